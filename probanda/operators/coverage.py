"""Declared against supplied cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, supplied: DataFrame, key: str = "case_id") -> DataFrame:
    """Outcome of every expected case: duplicate_expected, duplicate_supplied, missing, missing_optional or supplied; supplied cases that nobody expects are unexpected."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("n_expected"), F.max("required").alias("required"))
    s = supplied.groupBy(key).agg(F.count(F.lit(1)).alias("n_supplied"))
    j = e.join(s, key, "full_outer")
    outcome = (
        F.when(F.col("n_expected").isNull(), "unexpected").when(F.col("n_expected") > 1, "duplicate_expected").when(F.col("n_supplied") > 1, "duplicate_supplied")
        .when(F.col("n_supplied").isNull(), F.when(F.col("required"), "missing").otherwise("missing_optional")).otherwise("supplied"))
    return j.select(key, F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_supplied", F.lit(0)).alias("n_supplied"), outcome.alias("outcome"))


def outcome_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def by_axes(cases: DataFrame, axes: list[str]) -> DataFrame:
    """Counts of outcomes for each group of variants and for all cases (null axes); they sum to the expected."""
    g = cases.rollup(*axes).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("expected"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "missing")])
    return g.where((F.col("_g") == 0) | (F.col("_g") == (1 << len(axes)) - 1)).drop("_g")


def correspondence(pairs: DataFrame) -> DataFrame:
    """Whether (a, b) is one to one: how many sides are used more than once."""
    over = lambda c: pairs.groupBy(c).count().where("count > 1").agg(F.count(F.lit(1)).alias(f"repeated_{c}"))
    return over("a").crossJoin(over("b")).withColumn("bijective", (F.col("repeated_a") == 0) & (F.col("repeated_b") == 0))
