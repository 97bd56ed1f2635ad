"""Pairing two sets of captures by name or place, gating the differences, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import glob_pattern


def gate(value: Column, threshold: Column) -> Column:
    """pass iff value <= threshold; NaN and unknown values never pass."""
    return F.when(value.isNull() | F.isnan(value), "fail").when(value <= threshold, "pass").otherwise("fail")


def pair(baseline: DataFrame, capture: DataFrame, key: str = "name") -> DataFrame:
    """Full outer join on the key: b_*, c_* columns and status paired, missing (no capture) or new (no baseline)."""
    b = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in baseline.columns if c != key], F.lit(True).alias("_b"))
    c = capture.select(key, *[F.col(x).alias(f"c_{x}") for x in capture.columns if x != key], F.lit(True).alias("_c"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), "missing").otherwise("paired")
    return b.join(c, key, "full_outer").withColumn("status", status).drop("_b", "_c")


def matches(name: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike(glob_pattern(g))
    return found


def with_overrides(entries: DataFrame, rules: list[dict], defaults: dict, name: str = "name") -> DataFrame:
    """Per-name settings: for each field the first rule whose glob matches and that sets it wins, else the default. The rules are few and become one expression."""
    out = entries
    for field, default in defaults.items():
        chosen = [F.when(F.col(name).rlike(glob_pattern(r["glob"])), F.lit(r[field])) for r in rules if r.get(field) is not None]
        out = out.withColumn(field, F.coalesce(*chosen, F.lit(default)))
    return out


def gated(pairs: DataFrame, value: Column, threshold: str = "threshold") -> DataFrame:
    """status becomes pass or fail where both sides are there; value where it was measured."""
    out = pairs.withColumn("value", F.when(F.col("status") == "paired", value))
    return out.withColumn("status", F.when(F.col("status") == "paired", gate(F.col("value"), F.col(threshold))).otherwise(F.col("status")))


def totals(entries: DataFrame) -> DataFrame:
    """Counts by status in one row, and whether the run is a regression (an empty run is)."""
    statuses = ("pass", "fail", "new", "missing", "error")
    out = entries.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])
    return out.withColumn("regression", (F.col("total") == 0) | (F.col("n_fail") + F.col("n_missing") + F.col("n_error") > 0))


def only_in(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    return left.join(right, key, "left_anti")


def by_position(left: DataFrame, right: DataFrame, group: list[str], order: str, how: str = "inner") -> DataFrame:
    """The n-th of each group with the n-th; `full_outer` keeps the longer side."""
    w = Window.partitionBy(*group).orderBy(order)
    number = lambda df, p: df.select(*group, F.row_number().over(w).alias("place"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in group])
    return number(left, "b").join(number(right, "c"), [*group, "place"], how)


def manual(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Listed (i, j) pairs of places, in order `ord`, both of which exist. A pair is accepted if it is the first to name its i, and of such pairs the first to name its j: a pair refused for its i leaves its j free."""
    # Both names are joined to the accepted pairs only; until then a side is asked whether it has the place.
    ok = pairs.select("i", "j", "ord").join(left.toDF("i", "left").select("i"), "i", "left_semi").join(right.toDF("j", "right").select("j"), "j", "left_semi")
    ok = ok.groupBy("i").agg(F.min_by("j", "ord").alias("j"), F.min("ord").alias("ord"))
    ok = ok.groupBy("j").agg(F.min_by("i", "ord").alias("i"), F.min("ord").alias("ord"))
    return ok.join(left.toDF("i", "left").dropDuplicates(["i"]), "i").join(right.toDF("j", "right").dropDuplicates(["j"]), "j").select("j", "i", "ord", "left", "right")


def run_summary(entries: DataFrame, performance: DataFrame) -> DataFrame:
    """By run: counts of identical, changed, errors; worst entry by mean; mismatched when twice the matches fall short of the smaller side; and a flag.

    performance: (run, qualified, complete, moved), a run without a row is unqualified. Identical images
    are NO-EFFECT if a qualified, complete comparison moved nothing and PERF-ONLY if a qualified one moved
    something; IMAGE-CHANGE needs entries on both sides and no error; all else is INCONCLUSIVE."""
    worst = F.max_by("name", F.struct(F.col("mean"), F.col("name")))
    kinds = ("identical", "changed", "error", "only_ref", "only_run")
    out = entries.groupBy("run").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.max("mean").alias("worst_mean"), worst.alias("worst")).join(performance, "run", "left")
    matched, whole = F.col("identical") + F.col("changed"), F.col("error") + F.col("only_ref") + F.col("only_run") == 0
    same = whole & (F.col("identical") > 0) & (F.col("changed") == 0)
    says = lambda c: F.coalesce(F.col(c), F.lit(False))
    flag = F.when(same & says("qualified") & says("complete") & ~says("moved"), "NO-EFFECT").when(same & says("qualified") & says("moved"), "PERF-ONLY").when(whole & (F.col("changed") > 0), "IMAGE-CHANGE").otherwise("INCONCLUSIVE")
    return out.withColumn("mismatch", 2 * matched < F.least(matched + F.col("only_ref"), matched + F.col("only_run"))).withColumn("flag", flag).drop("qualified", "complete", "moved")
