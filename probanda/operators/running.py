"""Sums over all rows in an order, without all rows in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables
from ..sources.tables import written


def running_sums(rows: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """rows with each column as its sum up to the row. Rows are parted into ranges of the order (written once, so that all steps see the same ranges); the driver adds up one row of sums a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns]).collect())
    before, w = dict.fromkeys(columns, 0), Window.partitionBy("_range").orderBy(order)
    starts: dict[str, list] = {c: [] for c in columns}
    for r in sums:
        for c in columns:
            starts[c] += [F.lit(r["_range"]), F.lit(before[c])]
            before[c] += r[c] or 0
    added = {c: F.sum(c).over(w) + (F.element_at(F.create_map(*starts[c]), F.col("_range")) if starts[c] else 0) for c in columns}
    return dealt.select(*[c for c in rows.columns if c not in columns], *[added[c].alias(c) for c in columns])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in the order. Ranges are sorted once, where they are written, in parts of about tables.PART rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // tables.PART))
    # An id made in order is the range (from bit 33 on) and the place in it.
    at = "_at"
    while at in rows.columns or at == name:
        at += "_"
    dealt = tables.written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    of = F.shiftright(at, 33)
    starts, before = [], 0
    for r in sorted(dealt.groupBy(of.alias("_range")).count().collect()):
        starts += [F.lit(r["_range"]), F.lit(before)]
        before += r["count"]
    place = F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn(name, place + F.element_at(F.create_map(*starts), of) if starts else place).drop(at)
