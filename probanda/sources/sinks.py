"""Sinks: report rows, boxes, receipts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines; Spark's _SUCCESS file marks a complete run."""
    entries.write.json(path)


def quoted_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("quoteAll", True).option("header", True).csv(path)


def receipts(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no receipt covers yet: what a resumed run has to do."""
    return items.join(done.select(key), key, "left_anti")


def coco(boxes: DataFrame) -> DataFrame:
    """One JSON document an image with its annotations in order."""
    a = F.struct(F.col("class").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"))
    return boxes.groupBy("image").agg(F.to_json(F.struct(F.array_sort(F.collect_list(a)).alias("annotations"))).alias("document"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    centre = lambda o, s, n: (F.col(o) + F.col(s) / 2) / F.col(n)
    return boxes.select("image", F.format_string("%d %.6f %.6f %.6f %.6f", "class", centre("x", "w", "width"), centre("y", "h", "height"), F.col("w") / F.col("width"), F.col("h") / F.col("height")).alias("line"))


def verified_manifest(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """By path: ok, changed (hash differs), missing or unlisted."""
    j = listing.select("path", F.col("sha256").alias("_l")).join(manifest.select("path", F.col("sha256").alias("_m")), "path", "full_outer")
    status = F.when(F.col("_m").isNull(), "unlisted").when(F.col("_l").isNull(), "missing").when(F.col("_l") == F.col("_m"), "ok").otherwise("changed")
    return j.select("path", status.alias("status"))


def update_shards(index: DataFrame, path: str) -> None:
    """Writes only the shards present in the rows; others stay as they are."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
