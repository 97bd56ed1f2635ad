"""Structured Streaming forms of the evidence operators. Each runs what is there and stops (available now), or stays on with a trigger of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import append_new
from ..sources.tables import shared_path


def events_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files: int = 1) -> DataFrame:
    """A file stream over parquet files, some files a batch."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{pattern}")


def run_all(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs the stream over all that is there; a checkpoint lets a later run go on from here."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(stream: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are dropped once their window has closed."""
    w = F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def windowed_result(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's windows after all files: in complete mode each batch replaces the result of the one before."""
    events = events_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared_path(spark, "windows")
    run_all(windowed(events), lambda batch, _: batch.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out)


def append_once(spark: SparkSession, stream: DataFrame, keys: list[str], store: str) -> None:
    """Appends rows with keys that the store lacks. A batch that runs again after a failure adds nothing, as its rows are there."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            held = spark.read.parquet(store)
        except Exception as e:  # the first batch makes the store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = batch.limit(0)
        append_new(held, batch, keys).write.mode("append").parquet(store)

    run_all(stream, add)


def recompute_touched(spark: SparkSession, stream: DataFrame, history: Callable[[DataFrame], DataFrame], key: str, compute: Callable[[DataFrame], DataFrame], out: str) -> None:
    """For every batch: the names it touches are computed anew over their whole history and replace their partition."""
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")

    def again(batch: DataFrame, _: int) -> None:
        touched = batch.select(key).distinct()
        compute(history(touched)).write.mode("overwrite").partitionBy(key).parquet(out)

    run_all(stream, again)


def paced(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests (provider, t, id): admitted unless `most` requests of the provider came in the seconds before; by a range frame."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("provider").orderBy("t").rangeBetween(-seconds, -1)
    return requests.withColumn("before", F.count(F.lit(1)).over(w)).withColumn("admitted", F.col("before") < most)


def back_off(stream: DataFrame, first: int = 30, most: int = 300) -> DataFrame:
    """Keyed state of (provider, ok): the wait after consecutive failures, doubling from first to most seconds; a success clears it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for rows in batches:
            for ok in rows.sort_values("t")["ok"]:
                failures = 0 if ok else failures + 1
        state.update((failures,))
        yield pd.DataFrame({"provider": [key[0]], "failures": [failures], "wait": [0 if not failures else min(most, first * 2 ** (failures - 1))]})

    return stream.groupBy("provider").applyInPandasWithState(step, "provider string, failures int, wait int", "failures int", "update", "NoTimeout")
