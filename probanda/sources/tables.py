"""Tables in the folder that all executors share: written once, read back, so that lineage ends and no executor's loss matters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a temporary folder stands in, but only if driver and tasks are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="probanda-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """df as a written table with its path; then the table at `old`, which df may have been made from, goes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if old:
        removed(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of a part of a table that is dealt.
PART = 250_000


def dealt(tables: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """The tables by their keys, all in the same number of parts, which grows with the largest: a task of a join or of groups by these keys holds about so many rows, however large the tables are."""
    spark = tables[0].sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(t.count() for t in tables) // PART))
    return [t.repartition(parts, *keys) for t in tables]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that shared_path() named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
