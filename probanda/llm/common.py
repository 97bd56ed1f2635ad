"""What the training-data operators share: written tables that cut lineage, ranges of a key, words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import shared_path, written

__all__ = ["SPACES", "Ragged", "by_size", "chunked", "count_of", "give_back", "global_rank", "key_ranges", "partitions", "plain_parts", "range_of", "shared_path", "text_batches", "words", "written"]

#: The six white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"


#: Rows that go to Python at a time: whole texts are long, and a worker holds a few batches.
BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, BATCH)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The maximal runs without white space, in order; null text gives null."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text match the character class."""
    return F.regexp_count(text, F.lit(chars)).cast("long")


def key_ranges(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of an integer key that part its rows about evenly; only that column is read."""
    if n < 2:
        return []
    cuts = df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(x) for x in cuts})


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many cut points lie below the key: its range, ascending. Null keys belong to range 0."""
    if not cuts:
        return F.lit(0)
    below = F.when(key.isNotNull(), _halving(key, cuts, 0, len(cuts)))
    return F.coalesce(below, F.lit(0)).cast("int")


def _halving(key: Column, cuts: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key > F.lit(cuts[mid]), _halving(key, cuts, mid + 1, high)).otherwise(_halving(key, cuts, low, mid))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `rank` from 1 in the given order, by ranges: no task sees all rows, the driver sees one count a partition."""
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), name)
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, starts = 0, []
    for i in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)
    return dealt.withColumn("rank", offset + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range")


# --- inside tasks ----------------------------------------------------------

#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns freed memory to the system. Arrow and the C library keep it otherwise, and a worker that goes on to another stage holds it beside what that one needs."""
    pa.default_memory_pool().release_unused()
    _trim(0)


#: A word of letters, and a tail of ASCII marks without apostrophes.
PLAIN = r"\A(?P<word>\pL+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, dtype: str):
        self.flat, self.used = np.zeros(1024, dtype), 0
        self.starts, self.sizes, self.n = np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Appends rows; returns their numbers."""
        end, n = self.used + len(flat), self.n + len(sizes)
        self.flat, self.starts, self.sizes = self._room(self.flat, end), self._room(self.starts, n), self._room(self.sizes, n)
        self.flat[self.used : end] = flat
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        rows = np.arange(self.n, n)
        self.used, self.n = end, n
        return rows

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of these rows stand in `flat`, and how many each row has."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows, one after another, and how many each row has."""
        at, sizes = self.places(rows)
        return self.flat[at], sizes


def by_size(texts: list[str], limit: int) -> Iterator[list[str]]:
    """The texts in order, in groups that end as they reach `limit` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def chunked(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts cut at each space: the number of every chunk, the distinct chunks, and how many chunks each text has (the empty text one)."""
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def plain_parts(chunks: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which chunks are a word of letters with a tail of marks (maybe empty), and the words and tails of those."""
    found = pc.extract_regex(chunks, PLAIN)
    plain = found.is_valid()
    found = found.filter(plain)
    return plain.to_numpy(zero_copy_only=False), found.field("word"), found.field("tail")
