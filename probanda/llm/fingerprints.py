"""Document fingerprints by prefix polynomial hashes.

A text's prefix array holds, for every position, the polynomial hash of what
stands before it, modulo the prime 2^31 - 1 and for two bases. Any two spans
are then equal with overwhelming certainty if two differences are, and the
longest common extension of two places is found by binary search.

A fingerprint has the length, the hash of the whole text, hashes of prefixes of
geometrically growing lengths, and the least hashes of the spans of SPAN code
points, by bin. The likeness of two fingerprints is the larger of the common
prefix (found by binary search) and the estimated share of common spans.

Null text counts as empty; empty texts are equal to each other. Rows with
equal doc_id stand in the order of their texts; null ids come last. The next
document of the only document is itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_ranges, partitions, range_of, text_batches

P = np.uint64((1 << 31) - 1)
SHIFT = np.uint64(31)
BASES = (1_000_003, 754_974_721 % int(P))
SPAN, BINS, STEPS = 24, 64, 48
#: Prefix lengths whose hashes a fingerprint keeps, growing by about a fifth.
GRID = np.unique((8 * 1.25 ** np.arange(STEPS)).astype(np.int64))


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> SHIFT)
    x = (x & P) + (x >> SHIFT)
    return np.where(x >= P, x - P, x)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.start = [np.uint64(base), np.uint64(pow(base, -1, int(P)))]
        self.up = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int, inverse: bool = False) -> np.ndarray:
        have = self.up[inverse]
        while len(have) < n:
            step = _mod(have[-1:] * self.start[inverse])[0]
            have = self.up[inverse] = np.concatenate([have, _mod(have * step)])
        return have[:n]


_POWERS = [_Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def prefix_array(points: np.ndarray, which: int = 0) -> np.ndarray:
    """n + 1 values: the sums of (code point + 1) * base^place before each place, modulo P."""
    terms = _mod((points + np.uint64(1)) * _POWERS[which].get(len(points)))
    return np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(terms))])  # 2^33 places fit 64 bits


def span_hash(prefix: np.ndarray, start: int, end: int, which: int = 0) -> int:
    """The hash of a span, the same wherever it stands."""
    diff = (int(prefix[end]) - int(prefix[start])) % int(P)
    return diff * pow(BASES[which], -start, int(P)) % int(P)


def common_extension(a: list[np.ndarray], i: int, b: list[np.ndarray], j: int) -> int:
    """How far the texts agree from place i of one and j of the other, by binary search over their prefix arrays (one per base)."""
    low, high = 0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if all(span_hash(a[w], i, i + mid, w) == span_hash(b[w], j, j + mid, w) for w in range(len(a))):
            low = mid
        else:
            high = mid - 1
    return low


def fingerprint(text: str) -> bytes:
    """Length (8 bytes), whole hashes (2 x 4), least span hashes of BINS bins (2 each), hashes of prefixes (4 each)."""
    points = code_points(text)
    n = len(points)
    first, second = prefix_array(points, 0), prefix_array(points, 1)
    size = min(SPAN, n)
    count = n - size + 1
    spans = _mod((first[size:] + P - first[:count]) * _POWERS[0].get(count, True)) if n else np.zeros(0, np.uint64)
    mixed = (spans * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)  # 40 bits: 6 of the bin, 34 of the value
    bins, values = (mixed >> np.uint64(34)).astype(np.int64), mixed & np.uint64((1 << 34) - 1)
    least = np.full(BINS, (1 << 34) - 1, np.uint64)
    np.minimum.at(least, bins, values)
    filled = np.bincount(bins, minlength=BINS) > 0
    sketch = np.where(filled, 1 + (least * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)) % np.uint64(65535), 0).astype("<u2")
    grid = first[GRID[GRID <= n]].astype("<u4")
    return n.to_bytes(8, "little") + int(first[n]).to_bytes(4, "little") + int(second[n]).to_bytes(4, "little") + sketch.tobytes() + grid.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    if not n or not m:
        return 0.0
    end = 16 + 2 * BINS
    x, y = np.frombuffer(a[16:end], "<u2"), np.frombuffer(b[16:end], "<u2")
    either = (x > 0) | (y > 0)
    same = float((x == y)[either].mean())
    shared = 2 * same / (1 + same)
    g, h = np.frombuffer(a[end:], "<u4"), np.frombuffer(b[end:], "<u4")
    low, high = 0, min(len(g), len(h))
    while low < high:  # prefixes that agree come before those that do not
        mid = (low + high + 1) // 2
        low, high = (mid, high) if g[mid - 1] == h[mid - 1] else (low, mid - 1)
    prefix = 2 * float(GRID[low - 1]) / (n + m) if low else 0.0
    return min(1.0, max(shared, prefix))


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range, descending; each waits for the one after it."""
    held = None
    for batch in batches:
        out = []
        for part, halo, doc_id, text in zip(batch["_range"], batch["_halo"], batch["doc_id"], batch["text"], strict=True):
            mark = fingerprint(text)
            if held is not None and held[0] == part:
                _, old_id, old, old_mark = held
                k = len(old) // 3
                changed = old[: len(old) - k] + text[:k]
                new = fingerprint(changed)
                out.append((old_id, len(old), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), old_mark.hex(), new.hex(), likeness(old_mark, new), likeness(old_mark, mark)))
            held = None if halo else (part, doc_id, text, mark)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the start of the next document's, in descending doc_id.

    Ids are dealt into ranges; the first document of the range after is added
    to each, so that no range waits for another and the text is shuffled once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = key_ranges(rows.where("doc_id is not null"), "doc_id", n)
    rows = rows.withColumn("_range", range_of(F.col("doc_id"), cuts))
    # At most len(cuts) + 1 rows; null ids count as the least.
    tops = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    following = {order[(i + 1) % len(order)]: part for i, part in enumerate(order)}
    none = F.array().cast("array<struct<part:int,halo:boolean>>")
    own = F.array(F.struct(F.col("_range").alias("part"), F.lit(False).alias("halo")))
    extra = none
    if following:
        to = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
        top = F.create_map(*[x for part in following for x in (F.lit(part), F.lit(tops[part]).cast("long"))])
        halo = F.struct(F.element_at(to, F.col("_range")).alias("part"), F.lit(True).alias("halo"))
        extra = F.when(F.col("doc_id").eqNullSafe(F.element_at(top, F.col("_range"))), F.array(halo)).otherwise(none)
    dealt = rows.withColumn("_to", F.explode(F.concat(own, extra))).select(F.col("_to.part").alias("_range"), F.col("_to.halo").alias("_halo"), "doc_id", "text")
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("_range")).sortWithinPartitions("_range", "_halo", F.col("doc_id").desc_nulls_last(), "text")
    # As text, ids pass through pandas unharmed beside nulls.
    marked = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_edited, SCHEMA.replace("doc_id long", "doc_id string"))
    return marked.withColumn("doc_id", F.col("doc_id").cast("long"))
