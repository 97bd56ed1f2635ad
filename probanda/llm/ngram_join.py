"""N-gram Jaccard join through count vectors in R-trees.

A document is its set of distinct WIDTH-word shingles (64-bit hashes). The
shingles are hashed into groups, about one for each (but GROUPS to
MOST_GROUPS, by powers of two, so that fine points fold into coarse ones); a
document's group counts are a point, and the sum of the smaller coordinates of two points bounds the overlap of
their sets. Pairs whose bound reaches the least overlap that the threshold
asks for are verified on the sets themselves.

Points are brought together by blocks, so that no tree needs all documents:
documents that link share one of the first n - ceil(t n) + 1 shingles in any common order, and each
such shingle is a block. The order puts frequent shingles last, so that
common passages hardly ever open a block. Sets that are equal are one node.
Linking runs in two rounds: nodes alone in a block with one other are tried
against it, and every node against the first node of most of its larger
blocks; then, in larger blocks that still hold several components, a tree
finds all pairs of different components whose bound suffices. Pairs within a
component need no look, so groups of thousands of near copies stay linear.
Blocks above BLOCK nodes are split into chunks of about BLOCK, those of the largest
component's nodes apart from the others; each pair of chunks is joined once, but for two
of the largest component, so that no task has more than two chunks.

Words are runs without white space after lower-casing A-Z. A text of fewer than
WIDTH words is one shingle; null texts and texts without words have no
shingles, link with nothing and are their own component. Rows that share a
doc_id are one document that links through any of its texts. Rows with null
doc_id keep a null component and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import give_back, partitions, text_batches, written

WIDTH, PERCENT, GROUPS, MOST_GROUPS = 4, 85, 256, 1024
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Shingles of so many documents are counted at a time; those seen once in it are not reported.
COUNTED = 1_000_000
#: Of the shingles seen more than FREQUENT times, as many as fit HOT_LIST (16 bytes each) go last in the order; which ones they are changes the cost only.
FREQUENT, HOT_LIST = 32, 262_144
BLOCK, LEAF, FAN = 4096, 24, 8
#: Tables of ids up to this many rows (8 to 32 bytes each) are broadcast; longer ones are joined by shuffle.
SMALL = 2_000_000


#: Words whose hashes a worker remembers, then forgets together.
REMEMBERED = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ out >> np.uint64(29)) * MIX[k % 3] + h[k : n - size + 1 + k]
    out = (out ^ out >> np.uint64(32)) * MIX[0]
    return np.unique(out ^ out >> np.uint64(29))


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text; then what they took is given back."""
    for text in texts:
        yield shingle_set(text, width)
    give_back()


def group_counts(hashes: np.ndarray) -> bytes:
    """The point: counts of the groups, a byte each, after one byte with the number of groups as a power of two. Counts beyond 254 read as without limit."""
    groups = GROUPS
    while groups < len(hashes) and groups < MOST_GROUPS:
        groups *= 2
    counts = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % groups, minlength=groups)
    return bytes([groups.bit_length() - 1]) + np.minimum(counts, 255).astype(np.uint8).tobytes()


class Points:
    """Points of one column, as matrices of every number of groups that some of them reach."""

    def __init__(self, column: pd.Series):
        raw = column.tolist()
        self.groups = np.array([1 << b[0] for b in raw], np.int64)
        self.rows, self.matrix = {}, {}
        finer, kept = None, None
        for groups in sorted({GROUPS, *self.groups.tolist()}, reverse=True):
            own = np.flatnonzero(self.groups == groups)
            m = np.frombuffer(b"".join(raw[i][1:] for i in own), np.uint8).reshape(len(own), groups).astype(np.int32)
            m[m == 255] = 1 << 20
            if kept is not None and len(kept):
                own, m = np.concatenate([own, kept]), np.concatenate([m, finer.reshape(len(kept), -1, groups).sum(1, dtype=np.int32)])
            kept, finer = own, m
            place = np.full(len(raw), -1, np.int64)
            place[own] = np.arange(len(own))
            self.rows[groups], self.matrix[groups] = place, m

    def coarse(self) -> np.ndarray:
        return self.matrix[GROUPS][self.rows[GROUPS]]

    def at(self, groups: int, i: np.ndarray) -> np.ndarray:
        return self.matrix[groups][self.rows[groups][i]]


def bounded(left: Points, i: np.ndarray, n: np.ndarray, right: Points, j: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the points of the pairs (i, j), as fine as both have them, allow the overlap that sizes n and m need."""
    groups, need, ok = np.minimum(left.groups[i], right.groups[j]), least_overlap(n, m, percent), np.zeros(len(i), bool)
    for g in np.unique(groups).tolist():
        at = np.flatnonzero(groups == g)
        for low in range(0, len(at), 4_000_000 // g):
            part = at[low : low + 4_000_000 // g]
            ok[part] = np.minimum(left.at(g, i[part]), right.at(g, j[part])).sum(1) >= need[part]
    return ok


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def _frequent(width: int):
    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

        for batch in batches:
            for found in shingle_sets(batch["text"], width):
                held.append(found)
                size += len(held[-1])
                if size > COUNTED:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return frequent

def frequent_shingles(rows: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and frequencies of at most HOT_LIST frequent shingles."""
    counts = written(rows.select("text").mapInPandas(_frequent(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT), "frequent")
    room, least = HOT_LIST, 1 << 62
    for r in sorted(counts.groupBy(F.floor(F.log2("n") * 4).alias("q")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["q"]):
        room -= r["c"]
        if room < 0:
            break
        least = r["n"]
    found = counts.where(F.col("n") >= least).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy(np.int64)[order]


def block_keys(hashes: np.ndarray, hot: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of the set in the common order: rare ones by hash, then frequent ones by frequency and hash."""
    n = len(hashes)
    take = n + (-percent * n // 100) + 1
    if not len(hot):
        return hashes[:take]
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    known = hot[at] == hashes
    rare = hashes[~known]
    if len(rare) >= take:
        return rare[:take]
    rest = hashes[known][np.lexsort((hashes[known], often[at[known]]))]
    return np.concatenate([rare, rest[: take - len(rare)]])


def records(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (its number), n, digest, point, keys of every row, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, width))

    rows = rows.withColumn("row", F.monotonically_increasing_id())

    @F.pandas_udf("n long, digest binary, point binary, keys array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for h in shingle_sets(texts, width):
            if len(h):
                out.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), group_counts(h), block_keys(h, *hot.value, percent).view(np.int64)))
            else:
                out.append((0, None, None, np.zeros(0, np.int64)))
        return pd.DataFrame(out, columns=["n", "digest", "point", "keys"])

    return written(rows.select("doc_id", "row", describe("text").alias("r")).select("doc_id", "row", "r.*"), "records")


def _small(df: DataFrame, count: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is at most SMALL rows."""
    return F.broadcast(df) if (df.count() if count is None else count) <= SMALL else df


def suffices(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, n_a, n_b, p_a, p_b) whose sizes and points allow a link."""

    @F.pandas_udf("boolean")
    def bound(n: pd.Series, m: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        at = np.arange(len(n))
        return pd.Series(bounded(Points(p), at, n.to_numpy(), Points(q), at, m.to_numpy(), percent))

    return pairs.where(near("n_a", "n_b", percent)).where(bound("n_a", "n_b", "p_a", "p_b"))


def near(n: str, m: str, percent: int = PERCENT) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


class RTree:
    """Points in leaves of LEAF, packed by size and then by the most varied coordinate of each slab; boxes keep the largest coordinates, as overlap is bounded from above."""

    def __init__(self, points: np.ndarray, n: np.ndarray, labels: list[np.ndarray], percent: int = PERCENT):
        """Pairs are looked for that differ in every label."""
        self.percent = percent
        order = np.lexsort((n, labels[-1])) if len(labels) > 1 else np.argsort(n, kind="stable")
        slab = LEAF * FAN
        for low in range(0, len(order), slab):
            part = order[low : low + slab]
            widest = int(np.argmax(points[part].max(0) - points[part].min(0)))
            order[low : low + slab] = part[np.argsort(points[part, widest], kind="stable")]
        self.order, self.points, self.n, self.labels = order, points[order], n[order], [x[order] for x in labels]
        level, wide = (self.points, self.n, self.n, self.labels, self.labels), LEAF
        self.levels: list[tuple] = []
        while not self.levels or len(self.levels[-1][1]) > 1:
            cuts = np.arange(0, len(level[1]), wide)
            least, most = (lambda x, c=cuts: np.minimum.reduceat(x, c, axis=0)), (lambda x, c=cuts: np.maximum.reduceat(x, c, axis=0))
            level, wide = (most(level[0]), least(level[1]), most(level[2]), [least(x) for x in level[3]], [most(x) for x in level[4]]), FAN
            self.levels.append(level)

    def _open(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of boxes, those that may hold a link between rows that differ in every label."""
        high, small, large, firsts, lasts = self.levels[level]
        ok = (100 * large[i] >= self.percent * small[j]) & (100 * large[j] >= self.percent * small[i])
        for first, last in zip(firsts, lasts, strict=True):
            ok &= ~((first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j]))
        i, j = i[ok], j[ok]
        out = [np.zeros(0, bool)]
        for low in range(0, len(i), 16_000):
            a, b = i[low : low + 16_000], j[low : low + 16_000]
            out.append(np.minimum(high[a], high[b]).sum(1) >= least_overlap(small[a], small[b], self.percent))
        ok = np.concatenate(out)
        return i[ok], j[ok]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (in the given points) whose bound allows a link: the tree joined with itself from the top."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            i, j = self._open(level, i, j)
            size, wide = (len(self.levels[level - 1][1]), FAN) if level else (len(self.n), LEAF)
            found = [(np.zeros(0, np.int64),) * 2]
            step = max(1, 400_000 // (wide * wide))
            for low in range(0, len(i), step):
                a = (i[low : low + step, None] * wide + np.arange(wide))[:, :, None]
                b = (j[low : low + step, None] * wide + np.arange(wide))[:, None, :]
                a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
                ok = (a < size) & (b < size) & (a <= b if level else a < b)
                a, b = a[ok], b[ok]
                if not level:
                    ok = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
                    for x in self.labels:
                        ok &= x[a] != x[b]
                    a, b = a[ok], b[ok]
                    ok = np.zeros(len(a), bool)
                    for at in range(0, len(a), 16_000):
                        x, y = a[at : at + 16_000], b[at : at + 16_000]
                        ok[at : at + 16_000] = np.minimum(self.points[x], self.points[y]).sum(1) >= least_overlap(self.n[x], self.n[y], self.percent)
                    a, b = a[ok], b[ok]
                found.append((a, b))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.order[i], self.order[j]


def _join_blocks(percent: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block; the last block of a batch waits for the rest of its rows."""
        seen: set[tuple[int, int]] = set()

        def joined(rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            key, left, right, chunk, node, n, comp = (rows[c].to_numpy(np.int64) for c in ("key", "left", "right", "chunk", "node", "n", "comp"))
            fine = Points(rows["point"])
            points = fine.coarse()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            out = []
            for low, high in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                if high - low < 2:
                    continue
                at = slice(low, high)
                labels = [comp[at]] if left[low] == right[low] else [comp[at], chunk[at]]
                i, j = RTree(points[at], n[at], labels, percent).pairs()
                ok = bounded(fine, low + i, n[low + i], fine, low + j, n[low + j], percent)
                i, j = i[ok], j[ok]
                a, b = node[at][i], node[at][j]
                for x in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
                    if x not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(x)
                        out.append(x)
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else joined(rows[:0])

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ends = (rows[["key", "left", "right"]] == rows[["key", "left", "right"]].iloc[-1]).all(axis=1).to_numpy().argmax()
            held = rows.iloc[ends:]
            yield joined(rows.iloc[:ends])
        if held is not None:
            yield joined(held)
        give_back()

    return join


def verified(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, repeated: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets link. Only texts that some pair names are read for their sets; of repeated rows one is."""
    pairs = written(pairs.select("a", "b").distinct(), "candidates")
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([h.tobytes() for h in shingle_sets(texts, width)], dtype=object)

    rows = rows.join(_small(wanted), "node", "left_semi")
    if repeated:
        rows = rows.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["node", "_hash"])
    sets = rows.select("node", packed("text").alias("s"))

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(left, right, strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if not len(x) or not len(y):  # another text of the same doc_id
                out.append(False)
                continue
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left, right = sets.toDF("a", "s_a"), sets.toDF("b", "s_b")
    return written(pairs.join(left, "a").join(right, "b").where(linked("s_a", "s_b")).select("a", "b").distinct(), "links")


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link whose sets of width-word shingles have a Jaccard similarity of percent or more."""
    spark: SparkSession = docs.sparkSession
    text_batches(spark)
    found = records(docs, width, percent)
    usable = found.where("n > 0 and doc_id is not null")
    # A set's node is its least doc_id, described by one row; a doc_id of several sets links their nodes.
    names = written(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("row", "doc_id").alias("row")), "nodes")
    n_names = names.count()
    nodes = usable.join(_small(names.select("node", "row"), n_names), "row").select("node", "n", "point", "keys")
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    held = written(usable.select("doc_id", "digest").join(several, "doc_id").join(names.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "several")
    same = held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    repeated = bool(usable.groupBy("doc_id", "digest").count().where("count > 1").head(1))
    keys = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("center"), F.min_by("n", "node").alias("center_n")).where("c > 1"), "blocks")
    members = written(keys.join(_small(shared), "key"), "members")
    points = nodes.select("node", "n", "point")
    side = lambda x: points.toDF(x, f"n_{x}", f"p_{x}")

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(suffices(pairs.join(side("a"), "a").join(side("b"), "b"), percent), docs, width, percent, repeated)

    twos = members.where("c = 2 and node > center").where(near("n", "center_n", percent)).select(F.col("center").alias("a"), F.col("node").alias("b"))
    large = members.where("c > 2 and node > center").where(near("n", "center_n", percent)).groupBy("node", "center").agg(F.count(F.lit(1)).alias("k"))
    best = large.groupBy("node").agg(F.max_by("center", "k").alias("a")).select("a", F.col("node").alias("b"))
    first = checked(twos.union(best).distinct()).union(same)
    so_far = written(components(first), "so-far")
    # Blocks whose nodes are of one component are done.
    open_rows = members.where("c > 2").join(_small(so_far), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_rows = written(open_rows, "open")
    by_comp = open_rows.groupBy("key", "comp").count()
    blocks = written(by_comp.groupBy("key").agg(F.sum("count").alias("size"), F.max_by("comp", "count").alias("top"), F.max("count").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1"), "open-blocks")
    # Chunks 0 to m - 1 have the other components' nodes, m to m + t - 1 those of the largest.
    large = F.col("size") > BLOCK
    m = F.when(large, F.ceil((F.col("size") - F.col("most")) / BLOCK)).otherwise(1).cast("int")
    t = F.when(large, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int")
    by_hash = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = open_rows.join(_small(blocks), "key").withColumn("m", m).withColumn("t", t)
    rows = rows.withColumn("chunk", F.when(~large, 0).when(F.col("comp") != F.col("top"), by_hash(F.col("m"))).otherwise(F.col("m") + by_hash(F.greatest("t", F.lit(1)))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("chunk") < F.col("m"), F.col("m") + F.col("t") - 1).otherwise(F.col("m") - 1))))
    rows = rows.select("key", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "node", "comp").join(points, "node")
    dealt = rows.repartition(partitions(spark), "key", "left", "right").sortWithinPartitions("key", "left", "right")
    more = dealt.mapInPandas(_join_blocks(percent), "a long, b long").distinct()
    second = checked(more.join(first, ["a", "b"], "left_anti"))
    final = written(components(first.union(second)), "components")
    named = _small(names.drop("row").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), n_names)
    out = found.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have an earlier document in their component; of rows that repeat a doc_id one stays. Rows with null doc_id stay."""
    kept = written(near_copies(docs, width, percent).where("doc_id is not null and component_id = doc_id").groupBy("doc_id").count(), "kept")
    n = kept.count()
    key = F.col("doc_id").cast("long") == F.col("__kept_id")
    once = _small(kept.where("count = 1").select(F.col("doc_id").alias("__kept_id")), n)
    often = _small(kept.where("count > 1").select(F.col("doc_id").alias("__kept_id")), n)
    repeated = docs.join(often, key, "left_semi").dropDuplicates(["doc_id"])
    return docs.join(once, key, "left_semi").unionByName(repeated).unionByName(docs.where("doc_id is null"))
