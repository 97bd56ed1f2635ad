"""Similar codes and vectors: radius joins, top-k, clusters, split review."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from .components import components

#: Query vectors that meet the index in one pass.
BLOCK = 4096


#: Rows up to this many (an id and its split) are broadcast.
SMALL = 2_000_000


def _held(codes: DataFrame) -> DataFrame:
    """code and the least id that has it, once for each code."""
    return written(codes.where("code is not null").groupBy("code").agg(F.min("id").alias("id")), "codes")


def hamming_pairs(codes: DataFrame, radius: int) -> DataFrame:
    """All pairs a < b within the radius (inclusive), exact; equal codes are first one code with its least id."""
    one = _held(codes)
    near = near_codes(one, None, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    same = codes.join(one.withColumnRenamed("id", "a"), "code").where("id > a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.union(same)


def all_hamming_pairs(codes: DataFrame, radius: int) -> DataFrame:
    """All pairs a < b within the radius with those between copies too: each pair of different codes for every two ids that have them."""
    one = _held(codes)
    copied = codes.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = codes.join(one.withColumnRenamed("id", "first").join(copied, "code"), "code").select("first", "id")
    side = lambda c: members.select(F.col("first").alias(c), F.col("id").alias(f"_{c}"))
    # Codes without copies, most of them, stand for themselves.
    apart = near_codes(one, None, radius).join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in "ab"})
    same = side("a").join(side("a").withColumnRenamed("_a", "b"), "a").where("_a < b").select(F.col("_a").alias("a"), "b", F.lit(0).alias("distance"))
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").union(same)


#: Codes of a block; every two blocks meet in a task, some of their rows at a time.
CODES, ROWS = 32_768, 64
#: Codes of both blocks of which all pairs are compared at once (a megabyte, which stays in a core's cache), and pairs that go on together.
TILE, PAIRS = (32, 4096), 200_000


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and in y of the pairs of codes within the radius, and their distances; if both are one list each pair once."""
    same = x is y
    for i in range(0, len(x), TILE[0]):
        for j in range(i // TILE[1] * TILE[1] if same else 0, len(y), TILE[1]):
            d = np.bitwise_count(x[i : i + TILE[0], None] ^ y[None, j : j + TILE[1]])
            near = d <= radius
            if near.any():
                p, q = np.nonzero(near)
                if same:
                    p, q = p[p + i < q + j], q[p + i < q + j]
                yield p + i, q + j, d[p, q]


def _joint(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links between codes x and y (one list if they are the same) that hang together what all pairs within the radius do, at most one a code."""
    same = x is y
    label = np.arange(len(x)) if same else np.arange(len(x) + len(y))
    shift = 0 if same else len(x)
    for low in range(0, len(x), ROWS):
        near = np.bitwise_count(x[low : low + ROWS, None] ^ y[None, :]) <= radius
        if same:
            near[np.arange(len(near)), np.arange(low, low + len(near))] = False
        for i in np.flatnonzero(near.any(1)):
            others = np.flatnonzero(near[i]) + shift
            parts, at = np.unique(label[others], return_index=True)
            own = label[low + i]
            for part, j in zip(parts, others[at], strict=True):
                if part != own:
                    yield low + int(i), int(j) - shift
            label[np.isin(label, parts)] = own


def _met(codes: DataFrame, others: DataFrame | None) -> DataFrame:
    """(id, code) of codes and others (None: of codes twice) in blocks of about CODES, once for each block that they meet: a group (_i, _j) is two blocks, _other tells rows of the second. Groups are dealt over so many parts that each is a task's."""
    count = lambda df: max(1, -(-df.count() // CODES))
    own = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n = count(codes)
    if others is None:
        rows = codes.select("id", "code", own(n).alias("_b"), each(n).alias("_o"))
        rows = rows.select("id", "code", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_other"))
        return rows.repartition(n * (n + 1), "_i", "_j")
    m = count(others)
    rows = codes.select("id", "code", own(n).alias("_i"), each(m).alias("_j"), F.lit(False).alias("_other"))
    return rows.union(others.select("id", "code", each(n).alias("_i"), own(m).alias("_j"), F.lit(True))).repartition(2 * n * m, "_i", "_j")


def _sides(rows: pd.DataFrame, one: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and codes of a group of _met(), of either block; if both are one block the same arrays."""
    sides = [(x["id"].to_numpy(), x["code"].to_numpy(np.int64).view(np.uint64)) for x in (rows[~rows["_other"]], rows[rows["_other"]])]
    return [sides[0]] * 2 if one else sides


def near_codes(codes: DataFrame, others: DataFrame | None, radius: int) -> DataFrame:
    """a, b, distance: all pairs within the radius of codes with others (both (id, code)), or, if that is None, of different rows of codes, each once. All are compared, in blocks; pairs leave their task some at a time."""
    alone = others is None

    def met(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (a, x), (b, y) = _sides(pd.concat(batches), alone and key[0] == key[1])
        held, size = [], 0
        pairs = lambda: pd.DataFrame({"a": a[np.concatenate([p for p, _, _ in held])], "b": b[np.concatenate([q for _, q, _ in held])], "distance": np.concatenate([d for _, _, d in held]).astype(np.int32)})
        for found in _near(x, y, radius):
            held.append(found)
            size += len(found[0])
            if size > PAIRS:
                yield pairs()
                held, size = [], 0
        if held:
            yield pairs()

    kinds = [dict(df.dtypes)["id"] for df in (codes, codes if alone else others)]
    return _met(codes, others).groupBy("_i", "_j").applyInPandas(met, f"a {kinds[0]}, b {kinds[1]}, distance int")


def joining_links(codes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of different codes (id, code) within the radius. All codes are compared, in blocks of about CODES, every two of which are a task's; of their pairs only as many go on as the components need."""

    def met(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (a, x), (b, y) = _sides(rows, key[0] == key[1])
        found = np.array(list(_joint(x, y, radius)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": a[found[:, 0]], "b": b[found[:, 1]]})

    kind = dict(codes.dtypes)["id"]
    return _met(codes, None).groupBy("_i", "_j").applyInPandas(met, f"a {kind}, b {kind}")


def hamming_query(queries: DataFrame, codes: DataFrame, radius: int) -> DataFrame:
    """Codes within the radius of each query."""
    some = lambda df, key: df.where("code is not null").select(F.col(key).alias("id"), "code")
    return near_codes(some(queries, "query"), some(codes, "id"), radius).select(F.col("a").alias("query"), F.col("b").alias("id"), "distance").distinct()


def clusters(codes: DataFrame, radius: int) -> DataFrame:
    """id, component: transitive clusters, named by their least id; codes without neighbours are their own."""
    one = _held(codes)
    copies = codes.join(one.withColumnRenamed("id", "a"), "code").where("id > a").select("a", F.col("id").alias("b"))
    c = components(joining_links(one, radius).union(copies))
    return codes.select("id").join(c, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _top_k(ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best rows of every batch for each query, queries being unit vectors; vectors without length match nothing."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["id"].to_numpy()
            v = np.array(batch["vector"].tolist(), np.float64) if len(batch) else np.zeros((0, queries.shape[1]))
            norms = np.sqrt((v * v).sum(1))
            rows, v = rows[norms > 0], v[norms > 0] / norms[norms > 0][:, None]
            if not len(rows):
                continue
            scores = np.round(np.clip(queries @ v.T, -1, 1), 9)
            # All that reach the k-th best score stay until ties are ordered by id.
            limit = np.partition(scores, -min(k, len(rows)), axis=1)[:, -min(k, len(rows))]
            q, i = np.nonzero(scores >= limit[:, None])
            order = np.lexsort((rows[i], -scores[q, i], q))
            q, i = q[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            yield pd.DataFrame({"query": ids[q], "id": rows[i], "cosine": scores[q, i]})[place < k]

    return best


def cosine_top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query, exact, ties by id. A stated set of queries meets all vectors, BLOCK queries at a time (which go to the tasks): each batch of the index keeps its k best for every query, then the batches' best are ranked. Vectors without length match nothing."""
    n = queries.count()
    block = F.floor((F.row_number().over(Window.orderBy("id")) - 1) / BLOCK) if n > BLOCK else F.lit(0)
    q, found = queries.select("id", "vector").withColumn("_block", block), None
    for i in range(-(-n // BLOCK)):
        rows = q.where(F.col("_block") == i).select("id", "vector").collect()
        v = np.array([r["vector"] for r in rows], np.float64)
        norms = np.sqrt((v * v).sum(1))
        ids = np.array([r["id"] for r in rows], np.int64)[norms > 0]
        hits = index.select(F.col("id").cast("long").alias("id"), "vector").mapInPandas(_top_k(ids, v[norms > 0] / norms[norms > 0][:, None], k), "query long, id long, cosine double")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = queries.limit(0).select(F.col("id").cast("long").alias("query"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("cosine"))
    order = [F.col("cosine").desc(), F.col("id")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k)


def content_pairs(items: DataFrame) -> DataFrame:
    """Equal content as (a, b): the least id of each digest with every other, so that n copies give n - 1 pairs."""
    first = items.groupBy("digest").agg(F.min("id").alias("a"))
    return items.join(first, "digest").where("id > a").select("a", F.col("id").alias("b"))


def cross_split(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Pairs whose sides belong to different splits."""
    few = F.broadcast if splits.count() <= SMALL else lambda x: x
    s = lambda c: few(splits.select(F.col("id").alias(c), F.col("split").alias(f"split_{c}")))
    return pairs.join(s("a"), "a").join(s("b"), "b").where("split_a <> split_b")


def recall_by_transform(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By transform: planted pairs and how many of them were found, in either order."""
    side = lambda df, flag: df.select(*(["transform"] if flag else []), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    f = side(found, False).distinct().withColumn("_f", F.lit(1))
    return side(truth, True).join(f, ["a", "b"], "left").groupBy("transform").agg(F.count(F.lit(1)).alias("planted"), F.count("_f").alias("found"), F.avg(F.coalesce("_f", F.lit(0))).alias("recall"))


def merge_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after upserts (vector given) and removals (vector null)."""
    c = changes.select("id", F.col("vector").alias("_v"), F.lit(True).alias("_changed"))
    j = index.join(c, "id", "full_outer")
    return j.select("id", F.when(F.col("_changed").isNotNull(), F.col("_v")).otherwise(F.col("vector")).alias("vector")).where("vector is not null")
