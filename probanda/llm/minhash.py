"""Near duplicates by circulant MinHash, banding and exact verification.

A document is its set of distinct WIDTH-word shingles. Two permutations of the
integers below 2^32 make all signature coordinates: the first scatters the
shingles, the second is shifted circularly by k places for coordinate k, and the
coordinate is the least value that it gives any shingle. COORDINATES coordinates are dealt to
bands of ROWS; documents that agree in a band share a bucket. A pair of similarity 0.8 shares none of 32
bands of 4 with probability 5e-8.

Sets that are equal are one node. Linking runs in three rounds. Nodes alone in a
bucket with one other are tried against it, and every node against the first
node of most of its larger buckets. Then, in buckets that still hold several
components, every node outside the largest one is tried against the BEST nodes of
other components whose signatures are most like its own, if that promises a link.
At last all pairs of different components that share a bucket are, if their sizes allow a link and
their signatures agree in no fewer coordinates than SLACK deviations below the
threshold's expectation; a pair is taken up in the first band in which it agrees.
Pairs within a component need no look, so groups of thousands of near copies
stay linear. Buckets above BLOCK nodes part into chunks, and each pair of chunks
is joined once, but for two of the largest component. All pairs are verified on whole sets: a node's set
is read once for each group of at most FOLLOWERS nodes that are tried against it, and in the last round
once for each bucket that needs it, so that pairs that do not link are never rows.

Words are runs without white space after lower-casing A-Z. A text of fewer than
WIDTH words is one shingle; null texts and texts without words have no
shingles, link with nothing and are their own component. Rows that share a
doc_id are one document that links through any of its texts. Rows with null
doc_id keep a null component, take no part and are kept.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import partitions, text_batches, written
from .ngram_join import near, shingle_set

WIDTH, PERCENT, COORDINATES, ROWS = 2, 80, 128, 4
#: Deviations of the share of agreeing coordinates; a link falls below with a probability near 1e-9.
SLACK = 6
#: Before all pairs are joined, a node is tried against so many nodes of a bucket, unless they agree in fewer coordinates than LIKELY deviations below.
BEST, LIKELY = 8, 2
BLOCK, FOLLOWERS = 2048, 256
#: And a chunk has about so many shingles, as a task holds the sets of two chunks.
BLOCK_WORDS = 4_000_000
#: Tables of ids up to this many rows (8 to 32 bytes each) are broadcast; longer ones are joined by shuffle.
SMALL = 2_000_000
#: Shingles that are permuted together, so that they stay in a core's cache.
TOGETHER = 100_000
#: Odd factors: the two permutations multiply by them and fold high bits into low ones, which can be undone.
FACTORS = [np.uint32(x) for x in (0x7FEB352D, 0x846CA68B, 0x9E3779B1, 0x85EBCA6B)]
STEP = np.uint32(0x61C88647)


def scattered(x: np.ndarray, first: np.uint32, second: np.uint32) -> np.ndarray:
    """A permutation of the integers below 2^32."""
    x = x ^ x >> np.uint32(16)
    x *= first
    x ^= x >> np.uint32(15)
    x *= second
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each set (64-bit hashes, none empty)."""
    out = np.empty((len(sets), coordinates), np.uint32)
    done = 0
    while done < len(sets):
        end, size = done, 0
        while end < len(sets) and (end == done or size + len(sets[end]) <= TOGETHER):
            size += len(sets[end])
            end += 1
        sizes = np.array([len(s) for s in sets[done:end]])
        starts = np.cumsum(sizes) - sizes
        x = scattered((np.concatenate(sets[done:end]) >> np.uint64(32)).astype(np.uint32), FACTORS[0], FACTORS[1])
        for k in range(coordinates):
            x -= STEP  # one more place around the circle
            out[done:end, k] = np.minimum.reduceat(scattered(x, FACTORS[2], FACTORS[3]), starts)
        done = end
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows).astype(np.uint64)
    keys = np.arange(1, k // rows + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    keys = np.repeat(keys, n, 0)
    for i in range(rows):
        keys = (keys ^ keys >> np.uint64(31) ^ parts[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ keys >> np.uint64(32)).view(np.int64)


def least_agreement(percent: int, coordinates: int, slack: float = SLACK) -> int:
    """The coordinates in which linked signatures agree at the least."""
    t = percent / 100
    return int(np.floor(coordinates * t - slack * np.sqrt(coordinates * t * (1 - t))))


def records(docs: DataFrame, width: int, coordinates: int, rows: int) -> DataFrame:
    """doc_id, hash (of the text), n, digest, keys and brief (a byte a coordinate) of every row, written once."""

    @F.pandas_udf("n long, digest binary, keys array<long>, brief binary")
    def describe(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        some = [i for i, s in enumerate(sets) if len(s)]
        out = pd.DataFrame({"n": [len(s) for s in sets], "digest": None, "keys": None, "brief": None}).astype({"digest": object, "keys": object, "brief": object})
        if some:
            found = signatures([sets[i] for i in some], coordinates)
            keys, brief = bands(found, rows), found.astype(np.uint8)
            for j, i in enumerate(some):
                out.at[i, "digest"] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                out.at[i, "keys"] = keys[j]
                out.at[i, "brief"] = brief[j].tobytes()
        return out

    return written(_texts(docs).select("doc_id", "hash", describe("text").alias("r")).select("doc_id", "hash", "r.*"), "signatures")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _small(df: DataFrame, count: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is at most SMALL rows."""
    return F.broadcast(df) if (df.count() if count is None else count) <= SMALL else df


def _first_band(x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """The first band in which the brief signatures x agree with y. Bytes agree by chance in an earlier band with a probability near 1e-8."""
    return (x == y).reshape(len(x), x.shape[1] // rows, rows).all(2).argmax(1)


def _buckets(rows: pd.DataFrame, percent: int) -> Iterator[tuple]:
    """Each bucket, or pair of its chunks: places of its rows by ascending size, their components (which may be changed meanwhile), and a function from a place to those that sizes, components and chunks let it link with (the later ones, or all)."""
    key, left, right, chunk, n, comp = (rows[c].to_numpy(np.int64) for c in ("key", "left", "right", "chunk", "n", "comp"))
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    for low, high in zip(starts, np.r_[starts[1:], len(key)], strict=True):
        order = low + np.argsort(n[low:high], kind="stable")
        sizes, comps, chunks = n[order], comp[order], chunk[order]
        if (comps == comps[0]).all():
            continue
        apart = left[low] != right[low]
        begins, ends = np.searchsorted(sizes * 100, sizes * percent, "left"), np.searchsorted(sizes * percent, sizes * 100, "right")

        def partners(i: int, later: bool, c=comps, k=chunks, b=begins, e=ends, apart=apart) -> np.ndarray:
            at = np.arange(i + 1 if later else b[i], e[i])
            return at[(c[at] != c[i]) & (k[at] != k[i] if apart else True)]

        yield order, comps, partners


def _briefs(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["brief"]), np.uint8).reshape(len(rows), -1)


def _most_alike(rows: pd.DataFrame, percent: int, least: int, per_band: int) -> pd.DataFrame:
    """Of each node outside the largest component of its bucket, the pairs with the BEST most like ones."""
    brief, node, out = _briefs(rows), rows["node"].to_numpy(np.int64), [np.zeros((0, 2), np.int64)]
    for order, comps, partners in _buckets(rows, percent):
        names, counts = np.unique(comps, return_counts=True)
        for i in np.flatnonzero(comps != names[counts.argmax()]):
            others = order[partners(i, False)]
            like = (brief[others] == brief[order[i]]).sum(1)
            others = node[others[np.argsort(-like, kind="stable")[:BEST]][: (like >= least).sum()]]
            out.append(np.column_stack([np.minimum(others, node[order[i]]), np.maximum(others, node[order[i]])]))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _alike(brief: np.ndarray, order: np.ndarray, i: int, others: np.ndarray, band: int, least: int, per_band: int) -> np.ndarray:
    """Those of the others that agree with i in enough coordinates, and in no earlier band."""
    x, y = brief[order[others]], brief[order[i]]
    ok = (x == y).sum(1) >= least
    ok[ok] = _first_band(x[ok], y, per_band) == band
    return others[ok]


def _still_open(rows: pd.DataFrame, percent: int, least: int, per_band: int) -> pd.DataFrame:
    """The rows that are to be compared with some other row of their bucket."""
    brief, band, wanted = _briefs(rows), rows["band"].to_numpy(), np.zeros(len(rows), bool)
    for order, _, partners in _buckets(rows, percent):
        for i in range(len(order) - 1):
            others = _alike(brief, order, i, partners(i, True), band[order[0]], least, per_band)
            wanted[order[others]] = True
            wanted[order[i]] |= bool(len(others))
    return rows[wanted]


def _links_within(rows: pd.DataFrame, percent: int, least: int, per_band: int) -> pd.DataFrame:
    """Links between components that the buckets hold, until they are one."""
    brief, band, node, out = _briefs(rows), rows["band"].to_numpy(), rows["node"].to_numpy(np.int64), []
    sets = [np.frombuffer(s, np.uint64) for s in rows["s"]]
    for order, comps, partners in _buckets(rows, percent):
        for i in range(len(order) - 1):
            for j in _alike(brief, order, i, partners(i, True), band[order[0]], least, per_band):
                if comps[i] != comps[j] and linked_sets(sets[order[i]], sets[order[j]], percent):
                    out.append(sorted((node[order[i]], node[order[j]])))
                    comps[comps == comps[j]] = comps[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def linked_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _by_bucket(work, *parameters):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket and chunks; the last of a batch wait for the rest of theirs."""
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ends = (rows[["key", "left", "right"]] == rows[["key", "left", "right"]].iloc[-1]).all(axis=1).to_numpy().argmax()
            held = rows.iloc[ends:]
            if ends:
                yield work(rows.iloc[:ends], *parameters)
        if held is not None:
            yield work(held, *parameters)

    return run


def _linked(percent: int):
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (a, part), first the set of a, then those that are tried against it."""
        now, head = None, None
        for batch in batches:
            out = []
            for a, part, node, follows, s in zip(*(batch[c] for c in ("a", "part", "node", "follows", "s")), strict=True):
                x = np.frombuffer(s, np.uint64)
                if not follows:
                    now, head = (a, part), x
                elif (a, part) == now:
                    if linked_sets(x, head, percent):
                        out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return linked


def sets_of(nodes: DataFrame, docs: DataFrame, names: DataFrame, width: int, repeated: bool) -> DataFrame:
    """node, s (its set) of the nodes. Only their texts are read for sets; of repeated rows one is."""
    wanted = written(names.join(nodes.distinct(), "node").select("doc_id", "hash", "node"), "wanted")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).tobytes() for t in texts], dtype=object)

    rows = _texts(docs).join(_small(wanted), ["doc_id", "hash"]).select("node", "text")
    return (rows.dropDuplicates(["node"]) if repeated else rows).select("node", packed("text").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose sets link. The set of a is read once for each FOLLOWERS pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
    tried = pairs.join(_small(parts), "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("node"), F.lit(True).alias("follows"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(False).alias("follows"))
    met = tried.union(heads).join(sets, "node").repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "follows")
    return written(met.select("a", "part", "node", "follows", "s").mapInPandas(_linked(percent), "a long, b long"), "links")


def open_buckets(members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components of the links, dealt and sorted by bucket and pair of chunks."""
    so_far = written(components(links), "so-far")
    rows = members.where("c > 2").join(_small(so_far), "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("comp"))
    rows = written(rows, "open")
    by_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("words"))
    largest = F.max(F.struct("count", "words", "comp")).alias("m")
    several = by_comp.groupBy("key").agg(F.sum("count").alias("size"), F.sum("words").alias("words"), largest, F.count(F.lit(1)).alias("comps")).where("comps > 1")
    # Chunks 0 to m - 1 have the other components' nodes, m to m + t - 1 those of the largest.
    chunks = lambda size, words: F.ceil(F.greatest(size / BLOCK, words / BLOCK_WORDS)).cast("int")
    wide = (F.col("size") > BLOCK) | (F.col("words") > BLOCK_WORDS)
    m = F.when(wide, chunks(F.col("size") - F.col("m.count"), F.col("words") - F.col("m.words"))).otherwise(1)
    t = F.when(wide, chunks(F.col("m.count"), F.col("m.words"))).otherwise(0)
    several = written(several.select("key", wide.alias("wide"), F.col("m.comp").alias("top"), m.alias("m"), t.alias("t")), "open-buckets")
    by_hash = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = rows.join(_small(several), "key")
    dealt = dealt.withColumn("chunk", F.when(~F.col("wide"), 0).when(F.col("comp") != F.col("top"), by_hash(F.col("m"))).otherwise(F.col("m") + by_hash(F.greatest("t", F.lit(1)))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("chunk") < F.col("m"), F.col("m") + F.col("t") - 1).otherwise(F.col("m") - 1))))
    sides = [F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right")]
    return sorted_buckets(dealt.select("key", "band", *sides, "chunk", "node", "n", "comp").join(nodes.select("node", "brief"), "node"))


def sorted_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key", "left", "right").sortWithinPartitions("key", "left", "right")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    found = records(docs, width, coordinates, rows)
    usable = found.where("n > 0 and doc_id is not null")
    # Each set is one node, whose texts are read again by the least doc_id and the text's hash.
    names = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("m")).select("digest", "m.*")
    names = written(names.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_names = names.count()
    repeated = bool(usable.groupBy("doc_id", "hash").count().where("count > 1").head(1))
    nodes = usable.drop("digest").join(_small(names.drop("digest"), n_names), ["doc_id", "hash"]).select("node", "n", "keys", "brief")
    nodes = written(nodes.dropDuplicates(["node"]) if repeated else nodes, "node-rows")
    keys = nodes.select(F.posexplode("keys").alias("band", "key"), "node", "n")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("m")).where("c > 1")
    shared = written(shared.select("key", "c", F.col("m.node").alias("center"), F.col("m.n").alias("center_n")), "buckets")
    members = written(keys.join(_small(shared), "key"), "members")

    twos = members.where("c = 2 and node > center").where(near("n", "center_n", percent)).select("center", "node")
    large = members.where("c > 2 and node > center").where(near("n", "center_n", percent)).groupBy("node", "center").agg(F.count(F.lit(1)).alias("k"))
    most = large.groupBy("node").agg(F.max(F.struct("k", "center")).alias("m")).select("m.center", "node")
    tried = written(twos.union(most).toDF("a", "b").distinct(), "candidates")
    sets = lambda x: sets_of(x, docs, names, width, repeated)
    ends = lambda x: x.select(F.col("a").alias("node")).union(x.select("b"))
    links = verified(tried, sets(ends(tried)), percent)

    least = least_agreement(percent, coordinates, LIKELY)
    likely = open_buckets(members, nodes, links).mapInPandas(_by_bucket(_most_alike, percent, least, rows), "a long, b long")
    likely = written(likely.distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    links = links.union(verified(likely, sets(ends(likely)), percent))

    least = least_agreement(percent, coordinates)
    rest = open_buckets(members, nodes, links)
    rest = written(rest.mapInPandas(_by_bucket(_still_open, percent, least, rows), rest.schema), "rest")
    rest = sorted_buckets(rest.join(sets(rest.select("node")), "node"))
    links = links.union(written(rest.mapInPandas(_by_bucket(_links_within, percent, least, rows), "a long, b long").distinct(), "links"))
    # From nodes to documents: links of their least ids, and those that the sets of one doc_id make.
    id_of = lambda x: names.select(F.col("node").alias(x), F.col("doc_id").alias(f"id_{x}"))
    between = links.join(_small(id_of("a"), n_names), "a").join(_small(id_of("b"), n_names), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    mixed = usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    least = names.select("digest", F.col("doc_id").alias("a"))
    same = usable.select("doc_id", "digest").join(mixed, "doc_id").join(least, "digest").where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    final = written(components(between.union(same)), "components")
    named = least.join(_small(final), F.col("a") == F.col("node"), "left").select("digest", F.coalesce("component", "a").alias("component"))
    out = found.select("doc_id", "n", "digest").join(_small(named, n_names), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that are the first of their component, with all their columns; rows that repeat such a doc_id stay, as do rows with null doc_id."""
    kept = near_duplicates(docs, **parameters).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long") == F.col("__kept"), "left_semi").unionByName(docs.where("doc_id is null"))


#: All pairs that share a shingle, by a join on shingles; components by the least id reachable.
DUPLICATES_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(a) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS a FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""
