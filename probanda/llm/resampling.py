"""Importance resampling towards a target distribution, by hashed n-gram counts.

Every run of 1 to WIDTH consecutive words falls into one of BUCKETS buckets by the
unsigned crc32 of its UTF-8 bytes. A bucket's gain is the logarithm of its
smoothed share in the target texts against its share in all documents, in
thousandths; a document weighs the sum of the gains of its features. Gumbel noise
keyed by doc_id is added, and the highest scores among documents of enough
words are drawn: sampling without replacement in proportion to the weights.

All of it is SQL: features are exploded, counted by bucket before they are
shuffled, and looked up in the table of gains, which has at most BUCKETS rows and
is therefore broadcast. Features are summed by (doc_id, hash of the text), a
row a document before the shuffle; rows alike in both are one group that is
counted and given back as often. Ranks come from ranges of the scores and the
counts of the ranges before, so no task sees all rows.

Null and empty texts and texts without words have no features and weigh 0. A null doc_id counts as
the empty text in the key of the noise, and goes last among equal scores. Without
target texts all gains follow from the smoothing alone. Rows alike in score and
doc_id are ranked in any order.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, written

BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: What parts words, after A-Z have become a-z.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z; null for null text."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, APART), "")


def _joined(words: Column, k: int):
    return lambda i: F.array_join(F.slice(words, i, k), " ")


def runs(words: Column, width: int) -> Column:
    """All runs of 1 to `width` consecutive words, joined by one space."""
    found = [words]
    for k in range(2, width + 1):
        places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(places, _joined(words, k)))
    return F.concat(*found) if width > 1 else words


def worded(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and _words. The words pass a generator, as a projection may be moved into the functions over them and be done for every run."""
    return docs.select(*columns, F.explode(F.array(plain_words(F.col("text").cast("string")))).alias("_words"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def gains(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket that the documents or the target texts use."""
    sides = [worded(t).select(F.explode(runs(F.col("_words"), width)).alias("f")).select(bucket(F.col("f"), buckets).alias("bucket"), F.lit(i).alias("side")) for i, t in enumerate((docs, target))]
    counts = [side.groupBy("bucket").agg(F.sum(1 - F.col("side")).alias("s"), F.sum("side").alias("t")) for side in sides]
    table = written(counts[0].union(counts[1]).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    all_s, all_t = table.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return table.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, keyed by the seed and the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    table = gains(docs, target, width, buckets)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_text"))
    rows = worded(rows, "doc_id", "_text").withColumn("n_words", F.size("_words"))
    each = rows.select("doc_id", "_text", "n_words", F.posexplode_outer(runs(F.col("_words"), width)).alias("_at", "_f"))
    each = each.withColumn("bucket", bucket(F.col("_f"), buckets)).join(F.broadcast(table), "bucket", "left")
    first = F.coalesce(F.col("_at") == 0, F.lit(True)).cast("long")
    grouped = each.groupBy("doc_id", "_text").agg(F.max("n_words").alias("n_words"), F.sum(first).alias("_rows"), F.count("_f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    share = lambda c: F.expr(f"{c} div _rows").alias(c)
    out = grouped.select("doc_id", F.col("n_words").cast("long").alias("n_words"), share("n_features"), share("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_nth")).drop("_nth")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for rows that are not drawn."""
    rows = written(weighted(docs, target, width, buckets, seed), "weights")
    long_enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(long_enough).count() // 100
    ranked = global_rank(rows.where(long_enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "scores")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents whose doc_id is drawn, with all their columns. Rows that repeat a drawn doc_id all stay."""
    ids = resampled(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")


#: crc32 byte by byte over the distinct words, its table made by the polynomial.
RESAMPLING_SQL = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (
       SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
f AS (SELECT r, unnest(words) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
       lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1]))) % {BUCKETS} AS bucket FROM v, tab),
n AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT bucket, 1 AS s, 0 AS t FROM f JOIN h USING (w) UNION ALL SELECT bucket, 0, 1 FROM b JOIN h USING (w)) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST((SELECT sum(s) FROM n) + {BUCKETS} AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST((SELECT sum(t) FROM n) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM n),
w AS (SELECT r, sum(gain) AS weight FROM f JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
s AS (SELECT r, doc_id, len(words) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, {PERCENT} * (count(*) FILTER (n >= {LEAST_WORDS}) OVER ()) // 100 AS drawn FROM z)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM k
"""
