"""Queries of votes, coverage, similarity, grids, intervals and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components, coverage, grids, intervals, perceptual, similarity, text, votes
from ..sources.tables import table, written
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- votes -----------------------------------------------------------------

PRED = "WITH p AS (SELECT least(1.0, n_chars / 5000.0) AS confidence, quality AS correct FROM documents JOIN labels USING (doc_id))"


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("confidence"), F.col("quality").alias("correct"))


BINS = PRED + ", b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct) AS accuracy FROM p GROUP BY 1)"


@query(BINS + " SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM b")
def reliability_bins(spark, sf_dir):
    return votes.reliability(predictions(spark, sf_dir)).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(BINS + " SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, sf_dir):
    return votes.calibration_error(predictions(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query(PRED + ", c AS (SELECT confidence, count(*) AS n, sum(correct) AS good FROM p GROUP BY 1), t AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS n, sum(good) OVER (ORDER BY confidence DESC) AS good FROM c) SELECT round(min(confidence), 6) AS gate FROM t WHERE n >= 20 AND good / n >= 0.9")
def suggested_gate(spark, sf_dir):
    return votes.suggested_gate(predictions(spark, sf_dir), 0.9, 20).select(F.round("gate", 6).alias("gate"))


VOTES = "WITH v AS (SELECT l_partkey AS unit, l_suppkey AS rater, l_returnflag AS answer FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1)"


def first_votes(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("rater"), F.col("l_returnflag").alias("answer"), "l_orderkey", "l_linenumber")
    return votes.first_votes(v, ["l_orderkey", "l_linenumber"]).select("unit", "rater", "answer")


@query(VOTES + ", m AS (SELECT unit, count(*) AS m FROM v GROUP BY 1 HAVING count(*) > 1), c AS (SELECT unit, m, answer, count(*) AS k FROM v JOIN m USING (unit) GROUP BY ALL), a AS (SELECT sum(k * (k - 1) / (m - 1)) AS o, sum(k) AS n FROM c), e AS (SELECT sum(c * (c - 1)) AS e FROM (SELECT answer, sum(k) AS c FROM c GROUP BY 1)) SELECT round(1 - (1 - o / n) / (1 - e / (n * (n - 1))), 6) AS alpha, n::BIGINT AS values FROM a, e")
def krippendorff_alpha(spark, sf_dir):
    return votes.krippendorff(first_votes(spark, sf_dir)).select(F.round("alpha", 6).alias("alpha"), "values")


@query(VOTES + ", c AS (SELECT unit, answer, count(*) AS k FROM v GROUP BY ALL), t AS (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY unit ORDER BY k DESC) = 1) SELECT unit, CASE WHEN count(*) = 1 THEN max(answer) END AS answer, max(k) AS votes FROM t GROUP BY unit")
def consensus(spark, sf_dir):
    return votes.consensus(first_votes(spark, sf_dir))


@query(VOTES + ", c AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, count(*) OVER (PARTITION BY unit, answer) AS k FROM v QUALIFY n > 1) SELECT rater, sum(n - 1)::BIGINT AS peers, round(sum(k - 1) / sum(n - 1), 6) AS agreement FROM c GROUP BY rater")
def peer_agreement(spark, sf_dir):
    return votes.peer_agreement(first_votes(spark, sf_dir)).select("rater", "peers", F.round("agreement", 6).alias("agreement"))


JUDGE = "SELECT o_orderkey // 2 AS \"case\", CASE WHEN o_orderkey % 2 = 0 THEN 'ab' ELSE 'ba' END AS ord, CASE WHEN o_orderstatus = 'P' THEN 'abstain' WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS choice FROM orders"


@query(f"WITH j AS ({JUDGE}), p AS (SELECT \"case\", max(choice) FILTER (ord = 'ab') AS ab, max(choice) FILTER (ord = 'ba') AS ba FROM j GROUP BY 1), q AS (SELECT *, ab <> 'abstain' AND ba <> 'abstain' AS said FROM p WHERE ab IS NOT NULL AND ba IS NOT NULL), t AS (SELECT count(*) AS cases, count(*) FILTER (NOT said) AS abstained, count(*) FILTER (said AND ab = ba) AS flips, count(*) FILTER (said) AS s, sum((ab = 'first')::INT + (ba = 'first')::INT) FILTER (said) AS f FROM q) SELECT cases, abstained, flips, round(flips / s, 6) AS flip_rate, round(f / (2 * s), 6) AS first_share FROM t")
def position_bias(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    j = o.select(F.floor(F.col("o_orderkey") / 2).alias("case"), F.when(F.col("o_orderkey") % 2 == 0, "ab").otherwise("ba").alias("ord"), F.when(F.col("o_orderstatus") == "P", "abstain").when(F.col("o_orderstatus") == "F", "first").otherwise("second").alias("choice"))
    return votes.position_bias(j).select("cases", "abstained", "flips", F.round("flip_rate", 6).alias("flip_rate"), F.round("first_share", 6).alias("first_share"))


@query("WITH s AS (SELECT l_partkey AS item, l_returnflag AS answer, round(sum(l_quantity * (1 - l_discount)), 9) AS score, count(*) AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(score) OVER (PARTITION BY item) AS total, sum(k) OVER (PARTITION BY item) AS n FROM s QUALIFY rank() OVER (PARTITION BY item ORDER BY score DESC) = 1), t AS (SELECT item, min(answer) AS answer, max(score) / max(total) AS share, max(n)::BIGINT AS judges, max(k) AS k, count(*) AS ties FROM r GROUP BY item) SELECT item, answer, round(share, 6) AS share, judges, round(k / judges, 6) AS agreement, CASE WHEN ties > 1 THEN 'tie' WHEN judges < 2 THEN 'few_judges' WHEN share < 0.6 THEN 'low_share' END AS escalated FROM t")
def panel_scores(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("answer"), F.col("l_quantity").alias("weight"), (1 - F.col("l_discount")).alias("prob"))
    p = votes.panel(v)
    return p.select("item", "answer", F.round("share", 6).alias("share"), "judges", F.round("agreement", 6).alias("agreement"), "escalated")


@query("WITH g AS (SELECT l_partkey AS item, l_suppkey AS judge, count(DISTINCT l_returnflag) AS n, bool_or(l_returnflag = 'N') AS a, min(l_returnflag) AS x, avg(1 - l_discount) AS p FROM lineitem GROUP BY 1, 2) SELECT item, judge, CASE WHEN a THEN 'abstain' WHEN n > 1 THEN 'flip' ELSE 'consistent' END AS status, CASE WHEN NOT a AND n = 1 THEN x END AS answer, CASE WHEN NOT a AND n = 1 THEN round(p, 6) END AS prob FROM g")
def merged_orders(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("judge"), F.when(F.col("l_returnflag") == "N", "abstain").otherwise(F.col("l_returnflag")).alias("answer"), (1 - F.col("l_discount")).alias("prob"))
    return votes.merged_orders(v).withColumn("prob", F.round("prob", 6))


@query("SELECT l_partkey, l_suppkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS answer, count(*) AS n, min(l_linestatus) <> max(l_linestatus) AS conflict FROM lineitem GROUP BY 1, 2")
def merged_labels(spark, sf_dir):
    return votes.merged_labels(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_linestatus")


@query("WITH r AS (SELECT o_orderpriority AS stratum, o_orderstatus AS truth, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 120000 THEN 'O' ELSE 'P' END AS said FROM orders), t AS (SELECT stratum, truth AS class, count(*) AS support, count(*) FILTER (truth = said) AS hits FROM r GROUP BY 1, 2), s AS (SELECT stratum, said AS class, count(*) AS claims FROM r GROUP BY 1, 2) SELECT stratum, class, coalesce(support, 0) AS support, round(coalesce(hits, 0) / nullif(coalesce(claims, 0), 0), 6) AS precision, round(hits / nullif(support, 0), 6) AS recall FROM t FULL JOIN s USING (stratum, class)")
def class_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("truth"), F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_totalprice") > 120000, "O").otherwise("P").alias("said"))
    return votes.classification(r).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


TRIALS = "SELECT o_orderpriority AS class, o_custkey % 3 AS gate, CASE o_orderstatus WHEN 'F' THEN 'detected' WHEN 'O' THEN 'missed' ELSE 'excluded' END AS outcome, o_totalprice AS magnitude FROM orders"


@query(f"WITH t AS ({TRIALS}), g AS (SELECT class, gate, count(*) FILTER (outcome = 'detected') AS detected, count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome = 'unavailable') AS unavailable, min(magnitude) FILTER (outcome = 'detected') AS smallest FROM t GROUP BY 1, 2) SELECT *, round(missed / nullif(detected + missed, 0), 6) AS miss_rate FROM g")
def sensitivity_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderpriority").alias("class"), (F.col("o_custkey") % 3).alias("gate"), F.when(F.col("o_orderstatus") == "F", "detected").when(F.col("o_orderstatus") == "O", "missed").otherwise("excluded").alias("outcome"), F.col("o_totalprice").alias("magnitude"))
    return votes.sensitivity(t).withColumn("miss_rate", F.round("miss_rate", 6))


@query("WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'holdout' ELSE 'fit' END AS part, quality AS label, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), f AS (SELECT (min(score) FILTER (label = 1) + max(score) FILTER (label = 0)) / 2 AS \"limit\" FROM s WHERE part = 'fit') SELECT \"limit\", count(*) FILTER (label = 0 AND score >= \"limit\") AS false_positives, count(*) FILTER (label = 1 AND score < \"limit\") AS false_negatives, count(*) AS n FROM s, f WHERE part = 'holdout' GROUP BY 1")
def midpoint_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return votes.midpoint_threshold(d.select(F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("fit").alias("part"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score")))


# --- coverage --------------------------------------------------------------

CASES = "WITH e AS (SELECT n_nationkey || ':' || seg AS case_id, n_nationkey % 4 > 0 AS required FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)), g AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segs FROM customer), s AS (SELECT (s_nationkey + s_suppkey % 2) || ':' || segs[s_suppkey % 4 + 1] AS case_id FROM supplier, g), x AS (SELECT case_id, count(*) AS ne, bool_or(required) AS required FROM e GROUP BY 1), y AS (SELECT case_id, count(*) AS ns FROM s GROUP BY 1), r AS (SELECT case_id, coalesce(ne, 0) AS n_expected, coalesce(ns, 0) AS n_supplied, CASE WHEN ne IS NULL THEN 'unexpected' WHEN ne > 1 THEN 'duplicate_expected' WHEN ns > 1 THEN 'duplicate_supplied' WHEN ns IS NULL THEN CASE WHEN required THEN 'missing' ELSE 'missing_optional' END ELSE 'supplied' END AS outcome FROM x FULL JOIN y USING (case_id))"


def reconciled(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    e = n.crossJoin(F.broadcast(c.select("c_mktsegment").distinct())).select(F.concat_ws(":", "n_nationkey", "c_mktsegment").alias("case_id"), (F.col("n_nationkey") % 4 > 0).alias("required"))
    segments = c.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segs"))  # one row of a few names
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(segments)).select(F.concat_ws(":", F.col("s_nationkey") + F.col("s_suppkey") % 2, F.get("segs", (F.col("s_suppkey") % 4).cast("int"))).alias("case_id"))
    return coverage.reconcile(e, s)


@query(CASES + " SELECT * FROM r")
def inventory(spark, sf_dir):
    return reconciled(spark, sf_dir)


@query(CASES + " SELECT outcome, count(*) AS n FROM r GROUP BY 1")
def inventory_counts(spark, sf_dir):
    return coverage.outcome_counts(reconciled(spark, sf_dir))


@query("WITH c AS (SELECT o_orderpriority AS pri, o_custkey % 3 AS axis, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'missing' END AS outcome FROM orders) SELECT pri, axis, count(*) AS expected, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'missing') AS missing FROM c GROUP BY GROUPING SETS ((pri, axis), ())")
def coverage_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderpriority").alias("pri"), (F.col("o_custkey") % 3).alias("axis"), F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("missing").alias("outcome"))
    return coverage.by_axes(c, ["pri", "axis"])


@query("WITH p AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders), x AS (SELECT count(*) AS repeated_a FROM (SELECT a FROM p GROUP BY a HAVING count(*) > 1)), y AS (SELECT count(*) AS repeated_b FROM (SELECT b FROM p GROUP BY b HAVING count(*) > 1)) SELECT *, repeated_a = 0 AND repeated_b = 0 AS bijective FROM x, y")
def page_correspondence(spark, sf_dir):
    return coverage.correspondence(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")))


# --- similarity ------------------------------------------------------------

RADIUS = 12
#: dHashes of the pictures and of their near copies, in two halves, as DuckDB's shifts stop at the sign.
CODES = "WITH " + B.PICTURE_CODES + ", c AS (SELECT image AS id, d_hi AS hi, d_lo AS lo FROM codes), p AS (SELECT a.id AS a, b.id AS b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance FROM c a JOIN c b ON a.id < b.id)"


def codes(spark, sf_dir):
    return written(perceptual.line_hashes(B.pictures(spark, sf_dir), "d").select(F.col("image").alias("id"), F.col("dhash").alias("code")), "codes")


@query(CODES + f" SELECT * FROM p WHERE distance <= {RADIUS}")
def hamming_pairs(spark, sf_dir):
    return similarity.all_hamming_pairs(codes(spark, sf_dir), RADIUS)


@query(CODES + f" SELECT a AS query, b AS id, distance FROM (SELECT a, b, distance FROM p UNION ALL SELECT b, a, distance FROM p) WHERE a % 50 = 0 AND distance <= {RADIUS} UNION ALL SELECT id, id, 0 FROM c WHERE id % 50 = 0")
def hamming_neighbours(spark, sf_dir):
    c = codes(spark, sf_dir)
    return similarity.hamming_query(c.where("id % 50 = 0").withColumnRenamed("id", "query"), c, RADIUS)


@query("WITH RECURSIVE " + CODES.removeprefix("WITH ") + f", l AS (SELECT a AS x, b AS y FROM p WHERE distance <= {RADIUS} UNION SELECT b, a FROM p WHERE distance <= {RADIUS}), r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, l.y FROM r JOIN l ON r.reach = l.x) SELECT id, min(reach) AS component FROM r GROUP BY id")
def hash_clusters(spark, sf_dir):
    return similarity.clusters(codes(spark, sf_dir), RADIUS)


@query(CODES + f" SELECT a, b, distance, a % 3 AS split_a, b % 3 AS split_b FROM p WHERE distance <= {RADIUS} AND a % 3 <> b % 3")
def split_leaks(spark, sf_dir):
    c = codes(spark, sf_dir)
    return similarity.cross_split(similarity.all_hamming_pairs(c, RADIUS), c.select("id", (F.col("id") % 3).alias("split"))).select("a", "b", "distance", "split_a", "split_b")


@query("WITH q AS (SELECT vec_id AS query, embedding AS x FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(list_transform(x, lambda t: t::DOUBLE), list_transform(embedding, lambda t: t::DOUBLE)), 9) AS cosine FROM q, embeddings) SELECT query, id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM s QUALIFY place <= 10")
def cosine_top_10(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.cosine_top_k(e.where("id % 100 = 0"), e, 10)


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def equal_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("WITH t AS (SELECT a.doc_id AS a, b.doc_id AS b, a.lang AS transform FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id), f AS (SELECT * FROM t WHERE (a + b) % 2 = 0) SELECT transform, count(*) AS planted, count(f.a) AS found, round(count(f.a) / count(*), 6) AS recall FROM t LEFT JOIN f USING (a, b, transform) GROUP BY 1")
def planted_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    t = d.select(F.col("doc_id").alias("a"), F.col("lang").alias("transform"), "h").join(d.select(F.col("doc_id").alias("b"), "h"), "h").where("a < b").drop("h")
    r = similarity.recall_by_transform(t, t.where("(a + b) % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return r.withColumn("recall", F.round("recall", 6))


@query("SELECT vec_id AS id, round(CASE WHEN vec_id % 5 = 0 THEN -embedding[1] ELSE embedding[1] END, 6) AS head FROM embeddings WHERE vec_id % 7 > 0")
def index_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ch = e.where("id % 7 = 0 or id % 5 = 0").select("id", F.when(F.col("id") % 7 != 0, F.transform("vector", lambda x: -x)).alias("vector"))
    return similarity.merge_index(e, ch).select("id", F.round(F.get("vector", F.lit(0)), 6).alias("head"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.001 AS unit FROM embeddings")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("norm"), S.is_unit(F.col("embedding")).alias("unit"))


@query("SELECT page_id, ('0x' || substr(sha256(url), 1, 2))::INT AS shard FROM pages")
def path_shards(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.shard(F.col("url")).alias("shard"))


# --- grids -----------------------------------------------------------------

GRID = "SELECT l_partkey % 64 AS x, l_suppkey AS y, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2"
MASKS = f"WITH t AS ({GRID}), p AS (SELECT x, y + 1 AS y, label FROM t), j AS (SELECT t.label AS t, p.label AS p FROM t FULL JOIN p ON t.x = p.x AND t.y = p.y), k AS (SELECT label, count(*) FILTER (t = label AND p = label) AS shared, count(*) FILTER (t = label) AS n_truth, count(*) FILTER (p = label) AS n_said FROM j, (SELECT DISTINCT label FROM t) AS l GROUP BY 1), c AS (SELECT *, CASE WHEN n_truth = 0 THEN 'spurious' WHEN n_said = 0 THEN 'missed' ELSE 'scored' END AS status, shared / (n_truth + n_said - shared) AS iou FROM k)"


def grid(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("x"), F.col("l_suppkey").alias("y")).agg(F.min("l_returnflag").alias("label"))


def masks(spark, sf_dir):
    g = grid(spark, sf_dir)
    return grids.mask_metrics(g, g.select("x", (F.col("y") + 1).alias("y"), "label"))


@query(MASKS + " SELECT label, shared, n_truth, n_said, status, round(iou, 6) AS iou, round(2 * shared / (n_truth + n_said), 6) AS dice, round(shared / nullif(n_said, 0), 6) AS precision, round(shared / nullif(n_truth, 0), 6) AS recall FROM c")
def mask_metrics(spark, sf_dir):
    m = masks(spark, sf_dir)
    return m.select("label", "shared", "n_truth", "n_said", "status", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "precision", "recall")])


@query(MASKS + " SELECT round(avg(iou) FILTER (status <> 'spurious'), 6) AS macro, round(sum(shared) / sum(n_truth + n_said - shared), 6) AS micro, count(*) FILTER (status = 'missed') AS missed FROM c")
def mask_summary(spark, sf_dir):
    return grids.mask_summary(masks(spark, sf_dir)).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "missed")


CELLS = "SELECT l_partkey % 256 AS x, l_suppkey AS y, 2 - l_linenumber % 2 AS run, round(avg(l_quantity), 3) AS v FROM lineitem GROUP BY 1, 2, 3"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 256).alias("x"), F.col("l_suppkey").alias("y"), (2 - F.col("l_linenumber") % 2).alias("run")).agg(F.round(F.avg("l_quantity"), 3).alias("value"))


@query(f"WITH c AS ({CELLS}), j AS (SELECT CASE WHEN a.v > 3 THEN a.v END AS a, CASE WHEN b.v > 3 THEN b.v END AS b FROM c a JOIN c b USING (x, y) WHERE a.run = 1 AND b.run = 2) SELECT count(b - a) AS valid, count(*) FILTER (b - a <> 0) AS changed, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_b, count(*) FILTER (a IS NULL AND b IS NULL) AS neither, round(avg(b - a), 6) AS mean, round(avg(abs(b - a)), 6) AS mae, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse, round(min(b - a), 6) AS least, round(max(b - a), 6) AS most FROM j")
def band_delta(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("value", F.when(F.col("value") > 3, F.col("value")))
    d = grids.band_delta(c.where("run = 1"), c.where("run = 2"), ["x", "y"])
    return d.select("valid", "changed", "only_a", "only_b", "neither", *[F.round(k, 6).alias(k) for k in ("mean", "mae", "rmse", "least", "most")])


@query(f"WITH c AS ({CELLS}) SELECT run, floor(x / 16)::BIGINT AS tx, floor(y / 16)::BIGINT AS ty, count(*) AS cells, round(avg(v), 6) AS mean, round(sqrt(avg(v * v)), 6) AS rms, round(var_pop(v), 8) AS detail FROM c GROUP BY 1, 2, 3")
def tile_aggregates(spark, sf_dir):
    t = grids.tiles(cells(spark, sf_dir).withColumnRenamed("value", "err"), 16, ["run"])
    return t.select("run", "tx", "ty", "cells", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), F.round("detail", 8).alias("detail"))


RUNS = "SELECT l_linenumber AS run, l_partkey % 64 AS tile, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2"


@query(f"WITH r AS ({RUNS}), e AS (SELECT a.tile, max(abs(a.v - b.v)) AS noise FROM r a JOIN r b USING (tile) WHERE a.run <= 4 AND b.run <= 4 GROUP BY 1) SELECT r.tile, v - 25 AS value, abs(v - 25) > noise + 1e-12 AS beyond FROM r LEFT JOIN e USING (tile) WHERE run = 5")
def noise_decisions(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 64).alias("tile")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    e = grids.noise_envelope(r.where("run <= 4"))
    return grids.outside_envelope(r.where("run = 5").select("tile", (F.col("value") - 25).alias("value")), e)


@query()
def pixel_components(spark, sf_dir):
    h = grid(spark, sf_dir).where("label = 'N'").select((F.col("y") * 64 + F.col("x")).alias("id"), "x", "y")
    c = components.components(grids.neighbours(h))
    return h.join(c, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


# --- intervals -------------------------------------------------------------

CUES = "WITH o AS (SELECT o_custkey AS \"group\", o_orderkey AS k, o_orderpriority AS text, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS t, o_totalprice AS price, o_custkey % 2 = 0 AS dense FROM orders), c AS (SELECT \"group\", k AS cue, text, t AS start, t + 30 AS \"end\" FROM o WHERE k % 2 = 0), b AS (SELECT \"group\", k AS obs, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE text END AS text, t, CASE WHEN price > 300000 THEN false WHEN price > 20000 THEN true END AS legible FROM o WHERE k % 2 = 1 UNION ALL SELECT \"group\", -k * 5 - floor(d / 10)::BIGINT, CASE WHEN price > 200000 THEN 'other' WHEN price > 150000 THEN '' ELSE text END, t + d, true FROM o, (VALUES (3.5), (13.5), (23.5)) AS s(d) WHERE dense AND k % 2 = 0), n AS (SELECT b.\"group\", obs, cue, t >= start AND t < \"end\" AS inside, CASE WHEN t >= start AND t < \"end\" THEN 0 WHEN t < start THEN start - t ELSE t - \"end\" END AS away, t >= \"end\" AS past FROM b JOIN c ON b.\"group\" = c.\"group\" AND b.text = c.text), r AS (SELECT * FROM n WHERE away < 60 OR away = 60 AND NOT past QUALIFY dense_rank() OVER (PARTITION BY \"group\", obs ORDER BY inside DESC, away) = 1), g AS (SELECT \"group\", obs, count(*) AS n, min(cue) AS cue, bool_or(inside) AS inside FROM r GROUP BY 1, 2), a AS (SELECT b.\"group\", b.obs, CASE WHEN n = 1 THEN cue END AS cue, coalesce(n > 1, false) AS ambiguous, CASE WHEN n = 1 THEN inside END AS active FROM b LEFT JOIN g ON b.\"group\" = g.\"group\" AND b.obs = g.obs)"


def cues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("t"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 2 == 0).alias("dense"))
    lines = o.where("k % 2 = 1").select("group", F.col("k").alias("obs"), F.expr("case when k % 13 = 0 then null when k % 11 = 0 then '' else text end").alias("text"), "t", F.expr("case when price > 300000 then false when price > 20000 then true end").alias("legible"))
    more = o.where("dense and k % 2 = 0").withColumn("d", F.explode(F.array(F.lit(3.5), F.lit(13.5), F.lit(23.5))))
    more = more.select("group", (-F.col("k") * 5 - F.floor(F.col("d") / 10)).alias("obs"), F.expr("case when price > 200000 then 'other' when price > 150000 then '' else text end").alias("text"), (F.col("t") + F.col("d")).alias("t"), F.lit(True).alias("legible"))
    return o.where("k % 2 = 0").select("group", F.col("k").alias("cue"), "text", F.col("t").alias("start"), (F.col("t") + 30).alias("end")), lines.union(more)


@query(CUES + " SELECT * FROM a")
def nearest_cues(spark, sf_dir):
    return intervals.assign(*cues(spark, sf_dir), 60.0)


@query(CUES + ", x AS (SELECT b.*, a.cue AS own, a.ambiguous FROM b JOIN a USING (\"group\", obs)), m AS (SELECT \"group\", own AS cue, min(t) AS f, max(t) AS l, bool_or(NOT legible) AS bad, bool_and(coalesce(legible, false)) AS good FROM x WHERE own IS NOT NULL GROUP BY 1, 2), e AS (SELECT c.*, f, l, bad, good FROM c LEFT JOIN m USING (\"group\", cue)), y AS (SELECT e.*, x.obs, x.t, x.text AS said, x.own, x.text IS NOT NULL AND NOT x.ambiguous AS known, t - coalesce(lag(t) OVER (PARTITION BY e.\"group\", e.cue ORDER BY t, obs), start) > 12 AS hole FROM e JOIN x ON x.\"group\" = e.\"group\" AND t >= start AND t < \"end\" + 60), z AS (SELECT \"group\", cue, count(*) FILTER (t < \"end\") AS n, bool_and(known AND NOT hole) FILTER (t < \"end\") AS ok, max(t) FILTER (t < \"end\") AS last, bool_or(coalesce(said <> '', false)) FILTER (t < \"end\") AS texts, bool_or(own IS DISTINCT FROM cue) FILTER (t < \"end\") AS other, bool_and(known AND NOT hole) FILTER (t <= f) AS onset FROM y GROUP BY 1, 2), k AS (SELECT e.*, texts, other, onset, coalesce(n > 0 AND ok AND \"end\" - last <= 12, false) AS covered, CASE WHEN f IS NULL THEN 'insufficient_evidence' WHEN bad THEN 'illegible' WHEN good THEN 'legible' ELSE 'insufficient_evidence' END AS legibility FROM e LEFT JOIN z USING (\"group\", cue)) SELECT \"group\", cue, covered, legibility, concat_ws(',', CASE WHEN f IS NULL AND covered THEN CASE WHEN texts THEN 'text_mismatch' ELSE 'missing' END END, CASE WHEN f < start - 5 THEN 'early' END, CASE WHEN onset AND f > start + 5 THEN 'late' END, CASE WHEN l > \"end\" + 5 THEN 'persists_after_end' END, CASE WHEN covered AND l < \"end\" - 17 THEN 'ends_before_end' END, CASE WHEN covered AND f IS NOT NULL AND other THEN 'interrupted' END, CASE WHEN legibility = 'illegible' THEN 'illegible' END) AS findings FROM k")
def cue_findings(spark, sf_dir):
    c, o = cues(spark, sf_dir)
    return intervals.findings(c, o, 60.0, 12.0, 5.0)


@query(CUES + ", i AS (SELECT *, CASE WHEN t - lag(t) OVER w > 200 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY \"group\", text ORDER BY t, obs)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY \"group\", text ORDER BY t, obs)::BIGINT AS island FROM i) SELECT \"group\", text, island, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM k GROUP BY 1, 2, 3")
def text_islands(spark, sf_dir):
    return intervals.islands(cues(spark, sf_dir)[1], 200.0)


@query("SELECT e.user_id, e.event_id AS id, epoch(e.ts) AS t, (SELECT max_by(p.value, p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS value FROM events e WHERE e.event_type = 'error'")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return intervals.as_of(e.where("event_type = 'error'").select("user_id", "t", F.col("event_id").alias("id")), e.where("event_type = 'purchase'").select("user_id", "t", "value"), "user_id")


# --- text ------------------------------------------------------------------

@query()
def character_edits(spark, sf_dir):
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("answer is not null")
    return c.select("conv_id", "turn", F.levenshtein("text", "answer").alias("edits"))


@query()
def error_rates(spark, sf_dir):
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("answer is not null")
    return text.rates(c.select("conv_id", "turn", F.col("text").alias("reference"), F.col("answer").alias("said")))


@query("SELECT page_id, grp, place FROM (SELECT page_id, page_id % 10 AS grp, row_number() OVER (PARTITION BY page_id % 10 ORDER BY sha256('7:' || url), page_id) AS place FROM pages) WHERE place <= 5")
def seeded_sample(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("grp"), "url")
    return text.sample(p, ["grp"], "url", "7", 5, "page_id").select("page_id", "grp", "place")


@query("SELECT page_id, trim(regexp_replace(trim(url || '  x ' || page_id), '\\s+', ' ', 'g')) AS plain FROM pages")
def plain_space(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.plain_space(F.concat(F.col("url"), F.lit("  x "), F.col("page_id"))).alias("plain"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def passage_leaks(spark, sf_dir):
    return text.containing(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
