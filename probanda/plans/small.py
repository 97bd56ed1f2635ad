"""Queries of scalar functions, ranks, term trees and what sinks write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import perf, ranking, votes
from ..sources import sinks
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_orderpriority AS pri, 1 + (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority AS q, o_orderkey AS k, o_custkey % 40 AS s FROM orders) x WHERE q = o.o_orderpriority AND s > o.o_custkey % 40)::INT AS place FROM (SELECT DISTINCT o_orderpriority, o_orderkey, o_custkey FROM orders) o")
def strength_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pri"), (F.col("o_custkey") % 40).alias("strength")).distinct()
    return ranking.rank_by_strength(o, ["pri"]).select("o_orderkey", "pri", "place")


@query("SELECT DISTINCT l_partkey % 256 AS c, l_suppkey % 256 AS alpha, ((l_partkey % 256) * (l_suppkey % 256) + 128 * (255 - l_suppkey % 256) + 127) // 255 AS shown FROM lineitem")
def grey_composites(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).alias("c"), (F.col("l_suppkey") % 256).alias("alpha")).distinct()
    return li.withColumn("shown", S.over_grey(F.col("c"), F.col("alpha")).cast("long"))


_LIGHT = "CASE WHEN {0} / 255 <= 0.04045 THEN {0} / 255 / 12.92 ELSE pow(({0} / 255 + 0.055) / 1.055, 2.4) END"
_LUM = "0.2126 * " + _LIGHT.format("({0} % 256)") + " + 0.7152 * " + _LIGHT.format("({0} * 7 % 256)") + " + 0.0722 * " + _LIGHT.format("({0} * 13 % 256)")


@query(f"WITH l AS (SELECT p_partkey, {_LUM.format('p_partkey')} AS a, {_LUM.format('(p_partkey + 91)')} AS b FROM part) SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS contrast FROM l")
def contrast_ratios(spark, sf_dir):
    k = F.col("p_partkey")
    light = lambda k: S.luminance((k % 256) / 255, (k * 7 % 256) / 255, (k * 13 % 256) / 255)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.contrast(light(k), light(k + 91)), 6).alias("contrast"))


@query("WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), f AS (SELECT p, s, (p % 90) / 100 AS x, (s % 90) / 100 AS y, 640 + p % 7 AS w, 480 + s % 5 AS h FROM r) SELECT p, s, greatest(floor(x * w + 1e-9), 0)::BIGINT AS \"left\", greatest(floor(y * h + 1e-9), 0)::BIGINT AS top, least(ceil((x + 0.1) * w - 1e-9), w)::BIGINT AS \"right\", least(ceil((y + 0.1) * h - 1e-9), h)::BIGINT AS bottom FROM f")
def pixel_rects(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    rect = S.pixel_rect((F.col("p") % 90) / 100, (F.col("s") % 90) / 100, F.lit(0.1), F.lit(0.1), 640 + F.col("p") % 7, 480 + F.col("s") % 5)
    return li.withColumn("r", rect).select("p", "s", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("left", "top", "right", "bottom")])


@query("SELECT DISTINCT x, y, ['top', 'middle', 'bottom'][least(y * 3 // 100, 2) + 1] || '-' || ['left', 'centre', 'right'][least(x * 3 // 64, 2) + 1] AS place FROM (SELECT l_partkey % 65 AS x, l_suppkey % 101 AS y FROM lineitem)")
def position_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 65).alias("x"), (F.col("l_suppkey") % 101).alias("y")).distinct()
    return li.withColumn("place", S.position_label(F.col("x"), F.col("y"), F.lit(64), F.lit(100)))


@query("SELECT o_orderkey, o_custkey % 30 * 3600.0::DOUBLE + o_orderkey % 60 * 60 + o_custkey % 60 + (o_orderkey % 1000) / 1000 AS seconds FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)")
def cue_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    hours, rest = F.col("o_custkey") % 30, F.format_string("%02d:%02d", (F.col("o_orderkey") % 60).cast("int"), (F.col("o_custkey") % 60).cast("int"))
    stamp = F.concat(F.when(hours > 0, F.concat(hours, F.lit(":"))).otherwise(""), rest, F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise("."), F.format_string("%03d", (F.col("o_orderkey") % 1000).cast("int")))
    return o.select("o_orderkey", S.seconds(stamp).alias("seconds"))


@query("SELECT event_id, CASE WHEN value < 1 THEN NULL WHEN user_id % 17 = 0 THEN NULL ELSE round(ln(value), 6) END AS v FROM events")
def rounded_values(spark, sf_dir):
    v = F.when(F.col("value") < 1, float("nan")).when(F.col("user_id") % 17 == 0, float("inf")).otherwise(F.log("value"))
    return table(spark, sf_dir, "events").select("event_id", S.r6(v).alias("v"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) + 0.0 AS head, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) ** 2))), 6) AS norm FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))) AS n FROM embeddings)")
def normalised_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.normalised(F.col("embedding")).alias("v"))
    return e.select("vec_id", (F.round(F.get("v", F.lit(0)), 6) + F.lit(0.0)).alias("head"), F.round(S.norm(F.col("v")), 6).alias("norm"))


@query("WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 3 AS up FROM part), r AS (SELECT k, k AS spot, k % 7 = 0 AS hit FROM t UNION ALL SELECT r.k, t.up, t.up % 7 = 0 AND t.up IN (SELECT k FROM t) FROM r JOIN t ON r.spot = t.k WHERE NOT r.hit) SELECT k::VARCHAR AS id, max(CASE WHEN hit THEN spot END)::VARCHAR AS ancestor FROM r GROUP BY k")
def term_ancestors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.floor(F.col("p_partkey") / 3).cast("string").alias("parent"))
    return perf.selected_ancestors(p, p.where("cast(id as long) % 7 = 0"))


@query("WITH p AS (SELECT doc_id, least(1.0, n_chars / 5000) AS confidence FROM documents) SELECT count(*) AS predictions, count(quality) AS labelled, count(*) - count(quality) AS unlabelled, round(avg(quality), 6) AS accuracy FROM p LEFT JOIN labels USING (doc_id)")
def label_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("confidence"))
    j = votes.labelled(p, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("correct")), ["doc_id"])
    return votes.label_coverage(j).withColumn("accuracy", F.round("accuracy", 6))


@query("WITH l AS (SELECT page_id::VARCHAR AS path, sha256(html) AS h FROM pages WHERE page_id % 6 > 0), m AS (SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE sha256(html) END AS h FROM pages WHERE page_id % 4 > 0) SELECT coalesce(l.path, m.path) AS path, CASE WHEN m.h IS NULL THEN 'unlisted' WHEN l.h IS NULL THEN 'missing' WHEN l.h = m.h THEN 'ok' ELSE 'changed' END AS status FROM l FULL JOIN m ON l.path = m.path")
def manifest_status(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("sha256"))
    m = p.where("page_id % 4 > 0").withColumn("sha256", F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.col("sha256")))
    return sinks.verified_manifest(p.where("page_id % 6 > 0"), m)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_items(spark, sf_dir):
    """Orders are items, those of which a line came back have their receipt."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return sinks.receipts(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT l_orderkey::VARCHAR AS image, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', l_linenumber, (l_partkey % 80 + 5) / 100, (l_suppkey % 80 + 10) / 200, 10 / 100, 20 / 200) AS line FROM lineitem")
def yolo_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").alias("class"), (F.col("l_partkey") % 80).alias("x"), (F.col("l_suppkey") % 80).alias("y"), F.lit(10).alias("w"), F.lit(20).alias("h"), F.lit(100).alias("width"), F.lit(200).alias("height"))
    return sinks.yolo_lines(li)
