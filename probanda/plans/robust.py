"""Queries of robust statistics, fits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import readers
from ..sources.tables import table
from ..streaming import streams
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DAY = f"WITH d AS ({B.DAILY})"


@query(DAY + ", n AS (SELECT *, row_number() OVER (PARTITION BY entry, env ORDER BY value) AS i FROM d) SELECT a.entry, a.env, round(quantile_cont(a.value * 0.5 + b.value * 0.5, 0.5), 6) AS hl, max(a.i) AS n FROM n a JOIN n b ON a.entry = b.entry AND a.env = b.env AND a.i <= b.i GROUP BY 1, 2")
def hodges_lehmann(spark, sf_dir):
    return stats.hodges_lehmann(B.daily(spark, sf_dir), ["entry", "env"]).withColumn("hl", F.round("hl", 6))


@query(DAY + " SELECT a.entry, a.env, round(quantile_cont(a.value - b.value, 0.5), 6) AS shift FROM d a JOIN d b ON a.entry = b.entry AND a.env = b.env WHERE a.seq > 15 AND b.seq <= 15 GROUP BY 1, 2")
def sample_shift(spark, sf_dir):
    d = B.daily(spark, sf_dir)
    return stats.shift(d.where("seq > 15"), d.where("seq <= 15"), ["entry", "env"]).withColumn("shift", F.round("shift", 6))


@query()
def paired_effects(spark, sf_dir):
    d = B.daily(spark, sf_dir)
    p = d.where("env = 0").select("entry", F.col("seq").alias("ord"), F.col("value").alias("before")).join(d.where("env = 1").select("entry", F.col("seq").alias("ord"), F.col("value").alias("after")), ["entry", "ord"])
    return stats.paired_bootstrap(p, ["entry"])


@query()
def onset_candidates(spark, sf_dir):
    d = B.daily(spark, sf_dir).groupBy(F.col("entry").alias("identity"), F.col("seq").cast("double").alias("time")).agg(F.avg("value").alias("ms"), (F.max("value") - F.min("value")).alias("repeat_range"))
    return stats.onsets(d.withColumn("floor", F.lit(0.5)).withColumn("min_pct", F.lit(2.0)).withColumn("ms", F.col("ms") + F.when(F.col("time") > 18, 30.0).otherwise(0.0)))


@query()
def preference_strengths(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 20).alias("c")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    p = s.join(s.select("l_partkey", F.col("c").alias("d"), F.col("price").alias("q")), "l_partkey").where("c < d")
    return stats.bradley_terry(p.select(F.col("c").alias("i"), F.col("d").alias("j"), F.when(F.col("price") < F.col("q"), 1.0).when(F.col("price") > F.col("q"), 0.0).otherwise(0.5).alias("score")))


ISO = "WITH b AS (SELECT l_suppkey % 3 AS grp, l_linenumber AS bin, count(*) AS n, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1, 2), s AS (SELECT a.grp, a.bin AS a, e.bin AS e, (SELECT sum(rate * n) / sum(n) FROM b m WHERE m.grp = a.grp AND m.bin BETWEEN a.bin AND e.bin) AS m FROM b a JOIN b e ON a.grp = e.grp AND a.bin <= e.bin), l AS (SELECT b.grp, b.bin, s.a, min(m) AS m FROM b JOIN s ON b.grp = s.grp AND s.a <= b.bin AND s.e >= b.bin GROUP BY 1, 2, 3)"


@query(ISO + " SELECT grp, bin, round(max(m), 6) AS fitted FROM l GROUP BY 1, 2")
def isotonic_fit(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("grp"), F.col("l_linenumber").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_quantity") > 25).cast("double")).alias("rate"))
    return stats.isotonic(b, ["grp"]).withColumn("fitted", F.round("fitted", 6))


@query()
def exact_intervals(spark, sf_dir):
    c = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("hits"), F.count(F.lit(1)).alias("n"))
    return stats.exact_interval(c)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_stream(spark, sf_dir):
    return streams.windowed_result(spark, sf_dir).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id AS id, event_type AS provider, count(*) OVER w AS before, count(*) OVER w < 1 AS admitted FROM events WINDOW w AS (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)")
def paced_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("id"))
    return streams.paced(e, 600, 1).select("id", "provider", "before", "admitted")


@query("SELECT event_id AS id, (json_extract_string(props, '$.k')::DOUBLE) * 1000 AS ms FROM events")
def extracted_timings(spark, sf_dir):
    t = readers.timings(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json")), "k", "s")
    return t.select("id", F.get("samples", F.lit(0)).alias("ms"))


@query("WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE day(ts) <= 15 GROUP BY 1, 2), b AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE day(ts) > 15 GROUP BY 1, 2) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.v AS before, b.v AS after, a.user_id IS NULL AS absent_before, b.user_id IS NULL AS absent_after FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.v IS DISTINCT FROM b.v OR a.user_id IS NULL OR b.user_id IS NULL")
def metadata_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.dayofmonth("ts"))
    side = lambda c: e.where(c).groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return readers.metadata_diff(side("d <= 15"), side("d > 15"), ["user_id", "event_type"])


@query("WITH n AS (SELECT DISTINCT url AS name FROM (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS url FROM pages)), m AS (SELECT '' AS dir, 'theme' AS key, 'root' AS value UNION ALL SELECT DISTINCT split_part(name, '/', 1), 'theme', 'host-' || length(split_part(name, '/', 1)) FROM n UNION ALL SELECT DISTINCT split_part(name, '/', 1) || '/' || split_part(name, '/', 2), 'lang', split_part(name, '/', 2) FROM n), j AS (SELECT n.name, m.key, m.value, m.dir FROM n JOIN m ON m.dir = '' OR starts_with(n.name, m.dir || '/')) SELECT name, key, max_by(value, length(dir)) AS value FROM j GROUP BY 1, 2")
def layered_metadata(spark, sf_dir):
    n = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("name")).distinct()
    part = lambda i: F.coalesce(F.get(F.split("name", "/"), F.lit(i)), F.lit(""))
    m = spark.createDataFrame([("", "theme", "root")], "dir string, key string, value string")
    m = m.union(n.select(part(0), F.lit("theme"), F.concat(F.lit("host-"), F.length(part(0)))).distinct()).union(n.select(F.concat_ws("/", part(0), part(1)), F.lit("lang"), part(1)).distinct())
    return readers.layered(m, n)
