"""Queries of trials: preference intervals, leased requests, conformance, arms, ablations, histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ablation as A
from ..operators import conformance as C
from ..operators import preferences
from ..operators import readings as R
from ..sources.tables import shared_path, table
from ..streaming import limiter, streams

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- preferences -----------------------------------------------------------

def prices(spark, sf_dir):
    """Suppliers (by remainder) that sell the same part: the cheaper unit price wins."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 20).alias("c")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    p = s.join(s.select("l_partkey", F.col("c").alias("d"), F.col("price").alias("q")), "l_partkey").where("c < d")
    return p.select(F.col("c").alias("i"), F.col("d").alias("j"), F.when(F.col("price") < F.col("q"), 1.0).when(F.col("price") > F.col("q"), 0.0).otherwise(0.5).alias("score"))


@query()
def preference_intervals(spark, sf_dir):
    return preferences.preference_intervals(prices(spark, sf_dir))


# --- requests --------------------------------------------------------------

@query()
def leased_requests(spark, sf_dir):
    """Every event asks its type's provider for a lease and gives it back after as many minutes as its value says; errors were never sent."""
    e = streams.events_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ask = F.struct(F.lit("reserve").alias("kind"), F.col("ts").alias("at"))
    back = F.struct(F.lit("finish").alias("kind"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("at"))
    rows = e.select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).cast("string").alias("model"), F.col("event_id").cast("string").alias("id"), (F.col("event_type") != "error").alias("dispatched"), F.inline(F.array(ask, back)))
    out = shared_path(spark, "leases")
    limits = limiter.Limits(per_window=4, under_way=3, model_per_window=2, model_under_way=2, window=7200.0, lease=3600.0)
    streams.run_all(limiter.leased(rows, limits, "1 hour"), lambda batch, _: batch.write.mode("append").parquet(out))
    return spark.read.schema(limiter.RESULT).parquet(out)


# --- captures --------------------------------------------------------------

#: Orders are slots and customers runs; what is wrong with a slot follows from the remainder of its number by 31, what is wrong with a run from that of its customer by 50.
_SLOTS = "o AS (SELECT 'c' || o_custkey AS run, o_orderkey::VARCHAR AS slot, o_orderkey % 31 AS k, o_custkey % 50 AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 100 AS s FROM orders), a AS (SELECT *, CASE WHEN k = 10 THEN NULL WHEN k = 12 THEN 'other' ELSE 'main' END AS d, CASE WHEN k = 11 THEN s - 1 WHEN k = 19 THEN s + 250 ELSE s + 50 END AS e FROM o WHERE k <> 1)"
_BROKEN = "b AS (SELECT run, u = 9 AS other_schema, u <> 9 AND (u = 7 OR u = 10 AND count(*) FILTER (k <> 1) > 0) AS broken, u = 8 AS part FROM o GROUP BY run, u)"


@query("WITH " + _SLOTS + ", " + _BROKEN + ", w AS (SELECT *, max(e) OVER (PARTITION BY run, d ORDER BY s, e, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM a WHERE d IS NOT NULL), f AS (SELECT o.run, o.slot, o.k, w.s < w.earlier AS ov FROM o JOIN b ON b.run = o.run AND NOT other_schema AND NOT broken LEFT JOIN w ON w.run = o.run AND w.slot = o.slot),"
       " c AS (SELECT run, slot, CASE WHEN k IN (17, 18) THEN 'invalid_record' WHEN k IN (1, 2) THEN 'partial_run' WHEN k IN (3, 4) THEN 'acquisition_failed' WHEN k = 5 THEN 'settings_mismatch' WHEN k IN (6, 7) THEN 'missing_identity' WHEN k = 8 THEN 'identity_mismatch' WHEN k = 9 THEN 'readiness_not_reached' WHEN k IN (10, 11, 12) THEN 'clock_mismatch' WHEN k IN (13, 15) THEN 'missing_image' WHEN k = 14 THEN 'unsafe_image_path' WHEN k = 16 THEN 'stale_hash' END AS code FROM f"
       " UNION ALL SELECT run, slot, 'clock_overlap' FROM f WHERE ov AND k NOT IN (1, 2, 3, 4, 10, 11, 12, 18) UNION ALL SELECT run, NULL, CASE WHEN other_schema THEN 'unsupported_schema' WHEN broken THEN 'invalid_record' WHEN part THEN 'partial_run' END FROM b) SELECT * FROM c WHERE code IS NOT NULL")
def capture_conformance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("slot"), (F.col("o_orderkey") % 31).alias("k"), (F.col("o_custkey") % 50).alias("u"), F.col("o_orderpriority").alias("settings"), (100 * F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).cast("long").alias("start_ns"))
    k = lambda n: F.col("k") == n
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))

    def fingerprint(session, binary, priority, reached):
        pairs = {"fingerprint.schema": F.lit(C.FINGERPRINT_SCHEMA), "producer.binary": binary, "inputs.identity": sha("slot"), "run.session": session, "run.env.priority": priority, "run.readiness.loaded.reached": reached}
        return F.create_map(*[x for key, v in pairs.items() for x in (F.lit(key), v)])

    plan = fingerprint(F.when(k(18), "other").otherwise(F.col("run")), sha("run"), F.col("settings"), F.lit("true"))
    made = fingerprint(F.when(k(18), "other").otherwise(F.col("run")), F.when(~k(7), sha("run")).otherwise(""), F.when(k(8), "other").otherwise(F.col("settings")), F.when(k(9), "false").otherwise("true"))
    slots = o.select("run", "slot", "settings", plan.alias("fingerprint"), F.lit("main").alias("domain"))
    end = F.when(k(11), F.col("start_ns") - 1).when(k(19), F.col("start_ns") + 250).otherwise(F.col("start_ns") + 50)
    path = F.when(~k(13), F.when(k(14), "../x.png").otherwise(F.concat("slot", F.lit(".png"))))
    a = o.where(~k(1)).select("run", "slot", "u", F.when(k(2), "skipped").when(k(3), "failed").otherwise("acquired").alias("status"), F.when(k(4), "no frame").alias("error"), F.when(k(5), "other").otherwise(F.col("settings")).alias("settings"), F.when(~k(6), made).alias("fingerprint"),
                              F.when(k(12), "other").when(~k(10), "main").alias("domain"), F.col("run").alias("clock_run"), "start_ns", end.alias("end_ns"), path.alias("path"), F.when(k(17), "xyz").otherwise(F.sha2("slot", 256)).alias("sha256"))
    stray = o.where("u = 7").select("run").distinct().join(a.drop("run").limit(0), how="left").withColumn("slot", F.lit("stray")).select(a.columns)
    acquisitions = a.union(a.where("u = 10")).union(stray).drop("u")
    runs = o.select("run", "u").distinct().select("run", F.when(F.col("u") == 9, "other").otherwise(C.RECORD_SCHEMA).alias("schema"), (F.col("u") != 8).alias("complete"))
    files = o.where(~k(15)).select("run", F.concat("slot", F.lit(".png")).alias("path"), F.when(k(16), F.concat("slot", F.lit("!"))).otherwise(F.col("slot")).alias("content"))
    return C.conformance(runs, slots, acquisitions, files)


# --- arms ------------------------------------------------------------------

_RULES = [(None, "producer.build", "vary"), (None, "run.env.*", "ignore"), (None, "quality.level", "vary"), (None, "render.*.level", "ignore"), (None, "never.there", "vary"), ("5", "render.light", "vary"), (None, "render", "ignore"), (None, "render.shade", "vary")]


def fingerprints(spark, sf_dir):
    """(arm, key, value) of customers: what they are, and what they are held against, which is the first customer of their nation."""
    c = table(spark, sf_dir, "customer")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey")
    defect = F.col("arm").cast("long") % 41

    def flat(rows):
        own = lambda n: defect == n
        pairs = {
            "fingerprint.schema": F.when(own(1), "other").otherwise(C.FINGERPRINT_SCHEMA), "producer.binary": F.concat(F.lit("b"), "c_nationkey"), "inputs.identity": F.when(~own(2), "i"), "run.mode": F.when(own(3), " ").otherwise("full"), "run.session": F.lit("s"), "producer.build.market": F.col("c_mktsegment"),
            "run.env.balance": F.floor(F.col("c_acctbal") / 2000).cast("string"), "render.quality.level": (F.col("c_custkey") % 3).cast("string"), "render.shade": (F.col("c_custkey") % 2).cast("string"), "render.light": (F.col("c_custkey") % 5).cast("string"), "display.gain": (F.col("c_custkey") % 4).cast("string"),
            "run.readiness.loaded.criterion": F.lit("x"), "run.readiness.loaded.reached": F.when(own(4), "false").otherwise("true"), "run.readiness.loaded.observed": F.when(~own(5), "y")}
        entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in pairs.items()]), lambda e: e["value"].isNotNull())
        return rows.select("arm", F.inline(entries))

    capture = c.withColumn("arm", F.col("c_custkey").cast("string"))
    base = c.select(F.col("c_custkey").cast("string").alias("arm"), "c_nationkey").join(c.join(first, "c_custkey"), "c_nationkey")
    return flat(base), flat(capture)


_ARMS = "f AS (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1), p AS (SELECT a.c_custkey AS n, a.c_custkey::VARCHAR AS arm, a.c_custkey % 41 AS k, a.c_mktsegment AS m, b.c_mktsegment AS bm, floor(a.c_acctbal / 2000)::BIGINT::VARCHAR AS w, floor(b.c_acctbal / 2000)::BIGINT::VARCHAR AS bw, b.c_custkey AS bn FROM customer a JOIN f USING (c_nationkey) JOIN customer b ON b.c_custkey = f.c_custkey)"
_FOUND = (_ARMS + ", d AS (" + " UNION ALL ".join([
    "SELECT arm, 'producer.build.market' AS key, CASE WHEN m <> bm THEN 'varied' END AS reason, bm AS baseline, m AS capture FROM p", "SELECT arm, 'run.env.balance', CASE WHEN w <> bw THEN 'ignored' END, bw, w FROM p",
    "SELECT arm, 'render.quality.level', CASE WHEN n % 3 <> bn % 3 THEN 'ignored' END, (bn % 3)::VARCHAR, (n % 3)::VARCHAR FROM p", "SELECT arm, 'render.shade', CASE WHEN n % 2 <> bn % 2 THEN 'varied' END, (bn % 2)::VARCHAR, (n % 2)::VARCHAR FROM p",
    "SELECT arm, 'render.light', CASE WHEN n % 5 <> bn % 5 THEN CASE WHEN n = 5 THEN 'varied' ELSE 'ignored' END END, (bn % 5)::VARCHAR, (n % 5)::VARCHAR FROM p", "SELECT arm, 'display.gain', CASE WHEN n % 4 <> bn % 4 THEN 'difference' END, (bn % 4)::VARCHAR, (n % 4)::VARCHAR FROM p",
    f"SELECT arm, 'fingerprint.schema', CASE WHEN k = 1 THEN 'malformed' END, CASE WHEN k = 1 THEN 'other' ELSE '{C.FINGERPRINT_SCHEMA}' END, CASE WHEN k = 1 THEN 'other' ELSE '{C.FINGERPRINT_SCHEMA}' END FROM p",
    "SELECT arm, 'inputs.identity', CASE WHEN k = 2 THEN 'missing' END, NULL, NULL FROM p", "SELECT arm, 'run.mode', CASE WHEN k = 3 THEN 'malformed' END, ' ', ' ' FROM p",
    "SELECT arm, 'run.readiness.loaded.reached', CASE WHEN k = 4 THEN 'readiness_not_reached' END, 'false', 'false' FROM p", "SELECT arm, 'run.readiness.loaded.observed', CASE WHEN k = 5 THEN 'missing' END, NULL, NULL FROM p",
    "SELECT arm, 'never.there', 'never_varies', NULL, NULL FROM p", "SELECT arm, 'quality.level', 'never_varies', NULL, NULL FROM p", "SELECT arm, 'producer.build', CASE WHEN m = bm THEN 'never_varies' END, NULL, NULL FROM p", "SELECT arm, 'render.shade', CASE WHEN n % 2 = bn % 2 THEN 'never_varies' END, NULL, NULL FROM p", "SELECT arm, 'render.light', CASE WHEN n = 5 AND n % 5 = bn % 5 THEN 'never_varies' END, NULL, NULL FROM p"]) + "), found AS (SELECT * FROM d WHERE reason IS NOT NULL)")


def _findings(spark, sf_dir):
    baseline, capture = fingerprints(spark, sf_dir)
    return C.arm_findings(baseline, capture, spark.createDataFrame(_RULES, "arm string, pattern string, kind string")), capture


@query("WITH " + _FOUND + " SELECT * FROM found")
def arm_findings(spark, sf_dir):
    return _findings(spark, sf_dir)[0]


@query("WITH " + _FOUND + " SELECT p.arm, count(reason) = 0 AS valid, count(reason) AS offending FROM p LEFT JOIN found ON found.arm = p.arm AND reason NOT IN ('varied', 'ignored', 'never_varies') GROUP BY 1")
def arm_validity(spark, sf_dir):
    found, capture = _findings(spark, sf_dir)
    return C.arm_validity(found, capture)


# --- ablations -------------------------------------------------------------

#: Studies are suppliers by remainder, arms flags and states, repeats and images remainders of order and part; a few images cannot be read or compared, a few timings are gone.
_CELLS = "l AS (SELECT l_suppkey % 10 AS study, l_returnflag || l_linestatus AS arm, l_orderkey % 3 AS repeat, l_partkey % 4 AS image, l_discount, l_quantity FROM lineitem), cell AS (SELECT study, arm, repeat, image, CASE WHEN count(*) % 29 > 0 THEN image || '-' || (sum(round(l_discount * 100)::BIGINT) * 10 // count(*) % 2) END AS digest, CASE WHEN count(*) % 23 > 0 THEN (sum(round(l_discount * 100)::BIGINT) * 100 // count(*)) / 10000 END AS error FROM l GROUP BY study, arm, repeat, image), tm AS (SELECT study, arm, repeat, (sum(l_quantity::BIGINT) * 10000 // count(*)) / 10000 AS ms FROM l GROUP BY ALL HAVING count(*) % 19 > 0)"
_REPEATS = _CELLS + ", e AS (SELECT study, arm, repeat, count(*) AS n, count(*) - count(digest) AS bad FROM cell GROUP BY ALL), fb AS (SELECT study, min(repeat) AS repeat FROM e WHERE arm = 'AF' AND bad = 0 GROUP BY 1), ex AS (SELECT study, image FROM cell JOIN fb USING (study, repeat) WHERE arm = 'AF'), q AS (SELECT e.*, (SELECT count(*) FROM ex WHERE ex.study = e.study) AS wanted, (SELECT count(*) FROM cell c JOIN ex USING (study, image) WHERE c.study = e.study AND c.arm = e.arm AND c.repeat = e.repeat) AS shared, t.ms IS NOT NULL AS timed FROM e LEFT JOIN tm t USING (study, arm, repeat)), rp AS (SELECT study, arm, repeat, CASE WHEN bad > 0 THEN 'unreadable' WHEN wanted = 0 OR n <> wanted OR shared <> wanted THEN 'image_set_differs' WHEN NOT timed AND bool_or(timed) OVER w AND count(*) OVER w > 1 THEN 'missing_timing' END AS problem FROM q WINDOW w AS (PARTITION BY study, arm))"


def cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("study"), F.concat("l_returnflag", "l_linestatus").alias("arm"), (F.col("l_orderkey") % 3).alias("repeat"), (F.col("l_partkey") % 4).alias("image"), "l_discount", "l_quantity")
    n = F.count(F.lit(1))
    # Whole numbers, so that no rounding depends on the order of a sum.
    captures = li.groupBy("study", "arm", "repeat", "image").agg(n.alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"))
    captures = captures.select("study", "arm", "repeat", "image", F.expr("if(n % 29 > 0, concat_ws('-', image, s * 10 div n % 2), null)").alias("digest"), F.expr("if(n % 23 > 0, (s * 100 div n) / 10000D, null)").alias("error"))
    times = li.groupBy("study", "arm", "repeat").agg(n.alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("s")).where("n % 19 > 0").select("study", "arm", "repeat", F.expr("(s * 10000 div n) / 10000D").alias("ms"))
    return captures, times


@query("WITH " + _REPEATS + " SELECT * FROM rp")
def ablation_repeats(spark, sf_dir):
    return A.complete_repeats(*cells(spark, sf_dir), "AF")


@query("WITH " + _REPEATS + ", su AS (SELECT study, arm, count(*) FILTER (problem IS NULL) AS repeats, count(problem) AS left_out, min(repeat) FILTER (problem IS NULL) AS first FROM rp GROUP BY ALL), ar AS (SELECT s.*, EXISTS (SELECT 1 FROM su b WHERE b.study = s.study AND b.arm = 'AF' AND b.repeats > 0) AS based FROM su s WHERE arm <> 'AF'), ok AS (SELECT * FROM ar WHERE based AND repeats > 0)"
       ", fr AS (SELECT c.* FROM cell c JOIN ok ON ok.study = c.study AND ok.arm = c.arm AND ok.first = c.repeat), nk AS (SELECT study, count(*) AS arms FROM ok GROUP BY 1), cm AS (SELECT study, image FROM (SELECT study, image, count(*) AS k FROM fr WHERE error IS NOT NULL GROUP BY 1, 2) JOIN nk USING (study) WHERE k = arms), me AS (SELECT study, arm, count(*) AS images, avg(error) AS mean FROM fr JOIN cm USING (study, image) GROUP BY ALL)"
       ", wh AS (SELECT c.* FROM cell c JOIN rp ON rp.study = c.study AND rp.arm = c.arm AND rp.repeat = c.repeat AND problem IS NULL), sp AS (SELECT study, arm, image, count(DISTINCT digest) AS d, max(error) - min(error) AS r FROM wh GROUP BY ALL), un AS (SELECT s.study, s.arm, count(*) AS unstable FROM sp s LEFT JOIN sp b ON b.study = s.study AND b.image = s.image AND b.arm = 'AF' WHERE s.arm <> 'AF' AND s.d > 1 AND coalesce(s.r, 1) > coalesce(b.r, 0) + 1e-6 GROUP BY ALL)"
       ", ti AS (SELECT t.* FROM tm t JOIN rp ON rp.study = t.study AND rp.arm = t.arm AND rp.repeat = t.repeat AND problem IS NULL), md AS (SELECT study, arm, quantile_cont(ms, 0.5) AS median FROM ti GROUP BY ALL), sh AS (SELECT x.study, x.arm, quantile_cont(x.ms - y.ms, 0.5) AS shift FROM ti x JOIN ti y ON y.study = x.study AND y.arm = 'AF' JOIN ok ON ok.study = x.study AND ok.arm = x.arm GROUP BY ALL), no AS (SELECT study, max(ms) - min(ms) AS noise FROM ti WHERE arm = 'AF' GROUP BY 1)"
       ", tb AS (SELECT ar.study, ar.arm, CASE WHEN NOT based THEN 'no_base' WHEN repeats = 0 THEN 'excluded' WHEN coalesce(unstable, 0) > 0 THEN 'unstable' ELSE 'accepted' END AS status, repeats, left_out, coalesce(images, 0) AS images, mean, coalesce(unstable, 0) AS unstable, median, shift, noise FROM ar LEFT JOIN me USING (study, arm) LEFT JOIN un USING (study, arm) LEFT JOIN md USING (study, arm) LEFT JOIN sh USING (study, arm) LEFT JOIN no USING (study))"
       " SELECT study, arm, status, repeats, left_out, images, round(mean, 8) AS mean, unstable, CASE WHEN status IN ('accepted', 'unstable') THEN round(median, 6) END AS median, CASE WHEN round(shift, 6) = 0 THEN 0.0 ELSE round(shift, 6) END AS shift, CASE WHEN status = 'accepted' AND shift IS NOT NULL THEN 1 + (SELECT count(*) FROM tb o WHERE o.study = tb.study AND o.status = 'accepted' AND o.shift < tb.shift - tb.noise) END AS place FROM tb")
def ablation_table(spark, sf_dir):
    out = A.ablation(*cells(spark, sf_dir), "AF")
    return out.withColumns({"mean": F.round("mean", 8), "median": F.round("median", 6), "shift": F.when(F.round("shift", 6) == 0, 0.0).otherwise(F.round("shift", 6))})


# --- histories -------------------------------------------------------------

_HISTORY = "m AS (SELECT o_custkey AS report, o_custkey % 11 AS t, count(*) FILTER (o_orderstatus IN ('F', 'O') AND o_orderkey % 13 > 0 AND o_orderkey % 17 > 0) AS n FROM orders GROUP BY ALL)"


@query("WITH " + _HISTORY + " SELECT report, CASE WHEN t = 8 THEN 'invalid_identity' WHEN t = 1 THEN 'object_missing' WHEN t = 2 THEN 'content_changed' WHEN t = 7 THEN 'malformed' WHEN t = 3 THEN 'config_changed' WHEN t IN (4, 5) AND n > 0 OR t = 6 THEN 'samples_changed' ELSE 'verified' END AS state, CASE WHEN t IN (8, 1, 2, 7) THEN NULL WHEN t = 5 AND n > 0 THEN 1 ELSE 0 END AS lost, CASE WHEN t IN (8, 1, 2, 7) THEN NULL WHEN t = 6 THEN 1 ELSE 0 END AS added, CASE WHEN t IN (8, 1, 2, 7) THEN NULL WHEN t = 4 AND n > 0 THEN 1 ELSE 0 END AS changed FROM m")
def verified_history(spark, sf_dir):
    """Reports are customers, entries their orders; by the customer's remainder an object, its content, the index's configuration, or one of its samples is not what it was."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").repartition("o_custkey")
    # Orders are gathered as they are and made entries after, so that no hashes are shuffled.
    entry = lambda e: F.struct(e["o_orderkey"].cast("string").alias("name"), F.when(e["o_orderstatus"] == "F", "pass").when(e["o_orderstatus"] == "O", "fail").otherwise("error").alias("status"), F.when(e["o_orderkey"] % 13 == 0, "invalid").otherwise("valid").alias("validity"),
                               F.lit("mean").alias("metric"), e["o_totalprice"].alias("value"), F.lit(1000.0).alias("threshold"), F.when(e["o_orderkey"] % 17 > 0, F.sha2(e["o_orderkey"].cast("string"), 256)).alias("baseline_sha256"), F.sha2(e["o_orderpriority"], 256).alias("capture_sha256"))
    r = o.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).alias("orders")).withColumn("entries", F.sort_array(F.transform("orders", entry))).withColumn("t", F.col("o_custkey") % 11)
    config = F.concat(F.lit("k"), F.col("o_custkey") % 3)
    content = F.when(F.col("t") == 7, "{").otherwise(F.to_json(F.struct(config.alias("config"), "entries")))
    r = r.withColumn("content", F.concat(content, F.lit(" "), "o_custkey")).withColumn("sha", F.sha2("content", 256)).withColumn("report", F.when(F.col("t") == 8, F.upper("sha")).otherwise(F.col("sha")))
    index = r.select("report", F.sha2(F.when(F.col("t") == 3, "other").otherwise(config), 256).alias("config_sha256"))
    objects = r.where("t <> 1").select("report", F.when(F.col("t") == 2, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"))
    # The least entry of a report's samples, of what its content says.
    said = F.from_json("content", C.REPORT)["entries"]
    measured = F.filter(said, lambda e: e["status"].isin("pass", "fail") & ~e["validity"].eqNullSafe(F.lit("invalid")) & e["value"].isNotNull() & e["baseline_sha256"].isNotNull() & e["capture_sha256"].isNotNull())
    held = C.report_samples(r.select("report", "content", "t", F.array_min(F.transform(measured, lambda e: e["name"])).alias("_least")), "t", "_least").withColumn("_first", F.col("entry").eqNullSafe(F.col("_least"))).where("not (t = 5 and _first)")
    held = held.withColumn("value", F.when((F.col("t") == 4) & F.col("_first"), F.col("value") + 0.01).otherwise(F.col("value"))).select("report", *C.SAMPLE)
    more = r.where("t = 6").select("report", F.lit("added").alias("entry"), F.lit("mean").alias("metric"), F.lit(1.0).alias("value"), F.lit(1000.0).alias("threshold"), F.lit("a").alias("baseline_sha256"), F.lit("b").alias("capture_sha256"))
    return C.verified_history(index, held.union(more), objects).join(r.select("report", "o_custkey"), "report").drop("report").withColumnRenamed("o_custkey", "report")


# --- readings --------------------------------------------------------------

#: Turns of conversations are lines; a word's confidence follows from its length and place, and every seventeenth has none. Expected are each conversation's own second and third word, a common word and one that is not there.
_WORDS = "w AS (SELECT conv_id AS page, turn AS line, i AS at_, x[i] AS text, CASE WHEN i % 17 > 0 THEN (length(x[i]) * 7 + i) % 10 * 10.0 END AS confidence FROM (SELECT conv_id, turn, string_split(text, ' ') AS x FROM conversations), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)), li AS (SELECT conv_id AS page, turn AS line, text FROM conversations), b AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY page, line ORDER BY at_) - length(text) - 1 AS lo FROM w), ex AS (SELECT DISTINCT conv_id AS page, array_to_string(string_split(text, ' ')[2:3], ' ') AS phrase FROM conversations WHERE turn = 0 UNION SELECT DISTINCT conv_id, 'and' FROM conversations UNION SELECT DISTINCT conv_id, 'is not there' FROM conversations)"


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    w = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("line"), F.posexplode(F.split("text", " ", -1)).alias("at", "text")).withColumn("at", F.col("at") + 1)
    words = w.withColumn("confidence", F.when(F.col("at") % 17 > 0, (F.length("text") * 7 + F.col("at")) % 10 * 10.0))
    own = c.where("turn = 0").select(F.col("conv_id").alias("page"), F.array_join(F.slice(F.split("text", " ", -1), 2, 2), " ").alias("phrase"))
    pages = c.select(F.col("conv_id").alias("page")).distinct()
    return words, own.union(pages.select("page", F.lit("and"))).union(pages.select("page", F.lit("is not there")))


@query("WITH " + _WORDS + ", m AS (SELECT ex.page, phrase, li.line, s FROM ex JOIN li USING (page), LATERAL (SELECT unnest(range(1, length(li.text) - length(phrase) + 2)) AS s) WHERE phrase <> '' AND substr(li.text, s, length(phrase)) = phrase), t AS (SELECT m.page, phrase, m.line, s, count(*) FILTER (confidence IS NULL) AS none, count(*) FILTER (confidence < 20) AS low FROM m JOIN b ON b.page = m.page AND b.line = m.line AND lo + length(b.text) > s - 1 AND lo < s - 1 + length(phrase) GROUP BY ALL), g AS (SELECT page, phrase, count(*) AS n, count(*) FILTER (none = 0 AND low = 0) AS sure, count(*) FILTER (none > 0) AS unknown FROM t GROUP BY ALL) SELECT ex.page, ex.phrase, coalesce(n, 0) > 0 AS present, CASE WHEN coalesce(sure, 0) > 0 THEN true WHEN coalesce(unknown, 0) = 0 THEN false END AS readable FROM ex LEFT JOIN g ON g.page = ex.page AND g.phrase = ex.phrase")
def expected_readings(spark, sf_dir):
    return R.expected_readings(*turns(spark, sf_dir), 20.0)
