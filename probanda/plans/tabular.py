"""Queries of pairing, performance terms, ranking, history and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles as Q
from ..functions import scalars as S
from ..operators import frames, history, pairing, perf, ranking
from ..sources.tables import table
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SIDES = f"WITH s AS ({B.EVENT_CAPTURES}), b AS (SELECT name, value FROM s WHERE side = 'baseline'), c AS (SELECT name, value FROM s WHERE side = 'capture')"


def sides(spark, sf_dir):
    s = B.event_captures(spark, sf_dir)
    return s.where("side = 'baseline'").select("name", "value"), s.where("side = 'capture'").select("name", "value")


RULES = [{"glob": "1*/click/*", "threshold": 5.0}, {"glob": "*/click/*", "threshold": 20.0, "metric": "p95"}, {"glob": "*/error/1?", "metric": "max"}]
DEFAULTS = {"threshold": 10.0, "metric": "mean"}
_PAIRED = f"{SIDES}, p AS (SELECT coalesce(b.name, c.name) AS name, b.value AS b_value, c.value AS c_value, CASE WHEN b.name IS NULL THEN 'new' WHEN c.name IS NULL THEN 'missing' ELSE 'paired' END AS status FROM b FULL JOIN c ON b.name = c.name)"
_SET = _PAIRED + ", r AS (SELECT *, CASE WHEN regexp_full_match(name, '1[^/]*/click/[^/]*') THEN 5.0 WHEN regexp_full_match(name, '[^/]*/click/[^/]*') THEN 20.0 ELSE 10.0 END::DOUBLE AS threshold, CASE WHEN regexp_full_match(name, '[^/]*/click/[^/]*') THEN 'p95' WHEN regexp_full_match(name, '[^/]*/error/1[^/]') THEN 'max' ELSE 'mean' END AS metric FROM p), g AS (SELECT name, threshold, metric, CASE WHEN status = 'paired' THEN round(abs(c_value - b_value), 6) END AS value, CASE WHEN status <> 'paired' THEN status WHEN round(abs(c_value - b_value), 6) <= threshold THEN 'pass' ELSE 'fail' END AS status FROM r)"


def gated(spark, sf_dir):
    b, c = sides(spark, sf_dir)
    p = pairing.with_overrides(pairing.pair(b, c), RULES, DEFAULTS)
    return pairing.gated(p, F.round(F.abs(F.col("c_value") - F.col("b_value")), 6)).select("name", "threshold", "metric", "value", "status")


@query(_SET + " SELECT * FROM g")
def pair_and_gate(spark, sf_dir):
    return gated(spark, sf_dir)


@query(_SET + " SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'error') AS n_error, count(*) = 0 OR count(*) FILTER (status IN ('fail', 'missing', 'error')) > 0 AS regression FROM g")
def gate_totals(spark, sf_dir):
    return pairing.totals(gated(spark, sf_dir))


@query(f"{SIDES} SELECT name, value FROM b WHERE name NOT IN (SELECT name FROM c)")
def only_baseline(spark, sf_dir):
    return pairing.only_in(*sides(spark, sf_dir))


_POS = "SELECT o_custkey % 100 AS grp, o_orderpriority AS pri, row_number() OVER (PARTITION BY o_custkey % 100, o_orderpriority ORDER BY o_orderkey) AS place, o_orderkey AS k FROM orders"


def _orders(spark, sf_dir, pri):
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == pri).select((F.col("o_custkey") % 100).alias("grp"), F.col("o_orderkey").alias("k"))


@query(f"WITH p AS ({_POS}) SELECT a.grp, a.place, a.k AS b_k, b.k AS c_k FROM p a JOIN p b ON a.grp = b.grp AND a.place = b.place WHERE a.pri = '1-URGENT' AND b.pri = '5-LOW'")
def pair_by_position(spark, sf_dir):
    return pairing.by_position(_orders(spark, sf_dir, "1-URGENT"), _orders(spark, sf_dir, "5-LOW"), ["grp"], "k")


@query(f"WITH p AS ({_POS}), x AS (SELECT * FROM p WHERE pri = '1-URGENT'), y AS (SELECT * FROM p WHERE pri = '5-LOW') SELECT coalesce(x.grp, y.grp) AS grp, coalesce(x.place, y.place) AS place, x.k AS b_k, y.k AS c_k FROM x FULL JOIN y ON x.grp = y.grp AND x.place = y.place")
def pair_sequences(spark, sf_dir):
    return pairing.by_position(_orders(spark, sf_dir, "1-URGENT"), _orders(spark, sf_dir, "5-LOW"), ["grp"], "k", "full_outer")


LISTED = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey AS i, l_suppkey + 40 * (l_linenumber % 3) AS j FROM lineitem"


@query(f"WITH l AS ({LISTED}), e AS (SELECT ord, i, j, p_name AS \"left\", s_name AS \"right\" FROM l JOIN part ON i = p_partkey JOIN supplier ON j = s_suppkey), a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY i ORDER BY ord) = 1) SELECT i, j, ord, \"left\", \"right\" FROM a QUALIFY row_number() OVER (PARTITION BY j ORDER BY ord) = 1")
def pair_manually(spark, sf_dir):
    from ..operators.running import numbered

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = numbered(li, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "ord").select("ord", F.col("l_partkey").alias("i"), (F.col("l_suppkey") + 40 * (F.col("l_linenumber") % 3)).alias("j"))
    part, supp = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return pairing.manual(p, part, supp)


_KIND = f"{_PAIRED}, e AS (SELECT split_part(name, '/', 2) AS run, name, CASE WHEN status = 'new' THEN 'only_run' WHEN status = 'missing' THEN 'only_ref' WHEN round(abs(c_value - b_value), 0) = 0 OR split_part(name, '/', 2) IN ('view', 'click', 'error') THEN 'identical' ELSE 'changed' END AS kind, CASE WHEN status = 'paired' THEN round(abs(c_value - b_value), 6) END AS mean FROM p WHERE status = 'paired' OR split_part(name, '/', 2) IN ('purchase', 'signup')), f AS (SELECT * FROM (VALUES ('view', true, true, false), ('click', true, true, true), ('error', false, true, true), ('purchase', true, true, false)) AS v(run, qualified, complete, moved)), t AS (SELECT run, count(*) FILTER (kind = 'identical') AS identical, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'error') AS error, count(*) FILTER (kind = 'only_ref') AS only_ref, count(*) FILTER (kind = 'only_run') AS only_run, max(mean) AS worst_mean, max_by(name, (mean, name)) FILTER (mean IS NOT NULL) AS worst FROM e GROUP BY run)"


@query(_KIND + " SELECT t.*, 2 * (identical + changed) < least(identical + changed + only_ref, identical + changed + only_run) AS mismatch, CASE WHEN error + only_ref + only_run > 0 THEN 'INCONCLUSIVE' WHEN changed > 0 THEN 'IMAGE-CHANGE' WHEN identical > 0 AND qualified AND complete AND NOT moved THEN 'NO-EFFECT' WHEN identical > 0 AND qualified AND moved THEN 'PERF-ONLY' ELSE 'INCONCLUSIVE' END AS flag FROM t LEFT JOIN f USING (run)")
def run_summaries(spark, sf_dir):
    b, c = sides(spark, sf_dir)
    p = pairing.pair(b, c)
    apart = F.when(F.col("status") == "paired", F.abs(F.col("c_value") - F.col("b_value")))
    mean = F.round(apart, 6)
    run = F.split("name", "/")[1]
    kind = F.when(F.col("status") == "new", "only_run").when(F.col("status") == "missing", "only_ref").when((F.round(apart) == 0) | run.isin("view", "click", "error"), "identical").otherwise("changed")
    performance = spark.createDataFrame([("view", True, True, False), ("click", True, True, True), ("error", False, True, True), ("purchase", True, True, False)], "run string, qualified boolean, complete boolean, moved boolean")
    entries = p.where((F.col("status") == "paired") | run.isin("purchase", "signup"))
    return pairing.run_summary(entries.select(run.alias("run"), "name", kind.alias("kind"), mean.alias("mean")), performance)


_DIFF = f"WITH t AS ({B.ORDER_TERMS}), b AS (SELECT * FROM t WHERE run = 'before'), a AS (SELECT * FROM t WHERE run = 'after'), d AS (SELECT coalesce(b.grp, a.grp) AS grp, coalesce(b.id, a.id) AS id, b.value AS before, a.value AS after, CASE WHEN b.id IS NULL THEN 'appeared' WHEN a.id IS NULL THEN 'disappeared' WHEN b.kind = a.kind AND b.parent IS NOT DISTINCT FROM a.parent THEN 'paired' ELSE 'not_comparable' END AS status FROM b FULL JOIN a ON b.grp = a.grp AND b.id = a.id), f AS (SELECT *, CASE WHEN status = 'paired' THEN round(after - before, 6) END AS delta FROM d)"


def _diff(spark, sf_dir):
    t = B.order_terms(spark, sf_dir)
    d = perf.term_diff(t.where("run = 'before'"), t.where("run = 'after'"), ["grp", "id"])
    return d.withColumn("delta", F.round("delta", 6))


@query(_DIFF + " SELECT grp, id, before, after, status, delta, CASE WHEN status = 'paired' THEN round(100 * (after - before) / nullif(before, 0), 4) END AS pct FROM f")
def term_differences(spark, sf_dir):
    return _diff(spark, sf_dir).select("grp", "id", "before", "after", "status", "delta", F.round("pct", 4).alias("pct"))


@query(_DIFF + " SELECT grp, id, delta, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(delta) DESC, id) AS place FROM f WHERE delta IS NOT NULL) WHERE place <= 3")
def top_changes(spark, sf_dir):
    return perf.top_terms(_diff(spark, sf_dir), ["grp"], 3).select("grp", "id", "delta", "place")


_NOISE = f"WITH t AS ({B.REPEAT_TERMS}), n AS (SELECT id, max(value) - min(value) AS noise, avg(value) AS frame FROM t GROUP BY id HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM t) AND count(*) = (SELECT count(DISTINCT run) FROM t) AND count(DISTINCT kind) = 1 AND count(DISTINCT coalesce(parent, '-')) = 1)"


@query(_NOISE + " SELECT id, round(noise, 6) AS noise FROM n")
def repeat_noise(spark, sf_dir):
    return perf.repeat_noise(B.repeat_terms(spark, sf_dir), ["id"]).select("id", F.round("noise", 6).alias("noise"))


@query(f"WITH t AS ({B.REPEAT_TERMS}), s AS (SELECT id, max(value) - min(value) AS noise, CASE WHEN id % 3 > 0 THEN 0.5 END AS quantum, CASE WHEN id % 5 > 0 THEN avg(value) END AS frame FROM t GROUP BY id) SELECT id, CASE WHEN quantum IS NULL OR frame IS NULL THEN NULL ELSE round(greatest(3 * noise, 2 * quantum, greatest(0.05, 0.01 * frame)), 6) END AS threshold FROM s")
def noise_thresholds(spark, sf_dir):
    s = B.repeat_terms(spark, sf_dir).groupBy("id").agg((F.max("value") - F.min("value")).alias("noise"), F.avg("value").alias("f"))
    s = s.withColumn("quantum", F.when(F.col("id") % 3 > 0, 0.5)).withColumn("frame", F.when(F.col("id") % 5 > 0, F.col("f")))
    return s.select("id", F.round(perf.threshold(F.col("noise"), F.col("quantum"), F.col("frame")), 6).alias("threshold"))


@query(f"WITH t AS ({B.ORDER_TERMS}), s AS (SELECT grp, run, sum(CASE WHEN kind <> 'F' THEN value ELSE 0 END) AS additive, max(value) * 20 AS frame FROM t GROUP BY grp, run) SELECT grp, run, round(additive, 5) AS additive, round(frame - additive, 5) AS remainder FROM s")
def additive_terms(spark, sf_dir):
    t = B.order_terms(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "F", "scope").otherwise("pass")).withColumn("frame", F.col("value") * 20)
    return perf.additive(t, ["grp", "run"]).select("grp", "run", F.round("additive", 5).alias("additive"), F.round("remainder", 5).alias("remainder"))


@query(f"WITH s AS ({B.SCORES}) SELECT candidate, image, value, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY image ORDER BY value ASC NULLS LAST) END AS place FROM (SELECT candidate, image, CASE WHEN value < 60000 THEN value END AS value FROM s)")
def rank_candidates(spark, sf_dir):
    s = B.scores(spark, sf_dir).withColumn("value", F.when(F.col("value") < 60000, F.col("value")))
    return ranking.rank_each(s).select("candidate", "image", "value", "place")


@query(f"WITH s AS ({B.SCORES}), k AS (SELECT image FROM s WHERE value IS NOT NULL GROUP BY image HAVING count(DISTINCT candidate) = (SELECT count(DISTINCT candidate) FROM s)), r AS (SELECT *, rank() OVER (PARTITION BY image ORDER BY value) AS place FROM s WHERE image IN (SELECT image FROM k)), m AS (SELECT candidate, avg(place) AS mean_rank, avg(value) AS mean_value, count(*) AS n FROM r GROUP BY candidate) SELECT candidate, round(mean_rank, 6) AS mean_rank, round(mean_value, 8) AS mean_value, n, CASE WHEN n = (SELECT count(DISTINCT image) FROM s) THEN rank() OVER (ORDER BY mean_rank, mean_value) END AS place FROM m")
def overall_ranking(spark, sf_dir):
    return ranking.overall(B.scores(spark, sf_dir)).select("candidate", F.round("mean_rank", 6).alias("mean_rank"), F.round("mean_value", 8).alias("mean_value"), "n", "place")


@query(f"WITH d AS ({B.DAILY}), c AS (SELECT entry, env, capture, min_by(value, seq) AS value FROM d WHERE env < 4 OR seq < 3 GROUP BY 1, 2, 3), g AS (SELECT entry, env, CASE WHEN env = 1 THEN 5 ELSE 25 END AS t, count(*) AS n, min(value) AS least, max(value) AS most FROM c GROUP BY 1, 2) SELECT entry, env, n, least, most, round(most - least, 6) AS span, CASE WHEN n < 3 THEN 'insufficient_history' WHEN least <= t AND most > t THEN 'flaky_threshold' WHEN most > least AND most - least >= t THEN 'noise_dominates_threshold' ELSE 'stable_observed' END AS finding, CASE WHEN n < 3 THEN 'capture_more_distinct_repeats' WHEN least <= t AND most > t OR most > least AND most - least >= t THEN 'quarantine_and_remeasure' ELSE 'keep_threshold' END AS next_action, CASE WHEN n >= 3 THEN round(least(1.0, most + (most - least)), 6) END AS suggested FROM g")
def history_findings(spark, sf_dir):
    d = B.daily(spark, sf_dir).where("env < 4 or seq < 3")
    f = history.findings(d.withColumn("threshold", F.when(F.col("env") == 1, 5.0).otherwise(25.0)), ["entry", "env", "threshold"])
    return f.select("entry", "env", "n", "least", "most", F.round("span", 6).alias("span"), "finding", "next_action", F.round("suggested", 6).alias("suggested"))


_RUNS = f"WITH d AS (SELECT entry, env, seq, seq % 30 AS run_id, value + CASE WHEN env = 0 THEN 40 * seq ELSE 0 END AS value, env < 3 OR seq < 9 AS unchanged FROM ({B.DAILY})), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY entry, env, run_id ORDER BY seq) = 1), n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY entry, env ORDER BY seq DESC) AS j, lag(value) OVER w AS p FROM o WINDOW w AS (PARTITION BY entry, env ORDER BY seq)), m AS (SELECT entry, env, list_sort(list(value) FILTER (j <= 5)) AS y, list_sort(list(value) FILTER (i <= 5)) AS x, count(*) AS runs, count(*) FILTER (unchanged AND env <> 2 OR env = 2 AND seq % 2 = 0) AS unchanged_runs, min(value) FILTER (unchanged AND env <> 2 OR env = 2 AND seq % 2 = 0) AS lo, max(value) FILTER (unchanged AND env <> 2 OR env = 2 AND seq % 2 = 0) AS hi FROM n GROUP BY 1, 2), k AS (SELECT * FROM n WHERE p IS NULL OR p <> value QUALIFY row_number() OVER (PARTITION BY entry, env ORDER BY seq DESC) <= 10), s AS (SELECT entry, env, value, lag(value) OVER (PARTITION BY entry, env ORDER BY seq) AS p FROM k), r AS (SELECT entry, env, count(p) AS steps, count(*) FILTER (value > p) AS ups FROM s GROUP BY 1, 2), e AS (SELECT entry, env, runs, unchanged_runs, 25.0::DOUBLE AS threshold, lo, hi, coalesce(hi - lo, 0) AS span, y[len(y) // 2 + 1] - x[len(x) // 2 + 1] AS effect, unchanged_runs >= 10 AS enough, steps, ups FROM m JOIN r USING (entry, env)), c AS (SELECT *, enough AND runs >= 10 AND effect > greatest(span, 1e-9) AND steps > 0 AND 4 * ups >= 3 * steps AS candidate FROM e)"


@query(_RUNS + " SELECT entry, env, runs, unchanged_runs, threshold, CASE WHEN enough THEN round(span, 6) END AS span, CASE WHEN runs >= 10 THEN round(effect, 6) END AS effect, CASE WHEN enough AND NOT candidate THEN round(least(1.0, hi + span), 6) END AS suggested, CASE WHEN NOT enough THEN 'insufficient_unchanged_build_repeats' WHEN candidate THEN 'candidate' ELSE 'not_detected' END AS drift, CASE WHEN candidate THEN 'investigate_drift_with_fresh_matched_repeats' WHEN enough AND lo <= threshold AND hi > threshold THEN 'quarantine_and_remeasure' WHEN NOT enough THEN 'collect_unchanged_build_repeats' ELSE 'keep_threshold' END AS recommendation FROM c")
def run_drift(spark, sf_dir):
    d = B.daily(spark, sf_dir).withColumn("run_id", F.col("seq") % 30).withColumn("value", F.col("value") + F.when(F.col("env") == 0, 40 * F.col("seq")).otherwise(0)).withColumn("threshold", F.lit(25.0))
    d = d.withColumn("unchanged", F.when(F.col("env") == 2, F.col("seq") % 2 == 0).otherwise((F.col("env") < 3) | (F.col("seq") < 9)))
    r = history.run_analysis(d, ["entry", "env"])
    return r.withColumns({c: F.round(c, 6) for c in ("span", "effect", "suggested")})


@query(f"WITH d AS ({B.DAILY}), g AS (SELECT entry, env, count(*) AS n FROM d GROUP BY 1, 2) SELECT entry, env, n, greatest((SELECT count(*) FROM g) - 8, 0)::BIGINT AS omitted FROM g ORDER BY entry, env LIMIT 8")
def first_findings(spark, sf_dir):
    return history.first_page(B.daily(spark, sf_dir).groupBy("entry", "env").agg(F.count(F.lit(1)).alias("n")), ["entry", "env"], 8)


_CHRON = f"WITH d AS ({B.DAILY}), w AS (SELECT *, CASE WHEN bool_and(captured IS NOT NULL) OVER (PARTITION BY entry, env) THEN captured ELSE seq END::DOUBLE AS moment FROM d)"


@query(_CHRON + " SELECT entry, env, seq, moment FROM (SELECT *, row_number() OVER (PARTITION BY entry, env ORDER BY moment DESC, seq DESC) AS n FROM w) WHERE n <= 7")
def latest_observations(spark, sf_dir):
    return history.latest(history.chronology(B.daily(spark, sf_dir), ["entry", "env"]), ["entry", "env"], 7).select("entry", "env", "seq", "moment")


@query(_CHRON + ", l AS (SELECT *, lag(value) OVER (PARTITION BY entry, env ORDER BY moment) AS b FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY entry, env ORDER BY moment DESC, seq DESC) AS n FROM l WHERE b IS NULL OR b <> value), s AS (SELECT entry, env, value, lag(value) OVER (PARTITION BY entry, env ORDER BY moment) AS p FROM k WHERE n <= 10) SELECT entry, env, count(p) AS steps, round(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN value > p THEN 1 ELSE 0 END END), 6) AS rising FROM s GROUP BY 1, 2")
def rising_steps(spark, sf_dir):
    d = history.chronology(B.daily(spark, sf_dir), ["entry", "env"])
    return history.rising_share(d, ["entry", "env"]).select("entry", "env", "steps", F.round("rising", 6).alias("rising"))


@query(_CHRON + ", n AS (SELECT *, row_number() OVER (PARTITION BY entry, env ORDER BY moment) AS i, row_number() OVER (PARTITION BY entry, env ORDER BY moment DESC) AS j FROM w), m AS (SELECT entry, env, list_sort(list(value) FILTER (j <= 5)) AS y, list_sort(list(value) FILTER (i <= 5)) AS x FROM n GROUP BY 1, 2) SELECT entry, env, round(y[len(y) // 2 + 1] - x[len(x) // 2 + 1], 6) AS effect FROM m")
def endpoint_effects(spark, sf_dir):
    d = history.chronology(B.daily(spark, sf_dir), ["entry", "env"])
    return history.endpoint_effect(d, ["entry", "env"]).select("entry", "env", F.round("effect", 6).alias("effect"))


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, day(ts) ORDER BY event_id) = 1 AS kept FROM events")
def window_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.dayofmonth("ts"))
    return history.audited(e, ["user_id", "event_type", "d"], F.col("event_id")).select("event_id", "user_id", "event_type", "kept")


@query("SELECT event_id, user_id FROM events WHERE day(ts) > 20")
def idempotent_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("d"))
    incoming = e.where("d > 15")  # days 16 to 20 are replayed, and what is new comes twice
    return history.append_new(e.where("d <= 20"), incoming.union(incoming), ["event_id"]).select("event_id", "user_id")


FR = f"WITH f AS ({B.ORDER_FRAMES})"
OVER = 'OVER (PARTITION BY grp ORDER BY "index")'


@query(FR + f', g AS (SELECT grp, "index" - lag("index") {OVER} - 1 AS missing FROM f) SELECT grp, sum(missing)::BIGINT AS total, count(*) AS n_gaps FROM g WHERE missing > 0 GROUP BY grp')
def frame_gaps(spark, sf_dir):
    return frames.gaps(B.order_frames(spark, sf_dir), ["grp"]).select("grp", "total", "n_gaps")


@query(FR + ', v AS (SELECT *, lag("index") OVER w AS pi, lag(t) OVER w AS pt FROM f WINDOW w AS (PARTITION BY grp ORDER BY seq)) SELECT grp, seq, "index", t FROM v WHERE "index" <= pi OR t <= pt')
def order_violations(spark, sf_dir):
    return frames.violations(B.order_frames(spark, sf_dir), ["grp"]).select("grp", "seq", "index", "t")


@query(FR + f', s AS (SELECT grp, (t - lag(t) {OVER}) / ("index" - lag("index") {OVER}) AS step FROM f), m AS (SELECT grp, list_sort(list(step)) AS l FROM s WHERE step IS NOT NULL GROUP BY grp), q AS (SELECT grp, l[len(l) // 2 + 1] AS median, l[1] AS least, l[-1] AS most, len(l) AS n FROM m) SELECT grp, round(median, 6) AS median, round(least, 6) AS least, round(most, 6) AS most, n, greatest(abs(least - median), abs(most - median)) <= 0.05 * abs(median) AS constant FROM q')
def step_constancy(spark, sf_dir):
    s = frames.step_constancy(B.order_frames(spark, sf_dir), ["grp"])
    return s.select("grp", *[F.round(c, 6).alias(c) for c in ("median", "least", "most")], F.col("n"), "constant")


@query(FR + f', w AS (SELECT *, max(err) OVER k AS top, count(err) OVER k AS n FROM f WINDOW k AS (PARTITION BY grp ORDER BY "index" ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT grp, min("index") FILTER ("index" >= 20 AND top <= 0.5 AND n = 3) AS settled FROM w GROUP BY grp')
def settling_frames(spark, sf_dir):
    return frames.settling(B.order_frames(spark, sf_dir), ["grp"], 20, 3, 0.5)


@query(FR + f', w AS (SELECT *, first(value) {OVER} AS v0 FROM f) SELECT grp, min("index") FILTER (abs(value - v0) > 100) AS onset, min("index") FILTER (abs(value - v0) > 100) - 10 AS lag FROM w GROUP BY grp')
def onset_frames(spark, sf_dir):
    return frames.onset(B.order_frames(spark, sf_dir), ["grp"], 10, 100.0)


@query(FR + f', w AS (SELECT grp, "index", greatest(0, abs(candidate - lag(candidate) {OVER}) - abs(baseline - lag(baseline) {OVER})) AS pop FROM f QUALIFY lag(candidate) {OVER} IS NOT NULL) SELECT grp, round(max(pop), 6) AS pop, arg_min("index", (-pop, "index")) AS at FROM w GROUP BY grp')
def pop_frames(spark, sf_dir):
    return frames.pop(B.order_frames(spark, sf_dir), ["grp"]).select("grp", F.round("pop", 6).alias("pop"), "at")


@query(FR + f', w AS (SELECT grp, "index", abs(capture - lag(capture) {OVER}) AS c, abs(baseline - lag(baseline) {OVER}) AS b FROM f) SELECT grp, round(avg(c) - avg(b), 6) AS instability, arg_min("index", (-c, "index")) AS worst FROM w WHERE c IS NOT NULL GROUP BY grp')
def temporal_instability(spark, sf_dir):
    return frames.instability(B.order_frames(spark, sf_dir), ["grp"]).select("grp", F.round("instability", 6).alias("instability"), "worst")


@query(FR + f', w AS (SELECT grp, value - lag(value) {OVER} AS d, value - 2 * lag(value) {OVER} + lag(value, 2) {OVER} AS s FROM f) SELECT grp, round(var_pop(d), 4) AS delta_variance, round(avg(s * s) / 4, 4) AS second_energy FROM w GROUP BY grp')
def temporal_energy(spark, sf_dir):
    return frames.temporal_energy(B.order_frames(spark, sf_dir), ["grp"]).select("grp", F.round("delta_variance", 4).alias("delta_variance"), F.round("second_energy", 4).alias("second_energy"))


@query(FR + ', w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY "index" DESC) AS b FROM f QUALIFY b <= 10), a AS (SELECT grp, count(*) AS n, avg(value) FILTER (b > 5) AS x, avg(value) FILTER (b <= 5) AS y, stddev_pop(value) / avg(value) AS cv, regr_slope(value, -b) / avg(value) AS slope FROM w GROUP BY grp), c AS (SELECT grp, abs(y - x) / greatest(x, y) AS mean_change, cv, slope FROM a WHERE n = 10) SELECT grp, round(mean_change, 6) AS mean_change, round(cv, 6) AS cv, round(slope, 6) AS slope, mean_change <= 0.2 AND cv <= 0.4 AND abs(slope) <= 0.02 AS converged FROM c')
def warm_up(spark, sf_dir):
    return frames.warm_up(B.order_frames(spark, sf_dir), ["grp"], 5, 0.2, 0.4, 0.02).select("grp", *[F.round(c, 6).alias(c) for c in ("mean_change", "cv", "slope")], "converged")


@query(FR + f', d AS (SELECT grp, t - lag(t) {OVER} AS dt, CASE WHEN value = lag(value) {OVER} THEN 1 ELSE 0 END AS same FROM f), m AS (SELECT grp, list_sort(list(dt)) AS l, stddev_pop(dt) / avg(dt) AS cv, avg(same) AS frozen FROM d WHERE dt IS NOT NULL GROUP BY grp) SELECT grp, l[len(l) // 2 + 1] AS median_dt, round(cv, 6) AS cv, round(frozen, 6) AS frozen, round(len(list_filter(l, lambda x: x > 1.5 * l[len(l) // 2 + 1])) / len(l), 6) AS hitches FROM m')
def motion_statistics(spark, sf_dir):
    return frames.motion(B.order_frames(spark, sf_dir), ["grp"]).select("grp", "median_dt", *[F.round(c, 6).alias(c) for c in ("cv", "frozen", "hitches")])


@query(FR + ', h AS (SELECT grp, "index", "index" - row_number() OVER (PARTITION BY grp ORDER BY "index") AS g FROM f WHERE err > 0.4) SELECT grp, min("index") AS start, count(*) AS length FROM h GROUP BY grp, g')
def threshold_runs(spark, sf_dir):
    return frames.runs_over(B.order_frames(spark, sf_dir), ["grp"], 0.4)


@query(FR + ", v AS (SELECT grp, \"index\", CASE WHEN value > 400 THEN 'bad' WHEN value > 300 THEN 'skip' ELSE 'good' END AS verdict FROM f), e AS (SELECT grp, min(\"index\") FILTER (verdict = 'bad') AS first_bad, max(\"index\") FILTER (verdict = 'good') AS l FROM v GROUP BY grp) SELECT grp, first_bad, (SELECT max(\"index\") FROM v WHERE v.grp = e.grp AND verdict = 'good' AND \"index\" < first_bad) AS last_good, coalesce(l > first_bad, false) AS non_monotonic FROM e")
def bisection(spark, sf_dir):
    verdict = F.when(F.col("value") > 400, "bad").when(F.col("value") > 300, "skip").otherwise("good")
    return frames.bisect(B.order_frames(spark, sf_dir).withColumn("verdict", verdict), ["grp"])


@query("SELECT l_returnflag, l_linestatus, quantile_disc(l_quantity, 0.95) AS nearest, round(quantile_cont(l_extendedprice, 0.95), 4) AS linear, round(avg(l_extendedprice), 4) AS mean, round(avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS share FROM lineitem GROUP BY 1, 2")
def value_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(Q.nearest_rank("l_quantity", 0.95).alias("nearest"), F.round(Q.linear(F.col("l_extendedprice"), 0.95), 4).alias("linear"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("share"))


@query("SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-fA-F]{8,}') THEN ':id' ELSE s END), '/') AS template FROM pages")
def url_templates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.url_template(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)).alias("template"))
