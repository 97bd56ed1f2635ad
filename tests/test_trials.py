"""Preference intervals, leases, conformance, validity, ablations and verified histories against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.operators import ablation as A
from probanda.operators import conformance as C
from probanda.operators import preferences
from probanda.operators import readings as R
from probanda.operators.running import numbered
from probanda.streaming import limiter, streams


# --- preferences -----------------------------------------------------------

def plain_fit(votes, names, prior=0.1):
    """Strengths by repeated rounds over dictionaries; votes: (i, j, score, copies)."""
    games = {(a, b): 2 * prior for a in names for b in names if a != b}
    wins = dict.fromkeys(names, prior * (len(names) - 1))
    for i, j, s, n in votes:
        games[i, j] += n
        games[j, i] += n
        wins[i] += n * s
        wins[j] += n * (1 - s)
    logs = dict.fromkeys(names, 0.0)
    for _ in range(2000):
        new = {a: math.log(wins[a] / sum(games[a, b] / (math.exp(logs[a]) + math.exp(logs[b])) for b in names if b != a)) for a in names}
        mean = sum(new.values()) / len(new)
        logs = {a: x - mean for a, x in new.items()}
    return logs


def some_votes(seed, n, size, skill=1.0):
    r = random.Random(seed)
    out = []
    for _ in range(size):
        i, j = r.sample(range(n), 2)
        out.append((i, j, float(r.random() < 1 / (1 + math.exp(skill * (j - i)))) if r.random() < 0.9 else 0.5))
    return out


def test_replicates_are_whole_fits_of_resampled_votes(spark):
    votes = some_votes(3, 4, 60)
    frame = spark.createDataFrame([*votes, (1, 1, 1.0), (0, 1, None)], "i long, j long, score double")
    drawn = preferences.resampled(frame, 12, 5).collect()
    names, by = range(4), {}
    for x in drawn:
        by.setdefault(x["replicate"], []).append((x["i"], x["j"], x["wins"] / x["games"], x["games"]))
    got = {}
    for x in preferences._fitted_apart(preferences.resampled(frame, 12, 5), list(names), 0.1, 2000).collect():
        got.setdefault(x["replicate"], {})[x["candidate"]] = x["strength"]
    assert sorted(got) == list(range(12))
    for k, rows in by.items():
        half = [x for x in rows if x[0] < x[1]]  # each pair is there both ways round
        assert {(j, i, n) for i, j, _, n in rows} == {(i, j, n) for i, j, _, n in rows}
        want = plain_fit(half, names)
        assert all(got[k][c] == pytest.approx(want[c], abs=1e-6) for c in names)
    out = {x["candidate"]: x for x in preferences.preference_intervals(frame, 12, seed=5).collect()}
    for c in names:
        s = sorted(got[k][c] for k in got)
        p = sorted(1 + sum(got[k][d] > got[k][c] for d in names) for k in got)
        at = lambda q: math.floor(11 * q + 0.5)
        assert (out[c]["low"], out[c]["high"]) == (pytest.approx(s[at(0.025)]), pytest.approx(s[at(0.975)]))
        assert (out[c]["place_low"], out[c]["place_high"], out[c]["replicates"]) == (p[at(0.025)], p[at(0.975)], 12)
        assert out[c]["comparisons"] == sum(c in v[:2] for v in votes)


def test_intervals_hold_the_truth_and_tell_the_close_from_the_far(spark):
    votes = some_votes(8, 5, 900, 0.8) + [(9, 4, 1.0), (9, 4, 1.0)]
    out = {x["candidate"]: x for x in preferences.preference_intervals(spark.createDataFrame(votes, "i long, j long, score double"), 100).collect()}
    real = [out[i] for i in range(5)]
    assert all(x["low"] < x["strength"] < x["high"] and x["place_low"] <= x["place"] <= x["place_high"] for x in real)
    assert out[9]["few"] and not real[0]["few"] and out[9]["high"] - out[9]["low"] > 2 * (real[0]["high"] - real[0]["low"])
    assert real[0]["apart"] and all(x["connected"] for x in out.values())
    first = min(out.values(), key=lambda x: x["place"])
    assert first["apart"] is None
    assert preferences.preference_intervals(spark.createDataFrame([], "i long, j long, score double"), 5).count() == 0


def test_places_by_any_name(spark):
    """A place may be named as the step's own column is, and rows may have such a column."""
    frame = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "_at long, x string")
    assert sorted(map(tuple, numbered(frame.select("x"), [F.col("x").desc()], "_at").collect())) == [("a", 3), ("b", 2), ("c", 1)]
    assert sorted(map(tuple, numbered(frame, [F.col("x").desc()], "place").select("_at", "x", "place").collect())) == [(1, "a", 3), (2, "b", 2), (3, "c", 1)]


def test_large_panels_by_joins(spark):
    votes = spark.createDataFrame([v for v in some_votes(4, 5, 300) if v[0] != v[1]], "i long, j long, score double")
    pairs = preferences.resampled(votes, 2, 1)
    # All met all, so the prior is the same either way.
    a, b = (sorted((x["replicate"], x["candidate"], round(x["strength"], 1)) for x in df.collect()) for df in (preferences._fitted_apart(pairs, list(range(5)), 0.1, 500), preferences._fitted_together(pairs, 0.1, 500, 1e-3)))
    assert a == b and len(a) == 10


def test_poisson_quantiles():
    r = np.random.default_rng(1)
    for mean in (1, 7, 300, 5000):
        x = preferences.poisson(np.full(20_000, mean), r.random(20_000))
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / 20_000) and abs(x.var() / mean - 1) < 0.06
    assert list(preferences.poisson(np.array([1, 1, 2]), np.array([0.3, 0.5, 1 - 1e-17]))) [:2] == [0, 1]


# --- leases ----------------------------------------------------------------

def simulated(requests, x):
    """One request after another over all that ever happened."""
    log, used, out = [], 0, []
    for t, kind, name, model, dispatched in sorted(requests):
        if kind == "finish":
            a = next((a for a in log if a["id"] == name and a["open"] and (a["t"] + x.window > t or a["t"] + x.lease > t)), None)
            if a:
                a.update(open=False, counts=dispatched)
            out.append((name, kind, "released" if a else "ignored", None))
            continue
        again = []
        for own, most, going in ((log, x.per_window, x.under_way), ([a for a in log if a["model"] == model], x.model_per_window, x.model_under_way)):
            recent = sorted(a["t"] for a in own if a["counts"] and a["t"] + x.window > t)
            if len(recent) >= most:
                again.append(recent[-most] + x.window)
            if sum(a["open"] and a["t"] + x.lease > t for a in own) >= going:
                again.append(t + 1)
        if again:
            out.append((name, kind, "paced", max(again)))
        elif used >= x.cap:
            out.append((name, kind, "exhausted", None))
        elif any(a["id"] == name and (a["t"] + x.window > t or a["open"] and a["t"] + x.lease > t) for a in log):
            out.append((name, kind, "duplicate", None))
        else:
            log.append({"t": t, "id": name, "model": model, "open": True, "counts": True})
            used += 1
            out.append((name, kind, "admitted", None))
    return out


def test_stream_with_a_stop_against_one_request_after_another(spark, tmp_path):
    r = random.Random(5)
    limits = limiter.Limits(per_window=5, under_way=3, model_per_window=3, model_under_way=2, window=60.0, lease=90.0, cap=40)
    parts, want = [[], [], []], {}
    for p in ("p", "q"):
        t, requests = 1_700_000_000.0, []
        for i in range(150):
            t += r.choice([1, 4, 9, 25])
            requests.append((t, "reserve", f"{p}{i if r.random() < 0.9 else i - 1}", r.choice("ab"), True))
            if r.random() < 0.7:
                requests.append((t + r.choice([3, 20, 60]), "finish", f"{p}{i}", "a", r.random() < 0.7))
        requests.sort()
        want[p] = simulated(requests, limits)
        for k in range(3):
            parts[k] += [(p, m, n, kind, t, d) for t, kind, n, m, d in requests[k * 80 : (k + 1) * 80 if k < 2 else None]]
    shape = "provider string, model string, id string, kind string, t double, dispatched boolean"
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for part in parts:  # the stream stops after each file and goes on from its checkpoint
        spark.createDataFrame(part, shape).withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t").coalesce(1).write.mode("append").parquet(source)
        stream = streams.events_stream(spark, source, "*.parquet")
        streams.run_all(limiter.leased(stream, limits, "100 days"), lambda batch, _: batch.write.mode("append").parquet(out), checkpoint=mark)
    got = spark.read.parquet(out).collect()
    for p, rows in want.items():
        assert sorted(map(str, ((x["id"], x["kind"], x["decision"], x["retry_at"]) for x in got if x["provider"] == p))) == sorted(map(str, rows))
        assert {x[2] for x in rows} == {"admitted", "paced", "exhausted", "released", "ignored"} | ({"duplicate"} if any(x[2] == "duplicate" for x in rows) else set())


# --- captures --------------------------------------------------------------

H = "a" * 64
PRINT = {"fingerprint.schema": C.FINGERPRINT_SCHEMA, "producer.binary": f"sha256:{H}", "inputs.identity": f"sha256:{H}", "run.session": "r", "run.env.os": "x", "run.readiness.loaded.reached": "true"}
SHAPES = {
    "runs": "run string, schema string, complete boolean", "slots": "run string, slot string, settings string, fingerprint map<string,string>, domain string",
    "acquisitions": "run string, slot string, status string, error string, settings string, fingerprint map<string,string>, domain string, clock_run string, start_ns long, end_ns long, path string, sha256 string", "files": "run string, path string, content string"}


def record(**changes):
    """Tables of one good run of two slots; what a test changes is given by slot and column."""
    sha = hashlib.sha256(b"pixels").hexdigest()
    slots = [{"run": "r", "slot": s, "settings": "hi", "fingerprint": PRINT, "domain": "main"} for s in "ab"]
    made = [{"run": "r", "slot": s, "status": "acquired", "error": None, "settings": "hi", "fingerprint": PRINT, "domain": "main", "clock_run": "r", "start_ns": 10 * i, "end_ns": 10 * i + 5, "path": f"{s}.png", "sha256": sha} for i, s in enumerate("ab")]
    tables = {"runs": [{"run": "r", "schema": C.RECORD_SCHEMA, "complete": True}], "slots": slots, "acquisitions": made, "files": [{"run": "r", "path": f"{s}.png", "content": "pixels"} for s in "ab"]}
    for name, change in changes.items():
        tables[name] = change(tables[name])
    return tables


def codes(spark, tables):
    frames = [spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in SHAPES[n].split(", ")) for r in tables[n]], SHAPES[n]) for n in SHAPES]
    return sorted(((x["slot"], x["code"]) for x in C.conformance(*frames).collect()), key=str)


def put(name, **values):
    return lambda rows: [r | values if r["slot"] == name else r for r in rows]


def test_one_defect_for_each_code(spark):
    assert codes(spark, record()) == []
    a = lambda **v: record(acquisitions=put("a", **v))
    without = lambda key: {k: v for k, v in PRINT.items() if k != key}
    cases = [
        (a(status="skipped"), ["partial_run"]), (a(status="failed"), ["acquisition_failed"]), (a(error="x"), ["acquisition_failed"]), (a(settings="lo"), ["settings_mismatch"]), (a(settings=None), ["settings_mismatch"]), (a(fingerprint=None), ["missing_identity"]), (a(fingerprint=without("producer.binary")), ["missing_identity"]),
        (a(fingerprint=PRINT | {"producer.binary": "sha256:short"}), ["missing_identity"]), (a(fingerprint=PRINT | {"run.env.os": "y"}), ["identity_mismatch"]), (a(fingerprint=PRINT | {"run.readiness.loaded.reached": "false"}), ["readiness_not_reached"]), (a(domain="other"), ["clock_mismatch"]), (a(domain=None), ["clock_mismatch"]), (a(clock_run="q"), ["clock_mismatch"]), (a(end_ns=-1), ["clock_mismatch"]),
        (a(path=None), ["missing_image"]), (a(path="no.png"), ["missing_image"]), (a(path="../a.png"), ["unsafe_image_path"]), (a(sha256="A" * 64), ["invalid_record"]), (a(sha256=H), ["stale_hash"]), (record(acquisitions=lambda rows: rows[1:]), ["partial_run"]), (record(slots=put("a", domain=" ")), ["invalid_record"]), (record(slots=put("a", fingerprint=PRINT | {"run.session": "q"})), ["invalid_record"]),
        (a(settings="lo", path=None, end_ns=-1), ["clock_mismatch", "missing_image", "settings_mismatch"])]
    for tables, want in cases:
        assert codes(spark, tables) == [("a", c) for c in want], want
    assert codes(spark, record(acquisitions=put("a", end_ns=12))) == [("b", "clock_overlap")]


def test_findings_of_whole_runs(spark):
    again, stray = (lambda rows: [*rows, rows[0]]), (lambda rows: [*rows, rows[0] | {"slot": "z"}])
    for tables in (record(acquisitions=again), record(slots=again), record(acquisitions=stray), record(slots=lambda rows: []), record(slots=put("a", slot=" "))):
        assert codes(spark, tables) == [(None, "invalid_record")]
    assert codes(spark, record(runs=lambda rows: [rows[0] | {"schema": "v0"}], acquisitions=again)) == [(None, "unsupported_schema")]
    assert codes(spark, record(runs=lambda rows: [rows[0] | {"complete": None}])) == [(None, "partial_run")]


# --- arms ------------------------------------------------------------------

ARM = {"fingerprint.schema": C.FINGERPRINT_SCHEMA, "producer.binary": "b", "inputs.identity": "i", "run.mode": "full", "run.session": "s", "producer.build.opt": "3", "run.env.os": "x", "run.readiness.loaded.criterion": "c", "run.readiness.loaded.reached": "true", "run.readiness.loaded.observed": "o"}


def findings(spark, base, capture, rules=()):
    side = lambda d: spark.createDataFrame([("1", k, v) for k, v in d.items()], "arm string, key string, value string")
    found = C.arm_findings(side(base), side(capture), spark.createDataFrame(list(rules), "arm string, pattern string, kind string"))
    return sorted((x["key"], x["reason"]) for x in found.collect())


def test_differences_go_to_the_most_specific_rule(spark):
    base, capture = ARM | {"a.b.c": "1", "a.x.c": "1", "q.r": "1", "same": "1", "gone": "1"}, ARM | {"a.b.c": "2", "a.x.c": "2", "q.r": None, "same": "1"}
    assert findings(spark, base, capture) == [("a.b.c", "difference"), ("a.x.c", "difference"), ("gone", "difference"), ("q.r", "difference")]
    rules = [(None, "a", "ignore"), (None, "a.*.c", "vary"), (None, "a.b.c", "ignore"), ("1", "r", "vary"), ("2", "gone", "vary"), (None, "same", "vary"), (None, "*", "ignore")]
    assert findings(spark, base, capture, rules) == [("a.b.c", "ignored"), ("a.x.c", "varied"), ("gone", "ignored"), ("q.r", "varied"), ("same", "never_varies")]
    # A star does not reach over a slash, and letters of a pattern are no expression.
    assert findings(spark, ARM | {"k/l": "1", "k.l": "1"}, ARM | {"k/l": "2", "k.l": "2"}, [(None, "k*", "vary"), (None, "k.", "ignore")]) == [("k.l", "varied"), ("k/l", "difference")]


def test_identity_and_readiness(spark):
    assert findings(spark, ARM, ARM) == []
    drop = lambda *keys: {k: v for k, v in ARM.items() if k not in keys}
    assert findings(spark, drop("inputs.identity"), drop("inputs.identity")) == [("inputs.identity", "missing")]
    assert findings(spark, ARM | {"run.mode": " "}, ARM | {"run.mode": " "}) == [("run.mode", "malformed")]
    assert findings(spark, ARM | {"fingerprint.schema": "v0"}, ARM | {"fingerprint.schema": "v0"}) == [("fingerprint.schema", "malformed")]
    assert findings(spark, drop("run.env.os"), drop("run.env.os")) == [("run.env", "missing")]
    late = ARM | {"run.readiness.loaded.reached": "false"}
    assert findings(spark, late, late) == [("run.readiness.loaded.reached", "readiness_not_reached")]
    unseen = drop("run.readiness.loaded.observed")
    assert findings(spark, unseen, unseen) == [("run.readiness.loaded.observed", "missing")]
    bare = {k: v for k, v in ARM.items() if "readiness" not in k}
    assert findings(spark, bare, bare) == [("run.readiness", "missing")]
    arms = spark.createDataFrame([("1",), ("2",)], "arm string")
    found = spark.createDataFrame([("1", "varied"), ("2", "difference"), ("2", "missing")], "arm string, reason string")
    assert sorted(tuple(x) for x in C.arm_validity(found, arms).collect()) == [("1", True, 0), ("2", False, 2)]


# --- ablations -------------------------------------------------------------

def study(spark, captures, times):
    out = A.ablation(spark.createDataFrame([("s", *c) for c in captures], "study string, arm string, repeat int, image string, digest string, error double"), spark.createDataFrame([("s", *t) for t in times], "study string, arm string, repeat int, ms double"), "base")
    return {x["arm"]: x for x in out.collect()}


def test_an_image_that_fails_in_one_arm_leaves_all_means(spark):
    errors = {"base": (0.0, 0.0, 0.0), "x": (0.1, 0.2, 0.9), "y": (0.3, 0.4, 0.5)}
    captures = [(arm, r, i, f"{arm}{i}", e) for arm, row in errors.items() for r in (0, 1) for i, e in zip("abc", row, strict=True)]
    times = [(arm, r, t + r) for arm, t in (("base", 10.0), ("x", 8.0), ("y", 8.5)) for r in (0, 1)]
    whole = study(spark, captures, times)
    assert (whole["x"]["images"], whole["x"]["mean"], whole["y"]["mean"]) == (3, pytest.approx(0.4), pytest.approx(0.4))
    # Within the base's own range of 1 ms both are as fast.
    assert (whole["x"]["shift"], whole["y"]["shift"], whole["x"]["place"], whole["y"]["place"]) == (-2.0, -1.5, 1, 1)
    holed = [c[:4] + (None,) if c[0] == "y" and c[2] == "c" else c for c in captures]
    part = study(spark, holed, [(a, r, t + 4 if a == "y" else t) for a, r, t in times])
    assert (part["x"]["images"], part["x"]["mean"], part["y"]["mean"]) == (2, pytest.approx(0.15), pytest.approx(0.35)) and (part["x"]["place"], part["y"]["place"]) == (1, 2)
    unread = [(*c[:3], None, c[4]) if c[0] == "y" and c[2] == "c" else c for c in captures]
    out = study(spark, unread, times)
    assert (out["y"]["status"], out["y"]["left_out"], out["y"]["place"], out["x"]["images"]) == ("excluded", 2, None, 3)


def test_repeats_that_do_not_count(spark):
    rows = [("base", r, i, f"{i}", 0.0) for r in (0, 1) for i in "ab"] + [("x", 0, "a", "a", 0.1), ("x", 1, "a", "a", 0.2), ("x", 1, "b", "b", 0.2), ("x", 2, "a", "z", 0.4), ("x", 2, "b", "b", 0.2), ("z", 0, "a", "a", 0.1), ("z", 0, "b", "b", 0.1), ("z", 1, "a", "a", 0.1), ("z", 1, "b", "b", 0.1), ("z", 1, "c", "c", 0.1)]
    times = [("base", 0, 5.0), ("base", 1, 5.0), ("x", 1, 4.0), ("x", 2, 4.0), ("x", 0, 4.0), ("z", 1, 3.0), ("z", 0, -1.0)]
    frames = spark.createDataFrame([("s", *c) for c in rows], "study string, arm string, repeat int, image string, digest string, error double"), spark.createDataFrame([("s", *t) for t in times], "study string, arm string, repeat int, ms double")
    problems = {(x["arm"], x["repeat"]): x["problem"] for x in A.complete_repeats(*frames, "base").collect()}
    assert problems == {("base", 0): None, ("base", 1): None, ("x", 0): "image_set_differs", ("x", 1): None, ("x", 2): None, ("z", 0): "missing_timing", ("z", 1): "image_set_differs"}
    out = study(spark, rows, times)
    assert (out["x"]["status"], out["x"]["unstable"], out["x"]["place"], out["z"]["status"]) == ("unstable", 1, None, "excluded")
    lone = [r for r in rows if r[0] != "base"]
    assert {x["status"] for x in study(spark, lone, times).values()} == {"no_base"}
    assert study(spark, [], []) == {}


# --- histories -------------------------------------------------------------

def test_tampering_in_each_place(spark):
    entry = {"name": "e", "status": "pass", "validity": "valid", "metric": "mean", "value": 0.5, "threshold": 1.0, "baseline_sha256": "b", "capture_sha256": "c"}
    odd = [entry | {"name": "f", "status": "missing"}, entry | {"name": "g", "validity": "invalid"}, entry | {"name": "h", "value": None}, entry | {"name": "i", "capture_sha256": None}]
    content = json.dumps({"config": "k", "entries": [entry, *odd, entry | {"name": "j", "value": 0.25, "validity": None}]})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = [("e", "mean", 0.5, 1.0, "b", "c"), ("j", "mean", 0.25, 1.0, "b", "c")]

    def state(content=content, stored=content, config="k", samples=kept, report=None):
        report = report or sha(content)
        index = spark.createDataFrame([(report, sha(config))], "report string, config_sha256 string")
        held = spark.createDataFrame([(report, *s) for s in samples], "report string, entry string, metric string, value double, threshold double, baseline_sha256 string, capture_sha256 string")
        objects = spark.createDataFrame([(report, stored)] if stored is not None else [], "report string, content string")
        x = C.verified_history(index, held, objects).first()
        return tuple(x)[1:]

    assert state() == ("verified", 0, 0, 0)
    assert state(stored=None) == ("object_missing", None, None, None)
    assert state(stored=content.replace("0.25", "0.26")) == ("content_changed", None, None, None)
    assert state(report="x" * 64) == ("invalid_identity", None, None, None)
    assert state(content="{", stored="{") == ("malformed", None, None, None)
    assert state(config="other") == ("config_changed", 0, 0, 0)
    assert state(samples=kept[:1]) == ("samples_changed", 1, 0, 0)
    assert state(samples=[*kept, ("f", "mean", 0.5, 1.0, "b", "c")]) == ("samples_changed", 0, 1, 0)
    assert state(samples=[kept[0], ("j", "mean", 0.2500001, 1.0, "b", "c")]) == ("samples_changed", 0, 0, 1)


# --- readings --------------------------------------------------------------

def test_recognition_tables(spark):
    good = "\n".join([R.HEADER, "1\t1\t0\t0\t0\t0\t0\t0\t90\t90\t-1\t", "5\t1\t1\t1\t1\t1\t5\t6\t20\t10\t96.5\tSave", "5\t1\t1\t1\t1\t2\t30\t6\t30\t10\t41\tall\tof", "5\t1\t1\t1\t2\t1\t80\t80\t20\t5\t90\tbeyond", "5\t1\t1\t1\t2\t2\tx\t1\t1\t1\t90\tbad", "5\t1\t1", "5\t1\t1\t1\t2\t3\t1\t1\t1\t1\t9\t", ""])
    files = spark.createDataFrame([("a", good, 90, 90), ("b", "level\tx", 9, 9), ("c", R.HEADER, 9, 9), ("d", None, 9, 9)], "page string, content string, width int, height int")
    got = sorted((x["page"], x["slot"], x["at"], x["text"], x["confidence"], x["problem"]) for x in R.tsv_words(files).collect() if x["problem"] is None)
    assert got == [("a", "1/1/1/1/1", 1, "Save", 96.5, None), ("a", "1/1/1/1/2", 2, "all\tof", 41.0, None)]
    assert sorted((x["page"], x["problem"]) for x in R.tsv_words(files).collect() if x["problem"]) == [("a", "malformed"), ("a", "malformed"), ("a", "outside"), ("b", "header"), ("d", "header")]


def test_phrases_and_how_sure_they_are(spark):
    words = [("p", 1, i, w, c) for i, (w, c) in enumerate([("Save", 90.0), ("all", 80.0), ("files", None)])] + [("p", 2, 0, "Save", 10.0), ("p", 2, 1, "alloy", 95.0), ("q", 1, 0, "a.b", 50.0), ("q", 1, 1, "aXb", 99.0)]
    frame = spark.createDataFrame(words, "page string, line int, at int, text string, confidence double")
    asked = [("p", "Save"), ("p", "Save all"), ("p", "all files"), ("p", "files"), ("p", "loy"), ("p", "none"), ("p", ""), ("q", "a.b"), ("r", "x")]
    got = {(x["page"], x["phrase"]): (x["present"], x["readable"]) for x in R.expected_readings(frame, spark.createDataFrame(asked, "page string, phrase string"), 60.0).collect()}
    assert got == {("p", "Save"): (True, True), ("p", "Save all"): (True, True), ("p", "all files"): (True, None), ("p", "files"): (True, None), ("p", "loy"): (True, True), ("p", "none"): (False, False), ("p", ""): (False, False), ("q", "a.b"): (True, False), ("r", "x"): (False, False)}
    at = spark.createDataFrame([("aaaa", "aa"), ("xabab", "ab"), ("", "a"), ("a+b", "+")], "t string, p string").select(R.places(F.col("t"), F.col("p"))).collect()
    assert [x[0] for x in at] == [[0, 2], [1, 3], [], [1]]


def test_critical_regions(spark):
    def gate(candidate, ocr=False, complete=True, legible=True, base=(("Total 5", 12.0, 12.0, 30.0, 10.0, 99.0),), source=True):
        regions = spark.createDataFrame([("p", "r", 10, 10, 100, 20, ["Total 5", "Total 6"])], "page string, region string, x int, y int, w int, h int, accepted array<string>")
        sources = spark.createDataFrame([("p", "baseline", False, True, 400, 300), *([("p", "candidate", ocr, complete, 400, 300)] if source else [])], "page string, side string, ocr boolean, complete boolean, width int, height int")
        nodes = spark.createDataFrame([("p", s, *n) for s, rows in (("baseline", base), ("candidate", candidate)) for n in rows], "page string, side string, text string, x double, y double, w double, h double, confidence double")
        seen = spark.createDataFrame([("p", "r", "baseline", True), ("p", "r", "candidate", legible)], "page string, region string, side string, legible boolean")
        reason = {x["side"]: x["reason"] for x in R.region_texts(regions, sources, nodes, 60.0).collect()}["candidate"]
        states = R.critical_text(regions, sources, nodes, seen, 60.0)
        assert R.page_verdicts(states).first()["state"] == states.first()["state"]
        return states.first()["state"], reason

    node = lambda text="Total 6", x=12.0, y=12.0, w=30.0, h=10.0, c=99.0: (text, x, y, w, h, c)
    assert gate([node()]) == ("pass", None)
    assert gate([node("Total  6")]) == ("fail", None)
    assert gate([node()], legible=False) == ("fail", None) and gate([node()], legible=None) == ("insufficient_evidence", None)
    assert gate([]) == ("fail", "no_text") and gate([], ocr=True) == ("insufficient_evidence", "no_text") and gate([], complete=False) == ("insufficient_evidence", "no_text")
    assert gate([node(), node("x", x=50.0)]) == ("insufficient_evidence", "several_units") and gate([node(), node("far", x=300.0, y=200.0)]) == ("pass", None)
    assert gate([node(x=5.0)]) == ("insufficient_evidence", "crosses_boundary") and gate([node(x=None)]) == ("insufficient_evidence", "unlocated") and gate([node(), node("off", x=390.0)]) == ("insufficient_evidence", "invalid_geometry")
    assert gate([node("other", c=50.0)], ocr=True) == ("insufficient_evidence", "unsure") and gate([node(c=None)], ocr=True) == ("insufficient_evidence", "unsure") and gate([node("other")], ocr=True) == ("fail", None)
    assert gate([node()], complete=False) == ("insufficient_evidence", "incomplete") and gate([node()], source=False) == ("insufficient_evidence", "unavailable") and gate([node()], base=()) == ("insufficient_evidence", None)


def test_rules_meet_each_key_once(spark):
    keys = spark.createDataFrame([(a, k) for a in "12" for k in ("x.y", "z")], "arm string, key string")
    rules = spark.createDataFrame([(None, "x", "ignore"), ("2", "y", "vary"), ("2", "x.y", "vary")], "arm string, pattern string, kind string")
    found = C.resolved(keys, rules)
    assert {(r["arm"], r["key"]): r["kind"] for r in found.collect()} == {("1", "x.y"): "ignore", ("2", "x.y"): "vary", ("1", "z"): None, ("2", "z"): None}
    assert "Aggregate [key#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_compared_by_report(spark):
    """Contents are not shuffled and samples only by their report; repeated and unnamed entries count as in an outer join of both sides."""
    entry = {"name": "e", "status": "pass", "validity": "valid", "metric": "mean", "value": 0.5, "threshold": 1.0, "baseline_sha256": "b", "capture_sha256": "c"}
    content = json.dumps({"config": "k", "entries": [entry, entry, entry | {"name": None}, entry | {"name": "f"}]})
    report = hashlib.sha256(content.encode()).hexdigest()
    held = [(report, n, "mean", v, 1.0, "b", "c") for n, v in (("e", 0.5), ("e", 0.25), (None, 0.5), ("f", 0.5), ("g", 0.5))] + [("0" * 64, "e", "mean", 0.5, 1.0, "b", "c")]
    index = spark.createDataFrame([(report, hashlib.sha256(b"k").hexdigest())], "report string, config_sha256 string")
    samples = spark.createDataFrame(held, "report string, entry string, metric string, value double, threshold double, baseline_sha256 string, capture_sha256 string")
    out = C.verified_history(index, samples, spark.createDataFrame([(report, content)], "report string, content string"))
    assert [tuple(x) for x in out.collect()] == [(report, "samples_changed", 1, 2, 2)]
    moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert moved and not any("entry" in x or "content" in x for x in moved)


def test_fingerprints_are_not_shuffled(spark, monkeypatch):
    """Only answers about fingerprints go on; runs without a record are left out by either join."""
    other = [record()["runs"][0] | {"run": "s"}]
    tables = record(acquisitions=put("a", fingerprint=PRINT | {"run.env.os": "y"}), slots=lambda rows: [*rows, rows[0] | {"run": "nobody"}], runs=lambda rows: [*rows, *other])
    want = [(None, "invalid_record"), ("a", "identity_mismatch")]
    assert codes(spark, tables) == sorted(want, key=str)
    monkeypatch.setattr(C, "SMALL", 0)
    assert codes(spark, tables) == sorted(want, key=str)
    out = C.conformance(*[spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in SHAPES[n].split(", ")) for r in tables[n]], SHAPES[n]) for n in SHAPES])
    # All maps are gone below the first join.
    plan = out._jdf.queryExecution().optimizedPlan()
    below = [plan]
    while below:
        node = below.pop()
        under = [node.children().apply(i) for i in range(node.children().size())]
        assert not (node.nodeName() in ("Join", "Window") and any("fingerprint" in x.output().mkString(" ") for x in under))
        below += under
