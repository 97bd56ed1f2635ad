"""Rules of reviews, bindings, bootstraps and readers on fixtures with known results."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.operators import frames, grids, history, intervals, pairing, perf, review, running, similarity, stats, text, votes
from probanda.plans import evidence
from probanda.sources import readers, tables

from .conftest import SMALL


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_manual_pairs_leave_the_second_side_of_a_refused_pair_free(spark):
    p = rows(spark, [(0, 1, 10), (1, 1, 11), (2, 2, 11), (3, 3, 11), (4, 9, 12)], "ord int, i int, j int")
    left, right = rows(spark, [(i, f"l{i}") for i in (1, 2, 3)], "i int, left string"), rows(spark, [(j, f"r{j}") for j in (10, 11, 12)], "j int, right string")
    assert sorted((r["i"], r["j"]) for r in pairing.manual(p, left, right).collect()) == [(1, 10), (2, 11)]


def test_findings_need_three_captures_and_a_span_of_the_threshold(spark):
    data = [(g, f"c{i}", float(v), i, 2.0) for g, vs in {"few": [1, 9], "noisy": [3, 4, 5], "flaky": [1, 2, 3], "same": [1, 1, 1], "edge": [3, 3, 5]}.items() for i, v in enumerate(vs)]
    out = {r["g"]: r for r in history.findings(rows(spark, data, "g string, capture string, value double, seq int, threshold double"), ["g", "threshold"]).collect()}
    assert {g: r["finding"] for g, r in out.items()} == {"few": "insufficient_history", "noisy": "noise_dominates_threshold", "flaky": "flaky_threshold", "same": "stable_observed", "edge": "noise_dominates_threshold"}
    assert out["few"]["suggested"] is None and out["same"]["suggested"] == 1.0 and out["few"]["next_action"] == "capture_more_distinct_repeats"


def test_drift_must_exceed_the_span_of_unchanged_builds(spark):
    data = []
    for g, step in (("rises", 3.0), ("within", 0.02)):
        data += [(g, f"n{i}", i, 1.0 + (i % 3) * 0.5, 9.0, True) for i in range(12)] + [(g, f"c{i}", 12 + i, 1.0 + i * step, 9.0, False) for i in range(12)]
    data += [("few", f"n{i}", i, 1.0 + i, 9.0, i < 5) for i in range(12)] + [("few", "n3", 99, 500.0, 9.0, False)]
    out = {r["g"]: r for r in history.run_analysis(rows(spark, data, "g string, run_id string, seq int, value double, threshold double, unchanged boolean"), ["g"]).collect()}
    assert {g: r["drift"] for g, r in out.items()} == {"rises": "candidate", "within": "not_detected", "few": "insufficient_unchanged_build_repeats"}
    assert out["few"]["runs"] == 12 and out["rises"]["suggested"] is None and out["within"]["suggested"] == 1.0


@pytest.mark.parametrize(("values", "converged"), [([10.0] * 64, True), ([10 + 0.1 * i for i in range(64)], False), ([8.0 if i % 2 else 12.0 for i in range(64)], False), ([10.0] * 8, None)])
def test_warm_up_converges_on_a_steady_tail_only(spark, values, converged):
    out = frames.warm_up(rows(spark, [("g", i, v) for i, v in enumerate(values)], "g string, index int, value double"), ["g"]).collect()
    assert [r["converged"] for r in out] == ([] if converged is None else [converged])


def test_the_bound_after_the_end_is_exclusive(spark):
    c = rows(spark, [("g", 1, "hi", 10.0, 20.0)], "group string, cue int, text string, start double, end double")
    o = rows(spark, [("g", i, "hi", t) for i, t in enumerate([4.9, 5.0, 10.0, 19.9, 20.0, 24.9, 25.0])], "group string, obs int, text string, t double")
    got = {r["obs"]: r["cue"] for r in intervals.assign(c, o, 5.0).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: None}


def test_cue_findings(spark):
    c = rows(spark, [(g, 1, "hi", 10.0, 20.0) for g in "abcdefg"], "group string, cue int, text string, start double, end double")
    said = {
        "a": [(t, "hi", True) for t in range(10, 20)], "b": [(t, "", True) for t in range(10, 20)], "c": [(t, "no", True) for t in range(10, 20)], "d": [(t, "hi" if t != 14 else "no", True) for t in range(10, 20)],
        "e": [(t, "hi", t != 12) for t in range(10, 20)], "f": [(t, None if t == 13 else "", True) for t in range(10, 20)], "g": [(t, "" if t < 14 or t > 16 else "hi", True) for t in range(10, 20)],
    }
    o = rows(spark, [(g, i, x, float(t), ok) for g, v in said.items() for i, (t, x, ok) in enumerate(v)], "group string, obs int, text string, t double, legible boolean")
    got = {r["group"]: (r["covered"], r["findings"]) for r in intervals.findings(c, o, 5.0, 1.5, 1.0).collect()}
    assert got == {"a": (True, ""), "b": (True, "missing"), "c": (True, "text_mismatch"), "d": (True, "interrupted"), "e": (True, "illegible"), "f": (False, ""), "g": (True, "late,ends_before_end,interrupted")}


def test_medians_by_listing_and_by_bisection(spark, monkeypatch):
    r = random.Random(3)
    data = [(g, r.choice([r.gauss(0, 5), 1.0])) for g in "ab" for _ in range(41 if g == "a" else 60)]
    df = rows(spark, data, "g string, value double")
    want = {g: float(np.median([(x + y) / 2 for x, y in itertools.combinations_with_replacement([v for k, v in data if k == g], 2)])) for g in "ab"}
    both = {g: float(np.median([x - y for k, x in data if k == g for j, y in data[:30] if j == g])) for g in "a"}
    for listed in (10**6, 100):
        monkeypatch.setattr(stats, "LISTED", listed)
        assert {x["g"]: x["hl"] for x in stats.hodges_lehmann(df, ["g"]).collect()} == pytest.approx(want, abs=1e-9)
        assert {x["g"]: x["shift"] for x in stats.shift(df, rows(spark, data[:30], "g string, value double"), ["g"]).collect()} == pytest.approx(both, abs=1e-9)


def test_preference_rounds_agree_with_one_task(spark):
    r = random.Random(8)
    data = [(i, j, float(r.random() < (j + 1) / (i + j + 2))) for i in range(6) for j in range(i) for _ in range(40)]
    df = rows(spark, data, "i long, j long, score double")
    a, b = ({x["candidate"]: (x["strength"], x["place"], x["connected"]) for x in stats.bradley_terry(df, rounds=60, small=s).collect()} for s in (10**6, 0))
    assert {k: v[1:] for k, v in a.items()} == {k: v[1:] for k, v in b.items()} and all(abs(a[k][0] - b[k][0]) < 1e-4 for k in a)
    apart = rows(spark, [(1, 2, 1.0), (3, 4, 0.0)], "i long, j long, score double")
    assert {x["connected"] for x in stats.bradley_terry(apart).collect()} == {False}


def test_running_sums_and_gate_over_many_values(spark):
    data = [(i / 997, int(i % 7 > 2 or i > 500)) for i in range(997)]
    df = rows(spark, data, "confidence double, correct int").repartition(5)
    tails = [(c, sum(y for x, y in data if x >= c) / sum(x >= c for x, _ in data)) for c, _ in data[:-20]]
    assert votes.suggested_gate(df, 0.9, 20).first()["gate"] == min(c for c, a in tails if a >= 0.9)
    n = running.numbered(df, [F.col("confidence")], "place").agg(F.max("place"), F.count_distinct("place")).first()
    assert tuple(n) == (997, 997)
    assert votes.suggested_gate(df.limit(0), 0.9, 20).first()["gate"] is None


def test_arm_intervals_of_separate_arms(spark):
    base, arms = [10.0, 10.2, 9.8], {"slow": [11.0, 11.4, 10.6], "fast": [6.0, 6.1, 5.9], "null": [10.0, 10.2, 9.8], "one": [9.0], "two": [9.0, 9.2]}
    b = rows(spark, [("s", i, v) for i, v in enumerate(base)], "s string, ord int, value double")
    a = rows(spark, [("s", k, i, v) for k, vs in arms.items() for i, v in enumerate(vs)], "s string, arm string, ord int, value double")
    out = {r["arm"]: r for r in stats.arm_summary(b, a, ["s", "arm"]).collect()}
    assert [out[k]["median"] for k in ("fast", "null", "slow")] == [6.0, 10.0, 11.0]
    assert out["fast"]["high"] < -3 and out["slow"]["low"] > 0 and out["one"]["low"] is None and out["two"]["high"] < 0
    assert out["slow"]["iqr"] > out["fast"]["iqr"] and out["null"]["shift"] == 0


def test_draws_of_two_bounds_follow_one_stream(spark):
    z = stats._draws(11, 50, 3, 5)
    assert z.shape == (50, 8) and z[:, :3].max() == 2 and z[:, 3:].max() == 4
    assert (stats._draws(11, 50, 4, 4).ravel() == stats.split_mix(11, 4, 400)).all()


def test_timing_verdicts(spark):
    r = random.Random(4)
    def session(name, factor, spread, aa_spread=0.002, n=24):
        pairs = [(name, i, f"b{i}", "ab" if i % 2 else "ba", False, 10.0, 10 * factor * (1 + r.gauss(0, spread))) for i in range(n)]
        return pairs + [(name, 100 + i, f"a{i}", "ab", True, 10.0, 10 * math.exp(r.gauss(0, aa_spread))) for i in range(n)]

    data = session("slow", 1.2, 0.01) + session("fast", 0.8, 0.01) + session("same", 1.0, 0.004) + session("wide", 1.03, 0.06) + session("few", 1.2, 0.01, n=4) + session("noisy", 1.2, 0.01, 0.5)
    shape = "session string, ord int, block string, order string, aa boolean, before double, after double"
    out = {x["session"]: x for x in stats.timing_verdict(rows(spark, data, shape), ["session"], 3.0, [4, 24]).collect()}
    assert {k: v["verdict"] for k, v in out.items()} == {"slow": "slower", "fast": "faster", "same": "equivalent", "wide": "inconclusive", "few": "inconclusive", "noisy": "inconclusive"}
    assert out["wide"]["reasons"] == "ci_spans_equivalence_band" and "aa_noise_floor_too_wide" in out["noisy"]["reasons"]
    assert out["few"]["reasons"].split(",")[:2] == ["too_few_pairs", "too_few_same_session_aa_pairs"]


def test_timer_quantum(spark):
    data = [("g", 0.25 * k + e) for k, e in ((3, 0), (7, 1e-8), (12, 0), (14, 0), (3, 0))] + [("one", 4.0)] + [("six", 6.0 * k) for k in (1, 3, 4)]
    out = {r["g"]: r["quantum"] for r in perf.timer_quantum(rows(spark, data, "g string, value double"), ["g"]).collect()}
    assert out["g"] == pytest.approx(0.25, abs=1e-6) and out["one"] is None and out["six"] == 6.0


def test_layer_predicates(spark):
    df = rows(spark, [(0.0, "sky"), (2.0, "rock"), (5.0, "rocket"), (float("nan"), None)], "v double, label string")
    hits = lambda spec: [i for i, r in enumerate(df.select(review.layer_predicate(spec, F.col("v"), F.col("label"))[1].alias("h")).collect()) if r["h"]]
    assert [hits(s) for s in ("n=id=2,5", "n=range=0,2", "n=above=2", "n=label=rock*", "n=material=sky")] == [[1, 2], [0, 1], [2, 3], [1, 2], [0]]
    for bad in ("n", "=mask", "n=id=", "n=id=-1", "n=id=4294967296", "n=above=nan", "n=range=3,1", "n=range=1", "n=label=", "n=what"):
        with pytest.raises(ValueError):
            review.layer_predicate(bad, F.col("v"), F.col("label"))
    with pytest.raises(ValueError):
        review.page(df, ["v"], ["passed"])


def test_readers(spark):
    f = rows(spark, [(1, '{"a":{"b":1,"c":{}},"d":[1,2],"e":"x"}'), (2, "{"), (3, None), (4, "{}")], "id int, json string")
    assert sorted(map(tuple, readers.flattened(f, ["id"]).collect())) == [(1, "a.b", "1"), (1, "a.c", "{}"), (1, "d", "[1,2]"), (1, "e", "x")]
    paths = rows(spark, [(p,) for p in ("a/b.png", "/a", "../a", "a/../b", "a//b", "C:/x", "a\\b", "", "a/.", "a..b/c")], "p string")
    assert [r[0] for r in paths.select(readers.safe_relative(F.col("p"))).collect()] == [True] + [False] * 8 + [True]
    maps = rows(spark, [("ok", '{"schema":"m","fps":30.0,"frames":[{"index":0,"time_s":0.0,"path":"a.png"},{"index":2,"time_s":0.1,"path":"b.png"}]}'), ("order", '{"frames":[{"index":1,"time_s":0.0,"path":"a"},{"index":1,"time_s":0.1,"path":"b"}]}'), ("bad", "{"), ("none", '{"frames":[]}'), ("path", '{"frames":[{"index":1,"time_s":0.0,"path":"../a"}]}')], "path string, content string")
    got = {}
    for r in readers.frame_maps(maps).collect():
        got.setdefault(r["path"], []).append(r["problem"])
    assert got == {"ok": [None, None], "order": [None, "order"], "bad": ["malformed"], "none": ["no_frames"], "path": ["unsafe_path"]}


def test_matched_units(spark):
    shape = "page int, at int, text string, x double, y double, h double"
    a = rows(spark, [(1, 0, "Save", 0.0, 0.0, 10.0), (1, 1, "Open", 50.0, 0.0, 10.0), (1, 2, "Quit", 99.0, 0.0, 10.0), (1, 3, "Save", 0.0, 50.0, 10.0), (2, 0, "x", 0.0, 0.0, 4.0)], shape)
    b = rows(spark, [(1, 0, "Save", 0.0, 51.0, 10.0), (1, 1, "Save", 0.0, 9.0, 10.0), (1, 2, "Opens", 52.0, 0.0, 10.0), (1, 3, "New", 300.0, 0.0, 10.0)], shape)
    got = sorted((r["page"], r["kind"], r["before"], r["after"]) for r in text.matched_units(a, b, ["page"]).collect())
    assert got == [(1, "added", None, 3), (1, "changed", 1, 2), (1, "missing", 2, None), (1, "moved", 0, 1), (2, "missing", 0, None)]


def test_units_choose_in_turn(spark):
    """Against choosing one after another, on crowded pages with equal texts and ties."""
    r = random.Random(11)
    shape = "page int, at int, text string, x double, y double, h double"
    side = lambda n: [(p, i, r.choice("abc") * (1 + p % 2), float(r.randrange(12)), float(r.randrange(12)), float(r.choice([2, 9, 20]))) for p in range(4) for i in range(n - 3 * p)]
    a, b = side(25), side(22) + [(1, 90, "a", 500.0, 500.0, 9.0), (3, 91, "q", 900.0, 0.0, 9.0)]
    want = []
    for p in range(4):
        free = {x[1]: x for x in b if x[0] == p}
        far = lambda u, v: math.hypot(u[3] - v[3], u[4] - v[4])
        rest = []
        for u in sorted(x for x in a if x[0] == p):
            best = min((far(u, v), i) for i, v in free.items() if v[2] == u[2]) if any(v[2] == u[2] for v in free.values()) else None
            if best is None:
                rest.append(u)
                continue
            del free[best[1]]
            if best[0] > 4:
                want.append((p, "moved", u[1], best[1]))
        for u in rest:
            best = min(((far(u, v), i) for i, v in free.items()), default=(math.inf, None))
            if best[0] <= max(u[5], 8):
                del free[best[1]]
                want.append((p, "changed", u[1], best[1]))
            else:
                want.append((p, "missing", u[1], None))
        want += [(p, "added", None, i) for i in free]
    got = [tuple(x) for x in text.matched_units(rows(spark, a, shape), rows(spark, b, shape), ["page"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {x[1] for x in want} == {"moved", "changed", "missing", "added"}


def test_pseudomedians_of_draws():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=40), 3)
    times = r.poisson(1, (30, 40))
    want = []
    for t in times:
        v = np.repeat(x, t)
        i, j = np.triu_indices(len(v))
        want.append(np.median(v[i] * 0.5 + v[j] * 0.5))
    assert np.allclose(stats.weighted_pseudomedians(x, times), want, rtol=0, atol=1e-12)
    assert np.allclose([stats._halved(np.sort(x), t[np.argsort(x, kind="stable")], np.array([(n := t.sum()) * (n + 1) // 4 + 1])) for t in times], [[np.sort((v := np.repeat(x, t))[np.triu_indices(len(v))[0]] * 0.5 + v[np.triu_indices(len(v))[1]] * 0.5)[len(v) * (len(v) + 1) // 4]] for t in times], rtol=0, atol=1e-9)
    many = r.normal(size=5000)
    assert abs(stats.weighted_pseudomedians(many, np.ones((1, 5000), int))[0] - np.median(many)) < 0.05


def test_many_passages_and_short_ones(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(40)]
    passages = [(i, docs[i % 40][1][r.randrange(20) : 60 + r.randrange(120)]) for i in range(60)] + [(100, "w1 w2"), (101, "w5"), (102, ""), (103, None)]
    p, d = rows(spark, passages, "item_id long, text string"), rows(spark, docs, "doc_id long, text string")
    want = {i: n for i, t in passages if t and (n := sum(t in x for _, x in docs))}
    for few in (10**6, 3):
        monkeypatch.setattr(text, "FEW", few)
        assert {x["item_id"]: x["docs"] for x in text.containing(p, d).collect()} == want


def test_character_edits_and_error_rates_by_hand(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    df = rows(spark, [("kitten ätz", "sitting atz"), ("a b c", "a c"), ("", "x"), ("same", "same")], "reference string, said string")
    out = text.rates(df.select("*", F.col("reference").alias("r"), F.col("said").alias("s"))).collect()
    for x in out:
        assert x["cer"] == (edits(x["r"], x["s"]) / len(x["r"]) if x["r"] else None)
        assert x["wer"] == (edits(x["r"].split(), x["s"].split()) / len(x["r"].split()) if x["r"] else None)


def test_pixel_components_by_search(spark):
    cells = {(r["x"], r["y"]): r["y"] * 64 + r["x"] for r in evidence.grid(spark, SMALL).where("label = 'N'").collect()}
    want = {}
    for start in sorted(cells, key=cells.get):
        if cells[start] in want:
            continue
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in cells and cells[x, y] not in want:
                want[cells[x, y]] = cells[start]
                todo += [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    assert {r["id"]: r["component"] for r in evidence.pixel_components(spark, SMALL).collect()} == want


def test_hotspots_and_empty_inputs(spark):
    data = [(64 * y + x, x, y, 1.0 if (x, y) in {(1, 1), (2, 2), (9, 9)} else 0.01) for x in range(12) for y in range(12)]
    h = grids.hotspots(rows(spark, data, "id long, x long, y long, err double"), 0.5, 0.1).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["cells"]) for r in h] == [(1, 1, 2, 2, 2), (9, 9, 9, 9, 1)]
    none = rows(spark, [], "judge string, answer string, truth string")
    assert review.canary(none, 0.8).count() == 0
    assert math.isclose(sum(r["share"] for r in h), sum(r["error"] for r in h) / sum(d[3] for d in data))


def test_globs(spark):
    names = ["a.png", "b/a.png", "b/c/a.png", "x1.png", "x9.png", "a{b"]
    df = rows(spark, [(n,) for n in names], "n string")
    from probanda.functions.scalars import glob_pattern

    hits = lambda g: [r[0] for r in df.where(F.col("n").rlike(glob_pattern(g))).collect()]
    assert hits("*.png") == ["a.png", "x1.png", "x9.png"] and hits("b/**") == ["b/a.png", "b/c/a.png"] and hits("{a,x?}.png") == ["a.png", "x1.png", "x9.png"]
    assert hits("x[0-5].png") == ["x1.png"] and hits("x[!0-5].png") == ["x9.png"] and hits("a{b") == ["a{b"]


def test_long_series_and_many_bins(spark):
    """One group of 5,000 values: the spectrum against numpy, the rising fit against pools of plain Python."""
    r = np.random.default_rng(5)
    x = np.cumsum(r.normal(size=5000))
    got = {b["band"]: b["energy"] for b in frames.spectrum(rows(spark, [(0, i, float(v)) for i, v in enumerate(x)] + [(1, i, 1.0) for i in range(3)], "g int, index int, value double"), ["g"]).collect()}
    power = np.abs(np.fft.fft(x - x.mean())[1:2501]) ** 2 / 5000**2
    assert sorted(got) == [0, 1, 2] and [got[k] for k in range(3)] == pytest.approx([power[np.minimum(np.arange(2500) * 3 // 2500, 2) == k].sum() for k in range(3)])

    n, rate = r.integers(1, 9, 5000), np.clip(np.linspace(0, 1, 5000) + r.normal(size=5000) * 0.3, 0, 1)
    fit = {b["bin"]: b["fitted"] for b in stats.isotonic(rows(spark, [(0, i, int(k), float(v)) for i, (k, v) in enumerate(zip(n, rate, strict=True))], "g int, bin int, n int, rate double"), ["g"]).collect()}
    values = [fit[i] for i in range(5000)]
    assert all(a <= b + 1e-12 for a, b in itertools.pairwise(values)) and np.dot(values, n) == pytest.approx(np.dot(rate, n))
    # The best rising fit: residuals of every pool sum to nothing, and no beginning of a pool lies below it.
    for _, pool in itertools.groupby(range(5000), key=lambda i: round(values[i], 12)):
        at = list(pool)
        left = np.cumsum((rate[at] - values[at[0]]) * n[at])
        assert abs(left[-1]) < 1e-6 and left.min() > -1e-6 or left[:-1].min(initial=0) >= -1e-6


def test_many_repeats_in_slices(spark, monkeypatch):
    r = random.Random(2)
    data = [("g", "x", i, r.gauss(10, 1)) for i in range(60)]
    base = [("g", i, r.gauss(9, 1)) for i in range(50)]
    frames_ = rows(spark, base, "g string, ord int, value double"), rows(spark, data, "g string, arm string, ord int, value double")
    whole = stats.arm_summary(*frames_, ["g", "arm"]).first()
    monkeypatch.setattr(stats, "SLICE", 10_000)
    assert tuple(stats.arm_summary(*frames_, ["g", "arm"]).first()) == tuple(whole)


def test_draws_from_the_middle_of_a_stream():
    """A slice of draws goes on where the one before ended, numbers that were passed over too."""
    n = 1_000_003
    at = stats.passed_over(0, n, (1 << 64) - 1)
    assert len(at) == (1 << 64) % n
    seed = (at[0] - 40) * 0x9E3779B97F4A7C15 % (1 << 64)  # a stream whose 40th number is passed over
    whole = stats.split_mix(seed, n, 100)
    assert stats.passed_over(seed, n, 100) == [40]
    assert (stats.split_mix(seed, n, 30, 20) == whole[20:50]).all() and (stats.split_mix(seed, n, 30, 50) == whole[50:80]).all()


def test_grouped_intervals_by_slices(spark, monkeypatch):
    """Groups in chunks and slices of draws give what one draw over the whole group gives; a draw is held at a time."""
    r = random.Random(4)
    shape = "g string, u string, v double"
    data = [(r.choice(["a", "b", None]), r.choice([None, *"pqrstuvwxyz"]) and f"{r.randrange(60):02d}", r.choice([None, r.random()])) for _ in range(900)] + [("c", "only", 2.0), ("d", "x", None)]
    want = {}
    for g in ("a", "b", None, "c"):
        sums = {}
        for k, u, v in data:
            if k == g and v is not None:
                s, m = sums.get(u, (0.0, 0))
                sums[u] = (s + v, m + 1)
        keys = sorted(sums, key=lambda u: (u is None, u or ""))
        s, m = (np.array([sums[u][i] for u in keys], float) for i in (0, 1))
        d = s[at].sum(1) / m[at].sum(1) if len(s) > 1 and len(at := stats.split_mix(7, len(s), 200 * len(s)).reshape(200, len(s))) else None
        want[g] = [len(s), s.sum() / m.sum(), *([np.quantile(d, 0.025), np.quantile(d, 0.975)] if d is not None else [None, None])]
    monkeypatch.setattr(stats, "CHUNK", 7)
    monkeypatch.setattr(stats, "READ", 3000)
    got = {x["g"]: [x["units"], x["mean"], x["low"], x["high"]] for x in stats.grouped_interval(rows(spark, data, shape), ["g"], "u", "v", draws=200).collect()}
    assert got.keys() == want.keys()
    for g, x in want.items():
        assert [v is None for v in got[g]] == [v is None for v in x]
        assert [v for v in got[g] if v is not None] == pytest.approx([v for v in x if v is not None], rel=1e-12)


def test_grouped_means_alone(spark):
    """Units and means without any draw."""
    got = {x["g"]: (x["units"], x["mean"]) for x in stats.grouped_mean(rows(spark, [("a", 1, 1), ("a", 1, 0), ("a", 2, None), ("a", None, 1), ("b", 1, None)], "g string, u int, v int"), ["g"], "u", "v").collect()}
    assert got == {"a": (2, 2 / 3), "b": (1, None)}


def test_pairs_of_all_copies(spark):
    """Copies of a code have every pair that the code has, and those among themselves."""
    r = random.Random(8)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    codes = [r.choice(some) ^ (1 << r.randrange(60)) for _ in range(50)] + some * 3
    near = [(i, j, d) for i, j in itertools.combinations(range(len(codes)), 2) if (d := bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1")) <= 4]
    frame = rows(spark, list(enumerate(codes)), "id long, code long")
    assert sorted(tuple(x) for x in similarity.all_hamming_pairs(frame, 4).select("a", "b", "distance").collect()) == near


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_pairs_by_blocks(spark, monkeypatch, size):
    """Pairs from blocks and tiles of codes are all pairs, however many bits the codes share, and come without a join of the codes."""
    monkeypatch.setattr(similarity, "CODES", size)
    monkeypatch.setattr(similarity, "TILE", (3, 7))
    monkeypatch.setattr(similarity, "PAIRS", 4)
    r = random.Random(size)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(3)]
    codes = [r.choice(some) ^ sum(1 << b for b in r.sample(range(63), 6)) for _ in range(60)] + some * 2
    apart = lambda i, j: bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1")
    near = [(i, j, d) for i, j in itertools.combinations(range(len(codes)), 2) if (d := apart(i, j)) <= 9]
    frame = rows(spark, [*enumerate(codes), (99, None)], "id long, code long")
    assert len(near) > 20 and sorted(map(tuple, similarity.all_hamming_pairs(frame, 9).collect())) == near
    asked = [0, 7, 61, 62]
    got = similarity.hamming_query(frame.where(F.col("id").isin(asked)).withColumnRenamed("id", "query"), frame, 9)
    assert sorted(map(tuple, got.collect())) == [(i, j, apart(i, j)) for i in asked for j in range(len(codes)) if apart(i, j) <= 9]
    plan = similarity.near_codes(frame.where("code is not null"), None, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" in plan
    split = similarity.cross_split(similarity.all_hamming_pairs(frame, 9), frame.select("id", (F.col("id") % 3).alias("split")))
    assert sorted(tuple(x) for x in split.select("a", "b", "distance").collect()) == [x for x in near if x[0] % 3 != x[1] % 3]
    assert split._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_clusters_by_blocks(spark, monkeypatch):
    """Clusters from blocks of codes are those of all pairs, while links stay few."""
    monkeypatch.setattr(similarity, "CODES", 16)
    monkeypatch.setattr(similarity, "ROWS", 5)
    r = random.Random(3)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(9)]
    codes = list({r.choice(some) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for _ in range(120)}) + some
    codes += codes[:7]
    part = list(range(len(codes)))
    for i, j in itertools.combinations(range(len(codes)), 2):
        if part[i] != part[j] and bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1") <= 6:
            low, high = sorted((part[i], part[j]))
            part = [low if p == high else p for p in part]
    frame = rows(spark, list(enumerate(codes)), "id long, code long")
    assert {x["id"]: x["component"] for x in similarity.clusters(frame, 6).collect()} == dict(enumerate(part))
    one = frame.dropDuplicates(["code"])
    n = one.count()
    assert similarity.joining_links(one, 6).count() <= n * -(-n // 16)


def test_kind_by_the_difference_itself(spark, tmp_path):
    """A difference a little below a half rounds to none, though to six places it is a half."""
    from probanda.plans import tabular

    e = [(1, "2024-01-02 00:00:00", 1, "purchase", 0.07), (2, "2024-01-20 00:00:00", 1, "purchase", 0.57), (3, "2024-01-02 01:00:00", 1, "purchase", 0.2), (4, "2024-01-20 01:00:00", 1, "purchase", 0.7), (5, "2024-01-02 02:00:00", 1, "purchase", 5.23), (6, "2024-01-20 02:00:00", 1, "purchase", 5.73)]
    assert 0.57 - 0.07 < 0.5 and 0.7 - 0.2 < 0.5
    rows(spark, e, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(tabular.ORACLES["run_summaries"]).df()
    got = tabular.run_summaries(spark, str(tmp_path)).toPandas()
    assert got[["identical", "changed"]].values.tolist() == want[["identical", "changed"]].values.tolist()


def test_equal_units_list_no_pairs(spark, monkeypatch):
    """Crowded pages of few texts give the same by groups as by rounds over all pairs."""
    r = random.Random(12)
    shape = "page int, at int, text string, x double, y double, h double"
    side = lambda n: [(r.choice([1, 2, None]), i, r.choice(["a", "b", None]), float(r.randrange(9)), float(r.randrange(9)), 9.0) for i in range(n)]
    a, b = rows(spark, side(60), shape), rows(spark, side(50), shape)
    asked = []
    rounds = text.in_turn
    monkeypatch.setattr(text, "in_turn", lambda wishes, page: asked.append(1) or rounds(wishes, page))
    got = sorted((tuple(x) for x in text.matched_units(a, b, ["page"]).collect()), key=str)
    assert len(asked) == 1  # for those that are left only
    monkeypatch.setattr(text, "TOGETHER", 15)
    assert got == sorted((tuple(x) for x in text.matched_units(a, b, ["page"]).collect()), key=str)


def test_ancestors_by_doubled_ways(spark):
    r = random.Random(2)
    up = {str(i): str(r.randrange(i)) if i % 9 else None for i in range(1, 60)} | {"0": "gone", "a": "b", "b": "a", "x": "y"} | {f"l{i}": f"l{i + 1}" for i in range(20)}
    chosen = {"3", "8", "gone", "l17", "never"}
    terms = spark.createDataFrame(list(up.items()), "id string, parent string")
    for depth in (1, 3, 16):
        want = {}
        for start in up:
            at, left = start, depth
            while left and at is not None and at not in chosen:
                at, left = up.get(at), left - 1
            want[start] = at if left and at in chosen else None
        found = perf.selected_ancestors(terms, spark.createDataFrame([(c,) for c in chosen], "id string"), depth)
        assert dict(found.collect()) == want and found.count() == len(up)
        # Steps are tables: no task holds the joins of all of them.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_declared_changes_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 10)
    d = spark.range(200).selectExpr("id as entry", "if(id % 2 = 0, 'structure', 'none') as kind")
    m = spark.range(300).selectExpr("id as entry", "'fail' as status", "4 as hits", "1.0 as stops", "false as identical")
    found = review.intent(d, m)
    assert found.rdd.getNumPartitions() >= 30
    assert dict(found.groupBy("outcome").count().collect()) == {"matched": 100, "missing": 100, "unexpected": 200}


def test_manual_pairs_keep_no_rows_of_a_window(spark):
    r = random.Random(4)
    rows = [(n, r.randrange(40), r.randrange(40)) for n in range(500)]
    pairs = spark.createDataFrame(rows, "ord long, i long, j long")
    left, right = (spark.range(30).selectExpr("id", f"concat('{s}', id)") for s in "lr")
    first, taken = {}, {}
    for n, i, j in rows:
        if i < 30 and j < 30 and i not in first:
            first[i] = j
            taken.setdefault(j, (n, f"l{i}", f"r{j}"))
    found = pairing.manual(pairs, left, right)
    assert {x["j"]: (x["ord"], x["left"], x["right"]) for x in found.collect()} == taken
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
