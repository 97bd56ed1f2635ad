"""Every query with SQL against DuckDB on the smallest tables; fixtures with known numbers; traps."""

import math
import os

import duckdb
import pandas as pd
import pytest

from probanda.functions import quantiles as Q
from probanda.functions import scalars as S
from probanda.operators import frames, grids, history, intervals, pairing, perf, ranking, similarity, stats, votes
from probanda.plans import catalogue
from probanda.sources import readers, sinks

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[list[str]]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([cell(v) for v in row] for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    assert len(got), "a query without rows shows nothing"
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_paired_effect_fixture(spark):
    before, after = [10.0, 20, 30, 40, 50, 60], [9.0, 22, 32, 43, 54, 65]
    df = spark.createDataFrame([("g", i, float(b), float(a)) for i, (b, a) in enumerate(zip(before, after, strict=True))], "g string, ord int, before double, after double")
    r = stats.paired_bootstrap(df, ["g"]).first()
    assert (r["delta"], r["low"], r["high"]) == (2.5, 0.5, 4.0)
    assert [r["pct"], r["pct_low"], r["pct_high"]] == pytest.approx([7.500000000000001, -1.6384221354699913, 8.995412747509732], rel=1e-9)
    assert stats.paired_bootstrap(df.where("ord < 5"), ["g"]).first()["delta"] is None


def test_onset_of_a_step(spark):
    rows = [("a", float(i), 10.0 + (i % 3) * 0.01 + (5 if i >= 14 else 0), 0.02, 0.1, 1.0) for i in range(24)] + [("b", float(i), 10.0 + (i % 3) * 0.01, 0.02, 0.1, 1.0) for i in range(24)] + [("c", float(i), 1.0, 0.0, 0.0, 0.0) for i in range(6)]
    got = {r["identity"]: r for r in stats.onsets(spark.createDataFrame(rows, "identity string, time double, ms double, repeat_range double, floor double, min_pct double")).collect()}
    assert got["a"]["status"] == "candidate" and got["a"]["first_changed"] == 14 and got["b"]["status"] == "none" and got["c"]["status"] == "insufficient"


def test_quantile_definitions(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    from pyspark.sql import functions as F

    r = df.agg(Q.nearest_rank("v", 0.5).alias("a"), Q.linear(F.col("v"), 0.5).alias("b"), Q.upper_median(F.col("v")).alias("c"), Q.rounded_index(F.col("v"), 0.5).alias("d"), Q.averaging_median(F.col("v")).alias("e")).first()
    assert tuple(r) == (2.0, 2.5, 3.0, 3.0, 2.5)


def test_unknown_is_never_a_pass(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(pairing.gate(F.col("v"), F.lit(1.0))).collect()] == ["pass", "fail", "fail", "fail"]
    t = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None)], "n double, q double, f double")
    assert [r[0] for r in t.select(perf.threshold(F.col("n"), F.col("q"), F.col("f"))).collect()] == [3.0, None, None]
    assert pairing.totals(spark.createDataFrame([], "status string")).first()["regression"]


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 2.0), ("d", 1, None)], "candidate string, image int, value double")
    assert {r["candidate"]: r["place"] for r in ranking.rank_each(df).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}
    assert ranking.overall(df).count() == 0


def test_ambiguous_nearest(spark):
    cues = spark.createDataFrame([("g", 1, "x", 0.0, 1.0), ("g", 2, "x", 3.0, 4.0), ("g", 3, "y", 1.0, 2.0)], "group string, cue int, text string, start double, end double")
    obs = spark.createDataFrame([("g", 1, "x", 2.0), ("g", 2, "x", 0.0), ("g", 3, "x", 1.0), ("g", 4, "y", 9.0)], "group string, obs int, text string, t double")
    got = {r["obs"]: (r["cue"], r["ambiguous"], r["active"]) for r in intervals.assign(cues, obs, 1.5).collect()}
    assert got == {1: (None, True, None), 2: (1, False, True), 3: (1, False, False), 4: (None, False, None)}


def test_history_keeps_the_first_value(spark):
    df = spark.createDataFrame([("e", "c1", 2, 0.9), ("e", "c1", 1, 0.1), ("e", "c2", 3, 0.2), ("e", "c3", 4, 0.6)], "entry string, capture string, seq int, value double").selectExpr("*", "0.5D as threshold")
    r = history.findings(df, ["entry", "threshold"]).first()
    assert (r["n"], r["least"], r["most"], r["finding"]) == (3, 0.1, 0.6, "flaky_threshold")


def test_hamming_join_is_complete(spark):
    import random

    r = random.Random(6)
    codes = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    codes += [c ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for c in codes[:30]] + codes[:3]
    got = {(x["a"], x["b"]) for x in similarity.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "id long, code long"), 6).collect()}
    reps = {}
    for i, c in enumerate(codes):
        reps.setdefault(c, i)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1") <= 6 and (codes[i] == codes[j] and reps[codes[i]] == i or codes[i] != codes[j] and reps[codes[i]] == i and reps[codes[j]] == j)}
    assert got == want


def test_masks(spark):
    t = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 2)], "x int, y int, label int")
    p = spark.createDataFrame([(0, 0, 1), (1, 0, 3), (2, 0, 1)], "x int, y int, label int")
    m = {r["label"]: r for r in grids.mask_metrics(t, p).collect()}
    assert m[1]["iou"] == pytest.approx(1 / 3) and m[2]["status"] == "missed" and m[2]["iou"] == 0 and m[3]["status"] == "spurious"
    s = grids.mask_summary(grids.mask_metrics(t, p)).first()
    assert s["macro"] == pytest.approx(1 / 6)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "run" / "a").mkdir(parents=True)
    (tmp_path / "run" / "a" / "x.PNG").write_bytes(b"1")
    (tmp_path / "run" / "y.txt").write_bytes(b"2")
    (tmp_path / "run" / "z.id.png").write_bytes(b"3")
    assert [r["name"] for r in readers.captures(spark, str(tmp_path / "run"), "r").collect()] == ["a/x.PNG"]
    (tmp_path / "p.json").write_text('{"schema": "perf.v1", "unit": "ms", "frame": {"value": 5.0}, "terms": [{"id": "t", "kind": "pass", "value": 2.0}]}')
    (tmp_path / "q.json").write_text('{"schema": "perf.v1", "frame": {"value": -5.0}, "terms": []}')
    side = readers.perf_sidecars(spark, str(tmp_path / "*.json"))
    assert {r["problem"] for r in side.collect()} == {None, "frame_value"}
    assert readers.perf_terms(side).count() == 1
    srt = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nhello\r\nthere\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,000\r\nx\r\n"
    cues = readers.cues(spark.createDataFrame([("f", srt)], "path string, content string")).collect()
    assert [(c["start"], c["end"], c["text"]) for c in cues] == [(1.5, 2.0, "hello\nthere"), (60.0, 61.0, "x")]
    boxes = readers.yolo(spark.createDataFrame([("i", "0 0.5 0.5 0.2 0.4", 100, 50)], "image string, line string, width int, height int"))
    assert [round(v, 6) for v in boxes.first()[2:]] == [40.0, 15.0, 20.0, 20.0]
    status = sinks.verified_manifest(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string"))
    assert {r["path"]: r["status"] for r in status.collect()} == {"a": "ok", "b": "changed", "c": "missing"}


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.7071067811865475)
    assert pick(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert pick(S.contrast(F.lit(1.0), F.lit(0.0))) == pytest.approx(21)
    assert pick(S.position_label(F.lit(99), F.lit(0), F.lit(100), F.lit(100))) == "top-right"
    assert pick(S.r6(F.lit(float("inf")))) is None and pick(S.over_grey(F.lit(255), F.lit(0))) == 128
    assert pick(S.seconds(F.lit("01:00.250"))) == 60.25


def test_streams(spark, tmp_path):
    from probanda.streaming import streams

    spark.createDataFrame([(1, 5), (2, 6)], "k int, v int").repartition(2).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for _ in range(2):  # a replay adds nothing
        streams.append_once(spark, streams.events_stream(spark, str(tmp_path / "in"), "*.parquet"), ["k"], store)
    assert spark.read.parquet(store).count() == 2
    out = str(tmp_path / "out")
    streams.recompute_touched(spark, streams.events_stream(spark, str(tmp_path / "in"), "*.parquet"), lambda touched: spark.read.parquet(store).join(touched, "k", "left_semi"), "k", lambda h: h.groupBy("k").sum("v"), out)
    assert spark.read.parquet(out).count() == 2
    cases = votes.sensitivity(spark.createDataFrame([("c", "g", "detected", 2.0), ("c", "g", "missed", 1.0)], "class string, gate string, outcome string, magnitude double")).first()
    assert cases["miss_rate"] == 0.5 and frames.onset(spark.createDataFrame([(1, 0, 0.0), (1, 1, 5.0)], "g int, index int, value double"), ["g"], 0, 1.0).first()["onset"] == 1
