import hashlib
import math
import re
import zlib
from collections import Counter

from probanda.llm import resampling as s

from .conftest import edge_rows, prose


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, width):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, width=1, buckets=10_000, percent=10, least=20):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    c, t = (Counter(of(f) for x in texts for f in features(x, width)) for texts in ([x[1] for x in docs], target))
    n, k = sum(c.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((c[b] + 1) * (k + buckets)))) for b in c}
    out = []
    for i, text in docs:
        f = features(text, width)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(x)] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    eligible = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0]))
    for rank, x in enumerate(eligible[: percent * len(eligible) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def corpus():
    rows = [(x[0], x[1]) for x in edge_rows()] + [(100 + i, prose(i, 15 + i % 30)) for i in range(150)]
    rows += [(500, "ÄÖ naïve café " * 8), (501, "Zahl 12_3 a-b'c " * 9), (500, "another text under one id " * 5)]
    return rows + [(None, None), (502, "x " * 25), (502, "x " * 25), (502, "x " * 25)]


def test_against_counters(spark):
    docs, target = corpus(), [prose(1000 + i, 40) for i in range(9)] + [None, "", "café"]
    frame, goal = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert sorted((tuple(x) for x in s.resampled(frame, goal).collect()), key=repr) == brute(docs, target)
    got = s.resampled(frame, goal, width=3, buckets=64, percent=37, least_words=5).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(docs, target, 3, 64, 37, 5)
    assert [f.dataType.simpleString() for f in s.resampled(frame, goal).schema] == ["bigint"] * 5
    ids = {x["doc_id"] for x in s.resampled(frame, goal).where("rank is not null").collect()}
    drawn = s.drawn_documents(frame, goal)
    assert drawn.columns == frame.columns and {x["doc_id"] for x in drawn.collect()} == ids


def test_edges_and_empty_tables(spark, edges, nothing):
    docs = [(x[0], x[1]) for x in edge_rows()]
    goal = spark.createDataFrame([], "text string")
    assert sorted((tuple(x) for x in s.resampled(edges, goal).collect()), key=repr) == brute(docs, [])
    assert s.resampled(nothing, goal).count() == 0 and s.resampled(nothing, edges).count() == 0


def test_no_user_functions(spark, edges):
    plan = s.weighted(edges, edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
