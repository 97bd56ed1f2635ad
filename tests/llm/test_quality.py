import re
from collections import Counter

from probanda.llm import quality as q

from .conftest import edge_rows, prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts(spark, edges, nothing):
    more = [(100 + i, " ".join(["a b c"] * i + ["x y z"] * (i % 3) + [prose(i, 40)])) for i in range(1, 60)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in edge_rows()] + more + [(999, " ".join(f"{i % 977} {i % 983}" for i in range(9000)))], "doc_id long, text string")
    got = sorted((tuple(r)[:7] for r in q.quality_report(docs).collect()), key=str)
    want = sorted(((d, *brute(t)) for d, t in ((r["doc_id"], r["text"]) for r in docs.collect())), key=str)
    assert got == want
    assert q.quality_report(nothing).count() == 0


def test_keeping(edges, nothing):
    kept = q.kept_documents(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 2 and 0 not in ids and 11 not in ids and 9 in ids
    assert q.kept_documents(nothing).count() == 0


def test_no_python_and_no_shuffle(edges):
    plan = q.quality_report(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
