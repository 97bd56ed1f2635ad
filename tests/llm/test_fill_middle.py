import hashlib
import random
import re

import numpy as np
import pytest

from probanda.llm import fill_middle as m

from .conftest import edge_rows, prose


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(units[x:y]) for x, y in ((0, low), (low, high), (high, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, text, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, text, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, text, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def rows():
    r = random.Random(4)
    found = [(x[0], x[1]) for x in edge_rows()]
    found += [(100 + i, "".join(r.choice("abZ é\U0001f600<>PSM\n1") for _ in range(r.randrange(0, 90)))) for i in range(300)]
    found += [(1000, "<P>" + prose(1, 20)), (1001, "x <M> y"), (1002, "<S" + "<S"), (1003, "a" * 500), (1004, "." * 500), (1005, "<" * 64 + "P" * 64), (1006, "\x00\x00 a\x00")]
    return found + [(2000 + i, "abc " * 40) for i in range(5)] + [(2000, "abc " * 40)] * 3


@pytest.mark.parametrize("chunk", [1, 7, 64, m.CHUNK])
def test_against_units_of_whole_texts(spark, chunk):
    data = rows()
    got = m.rearranged(spark.createDataFrame(data, "doc_id long, text string"), chunk)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted((tuple(x) for x in got.collect()), key=repr)
    assert found == sorted((brute(*x) for x in data), key=repr)
    assert {x[3] for x in found} == {"plain", "psm", "spm"}


def test_outputs_turn_back(spark, edges, nothing):
    data = spark.createDataFrame(rows(), "doc_id long, text string")
    both = m.rearranged(data, 16).select("text", m.restored(m.F.col("output"), m.F.col("form")).alias("back")).collect()
    assert all(x["text"] == x["back"] for x in both)
    assert m.report(edges).count() == edges.count() and m.report(nothing).count() == 0
    assert all(x["output_sha256"] and x["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for x, t in zip(sorted(m.report(edges).where("doc_id = 9").collect()), [prose(1, 20_000)], strict=True))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(m, "SMALL", 0)
    data = rows()
    found = m.rearranged(spark.createDataFrame(data, "doc_id long, text string"), 11).collect()
    assert sorted((tuple(x) for x in found), key=repr) == sorted((brute(*x) for x in data), key=repr)


def test_functions_compose_in_any_grouping():
    r = random.Random(7)
    for _ in range(200):
        text = "".join(r.choice("ab. ") for _ in range(r.randrange(0, 60)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(6)))
        parts = [text[x:y] for x, y in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        f = [tuple(np.array([x], np.int64) for x in m.transitions(p)) for p in parts]
        left, right = f[0], f[-1]
        for x in f[1:]:
            left = m.composed(*left, *x)
        for x in f[-2::-1]:
            right = m.composed(*x, *right)
        states, before = m.entries(np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f]))
        units = len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
        assert left[1][0, 0] == right[1][0, 0] == before[-1] == units and (left[0] == right[0]).all()
        done = ""
        for k, p in enumerate(parts):
            assert before[k] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", done)) and states[k] == bool(re.search(r"[A-Za-z]\Z", done))
            done += p
