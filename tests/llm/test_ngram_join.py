import random
import re

import numpy as np

from probanda.llm import ngram_join as j
from probanda.operators.components import components

from .conftest import edge_rows, prose


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset({tuple(w)}) if w else frozenset())))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (d, s) in enumerate(sets):
        for e, t in sets[:a]:
            both = len(s & t)
            if s and t and d is not None and e is not None and 100 * both >= 85 * (len(s) + len(t) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def near(seed):
    r = random.Random(seed)
    rows = [(r_[0], r_[1]) for r_ in edge_rows()]
    for k in range(6):
        base = prose(1000 + k, 60 + 30 * k).split()
        for n in range(25):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.randrange(5)}"
            rows.append((100 * (k + 1) + n, " ".join(w)))
    return rows


def test_against_all_pairs(spark, edges, nothing, monkeypatch):
    rows = near(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(j, "BLOCK", 5)  # blocks that must be split
    monkeypatch.setattr(j, "FREQUENT", 2)
    monkeypatch.setattr(j, "SMALL", 0)  # no broadcasts
    assert sorted((tuple(r) for r in j.near_copies(docs).collect()), key=str) == want
    assert j.near_copies(nothing).count() == 0


def test_tree_finds_all_pairs_within_the_bound():
    r = np.random.default_rng(3)
    points = r.integers(0, 6, (300, j.GROUPS)).astype(np.int32)
    points[150:] = np.maximum(points[:150] + r.integers(-1, 2, (150, j.GROUPS)) * (r.random((150, j.GROUPS)) < 0.1), 0)
    n, comp = points.sum(1).astype(np.int64), r.integers(0, 200, 300)
    got = {tuple(sorted(x)) for x in zip(*(v.tolist() for v in j.RTree(points, n, [comp]).pairs()), strict=True)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and np.minimum(points[a], points[b]).sum() >= -(-85 * (n[a] + n[b]) // 185)}
    assert got == want and want
    side = r.integers(0, 2, 300)
    got = {tuple(sorted(x)) for x in zip(*(v.tolist() for v in j.RTree(points, n, [comp, side]).pairs()), strict=True)}
    assert got == {(a, b) for a, b in want if side[a] != side[b]} and got


def test_repeated_ids_and_rows(spark, monkeypatch):
    texts = [prose(2000 + k, 70) for k in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (9, texts[2]), (8, texts[3]), (8, texts[2]), (8, texts[0] + " x"), (5, texts[4]), (6, None), (6, "")]
    rows += [(7, texts[5])] * 150 + [(7, texts[5] + " more")] * 150 + [(4, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {(d, c) for d, _, c in want} == {(1, 1), (2, 1), (3, 1), (9, 1), (8, 1), (5, 5), (6, 6), (7, 4), (4, 4)}
    assert sorted((tuple(r) for r in j.near_copies(docs).collect()), key=str) == want


def test_a_block_of_many_that_hardly_link(spark, monkeypatch):
    """All share a passage that opens a block, few link; chunks of the block meet once."""
    monkeypatch.setattr(j, "BLOCK", 40)
    monkeypatch.setattr(j, "FREQUENT", 1 << 40)
    r, common = random.Random(3), prose(77, 40)
    rows = [(i, common + " " + " ".join(f"v{r.randrange(900)}" for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, rows[7 * i][1].replace(" v1", " w1", 1)) for i in range(40)] + [(2000 + i, rows[3][1] + f" u{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in j.near_copies(docs).collect()), key=str) == brute(rows)


def test_fine_points_never_exclude_a_link():
    r = np.random.default_rng(8)
    sets = []
    for size in (20, 300, 500, 540, 900, 1100, 4000, 9000, 30_000, 33_000):
        base = r.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(size * 0.95)], r.integers(0, 1 << 63, size // 20).astype(np.uint64)]))]
    import pandas as pd

    points = j.Points(pd.Series([j.group_counts(s) for s in sets]))
    i, k = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    n = np.array([len(s) for s in sets])
    ok = j.bounded(points, i, n[i], points, k, n[k])
    for a, b, allowed in zip(i, k, ok, strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert allowed or 100 * both < 85 * (n[a] + n[b] - both)
    assert ok.sum() < 4 * len(sets)


def test_stages_keep_one(edges, nothing):
    kept = j.one_of_each(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [None, 0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12]))
    assert j.one_of_each(nothing).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}


def test_other_widths_and_limits_against_all_pairs(spark):
    import corpus_pipeline

    rows = near(4)
    r = random.Random(9)
    for k in range(12):  # similarity of five-word shingles between 0.80 and 0.85
        base = [f"w{k}x{i}" for i in range(104)]
        other = list(base)
        other[r.randrange(8, 45)], other[r.randrange(55, 95)] = "new", "newer"
        rows += [(9000 + 2 * k, " ".join(base)), (9001 + 2 * k, " ".join(other))]

    def shingles(text):
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(d, shingles(x)) for d, x in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (d, s) in enumerate(sets):
        for e, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in j.near_copies(docs, 5, 80).where("doc_id is not null").collect()]
    assert sorted(got) == sorted((d, len(s), find(d)) for d, s in sets)
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept - {None} == {d for d, _ in sets if find(d) == d}
    assert all(9001 + 2 * k not in kept for k in range(12))
