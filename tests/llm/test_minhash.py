import random
import re

import numpy as np

from probanda.llm import minhash as m

from .conftest import edge_rows, prose


def brute(rows, width=2, percent=80):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        sets.append((doc_id, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset({tuple(w)}) if w else frozenset())))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (d, s) in enumerate(sets):
        for e, t in sets[:a]:
            both = len(s & t)
            if both and d is not None and e is not None and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def near(seed):
    r = random.Random(seed)
    rows = [(x[0], x[1]) for x in edge_rows()]
    for k in range(6):
        base = [f"w{k}x{r.randrange(500)}" for _ in range(60 + 40 * k)]
        for n in range(25):
            w = list(base)
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = f"new{r.randrange(5)}"
            rows.append((100 * (k + 1) + n, " ".join(w)))
    for k in range(40):  # similarities about the threshold, exactly 0.8 among them
        base = [f"v{k}y{i}" for i in range(46)]
        other = list(base)
        for at in r.sample(range(2, 44, 3), r.choice([2, 2, 2, 3])):
            other[at] = "changed"
        rows += [(5000 + 2 * k, " ".join(base)), (5001 + 2 * k, " ".join(other).upper())]
    base = [f"z{i}" for i in range(10)]  # nine shingles, of which one is lost and one gained: 8 / 10
    return rows + [(7000, " ".join(base)), (7001, " ".join([*base[:-1], "other"]))]


def found(docs, **parameters):
    return sorted((tuple(x) for x in m.near_duplicates(docs, **parameters).collect()), key=repr)


def test_against_all_pairs(spark, nothing, monkeypatch):
    rows = near(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert (7001, 9, 7000, False) in want
    assert found(docs) == want
    monkeypatch.setattr(m, "BLOCK", 3)  # buckets that must be split
    monkeypatch.setattr(m, "FOLLOWERS", 2)
    monkeypatch.setattr(m, "SMALL", 0)  # no broadcasts
    assert found(docs) == want
    assert found(docs, width=3, percent=70) == brute(rows, 3, 70)
    assert m.near_duplicates(nothing).count() == 0


def test_repeated_ids_and_rows(spark):
    texts = [prose(2000 + k, 70) for k in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (9, texts[2]), (8, texts[3]), (8, texts[2]), (8, texts[0] + " x"), (5, texts[4]), (6, None), (6, "")]
    rows += [(7, texts[5])] * 60 + [(7, texts[5] + " more")] * 60 + [(4, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {(d, c) for d, _, c, _ in want} == {(1, 1), (2, 1), (3, 1), (9, 1), (8, 1), (5, 5), (6, 6), (7, 4), (4, 4)}
    assert found(docs) == want


def test_a_bucket_of_many_that_hardly_link(spark, monkeypatch):
    """All share a passage that fills buckets, few link; chunks of a bucket meet once."""
    monkeypatch.setattr(m, "BLOCK", 40)
    r, common = random.Random(3), prose(77, 60)
    rows = [(i, common + " " + " ".join(f"v{r.randrange(9000)}" for _ in range(30))) for i in range(250)]
    rows += [(1000 + i, rows[6 * i][1].replace(" v1", " w1", 1)) for i in range(40)] + [(2000 + i, rows[3][1] + f" u{i}") for i in range(90)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    for share in (0.3, 0.8, 0.95):
        agree = []
        for _ in range(30):
            both, one, two = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            x, y = m.signatures([np.concatenate([both, one]), np.concatenate([both, two])])
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - share) < 0.03
        assert share < 0.8 or min(agree) * m.COORDINATES >= m.least_agreement(80, m.COORDINATES)
    sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 5, 3000, 2)]
    alone = np.concatenate([m.signatures([s]) for s in sets])
    assert (m.signatures(sets) == alone).all()
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(m.scattered(x, m.FACTORS[0], m.FACTORS[1]))) == 1 << 16


def test_one_of_each_group_stays(spark, edges, nothing):
    kept = m.without_copies(edges)
    assert kept.columns == edges.columns and m.without_copies(nothing).count() == 0
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(d) for d, _, _, k in brute([(x[0], x[1]) for x in edge_rows()]) if k)
