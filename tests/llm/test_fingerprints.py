import hashlib
import random

from probanda.llm import fingerprints as f

from .conftest import edge_rows


def test_prefix_arrays_answer_spans_and_extensions():
    r = random.Random(4)
    a = "".join(r.choice("ab") for _ in range(200))
    b = a[50:150] + "".join(r.choice("ab") for _ in range(100))
    pa, pb = ([f.prefix_array(f.code_points(t), w) for w in (0, 1)] for t in (a, b))
    for _ in range(300):
        i, j = r.randrange(200), r.randrange(200)
        n = r.randrange(0, 200 - max(i, j))
        assert (a[i : i + n] == b[j : j + n]) == all(f.span_hash(pa[w], i, i + n, w) == f.span_hash(pb[w], j, j + n, w) for w in (0, 1))
        k = 0
        while i + k < 200 and j + k < 200 and a[i + k] == b[j + k]:
            k += 1
        assert f.common_extension(pa, i, pb, j) == k


def test_likeness():
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    assert f.likeness(f.fingerprint(base), f.fingerprint(base)) == 1
    assert f.fingerprint(base) != f.fingerprint(base + " ")
    assert f.likeness(f.fingerprint(base), f.fingerprint("x" + base)) > 0.8
    assert f.likeness(f.fingerprint(base), f.fingerprint("".join(chr(97 + i * i % 23) for i in range(3000)))) < 0.1
    assert f.likeness(f.fingerprint(""), f.fingerprint("")) == 1 and f.likeness(f.fingerprint(""), f.fingerprint("a")) == 0


def test_edited_against_brute_force(spark, edges, nothing):
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, [-ord(c) for c in r[1][:200]]), reverse=True)
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None]
    want = []
    for i, (doc_id, text) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), f.fingerprint(text).hex(), f.fingerprint(changed).hex()))
    got = [tuple(r)[:5] for r in f.edited_fingerprints(edges).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert f.edited_fingerprints(nothing).count() == 0
    one = f.edited_fingerprints(edges.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
