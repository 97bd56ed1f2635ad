import subprocess
import sys

import numpy as np
import pytest

from probanda.llm import segmentation as s
from probanda.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")

#: A worker that goes from the join of near copies to segmentation; MB that it holds besides the model after each.
WORKER = """
import re, sys
from probanda.llm import ngram_join, segmentation
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
s = segmentation.segmenter(sys.argv[1], 0.1, 11)
first = held()
names = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(450_000)]
texts = [" ".join(names[i : i + 450]) for i in range(0, len(names), 450)]
small = [" ".join(names[j % 5000] for j in range(i, i + 450)) for i in range(0, len(names), 450)]
before = held()
n = sum(len(x) for x in getattr(ngram_join, "shingle_sets", lambda t, w: [ngram_join.shingle_set(x, w) for x in t])(texts, 5))
assert n == 446 * 1000
print(held() - before)
assert sum(1 for _ in s.encode_many(small, list(range(1000)))) == 1000
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_gives_back_what_stages_took():
    out = subprocess.run([sys.executable, "-c", WORKER, PATH], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    join, both = map(float, out)
    print("held", join, both)
    assert join < 40 and both < 100


def test_hashing_by_slices_changes_nothing(monkeypatch):
    texts = ["segmentation of wording " * 30] * 8
    want = [x.tolist() for x in s.Segmenter(PATH, 0.3).encode_many(texts, list(range(8)))]
    monkeypatch.setattr(s, "HASHED", 7)
    got = [x.tolist() for x in s.Segmenter(PATH, 0.3).encode_many(texts, list(range(8)))]
    assert got == want and len({tuple(x) for x in got}) == 8
    g = s.Segmenter(PATH, 0.3)
    g._learn(["▁segmentation"])
    flat, sizes = g.pieces.take(g._followed(g._root(["▁segmentation"] * 50), keys := np.arange(50, dtype=np.uint64) * np.uint64(s.K3)))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [g.merge("▁segmentation", int(k)) for k in keys]
