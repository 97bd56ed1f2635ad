import hashlib

import numpy as np
import sentencepiece

from probanda.llm import segmentation as s
from probanda.llm.queries import tokenizer_path

from .conftest import prose

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " x", "  two  spaces ", "a▁b ▁▁ c", "▁", "日本語 テスト", "\U0001f600 \U0001f600\U0001f600", "tab\tline\nend", "w" * 300, prose(3, 500), "Èonai aiaiai, rétion"]


def test_without_dropout_as_the_library():
    plain, library = s.Segmenter(PATH, 0.0), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(TEXTS, plain.encode_many(TEXTS, [0] * len(TEXTS)), strict=True):
        if s.SPACE not in text:
            assert ids.tolist() == library.encode(text), text
        assert plain.decode(ids).decode() == text


def test_dropout_varies_and_decodes():
    g = s.Segmenter(PATH, 0.3)
    a, b = (list(g.encode_many(TEXTS, [v] * len(TEXTS))) for v in (0, 1))
    assert any(x.tolist() != y.tolist() for x, y in zip(a, b, strict=True))
    for text, *both in zip(TEXTS, a, b, strict=True):
        assert all(g.decode(ids).decode() == text for ids in both)
    again = s.Segmenter(PATH, 0.3)
    assert all(x.tolist() == y.tolist() for x, y in zip(a, again.encode_many(TEXTS, [0] * len(TEXTS)), strict=True))
    words = sorted({w for t in TEXTS for w in g._stretches(t) if w})
    words = [w for w in words if len(w) <= s.WIDTHS[-1]] * 40
    g._learn(words)
    keys = np.arange(len(words), dtype=np.uint64) * np.uint64(s.K3)
    for _ in range(2):  # branches new, then known
        flat, sizes = g.pieces.take(g._followed(g._root(words), keys))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [g.merge(w, int(k)) for w, k in zip(words, keys, strict=True)]


def test_forgetting_changes_nothing(monkeypatch):
    texts, keys = [prose(i, 40) + " Straßen-Bahn (x) " + "q" * 30 for i in range(30)], list(range(30))
    want = [x.tolist() for x in s.Segmenter(PATH, 0.2).encode_many(texts, keys)]
    monkeypatch.setattr(s, "REMEMBERED", 50)
    monkeypatch.setattr(s, "TOGETHER", 700)
    assert [x.tolist() for x in s.Segmenter(PATH, 0.2).encode_many(texts, keys)] == want


def test_table(edges, nothing):
    rows = s.round_trips(edges, PATH).collect()
    text = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    assert len(rows) == 15 and all(r["lossless"] for r in rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in rows)
    assert s.round_trips(nothing, PATH).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in s.segmented(edges, PATH).collect()}
    assert ids[0] == [] and len(ids[9]) > 10_000


def test_each_occurrence_and_copy_is_parted_on_its_own(spark):
    g = s.Segmenter(PATH, 0.3)
    texts, docs = ["segmentation " * 40] * 10, [g.variant(i) for i in range(10)]
    ways = {tuple(g.merge(x, int(k))) for t, d in zip(texts, docs, strict=True) for x, k in zip(g._stretches(t)[1:40], g.places(d, 40)[1:40], strict=True)}
    assert len(ways) > 10
    for text, d, ids in zip([*TEXTS, *texts], [g.variant(9)] * len(TEXTS) + docs, g.encode_many([*TEXTS, *texts], [g.variant(9)] * len(TEXTS) + docs), strict=True):
        parts = g._stretches(text)
        want = [g.sign.tolist() if x is None else g.merge(x, int(k)) for x, k in zip(parts, g.places(d, len(parts)), strict=True)]
        assert ids.tolist() == sum(want, []) and g.decode(ids).decode() == text
    rows = spark.createDataFrame([(1, prose(3, 200))] * 3, "doc_id long, text string")
    first, again = (sorted(r["ids"] for r in s.segmented(rows, PATH).collect()) for _ in range(2))
    assert first == again and len({tuple(x) for x in first}) == 3
