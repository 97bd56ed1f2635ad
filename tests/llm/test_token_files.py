import json
import struct
import zlib

import numpy as np
import pytest
import xxhash

from probanda.llm import token_files as t
from probanda.llm.common import shared_path
from probanda.llm.queries import tokenizer_path

from .conftest import edge_rows, prose

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["", " ", "Don't STOP, it's 9 o'clock!", "éa x́, y", "ΣΑΣ <|endoftext|>b", "²x Ⅷ İstanbul", "a b\tc\x1cd ́", "日本語、テスト", "x≠ y≯", "z" * 500, prose(9, 300)]


def test_chunks_encode_as_whole_texts():
    e = t.Encoder(PATH)
    for text, ids in zip(TEXTS, e(TEXTS, 2), strict=True):
        assert np.frombuffer(ids, e.kind).tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_many_pieces_and_forgetting():
    e, texts = t.Encoder(PATH), [prose(i, 200) + f" {i}:Wört{i % 7}er!\n" for i in range(60)]
    want = [[*e.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    for n in (10, 10**6):
        t.WORDS, before = n, t.WORDS
        try:
            for at in range(0, 60, 20):
                assert [np.frombuffer(x, e.kind).tolist() for x in e(texts[at : at + 20], 2)] == want[at : at + 20]
        finally:
            t.WORDS = before


@pytest.mark.parametrize("change", ["no lower case", "other normaliser", "other split", "byte_bpe_50k.json"])
def test_other_tokenizers(tmp_path, change):
    path = tokenizer_path(change) if change.endswith("json") else str(tmp_path / "t.json")
    if not change.endswith("json"):
        spec = json.load(open(PATH, encoding="utf-8"))
        if change == "no lower case":
            spec["normalizer"]["normalizers"].pop()
        elif change == "other normaliser":
            spec["normalizer"] = {"type": "Replace", "pattern": {"String": "a "}, "content": "b"}
        else:
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\S+ ?\S*"}
        json.dump(spec, open(path, "w", encoding="utf-8"))
    e = t.Encoder(path)
    assert e.parted == (change == "no lower case")
    for text, ids in zip(TEXTS, e(TEXTS, 2), strict=True):
        assert np.frombuffer(ids, e.kind).tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_small_files_and_repeated_ids(spark):
    e, rows = t.Encoder(PATH), [(i // 40 if i % 3 else None, prose(i % 25, 30), i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    folder = shared_path(spark, "small")
    index = t.write_token_files(docs, PATH, folder=folder, file_bytes=300)
    assert index.count() > 20
    got = sorted(map(tuple, t.read_token_files(index, folder).collect()), key=lambda r: r[1])
    want = [(i, zlib.crc32(np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, text, _ in rows]
    assert sorted(((r[0], r[3]) for r in got), key=str) == sorted(want, key=str)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    assert [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)


def test_records_index_and_damage():
    data, offsets = b"", [0]
    for i, flags, kind in ((5, 0, "<u2"), (None, 0, "<u2"), (7, t.WIDE, "<u4")):
        data += t.frame(i, np.array([1, 2, 300 + len(data)], kind).tobytes(), flags)
        offsets.append(len(data))
    index = struct.pack(f"<{len(offsets)}Q", *offsets)
    assert [d for d, _ in t.records(data)] == [5, None, 7]
    assert t.record_at(data, index, 2)[0] == 7 and t.record_at(data, index, 0)[1].tolist() == [1, 2, 300]
    for at in (3, 9, 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(t.records(bytes(bad)))


def test_files_against_the_library(spark, edges, nothing):
    e = t.Encoder(PATH)
    placed = lambda text: np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, placed(r[1])))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in t.token_files(edges, PATH).collect()), key=lambda r: r[1])
    assert got == want
    assert t.token_files(nothing, PATH).count() == 0


def test_index_files(spark, edges):
    folder = shared_path(spark, "files")
    index = t.write_token_files(edges, PATH, folder=folder).collect()
    files, _ = t._filesystem(folder)
    for r in index:
        data, offsets = (files.open_input_stream(p).read() for p in (r["path"], r["path"].replace(".data", ".index")))
        assert len(offsets) == 8 * (r["n_docs"] + 1) and struct.unpack("<Q", offsets[-8:])[0] == len(data)
        assert sum(1 for _ in t.records(data)) == r["n_docs"]
