"""Token ids in length-delimited binary records, with an offset index beside each file.

A data file is a run of records:
    u64 length | u32 masked checksum of the length | doc_id i64, flags u8, ids | u32 masked checksum of that payload
Ids are little-endian u16 where the vocabulary fits (flag 0), else u32 (flag 1);
flag 2 marks a null doc_id. A checksum is crc32, rotated right by 15 bits plus a constant,
so that checksums of checksums stay apart. The index file holds u64 offsets,
one a record and the end of the file, for shuffled reads.

Files hold ascending ranges of doc_id (null first) of at most FILE_BYTES and one
record and are written under a task's own name, then renamed: a task
that runs again leaves the same files. Null text counts as empty and yields
the end id alone; equal doc_ids stand in the order of their texts' hashes; an empty table writes
no files and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Ragged, by_size, chunked, partitions, plain_parts, shared_path, text_batches, written

MASK = 0xA282EAD8
WIDE, NO_ID = 1, 2
#: Pieces and ids that a worker remembers, then forgets together; characters taken together; words a call.
WORDS, IDS, TOGETHER, LINE = 700_000, 8_000_000, 8_000_000, 500
#: Bytes after which a task begins its next file, and that a reader takes at a time.
FILE_BYTES, READ_BYTES = 256 << 20, 8 << 20


#: The signs that stand for bytes in byte-level vocabularies: printable characters of Latin-1 for themselves, then those from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
LETTERS = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)*")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, flags: int) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, flags | (NO_ID if doc_id is None else 0)) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def records(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids (u32) of each record; a wrong checksum raises."""
    at = 0
    while at < len(data):
        (n,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
        payload = data[at + 12 : at + 12 + n]
        if masked(data[at : at + 8]) != check or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at {at}")
        doc_id, flags = struct.unpack_from("<qB", payload)
        yield None if flags & NO_ID else doc_id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9).astype("<u4")
        at += 16 + n


def record_at(data: bytes, index: bytes, i: int) -> tuple[int | None, np.ndarray]:
    """The i-th record, found through the index."""
    start, end = struct.unpack_from("<QQ", index, 8 * i)
    return next(records(data[start:end]))


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes a text as the runs between white space one by one, and letters apart from marks: by normalisers that keep to this, and a first split that drops white space."""
    steps = lambda x: [y for s in x.get("normalizers") or x.get("pretokenizers") or [x] for y in ([s] if s is x else steps(s))] if x else []
    norms, splits = steps(spec.get("normalizer")), steps(spec.get("pre_tokenizer"))
    fine = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in norms)
    words = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    first = bool(splits) and splits[0]["type"] == "Split" and splits[0]["invert"] and splits[0]["behavior"] == "Removed"
    first = first and all(x.startswith("'") for x in splits[0]["pattern"].get("Regex", "").removesuffix(words).split("|") if x) and splits[0]["pattern"].get("Regex", "").endswith(words)
    rest = len(splits) == 2 and splits[1]["type"] == "ByteLevel" and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
    return bool(fine and first and rest and spec["model"]["type"] == "BPE" and not spec.get("post_processor"))


class Encoder:
    """Ids of whole texts. Where the tokenizer parts texts at white space and letters from marks, every distinct piece is encoded once and remembered; with other tokenizers texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = "<u4" if self.tokenizer.get_vocab_size() > 65536 else "<u2"
        self.parted = parts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.forget()

    def forget(self) -> None:
        self.ids, self.rows = Ragged(self.kind), {"": 0}
        self.ids.add(np.zeros(0, self.kind), np.zeros(1, np.int64))

    def _add(self, pieces: list[str], ids: list[int], sizes: np.ndarray) -> None:
        self.rows.update(zip(pieces, self.ids.add(np.array(ids, self.kind), sizes).tolist(), strict=True))

    def _learn(self, words: list[str], others: list[str]) -> None:
        """Words pass the normalisers as a line, and then go to the model one by one; words that do not stay letters are encoded like other pieces."""
        tokenize = self.tokenizer.model.tokenize
        for at in range(0, len(words), LINE):
            line = words[at : at + LINE]
            plain = self.tokenizer.normalizer.normalize_str(" ".join(line)) if self.tokenizer.normalizer else " ".join(line)
            units = [u if u.isascii() else u.encode().decode("latin-1").translate(BYTE_SIGNS) for u in plain.split(" ")]
            if LETTERS.fullmatch(plain) and len(units) == len(line):
                found = [[t.id for t in tokenize(u)] for u in units]
                self._add(line, [i for x in found for i in x], np.fromiter(map(len, found), np.int64, len(found)))
            else:
                others = others + line
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self._add(others, [i for x in found for i in x], np.array([len(x) for x in found]))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))

    def _group(self, texts: list[str], end_id: int) -> list[bytes]:
        if self.ids.n > WORDS or self.ids.used > IDS:
            self.forget()
        # Other white space than line ends and spaces stays in its chunk, for the tokenizer to part.
        codes, chunks, counts = chunked(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "))
        plain, words, tails = plain_parts(chunks)
        words, tails = words.dictionary_encode(), tails.dictionary_encode()
        word, tail, other = (x.to_numpy(zero_copy_only=False).tolist() for x in (words.dictionary, tails.dictionary, chunks.filter(pa.array(~plain))))
        known = self.rows
        self._learn([w for w in word if w not in known], list(dict.fromkeys(x for x in tail + other if x not in known)))
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[plain], second[plain] = self._rows(word)[words.indices], self._rows(tail)[tails.indices]
        first[~plain] = self._rows(other)
        flat, sizes = self.ids.take(np.stack([first, second], 1).ravel())
        # The chunks' ids, and the end of a document as one more chunk.
        own = Ragged(self.kind)
        own.add(np.append(flat, np.array(end_id, self.kind)), np.append(sizes.reshape(-1, 2).sum(1), 1))
        ids, sizes = own.take(np.insert(codes.astype(np.int64), np.cumsum(counts), len(chunks)))
        ends = np.cumsum(sizes)[np.cumsum(counts + 1) - 1].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, texts: list[str], end_id: int) -> Iterator[bytes]:
        """Ids of each text with the end id, as bytes."""
        for group in by_size(texts, TOGETHER):
            if self.parted:
                yield from self._group(group, end_id)
            else:
                for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False):
                    yield np.array([*e.ids, end_id], self.kind).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Files of one task, in order; a file that reaches file_bytes is closed and the next one begun."""
        files, base = _filesystem(folder)
        encode, found, offsets, at, n_tokens, stream, name = encoder(tokenizer), [], [], 0, 0, None, ""
        width = np.dtype(encode.kind).itemsize
        flags = WIDE if width == 4 else 0

        def close(task: int) -> None:
            stream.close()
            with files.open_output_stream(f"{name}.index") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            path = f"{base}/{task:06d}-{len(found):06d}"
            for kind in ("index", "data"):
                files.move(f"{name}.{kind}", f"{path}.{kind}")
            found.append((task, len(found), len(offsets), n_tokens, f"{path}.data"))

        for batch in batches:
            task = int(batch["_task"].iloc[0]) if len(batch) else 0
            for doc_id, ids in zip(batch["doc_id"], encode(batch["text"].tolist(), end_id), strict=True):
                if stream is None:
                    name = f"{base}/_attempt-{uuid.uuid4().hex}"
                    stream, offsets, at, n_tokens = files.open_output_stream(f"{name}.data"), [], 0, 0
                record = frame(None if pd.isna(doc_id) else int(doc_id), ids, flags)
                stream.write(record)
                offsets.append(at)
                at += len(record)
                n_tokens += len(ids) // width
                if at >= file_bytes:
                    close(task)
                    stream = None
        if stream is not None:
            close(task)
        if found:
            yield pd.DataFrame(found, columns=["part", "nth", "n_docs", "n_tokens", "path"])

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns part, nth, n_docs, n_tokens, path, one row a file; part and then nth ascend with doc_id."""
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or shared_path(spark, "tokens")
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one doc_id part by their texts, rows alike in both by their place in the input: no id has to fit a task.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    dealt = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(2 * partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("_task"), F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, ids pass through pandas unharmed beside nulls
    return written(dealt.mapInPandas(_writer(folder, tokenizer, end_id, file_bytes), "part int, nth int, n_docs long, n_tokens long, path string"), "token-index")


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of whole records of about READ_BYTES, found through the index file."""
        files, _ = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with files.open_input_stream(path.removesuffix(".data") + ".index") as stream:
                    offsets = np.frombuffer(stream.read(), "<u8").astype(np.int64)
                first, at = 0, int(start)
                with files.open_input_file(path) as stream:
                    while first < len(offsets) - 1:
                        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_BYTES, side="right")) - 1)
                        stream.seek(int(offsets[first]))
                        data, out = stream.read(int(offsets[last] - offsets[first])), []
                        for doc_id, ids in records(data):
                            out.append((None if doc_id is None else str(doc_id), at, len(ids), zlib.crc32(ids.tobytes())))
                            at += len(ids)
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    return read


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record. One row of the index stands for a whole file, so that the running sum is over few rows."""
    start = F.sum("n_tokens").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    dealt = index.withColumn("start", start).repartition(partitions(index.sparkSession), "path")
    found = dealt.mapInPandas(_reader(folder), "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder), folder)
