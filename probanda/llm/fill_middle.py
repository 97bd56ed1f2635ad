"""Fill-in-the-middle: a document cut at two units, its parts marked and set in another order.

A unit is a run of ASCII letters or one other code point, so an automaton of two states
(outside and inside a run) counts units: one begins at every other code
point, and at a letter read outside. A text is scanned in chunks of CHUNK code points, each
without regard to what precedes it: a chunk gives, for either state that it may be
entered in, the state that it is left in and the units that begin in it. These functions
compose associatively, and composing those of the chunks before yields each
chunk's entry state and the units before it; then one chunk tells where a unit begins.

A text of one chunk is scanned where it lies, a batch at a time. The chunks of longer texts are dealt over all
tasks; their functions, a few numbers a chunk, meet by text (a text has at most 2 GiB, so
at most 32,768 chunks) and are composed in logarithmically many array steps. The
cuts are then looked up in the chunks that hold them.

Form and cuts follow from sha256 of the seed and the doc_id. A null text is empty and a null doc_id counts as
an empty id; a text that is empty or has a marker in it stays as it is ("plain"), so that
every output can be turned back. Repeated rows are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, partitions, text_batches, written

CHUNK, SEED, PLAIN_FROM, SUFFIX_FIRST = 65_536, 1, 90, 20
#: The markers, fixed by the output's form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Chunks (16 bytes each) up to this many are broadcast with their texts' digests; more are joined by shuffle.
SMALL = 2_000_000
#: Code points that are scanned together.
TOGETHER = 4_000_000
#: Units, and code points up to either cut.
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in "nab"])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def is_letter(codes: np.ndarray) -> np.ndarray:
    return ((codes | 32) - np.uint32(97)) < 26


def begins(letter: np.ndarray, inside: bool) -> np.ndarray:
    """Where units begin, entered inside a run of letters or outside."""
    before = np.concatenate([[inside], letter[:-1]])
    return ~(letter & before) if len(letter) else letter


def transitions(text: str) -> tuple[list[int], list[int]]:
    """For the entry states outside and inside: the state after the chunk, and how many units begin in it."""
    letter = is_letter(code_points(text))
    if not len(letter):
        return [0, 1], [0, 0]
    n = int(begins(letter, False).sum())
    return [int(letter[-1])] * 2, [n, n - int(letter[0])]


def composed(ends: np.ndarray, counts: np.ndarray, later_ends: np.ndarray, later_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First the one function, then the later one, for each pair of rows."""
    return np.take_along_axis(later_ends, ends, 1), counts + np.take_along_axis(later_counts, ends, 1)


def entries(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk in order, the state it is entered in and the units before it; one row more for the end of the text."""
    f, c = (np.concatenate([first, rows]).astype(np.int64) for first, rows in (([[0, 1]], ends.reshape(-1, 2)), ([[0, 0]], counts.reshape(-1, 2))))
    step = 1
    while step < len(f):
        later = composed(f[:-step], c[:-step], f[step:], c[step:])
        f, c = np.concatenate([f[:step], later[0]]), np.concatenate([c[:step], later[1]])
        step *= 2
    return f[:, 0], c[:, 0]


def place_of(text: str, units: int, befores: np.ndarray, states: np.ndarray, chunk: int) -> int:
    """How many code points the first `units` units of the text have. befores, states: those of its chunks and of its end."""
    if units >= befores[-1]:
        return len(text)
    i = int(np.searchsorted(befores, units, "right")) - 1
    piece = is_letter(code_points(text[i * chunk : (i + 1) * chunk]))
    return i * chunk + int(np.flatnonzero(begins(piece, bool(states[i])))[units - int(befores[i])])


def short_cuts(texts: list[str], one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of one chunk: its units, and the code points up to the two cuts in order."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(size) - size
    letter = is_letter(code_points("".join(texts)))
    start = begins(letter, False)
    start[at[size > 0]] = True
    place = np.flatnonzero(start)
    first = np.searchsorted(place, at)
    n = np.searchsorted(place, at + size) - first
    low, high = one % (n + 1), two % (n + 1)
    place = np.append(place, 0)
    cut = lambda k: np.where(k < n, place[np.where(k < n, first + k, 0)] - at, size)
    return n, cut(np.minimum(low, high)), cut(np.maximum(low, high))


@F.pandas_udf(CUTS)
def _short(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    out, done = [np.zeros((0, 3), np.int64)], 0
    one, two = one.to_numpy(np.int64), two.to_numpy(np.int64)
    for group in by_size(texts.tolist(), TOGETHER):
        out.append(np.column_stack(short_cuts(group, one[done : done + len(group)], two[done : done + len(group)])))
        done += len(group)
    return pd.DataFrame(np.concatenate(out), columns=["n", "a", "b"])


def _pieces(chunk: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                at = range(0, len(text), chunk)
                for low in range(0, len(at), 64):
                    part = at[low : low + 64]
                    yield pd.DataFrame({"digest": digest, "chunk": np.arange(low, low + len(part), dtype=np.int32), "piece": [text[i : i + chunk] for i in part]})

    return pieces


@F.pandas_udf(T.StructType([T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]))
def _transitions(pieces: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([transitions(p) for p in pieces], columns=["ends", "counts"])


@F.pandas_udf(T.StructType([T.StructField("befores", T.ArrayType(T.LongType())), T.StructField("states", T.ArrayType(T.IntegerType()))]))
def _entries(chunks: pd.Series) -> pd.DataFrame:
    out = []
    for rows in chunks:
        states, befores = entries(np.array([list(r["ends"]) for r in rows]), np.array([list(r["counts"]) for r in rows]))
        out.append((befores, states))
    return pd.DataFrame(out, columns=["befores", "states"])


def long_texts(rows: DataFrame, chunk: int) -> DataFrame:
    """digest, befores, states of every text in the rows (digest, text)."""
    spark = rows.sparkSession
    pieces = rows.mapInPandas(_pieces(chunk), "digest string, chunk int, piece string").repartition(partitions(spark))
    each = pieces.select("digest", "chunk", _transitions("piece").alias("f")).groupBy("digest", "chunk").agg(F.first("f").alias("f"))
    by_text = each.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("chunk", "f.ends", "f.counts"))).alias("chunks"))
    return written(by_text.select("digest", _entries("chunks").alias("e")).select("digest", "e.*"), "entries")


def cut_documents(docs: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, text, h3, h4, n (units), a and b (code points up to the two cuts) of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digits.alias("_d"))
    rows = rows.select("doc_id", "text", *[F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    short = rows.where(F.char_length("text") <= chunk).withColumn("c", _short("text", "h1", "h2"))
    large = rows.where(F.char_length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    known = long_texts(large.select("digest", "text"), chunk)
    chunks = known.agg(F.coalesce(F.sum(F.size("befores")), F.lit(0))).first()[0]

    @F.pandas_udf(CUTS)
    def cut(texts: pd.Series, one: pd.Series, two: pd.Series, befores: pd.Series, states: pd.Series) -> pd.DataFrame:
        out = []
        for text, x, y, before, state in zip(texts, one, two, befores, states, strict=True):
            n = int(before[-1])
            low, high = sorted((x % (n + 1), y % (n + 1)))
            out.append((n, place_of(text, low, before, state, chunk), place_of(text, high, before, state, chunk)))
        return pd.DataFrame(out, columns=["n", "a", "b"])

    large = large.join(F.broadcast(known) if chunks <= SMALL else known, "digest").withColumn("c", cut("text", "h1", "h2", "befores", "states"))
    both = [x.select("doc_id", "text", "h3", "h4", "c.n", "c.a", "c.b") for x in (short, large)]
    return both[0].union(both[1])


def rearranged(docs: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output of every row."""
    rows = cut_documents(docs, chunk, seed)
    text, marked = F.col("text"), F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (text == "") | marked | (F.col("h3") % 100 >= PLAIN_FROM)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    prefix, middle, suffix = (F.expr(f"substring(text, {x})") for x in ("1, int(a)", "int(a) + 1, int(b - a)", "int(b) + 1"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that the output was made of."""
    last = F.locate(MIDDLE, output)
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    first_part = F.substring(output, F.lit(len(PREFIX) + 1), second - (len(PREFIX) + 1))
    second_part = F.substring(output, second + len(SUFFIX), last - second - len(SUFFIX))
    middle = F.substring(output, last + len(MIDDLE), F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first_part, middle, second_part)).otherwise(F.concat(second_part, middle, first_part))


def report(docs: DataFrame) -> DataFrame:
    rows = rearranged(docs)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = [f"CAST('0x' || substr(sha256('{SEED}:' || doc_id), {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]

MIDDLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
p AS (SELECT *, len(u) AS n, {_H[0]} % (len(u) + 1) AS x, {_H[1]} % (len(u) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_H[2]} % 100 >= {PLAIN_FROM} THEN 'plain'
             WHEN {_H[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS a, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS b, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS e FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || e || '{MIDDLE}' || b ELSE '{SUFFIX}' || e || '{PREFIX}' || a || '{MIDDLE}' || b END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM c
"""
