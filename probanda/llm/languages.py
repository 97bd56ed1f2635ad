"""Language identification by cross-parsing.

The labelled text of each language becomes a suffix automaton, which knows
all its substrings. A text is parsed greedily into the longest phrases found
in a language's text; the language that needs the fewest phrases, normalised
as phrases * log2(n) / n, wins.

Letters are lower-cased and everything else counts as one space. Learning
takes whole rows of each language, first by hash, up to SAMPLE rows and
max_chars / languages characters; rows longer than a SHARE of that are passed over, but
for the shortest of a language that has no others (a bounded sample of the labelled rows).
All letters of the sample count. Whole texts are parsed: in pieces of PIECE letters side by side,
each then begun again from the state in which the piece before ended, until it
runs as it did before, so that the phrases are those of one parse.

Null text and text without a letter give `und` with score 0. Ties go to the
language first by code point. Without any labelled row all give `und`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, text_batches

MAX_CHARS, SAMPLE, SHARE = 160_000, 200, 8
#: The most frequent letters have columns of a table, the others (of large scripts) a sorted list; letters a piece; pieces side by side; letters taken together.
DENSE, PIECE, LANES, TOGETHER = 95, 512, 4096, 3_000_000
OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """All languages' automata as one table. A state is where its row begins; an entry is the next state times 4 plus the phrases that end: where no substring goes on, one ends and the letter begins the next, or is one by itself."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        found = [c for c, _ in Counter("".join(samples.values())).most_common()]
        # Numbers of letters: columns first, then the one column of letters never seen, then the others.
        self.width = w = min(len(found), DENSE) + 1
        number = {c: i + (i >= w - 1) for i, c in enumerate(found)}
        self.letters = len(found) + 1
        self.lookup = np.full(0x110000, w - 1, np.int32)
        self.lookup[[ord(c) for c in number]] = list(number.values())
        tables, roots, keys, goals = [], [], [], []
        base = 0
        for lang in self.langs:
            moves = suffix_automaton(samples[lang])
            table = np.full((len(moves), w), -1, np.int32)
            for state, to in enumerate(moves):
                for c, t in to.items():
                    if number[c] < w:
                        table[state, number[c]] = (base + t) * w
                    else:
                        keys.append((base + state) * w * self.letters + number[c])
                        goals.append((base + t) * w)
            root, fresh, inside = base * w, table[0], (np.arange(len(table)) > 0)[:, None]
            tables.append(np.where(table >= 0, table * 4, np.where(fresh < 0, root * 4 + 1, fresh * 4)[None, :] + inside))
            roots.append(root)
            base += len(moves)
        self.roots = np.array(roots, np.int32)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.rare_keys, self.rare_goals = np.array(keys, np.int64)[order], np.array(goals, np.int32)[order]

    def _rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where letters without a column lead, or -1."""
        if not len(self.rare_keys):
            return np.full(len(state), -1, np.int32)
        key = state.astype(np.int64) * self.letters + code
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == key, self.rare_goals[at], -1)

    def step(self, state: np.ndarray, code: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Entries of states and letters (arrays of one shape)."""
        to = self.table[state + np.minimum(code, self.width - 1)]
        rare = np.flatnonzero(code >= self.width)
        if len(rare):
            s, c, r = state[rare], code[rare], root[rare]
            on, fresh = self._rare(s, c), self._rare(r, c)
            to[rare] = np.where(on >= 0, on * 4, np.where(fresh >= 0, fresh * 4, r * 4 + 1) + (s != r))
        return to

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text under each language."""
        codes = self.lookup[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum([0, *map(len, texts)])
        pieces = -(-np.diff(begins) // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[owner] + nth * PIECE
        size = np.minimum(PIECE, begins[owner + 1] - start)
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        for lang, root in enumerate(self.roots.tolist()):
            states, ended = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int8)
            which, entry = np.arange(len(start)), np.full(len(start), root, np.int32)
            again = False
            while len(which):
                moved = self._run(which, entry, start, size, root, codes, states, ended, again)
                # The piece after one that ends in another state than before begins again; after the first round all do that do not begin afresh.
                which = moved + 1
                which = which[which < len(start)]
                which = which[nth[which] > 0]
                entry = states[start[which] - 1]
                if not again:
                    which, entry, again = which[entry != root], entry[entry != root], True
            sums = np.r_[0, np.cumsum(ended, dtype=np.int64)]
            last = np.maximum(begins[1:] - 1, 0)
            out[:, lang] = sums[begins[1:]] - sums[begins[:-1]] + ((states[last] != root) & (np.diff(begins) > 0) if len(states) else 0)
        return out

    def _run(self, which: np.ndarray, entry: np.ndarray, start: np.ndarray, size: np.ndarray, root: int, codes: np.ndarray, states: np.ndarray, ended: np.ndarray, again: bool) -> np.ndarray:
        """Parses pieces from these states and writes down each letter's state and phrases ended; `again` stops where a state is as it was. Gives the pieces that came to their end."""
        over, rare = [], bool(len(codes)) and int(codes.max()) >= self.width
        order = np.argsort(-size[which], kind="stable")
        which, entry = which[order], entry[order]
        for low in range(0, len(which), LANES):
            piece, state = which[low : low + LANES], entry[low : low + LANES]
            at, left = start[piece], size[piece]
            roots = np.full(len(piece), root, np.int32)
            while len(piece):
                to = self.step(state, codes[at], roots[: len(piece)]) if rare else self.table[state + codes[at]]
                state = to >> 2
                live = states[at] != state if again else None
                states[at], ended[at] = state, to & 3
                at, left = at + 1, left - 1
                if live is not None or left[-1] == 0:
                    done = left == 0
                    if live is not None:
                        over.append(piece[done & live])
                        keep = live & ~done
                    else:
                        over.append(piece[done])
                        keep = ~done
                    if not keep.all():
                        piece, state, at, left = piece[keep], state[keep], at[keep], left[keep]
        return np.sort(np.concatenate([np.zeros(0, np.int64), *over]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [normal(t or "") for t in texts]
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = np.concatenate([self.phrases(group) for group in by_size(plain, TOGETHER)])
        langs, scores = [], []
        for text, counts in zip(plain, found, strict=True):
            n = len(text)
            if not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                continue
            rates = counts * (np.log2(n + 1) / n)
            best = int(np.argmin(rates))
            weights = np.exp2(-8.0 * (rates - rates[best]) / max(rates[best], 1e-9))
            langs.append(self.langs[best])
            scores.append(float(1.0 / weights.sum()))
        return langs, scores


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def samples(docs: DataFrame, max_chars: int = MAX_CHARS) -> dict[str, str]:
    """Sample text of each language: at most SAMPLE whole rows and max_chars / languages characters, by hash of text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select("lang", "text", F.length("text").alias("_n"))
    langs = known.groupBy("lang").count().count()
    if not langs:
        return {}
    each = max(1, max_chars // langs)
    fits = F.col("_n") <= max(1, each // SHARE)
    counts = {r["lang"]: r for r in known.groupBy("lang").agg(F.count_if(fits).alias("n"), F.min_by("text", F.struct("_n", F.xxhash64("text"))).alias("shortest")).collect()}
    # A hash below the share keeps about 4 SAMPLE rows of each language before any sorting.
    share = F.element_at(F.create_map(*[F.lit(x) for lang, r in counts.items() for x in (lang, min(1.0, 4 * SAMPLE / max(r["n"], 1)))]), F.col("lang"))
    order = F.xxhash64("text")
    drawn = known.where(fits).withColumn("_order", order).where((F.pmod("_order", F.lit(1 << 20)) / float(1 << 20) <= share))
    drawn = drawn.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "text"))).where(F.col("_nth") <= SAMPLE)
    out: dict[str, str] = {lang: normal(r["shortest"]) if not r["n"] else "" for lang, r in counts.items()}
    for r in sorted(drawn.select("lang", "_nth", "text").collect()):
        text = normal(r["text"])
        if len(out[r["lang"]]) + len(text) < each:
            out[r["lang"]] += text + " "
    return out


def identify(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the automata go to the executors once (their size is bounded by max_chars)."""
    spark = docs.sparkSession
    text_batches(spark)
    model = spark.sparkContext.broadcast(CrossParser(samples(docs, max_chars)))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), predict(F.col("text").cast("string")).alias("r"))
    return rows.select("doc_id", "held_out", "r.lang_pred", "r.score")
