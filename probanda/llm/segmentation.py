"""SentencePiece segmentation with seeded merge-dropout.

The model's pieces and scores are read from its file; merging is done here. An
agenda holds the candidate merges of a stretch of text, best score first,
then leftmost; each candidate that comes up is skipped if a keyed hash of seed,
doc_id, copy, place of the stretch, place in it and piece falls below the dropout
rate. No piece of the model crosses from a letter to a space, so stretches between
spaces are merged on their own. What is remembered of a stretch is a tree of
what its agenda came to: a node has the candidates that follow the skips so far, the
segmentation if none of them is skipped, and a branch for each of them as the next skip.
An occurrence follows its own skips down the tree, branches being merged as they are
first asked for. Each occurrence of a word is parted on its own; reruns part it alike.

Characters that are no piece become byte pieces, so that every text decodes to
itself, the space sign U+2581 too (always as bytes). Null text counts as empty
and has no pieces. Rate 0 gives the library's own segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ragged, by_size, chunked, give_back, plain_parts, text_batches

SPACE = "▁"
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Where no piece joins a letter to anything else, letters are also parted from what follows.
FINE = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:[^\w{SPACE}]|[\d_])+|{SPACE}+")
LETTER = re.compile(r"[^\W\d_]")
#: Nodes and their ids that a worker remembers, then forgets together.
REMEMBERED, IDS = 300_000, 8_000_000
SLOT_BITS = 21
#: Stretches of up to so many characters are merged side by side, SIDE at a time; longer ones one by one, at every place. Texts are taken together up to TOGETHER characters, and the keys of HASHED occurrences at a time.
WIDTHS, SIDE, TOGETHER, HASHED = (6, 9, 12, 16, 24), 4096, 1_000_000, 32_768
M64, K1, K2, K3 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB


class Segmenter:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 11):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in usual}
        self.scores = {model.id_to_piece(i): -model.get_score(i) for i in usual}
        crossing = any(bool(LETTER.match(a)) != bool(LETTER.match(b)) for p in self.ids for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.stretch = STRETCH if crossing or inner else FINE
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.kind = "<u2" if n <= 65536 else "<u4"
        self.seed, self.limit = seed, int(dropout * (1 << 32))
        self.sign = np.array([self.bytes[b] for b in SPACE.encode()], self.kind)
        self.decoded = Ragged("u1")
        self.decoded.add(np.frombuffer(b"".join(self.raw), np.uint8), np.array([len(x) for x in self.raw], np.int64))
        self.shown, self.bare = Ragged(self.kind), {}
        self.shown.add(np.arange(n).astype(self.kind), np.ones(n, np.int64))
        self.forget()
        # Numbers of symbols: pieces have their ids, further characters of pieces follow, the last is any other character.
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            number.setdefault(c, n + len(number) - len(self.ids))
        self.symbols = n + len(number) - len(self.ids) + 1
        chars = sorted(c for c in number if len(c) == 1)
        self.char_points, self.char_ids = np.array([ord(c) for c in chars], np.uint32), np.array([number[c] for c in chars], np.int32)
        pairs = sorted((number[p[:k]] * self.symbols + number[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair_keys, self.pair_ids = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32)
        self.slots = self._hash_pairs()
        #: Equal scores have equal ranks; the last is for -1.
        self.ranks = np.full(self.symbols + 1, len(self.ids) + 1, np.int32)
        place = {c: k for k, c in enumerate(sorted(set(self.scores.values())))}
        for p, i in self.ids.items():
            self.ranks[i] = place[self.scores[p]]

    def forget(self) -> None:
        """Node 0 is a space sign of the text itself."""
        #: Of a node: ids, and candidates (places times K1 plus pieces times K2).
        self.pieces, self.marks = Ragged(self.kind), Ragged("<u8")
        #: Of a node: the number of its stretch in `names`, the node above (-1 for roots), and the skip that leads from there.
        self.names: list[str] = []
        self.above = np.zeros(256, [("name", np.int32), ("node", np.int32), ("skip", np.uint64)])
        self.above["node"] = -1
        self.pieces.add(self.sign, np.array([len(self.sign)]))
        self.marks.add(np.zeros(0, np.uint64), np.zeros(1, np.int64))
        #: Beside each candidate, the node that follows its skip, or -1.
        self.next = np.zeros(0, np.int32)
        #: Nodes of stretches without skips; those too long for a tree are below 0, as numbers of `long` less one.
        self.roots: dict[str | None, int] = {None: 0}
        self.long: list[str] = []

    def variant(self, doc_id: object, copy: int = 0) -> int:
        """The key of a document, or of one of its copies."""
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{doc_id}:{copy}".encode(), digest_size=8).digest(), "little")

    @staticmethod
    def places(variant: int, n: int) -> np.ndarray:
        """Keys of the first n stretches of a document."""
        h = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(K1)) ^ np.uint64(variant & M64)
        h = (h ^ h >> np.uint64(31)) * np.uint64(K2)
        h = (h ^ h >> np.uint64(29)) * np.uint64(K3)
        return h ^ h >> np.uint64(32)

    def _skips(self, node: int) -> list[int]:
        """The skips that lead to a node."""
        out: list[int] = []
        while self.above["node"][node] >= 0:
            out.append(int(self.above["skip"][node]))
            node = self.above["node"][node]
        return out[::-1]

    def _grow(self, names: np.ndarray, above: np.ndarray, last: np.ndarray) -> np.ndarray:
        """New nodes of stretches, below these nodes (-1 for roots) by these skips; those of like length are merged side by side."""
        stretches, out = [self.names[i] for i in names.tolist()], np.zeros(len(names), np.int64)
        skips = [[*self._skips(a), s] if a >= 0 else [] for a, s in zip(above.tolist(), last.tolist(), strict=True)]
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        low = 0
        for high in WIDTHS:
            which = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(which), SIDE):
                part = which[at : at + SIDE].tolist()
                ids, n_ids, marks, n_marks = self._merge_side([stretches[i] for i in part], high, [skips[i] for i in part])
                out[part] = nodes = self.pieces.add(ids, n_ids)
                self.marks.add(marks, n_marks)
                if self.pieces.n > len(self.above):
                    more = np.zeros(len(self.above), self.above.dtype)
                    self.above = np.concatenate([self.above, more, np.zeros(max(0, self.pieces.n - 2 * len(more)), self.above.dtype)])
                self.above["name"][nodes], self.above["node"][nodes], self.above["skip"][nodes] = names[part], above[part], last[part]
            low = high
        room = len(self.marks.flat) - len(self.next)
        if room > 0:
            self.next = np.concatenate([self.next, np.full(room, -1, np.int32)])
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(K1) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _hash_pairs(self) -> np.ndarray:
        """Open addressing: a slot has 1 + the number of a pair, or 0."""
        slots, at, left = np.zeros(1 << SLOT_BITS, np.int32), self._slot(self.pair_keys), np.arange(len(self.pair_keys))
        while len(left):
            free = left[slots[at[left]] == 0]
            first = free[np.unique(at[free], return_index=True)[1]]
            slots[at[first]] = first + 1
            left = left[slots[at[left]] != left + 1]
            at[left] = at[left] + 1 & (1 << SLOT_BITS) - 1
        return slots

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What neighbouring symbols join to, or -1."""
        key = (a.astype(np.int64) * self.symbols + b).ravel()
        at = self._slot(key)
        pair = self.slots[at] - 1
        out = np.where(self.pair_keys[pair] == key, self.pair_ids[pair], -1)
        left = np.flatnonzero((out < 0) & (pair >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << SLOT_BITS) - 1
            pair = self.slots[at[left]] - 1
            out[left] = np.where((self.pair_keys[pair] == key[left]) & (pair >= 0), self.pair_ids[pair], -1)
            left = left[(out[left] < 0) & (pair >= 0)]
        out = out.reshape(a.shape)
        out[(a < 0) | (b < 0)] = -1
        return out

    def _merge_side(self, stretches: list[str], width: int, skips: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The agenda of every stretch as a row of candidates; in a step each row takes its best, leftmost one, or skips it if told. Gives the ids of each and their number, and the candidates taken after the last skip and their number."""
        n = len(stretches)
        points = np.zeros((n, width), np.uint32)
        sizes = np.fromiter(map(len, stretches), np.int64, n)
        inside = np.arange(width) < sizes[:, None]
        points[inside] = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.char_points, points), len(self.char_points) - 1)
        sym = np.where(inside, np.where(self.char_points[at] == points, self.char_ids[at], self.symbols - 1), -1).astype(np.int32)
        final, starts = sym.copy(), np.broadcast_to(np.arange(width, dtype=np.int32), sym.shape).copy()
        begins = starts.copy()
        rows, cols = np.arange(n), np.arange(width)
        edge = np.full((n, 1), -1, np.int32)
        to = np.concatenate([self._merged(sym[:, :-1], sym[:, 1:]), edge], 1).astype(np.int32)
        # Skips as a matrix; no candidate is 0, as no merge makes the first piece.
        told = np.zeros((n, max(map(len, skips))), np.uint64)
        for i, x in enumerate(skips):
            told[i, : len(x)] = x
        final_skip = told[np.arange(n), [len(x) - 1 for x in skips]] if told.shape[1] else np.zeros(n, np.uint64)
        past = np.array([not x for x in skips])
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            i, line = self.ranks[to].argmin(1), np.arange(len(rows))
            piece = to[line, i]
            live = np.flatnonzero(piece >= 0)
            if 4 * len(live) < 3 * len(rows):  # settled rows leave
                final[rows], begins[rows] = sym, starts
                rows, sym, starts, to, i, piece = rows[live], sym[live], starts[live], to[live], i[live], piece[live]
                live = np.arange(len(rows))
            if not len(live):
                final[rows], begins[rows] = sym, starts
                break
            k, made = i[live], piece[live]
            mark = starts[live, k].astype(np.uint64) * np.uint64(K1) + made.astype(np.uint64) * np.uint64(K2)
            if told.shape[1]:
                skip = (told[rows[live]] == mark[:, None]).any(1)
                past[rows[live[skip & (mark == final_skip[rows[live]])]]] = True
                to[live[skip], k[skip]] = -1
                live, k, made, mark = live[~skip], k[~skip], made[~skip], mark[~skip]
            new = past[rows[live]]
            taken.append((rows[live[new]], mark[new]))
            # The symbols after each merge move up by one; the last place is empty.
            shift = (live * width)[:, None] + np.minimum(cols + (cols > k[:, None]), width - 1)
            one = np.arange(len(live))
            moved = sym.ravel()[shift]
            moved[:, -1] = -1
            moved[one, k] = made
            sym[live] = moved
            right, left = np.where(k + 1 < width, moved[one, np.minimum(k + 1, width - 1)], -1), np.maximum(k - 1, 0)
            before = np.where(k > 0, moved[one, left], -1)
            starts[live] = starts.ravel()[shift]
            moved = to.ravel()[shift]
            moved[:, -1] = -1
            moved[one, left] = np.where(k > 0, self._merged(before, made), moved[one, left])
            moved[one, k] = self._merged(made, right)
            to[live] = moved
        who, marks = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.uint64)), *taken, strict=True))
        marks, n_marks = marks[np.argsort(who, kind="stable")], np.bincount(who, minlength=n)
        # What is no piece becomes bytes: rows of `shown` after the pieces.
        bare = np.nonzero(final >= len(self.raw))
        if len(bare[0]):
            code, which = np.unique(points[bare[0], begins[bare]], return_inverse=True)
            final[bare] = np.array([self._bytes_of(chr(c)) for c in code.tolist()])[which]
        some = final >= 0
        flat, sizes = self.shown.take(final[some])
        return flat, np.bincount(np.nonzero(some)[0], sizes, n).astype(np.int64), marks, n_marks

    def _bytes_of(self, char: str) -> int:
        """The row of `shown` with a character's byte pieces."""
        if char not in self.bare:
            found = [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
            self.bare[char] = int(self.shown.add(np.array(found, self.kind), np.array([len(found)]))[0])
        return self.bare[char]

    def numbered(self, symbols: list[str | None]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                else:
                    out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def skipped(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        h = keys ^ marks
        return ((h ^ h >> np.uint64(29)) * np.uint64(K3)) >> np.uint64(32) < np.uint64(self.limit)

    def merge(self, stretch: str, variant: int, drop: bool = True) -> list[int]:
        """The agenda as a heap over linked symbols; stale entries are recognised by the piece they stood for."""
        get, ids, limit = self.scores.get, self.ids, self.limit if drop else 0
        symbols: list[str | None] = list(stretch)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            score = get(pair)
            if score is not None:
                agenda.append((score, i, pair))
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            key = variant & M64
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) >= len(pair) or left + symbols[j] != pair:
                continue
            if limit:
                h = (key ^ (i * K1 + ids[pair] * K2)) & M64
                if ((h ^ h >> 29) * K3 & M64) >> 32 < limit:
                    continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                joined = pair + symbols[k]
                score = get(joined)
                if score is not None:
                    push(agenda, (score, i, joined))
            p = before[i]
            if p >= 0:
                joined = symbols[p] + pair
                score = get(joined)
                if score is not None:
                    push(agenda, (score, p, joined))
        return self.numbered(symbols)

    def _stretches(self, text: str) -> list[str | None]:
        """The text's stretches; None stands for a space sign of the text itself."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(SPACE) if text else ()):
            if k:
                out.append(None)
            if part or not k:
                out += self.stretch.findall((SPACE if not k else "") + part.replace(" ", SPACE))
        return out

    def _learn(self, stretches: Iterable[str]) -> None:
        """Roots of stretches that have none yet."""
        new = list(dict.fromkeys(s for s in stretches if s not in self.roots))
        short = [s for s in new if len(s) <= WIDTHS[-1]]
        none = np.full(len(short), -1)
        first = len(self.names)
        self.names += short
        self.roots.update(zip(short, self._grow(np.arange(first, len(self.names)), none, none.astype(np.uint64)).tolist(), strict=True))
        for s in new:
            if len(s) > WIDTHS[-1]:
                self.long.append(s)
                self.roots[s] = -len(self.long)

    def _root(self, stretches: list[str | None]) -> np.ndarray:
        return np.fromiter(map(self.roots.__getitem__, stretches), np.int64, len(stretches))

    def _roots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Roots of the stretches of the texts, and how many each text has. Texts whose stretches are what stands between single spaces are cut together, distinct chunks once."""
        column = pa.array(texts, pa.large_string())
        codes, chunks, counts = chunked(column)
        sizes = pc.utf8_length(chunks).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), counts)
        apart = pc.match_substring(column, SPACE).to_numpy(zero_copy_only=False)
        apart[owner[sizes[codes] == 0]] = True
        plain, words, tails = plain_parts(chunks) if self.stretch is FINE else (np.zeros(len(chunks), bool), chunks.slice(0, 0), chunks.slice(0, 0))
        words, tails = words.dictionary_encode(), tails.dictionary_encode()
        text_of = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        word, tail = [SPACE + w for w in text_of(words.dictionary)], text_of(tails.dictionary)
        other = [self.stretch.findall(SPACE + c) for c in text_of(chunks.filter(pa.array(~plain)))]
        by_hand = {i: self._stretches(texts[i]) for i in np.flatnonzero(apart).tolist()}
        self._learn(itertools.chain(word, filter(None, tail), *other, (s for x in by_hand.values() for s in x if s is not None)))
        # Two places for each plain chunk, the second empty where it has no tail; -1 << 40 stands for empty.
        none = -(1 << 40)
        of_chunk = Ragged("<i8")
        n_parts = np.full(len(chunks), 2, np.int64)
        n_parts[~plain] = [len(x) for x in other]
        flat = np.zeros(n_parts.sum(), np.int64)
        begin = np.cumsum(n_parts) - n_parts
        flat[begin[plain]] = self._root(word)[words.indices]
        flat[begin[plain] + 1] = np.array([self.roots[t] if t else none for t in tail], np.int64)[tails.indices]
        flat[np.repeat(~plain, n_parts)] = self._root([s for x in other for s in x])
        of_chunk.add(flat, n_parts)
        kept = ~apart[owner]
        roots, sizes = of_chunk.take(codes[kept])
        owner = np.repeat(owner[kept], sizes)
        roots, owner = roots[roots != none], owner[roots != none]
        counts = np.bincount(owner, minlength=len(texts))
        if by_hand:
            parts = np.split(roots, np.cumsum(counts)[:-1])
            for i, stretches in by_hand.items():
                parts[i] = self._root(stretches)
                counts[i] = len(stretches)
            roots = np.concatenate(parts)
        return roots, counts

    def _first_skips(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these occurrences skip a candidate of their nodes, and where the first one that each skips stands in `marks`."""
        who, where = [], []
        for low in range(0, len(nodes), HASHED):
            at, sizes = self.marks.places(nodes[low : low + HASHED])
            hit = np.flatnonzero(self.skipped(np.repeat(keys[low : low + HASHED], sizes), self.marks.flat[at]))
            owner = np.repeat(np.arange(low, low + len(sizes)), sizes)[hit]
            first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
            who.append(owner[first])
            where.append(at[hit[first]])
        return np.concatenate(who), np.concatenate(where)

    def _followed(self, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The nodes where occurrences end that start at these roots under these keys."""
        nodes, active = nodes.copy(), np.arange(len(nodes))
        while len(active):
            who, place = self._first_skips(nodes[active], keys[active])
            active = active[who]
            missing, one = np.unique(place[self.next[place] < 0], return_index=True)
            if len(missing):
                above = nodes[active[self.next[place] < 0][one]]
                made = self._grow(self.above["name"][above], above, self.marks.flat[missing])
                self.next[missing] = made
            nodes[active] = self.next[place]
        return nodes

    def encode_many(self, texts: list[str], variants: list[int]) -> Iterator[np.ndarray]:
        """Ids of each text under its key; stretches of several texts are merged together."""
        begin = 0
        for group in by_size(texts, TOGETHER):
            if self.pieces.n > REMEMBERED or self.pieces.used > IDS or len(self.long) > SIDE:
                self.forget()
            nodes, counts = self._roots(group)
            give_back()
            keys = np.concatenate([self.places(v, c) for v, c in zip(variants[begin : begin + len(group)], counts.tolist(), strict=True)])
            begin += len(group)
            short = nodes >= 0
            if self.limit:
                nodes[short] = self._followed(nodes[short], keys[short])
            own = self.pieces
            if not short.all():  # long stretches have a row each for this group
                own, which = Ragged(self.kind), np.flatnonzero(~short)
                flat, sizes = self.pieces.take(nodes[short])
                found = [self.merge(self.long[-nodes[i] - 1], int(keys[i])) for i in which.tolist()]
                own.add(np.concatenate([flat, np.array([p for x in found for p in x], self.kind)]), np.concatenate([sizes, [len(x) for x in found]]))
                nodes[short], nodes[which] = np.arange(len(sizes)), np.arange(len(sizes), len(nodes))
            ids, sizes = own.take(nodes)
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)].tolist()
            yield from (ids[a:b] for a, b in zip([0, *ends], ends, strict=False))
        give_back()

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        return next(self.encode_many([text], [variant]))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the space that encoding put first goes."""
        raw = self.decoded.take(ids)[0].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


_segmenters: dict[tuple, Segmenter] = {}


def segmenter(path: str, dropout: float, seed: int) -> Segmenter:
    if (path, dropout, seed) not in _segmenters:
        _segmenters[path, dropout, seed] = Segmenter(path, dropout, seed)
    return _segmenters[path, dropout, seed]


def segmented(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 11) -> DataFrame:
    """doc_id, ids array<int> of every row. Rows that repeat a document are its copies and are parted each on its own, by their place in the input: the same files, split alike, give the same pieces again, and no row is moved to number it."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(ids: pd.Series, copies: pd.Series, texts: pd.Series) -> pd.Series:
        s = segmenter(path, dropout, seed)
        found = s.encode_many([t or "" for t in texts], [s.variant(i, c) for i, c in zip(ids, copies, strict=True)])
        return pd.Series([x.astype(np.int32) for x in found], dtype=object)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_copy"))
    return rows.select("doc_id", encode(F.col("doc_id").cast("string"), "_copy", "text").alias("ids"))


def round_trips(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 11) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian u32), decoded_sha256, lossless of every document, encoded and decoded in one pass."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
    def check(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        s, rows = segmenter(path, dropout, seed), []
        texts = [t or "" for t in texts]
        for text, pieces in zip(texts, s.encode_many(texts, [s.variant(i) for i in ids]), strict=True):
            raw = s.decode(pieces)
            rows.append((len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), hashlib.sha256(raw).hexdigest(), raw == text.encode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), check(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("r"))
    return rows.select("doc_id", "r.*")
