"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The base spans follow fixed patterns, leftmost and without overlap for each
kind; candidates that fail their test are dropped without another try. The
field then reads the tokens around digits and at-signs: features of whole
segments of at most LONGEST tokens score each type, and dynamic programming over
segment ends chooses boundaries and types together. Its spans are added where
they touch no base span. Its weights are learnt on the driver from SENTENCES
generated lines (obfuscated addresses, numbers without a plus, spaced cards,
against plain numbers, hashes, keys and versions), by gradient steps on the
exact likelihood; no row of the data is needed.

Null and empty texts have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No address starts within a run of digits that a match could take whole.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SENTENCES, ROUNDS, LONGEST = 400, 8, 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each at-sign takes the local characters before it, back to the last match, so that long runs are read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:].lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15] if "+" in text else []
    return out


# --- the field -------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9@][0-9]*")
SPACE = re.compile(r"\s")
#: Address words stand for the signs; a plain "at" does beside a dotted host.
WORDS = re.compile(r"\(\s?at\s?\)|\[\s?at\s?\]|\sdot\s|[(\[]dot[)\]]|\sat\s(?=[^\W_][\w-]*\.[^\W_])", re.IGNORECASE)
CUES = {"email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax", "ring")}


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, kind: str) -> list[str]:
    """Features of the segment of tokens i to j (exclusive) under a kind; whole-span shapes rather than tokens."""
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b]
    digits = NOT_DIGIT.sub("", span)
    squeezed = re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), re.sub(r"[A-Za-z]+", "a", span))
    before = text[tokens[max(0, i - 3)][0] : a].lower()
    left, right = text[a - 1 : a], text[b : b + 1]
    tight = (left.isalnum() or left in "=\"'/#_@-") and left != "" or (right.isalnum() or right in "\"'/_@=") and right != ""
    out = [f"digits{min(len(digits), 20)}", f"tokens{j - i}", f"alpha{any(c.isalpha() for c in span)}", f"tight{bool(tight)}", f"first{squeezed[:1]}", f"last{squeezed[-1:]}"]
    out += [f"luhn{16 <= len(digits) <= 19 and luhn(digits)}", f"groups{'-'.join(str(min(len(g), 5)) for g in re.findall('[0-9]+', span))[:12]}"]
    out += [f"dots{min(span.count('.'), 4)}", f"at{'@' in span}{bool(re.search(r'(?:^|[^a-z])at(?:[^a-z]|$)', span.lower()))}{bool(re.search(r'[^a-z]dot[^a-z]', span.lower()))}", f"cue{kind in [k for k, v in CUES.items() if any(w in before for w in v)]}", f"shape{squeezed[:16]}"]
    if len(parts := span.split(".")) == 4:
        out.append(f"octets{all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)}")
    return [f"{kind}|{f}" for f in out] + [f"{kind}|bias"]


def _segments(text: str, tokens: list[tuple[int, int]], j: int) -> Iterator[tuple[int, str]]:
    """(start, kind) of the entities that may end before token j; without a digit or at-sign only address words may be one."""
    end = tokens[j - 1][1]
    for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
        if i < j - 1 and tokens[i + 1][0] - tokens[i][1] > 2:
            return
        span = text[tokens[i][0] : end]
        low = span.lower()
        n = sum(c.isdigit() for c in span)
        if "@" in span or " at " in low or "(at)" in low or "[at]" in low:
            yield i, "email"
        if n >= 4 and span[-1].isdigit() and (span[0].isdigit() or span[0] in "+("):
            if span.count(".") >= 3:
                yield i, "ip"
            if n >= 15:
                yield i, "card"
            if 8 <= n <= 15:
                yield i, "phone"


class Field:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, fs: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in fs)

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, str, list[str], float]]]:
        """By end: the segments with their features and scores. The segment of one token outside all entities scores 0."""
        out = [[]]
        for j in range(1, len(tokens) + 1):
            out.append([(i, k, fs := features(text, tokens, i, j, k), self.score(fs)) for i, k in _segments(text, tokens, j)])
        return out

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best-scoring segmentation, by dynamic programming over segment ends."""
        ends = self.candidates(text, tokens)
        top, back = [0.0] * len(ends), [None] * len(ends)
        for j in range(1, len(ends)):
            top[j] = top[j - 1]
            for i, kind, _, s in ends[j]:
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind)
        out, j = [], len(ends) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]

    def learn(self, lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS) -> Field:
        """Gradient ascent on the likelihood: observed minus expected features, expectations by forward and backward sums."""
        for step in range(rounds):
            rate = 0.3 / (1 + 0.15 * step)
            for text, gold in lines:
                tokens = [m.span() for m in TOKEN.finditer(text)]
                ends, n = self.candidates(text, tokens), len(tokens)
                fore, aft = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
                for j in range(1, n + 1):
                    fore[j] = fore[j - 1]
                    for i, _, _, s in ends[j]:
                        fore[j] = add(fore[j], fore[i] + s)
                for j in range(n, 0, -1):
                    aft[j - 1] = add(aft[j - 1], aft[j])
                    for i, _, _, s in ends[j]:
                        aft[i] = add(aft[i], aft[j] + s)
                change, want = defaultdict(float), set(gold)
                for j in range(1, n + 1):
                    for i, kind, fs, s in ends[j]:
                        p = math.exp(min(0.0, fore[i] + s + aft[j] - fore[n]))
                        d = ((kind, tokens[i][0], tokens[j - 1][1]) in want) - p
                        if abs(d) > 1e-4:
                            for f in fs:
                                change[f] += d
                for f, d in change.items():
                    self.weights[f] = self.weights.get(f, 0.0) * (1 - 1e-4) + rate * d / 4
        return self


def generated_lines(n: int = SENTENCES, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled lines: personal data in forms that the patterns miss or share, among words and harmless numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "ti", "es", "en", "at", "le", "qu", "ch", "do", "mi"]) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return x if r.random() < 0.5 else r.choice([" ", "-"]).join(x[i : i + 4] for i in range(0, 16, 4))

    def good() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            a, b, c = word() + r.choice(["", "." + word(), d(2)]), r.choice(["mail", "post", word()]) + r.choice(["", d(1)]), r.choice(["com", "org", "net"])
            return kind, r.choice([f"{a}@{b}.{c}", f"{a} at {b} dot {c}", f"{a} (at) {b} (dot) {c}", f"{a}[at]{b}.{c}", f"{a} at {b}.{c}"])
        if kind == "ip":
            return kind, ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        a, b, c = d(3), d(3), d(4)
        return kind, r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(1, 9)} {a} {b} {c}"])

    def bad() -> str:
        return r.choice([
            lambda: d(r.randint(1, 7)), lambda: d(16), lambda: f"19{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"20{d(2)}-20{d(2)}", lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(2)}.{d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}",
            lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))), lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
            lambda: f"v{d(1)}.{d(1)}.{d(2)}.{d(3)}1", lambda: f"{300 + int(d(2))}.{d(2)}.{d(3)}.{d(3)}", lambda: f"{word()} at {word()}", lambda: f"at the {word()} of {word()}", lambda: f"{d(10)}", lambda: d(12), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: f"{d(2)}:{d(2)}:{d(2)} {d(4)}",
        ])()

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(2, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                kind, s = good()
                if r.random() < 0.4:
                    text += r.choice(CUES[kind]) + r.choice([" ", ": "])
                gold.append((kind, len(text), len(text) + len(s)))
            else:
                s = bad()
            text += s + r.choice([" ", ", ", ". ", " "])
        out.append((text, gold))
    return out


_learnt: dict[tuple[int, int], dict[str, float]] = {}


def learnt_weights(n: int = SENTENCES, rounds: int = ROUNDS) -> dict[str, float]:
    if (n, rounds) not in _learnt:
        weights = Field().learn(generated_lines(n), rounds).weights
        _learnt[n, rounds] = {k: round(v, 4) for k, v in weights.items() if abs(v) > 0.01}
    return _learnt[n, rounds]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers that begin and end at white space; no entity can lie outside. Those that touch are one."""
    places = [m.span() for m in TRIGGER.finditer(text)]
    places += [m.span() for m in WORDS.finditer(text)]
    first, last = -1, -1
    for start, end in sorted(places):
        a, b = max(0, start - 80), min(len(text), end + 80)
        if b <= last:
            continue
        space = SPACE.search(text, b)
        b = space.start() if space else len(text)
        while a > last and a > 0 and not text[a - 1].isspace():
            a -= 1
        if a <= last:
            last = b
        else:
            if last >= 0:
                yield first, last
            first, last = a, b
    if last >= 0:
        yield first, last


def added_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field that touch no base span."""
    out, edges = [], sorted((x, y) for _, x, y in base)
    starts, longest = [x for x, _ in edges], max((y - x for x, y in edges), default=0)
    for a, b in windows(text):
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        for kind, s, e in field.best(text, tokens):
            near = edges[bisect.bisect_left(starts, s - longest) : bisect.bisect_left(starts, e)]
            if all(e <= x or s >= y for x, y in near):
                out.append((kind, s, e))
    return out


def personal_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, by kind and then start."""
    order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    base = base_spans(text)
    return order(base), order(base + added_spans(text, field, base))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row a document with its spans; each text is read in place, without a shuffle."""
    weights = learnt_weights()
    text_batches(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        field, rows = Field(weights), []
        for text in texts:
            base, spans = personal_spans(text or "", field)
            rows.append((*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the whole stretch is replaced, under the first's name."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def masked_documents(docs: DataFrame) -> DataFrame:
    """The documents with all personal data masked; n_chars, where there is such a column, follows the text."""
    weights = learnt_weights()
    text_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        field = Field(weights)
        return pd.Series([None if t is None else masked_text(t, personal_spans(t, field)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
