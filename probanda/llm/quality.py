"""Quality rules: a table of thresholds compiled into one projection, without user functions or shuffles.

Null text has no words and no lines; an empty text likewise. Both fail the base
rule (fewer than 50 words). Repeated rows are judged alike; other columns of
the input are left alone. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, count_of, words

SYMBOLS = "[#*$%&|<>]"

#: Up to so many repeated windows are looked up one by one.
FEW = 64

#: Frequent short words of the supported languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her she there been their we him has when who will no if out so said what up its about than into them can only other new some could time these two may then do first any my now such like our over even most after also did many before must "
    "der die das und in zu den von mit ist im nicht ein eine auf für sich dem des auch als an es "
    "le la les de des et en un une du que qui est pour dans ce il au par sur pas ne se plus avec "
    "el los las del y que se con por para una es no al lo como más o pero su sus"
).split()

#: rule: (measure, lowest allowed, highest allowed); None: no limit.
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "length": ("n_words", 50, None),
    "word_length": ("mean_word_chars", 2.0, 14.0),
    "symbols": ("symbols_per_word", None, 0.2),
    "stop_words": ("stop_word_share", 0.02, None),
    "duplicate_lines": ("dup_line_share", None, 0.3),
    "capitals": ("capital_share", None, 0.4),
}


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, _lines and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "_words": words(t),
        "_lines": F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACES}]")),
        "word_chars": F.length(t) - count_of(t, f"[{SPACES}]"),
        "n_symbols": count_of(t, SYMBOLS),
        "_capitals": count_of(t, "[A-Z]"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stops": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))),
        "_hashes": F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])))"),
    })
    # Texts without a repeat (most) skip the sort. A few repeated windows are looked up; many are found side by side among (hash, place) in order.
    out = out.withColumn("_order", F.expr("if(size(array_distinct(_hashes)) = size(_hashes), cast(array() as array<bigint>), sort_array(_hashes))"))
    out = out.withColumn("_twice", F.expr("array_distinct(filter(_order, (h, i) -> i > 0 and _order[i - 1] = h))"))
    out = out.withColumn("_sorted", F.expr(f"if(size(_twice) <= {FEW}, cast(array() as array<struct<h:bigint,i:int>>), array_sort(transform(_hashes, (h, i) -> struct(h, i))))"))
    out = out.withColumn("_found", F.expr(f"""case when size(_twice) = 0 then cast(array() as array<int>)
        when size(_twice) <= {FEW} then filter(transform(_hashes, (h, i) -> if(array_contains(_twice, h), i, -1)), i -> i >= 0)
        else array_sort(transform(filter(_sorted, (x, i) -> (i > 0 and _sorted[i - 1].h = x.h) or (i < size(_sorted) - 1 and _sorted[i + 1].h = x.h)), x -> x.i)) end"""))
    return out.withColumn("n_repeat_words", F.expr("aggregate(_found, struct(0L as n, 0 as to), (a, p) -> struct(a.n + (p + 3 - greatest(p, a.to)) as n, p + 3 as to), a -> a.n)"))


def compile_rules(rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> Column:
    """The table of thresholds as one boolean column over the measures."""
    ok = F.lit(True)
    for measure, low, high in rules.values():
        if low is not None:
            ok = ok & (F.col(measure) >= low)
        if high is not None:
            ok = ok & (F.col(measure) <= high)
    return F.coalesce(ok, F.lit(False))


def judge(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept; helper columns start with an underscore."""
    out = base_measures(docs, text)
    n = F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns({
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_share": F.col("_stops") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "capital_share": F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row a document: the counts, base_failed and kept."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only.

    Rejected rows leave through a generator: a filter would be pushed below the
    projections and put the sorting of windows inside the functions that walk them.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    one = F.array("_row")
    return judge(inner, "_text").select(F.inline(F.when(F.col("kept"), one).otherwise(F.slice(one, 1, 0))))
