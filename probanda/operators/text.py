"""Text rates, samples and passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from ..sources.tables import written


@F.pandas_udf(IntegerType())
def token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over white-space tokens."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (x or "").split(), (y or "").split()
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            above, row = row, [i]
            for j, t in enumerate(y, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (s != t)))
        out.append(row[-1])
    return pd.Series(out, dtype="int32")


def rates(rows: DataFrame) -> DataFrame:
    """cer and wer of `said` against `reference`; null where the reference is empty."""
    n, w = F.length("reference"), F.size(F.array_remove(F.split(F.trim("reference"), r"\s+"), ""))
    return rows.withColumn("cer", F.when(n > 0, F.levenshtein("reference", "said") / n)).withColumn("wer", F.when(w > 0, token_edits("reference", "said") / w)).drop("reference", "said")


def sample(rows: DataFrame, group: list[str], what: str, seed: str, n: int, tie: str) -> DataFrame:
    """The first n of each group by sha256(seed:value)."""
    w = Window.partitionBy(*group).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(what)), 256), tie)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


#: Passages that are looked up in each text directly; more go by a join on runs of words.
FEW, FEW_BYTES = 64, 8 << 20


def _direct(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of passages that a text has, by looking for each of a block of at most FEW passages in every text."""
    p = passages.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("item_id")) - 1) / FEW))
    n = p.agg(F.max("_block")).first()[0]
    out = None
    for i in range(-1 if n is None else n + 1):
        hits = docs.join(F.broadcast(p.where(F.col("_block") == i).select("item_id", F.col("text").alias("_p"))), F.contains("text", F.col("_p"))).select("item_id", "doc_id")
        out = hits if out is None else out.union(hits)
    return out if out is not None else docs.limit(0).select(F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id"), "doc_id")


def containing(passages: DataFrame, docs: DataFrame, words: int = 6) -> DataFrame:
    """item_id and how many documents hold the passage word for word; passages that none has are left out, null and empty ones too.

    Few passages are looked for in each text. Of many, those long enough meet the texts by a run of words
    after their first, which a document must hold at a word's start, and are then looked up whole; the short ones go block by block."""
    p = passages.where("text <> ''").select("item_id", "text")
    size = p.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    d = docs.select("doc_id", "text")
    if size[0] <= FEW and size[1] <= FEW_BYTES:
        found = _direct(p, d)
    else:
        split = lambda t: F.split(t, r"[ \n]")
        long = F.size(split("text")) > words + 1
        p_runs = p.where(long).select("item_id", F.col("text").alias("_p"), F.xxhash64(F.concat_ws(" ", F.slice(split("text"), 2, words))).alias("_h"))
        d_runs = d.select("doc_id", split("text").alias("_w")).withColumn("_h", F.explode(F.expr(f"array_distinct(transform(sequence(0, greatest(size(_w) - {words}, 0)), i -> xxhash64(concat_ws(' ', slice(_w, i + 1, {words})))))"))).select("doc_id", "_h")
        hits = d_runs.join(p_runs, "_h").select("doc_id", "item_id", "_p").distinct()
        found = d.join(hits, "doc_id").where(F.contains("text", F.col("_p"))).select("item_id", "doc_id").union(_direct(p.where(~long), d))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


def in_turn(wishes: DataFrame, page: list[str]) -> DataFrame:
    """page.., a, b: who gets what if all choose one after another. wishes: (page.., a, turn, b, wish): each chooser's wishes from 1 on.

    Everybody asks for the first wish at once; what several ask for stays with the one whose turn comes first, and the others ask for
    their next wish that nobody before them holds. Holders only ever give way to earlier ones, so this ends where choosing in turn does, in as
    many rounds as the longest chain of refusals."""
    wishes = written(wishes, "wishes")
    asking = wishes.where("wish = 1")
    while True:
        asking = written(asking, "asking")
        held = asking.groupBy(*page, "b").agg(F.min("turn").alias("holder"))
        judged = asking.join(held, [*page, "b"])
        refused = judged.where("turn > holder").select(*page, "a", F.col("wish").alias("last"))
        if not refused.head(1):
            return asking.select(*page, "a", "b")
        left = wishes.join(refused, [*page, "a"]).where("wish > last").join(held, [*page, "b"], "left").where("holder is null or turn < holder")
        following = left.groupBy(*page, "a", "turn").agg(F.min(F.struct("wish", "b")).alias("m")).select(*page, "a", "turn", F.col("m.b").alias("b"), F.col("m.wish").alias("wish"))
        asking = judged.where("turn = holder").select(*page, "a", "turn", "b", "wish").union(following)


#: Units of one text on a page, of both sides, that choose in one task (some 40 bytes each); where there are more, pairs are listed and all choose by rounds.
TOGETHER = 200_000


def _equal_units(a: DataFrame, there: DataFrame, group: list[str]) -> DataFrame:
    """group.., a, b: each unit, in order, with the nearest free one of equal text. Units of one text on a page are a group, whose pairs are never listed."""
    shown = F.col("text").isNotNull()
    for g in group:
        shown = shown & F.col(g).isNotNull()
    each = a.where(shown).select(*group, "text", F.lit(True).alias("first"), F.col("a").alias("place"), "x", "y").union(there.select(*group, F.col("_text").alias("text"), F.lit(False).alias("first"), F.col("b").alias("place"), F.col("_x").alias("x"), F.col("_y").alias("y")).where(shown))

    def chosen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        one = rows["first"].to_numpy(bool)
        place, x, y = rows["place"].to_numpy(), rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        b, bx, by = place[~one], x[~one], y[~one]
        taken = np.zeros(len(b), bool)
        found = np.full(int(one.sum()), -1)
        for i, (ax, ay) in enumerate(zip(x[one][: len(b)], y[one][: len(b)], strict=True)):
            dx, dy = ax - bx, ay - by
            far = np.sqrt(dx * dx + dy * dy)
            far[taken] = np.inf
            j = int(far.argmin())
            if taken[j]:  # all others are endlessly far
                j = int(taken.argmin())
            taken[j], found[i] = True, j
        mine = found >= 0
        out = pd.DataFrame({"a": place[one][mine], "b": b[found[mine]]})
        for i, g in enumerate(group):
            out[g] = key[i]
        return out[[*group, "a", "b"]]

    kinds = dict(a.dtypes)
    return each.groupBy(*group, "text").applyInPandas(chosen, ", ".join(f"`{g}` {kinds[g]}" for g in group) + f", a {kinds['a']}, b {kinds['a']}")


def matched_units(before: DataFrame, after: DataFrame, group: list[str], moved: float = 4.0, least_reach: float = 8.0) -> DataFrame:
    """What happened to text units (group.., at, text, x, y, h): moved, changed, missing or added; units in place are left out.

    In order of `at`, each unit gets the nearest free one of equal text (the first on ties), then each of
    the others the nearest free one not further than its height (least_reach at least). Units of equal text on a page choose in one task, up to TOGETHER of
    them, beyond by a join on the text; near ones meet by a join on squares as wide as the reach; pages are never gathered. Units alike in `at` go in any order."""
    place = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy("at", "text", "x", "y")).alias(c)
    numbers = lambda df: [F.col("at").cast("long").alias("at"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "h")]]
    a = written(before.select(*group, place("a"), *numbers(before)), "before")
    b = written(after.select(*group, place("b"), *numbers(after)), "after")
    there = b.select(*group, "b", F.col("text").alias("_text"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    far = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    wish = lambda df: df.select(*group, "a", F.col("a").alias("turn"), "b", F.row_number().over(Window.partitionBy(*group, "a").orderBy("far", "b")).alias("wish"))

    sizes = a.select(*group, "text").union(there.select(*group, "_text")).groupBy(*group, "text").count().where(F.col("count") > TOGETHER).drop("count")
    crowded = written(sizes, "crowded")
    if crowded.head(1):
        many = a.join(crowded, [*group, "text"], "left_semi").join(there, group).where(F.col("text") == F.col("_text")).withColumn("far", far)
        alone = there.join(crowded.withColumnRenamed("text", "_text"), [*group, "_text"], "left_anti").select(there.columns)
        kept = _equal_units(a.join(crowded, [*group, "text"], "left_anti").select(a.columns), alone, group).union(in_turn(wish(many), group).select(*group, "a", "b"))
    else:
        kept = _equal_units(a, there, group)
    kept = written(kept, "kept")
    far_of = a.join(kept, [*group, "a"]).join(there, [*group, "b"]).withColumn("far", far)

    left, free = a.join(kept, [*group, "a"], "left_anti"), there.join(kept, [*group, "b"], "left_anti")
    reach = F.greatest("h", F.lit(least_reach))
    left = written(left.withColumn("reach", reach).withColumn("level", F.ceil(F.log2("reach")).cast("int")), "left")
    square = lambda v: F.floor(v / F.pow(F.lit(2.0), "level")).cast("long")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    looks = left.withColumns({"sx": square(F.col("x")), "sy": square(F.col("y"))}).withColumn("sx", around("sx")).withColumn("sy", around("sy"))
    levels = left.select("level").distinct()  # powers of two between the least and the greatest reach
    stands = free.join(F.broadcast(levels)).withColumns({"sx": square(F.col("_x")), "sy": square(F.col("_y"))})
    close = looks.join(stands, [*group, "level", "sx", "sy"]).withColumn("far", far).where("far <= reach")
    changed = in_turn(wish(close), group)

    at = lambda df, side, key, name: df.join(side.select(*group, key, F.col("at").alias(name)), [*group, key])
    rows = far_of.where(F.col("far") > moved).select(*group, "a", "b", F.lit("moved").alias("kind")).union(changed.select(*group, "a", "b", F.lit("changed")))
    both = at(at(rows, a, "a", "before"), b, "b", "after").select(*group, "kind", "before", "after")
    none = F.lit(None).cast("long")
    missing = left.join(changed, [*group, "a"], "left_anti").select(*group, F.lit("missing").alias("kind"), F.col("at").alias("before"), none.alias("after"))
    added = b.join(kept, [*group, "b"], "left_anti").join(changed, [*group, "b"], "left_anti").select(*group, F.lit("added").alias("kind"), none.alias("before"), F.col("at").alias("after"))
    return both.union(missing).union(added)
