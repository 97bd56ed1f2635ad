"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target divided by its size is the number of copies that each of its
documents gets on average. The whole part is taken at once; the fractional
parts are rounded in pairs: words move at random from one document's expected
copies to the other's until one of them is integral, so that the words taken
never drift from the target. Blocks of about BLOCK documents are folded side
by side, the one document that each block leaves open goes up to the next
level, and so on until one remains per source, which is rounded to the nearer
integer. Hot sources only have more blocks.

Null sources form one source, ranked last; null and empty texts have size 0
and nothing is taken from them; repeated rows are documents of their own; an
empty table gives an empty result. The same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_rank, words, written

BLOCK = 128
#: Sources up to this many are broadcast (some 100 bytes each).
SMALL = 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n, target of (source, size) rows; what a source cannot take beyond cap times its size goes to the others by weight."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(stats, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "weights")
    total = ranked.agg((share * F.coalesce(F.sum("source_size"), F.lit(0))).alias("t"), F.sum("weight").alias("w")).first()
    level, clamped = (total["t"] / total["w"] if total["w"] else 0.0), -1
    while True:  # a round shares the excess of those above their cap; the set of those only grows
        full = cap * F.col("source_size") <= level * F.col("weight")
        now = ranked.agg(F.sum(full.cast("int")).alias("n"), F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not now["n"] or now["n"] == clamped or not now["w"]:
            break
        clamped, level = now["n"], (total["t"] - now["c"]) / now["w"]
    return ranked.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("weight"))).select("source", "source_size", "n", "target")


#: Folds the documents of a block, largest first, so that large ones are settled while others are left to take their words: `open` is the one whose expected copies are still fractional.
FOLD = """
aggregate(items,
  named_struct('open', cast(null as struct<size:bigint,doc_id:bigint,p:double,base:int>), 'done', cast(array() as array<struct<size:bigint,doc_id:bigint,copies:int>>)),
  (acc, x) -> if(acc.open is null, named_struct('open', x, 'done', acc.done),
    transform(array(named_struct(
        'x_up', least((1 - x.p) * x.size, acc.open.p * acc.open.size),
        'x_down', least(x.p * x.size, (1 - acc.open.p) * acc.open.size),
        'u', shiftrightunsigned(xxhash64({seed}, {level}, x.doc_id, x.size, acc.open.doc_id, acc.open.size, size(acc.done)), 11) / 9007199254740992D)),
      m -> case
        when m.u * (m.x_up + m.x_down) < m.x_down then
          if((1 - x.p) * x.size <= acc.open.p * acc.open.size,
            named_struct('open', named_struct('size', acc.open.size, 'doc_id', acc.open.doc_id, 'p', acc.open.p - m.x_up / acc.open.size, 'base', acc.open.base), 'done', concat(acc.done, array(named_struct('size', x.size, 'doc_id', x.doc_id, 'copies', x.base + 1)))),
            named_struct('open', named_struct('size', x.size, 'doc_id', x.doc_id, 'p', x.p + m.x_up / x.size, 'base', x.base), 'done', concat(acc.done, array(named_struct('size', acc.open.size, 'doc_id', acc.open.doc_id, 'copies', acc.open.base)))))
        else
          if(x.p * x.size <= (1 - acc.open.p) * acc.open.size,
            named_struct('open', named_struct('size', acc.open.size, 'doc_id', acc.open.doc_id, 'p', acc.open.p + m.x_down / acc.open.size, 'base', acc.open.base), 'done', concat(acc.done, array(named_struct('size', x.size, 'doc_id', x.doc_id, 'copies', x.base)))),
            named_struct('open', named_struct('size', x.size, 'doc_id', x.doc_id, 'p', x.p - m.x_down / x.size, 'base', x.base), 'done', concat(acc.done, array(named_struct('size', acc.open.size, 'doc_id', acc.open.doc_id, 'copies', acc.open.base + 1)))))
        end)[0]))
"""


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("size")), "sizes")
    targets = written(source_targets(sized, weights, share, cap), "targets")
    n_sources, most = targets.agg(F.count(F.lit(1)), F.max("n")).first()
    side = targets.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if n_sources <= SMALL else side
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_rate", rate)
    # Rates that are integral but for rounding are integral.
    rows = rows.withColumn("base", F.floor(F.col("_rate") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("_rate") - F.col("base"), F.lit(0.0)))
    open_row = (F.col("p") > 1e-9) & (F.col("size") > 0)
    same = ["source", "source_size", "target"]
    parts = [rows.where(~open_row).select(*same, "doc_id", "size", F.col("base").alias("copies"))]
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    # Rows alike in id and size are counted and numbered, so that they part into blocks as well.
    alike = rows.where(open_row).groupBy(*same, "n", "doc_id", "size", "p", "base").agg(F.count(F.lit(1)).alias("_c")).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_c")))
    level_rows = alike.select(*same, "doc_id", "size", "p", "base", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "_nth"), blocks).alias("block"))
    n_blocks, level = -(-(most or 0) // BLOCK), 0
    while True:
        items = F.reverse(F.array_sort(F.collect_list(F.struct("size", "doc_id", "p", "base")))).alias("items")
        folded = written(level_rows.groupBy(*same, "block").agg(items).select(*same, "block", F.expr(FOLD.format(seed=seed, level=level)).alias("f")), f"fold{level}")
        parts.append(folded.select(*same, F.explode("f.done").alias("d")).select(*same, "d.doc_id", "d.size", "d.copies"))
        left = folded.where("f.open is not null").select(*same, "f.open.doc_id", "f.open.size", "f.open.p", "f.open.base", "block")
        if n_blocks <= 1:
            break
        n_blocks, level = -(-n_blocks // BLOCK), level + 1
        level_rows = left.withColumn("block", F.floor(F.col("block") / BLOCK))
    parts.append(left.select(*same, "doc_id", "size", (F.col("base") + (F.col("p") >= 0.5).cast("int")).alias("copies")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it. Rows of one doc_id are told apart by source and size, and numbered by the hash of their text; rows alike in all these share their copies in any order. Other columns may be of any kind."""
    nth = lambda *more: F.row_number().over(Window.partitionBy("_id", "_src", "_size").orderBy(*more))
    copies = mix(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("_src"), F.col("size").alias("_size"), F.col("copies").alias("_copies"), F.col("source").isNull().alias("_null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_src"), F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("_size"), F.col("source").isNull().alias("_null"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    left = rows.withColumn("_nth", nth("_hash"))
    right = copies.withColumn("_nth", nth("_copies")).toDF(*[f"{c}_r" for c in [*copies.columns, "_nth"]])
    match = F.col("_id").eqNullSafe(F.col("_id_r")) & (F.col("_src") == F.col("_src_r")) & (F.col("_size") == F.col("_size_r")) & (F.col("_nth") == F.col("_nth_r")) & (F.col("_null") == F.col("_null_r"))
    return left.join(right, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies_r")))).select("_row.*")
