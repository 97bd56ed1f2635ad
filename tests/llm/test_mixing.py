from pyspark.sql import functions as F

from probanda.llm import mixing as m

from .conftest import edge_rows


def shares(sizes, total, weights=(5, 2, 1), cap=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = total, {}, list(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if cap * sizes[s] <= level * w[s]]
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_sums(spark, nothing):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 60)), None if i % 11 == 0 else f"s{i % 3 if i % 2 else i % 9}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = m.mix(docs).collect()
    assert len(out) == 3000
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    want = shares(sizes, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 60
    again = m.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert m.mix(nothing).count() == 0


def test_rounding_is_fair(spark):
    """Over seeds, every document's mean number of copies is its rate, and it takes each of two neighbouring numbers."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 3), f"s{i % 2}") for i in range(12)], "doc_id long, text string, source string")
    rows = m.mix(docs, seed=0).select("doc_id", (F.col("target") / F.col("source_size")).alias("rate")).collect()
    rate = {r["doc_id"]: r["rate"] for r in rows}
    # The fold alone, with many seeds side by side: blocks as mix deals them, a level of one block a source.
    items = spark.createDataFrame([(i % 2, 1 + i % 3, i, rate[i] % 1, int(rate[i])) for i in range(12)], "source int, size long, doc_id long, p double, base int")
    seeds = spark.range(400).withColumnRenamed("id", "seed")
    folded = items.crossJoin(seeds).groupBy("seed", "source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "doc_id", "p", "base")))).alias("items")).select("seed", "source", F.expr(m.FOLD.format(seed="seed", level=0)).alias("f"))
    done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.doc_id", "d.copies")
    left = folded.where("f.open is not null").select("source", "f.open.doc_id", (F.col("f.open.base") + F.col("f.open.p")).alias("copies"))
    for r in done.union(left).groupBy("doc_id").agg(F.avg("copies").alias("mean"), F.count("*").alias("n"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect():
        p = rate[r["doc_id"]] % 1
        assert r["n"] == 400 and abs(r["mean"] - rate[r["doc_id"]]) < 4 * (p * (1 - p) / 400) ** 0.5 + 1e-9
        assert r["high"] - r["low"] <= 1 and (r["low"] < r["high"] or p < 1e-9)


def test_repeated_rows_part_into_blocks(spark):
    docs = spark.createDataFrame([(7, "a b c", "s0")] * 3000 + [(None, "x y", "s1")] * 2000 + [(i, "q " * (i % 9), "s2") for i in range(400)], "doc_id long, text string, source string")
    out = m.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in out) == [400, 2000, 3000] and all(abs(r["taken"] - r["target"]) <= 9 for r in out)


def test_edges(edges):
    out = m.mix(edges).collect()
    assert len(out) == len(edge_rows()) and all(r["taken"] == 0 for r in out if r["size"] == 0)
    mixed = m.mixed_documents(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    odd = edges.withColumn("more", F.create_map(F.lit("k"), F.col("score"))).withColumn("_hash", F.lit(1)).withColumn("_nth", F.lit("x"))
    again = m.mixed_documents(odd)
    assert again.columns == odd.columns and again.count() == mixed.count() and again.schema["more"].dataType.simpleString() == "map<string,double>"
    plan = m.mix_report(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
