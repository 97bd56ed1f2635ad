import corpus_pipeline as c

from probanda.llm import ngram_join, quality
from probanda.llm.common import written

from .conftest import edge_rows, prose


def test_stages_one_by_one(spark):
    rows = edge_rows() + [(200 + i, prose(300 + i // 2, 90), "en", f"s{i % 4}", None, *[None] * 6) for i in range(40)]
    from .conftest import SCHEMA

    docs = spark.createDataFrame(rows, SCHEMA)
    at, seen = docs, []
    for _, stage in c.STAGES:
        at = written(stage(spark, at, ""), "t")
        seen.append(at)
    report = quality.quality_report(docs).collect()
    assert seen[0].count() == sum(r["kept"] for r in report)
    assert all(x.columns == docs.columns for x in seen[:4])
    labels = ngram_join.near_copies(seen[0])
    assert seen[1].count() == labels.select("component_id").distinct().count()
    assert seen[2].count() == seen[1].count() and seen[2].where("text like '%@%'").count() == 0
    assert 0.7 < seen[3].count() / (1.5 * seen[2].count()) < 1.4
    assert seen[4].count() == seen[3].count() and seen[4].where("n_pieces < 50").count() == 0


def test_empty(spark):
    from .conftest import SCHEMA

    at = spark.createDataFrame([], SCHEMA)
    for _, stage in c.STAGES:
        at = written(stage(spark, at, ""), "t")
    assert at.count() == 0


def test_run_against_plain_python(spark, tmp_path):
    """Every row of run(): kept and single documents, masked, as often as the mix takes them, in pieces that decode."""
    from collections import Counter

    from probanda.llm import mixing, personal_data, segmentation

    from .conftest import SCHEMA

    rows = edge_rows() + [(200 + i, prose(300 + i // 2, 90) + (" write to jo.do@mail.example.com" if i % 5 == 0 else ""), "en", f"s{i % 4}", None, *[None] * 6) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = c.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {(r["doc_id"], r["n_words"]) for r in quality.quality_report(docs).collect() if r["kept"]}
    texts = [(i, x, r[3]) for r in rows for i, x in [(r[0], r[1] or "")] if (i, len(x.split())) in kept]
    sets = [ngram_join.shingle_set(x, 5) for _, x, _ in texts]
    near = lambda a, b: 100 * (n := len(set(a.tolist()) & set(b.tolist()))) >= 80 * (len(a) + len(b) - n)
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is not None and texts[j][0] is not None and (texts[i][0] == texts[j][0] or near(sets[i], sets[j])):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, x in enumerate(texts):
        groups.setdefault(find(i), []).append(x)
    single = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    field = personal_data.Field(personal_data.learnt_weights())
    masked = {i: (personal_data.masked_text(x, personal_data.personal_spans(x, field)[1]), s) for i, x, s in single}
    taken = Counter()
    frame = spark.createDataFrame([(i, x, s) for i, (x, s) in masked.items()], "doc_id long, text string, source string")
    for r in mixing.mix(frame).collect():
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out) == Counter({k: v for k, v in taken.items() if v})
    s = segmentation.segmenter(c.tokenizer_path("piece_bpe_32k.model"), 0.1, 11)
    assert all(s.decode(__import__("numpy").array(r["ids"])).decode() == masked[r["doc_id"]][0] and r["n_pieces"] == len(r["ids"]) for r in out)
