import duckdb

from probanda.llm import licences as l

from .conftest import prose


WRAPPED = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction"


def test_signs_lose_nothing():
    """What holds SHARED of a notice's pairs has a sign."""
    for v in l.NOTICES.values():
        for pairs in map(l._pairs, v):
            without = [p for p in pairs if not any(w in p.split() for w in l.signs())]
            assert len(without) < l.SHARED * len(pairs)


def test_held_out_lines():
    m = l.model()
    lines = l.generated(91)
    assert sum(m.predict(t)[0] == k for k, t in lines) / len(lines) > 0.93


def test_however_lines_are_broken(spark):
    """Notices with few or many words a line, lines of thousands of characters, notices amid other words: the paragraph tells."""
    words, filler = WRAPPED.split(), prose(9, 400)
    wrap = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    texts = [wrap(words, n) for n in range(1, 13)] + [" ".join(words[:9]) + "\n" + " ".join(words[9:]) + " " + filler, filler + " " + " ".join(words) + " " + filler, (filler + "\n") * 3 + wrap(words, 4) + "\n" + filler]
    texts += [wrap(words, 4) + "\n" + wrap("Licensed under CC BY-NC 4.0.".split(), 2) + "\n" + filler]
    got = {x["doc_id"]: x["families"] for x in l.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(filler) > 1500 and [got[i] for i in range(len(texts))] == ["MIT"] * (len(texts) - 1) + ["CC-BY-NC,MIT"]


def test_table_against_sql(spark, edges, nothing):
    special = ["LICENSE\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.", "licence", "copyright é", "x\n// SPDX-License-Identifier: ISC\ny", "SPDX-License-Identifier: Unlicense.", "SPDX-License-Identifier: Vim", WRAPPED, WRAPPED.replace("\n", "\n\n"), prose(6, 200) + "\n" + WRAPPED + "\n\n \n" + prose(7, 50)]
    extra = special + [t for v in l.NOTICES.values() for t in v] + l.HARMLESS
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 1000)), "doc_id long, text string"))
    got = l.licences(docs).toPandas()
    documents = docs.toPandas()  # noqa: F841  (read by name)
    want = duckdb.sql(l.licences_sql()).df()
    norm = lambda d: sorted(map(str, d.astype(str).values.tolist()))
    assert norm(got[sorted(got)]) == norm(want[sorted(want)].assign(doc_id=want["doc_id"].astype(got["doc_id"].dtype)))
    by = got.set_index("doc_id")
    assert by.loc[range(1000, 1000 + len(special)), "families"].tolist() == ["CC-BY-NC,MIT", "", "", "ISC", "Unlicense", "", "MIT", "", "MIT"]
    assert (by.loc[[1000 + len(extra) - i - 1 for i in range(len(l.HARMLESS))], "families"] == "").all()
    notices = [(k, i) for i, k in enumerate((k for k, v in l.NOTICES.items() for _ in v), 1000 + len(special))]
    assert sum(by.loc[i, "families"] == k for k, i in notices) >= len(notices) - 1
    assert l.licences(nothing).count() == 0
    assert "Python" not in l.licences(docs)._jdf.queryExecution().executedPlan().toString()
