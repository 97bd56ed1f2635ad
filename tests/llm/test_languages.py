import random

from probanda.llm import languages as l

from .conftest import prose


def count_phrases(text, known):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in known:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_substring_search():
    r = random.Random(1)
    samples = {"x": "".join(r.choice("abc ") for _ in range(300)), "y": "".join(r.choice("abd ") for _ in range(200))}
    parser = l.CrossParser(samples)
    texts = ["".join(r.choice("abcdez ") for _ in range(r.randrange(1, 200))) for _ in range(60)] + [""]
    got = parser.phrases(texts)
    for text, counts in zip(texts, got, strict=True):
        assert counts.tolist() == [count_phrases(text, samples[k]) for k in ("x", "y")], text


def test_whole_texts_in_pieces(monkeypatch):
    """The phrases of pieces that carry on are those of one parse, in repetitive texts too."""
    monkeypatch.setattr(l, "PIECE", 7)
    monkeypatch.setattr(l, "LANES", 5)
    r = random.Random(2)
    samples = {"x": "abcd" * 50, "y": "".join(r.choice("ab ") for _ in range(300)), "z": "".join(chr(0x4E00 + r.randrange(40)) for _ in range(400))}
    texts = ["abcd" * 100, "ab" * 60, "", "d", "".join(r.choice("abcd ") for _ in range(500)), samples["z"][30:90] * 3, samples["y"][5:200] + samples["z"][9:80]]
    for dense in (2, 95):
        monkeypatch.setattr(l, "DENSE", dense)
        for text, counts in zip(texts, l.CrossParser(samples).phrases(texts), strict=True):
            assert counts.tolist() == [count_phrases(text, samples[k]) for k in sorted(samples)], text


def test_large_scripts():
    """Two languages of 700 ideographs each beside one of Latin letters."""
    r = random.Random(4)
    words = {k: ["".join(chr(0x4E00 + 350 * i + r.randrange(700)) for _ in range(2)) for _ in range(300)] for i, k in enumerate(("ja", "zh"))}
    text_of = {k: lambda w=w: "".join(r.choice(w) for _ in range(60)) for k, w in words.items()} | {"en": lambda: prose(r.randrange(10**6), 40)}
    parser = l.CrossParser({k: " ".join(f() for _ in range(60)) for k, f in text_of.items()})
    want = [k for k in text_of for _ in range(33)]
    got, _ = parser.predict([text_of[k]() for k in want])
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 97
    assert parser.predict(["²½ 12", "_", "é"])[0][:2] == ["und", "und"]


def test_the_sample_has_whole_rows(spark):
    rows = [(i, f"row {i} " + prose(i, 40), "aa") for i in range(300)] + [(1000 + i, prose(i, 9000), "bb") for i in range(8)]
    found = l.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40_000)
    assert found["bb"] in {l.normal(t) for _, t, k in rows if k == "bb"}
    for text in {l.normal(t).strip() for _, t, k in rows if k == "aa"}:
        head = text[:40]
        assert head not in found["aa"] or text in found["aa"]
    assert 10_000 < len(found["aa"]) <= 20_000


def test_table(spark, edges, nothing):
    swap = str.maketrans("aeiou", "oieua")
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).translate(swap), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = l.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    odd = {r["doc_id"]: r for r in l.identify(edges).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert l.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in l.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false").union(docs.selectExpr("doc_id", "text", "cast(null as string)"))).collect()} == {"und"}
