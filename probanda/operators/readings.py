"""Text that was read off pictures: words of recognition tables, phrases and how sure they are, and gates on critical regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .scopes import SQUARE

#: The header of a recognition table and the level of its words (fixed by the format).
HEADER, WORD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "5"


def tsv_words(files: DataFrame) -> DataFrame:
    """page, slot (page/block/paragraph/line/word), line (the slot without its word), at, x, y, w, h, confidence, text of every word in tables (page, content, width, height) of tab-separated recognition; and `problem`: header, malformed, or outside (a box beyond the picture) for tables and rows that are not words that can be used. Empty words and rows of other levels are left out."""
    f = files.withColumn("_lines", F.split("content", "\r?\n", -1)).withColumn("_ok", F.coalesce(F.get("_lines", F.lit(0)) == HEADER, F.lit(False)))
    rows = f.select("page", "width", "height", "_ok", F.explode(F.when(F.col("_ok"), F.expr("filter(slice(_lines, 2, size(_lines)), x -> x <> '')")).otherwise(F.array(F.lit("")))).alias("_row"))
    part = F.split("_row", "\t", 12)
    rows = rows.withColumn("_p", part)
    number = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    rows = rows.withColumns({"x": number(6), "y": number(7), "w": number(8), "h": number(9), "confidence": number(10), "text": F.get("_p", F.lit(11))})
    whole = F.size("_p") == 12
    wanted = ~F.col("_ok") | ~whole | ((F.get("_p", F.lit(0)) == WORD) & (F.col("text") != ""))
    numbers = F.lit(True)
    for c in ("x", "y", "w", "h", "confidence"):
        numbers = numbers & F.col(c).isNotNull()
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    problem = F.when(~F.col("_ok"), "header").when(~whole | ~numbers, "malformed").when(outside, "outside")
    slot = lambda n: F.array_join(F.slice("_p", 2, n), "/")
    use = rows.where(wanted).withColumn("problem", problem)
    return use.select("page", F.when(whole, slot(5)).alias("slot"), F.when(whole, slot(4)).alias("line"), F.get("_p", F.lit(5)).try_cast("int").alias("at"), "x", "y", "w", "h", "confidence", "text", "problem")


def text_lines(words: DataFrame) -> DataFrame:
    """page, line, text (words joined by a space, in the order of `at`) and words: begin, end (places in the text) and confidence of each. words: (page, line, at, text, confidence)."""
    w = words.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("at", "text", "confidence"))).alias("_w"))
    step = lambda s, x: F.struct(F.concat(s["done"], F.array(F.struct(s["next"].alias("begin"), (s["next"] + F.length(x["text"])).alias("end"), x["confidence"].alias("confidence")))).alias("done"), (s["next"] + F.length(x["text"]) + 1).alias("next"))
    start = F.struct(F.array().cast(f"array<struct<begin:int,end:int,confidence:{dict(words.dtypes)['confidence']}>>").alias("done"), F.lit(0).alias("next"))
    return w.select("page", "line", F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("text"), F.aggregate("_w", start, step)["done"].alias("words"))


def places(text: Column, phrase: Column) -> Column:
    """Where the phrase begins in the text, from 0, without overlaps."""
    parts = F.split(text, F.concat(F.lit("\\Q"), phrase, F.lit("\\E")), F.lit(-1))
    before = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x)) + (k - 1) * F.length(phrase)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), before)).otherwise(F.array().cast("array<int>"))


def expected_readings(words: DataFrame, expected: DataFrame, least: float) -> DataFrame:
    """present and readable of each expected phrase (page, phrase) among the lines of its page. A reading is sure if all words that it touches have a confidence of `least` or more, unsure if one has less, and unknown if one has none.

    readable: true if any reading is sure; else null if any is unknown; else false, as where there is none. Empty phrases are in no line."""
    lines = text_lines(words)
    j = expected.select("page", "phrase").distinct().join(lines, "page", "left")
    touched = lambda p: F.filter("words", lambda w: (w["end"] > p) & (w["begin"] < p + F.length("phrase")))
    sure = lambda ws: F.when(F.exists(ws, lambda w: w["confidence"].isNull()), None).otherwise(F.forall(ws, lambda w: w["confidence"] >= least))
    found = F.when((F.col("phrase") != "") & F.col("text").isNotNull(), F.transform(places(F.col("text"), F.col("phrase")), lambda p: sure(touched(p))))
    j = j.withColumn("_r", F.coalesce(found, F.array().cast("array<boolean>")))
    g = j.groupBy("page", "phrase").agg(F.sum(F.size("_r")).alias("_n"), F.sum(F.size(F.filter("_r", lambda x: x))).alias("_sure"), F.sum(F.size(F.filter("_r", lambda x: x.isNull()))).alias("_unknown"))
    return g.select("page", "phrase", (F.col("_n") > 0).alias("present"), F.when(F.col("_sure") > 0, True).when(F.col("_unknown") == 0, False).alias("readable"))


def _squares(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
    """df once for each square that its box touches."""
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / SQUARE), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(0.0))) / SQUARE)))
    return df.withColumn("_sx", span(x, w)).withColumn("_sy", span(y, h))


def region_texts(regions: DataFrame, sources: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """page, region, side, text, accepted and reason of what each side's source says in each region.

    regions: (page, region, x, y, w, h, accepted array); sources: (page, side, ocr, complete, width, height); nodes: (page, side, text, x, y, w, h, confidence). accepted is null with a
    reason: unavailable (no source), unlocated or invalid_geometry (some text of the page has no box, or none that can be), crosses_boundary, several_units, no_text (false instead if the source is complete and not recognition), unsure (recognition below
    `least`), incomplete. Texts must be equal to one of those accepted, to the last space."""
    n = nodes.join(sources.select("page", "side", "width", "height"), ["page", "side"])
    bad = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0) | (F.col("h") <= 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    lost = F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull()
    state = n.groupBy("page", "side").agg(F.max(lost).alias("_lost"), F.max(F.coalesce(bad, F.lit(False))).alias("_bad"))
    box = regions.select("page", "region", *[F.col(c).cast("double").alias(f"_{c}") for c in "xywh"])
    placed = written(n.where(~lost & ~bad).select("page", "side", "text", *[F.col(c).cast("double").alias(c) for c in "xywh"], "confidence").withColumn("_node", F.monotonically_increasing_id()), "nodes")
    near = _squares(placed, "x", "y", "w", "h")
    j = near.join(_squares(box, "_x", "_y", "_w", "_h"), ["page", "_sx", "_sy"]).where("x < _x + _w and y < _y + _h and x + w > _x and y + h > _y")
    j = j.dropDuplicates(["page", "region", "side", "_node"])
    crosses = F.expr("x < _x or y < _y or x + w > _x + _w or y + h > _y + _h")
    held = j.groupBy("page", "region", "side").agg(F.max(crosses).alias("_crosses"), F.count(F.lit(1)).alias("_n"), F.min("text").alias("_text"), F.min("confidence").alias("_c"), F.count("confidence").alias("_sure"))
    sides = F.explode(F.array(F.lit("baseline"), F.lit("candidate"))).alias("side")
    all_rows = regions.select("page", "region", F.col("accepted").alias("_accepted"), sides)
    r = all_rows.join(sources.select("page", "side", "ocr", "complete"), ["page", "side"], "left").join(state, ["page", "side"], "left").join(held, ["page", "region", "side"], "left")
    units, crossed = F.coalesce("_n", F.lit(0)), F.coalesce("_crosses", F.lit(False))
    reason = F.when(F.col("ocr").isNull(), "unavailable").when(F.coalesce("_lost", F.lit(False)), "unlocated").when(F.coalesce("_bad", F.lit(False)), "invalid_geometry").when(crossed, "crosses_boundary").when(units > 1, "several_units").when(units == 0, "no_text")
    reason = reason.when(F.col("ocr") & ((F.col("_sure") < 1) | (F.col("_c") < least)), "unsure").when(~F.col("ocr") & ~F.col("complete"), "incomplete")
    r = r.withColumn("reason", reason)
    empty = (F.col("reason") == "no_text") & ~F.col("ocr") & F.col("complete")
    one = (units == 1) & (F.col("reason").isNull() | F.col("reason").isin("unsure", "incomplete"))
    text = F.when(one, F.col("_text")).when(empty, "")
    accepted = F.when(empty, False).when(F.col("reason").isNull(), F.array_contains("_accepted", F.col("_text")))
    return r.select("page", "region", "side", text.alias("text"), accepted.alias("accepted"), "reason")


def critical_text(regions: DataFrame, sources: DataFrame, nodes: DataFrame, legible: DataFrame, least: float) -> DataFrame:
    """page, region, state: fail (the candidate's text is none of those accepted, or cannot be read), pass (both sides' texts are accepted and can be read), else insufficient_evidence. legible: (page, region, side, legible), null or absent where it was not measured."""
    t = region_texts(regions, sources, nodes, least).join(legible.select("page", "region", "side", "legible"), ["page", "region", "side"], "left")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    g = t.groupBy("page", "region").agg(*[of(s, c).alias(f"_{s}_{c}") for s in ("baseline", "candidate") for c in ("accepted", "legible")])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    state = F.when(no("_candidate_accepted") | no("_candidate_legible"), "fail").when(yes("_baseline_accepted") & yes("_baseline_legible") & yes("_candidate_accepted") & yes("_candidate_legible"), "pass").otherwise("insufficient_evidence")
    return g.select("page", "region", state.alias("state"))


def page_verdicts(states: DataFrame) -> DataFrame:
    """page, state: fail if any region fails, pass if all pass, else insufficient_evidence."""
    s = F.col("state")
    return states.groupBy("page").agg(F.when(F.count_if(s == "fail") > 0, "fail").when(F.count_if(s != "pass") == 0, "pass").otherwise("insufficient_evidence").alias("state"))
