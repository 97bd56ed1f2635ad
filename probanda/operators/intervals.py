"""Cues (group, cue, text, start, end) and observations (group, obs, text, t)."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def roundoff(a: Column, b: Column) -> Column:
    """How far sums of these doubles may be off."""
    return F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * (8 * sys.float_info.epsilon)


def exceeds(start: Column, end: Column, limit: float) -> Column:
    """Whether a gap is beyond its limit by more than rounding; a limit of 0 is exact."""
    return end - start > 0 if limit == 0 else end - start - limit > roundoff(start, end)


def _near(cues: DataFrame, observations: DataFrame, search: float, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Cues and observations of equal keys not much more than search seconds apart. Both sides are cut into time buckets, so that the range join is an equi-join."""
    size = bucket or max(search, 1.0)
    wide = cues.withColumn("_k", F.explode(F.sequence(F.floor((F.col("start") - search) / size), F.floor((F.col("end") + search) / size))))
    return observations.withColumn("_k", F.floor(F.col("t") / size)).join(wide, [*keys, "_k"]).drop("_k")


def assign(cues: DataFrame, observations: DataFrame, search: float, bucket: float | None = None) -> DataFrame:
    """The cue of each observation: one of equal text whose [start, end) holds it, else the nearest that begins within search seconds or ended less than that ago, up to rounding. An equal best leaves it ambiguous, assigned to none. Observations without text have none."""
    t, start, end = F.col("t"), F.col("start"), F.col("end")
    near = _near(cues, observations.where("text <> ''"), search, ["group", "text"], bucket)
    inside = (t >= start) & (t < end)
    beyond = F.lit(True) if search == 0 else t - end >= search - roundoff(t, end)
    near = near.where(~((t < start) & exceeds(t, start, search)) & ~((t >= end) & beyond))
    away = F.when(inside, 0.0).when(t < start, start - t).otherwise(t - end)
    near = near.withColumn("_in", inside.cast("int")).withColumn("_away", away)
    w = Window.partitionBy("group", "obs")
    best = near.withColumn("_top", F.max("_in").over(w)).where("_in = _top").withColumn("_least", F.min("_away").over(w)).where(F.col("_away") - F.col("_least") <= roundoff(t, end))
    best = best.groupBy("group", "obs").agg(F.count(F.lit(1)).alias("_n"), F.min("cue").alias("_cue"), F.max("_in").alias("_in"))
    return observations.select("group", "obs").join(best, ["group", "obs"], "left").select("group", "obs", F.when(F.col("_n") == 1, F.col("_cue")).alias("cue"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("ambiguous"), F.when(F.col("_n") == 1, F.col("_in") == 1).alias("active"))


def islands(observations: DataFrame, limit: float) -> DataFrame:
    """Stretches of observations of one text with gaps up to the limit."""
    w = Window.partitionBy("group", "text").orderBy("t", "obs")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(w) > limit).cast("int"), F.lit(1))
    numbered = observations.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w))
    return numbered.groupBy("group", "text", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))


def findings(cues: DataFrame, observations: DataFrame, search: float, gap: float, slack: float) -> DataFrame:
    """What is wrong with each cue: missing, text_mismatch, early, late, persists_after_end, ends_before_end, interrupted, illegible; whether its window is covered; and its legibility.

    Observations are (group, obs, text or null where unknown, t, legible or null). A window is covered if
    every sample in it is known and unambiguous and no gap in it, or at its edges, is beyond `gap`; only a
    covered window shows that text is missing, ends early or is interrupted."""
    t, start, end = F.col("t"), F.col("start"), F.col("end")
    seen = observations.join(assign(cues, observations, search).withColumnRenamed("cue", "_own"), ["group", "obs"])
    mine = seen.where("_own is not null").groupBy("group", F.col("_own").alias("cue")).agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.bool_or(~F.col("legible")).alias("_bad"), F.bool_and(F.coalesce("legible", F.lit(False))).alias("_good"))
    c = cues.join(mine, ["group", "cue"], "left")
    rows = _near(c.select("group", "cue", "start", "end", "_first"), seen, search, ["group"]).where((t >= start) & (t < end + search))
    known = F.col("text").isNotNull() & ~F.col("ambiguous")
    w = Window.partitionBy("group", "cue").orderBy("t", "obs")
    rows = rows.withColumn("_gap", exceeds(F.coalesce(F.lag("t").over(w), start), t, gap))
    inside, onset = t < end, t <= F.col("_first")
    sums = rows.groupBy("group", "cue").agg(
        F.count_if(inside).alias("_n"), F.bool_and(F.when(inside, known & ~F.col("_gap"))).alias("_ok"), F.max(F.when(inside, t)).alias("_end"), F.bool_or(F.when(inside, F.coalesce(F.col("text") != "", F.lit(False)))).alias("_text"),
        F.bool_or(F.when(inside, F.coalesce(F.col("_own") != F.col("cue"), F.lit(True)))).alias("_other"), F.bool_and(F.when(onset, known & ~F.col("_gap"))).alias("_onset"))
    j = c.join(sums, ["group", "cue"], "left")
    coarse = (roundoff(start, end) >= gap) | ((slack > 0) & (roundoff(start, end) >= slack) if slack > 0 else F.lit(False))
    first, last, none = F.col("_first"), F.col("_last"), F.col("_first").isNull()
    j = j.withColumn("covered", F.coalesce(~coarse & (F.col("_n") > 0) & F.col("_ok") & ~exceeds(F.col("_end"), end, gap), F.lit(False)))
    j = j.withColumn("legibility", F.when(none, "insufficient_evidence").when(F.col("_bad"), "illegible").when(F.col("_good"), "legible").otherwise("insufficient_evidence"))
    flag = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(
        F.when(none & F.col("covered"), F.when(F.col("_text"), "text_mismatch").otherwise("missing")),
        flag(exceeds(first, start, slack), "early"), flag(F.col("_onset") & exceeds(start, first, slack), "late"), flag(exceeds(end, last, slack), "persists_after_end"),
        flag(F.col("covered") & exceeds(last, end, gap + slack), "ends_before_end"), flag(F.col("covered") & ~none & F.col("_other"), "interrupted"), flag(F.col("legibility") == "illegible", "illegible")))
    return j.select("group", "cue", "covered", "legibility", F.array_join(found, ",").alias("findings"))


def as_of(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Each left row (t) with the last right row (t, value) at or before it."""
    u = left.select(group, "t", "id", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_o")).union(right.select(group, "t", F.lit(None).cast("long").alias("id"), "value", F.lit(0).alias("_o")))
    w = Window.partitionBy(group).orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return u.withColumn("value", F.last("value", True).over(w)).where("_o = 1").select(group, "id", "t", "value")
