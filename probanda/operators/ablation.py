"""Tables of ablations: arms of a study against its base, over repeats, with what was left out and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from . import stats

#: How much more an image may vary over an arm's repeats than over the base's (fixed value).
SLACK = 1e-6


def complete_repeats(captures: DataFrame, times: DataFrame, base: str) -> DataFrame:
    """study, arm, repeat, problem (null for complete ones) of every repeat. captures: (study, arm, repeat, image, digest: null if unreadable, error against the base: null if not compared); times: (study, arm, repeat, ms).

    A study's images are those of the first repeat of its base that can be read. Problems: unreadable, image_set_differs, missing_timing (where an arm has several repeats and
    timings of some)."""
    each = captures.groupBy("study", "arm", "repeat").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("digest").isNull()).alias("_unread"))
    first = each.where((F.col("arm") == base) & (F.col("_unread") == 0)).groupBy("study").agg(F.min("repeat").alias("repeat"))
    expected = captures.where(F.col("arm") == base).join(first, ["study", "repeat"]).select("study", "image")
    shared = captures.join(expected, ["study", "image"], "left_semi").groupBy("study", "arm", "repeat").agg(F.count(F.lit(1)).alias("_shared"))
    wanted = expected.groupBy("study").agg(F.count(F.lit(1)).alias("_wanted"))
    timed = times.where("ms > 0 and ms < double('inf')").select("study", "arm", "repeat").distinct().withColumn("_timed", F.lit(1))
    w = Window.partitionBy("study", "arm")
    j = each.join(shared, ["study", "arm", "repeat"], "left").join(wanted, "study", "left").join(timed, ["study", "arm", "repeat"], "left")
    j = j.withColumns({"_some": F.count("_timed").over(w), "_repeats": F.count(F.lit(1)).over(w)})
    same = (F.col("n") == F.col("_wanted")) & (F.col("_shared") == F.col("_wanted"))
    problem = F.when(F.col("_unread") > 0, "unreadable").when(~F.coalesce(same, F.lit(False)), "image_set_differs").when(F.col("_timed").isNull() & (F.col("_some") > 0) & (F.col("_repeats") > 1), "missing_timing")
    return j.select("study", "arm", "repeat", problem.alias("problem"))


def ablation(captures: DataFrame, times: DataFrame, base: str) -> DataFrame:
    """study, arm, status, repeats, left_out, images, mean, unstable, median, shift, place of every arm but the base.

    status: accepted, unstable (images vary more over its repeats than over the base's), excluded (no complete repeat), no_base. Each
    arm speaks through its first complete repeat. Means are over the images that were compared in all accepted arms of the study, so that an arm in which
    one image fails changes the others' means too, and an excluded one does not. shift: Hodges-Lehmann difference of its timings from the base's. place: 1 + the number of accepted arms
    that are faster by more than the range of the base's own timings; arms within it share a place."""
    repeats = written(complete_repeats(captures, times, base), "repeats")
    key = ["study", "arm"]
    summed = repeats.groupBy(*key).agg(F.count_if(F.col("problem").isNull()).alias("repeats"), F.count("problem").alias("left_out"), F.min(F.when(F.col("problem").isNull(), F.col("repeat"))).alias("_first"))
    based = summed.where((F.col("arm") == base) & (F.col("repeats") > 0)).select("study", F.lit(True).alias("_based"))
    arms = written(summed.where(F.col("arm") != base).join(based, "study", "left"), "arms")
    whole = repeats.where("problem is null").select(*key, "repeat")
    rows = captures.join(whole, [*key, "repeat"])

    spread = rows.groupBy(*key, "image").agg(F.count_distinct("digest").alias("_d"), (F.max("error") - F.min("error")).alias("_range"))
    own = spread.where(F.col("arm") == base).select("study", "image", F.col("_range").alias("_base_range"))
    unstable = spread.where((F.col("arm") != base) & (F.col("_d") > 1)).join(own, ["study", "image"], "left").where(F.coalesce("_range", F.lit(1.0)) > F.coalesce("_base_range", F.lit(0.0)) + SLACK).groupBy(*key).agg(F.count(F.lit(1)).alias("unstable"))

    accepted = arms.where("repeats > 0 and _based").select(*key, "_first")
    first = rows.join(accepted, key).where(F.col("repeat") == F.col("_first")).select(*key, "image", "error")
    n = accepted.groupBy("study").agg(F.count(F.lit(1)).alias("_arms"))
    common = first.where("error is not null").groupBy("study", "image").agg(F.count(F.lit(1)).alias("_in")).join(n, "study").where("_in = _arms").select("study", "image")
    means = first.join(common, ["study", "image"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("images"), F.avg("error").alias("mean"))

    timed = times.where("ms > 0 and ms < double('inf')").join(whole, [*key, "repeat"]).select(*key, F.col("ms").alias("value"))
    of_base = timed.where(F.col("arm") == base)
    noise = of_base.groupBy("study").agg((F.max("value") - F.min("value")).alias("_noise"))
    against = accepted.select(*key).join(of_base.select("study", "value"), "study")
    shifts = stats.shift(timed.join(accepted.select(*key), key, "left_semi"), against, key)
    medians = timed.groupBy(*key).agg(F.percentile("value", F.lit(0.5)).alias("median"))

    out = arms.join(means, key, "left").join(unstable, key, "left").join(medians, key, "left").join(shifts, key, "left").join(noise, "study", "left")
    status = F.when(F.col("_based").isNull(), "no_base").when(F.col("repeats") == 0, "excluded").when(F.col("unstable") > 0, "unstable").otherwise("accepted")
    out = written(out.withColumn("status", status), "table")
    ranked = out.where("status = 'accepted' and shift is not null")
    # Arms of a study are few beside its images and repeats; each is compared with the others of its study.
    faster = ranked.select("study", F.col("shift").alias("_other")).join(ranked.select(*key, "shift", "_noise"), "study").groupBy(*key).agg((1 + F.count_if(F.col("_other") < F.col("shift") - F.col("_noise"))).alias("place"))
    return out.join(faster, key, "left").select(*key, "status", "repeats", "left_out", F.coalesce("images", F.lit(0)).alias("images"), "mean", F.coalesce("unstable", F.lit(0)).alias("unstable"), F.when(F.col("status").isin("accepted", "unstable"), F.col("median")).alias("median"), "shift", "place")
