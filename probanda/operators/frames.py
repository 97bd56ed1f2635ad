"""Ordered frames: gaps, steps, settling, warm-up, temporal energy."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import upper_median


def gaps(frames: DataFrame, group: list[str], listed: int = 32) -> DataFrame:
    """Missing indexes by group: total, and the first gaps as (after, missing)."""
    w = Window.partitionBy(*group).orderBy("index")
    g = frames.withColumn("after", F.lag("index").over(w)).withColumn("missing", F.col("index") - F.col("after") - 1)
    holes = g.where("missing > 0").withColumn("_n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_n") <= listed, F.struct("after", "missing"))))
    return holes.groupBy(*group).agg(F.sum("missing").alias("total"), F.count(F.lit(1)).alias("n_gaps"), F.to_json(first).alias("first_gaps"))


def violations(frames: DataFrame, group: list[str]) -> DataFrame:
    """Frames whose index or time does not rise strictly."""
    w = Window.partitionBy(*group).orderBy("seq")
    return frames.withColumn("_i", F.lag("index").over(w)).withColumn("_t", F.lag("t").over(w)).where("index <= _i or t <= _t").drop("_i", "_t")


def step_constancy(frames: DataFrame, group: list[str], pct: float = 5.0) -> DataFrame:
    """Upper median of time per index step, and whether all steps lie within pct of it."""
    w = Window.partitionBy(*group).orderBy("index")
    steps = frames.withColumn("step", (F.col("t") - F.lag("t").over(w)) / (F.col("index") - F.lag("index").over(w))).where("step is not null")
    mid = steps.groupBy(*group).agg(upper_median(F.col("step")).alias("median"), F.min("step").alias("least"), F.max("step").alias("most"), F.count(F.lit(1)).alias("n"))
    far = F.greatest(F.abs(F.col("least") - F.col("median")), F.abs(F.col("most") - F.col("median")))
    return mid.withColumn("constant", far <= pct / 100 * F.abs("median"))


def settling(frames: DataFrame, group: list[str], change: int, k: int, limit: float) -> DataFrame:
    """First frame from the change on that begins k frames in a row within the limit; null if none does."""
    ahead = Window.partitionBy(*group).orderBy("index").rowsBetween(0, k - 1)
    ok = (F.col("index") >= change) & (F.max("err").over(ahead) <= limit) & (F.count("err").over(ahead) == k)
    return frames.withColumn("_ok", ok).groupBy(*group).agg(F.min(F.when(F.col("_ok"), F.col("index"))).alias("settled"))


def onset(frames: DataFrame, group: list[str], change: int, limit: float) -> DataFrame:
    """First frame that departs from the first by more than the limit, and its lag behind the declared change."""
    start = F.first("value").over(Window.partitionBy(*group).orderBy("index"))
    off = frames.withColumn("_off", F.abs(F.col("value") - start) > limit)
    return off.groupBy(*group).agg(F.min(F.when(F.col("_off"), F.col("index"))).alias("onset")).withColumn("lag", F.col("onset") - change)


def pop(frames: DataFrame, group: list[str]) -> DataFrame:
    """Largest rise of the candidate beyond the baseline's motion, at its earliest."""
    w = Window.partitionBy(*group).orderBy("index")
    rise = F.greatest(F.lit(0.0), F.abs(F.col("candidate") - F.lag("candidate").over(w)) - F.abs(F.col("baseline") - F.lag("baseline").over(w)))
    out = frames.withColumn("pop", rise).where(F.col("index") > F.lit(-1))
    best = F.max(F.struct(F.col("pop"), -F.col("index")))
    return out.where("pop is not null").groupBy(*group).agg(best.alias("_b")).select(*group, F.col("_b.pop").alias("pop"), (-F.col("_b.col2")).alias("at"))


def instability(frames: DataFrame, group: list[str]) -> DataFrame:
    """Mean change between consecutive frames of the capture less that of the baseline; the worst frame, earliest on ties."""
    w = Window.partitionBy(*group).orderBy("index")
    change = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    out = frames.withColumn("_c", change("capture")).withColumn("_b", change("baseline"))
    worst = F.max_by("index", F.struct(F.col("_c"), -F.col("index")))
    return out.where("_c is not null").groupBy(*group).agg((F.avg("_c") - F.avg("_b")).alias("instability"), worst.alias("worst"))


def temporal_energy(frames: DataFrame, group: list[str]) -> DataFrame:
    """Population variance of deltas, and mean squared second difference over 4."""
    w = Window.partitionBy(*group).orderBy("index")
    d = frames.withColumn("_d", F.col("value") - F.lag("value").over(w)).withColumn("_s", F.col("value") - 2 * F.lag("value", 1).over(w) + F.lag("value", 2).over(w))
    return d.groupBy(*group).agg(F.var_pop("_d").alias("delta_variance"), (F.avg(F.col("_s") * F.col("_s")) / 4).alias("second_energy"))


def warm_up(frames: DataFrame, group: list[str], window: int = 16, mean: float = 0.02, cv: float = 0.03, slope: float = 0.001) -> DataFrame:
    """Of the last two windows: absolute change of their means by the larger, and population CV and slope by frame, by the mean, of both together; converged where none is beyond its limit. Groups with fewer frames are left out."""
    back = frames.withColumn("_b", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("index").desc()))).where(F.col("_b") <= 2 * window)
    last, first = F.when(F.col("_b") <= window, F.col("value")), F.when(F.col("_b") > window, F.col("value"))
    out = back.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.avg(first).alias("_f"), F.avg(last).alias("_l"), (F.stddev_pop("value") / F.avg("value")).alias("cv"), (F.regr_slope("value", -F.col("_b")) / F.avg("value")).alias("slope"))
    out = out.where(F.col("_n") == 2 * window).withColumn("mean_change", F.abs(F.col("_l") - F.col("_f")) / F.greatest("_f", "_l"))
    return out.select(*group, "mean_change", "cv", "slope", ((F.col("mean_change") <= mean) & (F.col("cv") <= cv) & (F.abs("slope") <= slope)).alias("converged"))


def motion(frames: DataFrame, group: list[str]) -> DataFrame:
    """Upper median interval, share of hitches (beyond 1.5 medians), population CV, share of frozen frames."""
    w = Window.partitionBy(*group).orderBy("index")
    d = frames.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("_same", (F.col("value") == F.lag("value").over(w)).cast("int")).where("dt is not null")
    m = d.groupBy(*group).agg(upper_median(F.col("dt")).alias("median_dt"), (F.stddev_pop("dt") / F.avg("dt")).alias("cv"), F.avg("_same").alias("frozen"), F.collect_list("dt").alias("_all"))
    hitch = F.size(F.filter("_all", lambda x: x > 1.5 * F.col("median_dt"))) / F.size("_all")
    return m.withColumn("hitches", hitch).drop("_all")


def runs_over(points: DataFrame, group: list[str], limit: float) -> DataFrame:
    """Contiguous stretches above the limit as (start, length)."""
    w = Window.partitionBy(*group).orderBy("index")
    hot = points.where(F.col("err") > limit).withColumn("_g", F.col("index") - F.row_number().over(w))
    return hot.groupBy(*group, "_g").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def bisect(verdicts: DataFrame, group: list[str]) -> DataFrame:
    """Of an ordered series of good, bad or skip: the last good before the first bad, skips between them, and whether a good follows a bad."""
    bad, good = F.when(F.col("verdict") == "bad", F.col("index")), F.when(F.col("verdict") == "good", F.col("index"))
    edges = verdicts.groupBy(*group).agg(F.min(bad).alias("first_bad"), F.max(good).alias("_last"))
    both = verdicts.join(edges, group)
    out = both.groupBy(*group).agg(F.max("first_bad").alias("first_bad"), F.max(F.when((F.col("verdict") == "good") & (F.col("index") < F.col("first_bad")), F.col("index"))).alias("last_good"), F.max("_last").alias("_last"))
    return out.withColumn("non_monotonic", F.coalesce(F.col("_last") > F.col("first_bad"), F.lit(False))).drop("_last")


def animation(frames: DataFrame, group: list[str], frame_error: float, local_error: float, flicker: float) -> DataFrame:
    """By group of (index, raw, local, residual or null where unsupported): first frame beyond an error budget, largest flicker (null where a frame after the first has none), first frame of too much flicker, and the verdict; what is unsupported is a regression."""
    w = Window.partitionBy(*group).orderBy("index")
    f = frames.withColumn("_later", F.row_number().over(w) > 1)
    change = F.when(F.col("_later"), F.col("residual"))
    out = f.groupBy(*group).agg(
        F.min(F.when((F.col("raw") > frame_error) | (F.col("local") > local_error), F.col("index"))).alias("first_divergence"), F.min(F.when(change > flicker, F.col("index"))).alias("first_flicker"),
        F.max(change).alias("_most"), F.bool_and(~F.col("_later") | F.col("residual").isNotNull()).alias("_whole"))
    fine = F.col("first_divergence").isNull() & F.col("first_flicker").isNull() & F.col("_whole")
    return out.select(*group, "first_divergence", "first_flicker", F.when(F.col("_whole"), F.coalesce("_most", F.lit(0.0))).alias("flicker"), F.when(fine, "pass").otherwise("regression").alias("verdict"))


def spectrum(frames: DataFrame, group: list[str], bands: int = 3) -> DataFrame:
    """Energy of each of the equal bands of frequencies of a series about its mean: squared amplitudes at 1 to n / 2 cycles a series. Series are Spark's groups, each transformed at once; those of fewer than four values have none."""

    def energies(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("index")["value"].to_numpy(float)
        half = len(x) // 2
        if len(x) < 4:
            return pd.DataFrame([], columns=[*group, "band", "energy"])
        power = np.abs(np.fft.rfft(x - x.mean())[1 : half + 1]) ** 2 / len(x) ** 2
        band = np.minimum(np.arange(half) * bands // half, bands - 1)
        there = np.unique(band)
        return pd.DataFrame([(*key, int(k), float(power[band == k].sum())) for k in there], columns=[*group, "band", "energy"])

    kinds = dict(frames.dtypes)
    shape = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", band int, energy double"
    return frames.where("value is not null").select(*group, "index", F.col("value").cast("double").alias("value")).groupBy(*group).applyInPandas(energies, shape)


def spectral_distance(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """By group: the sum of absolute differences of band energies; a band that one side lacks has none."""
    j = a.withColumnRenamed("energy", "_a").join(b.withColumnRenamed("energy", "_b"), [*group, "band"], "full_outer")
    return j.groupBy(*group).agg(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("distance"))


def shannon_distance(a: DataFrame, b: DataFrame, group: list[str], bin: str = "bin") -> DataFrame:
    """Jensen-Shannon distance in nats of two histograms (group.., bin, n) by group; null where a side is empty."""
    share = lambda df, name: df.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*group))).select(*group, bin, name)
    j = share(a, "_p").join(share(b, "_q"), [*group, bin], "full_outer").withColumn("_p", F.coalesce("_p", F.lit(0.0))).withColumn("_q", F.coalesce("_q", F.lit(0.0)))
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(2 * F.col(x) / (F.col("_p") + F.col("_q"))) / 2).otherwise(0.0)
    return j.groupBy(*group).agg(F.when((F.sum("_p") > 0) & (F.sum("_q") > 0), F.sum(half("_p") + half("_q"))).alias("js_nats"))
