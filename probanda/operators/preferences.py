"""Intervals of preference strengths and of places: the whole fit over resampled votes.

A vote's number of copies in a replicate is Poisson with mean 1, as in a bootstrap over many votes; alike votes
are summed before, and their sum in a replicate is Poisson with their number as its mean. So replicates are made from
one row for each pair and answer, however many votes there were. All replicates are one table: of a small panel
each replicate is fitted in a task of its own, of a large one every round of all replicates is one join.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..sources.tables import replaced, written
from . import stats
from .running import numbered

#: Comparisons below which a candidate's interval says little (fixed value).
FEW_COMPARISONS = 5
#: Means above this are drawn by the normal law with the same mean and variance.
EXACT_MEAN = 400


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The Poisson quantiles of u (between 0 and 1) for whole means."""
    out = np.zeros(len(mean), np.int64)
    large = mean > EXACT_MEAN
    if large.any():
        z = np.array([NormalDist().inv_cdf(float(x)) for x in u[large]])
        out[large] = np.maximum(np.rint(mean[large] + np.sqrt(mean[large]) * z), 0).astype(np.int64)
    at = np.flatnonzero(~large)
    k, chance = np.zeros(len(at)), np.exp(-mean[at].astype(float))
    upto = chance.copy()
    while len(at):
        done = u[at] <= upto
        # Past the mean the chances die out; u may lie above their rounded sum.
        done |= (k > mean[at]) & (chance < 1e-300)
        out[at[done]] = k[done]
        at, k, chance, upto = at[~done], k[~done] + 1, chance[~done], upto[~done]
        chance = chance * mean[at] / k
        upto = upto + chance
    return out


@F.pandas_udf(LongType())
def _copies(votes: pd.Series, draw: pd.Series) -> pd.Series:
    u = ((draw.to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return pd.Series(poisson(votes.to_numpy(np.int64), u))


def resampled(votes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, i, j, games, wins (of i), both ways round, from votes (i, j, score of i)."""
    alike = votes.where("i <> j and score is not null").groupBy("i", "j", "score").agg(F.count(F.lit(1)).alias("votes"))
    each = alike.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.withColumn("copies", _copies("votes", F.xxhash64(F.lit(seed), "replicate", "i", "j", "score"))).where("copies > 0")
    sides = [each.select("replicate", F.col(a).alias("i"), F.col(b).alias("j"), "copies", s.alias("s")) for a, b, s in (("i", "j", F.col("score")), ("j", "i", 1 - F.col("score")))]
    return sides[0].union(sides[1]).groupBy("replicate", "i", "j").agg(F.sum("copies").cast("double").alias("games"), F.sum(F.col("copies") * F.col("s")).alias("wins"))


def _fitted_apart(pairs: DataFrame, names: list, prior: float, rounds: int) -> DataFrame:
    """Strengths of all names in every replicate, a task a replicate."""
    names = np.array(sorted(names))
    n = len(names)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        games, wins = np.full((n, n), 2 * prior), np.full(n, prior * (n - 1))
        i, j = np.searchsorted(names, rows["i"]), np.searchsorted(names, rows["j"])
        games[i, j] += rows["games"].to_numpy(float)
        np.fill_diagonal(games, 0)
        wins += np.bincount(i, rows["wins"], n)
        logs = np.zeros(n)
        for _ in range(rounds):
            p = np.exp(logs)
            new = np.log(wins) - np.log((games / (p[:, None] + p[None, :])).sum(1))
            new -= new.mean()
            moved, logs = np.abs(new - logs).max(), new
            if moved < 1e-10:
                break
        return pd.DataFrame({"replicate": key[0], "candidate": names, "strength": logs})

    return pairs.groupBy("replicate").applyInPandas(fit, f"replicate int, candidate {dict(pairs.dtypes)['i']}, strength double")


def _fitted_together(pairs: DataFrame, prior: float, rounds: int, close: float = 1e-6) -> DataFrame:
    """The same for large panels, where the prior counts between those that met only. Each round of all replicates is one join; a round replaces the table of the one before."""
    met = written(pairs.select("replicate", "i", "j", (F.col("games") + 2 * prior).alias("games"), (F.col("wins") + prior).alias("wins")), "met")
    wins = written(met.groupBy("replicate", F.col("i").alias("candidate")).agg(F.sum("wins").alias("wins")), "wins")
    now, path = replaced(wins.select("replicate", "candidate", F.lit(0.0).alias("strength"), F.lit(math.inf).alias("moved")), "strengths", None)
    for _ in range(rounds):
        side = lambda c, s: now.select("replicate", F.col("candidate").alias(c), F.col("strength").alias(s))  # noqa: E731, B023
        sums = met.join(side("i", "a"), ["replicate", "i"]).join(side("j", "b"), ["replicate", "j"]).groupBy("replicate", F.col("i").alias("candidate")).agg(F.sum(F.col("games") / (F.exp("a") + F.exp("b"))).alias("_d"))
        raw = wins.join(sums, ["replicate", "candidate"]).join(now.select("replicate", "candidate", F.col("strength").alias("_old")), ["replicate", "candidate"]).withColumn("_new", F.log(F.col("wins") / F.col("_d")))
        means = raw.groupBy("replicate").agg(F.avg("_new").alias("_mean"))
        level = raw.join(means, "replicate").withColumn("strength", F.col("_new") - F.col("_mean"))
        now, path = replaced(level.select("replicate", "candidate", "strength", F.abs(F.col("strength") - F.col("_old")).alias("moved")), "strengths", path)
        if (now.agg(F.max("moved")).first()[0] or 0) < close:
            break
    return now.select("replicate", "candidate", "strength")


def _percentile(values: Column, n: Column, q: float) -> Column:
    """The value at the rounded place (n - 1) q of an ascending array."""
    return F.element_at(values, (F.round((n - 1) * q) + 1).cast("int"))


def preference_intervals(votes: DataFrame, replicates: int = 200, confidence: float = 0.95, prior: float = 0.1, rounds: int = 500, seed: int = 1, small: int = stats.SMALL_PANEL) -> DataFrame:
    """candidate, strength, place, connected of the fit to all votes (i, j, score of i), with low, high, place_low and place_high over the
    replicates, replicates (in how many the candidate was fitted), comparisons, few (under FEW_COMPARISONS) and apart: whether its interval ends below that of the candidate before it in order of strength (null for the first).

    An array of one candidate's strengths has a value a replicate. Votes of a candidate against itself and null scores count for nothing."""
    v = written(votes.where("i <> j and score is not null"), "votes")
    fitted = written(stats.bradley_terry(v, prior, rounds, small), "fit")
    pairs = written(resampled(v, replicates, seed), "replicates")
    n = fitted.count()
    each = _fitted_apart(pairs, [r[0] for r in fitted.select("candidate").collect()], prior, rounds) if n * n <= small else _fitted_together(pairs, prior, rounds)
    placed = each.withColumn("place", F.rank().over(Window.partitionBy("replicate").orderBy(F.col("strength").desc())))
    arrays = placed.groupBy("candidate").agg(F.array_sort(F.collect_list("strength")).alias("_s"), F.array_sort(F.collect_list("place")).alias("_p"), F.count(F.lit(1)).alias("replicates"))
    tail = (1 - confidence) / 2
    ends = {f"{name}{end}": _percentile(F.col(c), F.col("replicates"), q) for name, c in (("", "_s"), ("place_", "_p")) for end, q in (("low", tail), ("high", 1 - tail))}
    sides = v.select(F.explode(F.array("i", "j")).alias("candidate")).groupBy("candidate").agg(F.count(F.lit(1)).alias("comparisons"))
    out = fitted.join(arrays.withColumns(ends).drop("_s", "_p"), "candidate", "left").join(sides, "candidate")
    ordered = written(numbered(out, [F.col("strength").desc(), F.col("candidate")], "_at"), "ordered")
    above = ordered.select((F.col("_at") + 1).alias("_at"), F.col("low").alias("_low"))
    return ordered.join(above, "_at", "left").withColumn("apart", F.col("high") < F.col("_low")).withColumn("few", F.col("comparisons") < FEW_COMPARISONS).drop("_at", "_low")
