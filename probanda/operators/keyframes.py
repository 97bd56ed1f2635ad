"""Shots of a series of frames by their histograms, and one keyframe for each kind of shot.

The best parting has the least sum of squared errors about the shots' mean histograms, plus a penalty a shot.
Histograms are summed along the series once; the error of any stretch is then a difference of two sums of squares less
the square of a difference of two sums, so a series of n frames needs n rows of its bins and no table of all stretches.
Cuts that can no longer be best are forgotten on the way. Series are Spark's groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default penalty a shot, most differing bits of both codes, and most histogram distance of two keyframes alike (fixed values).
PENALTY, BITS, DISTANCE = 0.15, 4, 0.02


def best_cuts(bins: np.ndarray, penalty: float) -> list[int]:
    """The ends of the shots of the best parting; among equal ones that with the earliest last cut."""
    n = len(bins)
    sums = np.concatenate([np.zeros((1, bins.shape[1])), np.cumsum(bins, 0)])
    squares = np.concatenate([[0.0], np.cumsum((bins * bins).sum(1))])
    best, before = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    open_cuts = np.zeros(1, np.int64)
    for end in range(1, n + 1):
        step = sums[end] - sums[open_cuts]
        error = np.maximum(squares[end] - squares[open_cuts] - (step * step).sum(1) / (end - open_cuts), 0.0)
        total = best[open_cuts] + error + penalty
        at = int(total.argmin())
        best[end], before[end] = total[at], open_cuts[at]
        # A stretch's error only grows with it, so a start that is worse by the penalty already stays worse.
        open_cuts = np.append(open_cuts[best[open_cuts] + error <= best[end] + 1e-12], end)
    ends, at = [], n
    while at:
        ends.append(at)
        at = int(before[at])
    return ends[::-1]


def _alike(a: dict, b: dict, bits: int) -> bool:
    differ = lambda k: (int(a[k]) ^ int(b[k])) & 0xFFFFFFFFFFFFFFFF
    return a["digest"] == b["digest"] or (differ("phash").bit_count() <= bits and differ("dhash").bit_count() <= bits and float(np.abs(a["hist"] - b["hist"]).sum()) <= DISTANCE)


def keyframes(frames: DataFrame, fps: float, penalty: float = PENALTY, bits: int = BITS) -> DataFrame:
    """By series and shot: first, last (places of its frames in the series, from 0), start and end in seconds, sample (its middle frame's place), keyframe (place of the earlier shot's sample that it repeats, or its own).

    frames: (series, at, hist array<double>, phash, dhash, digest), taken in the order of `at`. A sample repeats a keyframe of equal digest, or of
    which both codes differ in at most `bits` bits and the histograms by at most DISTANCE. Frames without a histogram are left out."""
    rows = frames.where("hist is not null").select("series", "at", "hist", "phash", "dhash", "digest")

    def part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "digest"]).reset_index(drop=True)
        bins = np.array(g["hist"].tolist(), np.float64)
        shots, kept, first = [], [], 0
        for end in best_cuts(bins, penalty):
            sample = (first + end - 1) // 2
            own = {"hist": bins[sample], **{c: g.at[sample, c] for c in ("phash", "dhash", "digest")}}
            known = next((place for place, k in kept if _alike(k, own, bits)), None)
            if known is None:
                kept.append((sample, own))
                known = sample
            shots.append((key[0], len(shots), first, end - 1, first / fps, end / fps, sample, known))
            first = end
        return pd.DataFrame(shots, columns=["series", "shot", "first", "last", "start", "end", "sample", "keyframe"])

    kind = dict(rows.dtypes)["series"]
    return rows.groupBy("series").applyInPandas(part, f"series {kind}, shot int, first int, last int, start double, end double, sample int, keyframe int")


def day_histogram(hour, weight):
    """An array of 24 shares from the hours of a group's rows."""
    total = F.sum(weight)
    return F.array(*[F.coalesce(F.sum(F.when(hour == h, weight)), F.lit(0.0)) / total for h in range(24)])
