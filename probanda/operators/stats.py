"""Robust paired statistics, change points, preference fits. Groups here are series or panels of bounded size; the work over groups is Spark's."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.tables import written
from .components import components
from .running import running_sums


#: Groups of up to this many pairs of values are measured by listing them; larger ones by bisection.
LISTED, HALVINGS = 100_000, 64


def _selected(left: DataFrame, right: DataFrame, group: list[str], sign: float, triangle: bool) -> DataFrame:
    """By group of large samples: the median of all x + sign * y (of x + y over i <= j if `triangle`), by bisection on the value. In a step each x counts the y below a bound by its place among them: n log n rows' work a step, no pairs."""

    def median(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sort(x["v"].to_numpy(float)), np.sort(sign * y["v"].to_numpy(float))
        own = np.arange(len(a)) if triangle else 0
        total = len(a) * (len(a) + 1) // 2 if triangle else len(a) * len(b)

        def below(t: float) -> int:  # sums up to t
            count = np.searchsorted(b, t - a, side="right")
            return int(np.maximum(count - own, 0).sum())

        def kth(k: int) -> float:
            low, high = a[0] + b[0], a[-1] + b[-1]
            for _ in range(HALVINGS):
                mid = low + (high - low) / 2
                low, high = (low, mid) if below(mid) >= k else (mid, high)
            return high

        return pd.DataFrame([[*key, (kth((total + 1) // 2) + kth(total // 2 + 1)) / 2]], columns=[*group, "m"])

    kinds = dict(left.dtypes)
    shape = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", m double"
    apart = right.select(*[F.col(c).alias(c) for c in right.columns])  # so that a sample can meet itself
    return left.groupBy(*group).cogroup(apart.groupBy(*group)).applyInPandas(median, shape)


def hodges_lehmann(values: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Median of the averages of all pairs i <= j of each group: of a small group as a join with itself, of a large one by bisection."""
    v = values.select(*group, F.col(value).alias("v")).where("v is not null")
    n = v.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") * F.col("n") <= LISTED
    numbered = v.join(n.where(small), group).withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy("v")))
    right = numbered.select(*group, F.col("v").alias("_v"), F.col("_i").alias("_j"))
    listed = numbered.join(right, group).where("_i <= _j").groupBy(*group).agg(F.percentile(F.col("v") * 0.5 + F.col("_v") * 0.5, F.lit(0.5)).alias("hl"))
    large = v.join(n.where(~small), group)
    measured = _selected(large, large, group, 1.0, True).select(*group, (F.col("m") / 2).alias("hl"))
    return listed.union(measured).join(n.withColumn("n", F.col("n").cast("int")), group)


def shift(left: DataFrame, right: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Median of all differences x - y between two samples of a group, the pairs listed in small groups only."""
    x, y = (df.select(*group, F.col(value).alias("v")).where("v is not null") for df in (left, right))
    n = x.groupBy(*group).count().withColumnRenamed("count", "_n").join(y.groupBy(*group).count().withColumnRenamed("count", "_m"), group)
    small = F.col("_n") * F.col("_m") <= LISTED
    few = n.where(small).select(*group)
    listed = x.join(few, group).join(y.join(few, group).withColumnRenamed("v", "_y"), group).groupBy(*group).agg(F.percentile(F.col("v") - F.col("_y"), F.lit(0.5)).alias("shift"))
    many = n.where(~small).select(*group)
    return listed.union(_selected(x.join(many, group), y.join(many, group), group, -1.0, False).withColumnRenamed("m", "shift"))


def _mixed(seed: int, first: int, size: int) -> np.ndarray:
    """Numbers first + 1 to first + size of the SplitMix64 stream of the seed."""
    z = np.uint64(seed) + np.arange(first + 1, first + 1 + size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def passed_over(seed: int, n: int, within: int) -> list[int]:
    """Which of the first `within` numbers of the stream lie beyond the last whole multiple of n: the few values that do are traced back to their places, as each step of the stream can be undone."""
    top, out = (1 << 64) // n * n, []
    back = lambda m: np.uint64(pow(m, -1, 1 << 64))
    for low in range(top, 1 << 64, 1 << 20):
        z = np.uint64(low) + np.arange(min(1 << 20, (1 << 64) - low), dtype=np.uint64)
        z = (z ^ z >> np.uint64(31) ^ z >> np.uint64(62)) * back(0x94D049BB133111EB)
        z = (z ^ z >> np.uint64(27) ^ z >> np.uint64(54)) * back(0xBF58476D1CE4E5B9)
        z = z ^ z >> np.uint64(30) ^ z >> np.uint64(60)
        at = (z - np.uint64(seed)) * back(0x9E3779B97F4A7C15)
        out += at[(at > 0) & (at <= np.uint64(within))].tolist()
    return sorted(out)


def split_mix(seed: int, n: int, size: int, skip: int = 0) -> np.ndarray:
    """size places below n from the SplitMix64 stream of the seed, after the first `skip`; draws beyond the last whole multiple of n are passed over."""
    out, at = np.zeros(0, np.uint64), skip
    for place in passed_over(seed, n, skip + 64) if skip else []:
        if place > at:
            break
        at += 1
    top = (1 << 64) // n * n
    while len(out) < size:
        z = _mixed(seed, at, size + 64)
        out, at = np.concatenate([out, z if top == 1 << 64 else z[z < np.uint64(top)]]), at + len(z)
    return (out[:size] % np.uint64(n)).astype(np.int64)


def paired_bootstrap(pairs: DataFrame, group: list[str], resamples: int = 2048, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """By group of (before, after) in order of ord: Hodges-Lehmann effect with a percentile interval, in units and in percent of log ratios; both share their draws. Six pairs at least, else unknown."""
    tail = (1 - confidence) / 2

    def estimate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        n = len(rows)
        if n < 6:
            return pd.DataFrame([[*key, n, *[pd.NA] * 6]], columns=names).astype(dict.fromkeys(names[-6:], "Float64"))
        d = (rows["after"] - rows["before"]).to_numpy()
        r = np.log(rows["after"].to_numpy()) - np.log(rows["before"].to_numpy())
        at = split_mix(seed, n, n * resamples).reshape(resamples, n)
        percent, once = (lambda x: np.expm1(x) * 100), np.ones((1, n), np.int64)
        often = np.zeros((resamples, n), np.int64)
        np.add.at(often, (np.arange(resamples)[:, None], at), 1)
        ms, logs = weighted_pseudomedians(d, often), weighted_pseudomedians(r, often)
        return pd.DataFrame([[*key, n, weighted_pseudomedians(d, once)[0], *np.quantile(ms, [tail, 1 - tail]), percent(weighted_pseudomedians(r, once)[0]), *percent(np.quantile(logs, [tail, 1 - tail]))]], columns=names)

    names = [*group, "n", "delta", "low", "high", "pct", "pct_low", "pct_high"]
    keys = ", ".join(f"{c} {t}" for c, t in pairs.select(*group).dtypes)
    return pairs.groupBy(*group).applyInPandas(estimate, f"{keys}, n long, delta double, low double, high double, pct double, pct_low double, pct_high double")


def _best_segments(cost: np.ndarray, least: int, penalty: float) -> list[int]:
    """Ends of the segments of least total cost; of equal ones the earliest start."""
    n = len(cost)
    best, back = np.full(n + 1, math.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for end in range(least, n + 1):
        totals = best[: end - least + 1] + cost[: end - least + 1, end] + penalty
        back[end] = int(np.argmin(totals))
        best[end] = totals[back[end]]
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def onsets(series: DataFrame, least: int = 5) -> DataFrame:
    """Sustained rises of each identity's series (identity, time, ms, repeat_range, floor, min_pct), 10 to 120 observations: exact segmentation of scaled logs by absolute deviation from segment medians."""

    names = ["identity", "last_before", "first_changed", "before_ms", "after_ms", "materiality", "status"]

    def none(identity: object, status: str) -> pd.DataFrame:
        return pd.DataFrame([[identity, *[pd.NA] * 5, status]], columns=names).astype(dict.fromkeys(names[1:6], "Float64"))

    def detect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time")
        n = len(rows)
        if not 10 <= n <= 120:
            return none(key[0], "insufficient")
        ms, t = rows["ms"].to_numpy(), rows["time"].to_numpy()
        logs = np.log(ms)
        scale = max(np.median(np.abs(np.diff(logs))) * 1.048358, np.median(np.log1p(rows["repeat_range"].to_numpy() / ms)), 1e-6)
        v = (logs - np.median(logs)) / scale
        cost = np.zeros((n, n + 1))
        for end in range(1, n + 1):
            for start in range(end):
                part = v[start:end]
                cost[start, end] = np.abs(part - np.median(part)).sum()
        penalty = 3 * math.log(n)
        left, right, start = [], [], 0
        for end in _best_segments(cost, least, penalty):  # residuals of a pilot; pairs stay within its segments
            rest = v[start:end] - np.median(v[start:end])
            left.append(rest[:-1])
            right.append(rest[1:])
            start = end
        a, b = np.concatenate(left), np.concatenate(right)
        power = float((a * a).sum() * (b * b).sum())
        rho = min(max(float((a * b).sum()) / math.sqrt(power), 0.0), 0.99) if power > 0 else 0.0
        ends = _best_segments(cost, least, penalty * min(max((1 + rho) / (1 - rho), 1.0), n / 5))
        out, first = [], 0
        for split, end in zip(ends, ends[1:], strict=False):
            before, after = np.median(ms[first:split]), np.median(ms[split:end])
            limit = float(np.maximum(rows["floor"].to_numpy()[first:end], before * rows["min_pct"].to_numpy()[first:end] / 100).max())
            if after - before > limit and int((ms[split:end] - before > limit).sum()) >= 5:
                out.append([key[0], t[split - 1], t[split], before, after, limit, "candidate"])
            first = split
        return pd.DataFrame(out, columns=names) if out else none(key[0], "none")

    kind = dict(series.dtypes)["identity"]
    return series.groupBy("identity").applyInPandas(detect, f"identity {kind}, last_before double, first_changed double, before_ms double, after_ms double, materiality double, status string")


#: Rows of candidates and of pairs that met up to which a fit is one task's work; with more, every round is a join.
SMALL_PANEL = 20_000


def bradley_terry(votes: DataFrame, prior: float = 0.1, rounds: int = 500, small: int = SMALL_PANEL) -> DataFrame:
    """candidate, strength (log, centred on 0), place, connected (whether all candidates are linked by votes) from votes (i, j, score of i). Every pair of candidates also has `prior` wins each way. A round sets each strength to its wins by the sum of games / (own + other's strength) over all others.

    The votes are summed by Spark. Of a panel of up to `small` pairs and candidates squared the rounds run in one task; of a larger one each is a join of the pairs with the strengths, written to the shared folder, where the prior counts between those that met only (a full prior would have a row for every two candidates)."""
    v = votes.where("i <> j")
    both = v.select("i", "j", F.col("score").alias("s")).union(v.select("j", "i", 1 - F.col("score")))
    pairs = written(both.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("games"), F.sum("s").alias("wins")), "pairs")
    names = pairs.select(F.col("i").alias("candidate")).distinct()
    parts = components(pairs.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))).agg(F.count_distinct("component")).first()[0]
    n = names.count()
    out = _panel(pairs, prior, rounds) if n * n <= small else _rounds(pairs, names, prior, rounds)
    return out.withColumn("connected", F.lit(parts <= 1))


def _panel(pairs: DataFrame, prior: float, rounds: int) -> DataFrame:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["i"], rows["j"]]))
        n = len(names)
        games = np.full((n, n), 2 * prior)
        games[np.searchsorted(names, rows["i"]), np.searchsorted(names, rows["j"])] += rows["games"]
        np.fill_diagonal(games, 0)
        wins = np.bincount(np.searchsorted(names, rows["i"]), rows["wins"], n) + prior * (n - 1)
        p = np.ones(n)
        for _ in range(rounds):
            new = wins / (games / (p[:, None] + p[None, :])).sum(1)
            new /= np.exp(np.log(new).mean())
            done = np.abs(np.log(p) - np.log(new)).max() < 1e-10
            p = new
            if done:
                break
        strength = np.log(p)
        return pd.DataFrame({"candidate": names, "strength": strength, "place": [1 + int((strength > s).sum()) for s in strength]})

    return pairs.withColumn("panel", F.lit(0)).groupBy("panel").applyInPandas(fit, "candidate long, strength double, place int")


def _rounds(pairs: DataFrame, names: DataFrame, prior: float, rounds: int, close: float = 1e-6) -> DataFrame:
    met = written(pairs.select("i", "j", (F.col("games") + 2 * prior).alias("games"), (F.col("wins") + prior).alias("wins")), "met")
    wins = written(met.groupBy(F.col("i").alias("candidate")).agg(F.sum("wins").alias("wins")), "wins")
    now = written(names.select("candidate", F.lit(0.0).alias("strength")), "strengths")
    for _ in range(rounds):
        side = lambda c, s: now.select(F.col("candidate").alias(c), F.col("strength").alias(s))  # noqa: E731, B023
        sums = met.join(side("i", "a"), "i").join(side("j", "b"), "j").groupBy(F.col("i").alias("candidate")).agg(F.sum(F.col("games") / (F.exp("a") + F.exp("b"))).alias("_d"))
        new = written(wins.join(sums, "candidate").join(now.withColumnRenamed("strength", "_old"), "candidate").select("candidate", F.log(F.col("wins") / F.col("_d")).alias("strength"), "_old"), "strengths")
        mean = new.agg(F.avg("strength")).first()[0]
        moved = new.agg(F.max(F.abs(F.col("strength") - mean - F.col("_old")))).first()[0]
        now = new.select("candidate", (F.col("strength") - mean).alias("strength"))
        if moved < close:
            break
    ranked = now.groupBy("strength").agg(F.count(F.lit(1)).alias("_n"))
    below = running_sums(ranked, F.col("strength").desc(), ["_n"]).join(ranked.withColumnRenamed("_n", "_own"), "strength").select("strength", (1 + F.col("_n") - F.col("_own")).cast("int").alias("place"))
    return now.join(below, "strength").select("candidate", "strength", "place")


def isotonic(bins: DataFrame, group: list[str]) -> DataFrame:
    """Rising fit of rate over bin (weights n): bins that fall are pooled with those before until none falls. A group's bins are pooled in one pass in one task; bins without weight or rate are left out."""

    def pooled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        pools: list[list[float]] = []  # weight, weighted sum, bins
        for n, rate in zip(rows["n"].to_numpy(float), rows["rate"].to_numpy(float), strict=True):
            now = [n, n * rate, 1]
            while pools and pools[-1][1] * now[0] >= now[1] * pools[-1][0]:
                now = [a + b for a, b in zip(pools.pop(), now, strict=True)]
            pools.append(now)
        fitted = np.repeat([x / n for n, x, _ in pools], [int(k) for _, _, k in pools])
        return pd.DataFrame({**dict(zip(group, key, strict=True)), "bin": rows["bin"].to_numpy(), "fitted": fitted})

    kinds = dict(bins.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "bin"]) + ", fitted double"
    return bins.where("n > 0 and rate is not null").select(*group, "bin", "n", "rate").groupBy(*group).applyInPandas(pooled, shape)


@F.pandas_udf(DoubleType())
def _exact_lower(hits: pd.Series, n: pd.Series, tail: pd.Series) -> pd.Series:
    def bound(k: int, m: int, q: float) -> float:
        if k <= 0:
            return 0.0
        low, high = 0.0, 1.0
        logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) for i in range(k, m + 1)]
        for _ in range(60):  # the chance of k hits or more rises with p
            p = (low + high) / 2
            chance = sum(math.exp(c + i * math.log(p) + (m - i) * math.log1p(-p)) for c, i in zip(logs, range(k, m + 1), strict=True)) if 0 < p < 1 else p
            low, high = (p, high) if chance < q else (low, p)
        return (low + high) / 2

    return pd.Series([bound(int(k), int(m), float(q)) for k, m, q in zip(hits, n, tail, strict=True)])


def exact_interval(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Clopper-Pearson bounds of hits of n, by bisection."""
    q = F.lit((1 - confidence) / 2)
    return counts.withColumn("low", _exact_lower("hits", "n", q)).withColumn("high", 1 - _exact_lower(F.col("n") - F.col("hits"), F.col("n"), q))


def _percentile(values: np.ndarray, q: float) -> float:
    return float(np.quantile(values, q))


def arm_summary(base: DataFrame, arms: DataFrame, group: list[str], draws: int = 2048, seed: int = 11) -> DataFrame:
    """By arm of (group.., ord, value), against the repeats of its baseline (group[:-1].., ord, value): repeats, median, interquartile range, Hodges-Lehmann shift, and its 95 % percentile interval over resampled repeats of both sides (null with one repeat on a side). Repeats are a few dozen; arms are Spark's groups."""
    shared = group[:-1]
    kinds = dict(arms.dtypes)
    names = ["repeats", "median", "iqr", "shift", "low", "high"]
    gathered = base.groupBy(*shared).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("_base"))
    rows = arms.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("_arm")).join(gathered, shared)

    def measure(batches):
        for batch in batches:
            out = []
            for key, a, b in zip(batch[group].itertuples(index=False, name=None), batch["_arm"], batch["_base"], strict=True):
                a, b = np.asarray(a, float), np.asarray(b, float)
                middle = lambda x, y: float(np.median((x[:, None] - y[None, :]).ravel()))
                low = high = None
                if len(a) > 1 and len(b) > 1:
                    at = _draws(seed, draws, len(a), len(b))
                    step = max(1, SLICE // (len(a) * len(b)))  # draws whose differences are held at a time
                    d = np.concatenate([np.median(a[x[:, : len(a)]][:, :, None] - b[x[:, len(a) :]][:, None, :], axis=(1, 2)) for x in (at[i : i + step] for i in range(0, draws, step))])
                    low, high = _percentile(d, 0.025), _percentile(d, 0.975)
                out.append((*key, len(a), float(np.median(a)), _percentile(a, 0.75) - _percentile(a, 0.25), middle(a, b), low, high))
            yield pd.DataFrame(out, columns=[*group, *names])

    shape = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", repeats int, median double, iqr double, shift double, low double, high double"
    return rows.mapInPandas(measure, shape)


def _draws(seed: int, draws: int, n: int, m: int) -> np.ndarray:
    """draws rows of n places below n and m below m, from one stream in that order; with one bound the rows are cut from it at once."""
    if n == m:
        return split_mix(seed, n, draws * (n + m)).reshape(draws, n + m)
    # A draw that is passed over depends on its bound, so the stream is walked with the bound of each place.
    bounds = np.tile(np.r_[np.full(n, n), np.full(m, m)], draws).astype(np.uint64)
    step = np.arange(1, len(bounds) + 1, dtype=np.uint64)
    z = np.uint64(seed) + step * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    z = z ^ z >> np.uint64(31)
    tops = {int(k): (1 << 64) // int(k) * int(k) for k in (n, m)}
    if all((z[bounds == k] < np.uint64(min(top, (1 << 64) - 1))).all() for k, top in tops.items()):
        return (z % bounds).astype(np.int64).reshape(draws, n + m)
    out, at = [], 0
    while len(out) < len(bounds):  # some draw is passed over: one by one
        at += 1
        x = (seed + at * 0x9E3779B97F4A7C15) & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        x ^= x >> 31
        k = int(bounds[len(out)])
        if x < tops[k]:
            out.append(x % k)
    return np.array(out, np.int64).reshape(draws, n + m)


#: Units that a row of the table of chunks holds, places that a slice of draws reads, and slices at most.
CHUNK, READ, SLICES = 65_536, 50_000_000, 64


def _summed(rows: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    return rows.groupBy(*group, unit).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.col(value)).alias("_n"))


def grouped_mean(rows: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    """By group: units (that are named) and the mean of value over all rows."""
    return _summed(rows, group, unit, value).groupBy(*group).agg(F.count(F.col(unit)).cast("int").alias("units"), (F.sum("_s") / F.sum("_n")).alias("mean"))


def _chunks(units: DataFrame, group: list[str], unit: str) -> DataFrame:
    """group.., _part, _at, _size, _sums, _counts: the sums (_s) and counts (_n) of a group's units in their order, as arrays of at most CHUNK; chunks are in order of _part and _at. Units are sorted in ranges, never a group in a task."""
    kinds = dict(units.dtypes)

    def packed(batches):
        held, at = {}, 0  # by group, as a range has a part of a few groups' units

        def chunk(key):
            nonlocal at
            s, n = (np.concatenate(x) for x in zip(*held.pop(key)[1], strict=True))
            at += 1
            return pd.DataFrame([[*key, int(part), at, len(s), s.tobytes(), n.tobytes()]], columns=names)

        for batch in batches:
            for key, rows in batch.groupby(group, dropna=False, sort=False):
                key, part = tuple(None if pd.isna(k) else k for k in key), rows["_part"].iloc[0]
                for other in [k for k in held if k != key]:
                    yield chunk(other)
                now = held.setdefault(key, [0, []])
                now[0] += len(rows)
                now[1].append((rows["_s"].to_numpy(float), rows["_n"].to_numpy(float)))
                if now[0] >= CHUNK:
                    yield chunk(key)
        for key in list(held):
            yield chunk(key)

    names = [*group, "_part", "_at", "_size", "_sums", "_counts"]
    order = [F.col(c).asc_nulls_last() for c in (*group, unit)]
    dealt = units.repartitionByRange(*order).sortWithinPartitions(*order).select(*group, F.spark_partition_id().alias("_part"), "_s", "_n")
    return dealt.mapInPandas(packed, ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", _part int, _at int, _size int, _sums binary, _counts binary")


def grouped_interval(rows: DataFrame, group: list[str], unit: str, value: str, draws: int = 1000, seed: int = 7, confidence: float = 0.95) -> DataFrame:
    """By group: the mean of value and its percentile interval over resampled units (all rows of a unit together).

    Spark sums the rows of a unit; a draw reads one sum and count a unit. A large group's draws are parted into slices, each a task's, which finds
    its place in the stream of draws and holds the group's sums and counts (16 bytes a unit) and one draw at a time."""
    units = _summed(rows.where(F.col(value).isNotNull()), group, unit, value)
    chunks = written(_chunks(units, group, unit), "chunks")
    tail = (1 - confidence) / 2
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in group)
    sizes = chunks.groupBy(*group).agg(F.sum("_size").alias("_units")).select(*[F.col(g).alias(f"_{g}") for g in group], F.greatest(F.lit(1), F.least(F.lit(min(SLICES, draws)), F.ceil(F.col("_units") * draws / READ))).cast("int").alias("_slices"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    sliced = chunks.join(sizes, same).drop(*[f"_{g}" for g in group]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))

    def draw(key: tuple, u: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(["_part", "_at"])
        s, n = (np.concatenate([np.frombuffer(x) for x in u[c]]) for c in ("_sums", "_counts"))
        first, end = (draws * (key[-1] + i) // int(u["_slices"].iloc[0]) for i in (0, 1))
        step, found = max(1, CHUNK * 16 // len(s)), []
        for low in range(first, end, step) if len(s) > 1 else []:
            high = min(end, low + step)
            at = split_mix(seed, len(s), (high - low) * len(s), low * len(s)).reshape(high - low, len(s))
            found.append(s[at].sum(1) / n[at].sum(1))
        return pd.DataFrame([[*key[:-1], len(s), s.sum() / n.sum(), np.concatenate(found).tolist() if found else []]], columns=[*group, "units", "mean", "_means"])

    drawn = sliced.groupBy(*group, "_slice").applyInPandas(draw, keys + ", units int, mean double, _means array<double>")

    def ends(batches):
        for batch in batches:
            found = [np.asarray(x, float) for x in batch["_means"]]
            bound = lambda q: [_percentile(x, q) if len(x) else None for x in found]  # noqa: B023, E731
            yield batch.drop(columns="_means").assign(low=bound(tail), high=bound(1 - tail)).astype({"low": "float64", "high": "float64"})

    gathered = drawn.groupBy(*group).agg(F.first("units").alias("units"), F.first("mean").alias("mean"), F.flatten(F.collect_list("_means")).alias("_means"))
    return gathered.mapInPandas(ends, keys + ", units int, mean double, low double, high double")


#: The fewest pairs and blocks, and the fewest draws that a tail of the bootstrap must hold.
LEAST_PAIRS, TAIL_DRAWS = 6, 10
#: Sums of weights that a slice of draws holds at a time, and values up to which all their pairs are listed.
SLICE, PAIRED = 4_000_000, 1000


def weighted_pseudomedians(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each row of `times` (how often each value is drawn): the median of the means of all pairs of the values drawn, each with itself too."""
    order = np.argsort(values, kind="stable")
    x, times = values[order], times[:, order].astype(np.int64)
    n = times.sum(1)
    pairs = n * (n + 1) // 2
    wanted = np.stack([(pairs + 1) // 2, pairs // 2 + 1], 1)
    if len(x) > PAIRED:
        return np.array([_halved(x, t, k).mean() for t, k in zip(times, wanted, strict=True)])
    i, j = np.triu_indices(len(x))
    means = x[i] * 0.5 + x[j] * 0.5
    by_mean = np.argsort(means, kind="stable")
    i, j, means = i[by_mean], j[by_mean], means[by_mean]
    step, out = max(1, SLICE // len(means)), []
    for low in range(0, len(times), step):
        t = times[low : low + step]
        upto = np.cumsum(np.where(i == j, t[:, i] * (t[:, i] + 1) // 2, t[:, i] * t[:, j]), 1)
        out += [means[np.searchsorted(u, k)].mean() for u, k in zip(upto, wanted[low : low + step], strict=True)]
    return np.array(out)


def _halved(x: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted-th least means of pairs by halving the range; a pair of places counts as often as both are drawn."""
    upto = np.concatenate([[0], np.cumsum(times)])

    def below(t: float) -> int:
        both = int((times * upto[np.searchsorted(x, 2 * t - x, "right")]).sum())
        return (both + int(times[x <= t].sum())) // 2

    out = []
    for k in wanted:
        low, high = x[0], x[-1]
        for _ in range(HALVINGS):
            mid = low + (high - low) / 2
            low, high = (low, mid) if below(mid) >= k else (mid, high)
        out.append(high)
    return np.array(out)


def block_effects(pairs: DataFrame, group: list[str], coverage: float, resamples: int, seed: int) -> DataFrame:
    """By group of pairs (block, before, after, seed_mask): effect in percent (pseudomedian of log ratios), low and high over resampled blocks. A block is drawn whole, so only how often each comes matters."""
    tail = (1 - coverage) / 2

    def measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, block = np.unique(rows["block"], return_inverse=True)
        r = np.log(rows["after"].to_numpy(float) / rows["before"].to_numpy(float))
        n = int(block.max()) + 1
        drawn = split_mix(seed ^ int(rows["seed_mask"].iloc[0]), n, resamples * n).reshape(resamples, n)
        often = np.zeros((resamples, n), np.int64)
        np.add.at(often, (np.arange(resamples)[:, None], drawn), 1)
        spread = weighted_pseudomedians(r, often[:, block])
        middle = weighted_pseudomedians(r, np.ones((1, len(r)), np.int64))[0]
        return pd.DataFrame([[*key, *(float(np.expm1(v) * 100) for v in (middle, _percentile(spread, tail), _percentile(spread, 1 - tail)))]], columns=[*group, "effect", "low", "high"])

    kinds = dict(pairs.dtypes)
    shape = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", effect double, low double, high double"
    return pairs.groupBy(*group).applyInPandas(measure, shape)


def timing_verdict(pairs: DataFrame, session: list[str], band_pct: float, looks: list[int], confidence: float = 0.95, resamples: int = 1024, seed: int = 7) -> DataFrame:
    """By session of pairs (ord, block, order ab or ba, aa, before, after): effect in percent, interval, noise floor of the same-build (aa) pairs, what speaks against a verdict, and the verdict.

    The confidence is shared out over the looks. Spark counts pairs, blocks and orders and sets the flags; a task only resamples the blocks of one side of a
    session. Without reasons against it the verdict is faster or slower (the interval lies beyond
    the band), equivalent (within it), or inconclusive; with any it is inconclusive. A timing that is no positive number leaves its session without an effect."""
    coverage = 1 - (1 - confidence) / len(looks)
    usable = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    ab, aa = ~F.col("aa"), F.col("aa")
    by_block = pairs.groupBy(*session, "block").agg(
        F.count_if(ab).alias("_ab"), F.count_if(aa).alias("_aa"), F.count_if(ab & (F.col("order") == "ab")).alias("_first"), F.count_if(ab & (F.col("order") == "ba")).alias("_second"),
        F.count_if(~(usable("before") & usable("after"))).alias("_unusable"))
    counts = by_block.groupBy(*session).agg(
        *[F.sum(f"_{c}").alias(f"_{c}") for c in ("ab", "aa", "first", "second", "unusable")], *[F.count_if(F.expr(test)).alias(name) for test, name in (("_ab > 0", "_ab_blocks"), ("_aa > 0", "_aa_blocks"), ("_ab > 0 and _aa > 0", "_shared"))])
    enough = counts.where("_unusable = 0").select(*session, (F.col("_ab") >= LEAST_PAIRS).alias("_ab_enough"), (F.col("_aa") >= LEAST_PAIRS).alias("_aa_enough"))
    taken = pairs.join(enough, session).where(F.when(aa, F.col("_aa_enough")).otherwise(F.col("_ab_enough")))
    effects = block_effects(taken.withColumn("seed_mask", aa.cast("int")).drop("_ab_enough", "_aa_enough"), [*session, "aa"], coverage, resamples, seed)
    own = effects.where(ab).drop("aa")
    floor = effects.where(aa).select(*session, F.greatest(F.abs("low"), F.abs("high")).alias("floor"))
    s = counts.join(own, session, "left").join(floor, session, "left")
    flags = [
        (F.lit((1 - coverage) / 2 * resamples < TAIL_DRAWS), "bootstrap_tail_underresolved"), (F.col("_ab") < LEAST_PAIRS, "too_few_pairs"), (F.col("_aa") < LEAST_PAIRS, "too_few_same_session_aa_pairs"),
        ((F.col("_first") == 0) | (F.col("_second") == 0), "order_not_interleaved"), ((F.col("_ab") >= LEAST_PAIRS) & (F.col("_ab_blocks") < LEAST_PAIRS), "too_few_independent_blocks"),
        ((F.col("_aa") >= LEAST_PAIRS) & (F.col("_aa_blocks") < LEAST_PAIRS), "too_few_aa_blocks"), (F.col("floor") > band_pct, "aa_noise_floor_too_wide"),
        (~F.col("_ab").isin(looks), "not_a_declared_look"), (F.col("_shared") > 0, "aa_ab_share_resampling_block")]  # fixed names
    against = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))
    s = s.withColumn("_against", F.when(F.col("_unusable") > 0, F.array(F.lit("invalid_timings"))).otherwise(against))
    found = F.when(F.size("_against") > 0, "inconclusive").when(F.col("high") < -band_pct, "faster").when(F.col("low") > band_pct, "slower").when((F.col("low") >= -band_pct) & (F.col("high") <= band_pct), "equivalent").otherwise("inconclusive")
    s = s.withColumn("verdict", found)
    reasons = F.when((F.size("_against") == 0) & (F.col("verdict") == "inconclusive"), "ci_spans_equivalence_band").otherwise(F.array_join("_against", ","))
    return s.select(*session, "effect", "low", "high", "floor", reasons.alias("reasons"), "verdict")
