"""What a series of runs says about an entry's threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import upper_median


def distinct_captures(samples: DataFrame, key: list[str]) -> DataFrame:
    """One row a capture, with the value recorded first."""
    return samples.groupBy(*key, "capture").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def findings(samples: DataFrame, key: list[str]) -> DataFrame:
    """n, least, most, span of distinct captures; insufficient_history (under 3), flaky_threshold (some pass, some fail), noise_dominates_threshold (a span of the threshold or more) or stable_observed; what to do next; from 3 captures on a suggested threshold."""
    g = distinct_captures(samples, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    g = g.withColumn("span", F.col("most") - F.col("least"))
    flaky = (F.col("least") <= F.col("threshold")) & (F.col("most") > F.col("threshold"))
    noisy = (F.col("span") > 0) & (F.col("span") >= F.col("threshold"))
    finding = F.when(F.col("n") < 3, "insufficient_history").when(flaky, "flaky_threshold").when(noisy, "noise_dominates_threshold").otherwise("stable_observed")
    action = F.when(F.col("n") < 3, "capture_more_distinct_repeats").when(flaky | noisy, "quarantine_and_remeasure").otherwise("keep_threshold")
    return g.withColumn("finding", finding).withColumn("next_action", action).withColumn("suggested", F.when(F.col("n") >= 3, F.least(F.lit(1.0), F.col("most") + F.col("span"))))


def first_page(found: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in order, each with how many rows the page leaves out."""
    total = found.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return found.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")


def chronology(rows: DataFrame, group: list[str]) -> DataFrame:
    """`moment`: the capture time if the whole group has one, else the sequence."""
    whole = F.min(F.col("captured").isNotNull()).over(Window.partitionBy(*group))
    return rows.withColumn("moment", F.when(whole, F.col("captured").cast("double")).otherwise(F.col("seq").cast("double")))


def latest(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("moment").desc(), F.col("seq").desc()))).where(F.col("_n") <= n).drop("_n")


def collapsed(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag("value").over(Window.partitionBy(*group).orderBy("moment"))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("value"))).drop("_before")


def rising_share(rows: DataFrame, group: list[str], levels: int = 10) -> DataFrame:
    """Share of rising steps among the last levels."""
    last = latest(collapsed(rows, group), group, levels)
    before = F.lag("value").over(Window.partitionBy(*group).orderBy("moment"))
    return last.withColumn("_up", (F.col("value") > before).cast("int")).groupBy(*group).agg(F.count("_up").alias("steps"), F.avg("_up").alias("rising"))


def endpoint_effect(rows: DataFrame, group: list[str], k: int = 5) -> DataFrame:
    """Upper median of the last k values less that of the first k."""
    w = Window.partitionBy(*group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy("moment"))).withColumn("_j", F.row_number().over(w.orderBy(F.col("moment").desc())))
    first, last = F.when(F.col("_i") <= k, F.col("value")), F.when(F.col("_j") <= k, F.col("value"))
    return numbered.groupBy(*group).agg((upper_median(last) - upper_median(first)).alias("effect"))


def run_analysis(rows: DataFrame, group: list[str], repeats: int = 10, share: float = 0.75) -> DataFrame:
    """By group of (run_id, seq, value, threshold, unchanged): independent runs (the first row of a run_id counts), the span of runs of unchanged builds, the effect of the last five runs against the first five, and whether it drifts: enough unchanged repeats, an effect beyond their span, and a share of the last level changes that rise."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "run_id").orderBy("seq"))).where("_n = 1").withColumn("moment", F.col("seq").cast("double"))
    noise = F.when(F.col("unchanged"), F.col("value"))
    out = once.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"), F.count(noise).alias("unchanged_runs"), F.min(noise).alias("_lo"), F.max(noise).alias("_hi"), F.min_by("threshold", "seq").alias("threshold"))
    out = out.join(endpoint_effect(once, group), group).join(rising_share(once, group), group)
    enough, span = F.col("unchanged_runs") >= repeats, F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    effect = F.when(F.col("runs") >= 10, F.col("effect"))
    drifts = enough & F.coalesce(effect > F.greatest(span, F.lit(1e-9)), F.lit(False)) & (F.col("steps") > 0) & (F.col("rising") >= share)
    flaky = enough & (F.col("_lo") <= F.col("threshold")) & (F.col("_hi") > F.col("threshold"))
    return out.select(
        *group, "runs", "unchanged_runs", "threshold", F.when(enough, span).alias("span"), effect.alias("effect"), F.when(enough & ~drifts, F.least(F.lit(1.0), F.col("_hi") + span)).alias("suggested"),
        F.when(~enough, "insufficient_unchanged_build_repeats").when(drifts, "candidate").otherwise("not_detected").alias("drift"),
        F.when(drifts, "investigate_drift_with_fresh_matched_repeats").when(flaky, "quarantine_and_remeasure").when(~enough, "collect_unchanged_build_repeats").otherwise("keep_threshold").alias("recommendation"))


def audited(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All rows with `kept`: the first of each repeated window; the others stay as the audit."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)


def append_new(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming, once each, that the store does not hold: an append that may be repeated."""
    return incoming.dropDuplicates(keys).join(store.select(*keys).distinct(), keys, "left_anti")
