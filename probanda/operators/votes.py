"""Votes, labels and predictions: agreement, calibration, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import running_sums


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence, the last closed: n, mean confidence (unclamped), accuracy."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return predictions.groupBy(F.least(F.floor(clamped * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    b = reliability(predictions, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def suggested_gate(predictions: DataFrame, target: float, support: int) -> DataFrame:
    """Least confidence whose tail has the support and accuracy; null if none. Tails are running sums over the distinct confidences, by ranges."""
    by = predictions.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("good")).where("confidence is not null")
    tail = running_sums(by, F.col("confidence").desc(), ["n", "good"])
    return tail.agg(F.min(F.when((F.col("n") >= support) & (F.col("good") / F.col("n") >= target), F.col("confidence"))).alias("gate"))


def first_votes(votes: DataFrame, order: list[str]) -> DataFrame:
    """One vote for each unit and rater, the first."""
    w = Window.partitionBy("unit", "rater").orderBy(*order)
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def krippendorff(votes: DataFrame) -> DataFrame:
    """Nominal alpha over (unit, rater, answer), units of two votes or more; null without disagreement to expect."""
    m = votes.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    counts = votes.join(m, "unit").groupBy("unit", "m", "answer").agg(F.count(F.lit(1)).alias("k"))
    agree = counts.agg(F.sum(F.col("k") * (F.col("k") - 1) / (F.col("m") - 1)).alias("o"), F.sum("k").alias("n"))
    marginal = counts.groupBy("answer").agg(F.sum("k").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("e"))
    both = agree.crossJoin(marginal)  # one row each
    observed, expected = 1 - F.col("o") / F.col("n"), 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return both.select(F.when(expected > 0, 1 - observed / expected).alias("alpha"), F.col("n").alias("values"))


def consensus(votes: DataFrame) -> DataFrame:
    """The answer with most votes; null on a tie."""
    c = votes.groupBy("unit", "answer").agg(F.count(F.lit(1)).alias("k"))
    top = c.withColumn("_r", F.rank().over(Window.partitionBy("unit").orderBy(F.col("k").desc()))).where("_r = 1")
    return top.groupBy("unit").agg(F.when(F.count(F.lit(1)) == 1, F.max("answer")).alias("answer"), F.max("k").alias("votes"))


def position_bias(judgements: DataFrame) -> DataFrame:
    """Of cases judged in both orders (case, ord ab/ba, choice first/second/abstain): flips, first-slot share, abstentions."""
    p = judgements.groupBy("case").pivot("ord", ["ab", "ba"]).agg(F.first("choice"))
    both = p.where("ab is not null and ba is not null")
    said = (F.col("ab") != "abstain") & (F.col("ba") != "abstain")
    out = both.agg(F.count(F.lit(1)).alias("cases"), F.count_if(~said).alias("abstained"), F.count_if(said & (F.col("ab") == F.col("ba"))).alias("flips"), F.count_if(said).alias("_said"), F.sum(F.when(said, (F.col("ab") == "first").cast("int") + (F.col("ba") == "first").cast("int"))).alias("_first"))
    return out.select("cases", "abstained", "flips", F.when(F.col("_said") > 0, F.col("flips") / F.col("_said")).alias("flip_rate"), F.when(F.col("_said") > 0, F.col("_first") / (2 * F.col("_said"))).alias("first_share"))


def panel(votes: DataFrame, min_judges: int = 2, min_prob: float = 0.6) -> DataFrame:
    """Weighted scores by item: the best answer, its share, agreement; escalated on a tie, too few judges or too small a share."""
    s = votes.groupBy("item", "answer").agg(F.sum(F.col("weight") * F.col("prob")).alias("score"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("item")
    r = s.withColumn("_all", F.sum("score").over(w)).withColumn("_n", F.sum("k").over(w)).withColumn("_r", F.rank().over(w.orderBy(F.round("score", 9).desc())))
    top = r.where("_r = 1").groupBy("item").agg(F.min("answer").alias("answer"), F.max("score").alias("score"), F.max("_all").alias("_all"), F.max("_n").alias("judges"), F.max("k").alias("_k"), F.count(F.lit(1)).alias("_ties"))
    share = F.when(F.col("_all") > 0, F.col("score") / F.col("_all"))
    reason = F.when(F.col("_ties") > 1, "tie").when(F.col("judges") < min_judges, "few_judges").when(share < min_prob, "low_share")
    return top.select("item", "answer", share.alias("share"), "judges", (F.col("_k") / F.col("judges")).alias("agreement"), reason.alias("escalated"))


def merged_orders(votes: DataFrame) -> DataFrame:
    """One judge's answers over orders: abstain if any is, flip if they differ, else the answer with the mean probability."""
    g = votes.groupBy("item", "judge").agg(F.count_distinct("answer").alias("_n"), F.max((F.col("answer") == "abstain").cast("int")).alias("_a"), F.min("answer").alias("_x"), F.avg("prob").alias("_p"))
    status = F.when(F.col("_a") == 1, "abstain").when(F.col("_n") > 1, "flip").otherwise("consistent")
    return g.select("item", "judge", status.alias("status"), F.when(status == "consistent", F.col("_x")).alias("answer"), F.when(status == "consistent", F.col("_p")).alias("prob"))


def peer_agreement(votes: DataFrame) -> DataFrame:
    """Share of the other votes on the same units that agree with each rater; from counts, without pairing voters."""
    n = Window.partitionBy("unit")
    k = Window.partitionBy("unit", "answer")
    c = votes.withColumn("_n", F.count(F.lit(1)).over(n)).withColumn("_k", F.count(F.lit(1)).over(k)).where("_n > 1")
    return c.groupBy("rater").agg(F.sum(F.col("_n") - 1).alias("peers"), (F.sum(F.col("_k") - 1) / F.sum(F.col("_n") - 1)).alias("agreement"))


def merged_labels(labels: DataFrame, key: list[str], answer: str) -> DataFrame:
    """One label a key; `conflict` where labels differ (their answer is null)."""
    g = labels.groupBy(*key).agg(F.min(answer).alias("_a"), F.max(answer).alias("_b"), F.count(F.lit(1)).alias("n"))
    same = F.col("_a") == F.col("_b")
    return g.select(*key, F.when(same, F.col("_a")).alias("answer"), "n", (~same).alias("conflict"))


def classification(rows: DataFrame) -> DataFrame:
    """By stratum and class: support, precision and recall, each null where its denominator is zero."""
    t = rows.groupBy("stratum", F.col("truth").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("truth") == F.col("said")).alias("hits"))
    s = rows.groupBy("stratum", F.col("said").alias("class")).agg(F.count(F.lit(1)).alias("claims"))
    j = t.join(s, ["stratum", "class"], "full_outer").na.fill(0, ["support", "hits", "claims"])
    return j.select("stratum", "class", "support", F.when(F.col("claims") > 0, F.col("hits") / F.col("claims")).alias("precision"), F.when(F.col("support") > 0, F.col("hits") / F.col("support")).alias("recall"))


def sensitivity(trials: DataFrame) -> DataFrame:
    """By class and gate: outcome counts, miss rate over detected and missed, smallest detected magnitude."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    g = trials.groupBy("class", "gate").agg(*[count(o).alias(o) for o in ("detected", "missed", "excluded", "unavailable")], F.min(F.when(F.col("outcome") == "detected", F.col("magnitude"))).alias("smallest"))
    n = F.col("detected") + F.col("missed")
    return g.withColumn("miss_rate", F.when(n > 0, F.col("missed") / n))


def midpoint_threshold(scores: DataFrame) -> DataFrame:
    """Midpoint of the least positive and the greatest negative fit score; errors of the holdout at it."""
    f = scores.where("part = 'fit'").agg(F.min(F.when(F.col("label") == 1, F.col("score"))).alias("lo"), F.max(F.when(F.col("label") == 0, F.col("score"))).alias("hi")).withColumn("limit", (F.col("lo") + F.col("hi")) / 2)
    h = scores.where("part <> 'fit'").crossJoin(F.broadcast(f.select("limit")))
    return h.groupBy("limit").agg(F.count_if((F.col("label") == 0) & (F.col("score") >= F.col("limit"))).alias("false_positives"), F.count_if((F.col("label") == 1) & (F.col("score") < F.col("limit"))).alias("false_negatives"), F.count(F.lit(1)).alias("n"))


def labelled(predictions: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their labels; those without keep their row, so that they can be counted."""
    return predictions.join(labels, keys, "left")


def label_coverage(joined: DataFrame) -> DataFrame:
    """How many predictions have a label, and their accuracy, null without any."""
    n = F.count("correct")
    return joined.agg(F.count(F.lit(1)).alias("predictions"), n.alias("labelled"), (F.count(F.lit(1)) - n).alias("unlabelled"), F.avg("correct").alias("accuracy"))
