"""Competition ranks of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_each(scores: DataFrame, within: str = "image", value: str = "value") -> DataFrame:
    """Ranks 1, 1, 3 by ascending value in each image; unknown values get none."""
    w = Window.partitionBy(within).orderBy(F.col(value).asc_nulls_last())
    return scores.withColumn("place", F.when(F.col(value).isNotNull(), F.rank().over(w)))


def common_images(scores: DataFrame) -> DataFrame:
    """Images that every candidate has a value for."""
    n = scores.select("candidate").distinct().agg(F.count(F.lit(1)).alias("_all"))
    have = scores.where("value is not null").groupBy("image").agg(F.count_distinct("candidate").alias("_n"))
    return have.crossJoin(F.broadcast(n)).where("_n = _all").select("image")


def overall(scores: DataFrame) -> DataFrame:
    """Mean rank and mean value over the common images; place only if all images are common, by mean rank and then mean value."""
    ranked = rank_each(scores.join(common_images(scores), "image", "left_semi"))
    sums = ranked.groupBy("candidate").agg(F.avg("place").alias("mean_rank"), F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    whole = scores.agg(F.count_distinct("image").alias("_images"))
    w = Window.orderBy("mean_rank", "mean_value")  # one row a candidate
    return sums.crossJoin(F.broadcast(whole)).withColumn("place", F.when(F.col("n") == F.col("_images"), F.rank().over(w))).drop("_images")


def rank_by_strength(strengths: DataFrame, group: list[str]) -> DataFrame:
    """One more than the number of strictly stronger rows."""
    return strengths.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(F.col("strength").desc())))
