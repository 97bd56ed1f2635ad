"""Label masks, rasters and tiles as rows of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components


def mask_metrics(truth: DataFrame, said: DataFrame) -> DataFrame:
    """By class of (x, y, label) grids: IoU, Dice, precision, recall; scored, missed, spurious or absent."""
    j = truth.toDF("x", "y", "t").join(said.toDF("x", "y", "p"), ["x", "y"], "full_outer")
    labels = F.array_distinct(F.array_compact(F.array("t", "p")))
    c = j.withColumn("label", F.explode(labels)).groupBy("label").agg(F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("shared"), F.count_if(F.col("t") == F.col("label")).alias("n_truth"), F.count_if(F.col("p") == F.col("label")).alias("n_said"))
    union = F.col("n_truth") + F.col("n_said") - F.col("shared")
    status = F.when(F.col("n_truth") == 0, "spurious").when(F.col("n_said") == 0, "missed").otherwise("scored")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return c.select("label", "shared", "n_truth", "n_said", status.alias("status"), (F.col("shared") / union).alias("iou"), (2 * F.col("shared") / (F.col("n_truth") + F.col("n_said"))).alias("dice"), ratio(F.col("shared"), F.col("n_said")).alias("precision"), ratio(F.col("shared"), F.col("n_truth")).alias("recall"))


def mask_summary(classes: DataFrame) -> DataFrame:
    """Macro IoU over classes of the truth (missed ones count as 0), micro as a ratio of sums."""
    union = F.col("n_truth") + F.col("n_said") - F.col("shared")
    return classes.agg(F.avg(F.when(F.col("status") != "spurious", F.col("iou"))).alias("macro"), (F.sum("shared") / F.sum(union)).alias("micro"), F.count_if(F.col("status") == "missed").alias("missed"))


def band_delta(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Valid pairs, changed cells, cells without data on one or both sides; mean, MAE, RMSE, least and greatest difference."""
    j = a.select(*key, F.col("value").alias("_a")).join(b.select(*key, F.col("value").alias("_b")), key)
    d = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_b") - F.col("_a"))
    return j.withColumn("_d", d).agg(
        F.count("_d").alias("valid"), F.count_if(F.col("_d") != 0).alias("changed"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("only_b"), F.count_if(F.col("_a").isNull() & F.col("_b").isNull()).alias("neither"),
        F.avg("_d").alias("mean"), F.avg(F.abs("_d")).alias("mae"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"), F.min("_d").alias("least"), F.max("_d").alias("most"))


def tiles(cells: DataFrame, size: int, group: list[str] | None = None) -> DataFrame:
    """By tile: cells, signed mean, root mean square and detail energy (variance)."""
    t = lambda c: F.floor(F.col(c) / size).cast("long")
    return cells.groupBy(*(group or []), t("x").alias("tx"), t("y").alias("ty")).agg(F.count("err").alias("cells"), F.avg("err").alias("mean"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms"), F.var_pop("err").alias("detail"))


def noise_envelope(repeats: DataFrame) -> DataFrame:
    """Largest difference of each tile (and of all, null tile) between any two repeats, which is its range over repeats."""
    r = repeats.groupBy("tile").agg((F.max("value") - F.min("value")).alias("noise"), F.count_distinct("run").alias("runs"))
    return r.union(r.agg(F.lit(None).cast("long").alias("tile"), F.max("noise").alias("noise"), F.max("runs").alias("runs")))


def outside_envelope(values: DataFrame, envelope: DataFrame, slack: float = 1e-12) -> DataFrame:
    """Tiles whose change exceeds their noise; unknown where a tile has no noise figure."""
    e = envelope.where("tile is not null").select("tile", "noise")
    return values.join(e, "tile", "left").select("tile", "value", F.when(F.col("noise").isNotNull(), F.abs("value") > F.col("noise") + slack).alias("beyond"))


def neighbours(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """Links (a, b) between marked cells (id, x, y) that touch."""
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    moved = cells.select(F.col("id").alias("a"), F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("_m")).select("a", "_m.x", "_m.y")
    return moved.join(cells.select(F.col("id").alias("b"), "x", "y"), ["x", "y"]).select("a", "b")


def summarised(cells: DataFrame, group: list[str], value: str = "err") -> DataFrame:
    """Mean, nearest-rank p50, p95, p99 and largest error, and shares above 0.1 and 0.5, of kept cells; NaN ranks as infinite, and nothing kept gives nulls."""
    v = F.when(F.isnan(value), float("inf")).otherwise(F.col(value).cast("double"))
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by _v)")
    return cells.withColumn("_v", v).groupBy(*group).agg(F.count("_v").alias("cells"), F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("_v").alias("most"), F.avg((F.col("_v") > 0.1).cast("int")).alias("above_01"), F.avg((F.col("_v") > 0.5).cast("int")).alias("above_05"))


def masked_summary(cells: DataFrame, group: list[str], masks: DataFrame, value: str = "err") -> DataFrame:
    """summarised() of the cells that no mask rectangle (group.., x0, y0, x1, y1, ends exclusive) covers; groups with nothing left keep their row. Rectangles are joined by rows of cells that they touch."""
    rows = masks.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).select(*group, "y", "x0", "x1").where("x0 < x1")
    spans = rows.groupBy(*group, "y").agg(F.collect_set(F.struct("x0", "x1")).alias("_m"))
    left = cells.join(spans, [*group, "y"], "left").where(~F.coalesce(F.exists("_m", lambda s: (F.col("x") >= s["x0"]) & (F.col("x") < s["x1"])), F.lit(False)))
    return cells.select(*group).distinct().join(summarised(left, group, value), group, "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def structural_checks(pixels: DataFrame, group: list[str]) -> DataFrame:
    """By group of (r, g, b), 0 to 255 or null where not finite: all black, all white, luminance of the encoded values, samples not finite."""
    c = lambda n: F.col(n) / 255
    light = 0.2126 * c("r") + 0.7152 * c("g") + 0.0722 * c("b")
    every = lambda v: F.bool_and((F.col("r") == v) & (F.col("g") == v) & (F.col("b") == v))
    return pixels.groupBy(*group).agg(F.coalesce(every(0), F.lit(False)).alias("all_black"), F.coalesce(every(255), F.lit(False)).alias("all_white"), F.avg(light).alias("mean"), F.min(light).alias("least"), F.max(light).alias("most"), F.count_if(F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()).alias("nonfinite"))


def settling_tiles(samples: DataFrame, change: int, final: int, frames: int) -> DataFrame:
    """By (tile, frame) of (tile, frame, at, value): mean error against the mean of the last `final` frames, and ghosting: how much of what stood before the change is left, as a projection, null where before and after are alike."""
    place = ["tile", "at"]
    levels = samples.groupBy(*place).agg(F.avg(F.when(F.col("frame") < change, F.col("value"))).alias("_pre"), F.avg(F.when(F.col("frame") >= frames - final, F.col("value"))).alias("_end"))
    j = samples.join(levels, place).withColumn("_d", F.col("_pre") - F.col("_end"))
    energy = F.sum(F.col("_d") * F.col("_d"))
    return j.groupBy("tile", "frame").agg(F.avg(F.abs(F.col("value") - F.col("_end"))).alias("error"), F.when(energy > 1e-12, F.sum((F.col("value") - F.col("_end")) * F.col("_d")) / energy).alias("ghosting"))


def worst_tiles(errors: DataFrame, final: int, frames: int, n: int = 16) -> DataFrame:
    """The n tiles of the largest error over the last frames, by tile on ties, with their persistent ghosting."""
    last = errors.where(F.col("frame") >= frames - final).groupBy("tile").agg(F.sum("error").alias("error"), F.avg("ghosting").alias("ghosting"))
    return last.orderBy(F.col("error").desc(), "tile").limit(n)


def attributed(errors: DataFrame, ids: DataFrame, group: list[str]) -> DataFrame:
    """By group and object id: pixels, error and its share of the group's; pixels without an id are unattributed (null id)."""
    j = errors.join(ids, [*group, "x", "y"], "left").groupBy(*group, "object").agg(F.count(F.lit(1)).alias("pixels"), F.sum("err").alias("error"))
    total = F.sum("error").over(Window.partitionBy(*group))
    return j.withColumn("share", F.when(total > 0, F.col("error") / total))


def hotspots(cells: DataFrame, limit: float, share: float, n: int = 256) -> DataFrame:
    """Stretches of touching cells (id, x, y, err) above the limit: box, cells, error, share of all error; of share or more, the n largest, the first by component on ties."""
    hot = cells.where(F.col("err") > limit)
    c = components(neighbours(hot))
    named = hot.join(c, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    total = cells.agg(F.sum("err").alias("_t"))  # one row
    out = named.groupBy("component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("cells"), F.sum("err").alias("error"))
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.col("error") / F.col("_t")).where(F.col("share") >= share).drop("_t")
    return out.orderBy(F.col("error").desc(), "component").limit(n)
