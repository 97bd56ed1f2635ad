"""Photosensitivity: flashes of cells, the area that flashes within a second, and the stretches of frames at risk.

A flash is a pair of opposing changes of a cell; no change is counted twice. Which change closes
a pair follows from the runs of changes alike in direction: one closes unless the run before it was a
single change that closed itself. So pairs are found by windows over runs, without a fold:
after a run of two or more every other run closes, beginning with the next; before any such, every second run does.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits of the published guidance (fixed values): change of relative luminance, luminance of the darker state, share of red, change of redness and its scale, flashes in a second, share of the screen; and the shares at which a warning is due.
CHANGE, DARKER, RED_SHARE, RED_CHANGE, RED_SCALE = 0.1, 0.8, 0.8, 20.0, 320.0
MOST, AREA, WARN_FLASHES, WARN_AREA = 3, 0.25, 3, 0.8


def _changes(cells: DataFrame, direction: Column) -> DataFrame:
    return cells.withColumn("direction", direction).where("direction <> 0").select("series", "cell", "frame", "direction")


def luminance_changes(cells: DataFrame) -> DataFrame:
    """series, cell, frame, direction (1 or -1) of the changes between frames that count. cells: (series, cell, frame, luminance). A null luminance changes nothing."""
    before = F.lag("luminance").over(Window.partitionBy("series", "cell").orderBy("frame"))
    step = F.col("luminance") - before
    counts = (F.abs(step) >= CHANGE) & (F.least(before, "luminance") < DARKER)
    return _changes(cells, F.when(counts, F.signum(step)).otherwise(0).cast("int"))


def red_changes(cells: DataFrame) -> DataFrame:
    """The same of saturated red. cells: (series, cell, frame, red, green, blue), linear."""
    total = F.col("red") + F.col("green") + F.col("blue")
    red = cells.withColumn("_full", F.coalesce((total > 0) & (F.col("red") / F.nullif(total, F.lit(0.0)) >= RED_SHARE), F.lit(False))).withColumn("_red", F.greatest(F.col("red") - F.col("green") - F.col("blue"), F.lit(0.0)) * RED_SCALE)
    w = Window.partitionBy("series", "cell").orderBy("frame")
    step = F.col("_red") - F.lag("_red").over(w)
    return _changes(red, F.when((F.col("_full") | F.lag("_full").over(w)) & (F.abs(step) > RED_CHANGE), F.signum(step)).otherwise(0).cast("int"))


def flashes(changes: DataFrame) -> DataFrame:
    """series, cell, start, end: the frame before the pair's first change, and the frame of its second."""
    w = Window.partitionBy("series", "cell").orderBy("frame")
    begins = F.coalesce((F.col("direction") != F.lag("direction").over(w)).cast("int"), F.lit(1))
    runs = changes.withColumn("run", F.sum(begins).over(w)).groupBy("series", "cell", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series", "cell").orderBy("run")
    long_before = F.max(F.when(F.col("n") > 1, F.col("run"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # The place of the run after the last long one; where there is none, the first run cannot close.
    closes = (F.col("run") - F.coalesce(long_before + 1, F.lit(2))) % 2 == 0
    paired = runs.withColumn("start", F.lag("last").over(w) - 1).withColumn("closes", closes)
    return paired.where("closes and start is not null").select("series", "cell", "start", F.col("first").alias("end"))


def flashing_frames(found: DataFrame, cells: DataFrame, fps: float, seconds: float = 1.0) -> DataFrame:
    """By series and frame: peak (most flashes of a cell within the last second), shares of the cells above MOST and from WARN_FLASHES on, start (of the earliest flash still within the second)."""
    stay = ceil(fps * seconds - 1e-9) - 1
    shape = cells.groupBy("series").agg(F.max("frame").alias("_last"), F.count_distinct("cell").alias("_cells"))
    each = found.withColumn("frame", F.explode(F.sequence("end", F.col("end") + stay)))
    by_cell = each.groupBy("series", "cell", "frame").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("end", "start")).alias("m"))
    by_frame = by_cell.groupBy("series", "frame").agg(F.max("n").alias("peak"), F.count_if(F.col("n") > MOST).alias("_above"), F.count_if(F.col("n") >= WARN_FLASHES).alias("_near"), F.min("m").alias("m"))
    out = by_frame.join(shape, "series").where("frame <= _last")
    return out.select("series", "frame", "peak", (F.col("_above") / F.col("_cells")).alias("above"), (F.col("_near") / F.col("_cells")).alias("near"), F.col("m.start").alias("start"))


def risk_segments(frames: DataFrame, area: float = AREA) -> DataFrame:
    """Stretches of frames at risk: series, start, end, verdict (FAIL if any of its frames fails, else WARN), peak, area (percent)."""
    fails = F.col("above") > area
    warns = (F.col("above") >= area * WARN_AREA) | (F.col("near") > area)
    risky = frames.withColumn("_fails", fails).where(fails | warns)
    w = Window.partitionBy("series").orderBy("frame")
    apart = F.coalesce((F.lag("frame").over(w) + 1 < F.col("start")).cast("int"), F.lit(1))
    risky = risky.withColumn("_part", F.sum(apart).over(w))
    share = F.when(F.col("_fails"), F.col("above")).otherwise(F.col("near"))
    out = risky.groupBy("series", "_part").agg(F.min_by("start", "frame").alias("start"), F.max("frame").alias("end"), F.when(F.max("_fails"), "FAIL").otherwise("WARN").alias("verdict"), F.max("peak").alias("peak"), (100 * F.max(share)).alias("area"))
    return out.drop("_part")
