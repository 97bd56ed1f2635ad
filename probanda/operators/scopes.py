"""Changes inside and outside declared regions, and tile trees held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Side of the squares by which pixels and boxes meet.
SQUARE = 64


def included(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """cells (image, x, y, ..) with `inside`: whether a box (image, x, y, w, h) of their image holds them. A box and the pixels meet in the squares that it touches, and a pixel in many boxes counts once."""
    b = boxes.where("w > 0 and h > 0").select("image", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("w") - 1).alias("_x1"), (F.col("y") + F.col("h") - 1).alias("_y1"))
    square = lambda c: F.floor(F.col(c) / SQUARE)
    b = b.withColumn("_sx", F.explode(F.sequence(square("_x"), square("_x1")))).withColumn("_sy", F.explode(F.sequence(square("_y"), square("_y1"))))
    c = cells.withColumns({"_sx": square("x"), "_sy": square("y")})
    held = c.select("image", "x", "y", "_sx", "_sy").join(b, ["image", "_sx", "_sy"]).where("x between _x and _x1 and y between _y and _y1").select("image", "x", "y").distinct().withColumn("inside", F.lit(True))
    return cells.join(held, ["image", "x", "y"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def localized(cells: DataFrame, boxes: DataFrame, most_outside: float | None = None) -> DataFrame:
    """By image: pixels, changed, mean and most (error) of what lies inside the boxes, outside, and on the boundary (pixels with a neighbour on the other side), and a verdict.

    cells: (image, x, y, before, after, error). verdict: invalid_region (no box, or one that leaves the image), collateral_change (a sample outside
    changed; with most_outside, an error outside exceeds it), else preserved. Boundary pixels count in their own scope too."""
    rows = included(cells.select("image", "x", "y", "before", "after", "error"), boxes)
    across, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    other = F.lit(False)
    for axis, w in (("x", across), ("y", down)):
        for f, step in ((F.lag, -1), (F.lead, 1)):
            other = other | F.coalesce((f(axis).over(w) == F.col(axis) + step) & (f("inside").over(w) != F.col("inside")), F.lit(False))
    rows = rows.withColumn("edge", other).withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))
    scopes = {"inside": F.col("inside"), "outside": ~F.col("inside"), "boundary": F.col("edge")}
    sums = []
    for name, of in scopes.items():
        sums += [F.count_if(of).alias(f"{name}_pixels"), F.count_if(of & F.col("changed")).alias(f"{name}_changed"), F.avg(F.when(of, F.col("error"))).alias(f"{name}_mean"), F.max(F.when(of, F.col("error"))).alias(f"{name}_most")]
    out = rows.groupBy("image").agg(*sums, (F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    drawn = boxes.groupBy("image").agg(F.min(F.least("x", "y", F.col("w") - 1, F.col("h") - 1)).alias("_least"), F.max(F.col("x") + F.col("w")).alias("_right"), F.max(F.col("y") + F.col("h")).alias("_bottom"))
    j = out.join(drawn, "image", "left")
    sound = F.coalesce((F.col("_least") >= 0) & (F.col("_right") <= F.col("_w")) & (F.col("_bottom") <= F.col("_h")), F.lit(False))
    spoilt = F.col("outside_changed") > 0 if most_outside is None else F.coalesce(F.col("outside_most") > most_outside, F.lit(False))
    return j.withColumn("verdict", F.when(~sound, "invalid_region").when(spoilt, "collateral_change").otherwise("preserved")).drop("_w", "_h", "_least", "_right", "_bottom")


def tile_keys(files: DataFrame) -> DataFrame:
    """files (path, ..) with z, x, y of tile trees (z/x/y.png, jpg, jpeg or webp) and `problem`: malformed, out_of_range (2^z tiles a side), repeated (one key under several names), or null."""
    shape = r"^(\d{1,2})/(\d{1,9})/(\d{1,9})\.(?:png|jpe?g|webp)$"
    part = lambda i: F.regexp_extract("path", shape, i)
    rows = files.withColumns({k: F.when(part(i) != "", part(i).cast("long")) for i, k in ((1, "z"), (2, "x"), (3, "y"))})
    wide = F.pow(F.lit(2.0), "z")
    problem = F.when(F.col("z").isNull(), "malformed").when((F.col("z") > 30) | (F.col("x") >= wide) | (F.col("y") >= wide), "out_of_range")
    rows = rows.withColumn("problem", problem)
    same = F.count(F.lit(1)).over(Window.partitionBy("z", "x", "y", "problem"))
    return rows.withColumn("problem", F.when(F.col("problem").isNull() & (same > 1), "repeated").otherwise(F.col("problem")))


def tile_coverage(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """By zoom z of two tile trees (path, digest): tiles of either, paired, missing (only in the reference), extra, changed (other digests), coverage (share of the reference's tiles that are there) and verdict identical or changed. Files with a problem are no tiles."""
    side = lambda df, name: tile_keys(df).where("problem is null").select("z", "x", "y", F.col("digest").alias(f"_{name}"), F.lit(True).alias(name))
    j = side(reference, "reference").join(side(candidate, "candidate"), ["z", "x", "y"], "full_outer")
    a, b = F.col("reference").isNotNull(), F.col("candidate").isNotNull()
    out = j.groupBy("z").agg(F.count("reference").alias("reference_tiles"), F.count("candidate").alias("candidate_tiles"), F.count_if(a & b).alias("paired"), F.count_if(a & ~b).alias("missing"), F.count_if(b & ~a).alias("extra"), F.count_if(a & b & ~F.col("_reference").eqNullSafe(F.col("_candidate"))).alias("changed"))
    whole = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("changed") == 0)
    return out.withColumn("coverage", F.when(F.col("reference_tiles") > 0, F.col("paired") / F.col("reference_tiles"))).withColumn("verdict", F.when(whole, "identical").otherwise("changed"))
