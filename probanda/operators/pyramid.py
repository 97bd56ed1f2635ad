"""Spatial evidence of two images: means over ever larger squares, profiles of tiles, regions of tiles, and the kind of change.

The levels are a quad-tree: each is summed from the level below, so every level is one shuffle of a
table four times smaller than the one before. Excluded pixels are rows that are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from .components import components

#: Default policy (fixed values): coarse difference that counts as none, share of the finest difference that may remain at the coarsest, shifts of a tile in itself and against its mean, least mean, deviations of its interval, tiles that make a region, tiles that may shift, their share, change of detail, change of gaps.
POLICY = {"coarse": 0.002, "remains": 0.3, "shift": 0.02, "relative": 0.02, "floor": 0.02, "z": 1.96, "region": 3, "sparse": 2, "share": 0.25, "detail": 0.1, "gap": 0.05}


def levels(cells: DataFrame, n: int = 3) -> DataFrame:
    """image, level (0 to n), squares, difference (mean absolute difference of the squares' means, by their pixels). cells: (image, x, y, b, c)."""
    now = cells.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(1).cast("long").alias("w"), F.col("b").cast("double").alias("b"), F.col("c").cast("double").alias("c"))
    out = None
    for level in range(n + 1):
        if level:
            now = written(now.groupBy("image", F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(*[F.sum(v).alias(v) for v in "wbc"]), f"level{level}")
        # The difference of two means times their pixels is the difference of the sums.
        row = now.groupBy("image").agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("squares"), (F.sum(F.abs(F.col("c") - F.col("b"))) / F.sum("w")).alias("difference"))
        out = row if out is None else out.union(row)
    return out


def ratio(a: Column, b: Column) -> Column:
    """b / a; 1 where both are nothing, null where only a is."""
    none = lambda x: F.abs(x) < 1e-15
    return F.when(none(a) & none(b), 1.0).when(~none(a), b / a)


def _laplacians(cells: DataFrame, tile: int) -> DataFrame:
    """cells with _lb and _lc, the absolute Laplacians where all four neighbours are there, and _inside: whether these are of the same tile."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    sides = cells
    for axis, w, names in (("x", row, ("_l", "_r")), ("y", column, ("_u", "_d"))):
        for f, step, name in ((F.lag, -1, names[0]), (F.lead, 1, names[1])):
            there = f(axis).over(w) == F.col(axis) + step
            sides = sides.withColumns({f"{name}{v}": F.when(there, f(v).over(w)) for v in "bc"})
    lap = lambda v: F.abs(4 * F.col(v) - F.col(f"_l{v}") - F.col(f"_r{v}") - F.col(f"_u{v}") - F.col(f"_d{v}"))
    place = lambda a: F.col(a) % tile
    inside = F.lit(True)
    for a in "xy":
        inside = inside & (place(a) > 0) & (place(a) < tile - 1)
    return sides.select(*cells.columns, lap("b").alias("_lb"), lap("c").alias("_lc"), inside.alias("_inside"))


def tile_profiles(cells: DataFrame, tile: int = 32, policy: dict | None = None) -> DataFrame:
    """image, tx, ty and per tile: pixels, means, shift and its interval, contrasts, ratios of variance and of detail, gap change, whether it shifted in itself and against its mean. cells may have gap_b and gap_c (booleans)."""
    p = POLICY | (policy or {})
    gaps = {"gap_b", "gap_c"} <= set(cells.columns)
    rows = cells if gaps else cells.withColumns({"gap_b": F.lit(None).cast("boolean"), "gap_c": F.lit(None).cast("boolean")})
    rows = rows.select("image", "x", "y", F.col("b").cast("double").alias("b"), F.col("c").cast("double").alias("c"), "gap_b", "gap_c")
    rows = _laplacians(rows, tile).withColumns({"tx": F.floor(F.col("x") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int")})
    detail = lambda v: F.coalesce(F.avg(F.when(F.col("_inside"), F.col(v))), F.lit(0.0))
    # A shift of just the limit is told by the last bit of two means, so these are summed line by line, however the rows come.
    mean = lambda v: F.try_divide(F.aggregate("_lines", F.lit(0.0), lambda s, e: s + F.coalesce(e[v], F.lit(0.0))), F.col(f"_n{v}"))
    t = rows.groupBy("image", "tx", "ty").agg(
        F.count(F.lit(1)).alias("pixels"), F.array_sort(F.collect_list(F.struct("y", "x", "b", "c"))).alias("_lines"), F.count("b").alias("_nb"), F.count("c").alias("_nc"), F.var_pop("b").alias("_vb"), F.var_pop("c").alias("_vc"),
        F.coalesce(F.var_samp(F.col("c") - F.col("b")), F.lit(0.0)).alias("_vd"), detail("_lb").alias("_db"), detail("_lc").alias("_dc"),
        F.avg(F.col("gap_b").cast("int")).alias("_gb"), F.avg(F.col("gap_c").cast("int")).alias("_gc"))
    t = t.withColumns({"b_mean": mean("b"), "c_mean": mean("c")}).drop("_lines").withColumn("shift", F.col("c_mean") - F.col("b_mean")).withColumn("_half", p["z"] * F.sqrt(F.col("_vd") / F.col("pixels")))
    t = t.withColumn("_sure", F.abs("shift") > F.col("_half")).withColumn("relative", F.col("shift") / F.greatest("b_mean", F.lit(p["floor"])))
    contrast = lambda v, m: F.sqrt(v) / F.greatest(m, F.lit(p["floor"]))
    return t.select(
        "image", "tx", "ty", "pixels", "b_mean", "c_mean", "shift", "relative", (F.col("shift") - F.col("_half")).alias("low"), (F.col("shift") + F.col("_half")).alias("high"),
        contrast("_vb", "b_mean").alias("b_contrast"), contrast("_vc", "c_mean").alias("c_contrast"), ratio(F.col("_vb"), F.col("_vc")).alias("variance_ratio"), ratio(F.col("_db"), F.col("_dc")).alias("detail_ratio"),
        (F.col("_gc") - F.col("_gb")).alias("gap_change"), (F.col("_sure") & (F.abs("shift") > p["shift"])).alias("shifted"), (F.col("_sure") & (F.abs("relative") > p["relative"])).alias("relatively_shifted"))


def regions(tiles: DataFrame) -> DataFrame:
    """image, region (a number), tiles: the parts of the tiles (image, tx, ty) that hang together by their sides."""
    nodes = written(tiles.select("image", "tx", "ty").withColumn("node", F.monotonically_increasing_id()), "tiles")
    beside = lambda dx, dy: nodes.select("image", (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.col("node").alias("other"))
    links = nodes.join(beside(1, 0).union(beside(0, 1)), ["image", "tx", "ty"]).select(F.col("node").alias("a"), F.col("other").alias("b"))
    found = nodes.join(components(links), "node", "left").withColumn("region", F.coalesce("component", "node"))
    return found.groupBy("image", "region").agg(F.count(F.lit(1)).alias("tiles"))


def change_classes(cells: DataFrame, tile: int = 32, n: int = 3, policy: dict | None = None) -> DataFrame:
    """image, class, regions, shifted, share, detail_ratio, coarse, remains by image. Classes: identical; texture_noise_only (nothing
    of it is left in the large, or it stays below every limit); systematic_shift (tiles of a region shifted, or gaps changed); else unclassified."""
    p = POLICY | (policy or {})
    known = written(levels(cells, n), "levels")
    at = lambda k: F.max(F.when(F.col("level") == k, F.col("difference")))
    scale = known.groupBy("image").agg(at(min(2, n)).alias("coarse"), at(n).alias("_last"), at(0).alias("_first"))
    tiles = written(tile_profiles(cells, tile, p), "profiles")
    gaps = {"gap_b", "gap_c"} <= set(cells.columns)
    rows = cells if gaps else cells.withColumns({"gap_b": F.lit(None).cast("boolean"), "gap_c": F.lit(None).cast("boolean")})
    rows = _laplacians(rows.select("image", "x", "y", F.col("b").cast("double").alias("b"), F.col("c").cast("double").alias("c"), "gap_b", "gap_c"), tile)
    whole = rows.groupBy("image").agg(
        F.count_if(F.col("b") != F.col("c")).alias("_changed"), F.coalesce(F.avg("_lb"), F.lit(0.0)).alias("_db"), F.coalesce(F.avg("_lc"), F.lit(0.0)).alias("_dc"), F.count("gap_b").alias("_gaps"),
        F.count_if(~F.col("gap_b")).cast("double").alias("_nb"), F.count_if(~F.col("gap_c")).cast("double").alias("_nc"), F.count_if(F.col("gap_b") != F.col("gap_c")).alias("_xor"), F.count_if(~F.col("gap_b") | ~F.col("gap_c")).alias("_union"))
    whole = whole.withColumn("detail_ratio", ratio(F.col("_db"), F.col("_dc")))
    far = lambda x, limit: F.coalesce(F.abs(x - 1) > limit, F.lit(True))
    covered = (F.col("_gaps") > 0) & (far(ratio(F.col("_nb"), F.col("_nc")), p["gap"]) | (F.col("_xor") / F.greatest("_union", F.lit(1)) > p["gap"]))
    counted = tiles.groupBy("image").agg(F.count_if("shifted").alias("shifted"), (F.count_if("relatively_shifted") / F.count(F.lit(1))).alias("share"))
    state = whole.join(scale, "image").join(counted, "image").withColumn("_covered", covered).withColumn("_detail", far(F.col("detail_ratio"), p["detail"])).withColumn("_small", F.col("coarse") <= p["coarse"])
    state = written(state.withColumn("_benign", F.col("_small") & ~F.col("_detail") & ~F.col("_covered") & (F.col("shifted") <= p["sparse"]) & (F.col("share") <= p["share"])), "state")
    taken = F.col("shifted") | F.col("relatively_shifted") | F.coalesce(F.abs("gap_change") > p["gap"], F.lit(False)) | (~F.col("_small") & F.col("_detail") & far(F.col("t.detail_ratio"), p["detail"]))
    chosen = tiles.alias("t").join(state.where("not _benign").select(F.col("image").alias("_image"), "_small", "_detail"), F.col("image") == F.col("_image")).where(taken)
    large = regions(chosen.select("image", "tx", "ty")).where(F.col("tiles") >= p["region"]).groupBy("image").agg(F.count(F.lit(1)).alias("regions"))
    out = state.join(large, "image", "left").withColumn("regions", F.coalesce("regions", F.lit(0))).withColumn("remains", ratio(F.col("_first"), F.col("_last")))
    fades = F.col("_last") <= F.col("_first") * p["remains"]
    kind = F.when(F.col("_changed") == 0, "identical").when(F.col("_benign") | (fades & (F.col("regions") == 0) & ~F.col("_detail") & ~F.col("_covered")), "texture_noise_only").when((F.col("regions") > 0) | F.col("_covered"), "systematic_shift").otherwise("unclassified")
    return out.select("image", kind.alias("class"), "regions", "shifted", "share", "detail_ratio", "coarse", "remains")
