"""Numeric buffers of a baseline and a capture: depth, normals, motion, masks and ids.

A pixel is a row with both sides' samples. Kinds and encodings are columns, so a table may hold
buffers of all kinds; a pixel's error is one expression and each image's summary one grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default limits (fixed values): depth in its own units, angle in degrees, pixels of motion, share of changed samples.
LIMITS = {"depth": 0.01, "normal": 1.0, "motion": 0.5, "mask": 0.0, "id": 0.0}
#: Encodings that each kind may have, its default first (fixed values).
ENCODINGS = {"depth": ("linear01", "reverse_z", "r32f"), "normal": ("rgb_snorm", "oct"), "motion": ("rg_snorm",), "mask": ("exact",), "id": ("exact",)}


def _folded(x: Column, y: Column) -> list[Column]:
    """The vector that a point of the unfolded octahedron stands for: points outside the inner square lie on the far side."""
    z = 1 - F.abs(x) - F.abs(y)
    side = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    return [F.when(z < 0, (1 - F.abs(y)) * side(x)).otherwise(x), F.when(z < 0, (1 - F.abs(x)) * side(y)).otherwise(y), z]


def _with_unit(rows: DataFrame, sample: str, to: str) -> DataFrame:
    """rows with the unit vector (an array) of a normal's sample; null where it has no direction."""
    v = [F.get(sample, F.lit(i)) * 2 - 1 for i in range(3)]
    fold = F.col("encoding") == "oct"
    v = [F.when(fold, f).otherwise(p) for f, p in zip(_folded(v[0], v[1]), v, strict=True)]
    rows = rows.withColumn(to, F.array(*v))
    length = F.sqrt(F.aggregate(to, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn(to, F.when((length > 1e-12) & (length < float("inf")), F.transform(to, lambda x: x / length)))


def errors(pixels: DataFrame) -> DataFrame:
    """pixels with `state`, `error` and `relative`. pixels: (kind, encoding or null, scale or null, b, c arrays of doubles, and
    if given valid_b, valid_c).

    state: only_b, only_c, neither (by validity; a side without samples is invalid); odd (a sample that no error can be told of: not finite, a normal without
    direction, a kind or encoding that is not known); else compared. relative: of depth, the error against the baseline's depth."""
    kinds = [F.col("kind") == k for k in ENCODINGS]
    default, known = F.lit(None).cast("string"), F.lit(False)
    for k, at in zip(ENCODINGS, kinds, strict=True):
        default = F.when(at, ENCODINGS[k][0]).otherwise(default)
        known = known | (at & F.col("encoding").isin(*ENCODINGS[k]))
    rows = pixels.withColumn("encoding", F.coalesce("encoding", default))
    valid = lambda side: F.coalesce(F.col(f"valid_{side}") if f"valid_{side}" in pixels.columns else F.lit(True), F.lit(False)) & F.coalesce(F.size(side) > 0, F.lit(False))
    rows = _with_unit(_with_unit(rows.withColumns({"_vb": valid("b"), "_vc": valid("c")}), "b", "_nb"), "c", "_nc")
    at = lambda side, i: F.get(side, F.lit(i))
    depth = lambda side: F.when(F.col("encoding") == "reverse_z", 1 - at(side, 0)).otherwise(at(side, 0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    cosine = F.aggregate(F.zip_with("_nb", "_nc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.when(cosine.isNull(), None).when(F.col("_nb") == F.col("_nc"), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    step = [(at("c", i) - at("b", i)) * 2 * F.coalesce("scale", F.lit(1.0)) for i in (0, 1)]
    error = F.when(kinds[0], F.abs(depth("c") - depth("b"))).when(kinds[1], angle).when(kinds[2], F.sqrt(step[0] * step[0] + step[1] * step[1])).otherwise((F.col("b") != F.col("c")).cast("double"))
    rows = rows.withColumn("_error", F.when(known, error))
    state = F.when(~F.col("_vb") & ~F.col("_vc"), "neither").when(~F.col("_vc"), "only_b").when(~F.col("_vb"), "only_c").when(~F.coalesce(finite(F.col("_error")), F.lit(False)), "odd").otherwise("compared")
    rows = rows.withColumn("state", state)
    compared = F.col("state") == "compared"
    rows = rows.withColumn("error", F.when(compared, F.col("_error"))).withColumn("relative", F.when(compared & kinds[0], F.col("error") / F.greatest(F.abs(depth("b")), F.lit(1e-12))))
    return rows.drop("_vb", "_vc", "_nb", "_nc", "_error")


def summaries(pixels: DataFrame, group: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """By group and kind: pixels by state, mean, most and mean relative error, changed (pixels with an error), above (share of those compared that exceed the limit), status: pass if the mean is within the kind's limit, fail, or unknown (nothing compared, or odd samples)."""
    limit = F.create_map(*[F.lit(x) for k, v in (LIMITS | (limits or {})).items() for x in (k, v)])[F.col("kind")]
    rows = errors(pixels).withColumn("_limit", limit)
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("compared", "only_b", "only_c", "neither", "odd")]
    out = rows.groupBy(*group, "kind").agg(
        *states, F.avg("error").alias("mean"), F.max("error").alias("most"), F.avg("relative").alias("relative"), F.count_if(F.col("error") > 0).alias("changed"),
        F.avg((F.col("error") > F.col("_limit")).cast("double")).alias("above"), F.max("_limit").alias("_limit"))
    status = F.when((F.col("compared") == 0) | (F.col("odd") > 0) | F.col("_limit").isNull(), "unknown").when(F.col("mean") <= F.col("_limit"), "pass").otherwise("fail")
    return out.withColumn("status", status).drop("_limit")
