"""aHash, dHash and pHash of grey images that are held as tables of pixels.

Resizing and the cosine transform are separable sums. The pixels of an image of up to PACKED
pixels are one row (as they come, or gathered), and its sums are products of small matrices. For larger images
both are joins with sparse tables of weights, first along the rows and then along the columns: partial sums
shrink each side before it is shuffled, and no task needs a whole image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from ..sources.tables import written

#: Width and height that each hash resizes to (fixed by the hashes' definitions).
SIDES = {"a": (8, 8), "d": (9, 8), "p": (32, 32)}
#: The lowest frequencies of the transform that pHash keeps along a side (fixed likewise).
FREQUENCIES = 8
#: Weight tables up to this many rows (32 bytes each) are broadcast; for more distinct sizes they are joined by shuffle.
SMALL = 1_000_000
#: Pixels up to which an image is one row (twelve bytes each, some thousands of such rows at a time).
PACKED = 1024
#: Sums are rounded to this many places before they are compared, so that their order cannot change a bit.
PLACES = 6


def triangle_weights(sizes: DataFrame, side: int, of: str = "adp") -> DataFrame:
    """size, kind, at, out, weight: what input place `at` adds to output place `out` when a line of `size` pixels is resized (side 0: width, 1: height). The triangle spans one output pixel to each side, or one input pixel where the line grows."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s[side]).alias("outs")) for k, s in SIDES.items() if k in of])
    rows = sizes.select("size", F.inline(kinds)).withColumn("out", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    ratio = F.col("size") / F.col("outs")
    rows = rows.withColumn("wide", F.greatest(ratio, F.lit(1.0))).withColumn("middle", (F.col("out") + 0.5) * ratio)
    first = F.greatest(F.floor(F.col("middle") - F.col("wide")), F.lit(0))
    last = F.least(F.ceil(F.col("middle") + F.col("wide")), F.col("size")) - 1
    rows = rows.withColumn("at", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    rows = rows.withColumn("w", 1 - F.abs(F.col("at") + 0.5 - F.col("middle")) / F.col("wide")).where("w > 0")
    return rows.select("size", "kind", "at", "out", (F.col("w") / F.sum("w").over(Window.partitionBy("size", "kind", "out"))).alias("weight"))


def _hinted(weights: DataFrame, name: str) -> DataFrame:
    rows = written(weights, name)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _whole(x: Column) -> Column:
    return F.round(F.round(x, PLACES))


def resized(pixels: DataFrame, of: str = "adp") -> DataFrame:
    """image, kind, y, x, v (whole numbers) of every hash's small picture. pixels: (image, width, height, y, x, v)."""
    tall = _hinted(triangle_weights(pixels.select(F.col("height").cast("int").alias("size")).distinct(), 1, of), "heights")
    wide = _hinted(triangle_weights(pixels.select(F.col("width").cast("int").alias("size")).distinct(), 0, of), "widths")
    rows = pixels.join(tall, (F.col("height") == F.col("size")) & (F.col("y") == F.col("at")))
    rows = rows.groupBy("image", "width", "kind", F.col("out").alias("oy"), "x").agg(F.sum(F.col("v") * F.col("weight")).alias("s"))
    rows = rows.join(wide.withColumnRenamed("kind", "_kind"), (F.col("width") == F.col("size")) & (F.col("x") == F.col("at")) & (F.col("kind") == F.col("_kind")))
    return rows.groupBy("image", "kind", F.col("oy").alias("y"), F.col("out").alias("x")).agg(_whole(F.sum(F.col("s") * F.col("weight"))).alias("v"))


def cosines(spark) -> DataFrame:
    """at, k, c: the cosine of frequency k at place `at` of the picture that pHash uses."""
    n = SIDES["p"][0]
    rows = spark.range(n).select(F.col("id").cast("int").alias("at")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FREQUENCIES - 1))))
    return rows.withColumn("c", F.cos((2 * F.col("at") + 1) * F.col("k") * F.pi() / (2 * n)))


def transform(picture: DataFrame) -> DataFrame:
    """image, u, v, c: the lowest frequencies of the pictures (image, y, x, v)."""
    table = F.broadcast(cosines(picture.sparkSession))
    rows = picture.join(table, F.col("x") == F.col("at")).groupBy("image", "y", F.col("k").alias("u")).agg(F.sum(F.col("v") * F.col("c")).alias("s"))
    rows = rows.join(table, F.col("y") == F.col("at")).groupBy("image", "u", F.col("k").alias("v")).agg(F.round(F.sum(F.col("s") * F.col("c")), PLACES).alias("c"))
    return rows


def _line(size: int, outs: int) -> np.ndarray:
    """triangle_weights of one size as a matrix (out, at)."""
    ratio = size / outs
    wide = max(ratio, 1.0)
    w = np.maximum(1 - np.abs(np.arange(size) + 0.5 - (np.arange(outs)[:, None] + 0.5) * ratio) / wide, 0)
    return w / w.sum(1, keepdims=True)


def _bits(picture: np.ndarray, kind: str) -> np.ndarray:
    """The 64-bit codes of the small pictures (image, y, x) of a kind."""
    if kind == "a":
        on = picture > picture.mean((1, 2), keepdims=True)
    elif kind == "d":
        on = picture[:, :, :-1] > picture[:, :, 1:]
    else:
        n = SIDES["p"][0]
        c = np.cos((2 * np.arange(n) + 1) * np.arange(FREQUENCIES)[:, None] * np.pi / (2 * n))
        found = np.round(c @ picture @ c.T, PLACES).reshape(len(picture), -1)
        on = found > np.sort(found[:, 1:], 1)[:, [FREQUENCIES * FREQUENCIES // 2 - 1]]
        on[:, 0] = False
    return (on.reshape(len(picture), 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1).view(np.int64)


def _coded(grey: np.ndarray, kind: str) -> np.ndarray:
    """The codes of a kind of images of one size (image, y, x)."""
    h, w = grey.shape[1:]
    small = np.round(_line(h, SIDES[kind][1]) @ grey @ _line(w, SIDES[kind][0]).T, PLACES)
    return _bits(np.copysign(np.floor(np.abs(small) + 0.5), small), kind)


def _packed(pixels: DataFrame, of: str) -> DataFrame:
    """The hashes of small images, a row of places and values each."""

    @F.pandas_udf(", ".join(f"{k}hash long" for k in of))
    def codes(widths: pd.Series, heights: pd.Series, places: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({f"{k}hash": np.zeros(len(widths), np.int64) for k in of})
        for (w, h), rows in pd.DataFrame({"w": widths.to_numpy(), "h": heights.to_numpy()}).groupby(["w", "h"]).indices.items():
            at = np.concatenate([places.iloc[i] for i in rows]).astype(np.int64) + np.repeat(np.arange(len(rows)) * w * h, [len(places.iloc[i]) for i in rows])
            grey = np.bincount(at, np.concatenate([values.iloc[i] for i in rows]), len(rows) * w * h).reshape(len(rows), h, w)
            for k in of:
                out.iloc[rows, out.columns.get_loc(f"{k}hash")] = _coded(grey, k)
        return out

    seen = F.col("v").isNotNull() & F.col("y").between(0, F.col("height") - 1) & F.col("x").between(0, F.col("width") - 1)
    kept = lambda c: F.collect_list(F.when(seen, c))
    rows = pixels.groupBy("image", "width", "height").agg(kept((F.col("y") * F.col("width") + F.col("x")).cast("int")).alias("places"), kept(F.col("v").cast("double")).alias("values"))
    return rows.select("image", codes("width", "height", "places", "values").alias("c")).select("image", "c.*")


def hashes(pixels: DataFrame, of: str = "adp") -> DataFrame:
    """image and those of ahash, dhash, phash (64-bit codes) that `of` names, of every image of the pixels (image, width, height, y, x, v from 0 to 255).

    aHash: brighter than the mean; dHash: brighter than the pixel to the right; pHash: above the
    median of all frequencies but the constant one. Bits ascend by row and then column. Pixels
    that are missing or null add nothing, as black does; an image without any has codes of zeros."""
    small = F.col("width") * F.col("height") <= PACKED
    sizes = pixels.agg(F.count_if(small), F.count_if(~small)).first()
    if not sizes[1]:
        return _packed(pixels, of)
    return _packed(pixels.where(small), of).union(_joined(pixels.where(~small), of)) if sizes[0] else _joined(pixels, of)


def _lines(images: DataFrame, of: str) -> DataFrame:
    """The hashes of small images, each the one row that it came as: nothing is shuffled."""

    @F.pandas_udf(", ".join(f"{k}hash long" for k in of))
    def codes(widths: pd.Series, heights: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({f"{k}hash": np.zeros(len(widths), np.int64) for k in of})
        for (w, h), rows in pd.DataFrame({"w": widths.to_numpy(), "h": heights.to_numpy()}).groupby(["w", "h"]).indices.items():
            held = values.to_numpy()[rows]
            if all(len(v) == h * w for v in held):
                grey = np.concatenate(held)
            else:
                grey = np.concatenate([np.r_[v[: h * w], np.zeros(max(h * w - len(v), 0))] for v in held])
            for k in of:
                out.iloc[rows, out.columns.get_loc(f"{k}hash")] = _coded(grey.reshape(len(rows), h, w), k)
        return out

    values = F.col("values")
    if images.schema["values"].dataType != ArrayType(DoubleType(), False):
        values = F.transform(values, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return images.select("image", codes("width", "height", values).alias("c")).select("image", "c.*")


def line_hashes(images: DataFrame, of: str = "adp") -> DataFrame:
    """hashes() of images that are rows already: (image, width, height, values: the pixels row by row; missing and null ones add nothing).

    Only ids are shuffled, to see which come more than once: their rows are one image, as pixels of one id are
    in hashes(), and go there with images of more than PACKED pixels. Rows without values are no images."""
    rows = images.where(F.size("values") > 0)
    keys = ["image", "width", "height"]
    again = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]), "repeated")
    n = again.count()
    large = F.col("width") * F.col("height") > PACKED
    rest = rows.where(large)
    if n:
        found = F.broadcast(again) if n <= SMALL else again
        same = F.col("image").eqNullSafe(F.col("_image")) & F.col("width").eqNullSafe(F.col("_width")) & F.col("height").eqNullSafe(F.col("_height"))
        rest = rest.union(rows.where(~large).join(found, same, "left_semi"))
        rows = rows.join(found, same, "left_anti")
    out = _lines(rows.where(~large), of)
    if not n and rest.isEmpty():
        return out
    pixels = rest.select(*keys, F.posexplode("values").alias("_at", "v"))
    return out.union(hashes(pixels.select(*keys, F.expr("_at div width").cast("int").alias("y"), F.expr("_at % width").alias("x"), "v"), of))


def _joined(pixels: DataFrame, of: str) -> DataFrame:
    """The hashes of images of any size, by joins."""
    small = written(resized(pixels.where(F.col("v").isNotNull()), of), "pictures")
    own = lambda k: small.where(F.col("kind") == k)
    picked = []
    if "a" in of:
        picked.append(own("a").withColumn("on", F.col("v") > F.avg("v").over(Window.partitionBy("image"))))
    if "d" in of:
        picked.append(own("d").withColumn("on", F.col("v") > F.lead("v").over(Window.partitionBy("image", "y").orderBy("x"))).where("x < 8"))
    if "p" in of:
        p = transform(own("p")).where("u + v > 0")
        middle = F.element_at(F.array_sort(F.collect_list("c").over(Window.partitionBy("image"))), FREQUENCIES * FREQUENCIES // 2)
        picked.append(p.select("image", F.lit("p").alias("kind"), F.col("v").alias("y"), F.col("u").alias("x"), (F.col("c") > middle).alias("on")))
    code = lambda k: F.coalesce(F.bit_or(F.when((F.col("kind") == k) & F.col("on"), F.expr("shiftleft(1L, int(8 * y + x))"))), F.lit(0).cast("long"))
    rows = pixels.select("image", F.lit("").alias("kind"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(False).alias("on")).distinct()
    for bits in picked:
        rows = rows.union(bits.select("image", "kind", "y", "x", "on"))
    return rows.groupBy("image").agg(*[code(k).alias(f"{k}hash") for k in of])
