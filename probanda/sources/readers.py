"""Sources: captures, sidecars, timing exports, frame maps, subtitles, boxes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType
from pyspark.sql.window import Window

from ..functions.scalars import seconds

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff", "exr", "hdr")

PERF = "schema string, unit string, frame struct<value:double,samples:bigint,stat:string>, terms array<struct<id:string,label:string,kind:string,value:double,parent:string,spread:struct<min:double,max:double>>>, counters map<string,map<string,double>>"


def captures(spark: SparkSession, root: str, run: str) -> DataFrame:
    """run, name (path below root), path, sha256 of every image file; suffixes in any case, ID sidecars left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index(F.col("path"), root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    return f.where(kind.isin(*IMAGES) & ~F.col("path").rlike(r"\.id\.[a-z]+$")).select(F.lit(run).alias("run"), name.alias("name"), "path", F.sha2("content", 256).alias("sha256"))


def perf_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row a sidecar with `problem`: null, or why it cannot be used."""
    d = spark.read.schema(PERF + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.input_file_name())
    bad = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(~F.coalesce(F.col("schema").rlike(r"perf.*[12]$"), F.lit(False)), "version_skew").when(F.col("frame.value").isNull() | (F.col("frame.value") < 0), "frame_value").when(F.exists("terms", lambda t: t["value"].isNull() | (t["value"] < 0)), "term_value")
    return d.withColumn("problem", bad).drop("_corrupt_record")


def perf_terms(sidecars: DataFrame) -> DataFrame:
    return sidecars.where("problem is null").select("path", F.explode("terms").alias("t")).select("path", "t.*")


def timings(rows: DataFrame, path: str, unit: str = "ms") -> DataFrame:
    """Samples in ms from JSON (id, json): a bare array, a number, or what a dotted path names."""
    factor = {"ms": 1.0, "s": 1000.0, "us": 1e-3, "ns": 1e-6}[unit]
    found = F.get_json_object("json", "$" + (f".{path}" if path else ""))
    values = F.coalesce(F.from_json(found, "array<double>"), F.array(found.try_cast("double")))
    return rows.select("id", F.transform(values, lambda v: v * factor).alias("samples"))


def layered(meta: DataFrame, names: DataFrame) -> DataFrame:
    """Metadata (dir, key, value) that holds for each name: the nearest directory above it wins, key by key; `dir` '' is the root."""
    parts = F.split("name", "/")
    above = names.select("name", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))).alias("_a")).select("name", "_a.dir", "_a.depth")
    return above.join(meta, "dir").groupBy("name", "key").agg(F.max_by("value", "depth").alias("value"))


def metadata_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose values differ between sides; an absent side shows as null with its flag."""
    x = a.select(*key, F.col("value").alias("before"), F.lit(True).alias("_x"))
    y = b.select(*key, F.col("value").alias("after"), F.lit(True).alias("_y"))
    j = x.join(y, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_x").isNull() | F.col("_y").isNull())
    return j.select(*key, "before", "after", F.col("_x").isNull().alias("absent_before"), F.col("_y").isNull().alias("absent_after"))


def cues(files: DataFrame) -> DataFrame:
    """ordinal, start, end, text of SRT or WebVTT contents (path, content); notes and styles are passed over."""
    text = F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), "\r\n?", "\n")
    block = files.select("path", F.posexplode(F.split(text, "\n{2,}")).alias("ordinal", "block"))
    line = r"(?m)^((?:\d+:)?\d\d:\d\d[,.]\d{3}) +--> +((?:\d+:)?\d\d:\d\d[,.]\d{3}).*$"
    stamp = lambda i: seconds(F.regexp_extract("block", line, i))
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    return block.where(F.col("block").rlike(line)).select("path", "ordinal", stamp(1).alias("start"), stamp(2).alias("end"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """index: the number that ends each file's stem; `problem` where there is none or two files share it."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    f = files.withColumn("index", F.regexp_extract(stem, r"(\d+)$", 1).try_cast("long"))
    n = F.count(F.lit(1)).over(Window.partitionBy("index"))
    return f.withColumn("problem", F.when(F.col("index").isNull(), "no_number").when(n > 1, "repeated_number"))


def yolo(rows: DataFrame) -> DataFrame:
    """class, x, y, w, h in pixels of normalised centre boxes (line, width, height)."""
    p = F.split(F.trim("line"), r"\s+")
    v = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return rows.select("image", v(0).cast("int").alias("class"), ((v(1) - v(3) / 2) * F.col("width")).alias("x"), ((v(2) - v(4) / 2) * F.col("height")).alias("y"), (v(3) * F.col("width")).alias("w"), (v(4) * F.col("height")).alias("h"))


def clipped(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes inside the image; `clipped` where cut, `dropped` where nothing is left."""
    left, top = F.greatest("x", F.lit(0.0)), F.greatest("y", F.lit(0.0))
    right, low = F.least(F.col("x") + F.col("w"), width), F.least(F.col("y") + F.col("h"), height)
    cut = (left != F.col("x")) | (top != F.col("y")) | (right != F.col("x") + F.col("w")) | (low != F.col("y") + F.col("h"))
    out = boxes.withColumn("clipped", cut).withColumn("dropped", (right <= left) | (low <= top))
    return out.withColumns({"x": left, "y": top, "w": F.greatest(right - left, F.lit(0.0)), "h": F.greatest(low - top, F.lit(0.0))})


@F.pandas_udf(MapType(StringType(), StringType()))
def _flat(documents: pd.Series) -> pd.Series:
    def walk(prefix: str, value, out: dict) -> None:
        if isinstance(value, dict) and (value or not prefix):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else k, v, out)
        else:
            out[prefix] = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    found = []
    for text in documents:
        try:
            out: dict[str, str] | None = {}
            walk("", json.loads(text), out)
        except (TypeError, ValueError):
            out = None
        found.append(out)
    return pd.Series(found, dtype=object)


def flattened(rows: DataFrame, key: list[str], column: str = "json") -> DataFrame:
    """key.., name, value of JSON documents: one row a leaf under its dotted name; arrays and empty objects are values as they stand, strings come without quotes. What is no JSON has no rows."""
    return rows.select(*key, F.explode(_flat(column))).toDF(*key, "name", "value")


def index_lines(lines: DataFrame, schema: str, version: str) -> DataFrame:
    """Lines (path, line, text) of an append-only index as path, line, row (the parsed struct) and problem: malformed, or version_skew where `schema` is not the version; empty lines are passed over. A problem names its line, so that nothing is dropped unseen."""
    d = lines.where(F.trim("text") != "").withColumn("row", F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    problem = F.when(bad, F.concat(F.lit("line "), F.col("line"), F.lit(": malformed"))).when(~F.col("row.schema").eqNullSafe(F.lit(version)), F.concat(F.lit("line "), F.col("line"), F.lit(": version_skew")))
    return d.withColumn("problem", problem).withColumn("row", F.when(F.col("problem").isNull(), F.col("row").dropFields("_bad")))


def safe_relative(path: Column) -> Column:
    """Whether a path stays below its root: relative, with no empty, `.` or `..` part, drive or backslash."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:|//|(^|/)\.{1,2}(/|$)|/$")


FRAME_MAP = "schema string, fps double, frames array<struct<index:bigint,time_s:double,path:string>>"


def frame_maps(files: DataFrame) -> DataFrame:
    """path, index, time, file of frame maps (path, content), with problem: malformed, no_frames, unsafe_path, or order (index or time does not rise)."""
    d = files.select("path", F.from_json("content", FRAME_MAP + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    bad = F.when(F.col("m").isNull() | F.col("m._bad").isNotNull(), "malformed").when(F.size(F.coalesce("m.frames", F.array())) == 0, "no_frames")
    d = d.withColumn("_p", bad).select("path", "_p", F.posexplode_outer("m.frames").alias("at", "f"))
    w = Window.partitionBy("path").orderBy("at")
    order = (F.col("f.index") <= F.lag("f.index").over(w)) | (F.col("f.time_s") <= F.lag("f.time_s").over(w))
    problem = F.coalesce(F.col("_p"), F.when(~safe_relative(F.col("f.path")), "unsafe_path").when(order, "order"))
    return d.select("path", F.col("f.index").alias("index"), F.col("f.time_s").alias("time"), F.col("f.path").alias("file"), problem.alias("problem"))


COCO = "images array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def coco_boxes(files: DataFrame) -> DataFrame:
    """path, image, id, label, x, y, w, h, problem of COCO files (path, content): every annotation of every image; unknown_image, unknown_category or bad_box (not four numbers, no area, or outside the image)."""
    d = files.select("path", F.from_json("content", COCO).alias("c"))
    images = d.select("path", F.explode("c.images").alias("i")).select("path", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image"), "i.width", "i.height")
    names = d.select("path", F.explode("c.categories").alias("k")).select("path", F.col("k.id").alias("category_id"), F.col("k.name").alias("label"))
    a = d.select("path", F.explode("c.annotations").alias("a")).select("path", "a.*").join(images, ["path", "image_id"], "left").join(names, ["path", "category_id"], "left")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    fits = (F.size("bbox") == 4) & (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    problem = F.when(F.col("image").isNull(), "unknown_image").when(F.col("label").isNull(), "unknown_category").when(~F.coalesce(fits, F.lit(False)), "bad_box")
    return a.select("path", "image", "id", "label", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), problem.alias("problem"))
