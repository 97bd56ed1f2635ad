"""Inputs of the catalogue's queries, drawn from the tables at hand, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def event_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (user/type/hour), value: mean value, side by day of month."""
    e = table(spark, sf_dir, "events")
    name = F.concat_ws("/", "user_id", "event_type", F.hour("ts"))
    side = F.when(F.dayofmonth("ts") <= 15, "baseline").otherwise("capture")
    return e.groupBy(name.alias("name"), side.alias("side")).agg(F.round(F.avg("value"), 6).alias("value"))


EVENT_CAPTURES = "SELECT concat_ws('/', user_id, event_type, hour(ts)) AS name, CASE WHEN day(ts) <= 15 THEN 'baseline' ELSE 'capture' END AS side, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of parts: run (ship year parity), part group, id (flag), kind (status), parent, value."""
    li = table(spark, sf_dir, "lineitem")
    g = (F.col("l_partkey") % 50).alias("grp")
    return li.groupBy(F.when(F.year("l_shipdate") % 2 == 0, "before").otherwise("after").alias("run"), g, F.concat_ws("-", "l_returnflag", (F.col("l_suppkey") % 7)).alias("id")).agg(
        F.min("l_linestatus").alias("kind"), F.when(F.min("l_linenumber") == 1, F.min("l_returnflag")).alias("parent"), F.round(F.avg("l_quantity"), 6).alias("value"))


ORDER_TERMS = "SELECT CASE WHEN year(l_shipdate) % 2 = 0 THEN 'before' ELSE 'after' END AS run, l_partkey % 50 AS grp, concat_ws('-', l_returnflag, l_suppkey % 7) AS id, min(l_linestatus) AS kind, CASE WHEN min(l_linenumber) = 1 THEN min(l_returnflag) END AS parent, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2, 3"


def repeat_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements: run = line number 1 to 4, id = part mod 40."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    return li.groupBy(F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 400).alias("id")).agg(F.lit("pass").alias("kind"), F.when(F.min("l_returnflag") == "A", "root").alias("parent"), F.round(F.avg("l_quantity"), 6).alias("value"))


REPEAT_TERMS = "SELECT l_linenumber AS run, l_partkey % 400 AS id, 'pass' AS kind, CASE WHEN min(l_returnflag) = 'A' THEN 'root' END AS parent, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate (brand), image (nation of the supplier), value: mean price."""
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    j = li.select("l_partkey", "l_suppkey", "l_extendedprice").join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("p_brand").alias("candidate"), F.col("s_nationkey").alias("image")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


SCORES = "SELECT p_brand AS candidate, s_nationkey AS image, round(avg(l_extendedprice), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry (event type), env (user mod 5), seq (day), captured, capture, value: mean value of the day."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    return e.groupBy(F.col("event_type").alias("entry"), (F.col("user_id") % 5).alias("env"), day.alias("seq")).agg(F.round(F.avg("value"), 1).alias("value"), F.when(F.min("user_id") >= 0, F.max(F.hour("ts"))).alias("h")).select(
        "entry", "env", "seq", F.when(F.col("entry") != "click", F.col("seq") * 24).alias("captured"), F.concat_ws(":", F.round(F.col("value") / 3).cast("int"), "env").alias("capture"), "value", F.lit(0.9).alias("threshold"))


DAILY = "SELECT entry, env, seq, CASE WHEN entry <> 'click' THEN seq * 24 END AS captured, concat_ws(':', CAST(round(value / 3) AS INT), env) AS capture, value, 0.9::DOUBLE AS threshold FROM (SELECT event_type AS entry, user_id % 5 AS env, day(ts) AS seq, round(avg(value), 1) AS value FROM events GROUP BY 1, 2, 3)"


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a customer: seq, index (day number of the order, once), t, value, err, candidate, baseline, capture."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    f = o.groupBy((F.col("o_custkey") % 100).alias("grp"), F.floor(day / 7).cast("long").alias("index")).agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("value"), F.min("o_orderkey").alias("seq"), F.max(day).cast("double").alias("t"))
    return f.select("grp", "seq", "index", "t", "value", F.round(F.col("value") / 500, 6).alias("err"), F.col("value").alias("candidate"), F.round(F.col("value") / 2, 4).alias("baseline"), F.col("value").alias("capture"))


ORDER_FRAMES = "SELECT grp, seq, \"index\", t, value, round(value / 500, 6) AS err, value AS candidate, round(value / 2, 4) AS baseline, value AS capture FROM (SELECT o_custkey % 100 AS grp, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 7) AS BIGINT) AS \"index\", round(avg(o_totalprice) / 1000, 3) AS value, min(o_orderkey) AS seq, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS DOUBLE) AS t FROM orders GROUP BY 1, 2)"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pictures of 8 x 8 pixels, a row each: each vector as one (even number), and a copy in which every pixel differs by at most two levels (odd number)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))

    def level(v, i):
        y, x = F.floor(i / 8).cast("int"), (i % 8).cast("int")
        own = F.round(128 + 400 * v.cast("double")) + F.col("k") * ((3 * x + 5 * y + F.col("vec_id")) % 5 - 2)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), own))

    return e.select((2 * F.col("vec_id") + F.col("k")).alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", level).alias("values"))


PICTURES = "SELECT 2 * vec_id + k AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0.0, least(255.0, round(128 + 400 * e) + k * ((3 * ((i - 1) % 8) + 5 * ((i - 1) // 8) + vec_id) % 5 - 2))) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), (VALUES (0), (1)) t(k)"


def picture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions b and c of each vector's picture, with shares of light: by the remainder of the label the same, with a checked noise, with one half lighter, or with more contrast; and whether a pixel is a gap."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).alias("k"), F.posexplode("embedding").alias("i", "e"))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    b = F.round(0.5 + F.col("e").cast("double"), 4)
    c = F.when(F.col("k") == 0, b).when(F.col("k") == 1, b + 0.001 * (2 * ((x + y) % 2) - 1)).when((F.col("k") == 2) & (x < 4), b + 0.05).when(F.col("k") == 2, b).otherwise(0.5 + 1.5 * (b - 0.5))
    return e.select(F.col("vec_id").alias("image"), "k", x.alias("x"), y.alias("y"), b.alias("b"), F.round(c, 6).alias("c"))


PICTURE_PAIRS = "SELECT vec_id AS image, k, x, y, b, round(CASE WHEN k = 0 THEN b WHEN k = 1 THEN b + 0.001 * (2 * ((x + y) % 2) - 1) WHEN k = 2 AND x < 4 THEN b + 0.05 WHEN k = 2 THEN b ELSE 0.5 + 1.5 * (b - 0.5) END, 6) AS c FROM (SELECT vec_id, label % 4 AS k, (i - 1) % 8 AS x, (i - 1) // 8 AS y, round(0.5 + e, 4) AS b FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"


#: All three hashes of the pictures, each in two halves.
PICTURE_CODES = f"""px AS ({PICTURES}),
kinds AS (SELECT * FROM (VALUES ('a', 8, 8), ('d', 9, 8), ('p', 32, 32)) t(kind, ow, oh)),
wraw AS (SELECT kind, 'x' AS axis, o, i, 1 - abs(i + 0.5 - (o + 0.5) * 8 / ow) / greatest(8 / ow, 1) AS w FROM kinds, range(40) r(o), range(8) s(i) WHERE o < ow
         UNION ALL SELECT kind, 'y', o, i, 1 - abs(i + 0.5 - (o + 0.5) * 8 / oh) / greatest(8 / oh, 1) FROM kinds, range(40) r(o), range(8) s(i) WHERE o < oh),
wt AS (SELECT kind, axis, o, i, w / sum(w) OVER (PARTITION BY kind, axis, o) AS w FROM wraw WHERE w > 0),
tall AS (SELECT image, kind, o AS oy, x, sum(v * w) AS s FROM px JOIN wt ON axis = 'y' AND i = y GROUP BY ALL),
pic AS (SELECT image, t.kind, oy AS y, o AS x, round(round(sum(s * w), 6)) AS v FROM tall t JOIN wt ON axis = 'x' AND wt.kind = t.kind AND i = x GROUP BY ALL),
cs AS (SELECT i, k, cos((2 * i + 1) * k * pi() / 64) AS c FROM range(32) r(i), range(8) s(k)),
fr AS (SELECT image, k AS v, u, round(sum(s * c), 6) AS c FROM (SELECT image, y, k AS u, sum(v * c) AS s FROM pic JOIN cs ON i = x WHERE kind = 'p' GROUP BY ALL) JOIN cs ON i = y GROUP BY ALL),
bits AS (SELECT image, kind, 8 * y + x AS bit FROM (SELECT *, v > avg(v) OVER (PARTITION BY image) AS lit FROM pic WHERE kind = 'a') WHERE lit
         UNION ALL SELECT image, kind, 8 * y + x FROM (SELECT *, v > lead(v) OVER (PARTITION BY image, y ORDER BY x) AS lit FROM pic WHERE kind = 'd') WHERE lit AND x < 8
         UNION ALL SELECT image, 'p', 8 * v + u FROM (SELECT *, c > list_sort(list(c) OVER (PARTITION BY image))[32] AS lit FROM fr WHERE u + v > 0) WHERE lit),
codes AS (SELECT i.image, """ + ", ".join(f"coalesce(sum(1::BIGINT << greatest(0, least(31, bit - {low}))::INT) FILTER (kind = '{k}' AND bit BETWEEN {low} AND {low + 31}), 0)::BIGINT AS {k}{half}" for k in "adp" for half, low in (("_hi", 32), ("_lo", 0))) + " FROM (SELECT DISTINCT image FROM px) i LEFT JOIN bits b ON i.image = b.image GROUP BY 1)"
