"""Queries of pictures: perceptual hashes, flashes, keyframes, pyramids of squares, profiles of tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import buffers, flashes, keyframes, perceptual, pyramid, scopes
from ..sources.tables import table
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- hashes ----------------------------------------------------------------

@query("WITH " + B.PICTURE_CODES + " SELECT image, " + ", ".join(f"printf('%08x%08x', {k}_hi, {k}_lo) AS {k}hash" for k in "adp") + " FROM codes")
def perceptual_hashes(spark, sf_dir):
    h = perceptual.line_hashes(B.pictures(spark, sf_dir))
    return h.select("image", *[F.lower(F.lpad(F.hex(f"{k}hash"), 16, "0")).alias(f"{k}hash") for k in "adp"])


@query("WITH " + B.PICTURE_CODES + " SELECT a.image // 2 AS picture, (bit_count(xor(a.p_hi, b.p_hi)) + bit_count(xor(a.p_lo, b.p_lo)))::INT AS phash_bits, (bit_count(xor(a.d_hi, b.d_hi)) + bit_count(xor(a.d_lo, b.d_lo)))::INT AS dhash_bits FROM codes a JOIN codes b ON b.image = a.image + 1 WHERE a.image % 2 = 0")
def copy_distances(spark, sf_dir):
    h = perceptual.line_hashes(B.pictures(spark, sf_dir), "dp").withColumn("picture", F.expr("image div 2"))
    side = lambda k: h.where(F.col("image") % 2 == k).select("picture", F.col("phash").alias(f"p{k}"), F.col("dhash").alias(f"d{k}"))
    differ = lambda k: F.bit_count(F.col(f"{k}0").bitwiseXOR(F.col(f"{k}1")))
    return side(0).join(side(1), "picture").select("picture", differ("p").alias("phash_bits"), differ("d").alias("dhash_bits"))


# --- flashes ---------------------------------------------------------------

#: Screens are event types, cells users by remainder, frames half days, light the mean value; eight frames count as a second.
_FPS = 8
_CELLS = "c AS (SELECT event_type AS series, user_id % 2 AS cell, CAST(floor(epoch(ts) / 43200) AS BIGINT) - 39444 AS frame, round(least(1.0, avg(value) / 100), 6) AS luminance FROM events GROUP BY ALL)"
_CHANGES = _CELLS + ", d AS (SELECT series, cell, frame, luminance, lag(luminance) OVER (PARTITION BY series, cell ORDER BY frame) AS b FROM c), ch AS (SELECT series, cell, frame, CASE WHEN luminance > b THEN 1 ELSE -1 END AS dir FROM d WHERE abs(luminance - b) >= 0.1 AND least(b, luminance) < 0.8)"
_FLASHES = _CHANGES + ", r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> dir THEN 1 ELSE 0 END) OVER (PARTITION BY series, cell ORDER BY frame) AS run FROM (SELECT *, lag(dir) OVER (PARTITION BY series, cell ORDER BY frame) AS before FROM ch)), g AS (SELECT series, cell, run, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r GROUP BY ALL), j AS (SELECT *, lag(last) OVER w - 1 AS start, max(CASE WHEN n > 1 THEN run END) OVER (PARTITION BY series, cell ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM g WINDOW w AS (PARTITION BY series, cell ORDER BY run)), f AS (SELECT series, cell, start, first AS \"end\" FROM j WHERE start IS NOT NULL AND (run - coalesce(longest + 1, 2)) % 2 = 0)"
_FRAMES = _FLASHES + f", e AS (SELECT *, unnest(generate_series(\"end\", \"end\" + {_FPS - 1})) AS frame FROM f), bc AS (SELECT series, cell, frame, count(*) AS n, min((\"end\", start)) AS m FROM e GROUP BY ALL), s AS (SELECT series, max(frame) AS last, count(DISTINCT cell) AS cells FROM c GROUP BY 1), fr AS (SELECT series, frame, max(n) AS peak, sum(CASE WHEN n > 3 THEN 1 ELSE 0 END) / max(cells) AS above, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) / max(cells) AS near, min(m)[2] AS start FROM bc JOIN s USING (series) WHERE frame <= last GROUP BY ALL)"


def light(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    frame = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 43_200_000_000).cast("long") - 39444
    return e.groupBy(F.col("event_type").alias("series"), (F.col("user_id") % 2).alias("cell"), frame.alias("frame")).agg(F.round(F.least(F.lit(1.0), F.avg("value") / 100), 6).alias("luminance"))


@query("WITH " + _FLASHES + ' SELECT series, cell, start, "end" FROM f')
def cell_flashes(spark, sf_dir):
    return flashes.flashes(flashes.luminance_changes(light(spark, sf_dir)))


@query("WITH " + _FRAMES + " SELECT series, frame, peak, round(above, 6) AS above, round(near, 6) AS near, start FROM fr")
def flashing_frames(spark, sf_dir):
    c = light(spark, sf_dir)
    f = flashes.flashing_frames(flashes.flashes(flashes.luminance_changes(c)), c, _FPS)
    return f.withColumns({"above": F.round("above", 6), "near": F.round("near", 6)})


@query("WITH " + _FRAMES + ", k AS (SELECT *, above > 0.25 AS fails FROM fr WHERE above >= 0.2 OR near > 0.25), p AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY frame) AS part FROM (SELECT *, coalesce(lag(frame) OVER (PARTITION BY series ORDER BY frame) + 1 < start, true) AS apart FROM k)) SELECT series, min_by(start, frame) AS start, max(frame) AS \"end\", CASE WHEN bool_or(fails) THEN 'FAIL' ELSE 'WARN' END AS verdict, max(peak) AS peak, round(100 * max(CASE WHEN fails THEN above ELSE near END), 6) AS area FROM p GROUP BY series, part")
def risk_segments(spark, sf_dir):
    c = light(spark, sf_dir)
    f = flashes.flashing_frames(flashes.flashes(flashes.luminance_changes(c)), c, _FPS)
    return flashes.risk_segments(f).withColumn("area", F.round("area", 6))


# --- keyframes -------------------------------------------------------------

@query()
def event_keyframes(spark, sf_dir):
    """Series are groups of users, frames days, histograms the shares of a day's values by hour."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("series"), F.to_date("ts").alias("at"), F.hour("ts").alias("hour"), "value")
    d = e.groupBy("series", "at").agg(keyframes.day_histogram(F.col("hour"), F.col("value")).alias("hist"))
    bits = lambda test: F.aggregate(F.sequence(F.lit(0), F.lit(22)), F.lit(0).cast("long"), lambda code, i: code * 2 + test(i).cast("long"))
    at = lambda i: F.get("hist", i)
    codes = {"phash": bits(lambda i: at(i) > 1 / 24), "dhash": bits(lambda i: at(i) > at(i + 1)), "digest": F.sha2(F.concat_ws(",", F.transform("hist", lambda x: x.cast("string"))), 256)}
    return keyframes.keyframes(d.withColumns(codes), 1.0)


# --- pyramids --------------------------------------------------------------

_TILE = 2
_LEVELS = f"px AS ({B.PICTURE_PAIRS}), l0 AS (SELECT image, x::BIGINT AS x, y::BIGINT AS y, 1 AS w, b, c FROM px), " + ", ".join(f"l{k} AS (SELECT image, x // 2 AS x, y // 2 AS y, sum(w) AS w, sum(b) AS b, sum(c) AS c FROM l{k - 1} GROUP BY 1, 2, 3)" for k in (1, 2, 3)) + ", lv AS (" + " UNION ALL ".join(f"SELECT image, {k} AS level, count(*) AS squares, sum(abs(c - b)) / sum(w) AS difference FROM l{k} GROUP BY 1" for k in range(4)) + ")"
_RATIO = "CASE WHEN abs({a}) < 1e-15 AND abs({b}) < 1e-15 THEN 1.0 WHEN abs({a}) >= 1e-15 THEN ({b}) / ({a}) END"
_PROFILES = (
    _LEVELS + ", st AS (SELECT p.*, p.x // 2 AS tx, p.y // 2 AS ty, " + ", ".join(f"abs(4 * p.{v} - l.{v} - r.{v} - u.{v} - d.{v}) AS l{v}" for v in "bc")
    + " FROM px p LEFT JOIN px l ON l.image = p.image AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN px r ON r.image = p.image AND r.y = p.y AND r.x = p.x + 1 LEFT JOIN px u ON u.image = p.image AND u.x = p.x AND u.y = p.y - 1 LEFT JOIN px d ON d.image = p.image AND d.x = p.x AND d.y = p.y + 1)"
    + ", tr AS (SELECT image, tx, ty, count(*) AS pixels, avg(b) AS b_mean, avg(c) AS c_mean, var_pop(b) AS vb, var_pop(c) AS vc, coalesce(var_samp(c - b), 0) AS vd FROM st GROUP BY 1, 2, 3)"
    + ", tp AS (SELECT *, c_mean - b_mean AS shift, 1.96 * sqrt(vd / pixels) AS half, (c_mean - b_mean) / greatest(b_mean, 0.02) AS relative FROM tr)"
    + ", pr AS (SELECT *, abs(shift) > half AND abs(shift) > 0.02 AS shifted, abs(shift) > half AND abs(relative) > 0.02 AS relatively_shifted, " + _RATIO.format(a="vb", b="vc") + " AS variance_ratio FROM tp)")


@query("WITH " + _LEVELS + " SELECT image, level, squares, round(difference, 12) AS difference FROM lv")
def pyramid_levels(spark, sf_dir):
    return pyramid.levels(B.picture_pairs(spark, sf_dir)).withColumn("difference", F.round("difference", 12))


@query("WITH " + _PROFILES + " SELECT image, tx, ty, pixels, CASE WHEN round(shift, 9) = 0 THEN 0.0 ELSE round(shift, 9) END AS shift, CASE WHEN round(relative, 9) = 0 THEN 0.0 ELSE round(relative, 9) END AS relative, CASE WHEN round(shift - half, 9) = 0 THEN 0.0 ELSE round(shift - half, 9) END AS low, round(variance_ratio, 4) AS variance_ratio, shifted, relatively_shifted FROM pr")
def tile_profiles(spark, sf_dir):
    t = pyramid.tile_profiles(B.picture_pairs(spark, sf_dir), _TILE)
    return t.select("image", "tx", "ty", "pixels", *[F.when(F.round(c, 9) == 0, 0.0).otherwise(F.round(c, 9)).alias(c) for c in ("shift", "relative", "low")], F.round("variance_ratio", 4).alias("variance_ratio"), "shifted", "relatively_shifted")


@query("WITH RECURSIVE " + _PROFILES + ", wh AS (SELECT image, count(*) FILTER (b <> c) AS changed, coalesce(avg(lb), 0) AS db, coalesce(avg(lc), 0) AS dc FROM st GROUP BY 1)"
       + ", sc AS (SELECT image, max(difference) FILTER (level = 2) AS coarse, max(difference) FILTER (level = 3) AS last, max(difference) FILTER (level = 0) AS first FROM lv GROUP BY 1)"
       + ", ct AS (SELECT image, count(*) FILTER (shifted) AS shifted, count(*) FILTER (relatively_shifted) / count(*) AS share FROM pr GROUP BY 1)"
       + ", sa AS (SELECT *, " + _RATIO.format(a="db", b="dc") + " AS detail_ratio FROM wh JOIN sc USING (image) JOIN ct USING (image)), sb AS (SELECT *, coalesce(abs(detail_ratio - 1) > 0.1, true) AS detail, coarse <= 0.002 AS small FROM sa)"
       + ", se AS (SELECT *, small AND NOT detail AND shifted <= 2 AND share <= 0.25 AS benign FROM sb)"
       + ", ch AS (SELECT image, tx, ty, 100 * tx + ty AS id FROM pr JOIN (SELECT image FROM se WHERE NOT benign) USING (image) WHERE shifted OR relatively_shifted)"
       + ", ad AS (SELECT a.image, a.id AS a, b.id AS b FROM ch a JOIN ch b ON a.image = b.image AND abs(a.tx - b.tx) + abs(a.ty - b.ty) = 1), re AS (SELECT image, id, id AS root FROM ch UNION SELECT re.image, re.id, ad.b FROM re JOIN ad ON ad.image = re.image AND ad.a = re.root)"
       + ", rg AS (SELECT image, count(*) AS regions FROM (SELECT image, root, count(*) AS n FROM (SELECT image, id, min(root) AS root FROM re GROUP BY 1, 2) GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1)"
       + " SELECT se.image, CASE WHEN changed = 0 THEN 'identical' WHEN benign OR (last <= first * 0.3 AND coalesce(regions, 0) = 0 AND NOT detail) THEN 'texture_noise_only' WHEN coalesce(regions, 0) > 0 THEN 'systematic_shift' ELSE 'unclassified' END AS class, coalesce(regions, 0) AS regions, shifted, round(share, 6) AS share, round(detail_ratio, 9) AS detail_ratio, round(coarse, 12) AS coarse FROM se LEFT JOIN rg ON rg.image = se.image")
def change_classes(spark, sf_dir):
    """Tiles of two pixels have no inner pixel, so that their own detail is never asked for; the whole picture's is."""
    c = pyramid.change_classes(B.picture_pairs(spark, sf_dir), _TILE)
    return c.select("image", "class", "regions", "shifted", F.round("share", 6).alias("share"), F.round("detail_ratio", 9).alias("detail_ratio"), F.round("coarse", 12).alias("coarse"))


# --- colours ---------------------------------------------------------------

_COLOURS = "c AS (SELECT event_id, [event_id % 256, user_id % 256, floor(value) % 256] AS a, [event_id * 7 % 256, user_id % 256, (floor(value) + hour(ts)) % 256] AS b FROM events)"


def colours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    blue = F.floor("value")
    one, two = (F.col("event_id") % 256, F.col("user_id") % 256, blue % 256), (F.col("event_id") * 7 % 256, F.col("user_id") % 256, (blue + F.hour("ts")) % 256)
    return e.select("event_id", *[v.cast("double").alias(f"{s}{i}") for s, x in (("a", one), ("b", two)) for i, v in enumerate(x)])


def _sql_difference(name: str, source: str, sides: tuple[str, str]) -> str:
    """The CTEs from linear colours (arrays of three in `source`) to their CIEDE2000 difference in `name`."""
    white = ["0.95047", "1.0", "1.08883"]
    xyz = [[f"({' + '.join(f'{w} * {s}[{k + 1}]' for k, w in enumerate(row))}) / {white[i]}" for i, row in enumerate(colour.XYZ)] for s in sides]
    bent = [[f"CASE WHEN {v} > 216 / 24389 THEN cbrt({v}) ELSE (24389 / 27 * ({v}) + 16) / 116 END" for v in side] for side in xyz]
    return f"""
{name}0 AS (SELECT *, {', '.join(f'{v} AS f{s}{i}' for s, side in zip('12', bent) for i, v in enumerate(side))} FROM {source}),
{name}1 AS (SELECT *, {', '.join(f'116 * f{s}1 - 16 AS l{s}, 500 * (f{s}0 - f{s}1) AS a{s}, 200 * (f{s}1 - f{s}2) AS b{s}' for s in '12')} FROM {name}0),
{name}2 AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM {name}1),
{name}3 AS (SELECT *, {', '.join(f'(1.5 - 0.5 * sqrt(cm ** 7 / (cm ** 7 + 25 ** 7))) * a{s} AS p{s}' for s in '12')} FROM {name}2),
{name}4 AS (SELECT *, {', '.join(f'sqrt(p{s} * p{s} + b{s} * b{s}) AS c{s}, CASE WHEN p{s} = 0 AND b{s} = 0 THEN 0 ELSE fmod(degrees(atan2(b{s}, p{s})) + 360, 360) END AS h{s}' for s in '12')} FROM {name}3),
{name}5 AS (SELECT *, l2 - l1 AS dl, c2 - c1 AS dc, (l1 + l2) / 2 AS l, (c1 + c2) / 2 AS c, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS h FROM {name}4),
{name}6 AS (SELECT *, dl / (1 + 0.015 * (l - 50) ** 2 / sqrt(20 + (l - 50) ** 2)) AS x, dc / (1 + 0.045 * c) AS y,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * c * (1 - 0.17 * cos(radians(h - 30)) + 0.24 * cos(radians(2 * h)) + 0.32 * cos(radians(3 * h + 6)) - 0.20 * cos(radians(4 * h - 63)))) AS z,
  -2 * sqrt(c ** 7 / (c ** 7 + 25 ** 7)) * sin(radians(60 * exp(-(((h - 275) / 25) ** 2)))) AS rt FROM {name}5),
{name} AS (SELECT event_id, sqrt(greatest(0, x * x + y * y + z * z + rt * y * z)) AS d FROM {name}6)"""


_LINEAR = "list_transform({s}, lambda v: CASE WHEN v / 255 <= 0.04045 THEN v / 255 / 12.92 ELSE ((v / 255 + 0.055) / 1.055) ** 2.4 END)"
_CVD = lambda m, s: "[" + ", ".join(f"greatest(0, least(1, {' + '.join(f'({w}) * {s}[{k + 1}]' for k, w in enumerate(row))}))" for row in m) + "]"


@query("WITH " + _COLOURS + f", li AS (SELECT event_id, {_LINEAR.format(s='a')} AS la, {_LINEAR.format(s='b')} AS lb FROM c), " + _sql_difference("pl", "li", ("la", "lb")) + ", "
       + ", ".join(f"{k[0]}s AS (SELECT event_id, {_CVD(m, 'la')} AS sa, {_CVD(m, 'lb')} AS sb FROM li), " + _sql_difference(k, f"{k[0]}s", ("sa", "sb")) for k, m in colour.DEFICIENCIES.items())
       + " SELECT event_id, round(pl.d, 4) AS plain, round(protan.d, 4) AS protan, round(deutan.d, 4) AS deutan, round(tritan.d, 4) AS tritan FROM pl JOIN protan USING (event_id) JOIN deutan USING (event_id) JOIN tritan USING (event_id)")
def colour_differences(spark, sf_dir):
    """How far two colours are apart, to all eyes and to those without one kind of cones."""
    rows = colours(spark, sf_dir)
    rows = rows.withColumns({c: colour.linear_light(F.col(c) / 255) for c in rows.columns if c != "event_id"})
    for kind in ("plain", *colour.DEFICIENCIES):
        for s in "ab":
            own = [F.col(f"{s}{i}") for i in range(3)]
            seen = own if kind == "plain" else colour.simulated(kind, own)
            rows = rows.withColumns({f"{s}_{i}": v for i, v in enumerate(seen)})
            rows = colour.with_lab(rows, [f"{s}_{i}" for i in range(3)], [f"{s}_l", f"{s}_a", f"{s}_b"])
        rows = colour.with_ciede2000(rows, ["a_l", "a_a", "a_b"], ["b_l", "b_a", "b_b"], kind)
    return rows.select("event_id", *[F.round(k, 4).alias(k) for k in ("plain", *colour.DEFICIENCIES)])


_PQ = "list_transform(list_transform({s}, lambda v: (v / 255) ** (32 / 2523)), lambda p: (greatest(p - 3424 / 4096, 0) / (2413 / 128 - 2392 / 128 * p)) ** (16384 / 2610))"
_LMS = lambda s: "list_transform([" + ", ".join("(" + " + ".join(f"{w} * {s}[{k + 1}]" for k, w in enumerate(row)) + ") / 4096" for row in colour.LMS) + "], lambda v: ((3424 / 4096 + 2413 / 128 * v ** (2610 / 16384)) / (1 + 2392 / 128 * v ** (2610 / 16384))) ** (2523 / 32))"
_ITP = lambda s: "[" + ", ".join("(" + " + ".join(f"({w}) * {s}[{k + 1}]" for k, w in enumerate(row)) + ") / 4096" for row in colour.ICTCP) + "]"


@query("WITH " + _COLOURS + f", p AS (SELECT event_id, {_PQ.format(s='a')} AS a, {_PQ.format(s='b')} AS b FROM c), q AS (SELECT event_id, {_LMS('a')} AS a, {_LMS('b')} AS b FROM p), r AS (SELECT event_id, {_ITP('a')} AS a, {_ITP('b')} AS b FROM q) SELECT event_id, round(720 * sqrt((a[1] - b[1]) ** 2 + 0.25 * (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), 4) AS difference FROM r")
def light_differences(spark, sf_dir):
    rows = colours(spark, sf_dir)
    rows = rows.withColumns({c: F.col(c) / 255 for c in rows.columns if c != "event_id"})
    for s in "ab":
        rows = colour.with_ictcp(rows, [f"{s}{i}" for i in range(3)], [f"{s}_i", f"{s}_t", f"{s}_p"])
    return rows.select("event_id", F.round(colour.itp_difference(["a_i", "a_t", "a_p"], ["b_i", "b_t", "b_p"]), 4).alias("difference"))


# --- buffers ---------------------------------------------------------------

_KINDS = ("depth", "depth", "normal", "normal", "motion", "id")
_CODES = ("linear01", "reverse_z", "rgb_snorm", "oct", "rg_snorm", "exact")


def samples(spark, sf_dir):
    """Vectors as pixels of three samples, some of them invalid on a side, and a few without end; the capture is the baseline with a shift that grows with the vector's number."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, 3), lambda x: F.round(0.5 + x.cast("double"), 4)))).alias("at", "b"))
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("vec_id") % 6 + 1).cast("int"))
    shift = (F.col("vec_id") % 5) * 0.002
    moved = F.array(*[F.get("b", F.lit(i)) + shift * k for i, k in ((0, 1), (1, -1), (2, 0))])
    endless = (F.col("vec_id") % 60 == 12) & (F.col("at") == 3)
    return e.select("vec_id", "at", pick(_KINDS).alias("kind"), pick(_CODES).alias("encoding"), F.lit(4.0).alias("scale"), "b", F.when(endless, F.array(F.lit(float("inf")))).otherwise(moved).alias("c"),
                    (F.get("b", F.lit(0)) > 0.3).alias("valid_b"), (F.get("b", F.lit(1)) > 0.25).alias("valid_c"))


_UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
_SAMPLES = (
    "e AS (SELECT vec_id, i AS at_, list_transform(embedding[3 * i + 1:3 * i + 3], lambda x: round(0.5 + x::DOUBLE, 4)) AS b FROM embeddings, range(21) r(i)),"
    + f" s AS (SELECT *, {list(_KINDS)}[vec_id % 6 + 1] AS kind, {list(_CODES)}[vec_id % 6 + 1] AS encoding, CASE WHEN vec_id % 60 = 12 AND at_ = 3 THEN ['inf'::DOUBLE] ELSE [b[1] + (vec_id % 5) * 0.002, b[2] - (vec_id % 5) * 0.002, b[3]] END AS c, b[1] > 0.3 AS vb, b[2] > 0.25 AS vc FROM e),"
    + " u AS (SELECT *, list_transform(b, lambda x: 2 * x - 1) AS nb, list_transform(c, lambda x: 2 * x - 1) AS nc FROM s),"
    + " o AS (SELECT *, " + ", ".join(f"CASE WHEN encoding <> 'oct' THEN n{s} WHEN 1 - abs(n{s}[1]) - abs(n{s}[2]) < 0 THEN [(1 - abs(n{s}[2])) * CASE WHEN n{s}[1] >= 0 THEN 1 ELSE -1 END, (1 - abs(n{s}[1])) * CASE WHEN n{s}[2] >= 0 THEN 1 ELSE -1 END, 1 - abs(n{s}[1]) - abs(n{s}[2])] ELSE [n{s}[1], n{s}[2], 1 - abs(n{s}[1]) - abs(n{s}[2])] END AS o{s}" for s in "bc") + " FROM u),"
    + f" w AS (SELECT *, CASE WHEN kind = 'normal' THEN {_UNIT.format(v='ob')} END AS wb, CASE WHEN kind = 'normal' THEN {_UNIT.format(v='oc')} END AS wc FROM o),"
    + " x AS (SELECT *, CASE kind WHEN 'depth' THEN abs(CASE WHEN encoding = 'reverse_z' THEN (1 - c[1]) - (1 - b[1]) ELSE c[1] - b[1] END) WHEN 'normal' THEN CASE WHEN wb = wc THEN 0 ELSE degrees(acos(greatest(-1, least(1, wb[1] * wc[1] + wb[2] * wc[2] + wb[3] * wc[3])))) END WHEN 'motion' THEN sqrt(((c[1] - b[1]) * 8) ** 2 + ((c[2] - b[2]) * 8) ** 2) ELSE (b <> c)::INT END AS err FROM w),"
    + " y AS (SELECT *, CASE WHEN NOT vb AND NOT vc THEN 'neither' WHEN NOT vc THEN 'only_b' WHEN NOT vb THEN 'only_c' WHEN err IS NULL OR isinf(err) OR isnan(err) THEN 'odd' ELSE 'compared' END AS state FROM x),"
    + " z AS (SELECT *, CASE WHEN state = 'compared' THEN err END AS error, CASE kind WHEN 'depth' THEN 0.01 WHEN 'normal' THEN 1.0 WHEN 'motion' THEN 0.5 ELSE 0 END AS lim FROM y)")


@query("WITH " + _SAMPLES + " SELECT vec_id, kind, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("compared", "only_b", "only_c", "odd")) + ", round(avg(error), 5) AS mean, round(max(error), 5) AS most, round(avg(error / greatest(abs(CASE WHEN encoding = 'reverse_z' THEN 1 - b[1] ELSE b[1] END), 1e-12)) FILTER (kind = 'depth'), 6) AS relative, CASE WHEN count(error) = 0 OR count(*) FILTER (state = 'odd') > 0 THEN 'unknown' WHEN avg(error) <= max(lim) THEN 'pass' ELSE 'fail' END AS status FROM z GROUP BY 1, 2")
def buffer_errors(spark, sf_dir):
    s = buffers.summaries(samples(spark, sf_dir), ["vec_id"])
    return s.select("vec_id", "kind", "compared", "only_b", "only_c", "odd", F.round("mean", 5).alias("mean"), F.round("most", 5).alias("most"), F.round("relative", 6).alias("relative"), "status")


# --- scopes ----------------------------------------------------------------

@query(f"WITH px AS ({B.PICTURE_PAIRS}), bx AS (SELECT DISTINCT image, image % 4 AS x, image % 3 AS y, 3 AS w, 4 AS h FROM px WHERE image % 11 > 0 UNION ALL SELECT DISTINCT image, CASE WHEN k = 2 THEN 0 ELSE 2 END, 0, 4, CASE WHEN image % 9 = 0 THEN 9 ELSE 8 END FROM px WHERE k > 1),"
       " i AS (SELECT p.*, EXISTS (SELECT 1 FROM bx WHERE bx.image = p.image AND p.x >= bx.x AND p.x < bx.x + bx.w AND p.y >= bx.y AND p.y < bx.y + bx.h) AS ins FROM px p), e AS (SELECT i.*, abs(c - b) AS err, EXISTS (SELECT 1 FROM i o WHERE o.image = i.image AND abs(o.x - i.x) + abs(o.y - i.y) = 1 AND o.ins <> i.ins) AS edge FROM i),"
       " v AS (SELECT image, bool_or(x + w > 8 OR y + h > 8) AS off FROM bx GROUP BY 1) SELECT e.image, " + ", ".join(f"count(*) FILTER ({t}) AS {n}_pixels, count(*) FILTER ({t} AND b <> c) AS {n}_changed, round(avg(err) FILTER ({t}), 12) AS {n}_mean" for n, t in (("inside", "ins"), ("outside", "NOT ins"), ("boundary", "edge")))
       + ", CASE WHEN off IS NULL OR off THEN 'invalid_region' WHEN count(*) FILTER (NOT ins AND b <> c) > 0 THEN 'collateral_change' ELSE 'preserved' END AS verdict FROM e LEFT JOIN v USING (image) GROUP BY e.image, off")
def localized_changes(spark, sf_dir):
    p = B.picture_pairs(spark, sf_dir)
    images = p.select("image", "k").distinct()
    one = images.where("image % 11 > 0").select("image", (F.col("image") % 4).cast("int").alias("x"), (F.col("image") % 3).cast("int").alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"))
    two = images.where("k > 1").select("image", F.when(F.col("k") == 2, 0).otherwise(2).alias("x"), F.lit(0).alias("y"), F.lit(4).alias("w"), F.when(F.col("image") % 9 == 0, 9).otherwise(8).alias("h"))
    cells = p.select("image", "x", "y", F.col("b").alias("before"), F.col("c").alias("after"), F.abs(F.col("c") - F.col("b")).alias("error"))
    out = scopes.localized(cells, one.union(two))
    return out.select("image", *[c for n in ("inside", "outside", "boundary") for c in (f"{n}_pixels", f"{n}_changed", F.round(f"{n}_mean", 12).alias(f"{n}_mean"))], "verdict")


_TILES = "t AS (SELECT page_id AS n, (3 + page_id % 3) AS z, page_id % 8 AS x, (page_id // 8) % 40 AS y, sha256(html) AS d FROM pages), r AS (SELECT *, count(*) OVER (PARTITION BY z, x, y) AS k FROM t WHERE x < 2 ** z AND y < 2 ** z), q AS (SELECT z, x, y, CASE WHEN n % 5 = 0 THEN 'x' ELSE d END AS d, count(*) OVER (PARTITION BY z, x, y) AS k FROM t WHERE n % 7 > 0 AND x < 2 ** z AND y < 2 ** z UNION ALL SELECT 9, n, n, d, 1 FROM t WHERE n % 13 = 0 AND n < 512)"


@query("WITH " + _TILES + ", a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM q WHERE k = 1), j AS (SELECT coalesce(a.z, b.z) AS z, a.d AS da, b.d AS db FROM a FULL JOIN b ON a.z = b.z AND a.x = b.x AND a.y = b.y) SELECT z, count(da) AS reference_tiles, count(db) AS candidate_tiles, count(*) FILTER (da IS NOT NULL AND db IS NOT NULL) AS paired, count(*) FILTER (db IS NULL) AS missing, count(*) FILTER (da IS NULL) AS extra, count(*) FILTER (da <> db) AS changed, CASE WHEN count(da) > 0 THEN round(count(*) FILTER (da IS NOT NULL AND db IS NOT NULL) / count(da), 6) END AS coverage, CASE WHEN count(*) FILTER (da IS NULL OR db IS NULL OR da <> db) = 0 THEN 'identical' ELSE 'changed' END AS verdict FROM j GROUP BY z")
def tile_coverage(spark, sf_dir):
    """Pages as tiles; the candidate lacks some, has others of its own, and some changed."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.sha2("html", 256).alias("d"))
    path = F.concat_ws("/", 3 + F.col("n") % 3, F.col("n") % 8, F.concat(F.expr("(n div 8) % 40"), F.lit(".png")))
    reference = p.select(path.alias("path"), F.col("d").alias("digest"))
    candidate = p.where("n % 7 > 0").select(path.alias("path"), F.when(F.col("n") % 5 == 0, "x").otherwise(F.col("d")).alias("digest"))
    own = p.where("n % 13 = 0 and n < 512").select(F.concat_ws("/", F.lit(9), "n", F.concat("n", F.lit(".webp"))).alias("path"), F.col("d").alias("digest"))
    return scopes.tile_coverage(reference, candidate.union(own)).withColumn("coverage", F.round("coverage", 6))
