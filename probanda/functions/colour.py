"""Colour as columns: sRGB and linear light, CIELAB, CIEDE2000, colour-vision simulation, ICtCp and its difference.

Each function takes a table and names of columns and adds its result. Intermediate values are columns of
their own on the way, so that an expression that is used often is not written out each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published matrices (fixed values): colour-vision deficiency of full severity in linear RGB (Machado, Oliveira and Fernandes 2009) for protan, deutan and tritan; linear sRGB to XYZ over the D65 white; and the steps to ICtCp of BT.2100, in 4096ths.
DEFICIENCIES = {
    "protan": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deutan": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.011820, 0.042940, 0.968881)),
    "tritan": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.303900)),
}
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LMS = ((1688, 2146, 262), (683, 2951, 462), (99, 309, 3688))
ICTCP = ((2048, 2048, 0), (6610, -13613, 7003), (17933, -17390, -543))
#: Constants of the perceptual quantizer (ST 2084): two exponents and three coefficients (fixed values).
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128


def linear_light(v: Column) -> Column:
    """Linear light of an sRGB share of 0 to 1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def encoded(v: Column) -> Column:
    """The sRGB share of linear light, cut off at 0 and 1."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def weighed(matrix, values: list[Column]) -> list[Column]:
    """A matrix times a vector of columns."""
    return [sum((w * v for w, v in zip(row[1:], values[1:], strict=True)), row[0] * values[0]) for row in matrix]


def simulated(kind: str, linear: list[Column]) -> list[Column]:
    """What an eye without the cones of the kind makes of linear RGB."""
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in weighed(DEFICIENCIES[kind], linear)]


def with_lab(rows: DataFrame, linear: list[str], names: list[str]) -> DataFrame:
    """rows with CIELAB of the linear RGB columns."""
    parts = [v / w for v, w in zip(weighed(XYZ, [F.col(c) for c in linear]), WHITE, strict=True)]
    bent = [F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116) for v in parts]
    rows = rows.withColumns({f"_f{i}": v for i, v in enumerate(bent)})
    f = [F.col(f"_f{i}") for i in range(3)]
    return rows.withColumns(dict(zip(names, (116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])), strict=True))).drop("_f0", "_f1", "_f2")


def with_ciede2000(rows: DataFrame, one: list[str], two: list[str], name: str) -> DataFrame:
    """rows with the CIEDE2000 difference of two CIELAB colours (Sharma, Wu and Dalal 2005, all weights 1)."""
    c = F.col
    sides = dict(zip("12", (one, two), strict=True))
    chroma = lambda x, y: F.sqrt(x * x + y * y)
    share = lambda x: F.sqrt(F.pow(x, F.lit(7)) / (F.pow(x, F.lit(7)) + 25.0**7))
    rows = rows.withColumns({f"_a{s}": c(v[1]) for s, v in sides.items()} | {f"_b{s}": c(v[2]) for s, v in sides.items()})
    rows = rows.withColumn("_g", 1.5 - 0.5 * share((chroma(c("_a1"), c("_b1")) + chroma(c("_a2"), c("_b2"))) / 2))
    rows = rows.withColumns({f"_a{s}": c("_g") * c(f"_a{s}") for s in sides})
    hue = lambda s: F.when((c(f"_a{s}") == 0) & (c(f"_b{s}") == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(f"_b{s}", f"_a{s}")), F.lit(360.0)))
    rows = rows.withColumns({f"_c{s}": chroma(c(f"_a{s}"), c(f"_b{s}")) for s in sides} | {f"_h{s}": hue(s) for s in sides})
    grey, turn = c("_c1") * c("_c2") == 0, c("_h2") - c("_h1")
    rows = rows.withColumns({
        "_dl": c(two[0]) - c(one[0]), "_dc": c("_c2") - c("_c1"), "_l": (c(one[0]) + c(two[0])) / 2, "_c": (c("_c1") + c("_c2")) / 2,
        # The shorter way around the circle, and the hue half-way along it.
        "_turn": F.when(grey, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn),
        "_h": F.when(grey, c("_h1") + c("_h2")).when(F.abs(turn) <= 180, (c("_h1") + c("_h2")) / 2).when(c("_h1") + c("_h2") < 360, (c("_h1") + c("_h2") + 360) / 2).otherwise((c("_h1") + c("_h2") - 360) / 2)})
    cos = lambda x: F.cos(F.radians(x))
    rows = rows.withColumns({
        "_dh": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_turn") / 2)),
        "_t": 1 - 0.17 * cos(c("_h") - 30) + 0.24 * cos(2 * c("_h")) + 0.32 * cos(3 * c("_h") + 6) - 0.20 * cos(4 * c("_h") - 63),
        "_rt": -2 * share(c("_c")) * F.sin(F.radians(60 * F.exp(-F.pow((c("_h") - 275) / 25, F.lit(2))))),
        "_sl": 1 + 0.015 * F.pow(c("_l") - 50, F.lit(2)) / F.sqrt(20 + F.pow(c("_l") - 50, F.lit(2)))})
    rows = rows.withColumns({"_x": c("_dl") / c("_sl"), "_y": c("_dc") / (1 + 0.045 * c("_c")), "_z": c("_dh") / (1 + 0.015 * c("_c") * c("_t"))})
    rows = rows.withColumn(name, F.sqrt(F.greatest(F.lit(0.0), c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z") + c("_rt") * c("_y") * c("_z"))))
    return rows.drop(*[f"_{k}{s}" for k in "abch" for s in "12"], "_g", "_dl", "_dc", "_l", "_c", "_turn", "_h", "_dh", "_t", "_rt", "_sl", "_x", "_y", "_z")


def light_of(v: Column) -> Column:
    """Light of a perceptually quantized share, as a share of 10,000 candelas a square metre."""
    p = F.pow(v, F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))


def quantized(v: Column) -> Column:
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def with_ictcp(rows: DataFrame, rgb: list[str], names: list[str]) -> DataFrame:
    """rows with ICtCp of perceptually quantized RGB shares; null outside 0 to 1."""
    inside = F.lit(True)
    for c in rgb:
        inside = inside & F.col(c).between(0, 1)
    lms = weighed(LMS, [light_of(F.col(c)) for c in rgb])
    rows = rows.withColumns({f"_q{i}": F.when(inside, quantized(v / 4096)) for i, v in enumerate(lms)})
    out = weighed(ICTCP, [F.col(f"_q{i}") for i in range(3)])
    return rows.withColumns({n: v / 4096 for n, v in zip(names, out, strict=True)}).drop("_q0", "_q1", "_q2")


def itp_difference(one: list[str], two: list[str]) -> Column:
    """The difference of two ICtCp colours (BT.2124), in which Ct counts half."""
    i, t, p = (F.col(a) - F.col(b) for a, b in zip(one, two, strict=True))
    return 720 * F.sqrt(i * i + 0.25 * t * t + p * p)
