"""Scalar functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Rounded half away from zero to six places; null unless finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, 6))


def strictest(*parts: Column) -> Column:
    """The greatest part, null if any part is (unlike greatest, which skips nulls)."""
    unknown = F.lit(False)
    for p in parts:
        unknown = unknown | p.isNull()
    return F.when(unknown, None).otherwise(F.greatest(*parts))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Accumulated in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def is_unit(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def shard(path: Column) -> Column:
    """First byte of the path's sha256."""
    return F.conv(F.substring(F.sha2(path, 256), 1, 2), 16, 10).cast("int")


def plain_space(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def url_template(path: Column) -> Column:
    """Path segments that are numbers or at least eight hex digits become `:id`."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^([0-9]+|[0-9a-fA-F]{8,})$"), ":id").otherwise(s)), "/")


def glob_pattern(glob: str) -> str:
    """Regular expression of a name glob: `**` crosses slashes, `*` and `?` do not, `{a,b}` is either, `[a-c]` and `[!a-c]` are classes."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c, close = glob[i], glob.find("]", i + 2)
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        if c == "[" and close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", close + 1
            continue
        if c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def pixel_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, slack: float = 1e-9) -> Column:
    """Fractions of an image to whole pixels that cover them, inside the image."""
    low = lambda v, n: F.greatest(F.floor(v * n + slack), F.lit(0))
    high = lambda v, n: F.least(F.ceil(v * n - slack), n)
    return F.struct(low(x, width).alias("left"), low(y, height).alias("top"), high(x + w, width).alias("right"), high(y + h, height).alias("bottom"))


def position_label(x: Column, y: Column, width: Column, height: Column) -> Column:
    third = lambda v, n: F.least(F.floor(v * 3 / n), F.lit(2)).cast("int")
    row = F.element_at(F.array(*map(F.lit, ("top", "middle", "bottom"))), third(y, height) + 1)
    column = F.element_at(F.array(*map(F.lit, ("left", "centre", "right"))), third(x, width) + 1)
    return F.concat_ws("-", row, column)


def over_grey(c: Column, alpha: Column, grey: int = 128) -> Column:
    """8-bit compositing with integer rounding."""
    return F.floor((c * alpha + grey * (255 - alpha) + 127) / 255).cast("int")


def linear_light(c: Column) -> Column:
    """sRGB (0 to 1) to linear."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear_light(r) + 0.7152 * linear_light(g) + 0.0722 * linear_light(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def seconds(stamp: Column) -> Column:
    """h:mm:ss,mmm or mm:ss.mmm to seconds."""
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stamp, r"^(?:(\d+):)?(\d\d):(\d\d)[,.](\d{3})$", i), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0))
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def is_abstention(answer: Column) -> Column:
    """Whether an answer leaves the question open (fixed values: unsure, needs_human); false for null."""
    return F.coalesce(answer.isin("unsure", "needs_human"), F.lit(False))


def is_human(source: Column) -> Column:
    """Whether a source names a person: `human`, or `human:` with a name, in any case and with blanks around; false for null."""
    plain = F.lower(F.trim(source))
    return F.coalesce((plain == "human") | plain.startswith("human:"), F.lit(False))
