"""Scalar functions on columns: numbers, colours, matrices, names.

All are expressions of built-in functions, so they stay in generated code. A matrix is a
struct (a, b, c, d, e, f) with x' = a x + c y + e and y' = b x + d y + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances and limits that results depend on.
INVISIBLE_ALPHA, OPAQUE_ALPHA = 1e-3, 0.999
FLAG_HAIRLINE, FLAG_ROUND_CAP = 1, 2
FONT_SCALE = 0.001
MAT = ("a", "b", "c", "d", "e", "f")

_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def num(x) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x


def f32(x: Column) -> Column:
    """Rounded to float32, as a stored cell is, then back to double."""
    return x.cast("float").cast("double")


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(clamp(x, 0, 1))


def clamp01_or_zero(x: Column) -> Column:
    """Into [0, 1]; what isn't finite is 0."""
    return F.when(finite(x), clamp(x, 0, 1)).otherwise(F.lit(0.0))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def quantize(x: Column, scale) -> Column:
    return round_half_up(x * num(scale))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def pack_meta(alpha: Column, flags: Column) -> Column:
    """alpha + 2 * flags in one number."""
    return clamp01(alpha) + F.greatest(F.lit(0.0), trunc(flags + 1e-6).cast("double")) * 2


def unpack_flags(packed: Column) -> Column:
    return F.greatest(F.lit(0), trunc(packed / 2 + 1e-6)).cast("int")


def unpack_alpha(packed: Column) -> Column:
    return clamp01(packed - unpack_flags(packed) * 2.0)


# ---- colours


def gray(x: Column, fallback=0.0) -> Column:
    """A grey level; above 1 it counts in 255ths; else the fallback."""
    return F.when(finite(x), clamp01(F.when(x > 1, x / 255).otherwise(x))).otherwise(num(fallback))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(gray(r).alias("r"), gray(g).alias("g"), gray(b).alias("b"))


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """From components in [0, 1], or in hundredths above 1."""
    part = lambda v: F.when(finite(v), clamp01(F.when(v > 1, v / 100).otherwise(v))).otherwise(F.lit(0.0))
    out = lambda v: 1 - F.least(F.lit(1.0), part(v) + part(k))
    return F.struct(out(c).alias("r"), out(m).alias("g"), out(y).alias("b"))


def hex_color(text: Column) -> Column:
    """#rgb or #rrggbb as (r, g, b) in [0, 1]; null for any other text."""
    body = F.lower(F.regexp_extract(F.trim(text), r"^#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1))
    full = F.when(F.length(body) == 3, F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255
    return F.when(F.length(body) > 0, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def mix(a: Column, b: Column, t: Column) -> Column:
    """Colour override: b by the share t, clamped."""
    w = clamp01(t)
    return a * (1 - w) + b * w


# ---- matrices


def mat(*values) -> Column:
    return F.struct(*(num(v).cast("double").alias(n) for v, n in zip(values, MAT, strict=True)))


def identity() -> Column:
    return mat(1, 0, 0, 1, 0, 0)


def multiply(m: Column, n: Column) -> Column:
    """m x n: n is applied first."""
    return mat(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"],
        m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def apply_x(m: Column, x: Column, y: Column) -> Column:
    return m["a"] * x + m["c"] * y + m["e"]


def apply_y(m: Column, x: Column, y: Column) -> Column:
    return m["b"] * x + m["d"] * y + m["f"]


def invert(m: Column) -> Column:
    """The inverse, or null where the determinant isn't finite or nearly 0."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    inverse = mat(
        m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det,
        (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det,
    )
    return F.when(finite(det) & (F.abs(det) > 1e-12), inverse)


def matrix_scale(m: Column) -> Column:
    """Mean of the column norms; 1 if that isn't a positive number."""
    s = (F.hypot(m["a"], m["b"]) + F.hypot(m["c"], m["d"])) / 2
    return F.when(finite(s) & (s > 0), s).otherwise(F.lit(1.0))


def transformed_box(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Bounds of a box's transformed corners."""
    xs = [apply_x(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    ys = [apply_y(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def rotation(degrees: Column) -> Column:
    """Into [0, 360)."""
    return F.when(finite(degrees), F.pmod(degrees, F.lit(360.0))).otherwise(F.lit(0.0))


def page_matrix(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column) -> Column:
    """Page space to a y-up world: quarter turns about the page's middle, lower left corner at 0."""
    w, h, r = x1 - x0, y1 - y0, rotation(degrees)
    return (
        F.when(r == 90, mat(F.lit(0.0), F.lit(-1.0), F.lit(1.0), F.lit(0.0), -y0, w + x0))
        .when(r == 180, mat(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), w + x0, h + y0))
        .when(r == 270, mat(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), h + y0, -x0))
        .otherwise(mat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), -x0, -y0))
    )


# ---- boxes


def overlaps(a: str, b: str) -> Column:
    """Closed boxes (columns with these prefixes) share a point."""
    c = F.col
    return (c(f"{a}max_x") >= c(f"{b}min_x")) & (c(f"{a}min_x") <= c(f"{b}max_x")) & (c(f"{a}max_y") >= c(f"{b}min_y")) & (c(f"{a}min_y") <= c(f"{b}max_y"))


def box_struct_overlap(a: Column, b: Column) -> Column:
    return (a["max_x"] >= b["min_x"]) & (a["min_x"] <= b["max_x"]) & (a["max_y"] >= b["min_y"]) & (a["min_y"] <= b["max_y"])


def intersect(a: Column, b: Column) -> Column:
    """Null is the whole plane; disjoint boxes also give null."""
    x0, y0 = F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"])
    x1, y1 = F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"])
    met = F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y")))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(met)


def union_box(a: Column, b: Column) -> Column:
    """Null-tolerant union of two boxes."""
    both = F.struct(
        F.least(a["min_x"], b["min_x"]).alias("min_x"), F.least(a["min_y"], b["min_y"]).alias("min_y"),
        F.greatest(a["max_x"], b["max_x"]).alias("max_x"), F.greatest(a["max_y"], b["max_y"]).alias("max_y"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def offset_box(b: Column, dx: Column, dy: Column) -> Column:
    return F.struct((b["min_x"] + dx).alias("min_x"), (b["min_y"] + dy).alias("min_y"), (b["max_x"] + dx).alias("max_x"), (b["max_y"] + dy).alias("max_y"))


def valid_box(b: Column) -> Column:
    return finite(b["min_x"]) & finite(b["min_y"]) & finite(b["max_x"]) & finite(b["max_y"])


# ---- dynamic arguments


def arg(args: Column, i: int) -> Column:
    """The i-th argument if there and finite, else null."""
    x = F.get(args, i)
    return F.when(finite(x), x)


def positive_int(x: Column, fallback: int, low: int = 1, high: int = 2**31 - 1) -> Column:
    """Truncated and clamped; the fallback if not a number."""
    return F.when(finite(x), clamp(trunc(x).cast("double"), low, high).cast("int")).otherwise(F.lit(fallback))


def non_negative_int(x: Column, fallback: int = 0) -> Column:
    n = F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double")
    return F.when(finite(n), F.greatest(F.lit(0), trunc(n))).otherwise(F.lit(fallback)).cast("long")


def finite_or(text: Column, fallback) -> Column:
    """A text as a finite number, else the fallback; an empty text is 0, a null one 0 too."""
    n = F.coalesce(F.when(F.trim(text) == "", F.lit(0.0)).otherwise(text.try_cast("double")), F.when(text.isNull(), F.lit(0.0)))
    return F.when(finite(n), n).otherwise(num(fallback))


def non_empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# ---- layout arithmetic


def auto_pages_per_row(n: Column) -> Column:
    return clamp(F.ceil(F.sqrt(n.cast("double"))).cast("double"), 1, 100).cast("int")


def texture_dims(n: Column, most: int, *, checked: bool = True) -> Column:
    """(width, height) of a near-square texture for n texels; with ``checked`` an error if it would be too high."""
    w = clamp(F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("double"), 1, most).cast("long")
    h = F.ceil(F.greatest(n, F.lit(1)) / w).cast("long")
    if checked:
        h = F.when(h <= most, h).otherwise(F.raise_error(F.lit("too many texels for the largest texture")).cast("long"))
    return F.struct(w.alias("width"), h.alias("height"))


def texel(i: Column, width: Column) -> Column:
    return F.struct((i % width).alias("x"), F.floor(i / width).cast("long").alias("y"))


def align_to(x: Column, unit: int) -> Column:
    return (F.ceil(x / unit) * unit).cast("long")


def power_of_two(x: Column) -> Column:
    """The smallest power of two that isn't below x."""
    n = F.greatest(x.cast("long"), F.lit(1))
    bits = F.length(F.bin(n - 1))
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), bits)).cast("long")


def points_close(x0, y0, x1, y1, eps: float = 1e-3) -> Column:
    return (F.abs(x0 - x1) <= eps) & (F.abs(y0 - y1) <= eps)


def cross_distance_sq(dx: Column, dy: Column, px: Column, py: Column) -> Column:
    """Squared distance of (px, py) from the line through 0 along (dx, dy)."""
    cross = dx * py - dy * px
    return cross * cross / (dx * dx + dy * dy)


def wheel_factor(delta: Column) -> Column:
    return F.exp(-delta * 0.0013)


# ---- names and texts


def iso_time(t: Column) -> Column:
    """A time as text, to the millisecond in UTC."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def without_parsed_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)[._-]?parsed[._-]?data$", "")


def _folded(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, _ACCENTS, _PLAIN), "[̀-ͯ]", ""))


def comparable_stem(text: Column) -> Column:
    """Accents off, lower case, letters and digits only."""
    return F.regexp_replace(_folded(text), "[^a-z0-9]+", "")


def id_stem(text: Column) -> Column:
    """As comparable_stem, with single underscores between the parts."""
    return F.regexp_replace(F.regexp_replace(_folded(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def zip_score(name: Column) -> Column:
    """How far a ZIP's name is from the usual form: 0 is best."""
    s = F.lower(stem(name))
    return F.when(s.endswith("-parsed-data"), 0).when(s.endswith("_parsed_data"), 1).when(s.rlike(r"parsed[._-]?data$"), 2).otherwise(3)


def download_name(label: Column) -> Column:
    base = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)\.pdf$", "")), "[^a-zA-Z0-9._-]+", "_")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("floorplan"))


def is_blank_token(font_char: Column, unicode: Column, is_space: Column) -> Column:
    """No glyph to draw: none given, marked as space, or text that is white space only."""
    none = font_char.isNull() | (font_char == "")
    return none | F.coalesce(is_space, F.lit(False)) | F.coalesce((unicode != "") & unicode.rlike(r"(?U)^\s*$"), F.lit(False))


def is_absolute_url(url: Column) -> Column:
    return url.rlike(r"(?i)^[a-z][a-z\d+.-]*:")


def asset_url(url: Column, base: Column) -> Column:
    return F.when(is_absolute_url(url), url).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", "")))


def kilobytes(n: Column) -> Column:
    return F.concat(F.format_number(n / 1024, 1), F.lit(" kB"))


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x, 1), F.lit("%"))


def options_key(merge: Column, cull: Column) -> Column:
    """The key under which extracted pages are kept."""
    bit = lambda c: F.when(F.coalesce(c, F.lit(True)), "1").otherwise("0")
    return F.concat(F.lit("merge:"), bit(merge), F.lit("|cull:"), bit(cull))


def mime_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".png"), "image/png").when(p.endswith(".webp"), "image/webp").when(p.rlike(r"\.jpe?g$"), "image/jpeg").otherwise("application/octet-stream")


def file_kind(path: Column, mime: Column) -> Column:
    """pdf, zip or null, by MIME type or extension."""
    p, m = F.lower(F.coalesce(path, F.lit(""))), F.coalesce(mime, F.lit(""))
    zips = m.isin("application/zip", "application/x-zip-compressed")
    return F.when((m == "application/pdf") | p.endswith(".pdf"), "pdf").when(zips | p.endswith(".zip"), "zip")
