"""Coverage of points by primitives: distances, crossings, winding, opacity and blending."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.grid import near_points

#: Fixed values.
MOST_FILL, MOST_GLYPH = 2048, 256
CHORDS = 6
TEXT_AA = 1.25
#: What is painted over what.
LAYERS = {"page": 0, "raster": 1, "fill": 2, "stroke": 3, "text": 4}


def smoothstep(low: Column, high: Column, x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def line_distance(px, py, x0, y0, x1, y1) -> Column:
    """From a point to a segment; to its first end where it is a point."""
    dx, dy = x1 - x0, y1 - y0
    sq = dx * dx + dy * dy
    t = F.when(sq <= 1e-10, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / sq)))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def _with(make, **values) -> Column:
    """``make`` of a struct of values, each worked out once: the expression grows with its parts, not with their uses."""
    return F.get(F.transform(F.array(F.struct(*(x.alias(n) for n, x in values.items()))), make), F.lit(0))


def quadratic_distance(px, py, x0, y0, cx, cy, x1, y1) -> Column:
    """From a point to a quadratic curve: the nearest of the real roots of the derivative."""
    root = lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(1 / 3))

    def nearest(u: Column) -> Column:
        def away(t: Column) -> Column:
            return _with(lambda w: F.hypot(u["qx"] + (2 * u["ax"] + u["bx"] * w["t"]) * w["t"], u["qy"] + (2 * u["ay"] + u["by"] * w["t"]) * w["t"]), t=F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))

        def one(k: Column) -> Column:
            s = F.sqrt(F.greatest(k["h"], F.lit(0.0)))
            return away(root((s - k["q"]) / 2) + root((-s - k["q"]) / 2) - k["kx"])

        def three(k: Column) -> Column:
            z = F.sqrt(F.greatest(-k["p"], F.lit(0.0)))
            v = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), k["q"] / (k["p"] * z * 2)))) / 3
            ways = lambda w: F.least(away((w["m"] + w["m"]) * w["z"] - k["kx"]), away((-w["n"] - w["m"]) * w["z"] - k["kx"]), away((w["n"] - w["m"]) * w["z"] - k["kx"]))
            return _with(ways, m=F.cos(v), n=F.sin(v) * math.sqrt(3), z=z)

        def depressed(k: Column) -> Column:
            return _with(
                lambda w: _with(lambda x: F.when(x["h"] >= 0, one(x)).otherwise(three(x)), kx=w["kx"], p=w["p"], q=w["q"], h=w["q"] * w["q"] + 4 * w["p"] * w["p"] * w["p"]),
                kx=k["kx"], p=k["ky"] - k["kx"] * k["kx"], q=k["kx"] * (2 * k["kx"] * k["kx"] - 3 * k["ky"]) + k["kz"],
            )

        bb = u["bb"]
        roots = _with(
            depressed, kx=(u["ax"] * u["bx"] + u["ay"] * u["by"]) / bb, ky=(2 * (u["ax"] * u["ax"] + u["ay"] * u["ay"]) + u["qx"] * u["bx"] + u["qy"] * u["by"]) / (3 * bb),
            kz=(u["qx"] * u["ax"] + u["qy"] * u["ay"]) / bb,
        )
        return F.when(bb <= 1e-12, line_distance(px, py, x0, y0, x1, y1)).otherwise(roots)

    bx, by = x0 - 2 * cx + x1, y0 - 2 * cy + y1
    return _with(nearest, ax=cx - x0, ay=cy - y0, bx=bx, by=by, qx=x0 - px, qy=y0 - py, bb=bx * bx + by * by)


def stroke_coverage(distance: Column, half_width: Column, hairline: Column, zoom: Column) -> Column:
    """Opacity of a stroke at a distance from its axis, with soft edges of about a pixel."""
    hw = F.when(hairline, F.greatest(0.5 / zoom, F.lit(1e-5))).otherwise(half_width)
    aa = F.when(hairline, F.greatest(0.35 / zoom, F.lit(5e-5))).otherwise(F.greatest(1 / zoom, F.lit(1e-4)))
    return 1 - smoothstep(hw - aa, hw + aa, distance)


def drawn(alpha: Column, length: Column, flags: Column) -> Column:
    """Whether a stroke is drawn at all: opaque enough, and of some length unless its caps are round."""
    return (alpha > 1e-3) & ((length >= 1e-5) | (flags.bitwiseAND(2) != 0))


def line_crossing(px, py, x0, y0, x1, y1) -> Column:
    """+1 or -1 where the ray to the right of the point meets the edge going up or down, else 0."""
    up, down = (y0 <= py) & (py < y1), (y1 <= py) & (py < y0)
    x = x0 + (py - y0) * (x1 - x0) / (y1 - y0)
    flat = F.abs(y1 - y0) <= 1e-6
    return F.when(flat | ~(up | down) | ~(x > px), 0).when(up, 1).otherwise(-1)


def fill_crossing(px, py, x0, y0, cx, cy, x1, y1, prim_type) -> Column:
    """Of a line, or of a quadratic as six chords of equal parameter steps."""

    def point(i: int):
        t = i / CHORDS
        u = 1 - t
        return u * u * x0 + 2 * u * t * cx + t * t * x1, u * u * y0 + 2 * u * t * cy + t * t * y1

    ends = [(x0, y0), *(point(i) for i in range(1, CHORDS)), (x1, y1)]
    curve = sum((line_crossing(px, py, *a, *b) for a, b in zip(ends[1:], ends[2:], strict=False)), line_crossing(px, py, *ends[0], *ends[1]))
    return F.when(prim_type == 0, line_crossing(px, py, x0, y0, x1, y1)).otherwise(curve)


def fill_crossings(px, py, x0, y0, cx, cy, x1, y1, prim_type) -> Column:
    """How many edges the ray meets, whatever their direction."""

    def point(i: int):
        t = i / CHORDS
        u = 1 - t
        return u * u * x0 + 2 * u * t * cx + t * t * x1, u * u * y0 + 2 * u * t * cy + t * t * y1

    ends = [(x0, y0), *(point(i) for i in range(1, CHORDS)), (x1, y1)]
    curve = sum((F.abs(line_crossing(px, py, *a, *b)) for a, b in zip(ends[1:], ends[2:], strict=False)), F.abs(line_crossing(px, py, *ends[0], *ends[1])))
    return F.when(prim_type == 0, F.abs(line_crossing(px, py, x0, y0, x1, y1))).otherwise(curve)


def text_crossing(px, py, x0, y0, cx, cy, x1, y1, prim_type) -> Column:
    """Of a glyph's line, or of its quadratic by the roots of its height."""
    a, b, c = y0 - 2 * cy + y1, 2 * (cy - y0), y0 - py
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    straight = F.abs(a) <= 1e-9

    def hit(t: Column, ok: Column) -> Column:
        x = (x0 - 2 * cx + x1) * t * t + 2 * (cx - x0) * t + x0
        slope = 2 * a * t + b
        good = ok & (t >= -1e-5) & (t < 1 - 1e-5) & (x > px) & (F.abs(slope) > 1e-9)
        return F.when(F.coalesce(good, F.lit(False)), F.signum(slope).cast("int")).otherwise(0)

    single = hit(-c / b, straight & (F.abs(b) > 1e-9))
    both = hit((-b - root) / (2 * a), ~straight & (disc >= 0)) + hit((-b + root) / (2 * a), ~straight & (disc >= 0))
    return F.when(prim_type == 0, line_crossing(px, py, x0, y0, x1, y1)).when(straight, single).otherwise(both)


def segment_distance(px, py, x0, y0, cx, cy, x1, y1, prim_type) -> Column:
    return F.when(prim_type == 0, line_distance(px, py, x0, y0, x1, y1)).otherwise(quadratic_distance(px, py, x0, y0, cx, cy, x1, y1))


SHAPE = ("x0", "y0", "cx", "cy", "x1", "y1")


def point_winding(points: DataFrame, segments: DataFrame, cell: float = 8.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, point_id, fill_id, winding, crossings) of points in the boxes of fills; ``by`` are the segments' columns that make ``fill_id`` unique.

    Points (point_id, px, py) and fills' boxes meet in grid cells, an equi-join; then each
    pair meets the fill's segments, and sums over them decide. Points that have columns of ``by`` meet
    fills of the same values only (their page); others meet those of every page.
    """
    c = F.col
    fill = [*by, "fill_id"]
    box = segments.groupBy(*fill).agg(
        F.min(F.least("x0", "cx", "x1")).alias("bx0"), F.min(F.least("y0", "cy", "y1")).alias("by0"), F.max(F.greatest("x0", "cx", "x1")).alias("bx1"), F.max(F.greatest("y0", "cy", "y1")).alias("by1")
    )
    pairs = near_points(points, box, cell, by).select("point_id", "px", "py", *fill)
    own = segments.where(c("pos") < MOST_FILL)
    p, q = (c("px"), c("py")), tuple(map(c, SHAPE))
    line = (c("x0"), c("y0"), c("x1"), c("y1"))
    # Lines and curves apart, so that lines stay in short generated code.
    lines = pairs.join(own.where("prim_type = 0"), fill).select("point_id", *fill, line_crossing(*p, *line).alias("w"), line_distance(*p, *line).alias("d"))
    lines = lines.withColumn("k", F.abs("w"))
    curves = pairs.join(own.where("prim_type <> 0"), fill).select(
        "point_id", *fill, fill_crossing(*p, *q, F.lit(1)).alias("w"), quadratic_distance(*p, *q).alias("d"), fill_crossings(*p, *q, F.lit(1)).alias("k")
    )
    return lines.unionByName(curves).groupBy(*by, "point_id", "fill_id").agg(F.sum("w").cast("long").alias("winding"), F.sum("k").cast("long").alias("crossings"), F.min("d").alias("distance"))


def fill_alpha(winding: Column, crossings: Column, rule: Column, distance: Column, has_stroke: Column, alpha: Column, zoom: Column) -> Column:
    """Nonzero (0) or even-odd (1) filling; the edge is hard under an own stroke, else soft."""
    inside = F.when(rule == 1, crossings % 2 == 1).otherwise(winding != 0)
    aa = F.greatest(1 / zoom, F.lit(1e-4))
    soft = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - F.when(inside, -distance).otherwise(distance) / aa))
    return alpha * F.when(has_stroke, inside.cast("double")).otherwise(soft)


def text_alpha(winding: Column, distance_px: Column, alpha: Column) -> Column:
    signed = F.when(winding != 0, -distance_px).otherwise(distance_px)
    return alpha * (1 - smoothstep(F.lit(-TEXT_AA), F.lit(TEXT_AA), signed))


def stroke_points(points: DataFrame, strokes: DataFrame, zoom: float = 1.0, cell: float = 8.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, point_id, seg_id, distance, coverage) where a stroke covers a point at all."""
    c = F.col
    z = F.lit(float(zoom))
    reach = F.when(c("flags").bitwiseAND(1) != 0, F.greatest(0.85 / z, F.lit(1e-4))).otherwise(c("half_width") + F.greatest(1 / z, F.lit(1e-4)))
    s = strokes.withColumn("_r", reach)
    s = s.withColumns({
        "bx0": F.least("x0", "cx", "x1") - c("_r"), "by0": F.least("y0", "cy", "y1") - c("_r"), "bx1": F.greatest("x0", "cx", "x1") + c("_r"), "by1": F.greatest("y0", "cy", "y1") + c("_r"),
    })
    kinds = ((s.where("prim_type = 0"), line_distance(c("px"), c("py"), c("x0"), c("y0"), c("x1"), c("y1"))), (s.where("prim_type <> 0"), quadratic_distance(c("px"), c("py"), *map(c, SHAPE))))
    near = [near_points(points, part, cell, by).withColumn("distance", d) for part, d in kinds]
    met = near[0].union(near[1]).select(*by, "point_id", "seg_id", "half_width", "flags", "_r", "distance").where("distance < _r")  # beyond its reach a stroke covers nothing
    return met.select(*by, "point_id", "seg_id", "distance", stroke_coverage(c("distance"), c("half_width"), c("flags").bitwiseAND(1) != 0, z).alias("coverage"))


#: Layers of a point that are painted over each other at a time.
STACK = 256


def blend(paint: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Source over destination in the order of painting: rows (by..., order..., r, g, b, alpha) on white.

    Painting over is associative: every STACK layers become one (what they show, and what share of what is
    below shows through), then those are painted, so no row holds all layers of a point.
    """
    rgb = ("r", "g", "b")
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    layer = F.struct(F.col("_k"), *(F.col(n).cast("double").alias(n) for n in (*rgb, "alpha")))
    stacks = paint.withColumn("_k", k).withColumn("_stack", F.floor(F.col("_k") / STACK)).groupBy(*by, "_stack").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    clear = F.struct(*(F.lit(0.0).alias(n) for n in rgb), F.lit(1.0).alias("through"))
    onto = lambda acc, x: F.struct(*((x[n] * x["alpha"] + acc[n] * (1 - x["alpha"])).alias(n) for n in rgb), (acc["through"] * (1 - x["alpha"])).alias("through"))
    stacks = stacks.select(*by, "_stack", F.aggregate("layers", clear, onto).alias("s")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_stack", "s.*"))).alias("stacks"))
    over = lambda acc, x: F.struct(*((x[n] + acc[n] * x["through"]).alias(n) for n in rgb))
    white = F.struct(*(F.lit(1.0).alias(n) for n in rgb))
    return stacks.select(*by, F.aggregate("stacks", white, over).alias("c")).select(*by, "c.*")


def raster_uv(px: Column, py: Column, inverse: Column) -> Column:
    """Where a point falls in an image placed by a matrix: (u, v) with v from the top."""
    u = inverse["a"] * px + inverse["c"] * py + inverse["e"]
    v = inverse["b"] * px + inverse["d"] * py + inverse["f"]
    return F.struct(u.alias("u"), (1 - v).alias("v"))
