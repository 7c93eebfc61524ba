"""From painted paths to rows of lines and quadratics.

A path is a flat array of opcodes and operands: 0 move (2), 1 line (2), 2 cubic (6),
3 quadratic (4), 4 close (0). Cubics become quadratics by halving until the error is
small. Rows are independent, so batches of paths flatten in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.interp import at
from inkfold.operators.merge import goes_on
from inkfold.plans.session import ship

#: Tolerance and depth of halving; squared lengths below which a part is a point.
SHAPE_ERROR, SHAPE_DEPTH = 0.08, 9
GLYPH_ERROR, GLYPH_DEPTH = 0.015, 12
STROKE_POINT, FILL_POINT = 1e-10, 1e-12
ROUND_CAP = 2
OPERANDS = {0: 2, 1: 2, 2: 6, 3: 4, 4: 0}


def quadratics(p0, p1, p2, p3, error: float, depth: int):
    """(control, end) pairs that follow a cubic, first to last."""
    control = tuple((3 * (b + c) - a - d) / 4 for a, b, c, d in zip(p0, p1, p2, p3, strict=True))
    if depth > 0:
        worst = 0.0
        for t in (0.25, 0.5, 0.75):
            u = 1 - t
            off = [
                u * u * u * a + 3 * u * u * t * b + 3 * u * t * t * c + t * t * t * d - (u * u * a + 2 * u * t * q + t * t * d)
                for a, b, c, d, q in zip(p0, p1, p2, p3, control, strict=True)
            ]
            worst = max(worst, off[0] ** 2 + off[1] ** 2)
        if worst > error * error:
            mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
            a, b, c = mid(p0, p1), mid(p1, p2), mid(p2, p3)
            d, e = mid(a, b), mid(b, c)
            m = mid(d, e)
            yield from quadratics(p0, a, d, m, error, depth - 1)
            yield from quadratics(m, e, c, p3, error, depth - 1)
            return
    yield control, p3


def commands(path):
    """(opcode, operands); ends at an unknown opcode or where operands are missing."""
    i = 0
    while i < len(path):
        n = OPERANDS.get(int(path[i]))
        if n is None or i + n >= len(path) + (n == 0):
            return
        yield int(path[i]), path[i + 1 : i + 1 + n]
        i += 1 + n


def _sq(a, b) -> float:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def stroke_segments(path, m, flags: int = 0, merge: bool = True):
    """(source count, rows (x0, y0, cx, cy, x1, y1, type)) of a stroked path."""
    out, pending, source = [], None, 0
    start = here = raw_start = raw = None

    def flush():
        nonlocal pending
        if pending is not None:
            x0, y0, x1, y1 = pending
            out.append((x0, y0, x1, y1, x1, y1, 0))
            pending = None

    def line(a, b):
        nonlocal pending, source
        if _sq(a, b) < STROKE_POINT:
            if flags & ROUND_CAP:
                flush()
                source += 1
                out.append((*a, *a, *a, 0))
            return
        source += 1
        if pending is not None and merge and goes_on(pending, (*a, *b)):
            pending = (*pending[:2], *b)
            return
        flush()
        pending = (*a, *b)

    def quad(a, c, b):
        nonlocal source
        flush()
        if _sq(a, b) < STROKE_POINT and _sq(a, c) < STROKE_POINT:
            return
        source += 1
        out.append((*a, *c, *b, 1))

    for code, v in commands(path):
        if code == 0:
            flush()
            raw_start = raw = (v[0], v[1])
            start = here = at(m, *raw)
        elif here is None:
            continue
        elif code == 1:
            raw, end = (v[0], v[1]), at(m, v[0], v[1])
            line(here, end)
            here = end
        elif code == 2:
            pts = [at(m, v[k], v[k + 1]) for k in (0, 2, 4)]
            for c, end in quadratics(here, *pts, SHAPE_ERROR, SHAPE_DEPTH):
                quad(here, c, end)
                here = end
            raw = (v[4], v[5])
        elif code == 3:
            c, end = at(m, v[0], v[1]), at(m, v[2], v[3])
            quad(here, c, end)
            raw, here = (v[2], v[3]), end
        else:
            if raw != raw_start:
                line(here, start)
            flush()
            raw, here = raw_start, start
    flush()
    return source, out


def outline(path, m, *, closes: bool, error: float, depth: int):
    """Rows of a filled path. With ``closes`` open subpaths are closed at a move and at the end."""
    out, start, here = [], None, None

    def line(a, b):
        if _sq(a, b) >= FILL_POINT:
            out.append((*a, *b, *b, 0))

    def quad(a, c, b):
        if _sq(a, b) >= FILL_POINT or _sq(a, c) >= FILL_POINT:
            out.append((*a, *c, *b, 1))

    for code, v in commands(path):
        if code == 0:
            if closes and here is not None:
                line(here, start)
            start = here = at(m, v[0], v[1])
        elif here is None:
            continue
        elif code == 1:
            end = at(m, v[0], v[1])
            line(here, end)
            here = end
        elif code == 2:
            for c, end in quadratics(here, *(at(m, v[k], v[k + 1]) for k in (0, 2, 4)), error, depth):
                quad(here, c, end)
                here = end
        elif code == 3:
            c, end = at(m, v[0], v[1]), at(m, v[2], v[3])
            quad(here, c, end)
            here = end
        else:
            line(here, start)
            here = start
    if closes and here is not None:
        line(here, start)
    return out


_ROW = "x0 double, y0 double, cx double, cy double, x1 double, y1 double, prim_type int"
_NAMES = ["x0", "y0", "cx", "cy", "x1", "y1"]


#: Rows of segments that leave a task at a time.
FLATTENED = 1 << 14


def _flattened(df: DataFrame, keep: list[str], need: list[str], rows, extra: str = "", extra_names: tuple = ()) -> DataFrame:
    """``rows(record)`` yields tuples (pos, *extra, x0 ... y1, type), which come with the columns ``keep`` of the record.

    ``need`` are columns that only ``rows`` reads, as the path: they aren't repeated with each segment.
    Records are taken one at a time, so memory follows the longest path, not the batch.
    """
    ship(df.sparkSession)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", pos long{extra}, {_ROW}"
    arrow = df.select(*keep).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kept = to_arrow_schema(arrow)
        fields = [*kept, pa.field("pos", pa.int64()), *(pa.field(n, pa.int64()) for n in extra_names), *(pa.field(n, pa.float64()) for n in _NAMES), pa.field("prim_type", pa.int32())]
        names = [f.name for f in fields]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names)
        out = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                own = tuple(r[c] for c in keep)
                for x in rows(r):
                    out.append((*own, *x))
                    if len(out) >= FLATTENED:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    return df.select(*keep, *need).mapInArrow(run, schema)


def strokes(painted: DataFrame, merge: bool = True) -> DataFrame:
    """Stroke rows of painted paths; ``source`` is the path's count before merging, in its first row (else 0)."""
    p = painted.where("is_stroke")

    def rows(r):
        n, out = stroke_segments(r["path"], r["ctm"], r["flags"], merge)
        for i, x in enumerate(out):
            yield (i, 0 if i else n, *x)

    flat = _flattened(p, ["doc_id", "page_no", "op_seq", "half_width", "flags", "stroke_rgb", "stroke_alpha"], ["ctm", "path"], rows, ", source long", ("source",))
    c = F.col
    return flat.select(
        "doc_id", "page_no", "op_seq", "pos", "source", *_NAMES, "prim_type", "half_width", *(c("stroke_rgb")[i].alias(n) for i, n in enumerate("rgb")), c("stroke_alpha").alias("alpha"), "flags"
    )


def fill_segments(painted: DataFrame) -> DataFrame:
    """Segments of visibly filled paths; a path without segments has no row, so it is no fill."""
    p = painted.where("is_fill and fill_alpha > 1e-3")
    rows = lambda r: ((i, *x) for i, x in enumerate(outline(r["path"], r["ctm"], closes=True, error=SHAPE_ERROR, depth=SHAPE_DEPTH)))
    flat = _flattened(p, ["doc_id", "page_no", "op_seq", "rule", "fill_rgb", "fill_alpha", "is_stroke", "stroke_alpha"], ["ctm", "path"], rows)
    has_stroke = F.col("is_stroke") & (F.col("stroke_alpha") > 1e-3)
    return flat.select("doc_id", "page_no", "op_seq", "pos", *_NAMES, "prim_type", "rule", *(F.col("fill_rgb")[i].alias(n) for i, n in enumerate("rgb")), F.col("fill_alpha").alias("alpha"), has_stroke.alias("has_stroke"))


def fill_paths(segments: DataFrame) -> DataFrame:
    """Parents of fill segments: box, count, paint; a page's ids follow the order of painting."""
    from pyspark.sql import Window

    low = lambda *n: F.min(F.least(*n))
    high = lambda *n: F.max(F.greatest(*n))
    g = segments.groupBy("doc_id", "page_no", "op_seq").agg(
        F.count(F.lit(1)).alias("seg_count"), low("x0", "cx", "x1").alias("min_x"), low("y0", "cy", "y1").alias("min_y"), high("x0", "cx", "x1").alias("max_x"), high("y0", "cy", "y1").alias("max_y"),
        *(F.first(n).alias(n) for n in ("rule", "r", "g", "b", "alpha", "has_stroke")),
    )
    w = Window.partitionBy("doc_id", "page_no").orderBy("op_seq")
    start = F.coalesce(F.sum("seg_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("fill_id", (F.row_number().over(w) - 1).cast("long")).withColumn("seg_start", start)


def glyph_segments(outlines: DataFrame) -> DataFrame:
    """(font, font_char, pos, segment): outlines of distinct glyphs (font, font_char, path)."""
    identity = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    rows = lambda r: ((i, *x) for i, x in enumerate(outline(r["path"] or [], identity, closes=False, error=GLYPH_ERROR, depth=GLYPH_DEPTH)))
    return _flattened(outlines, ["font", "font_char"], ["path"], rows)
