"""Text placement: glyph dictionary, running advance, visible instances, bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from inkfold.functions.scalar import FONT_SCALE, MAT, is_blank_token, transformed_box
from inkfold.plans.session import ship

#: Fixed values.
BOUNDS_EPS = 1e-4
LEAST_ALPHA = 1e-3
RETRY_SHARE = 0.2
VISIBLE_MODES = [0, 2, 4, 6]
#: Characters that are placed, and counted, at a time.
PLACED, COUNTED = 1 << 16, 1 << 20


def glyph_dictionary(tokens: DataFrame, order: list[str]) -> DataFrame:
    """(font, font_char, glyph_id, n): distinct glyphs, numbered by first use in ``order``.

    First uses are found by an aggregate with map-side combining; only distinct glyphs
    reach the single-partition numbering: as many as the fonts have characters.
    """
    first = F.min(F.struct(*order))
    return _numbered(tokens.groupBy("font", "font_char").agg(F.count(F.lit(1)).alias("n"), first.alias("_first")))


def _numbered(g: DataFrame) -> DataFrame:
    return g.select("font", "font_char", "n", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("glyph_id"))


def _pieces(batches, by: list[str], most: int):
    """Lists of ([values of by], font, start, text) of whole lines in parts, of about ``most`` characters a list."""
    held, size = [], 0
    for batch in batches:
        keys, fonts, lines = [batch.column(n) for n in by], batch.column("font"), batch.column("line")
        for i in range(batch.num_rows):
            key, font, line = [k[i].as_py() for k in keys], fonts[i].as_py(), lines[i].as_py() or ""
            for start in range(0, len(line), most):
                held.append((key, font, start, line[start : start + most]))
                size += len(held[-1][3])
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def line_glyph_dictionary(lines: DataFrame, by: list[str]) -> DataFrame:
    """The same of whole lines (by..., font, line), a token for each character, ordered by ``by`` and position.

    A task counts about a million characters at a time, so that only glyphs and first uses leave it, no token.
    """
    ship(lines.sparkSession)
    rows = lines.select(*by, "font", "line")
    kept = [rows.schema[n] for n in by]
    schema = f"font string, font_char string, n long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, pos int"
    kinds = [pa.string(), pa.string(), pa.int64(), *(f.type for f in to_arrow_schema(rows.select(*by).schema)), pa.int32()]
    names = ["font", "font_char", "n", *by, "pos"]

    def run(batches):
        for held in _pieces(batches, by, COUNTED):
            out = []
            held.sort(key=lambda p: ([(k is not None, k) for k in p[0]], p[2]))
            for font in {p[1] for p in held}:
                own = [p for p in held if p[1] == font]
                codes = _codes("".join(p[3] for p in own))
                starts = np.cumsum([0, *(len(p[3]) for p in own)])
                counts = np.bincount(codes)
                first = np.zeros(len(counts), np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                for code in np.flatnonzero(counts).tolist():
                    at = int(first[code])
                    i = int(np.searchsorted(starts, at, "right")) - 1
                    out.append((font, chr(code), int(counts[code]), *own[i][0], own[i][2] + at - int(starts[i])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    parts = rows.mapInArrow(run, schema)
    return _numbered(parts.groupBy("font", "font_char").agg(F.sum("n").alias("n"), F.min(F.struct(*by, "pos")).alias("_first")))


def line_advances(lines: DataFrame, by: list[str], width, *, blanks: str = " \n\t", size: float = 10.0, scale: float = FONT_SCALE, chars: bool = True) -> DataFrame:
    """(by..., pos, width, x) of each character of whole lines (by..., font, line) that isn't blank; with ``chars`` also font and font_char.

    ``width`` gives widths of an array of code points. As in ``advances`` x is a running sum, but a line is
    one row, so that no token is moved or sorted to sum up; a long line is placed in parts.
    """
    ship(lines.sparkSession)
    rows = lines.select(*by, "font", "line")
    own = [*by, "font"] if chars else by
    fields = to_arrow_schema(rows.select(*own).schema)
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in own) + (", font_char string" if chars else "") + ", pos int, width double, x double"
    names = [*own, *(["font_char"] if chars else []), "pos", "width", "x"]
    empty = np.array([ord(c) for c in blanks], "<u4")

    def run(batches):
        reached = 0.0
        for held in _pieces(batches, by, PLACED):
            joined = "".join(p[3] for p in held)
            codes, sizes = _codes(joined), np.array([len(p[3]) for p in held])
            wide = width(codes)
            step, x, at = wide * size * scale, np.empty(len(codes)), 0
            for p in held:
                sums = np.cumsum(np.concatenate(([reached if p[2] else 0.0], step[at : at + len(p[3])])))
                x[at : at + len(p[3])], reached = sums[:-1], sums[-1]
                at += len(p[3])
            seen = ~np.isin(codes, empty)
            of = pa.array(np.repeat(np.arange(len(held)), sizes)[seen])
            pos = np.arange(len(codes)) + np.repeat(np.array([p[2] for p in held]) - (np.cumsum(sizes) - sizes), sizes)
            columns = [pa.array(v, f.type).take(of) for v, f in zip(zip(*((*p[0], p[1]) if chars else p[0] for p in held), strict=True), fields, strict=True)]
            if chars:
                raw = joined.encode()
                ends = np.append(np.flatnonzero((np.frombuffer(raw, "u1") & 0xC0) != 0x80), len(raw)).astype("<i4")
                columns.append(pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(raw)).filter(pa.array(seen)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pos[seen].astype("<i4")), pa.array(wide[seen]), pa.array(x[seen])], names)

    return rows.mapInArrow(run, schema)


def advances(tokens: DataFrame, by: list[str], order: str, *, size: float | Column = 10.0, scale: float | Column = FONT_SCALE, char_spacing=0.0, word_spacing=0.0) -> DataFrame:
    """Adds ``x``: where each token starts. Numbers (``adjust``) move back, glyphs by width and spacing.

    What is drawn doesn't matter for the advance, so it is a running sum.
    """
    col = lambda v: F.lit(v) if isinstance(v, int | float) else v
    step = F.col("width") * col(size) * col(scale) + col(char_spacing) + F.when(F.coalesce("is_space", F.lit(False)), col(word_spacing)).otherwise(0.0)
    if "adjust" in tokens.columns:
        step = F.when(F.col("adjust").isNotNull(), -F.col("adjust") * col(size) / 1000).otherwise(step)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("_step", step).withColumn("x", F.coalesce(F.sum("_step").over(w), F.lit(0.0))).drop("_step")


def instances(tokens: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Tokens that are drawn: horizontal, not blank, a drawing mode, opaque enough, a known glyph with an outline that meets the clip.

    ``glyphs``: (font, font_char, glyph_id, min_x, min_y, max_x, max_y), one row a distinct
    glyph; the optimizer broadcasts it where it is small. Adds the transformed box.
    """
    m = F.struct(*(F.col("matrix")[i].alias(n) for i, n in enumerate(MAT)))
    t = tokens.where(~F.col("vertical") & ~is_blank_token(F.col("font_char"), F.col("unicode"), F.col("is_space")) & F.col("mode").isin(VISIBLE_MODES) & (F.col("alpha") > LEAST_ALPHA))
    t = t.join(glyphs, ["font", "font_char"]).withColumn("box", transformed_box(m, F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")))
    c, b = F.col("clip"), F.col("box")
    inside = c.isNull() | ((b["max_x"] >= c[0]) & (b["min_x"] <= c[2]) & (b["max_y"] >= c[1]) & (b["min_y"] <= c[3]))
    return t.where(inside).drop("min_x", "min_y", "max_x", "max_y").select("*", "box.*").drop("box")


def page_counts(placed: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Instances whose box meets the page, and others; ``retry`` where fewer than a fifth do."""
    page = pages.select(*by, *(F.col(n).alias(f"p_{n}") for n in ("min_x", "min_y", "max_x", "max_y")))
    return paged_counts(placed.join(page, by), by)


def paged_counts(placed: DataFrame, by: list[str]) -> DataFrame:
    """The same of instances that bring their page's box as p_min_x, p_min_y, p_max_x, p_max_y."""
    inside = (F.col("max_x") >= F.col("p_min_x")) & (F.col("min_x") <= F.col("p_max_x")) & (F.col("max_y") >= F.col("p_min_y")) & (F.col("min_y") <= F.col("p_max_y"))
    counts = placed.groupBy(*by).agg(F.count_if(inside).alias("in_page"), F.count_if(~inside).alias("out_of_page"))
    return counts.withColumn("retry", F.col("in_page") < RETRY_SHARE * (F.col("in_page") + F.col("out_of_page")))


def better_variant(plain: DataFrame, retried: DataFrame, by: list[str]) -> DataFrame:
    """Per page, whether the retry without page transforms is taken: only if strictly more is in the page."""
    r = retried.select(*by, F.col("in_page").alias("retried_in_page"))
    j = plain.join(r, by, "left")
    return j.select(*by, "in_page", "retried_in_page", (F.col("retry") & (F.coalesce("retried_in_page", F.lit(0)) > F.col("in_page"))).alias("use_retry"))


def bounds(placed: DataFrame, by: list[str]) -> DataFrame:
    return placed.groupBy(*by).agg(
        (F.min("min_x") - BOUNDS_EPS).alias("min_x"), (F.min("min_y") - BOUNDS_EPS).alias("min_y"), (F.max("max_x") + BOUNDS_EPS).alias("max_x"), (F.max("max_y") + BOUNDS_EPS).alias("max_y")
    )


def segments_of(placed: DataFrame, glyph_segments: DataFrame, most: int = 256) -> DataFrame:
    """Instances with their glyph's segments, up to the limit of primitives that a glyph draws."""
    return placed.join(glyph_segments.where(F.col("pos") < most).withColumnRenamed("pos", "seg_pos"), ["font", "font_char"])
