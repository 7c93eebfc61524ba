"""From operator streams to scenes: extraction, culling, layout and totals as one composition."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators import cull, interp, layout, paths, text
from inkfold.operators.layout import PER_ROW
from inkfold.plans.session import written


@dataclass
class Scenes:
    """Tables of the drawn things, keyed by (doc_id, page_no); coordinates are the document's after ``arrange``."""

    pages: DataFrame
    strokes: DataFrame
    fills: DataFrame
    fill_segments: DataFrame
    tokens: DataFrame
    counts: DataFrame


def extract(ops: DataFrame, pages: DataFrame, *, fonts: DataFrame | dict | None = None, merge: bool = True, drop_invisible: bool = True, max_pages: int | None = None) -> Scenes:
    """Scenes of pages, each in its own coordinates.

    ``ops``: operator lists; ``pages``: (doc_id, page_no, min_x, min_y, max_x, max_y). The page limit reaches both scans.
    """
    if max_pages is not None:
        ops, pages = layout.pages_up_to(ops, max_pages), layout.pages_up_to(pages, max_pages)
    painted = written(interp.painted_paths(ops), "painted")  # strokes and fills both read it
    strokes = paths.strokes(painted, merge).withColumn("seg_id", F.col("op_seq") * (1 << 32) + F.col("pos"))
    drawn = cull.visible(strokes) if drop_invisible else strokes
    segments = paths.fill_segments(painted)
    return Scenes(pages, drawn, paths.fill_paths(segments), segments, interp.shown_tokens(ops, fonts), interp.path_count(ops))


def saved(scenes: Scenes) -> Scenes:
    """Every table written once, for all that reads it later: other arrangements, totals, exports."""
    return Scenes(*(written(getattr(scenes, f.name), f"scene-{f.name}") for f in fields(scenes)))


def arrange(scenes: Scenes, per_row: int = PER_ROW) -> Scenes:
    """The pages of each document on a grid, all coordinates moved with their page."""
    places = layout.layout(scenes.pages, per_row)
    move = lambda df, xs, ys: layout.translate(df, places, xs, ys)
    shape = (["x0", "cx", "x1"], ["y0", "cy", "y1"])
    tokens = scenes.tokens.join(places, ["doc_id", "page_no"])
    tokens = tokens.withColumn("matrix", F.transform("matrix", lambda v, i: v + F.when(i == 4, F.col("tx")).when(i == 5, F.col("ty")).otherwise(0.0))).drop("tx", "ty")
    return Scenes(
        layout.compose_pages(scenes.pages, places), move(scenes.strokes, *shape), move(scenes.fills, ["min_x", "max_x"], ["min_y", "max_y"]), move(scenes.fill_segments, *shape), tokens, scenes.counts,
    )


def totals(scenes: Scenes) -> DataFrame:
    """One row a document: pages, counts of all that is drawn, and the box of it (of the pages, if nothing is)."""
    own = ["min_x", "min_y", "max_x", "max_y"]
    strokes, fills = cull.bounds(scenes.strokes, ["doc_id"]).select("doc_id", *own), scenes.fills.select("doc_id", *own)
    box = layout.combined_bounds(scenes.pages, strokes, fills)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = count(scenes.pages, "pages")
    shown = scenes.tokens.where(F.col("mode").isin(text.VISIBLE_MODES))
    for part, name in ((scenes.strokes, "segments"), (scenes.fills, "fills"), (scenes.fill_segments, "fill_segments"), (shown, "texts")):
        out = out.join(count(part, name), "doc_id", "left")
    sums = scenes.counts.groupBy("doc_id").agg(*(F.sum(n).alias(n) for n in ("operator_count", "path_count", "image_paint_op_count")))
    out = out.join(sums, "doc_id", "left").join(box, "doc_id")
    filled = ["segments", "fills", "fill_segments", "texts", "operator_count", "path_count", "image_paint_op_count"]
    return out.select("doc_id", "pages", *(F.coalesce(n, F.lit(0)).alias(n) for n in filled), *own)


def first_page(ops: DataFrame, pages: DataFrame, **options) -> Scenes:
    """The first page alone, where it is."""
    return extract(ops, pages, max_pages=1, **options)
