"""Raster layers: scale choice, placement, validity, alpha, mip levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.scalar import invert, mat, multiply, transformed_box
from inkfold.operators import interp
from inkfold.operators.layout import union_bounds
from inkfold.plans.session import ship

#: Fixed values.
PER_DPR, MOST_SCALE, MOST_SIDE, MOST_PIXELS = 3.0, 24.0, 16384, 134217728
SHRINK, ALMOST_ONE = 0.85, 1.05
STEPS = 64


def extraction_scale(width: Column, height: Column, dpr: Column, hint: Column) -> Column:
    """The largest scale of the ladder target * 0.85^k at which the page's image fits."""
    target = F.least(F.lit(MOST_SCALE), F.greatest(F.lit(1.0), F.greatest(dpr * PER_DPR, hint)))
    sized = lambda v, s: F.ceil(F.greatest(F.lit(1.0), v * s))
    ladder = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: target * F.pow(F.lit(SHRINK), k))
    fits = lambda s: (sized(width, s) <= MOST_SIDE) & (sized(height, s) <= MOST_SIDE) & (sized(width, s) * sized(height, s) <= MOST_PIXELS)
    best = F.coalesce(F.element_at(F.filter(ladder, fits), 1), F.lit(1.0))
    return F.when(best < ALMOST_ONE, 1.0).otherwise(best)


def _hint_rows(ops: list[dict]) -> list[dict]:
    """The largest ratio of an image's pixels to its size on the page, at least 1; forms are not followed."""
    s, best = interp.Stack(ctm=interp.IDENTITY), 1.0
    for op in ops:
        args = op["args"] or []
        if op["fn"] in ("save", "restore", "transform"):
            s.apply(op["fn"], args)
        elif op["fn"] in interp.IMAGES:
            w, h = interp.number(args, 0), interp.number(args, 1)
            m = s.now["ctm"]
            for pixels, side in ((w, (m[0] ** 2 + m[1] ** 2) ** 0.5), (h, (m[2] ** 2 + m[3] ** 2) ** 0.5)):
                if pixels and pixels > 0 and side > 1e-9:
                    best = max(best, pixels / side)
    return [{"hint": best}]


def scale_hints(ops: DataFrame) -> DataFrame:
    """(doc_id, page_no, hint)."""
    schema = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("hint", pa.float64())])
    return interp._by_page(ops, ["save", "restore", "transform", *interp.IMAGES], _hint_rows, "doc_id long, page_no int, hint double", schema)


def layer_matrix(page: Column, viewport: Column, width: Column, height: Column) -> Column:
    """Unit square to world: page x inverse(viewport) x diag(width, height)."""
    zero = F.lit(0.0)
    return multiply(multiply(page, invert(viewport)), mat(width, zero, zero, height, zero, zero))


def valid_layers(layers: DataFrame) -> DataFrame:
    """Layers with a size and enough bytes for it."""
    return layers.where((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("data") >= F.col("width").cast("long") * F.col("height") * 4))


def only_bounds(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """The box of a scene of images alone: the pages' boxes and the layers' unit squares under their matrices (structs a ... f)."""
    corner = lambda v: F.lit(float(v))
    placed = layers.select("doc_id", transformed_box(F.col("matrix"), corner(0), corner(0), corner(1), corner(1)).alias("b")).select("doc_id", "b.*")
    return union_bounds(pages, placed)


def summary(layers: DataFrame, by: list[str]) -> DataFrame:
    return layers.groupBy(*by).agg(F.count(F.lit(1)).alias("layers"), (F.sum(F.col("width").cast("double") * F.col("height")) / 1e6).alias("megapixels"))


def premultiplied(c: Column, alpha: Column) -> Column:
    """A colour byte times its alpha byte, halves up."""
    return F.floor(c * alpha / 255 + 0.5).cast("int")


def _on_bytes(layers: DataFrame, make, name: str, kind: str, arrow) -> DataFrame:
    ship(layers.sparkSession)
    keep = [c for c in layers.columns if c != "data"]
    schema = ", ".join(f"`{c}` {layers.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([make(r) for r in rows], arrow)], [*keep, name])

    return layers.select(*keep, "data").mapInArrow(run, f"{schema}, {name} {kind}")


def premultiply(layers: DataFrame) -> DataFrame:
    """RGBA bytes with colours multiplied by alpha."""

    def make(r):
        px = np.frombuffer(r["data"], np.uint8).reshape(-1, 4).astype(np.uint32)
        a = px[:, 3:]
        px[:, :3] = (px[:, :3] * a * 2 + 255) // 510
        return px.astype(np.uint8).tobytes()

    return _on_bytes(layers, make, "data", "binary", pa.binary())


def has_visible_alpha(layers: DataFrame) -> DataFrame:
    return _on_bytes(layers, lambda r: bool(np.frombuffer(r["data"], np.uint8)[3::4].any()), "visible", "boolean", pa.bool_())


def mip_chain(rgba: bytes, width: int, height: int) -> list[tuple[int, int, bytes]]:
    """All levels down to 1 x 1: means of 2 x 2, halves up, the last row or column repeated."""
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.uint32)
    out = [(width, height, rgba)]
    while px.shape[0] > 1 or px.shape[1] > 1:
        h, w = max(1, px.shape[0] // 2), max(1, px.shape[1] // 2)
        y0, x0 = np.arange(h) * 2, np.arange(w) * 2
        y1, x1 = np.minimum(y0 + 1, px.shape[0] - 1), np.minimum(x0 + 1, px.shape[1] - 1)
        px = (px[y0][:, x0] + px[y0][:, x1] + px[y1][:, x0] + px[y1][:, x1] + 2) >> 2
        out.append((w, h, px.astype(np.uint8).tobytes()))
    return out


def mips(layers: DataFrame) -> DataFrame:
    levels = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))
    make = lambda r: [{"width": w, "height": h, "data": d} for w, h, d in mip_chain(r["data"], r["width"], r["height"])]
    return _on_bytes(layers, make, "levels", "array<struct<width: int, height: int, data: binary>>", levels)


def mip_table(pixels: DataFrame, value: str = "v") -> DataFrame:
    """The next level of a pixel table (x, y, v) of even sides."""
    half = pixels.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
    return half.agg(F.floor((F.sum(value) + 2) / 4).cast("long").alias(value))


def smaller_encoding(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Of encodings (kind, n_bytes) the smallest; png wins a tie."""
    order = F.struct("n_bytes", F.when(F.col("kind") == "png", 0).otherwise(1).alias("o"))
    return sizes.groupBy(*by).agg(F.min_by("kind", order).alias("kind"), F.min("n_bytes").alias("n_bytes"))
