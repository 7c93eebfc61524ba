"""Scene containers: ZIP files with ``manifest.json`` and one file for each float4 column.

``read_scenes`` turns containers into a table of columns; ``write_scenes`` writes them.
A container is one row of a binary scan, so reading is spread over containers by Spark's
own file listing; executors inflate only the entries that a query asks for.
"""

from __future__ import annotations

import io
import json
import zipfile
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.plans.session import ship
from inkfold.sources import codecs

FORMAT, VERSION = "parsed-scene", 3
CHANNELS = codecs.CHANNELS

#: The columns' names, older names they may have, and the count that sizes each.
COLUMNS = {
    "fill-path-meta-a": ([], "fillPathCount"), "fill-path-meta-b": ([], "fillPathCount"), "fill-path-meta-c": ([], "fillPathCount"),
    "fill-primitives-a": (["fill-segments"], "fillSegmentCount"), "fill-primitives-b": ([], "fillSegmentCount"),
    "stroke-primitives-a": (["endpoints"], "segmentCount"), "stroke-primitives-b": (["primitive-meta"], "segmentCount"), "stroke-styles": (["styles"], "segmentCount"),
    "stroke-primitive-bounds": (["primitive-bounds"], "segmentCount"),
    "text-instance-a": ([], "textInstanceCount"), "text-instance-b": ([], "textInstanceCount"), "text-instance-c": ([], "textInstanceCount"),
    "text-glyph-meta-a": ([], "textGlyphCount"), "text-glyph-meta-b": ([], "textGlyphCount"),
    "text-glyph-primitives-a": (["text-glyph-segments"], "textGlyphPrimitiveCount"), "text-glyph-primitives-b": ([], "textGlyphPrimitiveCount"),
}
#: Older names of counts, and where older containers keep a single raster layer.
OLD_COUNTS = {"textGlyphPrimitiveCount": "textGlyphSegmentCount"}
OLD_LAYERS = ("raster/layer-0.webp", "raster/layer-0.png", "raster/layer-0.rgba", "raster/layer.webp", "raster/layer.png", "raster/layer.rgba")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
SUFFIX = {"channel-major": ".f32cm", "byte-shuffle": ".f32bs", "none": ".f32"}
SOURCE_PATHS = ("source/source.pdf", "source.pdf")


def finite(x, fallback=None):
    """As JavaScript reads numbers: null and blank text are 0, other text must be a number."""
    try:
        v = 0.0 if x is None or (isinstance(x, str) and not x.strip()) else float(x)
    except (TypeError, ValueError):
        return fallback
    return v if np.isfinite(v) else fallback


def count(x) -> int:
    v = finite(x, 0.0)
    return max(0, int(v))


def page_rects(values, fallback) -> list[list[float]]:
    """Whole, finite quads; a trailing rest is dropped; the fallback if none is left."""
    values = values if isinstance(values, list) else []
    quads = [[finite(v) if isinstance(v, int | float) else None for v in values[i : i + 4]] for i in range(0, len(values) - len(values) % 4, 4)]
    good = [q for q in quads if None not in q]
    return good or ([list(fallback)] if fallback else [])


def _entry(archive: zipfile.ZipFile, names: set[str], listed: dict[str, dict], name: str):
    """The first of a column's names that has both a manifest entry and a file."""
    for candidate in (name, *COLUMNS[name][0]):
        spec = listed.get(candidate)
        if spec is None:
            continue
        suffix = SUFFIX.get("channel-major" if spec.get("layout") == "channel-major" else "byte-shuffle" if "shuffle" in str(spec.get("predictor", "")) else "none")
        file = spec.get("file") or f"textures/{candidate}{suffix}"
        if file in names:
            return spec, archive.read(file)
    return None


def read_columns(data: bytes, wanted=None) -> tuple[dict, dict[str, np.ndarray]]:
    """(manifest, columns) of a container: values cut to the manifest's counts; an entry too short is an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        if "manifest.json" not in names:
            raise ValueError("a container needs a manifest.json")
        manifest = json.loads(archive.read("manifest.json"))
        scene = manifest.get("scene") or {}
        listed = {t["name"]: t for t in manifest.get("textures") or [] if isinstance(t, dict) and "name" in t}
        out = {}
        for name, (_, sized) in COLUMNS.items():
            if wanted is not None and name not in wanted:
                continue
            if (found := _entry(archive, names, listed, name)) is None:
                continue
            spec, raw = found
            logical = spec.get("logicalFloatCount")
            values = codecs.decode(raw, spec.get("layout") or "interleaved", spec.get("predictor") or "none", spec.get("componentType") or "float32", None if logical is None else count(logical))
            told = scene.get(sized, scene.get(OLD_COUNTS.get(sized)))
            n = len(values) if told is None else 4 * count(told)
            if len(values) < n:
                raise ValueError(f"{name} has {len(values)} values, {n} are needed")
            out[name] = values[:n]
    return manifest, migrated(out)


def migrated(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Derives what older containers lack: ends of lines, boxes of primitives, packed opacity, colours of fills and texts."""
    cols = dict(cols)
    table = lambda name: cols[name].reshape(-1, 4).copy()
    unit = lambda x: np.clip(np.where(np.isfinite(x), x, 0), 0, 1)
    for a, b in (("stroke-primitives-a", "stroke-primitives-b"), ("fill-primitives-a", "fill-primitives-b"), ("text-glyph-primitives-a", "text-glyph-primitives-b")):
        if a in cols and b not in cols:
            p = cols[a].reshape(-1, 4)
            cols[b] = np.concatenate((p[:, 2:], np.zeros((len(p), 2), "<f4")), axis=1).ravel().astype("<f4")
    if "stroke-primitives-a" in cols and "stroke-primitive-bounds" not in cols:
        p, q = cols["stroke-primitives-a"].reshape(-1, 4), cols["stroke-primitives-b"].reshape(-1, 4)
        xs, ys = np.stack((p[:, 0], p[:, 2], q[:, 0])), np.stack((p[:, 1], p[:, 3], q[:, 1]))
        cols["stroke-primitive-bounds"] = np.stack((xs.min(0), ys.min(0), xs.max(0), ys.max(0)), axis=1).ravel().astype("<f4") if len(p) else np.zeros(0, "<f4")
    if "stroke-primitives-b" in cols and "stroke-styles" in cols and len(cols["stroke-styles"]):
        meta, style = cols["stroke-primitives-b"].reshape(-1, 4).copy(), cols["stroke-styles"].reshape(-1, 4).copy()
        if (np.abs(meta[:, 3]) <= 1e-6).all():  # styles were (half width, luma, alpha, flag)
            meta[:, 3] = unit(style[:, 2]) + 2 * (style[:, 3] >= 0.5)
            style[:, 1:] = unit(style[:, 1])[:, None]
            cols["stroke-primitives-b"], cols["stroke-styles"] = meta.ravel(), style.ravel()
    if "fill-path-meta-b" in cols and "fill-path-meta-c" in cols and len(cols["fill-path-meta-c"]):
        b, c = table("fill-path-meta-b"), table("fill-path-meta-c")
        if (np.abs(c[:, 3]) <= 1e-6).all():  # fills were (..., luma, alpha)
            luma, alpha = unit(b[:, 2]), unit(b[:, 3])
            b[:, 2] = b[:, 3] = c[:, 2] = luma
            c[:, 3] = alpha
            cols["fill-path-meta-b"], cols["fill-path-meta-c"] = b.ravel(), c.ravel()
    if "text-instance-b" in cols and "text-instance-c" not in cols:
        luma = unit(table("text-instance-b")[:, 3])
        cols["text-instance-c"] = np.stack((luma, luma, luma, np.ones_like(luma)), axis=1).ravel().astype("<f4")
    return cols


def box(x) -> dict | None:
    """A manifest's box, if all of its sides are finite numbers."""
    sides = {k: finite(x.get(k)) if isinstance(x, dict) and k in x else None for k in ("minX", "minY", "maxX", "maxY")}
    return sides if None not in sides.values() else None


def scene_meta(manifest: dict, cols: dict[str, np.ndarray]) -> dict:
    """Bounds, page boxes, counts and the largest half width; what the manifest lacks follows from the columns.

    A half width of 0 in the manifest counts as lacking.
    """
    scene = manifest.get("scene") or {}
    parts = []
    if len(cols.get("stroke-primitive-bounds", ())):
        q = cols["stroke-primitive-bounds"].reshape(-1, 4)
        parts.append((q[:, 0].min(), q[:, 1].min(), q[:, 2].max(), q[:, 3].max()))
    if len(cols.get("fill-path-meta-a", ())) and len(cols.get("fill-path-meta-b", ())):
        q, r = cols["fill-path-meta-a"].reshape(-1, 4), cols["fill-path-meta-b"].reshape(-1, 4)
        parts.append((q[:, 2].min(), q[:, 3].min(), r[:, 0].max(), r[:, 1].max()))
    low, high = (lambda i: float(min(p[i] for p in parts))), (lambda i: float(max(p[i] for p in parts)))
    drawn = {"minX": low(0), "minY": low(1), "maxX": high(2), "maxY": high(3)} if parts else {"minX": 0.0, "minY": 0.0, "maxX": 1.0, "maxY": 1.0}
    bounds = box(scene.get("bounds")) or drawn
    page = box(scene.get("pageBounds")) or bounds
    styles = cols.get("stroke-styles", np.zeros(0, "<f4"))
    widest = max(0.0, float(styles.reshape(-1, 4)[:, 0].max())) if len(styles) else 0.0
    n = lambda k, other=0: count(scene[k]) if finite(scene.get(k, "none")) is not None else other
    items = {sized: len(cols[name]) // 4 for name, (_, sized) in reversed(COLUMNS.items()) if name in cols}
    strokes = n("segmentCount", items.get("segmentCount", 0))
    texts = n("textInstanceCount", items.get("textInstanceCount", 0))
    source_texts, in_page = n("sourceTextCount", texts), n("textInPageCount", texts)
    return {
        "bounds": bounds, "pageBounds": page, "pageRects": page_rects(scene.get("pageRects"), tuple(page.values())), "pageCount": max(1, n("pageCount", 1)), "pagesPerRow": max(1, n("pagesPerRow", 1)),
        "maxHalfWidth": (finite(scene["maxHalfWidth"], 0.0) if "maxHalfWidth" in scene else 0.0) or widest, "segmentCount": strokes, "sourceSegmentCount": n("sourceSegmentCount", strokes),
        "mergedSegmentCount": n("mergedSegmentCount", strokes), "sourceTextCount": source_texts, "textInPageCount": in_page, "textOutOfPageCount": n("textOutOfPageCount", max(0, source_texts - in_page)),
        **{k: n(k) for k in ("operatorCount", "pathCount", "imagePaintOpCount", "discardedTransparentCount", "discardedDegenerateCount", "discardedDuplicateCount", "discardedContainedCount")},
    }


def build(
    columns: dict[str, np.ndarray], scene: dict, *, layout: str = "channel-major", predictor: str = "none", level: int = 9, source: bytes | None = None, layers=(), label: str = "", generated_at: str | None = None
) -> bytes:
    """A container of these columns; the source document goes in only if it has images and no layers are given.

    What ``scene`` doesn't tell (bounds, page boxes, counts, the largest half width) is worked out from the columns.
    """
    out = io.BytesIO()
    textures, given = [], {k: np.asarray(v, "<f4") for k, v in columns.items()}
    with zipfile.ZipFile(out, "w") as archive:

        def put(name, data, deflate=True):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            archive.writestr(info, data, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED, level if deflate else None)

        shuffled = layout != "channel-major" and predictor != "none"
        for name, (_, sized) in COLUMNS.items():
            if name not in given:
                continue
            n = 4 * count(scene.get(sized, len(given[name]) // 4))
            if len(given[name]) < n:
                raise ValueError(f"{name} has {len(given[name])} values, {n} are needed")
            given[name] = given[name][:n]
            file = f"textures/{name}{SUFFIX['channel-major' if layout == 'channel-major' else 'byte-shuffle' if shuffled else 'none']}"
            put(file, codecs.encode(given[name], layout, predictor))
            side = max(1, int(np.ceil(np.sqrt(n // 4))))
            textures.append({
                "name": name, "file": file, "width": side, "height": max(1, -(-(n // 4) // side)), "channels": CHANNELS, "componentType": "float32", "layout": layout, "byteShuffle": shuffled,
                "predictor": predictor if shuffled else "none", "logicalItemCount": n // 4, "logicalFloatCount": n, "paddedFloatCount": n,
            })
        listed = []
        for i, layer in enumerate(layers):
            kind = layer.get("encoding", "rgba")
            put(f"raster/layer-{i}.{kind}", layer["data"], deflate=False)
            listed.append({"width": layer["width"], "height": layer["height"], "matrix": list(layer["matrix"]), "file": f"raster/layer-{i}.{kind}", "encoding": kind})
        embedded = source if source and scene.get("imagePaintOpCount", 0) > 0 and not listed else None
        if embedded:
            put(SOURCE_PATHS[0], embedded)
        told = scene_meta({"scene": scene}, given)
        told["pageRects"] = [x for quad in told["pageRects"] for x in quad]
        first = listed[0] if listed else {"width": 0, "height": 0}
        single = {"rasterLayerWidth": first["width"], "rasterLayerHeight": first["height"]} | ({"rasterLayerMatrix": first["matrix"], "rasterLayerFile": first["file"]} if listed else {})
        sized = {k: len(given[name]) // 4 for name, (_, k) in COLUMNS.items() if name in given}
        manifest = {
            "format": FORMAT, "formatVersion": VERSION, "sourceFile": label, "sourcePdfSizeBytes": len(embedded or b""),
            "generatedAt": generated_at or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "scene": sized | scene | told | {"rasterLayers": listed} | single, "textures": textures,
        } | ({"sourcePdfFile": SOURCE_PATHS[0]} if embedded else {})
        put("manifest.json", json.dumps(manifest, indent=2))
    return out.getvalue()


def matrix(values) -> list[float]:
    """Six finite numbers, else the identity."""
    good = [finite(x) if isinstance(x, int | float) else None for x in values] if isinstance(values, list | tuple) else []
    return good[:6] if len(good) >= 6 and None not in good[:6] else list(IDENTITY)


def raster_layers(data: bytes) -> list[dict]:
    """Layers of the list, else the single layer of older manifests: width, height, matrix, encoding, data.

    Raw pixels are cut to their size, and too few are an error; encoded images come as they are stored.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names, scene = set(archive.namelist()), json.loads(archive.read("manifest.json")).get("scene") or {}

        def read(spec: dict, file: str) -> dict | None:
            w, h, kind = count(spec.get("width")), count(spec.get("height")), file.rpartition(".")[2].lower()
            if file not in names:
                return None
            px = archive.read(file)
            if kind not in ("png", "webp", "jpg", "jpeg"):
                if not w or not h:
                    return None
                if len(px) < w * h * 4:
                    raise ValueError(f"{file} has {len(px)} bytes, {w * h * 4} are needed")
                px, kind = px[: w * h * 4], "rgba"
            return {"width": w, "height": h, "matrix": matrix(spec.get("matrix")), "encoding": kind, "data": px}

        specs = scene.get("rasterLayers") if isinstance(scene.get("rasterLayers"), list) else []
        found = [read(s, s["file"] if isinstance(s.get("file"), str) else f"raster/layer-{i}.rgba") for i, s in enumerate(specs) if isinstance(s, dict)]
        if not any(found):
            old = {"width": scene.get("rasterLayerWidth"), "height": scene.get("rasterLayerHeight"), "matrix": scene.get("rasterLayerMatrix")}
            named = scene.get("rasterLayerFile")
            found = [read(old, named if isinstance(named, str) else next((f for f in OLD_LAYERS if f in names), OLD_LAYERS[-1]))]
        return [f for f in found if f]


def source_document(data: bytes) -> bytes | None:
    """The embedded source: the manifest's path first, then the usual ones; the first that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names, manifest = set(archive.namelist()), json.loads(archive.read("manifest.json"))
        for path in (manifest.get("sourcePdfFile"), *SOURCE_PATHS):
            if path in names and (found := archive.read(path)):
                return found
    return None


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta): ``scene_meta`` of each container as a JSON text, for ``from_json`` with any schema."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            texts = [json.dumps(scene_meta(*read_columns(d))) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "meta"])

    return files.mapInArrow(run, "path string, meta string")


COLUMN_SCHEMA = "path string, name string, n_items long, values array<float>"


def read_scenes(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """(path, name, n_items, values): one row for each column of each container below ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    chosen = None if wanted is None else set(wanted)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols = read_columns(data, chosen)[1]
                keys = list(cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([len(cols[k]) // 4 for k in keys], pa.int64()), pa.array([cols[k] for k in keys], pa.list_(pa.float32()))],
                    ["path", "name", "n_items", "values"],
                )

    return files.mapInArrow(run, COLUMN_SCHEMA)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, manifest): the manifests' JSON texts, for ``from_json`` with any schema."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            texts = [zipfile.ZipFile(io.BytesIO(d)).read("manifest.json").decode() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "manifest"])

    return files.mapInArrow(run, "path string, manifest string")


def to_containers(columns: DataFrame, by: str = "doc_id", layout: str = "channel-major") -> DataFrame:
    """(by, container): packs rows (by, name, values) into one container a scene."""
    ship(columns.sparkSession)

    def run(key, table):
        cols = {r["name"]: np.asarray(r["values"], "<f4") for r in table.to_pylist()}
        scene = {sized: len(cols[name]) // 4 for name, (_, sized) in COLUMNS.items() if name in cols}
        return pa.table({by: pa.array([key[0].as_py()], pa.int64()), "container": pa.array([build(cols, scene, layout=layout)], pa.binary())})

    return columns.select(F.col(by).cast("long").alias(by), "name", "values").groupBy(by).applyInArrow(run, f"{by} long, container binary")


def strokes_of(columns: DataFrame) -> DataFrame:
    """Stroke rows of containers: (path, seg_id, x0 ... flags), columns put side by side by position."""
    c = F.col
    one = columns.where(c("name").isin("stroke-primitives-a", "stroke-primitives-b", "stroke-styles")).groupBy("path").pivot("name", ["stroke-primitives-a", "stroke-primitives-b", "stroke-styles"]).agg(F.first("values"))
    one = one.toDF("path", "pa", "pb", "ps").withColumn("seg_id", F.explode(F.sequence(F.lit(0), (F.size("pa") / 4).cast("int") - 1))).where(F.size("pa") > 0)
    get = lambda a, k: F.get(c(a), c("seg_id") * 4 + k).cast("double")
    meta = get("pb", 3)
    flags = F.greatest(F.lit(0), F.floor(meta / 2 + 1e-6)).cast("int")
    names = ["x0", "y0", "cx", "cy"]
    return one.select(
        "path", c("seg_id").cast("long").alias("seg_id"), *(get("pa", i).alias(n) for i, n in enumerate(names)), get("pb", 0).alias("x1"), get("pb", 1).alias("y1"),
        get("pb", 2).cast("int").alias("prim_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), meta - flags * 2)).alias("alpha"), flags.alias("flags"),
        get("ps", 0).alias("half_width"), *(get("ps", i + 1).alias(n) for i, n in enumerate("rgb")),
    )
