"""Hand-computed cases of the drawing operators."""

import io
import json
import math
import os
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.functions import scalar
from inkfold.operators import atlas, catalog, coverage, cull, grid, interp, layout, merge, paths, raster, text
from inkfold.plans import session
from inkfold.sources import codecs, container, files
from inkfold.streaming import camera

ID = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def stroke(i, x0, y0, x1, y1, hw=1.0, alpha=1.0, flags=0):
    return (0, 1, i, x0, y0, x1, y1, x1, y1, 0, hw, 0.0, 0.0, 0.0, alpha, flags)


STROKE = "doc_id long, page_no int, seg_id long, x0 double, y0 double, cx double, cy double, x1 double, y1 double, prim_type int, half_width double, r double, g double, b double, alpha double, flags int"


def reasons(spark, *rows):
    return {r["seg_id"]: r["reason"] for r in cull.cull(spark.createDataFrame(list(rows), STROKE)).collect()}


def test_cull(spark):
    assert reasons(spark, stroke(0, 0.0, 0.0, 10.0, 0.0), stroke(1, 10.0, 0.0, 0.0, 0.0)) == {0: None, 1: "duplicate"}
    assert reasons(spark, stroke(0, 0.0, 0.0, 10.0, 0.0), stroke(1, 2.0, 0.0, 5.0, 0.0)) == {0: None, 1: "contained"}
    assert reasons(spark, stroke(0, 0.0, 0.0, 10.0, 0.0, alpha=0.5), stroke(1, 2.0, 0.0, 5.0, 0.0)) == {0: None, 1: None}
    assert reasons(spark, stroke(0, 0.0, 0.0, 10.0, 0.0), stroke(1, 2.0, 0.0, 5.0, 0.0, hw=2.0)) == {0: None, 1: None}
    assert reasons(spark, stroke(0, 0.0, 0.0, 10.0, 0.0), stroke(1, -0.04, 0.0, 5.0, 0.0)) == {0: None, 1: "contained"}
    assert reasons(spark, stroke(0, 5.0, 5.0, 5.0, 5.0), stroke(1, 5.0, 5.0, 5.0, 5.0, flags=2), stroke(2, 0.0, 0.0, 1.0, 1.0, alpha=0.0009)) == {0: "degenerate", 1: None, 2: "transparent"}


def test_flattening():
    path = [0, 0, 0, 1, 1, 0, 1, 2, 0, 1, 2, 1]
    assert paths.stroke_segments(path, ID) == (3, [(0, 0, 2, 0, 2, 0, 0), (2, 0, 2, 1, 2, 1, 0)])
    assert len(paths.stroke_segments(path, ID, merge=False)[1]) == 3
    assert paths.stroke_segments([0, 5, 5, 1, 5, 5], ID) == (0, [])
    assert paths.stroke_segments([0, 5, 5, 1, 5, 5], ID, flags=2) == (1, [(5, 5, 5, 5, 5, 5, 0)])
    assert list(paths.quadratics((0, 0), (1, 0), (2, 0), (3, 0), 0.08, 9)) == [((1.5, 0.0), (3, 0))]
    square = [0, 0, 0, 1, 1, 0, 1, 1, 1, 1, 0, 1]
    assert len(paths.outline(square, ID, closes=True, error=0.08, depth=9)) == 4
    assert len(paths.outline(square, ID, closes=False, error=0.08, depth=9)) == 3
    assert paths.stroke_segments([*square, 4], ID)[0] == 4


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=4, max_size=4))
def test_quadratics_end_where_the_cubic_ends(points):
    out = list(paths.quadratics(*points, 0.08, 9))
    assert out[-1][1] == points[3] and len(out) <= 512


def test_interpreter():
    ops = [
        {"fn": "restore", "args": []}, {"fn": "save", "args": []}, {"fn": "transform", "args": [2, 0, 0, 2, 5, 0]}, {"fn": "setLineWidth", "args": [3]}, {"fn": "setLineCap", "args": [1]},
        {"fn": "setStrokeCMYKColor", "args": [0, 1, 1, 0]}, {"fn": "constructPath", "args": [], "paint": "eoFillStroke", "path": [0, 0, 0, 1, 1, 0]},
        {"fn": "restore", "args": []}, {"fn": "constructPath", "args": [], "paint": "stroke", "path": [0, 0, 0, 1, 1, 0]}, {"fn": "constructPath", "args": [], "paint": "endPath", "path": [0, 0, 0]},
    ]
    rows = interp.path_rows([{"op_seq": i, "gstate": None, "paint": None, "path": None, **o} for i, o in enumerate(ops)])
    assert [r["paint"] for r in rows] == ["eoFillStroke", "stroke"]
    assert rows[0]["half_width"] == 3.0 and rows[0]["flags"] == 2 and rows[0]["stroke_rgb"] == [1, 0, 0] and rows[0]["rule"] == 1
    assert rows[1]["half_width"] == 0.5 and rows[1]["ctm"] == list(ID)


def test_text_advance():
    glyph = {"adjust": None, "font_char": "A", "unicode": "A", "width": 500.0, "is_space": False}
    ops = [{"fn": "beginText", "args": []}, {"fn": "setFont", "args": [10], "paint": "f"}, {"fn": "setCharSpacing", "args": [1]}, {"fn": "showText", "args": [], "text": [glyph, glyph]}]
    rows = interp.text_rows([{"op_seq": i, "gstate": None, "paint": None, "path": None, "text": None, **o} for i, o in enumerate(ops)])
    assert [r["matrix"][4] for r in rows] == [0.0, 6.0]
    assert interp.meet((0, 0, 1, 1), (2, 2, 3, 3)) is None and interp.meet(None, (0, 0, 1, 1)) == (0, 0, 1, 1)


def test_interpreter_tables(spark):
    glyph = {"adjust": None, "font_char": "A", "unicode": "A", "width": 500.0, "is_space": False}
    rows = [
        (1, 1, 0, "setFont", "f", [10.0], None, None, None), (1, 1, 1, "showText", None, [], None, None, [glyph]), (1, 1, 2, "constructPath", "fill", [], [0.0, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 4.0, 4.0], None, None),
        (1, 1, 3, "setGState", None, [], None, [{"key": "CA", "value": "0.5"}], None), (1, 1, 4, "constructPath", "stroke", [], [0.0, 0.0, 0.0, 2.0, 0.0, 9.0, 9.0, 9.0, 9.0, 0.0], None, None),
        (1, 1, 5, "paintImageXObject", None, [100.0, 50.0], None, None, None),
    ]
    ops = spark.createDataFrame(rows, files.OPERATORS)
    painted = interp.painted_paths(ops)
    assert {r["paint"]: r["stroke_alpha"] for r in painted.collect()} == {"fill": 1.0, "stroke": 0.5}
    assert paths.strokes(painted).agg(F.sum("source"), F.count("*")).first() == paths.strokes(painted, merge=False).agg(F.sum("source"), F.count("*")).first()
    fill = paths.fill_paths(paths.fill_segments(painted)).first()
    assert (fill["seg_count"], fill["min_x"], fill["max_y"], fill["has_stroke"]) == (3, 0.0, 4.0, False)
    tokens = interp.shown_tokens(ops)
    box = spark.createDataFrame([("f", "A", 0, 0.0, 0.0, 0.5, 0.7)], "font string, font_char string, glyph_id long, min_x double, min_y double, max_x double, max_y double")
    placed = text.instances(tokens, box).first()
    assert (round(placed["max_x"], 6), round(placed["max_y"], 6)) == (5.0, 7.0)
    assert interp.page_flags(ops).first().asDict() == {"doc_id": 1, "page_no": 1, "has_text": True, "has_images": True, "has_forms": False}
    assert raster.scale_hints(ops).first()["hint"] == 100.0


def test_layout(spark):
    pages = spark.createDataFrame([(0, i, 0.0, 0.0, 100.0, 200.0) for i in (1, 2, 3)] + [(1, 1, 5.0, 5.0, 50.0, 50.0)], "doc_id long, page_no int, min_x double, min_y double, max_x double, max_y double")
    got = {(r["doc_id"], r["page_no"]): (r["tx"], r["ty"]) for r in layout.layout(pages, 2).collect()}
    assert got == {(0, 1): (0.0, -200.0), (0, 2): (124.0, -200.0), (0, 3): (0.0, -424.0), (1, 1): (0.0, 0.0)}


def test_scalars(spark):
    lit = F.lit
    assert one(spark, grid.grid_side(lit(10), lit(1.0), lit(1.0))) == (173, 173) and one(spark, grid.grid_side(lit(10), lit(100.0), lit(1.0))) == (1024, 64)
    packed = scalar.pack_meta(lit(0.5), lit(3.0))
    assert (one(spark, packed), one(spark, scalar.unpack_alpha(packed)), one(spark, scalar.unpack_flags(packed))) == (6.5, 0.5, 3)
    assert one(spark, scalar.quantize(lit(-2.5), 1)) == -2
    assert one(spark, scalar.cmyk(lit(0.0), lit(1.0), lit(1.0), lit(0.0))) == (1, 0, 0) and one(spark, scalar.cmyk(lit(50.0), lit(0.0), lit(0.0), lit(0.0))) == (0.5, 1, 1)
    assert one(spark, scalar.hex_color(lit("#f00"))) == (1, 0, 0) and one(spark, scalar.hex_color(lit("red"))) is None
    fit = one(spark, grid.fit(lit(0.0), lit(0.0), lit(100.0), lit(50.0), lit(1128.0), lit(628.0)))
    assert (fit["zoom"], fit["cx"], fit["cy"]) == (10, 50, 25)
    assert one(spark, scalar.texture_dims(lit(10), 4096)) == (4, 3) and [one(spark, scalar.power_of_two(lit(v))) for v in (1, 2, 3, 4, 5)] == [1, 2, 4, 4, 8]
    scale = lambda w, h: round(one(spark, raster.extraction_scale(lit(w), lit(h), lit(1.0), lit(1.0))), 2)
    assert (scale(612.0, 792.0), scale(6000.0, 100.0)) == (3, 2.55)
    assert (one(spark, scalar.comparable_stem(lit("LK Office Level 1"))), one(spark, scalar.id_stem(lit("LK Office Level 1")))) == ("lkofficelevel1", "lk_office_level_1")
    assert one(spark, scalar.download_name(lit(" my plan.PDF"))) == "my_plan" and one(spark, scalar.auto_pages_per_row(lit(10))) == 4
    m = scalar.mat(2, 0, 0, 4, 6, 8)
    assert one(spark, scalar.multiply(m, scalar.invert(m))) == (1, 0, 0, 1, 0, 0) and one(spark, scalar.invert(scalar.mat(0, 0, 0, 0, 1, 1))) is None
    assert one(spark, scalar.matrix_scale(m)) == 3 and one(spark, scalar.rotation(lit(-90.0))) == 270
    assert one(spark, scalar.intersect(F.expr("named_struct('min_x',0D,'min_y',0D,'max_x',1D,'max_y',1D)"), F.expr("named_struct('min_x',2D,'min_y',2D,'max_x',3D,'max_y',3D)"))) is None


def test_coverage(spark):
    edges = [(0, i, *a, *b, *b, 0) for i, (a, b) in enumerate([((0.0, 0.0), (1.0, 0.0)), ((1.0, 0.0), (1.0, 1.0)), ((1.0, 1.0), (0.0, 1.0)), ((0.0, 1.0), (0.0, 0.0))])]
    segments = spark.createDataFrame(edges, "fill_id long, pos int, x0 double, y0 double, cx double, cy double, x1 double, y1 double, prim_type int")
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5)], "point_id long, px double, py double")
    assert [(r["point_id"], r["winding"], r["crossings"], r["distance"]) for r in coverage.point_winding(points, segments).collect()] == [(0, 1, 1, 0.5)]
    c = lambda *v: tuple(map(F.lit, v))
    d = one(spark, coverage.quadratic_distance(*c(1.0, 3.0, 0.0, 0.0, 1.0, 2.0, 2.0, 0.0)))
    curve = [(2 * t * (1 - t) + 2 * t * t, 4 * t * (1 - t)) for t in np.linspace(0, 1, 20001)]
    assert d == pytest.approx(min(math.hypot(x - 1, y - 3) for x, y in curve), abs=1e-6)


def test_raster_bytes(spark):
    layer = spark.createDataFrame([(1, 1, bytes([200, 100, 50, 128]))], "width int, height int, data binary")
    assert list(raster.premultiply(layer).first()["data"]) == [100, 50, 25, 128]
    assert raster.has_visible_alpha(layer).first()["visible"]
    assert raster.mip_chain(bytes(b for v in (0, 1, 2, 3) for b in (v,) * 4), 2, 2)[1] == (1, 1, bytes([2] * 4))


def test_codecs():
    assert codecs.to_xor_delta([1.0, 1.0]) == bytes.fromhex("0000000080003f00")
    rng = np.random.default_rng(0)
    v = rng.normal(size=64).astype("<f4")
    for layout_, predictor in (("interleaved", "none"), ("channel-major", "none"), ("interleaved", "byte-shuffle"), ("interleaved", "xor-delta-byte-shuffle")):
        assert (codecs.decode(codecs.encode(v, layout_, predictor), layout_, predictor) == v).all()
    for bad in (lambda: codecs.to_channel_major([1.0]), lambda: codecs.decode(b"abc"), lambda: codecs.decode(b"", count=4)):
        with pytest.raises(ValueError):
            bad()


def test_container(spark, tmp_path):
    cols = {"stroke-primitives-a": [0, 0, 3, 4, 1, 1, 2, 2], "stroke-styles": [1, 0, 0, 0, 2, 0.5, 0.5, 0.5], "stroke-primitives-b": [3, 4, 0, 1, 2, 2, 0, 2.5]}
    layer = {"width": 1, "height": 1, "matrix": [1, 0, 0, 1, 0, 0], "data": b"abcd"}
    data = container.build(cols, {"segmentCount": 2, "imagePaintOpCount": 1}, source=b"%PDF", layers=[layer])
    (tmp_path / "s.zip").write_bytes(data)
    rows = container.strokes_of(container.read_scenes(spark, f"file://{tmp_path}")).orderBy("seg_id").collect()
    assert [(r["x1"], r["alpha"], r["flags"], r["half_width"]) for r in rows] == [(3, 1, 0, 1), (2, 0.5, 1, 2)]
    assert container.raster_layers(data)[0]["data"] == b"abcd" and container.source_document(data) is None
    assert container.source_document(container.build({}, {"imagePaintOpCount": 1}, source=b"%PDF")) == b"%PDF"
    assert container.read_columns(data)[1]["stroke-primitive-bounds"].tolist()[:4] == [0, 0, 3, 4]
    assert '"formatVersion": 3' in container.read_manifests(spark, f"file://{tmp_path}").first()["manifest"]
    with pytest.raises(ValueError):
        container.build(cols, {"segmentCount": 3})


def test_container_of_another_age():
    """Hand-made archives: older names, luma instead of colours, a single layer, bounds left out."""
    old = io.BytesIO()
    with zipfile.ZipFile(old, "w") as z:
        parts = {"endpoints": [0, 0, 3, 4], "styles": [2, 0.25, 0.5, 1], "fill-path-meta-a": [0, 1, -5, -6], "fill-path-meta-b": [7, 8, 0.5, 0.75], "fill-path-meta-c": [0, 0, 0, 0], "text-instance-a": [0] * 4, "text-instance-b": [1, 2, 3, 0.125]}
        for name, values in parts.items():
            z.writestr(f"textures/{name}.f32", np.array(values, "<f4").tobytes())
        scene = {"segmentCount": 1, "maxHalfWidth": 0, "pageBounds": {"minX": 0, "minY": 0, "maxX": 9, "maxY": None}, "pageRects": [0, 0, 1, 1, 5], "rasterLayerWidth": 1, "rasterLayerHeight": 1, "rasterLayerMatrix": [2, 0, 0, 2, 0]}
        z.writestr("manifest.json", json.dumps({"formatVersion": 1, "sourcePdfFile": "own/doc.pdf", "scene": scene, "textures": [{"name": n} for n in parts]}))
        z.writestr("raster/layer.rgba", b"abcdef")
        z.writestr("own/doc.pdf", b"%PDF own")
        z.writestr("source.pdf", b"%PDF other")
    data = old.getvalue()
    manifest, cols = container.read_columns(data)
    assert cols["stroke-primitives-b"].tolist() == [3, 4, 0, 2.5] and cols["stroke-styles"].tolist() == [2, 0.25, 0.25, 0.25] and cols["stroke-primitive-bounds"].tolist() == [0, 0, 3, 4]
    assert cols["fill-path-meta-b"].tolist() == [7, 8, 0.5, 0.5] and cols["fill-path-meta-c"].tolist() == [0, 0, 0.5, 0.75] and cols["text-instance-c"].tolist() == [0.125, 0.125, 0.125, 1]
    meta = container.scene_meta(manifest, cols)
    assert meta["bounds"] == {"minX": -5, "minY": -6, "maxX": 7, "maxY": 8} and meta["pageBounds"] == {"minX": 0, "minY": 0, "maxX": 9, "maxY": 0} and meta["pageRects"] == [[0, 0, 1, 1]] and meta["maxHalfWidth"] == 2
    assert container.raster_layers(data) == [{"width": 1, "height": 1, "matrix": [1, 0, 0, 1, 0, 0], "encoding": "rgba", "data": b"abcd"}]
    assert container.source_document(data) == b"%PDF own"


def test_containers_tell_all(spark, tmp_path):
    """Every layout; the manifest tells bounds, page boxes, counts and the largest half width, and where the source is."""
    cols = {"stroke-primitives-a": [0, 0, 3, 4], "stroke-primitives-b": [3, 4, 0, 1], "stroke-styles": [1.5, 0, 0, 0], "stroke-primitive-bounds": [0, 0, 3, 4], "text-glyph-primitives-a": [1, 2, 3, 4]}
    for i, (layout, predictor) in enumerate([("channel-major", "none"), ("interleaved", "none"), ("interleaved", "byte-shuffle"), ("interleaved", "xor-delta-byte-shuffle")]):
        data = container.build(cols, {"imagePaintOpCount": 2, "pageRects": [0, 0, 8, 8]}, layout=layout, predictor=predictor, source=b"%PDF", label="a.pdf", generated_at="2020-01-01T00:00:00Z")
        manifest, back = container.read_columns(data)
        scene = manifest["scene"]
        assert all(back[k].tolist() == v for k, v in cols.items()) and manifest["sourcePdfFile"] == "source/source.pdf" and manifest["sourcePdfSizeBytes"] == 4 and manifest["generatedAt"] == "2020-01-01T00:00:00Z"
        assert scene["bounds"] == {"minX": 0, "minY": 0, "maxX": 3, "maxY": 4} and scene["pageRects"] == [0, 0, 8, 8] and (scene["maxHalfWidth"], scene["segmentCount"], scene["textGlyphPrimitiveCount"], scene["pagesPerRow"]) == (1.5, 1, 1, 1)
        assert container.source_document(data) == b"%PDF" and {t["predictor"] for t in manifest["textures"]} == {predictor}
        (tmp_path / f"{i}.zip").write_bytes(data)
    assert len({r["meta"] for r in container.read_meta(spark, f"file://{tmp_path}").collect()}) == 1
    image = {"width": 3, "height": 2, "matrix": [1, 0, 0, 1, 0, 0], "data": b"\x89PNG", "encoding": "png"}
    data = container.build({}, {"imagePaintOpCount": 2}, source=b"%PDF", layers=[image])
    assert container.raster_layers(data) == [image] and container.source_document(data) is None and container.read_columns(data)[0]["scene"]["rasterLayerFile"] == "raster/layer-0.png"


def test_catalog(spark, tmp_path):
    names = spark.createDataFrame([("Plan A.pdf",), ("plan a.pdf",), ("plan_a-2.pdf",)], "name string")
    ids = [r["uid"] for r in catalog.unique_ids(names.withColumn("o", F.col("name")), ["o"]).collect()]
    assert len(set(ids)) == 3
    left = spark.createDataFrame([(1, "Big House.pdf"), (2, "Other.pdf")], "id long, name string")
    right = spark.createDataFrame([(7, "big_house-parsed-data.zip"), (8, "none.zip")], "id long, name string")
    got = {(r["left_id"], r["right_id"]) for r in catalog.match(left, right).collect()}
    assert got == {(1, 7), (2, None), (None, 8)} and [r["id"] for r in catalog.unused(left, right).collect()] == [8]
    (tmp_path / "m.json").write_text('{"examples": [{"name": "A", "pdf": {"path": "a.pdf", "sizeBytes": 5.9}, "parsedZip": {"path": "a.zip"}}, {"name": " ", "pdf": {"path": "x"}}]}')
    c = files.read_catalog(spark, f"file://{tmp_path}/m.json")
    assert [(r["id"], r["pdf_size"], r["zip_size"]) for r in c.collect()] == [("example-1", 5, 0)]
    assert files.select_example(c, "example-1:zip").first()["path"] == "a.zip"
    (tmp_path / "b.PDF").write_bytes(b"x")
    (tmp_path / "A.pdf").write_bytes(b"yy")
    assert [(r["name"], r["size"]) for r in files.list_files(spark, f"file://{tmp_path}", "pdf").collect()] == [("A.pdf", 2), ("b.PDF", 1)]


def test_atlas():
    w, h, at = atlas.pack([(0, 24, 40), (1, 30, 20), (2, 16, 16)])
    boxes = [(*at[i], *s) for i, s in ((0, (24, 40)), (1, (30, 20)), (2, (16, 16)))]
    assert all(x + a <= w and y + b <= h for x, y, a, b in boxes)
    assert not any(p != q and p[0] < q[0] + q[2] and q[0] < p[0] + p[2] and p[1] < q[1] + q[3] and q[1] < p[1] + p[3] for p in boxes for q in boxes)
    assert atlas.pack([(0, 10000, 8)]) is None and atlas.pack([]) is None


def test_box_join(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(-20, 20, (n, 4)) * [1, 1, 0.2, 0.2] + [0, 0, 5, 5])]
    a, b = make(40), make(40)
    schema = "id long, min_x double, min_y double, max_x double, max_y double"
    got = sorted((r["a_id"], r["b_id"]) for r in grid.join_boxes(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4])


def test_index_agrees_with_boxes(spark):
    rng = np.random.default_rng(6)
    rows = [stroke(i, *map(float, rng.uniform(0, 100, 4)), hw=float(rng.uniform(0, 2))) for i in range(300)]
    s = spark.createDataFrame(rows, STROKE)
    counted = {(r["cell"]): r["n"] for r in grid.population(s).collect()}
    assert counted == {r["cell"]: r["count"] for r in grid.entries(s).groupBy("cell").count().collect()}
    last = grid.csr(s).orderBy(F.desc("cell")).first()
    assert last["offset"] + last["n"] == sum(counted.values())


def test_camera():
    e = lambda kind, t, x=0.0, y=0.0, d=0.0, p=1: {"session_id": 1, "event_seq": int(t), "t_ms": float(t), "kind": kind, "pointer_id": p, "x": x, "y": y, "delta_y": d}
    c = camera.Camera()
    for ev in (e("pointerdown", 0, 10.0, 10.0), e("pointermove", 1, 20.0, 10.0)):
        c.on(ev)
    assert (c.s["cx"], c.s["cy"]) == (-10.0, 0.0)
    c = camera.Camera()
    c.on(e("wheel", 0, 512.0, 384.0, -100.0))
    assert c.s["tz"] == pytest.approx(math.exp(0.13)) and c.s["zoom"] == 1.0
    c.on(e("frame", 0))
    before = c.s["zoom"]
    c.on(e("frame", 16))
    assert (c.s["zoom"] - before) / (c.s["tz"] - before) == pytest.approx(0.318869, abs=1e-6)
    c.on(e("pointerdown", 20, p=1, x=0.0))
    c.on(e("pointerdown", 21, p=2, x=100.0))
    c.on(e("pointermove", 22, p=2, x=200.0))
    assert c.s["tz"] == pytest.approx(min(8192, c.s["zoom"] * 2))


def test_stream_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(3)
    kinds = ["pointerdown", "pointermove", "pointermove", "pointerup", "wheel", "frame"]
    rows = [(i % 3, i, float(i * 10), kinds[int(rng.integers(6))], 1, "mouse", float(rng.integers(100)), float(rng.integers(100)), float(rng.integers(-50, 50))) for i in range(60)]
    schema = "session_id long, event_seq long, t_ms double, kind string, pointer_id int, pointer_type string, x double, y double, delta_y double"
    for part in range(2):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wanted = sorted(map(tuple, camera.replay(spark.createDataFrame(rows, schema)).collect()))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = camera.track(stream).writeStream.format("memory").queryName("cameras").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cameras").collect())) == wanted
    late = camera.track(stream, idle_ms=600_000).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp2")).start()
    for _ in range(100):  # such a stream is never done
        if spark.table("late").count() == 60:
            break
        time.sleep(0.5)
    late.stop()
    assert sorted(map(tuple, spark.table("late").collect())) == wanted


def test_kept_tables_and_their_release(spark):
    made = []
    make = lambda: made.append(1) or spark.range(5)
    first, again = session.kept(spark, "merge:1|cull:1", make), session.kept(spark, "merge:1|cull:1", make)
    assert first.count() == again.count() == 5 and made == [1]
    assert session.kept(spark, "merge:0|cull:1", make).count() == 5 and made == [1, 1]
    path = first.inputFiles()[0]
    assert session.release(spark) >= 2 and not os.path.exists(path.removeprefix("file://"))
    assert session.kept(spark, "merge:1|cull:1", make).count() == 5 and made == [1, 1, 1]


def test_raster_only_bounds_and_times(spark):
    pages = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 0.0, 0.0, 1.0, 1.0)], "doc_id long, min_x double, min_y double, max_x double, max_y double")
    layers = spark.createDataFrame([(1, (2.0, 0.0, 0.0, -3.0, 4.0, 1.0))], "doc_id long, matrix struct<a: double, b: double, c: double, d: double, e: double, f: double>")
    assert sorted(map(tuple, raster.only_bounds(pages, layers).collect())) == [(1, 0, -2, 6, 5), (2, 0, 0, 1, 1)]
    assert spark.range(1).select(scalar.iso_time(F.lit(0).cast("timestamp"))).first()[0] == "1970-01-01T00:00:00.000Z"


def test_long_groups_are_taken_in_parts(spark):
    """Hundreds of layers on a point, thousands of transforms of a page, and a line of many batches."""
    rng = np.random.default_rng(5)
    layers = [(1, i, *map(float, rng.random(3)), float(rng.choice([0.0, 0.05, 1.0], p=[0.2, 0.797, 0.003]))) for i in range(700)]
    want = np.ones(3)
    for _, _, r, g, b, alpha in layers:
        want = np.array([r, g, b]) * alpha + want * (1 - alpha)
    found = coverage.blend(spark.createDataFrame(layers, "p int, o int, r double, g double, b double, alpha double"), ["p"], ["o"]).first()
    assert [found[c] for c in "rgb"] == pytest.approx(want.tolist())
    angles = rng.random(2500) * 0.01
    ops = [(1, i, "transform", [math.cos(a), math.sin(a), -math.sin(a), math.cos(a), 0.1, -0.2]) for i, a in enumerate(angles)]
    m = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for *_, n in ops:
        m = interp.times(m, n)
    found = interp.transform_chain(spark.createDataFrame(ops, "p int, o int, fn string, args array<double>"), ["p"], "o").first()
    assert list(found["ctm"]) == pytest.approx(list(m))
    lines = spark.range(30_000).select((F.col("id") % 2).alias("p"), "id", F.floor(F.col("id") / 2).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.floor(F.col("id") / 2) + 1).cast("double").alias("x1"), F.when(F.col("id") == 20_000, 5.0).otherwise(0.0).alias("y1"))
    found = sorted(tuple(r) for r in merge.chains(lines, ["p"], "id").select("p", "island", "chain", "x0", "x1", "n").collect())
    assert found == [(0, 0, 0, 0, 10_000, 10_000), (0, 0, 1, 10_000, 10_001, 1), (0, 1, 0, 10_001, 15_000, 4_999), (1, 0, 0, 0, 15_000, 15_000)]
