"""Cases that only larger tables meet."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkfold.functions import scalar
from inkfold.operators import atlas, cull, grid, interp, metrics, paths, text
from inkfold.plans import catalog, fixtures, functions

SMALL = "/root/testdata/sf0.001"


def in_sql(sql, **views):
    con = duckdb.connect()
    for name, source in views.items():
        con.execute(f"CREATE VIEW {name} AS {source}")
    return con.execute(sql).fetchall()


def same(df, sql, **views):
    found, want = sorted(map(tuple, df.collect())), sorted(in_sql(sql, **views))
    return found == want


def test_overlap_sums_without_pairs(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 12, (n, 4)) * [1, 1, 2, 1])]
    a, b = make(150), make(130)
    schema = "id long, min_x double, min_y double, max_x double, max_y double"
    got = grid.overlap_sums(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = {p[0]: [q[0] for q in b if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4]] for p in a}
    assert sorted(map(tuple, got.collect())) == sorted((i, len(q), sum(q)) for i, q in want.items() if q)
    # 3,000 equal boxes overlap in 9 million pairs; no row of the plan is one of them.
    equal = spark.range(3000).select("id", *(F.lit(v).alias(n) for n, v in zip(grid.BOX, (0.0, 0.0, 1.0, 1.0), strict=True)))
    assert [tuple(r) for r in grid.overlap_sums(equal, equal).select("n", "b_sum").distinct().collect()] == [(3000, 2999 * 1500)]
    assert not grid.overlap_sums(equal.where("id < 0"), equal).count()


def test_sizes_beyond_the_largest_texture(spark, tmp_path):
    """37 times a part's key passes 4096 x 4096 texels at part 453,438."""
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 453_400).write.parquet(str(tmp_path / "part.parquet"))
    got = functions.size_functions(spark, str(tmp_path))
    want = functions.ORACLES["size_functions"]
    columns = ", ".join(got.columns)
    assert same(got, f"SELECT {columns} FROM ({want})", part=f"SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    n = F.lit(4096 * 4096 + 1)
    assert spark.range(1).select(metrics.utilisation(n, 4096).alias("v")).first()["v"] > 100
    with pytest.raises(PySparkException, match="too many texels"):
        spark.range(1).select(scalar.texture_dims(n, 4096).alias("v")).collect()


def test_long_lines_are_placed_in_parts(spark):
    """Three parts of a line in one row, and lines of two fonts between them; tokens are neither moved nor sorted."""
    long = "ab é\n😀" * (text.PLACED * 5 // 12)
    assert len(long) > 2 * text.PLACED
    lines = [(3, "f", "xa"), (2, "f", long), (1, "g", "b a"), (4, "f", None)]
    df = spark.createDataFrame(lines, "doc_id long, font string, line string").coalesce(1)
    placed = text.line_advances(df, ["doc_id"], fixtures.glyph_widths)
    want, first, n = [], {}, {}
    for doc, font, line in sorted(lines):
        x = 0.0
        for pos, ch in enumerate(line or ""):
            first.setdefault((font, ch), len(first))
            n[font, ch] = n.get((font, ch), 0) + 1
            width = float(ord(ch) % 10 * 50 + 250)
            if ch not in " \n\t":
                want.append((doc, font, ch, pos, width, x))
            x += width * 10.0 * 0.001
    assert sorted(map(tuple, placed.collect())) == sorted(want)
    assert {tuple(r) for r in text.line_glyph_dictionary(df, ["doc_id"]).collect()} == {(*k, n[k], i) for k, i in first.items()}
    for query in (catalog.text_in_page, catalog.text_bounds, catalog.text_instances):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan


def test_strokes_drawn_twice_count_in_page_scenes(spark, tmp_path):
    """Paths that go up and down on one spot: duplicates, which culling would drop and the SQL counts."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("user_id < 40")  # two pages a document at least: a single one isn't moved
    events.withColumn("value", F.when(F.col("event_id") % 4 < 3, 0.5).otherwise(F.col("value"))).write.parquet(str(tmp_path / "events.parquet"))
    got = functions.page_scenes(spark, str(tmp_path))
    want = functions.ORACLES["page_scenes"]
    assert same(got, f"SELECT {', '.join(got.columns)} FROM ({want})", events=f"SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")


@pytest.mark.parametrize("kind", ["strokes", "fills"])
def test_long_paths_are_not_repeated_with_each_segment(spark, kind):
    """A path of 20,000 lines: with its 60,000 numbers in each row it would take 4.8 GB."""
    n = 20_000
    path = [float(v) for i in range(n + 1) for v in (min(i, 1), i, i % 2)]
    ops = spark.createDataFrame([(7, 1, 0, "constructPath", "fillStroke", [], path)], "doc_id long, page_no int, op_seq int, fn string, paint string, args array<double>, path array<float>")
    painted = interp.painted_paths(ops)
    rows = paths.strokes(painted) if kind == "strokes" else paths.fill_segments(painted)
    made = next(x for x in rows._jdf.queryExecution().analyzed().toString().split("\n") if "MapInArrow" in x)
    assert "path#" not in made.split(")#")[1] and "ctm#" not in made.split(")#")[1]
    assert rows.agg(F.count("*"), F.max("pos"), F.min("doc_id"), F.max("x1")).first()[:] == (n + (kind == "fills"), n - (kind == "strokes"), 7, float(n))


def test_glyphs_are_read_once_for_all_scales(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    boxes = spark.range(20).select(F.col("id").alias("glyph_id"), *(F.lit(v).alias(n) for n, v in zip(grid.BOX, (0.0, 0.0, 1.0, 1.0), strict=True)))
    placed = atlas.placements(boxes.mapInArrow(counted, boxes.schema), 256).collect()
    assert len(placed) == 20 and {r["tile_w"] for r in placed} == {51}  # the last of six scales
    assert read.value == 20


def test_vectors_are_packed_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["vec_id"])
    parts = list(catalog._slices([batch, batch.slice(0, 5)]))
    assert max(p.num_rows for p in parts) == catalog.PACKED and [v for p in parts for v in p.column(0).to_pylist()] == [*range(1000), *range(5)]


def test_visible_strokes_read_their_input_twice(spark):
    """Once for the first ids of keys, once for their rows; the result is that of the culling with reasons."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    strokes = fixtures.strokes(spark, SMALL)
    want = sorted(r["seg_id"] for r in cull.cull(strokes).where("reason is null and page_no = 2").collect())
    n = strokes.count()
    assert sorted(r["seg_id"] for r in cull.visible(strokes.mapInArrow(counted, strokes.schema)).where("page_no = 2").collect()) == want
    assert 0 < read.value <= 2 * n
