"""Interpreting ordered operator streams, one page at a time.

Input: (doc_id, page_no, op_seq, fn, args array<double>, path array<float>, gstate
array<struct<key, value>>, text array<struct<adjust, font_char, unicode, width, is_space>>).
A page's operators depend on all earlier ones, so a page is one group; pages run in
parallel. Operators that a pass ignores are filtered before the shuffle.

Depth and plain transform chains also exist as built-in expressions, which need no Python.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import scalar
from inkfold.plans.session import ship

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

#: Operator names by what they paint.
STROKES = ["stroke", "closeStroke", "fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke"]
FILLS = ["fill", "eoFill", "fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke"]
EVEN_ODD = ["eoFill", "eoFillStroke", "closeEOFillStroke"]
IMAGES = [
    "paintImageXObject", "paintImageXObjectRepeat", "paintInlineImageXObject", "paintInlineImageXObjectGroup", "paintImageMaskXObject", "paintImageMaskXObjectGroup",
    "paintImageMaskXObjectRepeat", "paintSolidColorImageMask", "paintJpegXObject", "beginInlineImage", "endInlineImage",
]
SHOWS = ["showText", "showSpacedText", "nextLineShowText", "nextLineSetSpacingShowText"]
STATE = ["save", "restore", "transform", "paintFormXObjectBegin", "paintFormXObjectEnd"]
PATH_OPS = [
    *STATE, "setLineWidth", "setLineCap", "setStrokeRGBColor", "setStrokeColor", "setStrokeGray", "setStrokeCMYKColor", "setFillRGBColor", "setFillColor", "setFillGray",
    "setFillCMYKColor", "setGState", "constructPath",
]
TEXT_OPS = [
    *STATE, "constructPath", "clip", "eoClip", "endPath", "setFillRGBColor", "setFillColor", "setFillGray", "setFillCMYKColor", "setGState", "beginText", "setCharSpacing",
    "setWordSpacing", "setHScale", "setLeading", "setFont", "setTextRenderingMode", "setTextRise", "moveText", "setLeadingMoveText", "setTextMatrix", "nextLine", *SHOWS,
]


def times(m, n):
    """m x n: n is applied first."""
    return (
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5],
    )


def at(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def scale_of(m) -> float:
    s = (math.hypot(m[0], m[1]) + math.hypot(m[2], m[3])) / 2
    return s if math.isfinite(s) and s > 0 else 1.0


def number(args, i, fallback=None):
    x = args[i] if i < len(args) else None
    return x if x is not None and math.isfinite(x) else fallback


def unit(x, above) -> float:
    """Into [0, 1]; a value over 1 counts in parts of ``above``."""
    if x is None or not math.isfinite(x):
        return 0.0
    return min(1.0, max(0.0, x / above if x > 1 else x))


def colour(fn: str, args, before):
    if fn.endswith("Gray"):
        g = number(args, 0)
        return before if g is None else (unit(g, 255),) * 3
    if fn.endswith("CMYKColor"):
        c, m, y, k = (unit(number(args, i, 0.0), 100) for i in range(4))
        return 1 - min(1, c + k), 1 - min(1, m + k), 1 - min(1, y + k)
    parts = [number(args, i) for i in range(3)]
    if parts[0] is None:
        return before
    if parts[1] is None or parts[2] is None:
        return (unit(parts[0], 255),) * 3
    return tuple(unit(p, 255) for p in parts)


def _float(text):
    try:
        x = float(text)
        return x if math.isfinite(x) else None
    except (TypeError, ValueError):
        return None


class Stack:
    """Graphics state with two stacks: save / restore, and nested forms. Popping an empty one changes nothing."""

    def __init__(self, **state):
        self.now, self.saved, self.forms = state, [], []

    def apply(self, fn: str, args) -> bool:
        if fn == "save":
            self.saved.append(dict(self.now))
        elif fn == "restore":
            if self.saved:
                self.now = self.saved.pop()
        elif fn == "transform":
            if len(args) >= 6 and all(x is not None and math.isfinite(x) for x in args[:6]):
                self.now["ctm"] = times(self.now["ctm"], tuple(args[:6]))
        elif fn == "paintFormXObjectBegin":
            self.forms.append(dict(self.now))
            if len(args) >= 6 and all(x is not None and math.isfinite(x) for x in args[:6]):
                self.now["ctm"] = times(self.now["ctm"], tuple(args[:6]))
        elif fn == "paintFormXObjectEnd":
            if self.forms:
                self.now = self.forms.pop()
        else:
            return False
        return True


def path_rows(ops: list[dict], base=IDENTITY) -> list[dict]:
    """Painted paths of a page, in order, with the state that holds where they are painted."""
    s = Stack(ctm=base, width=1.0, cap=0, stroke=(0.0, 0.0, 0.0), stroke_alpha=1.0, fill=(0.0, 0.0, 0.0), fill_alpha=1.0)
    out = []
    for op in ops:
        fn, args = op["fn"], op["args"] or []
        if s.apply(fn, args):
            continue
        now = s.now
        if fn == "setLineWidth":
            now["width"] = max(0.0, number(args, 0, now["width"]))
        elif fn == "setLineCap":
            now["cap"] = min(2, max(0, int(number(args, 0, now["cap"]))))
        elif fn.startswith("setStroke"):
            now["stroke"] = colour(fn, args, now["stroke"])
        elif fn.startswith("setFill"):
            now["fill"] = colour(fn, args, now["fill"])
        elif fn == "setGState":
            for pair in op["gstate"] or []:
                x = _float(pair["value"])
                if x is None:
                    continue
                if pair["key"] == "CA":
                    now["stroke_alpha"] = min(1.0, max(0.0, x))
                elif pair["key"] == "ca":
                    now["fill_alpha"] = min(1.0, max(0.0, x))
                elif pair["key"] == "LW":
                    now["width"] = max(0.0, x)
                elif pair["key"] == "LC":
                    now["cap"] = min(2, max(0, int(x)))
        elif fn == "constructPath" and op["path"]:
            paint = op["paint"]
            strokes, fills = paint in STROKES, paint in FILLS
            if not strokes and not fills:
                continue
            hairline = now["width"] <= 0
            out.append({
                "op_seq": op["op_seq"], "paint": paint, "ctm": list(now["ctm"]), "is_stroke": strokes, "is_fill": fills, "rule": int(paint in EVEN_ODD),
                "half_width": 0.0 if hairline else max(0.0, now["width"] * scale_of(now["ctm"]) / 2),
                "flags": scalar.FLAG_HAIRLINE * hairline + scalar.FLAG_ROUND_CAP * (now["cap"] == 1),
                "stroke_rgb": list(now["stroke"]), "stroke_alpha": now["stroke_alpha"], "fill_rgb": list(now["fill"]), "fill_alpha": now["fill_alpha"], "path": op["path"],
            })
    return out


PAINTED = (
    "doc_id long, page_no int, op_seq long, paint string, ctm array<double>, is_stroke boolean, is_fill boolean, rule int, half_width double, flags int, "
    "stroke_rgb array<double>, stroke_alpha double, fill_rgb array<double>, fill_alpha double, path array<float>"
)
_PAINTED = pa.schema([
    ("doc_id", pa.int64()), ("page_no", pa.int32()), ("op_seq", pa.int64()), ("paint", pa.string()), ("ctm", pa.list_(pa.float64())), ("is_stroke", pa.bool_()), ("is_fill", pa.bool_()),
    ("rule", pa.int32()), ("half_width", pa.float64()), ("flags", pa.int32()), ("stroke_rgb", pa.list_(pa.float64())), ("stroke_alpha", pa.float64()), ("fill_rgb", pa.list_(pa.float64())),
    ("fill_alpha", pa.float64()), ("path", pa.list_(pa.float32())),
])


def _by_page(ops: DataFrame, wanted: list[str], rows, schema: str, arrow: pa.Schema, more: tuple[str, ...] = (), **options) -> DataFrame:
    ship(ops.sparkSession)

    def run(key, table):
        doc_id, page_no = key[0].as_py(), key[1].as_py()
        found = rows(sorted(table.to_pylist(), key=lambda r: r["op_seq"]), **options)
        return pa.Table.from_pylist([{"doc_id": doc_id, "page_no": page_no, **r} for r in found], schema=arrow)

    have = set(ops.columns)
    kinds = {"paint": "string", "path": "array<float>", "gstate": "array<struct<key: string, value: string>>", "text": "array<struct<adjust: double, font_char: string, unicode: string, width: double, is_space: boolean>>"}
    full = ops.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.col("op_seq").cast("long").alias("op_seq"), "fn", "args",
        *(F.col(n).cast(k).alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in kinds.items()), *more,
    )
    return full.where(F.col("fn").isin(wanted)).groupBy("doc_id", "page_no").applyInArrow(run, schema)


def painted_paths(ops: DataFrame) -> DataFrame:
    """One row for each path that is stroked or filled; ``paint`` names how a constructPath is painted."""
    return _by_page(ops, PATH_OPS, path_rows, PAINTED, _PAINTED)


def path_count(ops: DataFrame) -> DataFrame:
    painted = (F.col("fn") == "constructPath") & F.col("paint").isin([*STROKES, *FILLS]) & (F.size("path") > 0)
    return ops.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("operator_count"), F.count_if(painted).alias("path_count"), F.count_if(F.col("fn").isin(IMAGES)).alias("image_paint_op_count"))


def page_flags(ops: DataFrame) -> DataFrame:
    """Which pages show text, paint images or use forms."""
    has = lambda names: F.bool_or(F.col("fn").isin(names))
    return ops.groupBy("doc_id", "page_no").agg(has(SHOWS).alias("has_text"), has(IMAGES).alias("has_images"), has(["paintFormXObjectBegin"]).alias("has_forms"))


def raster_ops(ops: DataFrame) -> DataFrame:
    """Operators needed to draw images only: images, state, and paths that are only clipped with."""
    keep = F.col("fn").isin([*IMAGES, *STATE, "clip", "eoClip", "setGState", "endPath"]) | ((F.col("fn") == "constructPath") & (F.coalesce("paint", F.lit("endPath")) == "endPath"))
    return ops.where(keep)


# ---- text


def box_of(path, m):
    """Bounds of a path's points and control points under a matrix; None without points. Stops where operands are missing."""
    xs, ys, i = [], [], 0
    sizes = {0: 2, 1: 2, 2: 6, 3: 4, 4: 0}
    while i < len(path):
        n = sizes.get(int(path[i]))
        if n is None or i + n >= len(path) + (n == 0):
            break
        for k in range(i + 1, i + 1 + n, 2):
            x, y = at(m, path[k], path[k + 1])
            xs.append(x)
            ys.append(y)
        i += 1 + n
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def meet(a, b):
    """Null is the whole plane; disjoint boxes also give null."""
    if a is None or b is None:
        return a or b
    box = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return box if box[0] <= box[2] and box[1] <= box[3] else None


def text_rows(ops: list[dict], fonts: dict | None = None, base=IDENTITY, identity_ctm: bool = False) -> list[dict]:
    """Every glyph token that is shown, with the matrix from glyph space to the world.

    ``fonts``: by reference (scale, vertical); operators that bring their font's ``font_name``, ``font_scale`` and
    ``font_vertical`` need none. With ``identity_ctm`` transforms of the page are left out, as for a retry.
    """
    fonts = fonts or {}
    default = (scalar.FONT_SCALE, False)

    def font_of(op, ref):
        if op.get("font_scale") is not None:
            return op.get("font_name") or ref, op["font_scale"], bool(op.get("font_vertical"))
        return (ref, *fonts.get(ref, default))

    s = Stack(ctm=base, fill=(0.0, 0.0, 0.0), alpha=1.0, font="", scale=scalar.FONT_SCALE, vertical=False, size=0.0, direction=1, char=0.0, word=0.0, hscale=1.0, leading=0.0, rise=0.0, mode=0)
    tm, line, cursor = IDENTITY, [0.0, 0.0], [0.0, 0.0]
    clip, pending, saved_clips, form_clips = None, None, [], []
    out = []

    def move(tx, ty):
        line[0] += tx
        line[1] += ty
        cursor[:] = line

    def show(op):
        now = s.now
        scale, vertical = now["scale"], now["vertical"]
        x = 0.0
        for pos, t in enumerate(op["text"] or []):
            if t["adjust"] is not None:
                x += (1 if vertical else -1) * t["adjust"] * now["size"] / 1000
                continue
            spacing = (now["word"] if t["is_space"] else 0.0) + now["char"]
            m = times(now["ctm"], tm)
            m = times(m, (1, 0, 0, 1, cursor[0], cursor[1] + now["rise"]))
            m = times(m, (now["hscale"] * now["direction"], 0, 0, -1 if now["direction"] > 0 else 1, 0, 0))
            m = times(times(m, (1, 0, 0, 1, x, 0)), (now["size"], 0, 0, -now["size"], 0, 0))
            out.append({
                "op_seq": op["op_seq"], "pos": pos, "font": now["font"], "font_char": t["font_char"], "unicode": t["unicode"], "is_space": t["is_space"], "matrix": list(m),
                "rgb": list(now["fill"]), "alpha": now["alpha"], "mode": now["mode"], "vertical": vertical, "clip": list(clip) if clip else None,
            })
            step = (t["width"] or 0.0) * now["size"] * scale
            x += step - spacing * now["direction"] if vertical else step + spacing * now["direction"]
        if vertical:
            cursor[1] -= x
        else:
            cursor[0] += x * now["hscale"] * now["direction"]

    for op in ops:
        fn, args = op["fn"], op["args"] or []
        if fn == "save":
            saved_clips.append(clip)
        elif fn == "restore":
            clip, pending = saved_clips.pop() if saved_clips else None, None
        elif fn == "paintFormXObjectBegin":
            form_clips.append(clip)
        elif fn == "paintFormXObjectEnd":
            outer = form_clips.pop() if form_clips else None
            clip = clip if outer is None else outer
        if identity_ctm and fn in ("transform", "paintFormXObjectBegin"):
            args = []
        if s.apply(fn, args):
            continue
        now = s.now
        if fn == "constructPath":
            if op["paint"] in (None, "endPath") and op["path"]:
                pending = box_of(op["path"], now["ctm"])
        elif fn in ("clip", "eoClip"):
            clip = meet(clip, pending)
        elif fn == "endPath":
            pending = None
        elif fn.startswith("setFill"):
            now["fill"] = colour(fn, args, now["fill"])
        elif fn == "setGState":
            for pair in op["gstate"] or []:
                if pair["key"] == "ca" and (x := _float(pair["value"])) is not None:
                    now["alpha"] = min(1.0, max(0.0, x))
                elif pair["key"] == "Font" and pair["value"]:
                    name, _, size = pair["value"].partition(" ")
                    now["font"], now["scale"], now["vertical"] = font_of(op, name)
                    now["size"] = abs(_float(size) or now["size"])
        elif fn == "beginText":
            tm, line[:], cursor[:] = IDENTITY, [0.0, 0.0], [0.0, 0.0]
        elif fn in ("setCharSpacing", "setWordSpacing", "setTextRise"):
            name = {"setCharSpacing": "char", "setWordSpacing": "word", "setTextRise": "rise"}[fn]
            now[name] = number(args, 0, now[name])
        elif fn == "setHScale":
            now["hscale"] = number(args, 0, 100.0) / 100
        elif fn == "setLeading":
            now["leading"] = -number(args, 0, 0.0)
        elif fn == "setFont":
            size = number(args, 0, 0.0)
            if op["paint"]:
                now["font"], now["scale"], now["vertical"] = font_of(op, op["paint"])
            now["size"], now["direction"] = abs(size), -1 if size < 0 else 1
        elif fn == "setTextRenderingMode":
            now["mode"] = max(0, int(number(args, 0, 0)))
        elif fn == "moveText":
            move(number(args, 0, 0.0), number(args, 1, 0.0))
        elif fn == "setLeadingMoveText":
            now["leading"] = number(args, 1, 0.0)
            move(number(args, 0, 0.0), number(args, 1, 0.0))
        elif fn == "setTextMatrix":
            if len(args) >= 6 and all(x is not None and math.isfinite(x) for x in args[:6]):
                tm, line[:], cursor[:] = tuple(args[:6]), [0.0, 0.0], [0.0, 0.0]
        elif fn == "nextLine":
            move(0.0, now["leading"])
        elif fn in SHOWS:
            if fn == "nextLineSetSpacingShowText":
                now["word"], now["char"] = number(args, 0, now["word"]), number(args, 1, now["char"])
            if fn.startswith("nextLine"):
                move(0.0, now["leading"])
            show(op)
    return out


TOKENS = (
    "doc_id long, page_no int, op_seq long, pos int, font string, font_char string, unicode string, is_space boolean, matrix array<double>, rgb array<double>, alpha double, "
    "mode int, vertical boolean, clip array<double>"
)
_TOKENS = pa.schema([
    ("doc_id", pa.int64()), ("page_no", pa.int32()), ("op_seq", pa.int64()), ("pos", pa.int32()), ("font", pa.string()), ("font_char", pa.string()), ("unicode", pa.string()),
    ("is_space", pa.bool_()), ("matrix", pa.list_(pa.float64())), ("rgb", pa.list_(pa.float64())), ("alpha", pa.float64()), ("mode", pa.int32()), ("vertical", pa.bool_()), ("clip", pa.list_(pa.float64())),
])


def shown_tokens(ops: DataFrame, fonts: DataFrame | dict | None = None, identity_ctm: bool = False) -> DataFrame:
    """``fonts``: a table (font_ref, loaded_name, font_scale, vertical), or a small dictionary by reference: (scale, vertical).

    A table is joined to the operators that choose a font, so it may have any size; a font that it lacks has the
    usual scale and goes by its reference. The token's ``font`` is the loaded name.
    """
    if not isinstance(fonts, DataFrame):
        return _by_page(ops, TEXT_OPS, text_rows, TOKENS, _TOKENS, fonts=fonts, identity_ctm=identity_ctm)
    c = F.col
    of_state = F.get(F.split(F.get(F.filter("gstate", lambda x: x["key"] == "Font"), F.lit(0))["value"], " "), F.lit(0)) if "gstate" in ops.columns else F.lit(None).cast("string")
    known = fonts.select(c("font_ref").alias("_ref"), c("loaded_name").alias("font_name"), F.coalesce("font_scale", F.lit(scalar.FONT_SCALE)).alias("font_scale"), c("vertical").alias("font_vertical")).dropDuplicates(["_ref"])
    chosen = ops.withColumn("_chosen", F.when(c("fn") == "setFont", c("paint")).when(c("fn") == "setGState", of_state))
    joined = chosen.join(known, c("_chosen") == c("_ref"), "left").drop("_chosen", "_ref")
    return _by_page(joined, TEXT_OPS, text_rows, TOKENS, _TOKENS, ("font_name", "font_scale", "font_vertical"), identity_ctm=identity_ctm)


# ---- built-in twins


def nesting_depth(ops: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``depth`` after each operator: a running sum of +1 and -1 that never goes below 0."""
    step = F.when(F.col("fn") == "save", 1).when(F.col("fn") == "restore", -1).otherwise(0)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = ops.withColumn("_s", F.sum(step).over(w))
    return s.withColumn("depth", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("long")).drop("_s")


#: Transforms that are multiplied at a time.
STRETCH = 1024


def transform_chain(ops: DataFrame, by: list[str], order: str) -> DataFrame:
    """The product of all transforms of a group, in order.

    Products are associative: every STRETCH transforms become one matrix, then those are multiplied, so no row
    holds all transforms of a group.
    """
    parts = [F.get("args", i).alias(n) for i, n in enumerate(scalar.MAT)]
    moves = ops.where((F.col("fn") == "transform") & (F.size("args") >= 6)).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order)))

    def product(df: DataFrame, keys: list[str], place: str, columns: list) -> DataFrame:
        ms = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place), *columns))).alias("ms"))
        return ms.select(*keys, F.aggregate("ms", scalar.identity(), scalar.multiply).alias("ctm"))

    stretches = product(moves.withColumn("_stretch", F.floor(F.col("_k") / STRETCH)), [*by, "_stretch"], "_k", parts)
    return product(stretches, by, "_stretch", [F.col(f"ctm.{n}").alias(n) for n in scalar.MAT])
