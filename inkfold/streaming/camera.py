"""Camera state from a stream of interactions: pan, zoom, pinch, damping, inertia.

One fold over a session's events serves batches (``replay``) and streams (``track``).
Events: (session_id, event_seq, t_ms, kind, pointer_id, pointer_type, x, y, delta_y); frames
are events too, so results don't depend on how a stream is cut into batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.plans.session import ship

#: Fixed values.
ZOOM_LOW, ZOOM_HIGH = 0.01, 8192.0
FACTOR_LOW, FACTOR_HIGH = 0.1, 10.0
WHEEL = 0.0013
DAMPING, LONGEST_FRAME_MS = 24.0, 64.0
SNAP_POSITION, SNAP_ZOOM = 1e-4, 1e-5
LEAST_FRAME_MS, LEAST_SPEED, MOST_SPEED, FRESH_MS = 0.1, 5.0, 20000.0, 120.0
PINCH_EPS = 1e-4
ACTIVE_MS = 140.0

START = {
    "cx": 0.0, "cy": 0.0, "zoom": 1.0, "tx": 0.0, "ty": 0.0, "tz": 1.0, "t": None, "vx": 0.0, "vy": 0.0, "v_t": None, "px": 0.0, "py": 0.0, "p_t": None, "input_t": None,
    "dragging": False, "pointers": [], "anchor": None,
}


def clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


class Camera:
    """One session's state; ``on`` takes an event and changes it."""

    def __init__(self, state: dict | None = None, width: float = 1024.0, height: float = 768.0, dpr: float = 1.0):
        self.s = dict(START) | (state or {})
        self.width, self.height, self.dpr = width, height, dpr

    def _world(self, x: float, y: float) -> tuple[float, float]:
        s = self.s
        return s["cx"] + (x * self.dpr - self.width / 2) / s["zoom"], s["cy"] - (y * self.dpr - self.height / 2) / s["zoom"]

    def pan(self, dx: float, dy: float, t: float) -> None:
        s = self.s
        s["cx"] -= dx * self.dpr / s["zoom"]
        s["cy"] += dy * self.dpr / s["zoom"]
        s["tx"], s["ty"], s["tz"], s["anchor"], s["input_t"] = s["cx"], s["cy"], s["zoom"], None, t

    def zoom_at(self, x: float, y: float, factor: float, t: float) -> None:
        """Changes the target zoom; the world point under (x, y) is to stay there."""
        s = self.s
        wx, wy = self._world(x, y)
        s["tz"] = clamp(s["tz"] * clamp(factor, FACTOR_LOW, FACTOR_HIGH), ZOOM_LOW, ZOOM_HIGH)
        s["anchor"], s["input_t"] = (wx, wy, x, y), t
        s["tx"], s["ty"] = self._anchored(s["tz"])

    def _anchored(self, zoom: float) -> tuple[float, float]:
        wx, wy, x, y = self.s["anchor"]
        return wx - (x * self.dpr - self.width / 2) / zoom, wy + (y * self.dpr - self.height / 2) / zoom

    def frame(self, t: float) -> None:
        """Moves towards the target and samples the speed of a drag."""
        s = self.s
        dt = 0.0 if s["t"] is None else clamp(t - s["t"], 0.0, LONGEST_FRAME_MS)
        s["t"] = t
        share = 1 - math.exp(-DAMPING * dt / 1000)
        s["zoom"] += (s["tz"] - s["zoom"]) * share
        if abs(s["tz"] - s["zoom"]) <= SNAP_ZOOM * max(1.0, s["tz"]):
            s["zoom"] = s["tz"]
        if s["anchor"] is not None:
            s["cx"], s["cy"] = self._anchored(s["zoom"])
            if s["zoom"] == s["tz"]:
                s["anchor"], s["tx"], s["ty"] = None, s["cx"], s["cy"]
        else:
            for c, g in (("cx", "tx"), ("cy", "ty")):
                s[c] += (s[g] - s[c]) * share
                if abs(s[g] - s[c]) <= SNAP_POSITION:
                    s[c] = s[g]
        if s["dragging"]:
            if s["p_t"] is not None and t - s["p_t"] > LEAST_FRAME_MS:
                vx, vy = ((s[c] - s[p]) * 1000 / (t - s["p_t"]) for c, p in (("cx", "px"), ("cy", "py")))
                speed = math.hypot(vx, vy)
                if speed >= LEAST_SPEED:
                    k = min(1.0, MOST_SPEED / speed)
                    s["vx"], s["vy"], s["v_t"] = vx * k, vy * k, t
            s["px"], s["py"], s["p_t"] = s["cx"], s["cy"], t

    def release(self, t: float) -> None:
        """Lets a fresh, fast drag run on."""
        s = self.s
        if s["v_t"] is not None and t - s["v_t"] <= FRESH_MS and math.hypot(s["vx"], s["vy"]) >= LEAST_SPEED:
            s["tx"], s["ty"] = s["cx"] + s["vx"] / DAMPING, s["cy"] + s["vy"] / DAMPING
        s["dragging"], s["v_t"], s["p_t"] = False, None, None

    def _two(self):
        (_, ax, ay), (_, bx, by) = self.s["pointers"][:2]
        return (ax + bx) / 2, (ay + by) / 2, math.hypot(ax - bx, ay - by)

    def on(self, e: dict) -> None:
        s, kind, t = self.s, e["kind"], e["t_ms"]
        pointers = [list(p) for p in s["pointers"]]
        held = next((p for p in pointers if p[0] == e["pointer_id"]), None)
        if kind == "frame":
            self.frame(t)
        elif kind == "wheel":
            self.zoom_at(e["x"], e["y"], math.exp(-e["delta_y"] * WHEEL), t)
        elif kind == "pointerdown":
            s["pointers"] = [p for p in pointers if p is not held] + [[e["pointer_id"], e["x"], e["y"]]]
            s["tx"], s["ty"], s["tz"], s["anchor"] = s["cx"], s["cy"], s["zoom"], None
            s["dragging"], s["vx"], s["vy"], s["v_t"] = len(s["pointers"]) == 1, 0.0, 0.0, None
            s["px"], s["py"], s["p_t"] = s["cx"], s["cy"], t
        elif kind == "pointermove" and held:
            if len(pointers) == 1:
                dx, dy = e["x"] - held[1], e["y"] - held[2]
                s["pointers"] = [[held[0], e["x"], e["y"]]]
                self.pan(dx, dy, t)
            else:
                x0, y0, d0 = self._two()
                held[1:] = [e["x"], e["y"]]
                s["pointers"] = pointers
                x1, y1, d1 = self._two()
                self.pan(x1 - x0, y1 - y0, t)
                factor = d1 / d0 if d0 > 0 else 1.0
                if abs(factor - 1) > PINCH_EPS:
                    self.zoom_at(x1, y1, factor, t)
        elif kind in ("pointerup", "pointercancel", "lostpointercapture") and held:
            s["pointers"] = [p for p in pointers if p is not held]
            if kind == "pointerup" and s["dragging"] and not s["pointers"]:
                self.release(t)
            s["dragging"] = len(s["pointers"]) == 1
            s["px"], s["py"], s["p_t"] = s["cx"], s["cy"], t
        elif kind == "set" and all(math.isfinite(e[k]) for k in ("x", "y", "delta_y")):
            zoom = clamp(e["delta_y"], ZOOM_LOW, ZOOM_HIGH)
            s |= {"cx": e["x"], "cy": e["y"], "zoom": zoom, "tx": e["x"], "ty": e["y"], "tz": zoom, "anchor": None, "t": None}

    def row(self, e: dict) -> tuple:
        s = self.s
        active = s["input_t"] is not None and e["t_ms"] - s["input_t"] <= ACTIVE_MS
        return e["session_id"], e["event_seq"], s["cx"], s["cy"], s["zoom"], bool(active)


OUT = "session_id long, event_seq long, cx double, cy double, zoom double, active boolean"
_COLUMNS = ["session_id", "event_seq", "cx", "cy", "zoom", "active"]


def _fold(camera: Camera, events: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for e in events.sort_values("event_seq").to_dict("records"):
        camera.on(e)
        rows.append(camera.row(e))
    return pd.DataFrame(rows, columns=_COLUMNS)


def replay(events: DataFrame) -> DataFrame:
    """The state after each event, sessions in parallel."""
    ship(events.sparkSession)
    return events.groupBy("session_id").applyInPandas(lambda pdf: _fold(Camera(), pdf), OUT)


def track(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream; a session's state is one small JSON text.

    With ``idle_ms`` a session without events for that long is forgotten, for streams that run on and on; such a
    stream always has a batch to run, so a trigger that ends with the available data needs None.
    """
    import json

    ship(events.sparkSession)

    def update(key, batches: Iterable[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        camera = Camera(json.loads(state.get[0]) if state.exists else None)
        for pdf in batches:
            yield _fold(camera, pdf)
        state.update((json.dumps(camera.s),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy("session_id").applyInPandasWithState(update, OUT, "state string", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


# ---- parts that are plain expressions


def pan_path(events: DataFrame, by: list[str], order: str, zoom: float = 1.0, dpr: float = 1.0) -> DataFrame:
    """Adds (cx, cy) after each pan (dx, dy) at a constant zoom: a running sum."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("cx", F.sum(-F.col("dx") * dpr / zoom).over(w)).withColumn("cy", F.sum(F.col("dy") * dpr / zoom).over(w))


def latest_load(loads: DataFrame) -> DataFrame:
    """Of a session's loads (session_id, token, ...) only the newest counts."""
    return loads.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in loads.columns if c != "session_id"]), "token").alias("r")).select("session_id", "r.*")


def smoothed_rate(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., fps): 0.85 of the mean so far and 0.15 of 1000 / dt, the first sample as it is."""
    w = Window.partitionBy(*by).orderBy(order)
    dt = frames.withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(w)).where("dt > 0")
    item = F.struct(F.col(order).alias("o"), (1000.0 / F.col("dt")).alias("v"))
    grouped = dt.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("vs"))
    fold = F.aggregate("vs", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise(acc * 0.85 + x["v"] * 0.15))
    return grouped.select(*by, fold.alias("fps"))


def cache_decision(segments, zoom_ratio, covered, moving, settled_elsewhere):
    """Whether a kept frame can be shown moved and scaled instead of drawing anew."""
    usable = (segments >= 300_000) & moving
    stale = (zoom_ratio < 0.75) | (zoom_ratio > 1.333) | ~covered | settled_elsewhere
    return F.when(usable & ~stale, "reuse").when(usable, "refresh").otherwise("draw")
