"""Encodings of float32 columns, as bytes: interleaved, channel-major, byte-shuffled, xor-delta."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = 4
LAYOUTS = ("interleaved", "channel-major")
PREDICTORS = ("none", "byte-shuffle", "xor-delta-byte-shuffle")


def _floats(data: bytes) -> np.ndarray:
    if len(data) % 4:
        raise ValueError(f"{len(data)} bytes are no whole float32 values")
    return np.frombuffer(data, "<f4")


def to_channel_major(values) -> bytes:
    """Items of four become four planes."""
    a = np.asarray(values, "<f4")
    if a.size % CHANNELS:
        raise ValueError("the length must be a multiple of 4")
    return a.reshape(-1, CHANNELS).T.tobytes()


def from_channel_major(data: bytes) -> np.ndarray:
    if len(data) % (4 * CHANNELS):
        raise ValueError("the byte length must be a multiple of 16")
    return np.ascontiguousarray(_floats(data).reshape(CHANNELS, -1).T).ravel()


def to_shuffled(values) -> bytes:
    """All first bytes, then all second bytes, and so on."""
    return np.asarray(values, "<f4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_shuffled(data: bytes) -> np.ndarray:
    if len(data) % 4:
        raise ValueError(f"{len(data)} bytes are no whole float32 values")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<f4").ravel()


def to_xor_delta(values) -> bytes:
    """Each word xor its predecessor, then shuffled."""
    w = np.asarray(values, "<f4").view("<u4")
    return to_shuffled((w ^ np.concatenate((np.zeros(1, "<u4"), w[:-1]))[: len(w)]).view("<f4"))


def from_xor_delta(data: bytes) -> np.ndarray:
    return np.bitwise_xor.accumulate(from_shuffled(data).view("<u4")).astype("<u4").view("<f4") if data else np.zeros(0, "<f4")


def decode(data: bytes, layout: str = "interleaved", predictor: str = "none", component: str = "float32", count: int | None = None) -> np.ndarray:
    """Float32 values of a stored column, in item order, cut to ``count`` values."""
    if component != "float32":
        raise ValueError(f"unknown component type {component!r}")
    if layout not in LAYOUTS or predictor not in PREDICTORS:
        raise ValueError(f"unknown layout {layout!r} or predictor {predictor!r}")
    if layout == "channel-major":
        values = from_channel_major(data)
    else:
        values = {"none": _floats, "byte-shuffle": from_shuffled, "xor-delta-byte-shuffle": from_xor_delta}[predictor](data)
    if count is not None:
        if count > len(values):
            raise ValueError(f"{count} values are promised, {len(values)} are there")
        values = values[:count]
    return values


def encode(values, layout: str = "interleaved", predictor: str = "none") -> bytes:
    if layout == "channel-major":
        return to_channel_major(values)
    return {"none": lambda v: np.asarray(v, "<f4").tobytes(), "byte-shuffle": to_shuffled, "xor-delta-byte-shuffle": to_xor_delta}[predictor](values)


# ---- built-in twins on array columns


def channel_major(values: Column) -> Column:
    """Items of four as four planes, on an array column."""
    n = F.size(values)
    m = (n / CHANNELS).cast("int")
    return F.when(n == 0, values).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, (i % m) * CHANNELS + F.floor(i / m).cast("int"))))


def interleaved(planes: Column) -> Column:
    n = F.size(planes)
    m = (n / CHANNELS).cast("int")
    return F.when(n == 0, planes).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(planes, (i % CHANNELS) * m + F.floor(i / CHANNELS).cast("int"))))


def xor_delta(words: Column) -> Column:
    """Integers xor their predecessors."""
    return F.transform(words, lambda x, i: x.bitwiseXOR(F.when(i > 0, F.get(words, i - 1)).otherwise(F.lit(0).cast("long"))))


def xor_scan(words: Column) -> Column:
    """The inverse: a running xor. The accumulator is copied at each step, so this is for short arrays."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(words, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")).bitwiseXOR(x))))
