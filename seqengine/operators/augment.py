"""Augmentation of recordings: noise, drift, dropout and time warp.

Kernels take a (steps, channels) array and a random generator seeded from the
recording's key and `seed`, so results don't depend on partitioning.  `augment`
runs them once a recording in Arrow batches of whole recordings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray, np.random.Generator], np.ndarray]
Span = float | tuple[float, float] | list[float]


def _drawn(value: Span, rng: np.random.Generator) -> float:
    """A number as it is, one of a list, or uniform within a pair."""
    if isinstance(value, list):
        return float(rng.choice(value))
    return float(rng.uniform(*value)) if isinstance(value, tuple) else float(value)


def noise(loc: Span = 0.0, scale: Span = 0.1, distribution: str = "gaussian", multiplicative: bool = False, per_channel: bool = True) -> Kernel:
    """Independent noise at each step, added or as a factor 1 + noise; an unknown distribution is zero."""

    def kernel(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        middle, width = _drawn(loc, rng), _drawn(scale, rng)
        draw = {"gaussian": rng.standard_normal, "laplace": lambda s: rng.laplace(size=s), "uniform": rng.random}.get(distribution, np.zeros)
        n = draw((len(x), x.shape[1] if per_channel else 1)) * width + middle
        return x * (1 + n) if multiplicative else x + n

    return kernel


def natural_knots(t: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The cubic spline through (t, y) whose first and last two pieces are one cubic (not-a-knot)."""
    n = len(t)
    if n == 2:
        return lambda q: y[0] + (y[1] - y[0]) * ((q - t[0]) / (t[1] - t[0]))[:, None]
    if n == 3:
        fit = np.linalg.solve(np.vander(t, 3), y)
        return lambda q: np.vander(q, 3) @ fit
    h, slope = np.diff(t), np.diff(y, axis=0) / np.diff(t)[:, None]
    a, rhs = np.zeros((n, n)), np.zeros((n, y.shape[1]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        rhs[i] = 3 * (h[i] * slope[i - 1] + h[i - 1] * slope[i])
    first, last = t[2] - t[0], t[-1] - t[-3]
    a[0, :2] = h[1], first
    rhs[0] = ((h[0] + 2 * first) * h[1] * slope[0] + h[0] ** 2 * slope[1]) / first
    a[-1, -2:] = last, h[-2]
    rhs[-1] = (h[-1] ** 2 * slope[-2] + (2 * last + h[-1]) * h[-2] * slope[-1]) / last
    d = np.linalg.solve(a, rhs)

    def at(q: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(t, q, "right") - 1, 0, n - 2)
        u, w = ((q - t[k]) / h[k])[:, None], h[k][:, None]
        return y[k] * (1 + 2 * u) * (1 - u) ** 2 + d[k] * w * u * (1 - u) ** 2 + y[k + 1] * u**2 * (3 - 2 * u) + d[k + 1] * w * u**2 * (u - 1)

    return at


def drift(most: Span = 0.5, points: int | list[int] = 3, multiplicative: bool = False, per_channel: bool = True) -> Kernel:
    """A smooth random walk from zero, scaled at each step by its largest channel, times `most`."""

    def kernel(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        length, channels = len(x), x.shape[1] if per_channel else 1
        choices = points if isinstance(points, list) else [points]
        own = rng.integers(len(choices), size=channels)
        path = np.zeros((length, channels))
        for k, n in enumerate(choices):
            if (own == k).any():
                walk = np.cumsum(rng.standard_normal((n + 2, int((own == k).sum()))), axis=0)
                path[:, own == k] = natural_knots(np.linspace(0, length, n + 2), walk)(np.arange(length, dtype=float))
        path -= path[0]
        path /= np.abs(path).max(axis=1, keepdims=True) + 1e-6
        path *= rng.uniform(*most, size=(1, channels)) if isinstance(most, tuple) else _drawn(most, rng)
        return x * (1 + path) if multiplicative else x + path

    return kernel


def dropout(share: Span = 0.05, size: int | tuple[int, int] | list[int] = 1, fill: str | float = "ffill", per_channel: bool = False) -> Kernel:
    """Blocks of steps replaced by the value before, the value after, the channel's mean or a constant.

    A pair (a, b) of sizes means a to b - 1.  A recording no longer than a block size raises.
    """
    sizes = list(range(*size)) if isinstance(size, tuple) else size if isinstance(size, list) else [size]

    def kernel(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out, length, p = x.copy(), len(x), _drawn(share, rng)
        mean = x.mean(axis=0)
        for block in sizes:
            if length < block:
                raise ValueError("a recording is shorter than a dropout block")
            starts = rng.random((length - block, x.shape[1] if per_channel else 1)) < p / len(sizes) / block
            if not per_channel:
                starts = np.repeat(starts, x.shape[1], axis=1)
            for at, c in np.argwhere(starts):
                if fill == "ffill":
                    out[at + 1 : min(at + block, length - 1) + 1, c] = out[at, c]
                elif fill == "bfill":
                    out[at : at + block, c] = out[min(at + block, length - 1), c]
                else:
                    out[at : at + block, c] = mean[c] if fill == "mean" else float(fill)
        return out

    return kernel


def monotone(t: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Shape-preserving cubic interpolation (harmonic-mean slopes, one-sided three-point ends)."""
    h, s = np.diff(t), np.diff(y) / np.diff(t)
    d = np.zeros(len(t))
    if len(t) == 2:
        d[:] = s[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = s[:-1] * s[1:] > 0
        d[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / s[:-1][same] + w2[same] / s[1:][same])
        for end, (h0, h1, s0, s1) in ((0, (h[0], h[1], s[0], s[1])), (-1, (h[-1], h[-2], s[-1], s[-2]))):
            e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if e * s0 <= 0:
                e = 0.0
            elif s0 * s1 <= 0 and abs(e) > 3 * abs(s0):
                e = 3 * s0
            d[end] = e

    def at(q: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(t, q, "right") - 1, 0, len(t) - 2)
        u = (q - t[k]) / h[k]
        return y[k] * (1 + 2 * u) * (1 - u) ** 2 + d[k] * h[k] * u * (1 - u) ** 2 + y[k + 1] * u**2 * (3 - 2 * u) + d[k + 1] * h[k] * u**2 * (u - 1)

    return at


def time_warp(changes: int = 3, ratio: Span = 3.0) -> Kernel:
    """Random speeds between `changes` change points, at most `ratio` apart; the length stays."""

    def kernel(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        length, top = len(x), _drawn(ratio, rng)
        if length < 2:
            return x
        speed = rng.random(changes + 1)
        spread = speed.max() - speed.min()
        speed = 1 + (speed - speed.min()) * ((top - 1) / spread if spread else 0)
        anchors = np.linspace(0, length - 1, changes + 2)
        travelled = np.r_[0, np.cumsum(speed * np.diff(anchors))]
        travelled *= (length - 1) / travelled[-1]
        where = monotone(anchors, travelled)(np.arange(length, dtype=float))
        return np.stack([np.interp(where, np.arange(length), x[:, c]) for c in range(x.shape[1])], axis=1)

    return kernel


def gated(kernels: Sequence[Kernel], chance: float = 0.25) -> Kernel:
    """Each kernel in order with an independent chance."""

    def kernel(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        for k in kernels:
            if rng.random() < chance:
                x = k(x, rng)
        return x

    return kernel


def standard() -> Kernel:
    """The augmentations in use: noise, drift, dropout and warp, each with a chance of a quarter."""
    return gated([noise(0, 0.05, multiplicative=True), drift(0.1, 40, multiplicative=True), dropout(0.05, (5, 10), "ffill", per_channel=True), time_warp(5, 4.0)])


def augment(arrays: DataFrame, key: str, kernel: Kernel, seed: int = 0) -> DataFrame:
    """Recordings (key, values: array of channel arrays) through a kernel."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in stream:
            done = []
            for k, values in zip(rows[key], rows["values"]):
                x = np.array([np.asarray(v, float) for v in values])
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                done.append(kernel(x, rng).tolist() if len(x) else [])
            yield pd.DataFrame({key: rows[key], "values": done})

    return arrays.select(key, "values").mapInPandas(run, f"{key} {arrays.schema[key].dataType.simpleString()}, values array<array<double>>")
