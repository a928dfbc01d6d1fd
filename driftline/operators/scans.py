"""Scan directions, source and turn-around cuts, correlated modes by row and column, simulated signals, housekeeping channels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.intervals import merge_ranges, ranges_of_mask
from driftline.operators.ordered import boxcar


def gradient(df: DataFrame, keys: list[str], samp: str, value: str, name: str = "gradient") -> DataFrame:
    """``df`` with the central difference of a signal, one-sided at its ends; null for a single sample."""
    w = Window.partitionBy(*keys).orderBy(samp)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    g = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    return df.withColumn(name, g)


def scan_direction(df: DataFrame, keys: list[str], samp: str, az: str) -> DataFrame:
    """``df`` with ``direction``: 1 where the scan goes up, -1 where it goes down, 0 where it stands."""
    return gradient(df, keys, samp, az, "_g").withColumn("direction", F.signum("_g").cast("int")).drop("_g")


def source_cuts(df: DataFrame, keys: list[str], samp: str, x: Column, y: Column, sources: list[tuple[float, float, float]], buffer: int = 0) -> DataFrame:
    """(keys, start, stop) where a detector is within the radius of a source (x, y, radius)."""
    near: Column = F.lit(False)
    for sx, sy, r in sources:
        near = near | ((x - sx) ** 2 + (y - sy) ** 2 < r * r)
    got = ranges_of_mask(df, keys, samp, near)
    wide = got.select(*keys, F.greatest(F.col("start") - buffer, F.lit(0)).alias("start"), (F.col("stop") + buffer).alias("stop"))
    return merge_ranges(wide, keys)


def clear_of(ranges: DataFrame, dets: DataFrame, keys: list[str], turns: DataFrame, turn_keys: list[str]) -> DataFrame:
    """Keys of ``dets`` none of whose ranges overlaps a turn-around of its observation."""
    t = turns.select(*[F.col(k).alias(f"_{k}") for k in turn_keys], F.col("start").alias("_a"), F.col("stop").alias("_b"))
    on = (F.col("start") < F.col("_b")) & (F.col("_a") < F.col("stop"))
    for k in turn_keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    hit = ranges.join(t, on, "left_semi").select(*keys).distinct()
    return dets.select(*keys).distinct().join(hit, keys, "left_anti")


def group_mode(df: DataFrame, keys: list[str], group: list[str], samp: str, value: str) -> DataFrame:
    """(keys, group, samp, mode, n): mean of the mean-free streams of each row, column or block of detectors."""
    w = Window.partitionBy(*keys, "det_uid")
    rows = df.withColumn("_x", F.col(value) - F.avg(value).over(w))
    return rows.groupBy(*keys, *group, samp).agg(F.avg("_x").alias("mode"), F.count("*").alias("n"))


def relative_calibration(df: DataFrame, keys: list[str], det: str, samp: str, value: str, width: int = 9) -> DataFrame:
    """(keys, det, cal): mean coefficient of the smoothed common mode over the detector's own; null for a coefficient of 0."""
    smooth = boxcar(df, [*keys, det], samp, value, width)
    mean = smooth.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, det)))
    common = mean.groupBy(*keys, samp).agg(F.avg("_x").alias("_c"))
    k = mean.join(common, [*keys, samp]).groupBy(*keys, det).agg((F.sum(F.col("_x") * F.col("_c")) / F.sum(F.col("_c") ** 2)).alias("_k"))
    ok = F.when(F.col("_k") != 0, F.col("_k"))
    return k.withColumn("cal", F.avg("_k").over(Window.partitionBy(*keys)) / ok).select(*keys, det, "cal")


def correlations_removed(df: DataFrame, keys: list[str], det: str, samp: str, value: str, width: int) -> DataFrame:
    """Streams less their mean and less the moving mean (odd ``width``) of the observation's common mode."""
    rows = df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys, det)))
    common = boxcar(rows.groupBy(*keys, samp).agg(F.avg(value).alias("_c")), keys, samp, "_c", width | 1)
    return rows.join(common, [*keys, samp]).withColumn(value, F.col(value) - F.col("_c")).drop("_c")


def injected(df: DataFrame, value: str, x: Column, y: Column, sources: list[tuple[float, float, float, float]]) -> DataFrame:
    """Streams plus gaussian sources (x, y, amplitude, fwhm)."""
    total: Column = F.lit(0.0)
    for sx, sy, amp, fwhm in sources:
        total = total + amp * F.exp(-4 * math.log(2) * ((x - sx) ** 2 + (y - sy) ** 2) / fwhm**2)
    return df.withColumn(value, F.col(value) + total)


def gaps_filled(df: DataFrame, keys: list[str], samp: str, value: str, ok: Column) -> DataFrame:
    """A channel whose bad samples are put on the line between their good neighbours, or at the nearest one at an end."""
    w = Window.partitionBy(*keys).orderBy(samp)
    good = F.when(ok, F.struct(F.col(samp).alias("s"), F.col(value).alias("v")))
    rows = df.withColumn("_p", F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(good, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col(samp) - p["s"]) / F.when(n["s"] != p["s"], n["s"] - p["s"])
    return rows.withColumn(value, F.when(ok, F.col(value)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)).drop("_p", "_n")


def sky_offset(dx: Column, dy: Column, alt: Column, params: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Offsets of a pointing model with a constant and a term in the altitude on each axis."""
    a0, a1, b0, b1 = params
    return dx + a0 + a1 * F.cos(alt), dy + b0 + b1 * F.sin(alt)


def frequency_waterfall(df: DataFrame, keys: list[str], samp: str, value: str, rate: float, cells: int) -> DataFrame:
    """(keys, cell, f, power): mean power of a stream in cells of equal width of frequency; a cell without a bin is interpolated."""
    from driftline.operators.spectral import per_stream, power_spectrum

    def kernel(x: np.ndarray) -> dict:
        f, p = power_spectrum(x, rate, len(x))
        edge = np.linspace(0, rate / 2, cells + 1)
        mid = (edge[1:] + edge[:-1]) / 2
        b = np.clip(np.digitize(f, edge) - 1, 0, cells - 1)
        n = np.bincount(b, minlength=cells)
        mean = np.bincount(b, p, cells) / np.maximum(n, 1)
        return {"cell": np.arange(cells, dtype=np.int32), "f": mid, "power": np.where(n > 0, mean, np.interp(mid, f, p))}

    return per_stream(df, keys, samp, value, kernel, "cell int, f double, power double")


def baseline_fit(df: DataFrame, keys: list[str], samp: str, value: str, freq: float, order: int) -> DataFrame:
    """(keys, amp, phase, rms) of a sine at ``freq`` (per sample) fitted together with a polynomial of an order."""
    from driftline.operators.spectral import per_stream

    def kernel(x: np.ndarray) -> dict:
        t = np.arange(len(x))
        u = 2 * t / max(len(x) - 1, 1) - 1
        basis = np.stack([np.cos(2 * np.pi * freq * t), np.sin(2 * np.pi * freq * t), *[u**k for k in range(order + 1)]], 1)
        c = np.linalg.lstsq(basis, x, rcond=None)[0]
        return {"amp": [float(np.hypot(c[0], c[1]))], "phase": [float(np.arctan2(c[1], c[0]))], "rms": [float(np.sqrt(np.mean((x - basis @ c) ** 2)))]}

    return per_stream(df, keys, samp, value, kernel, "amp double, phase double, rms double")


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with no curvature at its ends; straight on beyond them."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    low, mid, up, rhs = h.copy(), np.ones(n), h.copy(), np.zeros(n)
    mid[1:-1], rhs[1:-1] = 2 * (h[1:] + h[:-1]), 6 * np.diff(d)
    low[-1] = up[0] = 0.0
    for i in range(1, n):  # forward sweep of the tridiagonal system
        f = low[i - 1] / mid[i - 1]
        mid[i] -= f * (up[i - 1] if i < n else 0)
        rhs[i] -= f * rhs[i - 1]
    m = np.zeros(n)
    m[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        m[i] = (rhs[i] - up[i] * m[i + 1]) / mid[i]
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    inner = m[k] * a**3 / (6 * h[k]) + m[k + 1] * b**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
    left, right = d[0] - h[0] * m[1] / 6, d[-1] + h[-1] * m[-2] / 6
    return np.where(at < x[0], y[0] + left * (at - x[0]), np.where(at > x[-1], y[-1] + right * (at - x[-1]), inner))


def outliers_splined(df: DataFrame, keys: list[str], samp: str, value: str, lo: float = 0.03, hi: float = 0.97, margin: float = 0.5) -> DataFrame:
    """(keys, samp, x): values beyond the quantiles lo and hi by more than ``margin`` of their distance, put on a spline through the others."""
    from driftline.operators.spectral import per_stream

    def kernel(x: np.ndarray) -> dict:
        a, b = np.quantile(x, [lo, hi])
        bad = (x < a - margin * (b - a)) | (x > b + margin * (b - a))
        t = np.arange(len(x), dtype=float)
        y = np.where(bad, natural_spline(t[~bad], x[~bad], t), x) if bad.any() and (~bad).sum() > 1 else x
        return {"samp": t.astype(np.int32), "x": y}

    return per_stream(df, keys, samp, value, kernel, "samp int, x double")


def shifted(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """A small image moved by a fraction of pixels through its Fourier transform, periodic at its edges."""
    fy, fx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real


def without_common_mode(image: np.ndarray, scale: float, index: float, amp: float) -> np.ndarray:
    """A small image divided in Fourier space by amp u**index / (1 + u**index), u the wave number over ``scale``; the mean stays."""
    ky, kx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :]
    u = np.sqrt(ky**2 + kx**2) / scale
    gain = np.where(u > 0, amp * u**index / (1 + u**index), 1)
    return np.fft.ifft2(np.fft.fft2(image) / np.maximum(gain, 1e-6)).real
