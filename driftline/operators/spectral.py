"""Kernels over whole streams or whole observations: spectra, filters, glitches, modes, scans, fits.

A stream is one detector of one observation; a group that comes to Python is one stream, or all detectors of one
observation where the kernel needs them together. Neither grows with the number of observations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import shipped


LONGEST = 1 << 26  # samples of a stream that a kernel takes as a whole


def grid_size(samp: np.ndarray) -> int:
    """Samples from 0 to the last one; an error if that is more than a task can hold, as after a stray position."""
    n = int(samp.max()) + 1
    if n > LONGEST or int(samp.min()) < 0:
        raise ValueError(f"sample {int(samp.min()) if n <= LONGEST else n - 1} is outside a stream of at most {LONGEST} samples")
    return n


def on_grid(samp: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values on every sample from 0 to the last, absent and non-finite ones by linear interpolation."""
    ok = np.isfinite(x)
    n = grid_size(samp)
    return np.interp(np.arange(n), samp[ok], x[ok]) if ok.any() else np.zeros(n)


def per_stream(df: DataFrame, keys: list[str], samp: str, value: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``keys`` and the columns of ``kernel``, called with the values of each stream on its grid."""
    shipped(df.sparkSession)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        out = pd.DataFrame(kernel(on_grid(pdf["_s"].to_numpy(), pdf["_x"].to_numpy())))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    kinds = dict(df.dtypes)
    src = df.select(*keys, F.col(samp).alias("_s"), F.col(value).cast("double").alias("_x"))
    return src.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def per_observation(df: DataFrame, keys: list[str], det: str, samp: str, value: str, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``keys`` and the columns of ``kernel``, called with the detectors and the matrix (detector, sample) of each observation."""
    shipped(df.sparkSession)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dets = np.sort(pdf["_d"].unique())
        n = grid_size(pdf["_s"].to_numpy())
        m = np.full((len(dets), n), np.nan)
        m[np.searchsorted(dets, pdf["_d"]), pdf["_s"]] = pdf["_x"]
        m = np.array([np.interp(np.arange(n), np.flatnonzero(np.isfinite(r)), r[np.isfinite(r)]) if np.isfinite(r).any() else np.zeros(n) for r in m])
        out = pd.DataFrame(kernel(dets, m))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    kinds = dict(df.dtypes)
    src = df.select(*keys, F.col(det).alias("_d"), F.col(samp).alias("_s"), F.col(value).cast("double").alias("_x"))
    return src.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def fourier(df: DataFrame, keys: list[str], samp: str, value: str) -> DataFrame:
    """(keys, k, re, im): half spectrum of each real stream."""

    def kernel(x: np.ndarray) -> dict:
        f = np.fft.rfft(x)
        return {"k": np.arange(len(f), dtype=np.int32), "re": f.real, "im": f.imag}

    return per_stream(df, keys, samp, value, kernel, "k int, re double, im double")


def fourier_back(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, samp, x) of half spectra (k, re, im) of streams of ``n`` samples."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.fft.irfft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), int(pdf[n].iloc[0]))
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, "samp": np.arange(len(x), dtype=np.int32), "x": x})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", samp int, x double")


def trend(x: np.ndarray, ends: int) -> np.ndarray:
    """Line between the means of the first and last ``ends`` samples (a quarter of the stream at most)."""
    w = max(1, min(ends, len(x) // 4))
    a, b = x[:w].mean(), x[-w:].mean()
    return a + (b - a) * (np.arange(len(x)) - (w - 1) / 2) / max(len(x) - w, 1)


def filtered(x: np.ndarray, gain: Callable[[np.ndarray], np.ndarray], rate: float, tau: float = 0.0, deconvolve: bool = True, ends: int = 1000) -> np.ndarray:
    """x through a gain over frequency, with its trend taken off before and put back after; ``tau`` (de)convolves a time constant."""
    line = trend(x, ends)
    f = np.fft.rfftfreq(len(x), 1 / rate)
    g = gain(f).astype(complex)
    if tau:
        pole = 1 + 2j * np.pi * f * tau
        g = g * pole if deconvolve else g / pole
    return np.fft.irfft(np.fft.rfft(x - line) * g, len(x)) + line


def sine2_low(f: np.ndarray, fc: float, df: float) -> np.ndarray:
    return np.sin(np.pi / 2 * np.clip((fc + df / 2 - np.abs(f)) / df, 0, 1)) ** 2


def filter_streams(df: DataFrame, keys: list[str], samp: str, value: str, gain: Callable, rate: float, tau: float = 0.0) -> DataFrame:
    """(keys, samp, x): streams through ``filtered``."""

    def kernel(x: np.ndarray) -> dict:
        return {"samp": np.arange(len(x), dtype=np.int32), "x": filtered(x, gain, rate, tau)}

    return per_stream(df, keys, samp, value, kernel, "samp int, x double")


def glitch_ranges(x: np.ndarray, rate: float, sigmas: float = 10.0, high: float = 5.0, sigma_t: float = 0.003, apart: int = 30, buffer: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Ranges where the stream, high-passed and smoothed by a gaussian, exceeds ``sigmas`` robust deviations of its size.

    Glitches fewer than ``apart`` samples apart become one range; ranges are widened by ``buffer`` and merged. A first glitch within
    ``apart`` samples of the start reaches back to sample 1.
    """
    f = np.fft.rfftfreq(len(x), 1 / rate)
    g = (1 - sine2_low(f, high, 1.0)) * np.exp(-0.5 * (2 * np.pi * f * sigma_t) ** 2)
    y = np.abs(np.fft.irfft(np.fft.rfft(x - trend(x, 1000)) * g, len(x)))
    s = np.sort(y)
    n = len(s)
    hit = np.flatnonzero(y > sigmas * 0.741 * (s[3 * n // 4] - s[n // 4]))
    if not len(hit):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    first = np.flatnonzero(np.r_[True, np.diff(hit) >= apart])
    a, b = hit[first], hit[np.r_[first[1:] - 1, len(hit) - 1]] + 1
    if a[0] < apart:
        a[0] = min(a[0], 1)
    a, b = np.maximum(a - buffer, 0), np.minimum(b + buffer, n)
    new = np.flatnonzero(np.r_[True, a[1:] > np.maximum.accumulate(b)[:-1]])
    return a[new].astype(np.int32), np.maximum.reduceat(b, new).astype(np.int32)


def glitch_cuts(df: DataFrame, keys: list[str], samp: str, value: str, rate: float, sigmas: float = 10.0, high: float = 5.0, sigma_t: float = 0.003) -> DataFrame:
    """(keys, start, stop) of ``glitch_ranges``."""

    def kernel(x: np.ndarray) -> dict:
        a, b = glitch_ranges(x, rate, sigmas, high, sigma_t)
        return {"start": a, "stop": b}

    return per_stream(df, keys, samp, value, kernel, "start int, stop int")


def power_spectrum(x: np.ndarray, rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of half-overlapping sine windows of ``size`` samples (the whole stream if it is shorter)."""
    size = min(size, len(x))
    w = np.sin(np.pi * np.linspace(0, 1, size))
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    p = np.mean([np.abs(np.fft.rfft(w * (x[a : a + size] - x[a : a + size].mean()))) ** 2 for a in starts], axis=0)
    return np.fft.rfftfreq(size, 1 / rate), p * 2 / (rate * size * np.mean(w * w))


def spectra(df: DataFrame, keys: list[str], samp: str, value: str, rate: float, size: int, bins: int) -> DataFrame:
    """(keys, bin, f, power, n): power density in bins of equal ratios of frequency; empty bins are left out."""

    def kernel(x: np.ndarray) -> dict:
        f, p = power_spectrum(x, rate, size)
        f, p = f[1:], p[1:]
        edge = 10 ** np.linspace(np.log10(f[0]), np.log10(f[-1] * (1 + 1e-9)), bins + 1) if len(f) else np.zeros(1)
        b = np.digitize(f, edge) - 1
        n = np.bincount(b, minlength=bins) if len(f) else np.zeros(0)
        keep = np.flatnonzero(n)
        return {"bin": keep.astype(np.int32), "f": np.bincount(b, f, bins)[keep] / n[keep], "power": np.bincount(b, p, bins)[keep] / n[keep], "n": n[keep].astype(np.int64)}

    return per_stream(df, keys, samp, value, kernel, "bin int, f double, power double, n long")


def taper(n: int, window: str) -> np.ndarray:
    """Weights of a section of n samples: ``bartlett``, ``hann``, ``welch`` or ``none``."""
    u = np.arange(n)
    if window == "bartlett":
        return 1 - np.abs(u - n / 2) / (n / 2)
    if window == "hann":
        return 0.5 * (1 - np.cos(2 * np.pi * u / n))
    if window == "welch":
        return 1 - ((u - n / 2) / (n / 2)) ** 2
    if window == "none":
        return np.ones(n)
    raise ValueError(window)


def section_power(x: np.ndarray, dt: float, sections: int = 1, window: str = "none", padded: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power per Hz, the mean over 2 * sections - 1 half-overlapping sections, each detrended and tapered.

    ``padded``: length of the transform, if longer than a section. The lowest frequency is given as half of the next.
    """
    size = len(x) // sections
    if size < 1:
        raise ValueError(f"{sections} sections of {len(x)} samples")
    w, n = taper(size, window), max(size, padded)
    parts = [x[b * size // 2 : b * size // 2 + size] for b in range(2 * sections - 1)]
    p = sum(np.abs(np.fft.rfft(w * (y - trend(y, 200)), n)) ** 2 for y in parts)
    f = np.arange(len(p)) / len(p) / (2 * dt)
    if len(f) > 1:
        f[0] = f[1] / 2
    return f, p * 2 / len(parts) / w.sum() ** 2 * n * dt


def section_spectra(df: DataFrame, keys: list[str], samp: str, value: str, dt: float, sections: int, window: str) -> DataFrame:
    """(keys, k, f, power) of ``section_power``; streams of fewer than 8 samples have none."""

    def kernel(x: np.ndarray) -> dict:
        f, p = section_power(x, dt, sections, window) if len(x) >= 8 else (np.zeros(0), np.zeros(0))
        return {"k": np.arange(len(f), dtype=np.int32), "f": f, "power": p}

    return per_stream(df, keys, samp, value, kernel, "k int, f double, power double")


def without_polynomial(df: DataFrame, keys: list[str], samp: str, value: str, order: int) -> DataFrame:
    """(keys, samp, x): streams less the polynomial of an order fitted to them."""

    def kernel(x: np.ndarray) -> dict:
        t = np.arange(len(x))
        basis = np.vander(2 * t / max(len(x) - 1, 1) - 1, order + 1)
        return {"samp": t.astype(np.int32), "x": x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]}

    return per_stream(df, keys, samp, value, kernel, "samp int, x double")


def without_block_mode(df: DataFrame, keys: list[str], det: str, samp: str, value: str, block: int) -> DataFrame:
    """``df`` less the common mode (mean over the detectors) times each detector's own factor in every block of samples."""
    common = Window.partitionBy(*keys, samp)
    own = Window.partitionBy(*keys, det, "_blk")
    rows = df.withColumn("_m", F.avg(value).over(common)).withColumn("_blk", F.floor(F.col(samp) / block))
    k = F.sum(F.col(value) * F.col("_m")).over(own) / F.nullif(F.sum(F.col("_m") * F.col("_m")).over(own), F.lit(0.0))
    return rows.withColumn("_k", F.coalesce(k, F.lit(0.0))).withColumn(value, F.col(value) - F.col("_k") * F.col("_m")).drop("_m", "_blk", "_k")


def appended(modes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Orthonormal modes (rows) with ``new`` as one more, less its parts along the others; one that has nothing of its own is left out."""
    own = new - modes.T @ (modes @ new) if len(modes) else new.astype(float)
    own = own - modes.T @ (modes @ own) if len(modes) else own  # a second time, against rounding
    size = np.sqrt(own @ own)
    return np.vstack([modes, own / size]) if size > 1e-10 * max(np.sqrt(new @ new), 1e-300) else modes


def cross_spectra(df: DataFrame, keys: list[str], det: str, samp: str, value: str, rate: float) -> DataFrame:
    """(keys, det, k, f, coherence): coherence of each detector with the mean of the others over 8 stretches."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        size = m.shape[1] // 8
        if size < 4 or len(dets) < 2:
            return {"det": np.zeros(0, np.int32), "k": np.zeros(0, np.int32), "f": np.zeros(0), "coherence": np.zeros(0)}
        w = np.sin(np.pi * np.linspace(0, 1, size))
        s = np.fft.rfft(w * (c := m[:, : size * 8].reshape(len(m), 8, size) - m[:, : size * 8].reshape(len(m), 8, size).mean(2, keepdims=True)), axis=2)
        del c
        rest = (s.sum(0) - s) / (len(m) - 1)
        cross = np.abs((s * rest.conj()).mean(1)) ** 2
        coh = cross / np.maximum((np.abs(s) ** 2).mean(1) * (np.abs(rest) ** 2).mean(1), 1e-300)
        nf = coh.shape[1]
        return {"det": np.repeat(dets, nf).astype(np.int32), "k": np.tile(np.arange(nf, dtype=np.int32), len(m)), "f": np.tile(np.fft.rfftfreq(size, 1 / rate), len(m)), "coherence": coh.ravel()}

    return per_observation(df, keys, det, samp, value, kernel, "det int, k int, f double, coherence double")


def principal_modes(m: np.ndarray, n_modes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (largest first, NaN as 0), weights (detector, mode) and modes (mode, sample) of the covariance of the rows.

    The sign of a mode is that for which its largest weight is positive.
    """
    c = m - m.mean(1, keepdims=True)
    e, r = np.linalg.eigh(np.nan_to_num(c @ c.T / max(m.shape[1] - 1, 1)))
    o = np.argsort(-e)[:n_modes]
    r = r[:, o] * np.sign(r[np.abs(r[:, o]).argmax(0), o])
    return np.nan_to_num(e[o]), r, r.T @ c


def modes_of(df: DataFrame, keys: list[str], det: str, samp: str, value: str, n_modes: int) -> DataFrame:
    """(keys, det, mode, share, weight) of the principal modes of each observation; share is that of all variance."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        e, r, _ = principal_modes(m, min(n_modes, len(dets)))
        total = max(float(np.nan_to_num(m.var(1, ddof=1 if m.shape[1] > 1 else 0)).sum()), 1e-300)
        k = len(e)
        return {"det": np.repeat(dets, k).astype(np.int32), "mode": np.tile(np.arange(k, dtype=np.int32), len(dets)), "share": np.tile(e / total, len(dets)), "weight": r.ravel()}

    return per_observation(df, keys, det, samp, value, kernel, "det int, mode int, share double, weight double")


def without_modes(df: DataFrame, keys: list[str], det: str, samp: str, value: str, n_modes: int) -> DataFrame:
    """(keys, det, samp, x): streams less their part in the principal modes."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        _, r, t = principal_modes(m, min(n_modes, len(dets)))
        y = m - r @ t
        n = m.shape[1]
        return {"det": np.repeat(dets, n).astype(np.int32), "samp": np.tile(np.arange(n, dtype=np.int32), len(dets)), "x": y.ravel()}

    return per_observation(df, keys, det, samp, value, kernel, "det int, samp int, x double")


def common_mode(m: np.ndarray, median: bool = False) -> np.ndarray:
    c = m - m.mean(1, keepdims=True)
    return np.sort(c, axis=0)[len(c) // 2] if median else c.mean(0)


def preselect(df: DataFrame, keys: list[str], det: str, samp: str, value: str, norm: float = 4.0, corr: float = 0.5) -> DataFrame:
    """(keys, det, ratio, corr, ok): detectors whose size is within a factor of the median one and that follow the median common mode."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        c = m - m.mean(1, keepdims=True)
        size = np.sqrt((c * c).mean(1))
        good = size > 0
        mid = np.sort(size[good])[good.sum() // 2] if good.any() else 1.0
        ratio = size / mid
        near = good & (ratio < norm) & (ratio > 1 / norm)
        cm = common_mode(c[near], median=True) if near.any() else np.zeros(m.shape[1])
        den = size * np.sqrt((cm * cm).mean())
        r = np.where(den > 0, (c * cm).mean(1) / np.where(den > 0, den, 1), 0)
        return {"det": dets.astype(np.int32), "ratio": ratio, "corr": r, "ok": near & (r >= corr)}

    return per_observation(df, keys, det, samp, value, kernel, "det int, ratio double, corr double, ok boolean")


def drift_tests(df: DataFrame, keys: list[str], det: str, samp: str, value: str, low: int = 16, blocks: int = 3) -> DataFrame:
    """(keys, det, gain, corr, drift): gain and correlation with the common mode and relative residual over the lowest frequencies.

    The common mode and the ``blocks`` leading modes of the residual are taken off in turn.
    """

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        s = np.fft.rfft(np.array([r - trend(r, 1000) for r in m]), axis=1)[:, 1 : low + 1]
        c = np.concatenate([s.real, s.imag], 1)
        cm = c.mean(0)
        g = c @ cm / max(float(cm @ cm), 1e-300)
        size = np.sqrt((c * c).sum(1))
        corr = np.where(size > 0, c @ cm / np.maximum(size * np.sqrt(cm @ cm), 1e-300), 0)
        rest = c - g[:, None] * cm
        u, w, v = np.linalg.svd(rest, full_matrices=False)
        k = min(blocks, len(w))
        rest = rest - (u[:, :k] * w[:k]) @ v[:k]
        return {"det": dets.astype(np.int32), "gain": g, "corr": corr, "drift": np.sqrt((rest * rest).sum(1)) / np.maximum(size, 1e-300)}

    return per_observation(df, keys, det, samp, value, kernel, "det int, gain double, corr double, drift double")


def band_statistics(df: DataFrame, keys: list[str], det: str, samp: str, value: str, rate: float, bands: list[tuple[float, float]]) -> DataFrame:
    """(keys, det, band, noise, corr): root mean power in each band [lo, hi) and correlation with the common mode there."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        f = np.fft.rfftfreq(m.shape[1], 1 / rate)
        s = np.fft.rfft(np.array([r - trend(r, 1000) for r in m]), axis=1)
        out: dict[str, list] = {"det": [], "band": [], "noise": [], "corr": []}
        for b, (lo, hi) in enumerate(bands):
            t = s[:, (f >= lo) & (f < hi)]
            if not t.shape[1]:
                continue
            cm = t.mean(0)
            size = np.sqrt((np.abs(t) ** 2).sum(1))
            out["det"] += dets.tolist()
            out["band"] += [b] * len(dets)
            out["noise"] += (size / np.sqrt(t.shape[1] * m.shape[1] * rate)).tolist()
            out["corr"] += ((t * cm.conj()).sum(1).real / np.maximum(size * np.sqrt((np.abs(cm) ** 2).sum()), 1e-300)).tolist()
        return {k: np.array(v, np.int32 if k in ("det", "band") else float) for k, v in out.items()}

    return per_observation(df, keys, det, samp, value, kernel, "det int, band int, noise double, corr double")


def scan_summary(df: DataFrame, keys: list[str], samp: str, value: str, rate: float) -> DataFrame:
    """(keys, lo, hi, speed, period, n_turns, status) of a scan: limits, median speed, period from its turn-arounds.

    A turn is where the smoothed speed changes sign by more than a tenth of its median. status: 0 good, 1 too short, 2 no motion, 3 no
    turns, 4 irregular turns, 5 one turn.
    """

    def kernel(x: np.ndarray) -> dict:
        if len(x) < 16:
            row = (float(x.min()), float(x.max()), 0.0, 0.0, 0, 1)
        else:
            v = np.convolve(np.gradient(x), np.ones(5) / 5, "same")
            speed = float(np.median(np.abs(v)))
            strong = np.flatnonzero(np.abs(v) > speed / 10 * (1 + 1e-9))  # a speed that is just a tenth, but for rounding, is none
            sign = np.sign(v[strong])
            turns = strong[1:][sign[1:] != sign[:-1]]
            gaps = np.diff(turns)
            period = 2 * float(np.median(gaps)) / rate if len(gaps) else 0.0
            status = 2 if speed == 0 else 3 if not len(turns) else 5 if len(turns) == 1 else 4 if gaps.std() > 0.5 * gaps.mean() else 0
            row = (float(np.quantile(x, 0.01)), float(np.quantile(x, 0.99)), speed * rate, period, len(turns), status)
        return {k: np.array([v]) for k, v in zip(("lo", "hi", "speed", "period", "n_turns", "status"), row)}

    return per_stream(df, keys, samp, value, kernel, "lo double, hi double, speed double, period double, n_turns int, status int")


def harmonics(df: DataFrame, keys: list[str], samp: str, value: str, turn: float, n: int) -> DataFrame:
    """(keys, harmonic, cos, sin): least-squares amplitudes of the first ``n`` harmonics of an angle that turns once in ``turn`` samples."""

    def kernel(x: np.ndarray) -> dict:
        a = 2 * np.pi * np.arange(len(x)) / turn
        basis = np.stack([f(h * a) for h in range(1, n + 1) for f in (np.cos, np.sin)] + [np.ones(len(x))])
        c = np.linalg.lstsq(basis.T, x, rcond=None)[0]
        return {"harmonic": np.arange(1, n + 1, dtype=np.int32), "cos": c[0 : 2 * n : 2], "sin": c[1 : 2 * n : 2]}

    return per_stream(df, keys, samp, value, kernel, "harmonic int, cos double, sin double")


def least_squares(model: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, x: np.ndarray, y: np.ndarray, free: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Parameters that fit ``model(p, x)`` to y by damped Gauss-Newton steps; those not ``free`` stay."""
    return least_squares_each(lambda p, _: model(p[:, 0, 0], x)[None], np.array(start, float)[None], y[None], y[None], free, rounds)[0]


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many systems, and which of them have one."""
    try:
        return np.linalg.solve(a, b), np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.zeros_like(b), np.zeros(1, bool)
    half = len(a) // 2
    return tuple(np.concatenate(v) for v in zip(_solved(a[:half], b[:half]), _solved(a[half:], b[half:])))


def least_squares_each(model: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, x: np.ndarray, y: np.ndarray, free: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """``least_squares`` of many fits, each by itself: start, x and y have a row for each, ``model`` gets parameters as (parameter, fit, 1).

    A step that has no solution counts as one that doesn't help: the place, height and width of a peak of one reading can't be told
    apart but for the damping, which is raised.
    """
    p = np.array(start, float)
    f = np.flatnonzero(np.ones(p.shape[1], bool) if free is None else free)
    at = lambda q, t: model(np.ascontiguousarray(q.T)[:, :, None], t)
    size = lambda v: np.matmul(v[:, None, :], v[:, :, None])[:, 0, 0]
    a, b, d, damp, now = np.empty((len(p), len(f), len(f))), np.empty((len(p), len(f), 1)), np.arange(len(f)), np.full(len(p), 1e-3), at(p, x)
    r = y - now
    live = moved = np.arange(len(p))
    for _ in range(rounds):
        if len(moved):
            h = 1e-6 * np.maximum(np.abs(p[moved][:, f]), 1e-3)
            j = np.stack([(at(p[moved] + h[:, [i]] * (np.arange(p.shape[1]) == k), x[moved]) - now[moved]) / h[:, [i]] for i, k in enumerate(f)], 2)
            jt = j.transpose(0, 2, 1)
            a[moved], b[moved] = jt @ j, jt @ r[moved][:, :, None]
        m = a[live]
        m[:, d, d] += damp[live][:, None] * (m[:, d, d] + 1e-12)
        step, ok = _solved(m, b[live])
        q = p[live]
        q[:, f] += step[:, :, 0]
        there = at(q, x[live])
        new = y[live] - there
        was, left = size(r[live]), size(new)
        better = ok & (left < was)
        done = better & (was - left < 1e-14 * was)
        moved, lost = live[better], live[~better]
        p[moved], now[moved], r[moved] = q[better], there[better], new[better]
        damp[moved] /= 3
        damp[lost] *= 5
        moved = live[better & ~done]
        live = live[~done & (better | (damp[live] <= 1e8))]
        if not len(live):
            break
    return p


def metropolis(log_p: Callable[[np.ndarray], float], start: np.ndarray, scale: np.ndarray, steps: int, seed: int = 0) -> np.ndarray:
    """Chain of parameter vectors with density exp(log_p)."""
    rng, p = np.random.default_rng(seed), np.array(start, float)
    now, chain = log_p(p), []
    for _ in range(steps):
        q = p + rng.normal(size=len(p)) * scale
        new = log_p(q)
        if np.log(rng.random()) < new - now:
            p, now = q, new
        chain.append(p)
    return np.array(chain)


def fit_peaks(df: DataFrame, keys: list[str], samp: str, value: str, many: int = 1000) -> DataFrame:
    """(keys, at, height, sigma, snr): gaussian fitted around the largest excursion of each stream; peaks in the outer 5 % have snr 0.

    A task sorts its streams and fits ``many`` of them at once, each by itself.
    """
    shipped(df.sparkSession)
    gauss = lambda p, t: p[0] * np.exp(-0.5 * ((t - p[1]) / p[2]) ** 2)

    def peak(x: np.ndarray) -> tuple:
        """Place and readings around the peak, signal per noise of a peak of height 1."""
        n = len(x)
        edge = np.clip(np.minimum(np.arange(n), n - 1 - np.arange(n)) / max(1, n // 10), 0, 1)
        y = (x - np.median(x)) * edge
        k = int(np.abs(y).argmax())
        i = np.arange(max(0, k - 15), min(n, k + 16))
        noise = 1.4826 * np.median(np.abs(np.diff(x))) / 2**0.5 if n > 1 else 0.0
        return k, y[k], i.astype(float), y[i], noise if 0.05 * n <= k <= 0.95 * n else 0.0

    def fits(peaks: list[tuple]) -> list[np.ndarray]:
        p = np.empty((len(peaks), 3))
        width = np.array([len(v[2]) for v in peaks])
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            start = np.array([(peaks[i][1], peaks[i][0], 3.0) for i in own], float)
            p[own] = least_squares_each(gauss, start, np.array([peaks[i][2] for i in own]), np.array([peaks[i][3] for i in own]))
        noise = np.array([v[4] for v in peaks])
        snr = np.divide(np.abs(p[:, 0]), noise, out=np.zeros(len(p)), where=noise > 0)
        return [p[:, 1], p[:, 0], np.abs(p[:, 2]), snr]

    def run(batches):
        heads, peaks, parts = [], [], []  # keys of the streams that are here, their peaks, what there is of the last stream

        def whole() -> None:
            if parts:
                peaks.append(peak(on_grid(*(np.concatenate(v) for v in zip(*parts)))))
                parts.clear()

        def fitted() -> list:
            t = pa.concat_tables(heads)
            out = t.slice(0, len(peaks)).combine_chunks()
            for name, v in zip(("at", "height", "sigma", "snr"), fits(peaks)):
                out = out.append_column(name, pa.array(v))
            heads[:] = [t.slice(len(peaks))]
            peaks.clear()
            return out.to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            s, x, place = (t[c].to_numpy() for c in ("_s", "_x", "_n"))
            first = np.flatnonzero(place == 1)
            heads.append(t.select(keys).take(pa.array(first)))
            for lo, hi in zip([0, *first], [*first, len(s)]):
                if hi == lo:
                    continue
                if place[lo] == 1:
                    whole()
                parts.append((s[lo:hi], x[lo:hi]))
            if len(peaks) >= many:
                yield from fitted()
        whole()
        if peaks:
            yield from fitted()

    kinds = dict(df.dtypes)
    src = df.select(*keys, F.col(samp).alias("_s"), F.col(value).cast("double").alias("_x"))
    src = src.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_s")))
    return src.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", at double, height double, sigma double, snr double")


def biquad_response(f: np.ndarray, rate: float, b: tuple[float, float, float, float]) -> np.ndarray:
    """Complex response of the two-stage filter of ``functions.physics.biquad_gain``."""
    z = np.exp(-2j * np.pi * f / rate)
    stage = lambda p, q: (1 + z) ** 2 / (1 - p * z + q * z * z) * (1 - p + q) / 4
    return stage(b[0], b[1]) * stage(b[2], b[3])


def fir_filtered(x: np.ndarray, rate: float, b: tuple[float, float, float, float], taps: int = 128) -> np.ndarray:
    """x through the filter's impulse response of ``taps`` samples scaled to gain 1 at 0; before its first value x is taken to be at rest."""
    h = np.fft.irfft(biquad_response(np.fft.rfftfreq(1 << 14, 1 / rate), rate, b), 1 << 14)[:taps]
    wide = np.concatenate([np.full(taps - 1, x[0]), x])
    return np.convolve(wide, h / h.sum(), "valid")


def biquad_filter(x: np.ndarray, b: tuple[float, float, float, float]) -> np.ndarray:
    """x through the same filter in time, starting from its first value at rest.

    The recurrence y[i] = u[i] + p y[i - 1] - q y[i - 2] goes by blocks: a block is its own part through the impulse response, a triangular
    matrix, and what the last two values before it still do.
    """
    size = 256
    for p, q in ((b[0], b[1]), (b[2], b[3])):
        wide = np.concatenate([[x[0], x[0]], x])
        u = (1 - p + q) / 4 * (wide[2:] + 2 * wide[1:-1] + wide[:-2])
        h = np.zeros(size + 1)  # impulse response
        h[0], h[1] = 1.0, p
        for i in range(2, size + 1):
            h[i] = p * h[i - 1] - q * h[i - 2]
        lag = np.arange(size)[:, None] - np.arange(size)[None, :]
        own = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)
        y, y1, y2 = np.empty(len(x)), x[0], x[0]
        for a in range(0, len(x), size):
            n = min(size, len(x) - a)
            y[a : a + n] = own[:n, :n] @ u[a : a + n] + h[1 : n + 1] * y1 - q * h[:n] * y2
            y1, y2 = y[a + n - 1], y[a + n - 2] if n > 1 else y1
        x = y
    return x
