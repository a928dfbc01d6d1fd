"""Analyses of detectors by their spectra: common mode at low frequencies in several windows, noise at high ones, groups of detectors.

A kernel holds the spectra of one observation, whose number of detectors and samples doesn't grow with the season.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.spectral import per_observation, trend


def harmonic_bins(lo: int, hi: int, df: float, scan: float, wide: bool = False) -> np.ndarray:
    """Places in [lo, hi), counted from lo, of the bins of a scan's harmonics; with ``wide`` also of those beside them."""
    h = np.arange(1, int(np.ceil(hi * df / scan)) + 1) * scan / df
    i = np.sort(np.concatenate([np.floor(h + d + 0.5) for d in ((-1, 0, 1) if wide else (0,))])).astype(int)
    return i[(i >= lo) & (i < hi)] - lo


def edge_taper(n: int, edge: int) -> np.ndarray:
    """1 with squared sines over an ``edge``-th of n at both ends."""
    w = max(1, n // edge)
    t = np.ones(n)
    t[:w] = np.sin(np.pi / 2 * (np.arange(w) + 0.5) / w) ** 2
    t[n - w :] = t[:w][::-1]
    return t


def spectrum_modes(c: np.ndarray, n: int) -> np.ndarray:
    """The n leading orthonormal modes (mode, bin) of complex spectra (detector, bin)."""
    if not len(c) or not n:
        return np.zeros((0, c.shape[1]), complex)
    return np.linalg.svd(c, full_matrices=False)[2][:n]


def without(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Spectra less their parts along orthonormal modes."""
    return c - (c @ modes.conj().T) @ modes if len(modes) else c


def correlations(c: np.ndarray) -> np.ndarray:
    """Real correlation of every two spectra; 0 for those without power."""
    size = np.sqrt((np.abs(c) ** 2).sum(1))
    u = c / np.where(size > 0, size, 1)[:, None]
    return (u @ u.conj().T).real


def selected(cc: np.ndarray, least: float, fallback: float, few: int) -> np.ndarray:
    """Detectors whose median size of correlation with all exceeds ``least``; ``fallback`` where that leaves fewer than ``few``."""
    mid = np.median(np.abs(cc), axis=0)
    good = mid > least
    return good if good.sum() >= few else mid > fallback


def detector_groups(cc: np.ndarray, first: float = 0.99, least: float = 0.8, step: float = 0.005, few: int = 2, most: int = 5) -> np.ndarray:
    """Group of each detector by correlation: the one with most partners above a falling threshold and its partners above ``least`` are a group.

    The last group holds what is left once ``most`` - 1 groups are made or fewer than ``few`` detectors remain.
    """
    group, g, limit = np.full(len(cc), -1), 0, first
    while (group < 0).any():
        rest = np.flatnonzero(group < 0)
        if len(rest) <= few or g >= most - 1:
            group[rest] = g
            break
        near = np.abs(cc[np.ix_(rest, rest)])
        n = (near > limit).sum(0)
        best = int(n.argmax())
        if n[best] < min(few, max(len(rest) // 2, 1)) and limit > step:
            limit -= step
            continue
        own = rest[near[best] > min(least, limit)]
        group[own if len(own) else rest[best : best + 1]] = g
        g += 1
    return group


def low_frequency(df: DataFrame, keys: list[str], det: str, samp: str, value: str, rate: float, windows: list[tuple[float, float]], least: float = 0.6, fallback: float = 0.3, few: int = 2, leading: bool = True, dark: str | None = None, dark_modes: int = 2, tapered: bool = False) -> DataFrame:
    """(keys, det, window, preselected, gain, corr, norm, ratio): each detector against the common mode in windows [lo, hi) of frequency.

    The common mode is the leading mode (or, unless ``leading``, the mean) of the preselected detectors (``selected``). gain and corr are those of the
    detector on it, norm its size, ratio what is left of that once the ``dark_modes`` modes of the detectors where ``dark`` (a boolean column) are
    taken off; 1 without any. A window has 16 bins at least. Without preselected detectors gain and corr are 0.
    """
    source = df
    if dark is not None:  # the kernel gets the mark in the sign of the detector's number
        source = df.withColumn(det, F.when(F.col(dark), -F.col(det) - 1).otherwise(F.col(det)))

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        s = np.fft.rfft(np.array([r - trend(r, 1000) for r in m]), axis=1)
        n, is_dark = m.shape[1], dets < 0
        names = np.where(is_dark, -dets - 1, dets) if dark is not None else dets
        out: dict[str, list] = {k: [] for k in ("det", "window", "preselected", "gain", "corr", "norm", "ratio")}
        for w, (lo, hi) in enumerate(windows):
            a = int(np.floor(lo * n / rate + 0.5))
            b = min(max(int(np.floor(hi * n / rate + 0.5)), a + 16), s.shape[1])
            c = s[:, a:b]
            if c.shape[1] < 2:
                continue
            c = c * edge_taper(c.shape[1], 6) if tapered else c
            size = np.sqrt((np.abs(c) ** 2).sum(1))
            ratio = np.ones(len(c))
            if dark is not None and is_dark.any():
                c = without(c, spectrum_modes(c[is_dark], dark_modes))
                ratio = np.sqrt((np.abs(c) ** 2).sum(1)) / np.where(size > 0, size, 1)
            live = ~is_dark if dark is not None else np.ones(len(c), bool)
            norm = np.sqrt((np.abs(c) ** 2).sum(1))
            pre = np.zeros(len(c), bool)
            pre[live] = selected(correlations(c[live]), least, fallback, few) & (norm[live] > 0) if live.any() else False
            gain, corr = np.zeros(len(c)), np.zeros(len(c))
            if pre.any():
                mode = c[pre].mean(0)
                if leading:
                    top = spectrum_modes(c[pre], 1)[0]
                    mode = top * (c[pre] @ top.conj()).mean()
                p = (np.abs(mode) ** 2).sum()
                dot = (c @ mode.conj()).real
                gain, corr = dot / max(p, 1e-300), dot / np.maximum(norm * np.sqrt(p), 1e-300)
            for k, v in (("det", names), ("window", np.full(len(c), w)), ("preselected", pre), ("gain", gain), ("corr", corr), ("norm", norm), ("ratio", ratio)):
                out[k] += v.tolist()
        return {k: np.array(v, {"det": np.int32, "window": np.int32, "preselected": bool}.get(k, float)) for k, v in out.items()}

    return per_observation(source, keys, det, samp, value, kernel, "det int, window int, preselected boolean, gain double, corr double, norm double, ratio double")


def over_windows(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, det, preselected, gain, corr, norm, ratio) of ``low_frequency`` over all windows.

    Preselected are detectors that are so at least half as often as the one that is most often. In each window the sizes of the gains are scaled to mean 1 over
    those of them that are preselected there; gain, norm and ratio are means over the windows in which the detector is preselected, corr its largest there.
    """
    from pyspark.sql import Window

    by_det, whole, in_window = Window.partitionBy(*keys, "det"), Window.partitionBy(*keys), Window.partitionBy(*keys, "window")
    rows = found.withColumn("_n", F.sum(F.col("preselected").cast("int")).over(by_det))
    rows = rows.withColumn("_half", (F.col("_n") > 0) & (2 * F.col("_n") >= F.max("_n").over(whole)))
    scale = F.avg(F.when(F.col("_half") & F.col("preselected"), F.abs("gain"))).over(in_window)
    rows = rows.withColumn("_g", F.abs("gain") / scale)
    own = lambda c: F.when(F.col("preselected"), F.col(c))
    return rows.groupBy(*keys, "det").agg(F.first("_half").alias("preselected"), F.avg(own("_g")).alias("gain"), F.max(own("corr")).alias("corr"), F.avg(own("norm")).alias("norm"), F.avg(own("ratio")).alias("ratio"))


def high_frequency(df: DataFrame, keys: list[str], det: str, samp: str, value: str, rate: float, band: tuple[float, float], modes: int = 0) -> DataFrame:
    """(keys, det, rms, skew, kurt): noise in a band [lo, hi) once its leading ``modes`` are taken off, with the moments of it in time."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        n = m.shape[1]
        s = np.fft.rfft(np.array([r - trend(r, 1000) for r in m]), axis=1)
        f = np.fft.rfftfreq(n, 1 / rate)
        inside = (f >= band[0]) & (f < band[1])
        c = without(s[:, inside], spectrum_modes(s[:, inside], modes))
        wide = np.zeros_like(s)
        wide[:, inside] = c
        y = np.fft.irfft(wide, n, axis=1)
        y = y - y.mean(1, keepdims=True)
        v = (y * y).mean(1)
        ok = v > 0
        safe = np.where(ok, v, 1)
        return {"det": dets.astype(np.int32), "rms": np.sqrt((np.abs(c) ** 2).sum(1) / max(inside.sum(), 1) / n), "skew": np.where(ok, (y**3).mean(1) / safe**1.5, 0), "kurt": np.where(ok, (y**4).mean(1) / safe**2, 0)}

    return per_observation(df, keys, det, samp, value, kernel, "det int, rms double, skew double, kurt double")


def grouped_detectors(df: DataFrame, keys: list[str], det: str, samp: str, value: str, rate: float, band: tuple[float, float], few: int = 2, most: int = 5) -> DataFrame:
    """(keys, det, group) of ``detector_groups`` by the correlation in a band."""

    def kernel(dets: np.ndarray, m: np.ndarray) -> dict:
        s = np.fft.rfft(np.array([r - trend(r, 1000) for r in m]), axis=1)
        f = np.fft.rfftfreq(m.shape[1], 1 / rate)
        return {"det": dets.astype(np.int32), "group": detector_groups(correlations(s[:, (f >= band[0]) & (f < band[1])]), few=few, most=most).astype(np.int32)}

    return per_observation(df, keys, det, samp, value, kernel, "det int, group int")


def drift_of(c: np.ndarray, live: np.ndarray, dark: np.ndarray, blocks: np.ndarray, temperature: np.ndarray | None, modes: int) -> dict[str, np.ndarray]:
    """Gain, correlation, norm and drift of streams (detector, sample) without their means.

    The temperature, if it moves, and then the common mode of the dark detectors are fitted to every stream and taken off; gain and correlation are those
    on the common mode of the live ones. drift is the size of what is left without it and without the leading ``modes`` of the block means of the
    rest (blocks < 0 have no part), relative to the norm.
    """
    for mode in ([temperature - temperature.mean()] if temperature is not None else []) + ([c[dark].mean(0)] if dark.any() else []):
        p = mode @ mode
        if p > 1e-12 * max(float((c * c).sum()), 1e-300):
            c = c - np.outer(c @ mode / p, mode)
    norm = np.sqrt((c * c).mean(1))
    cm = c[live].mean(0) if live.any() else np.zeros(c.shape[1])
    p = cm @ cm
    gain = c @ cm / p if p > 0 else np.zeros(len(c))
    corr = gain * np.sqrt(p / c.shape[1]) / np.where(norm > 0, norm, 1)
    rest = c - np.outer(gain, cm)
    own = [rest[live & (blocks == b)].sum(0) for b in np.unique(blocks[live & (blocks >= 0)])]
    if own and modes:
        u = np.linalg.svd(np.array(own), full_matrices=False)[2][: min(modes, len(own))]
        rest = rest - (rest @ u.T) @ u
    return {"gain": gain, "corr": corr, "norm": norm, "drift": np.sqrt((rest * rest).mean(1)) / np.where(norm > 0, norm, 1)}


def drift_analysis(df: DataFrame, keys: list[str], det: str, samp: str, value: str, step: int, modes: int = 0, live: str | None = None, dark: str | None = None, block: str | None = None, temperature: str | None = None) -> DataFrame:
    """(keys, det, gain, corr, norm, drift) of ``drift_of`` for streams averaged over ``step`` samples (a last part is dropped).

    ``live`` and ``dark`` are boolean columns of detectors, ``block`` one of whole numbers (none: one block), ``temperature`` a column of samples. Absent
    samples are interpolated. Without ``live`` all detectors that aren't dark are.
    """
    from driftline.operators.spectral import grid_size
    from driftline.session import shipped

    import pandas as pd

    shipped(df.sparkSession)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dets = np.sort(pdf["_d"].unique())
        n = grid_size(pdf["_s"].to_numpy())
        m = np.full((len(dets), n), np.nan)
        m[np.searchsorted(dets, pdf["_d"]), pdf["_s"]] = pdf["_x"]
        grid = np.arange(n)
        fill = lambda r: np.interp(grid, np.flatnonzero(np.isfinite(r)), r[np.isfinite(r)]) if np.isfinite(r).any() else np.zeros(n)
        thin = lambda a: a[..., : n // step * step].reshape(*a.shape[:-1], -1, step).mean(-1)
        c = thin(np.array([fill(r) for r in m]))
        if not c.shape[1]:
            return pd.DataFrame({**{k: [] for k in keys}, "det": [], "gain": [], "corr": [], "norm": [], "drift": []})
        per = pdf.groupby("_d").first()
        t = None
        if temperature is not None:
            row = np.full(n, np.nan)
            row[pdf["_s"]] = pdf["_temp"]
            t = thin(fill(row))
        is_dark = per["_dark"].to_numpy(bool)
        got = drift_of(c - c.mean(1, keepdims=True), per["_live"].to_numpy(bool) & ~is_dark, is_dark, per["_blk"].to_numpy(int), t, modes)
        return pd.DataFrame({**dict(zip(keys, key)), "det": dets.astype(np.int32), **got})

    kinds = dict(df.dtypes)
    mark = lambda c, default: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(default)
    src = df.select(*keys, F.col(det).alias("_d"), F.col(samp).alias("_s"), F.col(value).cast("double").alias("_x"), mark(live, True).alias("_live"), mark(dark, False).alias("_dark"), (F.coalesce(F.col(block), F.lit(-1)) if block else F.lit(0)).alias("_blk"), (F.col(temperature) if temperature else F.lit(0)).cast("double").alias("_temp"))
    return src.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", det int, gain double, corr double, norm double, drift double")


def light_and_dark(df: DataFrame, keys: list[str], det: str, samp: str, value: str, cal: str, light: str, dark: str, sigmas: float = 3.0) -> DataFrame:
    """(keys, det, p_light, p_dark, member, recal): part of each detector in the light and the dark mode of its observation.

    The light mode is the mean of the calibrated streams of ``light`` detectors, the dark one that of the ``dark`` ones as they are. Parts are those of a fit to
    each mode alone, the light one of the calibrated stream. A detector is a member of the mode of whose candidates' robust centre its part is within
    ``sigmas`` deviations (light first), else of none; recal is the calibration over the part in the light mode for members of it, else 0.
    """
    from driftline.operators.stats import medsig

    x, y = F.col(value) * F.col(cal), F.col(value)
    w = [*keys, samp]
    mode = df.groupBy(*w).agg(F.avg(F.when(F.col(light), x)).alias("_l"), F.avg(F.when(F.col(dark), y)).alias("_k"))
    fit = lambda v, m: F.sum(v * m) / F.nullif(F.sum(m * m), F.lit(0.0))
    parts = df.join(mode, w).groupBy(*keys, det).agg(fit(x, F.col("_l")).alias("p_light"), fit(y, F.col("_k")).alias("p_dark"), F.first(cal).alias("_cal"), F.first(light).alias("_light"), F.first(dark).alias("_dark"))
    stats = lambda flag, c, n: medsig(parts.where(F.col(flag)), keys, c, spread=False).select(*keys, F.col("med").alias(f"_m{n}"), F.col("sig").alias(f"_s{n}"))
    got = parts.join(stats("_light", "p_light", 0), keys, "left").join(stats("_dark", "p_dark", 1), keys, "left")
    near = lambda c, n: F.abs(F.col(c) - F.col(f"_m{n}")) <= sigmas * F.col(f"_s{n}")
    member = F.when(near("p_light", 0) & (F.col("_cal") != 0), "light").when(near("p_dark", 1), "dark").otherwise("none")
    return got.withColumn("member", member).select(*keys, det, "p_light", "p_dark", "member", F.when((F.col("member") == "light") & (F.col("p_light") != 0), F.col("_cal") / F.col("p_light")).otherwise(0.0).alias("recal"))
