"""Implausible readings: limit violations, stuck runs and spikes, per source.

``stream_outliers`` is for densely sampled streams whose level moves. Every stream is modelled by a robust
autoregression around a running median; additive outliers are tested against predictions from both sides and against
the levels before and after, so that a level shift is not taken for an outlier, and the model is fitted again without
them until the set of outliers stays the same. Long streams are cut into blocks of readings with a halo of readings on both sides, so a
stream of any length is spread over many tasks and a task holds one block; the noise is that of the whole stream, an
exact median over all blocks.

``series_outliers`` is for slow series with one fixed level per source. A robust autoregression of order 1 around the median
is fitted from sums over cells of values, again and again without the outliers until they stay the same, which reads the
readings once; readings off their prediction are tested against the scatter. Runs come from blocks of time that borrow their
neighbours' last readings, so a source may have any number of readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import few_groups, with_groups
from driftline.operators.stats import order_statistics
from driftline.session import shipped

LIMIT, STUCK, SPIKE = 1, 2, 4


def _sliding_median(m: np.ndarray, half: int) -> np.ndarray:
    """Median of the 2 * half + 1 values around each; NaN are left out, rows are reflected at both ends."""
    wide = np.pad(m, ((0, 0), (half, half)), mode="reflect" if m.shape[1] > half else "symmetric")
    win = np.sort(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=1), axis=2)
    n = np.isfinite(win).sum(2)
    at = np.maximum(n - 1, 0)
    lo, hi = np.take_along_axis(win, (at // 2)[..., None], 2)[..., 0], np.take_along_axis(win, (n // 2 - (n == 2 * half + 1) * 0).clip(0, 2 * half)[..., None], 2)[..., 0]
    return np.where(n > 0, np.where(n % 2 == 1, lo, (lo + np.where(n > 0, hi, lo)) / 2), np.nan)


def _row_median(m: np.ndarray) -> np.ndarray:
    """Median of each row without NaN; NaN for rows without values."""
    s = np.sort(m, axis=1)
    n = np.isfinite(s).sum(1)
    i = np.arange(len(s))
    lo, hi = s[i, np.maximum((n - 1) // 2, 0)], s[i, np.minimum(n // 2, s.shape[1] - 1)]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def _noise(m: np.ndarray) -> np.ndarray:
    """Sample-to-sample noise of each row: 1.4826 times the median absolute difference over the root of two.

    Where more than half of the differences are 0, the root mean square of the smaller nine tenths takes its place.
    """
    if m.shape[1] < 2:
        return np.full(len(m), np.nan)
    d = np.abs(np.diff(m, axis=1))
    s = 1.4826 * _row_median(d) / np.sqrt(2)
    for i in np.flatnonzero(s == 0):
        v = np.sort(d[i][np.isfinite(d[i])])
        s[i] = np.sqrt(np.mean(v[: max(1, int(0.9 * len(v)))] ** 2) / 2)
    return s


def _autoregression(z: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Coefficients of order 2 of each row by least squares with Huber weights. z has 0 for left-out values."""
    a, b, y = z[:, 1:-1], z[:, :-2], z[:, 2:]
    phi = np.zeros((len(z), 2))
    for _ in range(2):
        r = y - phi[:, :1] * a - phi[:, 1:] * b
        w = np.minimum(1, 1.5 * sigma[:, None] / np.maximum(np.abs(r), 1e-300))
        saa, sbb, sab = (w * a * a).sum(1), (w * b * b).sum(1), (w * a * b).sum(1)
        say, sby = (w * a * y).sum(1), (w * b * y).sum(1)
        det = saa * sbb - sab * sab
        ok = det > 1e-9 * np.maximum(saa * sbb, 1e-300)
        d = np.where(ok, det, 1)
        phi = np.where(ok[:, None], np.stack([(say * sbb - sby * sab) / d, (sby * saa - say * sab) / d], 1), 0)
        phi = np.clip(phi, -0.9, 0.9)
    return phi


def _extrapolated(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Value at 0 of the least-squares line of each row over places t; NaN are left out."""
    w = np.isfinite(y)
    v, n = np.where(w, y, 0), np.maximum(w.sum(1), 1)
    mt, my = (w * t).sum(1) / n, v.sum(1) / n
    d = np.where(w, t - mt[:, None], 0)
    spread = (d * d).sum(1)
    slope = np.where(spread > 0, (d * np.where(w, y - my[:, None], 0)).sum(1) / np.where(spread > 0, spread, 1), 0)
    return my - slope * mt


def spike_mask(m: np.ndarray, sigmas: float = 10.0, half: int = 8, side: int = 8, sigma: np.ndarray | None = None) -> np.ndarray:
    """True where a value of the row is an additive outlier. m: rows of streams, NaN behind their ends; sigma: their noise, if not their own.

    The model is fitted again without the outliers until they are the same, or the same as in an earlier round.

    A value is one if it is more than ``sigmas`` times the noise of its row away from the running level plus the mean
    of the forward and backward prediction, unless it is the edge of a level shift: then it lies within half of that
    of the line through the last ``side`` values before, or the first ``side`` after it, that aren't outliers
    themselves.
    """
    there = np.isfinite(m)
    flags = np.zeros(m.shape, bool)
    if m.shape[1] < 5:
        return flags
    sigma = _noise(m) if sigma is None else np.where(np.isnan(sigma), _noise(m), sigma)
    todo = np.flatnonzero(np.isfinite(sigma) & (sigma > 0))
    before: list[set[bytes]] = [{b""} for _ in range(len(m))]
    while len(todo):
        x, s, t = m[todo], sigma[todo], there[todo]
        clean = np.where(flags[todo], np.nan, x)
        level = _sliding_median(clean, half)
        level = np.where(np.isfinite(level), level, _row_median(clean)[:, None])
        z0 = np.where(t, x - level, 0)
        # candidates of this round are left out of the fit, else they would raise their neighbours' predictions
        z = np.where(flags[todo] | (np.abs(z0) > 6 * s[:, None]), 0, z0)
        phi = _autoregression(z, s)
        fwd, bwd = np.zeros_like(z), np.zeros_like(z)
        fwd[:, 2:] = phi[:, :1] * z[:, 1:-1] + phi[:, 1:] * z[:, :-2]
        bwd[:, :-2] = phi[:, :1] * z[:, 1:-1] + phi[:, 1:] * z[:, 2:]
        out = t & (np.abs(z0 - (fwd + bwd) / 2) > sigmas * s[:, None])
        # level shift: the value fits the level on one of its sides
        rows, cols = np.nonzero(out)
        if len(rows):
            reach = 4 * side
            keep = np.pad(np.where((np.abs(z0) > 6 * s[:, None]) & out | ~t, np.nan, x), ((0, 0), (reach, reach)), constant_values=np.nan)
            fits = np.zeros(len(rows), bool)
            for off in (np.arange(reach - 1, -1, -1), np.arange(reach + 1, 2 * reach + 1)):
                near = keep[rows[:, None], cols[:, None] + off[None, :]]
                near[np.cumsum(np.isfinite(near), 1) > side] = np.nan
                has = np.isfinite(near).sum(1) >= 4
                fits |= has & (np.abs(x[rows, cols] - _extrapolated(off - reach, near)) <= sigmas / 2 * s[rows])
            out[rows[fits], cols[fits]] = False
        changed = (out != flags[todo]).any(1)
        flags[todo] = out
        again = np.zeros(len(todo), bool)
        for i in np.flatnonzero(changed):
            mark = np.flatnonzero(out[i]).tobytes()
            again[i] = mark not in before[todo[i]]
            before[todo[i]].add(mark)
        todo = todo[again]
    return flags


def sure_flags(starts: np.ndarray, x: np.ndarray, limit: float, stuck: int) -> np.ndarray:
    """Flags for limits and stuck runs of the readings x of streams that begin at ``starts``, in order and without nulls."""
    n = len(x)
    flags = np.zeros(n, np.uint8)
    with np.errstate(invalid="ignore"):
        flags[~np.isfinite(x) | (np.abs(x) >= limit)] = LIMIT
    first = np.zeros(n + 1, bool)
    first[starts], first[n] = True, True
    same = np.zeros(n, bool)
    same[1:] = (x[1:] == x[:-1]) & ~first[1:n]
    head = np.flatnonzero(~same)
    size = np.diff(np.append(head, n))
    flags[np.repeat(size >= stuck, size)] |= STUCK
    return flags


def reading_flags(starts: np.ndarray, x: np.ndarray, limit: float, stuck: int, sigmas: float, sigma: np.ndarray | None = None) -> np.ndarray:
    """As ``sure_flags``, with those for spikes; sigma: the noise at each reading, NaN for that of the readings themselves."""
    n = len(x)
    flags = sure_flags(starts, x, limit, stuck)
    first = np.zeros(n, bool)
    first[starts] = True
    good = flags == 0
    stream = np.cumsum(first) - 1
    at, s = np.flatnonzero(good), stream[good]
    if not len(at):
        return flags
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    length = np.diff(np.append(begin, len(s)))
    bucket = np.ceil(np.log2(np.maximum(length, 2)) * 4).astype(int)  # rows of nearly the same length together
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        wide = length[own].max()
        step = max(1, 400_000 // int(wide))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            col = np.arange(wide)
            inside = col[None, :] < length[some][:, None]
            m = np.full(inside.shape, np.nan)
            src = at[np.repeat(begin[some], length[some]) + np.concatenate([np.arange(j) for j in length[some]])]
            m[inside] = x[src]
            hit = spike_mask(m, sigmas, sigma=None if sigma is None else sigma[at[begin[some]]])
            flags[src[hit[inside]]] |= SPIKE
    return flags


def _streams(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole blocks of sorted rows (names..., _blk, _t, ...), the rows that count (one for each position) and where among them blocks begin.

    Holds ``rows`` rows or one block, whichever is more.
    """

    def work(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for c in [*names, "_blk"]:
            v = t[c].chunk(0)
            v = v.dictionary_encode().indices if pa.types.is_string(v.type) else v
            v = v.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        pos = t["_t"].to_numpy()
        again = np.zeros(t.num_rows, bool)
        again[1:] = (pos[1:] == pos[:-1]) & ~change[1:]
        idx = np.flatnonzero(~again)
        s = np.cumsum(change)[idx]
        return t, idx, np.flatnonzero(np.r_[True, s[1:] != s[:-1]])

    def cut(t: pa.Table) -> int:
        """Where the last block of t begins."""
        last = t.slice(t.num_rows - 1)
        same = np.ones(t.num_rows, bool)
        for c in [*names, "_blk"]:
            same &= pc.equal(t[c], last[c][0]).to_numpy()
        return t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            k = cut(t)
            if k:
                yield work(t.slice(0, k))
            rest = t.slice(k)
            held, size = rest.to_batches(), 0 if k else size // 2
    if held:
        yield work(pa.Table.from_batches(held))


def _scan_blocks(batches: Iterator[pa.RecordBatch], names: list[str], limit: float, stuck: int, sigmas: float, rows: int) -> Iterator[pa.RecordBatch]:
    """The flagged ones of sorted rows (names..., _blk, _t, _x, _own, _noise)."""
    for t, idx, starts in _streams(batches, names, rows):
        x, noise = t["_x"].to_numpy().astype(float), t["_noise"].to_numpy(zero_copy_only=False).astype(float)
        flags = reading_flags(starts, x[idx], limit, stuck, sigmas, noise[idx])
        hit = idx[(flags > 0) & t["_own"].to_numpy(zero_copy_only=False)[idx]]
        got = t.select([*names, "_t"]).take(pa.array(hit))
        got = got.append_column("_flags", pa.array(flags[np.searchsorted(idx, hit)].astype(np.int32)))
        yield got.combine_chunks().to_batches()[0] if len(hit) else pa.RecordBatch.from_pylist([], schema=got.schema)


def _step_blocks(batches: Iterator[pa.RecordBatch], names: list[str], limit: float, stuck: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Sizes of the steps from one ordinary reading to the next, at those of the block's own."""
    for t, idx, starts in _streams(batches, names, rows):
        x = t["_x"].to_numpy().astype(float)[idx]
        at = np.flatnonzero(sure_flags(starts, x, limit, stuck) == 0)
        first = np.zeros(len(idx), bool)
        first[starts] = True
        stream = np.cumsum(first)[at]
        own = t["_own"].to_numpy(zero_copy_only=False)[idx][at]
        hit = 1 + np.flatnonzero((stream[1:] == stream[:-1]) & own[1:])
        got = t.select(names).take(pa.array(idx[at[hit]])).append_column("_step", pa.array(np.abs(x[at[hit]] - x[at[hit - 1]])))
        yield got.combine_chunks().to_batches()[0] if len(hit) else pa.RecordBatch.from_pylist([], schema=got.schema)


def _blocks(rows: DataFrame, own: list[str], block: int, halo: int) -> DataFrame:
    """Rows (own..., _t, ...) with their block and those that borrow them: ``block`` readings of a stream, and ``halo`` on both sides.

    Readings are counted in stretches of positions; a stretch is never parted.
    """
    wide = max(1, min(1024, block // 8))
    cell = F.floor(F.col("_t") / F.lit(wide))
    along = Window.partitionBy(*own).orderBy("_cell")
    size = rows.groupBy(*own, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    size = size.withColumn("_to", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_wide", F.max("_n").over(Window.partitionBy(*own)))
    of = lambda c: F.floor(F.greatest(c, F.lit(0)) / F.lit(block))
    begin = F.col("_to") - F.col("_n")
    size = size.select(*own, "_cell", of(begin).alias("_mine"), F.sequence(of(begin - halo - F.col("_wide")), of(F.col("_to") + halo)).alias("_in"))
    return rows.withColumn("_cell", cell).join(size, [*own, "_cell"]).withColumn("_blk", F.explode("_in")).withColumn("_own", F.col("_blk") == F.col("_mine")).drop("_cell", "_in", "_mine")


def _stream_noise(steps: DataFrame, own: list[str]) -> DataFrame:
    """(own, _noise) as ``_noise`` for whole streams, exactly, from the sizes of their steps."""
    n = F.col("n")
    top = F.greatest(F.lit(1), F.floor(0.9 * n)).cast("long")
    got = order_statistics(steps, own, "_step", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2), "_top": top - 1}, spread=True)
    still = got.where("_lo + _hi = 0")
    v = F.col("_step")
    rest = with_groups(steps.join(still.select(*own), own, "left_semi"), still, own, few_groups(still, own)).groupBy(*own).agg(
        F.sum(F.when(v < F.col("_top"), v * v).otherwise(0)).alias("_sum"), F.sum((v < F.col("_top")).cast("long")).alias("_below"), F.first(top).alias("_m"), F.first("_top").alias("_v")
    )
    rest = rest.select(*own, F.sqrt((F.col("_sum") + (F.col("_m") - F.col("_below")) * F.col("_v") ** 2) / F.col("_m") / 2).alias("_noise"))
    return got.where("_lo + _hi > 0").select(*own, (1.4826 * (F.col("_lo") + F.col("_hi")) / 2 / F.sqrt(F.lit(2.0))).alias("_noise")).unionByName(rest)


def stream_outliers(
    df: DataFrame, keys: list[str], order: str, value: str, limit: float = float(2**27), stuck: int = 8, sigmas: float = 10.0,
    block: int = 1 << 16, halo: int = 256, rows: int = 200_000,
) -> DataFrame:
    """``keys``, ``order``, flags of the implausible readings: a sum of 1 limit, 2 stuck run, 4 spike.

    limit: NaN, infinite, or at least ``limit`` in size. stuck: one of ``stuck`` or more equal readings in succession. spike:
    see ``spike_mask``. Null readings and rows with a null key or null position are passed over. Of repeated positions
    of one stream one row counts. ``order`` is an integer. Where positions reach over more than ``block``, streams are handled in blocks of
    so many readings together with ``halo`` readings borrowed on both sides, which must hold ``stuck`` readings and the windows of the level;
    noise is that of the whole stream all the same. Streams of fewer than 5 readings have no spikes. Other columns are ignored. Empty gives empty.
    """
    shipped(df.sparkSession)
    own = [f"_k{i}" for i in range(len(keys))]
    known = F.col(value).isNotNull() & F.col(order).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    kind = "float" if dict(df.dtypes)[value] == "float" else "double"
    rows_ = df.where(known).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(order).alias("_t"), F.col(value).cast(kind).alias("_x"))
    reach = rows_.agg(F.min("_t").alias("a"), F.max("_t").alias("z")).head()
    sort = lambda r: r.withColumn("_h", F.xxhash64(*own, "_blk")).repartition("_h").sortWithinPartitions("_h", *own, "_blk", "_t").drop("_h")
    kinds = dict(rows_.dtypes)
    named = ", ".join(f"{o} {kinds[o]}" for o in own)
    if reach["a"] is None or reach["z"] - reach["a"] < block:  # no stream is longer than a block
        placed = sort(rows_.withColumn("_blk", F.lit(0)).withColumn("_own", F.lit(True))).withColumn("_noise", F.lit(None).cast("double"))
    else:
        blocks = sort(_blocks(rows_.dropDuplicates([*own, "_t"]), own, block, halo))
        steps = blocks.mapInArrow(lambda it: _step_blocks(it, own, limit, stuck, rows), f"{named}, _step double")
        placed = sort(with_groups(blocks, _stream_noise(steps, own), own, few_groups(rows_, own)))
    found = placed.select(*own, "_blk", "_t", "_x", "_own", "_noise").mapInArrow(lambda it: _scan_blocks(it, own, limit, stuck, sigmas, rows), f"{named}, _t {kinds['_t']}, _flags int")
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("_t").alias(order), F.col("_flags").alias("flags"))


CELLS, WIDEST = 200, 4000  # cells of values to a scatter, and on each side of the level


def fit_series(pdf, own: list[str]):
    """Level, scatter and coefficient of one source from its cells: the median, and the model fitted without outliers until they are the same.

    Columns: side (-1 below the bracket of the median, 0 in it, 1 above), cell, v (the value itself, in the bracket), n, s1 and s2 (sums of the distance
    from c0 and its square), ab and bb (products with the reading before), c0, s0. Ordinary are cells within 6 scatters of the level.
    """
    import pandas as pd

    pdf = pdf.sort_values(["side", "cell", "v"])
    n, c0, s0 = pdf.n.to_numpy(float), float(pdf.c0.iloc[0]), float(pdf.s0.iloc[0])
    upto = np.cumsum(n)
    middle = [pdf.v.to_numpy()[np.searchsorted(upto, r, "right")] for r in ((upto[-1] - 1) // 2, upto[-1] // 2)]
    level, s, phi, kept = float(np.mean(middle)), s0, 0.0, None
    mean = c0 + pdf.s1.to_numpy() / n
    seen: set[bytes] = set()
    while s > 0:
        inside = np.abs(mean - level) <= 6 * s
        if inside.tobytes() in seen:
            break
        seen.add(inside.tobytes())
        m = n[inside].sum()
        if not m:
            s = 0.0
            break
        d = pdf.s1.to_numpy()[inside].sum() / m
        s = float(np.sqrt(max(pdf.s2.to_numpy()[inside].sum() / m - d * d, 0.0)))
        bb = pdf.bb.to_numpy()[inside].sum()
        phi = float(np.clip(pdf.ab.to_numpy()[inside].sum() / bb, -0.9, 0.9)) if bb > 0 else 0.0
    return pd.DataFrame([[*[pdf[o].iloc[0] for o in own], level, s, phi]], columns=[*own, "_c", "_s", "_phi"])


def series_outliers(
    df: DataFrame, source: list[str], record: str, order: str, value: str, least: float = 1.0, stuck: int = 4, sigmas: float = 10.0,
    block: int = 8 * 86400, accuracy: int = 10_000,
) -> DataFrame:
    """``source``, ``record``, flags of the implausible readings of slow series with a fixed level.

    limit (1): NaN, infinite or below ``least``. stuck (2): one of ``stuck`` or more equal values in succession by
    (``order``, ``record``). spike (4): a reading more than ``sigmas`` less 4 scatters off its prediction by the readings before and after it, and more than
    ``sigmas`` scatters from the source's median; the scatter is the standard deviation of ordinary values (``fit_series``). Neighbours predict with
    at most 3 scatters, so the first test never rules out what the second one asks for. The median is exact: all values between its bracket, of ranks
    2 in ``accuracy`` apart on both sides, are counted one by one, others in cells of a 200th of the quartile scatter. Null values are
    passed over. Rows with a null source, record or order are tested for limit alone, equal ones once, and have no part in the rest.
    Repeated (source, record) count once. A source whose ordinary values are all equal has no spikes. ``block`` is the span of ``order`` whose rows are
    sorted together.
    """
    own = [f"_k{i}" for i in range(len(source))]
    known = F.col(value).isNotNull() & F.col(order).isNotNull() & F.col(record).isNotNull()
    for k in source:
        known = known & F.col(k).isNotNull()
    x = F.col("_x")
    named = [*[F.col(k).alias(o) for k, o in zip(source, own)], F.col(record).alias("_r"), F.col(order).alias("_t"), F.col(value).cast("double").alias("_x")]
    few = few_groups(df, source)
    rows = (
        df.where(known)
        .select(*named)
        .withColumn("_blk", F.floor(F.col("_t") / F.lit(block)).cast("long"))
        .repartition(*own, "_blk")
        .dropDuplicates([*own, "_blk", "_t", "_r"])
    )

    def fine(c: Column) -> Column:
        return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) & (c >= least)

    # a run shows within ``stuck`` - 1 readings on each side; each block borrows them from its neighbours
    k = stuck - 1
    item = F.struct("_t", "_r", "_x")
    by = Window.partitionBy(*own, "_blk")
    edge = (
        rows.withColumn("_i", F.row_number().over(by.orderBy("_t", "_r"))).withColumn("_j", F.count("*").over(by) - F.col("_i") + 1)
        .where(f"_i <= {k} or _j <= {k}")
        .groupBy(*own, "_blk")
        .agg(F.sort_array(F.collect_list(F.when(F.col("_i") <= k, item))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("_j") <= k, item))).alias("tail"))
    )
    order_ = Window.partitionBy(*own).orderBy("_blk")
    lent = edge.select(
        *own, "_blk",
        F.flatten(F.collect_list("tail").over(order_.rowsBetween(-k, -1))).alias("_before"),
        F.flatten(F.collect_list("head").over(order_.rowsBetween(1, k))).alias("_after"),
    ).select(*own, "_blk", F.explode(F.concat(F.slice(F.reverse("_before"), 1, k), F.slice("_after", 1, k))).alias("b"))
    borrowed = lent.select(*own, F.col("b._r").alias("_r"), F.col("b._t").alias("_t"), F.col("b._x").alias("_x"), "_blk", F.lit(False).alias("_own"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(borrowed)
    w = by.orderBy("_t", "_r")
    run = both.withColumn("_prev", F.lag("_x").over(w)).withColumn("_next", F.lead("_x").over(w))
    run = run.withColumn("_new", F.when(F.col("_prev").isNull() | F.isnan(x) | (F.col("_prev") != x), 1).otherwise(0))
    run = run.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.withColumn("_size", F.count("*").over(Window.partitionBy(*own, "_blk", "_run"))).where("_own").drop("_own", "_new", "_run")
    points = [0.25, 0.75, 0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    rough = rows.where(fine(x)).groupBy(*own).agg(F.percentile_approx("_x", points, F.lit(accuracy)).alias("q"))
    rough = rough.select(*own, F.col("q")[2].alias("_lo"), F.col("q")[3].alias("_hi"), ((F.col("q")[1] - F.col("q")[0]) / 1.349).alias("_s0"))
    c0 = (F.col("_lo") + F.col("_hi")) / 2

    def held(c: Column, level: Column, s: Column) -> Column:
        """A neighbour's distance from the level, within 3 scatters; 0 if there is none or it isn't fine."""
        return F.when(fine(c), F.greatest(F.least(c - level, 3 * s), -3 * s)).otherwise(0.0)

    before = held(F.col("_prev"), c0, F.col("_s0"))
    cells = with_groups(run.where(fine(x)), rough, own, few)
    side = F.when(x < F.col("_lo"), -1).when(x > F.col("_hi"), 1).otherwise(0)
    cell = F.when(F.col("_s0") > 0, F.greatest(F.least(F.floor((x - c0) / F.col("_s0") * CELLS), F.lit(WIDEST)), F.lit(-WIDEST))).otherwise(0)
    cells = cells.groupBy(*own, side.alias("side"), cell.cast("int").alias("cell"), F.when(side == 0, x).alias("v")).agg(
        F.count("*").alias("n"), F.sum(x - c0).alias("s1"), F.sum((x - c0) ** 2).alias("s2"), F.sum(held(x, c0, F.col("_s0")) * before).alias("ab"), F.sum(before * before).alias("bb"),
        F.first(c0).alias("c0"), F.first("_s0").alias("s0"),
    )
    kinds = dict(rows.dtypes)
    shipped(df.sparkSession)
    stats = cells.groupBy(*own).applyInPandas(lambda pdf: fit_series(pdf, own), ", ".join(f"{o} {kinds[o]}" for o in own) + ", _c double, _s double, _phi double")
    phi, c, s = F.col("_phi"), F.col("_c"), F.col("_s")
    off = x - c - phi / (1 + phi * phi) * (held(F.col("_prev"), c, s) + held(F.col("_next"), c, s))
    flags = (
        F.when(~fine(x), LIMIT).otherwise(0)
        + F.when(F.col("_size") >= stuck, STUCK).otherwise(0)
        + F.when(fine(x) & (s > 0) & (F.abs(off) > (sigmas - 4) * s) & (F.abs(x - c) > sigmas * s), SPIKE).otherwise(0)
    )
    out = [*[F.col(o).alias(n) for o, n in zip(own, source)], F.col("_r").alias(record), "flags"]
    apart = df.where(F.col(value).isNotNull() & ~known).select(*named).where(~fine(x)).distinct().withColumn("flags", F.lit(LIMIT))
    return with_groups(run, stats, own, few).withColumn("flags", flags).where("flags > 0").select(*out).unionByName(apart.select(*out))
