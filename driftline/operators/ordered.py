"""Operators on ordered signals: differences, jumps, trends, fills and resampling.

Signals are rows (keys..., samp, value), one per key and sample.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import few_groups, with_groups
from driftline.operators.stats import group_median


def jump_statistic(df: DataFrame, keys: list[str], samp: str, value: str, width: int, stride: int = 1) -> DataFrame:
    """(keys, jump): largest difference between the means of neighbouring windows of ``width`` every ``stride``-th samples; 0 if too short."""
    i = F.col(samp)
    nd = F.floor((F.max(i).over(Window.partitionBy(*keys)) + 1) / stride)
    rows = df.withColumn("_nd", nd).where((i % stride == 0) & (F.floor(i / stride) < F.col("_nd"))).withColumn("_j", F.floor(i / stride).cast("int"))
    w = Window.partitionBy(*keys).orderBy("_j")
    a, b = w.rowsBetween(0, width - 1), w.rowsBetween(width, 2 * width - 1)
    both = rows.withColumn("_a", F.sum(value).over(a)).withColumn("_b", F.sum(value).over(b)).withColumn("_m", F.count(value).over(b)).withColumn("_full", (F.col("_m") == width) & (F.col("_j") + 2 * width < F.col("_nd") + 1))
    return both.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_full"), F.abs(F.col("_a") - F.col("_b")) / width)), F.lit(0.0)).alias("jump"))


def step_jumps(df: DataFrame, keys: list[str], samp: str, value: str, step: int, threshold: float) -> DataFrame:
    """(keys, at, size): first sample behind the centre, and mean size, of each run of samples whose value ``step`` samples on differs by more than ``threshold``."""
    w = Window.partitionBy(*keys).orderBy(samp)
    d = df.withColumn("_d", F.lead(value, step).over(w) - F.col(value)).where(F.abs("_d") > threshold)
    run = d.withColumn("_g", F.col(samp) - F.row_number().over(w))
    return run.groupBy(*keys, "_g").agg(F.ceil((F.min(samp) + F.max(samp) + step) / 2).cast("int").alias("at"), F.avg("_d").alias("size")).drop("_g")


def quantised_jumps(jumps: DataFrame, quantum: float, tolerance: float) -> DataFrame:
    """Jumps that are whole multiples of ``quantum`` up to ``tolerance`` of it, with ``steps``."""
    k = F.round(F.col("size") / quantum)
    return jumps.withColumn("steps", k.cast("int")).where((F.col("steps") != 0) & (F.abs(F.col("size") / quantum - k) <= tolerance))


def remove_jumps(df: DataFrame, jumps: DataFrame, keys: list[str], samp: str, value: str, quantum: float) -> DataFrame:
    """The signal with the steps of the jumps up to each sample subtracted."""
    ev = jumps.select(*keys, F.col("at").alias(samp), F.lit(None).cast("double").alias(value), (F.col("steps") * F.lit(quantum)).alias("_j"), F.lit(0).alias("_k"))
    both = df.select(*keys, samp, F.col(value).cast("double").alias(value), F.lit(0.0).alias("_j"), F.lit(1).alias("_k")).unionByName(ev)
    w = Window.partitionBy(*keys).orderBy(samp, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.col(value) - F.sum("_j").over(w)).where("_k = 1").select(*keys, samp, value)


def unwrap(df: DataFrame, keys: list[str], samp: str, value: str, period: float) -> DataFrame:
    """The signal without wraps: each step of more than half a period is taken for one."""
    w = Window.partitionBy(*keys).orderBy(samp)
    d = F.col(value) - F.lag(value).over(w)
    turn = F.when(d > period / 2, -1).when(d < -period / 2, 1).otherwise(0)
    return df.withColumn("_t", turn).withColumn(value, F.col(value) + period * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def detrend(df: DataFrame, keys: list[str], samp: str, value: str) -> DataFrame:
    """The signal less the line through its first and last value, its mean over the line kept; with that line's ``slope`` and ``half``."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(samp)) - 1
    rows = df.withColumn("_i", i).withColumn("_n", F.count("*").over(w)).withColumn("_a", F.min_by(value, samp).over(w)).withColumn("_b", F.max_by(value, samp).over(w))
    slope = F.when(F.col("_n") > 1, (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)).otherwise(0.0)
    rows = rows.withColumn("slope", slope).withColumn("half", (F.col("_b") - F.col("_a")) / 2)
    return rows.withColumn(value, F.col(value) - F.col("_i") * F.col("slope") + F.col("half")).drop("_n", "_a", "_b").withColumnRenamed("_i", "i")


def retrend(df: DataFrame, value: str) -> DataFrame:
    """Undoes ``detrend``."""
    return df.withColumn(value, F.col(value) + F.col("i") * F.col("slope") - F.col("half")).drop("i", "slope", "half")


def detrend_ends(df: DataFrame, keys: list[str], samp: str, value: str, window: int) -> DataFrame:
    """The signal less the line between the means of its first and last ``window`` samples, and less its mean."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(samp)) - 1).withColumn("_n", F.count("*").over(w))
    head, tail = F.when(F.col("_i") < window, F.col(value)), F.when(F.col("_i") >= F.col("_n") - window, F.col(value))
    rows = rows.withColumn("_s", (F.avg(tail).over(w) - F.avg(head).over(w)) / F.greatest(F.col("_n") - window, F.lit(1)))
    flat = rows.withColumn(value, F.col(value) - F.col("_s") * F.col("_i"))
    return flat.withColumn(value, F.col(value) - F.avg(value).over(w)).drop("_i", "_n", "_s")


def remove_centre(df: DataFrame, keys: list[str], value: str, median: bool = False) -> DataFrame:
    """The signal less its mean or median, which comes out as ``centre``."""
    w = Window.partitionBy(*keys)
    c = F.median(value).over(w) if median else F.avg(value).over(w)
    return df.withColumn("centre", c).withColumn(value, F.col(value) - F.col("centre"))


def downsample_121(df: DataFrame, keys: list[str], samp: str, value: str, offset: int = 0) -> DataFrame:
    """Every second sample from ``offset`` on as (left + 2 own + right) / 4; where a neighbour is missing the rest counts 4/3."""
    w = Window.partitionBy(*keys).orderBy(samp)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    total = 2 * F.col(value) + F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0))
    factor = F.when(left.isNull() & right.isNull(), 0.5).when(left.isNull() | right.isNull(), 1 / 3).otherwise(0.25)
    out = df.withColumn("_v", total * factor).where(F.col(samp) % 2 == offset)
    return out.select(*keys, F.floor((F.col(samp) - offset) / 2).cast("int").alias(samp), F.col("_v").alias(value))


def decimate(df: DataFrame, keys: list[str], samp: str, value: str, factor: int) -> DataFrame:
    """Every ``factor``-th sample; for a power of two filtered by repeated ``downsample_121``."""
    if factor & (factor - 1) == 0:
        for _ in range(int(math.log2(factor))):
            df = downsample_121(df, keys, samp, value)
        return df
    return df.where(F.col(samp) % factor == 0).select(*keys, (F.col(samp) / factor).cast("int").alias(samp), value)


def boxcar(df: DataFrame, keys: list[str], samp: str, value: str, width: int, phase: str = "symmetric") -> DataFrame:
    """Moving mean over ``width`` samples of a periodic signal; ``phase`` is symmetric, lag or lead."""
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(samp), F.col(value).cast("double").alias(value)).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(samp)) - 1)
    wrapped = rows.withColumn("_r", F.explode(F.filter(F.array(F.lit(0), F.when(F.col("_i") < width, 1), F.when(F.col("_i") >= F.col("_n") - width, -1)), lambda r: r.isNotNull())))
    wrapped = wrapped.withColumn("_p", F.col("_i") + F.col("_r") * F.col("_n"))
    half = width // 2
    a, b = {"symmetric": (-half, width - 1 - half), "lag": (1 - width, 0), "lead": (0, width - 1)}[phase]
    mean = F.avg(value).over(w.orderBy("_p").rangeBetween(a, b))
    return wrapped.withColumn(value, mean).where("_r = 0").select(*keys, samp, value)


def scan_turns(df: DataFrame, keys: list[str], samp: str, az: str, gap: int, share: float = 1 / 3) -> DataFrame:
    """Ranges where the scan is slow: speed below ``share`` of its median, ranges at most ``gap`` apart joined."""
    from driftline.operators.intervals import merge_ranges, ranges_of_mask

    w = Window.partitionBy(*keys).orderBy(samp)
    v = F.abs(F.coalesce(F.lead(az).over(w), F.col(az)) - F.coalesce(F.lag(az).over(w), F.col(az))) / F.when(F.lag(az).over(w).isNull() | F.lead(az).over(w).isNull(), 1).otherwise(2)
    rows = df.withColumn("_v", v)
    rows = rows.withColumn("_m", F.median("_v").over(Window.partitionBy(*keys)))
    return merge_ranges(ranges_of_mask(rows, keys, samp, F.col("_v") < F.col("_m") * share), keys, gap)


def fill_ranges(df: DataFrame, ranges: DataFrame, keys: list[str], samp: str, value: str, reach: int, block: int = 4096, extrapolate: bool = False) -> DataFrame:
    """The signal with each range replaced by the line fitted to ``reach`` good samples' places on both sides.

    With samples on one side only, their mean takes the place of the line unless ``extrapolate``; without any the value is null. ``ranges``
    must be merged; context doesn't reach into other ranges, so the result doesn't depend on their order.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    r = ranges.select(*keys, "start", "stop", F.coalesce(F.lag("stop").over(w), F.lit(-(1 << 30))).alias("_lo"), F.coalesce(F.lead("start").over(w), F.lit(1 << 30)).alias("_hi"))
    r = r.select(*keys, "start", "stop", F.greatest(F.col("start") - reach, "_lo").alias("_lo"), F.least(F.col("stop") + reach, "_hi").alias("_hi"))
    blocks = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    rk = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], "start", "stop", "_lo", "_hi", F.col("_b").alias("_rb"))
    sig = df.select(*keys, F.col(samp).alias("_s"), F.col(value).cast("double").alias("_v")).withColumn("_sb", F.floor(F.col("_s") / block))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    ctx = sig.join(rk, same & (F.col("_sb") == F.col("_rb")) & (F.col("_s") >= F.col("_lo")) & (F.col("_s") < F.col("_hi")))
    out_side = (F.col("_s") < F.col("start")) | (F.col("_s") >= F.col("stop"))
    x, y = F.when(out_side, (F.col("_s") - F.col("_lo")).cast("double")), F.when(out_side, F.col("_v"))
    fit = ctx.groupBy(*keys, "start", "stop", "_lo").agg(
        F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_c"), F.avg(y).alias("_m"),
        F.count(F.when(F.col("_s") < F.col("start"), y)).alias("_nl"), F.count(F.when(F.col("_s") >= F.col("stop"), y)).alias("_nr"),
    )
    line = (F.col("_nl") > 0) & (F.col("_nr") > 0) if not extrapolate else F.col("_nl") + F.col("_nr") > 1
    inside = fit.withColumn("_s", F.explode(F.sequence("start", F.col("stop") - 1)))
    new = inside.select(*keys, F.col("_s").alias(samp), F.when(line & F.col("_k").isNotNull(), F.col("_c") + F.col("_k") * (F.col("_s") - F.col("_lo"))).otherwise(F.col("_m")).alias("_new"), F.lit(True).alias("_cut"))
    got = df.join(new, [*keys, samp], "left")
    return got.withColumn(value, F.when(F.col("_cut"), F.col("_new")).otherwise(F.col(value).cast("double"))).drop("_new", "_cut")


def sine_fit(df: DataFrame, keys: list[str], time: Column, value: str, freq: float) -> DataFrame:
    """(keys, amp, phase, rms) of the sine and cosine of a frequency fitted to the mean-free signal."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_y", F.col(value) - F.avg(value).over(w)).withColumn("_c", F.cos(2 * math.pi * freq * time)).withColumn("_s", F.sin(2 * math.pi * freq * time))
    y, c, s = F.col("_y"), F.col("_c"), F.col("_s")
    t = rows.groupBy(*keys).agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(y * c).alias("yc"), F.sum(y * s).alias("ys"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    det = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    t = t.where(det != 0).withColumn("_a", (F.col("ss") * F.col("yc") - F.col("cs") * F.col("ys")) / det).withColumn("_b", (F.col("cc") * F.col("ys") - F.col("cs") * F.col("yc")) / det)
    left = F.col("yy") - F.col("_a") * F.col("yc") - F.col("_b") * F.col("ys")
    phase = F.when((F.col("_a") == 0) & (F.col("_b") == 0), 0.0).when(F.col("_a") > 0, F.atan(F.col("_b") / F.when(F.col("_a") != 0, F.col("_a")))).otherwise(F.atan(F.col("_b") / F.when(F.col("_a") != 0, F.col("_a"))) + math.pi)
    return t.select(*keys, F.sqrt(F.col("_a") ** 2 + F.col("_b") ** 2).alias("amp"), F.coalesce(phase, F.signum("_b") * math.pi / 2).alias("phase"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("n")).alias("rms"))


def outliers_in_column(df: DataFrame, column: list[str], value: str, fraction: float) -> DataFrame:
    """``df`` with ``outlier``: farther from the median of its column than ``fraction`` of it."""
    m = group_median(df, column, value, "_m").drop("n")
    return with_groups(df, m, column, few_groups(df, column)).where("_m is not null").withColumn("outlier", F.abs(F.col(value) - F.col("_m")) > fraction * F.abs("_m")).drop("_m")


def fill_blanks(df: DataFrame, column: list[str], value: str, ok: Column) -> DataFrame:
    """Values that aren't ok take the median of the good ones of their column."""
    m = group_median(df.where(ok), column, value, "_m").drop("n")
    return with_groups(df, m, column, few_groups(df, column)).withColumn(value, F.when(ok, F.col(value)).otherwise(F.col("_m"))).drop("_m")


def add_phasors(amp1: Column, phase1: Column, amp2: Column, phase2: Column) -> tuple[Column, Column]:
    """Amplitude and phase of the sum of two oscillations."""
    c = amp1 * F.cos(phase1) + amp2 * F.cos(phase2)
    s = amp1 * F.sin(phase1) + amp2 * F.sin(phase2)
    return F.sqrt(c * c + s * s), F.atan2(s, c)


def repair_steps(df: DataFrame, keys: list[str], samp: str, value: str, tolerance: float) -> DataFrame:
    """Values whose step from the one before is farther than ``tolerance`` from the median step, put on the line through the others."""
    w = Window.partitionBy(*keys)
    step = F.col(value) - F.lag(value).over(w.orderBy(samp))
    rows = df.withColumn("_d", step).withColumn("_bad", F.coalesce(F.abs(F.col("_d") - F.median("_d").over(w)) > tolerance, F.lit(False)))
    y, x = F.when(~F.col("_bad"), F.col(value).cast("double")), F.when(~F.col("_bad"), F.col(samp).cast("double"))
    n, sx, sy = F.count(y).over(w), F.sum(x).over(w), F.sum(y).over(w)
    k = (n * F.sum(x * y).over(w) - sx * sy) / (n * F.sum(x * x).over(w) - sx * sx)
    rows = rows.withColumn("_k", k).withColumn("_c", (sy - F.col("_k") * sx) / n)
    return rows.withColumn(value, F.when(F.col("_bad"), F.col("_c") + F.col("_k") * F.col(samp)).otherwise(F.col(value))).drop("_d", "_bad", "_k", "_c")


def constant_detectors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values are all the same."""
    return df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a = _b").select(*keys)
