"""Loading of observations in one step: sample range, calibration, cuts, gap filling, pointing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.intervals import merge_ranges
from driftline.operators.joins import few_groups, with_groups
from driftline.operators.ordered import fill_ranges, repair_steps
from driftline.operators.season import calibrated


def axes(samples: DataFrame, tod: str, samp: str, start: int, stop: int | None) -> DataFrame:
    """(tod, _a, _z): first sample and the one past the last of each observation; negative ends count from its own end."""
    n = F.max(samp) + 1
    first = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    last = n if stop is None else n + stop if stop < 0 else F.least(n, F.lit(stop))
    return samples.groupBy(tod).agg(first.cast("int").alias("_a"), last.cast("int").alias("_z"))


def load_observations(
    samples: DataFrame, tod: str = "tod_id", det: str = "det_uid", samp: str = "samp", value: str = "x", start: int = 0, stop: int | None = None,
    cal: DataFrame | None = None, cal_keys: list[str] | None = None, cuts: DataFrame | None = None, context: int = 8,
    pointing: DataFrame | None = None, repair: dict[str, float] | None = None,
) -> DataFrame:
    """Streams (tod, det, samp, value, cut) of all observations, ready for use.

    Samples [start, stop) are taken, negative ends from each observation's own end, and numbered from 0. ``cal`` (``cal_keys``, cal) multiplies the streams;
    detectors it lacks become 0. ``cuts`` (tod, det, start, stop) in the same count as the samples are merged, cut to the range and filled from
    ``context`` samples on both sides; ``cut`` says which. ``pointing`` (tod, samp, columns...) is joined by sample after its columns named in
    ``repair`` are mended (``repair_steps``, with the tolerance given). Rows with a null key, position or value aren't loaded. Empty gives empty.
    """
    own = [tod, det]
    ax = axes(samples.where(F.col(samp) >= 0), tod, samp, start, stop)
    few = few_groups(samples, [tod])
    rows = samples.where(F.col(tod).isNotNull() & F.col(det).isNotNull() & F.col(value).isNotNull()).select(*own, samp, F.col(value).cast("double").alias(value), *[k for k in cal_keys or () if k not in own])
    rows = with_groups(rows, ax, [tod], few).where((F.col(samp) >= F.col("_a")) & (F.col(samp) < F.col("_z")))
    moved = lambda c: (F.col(c) - F.col("_a")).cast("int")
    rows = rows.withColumn(samp, moved(samp)).drop("_a", "_z")
    if cal is not None:
        rows = calibrated(rows, cal, cal_keys or [det], value, 0.0)
    rows = rows.select(*own, samp, value)
    if cuts is not None:
        c = with_groups(cuts.select(*own, "start", "stop"), ax, [tod], few).where("_a is not null")
        c = merge_ranges(c.select(*own, F.greatest(moved("start"), F.lit(0)).alias("start"), F.least(moved("stop"), (F.col("_z") - F.col("_a"))).cast("int").alias("stop")).where("start < stop"), own)
        filled = fill_ranges(rows.select(*own, samp, value), c, own, samp, value, context)
        from driftline.operators.intervals import in_ranges

        hit = in_ranges(rows, c, own, samp).select(*own, samp, F.lit(True).alias("cut"))
        rows = filled.join(hit, [*own, samp], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    else:
        rows = rows.withColumn("cut", F.lit(False))
    if pointing is not None:
        p = pointing
        for c, tolerance in (repair or {}).items():
            p = repair_steps(p, [tod], samp, c, tolerance)
        p = with_groups(p, ax, [tod], few).where((F.col(samp) >= F.col("_a")) & (F.col(samp) < F.col("_z"))).withColumn(samp, moved(samp)).drop("_a", "_z")
        rows = rows.join(p, [tod, samp], "left")
    return rows
