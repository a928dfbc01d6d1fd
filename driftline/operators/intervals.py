"""Algebra of half-open sample ranges (cuts) and of named flags.

Ranges are rows (keys..., start, stop). Axis lengths are a table (keys..., nsamps) where they matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Union of the ranges of each key: ranges that overlap, touch, or lie no more than ``gap`` apart become one. Empty ones are left out."""
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # of ranges with one start the longest counts; adding these up first bounds a busy key by the length of its axis
    rows = df.where("start < stop").groupBy(*keys, "start").agg(F.max("stop").alias("stop"))
    new = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") > before.cast("long") + gap), 1).otherwise(0))
    run = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def complement(merged: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """What of [0, nsamps) merged ranges leave. A key of ``axis`` without ranges gives all of it, one that is always cut nothing."""
    w = Window.partitionBy(*keys).orderBy("stop")
    edge = axis.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("stop"), "nsamps").unionByName(merged.join(axis, keys).select(*keys, "start", "stop", "nsamps"))
    gaps = edge.select(*keys, F.col("stop").alias("start"), F.coalesce(F.lead("start").over(w), F.col("nsamps")).alias("stop"))
    return gaps.where("start < stop")


def clamp(df: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges cut to [0, nsamps)."""
    got = df.join(axis, keys).select(*keys, F.greatest("start", F.lit(0)).alias("start"), F.least("stop", "nsamps").alias("stop"))
    return got.where("start < stop")


def buffered(df: DataFrame, axis: DataFrame, keys: list[str], left: int, right: int) -> DataFrame:
    """Ranges widened on both sides, merged and cut to the axis."""
    wide = df.select(*keys, (F.col("start").cast("long") - left).alias("start"), (F.col("stop").cast("long") + right).alias("stop"))
    inside = clamp(wide, axis, keys).select(*keys, F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    return merge_ranges(inside, keys)


def resampled(df: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Ranges on an axis with ``factor`` times fewer samples; both ends are cut off to whole samples."""
    return df.select(*keys, (F.col("start") / factor).cast("int").alias("start"), (F.col("stop") / factor).cast("int").alias("stop"))


def extracted(df: DataFrame, axis: DataFrame, keys: list[str], offset: int, count: int, cut_missing: bool = True) -> DataFrame:
    """Ranges relative to the window [offset, offset + count); parts of it outside the axis count as cut if ``cut_missing``."""
    inside = df.select(*keys, "start", "stop")
    if cut_missing:
        outer = axis.select(*keys, F.explode(F.array(F.struct(F.lit(min(offset, 0)).alias("a"), F.lit(0).alias("b")), F.struct(F.col("nsamps").alias("a"), F.greatest("nsamps", F.lit(offset + count)).alias("b")))).alias("r"))
        inside = inside.unionByName(outer.select(*keys, F.col("r.a").alias("start"), F.col("r.b").alias("stop")).where("start < stop"))
    moved = inside.select(*keys, F.greatest(F.col("start") - offset, F.lit(0)).alias("start"), F.least(F.col("stop") - offset, F.lit(count)).alias("stop"))
    return merge_ranges(moved.where("start < stop"), keys)


def always_cut(merged: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of ``axis`` with ``cut``: whether one range covers all of it."""
    per = merged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("start").alias("_a"), F.max("stop").alias("_b"))
    return axis.join(per, keys, "left").select(*keys, F.coalesce((F.col("_n") == 1) & (F.col("_a") <= 0) & (F.col("_b") >= F.col("nsamps")), F.lit(False)).alias("cut"))


def set_always_cut(df: DataFrame, axis: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """Ranges with those of the chosen keys replaced by the whole axis."""
    whole = axis.join(chosen.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(0).alias("start"), F.col("nsamps").alias("stop"))
    return df.select(*keys, "start", "stop").join(chosen.select(*keys).distinct(), keys, "left_anti").unionByName(whole)


def merge_tables(a: DataFrame, b: DataFrame, keys: list[str], axis: DataFrame, b_keys: DataFrame, cut_missing: bool = False) -> DataFrame:
    """Union of two sets of ranges over the keys of ``axis``; keys that ``b_keys`` lacks are ignored or always cut."""
    both = a.select(*keys, "start", "stop").unionByName(b.join(axis, keys, "left_semi").select(*keys, "start", "stop"))
    if cut_missing:
        both = both.unionByName(axis.join(b_keys.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("start"), F.col("nsamps").alias("stop")))
    return merge_ranges(both, keys)


def ranges_of_mask(df: DataFrame, keys: list[str], samp: str, mask: Column) -> DataFrame:
    """Runs of consecutive samples where the mask holds."""
    rows = df.where(mask).select(*keys, F.col(samp).alias("_s"))
    run = rows.withColumn("_g", F.col("_s") - F.row_number().over(Window.partitionBy(*keys).orderBy("_s")))
    return run.groupBy(*keys, "_g").agg(F.min("_s").alias("start"), (F.max("_s") + 1).alias("stop")).drop("_g")


def mask_of_ranges(df: DataFrame, axis: DataFrame, keys: list[str], invert: bool = False) -> DataFrame:
    """(keys, samp) of the samples inside the ranges, or of all others."""
    use = complement(merge_ranges(df, keys), axis, keys) if invert else merge_ranges(clamp(df, axis, keys), keys)
    return use.select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("samp"))


def in_ranges(samples: DataFrame, ranges: DataFrame, keys: list[str], samp: str, block: int = 4096, anti: bool = False) -> DataFrame:
    """Samples inside (or outside) any range of their key, by an equal join on blocks of the axis.

    ``ranges`` must be merged; then a sample is in one range at most.
    """
    cut = ranges.select(*keys, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("_b"))
    with_block = samples.withColumn("_b", F.floor(F.col(samp) / block))
    r = cut.select(*[F.col(k).alias(f"_{k}") for k in keys], "start", "stop", F.col("_b").alias("_rb"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_b") == F.col("_rb"), F.col(samp) >= F.col("start"), F.col(samp) < F.col("stop")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return with_block.join(r, cond, "left_anti" if anti else "left_semi").drop("_b")


def cut_fraction(merged: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_ranges, fraction) of the axis that is cut."""
    per = merged.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("t"))
    return axis.join(per, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_ranges"), F.coalesce(F.col("t") / F.col("nsamps"), F.lit(0.0)).alias("fraction"))


def recovered_cuts(merged: DataFrame, axis: DataFrame, keys: list[str], max_fraction: float, max_ranges: int) -> DataFrame:
    """Ranges in which keys cut by more than a fraction, or into more than so many ranges, are cut always."""
    bad = cut_fraction(merged, axis, keys).where((F.col("fraction") > max_fraction) | (F.col("n_ranges") > max_ranges))
    return set_always_cut(merged, axis, keys, bad)


def derived_flag(flags: DataFrame, axis: DataFrame, keys: list[str], positive: list[str], negative: list[str]) -> DataFrame:
    """Union of the positive flags' ranges and of the complement of each negative flag's ranges."""
    use = flags.where(F.col("flag").isin(positive)).select(*keys, "start", "stop")
    for f in negative:
        use = use.unionByName(complement(merge_ranges(clamp(flags.where(F.col("flag") == f), axis, keys), keys), axis, keys))
    return merge_ranges(clamp(use, axis, keys), keys)


def pack_flags(flags: DataFrame, axis: DataFrame, keys: list[str], bits: dict[str, int]) -> DataFrame:
    """(keys, index, mask): the bits in force from each sample on where they change, from sample 0. Any number of ranges may overlap."""
    merged = merge_ranges(clamp_flags(flags, axis, keys, bits), [*keys, "flag"])
    code = F.create_map(*[x for f, b in bits.items() for x in (F.lit(f), F.lit(1 << b))])[F.col("flag")].cast("long")
    ends = merged.join(axis, keys).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("index"), code.alias("d")), F.struct(F.col("stop").alias("index"), (-code).alias("d")))).alias("e"), "nsamps")
    ev = ends.select(*keys, F.col("e.index").alias("index"), F.col("e.d").alias("d"), "nsamps").where("index < nsamps").drop("nsamps")
    ev = ev.unionByName(axis.select(*keys, F.lit(0).alias("index"), F.lit(0).cast("long").alias("d")))
    per = ev.groupBy(*keys, "index").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("index")
    state = per.withColumn("mask", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return state.where((F.col("d") != 0) | (F.col("index") == 0)).select(*keys, "index", "mask")


def clamp_flags(flags: DataFrame, axis: DataFrame, keys: list[str], bits: dict[str, int]) -> DataFrame:
    """Flag ranges of the named flags, cut to the axis."""
    got = flags.where(F.col("flag").isin(list(bits))).join(axis, keys)
    return got.select(*keys, "flag", F.greatest("start", F.lit(0)).alias("start"), F.least("stop", "nsamps").alias("stop")).where("start < stop")


def unpack_flags(packed: DataFrame, axis: DataFrame, keys: list[str], bits: dict[str, int]) -> DataFrame:
    """(keys, flag, start, stop) of packed flags; the last state holds to the end of the axis."""
    w = Window.partitionBy(*keys).orderBy("index")
    state = packed.join(axis, keys).select(*keys, F.col("index").alias("start"), F.coalesce(F.lead("index").over(w), F.col("nsamps")).alias("stop"), "mask")
    flag = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(b).alias("bit")) for f, b in bits.items()])).alias("f")
    on = state.select(*keys, "start", "stop", "mask", flag).where("shiftright(mask, f.bit) & 1 = 1").select(*keys, F.col("f.flag").alias("flag"), "start", "stop")
    return merge_ranges(on, [*keys, "flag"])
