"""Continuous periods and gaps of overlapping ranges.

``periods_and_gaps`` ranks the starts and the ends of each entity independently of each other and sets the end of rank k beside the
start of rank k + 1: a gap exists exactly where that start exceeds that end. The boundaries between gaps, taken in pairs, are the
continuous periods. Before rows are moved, every task unites the ranges it has read of an entity, so repeated, nested and
overlapping ranges don't travel, and there is one exchange, by entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import shipped


def _unite(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Ranges (keys..., lo, hi, n) of which those of one entity that overlap or touch are one, among ``rows`` rows at a time; n is their largest."""

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for c in t.column_names[:width]:  # numbered anew after each column, so codes stay below the number of rows
            d = t[c].combine_chunks().dictionary_encode()
            code = code * len(d.dictionary) + d.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        lo, hi, n = (t[c].to_numpy().astype(np.int64) for c in t.column_names[width:])
        o = np.lexsort((lo, code))
        base = code[o] << 33
        end = np.maximum.accumulate(base + hi[o])
        first = np.flatnonzero(np.r_[True, base[1:] + lo[o][1:] > end[:-1]])
        last = np.append(first[1:], len(o)) - 1
        got = t.select(t.column_names[:width]).take(pa.array(o[first])).combine_chunks()
        cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
        kept = [lo[o][first], end[last] - base[last], np.maximum.reduceat(n[o], first)]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(v.astype(np.int32)) for v in kept]], names=t.column_names)

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield work(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield work(pa.Table.from_batches(held))


def periods_and_gaps(
    ranges: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", length: str = "nsamps", rows: int = 200_000
) -> DataFrame:
    """``keys``, kind (``period`` or ``gap``), start, stop of the union of half-open ranges within [0, length).

    A range counts by what of it lies within the axis. One with a null end or null length, a reversed or an empty one
    holds nothing; an entity whose ranges all hold nothing has no rows. Rows with a null key belong to no entity.
    Repeated ranges change nothing. If lengths of one entity differ, the largest bounds its last gap. Other columns
    of ``ranges`` are ignored, also if named like those of the result. An empty table gives an empty result. Tasks unite ranges among
    ``rows`` rows at a time.
    """
    shipped(ranges.sparkSession)
    n = F.col(length).cast("int")
    lo = F.greatest(F.col(start).cast("int"), F.lit(0))
    hi = F.least(F.col(stop).cast("int"), n)
    known: Column = F.col(start).isNotNull() & F.col(stop).isNotNull() & n.isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = [f"_k{i}" for i in range(len(keys))]
    inside = ranges.where(known).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], lo.alias("_lo"), hi.alias("_hi"), n.alias("_n")).where("_lo < _hi")
    width = len(keys)
    united = inside.mapInArrow(lambda it: _unite(it, width, rows), inside.schema).repartition(*own)
    bounds = united.select(*own, "_n", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("_lo").alias("pos")), F.struct(F.lit(1).alias("end"), F.col("_hi").alias("pos")))).alias("b")).select(*own, "_n", "b.*")
    ranked = bounds.withColumn("_rank", F.row_number().over(Window.partitionBy(*own, "end").orderBy("pos")))
    # the end of rank k beside the start of rank k + 1; before the first start there is no end, after the last end no start
    beside = ranked.groupBy(*own, (F.col("_rank") - 1 + F.col("end")).alias("_after")).agg(
        F.max(F.when(F.col("end") == 1, F.col("pos"))).alias("_end"), F.max(F.when(F.col("end") == 0, F.col("pos"))).alias("_start"), F.max("_n").alias("_n")
    )
    beside = beside.withColumn("_n", F.max("_n").over(Window.partitionBy(*own)))
    gaps = beside.where("_end is null or _start is null or _start > _end")
    paired = gaps.withColumn("_from", F.lag("_start").over(Window.partitionBy(*own).orderBy("_after")))
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("stop"))
    period = F.when(F.col("_end").isNotNull(), piece("period", F.col("_from"), F.col("_end")))
    gap = piece("gap", F.coalesce("_end", F.lit(0)), F.coalesce("_start", "_n"))
    return (
        paired.select(*own, F.explode(F.array(period, gap)).alias("p"))
        .where("p.start < p.stop")
        .select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "p.kind", "p.start", "p.stop")
    )
