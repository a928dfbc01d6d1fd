"""Pairing of records by nearest time.

Both tables are cut along time into blocks of an entity, the right one with the records within the tolerance of a block
as well, so one busy entity is spread over many tasks. Each partition is sorted by entity, block and time and read once by
a merge that holds the last right record before, and the left records that still wait for the next right one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import shipped


def _codes(t: pa.Table) -> np.ndarray:
    """True where a row's entity or block differs from that of the row before."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("_key", "_blk"):
        col = t[c].combine_chunks()
        if t.num_rows > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return new


def _merge(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def step(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        t = t.combine_chunks()
        n = t.num_rows
        new = _codes(t)
        group = np.cumsum(new)
        at = t["_t"].to_numpy()
        left = t["_left"].to_numpy(zero_copy_only=False)
        # rows of the last moment wait, for others of the same moment may follow
        moved = np.flatnonzero(new[1:] | (at[1:] != at[:-1])) + 1
        end = n if last else int(moved[-1]) if len(moved) else 0
        if not end:
            return None, t
        i = np.arange(end)
        same = np.zeros(end, bool)
        same[1:] = ~new[1:end] & (at[1:end] == at[: end - 1])
        right = ~left[:end]
        # of right records of one moment the last in order counts
        right[:-1] &= ~(same[1:] & right[1:])
        ids = t["_lid"].combine_chunks()
        again = np.zeros(end, bool)
        if end > 1:
            equal = pc.fill_null(pc.equal(ids.slice(1, end - 1), ids.slice(0, end - 1)), False).to_numpy(zero_copy_only=False)
            again[1:] = same[1:] & left[1:end] & left[: end - 1] & equal
        prev = np.maximum.accumulate(np.where(right, i, -1))
        nxt = np.minimum.accumulate(np.where(right, i, end)[::-1])[::-1]
        g = group[:end]
        has_p = (prev >= 0) & (g[np.maximum(prev, 0)] == g)
        has_n = (nxt < end) & (g[np.minimum(nxt, end - 1)] == g)
        dp = np.where(has_p, at[:end] - at[np.maximum(prev, 0)], np.inf)
        dn = np.where(has_n, at[np.minimum(nxt, end - 1)] - at[:end], np.inf)
        ask = left[:end] & ~again
        open_ = np.zeros(end, bool)
        if not last:
            now, alive = at[end], group[end] == g
            open_ = ask & alive & ~has_n & (at[:end] + tolerance >= now)
        pick = np.where(dn <= dp, nxt, prev)
        hit = np.flatnonzero(ask & ~open_ & (np.minimum(dp, dn) <= tolerance))
        out = None
        if len(hit):
            out = pa.RecordBatch.from_arrays(
                [t["_lid"].combine_chunks().take(pa.array(hit)), t["_rid"].combine_chunks().take(pa.array(pick[hit])), pa.array(at[pick[hit]] - at[hit])],
                names=["_lid", "_rid", "lag"],
            )
        if last:
            return out, None
        keep = np.flatnonzero(open_)
        if group[end] == g[-1] and prev[-1] >= 0 and has_p[-1]:
            keep = np.union1d(keep, [prev[-1]])
        if len(keep):  # right records before the oldest open left one
            keep = np.union1d(keep, prev[keep][has_p[keep]])
        rest = t.slice(end)
        return out, pa.concat_tables([t.take(pa.array(keep)), rest]) if len(keep) else rest

    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        out, held = step(held, False)
        if out is not None:
            yield out
    if held is not None and held.num_rows:
        out, _ = step(held, True)
        if out is not None:
            yield out


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_time: str, right_time: str, left_id: str, right_id: str,
    tolerance: float, block: float | None = None,
) -> DataFrame:
    """``left_id``, ``right_id`` and lag (right less left time) of the nearest right record of the same key within ``tolerance``.

    Of two equally near the later one; of several at one time that with the largest id. Times are numbers of one unit; a
    row with a null key, or with a null, NaN or infinite time, has no partner. A left row without a partner has no row. Left
    rows that repeat key, time and id count once. The two ids may have the same name: the right one is then called
    ``right_<name>``. Other columns are ignored. Empty tables give an empty result. ``block`` is the length of the
    stretches of time one task handles, ten times the tolerance unless given.
    """
    shipped(left.sparkSession)
    b = float(block or max(10 * tolerance, 1e-6))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    lt, rt = F.col(left_time).cast("double"), F.col(right_time).cast("double")
    blk = lambda c: F.floor(c / F.lit(b))
    kinds = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]
    none = F.lit(None)
    asks = left.where(left_key.isNotNull() & fine(lt)).select(
        left_key.alias("_key"), blk(lt).alias("_blk"), lt.alias("_t"), F.lit(True).alias("_left"), F.col(left_id).alias("_lid"), none.cast(kinds[1]).alias("_rid")
    )
    near = F.array_distinct(F.array(blk(rt - tolerance), blk(rt), blk(rt + tolerance)))
    gives = right.where(right_key.isNotNull() & fine(rt)).select(
        right_key.alias("_key"), F.explode(near).alias("_blk"), rt.alias("_t"), F.lit(False).alias("_left"), none.cast(kinds[0]).alias("_lid"), F.col(right_id).alias("_rid")
    )
    both = asks.unionByName(gives).repartition("_key", "_blk").sortWithinPartitions("_key", "_blk", "_t", "_left", "_rid", "_lid")
    found = both.mapInArrow(lambda it: _merge(it, tolerance), f"_lid {kinds[0]}, _rid {kinds[1]}, lag double")
    name = right_id if right_id != left_id else f"right_{right_id}"
    return found.select(F.col("_lid").alias(left_id), F.col("_rid").alias(name), "lag")
