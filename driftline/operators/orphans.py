"""References to records that do not exist.

Every listing of a record is a change delta (+1 when it is added, -1 when it is removed) and every reference counts
for its key. ``orphans_at`` keeps the signed existence count of each key along time and reports each reference made
while that count is zero. ``fold_counts`` keeps both counts per key from batches of deltas, for a report of the keys
that are orphans now.

A key may hold a large part of all references. Time is therefore cut into blocks, and rows are moved once, by key and block: the net of
each is added up, its running sum carries the count into each block, and only the rows of one key in one block are
sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listing_deltas(listed: DataFrame, tbl: str, key, added: str = "added", removed: str = "removed") -> DataFrame:
    """(tbl, key, at, delta) of the rows of a registry: +1 at ``added``, -1 at ``removed`` unless that is null.

    A row with a null key or null ``added``, or removed no later than it was added, is never in force and gives none.
    Repeated rows give repeated deltas, which cancel out.
    """
    at = F.array(F.struct(F.col(added).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(removed).alias("at"), F.lit(-1).alias("delta")))
    rows = listed.where(F.col(added).isNotNull() & key.isNotNull() & (F.col(removed).isNull() | (F.col(removed) > F.col(added))))
    return rows.select(key.alias("key"), F.explode(at).alias("d")).select(F.lit(tbl).alias("tbl"), "key", F.col("d.at").alias("at"), F.col("d.delta").cast("long").alias("delta")).where("at is not null")


def orphans_at(refs: DataFrame, deltas: DataFrame, block: str = "day") -> DataFrame:
    """References for whose key no record is in force at their time.

    ``refs``: tbl, key, at, row_id. ``deltas``: tbl, key, at, delta as from ``listing_deltas``. A change at the time of
    a reference comes before it. Result: tbl, period (100 * year + month of ``at``), row_id, once per tbl and row_id
    (of differing repeats the earliest). References with a null key or time refer to nothing and are passed over.
    ``block`` is the unit of time (as of ``date_trunc``) within which the rows of one key are sorted together.
    """
    start = F.date_trunc(block, F.col("at")).cast("timestamp_ntz")
    typed = lambda df, kind, delta, row: df.select("tbl", "key", F.col("at").cast("timestamp_ntz").alias("at"), F.lit(kind).alias("kind"), delta.cast("long").alias("delta"), row.cast("long").alias("row_id")).withColumn("blk", start)
    nothing = F.lit(None)
    changes = typed(deltas, 1, F.col("delta"), nothing)
    asked = typed(refs.where("key is not null and at is not null"), 2, F.lit(0), F.col("row_id"))
    own = ["tbl", "key", "blk"]
    events = changes.unionByName(asked).repartition(*own)  # both uses below read this exchange
    # the last row, references coming last, tells whether a block asks at all; it needs every column, so both uses share one exchange
    net = events.groupBy(*own).agg(F.sum("delta").alias("net"), F.max(F.struct("kind", "at", "row_id")).alias("last"))
    before = Window.partitionBy("tbl", "key").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = net.select(*own, "last", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("carried")).where("carried <> 0 and last.kind = 2").drop("last")
    along = Window.partitionBy(*own).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("exists", F.sum("delta").over(along)).where("kind = 2").join(carried, own, "left")
    period = 100 * F.year("at") + F.month("at")
    return counted.where("exists + coalesce(carried, 0) <= 0").groupBy("tbl", "row_id").agg(F.min(period).cast("int").alias("period")).select("tbl", "period", "row_id")


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphan references per table and period."""
    return found.groupBy("tbl", "period").agg(F.count("*").alias("n_orphans"))


def fold_counts(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Counts per (tbl, key) after a batch: (tbl, key, n_refs, n_exists), the new state of the ledger.

    ``changes``: tbl, key, d_refs, d_exists, both signed. Batches may come in any order and be folded in any grouping.
    """
    new = changes.select("tbl", "key", F.col("d_refs").alias("n_refs"), F.col("d_exists").alias("n_exists"))
    rows = new if state is None else state.select("tbl", "key", "n_refs", "n_exists").unionByName(new)
    return rows.groupBy("tbl", "key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_exists").alias("n_exists"))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist: positive references, no existence."""
    return state.where("n_refs > 0 and n_exists <= 0")
