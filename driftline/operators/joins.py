"""Joins by nearest reading, interval, box and distance, and lookups with defaults."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 50_000


def bounded(df: DataFrame, rows: int = SMALL) -> tuple[DataFrame, bool]:
    """``df``, marked for broadcasting if it has at most ``rows`` rows, and whether it is."""
    few = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if few else df), few


def few_groups(df: DataFrame, keys: list[str], rows: int = SMALL) -> bool:
    """Whether ``df`` has at most ``rows`` groups; reads the keys alone."""
    return df.select(*keys).distinct().limit(rows + 1).count() <= rows


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, parts: int = 64) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each.

    With ``few`` (see ``few_groups``) the groups are broadcast and the rows stay where they are; else every group goes to ``parts`` parts,
    so that the rows of a hot one are joined in as many. Keys may be null.
    """
    same = lambda a: [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in a]
    named = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    if few:
        return rows.join(F.broadcast(named), reduce(lambda a, b: a & b, same(keys)), "left").drop(*[f"_of_{k}" for k in keys])
    own = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    named = named.withColumn("_of__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return own.join(named, reduce(lambda a, b: a & b, same([*keys, "_part"])), "left").drop("_part", "_of__part", *[f"_of_{k}" for k in keys])


def first_rows(table: DataFrame, keys: list[str], columns: list[str], order: Column | None = None) -> DataFrame:
    """``keys`` and columns of the first row of each key, all of one row: by ``order``, else as the table is read."""
    rows = table.select(*keys, F.struct(*columns).alias("_row"), (F.monotonically_increasing_id() if order is None else order).alias("_ord"))
    return rows.groupBy(*keys).agg(F.min_by("_row", "_ord").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def lookup(df: DataFrame, table: DataFrame, keys: list[str], columns: dict[str, object], order: Column | None = None) -> DataFrame:
    """``df`` with columns of the first row of ``table`` (see ``first_rows``) with its keys, defaults for missing rows and values, and ``found``."""
    one = first_rows(table, keys, list(columns), order).withColumn("found", F.lit(True))
    got = df.join(one, keys, "left")
    for c, default in columns.items():
        got = got.withColumn(c, F.coalesce(c, F.lit(default)))
    return got.withColumn("found", F.coalesce("found", F.lit(False)))


def nearest_reading(queries: DataFrame, readings: DataFrame, keys: list[str], time: str, value: str, block: float = 86400.0) -> DataFrame:
    """``queries`` with the value of the nearest reading of their keys and ``dt`` (reading less query), clamped at both ends.

    Of two equally near the later counts; of readings at one time the largest value. Time is cut into blocks of a key, each of
    which receives the last reading before and the first after it, so no key is sorted as a whole. Queries whose key has no
    reading get nulls. Null times have no reading.
    """
    blk = F.floor(F.col(time) / F.lit(block))
    r = readings.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).cast("double").alias("_t")).agg(F.max(value).alias("_v")).withColumn("_b", F.floor(F.col("_t") / F.lit(block)))
    q = queries.withColumn("_t", F.col(time).cast("double")).withColumn("_b", blk)
    item = F.struct("_t", "_v")
    edge = r.groupBy(*keys, "_b").agg(F.min(item).alias("_first"), F.max(item).alias("_last"))
    spots = edge.unionByName(q.select(*keys, "_b").distinct(), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b")
    lent = spots.select(*keys, "_b", F.array(F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing))).alias("_x"))
    lent = lent.select(*keys, "_b", F.explode("_x").alias("_x")).where("_x is not null").select(*keys, F.col("_x._t").alias("_t"), F.col("_x._v").alias("_v"), "_b")
    cols = [c for c in queries.columns]
    both = q.withColumn("_v", F.lit(None).cast(dict(r.dtypes)["_v"])).withColumn("_q", F.lit(True)).unionByName(r.unionByName(lent).withColumn("_q", F.lit(False)), allowMissingColumns=True)
    o = Window.partitionBy(*keys, "_b").orderBy("_t")
    have = F.when(~F.col("_q"), item)
    both = both.withColumn("_p", F.last(have, True).over(o.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(have, True).over(o.rangeBetween(0, Window.unboundedFollowing)))
    dp, dn = F.col("_t") - F.col("_p._t"), F.col("_n._t") - F.col("_t")
    best = F.when(F.col("_p").isNull() | (dn <= dp), F.col("_n")).otherwise(F.col("_p"))
    return both.where("_q").withColumn("_best", best).select(*cols, F.col("_best._v").alias(value), (F.col("_best._t") - F.col("_t")).alias("dt"))


def nearest_within(queries: DataFrame, readings: DataFrame, keys: list[str], time: str, value: str, tolerance: float, missing: float = -1.0, top: float | None = None) -> DataFrame:
    """As ``nearest_reading``; farther than ``tolerance`` gives ``missing``, values above ``top`` give ``top``."""
    got = nearest_reading(queries, readings, keys, time, value)
    v = F.col(value) if top is None else F.least(F.col(value), F.lit(top))
    return got.withColumn(value, F.when(F.abs("dt") <= tolerance, v).otherwise(F.lit(missing)))


def seek(queries: DataFrame, readings: DataFrame, keys: list[str], time: str, block: float = 86400.0) -> DataFrame:
    """``queries`` with ``at``, the time of the first reading of their keys at or after theirs; null if there is none.

    Time is cut into blocks of a key; a block has its own readings and the first one of those after it. Null times and keys find nothing.
    """
    blk = lambda c: F.floor(c / F.lit(block))
    t = F.col(time).cast("double")
    r = readings.where(F.col(time).isNotNull()).select(*keys, t.alias("_t"), blk(t).alias("_b")).distinct()
    q = queries.withColumn("_t", t).withColumn("_b", blk(t))
    first = r.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"))
    spots = first.unionByName(q.select(*keys, "_b").distinct(), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max("_first").alias("_first"))
    later = F.first("_first", True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing))
    lent = spots.select(*keys, later.alias("_t"), "_b").where("_t is not null")
    both = q.withColumn("_q", F.lit(True)).unionByName(r.unionByName(lent).withColumn("_q", F.lit(False)), allowMissingColumns=True)
    ahead = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    return both.withColumn("at", F.first(F.when(~F.col("_q"), F.col("_t")), True).over(ahead)).where("_q").withColumn("at", F.when(F.col("_t").isNotNull(), F.col("at"))).select(*queries.columns, "at")


def interval_lookup(df: DataFrame, intervals: DataFrame, time: str, columns: list[str], on: list[str] | None = None) -> DataFrame:
    """``df`` with columns of the first interval (by ``ord``) with t0 <= time < t1; nulls if there is none.

    The intervals are first cut at each other's ends into pieces that don't overlap, each of which belongs to the interval of least
    ``ord`` over it, so a row meets one piece at most. A table of at most ``SMALL`` intervals is broadcast; beyond that both joins go by
    buckets of time as wide as the mean interval, an interval or piece going to each bucket it meets.
    """
    on = on or []
    keys = [f"_k{i}" for i in range(len(on))]
    iv, few = bounded(intervals.where("t0 < t1").select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.col("ord").alias("_o"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1"), F.struct(*columns).alias("_s")))
    width = 1.0 if few else float(iv.agg(F.avg(F.col("_t1") - F.col("_t0"))).first()[0] or 1.0)
    bucket = lambda c: F.lit(0) if few else F.floor(c / width)
    buckets = lambda a, z: F.array(F.lit(0)) if few else F.sequence(F.floor(a / width), F.floor(z / width))
    edges = iv.select(*keys, F.explode(F.array("_t0", "_t1")).alias("_a")).distinct()
    piece = edges.withColumn("_z", F.lead("_a").over(Window.partitionBy(*keys).orderBy("_a"))).where("_z is not null").withColumn("_b", bucket(F.col("_a")))
    over = iv.withColumn("_b", F.explode(buckets(F.col("_t0"), F.col("_t1"))))
    over = over.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_ob"), "_o", "_t0", "_t1", "_s")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("_b") == F.col("_ob"))
    owned = piece.join(over, same & (F.col("_t0") <= F.col("_a")) & (F.col("_a") < F.col("_t1"))).groupBy(*keys, "_a", "_z").agg(F.min_by("_s", "_o").alias("_s"))
    owned = owned.withColumn("_b", F.explode(buckets(F.col("_a"), F.col("_z"))))
    owned = F.broadcast(owned) if few else owned
    t = F.col(time)
    rows = df.withColumn("_q", bucket(t))
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in zip(on, keys)], (F.col("_q") == F.col("_b")) & (t >= F.col("_a")) & (t < F.col("_z")))
    return rows.join(owned, cond, "left").select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in columns])


def files_overlapping(files: DataFrame, t0: float, t1: float) -> DataFrame:
    """Files whose name ``<prefix>_<start>_<stop>.dat`` says that they overlap [t0, t1), in order of time."""
    part = lambda i: F.regexp_extract("name", r"_(\d+)_(\d+)\.dat$", i)
    got = files.where(part(1) != "").withColumn("start", part(1).cast("long")).withColumn("stop", part(2).cast("long"))
    return got.where((F.col("start") < t1) & (F.col("stop") > t0))


def sources_in_patch(df: DataFrame, ra: str, dec: str, ra_range: tuple[float, float], dec_range: tuple[float, float], period: float = 360.0) -> DataFrame:
    """Rows inside a box in the sky whose RA range may go across 0."""
    lo, hi = ra_range
    width = (hi - lo) % period
    return df.where((F.pmod(F.col(ra) - lo, F.lit(period)) <= width) & F.col(dec).between(*dec_range))


def within_distance(df: DataFrame, keys: list[str], ident: str, x: str, y: str, lo: float, hi: float) -> DataFrame:
    """(keys, ident, n): number of rows of the same keys at a distance of lo <= d < hi, itself included if lo is 0.

    Positions are put on a grid of cells of size ``hi`` and compared with the nine cells around them.
    """
    cx, cy = F.floor(F.col(x) / hi), F.floor(F.col(y) / hi)
    a = df.select(*keys, F.col(ident).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"), cx.alias("_cx"), cy.alias("_cy"))
    step = F.sequence(F.lit(-1), F.lit(1))
    b = df.select(*keys, F.col(x).alias("_u"), F.col(y).alias("_v"), cx.alias("_px"), cy.alias("_py")).withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    b = b.select(*keys, "_u", "_v", (F.col("_px") + F.col("_dx")).alias("_cx"), (F.col("_py") + F.col("_dy")).alias("_cy"))
    d2 = (F.col("_x") - F.col("_u")) ** 2 + (F.col("_y") - F.col("_v")) ** 2
    near = a.join(b, [*keys, "_cx", "_cy"]).where((d2 >= lo * lo) & (d2 < hi * hi)).groupBy(*keys, "_i").agg(F.count("*").alias("n"))
    return df.select(*keys, F.col(ident).alias("_i")).join(near, [*keys, "_i"], "left").select(*keys, F.col("_i").alias(ident), F.coalesce("n", F.lit(0)).alias("n"))


def pairwise_correlation(df: DataFrame, keys: list[str], det: str, samp: str, value: str) -> DataFrame:
    """(keys, a, b, cov, corr) of the detectors of each observation over the samples that both have, a < b.

    The result is the covariance matrix; it comes from products of the observation's matrix, not from pairs of rows. Pairs with
    fewer than two common samples have nulls, as has the correlation with a constant stream.
    """
    import numpy as np
    import pandas as pd

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dets, at = np.unique(pdf["_d"], return_inverse=True)
        _, col = np.unique(pdf["_s"], return_inverse=True)
        x, m = np.zeros((len(dets), col.max() + 1)), np.zeros((len(dets), col.max() + 1))
        x[at, col], m[at, col] = pdf["_x"], 1.0
        x = (x - (x.sum(1) / m.sum(1))[:, None]) * m
        n, sx, xx = m @ m.T, x @ m.T, (x * x) @ m.T
        xy = x @ x.T
        a, b = np.triu_indices(len(dets), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = xy[a, b] - sx[a, b] * sx[b, a] / n[a, b]
            va, vb = xx[a, b] - sx[a, b] ** 2 / n[a, b], xx[b, a] - sx[b, a] ** 2 / n[a, b]
            corr = np.where((va > 1e-12 * xx[a, b]) & (vb > 1e-12 * xx[b, a]), cov / np.sqrt(va * vb), np.nan)
            cov = np.where(n[a, b] > 1, cov / (n[a, b] - 1), np.nan)
        keep = n[a, b] > 0
        return pd.DataFrame({**dict(zip(keys, key)), "a": dets[a][keep], "b": dets[b][keep], "cov": cov[keep], "corr": corr[keep]})

    kinds = dict(df.dtypes)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(det).alias("_d"), F.col(samp).alias("_s"), F.col(value).cast("double").alias("_x"))
    got = src.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", a {kinds[det]}, b {kinds[det]}, cov double, corr double")
    return got.withColumn("cov", F.nanvl("cov", F.lit(None).cast("double"))).withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def radial_bins(pairs: DataFrame, places: DataFrame, det: str, edges: list[float]) -> DataFrame:
    """(bin, n, p34, p50, p66) of the correlation of pairs by their distance, bins [lo, hi)."""
    p = places.select(det, "x", "y")
    a, b = p.toDF("a", "ax", "ay"), p.toDF("b", "bx", "by")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    got = pairs.join(a, "a").join(b, "b").withColumn("_d", d)
    bin_ = reduce(lambda e, i: e.when((F.col("_d") >= edges[i]) & (F.col("_d") < edges[i + 1]), i), range(1, len(edges) - 1), F.when((F.col("_d") >= edges[0]) & (F.col("_d") < edges[1]), 0))
    got = got.withColumn("bin", bin_).where("bin is not null").select("bin", "corr")
    from driftline.operators.stats import order_statistics

    at = lambda q: (F.col("n") - 1) * q
    qs = (0.34, 0.5, 0.66)
    size = got.groupBy("bin").agg(F.count("*").alias("_all"))
    got = order_statistics(got, ["bin"], "corr", {f"{side}{i}": f(at(q)).cast("long") for i, q in enumerate(qs) for side, f in (("lo", F.floor), ("hi", F.ceil))}, spread=True)
    return got.join(size, "bin").select("bin", F.col("_all").alias("n"), *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at(q) - F.floor(at(q)))).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


def resample_join(slow: DataFrame, keys: list[str], samp: str, factor_slow: int, factor: int, count: int | None = None) -> DataFrame:
    """Slow channel read on a grid of another rate: output sample i takes slow sample i * factor_slow // factor.

    The grid is as long as the channel, or has ``count`` samples. Each slow sample gives the output samples that take it.
    """
    first = lambda i: F.ceil(i * factor / factor_slow).cast("int")
    at, last = F.col(samp), first(F.col(samp) + 1) - 1
    last = last if count is None else F.least(last, F.lit(count - 1))
    some = slow.withColumn("_first", first(at)).withColumn("_last", last).where((at >= 0) & (F.col("_first") <= F.col("_last")))
    return some.withColumn(samp, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def angular_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in radians."""
    s = F.sin((dec2 - dec1) / 2) ** 2 + F.cos(dec1) * F.cos(dec2) * F.sin((ra2 - ra1) / 2) ** 2
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def degrees(x: float) -> float:
    return math.degrees(x)
