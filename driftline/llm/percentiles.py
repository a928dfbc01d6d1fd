"""Percentiles of very large columns by relative-rank compactors.

A sketch is a stack of compactors; an item of level h stands for 2**h values. A full compactor sorts its items, never
touches the half next to the tail it protects, and promotes every other item of a region at the opposite end. The
region grows and shrinks with the number of trailing ones of the compaction count, so items nearer the protected tail
are compacted exponentially less often; the error of a rank is then proportional to its distance from that tail. Two
stacks, one for each tail, make one sketch; each percentile is answered by the stack of its nearer tail. Sketches
merge level by level, so those of partitions, days or any set of days combine. While all values fit
into one compactor they are kept as they are and percentiles are exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import bounded
from driftline.session import checkpointed, shipped

SECTION = 128
SECTIONS = 3


class Stack:
    """Compactors that protect the high tail (``high``) or the low one."""

    def __init__(self, high: bool, k: int):
        self.high, self.k = high, k
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.counts: list[int] = [0]

    def _shape(self, h: int) -> tuple[int, int]:
        """Section size and number of sections of level h; they change with the compactions it has had."""
        k, m = float(self.k), SECTIONS
        while self.counts[h] >= 1 << (m - 1) and k > 8:
            k, m = k / 2**0.5, 2 * m
        return 2 * round(k / 2), m

    def capacity(self, h: int) -> int:
        k, m = self._shape(h)
        return 2 * k * m

    def compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self.capacity(h) and len(self.levels[h]) > 1:
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        k, m = self._shape(h)
        items = np.sort(self.levels[h])
        if not self.high:
            items = items[::-1]
        c = self.counts[h]
        free = ((~c & (c + 1)).bit_length() - 1) + 1  # trailing ones, plus one
        region = len(items) - 2 * k * m + k * min(free, m) if len(items) > 2 * k * m else k * min(free, m)
        region -= region % 2
        # a coin that depends on the contents only, so that a rerun gives the same sketch
        coin = (hash((h, c, float(items[region - 1]), len(items))) >> 7) & 1
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.counts.append(0)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[:region][coin::2]])
        self.levels[h] = items[region:]
        self.counts[h] = c + 1

    def merge(self, other: Stack) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.counts.append(0)
        for h, (x, c) in enumerate(zip(other.levels, other.counts)):
            self.levels[h] = np.concatenate([self.levels[h], x])
            self.counts[h] |= c
        self.compress()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.repeat(1 << np.arange(len(self.levels)), [len(x) for x in self.levels])
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o])


class Sketch:
    """Two stacks and the count; one buffer of plain values while they fit."""

    def __init__(self, k: int = SECTION):
        self.k, self.n = k, 0
        self.plain: np.ndarray | None = np.zeros(0)
        self.low = self.high = None
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def take(self, values: np.ndarray) -> Sketch:
        """As ``add``, in whole portions of what a compactor holds, so that it doesn't matter in which pieces values come; ``settle`` ends it."""
        room = 2 * self.k * SECTIONS
        self.waiting.append(values)
        self.n_waiting += len(values)
        if self.n_waiting >= room:
            every = np.concatenate(self.waiting)
            whole = len(every) // room * room
            for at in range(0, whole, room):
                self.add(every[at : at + room])
            self.waiting, self.n_waiting = [every[whole:]], len(every) - whole
        return self

    def settle(self) -> Sketch:
        rest, self.waiting, self.n_waiting = self.waiting, [], 0
        return self.add(np.concatenate(rest)) if rest else self

    def add(self, values: np.ndarray) -> Sketch:
        room = 2 * self.k * SECTIONS
        self.n += len(values)
        if self.plain is not None:
            self.plain = np.concatenate([self.plain, values])
            if len(self.plain) < room:
                return self
            values, self.plain = self.plain, None
            self.low, self.high = Stack(False, self.k), Stack(True, self.k)
        for at in range(0, len(values), room):
            for s in (self.low, self.high):
                s.levels[0] = np.concatenate([s.levels[0], values[at : at + room]])
                s.compress()
        return self

    def merge(self, other: Sketch) -> Sketch:
        if other.plain is not None:
            return self.add(other.plain)
        if self.plain is not None:
            mine = self.plain
            self.plain, self.low, self.high = None, other.low, other.high
            self.n = other.n
            return self.add(mine)
        self.n += other.n
        self.low.merge(other.low)
        self.high.merge(other.high)
        return self

    def quantiles(self, qs: list[float]) -> list[float]:
        """The value of rank ceil(q * n) for each q; NaN if there are none."""
        if not self.n:
            return [float("nan")] * len(qs)
        if self.plain is not None:
            v = np.sort(self.plain)
            return [float(v[min(max(int(np.ceil(q * self.n - 1e-9)), 1), self.n) - 1]) for q in qs]
        sides = {True: self.high.weighted(), False: self.low.weighted()}
        got = []
        for q in qs:
            v, w = sides[q >= 0.5]
            rank = min(max(int(np.ceil(q * self.n - 1e-9)), 1), self.n)
            if q >= 0.5:  # counted from the protected tail
                rank = int(w[-1]) - (self.n - rank)
            got.append(float(v[min(int(np.searchsorted(w, rank)), len(v) - 1)]))
        return got

    def rank_error(self, q: float) -> float:
        """Bound of the error of the rank of percentile q, as a share of the count, at three standard deviations."""
        return 0.0 if self.plain is not None else 3 * 0.1306 / self.k * 4 * min(q, 1 - q)

    def pack(self) -> bytes:
        if self.plain is not None:
            return struct.pack("<qii", self.n, self.k, 0) + self.plain.tobytes()
        parts = [struct.pack("<qii", self.n, self.k, 1)]
        for s in (self.low, self.high):
            parts.append(struct.pack("<i", len(s.levels)))
            for x, c in zip(s.levels, s.counts):
                parts += [struct.pack("<iq", len(x), c), np.ascontiguousarray(x).tobytes()]
        return b"".join(parts)

    @staticmethod
    def unpack(data: bytes) -> Sketch:
        n, k, kind = struct.unpack_from("<qii", data)
        s, at = Sketch(k), 16
        s.n = n
        if kind == 0:
            s.plain = np.frombuffer(data, np.float64, offset=at).copy()
            return s
        s.plain, s.low, s.high = None, Stack(False, k), Stack(True, k)
        for t in (s.low, s.high):
            (m,) = struct.unpack_from("<i", data, at)
            at += 4
            t.levels, t.counts = [], []
            for _ in range(m):
                size, c = struct.unpack_from("<iq", data, at)
                t.levels.append(np.frombuffer(data, np.float64, size, at + 12).copy())
                t.counts.append(c)
                at += 12 + 8 * size
        return s


def _runs(new: np.ndarray) -> list[tuple[int, int]]:
    b = np.flatnonzero(new)
    return list(zip(b, np.append(b[1:], len(new))))


def _partial(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema, most: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sketches of the (keys..., metric) of a partition, whose rows come group by group; keys in the first ``width`` columns, metrics in the others."""
    held: dict[tuple, Sketch] = {}

    def flush(last: tuple | None = None) -> pa.RecordBatch:
        """Sketches of all groups, but for ``last``, whose rows still come."""
        done = [key for key in held if key[:-1] != last]
        rows = [(*key, s.n, s.pack()) for key, s in ((key, held.pop(key).settle()) for key in done)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        names = t.column_names
        code = np.zeros(t.num_rows, np.int64)
        for c in names[:width]:
            d = t[c].combine_chunks().dictionary_encode()
            i = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            code = code * (len(d.dictionary) + 1) + i
        o = np.argsort(code, kind="stable")
        new = np.r_[True, np.diff(code[o]) != 0]
        values = {m: t[m].to_numpy()[o] for m in names[width:]}
        for a, e in _runs(new):
            key = tuple(t[c][int(o[a])].as_py() for c in names[:width])
            for m, v in values.items():
                x = v[a:e]
                x = x[np.isfinite(x)]
                if len(x):
                    held.setdefault((*key, m), Sketch(k)).take(x)
        last = tuple(t[c][t.num_rows - 1].as_py() for c in names[:width])
        if len(held) > most and any(key[:-1] != last for key in held):
            yield flush(last)
    if held:
        yield flush()


def _combine(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Merges the sketches of equal keys that follow each other; holds one."""
    now, s, rows = None, None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns - 2)]
        packed = b.column(b.num_columns - 1)
        for i, key in enumerate(zip(*cols)):
            one = Sketch.unpack(packed[i].as_py())
            if key == now:
                s.merge(one)
                continue
            if s is not None:
                rows.append((*now, s.n, s.pack()))
            now, s = key, one
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if s is not None:
        rows.append((*now, s.n, s.pack()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def _salted(rows: DataFrame, keys: list[str], spread: list[str], most: int) -> DataFrame:
    """``rows`` with ``_salt``: 0 in groups of at most ``most`` rows, else one of as many numbers as the group has times ``most`` rows.

    Rows that agree in ``spread`` get the same number. The few groups that need any are broadcast; beyond ``joins.SMALL`` of them they
    are joined by shuffle in 64 parts.
    """
    many = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    many = checkpointed(many.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.ceil(F.col("_rows") / most).alias("_parts")))  # counted once
    many, few = bounded(many)
    part = F.lit(0) if few else F.pmod(F.xxhash64(*spread, F.lit(1)), F.lit(64))
    many = many.withColumn("_part", F.lit(0) if few else F.explode(F.sequence(F.lit(0), F.lit(63))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    got = rows.withColumn("_own", part).join(many, same & (F.col("_own") == F.col("_part")), "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0).cast("long"))
    return got.withColumn("_salt", salt).drop("_own", "_part", "_parts", *[f"_h{i}" for i in range(len(keys))])


def sketch_columns(df: DataFrame, keys: list[str], columns: list[str], k: int = SECTION, once: list[Column] | None = None, most: int = 1 << 22) -> DataFrame:
    """``keys``, metric, n_values, sketch (binary) for each group and column with at least one finite value.

    Keys with the name of one of those columns come out with ``key_`` before it.
    Null, NaN and infinite values are left out; a null key is a group of its own. Rows count as often as they occur, or, with
    ``once``, one of those that agree in keys and the expressions ``once`` counts. Rows go to the task of their group, of groups of more
    than ``most`` rows to one of several; repeats are left out and partial sketches made there, so nothing but sketches goes on.
    An empty table gives an empty result.
    """
    shipped(df.sparkSession)
    from pyspark.sql import types as T

    width = len(keys)
    own = [f"_g{i}" for i in range(width)]
    named = [*[F.col(c).alias(o) for c, o in zip(keys, own)], *[F.col(c).cast("double").alias(c) for c in columns]]
    out = T.StructType([*df.select(*named).schema.fields[:width], T.StructField("metric", T.StringType()), T.StructField("n_values", T.LongType()), T.StructField("sketch", T.BinaryType())])
    schema = _arrow(out)
    marks = [f"_o{i}" for i in range(len(once or ()))]
    rows = df.select(*named, *[e.alias(m) for e, m in zip(once or (), marks)])
    rows = _salted(rows, own, marks or columns, most).repartition(*own, "_salt")
    if once:
        rows = rows.dropDuplicates([*own, "_salt", *marks])
    # a sketch depends on the order of its values; this one is the same in every run
    part = rows.sortWithinPartitions(*own, *(marks or columns)).select(*own, *columns).mapInArrow(lambda it: _partial(it, k, schema, 1000, width), out)
    names = [f"key_{c}" if c in ("metric", "n_values", "sketch") else c for c in keys]
    return merge_sketches(part.select(*[F.col(o).alias(c) for o, c in zip(own, names)], "metric", "n_values", "sketch"), names)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of the coarser groups of ``keys`` and metric, e.g. of sets of days."""
    shipped(sketches.sparkSession)
    src = sketches.select(*keys, "metric", "n_values", "sketch")
    schema = _arrow(src.schema)
    own = [*keys, "metric"]
    return src.repartition(*own).sortWithinPartitions(*own, "n_values", "sketch").mapInArrow(lambda it: _combine(it, schema), src.schema)


def sketch_items(sketches: DataFrame) -> DataFrame:
    """The items of the sketches as rows: the other columns, tail (``low``, ``high``, or ``both`` while all values are kept), level, value.

    An item stands for 2**level values. Items of any set of sketches together are the sketch of that set: up to the median its percentiles
    are the weighted ones of the items of tails low and both, above it those of high and both (see ``percentiles_of_items``).
    """
    keep = [c for c in sketches.columns if c != "sketch"]
    kinds = dict(sketches.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, packed in enumerate(b.column(b.num_columns - 1)):
                s = Sketch.unpack(packed.as_py())
                for tail, levels in [("both", [s.plain])] if s.plain is not None else [("low", s.low.levels), ("high", s.high.levels)]:
                    v = np.concatenate(levels)
                    level = np.repeat(np.arange(len(levels), dtype=np.int32), [len(x) for x in levels])
                    same = [c.take(pa.array(np.full(len(v), i))) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([tail] * len(v), pa.string()), pa.array(level), pa.array(v)], names=[*keep, "tail", "level", "value"])

    return sketches.select(*keep, "sketch").mapInArrow(read, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["tail string", "level int", "value double"]))


def percentiles_of_items(items: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """``keys``, metric, n_values and the percentiles by name from the rows of ``sketch_items`` of any set of sketches.

    Only the items of one group and metric are sorted together; their number grows with the logarithm of the values of a sketch.
    """
    own = [*keys, "metric"]
    w = F.expr("shiftleft(1L, level)")
    side = items.select(*own, "value", w.alias("_w"), F.explode(F.when(F.col("tail") == "both", F.array(F.lit("low"), F.lit("high"))).otherwise(F.array("tail"))).alias("tail"))
    by = Window.partitionBy(*own, "tail")
    ranked = side.withColumn("_n", F.sum("_w").over(by)).withColumn("_upto", F.sum("_w").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(q * F.col("_n") - 1e-9))
    value = lambda q: F.min(F.when((F.col("tail") == ("high" if q >= 0.5 else "low")) & (F.col("_upto") >= rank(q)), F.col("value")))
    return ranked.groupBy(*own).agg(F.max("_n").alias("n_values"), *[value(q).alias(name) for name, q in qs.items()])


def read_percentiles(sketches: DataFrame, qs: dict[str, float]) -> DataFrame:
    """The other columns of ``sketches``, the percentiles by name (value of rank ceil(q * n)), and the bound of each (``<name>_error``).

    A bound is that of the error of the rank, as a share of n; it is in proportion to the distance from the nearer tail, and 0 where the
    sketch holds all values.
    """
    keep = [c for c in sketches.columns if c != "sketch"]
    kinds = dict(sketches.dtypes)
    names, values = list(qs), list(qs.values())
    errors = [f"{n}_error" for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [Sketch.unpack(x.as_py()) for x in b.column(b.num_columns - 1)]
            q = np.array([x.quantiles(values) for x in s]).reshape(len(s), len(values))
            err = np.array([[x.rank_error(v) for v in values] for x in s]).reshape(len(s), len(values))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(m[:, i]) for m in (q, err) for i in range(len(values))]], names=[*keep, *names, *errors])

    return sketches.select(*keep, "sketch").mapInArrow(read, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` double" for n in [*names, *errors]]))


def ranks_within_bounds(percentiles: DataFrame, values: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """``keys``, metric, percentile, n_values, within: whether the true rank of each percentile keeps to its bound.

    ``percentiles`` as from ``read_percentiles``; ``values``: keys and a column for each metric. One pass counts the values below and up to
    each percentile.
    """
    metrics = [c for c in values.columns if c not in keys]
    one = values.unpivot(keys, metrics, "metric", "_v").where("_v is not null and not isnan(_v) and abs(_v) < double('inf')")
    got, _ = bounded(percentiles.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("metric").alias("_m"), F.array(*qs).alias("_x")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)], F.col("metric") == F.col("_m"))
    count = lambda c: F.sum(c.cast("long"))
    tally = [F.struct(count(F.col("_v") < F.col("_x")[i]).alias("below"), count(F.col("_v") <= F.col("_x")[i]).alias("upto")).alias(n) for i, n in enumerate(qs)]
    ranks = one.join(got, same).groupBy(*keys, "metric").agg(*tally)
    ranks = ranks.select(*keys, "metric", F.explode(F.array(*[F.struct(F.lit(n).alias("percentile"), f"{n}.below", f"{n}.upto") for n in qs])).alias("r")).select(*keys, "metric", "r.*")
    bound = percentiles.select(*keys, "metric", "n_values", F.explode(F.array(*[F.struct(F.lit(n).alias("percentile"), F.lit(q).alias("q"), F.col(f"{n}_error").alias("bound")) for n, q in qs.items()])).alias("b")).select(*keys, "metric", "n_values", "b.*")
    want = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_values") - 1e-9))
    off = F.greatest(F.lit(0), F.col("below") + 1 - want, want - F.col("upto"))
    return bound.join(ranks, [*keys, "metric", "percentile"]).select(*keys, "metric", "percentile", "n_values", (off <= F.col("bound") * F.col("n_values") + 1).alias("within"))
