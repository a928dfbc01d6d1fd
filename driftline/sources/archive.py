"""Keyed archives of tables, channel folders, frame files and databases."""

from __future__ import annotations

import os
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from driftline.operators.joins import bounded
from driftline.session import checkpointed


def depot_path(root: str, kind: str, tag: str, name: str) -> str:
    """``root/kind/tag/first five digits/name``."""
    return os.path.join(root, kind, tag, name[:5], name)


class Depot:
    """Products by kind, tag and TOD, each a parquet folder at its ``depot_path``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def check(self, kind: str, tag: str, name: str) -> bool:
        try:
            self.read(kind, tag, name)
        except AnalysisException:
            return False
        return True

    def read(self, kind: str, tag: str, name: str) -> DataFrame:
        return self.spark.read.parquet(depot_path(self.root, kind, tag, name))

    def write(self, df: DataFrame, kind: str, tag: str, name: str, clobber: bool = True) -> None:
        """Replaces the product; with ``clobber`` false one that is there is an error."""
        df.write.mode("overwrite" if clobber else "errorifexists").parquet(depot_path(self.root, kind, tag, name))


class Archive:
    """A parquet folder of one product with one part per key (a TOD).

    ``put`` replaces the parts of the keys it holds and leaves the others, unless ``clobber`` is false: then keys that are there
    already are an error. Class and version are columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "tod_id"):
        self.spark, self.path, self.key = spark, path, key

    def table(self) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException:
            return None

    def keys(self) -> DataFrame:
        t = self.table()
        return t.select(self.key).distinct() if t is not None else self.spark.createDataFrame([], f"{self.key} string")

    def has(self, key: str) -> bool:
        t = self.table()
        return t is not None and not t.where(F.col(self.key) == key).isEmpty()

    def get(self, key: str) -> DataFrame:
        t = self.table()
        got = t.where(F.col(self.key) == key) if t is not None else None
        if got is None or got.isEmpty():
            raise KeyError(key)
        return got

    def put(self, df: DataFrame, kind: str = "", version: int = 1, clobber: bool = True) -> None:
        if not clobber:
            both = df.select(self.key).distinct().join(self.keys(), self.key).take(1)
            if both:
                raise ValueError(f"{both[0][0]} is in the archive")
        out = df.withColumn("_class", F.lit(kind)).withColumn("_version", F.lit(version))
        out.repartition(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def delete(self, keys: list[str]) -> None:
        t = self.table()
        if t is None:
            return
        kept = checkpointed(t.where(~F.col(self.key).isin(keys)))  # cut from the files that are about to go
        kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(self.key).parquet(self.path)

    def join_from(self, other: Archive, clobber: bool = False) -> None:
        """Takes the other archive's parts; those that both have only if ``clobber``."""
        t = other.table()
        if t is None:
            return
        if not clobber:
            have, _ = bounded(self.keys())
            t = t.join(have, self.key, "left_anti")
        if not t.isEmpty():
            t.repartition(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)


#: numpy type codes of a channel's raw file by the letter in its list
RAW = {"c": "i1", "s": "<i2", "S": "<i4", "u": "<u2", "U": "<u4", "f": "<f4", "d": "<f8", "l": "<i4"}


class ChannelPart(InputPartition):
    def __init__(self, channel: str, code: str, spf: int, start: int, stop: int):
        self.channel, self.code, self.spf, self.start, self.stop = channel, code, spf, start, stop


class ChannelFolderReader(DataSourceReader):
    """One partition for each channel and ``block`` samples; of the channels and samples asked for in the options only."""

    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", 1 << 20))
        self.channels: set[str] | None = {x.strip() for x in options["channels"].split(",")} if options.get("channels") else None
        self.lo, self.hi = int(options.get("start", 0)), int(options.get("stop", 1 << 62))

    def _read(self, name: str, offset: int = 0, size: int = -1) -> bytes:
        if self.path.endswith(".zip"):
            with zipfile.ZipFile(self.path) as z, z.open(name) as f:
                f.seek(offset)
                return f.read(size)
        with open(os.path.join(self.path, name), "rb") as f:
            f.seek(offset)
            return f.read(size)

    def _size(self, name: str) -> int:
        if self.path.endswith(".zip"):
            with zipfile.ZipFile(self.path) as z:
                return z.getinfo(name).file_size
        return os.path.getsize(os.path.join(self.path, name))

    def fields(self) -> list[tuple[str, str, int]]:
        """(channel, type letter, samples per frame) of the raw channels."""
        out = []
        for line in self._read("format").decode().splitlines():
            p = line.split()
            if len(p) >= 4 and p[1].upper() == "RAW":
                out.append((p[0], p[2], int(p[3])))
        return out

    def partitions(self) -> list[ChannelPart]:
        import numpy as np

        parts = []
        for name, code, spf in self.fields():
            if self.channels is not None and name not in self.channels:
                continue
            n = self._size(name) // np.dtype(RAW[code]).itemsize
            for a in range(max(0, self.lo), min(n, self.hi), self.block):
                parts.append(ChannelPart(name, code, spf, a, min(a + self.block, n, self.hi)))
        return parts

    def read(self, part: ChannelPart) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = np.dtype(RAW[part.code])
        raw = np.frombuffer(self._read(part.channel, part.start * t.itemsize, (part.stop - part.start) * t.itemsize), t)
        n = len(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.channel] * n, pa.string()), pa.array(np.arange(part.start, part.start + n)), pa.array(raw.astype(np.float64)), pa.array(np.full(n, part.spf, np.int32))],
            names=["channel", "samp", "value", "spf"],
        )


class ChannelFolder(DataSource):
    """A folder, or a zip file, with one raw file per channel and a list named ``format``: ``name RAW type samples-per-frame``.

    Options: path, channels (names by comma), start and stop (samples), block. On a cluster the path must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "channel_folder"

    def schema(self) -> str:
        return "channel string, samp bigint, value double, spf int"

    def reader(self, schema) -> DataSourceReader:
        return ChannelFolderReader(dict(self.options))


def read_channels(spark: SparkSession, path: str, channels: list[str] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """(channel, samp, value, spf) of some channels, or all, of a channel folder, samples [start, stop)."""
    from driftline.session import shipped

    shipped(spark).dataSource.register(ChannelFolder)
    r = spark.read.format("channel_folder").option("path", path).option("start", str(start))
    r = r.option("channels", ",".join(channels)) if channels else r
    return (r.option("stop", str(stop)) if stop is not None else r).load()


def read_resampled(spark: SparkSession, path: str, channels: list[str], spf: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """(channel, samp, value): channels on the grid of ``spf`` samples a frame, each sample that of the channel's own rate in force then.

    A channel is read as a whole; ``start`` and ``stop`` are samples of the new grid.
    """
    from functools import reduce

    from driftline.operators.joins import resample_join

    df = read_channels(spark, path, channels)
    rates = {r["channel"]: r["spf"] for r in df.select("channel", "spf").distinct().collect()}  # a row for each channel asked for
    one = [resample_join(df.where(F.col("channel") == c).select("channel", F.col("samp").cast("int").alias("samp"), "value"), ["channel"], "samp", own, spf) for c, own in rates.items()]
    got = reduce(DataFrame.unionByName, one) if one else df.select("channel", F.col("samp").cast("int").alias("samp"), "value")
    got = got.where((F.col("samp") >= start) & (F.col("samp") < (stop if stop is not None else 2**31 - 1)))
    return got.select("channel", (F.col("samp") - start).cast("int").alias("samp"), "value")


def frames_of(df: DataFrame) -> DataFrame:
    """(channel, n_frames, spf, n_bonus): whole frames and the samples beyond them."""
    n = F.max("samp") + 1
    return df.groupBy("channel", "spf").agg(F.floor(n / F.col("spf")).alias("n_frames"), (n % F.col("spf")).alias("n_bonus"))


def same_rate(df: DataFrame) -> DataFrame:
    """The channels, checked to have one number of samples per frame."""
    if df.select("spf").distinct().count() > 1:
        raise ValueError("channels of different rates")
    return df


def sample_range(df: DataFrame, n: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """Samples [start, stop) of n, negative numbers counted from the end, numbered from 0."""
    a = start + n if start < 0 else start
    b = n if stop is None else stop + n if stop < 0 else min(stop, n)
    return df.where((F.col("samp") >= a) & (F.col("samp") < b)).withColumn("samp", F.col("samp") - a)


def read_frames(spark: SparkSession, path: str, header_words: int, rows: int, columns: int) -> DataFrame:
    """(path, frame, row, col, word) of frame files: each frame a header, rows x columns words and a checksum word, 32 bits each."""
    from driftline.session import shipped

    size = 4 * (header_words + rows * columns + 1)

    def parse(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                n = len(content) // size
                w = np.frombuffer(content[: n * size], "<i4").reshape(n, -1)[:, header_words : header_words + rows * columns]
                yield pd.DataFrame({"path": p, "frame": np.repeat(np.arange(n, dtype=np.int32), rows * columns), "row": np.tile(np.repeat(np.arange(rows, dtype=np.int32), columns), n), "col": np.tile(np.arange(columns, dtype=np.int32), rows * n), "word": w.ravel()})

    files = shipped(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, frame int, row int, col int, word int")


def write_frames(frames: list[list[int]], header: list[int]) -> bytes:
    """Bytes of frames, for tests and small exports."""
    out = b""
    for f in frames:
        words = [*header, *f]
        check = 0
        for w in words:
            check ^= w & 0xFFFFFFFF
        out += struct.pack(f"<{len(words)}i", *words) + struct.pack("<I", check)
    return out


def read_database(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database through its JDBC driver (which must be on the class path); with ``column`` in ``parts`` ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", str(parts))
    return r.load()


def observation_list(spark: SparkSession, source: str, value) -> DataFrame:
    """(ord, name) from names (``list``), a text file (``file``) or a path pattern (``glob``)."""
    from driftline.sources.text import parse_list, text_lines

    if source == "list":
        return spark.createDataFrame(list(enumerate(value)), "ord bigint, name string")
    if source == "file":
        return parse_list(text_lines(spark, value)).select(F.col("ord").cast("long").alias("ord"), "name")
    if source == "glob":
        import glob

        return spark.createDataFrame(list(enumerate(sorted(glob.glob(value)))), "ord bigint, name string")
    raise ValueError(source)
