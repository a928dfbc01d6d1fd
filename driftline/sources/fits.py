"""FITS tables and images, read and written in parts.

A FITS file is a row of units, each a header of 80-character cards in blocks of 2,880 bytes and a big-endian data area padded to
whole blocks. Tables (BINTABLE) are read by ranges of rows and images by ranges of lines, so a file of any size is spread over
many tasks; a task writes a file of its own, and a folder of files reads as one table or image.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from driftline.session import shipped

BLOCK, CARD = 2880, 80
# fixed values: type letters of table columns and numbers of image types
COLUMN = {"L": ("i1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
LETTER = {"boolean": "L", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D"}
IMAGE = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def card(key: str, value: object) -> bytes:
    text = "T" if value is True else "F" if value is False else f"'{value:<8}'" if isinstance(value, str) else repr(value)
    return (f"{key:<8}= {text:<20}" if isinstance(value, str) else f"{key:<8}= {text:>20}").ljust(CARD).encode("ascii")


def header(cards: dict[str, object]) -> bytes:
    """Header of a unit, padded to whole blocks."""
    out = b"".join(card(k, v) for k, v in cards.items()) + b"END".ljust(CARD)
    return out.ljust(-(-len(out) // BLOCK) * BLOCK)


def parse_header(f) -> dict[str, object]:
    """Cards of the header at the file's position, which is left where its data begin."""
    cards: dict[str, object] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise EOFError("no further unit")
        for i in range(0, BLOCK, CARD):
            line = block[i : i + CARD].decode("ascii")
            key = line[:8].strip()
            if key == "END":
                return cards
            if line[8:10] != "= ":
                continue
            rest = line[10:]
            if rest.lstrip().startswith("'"):
                text = rest.lstrip()[1:].replace("''", "\0")
                cards[key] = text[: text.index("'")].replace("\0", "'").rstrip()
                continue
            word = rest.split("/")[0].strip()
            cards[key] = word == "T" if word in ("T", "F") else float(word.replace("D", "E")) if any(c in word for c in ".ED") else int(word) if word else None


def data_size(cards: dict[str, object]) -> int:
    """Bytes of a unit's data, without the padding."""
    n = 1 if cards.get("NAXIS", 0) else 0
    for i in range(1, int(cards.get("NAXIS", 0)) + 1):
        n *= int(cards[f"NAXIS{i}"])
    return n * abs(int(cards["BITPIX"])) // 8 + int(cards.get("PCOUNT", 0))


def open_unit(path: str, table: bool) -> tuple[dict[str, object], int]:
    """Header and data position of the file's first table, or first image with data."""
    with open(path, "rb") as f:
        while True:
            cards = parse_header(f)
            if (cards.get("XTENSION") == "BINTABLE") == table and (table or data_size(cards)):
                return cards, f.tell()
            f.seek(-(-data_size(cards) // BLOCK) * BLOCK, 1)


def files_of(path: str) -> list[str]:
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".fits")) if os.path.isdir(path) else [path]


def columns_of(cards: dict[str, object]) -> list[tuple[str, str, int]]:
    """(name, type letter, repeat) of a table's columns."""
    out = []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = str(cards[f"TFORM{i}"]).strip()
        letter = form.lstrip("0123456789")
        digits = form[: len(form) - len(letter)]
        out.append((str(cards.get(f"TTYPE{i}", f"col{i}")), letter[0], int(digits) if digits else 1))
    return out


class FitsPart(InputPartition):
    def __init__(self, path: str, at: int, start: int, stop: int):
        self.path, self.at, self.start, self.stop = path, at, start, stop


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, table: bool):
        self.path, self.table, self.block = options["path"], table, int(options.get("block", 1 << 18))

    def partitions(self) -> list[FitsPart]:
        parts = []
        for p in files_of(self.path):
            cards, at = open_unit(p, self.table)
            n = int(cards["NAXIS2"])
            step = self.block if self.table else max(1, self.block // max(1, int(cards["NAXIS1"])))
            parts += [FitsPart(p, at, a, min(a + step, n)) for a in range(0, n, step)]
        return parts

    def read(self, part: FitsPart) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cards, at = open_unit(part.path, self.table)
        n = part.stop - part.start
        with open(part.path, "rb") as f:
            if self.table:
                fields = [(name, (f"S{k}" if t == "A" else COLUMN[t][0]) if k == 1 or t == "A" else (COLUMN[t][0], (k,))) for name, t, k in columns_of(cards)]
                kind = np.dtype(fields)
                f.seek(at + part.start * kind.itemsize)
                rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                cols = []
                for name, t, k in columns_of(cards):
                    v = rows[name]
                    if t == "A":
                        cols.append(pa.array([x.decode("utf-8", "replace").rstrip(" \0") for x in v.tolist()], pa.string()))
                    elif t == "L":
                        cols.append(pa.array(np.where(v == ord("T"), True, False)))
                    else:
                        flat = pa.array(v.astype(v.dtype.newbyteorder("=")).ravel() if t != "B" else v.ravel().astype(np.int16))
                        cols.append(flat if k == 1 else pa.FixedSizeListArray.from_arrays(flat, k).cast(pa.list_(flat.type)))
                yield pa.RecordBatch.from_arrays(cols, names=[name for name, _, _ in columns_of(cards)])
                return
            wide, kind = int(cards["NAXIS1"]), np.dtype(IMAGE[int(cards["BITPIX"])])
            f.seek(at + part.start * wide * kind.itemsize)
            v = np.frombuffer(f.read(n * wide * kind.itemsize), kind).astype(float) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
            line = np.arange(part.start, part.stop, dtype=np.int32) + int(cards.get("LINE0", 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(wide, dtype=np.int32), n)), pa.array(np.repeat(line, wide)), pa.array(v)], names=["i0", "i1", "value"])


class FitsWriter(DataSourceArrowWriter):
    """Every task writes one file, under another name until it is whole."""

    def __init__(self, path: str, fields: list[tuple[str, str]]):
        self.path, self.fields = path, fields

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import numpy as np
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return WriterCommitMessage()
        t = pa.Table.from_batches(batches)
        kind, forms, cols = [], [], []
        for name, spark in self.fields:
            c = t[name].combine_chunks()
            if spark == "string":
                raw = [x.encode("utf-8") for x in c.fill_null("").to_pylist()]
                width = max(map(len, raw), default=1) or 1
                kind.append((name, f"S{width}"))
                forms.append(f"{width}A")
                cols.append(np.array(raw, f"S{width}"))
            else:
                letter = LETTER[spark]
                kind.append((name, COLUMN[letter][0]))
                forms.append(f"1{letter}")
                v = c.fill_null(float("nan") if spark in ("float", "double") else False if spark == "boolean" else 0).to_numpy(zero_copy_only=False)
                cols.append(np.where(v, ord("T"), ord("F")) if spark == "boolean" else v)
        rows = np.zeros(t.num_rows, np.dtype(kind))
        for (name, _), v in zip(kind, cols):
            rows[name] = v
        cards: dict[str, object] = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kind)}
        for i, ((name, _), form) in enumerate(zip(kind, forms), 1):
            cards |= {f"TTYPE{i}": name, f"TFORM{i}": form}
        store(self.path, header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True}) + header(cards) + rows.tobytes())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass


def store(folder: str, data: bytes) -> str:
    """A new file of the folder, padded to whole blocks."""
    name = os.path.join(folder, f"part-{uuid.uuid4().hex}.fits")
    with open(name + ".tmp", "wb") as f:
        f.write(data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0"))
    os.replace(name + ".tmp", name)
    return name


class FitsTable(DataSource):
    """Option path: a file or a folder of files with the same columns, one that all executors see; block: rows of a task."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        kinds = [(n, COLUMN[t][1], k if t != "A" else 1) for n, t, k in columns_of(open_unit(files_of(self.options["path"])[0], True)[0])]
        return ", ".join(f"`{n}` {t if k == 1 else f'array<{t}>'}" for n, t, k in kinds)

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(dict(self.options), True)

    def writer(self, schema, overwrite: bool) -> FitsWriter:
        os.makedirs(self.options["path"], exist_ok=True)
        if overwrite:
            for p in files_of(self.options["path"]):
                os.remove(p)
        return FitsWriter(self.options["path"], [(f.name, f.dataType.simpleString()) for f in schema.fields])


class FitsImage(DataSource):
    """Option path: a file, or a folder of files each of which holds some lines (the card LINE0 has the first one's number)."""

    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return "i0 int, i1 int, value double"

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(dict(self.options), False)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    shipped(spark).dataSource.register(FitsTable)
    return spark.read.format("fits_table").option("path", path).load()


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Columns of numbers, booleans and strings; nulls become NaN, 0, false or an empty text, for which FITS has no sign."""
    shipped(df.sparkSession).dataSource.register(FitsTable)
    df.write.format("fits_table").option("path", path).mode("overwrite" if overwrite else "append").save()


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """(i0, i1, value) of every pixel; i0 runs along a line."""
    shipped(spark).dataSource.register(FitsImage)
    return spark.read.format("fits_image").option("path", path).load()


def write_image(sky: DataFrame, path: str, value: str, n0: int, n1: int, cards: dict[str, object] | None = None, lines: int = 512) -> None:
    """A sparse map (i0, i1, value) as files of ``lines`` lines each; pixels without a row are NaN, those outside the map are left out."""
    os.makedirs(path, exist_ok=True)
    more = dict(cards or {})

    def one(key: tuple, pdf):
        import numpy as np
        import pandas as pd

        a = int(key[0]) * lines
        image = np.full((min(lines, n1 - a), n0), np.nan, ">f8")
        image[pdf["i1"].to_numpy() - a, pdf["i0"].to_numpy()] = pdf["_v"].to_numpy()
        units = {"SIMPLE": True, "BITPIX": -64, "NAXIS": 2, "NAXIS1": n0, "NAXIS2": len(image), "LINE0": a}
        return pd.DataFrame({"file": [store(path, header(units | more) + image.tobytes())]})

    inside = sky.where((F.col("i0") >= 0) & (F.col("i0") < n0) & (F.col("i1") >= 0) & (F.col("i1") < n1)).select("i0", "i1", F.col(value).cast("double").alias("_v"))
    every = sky.sparkSession.range(-(-n1 // lines)).select(F.col("id").alias("_p"))
    rows = inside.withColumn("_p", F.floor(F.col("i1") / lines)).unionByName(every.select(F.lit(0).alias("i0"), (F.col("_p") * lines).cast("int").alias("i1"), F.lit(None).cast("double").alias("_v"), "_p"))
    rows = rows.groupBy("i0", "i1", "_p").agg(F.max("_v").alias("_v"))
    shipped(sky.sparkSession)
    rows.groupBy("_p").applyInPandas(one, "file string").write.format("noop").mode("overwrite").save()
