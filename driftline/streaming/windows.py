"""Streams: windows, sessions, repeats and runs, as additions to the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import shared_folder, shipped


def open_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A stream of the parquet files of one table of a folder."""
    return shipped(spark).readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def tumbling(df: DataFrame, time: str, length: str, late: str, keys: list[str], value: str) -> DataFrame:
    """(start, keys, n, total) of windows of a length, for rows at most ``late`` behind."""
    w = df.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, length: str, step: str, late: str, keys: list[str]) -> DataFrame:
    w = df.withWatermark(time, late).groupBy(F.window(time, length, step), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """(keys, start, stop, n) of rows that follow each other within ``gap``."""
    w = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def without_repeats(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) as it stands after each batch."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream gives for the rows there are now, from files in the shared folder.

    With mode ``complete`` these hold the result as the last batch left it. The stream's own checkpoint lies beside them.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex[:12]}"
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        w = w.format("parquet").option("path", f"{folder}/rows")
    else:
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    q = w.start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
