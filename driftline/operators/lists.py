"""Set algebra on ordered lists of names, and their division into jobs.

A list is a DataFrame (ord, name). Names are the same if their ``basename`` is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import basename


def _keyed(df: DataFrame, side: int) -> DataFrame:
    return df.select(F.lit(side).alias("side"), "ord", "name", basename(F.col("name")).alias("key"))


def list_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of a, then the names of b that aren't in a (repeats in b stay)."""
    left, right = _keyed(a, 0), _keyed(b, 1)
    return left.unionByName(right.join(left.select("key").distinct(), "key", "left_anti")).select("side", "ord", "name")


def list_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without, for each name of b, its first so many occurrences."""
    left = _keyed(a, 0).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    drop = _keyed(b, 1).groupBy("key").agg(F.count("*").alias("m"))
    return left.join(drop, "key", "left").where("m is null or n > m").select("ord", "name")


def list_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of both, in a's spelling (of its first occurrence) and b's order."""
    first = _keyed(a, 0).groupBy("key").agg(F.min_by("name", "ord").alias("name"))
    return _keyed(b, 1).select("ord", "key").join(first, "key").select("ord", "name")


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def merge_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and those rows of b whose key isn't in a."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def match_first(a: DataFrame, b: DataFrame, key: str, index: str) -> DataFrame:
    """(index, other): pairs of row numbers with the same key, the first one of b."""
    first = b.groupBy(key).agg(F.min(index).alias("other"))
    return a.join(first, key).select(index, "other")


def split_list(df: DataFrame, parts: int, n: int) -> DataFrame:
    """``part`` of each row when a list of n is cut into chunks of ceil(n / parts)."""
    size = -(-n // parts)
    return df.withColumn("part", F.floor(F.col("ord") / F.lit(max(size, 1))).cast("int"))


def job_ranges(n: int, jobs: int) -> list[tuple[int, int]]:
    """[i n // jobs, (i + 1) n // jobs) of each job."""
    return [(i * n // jobs, (i + 1) * n // jobs) for i in range(jobs)]


def job_of(df: DataFrame, n: int, jobs: int) -> DataFrame:
    """``job`` of each row of a list of n, as by ``job_ranges``."""
    return df.withColumn("job", F.expr(f"cast(((ord + 1) * {jobs} - 1) div {n} as int)"))
