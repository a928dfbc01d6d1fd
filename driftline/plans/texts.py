"""Queries on text formats (written and read back) and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import intervals
from driftline.plans import signals
from driftline.plans.signals import R, cut_ranges
from driftline.session import shared_folder
from driftline.sources import archive, fits
from driftline.sources import text as src
from driftline.streaming import windows
from driftline.tables import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("text_cuts", f"WITH {R} SELECT DISTINCT tod_id AS path, det_uid, start, stop FROM r")
def _(spark, d):
    lines = src.format_cuts(cut_ranges(spark, d).select(F.col("tod_id").alias("path"), "det_uid", "start", "stop").distinct())
    return src.parse_cuts(lines.select("path", F.col("det_uid").alias("line"), "value"))[1]


@query("text_row_column_cuts", f"WITH {R} SELECT DISTINCT tod_id AS path, det_uid, start, stop FROM r")
def _(spark, d):
    lines = src.format_cuts(cut_ranges(spark, d).select(F.col("tod_id").alias("path"), "det_uid", "start", "stop").distinct())
    named = lines.withColumn("value", F.concat(F.format_string("r%02dc%02d: ", F.floor(F.col("det_uid") / 32).cast("int"), (F.col("det_uid") % 32).cast("int")), F.substring_index("value", ": ", -1)))
    return src.parse_row_column_cuts(named, 32)


@query("text_columns", "SELECT s_suppkey AS a, s_nationkey AS b, round(s_acctbal, 2) AS c FROM supplier")
def _(spark, d):
    lines = src.format_columns(load(spark, d, "supplier"), {"s_suppkey": "%d", "s_nationkey": "%4d", "s_acctbal": "%12.2f"})
    return src.read_columns(lines.select(F.lit("p").alias("path"), F.lit(0).alias("line"), "value"), {"a": (0, "bigint"), "b": (1, "int"), "c": (2, "double")}).select("a", "b", "c")


@query("text_report", "SELECT c_name AS name, c_nationkey::BIGINT AS n, c_acctbal AS bal FROM customer")
def _(spark, d):
    lines = src.format_report(load(spark, d, "customer"), ["c_name", "c_nationkey", "c_acctbal"])
    return src.parse_report(lines.select(F.lit("p").alias("path"), F.lit(0).alias("line"), "value"), [("name", "string"), ("n", "bigint"), ("bal", "double")]).select("name", "n", "bal")


@query("fits_table", "SELECT p_partkey, p_name, p_size, p_retailprice, p_size > 25 AS large FROM part")
def _(spark, d):
    """A table written to FITS files and read back."""
    folder = f"{shared_folder(spark)}/fits_{uuid.uuid4().hex[:12]}"
    fits.write_table(load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large")), folder)
    return fits.read_table(spark, folder)


@query("fits_map", "SELECT CAST(floor(l_quantity + 0.5) AS INTEGER) AS i0, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS i1, count(*)::DOUBLE AS value FROM lineitem WHERE floor(l_quantity + 0.5) BETWEEN 0 AND 51 AND floor(l_discount * 100 + 0.5) BETWEEN 0 AND 11 GROUP BY 1, 2")
def _(spark, d):
    """A map written as a FITS image in pieces and read back, its hit pixels."""
    folder = f"{shared_folder(spark)}/fits_{uuid.uuid4().hex[:12]}"
    m = load(spark, d, "lineitem").select(F.floor(F.col("l_quantity") + 0.5).cast("int").alias("i0"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("i1")).groupBy("i0", "i1").agg(F.count("*").alias("n"))
    fits.write_image(m, folder, "n", 52, 12, {"CTYPE1": "X"}, lines=5)
    return fits.read_image(spark, folder).where("not isnan(value)")


@query("flags_archived", signals.SQL["flags_unpack"])
def _(spark, d):
    """Packed flags put into an archive by TOD, taken out of it and unpacked."""
    ax = signals.axis(spark, d)
    a = archive.Archive(spark, f"{shared_folder(spark)}/flags_{uuid.uuid4().hex[:12]}")
    a.put(intervals.pack_flags(signals.cut_ranges(spark, d), ax, signals.KEYS, signals._BITS).where("tod_id is not null"), "flags", 1)
    return intervals.unpack_flags(a.table().drop("_class", "_version"), ax, signals.KEYS, signals._BITS)


@query("depot_products", "SELECT coalesce(pa, 'none') AS name, count(*) AS n FROM array_data GROUP BY 1")
def _(spark, d):
    """The detectors of each array written to a depot, found there and read back."""
    depot = archive.Depot(spark, f"{shared_folder(spark)}/depot_{uuid.uuid4().hex[:12]}")
    rows = load(spark, d, "array_data").withColumn("name", F.coalesce("pa", F.lit("none")))
    names = [r[0] for r in rows.select("name").distinct().collect()]  # arrays are few by their meaning
    for n in names:
        depot.write(rows.where(F.col("name") == n), "arrays", "v1", n)
    found = [n for n in [*names, "missing"] if depot.check("arrays", "v1", n)]
    return reduce(DataFrame.unionByName, [depot.read("arrays", "v1", n).groupBy("name").agg(F.count("*").alias("n")) for n in found])


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    s = windows.open_stream(spark, d, "events", load(spark, d, "events").schema).withColumn("t", F.col("ts").cast("timestamp"))
    got = windows.run_to_end(windows.tumbling(s, "t", "1 hour", "0 seconds", ["event_type"], "value"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def _(spark, d):
    s = windows.open_stream(spark, d, "events", load(spark, d, "events").schema).withColumn("t", F.col("ts").cast("timestamp"))
    got = windows.run_to_end(windows.sliding(s, "t", "2 hours", "1 hour", "0 seconds", ["event_type"]), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM g GROUP BY user_id, s""")
def _(spark, d):
    s = windows.open_stream(spark, d, "events", load(spark, d, "events").schema).withColumn("t", F.col("ts").cast("timestamp"))
    got = windows.run_to_end(windows.sessions(s, "t", "30 minutes", "1000 days", ["user_id"]), "complete")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("stream_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    s = windows.open_stream(spark, d, "events", load(spark, d, "events").schema)
    return windows.run_to_end(windows.running_totals(s, "user_id", "value"), "complete").withColumn("total", F.round("total", 4))


@query("stream_repeats", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def _(spark, d):
    s = windows.open_stream(spark, d, "events", load(spark, d, "events").schema).withColumn("t", F.col("ts").cast("timestamp"))
    got = windows.run_to_end(windows.without_repeats(s, "t", ["event_type", "user_id"], "1000 days"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"))
