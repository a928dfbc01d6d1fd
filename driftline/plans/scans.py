"""Queries on scans, source cuts, correlated modes and housekeeping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from driftline.operators import intervals, scans, tods
from driftline.plans import signals
from driftline.plans.skymaps import _KEY2, _WINDOWED, _fitted, _on_grid
from driftline.plans.signals import KEYS, P, S, W, _LOW, low_cuts, merged_sql, stream
from driftline.tables import load

QUERIES, SQL = {}, {}
r3 = lambda c: F.round(c, 3)
r6 = lambda c: F.round(c, 6)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("scan_direction", f"""WITH {S}, g AS (SELECT *, lag(x) OVER {W} AS p, lead(x) OVER {W} AS n FROM s) SELECT tod_id, det_uid, samp,
CAST(sign(CASE WHEN p IS NULL THEN n - x WHEN n IS NULL THEN x - p ELSE (n - p) / 2 END) AS INTEGER) AS direction FROM g""")
def _(spark, d):
    return scans.scan_direction(stream(spark, d), KEYS, "samp", "x").select(*KEYS, "samp", "direction")


_XY = "xy AS (SELECT *, cos(samp / 20.0) * 2 AS px, det_uid / 1000.0 + samp / 400.0 AS py FROM s)"


def _places(spark, d):
    return stream(spark, d).withColumn("px", F.cos(F.col("samp") / 20.0) * 2).withColumn("py", F.col("det_uid") / 1000.0 + F.col("samp") / 400.0)


@query("source_cuts", f"""WITH {S}, {_XY}, h AS (SELECT tod_id, det_uid, samp, samp - row_number() OVER {W} AS g FROM xy WHERE pow(px - 0.5, 2) + pow(py - 0.8, 2) < 0.25 OR pow(px + 1, 2) + pow(py - 1.2, 2) < 0.16),
i AS (SELECT tod_id, det_uid, CAST(greatest(min(samp) - 3, 0) AS INTEGER) AS start, CAST(max(samp) + 4 AS INTEGER) AS stop FROM h GROUP BY tod_id, det_uid, g), {merged_sql('i', 'm')} SELECT * FROM m""")
def _(spark, d):
    return scans.source_cuts(_places(spark, d), KEYS, "samp", F.col("px"), F.col("py"), [(0.5, 0.8, 0.5), (-1.0, 1.2, 0.4)], 3)


@query("turnaround_clear", f"""WITH {_LOW}, t AS (SELECT DISTINCT tod_id, 100 AS a, 130 AS b FROM lm UNION SELECT DISTINCT tod_id, 300, 330 FROM lm)
SELECT DISTINCT tod_id, det_uid FROM lm WHERE NOT EXISTS (SELECT 1 FROM lm l JOIN t ON l.tod_id = t.tod_id AND l.start < t.b AND t.a < l.stop WHERE l.tod_id = lm.tod_id AND l.det_uid = lm.det_uid)""")
def _(spark, d):
    c = low_cuts(spark, d)
    turns = c.select("tod_id").distinct().select("tod_id", F.explode(F.array(F.struct(F.lit(100).alias("start"), F.lit(130).alias("stop")), F.struct(F.lit(300).alias("start"), F.lit(330).alias("stop")))).alias("t")).select("tod_id", "t.*")
    return scans.clear_of(c, c, KEYS, turns, ["tod_id"])


@query("row_mode", f"WITH {S}, c AS (SELECT *, x - avg(x) OVER {P} AS y FROM s) SELECT tod_id, CAST(det_uid // 32 AS INTEGER) AS row, samp, round(avg(y), 3) AS mode, count(*) AS n FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    s = stream(spark, d).withColumn("row", F.floor(F.col("det_uid") / 32).cast("int"))
    return scans.group_mode(s, ["tod_id"], ["row"], "samp", "x").withColumn("mode", r3("mode"))


def _box(src: str, name: str, keys: str, width: int) -> str:
    """CTEs that end in ``name``: the periodic moving mean ``m`` of column x of ``src``."""
    h = width // 2
    return f"""{name}_t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY samp) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
{name}_e AS (SELECT * FROM {name}_t UNION ALL SELECT * REPLACE (i + n AS i) FROM {name}_t WHERE i < {width} UNION ALL SELECT * REPLACE (i - n AS i) FROM {name}_t WHERE i >= n - {width}),
{name} AS (SELECT * FROM (SELECT *, avg(x) OVER (PARTITION BY {keys} ORDER BY i RANGE BETWEEN {h} PRECEDING AND {width - 1 - h} FOLLOWING) AS m FROM {name}_e) WHERE i >= 0 AND i < n)"""


@query("relative_calibration", f"""WITH {S}, {_box('s', 'b', 'tod_id, det_uid', 9)}, y AS (SELECT tod_id, det_uid, samp, m - avg(m) OVER {P} AS y FROM b), c AS (SELECT tod_id, samp, avg(y) AS c FROM y GROUP BY 1, 2),
k AS (SELECT tod_id, det_uid, sum(y * c) / sum(c * c) AS k FROM y JOIN c USING (tod_id, samp) GROUP BY 1, 2) SELECT tod_id, det_uid, round(avg(k) OVER (PARTITION BY tod_id) / k, 6) AS cal FROM k WHERE k <> 0""")
def _(spark, d):
    return scans.relative_calibration(stream(spark, d), ["tod_id"], "det_uid", "samp", "x").withColumn("cal", r6("cal")).where("cal is not null")


@query("correlations_removed", f"""WITH {S}, y AS (SELECT tod_id, det_uid, samp, x - avg(x) OVER {P} AS y FROM s), c AS (SELECT tod_id, samp, avg(y) AS x FROM y GROUP BY 1, 2), {_box('c', 'b', 'tod_id', 9)}
SELECT tod_id, det_uid, samp, round(y - m, 3) AS x FROM y JOIN b USING (tod_id, samp)""")
def _(spark, d):
    return scans.correlations_removed(stream(spark, d), ["tod_id"], "det_uid", "samp", "x", 9).withColumn("x", r3("x"))


@query("injected", f"WITH {S}, {_XY} SELECT tod_id, det_uid, samp, round(x + 5000 * exp(-4 * {math.log(2)!r} * (pow(px - 0.5, 2) + pow(py - 0.8, 2)) / 0.09), 3) AS x FROM xy")
def _(spark, d):
    return scans.injected(_places(spark, d), "x", F.col("px"), F.col("py"), [(0.5, 0.8, 5000.0, 0.3)]).select(*KEYS, "samp", r3("x").alias("x"))


_RAW = "o AS (SELECT DISTINCT tod_id, det_uid, samp, data::DOUBLE AS x, coalesce(isfinite(data) AND abs(data) < 134217728, false) AS ok FROM samples)"


def _raw(spark, d):
    """All samples, bad ones too, each once."""
    x = F.col("data").cast("double")
    s = load(spark, d, "samples").select(*KEYS, "samp", x.alias("x"), F.coalesce(~F.isnan(x) & (F.abs(x) < 134217728), F.lit(False)).alias("ok"))
    return s.distinct()


@query("gaps_filled", f"""WITH {_RAW}, f AS (SELECT *, last_value(CASE WHEN ok THEN samp END IGNORE NULLS) OVER w1 AS ps, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w1 AS pv,
first_value(CASE WHEN ok THEN samp END IGNORE NULLS) OVER w2 AS ns, first_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w2 AS nv FROM o WINDOW w1 AS (PARTITION BY tod_id, det_uid ORDER BY samp ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT tod_id, det_uid, samp, round(CASE WHEN ok THEN x WHEN ps IS NULL THEN nv WHEN ns IS NULL THEN pv ELSE pv + (nv - pv) * (samp - ps) / (ns - ps) END, 2) AS x FROM f""")
def _(spark, d):
    return scans.gaps_filled(_raw(spark, d), KEYS, "samp", "x", F.col("ok")).select(*KEYS, "samp", F.round("x", 2).alias("x"))


@query("sky_offset", "SELECT DISTINCT basename, round(0.1 + 0.2 + 0.03 * cos(radians(mean_alt)), 6) AS dx, round(-0.1 + 0.01 + 0.02 * sin(radians(mean_alt)), 6) AS dy FROM tod_info WHERE mean_alt IS NOT NULL")
def _(spark, d):
    t = load(spark, d, "tod_info").where("mean_alt is not null").select("basename", "mean_alt").distinct()
    dx, dy = scans.sky_offset(F.lit(0.1), F.lit(-0.1), F.radians("mean_alt"), (0.2, 0.03, 0.01, 0.02))
    return t.select("basename", r6(dx).alias("dx"), r6(dy).alias("dy")).distinct()


_CAL = "c AS (SELECT det_uid, min(optical_sign) AS c FROM array_data WHERE det_type = 'tes' GROUP BY 1)"


@query("tod_loaded", f"""WITH {S.replace('s AS', 's0 AS', 1)}, {_CAL}, {_LOW.replace('lm', 'l0')}, n AS (SELECT tod_id, max(samp) + 1 AS n FROM s0 GROUP BY 1), s AS (SELECT tod_id, det_uid, samp - 10 AS samp, x * coalesce(c, 0) AS x FROM s0 JOIN n USING (tod_id) LEFT JOIN c USING (det_uid) WHERE samp >= 10 AND samp < n - 10),
lm AS (SELECT tod_id, det_uid, greatest(start - 10, 0) AS start, least(stop - 10, n - 20) AS stop FROM l0 JOIN n USING (tod_id) WHERE greatest(start - 10, 0) < least(stop - 10, n - 20)), q AS (WITH e{signals.SQL['fill_cuts'].split(', e', 1)[1]})
SELECT q.tod_id, q.det_uid, q.samp, q.x, lm.start IS NOT NULL AS cut, round(cos((q.samp + 10) / 20.0), 6) AS az FROM q LEFT JOIN lm ON q.tod_id = lm.tod_id AND q.det_uid = lm.det_uid AND q.samp >= lm.start AND q.samp < lm.stop""")
def _(spark, d):
    s = stream(spark, d)
    cal = load(spark, d, "array_data").where("det_type = 'tes'").groupBy("det_uid").agg(F.min("optical_sign").alias("cal"))
    pointing = s.select("tod_id", "samp").distinct().withColumn("az", F.cos(F.col("samp") / 20.0))
    got = tods.load_observations(s, start=10, stop=-10, cal=cal, cal_keys=["det_uid"], cuts=low_cuts(spark, d), pointing=pointing)
    return got.select(*KEYS, "samp", F.round("x", 2).alias("x"), "cut", r6("az").alias("az"))


@query("frequency_waterfall", f"""WITH {_on_grid(_KEY2)}, {_WINDOWED.format(size='n')}, c AS (SELECT *, least(15, floor(f / 0.25)) AS cell FROM ps), a AS (SELECT tod_id, det_uid, cell, avg(p) AS p FROM c GROUP BY 1, 2, 3),
m AS (SELECT tod_id, det_uid, n, max(k) AS last, unnest(range(16)) AS cell FROM ps GROUP BY 1, 2, 3), i AS (SELECT *, least((cell + 0.5) * 0.25 * n / 8, last) AS at_k FROM m), lo AS (SELECT i.*, p AS plo FROM i JOIN ps USING (tod_id, det_uid) WHERE ps.k = floor(at_k)), hi AS (SELECT lo.*, p AS phi FROM lo JOIN ps USING (tod_id, det_uid) WHERE ps.k = least(floor(at_k) + 1, last))
SELECT hi.tod_id, hi.det_uid, CAST(hi.cell AS INTEGER) AS cell, (hi.cell + 0.5) * 0.25::DOUBLE AS f, round(coalesce(a.p, plo + (phi - plo) * (at_k - floor(at_k))), 6) AS power FROM hi LEFT JOIN a ON a.tod_id = hi.tod_id AND a.det_uid = hi.det_uid AND a.cell = hi.cell""")
def _(spark, d):
    s = stream(spark, d).withColumn("x", F.col("x") / 1000)
    return scans.frequency_waterfall(s, KEYS, "samp", "x", 8.0, 16).withColumn("power", F.round("power", 6))


_U = "(2.0 * samp / greatest(n - 1, 1) - 1)"


@query("baseline_fit", f"""WITH {_on_grid(_KEY2)}, {_fitted(['cos(2 * pi() * 0.025 * samp)', 'sin(2 * pi() * 0.025 * samp)', '1', _U, f'pow({_U}, 2)', f'pow({_U}, 3)'])},
re AS (SELECT tod_id, det_uid, samp, any_value(x) - sum(c * b) AS e FROM ba JOIN sol USING (tod_id, det_uid, i) GROUP BY 1, 2, 3), rr AS (SELECT tod_id, det_uid, sqrt(avg(e * e)) AS rms FROM re GROUP BY 1, 2),
ab AS (SELECT tod_id, det_uid, max(c) FILTER (i = 0) AS ca, max(c) FILTER (i = 1) AS cb FROM sol GROUP BY 1, 2) SELECT tod_id, det_uid, round(sqrt(ca * ca + cb * cb), 6) AS amp, round(atan2(cb, ca), 6) AS phase, round(rms, 6) AS rms FROM ab JOIN rr USING (tod_id, det_uid)""")
def _(spark, d):
    s = stream(spark, d)
    s = s.join(s.groupBy(*KEYS).agg(F.avg("x").alias("_m")), KEYS).withColumn("x", (F.col("x") - F.col("_m")) / 1000)
    return scans.baseline_fit(s, KEYS, "samp", "x", 0.025, 3).select(*KEYS, *[F.round(c, 6).alias(c) for c in ("amp", "phase", "rms")])


@query("outliers_splined")
def _(spark, d):
    return scans.outliers_splined(stream(spark, d), KEYS, "samp", "x").withColumn("x", r3("x"))


@query("cuts_mce", f"WITH {_RAW}, h AS (SELECT tod_id, samp, samp - row_number() OVER (PARTITION BY tod_id ORDER BY samp) AS g FROM (SELECT DISTINCT tod_id, samp FROM o WHERE NOT ok)), i AS (SELECT tod_id, CAST(min(samp) AS INTEGER) AS start, CAST(max(samp) + 1 AS INTEGER) AS stop FROM h GROUP BY tod_id, g) SELECT d.tod_id, d.det_uid, start, stop FROM (SELECT DISTINCT tod_id, det_uid FROM o) d JOIN i USING (tod_id)")
def _(spark, d):
    s = _raw(spark, d)
    bad = intervals.ranges_of_mask(s.where(~F.col("ok")).select("tod_id", "samp").distinct(), ["tod_id"], "samp", F.lit(True))
    return s.select(*KEYS).distinct().join(bad, "tod_id").select(*KEYS, "start", "stop")


@query("housekeeping_files", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def _(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(load(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")
