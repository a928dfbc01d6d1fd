"""Queries on detector streams and their cuts and flags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import intervals, joins, ordered, stats
from driftline.tables import load

QUERIES, SQL = {}, {}
KEYS = ["tod_id", "det_uid"]
r3 = lambda c: F.round(c, 3)
r6 = lambda c: F.round(c, 6)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def stream(spark: SparkSession, d: str) -> DataFrame:
    """Readings within physical limits, each sample once; placed by stream, so operators on streams need no further shuffle."""
    s = load(spark, d, "samples").where("data is not null and not isnan(data) and abs(data) < 134217728")
    return s.select("tod_id", "det_uid", "samp", F.col("data").cast("double").alias("x")).repartition(*KEYS).dropDuplicates([*KEYS, "samp"])


S = "s AS (SELECT DISTINCT tod_id, det_uid, samp, data::DOUBLE AS x FROM samples WHERE data IS NOT NULL AND isfinite(data) AND abs(data) < 134217728)"
W = "(PARTITION BY tod_id, det_uid ORDER BY samp)"
P = "(PARTITION BY tod_id, det_uid)"


@query("mean_axis0", f"WITH {S} SELECT tod_id, samp, round(avg(x), 3) AS mean FROM s GROUP BY 1, 2")
def _(spark, d):
    return stream(spark, d).groupBy("tod_id", "samp").agg(r3(F.avg("x")).alias("mean"))


@query("upper_median_axis0", f"WITH {S}, r AS (SELECT tod_id, samp, x, row_number() OVER (PARTITION BY tod_id, samp ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY tod_id, samp) AS n FROM s) SELECT tod_id, samp, x AS med FROM r WHERE i = n // 2")
def _(spark, d):
    return stats.upper_median(stream(spark, d), ["tod_id", "samp"], "x")


@query("rms_axis1", f"WITH {S}, c AS (SELECT *, x - min(x) OVER {P} AS y FROM s) SELECT tod_id, det_uid, round(sqrt(avg(y * y)), 3) AS rms FROM c GROUP BY 1, 2")
def _(spark, d):
    low = stream(spark, d)
    base = low.groupBy(*KEYS).agg(F.min("x").alias("b"))
    return low.join(base, KEYS).withColumn("y", F.col("x") - F.col("b")).groupBy(*KEYS).agg(r3(stats.rms(F.col("y"))).alias("rms"))


@query("row_extremes", f"WITH {S} SELECT tod_id, det_uid, max(x) AS hi, min(x) AS lo, round(sum(x), 3) AS total, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    return stream(spark, d).groupBy(*KEYS).agg(F.max("x").alias("hi"), F.min("x").alias("lo"), r3(F.sum("x")).alias("total"), F.count("*").alias("n"))


_C = f"{S}, c AS (SELECT tod_id, det_uid, samp, (x - min(x) OVER {P}) / 1000 AS y FROM s)"


def centred(spark, d):
    s = stream(spark, d)
    return s.join(s.groupBy(*KEYS).agg(F.min("x").alias("b")), KEYS).select(*KEYS, "samp", ((F.col("x") - F.col("b")) / 1000).alias("y"))


@query("moment_chunks", f"""WITH {_C}, k AS (SELECT *, CAST(floor((samp - 10) / 50.0) AS INTEGER) AS chunk, max(samp) OVER {P} + 1 AS n FROM c)
SELECT tod_id, det_uid, chunk, round(avg(y), 8) AS m1, round(avg(y * y), 4) AS m2 FROM k WHERE samp >= 10 AND (chunk + 1) * 50 + 10 <= n GROUP BY 1, 2, 3""")
def _(spark, d):
    got = stats.moment_chunks(centred(spark, d), KEYS, "samp", "y", 50, 10, 2)
    return got.select(*KEYS, "chunk", F.round("m1", 8).alias("m1"), F.round("m2", 4).alias("m2"))


@query("noise_level", f"WITH {_C}, v AS (SELECT tod_id, det_uid, samp // 20 AS w, var_pop(y) AS v FROM c GROUP BY 1, 2, 3) SELECT tod_id, det_uid, round(median(v), 4) AS noise FROM v GROUP BY 1, 2")
def _(spark, d):
    return stats.noise_level(centred(spark, d), KEYS, "samp", "y", 20).withColumn("noise", F.round("noise", 4))


@query("normality", f"""WITH p AS (SELECT DISTINCT tod_id, pa, det_uid, rms / 100 AS v FROM pathologies WHERE isfinite(rms)), m AS (SELECT pa, det_uid, avg(pow(v, 2)) AS m2, avg(pow(v, 3)) AS m3, avg(pow(v, 4)) AS m4 FROM p GROUP BY 1, 2)
SELECT pa, det_uid, round(m2, 6) AS var, round(CASE WHEN m2 = 0 THEN 0 ELSE m3 / pow(m2, 1.5) END, 6) AS skew, round(CASE WHEN m2 = 0 THEN 0 ELSE m4 / pow(m2, 2) END, 6) AS kurt FROM m""")
def _(spark, d):
    p = load(spark, d, "pathologies").where("rms is not null and not isnan(rms) and abs(rms) < double('inf')").select("tod_id", "pa", "det_uid", (F.col("rms") / 100).alias("v")).distinct()
    return p.groupBy("pa", "det_uid").agg(*stats.moments_about_zero(F.col("v"))).select("pa", "det_uid", r6("var").alias("var"), r6("skew").alias("skew"), r6("kurt").alias("kurt"))


@query("normality_scores", """WITH p AS (SELECT DISTINCT tod_id, pa, det_uid, rms AS v FROM pathologies WHERE isfinite(rms)), c AS (SELECT *, avg(v) OVER (PARTITION BY pa, det_uid) AS m FROM p),
g AS (SELECT pa, det_uid, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS g1, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) AS b2, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2 HAVING count(*) > 20 AND avg(pow(v - m, 2)) > 0),
y AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS z, 6 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g),
u AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS u, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM y), k AS (SELECT *, (1 - 2 / a) / (1 + z * sqrt(2 / (a - 4))) AS i FROM u)
SELECT pa, det_uid, round(ln(u + sqrt(u*u + 1)) / sqrt(0.5 * ln(w2)), 6) AS z_skew, round((1 - 2 / (9 * a) - sign(i) * pow(abs(i), 1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)), 6) AS z_kurt FROM k""")
def _(spark, d):
    p = load(spark, d, "pathologies").where("rms is not null and not isnan(rms) and abs(rms) < double('inf')").select("tod_id", "pa", "det_uid", F.col("rms").alias("v")).distinct()
    g = p.groupBy("pa", "det_uid").agg(F.skewness("v").alias("g1"), (F.kurtosis("v") + 3).alias("b2"), F.count("*").cast("double").alias("n")).where("n > 20 and g1 is not null")
    return g.select("pa", "det_uid", r6(stats.skew_score(F.col("g1"), F.col("n"))).alias("z_skew"), r6(stats.kurtosis_score(F.col("b2"), F.col("n"))).alias("z_kurt"))


@query("bin_sums", "SELECT CAST(floor(l_quantity / 5) - 2 AS INTEGER) AS bin, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem WHERE floor(l_quantity / 5) - 2 >= 0 GROUP BY 1")
def _(spark, d):
    got = stats.bin_sums(load(spark, d, "lineitem"), [], (F.floor(F.col("l_quantity") / 5) - 2).cast("int"), F.col("l_extendedprice"))
    return got.withColumn("total", F.round("total", 2))


@query("log_bins", """WITH b AS (SELECT CASE WHEN l_extendedprice >= 1000 AND l_extendedprice < 100000 THEN CAST(floor(log10(l_extendedprice / 1000) / 0.2 + 1e-12) AS INTEGER) ELSE -1 END AS bin, l_discount AS v FROM lineitem)
SELECT bin, round(avg(v), 6) AS mean, count(*) AS n FROM b WHERE bin >= 0 GROUP BY 1""")
def _(spark, d):
    got = stats.bin_sums(load(spark, d, "lineitem"), [], stats.log_bin(F.col("l_extendedprice"), 1000.0, 100000.0, 10), F.col("l_discount"))
    return got.select("bin", r6(F.col("total") / F.col("n")).alias("mean"), "n")


@query("weather_average", "SELECT count(*) AS n, round(coalesce(avg(loading), 0), 6) AS mean, round(coalesce(stddev_pop(loading), 0), 6) AS std FROM (SELECT DISTINCT reading_id, ctime, loading FROM recal_model WHERE isfinite(loading) AND loading > 0) WHERE ctime >= 1104600000 AND ctime < 1105000000")
def _(spark, d):
    r = load(spark, d, "recal_model").where("loading > 0 and not isnan(loading) and loading < double('inf')").select("reading_id", "ctime", "loading").distinct()
    return stats.average_between(r, "ctime", "loading", 1104600000.0, 1105000000.0).select("n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("report_statistics", """WITH p AS (SELECT DISTINCT tod_id, det_uid, rms, gain, correlation FROM pathologies), u AS (UNPIVOT p ON rms, gain, correlation INTO NAME key VALUE v)
SELECT key, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std FROM u WHERE isfinite(v) GROUP BY key""")
def _(spark, d):
    p = load(spark, d, "pathologies").select("tod_id", "det_uid", "rms", "gain", "correlation").distinct()
    fin = p.select([F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("rms", "gain", "correlation")])
    return stats.report_statistics(fin, ["rms", "gain", "correlation"]).select("key", "n", *[r6(c).alias(c) for c in ("mean", "median", "std")])


@query("significance", """WITH l AS (SELECT unnest(range(11)) AS i), t AS (SELECT i, 10 + 4.0 * i AS level FROM l)
SELECT level::DOUBLE AS level, round(100 * sum(CASE WHEN l_quantity < level THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS below, round(100 - 100 * sum(CASE WHEN l_quantity < level THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS above FROM lineitem, t GROUP BY level""")
def _(spark, d):
    return stats.significance(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10.0, 50.0, 10).select("level", r6("below").alias("below"), r6("above").alias("above"))


@query("medsig_group", """SELECT pa, det_uid, round(max(CASE WHEN i = n // 2 THEN v END), 6) AS med, round(0.741 * (max(CASE WHEN i = 3 * n // 4 THEN v END) - max(CASE WHEN i = n // 4 THEN v END)), 6) AS sig, max(n) AS n
FROM (SELECT pa, det_uid, gain AS v, row_number() OVER (PARTITION BY pa, det_uid ORDER BY gain) - 1 AS i, count(*) OVER (PARTITION BY pa, det_uid) AS n FROM (SELECT DISTINCT tod_id, pa, det_uid, gain FROM pathologies WHERE isfinite(gain))) GROUP BY 1, 2""")
def _(spark, d):
    p = load(spark, d, "pathologies").where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").select("tod_id", "pa", "det_uid", "gain").distinct()
    return stats.medsig(p, ["pa", "det_uid"], "gain").select("pa", "det_uid", r6("med").alias("med"), r6("sig").alias("sig"), "n")


_MED = "(SELECT pa, det_uid, max(CASE WHEN i = n // 2 THEN v END) AS med, 0.741 * (max(CASE WHEN i = 3 * n // 4 THEN v END) - max(CASE WHEN i = n // 4 THEN v END)) AS sig FROM (SELECT pa, det_uid, v, row_number() OVER (PARTITION BY pa, det_uid ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY pa, det_uid) AS n FROM {src}) GROUP BY 1, 2)"


def _mode_sql(rounds: int) -> str:
    parts = ["v0 AS (SELECT DISTINCT tod_id, pa, det_uid, gain AS v FROM pathologies WHERE isfinite(gain))", "m0 AS " + _MED.format(src="v0")]
    for i in range(1, rounds + 1):
        parts.append(f"v{i} AS (SELECT v0.pa, v0.det_uid, v FROM v0 JOIN m{i - 1} m ON v0.pa = m.pa AND v0.det_uid = m.det_uid AND abs(v - med) <= 2 * sig)")
        parts.append(f"n{i} AS " + _MED.format(src=f"v{i}"))
        parts.append(f"m{i} AS (SELECT m.pa, m.det_uid, coalesce(n.med, m.med) AS med, coalesce(n.sig, m.sig) AS sig FROM m{i - 1} m LEFT JOIN n{i} n ON m.pa = n.pa AND m.det_uid = n.det_uid)")
    return "WITH " + ", ".join(parts) + f" SELECT pa, det_uid, med AS mode FROM m{rounds}"


@query("find_mode", _mode_sql(4))
def _(spark, d):
    p = load(spark, d, "pathologies").where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").select("tod_id", "pa", "det_uid", "gain").distinct()
    return stats.find_mode(p, ["pa", "det_uid"], "gain")


@query("array_sensitivity", """WITH f AS (SELECT DISTINCT ff_id, pa, det_uid, sn FROM flatfield WHERE sn > 0 AND isfinite(sn) AND det_uid >= 0), m AS (SELECT pa, det_uid, median(sn) AS s FROM f GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT pa, count(*) AS n, round(pow(sum(pow(s, -2)), -0.5) / sqrt(2), 6) AS sens FROM m GROUP BY pa""")
def _(spark, d):
    f = load(spark, d, "flatfield").where("sn > 0 and not isnan(sn) and sn < double('inf') and det_uid >= 0").select("ff_id", "pa", "det_uid", "sn").distinct()
    m = stats.group_median(f, ["pa", "det_uid"], "sn", "s").where("n >= 3")
    return m.groupBy("pa").agg(F.count("*").alias("n"), r6(stats.band_sensitivity(F.col("s"))).alias("sens"))


@query("cumulative_sensitivity", """WITH f AS (SELECT DISTINCT ff_id, pa, det_uid, sn FROM flatfield WHERE sn > 0 AND isfinite(sn) AND det_uid >= 0), m AS (SELECT pa, det_uid, median(sn) AS s FROM f GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT pa, det_uid, row_number() OVER w AS rank, round(pow(sum(pow(s, -2)) OVER (PARTITION BY pa ORDER BY s, det_uid ROWS UNBOUNDED PRECEDING), -0.5), 6) AS cumulative FROM m WINDOW w AS (PARTITION BY pa ORDER BY s, det_uid)""")
def _(spark, d):
    f = load(spark, d, "flatfield").where("sn > 0 and not isnan(sn) and sn < double('inf') and det_uid >= 0").select("ff_id", "pa", "det_uid", "sn").distinct()
    m = stats.group_median(f, ["pa", "det_uid"], "sn", "s").where("n >= 3")
    return stats.cumulative_sensitivity(m, ["pa"], "s", "det_uid").select("pa", "det_uid", "rank", r6("cumulative").alias("cumulative"))


@query("weighted_line", """WITH q AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y, 1 + l_discount AS w FROM lineitem), s AS (SELECT g, sum(w) AS s, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy FROM q GROUP BY g)
SELECT g, round((s*sxy - sx*sy) / (s*sxx - sx*sx), 6) AS slope, round((sxx*sy - sx*sxy) / (s*sxx - sx*sx), 6) AS intercept FROM s""")
def _(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (1 + F.col("l_discount")).alias("w"))
    return q.groupBy("g").agg(*stats.weighted_line(F.col("x"), F.col("y"), F.col("w"))).select("g", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("pooled_slope", """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, covar_pop(l_quantity, l_extendedprice / 1000) AS c, var_pop(l_quantity) AS vx, var_pop(l_extendedprice / 1000) AS vy FROM lineitem GROUP BY 1),
s AS (SELECT *, sum(n * c) OVER () / sum(n * vx) OVER () AS slope FROM g) SELECT g, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(n * (vy - 2 * slope * c + slope * slope * vx), 3) AS chi2 FROM s""")
def _(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return stats.pooled_slope(q, "g", "x", "y").select("g", r6("slope").alias("slope"), r6("intercept").alias("intercept"), r3("chi2").alias("chi2"))


def _clip_sql(rounds: int) -> str:
    parts = ["WITH k0 AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)", "f1 AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / count(*)) AS e FROM k0 GROUP BY g)"]
    for i in range(2, rounds + 1):
        parts.append(f"f{i} AS (SELECT k0.g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / count(*)) AS e FROM k0 JOIN f{i - 1} p ON k0.g = p.g AND abs(y - p.b * x - p.a) <= 1.5 * p.e GROUP BY k0.g)")
    return ", ".join(parts) + f" SELECT g, round(b, 6) AS slope, round(a, 6) AS intercept, n, round(e, 6) AS err FROM f{rounds}"


@query("clipped_line", _clip_sql(5))
def _(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return stats.clipped_line(q, ["g"], "x", "y", 5, 1.5).select("g", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n", r6("err").alias("err"))


_G = "p AS (SELECT DISTINCT tod_id, pa, det_uid, gain, live FROM pathologies WHERE isfinite(gain))"


@query("normalized_gains", f"""WITH {_G}, ref AS (SELECT * FROM p WHERE live AND gain <> 0), q AS (SELECT tod_id, max(CASE WHEN i = n // 2 THEN gain END) AS med, 0.741 * (max(CASE WHEN i = 3 * n // 4 THEN gain END) - max(CASE WHEN i = n // 4 THEN gain END)) AS sig
FROM (SELECT tod_id, gain, row_number() OVER (PARTITION BY tod_id ORDER BY gain) - 1 AS i, count(*) OVER (PARTITION BY tod_id) AS n FROM ref) GROUP BY 1),
m AS (SELECT tod_id, avg(gain) AS norm, count(*) AS k FROM ref JOIN q USING (tod_id) WHERE sig = 0 OR abs(gain - med) <= 3 * sig GROUP BY 1)
SELECT p.tod_id, p.det_uid, round(p.gain / CASE WHEN coalesce(k, 0) >= 5 AND norm <> 0 THEN norm ELSE 1 END, 6) AS relative, coalesce(k >= 5, false) AS ok FROM p LEFT JOIN m ON p.tod_id = m.tod_id""")
def _(spark, d):
    p = load(spark, d, "pathologies").where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").select("tod_id", "pa", "det_uid", "gain", "live").distinct()
    return stats.normalized_gains(p, ["tod_id"], "det_uid", "gain", F.col("live"), 5).select("tod_id", "det_uid", r6("relative").alias("relative"), "ok")


_FIT = "WHERE pow(x - cx, 2) + pow(y - cy, 2) < 0.25 GROUP BY det"


@query("combine_fits", f"""WITH e AS (SELECT DISTINCT ff_id, concat_ws('|', pa, det_uid) AS det, date_trunc('week', recorded) AS obs, sn / 100 AS x, tau * 100 AS y, peak_dac AS t, sn > 5 AS ok FROM flatfield WHERE det_uid >= 0 AND sn IS NOT NULL AND tau > 0),
f AS (SELECT * FROM e WHERE ok AND isfinite(x) AND isfinite(y) AND isfinite(t)), tp AS (SELECT det, median(x) AS px, median(y) AS py FROM f WHERE obs = (SELECT min(obs) FROM f) GROUP BY det),
sh AS (SELECT obs, median(px - x) AS dx, median(py - y) AS dy FROM f JOIN tp USING (det) GROUP BY obs HAVING count(*) >= 5), g AS (SELECT det, x + dx AS x, y + dy AS y, t FROM f JOIN sh USING (obs)),
c0 AS (SELECT det, median(x) AS cx, median(y) AS cy FROM g GROUP BY det), c1 AS (SELECT det, avg(x) AS cx, avg(y) AS cy FROM g JOIN c0 USING (det) {_FIT}), c2 AS (SELECT det, avg(x) AS cx, avg(y) AS cy FROM g JOIN c1 USING (det) {_FIT}),
c3 AS (SELECT det, avg(x) AS x, avg(y) AS y, avg(t) AS tau, stddev_pop(x) AS x_err, stddev_pop(y) AS y_err, stddev_pop(t) AS tau_err, count(*) AS n FROM g JOIN c2 USING (det) {_FIT})
SELECT det, {', '.join(f'round({c}, 6) AS {c}' for c in ('x', 'y', 'tau', 'x_err', 'y_err', 'tau_err'))}, coalesce(n, 0) AS n_obs, coalesce(n >= 2, false) AS ok FROM (SELECT DISTINCT det FROM e) LEFT JOIN c3 USING (det)""")
def _(spark, d):
    f = load(spark, d, "flatfield").where("det_uid >= 0 and sn is not null and tau > 0").select("ff_id", F.concat_ws("|", "pa", F.col("det_uid").cast("string")).alias("det"), (F.col("sn") / 100).alias("x"), (F.col("tau") * 100).alias("y"), F.col("peak_dac").alias("tau"), (F.col("sn") > 5).alias("ok"), F.date_trunc("week", "recorded").alias("obs")).distinct()
    got = stats.combine_fits(f, "obs", "det", "x", "y", "tau", F.col("ok"), 0.5)
    return got.select("det", *[r6(c).alias(c) for c in ("x", "y", "tau", "x_err", "y_err", "tau_err")], "n_obs", "ok")


@query("histogram", "SELECT CAST(floor((l_extendedprice - 1000) * 20 / 99000) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice >= 1000 AND l_extendedprice < 100000 GROUP BY 1")
def _(spark, d):
    return stats.histogram(load(spark, d, "lineitem"), "l_extendedprice", 1000.0, 100000.0, 20)


# cuts and flags

R = "r AS (SELECT DISTINCT tod_id, det AS det_uid, layer AS flag, start, stop, nsamps FROM cuts WHERE start IS NOT NULL AND stop IS NOT NULL AND start < stop)"
A = "a AS (SELECT tod_id, det AS det_uid, max(nsamps) AS nsamps FROM cuts WHERE tod_id IS NOT NULL AND det IS NOT NULL GROUP BY 1, 2)"


def cut_ranges(spark, d):
    return load(spark, d, "cuts").where("start is not null and stop is not null and start < stop").select("tod_id", F.col("det").alias("det_uid"), F.col("layer").alias("flag"), "start", "stop").distinct()


def axis(spark, d):
    return load(spark, d, "cuts").where("tod_id is not null and det is not null").groupBy("tod_id", F.col("det").alias("det_uid")).agg(F.max("nsamps").alias("nsamps"))


def merged_sql(src: str, name: str, keys: str = "tod_id, det_uid", gap: int = 0) -> str:
    """CTEs that end in ``name``: the union of the ranges of ``src``."""
    return f"""{name}_o AS (SELECT {keys}, start, stop, max(stop) OVER (PARTITION BY {keys} ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT {keys}, start, max(stop) AS stop FROM {src} WHERE start < stop GROUP BY {keys}, start)),
{name}_i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM {name}_o),
{name} AS (SELECT {keys}, min(start) AS start, max(stop) AS stop FROM {name}_i GROUP BY {keys}, g)"""


def complement_sql(src: str, name: str) -> str:
    return f"""{name}_e AS (SELECT tod_id, det_uid, 0 AS start, 0 AS stop, nsamps FROM a UNION ALL SELECT m.tod_id, m.det_uid, start, stop, nsamps FROM {src} m JOIN a USING (tod_id, det_uid)),
{name}_g AS (SELECT tod_id, det_uid, stop AS start, coalesce(lead(start) OVER (PARTITION BY tod_id, det_uid ORDER BY stop), nsamps) AS stop FROM {name}_e), {name} AS (SELECT * FROM {name}_g WHERE start < stop)"""


_CL = "cl AS (SELECT tod_id, det_uid, flag, greatest(start, 0) AS start, least(stop, a.nsamps) AS stop FROM r JOIN a USING (tod_id, det_uid) WHERE greatest(start, 0) < least(stop, a.nsamps))"


@query("cuts_merge", f"WITH {R}, {merged_sql('r', 'm')} SELECT * FROM m")
def _(spark, d):
    return intervals.merge_ranges(cut_ranges(spark, d), KEYS)


@query("cuts_complement", f"WITH {R}, {A}, {_CL}, {merged_sql('cl', 'm')}, {complement_sql('m', 'u')} SELECT tod_id, det_uid, start, stop FROM u")
def _(spark, d):
    ax = axis(spark, d)
    return intervals.complement(intervals.merge_ranges(intervals.clamp(cut_ranges(spark, d), ax, KEYS), KEYS), ax, KEYS)


@query("cuts_buffered", f"WITH {R}, {A}, b AS (SELECT tod_id, det_uid, greatest(start - 30, 0) AS start, CAST(least(stop::BIGINT + 50, a.nsamps) AS INTEGER) AS stop FROM r JOIN a USING (tod_id, det_uid)), {merged_sql('b', 'm')} SELECT * FROM m")
def _(spark, d):
    return intervals.buffered(cut_ranges(spark, d), axis(spark, d), KEYS, 30, 50)


@query("cuts_resampled", f"WITH {R} SELECT DISTINCT tod_id, det_uid, CAST(trunc(start / 4.0) AS INTEGER) AS start, CAST(trunc(stop / 4.0) AS INTEGER) AS stop FROM r")
def _(spark, d):
    return intervals.resampled(cut_ranges(spark, d), KEYS, 4.0).distinct()


@query("cuts_extracted", f"""WITH {R}, {A}, x AS (SELECT tod_id, det_uid, start, stop FROM r UNION ALL SELECT tod_id, det_uid, nsamps, greatest(nsamps, 33000) FROM a),
e AS (SELECT tod_id, det_uid, greatest(start - 8000, 0) AS start, least(stop - 8000, 25000) AS stop FROM x), {merged_sql('e', 'm')} SELECT * FROM m""")
def _(spark, d):
    return intervals.extracted(cut_ranges(spark, d), axis(spark, d), KEYS, 8000, 25000)


@query("cuts_always", f"""WITH {R}, {A}, {_CL}, {merged_sql('cl', 'm')}, p AS (SELECT tod_id, det_uid, count(*) AS n, min(start) AS s, max(stop) AS e FROM m GROUP BY 1, 2)
SELECT tod_id, det_uid, coalesce(n = 1 AND s <= 0 AND e >= nsamps, false) AS cut FROM a LEFT JOIN p USING (tod_id, det_uid)""")
def _(spark, d):
    ax = axis(spark, d)
    return intervals.always_cut(intervals.merge_ranges(intervals.clamp(cut_ranges(spark, d), ax, KEYS), KEYS), ax, KEYS)


_FR = f"{R}, {A}, {_CL}, {merged_sql('cl', 'm')}, f AS (SELECT a.tod_id, a.det_uid, a.nsamps, count(m.start) AS n, coalesce(sum(m.stop - m.start) / a.nsamps::DOUBLE, 0) AS fr FROM a LEFT JOIN m USING (tod_id, det_uid) GROUP BY 1, 2, 3)"


@query("cuts_fraction", f"WITH {_FR} SELECT tod_id, det_uid, n AS n_ranges, round(fr, 6) AS fraction FROM f")
def _(spark, d):
    ax = axis(spark, d)
    got = intervals.cut_fraction(intervals.merge_ranges(intervals.clamp(cut_ranges(spark, d), ax, KEYS), KEYS), ax, KEYS)
    return got.select(*KEYS, F.col("n_ranges").cast("long").alias("n_ranges"), r6("fraction").alias("fraction"))


@query("cuts_recovered", f"""WITH {_FR} SELECT m.tod_id, m.det_uid, m.start, m.stop FROM m JOIN f USING (tod_id, det_uid) WHERE NOT (fr > 0.2 OR n > 8)
UNION ALL SELECT tod_id, det_uid, 0, nsamps FROM f WHERE fr > 0.2 OR n > 8""")
def _(spark, d):
    ax = axis(spark, d)
    return intervals.recovered_cuts(intervals.merge_ranges(intervals.clamp(cut_ranges(spark, d), ax, KEYS), KEYS), ax, KEYS, 0.2, 8)


@query("cuts_of_two", f"""WITH {R}, {A}, y AS (SELECT tod_id, det_uid, start, stop FROM r WHERE flag = 'glitch' UNION ALL SELECT tod_id, det_uid, start, stop FROM r JOIN a USING (tod_id, det_uid) WHERE flag = 'planet'
UNION ALL SELECT tod_id, det_uid, 0, nsamps FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.flag = 'planet' AND r.tod_id = a.tod_id AND r.det_uid = a.det_uid)), {merged_sql('y', 'm')} SELECT * FROM m""")
def _(spark, d):
    r, ax = cut_ranges(spark, d), axis(spark, d)
    planet = r.where("flag = 'planet'")
    return intervals.merge_tables(r.where("flag = 'glitch'"), planet, KEYS, ax, planet, cut_missing=True)


@query("mask_ranges", f"WITH {S}, h AS (SELECT tod_id, det_uid, samp, samp - row_number() OVER {W} AS g FROM (SELECT *, avg(x) OVER {P} AS m FROM s) WHERE x > m) SELECT tod_id, det_uid, CAST(min(samp) AS INTEGER) AS start, CAST(max(samp) + 1 AS INTEGER) AS stop FROM h GROUP BY tod_id, det_uid, g")
def _(spark, d):
    s = stream(spark, d)
    m = s.join(s.groupBy(*KEYS).agg(F.avg("x").alias("m")), KEYS)
    return intervals.ranges_of_mask(m, KEYS, "samp", F.col("x") > F.col("m"))


_LOW = f"lr AS (SELECT tod_id, det AS det_uid, greatest(start, 0) // 80 AS start, least(stop, nsamps) // 80 AS stop FROM cuts WHERE start IS NOT NULL AND stop >= 0 AND greatest(start, 0) // 80 < least(stop, nsamps) // 80), {merged_sql('lr', 'lm')}"


def low_cuts(spark, d):
    """Cuts on the axis of the downsampled streams, merged. A cut that begins before the TOD counts from sample 0."""
    c = load(spark, d, "cuts").where("start is not null and stop is not null")
    c = c.select("tod_id", F.col("det").alias("det_uid"), F.floor(F.greatest("start", F.lit(0)) / 80).cast("int").alias("start"), F.floor(F.least("stop", "nsamps") / 80).cast("int").alias("stop"))
    return intervals.merge_ranges(c, KEYS)


@query("samples_cut", f"WITH {S}, {_LOW} SELECT s.tod_id, s.det_uid, count(*) AS n, round(avg(x), 3) AS mean FROM s JOIN lm ON s.tod_id = lm.tod_id AND s.det_uid = lm.det_uid AND samp >= start AND samp < stop GROUP BY 1, 2")
def _(spark, d):
    got = intervals.in_ranges(stream(spark, d), low_cuts(spark, d), KEYS, "samp")
    return got.groupBy(*KEYS).agg(F.count("*").alias("n"), r3(F.avg("x")).alias("mean"))


@query("samples_uncut", f"WITH {S}, {_LOW} SELECT tod_id, det_uid, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM lm WHERE s.tod_id = lm.tod_id AND s.det_uid = lm.det_uid AND samp >= start AND samp < stop) GROUP BY 1, 2")
def _(spark, d):
    return intervals.in_ranges(stream(spark, d), low_cuts(spark, d), KEYS, "samp", anti=True).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("mask_of_cuts", f"WITH {_LOW}, {A}, x AS (SELECT tod_id, det_uid, unnest(range(start, least(stop, nsamps // 80))) AS samp FROM lm JOIN a USING (tod_id, det_uid)) SELECT tod_id, det_uid, CAST(samp AS INTEGER) AS samp FROM x")
def _(spark, d):
    c = low_cuts(spark, d)
    ax = axis(spark, d).withColumn("nsamps", F.floor(F.col("nsamps") / 80).cast("int"))
    return intervals.mask_of_ranges(c, ax, KEYS)


@query("constant_detectors", "SELECT DISTINCT tod_id FROM (SELECT tod_id, max(nsamps) - min(nsamps) AS w FROM cuts GROUP BY 1) WHERE w = 0")
def _(spark, d):
    return ordered.constant_detectors(load(spark, d, "cuts").where("tod_id is not null"), ["tod_id"], "nsamps")


_BITS = {f: i for i, f in enumerate(["glitch", "planet", "partial", "mce", "source", "scan", "turn", "jump", "azimuth", "other"])}
_DF = f"""WITH {R}, {A}, {_CL}, ng AS (SELECT * FROM cl WHERE flag = 'planet'), {merged_sql('ng', 'nm')}, {complement_sql('nm', 'nc')},
u AS (SELECT tod_id, det_uid, start, stop FROM cl WHERE flag = 'glitch' UNION ALL SELECT tod_id, det_uid, start, stop FROM nc), {merged_sql('u', 'm')} SELECT * FROM m"""


@query("flags_derived", _DF)
def _(spark, d):
    return intervals.derived_flag(cut_ranges(spark, d), axis(spark, d), KEYS, ["glitch"], ["planet"])


_CASE = "CASE flag " + " ".join(f"WHEN '{f}' THEN {1 << b}" for f, b in _BITS.items()) + " END"
_PACK = f"""{R}, {A}, {_CL}, fl AS (SELECT * FROM cl WHERE flag IN ({', '.join(repr(f) for f in _BITS)})), {merged_sql('fl', 'fm', 'tod_id, det_uid, flag')},
ev AS (SELECT tod_id, det_uid, start AS index, {_CASE} AS d, nsamps FROM fm JOIN a USING (tod_id, det_uid) UNION ALL SELECT tod_id, det_uid, stop, -({_CASE}), nsamps FROM fm JOIN a USING (tod_id, det_uid) UNION ALL SELECT tod_id, det_uid, 0, 0, nsamps FROM a),
pe AS (SELECT tod_id, det_uid, index, sum(d) AS d FROM ev WHERE index < nsamps GROUP BY 1, 2, 3), st AS (SELECT *, CAST(sum(d) OVER (PARTITION BY tod_id, det_uid ORDER BY index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mask FROM pe)"""


@query("flags_pack", f"WITH {_PACK} SELECT tod_id, det_uid, index, mask FROM st WHERE d <> 0 OR index = 0")
def _(spark, d):
    return intervals.pack_flags(cut_ranges(spark, d), axis(spark, d), KEYS, _BITS)


@query("flags_unpack", f"WITH {R}, {A}, {_CL}, fl AS (SELECT * FROM cl WHERE flag IN ({', '.join(repr(f) for f in _BITS)})), {merged_sql('fl', 'fm', 'tod_id, det_uid, flag')} SELECT * FROM fm")
def _(spark, d):
    ax = axis(spark, d)
    return intervals.unpack_flags(intervals.pack_flags(cut_ranges(spark, d), ax, KEYS, _BITS), ax, KEYS, _BITS)


# ordered signals

@query("jump_statistic", f"""WITH {S}, n AS (SELECT *, max(samp) OVER {P} + 1 AS nd FROM s), j AS (SELECT *, sum(x) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS p,
sum(x) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN 10 FOLLOWING AND 19 FOLLOWING) AS q, count(*) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN 10 FOLLOWING AND 19 FOLLOWING) AS c FROM n)
SELECT tod_id, det_uid, round(coalesce(max(CASE WHEN c = 10 AND samp + 20 < nd + 1 THEN abs(p - q) / 10 END), 0), 3) AS jump FROM j GROUP BY 1, 2""")
def _(spark, d):
    return ordered.jump_statistic(stream(spark, d), KEYS, "samp", "x", 10).withColumn("jump", r3("jump"))


@query("step_jumps", f"""WITH {S}, l AS (SELECT tod_id, det_uid, samp, lead(x, 3) OVER {W} - x AS dd FROM s), j AS (SELECT * FROM l WHERE abs(dd) > 20000), g AS (SELECT *, samp - row_number() OVER {W} AS g FROM j)
SELECT tod_id, det_uid, CAST(ceil((min(samp) + max(samp) + 3) / 2.0) AS INTEGER) AS at, round(avg(dd), 3) AS size FROM g GROUP BY tod_id, det_uid, g""")
def _(spark, d):
    return ordered.step_jumps(stream(spark, d), KEYS, "samp", "x", 3, 20000.0).withColumn("size", r3("size"))


@query("remove_jumps", f"""WITH {S}, l AS (SELECT tod_id, det_uid, samp, lead(x, 3) OVER {W} - x AS dd FROM s), j AS (SELECT * FROM l WHERE abs(dd) > 20000), g AS (SELECT *, samp - row_number() OVER {W} AS g FROM j),
e AS (SELECT tod_id, det_uid, CAST(ceil((min(samp) + max(samp) + 3) / 2.0) AS INTEGER) AS at, round(avg(dd) / 1000) * 1000 AS k, abs(avg(dd) / 1000 - round(avg(dd) / 1000)) AS res FROM g GROUP BY tod_id, det_uid, g)
SELECT s.tod_id, s.det_uid, s.samp, round(any_value(x) - coalesce(sum(k), 0), 3) AS x FROM s LEFT JOIN (SELECT * FROM e WHERE res <= 0.2 AND k <> 0) e ON e.tod_id = s.tod_id AND e.det_uid = s.det_uid AND e.at <= s.samp GROUP BY 1, 2, 3""")
def _(spark, d):
    s = stream(spark, d)
    jumps = ordered.quantised_jumps(ordered.step_jumps(s, KEYS, "samp", "x", 3, 20000.0), 1000.0, 0.2)
    return ordered.remove_jumps(s, jumps, KEYS, "samp", "x", 1000.0).withColumn("x", r3("x"))


@query("unwrap", f"""WITH {S}, w AS (SELECT tod_id, det_uid, samp, ((x % 4096) + 4096) % 4096 AS y FROM s), t AS (SELECT *, y - lag(y) OVER {W} AS dd FROM w)
SELECT tod_id, det_uid, samp, round(y + 4096 * sum(CASE WHEN dd > 2048 THEN -1 WHEN dd < -2048 THEN 1 ELSE 0 END) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS UNBOUNDED PRECEDING), 3) AS y FROM t""")
def _(spark, d):
    w = stream(spark, d).select(*KEYS, "samp", F.pmod("x", F.lit(4096.0)).alias("y"))
    return ordered.unwrap(w, KEYS, "samp", "y", 4096.0).withColumn("y", r3("y"))


_DT = f"""{S}, t AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER {P} AS n, first_value(x) OVER {W} AS a, last_value(x) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM s)"""


@query("detrend", f"WITH {_DT} SELECT tod_id, det_uid, samp, round(x - i * CASE WHEN n > 1 THEN (b - a) / (n - 1) ELSE 0 END + (b - a) / 2, 3) AS x FROM t")
def _(spark, d):
    return ordered.detrend(stream(spark, d), KEYS, "samp", "x").select(*KEYS, "samp", r3("x").alias("x"))


@query("retrend", f"WITH {S} SELECT tod_id, det_uid, samp, round(x, 3) AS x FROM s")
def _(spark, d):
    return ordered.retrend(ordered.detrend(stream(spark, d), KEYS, "samp", "x"), "x").select(*KEYS, "samp", r3("x").alias("x"))


@query("detrend_ends", f"""WITH {S}, t AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER {P} AS n FROM s), k AS (SELECT *, (avg(CASE WHEN i >= n - 20 THEN x END) OVER {P} - avg(CASE WHEN i < 20 THEN x END) OVER {P}) / greatest(n - 20, 1) AS sl FROM t),
z AS (SELECT *, x - sl * i AS y FROM k) SELECT tod_id, det_uid, samp, round(y - avg(y) OVER {P}, 3) AS x FROM z""")
def _(spark, d):
    return ordered.detrend_ends(stream(spark, d), KEYS, "samp", "x", 20).select(*KEYS, "samp", r3("x").alias("x"))


@query("remove_mean", f"WITH {S} SELECT tod_id, det_uid, samp, round(x - avg(x) OVER {P}, 3) AS x FROM s")
def _(spark, d):
    return ordered.remove_centre(stream(spark, d), KEYS, "x").select(*KEYS, "samp", r3("x").alias("x"))


@query("remove_median", f"WITH {S}, m AS (SELECT tod_id, det_uid, median(x) AS m FROM s GROUP BY 1, 2) SELECT tod_id, det_uid, samp, round(x - m, 3) AS x FROM s JOIN m USING (tod_id, det_uid)")
def _(spark, d):
    return ordered.remove_centre(stream(spark, d), KEYS, "x", median=True).select(*KEYS, "samp", r3("x").alias("x"))


@query("downsample_121", f"""WITH {S}, n AS (SELECT *, lag(x) OVER {W} AS l, lead(x) OVER {W} AS r FROM s) SELECT tod_id, det_uid, CAST(samp // 2 AS INTEGER) AS samp,
round((2 * x + coalesce(l, 0) + coalesce(r, 0)) * CASE WHEN l IS NULL AND r IS NULL THEN 0.5 WHEN l IS NULL OR r IS NULL THEN 1 / 3.0::DOUBLE ELSE 0.25 END, 3) AS x FROM n WHERE samp % 2 = 0""")
def _(spark, d):
    return ordered.downsample_121(stream(spark, d), KEYS, "samp", "x").withColumn("x", r3("x"))


def _half(src: str, name: str) -> str:
    w = "(PARTITION BY tod_id, det_uid ORDER BY samp)"
    return f"""{name}_n AS (SELECT *, lag(x) OVER {w} AS l, lead(x) OVER {w} AS r FROM {src}), {name} AS (SELECT tod_id, det_uid, CAST(samp // 2 AS INTEGER) AS samp,
(2 * x + coalesce(l, 0) + coalesce(r, 0)) * CASE WHEN l IS NULL AND r IS NULL THEN 0.5 WHEN l IS NULL OR r IS NULL THEN 1 / 3.0::DOUBLE ELSE 0.25 END AS x FROM {name}_n WHERE samp % 2 = 0)"""


@query("decimate_4", f"WITH {S}, {_half('s', 'h')}, {_half('h', 'q')} SELECT tod_id, det_uid, samp, round(x, 3) AS x FROM q")
def _(spark, d):
    return ordered.decimate(stream(spark, d), KEYS, "samp", "x", 4).withColumn("x", r3("x"))


@query("boxcar", f"""WITH {S}, t AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER {P} AS n FROM s), e AS (SELECT * FROM t UNION ALL SELECT * REPLACE (i + n AS i) FROM t WHERE i < 7 UNION ALL SELECT * REPLACE (i - n AS i) FROM t WHERE i >= n - 7),
m AS (SELECT *, avg(x) OVER (PARTITION BY tod_id, det_uid ORDER BY i RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y FROM e) SELECT tod_id, det_uid, samp, round(y, 3) AS x FROM m WHERE i >= 0 AND i < n""")
def _(spark, d):
    return ordered.boxcar(stream(spark, d), KEYS, "samp", "x", 7).withColumn("x", r3("x"))


@query("scan_turns", f"""WITH {S}, v AS (SELECT *, abs(coalesce(lead(x) OVER {W}, x) - coalesce(lag(x) OVER {W}, x)) / CASE WHEN lag(x) OVER {W} IS NULL OR lead(x) OVER {W} IS NULL THEN 1 ELSE 2 END AS v FROM s),
m AS (SELECT tod_id, det_uid, median(v) AS m FROM v GROUP BY 1, 2), h AS (SELECT tod_id, det_uid, samp, samp - row_number() OVER {W} AS g FROM v JOIN m USING (tod_id, det_uid) WHERE v < m * (1 / 3.0::DOUBLE)),
i AS (SELECT tod_id, det_uid, CAST(min(samp) AS INTEGER) AS start, CAST(max(samp) + 1 AS INTEGER) AS stop FROM h GROUP BY tod_id, det_uid, g), {merged_sql('i', 'j', gap=5)} SELECT * FROM j""")
def _(spark, d):
    return ordered.scan_turns(stream(spark, d), KEYS, "samp", "x", 5)


@query("fill_cuts", f"""WITH {S}, {_LOW}, e AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY tod_id, det_uid ORDER BY start), -1073741824) AS pl, coalesce(lead(start) OVER (PARTITION BY tod_id, det_uid ORDER BY start), 1073741824) AS nh FROM lm),
c AS (SELECT tod_id, det_uid, start, stop, greatest(start - 8, pl) AS lo, least(stop + 8, nh) AS hi FROM e),
x AS (SELECT c.tod_id, c.det_uid, c.start, c.stop, c.lo, regr_slope(s.x, (samp - lo)::DOUBLE) AS k, regr_intercept(s.x, (samp - lo)::DOUBLE) AS b, avg(s.x) AS m, count(*) FILTER (WHERE samp < start) AS nl, count(*) FILTER (WHERE samp >= stop) AS nr
FROM c JOIN s ON s.tod_id = c.tod_id AND s.det_uid = c.det_uid AND samp >= lo AND samp < hi AND (samp < start OR samp >= stop) GROUP BY 1, 2, 3, 4, 5)
SELECT s.tod_id, s.det_uid, s.samp, round(CASE WHEN lm.start IS NULL THEN s.x WHEN nl > 0 AND nr > 0 AND k IS NOT NULL THEN b + k * (samp - lo) ELSE m END, 2) AS x
FROM s LEFT JOIN lm ON s.tod_id = lm.tod_id AND s.det_uid = lm.det_uid AND samp >= lm.start AND samp < lm.stop LEFT JOIN x ON x.tod_id = lm.tod_id AND x.det_uid = lm.det_uid AND x.start = lm.start""")
def _(spark, d):
    return ordered.fill_ranges(stream(spark, d), low_cuts(spark, d), KEYS, "samp", "x", 8).withColumn("x", F.round("x", 2))


_SINE = f"""{S}, y AS (SELECT *, (x - avg(x) OVER {P}) / 1000 AS y, cos(2 * {math.pi!r} * 0.025 * samp) AS c, sin(2 * {math.pi!r} * 0.025 * samp) AS z FROM s),
t AS (SELECT tod_id, det_uid, sum(c*c) AS cc, sum(z*z) AS ss, sum(c*z) AS cs, sum(y*c) AS yc, sum(y*z) AS ys FROM y GROUP BY 1, 2), f AS (SELECT *, (ss*yc - cs*ys) / (cc*ss - cs*cs) AS fa, (cc*ys - cs*yc) / (cc*ss - cs*cs) AS fb FROM t)"""


@query("sync_amplitude", f"WITH {_SINE} SELECT tod_id, det_uid, round(sqrt(fa*fa + fb*fb), 5) AS amp FROM f")
def _(spark, d):
    y = stream(spark, d).withColumn("x", F.col("x") / 1000)
    return ordered.sine_fit(y, KEYS, F.col("samp").cast("double"), "x", 0.025).select(*KEYS, F.round("amp", 5).alias("amp"))


_COS = f"""sum(y*y) AS yy, count(*) AS n FROM y GROUP BY 1, 2), f AS (SELECT *, (ss*yc - cs*ys) / (cc*ss - cs*cs) AS fa, (cc*ys - cs*yc) / (cc*ss - cs*cs) AS fb FROM t)"""


@query("sine_fit", f"WITH {_SINE.split('sum(y*z) AS ys FROM y')[0]}sum(y*z) AS ys, {_COS} SELECT tod_id, det_uid, round(sqrt(fa*fa + fb*fb), 5) AS amp, round(atan(fb / fa) + CASE WHEN fa > 0 THEN 0 ELSE pi() END, 5) AS phase, round(sqrt(greatest(yy - fa*yc - fb*ys, 0) / n), 5) AS rms FROM f WHERE fa <> 0")
def _(spark, d):
    y = stream(spark, d).withColumn("x", F.col("x") / 1000)
    got = ordered.sine_fit(y, KEYS, F.col("samp").cast("double"), "x", 0.025)
    return got.select(*KEYS, *[F.round(c, 5).alias(c) for c in ("amp", "phase", "rms")])


@query("column_outliers", "WITH p AS (SELECT DISTINCT tod_id, det_uid, gain FROM pathologies WHERE isfinite(gain)), m AS (SELECT det_uid, median(gain) AS m FROM p GROUP BY 1) SELECT det_uid, count(*) FILTER (WHERE abs(gain - m) > 0.3 * abs(m)) AS n FROM p JOIN m USING (det_uid) GROUP BY 1")
def _(spark, d):
    p = load(spark, d, "pathologies").where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").select("tod_id", "det_uid", "gain").distinct()
    return ordered.outliers_in_column(p, ["det_uid"], "gain", 0.3).groupBy("det_uid").agg(F.count_if("outlier").alias("n"))


@query("phasors_added", "WITH p AS (SELECT DISTINCT tod_id, det_uid, gain, rms FROM pathologies WHERE isfinite(gain) AND isfinite(rms)), s AS (SELECT *, gain * cos(det_uid) + rms * cos(2.0 * det_uid) AS c, gain * sin(det_uid) + rms * sin(2.0 * det_uid) AS s FROM p) SELECT tod_id, det_uid, round(sqrt(c * c + s * s), 5) AS amp, round(cos(atan2(s, c)), 5) + 0.0 AS cos FROM s WHERE c * c + s * s > 1e-6")
def _(spark, d):
    fine = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in ("gain", "rms"))
    p = load(spark, d, "pathologies").where(fine).select("tod_id", "det_uid", "gain", "rms").distinct()
    amp, phase = ordered.add_phasors(F.col("gain"), F.col("det_uid").cast("double"), F.col("rms"), 2.0 * F.col("det_uid"))
    return p.withColumn("amp", amp).withColumn("phase", phase).where("amp * amp > 1e-6").select("tod_id", "det_uid", F.round("amp", 5).alias("amp"), (F.round(F.cos("phase"), 5) + 0.0).alias("cos"))


@query("fill_blanks", "WITH p AS (SELECT DISTINCT tod_id, det_uid, gain FROM pathologies WHERE isfinite(gain)), m AS (SELECT det_uid, median(CASE WHEN gain > 0 THEN gain END) AS m FROM p GROUP BY 1) SELECT tod_id, det_uid, round(CASE WHEN gain > 0 THEN gain ELSE m END, 6) AS gain FROM p JOIN m USING (det_uid)")
def _(spark, d):
    p = load(spark, d, "pathologies").where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").select("tod_id", "det_uid", "gain").distinct()
    return ordered.fill_blanks(p, ["det_uid"], "gain", F.col("gain") > 0).withColumn("gain", r6("gain"))


@query("repair_steps", f"""WITH {S}, d AS (SELECT *, x - lag(x) OVER {W} AS dd FROM s), m AS (SELECT tod_id, det_uid, median(dd) AS md FROM d GROUP BY 1, 2), b AS (SELECT d.*, coalesce(abs(dd - md) > 20000, false) AS bad FROM d JOIN m USING (tod_id, det_uid)),
f AS (SELECT tod_id, det_uid, count(*) AS n, sum(samp::DOUBLE) AS sx, sum(x) AS sy, sum(samp * x) AS sxy, sum(samp::DOUBLE * samp) AS sxx FROM b WHERE NOT bad GROUP BY 1, 2), k AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS k FROM f)
SELECT tod_id, det_uid, samp, round(CASE WHEN bad THEN (sy - k * sx) / n + k * samp ELSE x END, 2) AS x FROM b JOIN k USING (tod_id, det_uid)""")
def _(spark, d):
    return ordered.repair_steps(stream(spark, d), KEYS, "samp", "x", 20000.0).select(*KEYS, "samp", F.round("x", 2).alias("x"))


# matrices of streams

_E = "e AS (SELECT vec_id AS det, unnest(range(len(embedding))) AS samp, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def matrix(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("det"), F.posexplode("embedding").alias("samp", "x")).withColumn("x", F.col("x").cast("double"))


@query("mode_dots", f"WITH {_E} SELECT det, CAST(m AS INTEGER) AS mode, round(sum(x * cos(m * samp / 10.0)), 6) AS dot FROM e, (SELECT unnest(range(1, 4)) AS m) GROUP BY 1, 2")
def _(spark, d):
    m = matrix(spark, d).withColumn("mode", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return m.groupBy("det", "mode").agg(r6(F.sum(F.col("x") * F.cos(F.col("mode") * F.col("samp") / 10.0))).alias("dot"))


@query("remove_modes", f"""WITH {_E}, g AS (SELECT *, avg(x) OVER (PARTITION BY samp) AS mode FROM e), k AS (SELECT det, sum(x * mode) / sum(mode * mode) AS k FROM g GROUP BY det) SELECT det, CAST(samp AS INTEGER) AS samp, round(x - k * mode, 6) AS x FROM g JOIN k USING (det)""")
def _(spark, d):
    m = matrix(spark, d)
    common = m.groupBy("samp").agg(F.avg("x").alias("mode"))
    g = m.join(common, "samp")
    k = g.groupBy("det").agg((F.sum(F.col("x") * F.col("mode")) / F.sum(F.col("mode") ** 2)).alias("k"))
    return g.join(k, "det").select("det", "samp", r6(F.col("x") - F.col("k") * F.col("mode")).alias("x"))


@query("correlation_pairs", f"WITH {_C}, p AS (SELECT a.tod_id, a.det_uid AS a, b.det_uid AS b, covar_samp(a.y, b.y) AS cov, corr(a.y, b.y) AS corr FROM c a JOIN c b ON a.tod_id = b.tod_id AND a.samp = b.samp AND a.det_uid < b.det_uid GROUP BY 1, 2, 3) SELECT tod_id, a, b, round(corr, 6) AS corr FROM p")
def _(spark, d):
    return joins.pairwise_correlation(centred(spark, d), ["tod_id"], "det_uid", "samp", "y").select("tod_id", "a", "b", r6("corr").alias("corr"))


@query("radial_correlation", f"""WITH {_C}, p AS (SELECT a.tod_id, a.det_uid AS a, b.det_uid AS b, corr(a.y, b.y) AS corr FROM c a JOIN c b ON a.tod_id = b.tod_id AND a.samp = b.samp AND a.det_uid < b.det_uid GROUP BY 1, 2, 3),
q AS (SELECT det_uid, min(sky_x) AS x, min(sky_y) AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL GROUP BY 1), r AS (SELECT corr, sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)) AS d FROM p JOIN q u ON u.det_uid = a JOIN q v ON v.det_uid = b),
t AS (SELECT corr, CASE WHEN d < 0.5 THEN 0 WHEN d < 1 THEN 1 WHEN d < 1.5 THEN 2 WHEN d < 2 THEN 3 WHEN d < 3 THEN 4 END AS bin FROM r)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(quantile_cont(corr, 0.34), 6) AS p34, round(quantile_cont(corr, 0.5), 6) AS p50, round(quantile_cont(corr, 0.66), 6) AS p66 FROM t WHERE bin IS NOT NULL GROUP BY 1""")
def _(spark, d):
    pairs = joins.pairwise_correlation(centred(spark, d), ["tod_id"], "det_uid", "samp", "y")
    places = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null").groupBy("det_uid").agg(F.min("sky_x").alias("x"), F.min("sky_y").alias("y"))
    got = joins.radial_bins(pairs, places, "det_uid", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
    return got.select("bin", "n", *[r6(c).alias(c) for c in ("p34", "p50", "p66")])


@query("resample_join", f"WITH {S}, g AS (SELECT tod_id, det_uid, max(samp) AS m FROM s GROUP BY 1, 2), o AS (SELECT tod_id, det_uid, unnest(range((4 * (m + 1) + 2) // 3)) AS o FROM g) SELECT tod_id, det_uid, CAST(o AS INTEGER) AS samp, x FROM o JOIN s USING (tod_id, det_uid) WHERE s.samp = o * 3 // 4")
def _(spark, d):
    return joins.resample_join(stream(spark, d), KEYS, "samp", 3, 4).select(*KEYS, "samp", "x")
