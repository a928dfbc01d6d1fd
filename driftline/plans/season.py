"""Queries on season-level steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import tod_key
from driftline.operators import intervals, season, stats
from driftline.plans.catalog import TODS, _tods
from driftline.plans.signals import A, KEYS, R, S, _CL, axis, cut_ranges, merged_sql, stream
from driftline.tables import load

QUERIES, SQL = {}, {}
r6 = lambda c: F.round(c, 6)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _patho(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pathologies").select("tod_id", "pa", "det_uid", "ctime", "rms", "gain", "correlation", "kurtosis", "live").distinct()


_P = "p AS (SELECT DISTINCT tod_id, pa, det_uid, ctime, rms, gain, correlation, kurtosis, live FROM pathologies)"
_D = "dd AS (SELECT pa, det_uid, min(optical_sign) AS s, min(nom_freq) AS f FROM array_data WHERE det_uid IS NOT NULL GROUP BY 1, 2)"


def _dets(spark, d):
    return load(spark, d, "array_data").where("det_uid is not null").groupBy("pa", "det_uid").agg(F.min("optical_sign").alias("s"), F.min("nom_freq").alias("f"))


_FFM = "ff AS (SELECT pa, det_uid, median(peak_dac) AS m FROM (SELECT DISTINCT ff_id, pa, det_uid, peak_dac FROM flatfield WHERE isfinite(peak_dac) AND peak_dac <> 0 AND det_uid >= 0) GROUP BY 1, 2)"


@query("cal_chain", f"WITH {_P}, {_D}, {_FFM} SELECT p.tod_id, p.det_uid, round(2.0 * coalesce(dd.s, 0) * coalesce(ff.m, 0) / 100, 6) AS cal FROM p LEFT JOIN dd ON dd.pa = p.pa AND dd.det_uid = p.det_uid LEFT JOIN ff ON ff.pa = p.pa AND ff.det_uid = p.det_uid")
def _(spark, d):
    ff = load(spark, d, "flatfield").where("peak_dac is not null and not isnan(peak_dac) and abs(peak_dac) < double('inf') and peak_dac <> 0 and det_uid >= 0").select("ff_id", "pa", "det_uid", "peak_dac").distinct()
    gain = stats.group_median(ff, ["pa", "det_uid"], "peak_dac", "m").select("pa", "det_uid", (F.col("m") / 100).alias("cal"))
    sign = _dets(spark, d).select("pa", "det_uid", F.col("s").alias("cal"))
    got = season.calibration_chain(_patho(spark, d).select("tod_id", "pa", "det_uid"), [("constant", 2.0, []), ("table", sign, ["pa", "det_uid"]), ("table", gain, ["pa", "det_uid"])])
    return got.select("tod_id", "det_uid", r6("cal").alias("cal"))


@query("recovered_calibration", f"""WITH {_P}, {_D}, g AS (SELECT p.tod_id, p.det_uid, p.gain, p.live, dd.f, dd.s FROM p JOIN dd ON dd.pa = p.pa AND dd.det_uid = p.det_uid WHERE isfinite(p.gain) AND dd.f IS NOT NULL), ref AS (SELECT * FROM g WHERE live AND gain <> 0),
q AS (SELECT tod_id, f, max(CASE WHEN i = n // 2 THEN gain END) AS med, 0.741 * (max(CASE WHEN i = 3 * n // 4 THEN gain END) - max(CASE WHEN i = n // 4 THEN gain END)) AS sig FROM (SELECT tod_id, f, gain, row_number() OVER (PARTITION BY tod_id, f ORDER BY gain) - 1 AS i, count(*) OVER (PARTITION BY tod_id, f) AS n FROM ref) GROUP BY 1, 2),
m AS (SELECT tod_id, f, avg(gain) AS norm, count(*) AS k FROM ref JOIN q USING (tod_id, f) WHERE sig = 0 OR abs(gain - med) <= 3 * sig GROUP BY 1, 2), r AS (SELECT g.*, g.gain / CASE WHEN coalesce(k, 0) >= 2 AND norm <> 0 THEN norm ELSE 1 END AS rel FROM g LEFT JOIN m ON g.tod_id = m.tod_id AND g.f = m.f)
SELECT tod_id, det_uid, round(CASE WHEN rel <> 0 THEN s / rel ELSE 0 END, 6) AS cal FROM r""")
def _(spark, d):
    p = _patho(spark, d).where("gain is not null and not isnan(gain) and abs(gain) < double('inf')").join(_dets(spark, d).where("f is not null"), ["pa", "det_uid"])
    rel = stats.normalized_gains(p, ["tod_id", "f"], "det_uid", "gain", F.col("live"), 2)
    cal = F.when(F.col("relative") != 0, F.col("s") / F.when(F.col("relative") != 0, F.col("relative"))).otherwise(0.0)
    return rel.select("tod_id", "det_uid", r6(cal).alias("cal"))


@query("calibrated_streams", f"WITH {S}, c AS (SELECT det_uid, min(optical_sign) AS c FROM array_data WHERE det_type = 'tes' GROUP BY 1) SELECT s.tod_id, s.det_uid, s.samp, round(x * coalesce(c, 0), 3) + 0.0 AS x FROM s LEFT JOIN c USING (det_uid)")
def _(spark, d):
    cal = load(spark, d, "array_data").where("det_type = 'tes'").groupBy("det_uid").agg(F.min("optical_sign").alias("cal"))
    return season.calibrated(stream(spark, d), cal, ["det_uid"], "x").select(*KEYS, "samp", (F.round("x", 3) + 0.0).alias("x"))


@query("cut_check", f"""WITH {_P} SELECT tod_id, det_uid, CASE WHEN rms IS NULL OR isnan(rms) OR NOT rms BETWEEN 5 AND 200 THEN 'rms' WHEN gain IS NULL OR isnan(gain) OR NOT gain BETWEEN 0.5 AND 1.5 THEN 'gain'
WHEN correlation IS NULL OR isnan(correlation) OR NOT correlation BETWEEN 0.9 AND 1 THEN 'correlation' END AS failed FROM p""")
def _(spark, d):
    return season.first_failure(_patho(spark, d), {"rms": (5.0, 200.0), "gain": (0.5, 1.5), "correlation": (0.9, 1.0)}).select("tod_id", "det_uid", "failed")


_LONG = f"{_P}, u AS (SELECT tod_id, det_uid, key, v FROM (UNPIVOT p ON rms, gain, correlation INTO NAME key VALUE v) WHERE isfinite(v))"


def _long(spark, d):
    p = _patho(spark, d).select("tod_id", "det_uid", *[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in ("rms", "gain", "correlation")])
    return p.unpivot(["tod_id", "det_uid"], ["rms", "gain", "correlation"], "key", "v").where("v is not null")


_SIG = "SELECT tod_id, key, max(CASE WHEN i = n // 2 THEN v END) AS med, 0.741 * (max(CASE WHEN i = 3 * n // 4 THEN v END) - max(CASE WHEN i = n // 4 THEN v END)) AS sig FROM (SELECT tod_id, key, v, row_number() OVER (PARTITION BY tod_id, key ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY tod_id, key) AS n FROM u) GROUP BY 1, 2"


@query("criteria_selection", f"""WITH {_LONG}, s AS ({_SIG}), o AS (SELECT tod_id, det_uid, CASE key WHEN 'gain' THEN v BETWEEN 0.5 AND 1.5 AND (sig = 0 OR abs(v - med) <= 3 * sig) WHEN 'correlation' THEN v BETWEEN 0.8 AND 1 ELSE sig = 0 OR abs(v - med) <= 5 * sig END AS ok FROM u JOIN s USING (tod_id, key))
SELECT tod_id, det_uid, count(*) FILTER (WHERE NOT ok) AS n_failed, bool_and(ok) AS live FROM o GROUP BY 1, 2""")
def _(spark, d):
    return season.criteria_selection(_long(spark, d), KEYS, {"rms": {"sigmas": 5.0}, "gain": {"absolute": (0.5, 1.5), "sigmas": 3.0}, "correlation": {"absolute": (0.8, 1.0)}})


@query("excess_partial", f"WITH {_P}, c AS (SELECT pa, det_uid, avg(CASE WHEN coalesce(live, false) THEN 0 ELSE 1 END) AS fraction FROM p GROUP BY 1, 2) SELECT pa, det_uid, round(fraction, 6) AS fraction, fraction <= 0.2 AS kept FROM c")
def _(spark, d):
    return season.excess_partial(_patho(spark, d), ["pa", "det_uid"], F.coalesce("live", F.lit(False)), 0.2).withColumn("fraction", r6("fraction"))


@query("stable_detectors", f"WITH {_P}, g AS (SELECT * FROM p WHERE isfinite(gain)), m AS (SELECT tod_id, median(gain) AS m FROM g WHERE live GROUP BY 1) SELECT tod_id, det_uid, coalesce(gain / CASE WHEN m <> 0 THEN m END > 0.8 AND gain / CASE WHEN m <> 0 THEN m END < 1.2, false) AS stable FROM g LEFT JOIN m USING (tod_id)")
def _(spark, d):
    g = _patho(spark, d).where("gain is not null and not isnan(gain) and abs(gain) < double('inf')")
    return season.stable(g, ["tod_id"], "gain", F.col("live")).select("tod_id", "det_uid", "stable")


@query("beam_summary", """WITH b AS (SELECT l_returnflag AS g, l_quantity AS fwhm, l_quantity + l_tax * 10 AS a, l_quantity - l_discount * 10 AS c, l_suppkey % 180 AS ang FROM lineitem),
s AS (SELECT g, count(*) AS n, avg(fwhm) AS f, stddev_pop(fwhm) AS sd, avg((a + c) / 2) AS m, avg((a - c) / 2 * cos(radians(2 * ang))) AS q, avg((a - c) / 2 * sin(radians(2 * ang))) AS u FROM b GROUP BY g)
SELECT g, n, round(f, 6) AS fwhm, round(sd, 6) AS fwhm_std, round(m + sqrt(q*q + u*u), 6) AS maj, round(m - sqrt(q*q + u*u), 6) AS min, round(degrees(atan2(u, q)) / 2, 4) AS angle FROM s""")
def _(spark, d):
    q = F.col("l_quantity")
    b = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), q.alias("fwhm"), (q + F.col("l_tax") * 10).alias("fwhm_maj"), (q - F.col("l_discount") * 10).alias("fwhm_min"), (F.col("l_suppkey") % 180).alias("fwhm_ang"))
    return season.beam_summary(b, ["g"]).select("g", "n", *[r6(c).alias(c) for c in ("fwhm", "fwhm_std", "maj", "min")], F.round("angle", 4).alias("angle"))


_MODELS = [("pa4", "f150", 1104500000.0, 1106000000.0, 0.3, 0.2), ("pa4", "f150", 1106000000.0, 1120000000.0, 0.4, 0.1), ("pa5", "f090", 1104500000.0, 1120000000.0, 0.5, 0.15), ("pa6", "f150", 1104500000.0, 1109000000.0, 0.2, 0.3)]
_MVAL = ", ".join(repr(m) for m in _MODELS)


@query("absolute_calibration", f"""WITH m(pa, band, t_lo, t_hi, b, m) AS (VALUES {_MVAL}), t AS (SELECT basename AS tod_id, pa, ctime, coalesce(pwv, -1) AS loading FROM {TODS} WHERE malf IS NULL),
r AS (SELECT tod_id, freq_code AS band, 1 + count(*) / 1000.0::DOUBLE AS cal FROM (SELECT DISTINCT fit_id, trim(tod_name) AS tod_id, freq_code FROM fit_planet_cal WHERE freq_code IS NOT NULL AND tod_name IS NOT NULL) GROUP BY 1, 2)
SELECT t.tod_id, m.band, round(1e6 * exp(-(b + m.m * CASE WHEN loading < 0 THEN 1.5 ELSE loading END)) * coalesce(r.cal, 1), 3) AS cal FROM t JOIN m ON t.pa = m.pa AND ctime >= t_lo AND ctime < t_hi LEFT JOIN r ON r.tod_id = t.tod_id AND r.band = m.band""".replace(f"{TODS} WHERE malf IS NULL", f"{TODS} WHERE basename NOT IN (SELECT basename FROM tod_info WHERE malfunction IS NOT NULL)"))
def _(spark, d):
    t = _tods(spark, d).select(F.col("basename").alias("tod_id"), "pa", "ctime", F.coalesce("pwv", F.lit(-1.0)).alias("loading"))
    bad = load(spark, d, "tod_info").where("malfunction is not null").select(F.col("basename").alias("tod_id"))
    models = spark.createDataFrame(_MODELS, "pa string, band string, t_lo double, t_hi double, b double, m double")
    f = load(spark, d, "fit_planet_cal").where("freq_code is not null and tod_name is not null").select("fit_id", F.trim("tod_name").alias("tod_id"), F.col("freq_code").alias("band")).distinct()
    recal = f.groupBy("tod_id", "band").agg((1 + F.count("*") / 1000).alias("cal"))
    return season.absolute_calibration(t, models, bad, [recal]).select("tod_id", "band", F.round("cal", 3).alias("cal"))


@query("band_noise", """WITH q AS (SELECT l_suppkey AS det, l_quantity AS f, l_extendedprice / 1000 AS s FROM lineitem), b AS (SELECT det, CASE WHEN f >= 1 AND f < 10 THEN 0 WHEN f >= 10 AND f < 30 THEN 1 WHEN f >= 30 AND f < 50 THEN 2 END AS band, sqrt(avg(s * s)) AS n FROM q GROUP BY 1, 2)
SELECT det, CAST(band AS INTEGER) AS band, round(n * abs(coalesce(s_acctbal, 0)) / 1000, 4) AS noise FROM b LEFT JOIN supplier ON s_suppkey = det WHERE band IS NOT NULL AND det IN (SELECT det FROM b WHERE band = 0 AND n > 0)""")
def _(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("det"), F.col("l_quantity").alias("f"), (F.col("l_extendedprice") / 1000).alias("spec"))
    cal = load(spark, d, "supplier").select(F.col("s_suppkey").alias("det"), F.col("s_acctbal").alias("cal"))
    return season.band_noise(q, ["det"], [(1.0, 10.0), (10.0, 30.0), (30.0, 50.0)], cal).select("det", "band", F.round(F.col("noise") / 1000, 4).alias("noise"))


@query("destriped", f"""WITH {S}, i AS (SELECT *, cos(samp / 8.0) > 0.7 AS ins FROM s), g AS (SELECT *, sum(CASE WHEN ins AND NOT coalesce(pi, false) THEN 1 ELSE 0 END) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, lag(ins) OVER (PARTITION BY tod_id, det_uid ORDER BY samp) AS pi FROM i)),
f AS (SELECT tod_id, det_uid, seg, regr_slope(x, samp::DOUBLE) AS k, regr_intercept(x, samp::DOUBLE) AS c FROM g WHERE NOT ins GROUP BY 1, 2, 3 HAVING count(*) >= 4)
SELECT g.tod_id, g.det_uid, g.samp, round(x - c - k * samp, 2) AS x FROM g JOIN f USING (tod_id, det_uid, seg) WHERE ins""")
def _(spark, d):
    return season.destriped(stream(spark, d), KEYS, "samp", "x", F.cos(F.col("samp") / 8.0) > 0.7).select(*KEYS, "samp", F.round("x", 2).alias("x"))


_FRAC = f"{R}, {A}, {_CL}, {merged_sql('cl', 'm')}, fr AS (SELECT a.tod_id, a.det_uid, coalesce(sum(m.stop - m.start) / max(a.nsamps)::DOUBLE, 0) AS fraction FROM a LEFT JOIN m USING (tod_id, det_uid) GROUP BY 1, 2)"


def _fractions(spark, d):
    ax = axis(spark, d)
    return intervals.cut_fraction(intervals.merge_ranges(intervals.clamp(cut_ranges(spark, d), ax, KEYS), KEYS), ax, KEYS)


@query("report_rows", f"""WITH {_P}, {_FRAC}, g AS (SELECT tod_id, count(*) FILTER (WHERE live) AS live_dets, count(*) FILTER (WHERE NOT live) AS dark_dets, median(CASE WHEN live AND isfinite(gain) THEN gain END) AS gm, stddev_pop(CASE WHEN live AND isfinite(gain) THEN gain END) AS gs, count(CASE WHEN live AND isfinite(gain) THEN 1 END) AS gn FROM p GROUP BY 1),
c AS (SELECT tod_id, avg(fraction) AS cf FROM fr GROUP BY 1) SELECT tod_id, live_dets, dark_dets, round(gm, 6) AS gain_median, round(gs, 6) AS gain_std, gn AS gain_n, round(cf, 6) AS cut_fraction FROM g LEFT JOIN c USING (tod_id)""")
def _(spark, d):
    got = season.report_rows(_patho(spark, d), _fractions(spark, d), ["gain"])
    return got.select("tod_id", "live_dets", "dark_dets", r6("gain_median").alias("gain_median"), r6("gain_std").alias("gain_std"), "gain_n", r6("cut_fraction").alias("cut_fraction"))


@query("pointing_offset", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_tax ELSE l_tax END), 6) + 0.0 AS dx, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_discount ELSE l_discount END), 6) + 0.0 AS dy FROM lineitem GROUP BY 1")
def _(spark, d):
    b = load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "source_offset").otherwise("x").alias("kind"), F.col("l_tax").alias("dx"), F.col("l_discount").alias("dy"))
    return season.pointing_offset(b, ["l_orderkey"]).select("l_orderkey", (r6("dx") + 0.0).alias("dx"), (r6("dy") + 0.0).alias("dy"))


@query("focal_plane", """WITH p AS (SELECT det_uid, min(sky_x) AS x, min(sky_y) AS y, min(radians(sky_angle)) AS phi, bool_and(sky_angle IS NOT NULL) AS ok FROM array_data WHERE det_uid IS NOT NULL AND sky_x IS NOT NULL AND sky_y IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT det AS det_uid FROM cuts WHERE det IS NOT NULL)
SELECT det_uid, round(coalesce(x + 0.1, 0), 6) AS x, round(coalesce(y - 0.2, 0), 6) AS y, round(coalesce(phi, 0), 6) AS phi, x IS NOT NULL AND coalesce(ok, false) AS mask FROM r LEFT JOIN p USING (det_uid)""")
def _(spark, d):
    a = load(spark, d, "array_data").where("det_uid is not null and sky_x is not null and sky_y is not null").groupBy("det_uid").agg(F.min("sky_x").alias("x"), F.min("sky_y").alias("y"), F.min(F.radians("sky_angle")).alias("phi"), F.every(F.col("sky_angle").isNotNull()).alias("ok"))
    req = load(spark, d, "cuts").where("det is not null").select(F.col("det").alias("det_uid")).distinct()
    got = season.focal_plane(a.select("det_uid", "x", "y"), a.select("det_uid", "phi", "ok"), (0.1, -0.2), req)
    return got.select("det_uid", r6("x").alias("x"), r6("y").alias("y"), r6("phi").alias("phi"), "mask")


@query("whole_cuts", f"WITH {A}, {_P} SELECT a.tod_id, a.det_uid, 0 AS start, nsamps AS stop FROM a LEFT JOIN p USING (tod_id, det_uid) WHERE NOT coalesce(live, false)")
def _(spark, d):
    dets = axis(spark, d).join(_patho(spark, d).select(*KEYS, "live"), KEYS, "left")
    return season.whole_cuts(dets, KEYS, F.col("live"))


@query("tod_list_summary", r"""WITH f AS (SELECT DISTINCT fit_id, regexp_replace(lower(regexp_replace(trim(tod_name), '^.*/', '')), '\.zip$', '') AS k FROM fit_planet_cal WHERE tod_name IS NOT NULL), t AS (SELECT DISTINCT basename AS k, pa, obs_type FROM tod_info)
SELECT coalesce(pa, 'none') AS pa, count(*) AS n, count(*) FILTER (WHERE obs_type = 'planet') AS n_planet, count(*) FILTER (WHERE pa IS NULL) AS n_missing FROM f LEFT JOIN t USING (k) GROUP BY 1""")
def _(spark, d):
    f = load(spark, d, "fit_planet_cal").where("tod_name is not null").select("fit_id", tod_key(F.col("tod_name")).alias("k")).distinct()
    t = load(spark, d, "tod_info").select(F.col("basename").alias("k"), "pa", "obs_type").distinct()
    return f.join(t, "k", "left").groupBy(F.coalesce("pa", F.lit("none")).alias("pa")).agg(F.count("*").alias("n"), F.count_if(F.col("obs_type") == "planet").alias("n_planet"), F.count_if(F.col("pa").isNull()).alias("n_missing"))


@query("season_matrix", f"WITH {_LONG} SELECT tod_id, det_uid, max(CASE WHEN key = 'rms' THEN v END) AS rms, max(CASE WHEN key = 'gain' THEN v END) AS gain, max(CASE WHEN key = 'correlation' THEN v END) AS correlation FROM u GROUP BY 1, 2")
def _(spark, d):
    return season.criteria_matrix(_long(spark, d), KEYS, "key", ["rms", "gain", "correlation"])
