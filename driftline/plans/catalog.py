"""Queries on catalogues: selection, lists, lookups, scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import angles, physics, text, time
from driftline.functions.names import tod_key
from driftline.operators import joins, lists, select
from driftline.tables import load

r6 = lambda c: F.round(c, 6)


def _tods(spark: SparkSession, d: str) -> DataFrame:
    """One row per observation: the first listing of each."""
    return load(spark, d, "tod_info").groupBy("basename").agg(*[F.min(c).alias(c) for c in ("pa", "ctime", "merged_ctime", "mean_alt", "min_az", "max_az", "scan_speed", "pwv", "min_dec", "max_dec", "min_ra_south", "obs_type", "obs_detail", "obs_drift", "ctime_start", "ctime_end", "datafile_id")])


TODS = "(SELECT basename, " + ", ".join(f"min({c}) AS {c}" for c in ("pa", "ctime", "merged_ctime", "mean_alt", "min_az", "max_az", "scan_speed", "pwv", "min_dec", "max_dec", "min_ra_south", "obs_type", "obs_detail", "obs_drift", "ctime_start", "ctime_end", "datafile_id")) + " FROM tod_info GROUP BY basename)"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("sel_outer", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11','Brand#22','Brand#33') AND p_size IN (1,5,10,15,20)")
def _(spark, d):
    return select.select_outer(load(spark, d, "part"), {"p_brand": ["Brand#11", "Brand#22", "Brand#33"], "p_size": [1, 5, 10, 15, 20]}, ["p_partkey", "p_brand", "p_size"])


@query("sel_tods", f"SELECT basename, ctime, pa FROM {TODS} WHERE pa = 'pa5' AND obs_type IN ('scan','planet') AND mean_alt >= 35 AND mean_alt < 50 AND obs_detail IS NOT NULL")
def _(spark, d):
    got = select.select_outer(_tods(spark, d), {"pa": "pa5", "obs_type": ["scan", "planet"], "mean_alt": (35.0, 50.0)}, ordered=["ctime"])
    return got.where("obs_detail is not null").select("basename", "ctime", "pa")


@query("sel_null_or_list", f"SELECT basename FROM {TODS} WHERE obs_drift IS NULL OR obs_drift IN ('rising')")
def _(spark, d):
    return select.select_outer(_tods(spark, d), {"obs_drift": ["rising", None]}, ["basename"])


@query("sel_modular_range", f"SELECT basename, round((ctime / 3600.0) % 24, 6) AS hour FROM {TODS} WHERE (((ctime / 3600.0) - 22) % 24 + 24) % 24 + 22 < 28")
def _(spark, d):
    t = _tods(spark, d).withColumn("hour", F.col("ctime") / 3600.0)
    return select.select_outer(t, {"hour": (22.0, 28.0, 24.0)}).select("basename", r6(F.pmod("hour", F.lit(24.0))).alias("hour"))


@query("sel_inner_order", """WITH req AS (SELECT c_custkey AS ord, c_nationkey AS s_nationkey FROM customer),
f AS (SELECT s_nationkey, min(s_suppkey) AS i FROM supplier GROUP BY s_nationkey)
SELECT ord, coalesce(i, -1) AS s_suppkey, i IS NOT NULL AS found FROM req LEFT JOIN f USING (s_nationkey)""")
def _(spark, d):
    req = load(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("s_nationkey"))
    return select.select_inner(load(spark, d, "supplier"), req, ["s_nationkey"], "s_suppkey")


_SURVIVE = f"""WITH t AS (SELECT * FROM {TODS})
SELECT 0 AS rule, 'obs_type' AS key, count(*) FILTER (WHERE obs_type IN ('scan','planet')) AS n FROM t
UNION ALL SELECT 1, 'pwv', count(*) FILTER (WHERE obs_type IN ('scan','planet') AND pwv >= 0 AND pwv < 1) FROM t
UNION ALL SELECT 2, 'ctime', count(*) FILTER (WHERE obs_type IN ('scan','planet') AND pwv >= 0 AND pwv < 1 AND ctime % 86400 < 43200) FROM t"""


@query("sel_rule_survivors", _SURVIVE)
def _(spark, d):
    return select.rule_survivors(_tods(spark, d), [("obs_type", ["scan", "planet"]), ("pwv", (0.0, 1.0)), ("ctime", (0, 43200, 86400))])


@query("sel_strict", "SELECT fit_id FROM (SELECT DISTINCT * FROM fit_planet_cal) WHERE amp > 50 AND amp < 150")
def _(spark, d):
    return select.strictly_between(load(spark, d, "fit_planet_cal").distinct(), {"amp": (50.0, 150.0)}).select("fit_id")


_MEDSIG = """SELECT {k}, max(CASE WHEN i = n // 2 THEN v END) AS med, 0.741 * (max(CASE WHEN i = 3 * n // 4 THEN v END) - max(CASE WHEN i = n // 4 THEN v END)) AS sig
FROM (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t} WHERE {v} IS NOT NULL) GROUP BY {k}"""


@query("sel_sigma", f"""WITH t AS (SELECT * FROM part), s AS ({_MEDSIG.format(k='p_brand', v='p_retailprice', t='part')})
SELECT p_brand, count(*) FILTER (WHERE sig = 0 OR abs(p_retailprice - med) <= 1.0 * sig) AS n FROM t JOIN s USING (p_brand) GROUP BY p_brand""")
def _(spark, d):
    got = select.select_by_sigma(load(spark, d, "part"), ["p_brand"], "p_retailprice", 1.0)
    return got.groupBy("p_brand").agg(F.count_if("selected").alias("n"))


@query("sel_limit_mask", """WITH m AS (SELECT c_mktsegment, median(CASE WHEN c_acctbal <> 0 THEN c_acctbal END) AS m, max(c_acctbal) AS x FROM customer GROUP BY 1)
SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal <= least(3 * m, x + 0.2 * m)) AS n FROM customer JOIN m USING (c_mktsegment) GROUP BY 1""")
def _(spark, d):
    return select.limit_mask(load(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").groupBy("c_mktsegment").agg(F.count_if("kept").alias("n"))


@query("sel_group_masks", f"""WITH t AS (SELECT * FROM {TODS}) SELECT a.pa, b.obs_type, count(t.basename) AS n FROM (SELECT DISTINCT pa FROM t) a CROSS JOIN (SELECT DISTINCT obs_type FROM t) b
LEFT JOIN t ON t.pa = a.pa AND t.obs_type = b.obs_type GROUP BY 1, 2""")
def _(spark, d):
    return select.group_masks(_tods(spark, d), ["pa", "obs_type"])


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    a = load(spark, d, "flatfield").dropDuplicates(["ff_id"]).where("tod_name is not null").select(F.col("ff_id").alias("ord"), F.trim("tod_name").alias("name"))
    b = load(spark, d, "fit_planet_cal").dropDuplicates(["fit_id"]).where("tod_name is not null").select(F.col("fit_id").alias("ord"), F.trim("tod_name").alias("name"))
    return a, b


_LISTS = r"""a AS (SELECT DISTINCT ff_id AS ord, trim(tod_name) AS name, regexp_replace(regexp_replace(trim(tod_name), '^.*/', ''), '\.zip$', '') AS key FROM flatfield WHERE tod_name IS NOT NULL),
b AS (SELECT DISTINCT fit_id AS ord, trim(tod_name) AS name, regexp_replace(regexp_replace(trim(tod_name), '^.*/', ''), '\.zip$', '') AS key FROM fit_planet_cal WHERE tod_name IS NOT NULL)"""


@query("list_union", f"WITH {_LISTS} SELECT 0 AS side, ord, name FROM a UNION ALL SELECT 1, ord, name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = b.key)")
def _(spark, d):
    return lists.list_union(*_lists(spark, d))


@query("list_minus", f"""WITH {_LISTS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM a), m AS (SELECT key, count(*) AS m FROM b GROUP BY key)
SELECT ord, name FROM l LEFT JOIN m USING (key) WHERE m IS NULL OR n > m""")
def _(spark, d):
    return lists.list_minus(*_lists(spark, d))


@query("list_intersect", f"WITH {_LISTS}, f AS (SELECT key, arg_min(name, ord) AS name FROM a GROUP BY key) SELECT b.ord, f.name FROM b JOIN f USING (key)")
def _(spark, d):
    return lists.list_intersect(*_lists(spark, d))


@query("dedup_first", "SELECT tod_id, det_uid, received FROM pathologies QUALIFY row_number() OVER (PARTITION BY tod_id, det_uid ORDER BY received) = 1")
def _(spark, d):
    return select.first_of(load(spark, d, "pathologies"), ["tod_id", "det_uid"], ["received"]).select("tod_id", "det_uid", "received")


@query("dedup_names", "SELECT item, min(doc_id) AS doc_id FROM documents WHERE item IS NOT NULL GROUP BY item")
def _(spark, d):
    return lists.dedup_first(load(spark, d, "documents").where("item is not null"), "item", "doc_id").select("item", "doc_id")


@query("merge_missing", "SELECT s_suppkey AS id, s_nationkey AS nat FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nat"))
    b = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nat"))
    return lists.merge_missing(a, b, "id")


@query("match_first", "SELECT c_custkey AS i, other FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS other FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def _(spark, d):
    a = load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"))
    return lists.match_first(a, load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i")), "k", "i")


@query("split_list", "SELECT doc_id - 1 AS ord, CAST((doc_id - 1) // CAST(ceil((SELECT count(*) FROM documents) / 7.0) AS BIGINT) AS INTEGER) AS part FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents").select((F.col("doc_id") - 1).alias("ord"))
    return lists.split_list(docs, 7, docs.count())


@query("job_ranges", "WITH n AS (SELECT count(*) AS n FROM documents), j AS (SELECT unnest(range(5)) AS job), r AS (SELECT job, job * n // 5 AS a, (job + 1) * n // 5 AS b FROM j, n) SELECT doc_id - 1 AS ord, CAST(job AS INTEGER) AS job FROM documents JOIN r ON doc_id - 1 >= a AND doc_id - 1 < b")
def _(spark, d):
    docs = load(spark, d, "documents").select((F.col("doc_id") - 1).alias("ord"))
    return lists.job_of(docs, docs.count(), 5)


@query("names_parsed", r"""SELECT fit_id, regexp_replace(regexp_replace(trim(tod_name), '^.*/', ''), '\.zip$', '') AS base,
regexp_matches(regexp_replace(regexp_replace(trim(tod_name), '^.*/', ''), '\.zip$', ''), '^[0-9]{10}\.[0-9]{10}\.ar.$') AS ok,
CASE WHEN split_part(regexp_replace(lower(regexp_replace(trim(tod_name), '^.*/', '')), '\.zip$', ''), '.', 3) = '' THEN 'ar1' ELSE split_part(regexp_replace(lower(regexp_replace(trim(tod_name), '^.*/', '')), '\.zip$', ''), '.', 3) END AS arr, freq_code AS freq
FROM (SELECT DISTINCT fit_id, tod_name, freq_code FROM fit_planet_cal WHERE tod_name IS NOT NULL)""")
def _(spark, d):
    t = load(spark, d, "fit_planet_cal").select("fit_id", "tod_name", "freq_code").distinct().where("tod_name is not null")
    base = text.basename(F.trim("tod_name"))
    return t.select("fit_id", base.alias("base"), text.is_tod_id(base).alias("ok"), text.array_of(tod_key(F.col("tod_name"))).alias("arr"), text.frequency_of(F.concat(F.lit("a_"), "freq_code", F.lit("_b"))).alias("freq"))


@query("times", f"""SELECT basename, strftime(to_timestamp(ctime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS txt, ctime AS back, round(ctime / 86400.0 + 40587.0, 6) AS mjd, round(ctime, 3)::DOUBLE AS back2,
CAST(floor((ctime - 949381200) / 31557600.0 + 2000) AS INTEGER) AS season, strftime(to_timestamp(ctime) AT TIME ZONE 'UTC', '%Y-%m-%d') AS night, substr(basename, 1, 5) AS code FROM {TODS}""")
def _(spark, d):
    t = _tods(spark, d)
    c = F.col("ctime")
    return t.select("basename", time.ctime_text(c).alias("txt"), time.text_ctime(time.ctime_text(c)).alias("back"), r6(time.ctime_mjd(c)).alias("mjd"), F.round(time.mjd_ctime(time.ctime_mjd(c)), 3).alias("back2"), time.season(c).alias("season"), time.night_name(c).alias("night"), time.first_five(F.col("basename")).alias("code"))


@query("angles", f"""SELECT basename, round((((min_ra_south + 180) % 360) + 360) % 360 - 180, 6) AS ra, round(((min_az - 90) % 360 + 360) % 360 + 90, 6) < 210 AS east,
printf('%s%02d:%02d:%02d.%02d', CASE WHEN min_dec < 0 AND u > 0 THEN '-' ELSE '' END, u // 360000, u // 6000 % 60, u // 100 % 60, u % 100) AS dec_text, round((CASE WHEN min_dec < 0 THEN -1 ELSE 1 END) * u / 360000.0, 6) AS dec_back
FROM (SELECT *, CAST(round(abs(min_dec) * 3600 * 100) AS BIGINT) AS u FROM {TODS} WHERE min_dec IS NOT NULL AND min_ra_south IS NOT NULL AND min_az IS NOT NULL)""")
def _(spark, d):
    t = _tods(spark, d).where("min_dec is not null and min_ra_south is not null and min_az is not null")
    dec = angles.format_sexagesimal(F.col("min_dec"))
    return t.select("basename", r6(angles.rerange(F.col("min_ra_south"), -180.0, 360.0)).alias("ra"), angles.is_within(F.col("min_az"), 90.0, 210.0, 360.0).alias("east"), dec.alias("dec_text"), r6(angles.parse_sexagesimal(dec)).alias("dec_back"))


@query("galactic", f"""WITH t AS (SELECT basename, radians(min_ra_south) AS a, radians(min_dec) AS d FROM {TODS} WHERE min_dec IS NOT NULL AND min_ra_south IS NOT NULL),
k AS (SELECT *, radians(192.859508) AS ap, radians(27.128336) AS dp, radians(122.932) AS ln FROM t)
SELECT basename, round(degrees(asin(sin(dp) * sin(d) + cos(dp) * cos(d) * cos(a - ap))), 5) AS b,
round((degrees(ln - atan2(cos(d) * sin(a - ap), cos(dp) * sin(d) - sin(dp) * cos(d) * cos(a - ap))) + 720) % 360, 5) AS l FROM k""")
def _(spark, d):
    t = _tods(spark, d).where("min_dec is not null and min_ra_south is not null")
    lon, lat = angles.galactic(F.radians("min_ra_south"), F.radians("min_dec"))
    return t.select("basename", F.round(F.degrees(lat), 5).alias("b"), F.round(F.degrees(lon), 5).alias("l"))


@query("quaternions", """WITH t AS (SELECT DISTINCT pa, det_uid, radians(array_angle) AS g, sky_x AS x, sky_y AS y FROM array_data WHERE array_angle IS NOT NULL)
SELECT pa, det_uid, round(x * cos(g) - y * sin(g), 6) AS u, round(x * sin(g) + y * cos(g), 6) AS v, 1.0::DOUBLE AS norm FROM t""")
def _(spark, d):
    t = load(spark, d, "array_data").select("pa", "det_uid", "array_angle", "sky_x", "sky_y").distinct().where("array_angle is not null")
    q = angles.q_axis(3, F.radians("array_angle"))
    u, v, _w = angles.q_rotate(q, (F.col("sky_x"), F.col("sky_y"), F.lit(0.0)))
    return t.select("pa", "det_uid", r6(u).alias("u"), r6(v).alias("v"), r6(angles.q_norm(q)).alias("norm"))


_X = "(6.62607015e-34 * nu / (1.380649e-23 * 2.725))"


@query("radiometry", f"""WITH t AS (SELECT DISTINCT nom_freq, nom_freq * 1e9 AS nu FROM array_data WHERE nom_freq > 0)
SELECT nom_freq, round(pow(exp({_X}) - 1, 2) / (pow({_X}, 2) * exp({_X})), 6) AS rj_cmb, 2.725::DOUBLE AS t_back,
round(2 * 6.62607015e-34 * pow(nu, 3) / pow(299792458.0, 2) / (exp({_X}) - 1) * 1e18, 6) AS b, round(2 * pow(nu, 2) * 1.380649e-23 * 10 / pow(299792458.0, 2) * 1e15, 6) AS rj, 10.0::DOUBLE AS rj_back FROM t""")
def _(spark, d):
    t = load(spark, d, "array_data").select("nom_freq").distinct().where("nom_freq > 0").withColumn("nu", F.col("nom_freq") * 1e9)
    nu = F.col("nu")
    b = physics.blackbody(nu, F.lit(2.725))
    rj = physics.rayleigh_jeans(nu, F.lit(10.0))
    return t.select("nom_freq", r6(physics.rj_to_cmb(nu)).alias("rj_cmb"), r6(physics.brightness_temperature(nu, b)).alias("t_back"), r6(b * 1e18).alias("b"), r6(rj * 1e15).alias("rj"), r6(physics.rj_temperature(nu, rj)).alias("rj_back"))


@query("filter_gains", """WITH f AS (SELECT DISTINCT samp, samp / 8.0 AS f FROM samples WHERE samp IS NOT NULL)
SELECT samp, round(CASE WHEN f < 4.5 THEN 1 WHEN f > 5.5 THEN 0 ELSE pow(sin(pi() / 2 * (1 - (f - 4.5) / 1.0)), 2) END, 6) AS low, round(CASE WHEN f < 0.75 THEN 0 WHEN f > 1.25 THEN 1 ELSE pow(sin(pi() / 2 * (f - 0.75) / 0.5), 2) END, 6) AS high,
round(1 / sqrt(1 + pow(f / 10, 8)), 6) AS butter, round(CASE WHEN f = 0 THEN 0 ELSE 1 / sqrt(1 + pow(2.0 / f, 4)) END, 6) AS butter_high, round(exp(-pow(f - 20, 2) / 18), 6) AS band,
round(1 / sqrt(1 + pow(2 * pi() * f * 0.002, 2)), 6) AS rc, round(1 + pow(1.0 / CASE WHEN f = 0 THEN 1.0 ELSE f END, 2), 6) AS noise,
round(CASE WHEN f = 0 THEN 1 ELSE pow(1.0 / f, 2) / (1 + pow(1.0 / f, 2)) END, 6) AS wiener FROM (SELECT samp, f FROM f) f""")
def _(spark, d):
    t = load(spark, d, "samples").select("samp").distinct().where("samp is not null").withColumn("f", F.col("samp") / 8.0)
    f = F.col("f")
    return t.select("samp", r6(physics.low_pass_sine2_half(f, 5.0, 0.5)).alias("low"), r6(physics.high_pass_sine2(f, 1.0, 0.5)).alias("high"), r6(physics.butterworth_low(f, 10.0, 4)).alias("butter"), r6(physics.butterworth_high(f, 2.0, 2)).alias("butter_high"), r6(physics.gaussian_band(f, 20.0, 3.0)).alias("band"), r6(physics.rc_gain(f, 0.002)).alias("rc"), r6(physics.power_law(f, 1.0, 2.0)).alias("noise"), r6(physics.wiener_low(f, 1.0, 2.0)).alias("wiener"))


@query("beams", f"""WITH t AS (SELECT DISTINCT pa, det_uid, sky_x AS x, sky_y AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL)
SELECT pa, det_uid, round(exp(-4 * ln(2) * (x * x + y * y) / 2.25), 6) AS gauss, round(sqrt(pow(x * cos(0.3) + y * sin(0.3), 2) / 4 + pow(-x * sin(0.3) + y * cos(0.3), 2)), 6) AS r, round(2 * {math.pi!r} * 0.01 * 4, 6) AS wing FROM t""")
def _(spark, d):
    t = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null").select("pa", "det_uid", F.col("sky_x").alias("x"), F.col("sky_y").alias("y")).distinct()
    x, y = F.col("x"), F.col("y")
    return t.select("pa", "det_uid", r6(physics.gaussian_beam(F.sqrt(x * x + y * y), 1.5)).alias("gauss"), r6(physics.elliptical_radius(x, y, 2.0, 1.0, 0.3)).alias("r"), r6(physics.wing_solid_angle(F.lit(0.01), F.lit(2.0))).alias("wing"))


@query("airy", """WITH RECURSIVE t AS (SELECT DISTINCT pa, det_uid, sqrt(sky_x * sky_x + sky_y * sky_y) * 3 AS r FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL),
j AS (SELECT pa, det_uid, r, 0 AS k, r / 2 AS term, r / 2 AS total FROM t UNION ALL SELECT pa, det_uid, r, k + 1, -term * r * r / 4 / ((k + 1) * (k + 2)), total - term * r * r / 4 / ((k + 1) * (k + 2)) FROM j WHERE k < 40)
SELECT pa, det_uid, round(CASE WHEN r < 1e-9 THEN 1 ELSE pow(2 * total / r, 2) END, 6) AS airy FROM j WHERE k = 40""")
def _(spark, d):
    t = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null").select("pa", "det_uid", (F.sqrt(F.col("sky_x") ** 2 + F.col("sky_y") ** 2) * 3).alias("r")).distinct()
    return t.select("pa", "det_uid", r6(physics.airy_beam(F.col("r"))).alias("airy"))


@query("bit_fields", "SELECT DISTINCT datafile_id AS w, CAST((CAST(datafile_id * 65537 % 2147483648 AS BIGINT) >> 7) * 8 AS INTEGER) AS sig, CAST((CAST(datafile_id * 65537 % 2147483648 AS BIGINT) >> 4) & 255 AS INTEGER) AS mid FROM tod_info WHERE datafile_id IS NOT NULL")
def _(spark, d):
    t = load(spark, d, "tod_info").where("datafile_id is not null").select(F.col("datafile_id").alias("w")).distinct().withColumn("x", (F.col("w") * 65537 % 2147483648).cast("int"))
    return t.select("w", text.mode10_signal(F.col("x")).alias("sig"), text.bit_field(F.col("x"), 4, 8, signed=False).alias("mid"))


@query("regular_sizes", """WITH n AS (SELECT DISTINCT nsamps AS n FROM cuts WHERE nsamps IS NOT NULL), p AS (SELECT a.e * b.e * c.e * f.e * g.e * h.e AS m FROM
(SELECT pow(2, unnest(range(18))) AS e) a, (SELECT pow(3, unnest(range(11))) AS e) b, (SELECT pow(5, unnest(range(8))) AS e) c,
(SELECT pow(7, unnest(range(6))) AS e) f, (SELECT pow(11, unnest(range(5))) AS e) g, (SELECT pow(13, unnest(range(5))) AS e) h WHERE a.e * b.e * c.e * f.e * g.e * h.e < 200000)
SELECT n AS nsamps, CAST(min(m) AS BIGINT) AS size FROM n JOIN p ON m >= n GROUP BY n""")
def _(spark, d):
    t = load(spark, d, "cuts").where("nsamps is not null").select("nsamps").distinct()
    return t.select("nsamps", physics.next_regular(F.col("nsamps")).alias("size"))


@query("lookup_default", "WITH a AS (SELECT pa, det_uid, any_value(optical_sign) AS s FROM array_data GROUP BY pa, det_uid) SELECT ff_id, coalesce(s, 0.0) AS optical_sign, a.pa IS NOT NULL AS found FROM (SELECT DISTINCT ff_id, pa, det_uid FROM flatfield) f LEFT JOIN a ON a.pa = f.pa AND a.det_uid = f.det_uid")
def _(spark, d):
    ff = load(spark, d, "flatfield").select("ff_id", "pa", "det_uid").distinct()
    return joins.lookup(ff, load(spark, d, "array_data"), ["pa", "det_uid"], {"optical_sign": 0.0}).select("ff_id", "optical_sign", "found")


@query("catalog_metadata", f"""SELECT DISTINCT tod_id, round(least(mean_alt, 61), 6) AS alt, CASE WHEN scan_speed IS NULL OR scan_speed < 0 THEN 1.5 ELSE scan_speed END AS speed FROM cuts JOIN {TODS} t ON t.basename = cuts.tod_id""")
def _(spark, d):
    t = _tods(spark, d).withColumnRenamed("basename", "tod_id")
    got = load(spark, d, "cuts").select("tod_id").distinct().join(t, "tod_id")
    return got.select("tod_id", r6(F.least("mean_alt", F.lit(61.0))).alias("alt"), F.when(F.col("scan_speed").isNull() | (F.col("scan_speed") < 0), 1.5).otherwise(F.col("scan_speed")).alias("speed"))


_NEAR = f"""WITH q AS (SELECT basename, pa, ctime::DOUBLE AS t FROM {TODS}), rr AS (SELECT o_orderkey, epoch(o_orderdate) + 347155200 + (o_orderkey % 86400) AS t, o_totalprice AS v FROM orders),
r AS (SELECT t::DOUBLE AS t, max(v) AS v FROM rr GROUP BY 1),
b AS (SELECT q.*, r.t AS bt, r.v AS bv FROM q ASOF LEFT JOIN r ON q.t >= r.t), n AS (SELECT b.*, r.t AS nt, r.v AS nv FROM b ASOF LEFT JOIN r ON b.t <= r.t)"""


def _readings(spark, d):
    return load(spark, d, "orders").select(F.lit("a").alias("ch"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 347155200 + F.col("o_orderkey") % 86400).cast("double").alias("t"), F.col("o_totalprice").alias("v"))


@query("nearest_reading", f"{_NEAR} SELECT basename, round(CASE WHEN bt IS NULL OR nt - t <= t - bt THEN nv ELSE bv END, 6) AS v, round(CASE WHEN bt IS NULL OR nt - t <= t - bt THEN nt - t ELSE bt - t END, 6) AS dt FROM n")
def _(spark, d):
    q = _tods(spark, d).select("basename", F.lit("a").alias("ch"), F.col("ctime").cast("double").alias("t"))
    return joins.nearest_reading(q, _readings(spark, d), ["ch"], "t", "v").select("basename", r6("v").alias("v"), r6("dt").alias("dt"))


@query("nearest_within", f"{_NEAR}, m AS (SELECT basename, CASE WHEN bt IS NULL OR nt - t <= t - bt THEN nv ELSE bv END AS v, CASE WHEN bt IS NULL OR nt - t <= t - bt THEN nt - t ELSE bt - t END AS dt FROM n) SELECT basename, round(CASE WHEN abs(dt) <= 3600 THEN least(v, 200000) ELSE -1 END, 6) AS v FROM m")
def _(spark, d):
    q = _tods(spark, d).select("basename", F.lit("a").alias("ch"), F.col("ctime").cast("double").alias("t"))
    return joins.nearest_within(q, _readings(spark, d), ["ch"], "t", "v", 3600.0, top=200000.0).select("basename", r6("v").alias("v"))


def _intervals(spark):
    return spark.createDataFrame([(0, 1104544000.0, 1105500000.0, "early"), (1, 1105000000.0, 1107000000.0, "mid"), (2, 1107000000.0, 1110000000.0, "late")], "ord int, t0 double, t1 double, tag string")


@query("interval_calibration", f"SELECT basename, CASE WHEN ctime >= 1104544000 AND ctime < 1105500000 THEN 'early' WHEN ctime >= 1105000000 AND ctime < 1107000000 THEN 'mid' WHEN ctime >= 1107000000 AND ctime < 1110000000 THEN 'late' END AS tag FROM {TODS}")
def _(spark, d):
    return joins.interval_lookup(_tods(spark, d).select("basename", "ctime"), _intervals(spark), "ctime", ["tag"]).select("basename", "tag")


@query("sources_in_patch", f"SELECT basename FROM {TODS} WHERE ((min_ra_south - 330) % 360 + 360) % 360 <= 90 AND min_dec BETWEEN -40 AND 10")
def _(spark, d):
    return joins.sources_in_patch(_tods(spark, d), "min_ra_south", "min_dec", (330.0, 60.0), (-40.0, 10.0)).select("basename")


_DETS = "(SELECT DISTINCT pa, det_uid, sky_x AS x, sky_y AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL)"


def _dets(spark, d):
    return load(spark, d, "array_data").where("sky_x is not null and sky_y is not null").select("pa", "det_uid", F.col("sky_x").alias("x"), F.col("sky_y").alias("y")).distinct()


@query("friend_counts", f"SELECT a.pa, a.det_uid, count(b.det_uid) AS n FROM {_DETS} a LEFT JOIN {_DETS} b ON a.pa = b.pa AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) >= 0.01 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.25 GROUP BY 1, 2 HAVING count(b.det_uid) >= 2")
def _(spark, d):
    return joins.within_distance(_dets(spark, d), ["pa"], "det_uid", "x", "y", 0.1, 0.5).where("n >= 2")


@query("node_counts", f"SELECT a.pa, a.det_uid, count(b.det_uid) AS n FROM {_DETS} a LEFT JOIN {_DETS} b ON a.pa = b.pa AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.16 GROUP BY 1, 2 HAVING count(b.det_uid) < 6")
def _(spark, d):
    return joins.within_distance(_dets(spark, d), ["pa"], "det_uid", "x", "y", 0.0, 0.4).where("n < 6")


_SEEK = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^.*[/\\]', '')), '\.zip$', '')"


def _lat(planet: str) -> str:
    """SQL of the sub-observer latitude at t."""
    m, b, c, s, w1, w0, t0, _ = physics.DISC[planet]
    y = f"((t - {t0}) / (86400 * 365.24))"
    return f"{y} * {m!r} + {b!r} + {c!r} * cos(({w1!r} * {y} + {w0!r}) * {y}) + {s!r} * sin(({w1!r} * {y} + {w0!r}) * {y})"


@query("files_overlapping", """WITH f AS (SELECT DISTINCT basename, ctime, 'weather_' || ctime || '_' || (ctime + 900) || '.dat' AS name FROM tod_info WHERE ctime IS NOT NULL), m AS (SELECT avg(ctime) AS t FROM f)
SELECT name, ctime AS start, ctime + 900 AS stop FROM (SELECT DISTINCT name, ctime FROM f) WHERE ctime < 1107800000 AND ctime + 900 > 1107000000""")
def _(spark, d):
    t = load(spark, d, "tod_info").where("ctime is not null").select(F.concat(F.lit("weather_"), "ctime", F.lit("_"), F.col("ctime") + 900, F.lit(".dat")).alias("name")).distinct()
    return joins.files_overlapping(t, 1107000000, 1107800000).select("name", "start", "stop")


@query("seek_ctime", f"""WITH f AS (SELECT DISTINCT fit_id, {_SEEK.format('tod_name')} AS k, ctime FROM fit_planet_cal WHERE tod_name IS NOT NULL AND ctime IS NOT NULL), r AS (SELECT DISTINCT {_SEEK.format('tod_name')} AS k, ctime AS t FROM recal_model WHERE tod_name IS NOT NULL AND ctime IS NOT NULL)
SELECT fit_id, ctime, (SELECT min(t) FROM r WHERE r.k = f.k AND r.t >= f.ctime) AS at FROM f""".replace(" AS at FROM f", ' AS "at" FROM f'))
def _(spark, d):
    k = lambda t: load(spark, d, t).where("tod_name is not null and ctime is not null").withColumn("k", tod_key(F.col("tod_name")))
    return joins.seek(k("fit_planet_cal").select("fit_id", "k", "ctime").distinct(), k("recal_model"), ["k"], "ctime", block=600.0).select("fit_id", "ctime", "at")


@query("disc_corrections", f"""WITH t AS (SELECT DISTINCT basename, ctime + 300000000 AS t FROM tod_info WHERE ctime IS NOT NULL) SELECT basename, {', '.join(f"round(CASE WHEN t BETWEEN 1356998400 AND 1893456000 THEN 1 / sqrt(1 + pow(sin(radians({_lat(p)})), 2) * {v[7]!r}) END, 9) AS {p}" for p, v in physics.DISC.items())} FROM t""")
def _(spark, d):
    t = load(spark, d, "tod_info").where("ctime is not null").select("basename", (F.col("ctime") + 300000000).alias("t")).distinct()
    return t.select("basename", *[F.round(physics.disc_correction(F.col("t"), p), 9).alias(p) for p in physics.DISC])


@query("exploded_bits", "SELECT DISTINCT datafile_id AS w, CAST((1 << CAST(datafile_id % 8 AS INTEGER)) | CASE WHEN datafile_id % 11 < 8 THEN 1 << CAST(datafile_id % 11 AS INTEGER) ELSE 0 END AS INTEGER) AS b0, CAST(CASE WHEN datafile_id % 11 >= 8 THEN 1 << CAST(datafile_id % 11 - 8 AS INTEGER) ELSE 0 END AS INTEGER) AS b1 FROM tod_info WHERE datafile_id IS NOT NULL")
def _(spark, d):
    t = load(spark, d, "tod_info").where("datafile_id is not null").select(F.col("datafile_id").alias("w")).distinct()
    b = text.explode_bits(F.array((F.col("w") % 8).cast("int"), (F.col("w") % 11).cast("int")), 2)
    return t.select("w", b[0].cast("int").alias("b0"), b[1].cast("int").alias("b1"))
