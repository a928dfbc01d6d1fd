"""Queries on the quality of the observation tables: orphans, cut coverage, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import tod_key
from driftline.operators.coverage import periods_and_gaps
from driftline.operators.orphans import current_orphans, fold_counts, listing_deltas, orphan_report, orphans_at
from driftline.operators.spikes import series_outliers, stream_outliers
from driftline.tables import load


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References of flatfield and fit_planet_cal, and the listings they refer to."""
    det = lambda: F.concat_ws("|", F.col("pa"), F.col("det_uid").cast("string"))
    flat = load(spark, d, "flatfield").where("det_uid >= 0 and peak_dac is not null and not isnan(peak_dac) and peak_dac <> 0 and ff_id is not null")
    fits = load(spark, d, "fit_planet_cal").where("tod_name is not null and fit_id is not null")
    refs = flat.select(F.lit("flatfield").alias("tbl"), det().alias("key"), F.col("recorded").alias("at"), F.col("ff_id").alias("row_id")).unionByName(
        fits.select(F.lit("fit_planet_cal").alias("tbl"), tod_key(F.col("tod_name")).alias("key"), F.col("recorded").alias("at"), F.col("fit_id").alias("row_id"))
    )
    arrays = load(spark, d, "array_data").where("det_uid is not null and pa is not null")
    deltas = listing_deltas(arrays, "flatfield", det()).unionByName(listing_deltas(load(spark, d, "tod_info"), "fit_planet_cal", tod_key(F.col("basename"))))
    return refs, deltas


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans_at(*_references(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p2_found(spark, d))


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and in force no more: the ledger of all earlier months, kept up by the changes of the last one."""
    refs, deltas = _references(spark, d)
    asked = refs.dropDuplicates(["tbl", "row_id"]).select("tbl", "key", "at", F.lit(1).alias("d_refs"), F.lit(0).alias("d_exists"))
    changes = asked.unionByName(deltas.select("tbl", "key", "at", F.lit(0).alias("d_refs"), F.col("delta").alias("d_exists")))
    month = F.date_trunc("month", F.lit(refs.agg(F.max("at")).head()[0]))
    ledger = fold_counts(None, changes.where(F.col("at") < month))
    return current_orphans(fold_counts(ledger, changes.where(F.col("at").isNull() | (F.col("at") >= month)))).select("tbl", "key", "n_refs")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(load(spark, d, "cuts"), ["tod_id", "det"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    samples = stream_outliers(load(spark, d, "samples"), ["tod_id", "det_uid"], "samp", "data")
    patho = series_outliers(load(spark, d, "pathologies"), ["pa", "det_uid"], "tod_id", "ctime", "kurtosis")
    return samples.select(F.lit("samples").alias("tbl"), "tod_id", "det_uid", "samp").unionByName(
        patho.select(F.lit("pathologies").alias("tbl"), "tod_id", "det_uid", F.lit(-1).alias("samp"))
    )


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_current": p2_current, "p4_found": p4_found, "p5_found": p5_found}

_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^.*[/\\]', '')), '\.zip$', '')"
_P2 = f"""
SELECT 'flatfield' AS tbl, CAST(100 * year(f.recorded) + month(f.recorded) AS INTEGER) AS period, f.ff_id AS row_id
FROM (SELECT DISTINCT ff_id, pa, det_uid, recorded FROM flatfield
      WHERE det_uid >= 0 AND peak_dac IS NOT NULL AND NOT isnan(peak_dac) AND peak_dac <> 0) f
WHERE NOT EXISTS (SELECT 1 FROM array_data a WHERE a.pa = f.pa AND a.det_uid = f.det_uid
                  AND a.added <= f.recorded AND (a.removed IS NULL OR f.recorded < a.removed))
UNION ALL
SELECT 'fit_planet_cal', CAST(100 * year(f.recorded) + month(f.recorded) AS INTEGER), f.fit_id
FROM (SELECT DISTINCT fit_id, {_KEY.format('tod_name')} AS k, recorded FROM fit_planet_cal WHERE tod_name IS NOT NULL) f
WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_KEY.format('basename')} AS k, added, removed FROM tod_info) t
                  WHERE t.k = f.k AND t.added <= f.recorded AND (t.removed IS NULL OR f.recorded < t.removed))
"""

SQL = {
    "p2_found": _P2,
    "p2_report": f"SELECT tbl, period, count(*) AS n_orphans FROM ({_P2}) GROUP BY tbl, period",
    "p2_current": f"""
WITH refs AS (
  SELECT DISTINCT 'flatfield' AS tbl, pa || '|' || det_uid AS key, ff_id AS row_id FROM flatfield
  WHERE det_uid >= 0 AND peak_dac IS NOT NULL AND NOT isnan(peak_dac) AND peak_dac <> 0
  UNION SELECT DISTINCT 'fit_planet_cal', {_KEY.format('tod_name')}, fit_id FROM fit_planet_cal WHERE tod_name IS NOT NULL),
live AS (
  SELECT 'flatfield' AS tbl, pa || '|' || det_uid AS key FROM array_data WHERE removed IS NULL
  UNION SELECT 'fit_planet_cal', {_KEY.format('basename')} FROM tod_info WHERE removed IS NULL)
SELECT tbl, key, count(*) AS n_refs FROM refs WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.tbl = refs.tbl AND live.key = refs.key)
GROUP BY tbl, key""",
    "p4_found": """
WITH r AS (
  SELECT DISTINCT tod_id, det, greatest(start, 0) AS a, least(stop, nsamps) AS b, nsamps FROM cuts
  WHERE start IS NOT NULL AND stop IS NOT NULL AND greatest(start, 0) < least(stop, nsamps)),
o AS (SELECT *, max(b) OVER (PARTITION BY tod_id, det ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY tod_id, det ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o),
p AS (SELECT tod_id, det, min(a) AS a, max(b) AS b, max(nsamps) AS n FROM i GROUP BY tod_id, det, g)
SELECT tod_id, det, 'period' AS kind, a AS start, b AS stop FROM p
UNION ALL
SELECT tod_id, det, 'gap', coalesce(lag(b) OVER w, 0), a FROM p WINDOW w AS (PARTITION BY tod_id, det ORDER BY a)
QUALIFY coalesce(lag(b) OVER w, 0) < a
UNION ALL
SELECT tod_id, det, 'gap', max(b), max(n) FROM p GROUP BY tod_id, det HAVING max(b) < max(n)""",
    # the level here is a running median without autoregression; the two agree where spikes stand clear of the threshold
    "p5_found": """
WITH s AS (SELECT DISTINCT tod_id, det_uid, samp, data::DOUBLE AS x FROM samples WHERE data IS NOT NULL),
e AS (SELECT *, coalesce(x <> lag(x) OVER w OR NOT isfinite(x), true) AS nw FROM s WINDOW w AS (PARTITION BY tod_id, det_uid ORDER BY samp)),
g AS (SELECT *, sum(nw::INT) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS UNBOUNDED PRECEDING) AS run FROM e),
h AS (SELECT *, count(*) OVER (PARTITION BY tod_id, det_uid, run) AS size FROM g),
f AS (SELECT *, NOT isfinite(x) OR abs(x) >= 134217728 OR size >= 8 AS bad FROM h),
d AS (SELECT tod_id, det_uid, samp, x, abs(x - lag(x) OVER w) AS step, median(x) OVER (PARTITION BY tod_id, det_uid ORDER BY samp ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS level
      FROM f WHERE NOT bad WINDOW w AS (PARTITION BY tod_id, det_uid ORDER BY samp)),
n AS (SELECT tod_id, det_uid, 1.4826 * median(step) / sqrt(2) AS noise FROM d GROUP BY tod_id, det_uid),
p AS (SELECT DISTINCT tod_id, pa, det_uid, ctime, kurtosis AS k FROM pathologies WHERE kurtosis IS NOT NULL),
pe AS (SELECT *, coalesce(k <> lag(k) OVER w OR isnan(k), true) AS nw FROM p WINDOW w AS (PARTITION BY pa, det_uid ORDER BY ctime, tod_id)),
pg AS (SELECT *, sum(nw::INT) OVER (PARTITION BY pa, det_uid ORDER BY ctime, tod_id ROWS UNBOUNDED PRECEDING) AS run FROM pe),
ph AS (SELECT *, count(*) OVER (PARTITION BY pa, det_uid, run) AS size FROM pg),
pm AS (SELECT pa, det_uid, median(k) AS m, (quantile_cont(k, 0.75) - quantile_cont(k, 0.25)) / 1.349 AS s0 FROM p WHERE isfinite(k) AND k >= 1 GROUP BY pa, det_uid),
ps AS (SELECT pa, det_uid, any_value(m) AS m, stddev_pop(k) AS s FROM p JOIN pm USING (pa, det_uid) WHERE isfinite(k) AND k >= 1 AND abs(k - m) <= 6 * s0 GROUP BY pa, det_uid)
SELECT 'samples' AS tbl, tod_id, det_uid, samp FROM f WHERE bad
UNION ALL SELECT 'samples', tod_id, det_uid, samp FROM d JOIN n USING (tod_id, det_uid) WHERE abs(x - level) > 10 * noise
UNION ALL SELECT 'pathologies', tod_id, det_uid, -1 FROM ph LEFT JOIN ps USING (pa, det_uid)
WHERE NOT isfinite(k) OR k < 1 OR size >= 4 OR abs(k - m) > 10 * s""",
}
