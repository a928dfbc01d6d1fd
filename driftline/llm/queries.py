"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import tod_key
from driftline.llm.encode import count_tokens, encode_corpus
from driftline.llm.garbled import find_garbled
from driftline.llm.mixing import kept_limits, mix
from driftline.llm.nearest import nearest_in_time
from driftline.llm.percentiles import SECTION, SECTIONS, merge_sketches, percentiles_of_items, ranks_within_bounds, read_percentiles, sketch_columns, sketch_items
from driftline.tables import load

QS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fits = load(spark, d, "fit_planet_cal").where("fit_id is not null")
    usable = load(spark, d, "recal_model").where("reading_id is not null and loading > 0 and not isnan(loading) and loading < double('inf')")
    key = tod_key(F.col("tod_name"))
    return nearest_in_time(fits, usable, key, key, "ctime", "ctime", "fit_id", "reading_id", 20.0).select("fit_id", "reading_id")


METRICS = ["rms", "gain", "correlation"]


def _pathologies(spark: SparkSession, d: str) -> DataFrame:
    """Rows with ctime and their day, that of ctime."""
    rows = load(spark, d, "pathologies").where("ctime is not null")
    n = F.floor(F.col("ctime") / 86400).cast("int")
    return rows.select("tod_id", "det_uid", "pa", F.date_add(F.lit("1970-01-01").cast("date"), n).alias("day"), *METRICS)


def _once() -> list[Column]:
    """Values count once per (tod_id, det_uid); those of rows without tod_id or det_uid once per set of values."""
    return [F.col("tod_id"), F.col("det_uid"), F.when(F.col("tod_id").isNull() | F.col("det_uid").isNull(), F.struct(*METRICS))]


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketch_columns(_pathologies(spark, d), ["pa", "day"], METRICS, once=_once())


def p3_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The sketches of each array, day and quantity, as rows that merge into those of any set of days."""
    return sketch_items(_day_sketches(spark, d)).drop("n_values")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each array, day and quantity."""
    return read_percentiles(_day_sketches(spark, d), QS)


def p3_season(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each array and quantity over all days, made from the sketches of the days."""
    return read_percentiles(merge_sketches(_day_sketches(spark, d), ["pa"]), QS)


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the true rank of each percentile of the season keeps to its bound."""
    once = _pathologies(spark, d).withColumn("_v", _once()[2]).dropDuplicates(["tod_id", "det_uid", "pa", "day", "_v"])
    return ranks_within_bounds(p3_season(spark, d), once.select("pa", *METRICS), ["pa"], QS)


def p3_weekend(spark: SparkSession, d: str) -> DataFrame:
    """Median of each array and quantity over the Saturdays and Sundays, from the rows of their sketches alone."""
    return percentiles_of_items(p3_sketches(spark, d).where(F.dayofweek("day").isin(1, 7)), ["pa"], {"p50": 0.5}).select("pa", "metric", "n_values")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents").select("doc_id", "text"))


def _mixture(spark: SparkSession, d: str, temperature: bool = False) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    sized = count_tokens(docs.where("source is not null"))
    return mix(sized, "source", "doc_id", "n_tokens", load(spark, d, "mix_targets"), temperature=temperature)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mixture and how often it is used: the target shares at the largest budget that the repetition limits allow."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, d)[1]


def p7_temperature(spark: SparkSession, d: str) -> DataFrame:
    """As ``p7_mixture`` with a budget of all tokens: token shares exponentiated to the entropy of the targets, as far as the repetition limits allow."""
    return _mixture(spark, d, True)[0]


def p7_temperature_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source, and the exponent."""
    return _mixture(spark, d, True)[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether both mixtures respect the limits and reach the shares wanted, and whether the exponent was bisected."""
    both = [kept_limits(r).withColumn("mixture", F.lit(n)).withColumn("between", F.lit(n == "targets") | F.lit(0 < r.select("exponent").head()[0] < 1)) for n, r in (("targets", p7_shares(spark, d)), ("temperature", p7_temperature_shares(spark, d)))]
    return both[0].unionByName(both[1])


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents, the swaps they suffered and what they read without them."""
    return find_garbled(load(spark, d, "documents").where("doc_id is not null"), "doc_id", "text", F.lower(F.trim("source")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


QUERIES = {"p1_found": p1_found, "p3_sketches": p3_sketches, "p3_percentiles": p3_percentiles, "p3_season": p3_season, "p3_bounds": p3_bounds, "p3_weekend": p3_weekend, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_temperature": p7_temperature, "p7_temperature_shares": p7_temperature_shares, "p7_limits": p7_limits, "p8_found": p8_found, "p8_restored": p8_restored}

_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace(tod_name, '^\s+|\s+$', '', 'g'), '^.*[/\\]', '')), '\.zip$', '')"
_RANK = "max(CASE WHEN i = greatest(1, CAST(ceil({q} * n - 1e-9) AS BIGINT)) THEN v END) AS {name}"

_P3 = """
WITH p AS (SELECT DISTINCT tod_id, det_uid, pa, CAST(to_timestamp(ctime) AT TIME ZONE 'UTC' AS DATE) AS day, rms, gain, correlation FROM pathologies),
u AS (UNPIVOT p ON rms, gain, correlation INTO NAME metric VALUE v),
r AS (SELECT pa, day, metric, v, row_number() OVER (PARTITION BY pa, day, metric ORDER BY v) AS i,
             count(*) OVER (PARTITION BY pa, day, metric) AS n FROM u WHERE isfinite(v))"""

SQL = {
    # documents aren't comparable, for they depend on a hash; the limits are
    "p7_limits": """
SELECT source, true AS repeats_kept, true AS share_reached, mixture, true AS "between"
FROM mix_targets, (VALUES ('targets'), ('temperature')) m(mixture) WHERE source IS NOT NULL""",
    "p1_found": f"""
WITH f AS (SELECT DISTINCT fit_id, {_KEY} AS k, ctime AS t FROM fit_planet_cal WHERE tod_name IS NOT NULL AND ctime IS NOT NULL),
r AS (SELECT DISTINCT reading_id, {_KEY} AS k, ctime AS t FROM recal_model
      WHERE tod_name IS NOT NULL AND ctime IS NOT NULL AND loading > 0 AND isfinite(loading))
SELECT fit_id, reading_id FROM f JOIN r ON f.k = r.k AND r.t BETWEEN f.t - 20 AND f.t + 20
QUALIFY row_number() OVER (PARTITION BY fit_id ORDER BY abs(r.t - f.t), r.t DESC, reading_id DESC) = 1""",
    # while a group has fewer values than a compactor holds (as here), the sketch is the values themselves
    "p3_sketches": f"{_P3} SELECT pa, day, metric, 'both' AS tail, 0 AS level, v AS value FROM r",
    "p3_percentiles": f"""
{_P3} SELECT pa, day, metric, max(n) AS n_values, {", ".join(_RANK.format(q=q, name=k) for k, q in QS.items())},
{", ".join(f"CASE WHEN max(n) < {2 * SECTION * SECTIONS} THEN 0.0::DOUBLE ELSE {12 * 0.1306 / SECTION * min(q, 1 - q)!r}::DOUBLE END AS {k}_error" for k, q in QS.items())}
FROM r GROUP BY pa, day, metric""",
    # of the season only the bounds can be compared: the rank of every percentile must keep to its own
    "p3_bounds": f"""
{_P3}, q AS (SELECT unnest({list(QS)}) AS percentile)
SELECT pa, metric, percentile, count(*) AS n_values, true AS within FROM r, q GROUP BY pa, metric, percentile""",
    "p3_weekend": f"{_P3} SELECT pa, metric, count(*) AS n_values FROM r WHERE dayofweek(day) IN (0, 6) GROUP BY pa, metric",
}
