"""Season-level steps: calibration chains, selections over many criteria, reports and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import bounded, few_groups, first_rows, with_groups
from driftline.operators.stats import group_median, medsig


def calibration_chain(df: DataFrame, steps: list[tuple[str, object, list[str]]], name: str = "cal") -> DataFrame:
    """``df`` with the product of calibration steps: ("constant", number, []) or ("table", DataFrame with column cal, keys).

    A detector that a table lacks, or for which it has NaN or an infinite value, gets 0.
    """
    total: Column = F.lit(1.0)
    out = df
    for i, (kind, what, keys) in enumerate(steps):
        if kind == "constant":
            total = total * F.lit(float(what))
            continue
        one = first_rows(what, keys, ["cal"]).withColumnRenamed("cal", f"_c{i}")
        out = with_groups(out, one, keys, few_groups(what, keys))
        c = F.col(f"_c{i}")
        total = total * F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), 0.0).otherwise(c)
    return out.withColumn(name, total).select(*df.columns, name)


def chain_steps(step: dict | list, products: dict, keys: list[str]) -> list[tuple[str, object, list[str]]]:
    """Steps for ``calibration_chain`` from a nested description; ``products`` has the tables and depots it names.

    A list, or type ``cal_steps``, is a chain. ``constant``: value. ``array_data_parameter``: the column ``parameter`` of the array table. ``flatfield`` and
    ``cal_table``: the column cal of a table, of its stable detectors only with ``fiducial``. ``depot_cal``: the same from a depot (kind, tag, name). ``abscal``: the
    value of a band (``on``, the keys of its table). ``column_file``: two columns of a text file, key and value. ``reference``: another step of ``products`` by name.
    """
    if isinstance(step, list):
        return [s for x in step for s in chain_steps(x, products, keys)]
    kind = step.get("type", "cal_steps")
    table = lambda t, k: [("table", t, k)]
    if kind == "cal_steps":
        return chain_steps(step["cal_steps"], products, keys)
    if kind == "constant":
        return [("constant", float(step["value"]), [])]
    if kind == "array_data_parameter":
        return table(products["array_data"].select(*keys, F.col(step["parameter"]).cast("double").alias("cal")), keys)
    if kind in ("flatfield", "cal_table"):
        t = products[step["table"]]
        return table((t.where("stable") if step.get("fiducial") else t).select(*keys, "cal"), keys)
    if kind == "depot_cal":
        return table(products[step.get("depot", "depot")].read(step.get("kind", "Calibration"), step["tag"], step["name"]).select(*keys, "cal"), keys)
    if kind == "abscal":
        return table(products[step["table"]].select(*step["on"], "cal"), step["on"])
    if kind == "column_file":
        return table(products[step["table"]].select(F.col(step["columns"][0]).alias(keys[-1]), F.col(step["columns"][1]).cast("double").alias("cal")), keys[-1:])
    if kind == "reference":
        return chain_steps(products[step["name"]], products, keys)
    raise ValueError(f"unknown calibration step {kind}")


def calibrated(df: DataFrame, cal: DataFrame, keys: list[str], value: str, missing: float | None = 0.0) -> DataFrame:
    """Streams times their detector's calibration; without one times ``missing``, or as they are if that is None."""
    c = cal.select(*keys, F.col("cal").alias("_c"))
    return with_groups(df, c, keys, few_groups(cal, keys)).withColumn(value, F.col(value) * F.coalesce("_c", F.lit(1.0 if missing is None else missing))).drop("_c")


def first_failure(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """``df`` with ``failed``: the first rule (key: lo, hi inclusive) that a row breaks or for which it has no finite value."""
    out: Column = F.lit(None).cast("string")
    for k, (lo, hi) in reversed(list(rules.items())):
        c = F.col(k)
        bad = c.isNull() | F.isnan(c) | ~c.between(lo, hi)
        out = F.when(bad, k).otherwise(out)
    return df.withColumn("failed", out)


def criteria_selection(long: DataFrame, keys: list[str], limits: dict[str, dict]) -> DataFrame:
    """(keys, n_failed, live) of values (keys, tod, key, v) against criteria, all of which must hold.

    A criterion has ``absolute`` (lo, hi) and / or ``sigmas`` (about the robust centre of its TOD and key), joined by ``how``: and (default) or or.
    """
    s = medsig(long, ["tod_id", "key"], "v", spread=False).drop("n")
    rows = long.where(F.col("key").isin(list(limits))).join(s, ["tod_id", "key"], "left")
    ok: Column = F.lit(True)
    for k, rule in limits.items():
        a = F.col("v").between(*rule["absolute"]) if "absolute" in rule else None
        r = (F.col("sig") == 0) | (F.abs(F.col("v") - F.col("med")) <= rule["sigmas"] * F.col("sig")) if "sigmas" in rule else None
        both = a if r is None else r if a is None else (a | r if rule.get("how") == "or" else a & r)
        ok = F.when(F.col("key") == k, F.coalesce(both, F.lit(False))).otherwise(ok)
    return rows.withColumn("_ok", ok).groupBy(*keys).agg(F.count_if(~F.col("_ok")).alias("n_failed"), F.every("_ok").alias("live"))


def excess_partial(chunks: DataFrame, keys: list[str], selected: Column, most: float) -> DataFrame:
    """(keys, fraction, kept): whether the share of unselected chunks is at most ``most``."""
    g = chunks.groupBy(*keys).agg(F.avg(F.when(selected, 0.0).otherwise(1.0)).alias("fraction"))
    return g.withColumn("kept", F.col("fraction") <= most)


def stable(df: DataFrame, keys: list[str], value: str, selected: Column, lo: float = 0.8, hi: float = 1.2) -> DataFrame:
    """``df`` with ``stable``: value over the median of its group's selected values lies between lo and hi."""
    m = group_median(df.where(selected), keys, value, "_m").drop("n")
    ratio = F.col(value) / F.when(F.col("_m") != 0, F.col("_m"))
    return df.join(m, keys, "left").withColumn("stable", F.coalesce((ratio > lo) & (ratio < hi), F.lit(False))).drop("_m")


def beam_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation of fwhm per group and the mean ellipse of (fwhm_maj, fwhm_min, fwhm_ang in degrees)."""
    p = (F.col("fwhm_maj") - F.col("fwhm_min")) / 2
    a = F.radians(2 * F.col("fwhm_ang"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("fwhm").alias("fwhm"), F.stddev_pop("fwhm").alias("fwhm_std"), F.avg((F.col("fwhm_maj") + F.col("fwhm_min")) / 2).alias("_c"), F.avg(p * F.cos(a)).alias("_q"), F.avg(p * F.sin(a)).alias("_u"))
    size = F.sqrt(F.col("_q") ** 2 + F.col("_u") ** 2)
    return g.select(*keys, "n", "fwhm", "fwhm_std", (F.col("_c") + size).alias("maj"), (F.col("_c") - size).alias("min"), (F.degrees(F.atan2("_u", "_q")) / 2).alias("angle"))


def absolute_calibration(tods: DataFrame, models: DataFrame, blacklist: DataFrame, recals: list[DataFrame], default_loading: float = 1.5) -> DataFrame:
    """(tod_id, band, cal) = 1e6 exp(-(b + m loading)) by the model of the array and time, times recalibrations, sorted.

    ``models``: pa, band, t_lo, t_hi, b, m. A negative loading counts as ``default_loading``. TODs of the blacklist are left out; a
    recalibration that lacks a TOD and band counts as 1.
    """
    live = tods.join(blacklist.select("tod_id").distinct(), "tod_id", "left_anti")
    m, _ = bounded(models.withColumnRenamed("pa", "_pa"))
    got = live.join(m, (F.col("pa") == F.col("_pa")) & (F.col("ctime") >= F.col("t_lo")) & (F.col("ctime") < F.col("t_hi")))
    loading = F.when(F.col("loading") < 0, default_loading).otherwise(F.col("loading"))
    out = got.select("tod_id", "band", (1e6 * F.exp(-(F.col("b") + F.col("m") * loading))).alias("cal"))
    for i, r in enumerate(recals):
        out = out.join(r.select("tod_id", "band", F.col("cal").alias(f"_r{i}")), ["tod_id", "band"], "left").withColumn("cal", F.col("cal") * F.coalesce(f"_r{i}", F.lit(1.0))).drop(f"_r{i}")
    return out.orderBy("tod_id", "band")


def band_noise(spectra: DataFrame, keys: list[str], bands: list[tuple[float, float]], cal: DataFrame) -> DataFrame:
    """(keys, band, noise): root mean of spec squared in each band [lo, hi), times |cal|; detectors whose first band is 0 are left out."""
    b = reduce(lambda e, i: e.when((F.col("f") >= bands[i][0]) & (F.col("f") < bands[i][1]), i), range(1, len(bands)), F.when((F.col("f") >= bands[0][0]) & (F.col("f") < bands[0][1]), 0))
    per = spectra.withColumn("band", b).where("band is not null").groupBy(*keys, "band").agg(F.sqrt(F.avg(F.col("spec") ** 2)).alias("noise"))
    good = per.where("band = 0 and noise > 0").select(*keys)
    return per.join(good, keys, "left_semi").join(cal, keys, "left").withColumn("noise", F.col("noise") * F.abs(F.coalesce("cal", F.lit(0.0)))).select(*keys, "band", "noise")


def destriped(df: DataFrame, keys: list[str], samp: str, value: str, inside: Column, least: int = 4) -> DataFrame:
    """Samples inside a region less the line through those outside it: segments run from one stretch inside to the next.

    Each stretch inside takes the line fitted to the outside samples of its segment (the stretch and what follows it up to the next);
    segments with fewer than ``least`` outside samples are left out.
    """
    w = Window.partitionBy(*keys).orderBy(samp)
    rows = df.withColumn("_in", inside).withColumn("_new", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x, y = F.when(~F.col("_in"), F.col(samp).cast("double")), F.when(~F.col("_in"), F.col(value))
    fit = rows.groupBy(*keys, "segment").agg(F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_c"), F.count(y).alias("_n")).where(F.col("_n") >= least)
    return rows.where("_in").join(fit, [*keys, "segment"]).withColumn(value, F.col(value) - F.col("_c") - F.col("_k") * F.col(samp)).select(*df.columns, "segment")


def report_rows(patho: DataFrame, cuts: DataFrame, criteria: list[str]) -> DataFrame:
    """One row per TOD: live and dark detectors, mean cut fraction, median and scatter of each criterion over the live ones.

    ``patho``: tod_id, det_uid, live and the criteria. ``cuts``: tod_id, det_uid, fraction.
    """
    live = F.col("live")
    agg = [F.count_if(live).alias("live_dets"), F.count_if(~live).alias("dark_dets")]
    for c in criteria:
        v = F.when(live & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
        agg += [F.median(v).alias(f"{c}_median"), F.stddev_pop(v).alias(f"{c}_std"), F.count(v).alias(f"{c}_n")]
    per = patho.groupBy("tod_id").agg(*agg)
    return per.join(cuts.groupBy("tod_id").agg(F.avg("fraction").alias("cut_fraction")), "tod_id", "left")


def criteria_matrix(long: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """A criterion table (rows..., column, v) with one column for each of the values of ``column`` asked for."""
    return long.where(F.col(column).isin(values)).groupBy(*rows).pivot(column, values).agg(F.max("v"))


def pointing_offset(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the shifts (dx, dy) of a TOD's blocks; those of kind source_offset count with opposite sign."""
    s = F.when(F.col("kind") == "source_offset", -1).otherwise(1)
    return blocks.groupBy(*keys).agg(F.sum(s * F.col("dx")).alias("dx"), F.sum(s * F.col("dy")).alias("dy"))


def focal_plane(places: DataFrame, polarisation: DataFrame, shift: tuple[float, float], request: DataFrame) -> DataFrame:
    """(det_uid, x, y, phi, mask) of the requested detectors; missing ones are at 0 with mask false, as are those with a bad angle."""
    p = places.join(polarisation, "det_uid", "left")
    got = request.join(p, "det_uid", "left")
    ok = F.col("x").isNotNull() & F.coalesce("ok", F.lit(False))
    return got.select("det_uid", F.coalesce(F.col("x") + shift[0], F.lit(0.0)).alias("x"), F.coalesce(F.col("y") + shift[1], F.lit(0.0)).alias("y"), F.coalesce("phi", F.lit(0.0)).alias("phi"), ok.alias("mask"))


def whole_cuts(dets: DataFrame, keys: list[str], selected: Column) -> DataFrame:
    """Ranges over the whole axis (nsamps) of unselected detectors."""
    return dets.where(~F.coalesce(selected, F.lit(False))).select(*keys, F.lit(0).alias("start"), F.col("nsamps").alias("stop"))


def chunk_cuts(chunks: DataFrame, keys: list[str], selected: Column, size: int, offset: int = 0) -> DataFrame:
    """Ranges of unselected chunks."""
    return chunks.where(~F.coalesce(selected, F.lit(False))).select(*keys, (F.col("chunk") * size + offset).cast("int").alias("start"), ((F.col("chunk") + 1) * size + offset).cast("int").alias("stop"))
