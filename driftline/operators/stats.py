"""Statistics per detector, sample, group and season.

Order statistics are ranks among a group's values. Groups that grow with the season (a detector's readings) are never sorted or
held as a whole; groups of fixed size (a sample's detectors) are sorted by a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import few_groups, with_groups
from driftline.session import checkpointed


def order_statistics(df: DataFrame, keys: list[str], value: str, at: dict[str, Column], spread: bool = False) -> DataFrame:
    """``keys`` and, by name, the values of zero-based rank ``at`` (an expression over the count n) of each group; and n.

    With ``spread`` a group may be larger than a task should sort: equal values are added up, counted by buckets in the order of
    values (64 to each factor of two), and only the buckets that hold a wanted rank are sorted, each by itself. Nulls don't count;
    null keys are a group.
    """
    if not spread:
        w = Window.partitionBy(*keys)
        ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("n"))
        return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == r, F.col("_v"))).alias(k) for k, r in at.items()], F.first("n").alias("n"))
    own = [f"_k{i}" for i in range(len(keys))]
    v = F.col("_v").cast("double")
    bucket = F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 64) + 100_000))
    values = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(value).alias("_v")).groupBy(*own, "_v").agg(F.count("*").alias("_c")).withColumn("_b", bucket)
    w = Window.partitionBy(*own)
    per = values.groupBy(*own, "_b").agg(F.sum("_c").alias("_m")).withColumn("n", F.sum("_m").over(w)).withColumn("_upto", F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    asked = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), (r - (F.col("_upto") - F.col("_m"))).cast("long").alias("rank")) for k, r in at.items()]), lambda x: (x["rank"] >= 0) & (x["rank"] < F.col("_m")))
    wanted = per.select(*[F.col(o).alias(f"_w{o}") for o in own], F.col("_b").alias("_wb"), "n", asked.alias("_asked")).where("size(_asked) > 0")
    on = F.col("_b").eqNullSafe(F.col("_wb"))
    for o in own:
        on = on & F.col(o).eqNullSafe(F.col(f"_w{o}"))
    part = values.join(wanted, on).withColumn("_end", F.sum("_c").over(Window.partitionBy(*own, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = part.select(*own, "_v", "_c", "_end", "n", F.explode("_asked").alias("_q")).where("_q.rank < _end and _q.rank >= _end - _c")
    got = hit.groupBy(*own).agg(*[F.max(F.when(F.col("_q.name") == k, F.col("_v"))).alias(k) for k in at], F.first("n").alias("n"))
    return got.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], *at, "n")


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, median, n): mean of the middle two values of each group, of groups of any size."""
    q = order_statistics(df, keys, value, {"_lo": F.expr("(n - 1) div 2"), "_hi": F.expr("n div 2")}, spread=True)
    return q.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name), "n")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of rank n // 2 of each group: no mean of the middle two."""
    return order_statistics(df, keys, value, {"med": F.expr("n div 2")}).drop("n")


def medsig(df: DataFrame, keys: list[str], value: str, spread: bool = True) -> DataFrame:
    """Robust centre and deviation: med = x[n // 2], sig = 0.741 (x[3 n // 4] - x[n // 4]) of the sorted values.

    Without ``spread`` each group is sorted in one task, which is faster for groups known to be small.
    """
    q = order_statistics(df, keys, value, {"med": F.expr("n div 2"), "lo": F.expr("n div 4"), "hi": F.expr("3 * n div 4")}, spread)
    return q.select(*keys, "med", (0.741 * (F.col("hi") - F.col("lo"))).alias("sig"), "n")


def rms(value: Column) -> Column:
    """Root mean square."""
    return F.sqrt(F.avg(value * value))


def moments_about_zero(value: Column) -> list[Column]:
    """Variance, skewness and kurtosis about zero; 0 where the variance is 0."""
    m2, m3, m4 = F.avg(value**2), F.avg(value**3), F.avg(value**4)
    return [m2.alias("var"), F.when(m2 == 0, 0.0).otherwise(m3 / m2**1.5).alias("skew"), F.when(m2 == 0, 0.0).otherwise(m4 / m2**2).alias("kurt")]


def moment_chunks(df: DataFrame, keys: list[str], samp: str, value: str, size: int, offset: int = 0, powers: int = 4) -> DataFrame:
    """Raw moments m1.. of whole chunks of ``size`` samples from ``offset`` on; a last part chunk is dropped."""
    chunk = F.floor((F.col(samp) - offset) / size).cast("int")
    n = F.max(samp).over(Window.partitionBy(*keys)) + 1
    rows = df.withColumn("_n", n).where(F.col(samp) >= offset).withColumn("chunk", chunk).where((F.col("chunk") + 1) * size + offset <= F.col("_n"))
    return rows.groupBy(*keys, "chunk").agg(*[F.avg(F.col(value) ** m).alias(f"m{m}") for m in range(1, powers + 1)])


def noise_level(df: DataFrame, keys: list[str], samp: str, value: str, window: int) -> DataFrame:
    """Median over windows of ``window`` samples of their population variance."""
    per = df.groupBy(*keys, F.floor(F.col(samp) / window).alias("_w")).agg(F.var_pop(value).alias("v"))
    return per.groupBy(*keys).agg(F.median("v").alias("noise"))


def skew_score(g1: Column, n: Column) -> Column:
    """Normalised score of a sample skewness (D'Agostino)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2.0 / (w2 - 1))
    u = y / alpha
    return delta * F.log(u + F.sqrt(u * u + 1))


def kurtosis_score(b2: Column, n: Column) -> Column:
    """Normalised score of a sample kurtosis (Anscombe and Glynn); -1000 where the kurtosis is 0."""
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    t = 1 - 2 / (9.0 * a)
    inner = (1 - 2.0 / a) / (1 + x * F.sqrt(2 / (a - 4.0)))
    return F.when(b2 == 0, -1000.0).otherwise((t - F.signum(inner) * F.abs(inner) ** (1 / 3.0)) / F.sqrt(2 / (9.0 * a)))


def bin_sums(df: DataFrame, keys: list[str], index: Column, value: Column) -> DataFrame:
    """Sum and count per bin; rows with a negative index are left out."""
    return df.withColumn("bin", index).where("bin >= 0").groupBy(*keys, "bin").agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def complex_bin_sums(df: DataFrame, keys: list[str], index: Column, re: Column, im: Column) -> DataFrame:
    """Sums of the real and imaginary parts and count per bin; rows with a negative index are left out."""
    return df.withColumn("bin", index).where("bin >= 0").groupBy(*keys, "bin").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.count(re).alias("n"))


def log_bin(f: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the bin of equal ratios between lo and hi that holds f; -1 outside."""
    r = math.log10(hi / lo) / bins
    b = F.floor(F.log10(F.when(f > 0, f) / lo) / r + 1e-12).cast("int")
    return F.when((f >= lo) & (f < hi), b).otherwise(-1)


def average_between(df: DataFrame, time: str, value: str, t0: float, t1: float) -> DataFrame:
    """n, mean and population deviation over [t0, t1); zeros if there are no readings."""
    x = F.when((F.col(time) >= t0) & (F.col(time) < t1), F.col(value))
    return df.agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"))


def report_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, n, mean, median, std) of each column without NaN and nulls."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "key", "v").where("v is not null and not isnan(v)")
    middle = order_statistics(long, ["key"], "v", {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)}, spread=True)
    rest = long.groupBy("key").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return rest.join(middle.select("key", ((F.col("lo") + F.col("hi")) / 2).alias("median")), "key").select("key", "n", "mean", "median", "std")


def significance(df: DataFrame, key: str, weight: str, lo: float, hi: float, steps: int) -> DataFrame:
    """Percent of all weight below and above each of ``steps`` + 1 levels between lo and hi, in one pass."""
    total = F.sum(weight)
    levels = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
    row = df.agg(*[(100 * F.sum(F.when(F.col(key) < v, F.col(weight)).otherwise(0.0)) / total).alias(f"b{i}") for i, v in enumerate(levels)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"b{i}").alias("below"), (100 - F.col(f"b{i}")).alias("above")) for i, v in enumerate(levels)])).alias("r")).select("r.*")


def band_sensitivity(value: Column) -> Column:
    """Sensitivity of detectors together: (sum x**-2)**-1/2 over the root of two."""
    return F.sum(value**-2) ** -0.5 / math.sqrt(2)


def cumulative_sensitivity(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """``df`` with rank and the sensitivity of the best so many detectors."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum(F.col(value) ** -2).over(w.rowsBetween(Window.unboundedPreceding, 0)) ** -0.5)


def weighted_line(x: Column, y: Column, w: Column) -> list[Column]:
    """Slope and intercept of the weighted least-squares line; null if x has no spread."""
    s, sx, sy, sxx, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)
    det = s * sxx - sx * sx
    ok = F.when(det != 0, det)
    return [((s * sxy - sx * sy) / ok).alias("slope"), ((sxx * sy - sx * sxy) / ok).alias("intercept")]


def pooled_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One slope for all groups and an intercept and residual sum for each: (group, slope, intercept, chi2)."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    every = Window.partitionBy(F.lit(0))  # over one row per group
    s = F.sum(F.col("n") * F.col("c")).over(every) / F.sum(F.col("n") * F.col("vx")).over(every)
    g = g.withColumn("slope", s)
    return g.select(group, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (F.col("n") * (F.col("vy") - 2 * F.col("slope") * F.col("c") + F.col("slope") ** 2 * F.col("vx"))).alias("chi2"))


def clipped_line(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 5, sigmas: float = 3.0) -> DataFrame:
    """(keys, slope, intercept, n, err) of a line fitted ``rounds`` times, each time without rows beyond ``sigmas`` deviations."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    fit, few = None, few_groups(rows, keys)
    for i in range(rounds):
        kept = rows if fit is None else with_groups(rows, fit, keys, few).where(F.abs(F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept")) <= sigmas * F.col("err")).select(*rows.columns)
        fit = kept.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("n"), F.sqrt(F.greatest(F.regr_syy("_y", "_x") - F.regr_slope("_y", "_x") * F.regr_sxy("_y", "_x"), F.lit(0.0)) / F.count("*")).alias("err"))
    return fit


def normalized_gains(df: DataFrame, keys: list[str], det: str, gain: str, reference: Column, least: int = 1, sigmas: float = 3.0) -> DataFrame:
    """``df`` with norm (mean gain of the reference detectors within ``sigmas`` robust deviations) and gain divided by it.

    Fewer than ``least`` such detectors give norm 1 and ok false.
    """
    ref = df.where(reference & (F.col(gain) != 0) & F.col(gain).isNotNull() & ~F.isnan(gain))
    s = medsig(ref, keys, gain, spread=False).drop("n")
    kept = ref.join(s, keys).where((F.col("sig") == 0) | (F.abs(F.col(gain) - F.col("med")) <= sigmas * F.col("sig")))
    norm = kept.groupBy(*keys).agg(F.avg(gain).alias("norm"), F.count("*").alias("_n"))
    out = df.join(norm, keys, "left").withColumn("ok", F.coalesce(F.col("_n") >= least, F.lit(False)))
    return out.withColumn("norm", F.when(F.col("ok") & (F.col("norm") != 0), F.col("norm")).otherwise(1.0)).withColumn("relative", F.col(gain) / F.col("norm")).drop("_n")


def find_mode(df: DataFrame, keys: list[str], value: str, rounds: int = 4, width: float = 2.0) -> DataFrame:
    """(keys, mode): robust centre of the values within ``width`` deviations of the centre before, ``rounds`` times.

    Where no value is left the centre stays.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    now, few = checkpointed(medsig(rows, keys, "_v").drop("n")), few_groups(rows, keys)  # one row per group; each round reads it twice
    for _ in range(rounds):
        near = with_groups(rows, now, keys, few).where(F.abs(F.col("_v") - F.col("med")) <= width * F.col("sig")).select(*keys, "_v")
        new = medsig(near, keys, "_v").select(*keys, F.col("med").alias("_m"), F.col("sig").alias("_s"))
        now = checkpointed(now.join(new, keys, "left").select(*keys, F.coalesce("_m", "med").alias("med"), F.coalesce("_s", "sig").alias("sig")))
    return now.select(*keys, F.col("med").alias("mode"))


def sum_in_any_order(value: Column, unit: Column, power: int = 1) -> Column:
    """Sum of powers of values of magnitude ``unit`` (of the group) or so, to 27 decimals of it: the same however the rows are ordered and parted."""
    share = F.when(unit > 0, value / unit).otherwise(0.0)
    return F.sum((share**power).cast("decimal(38,27)")).cast("double") * F.first(unit) ** power


def combine_fits(df: DataFrame, obs: str, det: str, x: str, y: str, tau: str, ok: Column, radius: float, template: DataFrame | None = None, rounds: int = 3, least: int = 2, least_dets: int = 5) -> DataFrame:
    """(det, x, y, tau, their deviations, n_obs, ok): mean fit of each detector over observations within ``radius`` of the last estimate.

    Every observation is first shifted to the template (det, x, y; the first observation unless given) by the median difference over the detectors
    both have; observations with fewer than ``least_dets`` of those are left out, as are fits that aren't ``ok`` or have a null or non-finite number.
    The first estimate is the median of each coordinate. A detector without ``least`` fits has ok false, and nulls where none is left.
    Results don't depend on the order of rows.
    """
    rows = df.select(F.col(obs).alias("_o"), F.col(det).alias("_d"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(tau).cast("double").alias("_t"), ok.alias("_ok"))
    few = few_groups(rows, ["_d"])
    good = rows.where("_ok")
    for c in ("_x", "_y", "_t"):
        good = good.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    middle = lambda d, keys, v, name: group_median(d, keys, v, name).drop("n")
    if template is None:
        first = good.where(F.col("_o") == good.agg(F.min("_o")).scalar())
        template = middle(first, ["_d"], "_x", "px").join(middle(first, ["_d"], "_y", "py"), "_d")
    else:
        template = template.select(F.col(det).alias("_d"), F.col(x).alias("px"), F.col(y).alias("py"))
    both = with_groups(good, template, ["_d"], few).where("px is not null").select("_o", (F.col("px") - F.col("_x")).alias("dx"), (F.col("py") - F.col("_y")).alias("dy"))
    shift = both.groupBy("_o").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_dets).join(middle(both, ["_o"], "dx", "dx"), "_o").join(middle(both, ["_o"], "dy", "dy"), "_o").drop("_n")
    moved = with_groups(good, checkpointed(shift), ["_o"], few_groups(good, ["_o"])).where("dx is not null").select("_d", (F.col("_x") + F.col("dx")).alias("_x"), (F.col("_y") + F.col("dy")).alias("_y"), "_t")
    moved = checkpointed(moved)  # every round reads it
    unit, top, n = F.col("unit"), F.col("top"), F.count("*")  # what distances and times don't exceed
    size = moved.groupBy("_d").agg(F.least(F.lit(float(radius)), 2 * F.greatest(F.max(F.abs("_x")), F.max(F.abs("_y")))).alias("unit"), F.max(F.abs("_t")).alias("top"))
    now = middle(moved, ["_d"], "_x", "cx").join(middle(moved, ["_d"], "_y", "cy"), "_d").join(size, "_d")
    off = {c: F.col(f"_{c}") - F.col(f"c{c}") for c in "xyt"}
    for _ in range(rounds):
        near = with_groups(moved, now, ["_d"], few).where(off["x"] ** 2 + off["y"] ** 2 < radius**2)
        centre = [(F.first(f"c{c}") + sum_in_any_order(off[c], unit) / n).alias(f"c{c}") for c in "xy"]
        now = checkpointed(near.groupBy("_d").agg(*centre, (sum_in_any_order(F.col("_t"), top) / n).alias("ct"), F.first("unit").alias("unit"), F.first("top").alias("top")))
    spread = [F.sqrt(sum_in_any_order(off[c], u, 2) / n).alias(f"s{c}") for c, u in zip("xyt", (unit, unit, top))]
    now = with_groups(near.select("_d", "_x", "_y", "_t"), now, ["_d"], few).groupBy("_d").agg(*[F.first(f"c{c}").alias(f"c{c}") for c in "xyt"], *spread, n.alias("n"))
    return rows.select("_d").distinct().join(now, "_d", "left").select(
        F.col("_d").alias(det), F.col("cx").alias(x), F.col("cy").alias(y), F.col("ct").alias(tau), F.col("sx").alias(f"{x}_err"), F.col("sy").alias(f"{y}_err"), F.col("st").alias(f"{tau}_err"),
        F.coalesce("n", F.lit(0)).alias("n_obs"), F.coalesce(F.col("n") >= least, F.lit(False)).alias("ok"),
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins of [lo, hi), values outside left out."""
    b = F.floor((F.col(value) - lo) * bins / (hi - lo)).cast("int")
    return df.where((F.col(value) >= lo) & (F.col(value) < hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
