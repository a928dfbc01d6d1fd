"""Selection of records: value lists, ranges, ordered lookups and outlier rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.joins import few_groups, with_groups
from driftline.operators.stats import group_median, medsig


def predicate(df: DataFrame, key: str, want) -> Column:
    """None: is null; list: one of; (lo, hi): half-open range; (lo, hi, mod): the same modulo; else equality.

    A None in a list also takes nulls. A column that isn't there selects nothing.
    """
    if key not in df.columns:
        return F.lit(False)
    c = F.col(key)
    if want is None:
        return c.isNull()
    if isinstance(want, list):
        some = [v for v in want if v is not None]
        return c.isin(some) | (c.isNull() if len(some) < len(want) else F.lit(False))
    if isinstance(want, tuple):
        if len(want) == 3:
            lo, hi, mod = want
            return F.pmod(c - lo, F.lit(mod)) + lo < hi
        return (c >= want[0]) & (c < want[1])
    return c == want


def select_outer(df: DataFrame, rules: dict, fields: list[str] | None = None, ordered: list[str] | None = None) -> DataFrame:
    """Rows that fulfil all rules (see ``predicate``), optionally some fields of them, in the order of ``ordered``."""
    out = df.where(reduce(lambda a, b: a & b, [predicate(df, k, v) for k, v in rules.items()], F.lit(True)))
    out = out.orderBy(*ordered) if ordered else out
    return out.select(*fields) if fields else out


def select_inner(df: DataFrame, request: DataFrame, keys: list[str], index: str, ord_: str = "ord") -> DataFrame:
    """One row per request, (``ord_``, index, found): the least ``index`` of the rows with the same keys, -1 if there is none.

    Null keys match null keys.
    """
    first = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(index).alias("_i"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    got = request.join(first, same, "left")
    return got.select(ord_, F.coalesce("_i", F.lit(-1)).alias(index), F.col("_i").isNotNull().alias("found"))


def rule_survivors(df: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """(rule, key, n): rows that fulfil the first so many rules, counted in one pass."""
    masks, now = [], F.lit(True)
    for k, v in rules:
        now = now & F.coalesce(predicate(df, k, v), F.lit(False))
        masks.append(now)
    counts = df.agg(*[F.count_if(m).alias(f"n{i}") for i, m in enumerate(masks)])
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(k).alias("key"), F.col(f"n{i}").alias("n")) for i, (k, _) in enumerate(rules)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def strictly_between(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows with gt < value < lt for every key; null values fail."""
    conds = [c for k, (gt, lt) in limits.items() for c in ([F.col(k) > gt] if gt is not None else []) + ([F.col(k) < lt] if lt is not None else [])]
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def select_by_sigma(df: DataFrame, keys: list[str], value: str, sigmas: float) -> DataFrame:
    """``df`` with ``selected``: within ``sigmas`` robust deviations of the robust centre of its group, limits included.

    A group with deviation 0 is selected as a whole, null values never are. The centre and deviation are those of ``medsig``.
    """
    stats = medsig(df, keys, value)
    if keys:
        got = with_groups(df, stats.drop("n"), keys, few_groups(df, keys))
    else:
        one = stats.select(F.struct("med", "sig")).scalar()
        got = df.withColumn("_f", one).withColumn("med", F.col("_f.med")).withColumn("sig", F.col("_f.sig"))
    ok = F.col(value).isNotNull() & ((F.col("sig") == 0) | (F.abs(F.col(value) - F.col("med")) <= sigmas * F.col("sig")))
    return got.withColumn("selected", F.coalesce(ok, F.lit(False))).select(*df.columns, "selected")


def limit_mask(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``kept``: value <= min(3 m, max + 0.2 m), m the median of the group's values other than 0."""
    m = group_median(df.where(F.col(value) != 0), keys, value, "_m").drop("n").join(df.groupBy(*keys).agg(F.max(value).alias("_x")), keys)
    return with_groups(df, m, keys, few_groups(df, keys)).where("_m is not null").withColumn("kept", F.col(value) <= F.least(3 * F.col("_m"), F.col("_x") + 0.2 * F.col("_m"))).drop("_m", "_x")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def group_masks(df: DataFrame, keys: list[str], empty: bool = True) -> DataFrame:
    """Number of rows of every combination of the distinct key values; also of those without rows if ``empty``.

    The distinct values are few by their meaning (arrays, bands); the combinations are made of these alone.
    """
    have = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if not empty:
        return have
    combos = have.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        combos = combos.withColumn(k, F.explode(k))
    return combos.join(have, keys, "left").na.fill(0, ["n"])
