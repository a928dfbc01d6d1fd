"""Mixtures of sources by weight, with a cap on repeats.

Two families of weights, each with one exponent found by bisection:
``temperature_weights`` exponentiates the natural token shares, natural**t: 1 leaves them, 0 makes all sources equal. t is the exponent whose
weights have a wanted entropy, or the one nearest to it whose weights respect every repetition limit.
``mixture_weights`` goes from the target shares to the natural ones, target**(1 - a) * natural**a, no further than the repetition limits ask.
Weights are then
realised as budgeted permutations: a source gives all its documents as often as its budget holds them whole, and
for the rest its blocks in a seeded random order, the last block being cut within its own random order. Blocks have
their token totals added up first, so no source is ever sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import checkpointed


def mixture_weights(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: float | None = None, entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """Weights by source, the budget in tokens, and the exponent.

    Sources without tokens or without a positive target get none; the shares of the others are scaled to 1. Without ``budget`` it is
    the largest at which the targets respect the repetition limits. Beyond what all limits allow together the budget is cut.
    """
    live = [s for s in target if tokens.get(s, 0) > 0 and target[s] > 0 and repeats.get(s, 1) > 0]
    if not live:
        return {}, 0.0, 0.0
    total, asked = sum(tokens[s] for s in live), sum(target[s] for s in live)
    cap = {s: float(tokens[s]) * repeats.get(s, 1) for s in live}
    most = min(cap[s] / (target[s] / asked) for s in live)
    size = min(budget if budget is not None else most, sum(cap.values()))

    def at(a: float) -> dict[str, float]:
        w = {s: (target[s] / asked) ** (1 - a) * (tokens[s] / total) ** a for s in live}
        z = sum(w.values())
        return {s: v / z for s, v in w.items()}

    over = lambda w: any(w[s] * size > cap[s] * (1 + 1e-12) for s in live)
    h = lambda w: -sum(v * math.log(v) for v in w.values() if v > 0)
    bad = (lambda w: h(w) < entropy) if entropy is not None else over
    lo, hi = 0.0, 1.0
    if not bad(at(0.0)):
        hi = 0.0
    for _ in range(60 if hi else 0):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if bad(at(mid)) else (lo, mid)
    w = at(hi)
    if over(w):  # natural shares break a limit as well: fill the limited sources and share out the rest
        fixed: dict[str, float] = {}
        while True:
            rest = size - sum(fixed.values())
            free = {s: w[s] for s in live if s not in fixed}
            z = sum(free.values())
            full = [s for s in free if free[s] / z * rest > cap[s]]
            if not full:
                w = {s: (fixed[s] if s in fixed else free[s] / z * rest) / size for s in live}
                break
            fixed |= {s: cap[s] for s in full}
            if len(fixed) == len(live):
                w = {s: cap[s] / size for s in live}
                break
    return w, size, hi


def entropy_of(weights: dict[str, float]) -> float:
    """Entropy in nats of weights scaled to 1; those that aren't positive don't count."""
    z = sum(v for v in weights.values() if v > 0)
    return -sum(v / z * math.log(v / z) for v in weights.values() if v > 0)


def temperature_weights(tokens: dict[str, int], repeats: dict[str, int], entropy: float, budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """Weights by source proportional to natural**t, the budget in tokens (all tokens unless given), and t.

    t is between 0 and 16 and gives the weights ``entropy`` (the nearer end, if none does). Where those break a repetition limit, it is the
    nearest t towards 1 that doesn't; at 1 every source is used once at most for a budget of all tokens. A larger budget is cut to what t = 1 allows.
    """
    live = [s for s in tokens if tokens[s] > 0 and repeats.get(s, 1) > 0]
    if not live:
        return {}, 0.0, 0.0
    total = sum(tokens[s] for s in live)
    size = min(budget if budget is not None else total, total * min(repeats.get(s, 1) for s in live))

    def at(t: float) -> dict[str, float]:
        w = {s: math.exp(t * math.log(tokens[s] / total)) for s in live}
        z = sum(w.values())
        return {s: v / z for s, v in w.items()}

    def bisect(bad, lo: float, hi: float) -> float:
        """The exponent next to ``lo`` that isn't bad; ``hi`` isn't."""
        if not bad(lo):
            return lo
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if bad(mid) else (lo, mid)
        return hi

    t = bisect(lambda x: entropy_of(at(x)) > entropy, 0.0, 16.0)
    over = lambda x: any(w * size > tokens[s] * repeats.get(s, 1) * (1 + 1e-12) for s, w in at(x).items())
    t = bisect(over, t, 1.0)
    return at(t), size, t


def mix(docs: DataFrame, source: str, doc_id: str, size: str, targets: DataFrame, budget: float | None = None, entropy: float | None = None, temperature: bool = False, seed: int = 7, per_block: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and the report of shares.

    ``docs``: one row per document with its source (as in ``targets``) and size in tokens. ``targets``: source, target_share,
    max_repeats. A document is used ``copies`` times, at most max_repeats. With ``temperature`` the weights are those of ``temperature_weights``
    with the entropy of the target shares (or ``entropy``), else of ``mixture_weights``. Documents of no target source, and those of a null
    or negative size, are not used; those of size 0 are as long as their block is. The report has a row per target source:
    tokens in the mixture, wanted weight and share, docs, copies and largest document, also where there are none, and the exponent. Repeated rows are
    documents of their own. A source ends within one document of its budget. A source has at least 1024 blocks and at most about ``per_block``
    documents in each; only the block that is cut is sorted. Only totals per source (one row each) come to the driver.
    """
    spark = docs.sparkSession
    want = {r["source"]: r for r in targets.select("source", "target_share", "max_repeats").where("source is not null").toLocalIterator()}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).where("n_tokens >= 0")
    small = F.broadcast if len(want) <= 10_000 else lambda t: t  # a list of sources; longer ones are joined by shuffle
    rows = rows.join(small(targets.select("source").distinct()), "source", "left_semi")
    rows = checkpointed(rows.withColumn("_o", F.xxhash64("doc_id", F.lit(seed))))  # sizes are dear where they come from a tokenizer; they are read several times below
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    have = {r["source"]: int(r["t"] or 0) for r in sums}
    repeats = {s: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for s, r in want.items()}
    share = {s: float(r["target_share"] or 0) for s, r in want.items()}
    if temperature:
        asked = {s: have.get(s, 0) for s in want if share[s] > 0}
        h = entropy if entropy is not None else entropy_of({s: share[s] for s, n in asked.items() if n > 0} or {"": 1.0})
        weights, total, exponent = temperature_weights(asked, repeats, h, budget)
    else:
        weights, total, exponent = mixture_weights(have, share, repeats, budget, entropy)
    plan, blocks = [], {r["source"]: 1 << max(10, math.ceil(math.log2(max(r["n"] / per_block, 1)))) for r in sums}
    for s, w in weights.items():
        b = min(w * total, have[s] * repeats[s])
        whole = int(b / have[s] + 1e-9)
        plan.append((s, whole, int(max(0, round(b - whole * have[s]))), blocks[s], float(w)))
    plans = spark.createDataFrame(plan or [("", 0, 0, 1, 0.0)], "source string, whole int, rest long, blocks int, weight double")
    placed = rows.join(small(plans), "source").withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("blocks")))
    totals = placed.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy(F.xxhash64("_b", F.lit(seed)), "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = totals.withColumn("upto", F.sum("t").over(w)).select("source", "_b", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left_"), "t")
    # at most one block per source is cut; the others are in or out as a whole
    placed = placed.join(F.broadcast(cut) if sum(blocks.values()) <= 1_000_000 else cut, ["source", "_b"])  # a row for each block
    inside = (F.col("left_") > 0) & (F.col("left_") < F.col("t"))
    full = placed.where(~inside).withColumn("extra", (F.col("left_") >= F.col("t")).cast("int") * (F.col("t") > 0).cast("int"))
    run = Window.partitionBy("source").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = placed.where(inside).withColumn("extra", (F.sum("n_tokens").over(run) <= F.col("left_")).cast("int"))
    chosen = full.unionByName(part).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    largest = rows.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    report = (
        targets.select("source", "target_share", "max_repeats").where("source is not null").join(used, "source", "left")
        .join(plans.select("source", "weight"), "source", "left").join(largest, "source", "left")
        .na.fill(0, ["tokens", "n_docs", "most_copies", "weight", "largest"])
        .withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))
        .withColumn("exponent", F.lit(float(exponent)))
    )
    return chosen, report


def kept_limits(report: DataFrame) -> DataFrame:
    """source, repeats_kept, share_reached: whether a source respects its limit and its share is its weight, to one document of each source."""
    slack = F.sum(F.col("largest") + 1).over(Window.partitionBy(F.lit(1))) / F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return report.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("share") - F.col("weight")) <= slack).alias("share_reached"))
