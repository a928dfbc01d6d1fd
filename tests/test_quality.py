"""Coverage, orphans and spikes on small fixtures, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.operators import spikes
from driftline.operators.coverage import periods_and_gaps
from driftline.operators.orphans import current_orphans, fold_counts, listing_deltas, orphan_report, orphans_at

CUT = "tod_id string, det int, start int, stop int, nsamps int, kind string"


def brute_cover(rows):
    out, per = set(), {}
    for t, d, a, b, n, _ in rows:
        if None in (t, d, a, b, n) or max(a, 0) >= min(b, n):
            continue
        per.setdefault((t, d), [np.zeros(n, bool), n])[0][max(a, 0) : min(b, n)] = True
    for (t, d), (m, n) in per.items():
        e = np.flatnonzero(np.diff(np.r_[False, m, False].astype(int)))
        for a, b in zip(e[::2], e[1::2]):
            out.add((t, d, "period", a, b))
        e = np.flatnonzero(np.diff(np.r_[False, ~m, False].astype(int)))
        for a, b in zip(e[::2], e[1::2]):
            out.add((t, d, "gap", a, b))
    return out


def test_cover_random(spark):
    r = random.Random(1)
    end = lambda: r.choice([None, -5, 0, 50, 60, 2**31 - 1, *range(50)])
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), end(), end(), 50, "x") for _ in range(120)]
    rows += rows[:20] + [("hot", 1, i % 40, i % 40 + 2, 50, "x") for i in range(400)] + [("n", 1, 0, 5, None, "x"), ("z", 1, 0, 5, 0, "x"), ("neg", 1, 0, 5, -3, "x")]
    got = {tuple(x) for x in periods_and_gaps(spark.createDataFrame(rows, CUT), ["tod_id", "det"]).collect()}
    assert got == brute_cover(rows)


def test_cover_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], CUT), ["tod_id", "det"]).count() == 0


def test_cover_touching_and_full(spark):
    rows = [("t", 1, 0, 10, 20, ""), ("t", 1, 10, 20, 20, ""), ("t", 2, 3, 3, 20, ""), ("t", 3, 5, 6, 20, "")]
    got = sorted(tuple(x) for x in periods_and_gaps(spark.createDataFrame(rows, CUT), ["tod_id", "det"]).collect())
    assert got == [("t", 1, "period", 0, 20), ("t", 3, "gap", 0, 5), ("t", 3, "gap", 6, 20), ("t", 3, "period", 5, 6)]


def day(n, h=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=h)


def test_orphans_random(spark):
    r = random.Random(2)
    listed = [(r.choice("abcd"), day(r.randrange(20)) if r.random() > 0.05 else None, day(r.randrange(30)) if r.random() < 0.6 else None) for _ in range(40)]
    listed += listed[:5] + [(None, day(1), None)]
    refs = [("t", r.choice(["a", "b", "c", "d", "hot", None]), day(r.randrange(30), r.randrange(24)) if r.random() > 0.05 else None, i) for i in range(300)]
    refs += [("t", "a", a, 1000 + i) for i, (k, a, b) in enumerate(listed) if k == "a" and a] + [("t", "a", b, 2000 + i) for i, (k, a, b) in enumerate(listed) if k == "a" and b]
    refs += refs[:10]
    d = listing_deltas(spark.createDataFrame(listed, "key string, added timestamp_ntz, removed timestamp_ntz"), "t", F.col("key"))
    got = {tuple(x) for x in orphans_at(spark.createDataFrame(refs, "tbl string, key string, at timestamp_ntz, row_id long"), d).collect()}
    live = lambda k, t: any(x == k and a and a <= t and (b is None or t < b) for x, a, b in listed)
    want = {("t", 100 * t.year + t.month, i) for _, k, t, i in refs if k and t and not live(k, t)}
    assert got == want and any(k == "hot" for _, k, t, i in refs)


def test_orphans_empty_and_report(spark):
    none = spark.createDataFrame([], "key string, added timestamp_ntz, removed timestamp_ntz")
    refs = spark.createDataFrame([("t", "a", day(0), 1), ("t", "a", day(40), 2)], "tbl string, key string, at timestamp_ntz, row_id long")
    found = orphans_at(refs, listing_deltas(none, "t", F.col("key")))
    assert sorted(tuple(x) for x in orphan_report(found).collect()) == [("t", 202001, 1), ("t", 202002, 1)]
    assert orphans_at(refs.limit(0), listing_deltas(none, "t", F.col("key"))).count() == 0


def test_ledger_folds_in_any_order(spark):
    kind = "tbl string, key string, d_refs int, d_exists int"
    rows = [("t", "a", 1, 0), ("t", "a", 0, 1), ("t", "b", 1, 0), ("t", "c", 1, 0), ("t", "c", -1, 0), ("t", "d", 1, 0), ("t", "d", 0, 1), ("t", "d", 0, -1)]
    one = fold_counts(None, spark.createDataFrame(rows, kind))
    two = fold_counts(fold_counts(None, spark.createDataFrame(rows[4:], kind)), spark.createDataFrame(rows[:4], kind))
    f = lambda d: sorted(tuple(x) for x in d.collect())
    assert f(one) == f(two) and [x["key"] for x in current_orphans(one).orderBy("key").collect()] == ["b", "d"]


def stream_fixture(seed, n=300):
    r = np.random.default_rng(seed)
    x = 1e6 + 3000 * np.sin(np.arange(n) / 15) + np.cumsum(r.normal(0, 20, n)) + r.normal(0, 100, n)
    return x


def test_spike_mask_finds_spikes_and_keeps_shifts_and_bumps():
    x = stream_fixture(1)
    x += 8000 * np.exp(-0.5 * ((np.arange(300) - 220) / 12) ** 2)  # a slow passage
    x[150:] += 5000  # a level shift
    for i in (40, 41, 42, 43, 90, 260, 299):
        x[i] += 3000
    got = np.flatnonzero(spikes.spike_mask(x[None, :])[0])
    assert got.tolist() == [40, 41, 42, 43, 90, 260, 299]


@pytest.mark.parametrize("block,halo", [(1 << 16, 256), (64, 48)])
def test_stream_outliers(spark, block, halo):
    x = stream_fixture(3)
    x[10], x[20], x[200] = np.nan, 3e8, x[200] - 4000
    x[55:66] = x[55]  # crosses the border of a block of 64
    x[120:127] = x[120]  # one too few
    rows = [("t", 1, i, float(v), "k") for i, v in enumerate(x)]
    rows += [("t", 1, None, 5.0, "k"), ("t", None, 3, 5.0, "k"), ("t", 1, 400, None, "k"), *rows[:30], *[("u", 1, i, 7.0, "k") for i in range(9)], ("s", 1, 0, float("inf"), "k")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "tod_id string, det_uid int, samp int, data double, flags string")
    got = {(a, c): f for a, b, c, f in spikes.stream_outliers(df, ["tod_id", "det_uid"], "samp", "data", block=block, halo=halo, rows=50).collect()}
    want = {("t", 10): 1, ("t", 20): 1, ("t", 200): 4, **{("t", i): 2 for i in range(55, 66)}, **{("u", i): 2 for i in range(9)}, ("s", 0): 1}
    assert got == want


@pytest.mark.parametrize("gap", [1, 40])
def test_blocks_of_a_stream_agree_with_the_whole(spark, gap):
    """Several blocks, also with positions far apart, sparse stretches and a stream that is mostly at rest: the same as one block."""
    r = np.random.default_rng(8)
    x = 1e6 + 3000 * np.sin(np.arange(1500) / 15) + np.cumsum(r.normal(0, 20, 1500)) + r.normal(0, 100, 1500)
    x[:600] = x[:600] * 0.5 + 5e5 + r.normal(0, 20, 600)  # noise differs between blocks
    x[[70, 127, 128, 700, 1401]] += 2500
    x[252:260] = x[252]
    rows = [("t", 1, i * gap if i < 1000 else 200_000 + i * gap * 3, float(v)) for i, v in enumerate(x)]
    rest = np.where(r.random(700) < 0.3, r.normal(0, 1, 700), 0.0)
    rest[::5] = np.arange(140) * 1e-3
    rest[[333, 650]] = 40.0
    rows += [("u", 2, i * gap, float(v)) for i, v in enumerate(rest)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "tod_id string, det_uid int, samp int, data double")
    run = lambda block: {tuple(r) for r in spikes.stream_outliers(df, ["tod_id", "det_uid"], "samp", "data", block=block, halo=64, rows=100).collect()}
    whole = run(1 << 24)
    assert run(256) == whole and {("t", 1, gap * i, 4) for i in (70, 127, 700)} <= whole and len({k for k, *_ in whole}) == 2


def test_stream_outliers_empty(spark):
    df = spark.createDataFrame([], "tod_id string, det_uid int, samp int, data double")
    assert spikes.stream_outliers(df, ["tod_id", "det_uid"], "samp", "data").count() == 0


@pytest.mark.parametrize("block", [8 * 86400, 5])
def test_series_outliers(spark, block, monkeypatch):
    if block == 5:  # as with more sources than are broadcast
        monkeypatch.setattr(spikes, "few_groups", lambda *a: False)
    r = np.random.default_rng(5)
    v = 3 + r.normal(0, 0.2, 200)
    v[20:24] = v[20]
    v[60:63] = v[60]
    v[100], v[120], v[140], v[150] = np.nan, 0.2, 30.0, np.inf
    rows = [("pa", 1, f"t{i:03d}", i, float(x)) for i, x in enumerate(v)] + [("pa", 1, "t500", 500, None), ("pa", None, "t1", 1, 9.0), ("pa", 2, "t0", 0, 4.0)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "pa string, det_uid int, tod_id string, ctime long, kurtosis double")
    got = {(x["det_uid"], x["tod_id"]): x["flags"] for x in spikes.series_outliers(df, ["pa", "det_uid"], "tod_id", "ctime", "kurtosis", block=block).collect()}
    assert got == {**{(1, f"t{i:03d}"): 2 for i in range(20, 24)}, (1, "t100"): 1, (1, "t120"): 1, (1, "t140"): 4, (1, "t150"): 1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=0, max_size=40))
def test_reading_flags_never_fail(values):
    x = np.array(values, float)
    starts = np.array([0] if len(x) else [], int)
    assert len(spikes.reading_flags(starts, x, 2.0**27, 8, 10.0)) == len(x)


def test_limits_need_no_key(spark):
    bad = [(None, 1, "t1", 1, 0.5), ("pa", None, "t2", 2, float("nan")), ("pa", 1, "t3", None, float("inf")), ("pa", 1, None, 4, -1.0)]
    rows = bad + bad[:1] + [("pa", None, f"u{i}", i, 9.0) for i in range(6)] + [("pa", 1, "t5", 5, 0.5), (None, 1, "t6", 6, None)]
    df = spark.createDataFrame(rows, "pa string, det_uid int, tod_id string, ctime long, kurtosis double")
    got = spikes.series_outliers(df, ["pa", "det_uid"], "tod_id", "ctime", "kurtosis").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(*r[:3], 1) for r in [*bad, rows[-2]]]))
