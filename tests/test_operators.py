"""Properties and documented values of the operators."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import angles, physics, text, time
from driftline.operators import intervals, joins, lists, mapping, ordered, select, spectral
from driftline.sources import archive
from driftline.sources import text as src

K = ["k"]


def ranges(spark, rows):
    return spark.createDataFrame(rows, "k int, start int, stop int")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_documented_values(spark):
    one = spark.range(1).select(
        physics.rj_to_cmb(F.lit(150e9)).alias("rj"), text.explode_bits(F.lit([0, 1, 5, 15]), 3).alias("bits"), time.text_ctime(F.lit("2010-01-01 00:00:00")).alias("t"),
        angles.parse_sexagesimal(F.lit("-00:30:00")).alias("s"), angles.format_sexagesimal(F.lit(-0.5)).alias("f"), physics.bessel_j1(F.lit(3.0)).alias("j"), physics.next_regular(F.lit(32973)).alias("n"),
    ).first()
    assert abs(one["rj"] - 1.7351210431239954) < 2e-3 and one["bits"] == [35, 128, 0] and one["t"] == 1262304000
    assert one["s"] == -0.5 and one["f"] == "-00:30:00.00" and abs(one["j"] - 0.33905895852593645) < 1e-12 and one["n"] == 33000


def test_interval_properties(spark):
    r = [(1, 3, 5), (1, 5, 9), (1, 20, 22), (1, 21, 25), (2, 0, 100), (3, 99, 120), (3, -5, 2), (5, 7, 7)]
    axis = spark.createDataFrame([(k, 100) for k in (1, 2, 3, 4)], "k int, nsamps int")
    m = intervals.merge_ranges(intervals.clamp(ranges(spark, r), axis, K), K)
    assert rows_of(m) == [(1, 3, 9), (1, 20, 25), (2, 0, 100), (3, 0, 2), (3, 99, 100)]
    c = intervals.complement(m, axis, K)
    assert rows_of(c) == [(1, 0, 3), (1, 9, 20), (1, 25, 100), (3, 2, 99), (4, 0, 100)]
    assert rows_of(intervals.complement(c, axis, K)) == rows_of(m)
    assert rows_of(intervals.merge_ranges(m, K)) == rows_of(m)
    assert rows_of(intervals.ranges_of_mask(intervals.mask_of_ranges(m, axis, K), K, "samp", F.lit(True))) == rows_of(m)
    assert {x["k"]: x["cut"] for x in intervals.always_cut(m, axis, K).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_flags_beyond_eight_bits(spark):
    bits = {f"f{i}": i for i in range(12)}
    rows = [(1, f"f{i}", i, i + 10) for i in range(12)] + [(1, "f3", 5, 9), (2, "f11", 0, 40), (2, "f0", 39, 80)]
    flags = spark.createDataFrame(rows, "k int, flag string, start int, stop int")
    axis = spark.createDataFrame([(1, 40), (2, 40), (3, 40)], "k int, nsamps int")
    packed = intervals.pack_flags(flags, axis, K, bits)
    back = intervals.unpack_flags(packed, axis, K, bits)
    want = intervals.merge_ranges(intervals.clamp_flags(flags, axis, K, bits), ["k", "flag"])
    assert rows_of(back) == rows_of(want)
    assert [tuple(x) for x in packed.where("k = 3").collect()] == [(3, 0, 0)]


def test_fill_and_jumps(spark):
    x = [float(2 * i) for i in range(40)]
    bad = [v if not 10 <= i < 14 else 999.0 for i, v in enumerate(x)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(bad)], "k int, samp int, x double")
    got = ordered.fill_ranges(df, ranges(spark, [(1, 10, 14)]), K, "samp", "x", 5)
    assert [r["x"] for r in got.orderBy("samp").collect()] == pytest.approx(x)
    whole = ordered.fill_ranges(df, ranges(spark, [(1, 0, 40)]), K, "samp", "x", 5)
    assert all(r["x"] is None for r in whole.collect())
    steps = spark.createDataFrame([(1, i, 0.0 if i < 20 else 10.0) for i in range(40)], "k int, samp int, x double")
    j = ordered.jump_statistic(steps, K, "samp", "x", 5).first()
    assert j["jump"] == 10.0
    fixed = ordered.remove_jumps(steps, ordered.quantised_jumps(ordered.step_jumps(steps, K, "samp", "x", 1, 5.0), 10.0, 0.1), K, "samp", "x", 10.0)
    assert {r["x"] for r in fixed.collect()} == {0.0}
    w = ordered.unwrap(spark.createDataFrame([(1, i, float((7 * i) % 16)) for i in range(30)], "k int, samp int, x double"), K, "samp", "x", 16.0)
    assert [r["x"] for r in w.orderBy("samp").collect()] == [7.0 * i for i in range(30)]


def test_nearest_reading_clamps_and_ties(spark):
    q = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 99.0), (1, 12.0), (2, 0.0), (1, None)], "k int, t double")
    r = spark.createDataFrame([(1, 0.0, 10), (1, 10.0, 20), (1, 10.0, 25), (1, 20.0, 30)], "k int, t double, v int")
    for block in (86400.0, 3.0):
        got = {(x["k"], x["t"]): (x["v"], x["dt"]) for x in joins.nearest_reading(q, r, K, "t", "v", block).collect()}
        assert got[1, -5.0] == (10, 5.0) and got[1, 5.0] == (25, 5.0) and got[1, 99.0] == (30, -79.0) and got[1, 12.0] == (25, -2.0) and got[2, 0.0] == (None, None)


def test_interval_lookup_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "i int, t double")
    iv = spark.createDataFrame([(0, 5.0, 10.0, "a"), (1, 8.0, 20.0, "b"), (2, 20.0, 21.0, "c")], "ord int, t0 double, t1 double, tag string")
    want = {i: "a" if 5 <= i < 10 else "b" if 8 <= i < 20 else "c" if i == 20 else None for i in range(40)}
    for small in (50_000, 1):
        monkeypatch.setattr(joins, "SMALL", small)
        monkeypatch.setattr(joins.bounded, "__defaults__", (small,))
        assert {x["i"]: x["tag"] for x in joins.interval_lookup(df, iv, "t", ["tag"]).collect()} == want
        twice = df.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).unionByName(spark.createDataFrame([(99, None, 1)], "i int, t double, k int"))
        keyed = joins.interval_lookup(twice, iv.withColumn("k", F.lit(1)), "t", ["tag"], ["k"]).collect()
        assert len(keyed) == 81 and all(x["tag"] == (want.get(x["i"]) if x["k"] == 1 else None) for x in keyed)


def test_selection_and_lists(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, s string")
    assert select.select_outer(df, {"nothere": 1}).count() == 0
    assert select.select_outer(df, {"s": None}).count() == 1 and select.select_outer(df, {"s": ["a", None]}).count() == 2
    req = spark.createDataFrame([(0, "b"), (1, "zz"), (2, None)], "ord int, s string")
    got = [tuple(r) for r in select.select_inner(spark.createDataFrame([(7, "b"), (5, "b"), (9, None)], "i int, s string"), req, ["s"], "i").orderBy("ord").collect()]
    assert got == [(0, 5, True), (1, -1, False), (2, 9, True)]
    a = spark.createDataFrame([(0, "d/x.zip"), (1, "y"), (2, "x")], "ord int, name string")
    b = spark.createDataFrame([(0, "z"), (1, "x"), (2, "z")], "ord int, name string")
    assert rows_of(lists.list_union(a, b)) == [(0, 0, "d/x.zip"), (0, 1, "y"), (0, 2, "x"), (1, 0, "z"), (1, 2, "z")]
    assert rows_of(lists.list_minus(a, b)) == [(1, "y"), (2, "x")] and rows_of(lists.list_intersect(a, b)) == [(1, "d/x.zip")]
    assert lists.job_ranges(10, 3) == [(0, 3), (3, 6), (6, 10)]


def test_map_solution_recovers_the_sky(spark):
    r = np.random.default_rng(0)
    sky = r.normal(size=(6, 5))
    sky -= sky.mean()
    rows = [(d, int(i), int(j), float(sky[i, j] + off)) for d, off in enumerate(r.normal(0, 100, 8)) for i, j in zip(r.integers(0, 6, 60), r.integers(0, 5, 60))]
    m, story = mapping.solve_map(spark.createDataFrame(rows, "det int, i0 int, i1 int, value double"), ["det"], rounds=30, tolerance=1e-18)
    got = np.zeros((6, 5))
    for x in m.collect():
        got[x["i0"], x["i1"]] = x["x"]
    assert np.allclose(got - got.mean(), sky, atol=1e-6) and story[-1] < story[0]


def test_kernels():
    x = np.sin(np.arange(512) / 9) + 0.01 * np.arange(512)
    assert np.allclose(spectral.filtered(x, np.ones_like, 10.0), x)
    assert np.allclose(spectral.filtered(spectral.filtered(x, np.ones_like, 10.0, 0.05, ends=1), np.ones_like, 10.0, 0.05, False, ends=1), x, atol=0.05)
    y = np.random.default_rng(0).normal(size=4000)
    y[2000] += 200
    a, b = spectral.glitch_ranges(y, 400.0)
    assert len(a) == 1 and a[0] < 2000 < b[0]
    f, p = spectral.power_spectrum(np.random.default_rng(1).normal(size=20000), 10.0, 256)
    assert abs(p[5:-5].mean() - 2 / 10.0) < 0.02
    t = np.linspace(-5, 5, 80)
    fit = spectral.least_squares(lambda q, u: q[0] * np.exp(-0.5 * ((u - q[1]) / q[2]) ** 2), np.array([1.0, 0.5, 1.0]), t, 3 * np.exp(-0.5 * ((t - 1) / 0.7) ** 2))
    assert np.allclose(fit, [3, 1, 0.7], atol=1e-5)
    held = spectral.least_squares(lambda q, u: q[0] + q[1] * u, np.array([0.0, 2.0]), t, 1 + 3 * t, np.array([True, False]))
    assert held[1] == 2.0
    chain = spectral.metropolis(lambda q: -0.5 * float(q @ q), np.zeros(1), np.ones(1), 4000)
    assert abs(chain.std() - 1) < 0.15
    m = np.outer([1.0, 2.0, 3.0], np.sin(np.arange(100) / 5)) + np.random.default_rng(2).normal(0, 1e-3, (3, 100))
    e, w, modes = spectral.principal_modes(m, 2)
    assert e[0] > 1000 * e[1] and np.allclose(w[:, 0] / w[0, 0], [1, 2, 3], atol=0.01)
    c = (1.7, 0.73, 1.6, 0.68)
    flat = spectral.biquad_filter(np.full(50, 3.0), c)
    assert np.allclose(flat, 3.0) and abs(spectral.biquad_response(np.array([0.0]), 400.0, c)[0] - 1) < 1e-9


def test_peaks_of_one_reading(spark):
    """A lone reading leaves height, place and width open; it is fitted none the less, and the streams beside it too."""
    lone = {n: 1e5 * (np.arange(n) == n // 2) for n in range(11, 40)}
    wide = 3 * np.exp(-0.5 * ((np.arange(400) - 200.5) / 4) ** 2)
    rows = [(n, i, float(v)) for n, x in [*lone.items(), (400, wide)] for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, samp int, x double")
    got = {r["k"]: r for r in spectral.fit_peaks(df, ["k"], "samp", "x").collect()}
    assert set(got) == {*lone, 400}
    for n in lone:
        r = got[n]
        assert np.isfinite([r["at"], r["height"], r["sigma"], r["snr"]]).all()
        assert abs(r["height"] * np.exp(-0.5 * ((n // 2 - r["at"]) / r["sigma"]) ** 2) / 1e5 - 1) < 1e-3
    assert np.allclose([got[400][c] for c in ("at", "height", "sigma")], [200.5, 3, 4], atol=1e-3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # streams begin, end and go on at the edges of batches
    try:
        assert {r["k"]: r for r in spectral.fit_peaks(df, ["k"], "samp", "x", many=3).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_biquad_gain_matches_response(spark):
    c, f = (1.7, 0.73, 1.6, 0.68), [0.0, 3.0, 40.0, 150.0]
    got = spark.createDataFrame([(x,) for x in f], "f double").select(physics.biquad_gain(F.col("f"), 400.0, c).alias("g")).collect()
    assert np.allclose([r["g"] for r in got], np.abs(spectral.biquad_response(np.array(f), 400.0, c)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=60))
def test_filter_keeps_length(values):
    assert len(spectral.filtered(np.array(values), lambda f: spectral.sine2_low(f, 1.0, 0.5), 8.0)) == len(values)


def test_text_formats(spark, tmp_path):
    p = tmp_path / "a.cuts"
    p.write_text("format = 'cuts'\nn_samp = 100\nEND\n0: (0,5) (7,9)\n3: \n12: (-3,4)\njunk\n")
    head, cuts = src.parse_cuts(src.text_lines(spark, str(p)))
    assert {(r["key"], r["value"]) for r in head.collect()} == {("format", "'cuts'"), ("n_samp", "100")}
    assert sorted((r["det_uid"], r["start"], r["stop"]) for r in cuts.collect()) == [(0, 0, 5), (0, 7, 9), (12, -3, 4)]
    q = tmp_path / "b.txt"
    q.write_text("# a b c\n1 2.5 x\n2 oops y\n\n3 4 z\n")
    lines = src.text_lines(spark, str(q))
    assert src.infer_types(lines, 3) == ["bigint", "string", "string"]
    assert [tuple(r)[2:] for r in src.read_columns(lines, {"a": (0, "int"), "b": (1, "double")}).orderBy("line").collect()] == [(1, 2.5), (2, None), (3, 4.0)]
    run = tmp_path / "c.run"
    run.write_text("<FRAMEACQ>\n <RC> 1 2 3\n <RUN_ID> 7\n</FRAMEACQ>\n<IV>\n <RC> 4\n</IV>\n")
    got = sorted((r["block"], r["key"], r["item"], r["value"]) for r in src.parse_run_file(src.text_lines(spark, str(run))).collect())
    assert got == [("FRAMEACQ", "RC", 0, "1"), ("FRAMEACQ", "RC", 1, "2"), ("FRAMEACQ", "RC", 2, "3"), ("FRAMEACQ", "RUN_ID", 0, "7"), ("IV", "RC", 0, "4")]
    assert src.report_columns("# name | n | x", "# str | int | float") == [("name", "string"), ("n", "bigint"), ("x", "double")]
    conf = src.parse_config("root = '/a'\npath = '%(root)s/b'\nn = [1, 2]\nbad = __import__('os').getcwd()\n")
    assert conf["path"] == "/a/b" and conf["n"] == [1, 2] and isinstance(conf["bad"], str)
    assert src.get_deep(src.set_deep({}, "a.b.c", 5), "a.b.c") == 5 and src.get_deep({}, "x.y", 3) == 3
    assert [r["name"] for r in archive.observation_list(spark, "list", ["u", "v"]).collect()] == ["u", "v"]


@pytest.mark.parametrize("zipped", [False, True])
def test_channel_folder(spark, tmp_path, zipped):
    import zipfile

    d = tmp_path / "tod"
    d.mkdir()
    np.arange(100, dtype="<f4").tofile(d / "az")
    (np.arange(10, dtype="<i4") * 7).tofile(d / "slow")
    (d / "format").write_text("az RAW f 10\nslow RAW S 1\nsum LINCOM 1 az\n")
    path = str(d)
    if zipped:
        path = str(tmp_path / "tod.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in os.listdir(d):
                z.write(d / f, f)
    t = archive.read_channels(spark, path)
    assert {r["channel"]: (r["n_frames"], r["spf"], r["n_bonus"]) for r in archive.frames_of(t).collect()} == {"az": (10, 10, 0), "slow": (10, 1, 0)}
    got = archive.read_channels(spark, path, ["az"], 90, 95).orderBy("samp").collect()
    assert [r["value"] for r in got] == [90.0, 91.0, 92.0, 93.0, 94.0]
    with pytest.raises(ValueError):
        archive.same_rate(t)
    tail = archive.sample_range(archive.read_channels(spark, path, ["az"]), 100, -3)
    assert sorted((r["samp"], r["value"]) for r in tail.collect()) == [(0, 97.0), (1, 98.0), (2, 99.0)]


def test_frames(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(archive.write_frames([[1, 2, 3, 4], [5, 6, 7, -8]], [0] * 3))
    got = [(r["frame"], r["row"], r["col"], r["word"]) for r in archive.read_frames(spark, str(tmp_path / "f.bin"), 3, 2, 2).orderBy("frame", "row", "col").collect()]
    assert got == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3), (0, 1, 1, 4), (1, 0, 0, 5), (1, 0, 1, 6), (1, 1, 0, 7), (1, 1, 1, -8)]


def test_archive(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path / "arc"))
    df = lambda *ks: spark.createDataFrame([(k, i) for k in ks for i in range(3)], "tod_id string, v int")
    assert not a.has("x")
    a.put(df("x", "y"), "cuts", 2)
    a.put(df("y", "z"))
    assert sorted(r[0] for r in a.keys().collect()) == ["x", "y", "z"] and a.get("y").count() == 3 and a.get("x").first()["_version"] == 2
    with pytest.raises(ValueError):
        a.put(df("x"), clobber=False)
    a.delete(["x"])
    assert not a.has("x") and a.has("z")
    b = archive.Archive(spark, str(tmp_path / "arc2"))
    b.put(df("q"))
    b.join_from(a)
    assert sorted(r[0] for r in b.keys().collect()) == ["q", "y", "z"]
    with pytest.raises(KeyError):
        b.get("nope")
    assert archive.depot_path("/r", "cuts", "v1", "1104544902.x") == "/r/cuts/v1/11045/1104544902.x"


def test_order_statistics_agree_and_stand_skew(spark):
    from driftline.operators import stats

    r = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.exp(3 * r.normal(size=500)) * np.where(r.random(500) < 0.3, -1, 1)] + [("ties", float(v)) for v in r.integers(-2, 3, 200)]
    rows += [(None, 1.0), (None, 2.0), ("hot", None), ("one", 0.0), ("big", 1e308), ("big", -1e308), ("big", 5e-324)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"lo": F.expr("n div 4"), "med": F.expr("n div 2"), "hi": F.expr("3 * n div 4")}
    key = lambda d: sorted((tuple(x) for x in d.collect()), key=str)
    assert key(stats.order_statistics(df, K, "v", at)) == key(stats.order_statistics(df, K, "v", at, spread=True))
    med = {x["k"]: x["median"] for x in stats.group_median(df, K, "v").collect()}
    assert med["hot"] == float(np.median([v for k, v in rows if k == "hot" and v is not None])) and med[None] == 1.5
    assert stats.order_statistics(df.limit(0), K, "v", at, spread=True).count() == 0


def test_scans(spark):
    from driftline.operators import scans

    df = spark.createDataFrame([(1, i, float(i if i < 5 else 10 - i)) for i in range(11)] + [(2, 0, 7.0)], "k int, samp int, x double")
    assert [x["direction"] for x in scans.scan_direction(df, K, "samp", "x").orderBy("k", "samp").collect()] == [1] * 5 + [0] + [-1] * 5 + [None]
    filled = scans.gaps_filled(df, K, "samp", "x", ~F.col("samp").isin(0, 3, 4, 5, 10))
    assert [x["x"] for x in filled.where("k = 1").orderBy("samp").collect()] == pytest.approx([1, 1, 2, 2.5, 3, 3.5, 4, 3, 2, 1, 1])
    image = np.random.default_rng(0).normal(size=(16, 16))
    assert np.allclose(scans.shifted(image, 2, 3), np.roll(image, (2, 3), (0, 1))) and scans.without_common_mode(image, 0.1, 2, 1).shape == image.shape
    assert abs(scans.without_common_mode(image, 0.1, 2, 1).mean() - image.mean()) < 1e-9


def test_spline():
    from driftline.operators.scans import natural_spline

    x = np.array([0.0, 1.0, 2.5, 4.0, 5.0])
    assert np.allclose(natural_spline(x, 3 * x - 1, np.linspace(-2, 7, 30)), 3 * np.linspace(-2, 7, 30) - 1)
    t = np.linspace(0, 6, 40)
    assert np.allclose(natural_spline(t, np.sin(t), np.linspace(0.5, 5.5, 77)), np.sin(np.linspace(0.5, 5.5, 77)), atol=1e-3)
    assert np.allclose(natural_spline(x, np.sin(x), x), np.sin(x))


def test_resampled_channel_is_whole(spark):
    # 1,000 and 7 samples at 3/4 of the rate: every one of them is read, those past the 500th output too
    n = {1: 1000, 2: 7}
    slow = spark.createDataFrame([(k, i, float(i)) for k, m in n.items() for i in range(m)], "k int, samp int, x double")
    want = sorted((k, o, o * 3 / 4 // 1) for k, m in n.items() for o in range(2 * m) if o * 3 // 4 < m)
    assert rows_of(joins.resample_join(slow, K, "samp", 3, 4).select("k", "samp", "x")) == want
    assert rows_of(joins.resample_join(slow, K, "samp", 3, 4, 500).select("k", "samp", "x")) == [r for r in want if r[1] < 500]
    # a higher rate than the grid's leaves samples out
    assert rows_of(joins.resample_join(slow, K, "samp", 3, 1).select("k", "samp", "x")) == sorted((k, o, o * 3.0) for k, m in n.items() for o in range(m) if o * 3 < m)


def test_resample_join_reads_past_sample_375(spark, tmp_path):
    from driftline.plans import signals

    spark.createDataFrame([("t", 1, i, float(i)) for i in range(420)], "tod_id string, det_uid int, samp int, data float").write.parquet(f"{tmp_path}/samples.parquet")
    got = signals.QUERIES["resample_join"](spark, str(tmp_path))
    assert got.count() == 560 and got.agg(F.max("x")).first()[0] == 419.0


def test_cuts_from_before_the_tod_are_clamped(spark, tmp_path):
    from driftline.plans import scans, signals

    cuts = [("t", 1, -100, 240, 8000), ("t", 1, 4000, 4080, 8000), ("t", 2, -200, -100, 8000), ("t", 2, 7920, 9000, 8000), ("t", 3, -5, 8400, 8000), ("t", 4, None, 800, 8000)]
    spark.createDataFrame(cuts, "tod_id string, det int, start int, stop int, nsamps int").write.parquet(f"{tmp_path}/cuts.parquet")
    spark.createDataFrame([("t", k, i, float(i)) for k in (1, 2) for i in range(100)], "tod_id string, det_uid int, samp int, data float").write.parquet(f"{tmp_path}/samples.parquet")
    run = lambda m, n: m.QUERIES[n](spark, str(tmp_path))
    assert rows_of(signals.low_cuts(spark, str(tmp_path)).select("det_uid", "start", "stop")) == [(1, 0, 3), (1, 50, 51), (2, 99, 100), (3, 0, 100)]
    assert {r["det_uid"]: r["n"] for r in run(signals, "samples_cut").collect()} == {1: 4, 2: 1}
    assert {r["det_uid"]: r["n"] for r in run(signals, "samples_uncut").collect()} == {1: 96, 2: 99}
    filled = {r["samp"]: r["x"] for r in run(signals, "fill_cuts").where("det_uid = 1").collect()}
    assert filled[0] == filled[2] == 6.5 and filled[10] == 10.0  # the mean of the eight samples behind the cut
    assert sorted(r["samp"] for r in run(signals, "mask_of_cuts").where("det_uid = 1").collect()) == [0, 1, 2, 50]
    assert {r["det_uid"] for r in run(scans, "turnaround_clear").collect()} == {1, 2, 3}


def test_mask_of_cuts_has_the_axis_of_each_tod(spark, tmp_path):
    from driftline.plans import signals

    cuts = [("long", 1, 36000, 50000, 80000), ("long", 1, 79920, 90000, 80000), ("short", 1, 790, 900, 850)]
    spark.createDataFrame(cuts, "tod_id string, det int, start int, stop int, nsamps int").write.parquet(f"{tmp_path}/cuts.parquet")
    got = signals.QUERIES["mask_of_cuts"](spark, str(tmp_path))
    assert rows_of(got.select("tod_id", "samp")) == [("long", i) for i in [*range(450, 625), 999]] + [("short", 9)]
