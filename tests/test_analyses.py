"""Kernels of spectra, modes, filters and FITS files against plain computations on small fixtures."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import joins, pathology, season, spectral, stats, tods
from driftline.sources import fits


def waves(n_det=12, n=512, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n) / 8
    common = np.sin(2 * np.pi * 0.11 * t) + 0.5 * np.sin(2 * np.pi * 0.31 * t + 1)
    gains = 1 + 0.1 * np.arange(n_det)
    return gains[:, None] * common + 0.01 * r.normal(size=(n_det, n)), gains


def frame(spark, m, extra=None):
    rows = [("t", d, i, float(v), bool(extra is not None and extra[d])) for d, row in enumerate(m) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "tod_id string, det_uid int, samp int, x double, dark boolean")


@pytest.mark.parametrize("leading", [True, False])
def test_low_frequency_finds_gains_and_takes_off_dark_modes(spark, leading):
    m, gains = waves()
    r = np.random.default_rng(4)
    hum = np.cumsum(r.normal(size=m.shape[1])) * 0.05
    dark = np.arange(12) >= 9
    m[9:] = hum + 0.001 * r.normal(size=(3, m.shape[1]))
    live = m[:9] + hum
    live[8] = r.normal(size=m.shape[1])  # follows nothing
    df = frame(spark, np.vstack([live, m[9:]]), dark)
    found = pathology.low_frequency(df, ["tod_id"], "det_uid", "samp", "x", 8.0, [(0.05, 0.5), (0.2, 0.6)], leading=leading, dark="dark", dark_modes=1)
    got = {r["det"]: r for r in pathology.over_windows(found, ["tod_id"]).collect()}
    assert set(got) == set(range(12)) and [d for d, r in got.items() if r["preselected"]] == list(range(8)) or {d for d, r in got.items() if r["preselected"]} == set(range(8))
    ratio = np.array([got[d]["gain"] for d in range(8)]) / gains[:8]
    assert np.allclose(ratio, ratio.mean(), rtol=0.02) and all(got[d]["corr"] > 0.99 for d in range(8))
    assert all(r["ratio"] < 0.2 for r in found.where("window = 0 and det >= 9").collect())


def test_high_frequency_modes_and_groups(spark):
    m, _ = waves()
    r = np.random.default_rng(1)
    hum = np.sin(2 * np.pi * 3.0 * np.arange(512) / 8)
    a = {r["det"]: r["rms"] for r in pathology.high_frequency(frame(spark, m + hum), ["tod_id"], "det_uid", "samp", "x", 8.0, (2.0, 4.0)).collect()}
    b = {r["det"]: r["rms"] for r in pathology.high_frequency(frame(spark, m + hum), ["tod_id"], "det_uid", "samp", "x", 8.0, (2.0, 4.0), modes=1).collect()}
    assert all(b[d] < 0.1 * a[d] for d in a)
    other = np.cumsum(r.normal(size=512)) * 0.1
    m[6:] = other * (1 + np.arange(6))[:, None] + 0.001 * r.normal(size=(6, 512))
    g = {r["det"]: r["group"] for r in pathology.grouped_detectors(frame(spark, m), ["tod_id"], "det_uid", "samp", "x", 8.0, (0.02, 0.6), few=3).collect()}
    assert len({g[d] for d in range(6)}) == 1 and len({g[d] for d in range(6, 12)}) == 1 and g[0] != g[6]


def test_harmonics_of_a_scan_and_tapers():
    assert pathology.harmonic_bins(10, 40, 0.01, 0.1).tolist() == [0, 10, 20]
    assert pathology.harmonic_bins(10, 40, 0.01, 0.1, wide=True).tolist() == [0, 1, 9, 10, 11, 19, 20, 21, 29]
    t = pathology.edge_taper(60, 6)
    assert t[10:50].min() == 1 and t[0] < 0.02 and np.allclose(t, t[::-1])


def test_biquad_equals_the_recurrence():
    r = np.random.default_rng(2)
    x = 50 + np.cumsum(r.normal(size=1000))
    b = (1.9, 0.92, 1.8, 0.85)
    want = x
    for p, q in ((b[0], b[1]), (b[2], b[3])):
        g, y = (1 - p + q) / 4, np.empty(len(x))
        x1 = x2 = y1 = y2 = want[0]
        for i, v in enumerate(want):
            y[i] = g * (v + 2 * x1 + x2) + p * y1 - q * y2
            x1, x2, y1, y2 = v, x1, y[i], y1
        want = y
    for n in (1, 2, 255, 257, 1000):
        assert np.allclose(spectral.biquad_filter(x[:n], b), want[:n], rtol=1e-10)


def test_filter_taps_and_half_power():
    from driftline.functions import physics

    b, r = (1.2, 0.5, 1.1, 0.4), np.random.default_rng(5)
    x = 10 + r.normal(size=600)
    assert np.allclose(spectral.fir_filtered(x, 400.0, b), spectral.biquad_filter(x, b), atol=1e-6)
    f = physics.half_power(400.0, b)
    assert abs(spectral.biquad_response(np.array([f]), 400.0, b)[0]) ** 2 == pytest.approx(0.5)


def test_names_are_substituted_until_nothing_is_left():
    from driftline.sources.text import substituted

    tree = {"root": "/data", "year": 2015, "path": "{root}/{year}", "sub": {"file": "{path}/x.txt", "n": [1, "{year}", "{none}"]}}
    assert substituted(tree) == {"root": "/data", "year": 2015, "path": "/data/2015", "sub": {"file": "/data/2015/x.txt", "n": [1, "2015", "{none}"]}}
    with pytest.raises(ValueError):
        substituted({"a": "{b}x", "b": "{a}"})


def test_channels_are_read_on_the_grid_of_another_rate(spark, tmp_path):
    from driftline.sources.archive import read_resampled

    (tmp_path / "format").write_text("fast RAW d 8\nslow RAW s 2\n")
    np.arange(32, dtype="<f8").tofile(tmp_path / "fast")
    np.arange(8, dtype="<i2").tofile(tmp_path / "slow")
    got = read_resampled(spark, str(tmp_path), ["fast", "slow"], 4).collect()
    by = {c: [r["value"] for r in sorted(got, key=lambda r: r["samp"]) if r["channel"] == c] for c in ("fast", "slow")}
    assert by["fast"] == [2.0 * i for i in range(16)] and by["slow"] == [i // 2 for i in range(16)]
    part = read_resampled(spark, str(tmp_path), ["slow"], 4, 3, 6).orderBy("samp").collect()
    assert [(r["samp"], r["value"]) for r in part] == [(0, 1.0), (1, 2.0), (2, 2.0)]


def test_modes_are_appended_orthonormal():
    r = np.random.default_rng(3)
    modes = np.zeros((0, 50))
    for _ in range(4):
        modes = spectral.appended(modes, r.normal(size=50))
    assert modes.shape == (4, 50) and np.allclose(modes @ modes.T, np.eye(4))
    assert len(spectral.appended(modes, modes[0] * 3 - modes[2])) == 4


@pytest.mark.parametrize("window", ["none", "hann", "welch", "bartlett"])
def test_section_power_keeps_the_variance_of_a_tone(window):
    t = np.arange(4096)
    x = 3 * np.sin(2 * np.pi * 100 * t / 1024)
    f, p = spectral.section_power(x, 0.5, 4, window)
    assert len(f) == 513 and abs(f[int(p.argmax())] - 100 / 512) < 0.002 and p.max() == pytest.approx(2 * 9 / 4 * 1024 * 0.5, rel=0.02)


def test_stray_positions_are_an_error():
    with pytest.raises(ValueError):
        spectral.on_grid(np.array([0, 1, 1 << 40]), np.ones(3))
    with pytest.raises(ValueError):
        spectral.on_grid(np.array([-3, 1]), np.ones(2))


def test_skew_score_of_a_symmetric_sample_is_zero(spark):
    assert spark.range(1).select(stats.skew_score(F.lit(0.0), F.lit(40.0))).head()[0] == 0.0


def test_first_rows_are_rows_of_the_table(spark):
    t = spark.createDataFrame([("a", 1, None, 9), ("a", 2, 5.0, 1), ("b", 7, 8.0, 3)], "k string, u int, v double, o int").coalesce(1)
    assert {tuple(r) for r in joins.first_rows(t, ["k"], ["u", "v"]).collect()} == {("a", 1, None), ("b", 7, 8.0)}
    assert {tuple(r) for r in joins.first_rows(t, ["k"], ["u", "v"], F.col("o")).collect()} == {("a", 2, 5.0), ("b", 7, 8.0)}
    q = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    got = {r["k"]: (r["u"], r["v"], r["found"]) for r in joins.lookup(q, t, ["k"], {"u": -1, "v": 0.5}).collect()}
    assert got == {"a": (1, 0.5, True), "c": (-1, 0.5, False), None: (-1, 0.5, False)}
    cal = season.calibration_chain(q, [("constant", 2.0, []), ("table", t.select("k", F.col("v").alias("cal")).where("cal is not null"), ["k"])])
    assert {r["k"]: r["cal"] for r in cal.collect()} == {"a": 10.0, "c": 0.0, None: 0.0}


@pytest.mark.parametrize("few", [True, False])
def test_rows_get_the_columns_of_their_group(spark, few):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [(None, 1), ("z", 2)], "k string, i int")
    groups = spark.createDataFrame([("a", 5.0), (None, 6.0)], "k string, v double")
    got = joins.with_groups(rows, groups, ["k"], few)
    assert got.columns == ["k", "i", "v"] and sorted(got.groupBy("v").count().collect(), key=str) == sorted([(5.0, 300), (6.0, 1), (None, 1)], key=str)
    assert joins.few_groups(rows, ["k"], 3) and not joins.few_groups(rows, ["k"], 2)


def test_calibration_steps_of_all_kinds(spark, tmp_path):
    from driftline.sources.archive import Depot

    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    depot = Depot(spark, str(tmp_path))
    depot.write(t([(1, 3.0), (2, float("nan"))], "det_uid int, cal double"), "Calibration", "v1", "1234567890.t")
    assert depot.check("Calibration", "v1", "1234567890.t") and not depot.check("Calibration", "v1", "9")
    products = {
        "array_data": t([(1, -1.0), (2, 1.0)], "det_uid int, optical_sign double"), "ff": t([(1, 2.0, True), (2, 5.0, False)], "det_uid int, cal double, stable boolean"),
        "depot": depot, "bands": t([("f1", 7.0)], "band string, cal double"), "file": t([(1, "11"), (2, "13")], "a int, b string"), "sub": [{"type": "constant", "value": 0.5}],
    }
    df = t([(1, "f1"), (2, "f1"), (1, "f2")], "det_uid int, band string")
    steps = [{"type": "constant", "value": 10}, {"cal_steps": [{"type": "array_data_parameter", "parameter": "optical_sign"}, {"type": "flatfield", "table": "ff", "fiducial": True}]}, {"type": "depot_cal", "tag": "v1", "name": "1234567890.t"}, {"type": "abscal", "table": "bands", "on": ["band"]}, {"type": "column_file", "table": "file", "columns": ["a", "b"]}, {"type": "reference", "name": "sub"}]
    got = season.calibration_chain(df, season.chain_steps(steps, products, ["det_uid"])).collect()
    assert {(r["det_uid"], r["band"]): r["cal"] for r in got} == {(1, "f1"): -10 * 2 * 3 * 7 * 11 * 0.5, (2, "f1"): 0.0, (1, "f2"): 0.0}
    with pytest.raises(ValueError):
        season.chain_steps({"type": "other"}, products, ["det_uid"])


def test_drift_of_streams_with_temperature_and_block_modes():
    r = np.random.default_rng(6)
    n = 400
    common, temp, hum, local = (np.cumsum(r.normal(size=n)) for _ in range(4))
    zero = lambda a: a - a.mean(-1, keepdims=True)
    gains = 1 + 0.1 * np.arange(10)
    c = np.outer(gains, common) + np.outer(np.arange(12)[:10] * 0.2, temp) + hum
    c[5:] += local
    m = zero(np.vstack([c, hum + 0.3 * temp, hum - 0.1 * temp]) + 0.01 * r.normal(size=(12, n)))
    live, dark = np.arange(12) < 10, np.arange(12) >= 10
    got = pathology.drift_of(m, live, dark, np.where(np.arange(12) < 5, 0, 1), temp, 2)
    plain = pathology.drift_of(m, live, dark, np.where(np.arange(12) < 5, 0, 1), temp, 0)
    assert (got["drift"][:10] < 0.05).all() and (got["drift"][:10] < 0.25 * plain["drift"][:10]).all()
    assert np.allclose(got["gain"], plain["gain"])


def test_fits_are_shifted_to_the_template_first(spark):
    truth = {f"d{i}": (i * 1.0, i * 0.5) for i in range(8)}
    rows = [(o, d, x + dx, y + dy, 2.0, True) for o, (dx, dy) in enumerate([(0, 0), (3, -1), (-2, 4)]) for d, (x, y) in truth.items()]
    rows += [(9, "d0", 100.0, 100.0, 1.0, True), (1, "lost", 1.0, float("nan"), 1.0, True), (2, "bad", 1.0, 1.0, 1.0, False), (1, "once", 4.0, 4.0, 1.0, True)]
    df = spark.createDataFrame(rows, "obs int, det string, x double, y double, tau double, ok boolean")
    got = {r["det"]: r for r in stats.combine_fits(df, "obs", "det", "x", "y", "tau", F.col("ok"), 0.5).collect()}
    assert set(got) == {*truth, "lost", "bad", "once"}
    for d, (x, y) in truth.items():
        assert got[d]["ok"] and got[d]["n_obs"] == 3 and got[d]["x"] == pytest.approx(x) and got[d]["y"] == pytest.approx(y) and got[d]["x_err"] == pytest.approx(0)
    assert not got["lost"]["ok"] and got["lost"]["n_obs"] == 0 and not got["bad"]["ok"] and got["once"]["n_obs"] == 1 and not got["once"]["ok"]


def test_combined_fits_do_not_depend_on_the_order_of_rows(spark):
    r = np.random.default_rng(4)
    rows = [(o, f"d{d}", float(r.normal(d, 0.1)), float(r.normal(0, 0.1)), float(r.lognormal()), True) for o in range(30) for d in range(20)]
    rows += [(0, "zero", 0.0, 0.0, 0.0, True), *[(0, "far", x, 0.1, 2.0, True) for x in (0.1, 0.1, 0.4, 1e9)]]
    kinds = "obs int, det string, x double, y double, tau double, ok boolean"
    run = lambda rows, n, radius: {x["det"]: tuple(x)[1:] for x in stats.combine_fits(spark.createDataFrame(rows, kinds).repartition(n), "obs", "det", "x", "y", "tau", F.col("ok"), radius).collect()}
    got = run(rows, 1, 0.5)
    assert run([rows[i] for i in r.permutation(len(rows))], 5, 0.5) == got
    assert got["zero"] == (0, 0, 0, 0, 0, 0, 1, False) and got["far"] == pytest.approx((0.2, 0.1, 2, 0.02**0.5, 0, 0, 3, True), abs=1e-12)
    # without a limit all fits count, at their plain mean and deviation
    free, tau = run(rows, 2, float("inf")), [x[4] for x in rows if x[1] == "d3"]
    assert free["d3"][6] == 30 and free["d3"][2::3][:2] == pytest.approx((np.mean(tau), np.std(tau)), rel=1e-13)


def test_observations_are_loaded_from_both_ends(spark):
    rows = [("t", 1, i, float(i)) for i in range(30)] + [("u", 1, i, 1.0) for i in range(5)] + [("t", None, 3, 1.0), (None, 1, 3, 1.0), ("t", 1, None, 1.0), ("t", 2, 12, None)]
    s = spark.createDataFrame(rows, "tod_id string, det_uid int, samp int, x double")
    cuts = spark.createDataFrame([("t", 1, 0, 12), ("t", 1, 15, 17), ("t", 1, 11, 13), ("u", 1, 0, 9)], "tod_id string, det_uid int, start int, stop int")
    got = {(r["tod_id"], r["samp"]): (r["x"], r["cut"]) for r in tods.load_observations(s, start=-20, stop=-5, cuts=cuts).collect()}
    assert {k for k in got if k[0] == "t"} == {("t", i) for i in range(15)}
    assert [i for i in range(15) if got["t", i][1]] == [0, 1, 2, 5, 6] and got["t", 5][0] == pytest.approx(15) and got["t", 7] == (17.0, False)
    assert tods.load_observations(s.limit(0)).count() == 0


def test_fits_headers_and_vector_columns(spark, tmp_path):
    kind = np.dtype([("v", (">f4", (3,))), ("n", ">i8"), ("s", "S5"), ("b", "u1")])
    rows = np.zeros(1000, kind)
    rows["v"], rows["n"], rows["s"], rows["b"] = np.arange(3000).reshape(-1, 3), np.arange(1000) * 10**12, b"ab", 200
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": kind.itemsize, "NAXIS2": 1000, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 4}
    for i, (n, t) in enumerate([("v", "3E"), ("n", "K"), ("s", "5A"), ("b", "1B")], 1):
        cards |= {f"TTYPE{i}": n, f"TFORM{i}": t}
    first = fits.header({"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": 4, "NAXIS2": 3, "OBJECT": "it's", "SCALE": 1.5})
    image = np.arange(12, dtype=">f4").tobytes().ljust(fits.BLOCK, b"\0")
    path = str(tmp_path / "x.fits")
    with open(path, "wb") as f:
        f.write(first.replace(b"'it's    '", b"'it''s   '") + image + fits.header(cards) + rows.tobytes().ljust(-(-rows.nbytes // fits.BLOCK) * fits.BLOCK, b"\0"))
    got = fits.parse_header(io.BytesIO(open(path, "rb").read()))
    assert got["OBJECT"] == "it's" and got["SCALE"] == 1.5 and got["NAXIS1"] == 4
    t = fits.read_table(spark, path)
    assert dict(t.dtypes) == {"v": "array<float>", "n": "bigint", "s": "string", "b": "smallint"}
    last = t.orderBy(F.desc("n")).head()
    assert t.count() == 1000 and last["v"] == [2997.0, 2998.0, 2999.0] and last["n"] == 999 * 10**12 and last["s"] == "ab" and last["b"] == 200
    assert {(r["i0"], r["i1"], r["value"]) for r in fits.read_image(spark, path).collect()} == {(i % 4, i // 4, float(i)) for i in range(12)}


def test_fits_tables_keep_what_they_can(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 1.5, True), (None, None, None, None), (3, "", -2.0, False)], "a int, s string, x double, b boolean")
    fits.write_table(df, str(tmp_path / "t"))
    got = sorted(map(tuple, fits.read_table(spark, str(tmp_path / "t")).collect()), key=str)
    assert str(got) == str(sorted([(1, "é", 1.5, True), (0, "", float("nan"), False), (3, "", -2.0, False)], key=str))
