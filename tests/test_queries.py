"""Every core query with SQL, against DuckDB on the smallest tables."""

import os
from importlib import import_module

import numpy as np
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
MODULES = ["quality", "catalog", "signals", "season", "skymaps", "scans", "texts"]
CASES = [(n, m) for m in MODULES for n in import_module(f"driftline.plans.{m}").SQL]
REST = [(n, m) for m in MODULES for n in import_module(f"driftline.plans.{m}").QUERIES if n not in import_module(f"driftline.plans.{m}").SQL]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if "datetime" in str(df[k].dtype):
            df[k] = df[k].astype("datetime64[us]").astype(str)
        elif df[k].dtype.kind in "fiub" or str(df[k].dtype) in ("Int32", "Int64"):
            df[k] = df[k].astype(float) + 0.0
        else:
            df[k] = df[k].map(lambda v: None if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v) else v).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name,module", CASES)
def test_sql(spark, duck, name, module):
    m = import_module(f"driftline.plans.{module}")
    a, b = normal(m.QUERIES[name](spark, DATA).toPandas()), normal(duck.execute(m.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for k in a.columns:
        if a[k].dtype.kind == "f" and b[k].dtype.kind == "f":
            np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=2e-6)
        else:
            assert (a[k] == b[k]).all(), k


def peaks(spark, got):
    """A gaussian of some width within reach of its stream; no noise, no signal-to-noise."""
    assert len(got) and (got["sigma"] >= 0).all() and (got["snr"] >= 0).all() and np.isfinite(got["height"]).all()
    assert not got.duplicated(["tod_id", "det_uid"]).any()


def splined(spark, got):
    """Readings within the quantiles stay as they are."""
    s = import_module("driftline.plans.signals").stream(spark, DATA).toPandas().merge(got, on=["tod_id", "det_uid", "samp"], suffixes=("", "_new"))
    q = s.groupby(["tod_id", "det_uid"])["x"].quantile([0.05, 0.95]).unstack()
    inside = s.join(q, on=["tod_id", "det_uid"])
    inside = inside[(inside["x"] > inside[0.05]) & (inside["x"] < inside[0.95])]
    assert len(inside) > 1000 and np.allclose(inside["x"], inside["x_new"], atol=1e-3)


def modes(spark, got):
    """Shares of the variance fall from mode to mode and are one at most in all; weights are unit vectors."""
    first = got.groupby(["tod_id", "mode"])["share"].first().unstack()
    assert (first.sum(axis=1) <= 1 + 1e-6).all() and (first.fillna(0).diff(axis=1).iloc[:, 1:] <= 1e-9).all().all()
    assert np.allclose((got["weight"] ** 2).groupby([got["tod_id"], got["mode"]]).sum(), 1)


def without(spark, got):
    """Taking modes off leaves less than there was."""
    before = import_module("driftline.plans.skymaps")._short(spark, DATA).toPandas()
    assert len(got) >= len(before) and (got["x"] ** 2).sum() < (before["x"] ** 2).sum()


def drifts(spark, got):
    assert len(got) and got["corr"].abs().max() <= 1 + 1e-9 and got["drift"].between(0, 1 + 1e-9).all()


def solved(spark, got):
    """The map's mean is that of no signal; every pixel was hit."""
    assert len(got) and (got["hits"] > 0).all() and abs(got["x"].mean()) < 1e-6


CHECKS = {"fit_peaks": peaks, "outliers_splined": splined, "principal_modes": modes, "without_modes": without, "drift_tests": drifts, "map_solved": solved}


def test_every_query_without_sql_has_a_check():
    assert {n for n, _ in REST} == set(CHECKS)


@pytest.mark.parametrize("name,module", REST)
def test_properties(spark, name, module):
    CHECKS[name](spark, import_module(f"driftline.plans.{module}").QUERIES[name](spark, DATA).toPandas())
