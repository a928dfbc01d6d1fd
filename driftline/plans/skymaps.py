"""Queries on maps, spectra and modes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import mapping, pathology, spectral, stats
from driftline.operators.joins import few_groups, with_groups
from driftline.plans.signals import KEYS, S, _E, matrix, merged_sql, stream
from driftline.tables import load

QUERIES, SQL = {}, {}
r6 = lambda c: F.round(c, 6)
GRID = mapping.Grid(52, 12, 0.0, 0.0, 0.0, 0.0, 1.0, 0.01)
RATE = 8.0


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _li(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.ln("l_extendedprice").alias("v"), F.col("l_suppkey").alias("det"))


_MAP = "m AS (SELECT CAST(floor(l_quantity + 0.5) AS INTEGER) AS i0, CAST(floor(l_discount / 0.01 + 0.5) AS INTEGER) AS i1, sum(ln(l_extendedprice)) AS signal, count(*) AS hits FROM lineitem WHERE floor(l_quantity + 0.5) BETWEEN 0 AND 51 AND floor(l_discount / 0.01 + 0.5) BETWEEN 0 AND 11 GROUP BY 1, 2)"


def _map(spark, d):
    return mapping.project(_li(spark, d), GRID, F.col("x"), F.col("y"), {"signal": F.col("v")})


@query("map_bin", f"WITH {_MAP} SELECT i0, i1, round(signal, 6) AS signal, hits FROM m")
def _(spark, d):
    return _map(spark, d).withColumn("signal", r6("signal"))


@query("map_deproject", f"WITH {_MAP} SELECT l_orderkey, l_linenumber, round(coalesce(signal / hits, 0), 6) AS signal FROM lineitem LEFT JOIN m ON i0 = CAST(floor(l_quantity + 0.5) AS INTEGER) AND i1 = CAST(floor(l_discount / 0.01 + 0.5) AS INTEGER)")
def _(spark, d):
    m = mapping.divided(_map(spark, d), "signal", "hits")
    return mapping.deproject(_li(spark, d), GRID, F.col("x"), F.col("y"), m, "signal").select("l_orderkey", "l_linenumber", r6("signal").alias("signal"))


@query("map_polarised", """WITH q AS (SELECT CAST(floor(l_quantity + 0.5) AS INTEGER) AS i0, CAST(floor(l_discount / 0.01 + 0.5) AS INTEGER) AS i1, ln(l_extendedprice) AS v, radians(l_suppkey % 90) AS phi, radians(l_linenumber * 10) AS g FROM lineitem WHERE floor(l_quantity + 0.5) BETWEEN 0 AND 51 AND floor(l_discount / 0.01 + 0.5) BETWEEN 0 AND 11),
a AS (SELECT *, sin(phi) * cos(g) - cos(phi) * sin(g) AS c, sin(phi) * sin(g) + cos(phi) * cos(g) AS s FROM q)
SELECT i0, i1, round(sum(v), 6) AS sum_i, round(sum(v * (c*c - s*s)), 4) + 0.0 AS sum_q, round(-sum(v * 2 * s * c), 4) + 0.0 AS sum_u, count(*) AS hits FROM a GROUP BY 1, 2""")
def _(spark, d):
    q = load(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.ln("l_extendedprice").alias("v"), F.radians(F.col("l_suppkey") % 90).alias("phi"), F.radians(F.col("l_linenumber") * 10).alias("g"))
    c2, s2 = mapping.tangent_angle(F.cos("g"), F.sin("g"), F.col("phi"))
    m = mapping.project(q, GRID, F.col("x"), F.col("y"), mapping.polarised(F.col("v"), c2, s2))
    return m.select("i0", "i1", r6("sum_i").alias("sum_i"), (F.round("sum_q", 4) + 0.0).alias("sum_q"), (F.round("sum_u", 4) + 0.0).alias("sum_u"), "hits")


@query("map_peak", f"WITH {_MAP} SELECT i0, i1, round(signal, 6) AS signal FROM m ORDER BY signal DESC, i0, i1 LIMIT 1")
def _(spark, d):
    return mapping.peak(_map(spark, d), "signal").withColumn("signal", r6("signal"))


@query("map_submap", f"WITH {_MAP} SELECT i0 - 10 AS i0, i1 - 2 AS i1, hits FROM m WHERE i0 >= 10 AND i0 < 30 AND i1 >= 2 AND i1 < 9")
def _(spark, d):
    return mapping.submap(_map(spark, d), (10, 2), (30, 9)).select("i0", "i1", "hits")


@query("map_shrink", f"WITH {_MAP} SELECT CAST(i0 // 2 AS INTEGER) AS i0, CAST(i1 // 2 AS INTEGER) AS i1, round(sum(signal * hits) / sum(hits), 6) AS signal, CAST(sum(hits) AS BIGINT) AS hits FROM m GROUP BY 1, 2")
def _(spark, d):
    return mapping.shrink(_map(spark, d), "signal", "hits", 2).withColumn("signal", r6("signal"))


@query("map_plane", f"""WITH {_MAP}, s AS (SELECT avg(i0) AS u, avg(i1) AS v, avg(signal) AS z, var_pop(i0) AS uu, var_pop(i1) AS vv, covar_pop(i0, i1) AS uv, covar_pop(i0, signal) AS uz, covar_pop(i1, signal) AS vz FROM m)
SELECT i0, i1, round(signal - z - (uz*vv - vz*uv) / (uu*vv - uv*uv) * (i0 - u) - (vz*uu - uz*uv) / (uu*vv - uv*uv) * (i1 - v), 3) AS signal FROM m, s""")
def _(spark, d):
    return mapping.plane_removed(_map(spark, d), "signal").select("i0", "i1", F.round("signal", 3).alias("signal"))


@query("map_solid_angle", f"""WITH {_MAP}, r AS (SELECT *, sqrt(pow(i0 - 25, 2) + pow(i1 - 5, 2)) AS r FROM m), b AS (SELECT avg(CASE WHEN r >= 8 AND r < 20 THEN signal END) AS b, max(signal) AS p FROM r), z AS (SELECT r, (signal - b) / (p - b) AS z FROM r, b),
o AS (SELECT sum(CASE WHEN r < 8 THEN z END) * 0.25 AS i, avg(CASE WHEN r >= 7 AND r < 8 THEN z END) * 2 * pi() * 64 * 0.25 AS e FROM z) SELECT round(i, 5) AS om_inner, round(e, 5) AS om_outer, round(i + e, 5) AS om_total FROM o""")
def _(spark, d):
    got = mapping.solid_angles(_map(spark, d), "signal", (25.0, 5.0), 8.0, 20.0, 0.25)
    return got.select(*[F.round(c, 5).alias(c) for c in ("om_inner", "om_outer", "om_total")])


@query("wand_radec", """WITH a AS (SELECT DISTINCT pa, det_uid, radians(sky_x) AS x, radians(sky_y) AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL AND det_uid IS NOT NULL),
b AS (SELECT *, sqrt(1 - x*x - y*y) AS z, x * sin(0.3) - y * cos(0.3) AS dx, -(y * sin(0.3) + x * cos(0.3)) AS dy FROM a), c AS (SELECT *, dx / (z * cos(-0.5) - dy * sin(-0.5)) AS q, dx * sin(-0.5) / cos(-0.5) AS t FROM b)
SELECT pa, det_uid, round(1 + q * (1 - q * q / 3), 8) AS ra, round(-0.5 + dy - (t * dx - dy * (dy * dy / 3 - t * t)) / 2, 8) AS dec FROM c""")
def _(spark, d):
    a = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null and det_uid is not null").select("pa", "det_uid", F.radians("sky_x").alias("x"), F.radians("sky_y").alias("y")).distinct()
    ra, dec = mapping.radec_wand(F.lit(1.0), F.lit(-0.5), F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), F.col("x"), F.col("y"))
    return a.select("pa", "det_uid", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query("wand_tangent", "SELECT DISTINCT pa, det_uid, round(0.5 - sky_x * cos(0.3) - sky_y * sin(0.3), 6) AS x, round(0.2 + sky_y * cos(0.3) - sky_x * sin(0.3), 6) AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL AND det_uid IS NOT NULL")
def _(spark, d):
    a = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null and det_uid is not null").select("pa", "det_uid", "sky_x", "sky_y").distinct()
    x, y = mapping.tangent_wand(F.lit(0.5), F.lit(0.2), F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), F.col("sky_x"), F.col("sky_y"))
    return a.select("pa", "det_uid", r6(x).alias("x"), r6(y).alias("y"))


@query("projections", """WITH t AS (SELECT DISTINCT basename, min_ra_south AS a, min_dec AS d FROM tod_info WHERE min_ra_south IS NOT NULL AND min_dec IS NOT NULL), z AS (SELECT *, sin(radians(d)) * sin(radians(-20)) + cos(radians(d)) * cos(radians(-20)) * cos(radians(a - 180)) AS z FROM t)
SELECT basename, CASE WHEN z > 0 THEN round(degrees(cos(radians(d)) * sin(radians(a - 180)) / z), 5) END AS tx, CASE WHEN z > 0 THEN round(degrees((sin(radians(d)) * cos(radians(-20)) - cos(radians(d)) * sin(radians(-20)) * cos(radians(a - 180))) / z), 5) END AS ty, round(degrees(sin(radians(d))), 6) AS cy, round(d + 20, 6) AS py FROM z""")
def _(spark, d):
    t = load(spark, d, "tod_info").where("min_ra_south is not null and min_dec is not null").select("basename", "min_ra_south", "min_dec").distinct()
    tx, ty = mapping.tan_projection(F.col("min_ra_south"), F.col("min_dec"), 180.0, -20.0)
    return t.select("basename", F.round(tx, 5).alias("tx"), F.round(ty, 5).alias("ty"), r6(mapping.cea_projection(F.col("min_ra_south"), F.col("min_dec"), 180.0)[1]).alias("cy"), r6(mapping.car_projection(F.col("min_ra_south"), F.col("min_dec"), 180.0, -20.0)[1]).alias("py"))


@query("projections_back", """WITH t AS (SELECT DISTINCT basename, min_ra_south AS a, min_dec AS d FROM tod_info WHERE min_ra_south IS NOT NULL AND min_dec IS NOT NULL), z AS (SELECT *, sin(radians(d)) * sin(radians(-20)) + cos(radians(d)) * cos(radians(-20)) * cos(radians(a - 180)) AS z FROM t)
SELECT basename, CASE WHEN z > 0 THEN round(((a % 360) + 360) % 360, 5) END AS tra, CASE WHEN z > 0 THEN round(d, 5) END AS tdec, round(a, 5) AS cra, round(d, 5) AS cdec, round(d, 5) AS pdec FROM z""")
def _(spark, d):
    t = load(spark, d, "tod_info").where("min_ra_south is not null and min_dec is not null").select("basename", "min_ra_south", "min_dec").distinct()
    a, b = F.col("min_ra_south"), F.col("min_dec")
    tra, tdec = mapping.radec_from_tan(*mapping.tan_projection(a, b, 180.0, -20.0), 180.0, -20.0)
    cra, cdec = mapping.radec_from_cea(*mapping.cea_projection(a, b, 180.0), 180.0)
    pdec = mapping.radec_from_car(*mapping.car_projection(a, b, 180.0, -20.0), 180.0, -20.0)[1]
    return t.select("basename", *[F.round(c, 5).alias(n) for n, c in (("tra", tra), ("tdec", tdec), ("cra", cra), ("cdec", cdec), ("pdec", pdec))])


@query("wand_sindec", """WITH a AS (SELECT DISTINCT pa, det_uid, radians(sky_x) AS x, radians(sky_y) AS y FROM array_data WHERE sky_x IS NOT NULL AND sky_y IS NOT NULL AND det_uid IS NOT NULL),
b AS (SELECT *, x * x + y * y AS r, x * sin(0.3) - y * cos(0.3) AS dx, -(y * sin(0.3) + x * cos(0.3)) AS dy FROM a), c AS (SELECT *, dx / (sqrt(1 - r) * cos(-0.5) - dy * sin(-0.5)) AS q FROM b)
SELECT pa, det_uid, round(1 + q * (1 - q * q / 3), 8) AS ra, round(sin(-0.5) * (1 - r / 2) + cos(-0.5) * dy, 8) AS sindec FROM c""")
def _(spark, d):
    a = load(spark, d, "array_data").where("sky_x is not null and sky_y is not null and det_uid is not null").select("pa", "det_uid", F.radians("sky_x").alias("x"), F.radians("sky_y").alias("y")).distinct()
    ra, s = mapping.ra_sindec_wand(F.lit(1.0), F.lit(-0.5), F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), F.col("x"), F.col("y"))
    return a.select("pa", "det_uid", F.round(ra, 8).alias("ra"), F.round(s, 8).alias("sindec"))


@query("map_grown", f"WITH {_MAP}, f AS (SELECT CASE WHEN 2 * avg(signal) > max(signal) + min(signal) THEN -1 ELSE 1 END AS f FROM m), p AS (SELECT a AS i0, b AS i1 FROM range(60) x(a), range(20) y(b)) SELECT CAST(p.i0 AS INTEGER) AS i0, CAST(p.i1 AS INTEGER) AS i1, round(coalesce(signal * f, 0), 6) AS signal, round(sqrt(pow(p.i0 - 29.5, 2) + pow((p.i1 - 9.5) * 2, 2)), 6) AS r FROM p LEFT JOIN m ON m.i0 + 4 = p.i0 AND m.i1 + 3 = p.i1, f")
def _(spark, d):
    m = mapping.grown(mapping.sign_corrected(_map(spark, d), "signal"), (-4, -3), (56, 17))
    got = mapping.every_pixel(m, 60, 20, ["signal"])
    return got.select("i0", "i1", r6("signal").alias("signal"), r6(mapping.radii(F.col("i0"), F.col("i1"), (29.5, 9.5), (1.0, 2.0))).alias("r"))


@query("map_deproject_polarised", """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity + 0.5) AS INTEGER) AS i0, CAST(floor(l_discount / 0.01 + 0.5) AS INTEGER) AS i1, ln(l_extendedprice) AS v, radians(l_suppkey % 90) AS phi, radians(l_linenumber * 10) AS g FROM lineitem),
a AS (SELECT *, sin(phi) * cos(g) - cos(phi) * sin(g) AS c, sin(phi) * sin(g) + cos(phi) * cos(g) AS s FROM q), m AS (SELECT i0, i1, sum(v) / count(*) AS mi, sum(v * (c*c - s*s)) / count(*) AS mq, -sum(v * 2 * s * c) / count(*) AS mu FROM a WHERE i0 BETWEEN 0 AND 51 AND i1 BETWEEN 0 AND 11 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(coalesce(mi + mq * (c*c - s*s) - mu * 2 * s * c, 0), 5) + 0.0 AS signal FROM a LEFT JOIN m USING (i0, i1)""")
def _(spark, d):
    q = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.ln("l_extendedprice").alias("v"), F.radians(F.col("l_suppkey") % 90).alias("phi"), F.radians(F.col("l_linenumber") * 10).alias("g"))
    c2, s2 = mapping.tangent_angle(F.cos("g"), F.sin("g"), F.col("phi"))
    m = mapping.project(q, GRID, F.col("x"), F.col("y"), mapping.polarised(F.col("v"), c2, s2))
    m = m.select("i0", "i1", *[(F.col(c) / F.col("hits")).alias(c) for c in ("sum_i", "sum_q", "sum_u")])
    got = mapping.deproject_polarised(q, GRID, F.col("x"), F.col("y"), m, ("sum_i", "sum_q", "sum_u"), c2, s2)
    return got.select("l_orderkey", "l_linenumber", (F.round("signal", 5) + 0.0).alias("signal"))


@query("waterfall", f"WITH {S} SELECT tod_id, CAST(samp // 20 AS INTEGER) AS it, CAST(det_uid // 100 AS INTEGER) AS ix, round(avg(x), 3) AS mean, count(*) AS n FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return mapping.waterfall(stream(spark, d), ["tod_id"], F.col("samp"), F.col("det_uid"), "x", 20.0, 100.0).withColumn("mean", F.round("mean", 3))


@query("map_residual", f"WITH {_MAP} SELECT i0, i1, hits, true AS reduced FROM m")
def _(spark, d):
    """Hits of the solved map, and whether the equation is left with less than a hundredth of its right side."""
    i0, i1 = GRID.pixel(F.col("x"), F.col("y"))
    rows = _li(spark, d).select("det", i0.alias("i0"), i1.alias("i1"), F.col("v").alias("value")).where(GRID.inside(F.col("i0"), F.col("i1")))
    sky, _story = mapping.solve_map(rows, ["det"], rounds=5)
    off = rows.join(sky, ["i0", "i1"]).withColumn("e", F.col("value") - F.col("x"))
    mean = off.groupBy("det").agg(F.avg("e").alias("me"), F.avg("value").alias("mv"))
    left = off.join(mean, "det").groupBy("i0", "i1").agg(F.sum(F.col("e") - F.col("me")).alias("r"), F.sum(F.col("value") - F.col("mv")).alias("b"))
    good = left.agg(F.sum(F.col("r") ** 2) < 1e-4 * F.sum(F.col("b") ** 2)).scalar()
    return sky.select("i0", "i1", "hits").withColumn("reduced", good)


@query("map_solved")
def _(spark, d):
    i0, i1 = GRID.pixel(F.col("x"), F.col("y"))
    rows = _li(spark, d).select("det", i0.alias("i0"), i1.alias("i1"), F.col("v").alias("value")).where(GRID.inside(F.col("i0"), F.col("i1")))
    return mapping.solve_map(rows, ["det"], rounds=5)[0]


# spectra and modes


def _short(spark, d):
    s = stream(spark, d)
    return s.join(s.groupBy(*KEYS).agg(F.avg("x").alias("_m")), KEYS).select(*KEYS, "samp", ((F.col("x") - F.col("_m")) / 1000).alias("x"))


_OVER = "PARTITION BY tod_id, det_uid ORDER BY samp"


def _on_grid(whole: str) -> str:
    """CTEs up to g (tod_id, det_uid, n, samp, x): streams on every sample up to the last of ``whole``, and y (... line, y) less their trend."""
    return f"""{S}, sh AS (SELECT tod_id, det_uid, samp, (x - avg(x) OVER (PARTITION BY tod_id, det_uid)) / 1000 AS x FROM s),
ax AS (SELECT DISTINCT tod_id, det_uid, max(samp) OVER (PARTITION BY {whole}) + 1 AS n FROM sh), gr AS (SELECT tod_id, det_uid, n, unnest(range(n)) AS samp FROM ax),
gj AS (SELECT gr.*, x, CASE WHEN x IS NOT NULL THEN samp END AS place FROM gr LEFT JOIN sh USING (tod_id, det_uid, samp)),
gf AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS pv, last_value(place IGNORE NULLS) OVER b AS ps, first_value(x IGNORE NULLS) OVER f AS nv, first_value(place IGNORE NULLS) OVER f AS ns FROM gj
  WINDOW b AS ({_OVER} ROWS UNBOUNDED PRECEDING), f AS ({_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS MATERIALIZED (SELECT tod_id, det_uid, n, samp, CASE WHEN x IS NOT NULL THEN x WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (samp - ps) / (ns - ps) END AS x FROM gf),
tr AS (SELECT tod_id, det_uid, w, avg(x) FILTER (samp < w) AS a, avg(x) FILTER (samp >= n - w) AS b FROM (SELECT *, greatest(1, least(1000, n // 4)) AS w FROM g) GROUP BY 1, 2, 3),
yl AS (SELECT g.*, a + (b - a) * (samp - (w - 1) / 2.0) / greatest(n - w, 1) AS line FROM g JOIN tr USING (tod_id, det_uid)), y AS MATERIALIZED (SELECT *, x - line AS y FROM yl)"""


def _dft(src: str, value: str, keys: str) -> str:
    """Half spectrum (keys, n, k, re, im) of (keys, n, samp, value)."""
    angle = "2 * pi() * ((k * samp) % n) / n"
    return f"SELECT {keys}, n, k, sum({value} * cos({angle})) AS re, -sum({value} * sin({angle})) AS im FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM {src}) GROUP BY {keys}, n, k"


def _through(re: str, im: str) -> str:
    """CTEs up to bk (tod_id, det_uid, samp, v): streams less their trend with spectrum (re, im) times a gain."""
    angle = "2 * pi() * ((k * samp) % n) / n"
    return f"""{_on_grid('tod_id, det_uid')}, ft AS MATERIALIZED ({_dft('y', 'y', 'tod_id, det_uid')}), fg AS (SELECT tod_id, det_uid, n, k, {re} AS re, {im} AS im, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS c FROM (SELECT *, k * {RATE} / n AS f FROM ft)),
bk AS MATERIALIZED (SELECT tod_id, det_uid, samp, sum(c * (re * cos({angle}) - im * sin({angle}))) / n AS v FROM (SELECT *, unnest(range(n)) AS samp FROM fg) GROUP BY tod_id, det_uid, n, samp)"""


def _sine2(fc: float, df: float) -> str:
    return f"pow(sin(pi() / 2 * greatest(0, least(1, ({fc} + {df} / 2 - f) / {df}))), 2)"


def _solved(n: int, rows: str = "mx") -> str:
    """CTEs up to sol (tod_id, det_uid, i, c): normal equations ``rows`` (tod_id, det_uid, i, j, v; j = n is the right side) by Gauss and Jordan."""
    step = "s{b} AS MATERIALIZED (SELECT a.tod_id, a.det_uid, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v FROM {a} a JOIN {a} p ON {on} AND p.i = {k} AND p.j = {k} JOIN {a} r ON {onr} AND r.i = a.i AND r.j = {k} JOIN {a} c ON {onc} AND c.i = {k} AND c.j = a.j)"
    on = lambda t: f"a.tod_id = {t}.tod_id AND a.det_uid = {t}.det_uid"
    return ", ".join(step.format(a=f"s{k}" if k else rows, b=k + 1, k=k, on=on("p"), onr=on("r"), onc=on("c")) for k in range(n)) + f", sol AS MATERIALIZED (SELECT tod_id, det_uid, i, v AS c FROM s{n} WHERE j = {n})"


def _fitted(basis: list[str]) -> str:
    """CTEs up to sol: coefficients of least squares of g on the basis (expressions of samp and n), and ba, the basis at every sample."""
    return f"ba AS MATERIALIZED (SELECT tod_id, det_uid, samp, x, unnest(range({len(basis) + 1})) AS i, unnest([{', '.join(f'({b})::DOUBLE' for b in basis)}, x]) AS b FROM g), mx AS MATERIALIZED (SELECT u.tod_id, u.det_uid, u.i, v.i AS j, sum(u.b * v.b) AS v FROM ba u JOIN ba v USING (tod_id, det_uid, samp) WHERE u.i < {len(basis)} GROUP BY 1, 2, 3, 4), {_solved(len(basis))}"


_BACK = "SELECT tod_id, det_uid, CAST(samp AS INTEGER) AS samp, round(v + line, 4) + 0.0 AS x FROM bk JOIN y USING (tod_id, det_uid, samp)"
_KEY2 = "tod_id, det_uid"


@query("fourier", f"""WITH {_E}, k AS (SELECT unnest(range(33)) AS k) SELECT det, CAST(k AS INTEGER) AS k, round(sum(x * cos(2 * pi() * k * samp / 64)), 5) + 0.0 AS re, round(-sum(x * sin(2 * pi() * k * samp / 64)), 5) + 0.0 AS im FROM e, k GROUP BY 1, 2""")
def _(spark, d):
    return spectral.fourier(matrix(spark, d), ["det"], "samp", "x").select("det", "k", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


@query("spectrum_bins", f"""WITH {_E}, k AS (SELECT unnest(range(33)) AS k), f AS (SELECT det, k, sum(x * cos(2 * pi() * k * samp / 64)) AS re, -sum(x * sin(2 * pi() * k * samp / 64)) AS im FROM e, k GROUP BY 1, 2)
SELECT det, CAST(k // 8 AS INTEGER) AS bin, round(sum(re), 5) + 0.0 AS re, round(sum(im), 5) + 0.0 AS im, count(*) AS n FROM f GROUP BY det, k // 8""")
def _(spark, d):
    f = spectral.fourier(matrix(spark, d), ["det"], "samp", "x")
    got = stats.complex_bin_sums(f, ["det"], F.floor(F.col("k") / 8).cast("int"), F.col("re"), F.col("im"))
    return got.select("det", "bin", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"), "n")


@query("fourier_back", f"WITH {_E} SELECT det, CAST(samp AS INTEGER) AS samp, round(x, 6) + 0.0 AS x FROM e")
def _(spark, d):
    m = matrix(spark, d)
    f = spectral.fourier(m, ["det"], "samp", "x").withColumn("n", F.lit(64))
    return spectral.fourier_back(f, ["det"], "n").withColumn("x", r6("x") + 0.0)


_SEC = f"""se AS (SELECT *, unnest(range(3)) AS b, n // 2 AS size FROM g WHERE n >= 8), sp AS MATERIALIZED (SELECT tod_id, det_uid, b, size AS n, samp - b * size // 2 AS samp, x FROM se WHERE samp >= b * size // 2 AND samp < b * size // 2 + size),
sw AS (SELECT tod_id, det_uid, b, w, avg(x) FILTER (samp < w) AS a, avg(x) FILTER (samp >= n - w) AS z FROM (SELECT *, greatest(1, least(200, n // 4)) AS w FROM sp) GROUP BY 1, 2, 3, 4),
sx AS (SELECT sp.*, 0.5 * (1 - cos(2 * pi() * samp / n)) * (x - a - (z - a) * (samp - (w - 1) / 2.0) / greatest(n - w, 1)) AS y FROM sp JOIN sw USING (tod_id, det_uid, b)), sf AS ({_dft('sx', 'y', 'tod_id, det_uid, b')})"""


@query("power_sections", f"""WITH {_on_grid(_KEY2)}, {_SEC} SELECT tod_id, det_uid, CAST(k AS INTEGER) AS k, round(CASE WHEN k = 0 THEN 0.5 ELSE k END * {RATE} / 2 / (n // 2 + 1), 6) AS f, round(sum(re * re + im * im) * 2 / 3 / pow(n / 2.0, 2) * n / {RATE}, 6) + 0.0 AS power FROM sf GROUP BY tod_id, det_uid, n, k""")
def _(spark, d):
    got = spectral.section_spectra(_short(spark, d), KEYS, "samp", "x", 1 / RATE, 2, "hann")
    return got.select(*KEYS, "k", r6("f").alias("f"), (r6("power") + 0.0).alias("power"))


@query("polynomial_removed", f"""WITH {_on_grid(_KEY2)}, {_fitted(['1', '(2.0 * samp / greatest(n - 1, 1) - 1)', 'pow(2.0 * samp / greatest(n - 1, 1) - 1, 2)', 'pow(2.0 * samp / greatest(n - 1, 1) - 1, 3)'])},
re AS (SELECT tod_id, det_uid, samp, any_value(x) - sum(c * b) AS e FROM ba JOIN sol USING (tod_id, det_uid, i) GROUP BY 1, 2, 3) SELECT tod_id, det_uid, CAST(samp AS INTEGER) AS samp, round(e, 6) + 0.0 AS x FROM re""")
def _(spark, d):
    return spectral.without_polynomial(_short(spark, d), KEYS, "samp", "x", 3).withColumn("x", r6("x") + 0.0)


@query("block_mode", f"""WITH {S}, sh AS (SELECT tod_id, det_uid, samp, samp // 64 AS blk, (x - avg(x) OVER (PARTITION BY tod_id, det_uid)) / 1000 AS x FROM s), m AS (SELECT *, avg(x) OVER (PARTITION BY tod_id, samp) AS m FROM sh),
k AS (SELECT tod_id, det_uid, blk, sum(x * m) / nullif(sum(m * m), 0) AS k FROM m GROUP BY 1, 2, 3) SELECT tod_id, det_uid, samp, round(x - coalesce(k, 0) * m, 6) + 0.0 AS x FROM m JOIN k USING (tod_id, det_uid, blk)""")
def _(spark, d):
    return spectral.without_block_mode(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", 64).select(*KEYS, "samp", (r6("x") + 0.0).alias("x"))


@query("filter_low", f"WITH {_through(f're * {_sine2(1.0, 0.5)}', f'im * {_sine2(1.0, 0.5)}')} {_BACK}")
def _(spark, d):
    return spectral.filter_streams(_short(spark, d), KEYS, "samp", "x", lambda f: spectral.sine2_low(f, 1.0, 0.5), RATE).withColumn("x", F.round("x", 4) + 0.0)


@query("deconvolved", f"WITH {_through('re - im * 2 * pi() * f * 0.05', 'im + re * 2 * pi() * f * 0.05')} {_BACK}")
def _(spark, d):
    return spectral.filter_streams(_short(spark, d), KEYS, "samp", "x", np.ones_like, RATE, tau=0.05).withColumn("x", F.round("x", 4) + 0.0)


_GLITCH = f"(1 - {_sine2(2.0, 1.0)}) * exp(-0.5 * pow(2 * pi() * f * 0.02, 2))"


@query("glitch_cuts", f"""WITH {_through(f're * {_GLITCH}', f'im * {_GLITCH}')}, r AS (SELECT tod_id, det_uid, samp, abs(v) AS v, row_number() OVER (PARTITION BY {_KEY2} ORDER BY abs(v)) - 1 AS i, count(*) OVER (PARTITION BY {_KEY2}) AS n FROM bk),
q AS (SELECT tod_id, det_uid, n, max(v) FILTER (i = 3 * n // 4) - max(v) FILTER (i = n // 4) AS w FROM r GROUP BY 1, 2, 3), h AS (SELECT tod_id, det_uid, samp, q.n, coalesce(samp - lag(samp) OVER ({_OVER}) >= 30, true) AS nw FROM r JOIN q USING (tod_id, det_uid) WHERE v > 7.41 * w),
gg AS (SELECT *, sum(nw::INT) OVER ({_OVER} ROWS UNBOUNDED PRECEDING) AS p FROM h), e AS (SELECT tod_id, det_uid, p, n, min(samp) AS a, max(samp) + 1 AS b FROM gg GROUP BY 1, 2, 3, 4),
b AS (SELECT tod_id, det_uid, greatest(CASE WHEN p = 1 AND a < 30 THEN least(a, 1) ELSE a END - 6, 0) AS start, least(b + 6, n) AS stop FROM e), {merged_sql('b', 'gm')} SELECT tod_id, det_uid, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM gm""")
def _(spark, d):
    return spectral.glitch_cuts(_short(spark, d), KEYS, "samp", "x", RATE, high=2.0, sigma_t=0.02)


_WINDOWED = f"""wi AS (SELECT *, unnest(range(0, n - size + 1, greatest(1, size // 2))) AS a FROM (SELECT *, {{size}} AS size FROM g)), wc AS (SELECT tod_id, det_uid, a, size AS n, samp - a AS samp, x - avg(x) OVER (PARTITION BY tod_id, det_uid, a) AS x, sin(pi() * (samp - a) / (size - 1)) AS w FROM wi WHERE samp >= a AND samp < a + size),
wx AS (SELECT *, w * x AS wx FROM wc), wn AS (SELECT tod_id, det_uid, n, avg(w * w) AS ww FROM wc WHERE a = 0 GROUP BY 1, 2, 3), wf AS ({_dft('wx', 'wx', 'tod_id, det_uid, a')}),
ps AS MATERIALIZED (SELECT tod_id, det_uid, n, k, k * {RATE} / n AS f, avg(re * re + im * im) * 2 / ({RATE} * n * any_value(ww)) AS p FROM wf JOIN wn USING (tod_id, det_uid, n) GROUP BY 1, 2, 3, 4)"""


@query("power_spectra", f"""WITH {_on_grid(_KEY2)}, {_WINDOWED.format(size='least(128, n)')}, bn AS (SELECT *, floor(12 * log10(f / ({RATE} / n)) / log10((n // 2) * (1 + 1e-9))) AS b FROM ps WHERE k > 0)
SELECT tod_id, det_uid, CAST(b AS INTEGER) AS bin, round(avg(f), 6) AS f, round(avg(p), 6) AS power, count(*) AS n FROM bn GROUP BY 1, 2, 3""")
def _(spark, d):
    return spectral.spectra(_short(spark, d), KEYS, "samp", "x", RATE, 128, 12).select(*KEYS, "bin", r6("f").alias("f"), r6("power").alias("power"), "n")


@query("cross_spectra", f"""WITH {_on_grid('tod_id')}, c AS (SELECT *, count(DISTINCT det_uid) OVER (PARTITION BY tod_id) AS nd, n // 8 AS size FROM g), st AS (SELECT tod_id, det_uid, nd, samp // size AS a, size AS n, samp % size AS samp, x FROM c WHERE size >= 4 AND nd > 1 AND samp < 8 * size),
sc AS (SELECT *, sin(pi() * samp / (n - 1)) * (x - avg(x) OVER (PARTITION BY tod_id, det_uid, a)) AS wx FROM st), f AS ({_dft('sc', 'wx', 'tod_id, det_uid, a, nd')}),
o AS (SELECT *, (sum(re) OVER w - re) / (nd - 1) AS ore, (sum(im) OVER w - im) / (nd - 1) AS oim FROM f WINDOW w AS (PARTITION BY tod_id, a, k))
SELECT tod_id, det_uid AS det, CAST(k AS INTEGER) AS k, round(k * {RATE} / n, 6) AS f, round((pow(avg(re * ore + im * oim), 2) + pow(avg(im * ore - re * oim), 2)) / greatest(avg(re * re + im * im) * avg(ore * ore + oim * oim), 1e-300), 6) AS coherence FROM o GROUP BY tod_id, det_uid, n, k""")
def _(spark, d):
    return spectral.cross_spectra(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", RATE).select("tod_id", "det", "k", r6("f").alias("f"), r6("coherence").alias("coherence"))


@query("principal_modes")
def _(spark, d):
    return spectral.modes_of(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", 3)


@query("modes_checked", f"""WITH {_on_grid('tod_id')}, n AS (SELECT tod_id, least(3, count(DISTINCT det_uid)) AS m FROM g GROUP BY 1), i AS (SELECT tod_id, m, unnest(range(m)) AS i FROM n), j AS (SELECT *, unnest(range(i, m)) AS j FROM i)
SELECT tod_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS dot, true AS explains FROM j""")
def _(spark, d):
    """Weights of the modes are orthonormal, and what is left without them has no part along them; each explains the share it states."""
    s = _short(spark, d)
    w = spectral.modes_of(s, ["tod_id"], "det_uid", "samp", "x", 3)
    a, b = w.select("tod_id", "det", F.col("mode").alias("i"), F.col("weight").alias("wi"), "share"), w.select("tod_id", "det", F.col("mode").alias("j"), F.col("weight").alias("wj"))
    dots = a.join(b, ["tod_id", "det"]).where("i <= j").groupBy("tod_id", "i", "j").agg((F.round(F.sum(F.col("wi") * F.col("wj")), 6) + 0.0).alias("dot"), F.first("share").alias("share"))
    rest = spectral.without_modes(s, ["tod_id"], "det_uid", "samp", "x", 3).join(a, ["tod_id", "det"]).groupBy("tod_id", "i", "samp").agg(F.sum(F.col("x") * F.col("wi")).alias("t"))
    left = rest.groupBy("tod_id", "i").agg(F.stddev_pop("t").alias("left_"))
    size = s.groupBy("tod_id").agg(F.stddev_pop("x").alias("size"))
    return dots.join(left, ["tod_id", "i"]).join(size, "tod_id").select("tod_id", "i", "j", "dot", ((F.col("left_") <= 1e-6 * F.col("size")) & F.col("share").between(0, 1 + 1e-9)).alias("explains"))


@query("without_modes")
def _(spark, d):
    return spectral.without_modes(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", 2)


@query("preselected", f"""WITH {_on_grid('tod_id')}, c AS MATERIALIZED (SELECT tod_id, det_uid, samp, x - avg(x) OVER (PARTITION BY tod_id, det_uid) AS c FROM g), z AS (SELECT tod_id, det_uid, sqrt(avg(c * c)) AS size FROM c GROUP BY 1, 2),
zi AS (SELECT *, row_number() OVER (PARTITION BY tod_id ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY tod_id) AS n FROM z WHERE size > 0), m AS (SELECT tod_id, size AS mid FROM zi WHERE i = n // 2),
q AS (SELECT z.tod_id, det_uid, size, size / coalesce(mid, 1) AS ratio, size > 0 AND size / coalesce(mid, 1) < 4 AND size / coalesce(mid, 1) > 0.25 AS near FROM z LEFT JOIN m ON z.tod_id = m.tod_id),
ci AS (SELECT c.tod_id, samp, c, row_number() OVER (PARTITION BY c.tod_id, samp ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY c.tod_id, samp) AS n FROM c JOIN q USING (tod_id, det_uid) WHERE near), cm AS (SELECT tod_id, samp, c AS cm FROM ci WHERE i = n // 2),
r AS (SELECT c.tod_id, det_uid, avg(c * coalesce(cm, 0)) AS cc, sqrt(avg(coalesce(cm * cm, 0))) AS s FROM c LEFT JOIN cm ON c.tod_id = cm.tod_id AND c.samp = cm.samp GROUP BY 1, 2)
SELECT tod_id, det_uid AS det, round(ratio, 6) AS ratio, round(CASE WHEN size * s > 0 THEN cc / (size * s) ELSE 0 END, 6) + 0.0 AS corr, near AND size * s > 0 AND cc / (size * s) >= 0.5 AS ok FROM q JOIN r USING (tod_id, det_uid)""")
def _(spark, d):
    return spectral.preselect(_short(spark, d), ["tod_id"], "det_uid", "samp", "x").select("tod_id", "det", r6("ratio").alias("ratio"), (r6("corr") + 0.0).alias("corr"), "ok")


@query("drift_tests")
def _(spark, d):
    return spectral.drift_tests(_short(spark, d), ["tod_id"], "det_uid", "samp", "x")


@query("band_statistics", f"""WITH {_on_grid('tod_id')}, f AS ({_dft('y', 'y', 'tod_id, det_uid')}), h AS (SELECT *, CASE WHEN f >= 0.05 AND f < 0.5 THEN 0 WHEN f >= 0.5 AND f < 2 THEN 1 WHEN f >= 2 AND f < 4 THEN 2 END AS band FROM (SELECT *, k * {RATE} / n AS f FROM f)),
c AS (SELECT *, avg(re) OVER w AS cre, avg(im) OVER w AS cim FROM h WHERE band IS NOT NULL WINDOW w AS (PARTITION BY tod_id, k))
SELECT tod_id, det_uid AS det, CAST(band AS INTEGER) AS band, round(sqrt(sum(re * re + im * im)) / sqrt(count(*) * n * {RATE}), 6) AS noise, round(sum(re * cre + im * cim) / greatest(sqrt(sum(re * re + im * im)) * sqrt(sum(cre * cre + cim * cim)), 1e-300), 6) + 0.0 AS corr FROM c GROUP BY tod_id, det_uid, band, n""")
def _(spark, d):
    got = spectral.band_statistics(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", RATE, [(0.05, 0.5), (0.5, 2.0), (2.0, 4.0)])
    return got.select("tod_id", "det", "band", r6("noise").alias("noise"), (r6("corr") + 0.0).alias("corr"))


@query("scan_summary", f"""WITH {_on_grid(_KEY2)}, v AS (SELECT *, CASE WHEN samp = 0 THEN lead(x) OVER w - x WHEN samp = n - 1 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS v FROM g WINDOW w AS ({_OVER})),
c AS MATERIALIZED (SELECT *, sum(v) OVER ({_OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM v), m AS (SELECT tod_id, det_uid, any_value(n) AS n, median(abs(s)) AS speed, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, min(x) AS mn, max(x) AS mx FROM c GROUP BY 1, 2),
t AS (SELECT tod_id, det_uid, samp, sign(s) <> lag(sign(s)) OVER ({_OVER}) AS turn FROM c JOIN m USING (tod_id, det_uid) WHERE abs(s) > speed / 10 * (1 + 1e-9)), g2 AS (SELECT tod_id, det_uid, samp - lag(samp) OVER ({_OVER}) AS gap FROM t WHERE turn),
p AS (SELECT tod_id, det_uid, count(*) AS k, median(gap) AS gap, stddev_pop(gap) AS sd, avg(gap) AS mean FROM g2 GROUP BY 1, 2), z AS (SELECT m.*, coalesce(k, 0) AS k, gap, sd, mean FROM m LEFT JOIN p USING (tod_id, det_uid))
SELECT tod_id, det_uid, round(CASE WHEN n < 16 THEN mn ELSE lo END, 6) + 0.0 AS lo, round(CASE WHEN n < 16 THEN mx ELSE hi END, 6) + 0.0 AS hi, round(CASE WHEN n < 16 THEN 0 ELSE speed * {RATE} END, 6) AS speed, round(CASE WHEN n < 16 OR gap IS NULL THEN 0 ELSE 2 * gap / {RATE} END, 6) AS period, CAST(CASE WHEN n < 16 THEN 0 ELSE k END AS INTEGER) AS n_turns,
CAST(CASE WHEN n < 16 THEN 1 WHEN speed = 0 THEN 2 WHEN k = 0 THEN 3 WHEN k = 1 THEN 5 WHEN sd > 0.5 * mean THEN 4 ELSE 0 END AS INTEGER) AS status FROM z""")
def _(spark, d):
    got = spectral.scan_summary(_short(spark, d), KEYS, "samp", "x", RATE)
    return got.select(*KEYS, *[(r6(c) + 0.0).alias(c) for c in ("lo", "hi", "speed", "period")], "n_turns", "status")


def _marked(spark, d):
    """Streams with calibration, and every fifth detector as a dark one."""
    cal = load(spark, d, "array_data").where("det_type = 'tes'").groupBy("det_uid").agg(F.min("optical_sign").alias("cal"))
    s = with_groups(_short(spark, d), cal, ["det_uid"], few_groups(cal, ["det_uid"]))
    return s.withColumn("cal", F.coalesce("cal", F.lit(0.0))).withColumn("dark", F.col("det_uid") % 5 == 0).withColumn("light", ~F.col("dark") & (F.col("cal") != 0))


_DS = f"{_on_grid('tod_id')}, d0 AS (SELECT tod_id, det_uid, samp // 4 AS i, avg(x) AS x FROM g WHERE samp < n // 4 * 4 GROUP BY 1, 2, 3), d1 AS MATERIALIZED (SELECT *, x - avg(x) OVER (PARTITION BY tod_id, det_uid) AS c FROM d0)"


@query("drift_live", f"""WITH {_DS}, k AS (SELECT tod_id, i, avg(c) AS k FROM d1 WHERE det_uid % 5 = 0 GROUP BY 1, 2), f AS (SELECT d1.tod_id, det_uid, coalesce(sum(c * k) / nullif(sum(k * k), 0), 0) AS f FROM d1 LEFT JOIN k ON k.tod_id = d1.tod_id AND k.i = d1.i GROUP BY 1, 2),
e AS MATERIALIZED (SELECT d1.tod_id, det_uid, d1.i, c - f * coalesce(k, 0) AS c FROM d1 JOIN f USING (tod_id, det_uid) LEFT JOIN k ON k.tod_id = d1.tod_id AND k.i = d1.i), m AS (SELECT tod_id, i, avg(c) AS m FROM e WHERE det_uid % 5 <> 0 GROUP BY 1, 2),
r AS (SELECT e.tod_id, det_uid, e.i, c, coalesce(m, 0) AS m FROM e LEFT JOIN m ON m.tod_id = e.tod_id AND m.i = e.i), a AS (SELECT tod_id, det_uid, coalesce(sum(c * m) / nullif(sum(m * m), 0), 0) AS gain, sqrt(avg(c * c)) AS norm, sqrt(avg(m * m)) AS s FROM r GROUP BY 1, 2),
b AS (SELECT r.tod_id, r.det_uid, sqrt(avg(pow(c - gain * m, 2))) AS rest FROM r JOIN a USING (tod_id, det_uid) GROUP BY 1, 2)
SELECT tod_id, det_uid AS det, round(gain, 5) + 0.0 AS gain, round(CASE WHEN norm > 0 THEN gain * s / norm ELSE 0 END, 5) + 0.0 AS corr, round(norm, 5) AS norm, round(CASE WHEN norm > 0 THEN rest / norm ELSE 0 END, 5) AS drift FROM a JOIN b USING (tod_id, det_uid) WHERE det_uid % 5 <> 0""")
def _(spark, d):
    got = pathology.drift_analysis(_marked(spark, d), ["tod_id"], "det_uid", "samp", "x", 4, dark="dark").where("det % 5 <> 0")
    return got.select("tod_id", "det", *[(F.round(c, 5) + 0.0).alias(c) for c in ("gain", "corr", "norm", "drift")])


@query("light_and_dark", f"""WITH {S}, sh AS (SELECT tod_id, det_uid, samp, (x - avg(x) OVER (PARTITION BY tod_id, det_uid)) / 1000 AS y FROM s), cc AS (SELECT det_uid, min(optical_sign) AS cal FROM array_data WHERE det_type = 'tes' GROUP BY 1),
c AS MATERIALIZED (SELECT sh.*, coalesce(cal, 0.0) AS cal, det_uid % 5 = 0 AS dark, det_uid % 5 <> 0 AND coalesce(cal, 0.0) <> 0 AS light FROM sh LEFT JOIN cc USING (det_uid)), m AS (SELECT tod_id, samp, avg(y * cal) FILTER (light) AS l, avg(y) FILTER (dark) AS k FROM c GROUP BY 1, 2),
p AS (SELECT tod_id, det_uid, any_value(cal) AS cal, bool_or(light) AS light, bool_or(dark) AS dark, sum(y * cal * l) / nullif(sum(l * l), 0) AS pl, sum(y * k) / nullif(sum(k * k), 0) AS pk FROM c JOIN m USING (tod_id, samp) GROUP BY 1, 2),
ql AS (SELECT tod_id, max(pl) FILTER (i = n // 2) AS m, 0.741 * (max(pl) FILTER (i = 3 * n // 4) - max(pl) FILTER (i = n // 4)) AS s FROM (SELECT tod_id, pl, row_number() OVER (PARTITION BY tod_id ORDER BY pl) - 1 AS i, count(*) OVER (PARTITION BY tod_id) AS n FROM p WHERE light AND pl IS NOT NULL) GROUP BY 1),
qk AS (SELECT tod_id, max(pk) FILTER (i = n // 2) AS m, 0.741 * (max(pk) FILTER (i = 3 * n // 4) - max(pk) FILTER (i = n // 4)) AS s FROM (SELECT tod_id, pk, row_number() OVER (PARTITION BY tod_id ORDER BY pk) - 1 AS i, count(*) OVER (PARTITION BY tod_id) AS n FROM p WHERE dark AND pk IS NOT NULL) GROUP BY 1),
r AS (SELECT p.*, CASE WHEN abs(pl - ql.m) <= 3 * ql.s AND cal <> 0 THEN 'light' WHEN abs(pk - qk.m) <= 3 * qk.s THEN 'dark' ELSE 'none' END AS member FROM p LEFT JOIN ql ON ql.tod_id = p.tod_id LEFT JOIN qk ON qk.tod_id = p.tod_id)
SELECT tod_id, det_uid, round(pl, 5) + 0.0 AS p_light, round(pk, 5) + 0.0 AS p_dark, member, round(CASE WHEN member = 'light' AND pl <> 0 THEN cal / pl ELSE 0 END, 5) + 0.0 AS recal FROM r""")
def _(spark, d):
    got = pathology.light_and_dark(_marked(spark, d), ["tod_id"], "det_uid", "samp", "x", "cal", "light", "dark")
    return got.select("tod_id", "det_uid", *[(F.round(c, 5) + 0.0).alias(c) for c in ("p_light", "p_dark", "recal")], "member")


_TURN = [f"{f}({h} * 2 * pi() * samp / 40)" for h in (1, 2, 3) for f in ("cos", "sin")]


_BANDS = [(0.05, 0.5), (0.3, 1.5)]
_LIM = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(_BANDS))


@query("low_frequency", f"""WITH {_on_grid('tod_id')}, f AS ({_dft('y', 'y', 'tod_id, det_uid')}), w AS (SELECT f.*, b.w FROM f, (VALUES {_LIM}) b(w, lo, hi) WHERE k >= floor(lo * n / {RATE} + 0.5) AND k < greatest(floor(hi * n / {RATE} + 0.5), floor(lo * n / {RATE} + 0.5) + 16)),
z AS MATERIALIZED (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY tod_id, det_uid, w)) AS size, count(*) OVER (PARTITION BY tod_id, det_uid, w) AS nk FROM w), c AS (SELECT a.tod_id, a.w, a.det_uid, abs(sum(a.re * b.re + a.im * b.im) / any_value(a.size * b.size)) AS cc FROM z a JOIN z b USING (tod_id, w, k) WHERE a.nk > 1 GROUP BY a.tod_id, a.w, a.det_uid, b.det_uid),
m AS (SELECT tod_id, w, det_uid, median(cc) AS mid FROM c GROUP BY 1, 2, 3), p AS (SELECT *, CASE WHEN count(*) FILTER (mid > 0.6) OVER (PARTITION BY tod_id, w) >= 2 THEN mid > 0.6 ELSE mid > 0.3 END AS pre FROM m),
cm AS (SELECT tod_id, w, k, avg(re) AS cre, avg(im) AS cim FROM z JOIN p USING (tod_id, w, det_uid) WHERE pre GROUP BY 1, 2, 3), r AS (SELECT p.tod_id, p.w, p.det_uid, any_value(pre) AS pre, any_value(size) AS norm, coalesce(sum(re * cre + im * cim) / sum(cre * cre + cim * cim), 0) AS gain, coalesce(sum(re * cre + im * cim) / (any_value(size) * sqrt(sum(cre * cre + cim * cim))), 0) AS corr
  FROM p JOIN z USING (tod_id, w, det_uid) LEFT JOIN cm ON cm.tod_id = p.tod_id AND cm.w = p.w AND cm.k = z.k GROUP BY 1, 2, 3),
h AS (SELECT *, sum(pre::INT) OVER (PARTITION BY tod_id, det_uid) AS np FROM r), h2 AS (SELECT *, np > 0 AND 2 * np >= max(np) OVER (PARTITION BY tod_id) AS half FROM h), g2 AS (SELECT *, abs(gain) / avg(abs(gain)) FILTER (half AND pre) OVER (PARTITION BY tod_id, w) AS g FROM h2)
SELECT tod_id, det_uid AS det, any_value(half) AS preselected, round(avg(g) FILTER (pre), 5) AS gain, round(max(corr) FILTER (pre), 5) AS corr, round(avg(norm) FILTER (pre), 4) AS norm FROM g2 GROUP BY 1, 2""")
def _(spark, d):
    got = pathology.low_frequency(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", RATE, _BANDS, leading=False)
    return pathology.over_windows(got, ["tod_id"]).select("tod_id", "det", "preselected", F.round("gain", 5).alias("gain"), F.round("corr", 5).alias("corr"), F.round("norm", 4).alias("norm"))


@query("high_frequency", f"""WITH {_through('re * CASE WHEN f >= 2 AND f < 4 THEN 1 ELSE 0 END', 'im * CASE WHEN f >= 2 AND f < 4 THEN 1 ELSE 0 END').replace(_on_grid('tod_id, det_uid'), _on_grid('tod_id'))}, p AS (SELECT tod_id, det_uid, n, sum(re * re + im * im) AS p, count(*) AS nk FROM ft WHERE k * {RATE} / n >= 2 AND k * {RATE} / n < 4 GROUP BY 1, 2, 3),
c AS (SELECT *, v - avg(v) OVER (PARTITION BY tod_id, det_uid) AS e FROM bk), m AS (SELECT tod_id, det_uid, avg(e * e) AS v, avg(e * e * e) AS s, avg(e * e * e * e) AS q FROM c GROUP BY 1, 2)
SELECT tod_id, det_uid AS det, round(sqrt(p / nk / n), 6) AS rms, round(CASE WHEN v > 0 THEN s / pow(v, 1.5) ELSE 0 END, 5) + 0.0 AS skew, round(CASE WHEN v > 0 THEN q / (v * v) ELSE 0 END, 5) AS kurt FROM p JOIN m USING (tod_id, det_uid)""")
def _(spark, d):
    got = pathology.high_frequency(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", RATE, (2.0, 4.0))
    return got.select("tod_id", "det", r6("rms").alias("rms"), (F.round("skew", 5) + 0.0).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query("detector_groups", f"SELECT DISTINCT tod_id, det_uid AS det, true AS grouped FROM ({'WITH ' + S + ' SELECT tod_id, det_uid FROM s'})")
def _(spark, d):
    """Every detector belongs to one of at most five groups."""
    g = pathology.grouped_detectors(_short(spark, d), ["tod_id"], "det_uid", "samp", "x", RATE, (0.05, 1.0))
    return g.select("tod_id", "det", F.col("group").between(0, 4).alias("grouped"))


@query("harmonics", f"""WITH {_on_grid(_KEY2)}, {_fitted([*_TURN, '1'])} SELECT tod_id, det_uid, CAST(i // 2 + 1 AS INTEGER) AS harmonic, round(max(c) FILTER (i % 2 = 0), 6) + 0.0 AS cos, round(max(c) FILTER (i % 2 = 1), 6) + 0.0 AS sin FROM sol WHERE i < 6 GROUP BY tod_id, det_uid, i // 2""")
def _(spark, d):
    return spectral.harmonics(_short(spark, d), KEYS, "samp", "x", 40.0, 3).select(*KEYS, "harmonic", (r6("cos") + 0.0).alias("cos"), (r6("sin") + 0.0).alias("sin"))


@query("fit_peaks")
def _(spark, d):
    return spectral.fit_peaks(_short(spark, d), KEYS, "samp", "x")
