"""Sky maps: pointing, binning, reading maps back into streams, and the iterative solution of a map.

A map is a sparse table (i0, i1, value columns). Streams are rows with x, y on the map's plane.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.joins import few_groups, with_groups
from driftline.session import checkpointed


@dataclass(frozen=True)
class Grid:
    """Pixels n0 x n1 with reference pixel pix, its coordinate x and the size dx of a pixel, on both axes."""

    n0: int
    n1: int
    pix0: float
    pix1: float
    x0: float
    x1: float
    dx0: float
    dx1: float

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Indices of the pixel that holds (x, y), as integers; outside the grid they are out of range."""
        i = lambda v, a, d, p: F.floor((v - a) / d + p + 0.5).cast("int")
        return i(x, self.x0, self.dx0, self.pix0), i(y, self.x1, self.dx1, self.pix1)

    def inside(self, i0: Column, i1: Column) -> Column:
        return (i0 >= 0) & (i0 < self.n0) & (i1 >= 0) & (i1 < self.n1)

    def centre(self, i0: Column, i1: Column) -> tuple[Column, Column]:
        return (i0 - self.pix0) * self.dx0 + self.x0, (i1 - self.pix1) * self.dx1 + self.x1


def tangent_wand(wx: Column, wy: Column, cosg: Column, sing: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Place of a detector with offset (x, y) from a boresight at (wx, wy) turned by gamma."""
    return wx - x * cosg - y * sing, wy + y * cosg - x * sing


def tangent_angle(cosg: Column, sing: Column, phi: Column) -> tuple[Column, Column]:
    """cos and sin of twice the polarisation angle on the sky."""
    c = F.sin(phi) * cosg - F.cos(phi) * sing
    s = F.sin(phi) * sing + F.cos(phi) * cosg
    return c * c - s * s, 2 * s * c


def radec_wand(ra: Column, dec: Column, cosg: Column, sing: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Right ascension and declination of a detector, expanded in its small offset."""
    z = F.sqrt(1 - x * x - y * y)
    dx, dy = x * sing - y * cosg, -(y * sing + x * cosg)
    q = dx / (z * F.cos(dec) - dy * F.sin(dec))
    t = dx * F.sin(dec) / F.cos(dec)
    return ra + q * (1 - q * q / 3), dec + dy - (t * dx - dy * (dy * dy / 3 - t * t)) / 2


def project(rows: DataFrame, grid: Grid, x: Column, y: Column, values: dict[str, Column]) -> DataFrame:
    """(i0, i1, names..., hits): sums of the values in each pixel that is hit."""
    i0, i1 = grid.pixel(x, y)
    hit = rows.select(i0.alias("i0"), i1.alias("i1"), *[v.alias(k) for k, v in values.items()]).where(grid.inside(F.col("i0"), F.col("i1")))
    return hit.groupBy("i0", "i1").agg(*[F.sum(k).alias(k) for k in values], F.count("*").alias("hits"))


def polarised(value: Column, cos2: Column, sin2: Column, weight: Column | None = None) -> dict[str, Column]:
    """Values for ``project``: intensity and both polarisation sums."""
    w = F.lit(1.0) if weight is None else weight
    return {"sum_i": w * value, "sum_q": w * value * cos2, "sum_u": -w * value * sin2}


def deproject(rows: DataFrame, grid: Grid, x: Column, y: Column, sky: DataFrame, column: str, into: str = "signal") -> DataFrame:
    """``rows`` with the map's value at their place, 0 where the map has none."""
    i0, i1 = grid.pixel(x, y)
    m = sky.select("i0", "i1", F.col(column).alias(into))
    return rows.withColumn("i0", i0).withColumn("i1", i1).join(m, ["i0", "i1"], "left").withColumn(into, F.coalesce(into, F.lit(0.0))).drop("i0", "i1")


def divided(sky: DataFrame, value: str, weight: str) -> DataFrame:
    """The map's value over its weight where that isn't 0, 0 elsewhere."""
    return sky.withColumn(value, F.when(F.col(weight) != 0, F.col(value) / F.when(F.col(weight) != 0, F.col(weight))).otherwise(0.0))


def peak(sky: DataFrame, value: str) -> DataFrame:
    """The pixel with the largest value, of several the first by (i0, i1)."""
    top = sky.agg(F.min_by(F.struct("i0", "i1", value), F.struct((-F.col(value)).alias("v"), "i0", "i1")).alias("p"))
    return top.select("p.i0", "p.i1", F.col(f"p.{value}").alias(value))


def submap(sky: DataFrame, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """Pixels [lo, hi) with indices from 0 on."""
    got = sky.where((F.col("i0") >= lo[0]) & (F.col("i0") < hi[0]) & (F.col("i1") >= lo[1]) & (F.col("i1") < hi[1]))
    return got.withColumn("i0", F.col("i0") - lo[0]).withColumn("i1", F.col("i1") - lo[1])


def shrink(sky: DataFrame, value: str, weight: str, factor: int) -> DataFrame:
    """Weighted mean of blocks of factor x factor pixels."""
    d = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return sky.groupBy(d("i0"), d("i1")).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def plane_removed(sky: DataFrame, value: str, hits: str = "hits") -> DataFrame:
    """The map less the plane fitted to its hit pixels."""
    u, v, z = F.col("i0").cast("double"), F.col("i1").cast("double"), F.col(value)
    on = sky.where(F.col(hits) > 0)
    s = on.agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(z).alias("z"), F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv"), F.covar_pop(u, z).alias("uz"), F.covar_pop(v, z).alias("vz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    ok = F.when(det != 0, det)
    s = s.select("u", "v", "z", F.coalesce((F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / ok, F.lit(0.0)).alias("a"), F.coalesce((F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / ok, F.lit(0.0)).alias("b"))
    fit = s.select(F.struct(*s.columns)).scalar()
    out = sky.withColumn("_f", fit)
    f = lambda k: F.col(f"_f.{k}")
    return out.withColumn(value, F.col(value) - f("z") - f("a") * (u - f("u")) - f("b") * (v - f("v"))).drop("_f")


def annulus_mean(sky: DataFrame, value: str, centre: tuple[float, float], lo: float, hi: float) -> Column:
    """Aggregate: mean of the pixels at a distance lo <= r < hi of the centre."""
    r = F.sqrt((F.col("i0") - centre[0]) ** 2 + (F.col("i1") - centre[1]) ** 2)
    return F.avg(F.when((r >= lo) & (r < hi), F.col(value)))


def solid_angles(sky: DataFrame, value: str, centre: tuple[float, float], radius: float, outer: float, area: float) -> DataFrame:
    """(om_inner, om_outer, om_total): of a beam map less the mean of its annulus [radius, outer), its wing continued as the cube."""
    r = F.sqrt((F.col("i0") - centre[0]) ** 2 + (F.col("i1") - centre[1]) ** 2)
    base = sky.agg(F.struct(annulus_mean(sky, value, centre, radius, outer).alias("b"), F.max(value).alias("p"))).scalar()
    z = sky.withColumn("_f", base).withColumn("_z", (F.col(value) - F.col("_f.b")) / (F.col("_f.p") - F.col("_f.b")))
    inner = F.sum(F.when(r < radius, F.col("_z"))) * area
    edge = F.avg(F.when((r >= radius - 1) & (r < radius), F.col("_z"))) * 2 * math.pi * radius**2 * area
    return z.agg(inner.alias("om_inner"), edge.alias("om_outer"), (inner + edge).alias("om_total"))


def grown(sky: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """The map on the larger pixel range [low, high): its pixels numbered from ``low``; pixels that come in have no rows, as any without data."""
    return sky.withColumn("i0", F.col("i0") - low[0]).withColumn("i1", F.col("i1") - low[1]).where((F.col("i0") >= 0) & (F.col("i1") >= 0) & (F.col("i0") < high[0] - low[0]) & (F.col("i1") < high[1] - low[1]))


def every_pixel(sky: DataFrame, n0: int, n1: int, values: list[str]) -> DataFrame:
    """All n0 x n1 pixels; those without a row have 0 in ``values``."""
    whole = sky.sparkSession.range(n0 * n1).select((F.col("id") % n0).cast("int").alias("i0"), F.floor(F.col("id") / n0).cast("int").alias("i1"))
    return whole.join(sky.select("i0", "i1", *values), ["i0", "i1"], "left").na.fill(0, values)


def sign_corrected(sky: DataFrame, value: str) -> DataFrame:
    """The map times -1 if its mean is farther from its least than from its largest value."""
    flip = sky.agg(F.when(2 * F.avg(value) > F.max(value) + F.min(value), -1.0).otherwise(1.0)).scalar()
    return sky.withColumn(value, F.col(value) * flip)


def radii(i0: Column, i1: Column, centre: tuple[float, float], step: tuple[float, float]) -> Column:
    """Distance of a pixel from a centre (in pixels), in units of the pixel steps."""
    return F.sqrt(((i0 - centre[0]) * step[0]) ** 2 + ((i1 - centre[1]) * step[1]) ** 2)


def radec_from_tan(x: Column, y: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Inverse of ``tan_projection``; RA in [0, 360)."""
    u, v = F.radians(x), F.radians(y)
    s0, c0 = math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    ra = F.degrees(F.atan2(u, c0 - v * s0)) + ra0
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(s0 + v * c0, F.sqrt(u * u + (c0 - v * s0) ** 2)))


def radec_from_cea(x: Column, y: Column, ra0: float, lam: float = 1.0) -> tuple[Column, Column]:
    """Inverse of ``cea_projection``."""
    return x + ra0, F.degrees(F.asin(F.radians(y) * lam))


def radec_from_car(x: Column, y: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Inverse of ``car_projection``."""
    return x + ra0, y + dec0


def ra_sindec_wand(ra: Column, dec: Column, cosg: Column, sing: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Right ascension and sine of the declination of a detector, expanded in its small offset."""
    r = x * x + y * y
    dx, dy = x * sing - y * cosg, -(y * sing + x * cosg)
    q = dx / (F.sqrt(1 - r) * F.cos(dec) - dy * F.sin(dec))
    return ra + q * (1 - q * q / 3), F.sin(dec) * (1 - r / 2) + F.cos(dec) * dy


def deproject_polarised(rows: DataFrame, grid: Grid, x: Column, y: Column, sky: DataFrame, maps: tuple[str, str, str], cos2: Column, sin2: Column, value: str = "signal") -> DataFrame:
    """``rows`` with the signal I + Q cos 2g - U sin 2g of a polarised map at their pixels; 0 where the map has none."""
    i0, i1 = grid.pixel(x, y)
    i, q, u = maps
    at = rows.withColumn("i0", i0).withColumn("i1", i1).withColumn("_c", cos2).withColumn("_s", sin2)
    got = at.join(sky.select("i0", "i1", F.col(i).alias("_i"), F.col(q).alias("_q"), F.col(u).alias("_u")), ["i0", "i1"], "left")
    return got.withColumn(value, F.coalesce(F.col("_i") + F.col("_q") * F.col("_c") - F.col("_u") * F.col("_s"), F.lit(0.0))).drop("_i", "_q", "_u", "_c", "_s", "i0", "i1")


def tan_projection(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Plane coordinates in degrees of the gnomonic projection; null behind the plane."""
    a = F.radians(ra - ra0)
    d, s0, c0 = F.radians(dec), math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    z = F.sin(d) * s0 + F.cos(d) * c0 * F.cos(a)
    ok = F.when(z > 0, z)
    return F.degrees(F.cos(d) * F.sin(a) / ok), F.degrees((F.sin(d) * c0 - F.cos(d) * s0 * F.cos(a)) / ok)


def cea_projection(ra: Column, dec: Column, ra0: float, lam: float = 1.0) -> tuple[Column, Column]:
    """Cylindrical equal area."""
    return ra - ra0, F.degrees(F.sin(F.radians(dec)) / lam)


def car_projection(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Plate carree."""
    return ra - ra0, dec - dec0


def waterfall(rows: DataFrame, keys: list[str], time: Column, place: Column, value: str, dt: float, dx: float) -> DataFrame:
    """(keys, it, ix, mean, n) in cells of time and place."""
    return rows.groupBy(*keys, F.floor(time / dt).cast("int").alias("it"), F.floor(place / dx).cast("int").alias("ix")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def solve_map(rows: DataFrame, det: list[str], rounds: int = 5, tolerance: float = 1e-6, every: int = 3) -> tuple[DataFrame, list[float]]:
    """Map of streams (det..., i0, i1, value) with each detector's mean filtered out, by preconditioned conjugate gradients.

    Filter F takes the mean off each detector's stream; the equation is P' F P x = P' F d with P reading a map at the samples. The preconditioner divides
    by the hits and takes off the map's mean. Returns the map (i0, i1, x, hits) and the convergence sum(r^2) / sum(x^2) of every
    round; stops at ``tolerance``. The samples' pixels with their numbers per detector are all that a round reads, so it costs
    one join and two aggregates over (detector, pixel) pairs, not over samples.
    """
    pair = checkpointed(rows.groupBy(*det, "i0", "i1").agg(F.count("*").alias("n"), F.sum("value").alias("s")))
    per = pair.groupBy(*det).agg((F.sum("s") / F.sum("n")).alias("m"))
    few = few_groups(pair, det)
    right = with_groups(pair, per, det, few).groupBy("i0", "i1").agg(F.sum(F.col("s") - F.col("n") * F.col("m")).alias("r"), F.sum("n").alias("hits"))

    def conditioned(m: DataFrame) -> DataFrame:
        z = m.withColumn("z", F.col("r") / F.col("hits"))
        return z.withColumn("z", F.col("z") - z.agg(F.avg("z")).scalar())

    sky = checkpointed(conditioned(right).withColumn("x", F.lit(0.0)).withColumn("p", F.col("z")))
    rz = float(sky.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0)
    story: list[float] = []
    held: list[DataFrame] = []
    for k in range(rounds):
        if rz == 0:
            break
        at = pair.join(sky.select("i0", "i1", "p"), ["i0", "i1"])
        mean = at.groupBy(*det).agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mp"))
        q = with_groups(at, mean, det, few).groupBy("i0", "i1").agg(F.sum(F.col("n") * (F.col("p") - F.col("mp"))).alias("q"))
        sky = sky.join(q, ["i0", "i1"])
        pq = float(sky.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0)
        if pq == 0:
            break
        a = rz / pq
        sky = sky.withColumn("x", F.col("x") + a * F.col("p")).withColumn("r", F.col("r") - a * F.col("q")).select("i0", "i1", "hits", "x", "r", "p")
        sky = conditioned(sky)
        if (k + 1) % every == 0 or k + 1 == rounds:
            sky = checkpointed(sky)
            while held:
                held.pop().unpersist()
        else:
            sky = sky.persist()
            held.append(sky)
        got = sky.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("r") ** 2), F.sum(F.col("x") ** 2)).first()
        new, rr, xx = (float(v or 0.0) for v in got)
        story.append(rr / xx if xx else 0.0)
        sky = sky.withColumn("p", F.col("z") + (new / rz) * F.col("p"))
        rz = new
        if story[-1] < tolerance:
            break
    return sky.select("i0", "i1", "x", "hits"), story
