"""Angles, sexagesimal text, quaternions and spherical frames as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Quaternion = tuple[Column, Column, Column, Column]


def rerange(x: Column, lo: float, period: float) -> Column:
    """x moved by whole periods into [lo, lo + period)."""
    return F.pmod(x - lo, F.lit(period)) + lo


def is_within(x: Column, lo: float, hi: float, period: float) -> Column:
    """Whether x, up to whole periods, lies in [lo, hi)."""
    return rerange(x, lo, period) < hi


def parse_sexagesimal(text: Column) -> Column:
    """Value of ``[-]d:m:s`` or ``d:m``; the sign holds for all parts. Null for text that isn't such."""
    body = F.regexp_replace(text, "^[+-]", "")
    part = lambda i: F.coalesce(F.try_element_at(F.split(body, ":"), F.lit(i)).cast("double"), F.lit(0.0))
    value = part(1) + part(2) / 60 + part(3) / 3600
    ok = text.rlike(r"^[+-]?\d+(:\d+(\.\d+)?){0,2}$")
    return F.when(ok, F.when(text.startswith("-"), -value).otherwise(value))


def format_sexagesimal(x: Column, digits: int = 2) -> Column:
    """``[-]dd:mm:ss.ss``, rounded as a whole so that seconds never read 60."""
    units = F.round(F.abs(x) * 3600 * 10**digits).cast("long")
    whole = 3600 * 10**digits
    deg, rest = F.floor(units / whole), units % whole
    text = F.format_string(f"%02d:%02d:%02d.%0{digits}d", deg, F.floor(rest / (60 * 10**digits)), F.floor(rest % (60 * 10**digits) / 10**digits), rest % 10**digits)
    return F.when((x < 0) & (units > 0), F.concat(F.lit("-"), text)).otherwise(text)


def q_mul(a: Quaternion, b: Quaternion) -> Quaternion:
    """Hamilton product."""
    (p, q, r, s), (t, u, v, w) = a, b
    return (
        p * t - q * u - r * v - s * w,
        p * u + q * t + r * w - s * v,
        p * v - q * w + r * t + s * u,
        p * w + q * v - r * u + s * t,
    )


def q_conj(a: Quaternion) -> Quaternion:
    return a[0], -a[1], -a[2], -a[3]


def q_norm(a: Quaternion) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2] + a[3] * a[3])


def q_axis(axis: int, angle: Column) -> Quaternion:
    """Rotation by ``angle`` about axis 1, 2 or 3."""
    zero = F.lit(0.0)
    parts = [F.cos(angle / 2), zero, zero, zero]
    parts[axis] = F.sin(angle / 2)
    return tuple(parts)


def q_chain(steps: list[tuple[int, Column]]) -> Quaternion:
    """Product of rotations about axes, the first leftmost."""
    out = q_axis(*steps[0])
    for s in steps[1:]:
        out = q_mul(out, q_axis(*s))
    return out


def q_rotate(q: Quaternion, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return q_mul(q_mul(q, (F.lit(0.0), *v)), q_conj(q))[1:]


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


# fixed values: galactic pole and node in J2000, degrees
GAL_NODE, POLE_DEC, POLE_RA = 122.932, 27.128336, 192.859508


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Galactic longitude in [0, 2 pi) and latitude of J2000 coordinates, in radians."""
    r = math.radians
    q = q_chain([(3, F.lit(r(GAL_NODE) - math.pi)), (2, F.lit(-math.pi / 2 + r(POLE_DEC))), (3, F.lit(-r(POLE_RA)))])
    x, y, z = q_rotate(q, unit_vector(ra, dec))
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))
