"""Radiometry, beam shapes and filter gains as column expressions over frequency, radius or time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: SI constants and the CMB temperature
H, K_B, C, T_CMB = 6.62607015e-34, 1.380649e-23, 299792458.0, 2.725


def blackbody(nu: Column, t: Column) -> Column:
    """Spectral radiance of a black body."""
    return 2 * H * nu**3 / C**2 / F.expm1(H * nu / (K_B * t))


def rayleigh_jeans(nu: Column, t: Column) -> Column:
    return 2 * nu**2 * K_B * t / C**2


def rj_temperature(nu: Column, radiance: Column) -> Column:
    return radiance * C**2 / (2 * nu**2 * K_B)


def brightness_temperature(nu: Column, radiance: Column) -> Column:
    return H * nu / K_B / F.log1p(2 * H * nu**3 / C**2 / radiance)


def cmb_derivative(nu: Column) -> Column:
    """Change of radiance with the temperature of the CMB."""
    x = H * nu / (K_B * T_CMB)
    return 2 * K_B * nu**2 / C**2 * x**2 * F.exp(x) / F.expm1(x) ** 2


def rj_to_cmb(nu: Column) -> Column:
    """Factor from Rayleigh-Jeans to CMB temperature differences."""
    x = H * nu / (K_B * T_CMB)
    return F.expm1(x) ** 2 / (x**2 * F.exp(x))


def gaussian_beam(r: Column, fwhm: float) -> Column:
    return F.exp(-4 * math.log(2) * r * r / fwhm**2)


def elliptical_radius(x: Column, y: Column, a: float, b: float, angle: float) -> Column:
    """Radius scaled so that the ellipse with half axes a, b at ``angle`` has radius 1."""
    c, s = math.cos(angle), math.sin(angle)
    u, v = x * c + y * s, -x * s + y * c
    return F.sqrt(u * u / a**2 + v * v / b**2)


def bessel_j1(x: Column) -> Column:
    """First-order Bessel function by its power series (|x| up to 12, error below 1e-9)."""
    half = x / 2
    term, total = half, half
    for k in range(1, 32):
        term = term * (-(half * half)) / (k * (k + 1))
        total = total + term
    return total


def airy_beam(x: Column) -> Column:
    """(2 J1(x) / x) squared, 1 at 0."""
    return F.when(F.abs(x) < 1e-9, 1.0).otherwise((2 * bessel_j1(x) / F.when(x == 0, 1.0).otherwise(x)) ** 2)


def peak_solid_angle(fwhm: float) -> float:
    """Of a gaussian peak."""
    return math.pi * fwhm**2 / (4 * math.log(2))


def wing_solid_angle(level: Column, radius: Column) -> Column:
    """Beyond ``radius`` of a wing that falls as the cube of the radius from ``level``."""
    return 2 * math.pi * level * radius**2


def low_pass_sine2(f: Column, fc: float, df: float) -> Column:
    """1 below fc - df / 2, 0 above fc + df / 2, a squared sine between (df is the whole width)."""
    a = F.abs(f)
    return F.when(a < fc - df / 2, 1.0).when(a > fc + df / 2, 0.0).otherwise(F.sin(math.pi / 2 * (1 - (a - (fc - df / 2)) / df)) ** 2)


def high_pass_sine2(f: Column, fc: float, df: float) -> Column:
    a = F.abs(f)
    return F.when(a < fc - df / 2, 0.0).when(a > fc + df / 2, 1.0).otherwise(F.sin(math.pi / 2 * (a - (fc - df / 2)) / df) ** 2)


def low_pass_sine2_half(f: Column, fc: float, df: float) -> Column:
    """As ``low_pass_sine2`` with df the half width."""
    return low_pass_sine2(f, fc, 2 * df)


def butterworth_low(f: Column, fc: float, order: int) -> Column:
    return 1 / F.sqrt(1 + (f / fc) ** (2 * order))


def butterworth_high(f: Column, fc: float, order: int) -> Column:
    return F.when(f == 0, 0.0).otherwise(1 / F.sqrt(1 + (F.lit(fc) / F.when(f == 0, 1.0).otherwise(f)) ** (2 * order)))


def gaussian_band(f: Column, fc: float, df: float) -> Column:
    return F.exp(-((F.abs(f) - fc) ** 2) / (2 * df * df))


def rc_gain(f: Column, tau: float) -> Column:
    """Gain of a one-pole filter."""
    return 1 / F.sqrt(1 + (2 * math.pi * f * tau) ** 2)


def power_law(f: Column, knee: float, index: float) -> Column:
    return 1 + (F.lit(knee) / F.when(f == 0, F.lit(knee)).otherwise(F.abs(f))) ** index


def wiener_low(f: Column, knee: float, index: float) -> Column:
    """Share of 1/f power: 1 at low frequency, 0 at high."""
    u = (F.lit(knee) / F.when(f == 0, 1.0).otherwise(F.abs(f))) ** index
    return F.when(f == 0, 1.0).otherwise(u / (1 + u))


def biquad_gain(f: Column, rate: float, b: tuple[float, float, float, float]) -> Column:
    """Gain at f of a two-stage filter, each stage (1 + z)**2 / (1 - b1 z + b2 z**2) with z one sample's delay; 1 at 0."""
    w = 2 * math.pi * f / rate
    re1, im1, re2, im2 = F.cos(w), -F.sin(w), F.cos(2 * w), -F.sin(2 * w)

    def stage(b1: float, b2: float) -> Column:
        num = (1 + re1) ** 2 + im1 * im1
        den = (1 - b1 * re1 + b2 * re2) ** 2 + (b2 * im2 - b1 * im1) ** 2
        return num / F.sqrt(den) * ((1 - b1 + b2) / 4)

    return stage(b[0], b[1]) * stage(b[2], b[3])


def half_power(rate: float, b: tuple[float, float, float, float]) -> float:
    """Frequency at which the power of the two-stage filter has fallen to a half, between 0 and half of the rate (that, if it doesn't)."""

    def gain(f: float) -> float:
        z = complex(math.cos(2 * math.pi * f / rate), -math.sin(2 * math.pi * f / rate))
        stage = lambda p, q: (1 + z) ** 2 / (1 - p * z + q * z * z) * (1 - p + q) / 4
        return abs(stage(b[0], b[1]) * stage(b[2], b[3]))

    lo, hi = 0.0, rate / 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gain(mid) > 0.5**0.5 else (lo, mid)
    return hi


# fixed values: of the sub-observer latitude in degrees, slope and constant by year, cosine and sine amplitudes, change and constant of
# their angular rate by year; reference time in unix seconds; squared eccentricity term
DISC = {
    "uranus": (3.88233016e00, 4.81513918e01, -2.54042514e00, -1.20158753e00, -2.46918964e-04, 6.21477912e00, 1577836800, 0.047481307441877396),
    "jupiter": (2.21912058e-02, -7.21533904e-02, -2.11716337e00, 2.79381276e00, 1.40789074e-03, 5.36641642e-01, 1577836800, 0.1435630105925818),
    "saturn": (1.80574507e00, -8.90907531e00, 3.67589879e01, -2.85961149e01, 1.55770490e-03, 1.65458760e-01, 1577836800, 0.22899679859188238),
}


def disc_correction(ctime: Column, planet: str) -> Column:
    """Factor of a planet's solid angle for the tilt of its flattened disc; null outside the years 2013 to 2029, for which the model was made."""
    slope, constant, c, s, bend, turn, start, flat = DISC[planet]
    t = (ctime - start) / (86400 * 365.24)
    angle = (bend * t + turn) * t
    lat = F.radians(t * slope + constant + c * F.cos(angle) + s * F.sin(angle))
    return F.when(ctime.between(1356998400, 1893456000), 1 / F.sqrt(1 + F.sin(lat) ** 2 * flat))


def sine2_taper(i: Column, n: Column, edge: int) -> Column:
    """Weight of sample i of n: a squared sine over the first and last ``edge`` samples, 1 between."""
    d = F.least(i, n - 1 - i)
    return F.when(d >= edge, 1.0).otherwise(F.sin(math.pi / 2 * (d + 1) / (edge + 1)) ** 2)


def next_regular(n: Column) -> Column:
    """The least number of at least n whose prime factors are at most 13 (n up to 2**20)."""
    # such numbers lie so close together that 700 candidates suffice up to 2**20
    primes = F.lit([p for p in (2, 3, 5, 7, 11, 13) for _ in range(int(math.log(2**21, p)))])

    def rest(m: Column) -> Column:
        return F.aggregate(primes, m.cast("long"), lambda acc, p: F.when(acc % p == 0, F.floor(acc / p)).otherwise(acc))

    candidates = F.sequence(n.cast("long"), n.cast("long") + 700)
    return F.filter(candidates, lambda m: rest(m) == 1)[0]
