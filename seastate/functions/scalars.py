"""Scalar functions as Column expressions. Everything runs inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..grid import GRAVITY

Value = Column | float | int


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def pmod(x: Column, m: float = 360.0) -> Column:
    """Remainder that is never negative."""
    return F.pmod(x, F.lit(float(m)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def angle(a: Value, b: Value) -> Column:
    """The smallest difference of two directions, 0 to 180."""
    d = pmod(F.abs(col(a) - col(b)))
    return F.least(d, F.lit(360.0) - d)


def to_nautical(a: Value) -> Column:
    """Cartesian going-to to nautical coming-from, and back."""
    return pmod(F.lit(270.0) - col(a))


def wavenumber(freq: Value, depth: Value | None = None) -> Column:
    freq = col(freq)
    if depth is None:
        return 2 * math.pi * freq * freq / 1.56
    depth = col(depth)
    omega = 2 * math.pi * freq
    y = 0.10194 * omega * omega * depth
    a = 1 + 0.6522 * y + 0.4622 * F.pow(y, F.lit(2.0)) + 0.0864 * F.pow(y, F.lit(4.0)) + 0.0675 * F.pow(y, F.lit(5.0))
    return ratio(y * F.sqrt(1 + ratio(F.lit(1.0), y * a)), depth)


def wavelength(freq: Value, depth: Value | None = None) -> Column:
    return ratio(F.lit(1.56), col(freq) * col(freq)) if depth is None else ratio(F.lit(2 * math.pi), wavenumber(freq, depth))


def celerity(freq: Value, depth: Value | None = None) -> Column:
    """Phase speed: 1.56 / f in deep water, else omega / k."""
    return ratio(F.lit(1.56), col(freq)) if depth is None else ratio(2 * math.pi * col(freq), wavenumber(freq, depth))


def waveage(freq: Value, dir: Value, wspd: Value, wdir: Value, dpt: Value | None, agefac: float) -> Column:
    """Whether waves are under the wind's influence: celerity <= agefac wspd cos(dir - wdir)."""
    return celerity(freq, dpt) <= agefac * col(wspd) * F.cos(F.radians(col(dir) - col(wdir)))


def spddir_to_uv(spd: Value, direc: Value, coming_from: bool = False) -> tuple[Column, Column]:
    a = F.radians(col(direc) + (180.0 if coming_from else 0.0))
    return col(spd) * F.sin(a), col(spd) * F.cos(a)


def uv_to_spddir(u: Value, v: Value, coming_from: bool = False) -> tuple[Column, Column]:
    return F.hypot(col(u), col(v)), pmod((270.0 if coming_from else 90.0) - F.degrees(F.atan2(col(v), col(u))))


def dfp_wsea(wspd: Value, fp: Value, dt: Value, scaling: float = 1.0) -> Column:
    """The change of a wind sea's peak frequency over dt seconds, by fetch-unlimited growth."""
    t = 15.8 * F.pow(ratio(F.lit(GRAVITY), col(wspd)), F.lit(0.57))
    t0 = F.pow(ratio(col(fp), t), F.lit(-1 / 0.43))
    return scaling * t * F.pow(t0 + col(dt), F.lit(-0.43)) - col(fp)


def dfp_swell(dt: Value, distance: float = 1e6) -> Column:
    """The rise of a swell's peak frequency over dt seconds by dispersion from a source at a distance."""
    return col(dt) * GRAVITY / (4 * math.pi * distance)


def station_direction(radians: Value) -> Column:
    """Model point output's directions (radians) to degrees coming from."""
    d = F.abs(F.pmod(col(radians) - 2.5 * math.pi, F.lit(2 * math.pi)))
    return pmod(F.degrees(d) + 270.0)


def register(spark: SparkSession) -> None:
    """SQL functions of the session: sea_wavenumber, sea_wavelength, sea_celerity, sea_angle, sea_nautical."""
    k = "0.10194D*power(2*pi()*f,2)*h"
    a = f"(1+0.6522D*({k})+0.4622D*power({k},2)+0.0864D*power({k},4)+0.0675D*power({k},5))"
    for name, args, body in (
        ("sea_wavenumber", "f DOUBLE, h DOUBLE", f"({k})*sqrt(1+1/(({k})*{a}))/h"),
        ("sea_wavelength", "f DOUBLE, h DOUBLE", f"2*pi()/(({k})*sqrt(1+1/(({k})*{a}))/h)"),
        ("sea_celerity", "f DOUBLE, h DOUBLE", f"2*pi()*f/(({k})*sqrt(1+1/(({k})*{a}))/h)"),
        ("sea_angle", "x DOUBLE, y DOUBLE", "least(pmod(abs(x-y),360D),360D-pmod(abs(x-y),360D))"),
        ("sea_nautical", "x DOUBLE", "pmod(270D-x,360D)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
