"""Integrated statistics of spectra as Column expressions.

`stats` plans all that is asked for in one projection: a spectrum is a row, so nothing is shuffled, no Python runs, and
the sums over directions are computed once and shared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..functions import scalars as S
from ..grid import GRAVITY, Grid

NAN = float("nan")
ONED, SIN, COS = "__oned", "__sin", "__cos"


def root(x: Column) -> Column:
    """Square root, null below 0."""
    return F.when(x >= 0, F.sqrt(x))


def lits(values: Iterable[float]) -> Column:
    return F.lit([float(v) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, weights: Iterable[float]) -> Column:
    """Sum of an array column times fixed weights."""
    return total(F.zip_with(a, lits(weights), lambda x, w: x * w))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for a row, however often and in whatever lambda f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean(a: Column) -> Column:
    """NaN and null become 0."""
    return F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))


def rows_of(efth: Column, g: Grid) -> Callable[[Column], Column]:
    """The directions of one frequency."""
    return lambda i: F.slice(efth, i * g.nd + 1, g.nd)


def oned_array(efth: Column, g: Grid, skipna: bool = True) -> Column:
    """Density by frequency: the sum over directions times their step; spectra without directions stay."""
    e = clean(efth) if skipna else efth
    if g.dir is None:
        return e
    return let(e, lambda a: F.transform(F.sequence(F.lit(0), F.lit(g.nf - 1)), lambda i: total(rows_of(a, g)(i)) * g.dd))


def momd_array(efth: Column, g: Grid, kind: str, mom: int = 1, theta: float = 90.0) -> Column:
    """Per frequency, the sum over directions of density times sin**mom ("sin"), cos**mom ("cos") or sin x cos ("both")."""
    phi = g.directional().phi(theta)
    weights = {"sin": [math.sin(p) ** mom for p in phi], "cos": [math.cos(p) ** mom for p in phi], "both": [math.sin(p) * math.cos(p) for p in phi]}[kind]
    return let(efth, lambda a: F.transform(F.sequence(F.lit(0), F.lit(g.nf - 1)), lambda i: dot(rows_of(a, g)(i), [w * g.dd for w in weights])))


class Terms:
    """Expressions over the shared columns of one frame."""

    def __init__(self, g: Grid):
        self.g, self.e, self.sin, self.cos = g, F.col(ONED), F.col(SIN), F.col(COS)

    def m(self, n: int) -> Column:
        return dot(self.e, self.g.df * self.g.f**n)

    def energy(self, tail: bool = True) -> Column:
        m0 = self.m(0)
        return m0 + F.element_at(self.e, -1) * self.g.tail() if tail and self.g.tail() else m0

    def ipeak(self) -> Column:
        """The frequency index of the largest inner local maximum, the first on ties; null without one."""
        e, n = self.e, self.g.nf
        if n < 3:
            return F.lit(None).cast("int")
        inner = F.filter(F.sequence(F.lit(1), F.lit(n - 2)), lambda i: (F.get(e, i) > F.get(e, i - 1)) & (F.get(e, i) > F.get(e, i + 1)))
        start = F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("e"))
        return F.aggregate(inner, start, lambda s, i: F.when(s["e"].isNull() | (F.get(e, i) > s["e"]), F.struct(i.alias("i"), F.get(e, i).alias("e"))).otherwise(s))["i"]

    def tp(self, smooth: bool = True) -> Column:
        i, f, e = F.col("__ipeak"), lits(self.g.f), self.e
        if not smooth:
            return S.ratio(F.lit(1.0), F.get(f, i))
        f1, f2, f3 = (F.get(f, i + k) for k in (-1, 0, 1))
        e1, e2, e3 = (F.get(e, i + k) for k in (-1, 0, 1))
        q12, q13 = S.ratio(e1 - e2, f1 - f2), S.ratio(e1 - e3, f1 - f3)
        qa = S.ratio(q13 - q12, f3 - f2)
        return S.ratio(F.lit(2.0), f1 + f2 - S.ratio(q12, qa))

    def dspr(self, a: Column, b: Column, e: Column) -> Column:
        r = 1 - S.ratio(F.sqrt(a * a + b * b), e)
        return F.when(e > 0, F.sqrt(2 * (180 / math.pi) ** 2 * F.greatest(r, F.lit(0.0))))


def direction(s: Column, c: Column) -> Column:
    return S.pmod(270.0 - F.degrees(F.atan2(s, c)))


def hs(t: Terms, tail: bool = True) -> Column:
    return 4 * F.sqrt(t.energy(tail))


def hrms(t: Terms, tail: bool = True) -> Column:
    return F.sqrt(8 * t.energy(tail))


def hmax(t: Terms, dt: Column | float | None = None) -> Column:
    """k hs with k from the number of waves in dt seconds, or 1.86."""
    if dt is None:
        return 1.86 * hs(t)
    return F.sqrt(0.5 * F.log(F.bround(S.col(dt) / tm02(t)))) * hs(t)


def momf(t: Terms, mom: int = 0) -> Column:
    return t.m(mom)


def tm01(t: Terms) -> Column:
    return S.ratio(t.m(0), t.m(1))


def tm02(t: Terms) -> Column:
    return F.sqrt(S.ratio(t.m(0), t.m(2)))


def dm(t: Terms) -> Column:
    return direction(total(t.sin), total(t.cos))


def dp(t: Terms) -> Column:
    """The direction with the largest sum over frequencies, the first on ties."""
    g = t.g.directional()
    sums = F.col("__bydir")
    return F.get(lits(g.theta), (F.array_position(sums, F.array_max(sums)) - 1).cast("int"))


def dpm(t: Terms) -> Column:
    i = F.col("__ipeak")
    return direction(F.get(t.sin, i), F.get(t.cos, i))


def dspr(t: Terms) -> Column:
    return t.dspr(dot(t.sin, t.g.df), dot(t.cos, t.g.df), t.m(0))


def fdspr(t: Terms, mom: int = 1) -> Column:
    """The spread of each frequency."""
    s, c = (t.sin, t.cos) if mom == 1 else (momd_array(F.col(EFTH), t.g, "sin", mom), momd_array(F.col(EFTH), t.g, "cos", mom))
    three = F.zip_with(F.zip_with(s, c, lambda x, y: F.struct(x.alias("s"), y.alias("c"))), t.e, lambda p, e: F.struct(p.alias("p"), e.alias("e")))
    return F.transform(three, lambda x: t.dspr(x["p"]["s"], x["p"]["c"], x["e"]))


def dpspr(t: Terms, mom: int = 1) -> Column:
    return F.get(fdspr(t, mom), F.col("__ipeak"))


def tp(t: Terms, smooth: bool = True) -> Column:
    return t.tp(smooth)


def fp(t: Terms, smooth: bool = True) -> Column:
    return S.ratio(F.lit(1.0), t.tp(smooth))


def crsd(t: Terms, theta: float = 90.0) -> Column:
    return momd_array(F.col(EFTH), t.g, "both", 1, theta)


def swe(t: Terms) -> Column:
    v = F.sqrt(F.greatest(1 - S.ratio(t.m(2) * t.m(2), t.m(0) * t.m(4)), F.lit(0.0)))
    return F.when(v.isNull() | F.isnan(v) | (v < 0.001), 1.0).otherwise(v)


def sw(t: Terms) -> Column:
    v = F.sqrt(F.greatest(S.ratio(t.m(0) * t.m(2), t.m(1) * t.m(1)) - 1, F.lit(0.0)))
    return F.when(hs(t) >= 0.001, v)


def gw(t: Terms) -> Column:
    m0 = hs(t) * hs(t) / 16
    return root(S.ratio(m0, tm02(t) * tm02(t)) - S.ratio(m0 * m0, tm01(t) * tm01(t)))


def alpha(t: Terms, smooth: bool = True) -> Column:
    """The high-frequency tail's level: a mean over 1.35 fp < f < 2 fp; the last two frequencies where none lie there."""
    peak, f, g = fp(t, smooth), t.g.f, t.g
    terms = F.zip_with(t.e, lits(f), lambda e, x: F.struct(x.alias("f"), (e * F.pow(x, F.lit(5.0)) * F.exp(1.25 * F.pow(S.ratio(peak, x), F.lit(4.0)))).alias("v")))
    inner = F.filter(terms, lambda x: (x["f"] > 1.35 * peak) & (x["f"] < 2 * peak))
    used = F.when(F.size(inner) > 1, inner).when(F.size(inner) == 1, F.slice(F.filter(terms, lambda x: x["f"] > 1.35 * peak), 1, 2)).otherwise(F.slice(terms, max(1, g.nf - 1), 2))
    value = F.aggregate(used, F.lit(0.0), lambda s, x: s + x["v"])
    return F.when(peak.isNotNull(), (2 * math.pi) ** 4 / GRAVITY**2 * S.ratio(value, F.size(used).cast("double")))


def gamma(t: Terms, smooth: bool = True, scaled: bool = True) -> Column:
    """The peak enhancement against a Pierson-Moskowitz peak of the same height; 1 at least."""
    h = hs(t)
    v = S.ratio(F.array_max(t.e), 0.3125 * h * h * 0.2865048 * S.ratio(F.lit(1.0), fp(t, smooth)))
    if scaled:
        v = quartic(v)
    return F.when(v.isNull() | F.isnan(v) | (v < 1), 1.0).otherwise(v)


#: The quartic that corrects the peak ratio, lowest power first. Fixed values.
GAMMA_QUARTIC = (0.12974958, 0.32524949, 0.64087366, -0.13543292, 0.0378375)


def quartic(v: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(GAMMA_QUARTIC):
        out = out * v + c
    return out


def goda(t: Terms) -> Column:
    e2 = total(F.zip_with(t.e, lits(t.g.f * t.g.df), lambda e, w: e * e * w))
    return S.ratio(2 * e2, t.m(0) * t.m(0))


def _stokes(t: Terms, depth, part: str, theta: float) -> Column:
    """Stokes drift: the sum of density x 4 pi f k, times the component's cosine or sine."""
    by = {"x": lambda: momd_array(F.col(EFTH), t.g, "cos", 1, theta), "y": lambda: momd_array(F.col(EFTH), t.g, "sin", 1, theta), "all": lambda: t.e}[part]()
    k = F.transform(lits(t.g.f), lambda f: S.wavenumber(f, depth) * f * 4 * math.pi)
    return total(F.zip_with(F.zip_with(by, k, lambda e, w: e * w), lits(t.g.df), lambda x, w: x * w))


def uss_x(t: Terms, depth=None, theta: float = 90.0) -> Column:
    return _stokes(t, depth, "x", theta)


def uss_y(t: Terms, depth=None, theta: float = 90.0) -> Column:
    return _stokes(t, depth, "y", theta)


def uss(t: Terms, depth=None, theta: float = 90.0) -> Column:
    return _stokes(t, depth, "all", theta)


def mss(t: Terms, depth=None) -> Column:
    k2 = F.transform(lits(t.g.f), lambda f: S.wavenumber(f, depth) * S.wavenumber(f, depth))
    return total(F.zip_with(F.zip_with(t.e, k2, lambda e, w: e * w), lits(t.g.df), lambda x, w: x * w))


#: Every statistic by name: scalars, and arrays by frequency.
REGISTRY: dict[str, Callable[..., Column]] = {f.__name__: f for f in (hs, hrms, hmax, momf, tm01, tm02, dm, dp, dpm, dspr, fdspr, dpspr, tp, fp, crsd, swe, sw, gw, alpha, gamma, goda, uss_x, uss_y, uss, mss)}
DIRECTIONAL = {"dm", "dp", "dpm", "dspr", "fdspr", "dpspr", "crsd", "uss_x", "uss_y"}
#: Units and standard names, kept as column metadata.
UNITS = {"hs": "m", "hrms": "m", "hmax": "m", "tm01": "s", "tm02": "s", "tp": "s", "fp": "Hz", "dm": "degree", "dp": "degree", "dpm": "degree", "dspr": "degree", "fdspr": "degree", "dpspr": "degree", "uss": "m/s", "uss_x": "m/s", "uss_y": "m/s"}


def stats(frame: SpectraFrame, wanted: Iterable[str] | dict[str, dict], names: list[str] | None = None, fmin=None, fmax=None, dmin=None, dmax=None) -> DataFrame:
    """The other columns of the frame with the wanted statistics, in one projection.

    wanted: names, or names with keyword arguments; names renames them in order. Limits split the spectra first. NaN bins
    count as 0; a statistic that isn't defined (no peak, no energy) is null.
    """
    if any(x is not None for x in (fmin, fmax, dmin, dmax)):
        from .shape import split

        frame = split(frame, fmin, fmax, dmin, dmax)
    asked = dict(wanted) if isinstance(wanted, dict) else {w: {} for w in wanted}
    if unknown := [w for w in asked if w not in REGISTRY]:
        raise ValueError(f"no such statistic: {unknown}")
    if names is not None and len(names) != len(asked):
        raise ValueError("as many names as statistics are needed")
    g = frame.grid
    if DIRECTIONAL & asked.keys():
        g.directional()
    df = frame.df.withColumn(EFTH, clean(F.col(EFTH))).withColumn(ONED, oned_array(F.col(EFTH), g, skipna=False))
    if g.dir is not None and DIRECTIONAL & asked.keys():
        df = df.withColumn(SIN, momd_array(F.col(EFTH), g, "sin")).withColumn(COS, momd_array(F.col(EFTH), g, "cos"))
        if "dp" in asked:
            df = df.withColumn("__bydir", F.transform(F.sequence(F.lit(0), F.lit(g.nd - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(g.nf - 1)), F.lit(0.0), lambda s, i: s + F.get(F.col(EFTH), i * g.nd + j))))
    t = Terms(g)
    if {"tp", "fp", "dpm", "dpspr", "alpha", "gamma"} & asked.keys():
        df = df.withColumn("__ipeak", t.ipeak())
    out = [REGISTRY[w](t, **kw).alias(n, metadata={"units": UNITS[w]} if w in UNITS else {}) for (w, kw), n in zip(asked.items(), names or asked)]
    return df.select(*(c for c in frame.others if c not in (names or asked)), *out)


def mean_interval(df: DataFrame, time_col: str = "time") -> float | None:
    """Mean seconds between the distinct times of df; None with fewer than two. For hmax."""
    r = df.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b"), F.countDistinct(time_col).alias("n")).select(((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6).alias("s"), "n").first()
    return r["s"] / (r["n"] - 1) if r["n"] > 1 else None
