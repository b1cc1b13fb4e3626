"""Parametric spectra from columns of parameters, reconstruction from partitions, and fits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame, pack, unpack
from ..functions import scalars as S
from ..functions.scalars import Value, col
from ..grid import GRAVITY, Grid
from . import partition as P
from . import stats as ST


def blocks(f: Callable[..., np.ndarray], *values: Value, partial: bool = False) -> Column:
    """An array column of f(values): numbers come as numpy columns (n, 1), a batch at a time, and f gives (n, bins). A value that is null, or a bin that f masks, gives nulls; partial: f takes nulls as NaN, and NaN bins are null."""

    def op(*columns: pa.Array) -> pa.Array:
        lost = np.zeros(len(columns[0]), bool)
        for c in columns:
            if c.null_count:
                lost |= c.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            found = f(*(c.to_numpy(zero_copy_only=False).astype(float)[:, None] for c in columns))
        x = np.ma.getdata(found)
        bad = np.ma.getmask(found)
        if partial:
            bad, lost = np.ma.getmaskarray(found) | np.isnan(x), np.zeros(len(x), bool)
        if bad is np.ma.nomask and not lost.any():
            return pack(x)
        bad = np.broadcast_to(bad, x.shape) | lost[:, None]
        flat = pa.array(np.ascontiguousarray(x).reshape(-1), mask=bad.reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)

    return F.arrow_udf(op, "array<double>")(*(col(v).cast("double") for v in values))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, masked where b is 0."""
    out = a / b
    bad = np.ma.getmask(out) | (np.ma.getdata(b) == 0)
    return np.ma.masked_array(np.ma.getdata(out), np.broadcast_to(bad, out.shape)) if bad.any() else out


def scaled(e: np.ndarray, g: Grid, hs: np.ndarray | None) -> np.ndarray:
    """Density scaled to a height; spectra without energy, or with a bin that isn't known, are masked."""
    if hs is None:
        return e
    x = np.ma.getdata(e)
    m0 = np.zeros((len(x), 1))
    for k in range(g.nf):  # in the order of frequencies
        m0[:, 0] += x[:, k] * g.df[k]
    m0[:, 0] += x[:, -1] * g.tail()
    k = ratio(hs * hs / 16, m0)
    if np.ma.getmask(e) is not np.ma.nomask:
        k = np.ma.masked_array(np.ma.getdata(k), np.ma.getmaskarray(k) | np.ma.getmaskarray(e).any(axis=1, keepdims=True))
    return e * k


def _hs(hs: Value | None) -> tuple[Value, ...]:
    return () if hs is None else (hs,)


def pm_values(f: np.ndarray, fp: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    own = f > 0
    out = alpha * GRAVITY**2 * (2 * math.pi) ** -4 * np.where(own, f, 1.0) ** -5.0 * np.exp(-1.25 * ratio(f, fp) ** -4.0)
    return out if own.all() else np.ma.where(own, out, 0.0)


def jonswap_values(g: Grid, fp, alpha, gamma, sigma_a, sigma_b, hs=None) -> np.ndarray:
    f = g.f[None, :]
    sigma = np.where(f <= fp, sigma_a, sigma_b)
    shape = pm_values(f, fp, alpha) * gamma ** np.exp(ratio(-(f - fp) * (f - fp), 2 * sigma * sigma * fp * fp))
    return scaled(shape, g, hs)


def pierson_moskowitz(g: Grid, fp: Value, alpha: Value = 0.0081, hs: Value | None = None) -> Column:
    return blocks(lambda fp, alpha, hs=None: scaled(pm_values(g.f[None, :], fp, alpha), g, hs), fp, alpha, *_hs(hs))


def jonswap(g: Grid, fp: Value, alpha: Value = 0.0081, gamma: Value = 3.3, sigma_a: float = 0.07, sigma_b: float = 0.09, hs: Value | None = None) -> Column:
    return blocks(lambda fp, alpha, gamma, hs=None: jonswap_values(g, fp, alpha, gamma, sigma_a, sigma_b, hs), fp, alpha, gamma, *_hs(hs))


def tma(g: Grid, fp: Value, dep: Value, alpha: Value = 0.0081, gamma: Value = 3.3, sigma_a: float = 0.07, sigma_b: float = 0.09, hs: Value | None = None) -> Column:
    """jonswap with the depth factor tanh(kh)**2 / (1 + 2kh / sinh(2kh)), scaled again."""

    def made(fp, dep, alpha, gamma, hs=None):
        omega = 2 * math.pi * g.f[None, :]
        y = 0.10194 * omega * omega * dep
        a = 1 + 0.6522 * y + 0.4622 * y**2.0 + 0.0864 * y**4.0 + 0.0675 * y**5.0
        kh = ratio(y * np.sqrt(1 + ratio(np.ones_like(y), y * a)), dep) * dep  # as scalars.wavenumber
        factor = np.tanh(kh) * np.tanh(kh) / (1 + ratio(2 * kh, np.sinh(np.minimum(2 * kh, 700.0))))
        return scaled(jonswap_values(g, fp, alpha, gamma, sigma_a, sigma_b, hs) * factor, g, hs)

    return blocks(made, fp, dep, alpha, gamma, *_hs(hs))


def gaussian(g: Grid, hs: Value, fp: Value, gw: Value) -> Column:
    def made(hs, fp, gw):
        height = ratio(hs * hs / 16, gw * math.sqrt(2 * math.pi))
        return scaled(height * np.exp(-0.5 * ratio(g.f[None, :] - fp, gw) ** 2.0), g, hs)

    return blocks(made, hs, fp, gw)


def conditional(cond: Column, when_true: Column, when_false: Column) -> Column:
    """One shape or another, row by row."""
    return F.when(cond, when_true).otherwise(when_false)


def cartwright_values(d: np.ndarray, dm, dspr, under_90: bool) -> np.ndarray:
    turn = np.abs(d - dm)
    turn = np.where(turn > 180, 360 - turn, turn)
    s = ratio(np.full_like(dspr, 2.0), np.radians(dspr) ** 2.0) - 1
    g = np.abs(np.cos(0.5 * np.radians(turn))) ** (2 * s)
    return np.where(turn <= 90, g, 0.0) if under_90 else g


def _normal(a: np.ndarray, g: Grid) -> np.ndarray:
    """Values over directions, the last axis, to a density per degree."""
    t = np.zeros((*a.shape[:-1], 1))
    for j in range(a.shape[-1]):  # in the order of directions
        t[..., 0] += np.ma.getdata(a)[..., j]
    return ratio(a, t * (2 * math.pi / g.nd)) * (math.pi / 180)


def cartwright(g: Grid, dm: Value, dspr: Value, under_90: bool = False) -> Column:
    """Spreading over the directions."""
    return blocks(lambda dm, dspr: _normal(cartwright_values(g.directional().theta[None, :], dm, dspr, under_90), g), dm, dspr)


def asymmetric(g: Grid, dm: Value, dpm: Value, dspr: Value, dpspr: Value, fm: Value, fp: Value) -> Column:
    """Spreading by frequency: direction and spread vary linearly with f - fp within limits; row-major over (freq, dir)."""
    clip = lambda x, a, b: np.fmax(np.fmin(x, b), a)

    def made(dm, dpm, dspr, dpspr, fm, fp):
        gap, f = np.fmax(fm - fp, 0.001), g.f[None, :]
        theta = clip(dpm + (dm - dpm) / gap * (f - fp), 0.5 * dpm, 1.5 * dpm)
        sigma = clip(dpspr + np.fmax(dspr - dpspr, 0.0) / gap * (f - fp), 0.5 * dspr, 1.5 * np.fmax(dspr, dpspr))
        sigma = np.fmax(sigma, 0.14)
        return _normal(cartwright_values(g.directional().theta[None, None, :], theta[:, :, None], sigma[:, :, None], False), g).reshape(len(dm), -1)

    return blocks(made, dm, dpm, dspr, dpspr, fm, fp, partial=True)


def spread_out(e: Column, spreading: Column, g: Grid, by_frequency: bool = False) -> Column:
    """Density over frequency times spreading; NaN and null become 0."""

    def op(e: pa.Array, spreading: pa.Array) -> pa.Array:
        rows = unpack(spreading, g if by_frequency else Grid(tuple(range(1, g.nd + 1))))
        with np.errstate(all="ignore"):
            out = unpack(e, Grid(g.freq)) * rows.reshape(len(e), g.nf if by_frequency else 1, g.nd)
        return pack(np.where(np.isnan(out), 0.0, out))

    return F.arrow_udf(op, "array<double>")(e, spreading)


SHAPES = {"pierson_moskowitz": pierson_moskowitz, "jonswap": jonswap, "tma": tma, "gaussian": gaussian}
SPREADS = {"cartwright": cartwright, "asymmetric": asymmetric}


def construct_partition(df: DataFrame, g: Grid, freq_name: str = "jonswap", dir_name: str = "cartwright", freq_kwargs: dict | None = None, dir_kwargs: dict | None = None) -> SpectraFrame:
    """df with efth built from shapes by name; string arguments are columns of df."""
    if freq_name not in SHAPES or dir_name not in SPREADS:
        raise ValueError(f"shapes are {sorted(SHAPES)}, spreadings {sorted(SPREADS)}")
    bound = lambda kw: {k: F.col(v) if isinstance(v, str) else v for k, v in (kw or {}).items()}
    rows = df.withColumn("__e", SHAPES[freq_name](g, **bound(freq_kwargs))).withColumn("__g", SPREADS[dir_name](g, **bound(dir_kwargs)))
    return SpectraFrame(rows.withColumn(EFTH, spread_out(F.col("__e"), F.col("__g"), g, dir_name == "asymmetric")).drop("__e", "__g"), g)


NEEDS = {"pierson_moskowitz": ["hs", "fp"], "jonswap": ["hs", "fp", "gamma"], "tma": ["hs", "fp", "gamma"], "gaussian": ["hs", "fp", "gw"], "cartwright": ["dm", "dspr"], "asymmetric": ["dm", "dpm", "dspr", "dpspr", "fp"]}


def partition_and_reconstruct(frame: SpectraFrame, keys: list[str], parts: int = 4, freq_name: str = "jonswap", dir_name: str = "cartwright", partition_method: str = "ptm3", method_combine: str = "max", **kw) -> SpectraFrame:
    """Partition, describe each part, rebuild it from its statistics, and put the parts together again."""
    count = {"parts": parts} if partition_method == "ptm3" else {"swells": parts - 1} if partition_method in ("ptm1", "hp01") else {"swells": parts - 2} if partition_method == "ptm2" else {}
    split = P.METHODS[partition_method](frame, **count, **kw)
    names = list(dict.fromkeys([*NEEDS[freq_name], *NEEDS[dir_name], *(["tm01"] if dir_name == "asymmetric" else [])]))
    known = ST.stats(split, names)
    if dir_name == "asymmetric":
        known = known.withColumn("fm", S.ratio(F.lit(1.0), F.col("tm01")))
    freq_kwargs = {n: n for n in NEEDS[freq_name]} | ({"dep": "dpt"} if freq_name == "tma" else {})
    dir_kwargs = {n: n for n in NEEDS[dir_name]} | ({"fm": "fm"} if dir_name == "asymmetric" else {})
    return P.merge_parts(construct_partition(known, split.grid, freq_name, dir_name, freq_kwargs, dir_kwargs), keys, method_combine)


def log_jonswap(f: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the shape at parameters p (n, 3: fp, hs, gamma), and its derivatives by fp and gamma."""
    fp, gamma = p[:, 0, None], p[:, 2, None]
    u, sigma = f / fp - 1, np.where(f <= fp, 0.07, 0.09)
    near = np.exp(-(u**2) / (2 * sigma**2))
    by_fp = -5 * fp**3 / f**4 + np.log(gamma) * near * u * f / (sigma * fp) ** 2
    return -5 * np.log(f) - 1.25 * (fp / f) ** 4 + np.log(gamma) * near, np.stack([by_fp, near / gamma], axis=2)


def log_gaussian(f: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As log_jonswap, for p of fp, hs, gw."""
    d, gw = f - p[:, 0, None], p[:, 2, None]
    return -0.5 * (d / gw) ** 2, np.stack([d / gw**2, d**2 / gw**3], axis=2)


def modelled(log_shape, g: Grid, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities (n, nf) of the given wave height, tail included, and their derivatives (n, nf, 3)."""
    e, slope = np.zeros((len(p), g.nf)), np.zeros((len(p), g.nf, 3))
    own = np.flatnonzero(g.f > 0)
    weight = (g.df + np.where(np.arange(g.nf) == g.nf - 1, g.tail(), 0.0))[own]
    with np.errstate(all="ignore"):
        log, by = log_shape(g.f[own], p)
        shape = np.exp(log - log.max(axis=1, keepdims=True))
        part = shape * weight / (shape * weight).sum(axis=1, keepdims=True)
        density = part / weight * p[:, 1, None] ** 2 / 16
        mean = (part[:, :, None] * by).sum(axis=1, keepdims=True)
        e[:, own] = density
        slope[:, own, 1] = 2 * density / p[:, 1, None]
        slope[:, own, 0::2] = density[:, :, None] * (by - mean)
    return e, slope


def least_squares(log_shape, g: Grid, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 400) -> np.ndarray:
    """(n, 3): Levenberg-Marquardt with clipped parameters for all rows of y at once; NaN where it doesn't settle.

    Each row has its own damping: a step that lowers its cost is taken and damps less, another one damps more.
    """
    p, out = np.clip(start, low, high), np.full(start.shape, np.nan)
    damp, failed = np.full(len(p), 1e-3), np.zeros(len(p), int)
    model, slope = modelled(log_shape, g, p)
    rest = model - y
    cost = (rest**2).sum(axis=1)
    live = np.flatnonzero(np.isfinite(cost))
    for _ in range(rounds):
        if not len(live):
            break
        a = np.einsum("nfi,nfj->nij", slope[live], slope[live])
        b = np.einsum("nfi,nf->ni", slope[live], rest[live])
        diagonal = np.maximum(np.einsum("nii->ni", a), 1e-12)
        a[:, [0, 1, 2], [0, 1, 2]] += damp[live, None] * diagonal
        try:
            move = -np.linalg.solve(a, b[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            move = -(np.linalg.pinv(a) @ b[:, :, None])[:, :, 0]
        q = np.clip(p[live] + move, low, high)
        model, new_slope = modelled(log_shape, g, q)
        new_rest = model - y[live]
        new_cost = (new_rest**2).sum(axis=1)
        better = np.isfinite(new_cost) & (new_cost < cost[live])
        with np.errstate(invalid="ignore"):
            small = (cost[live] - new_cost <= 1e-12 * np.maximum(cost[live], 1e-300)) & (np.abs(q - p[live]) <= 1e-8 * np.maximum(np.abs(p[live]), 1e-8)).all(axis=1)
        took = live[better]
        p[took], slope[took], rest[took], cost[took] = q[better], new_slope[better], new_rest[better], new_cost[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 8, 1e-12), damp[live] * 4)
        failed[live] = np.where(better, 0, failed[live] + 1)
        done = better & (small | (new_cost < 1e-24)) | (failed[live] >= 30)
        out[live[done]] = p[live[done]]
        live = live[~done]
    return out


def _fit(frame: SpectraFrame, third: str, log_shape, guess: float, bounded: bool) -> SpectraFrame:
    """The frame's other columns with fp, hs and a third parameter, and efth the fitted density over frequency. No fit: null and NaN."""
    g = frame.grid
    flat = Grid(g.freq)
    start = ST.stats(frame.with_df(frame.df.withColumn("__e", ST.oned_array(F.col(EFTH), g))), {"fp": {}, "hs": {}}, names=["__fp", "__hs"])
    names = [c for c in start.columns if c not in ("__e", "__fp", "__hs")]
    from pyspark.sql import types as T

    rows = start.select(*names, "__e", "__fp", "__hs")
    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in ("fp", "hs", third)), T.StructField(EFTH, T.ArrayType(T.DoubleType()))])
    low = np.array([min(g.freq), 1e-10, 0.1]) if bounded else np.array([-np.inf, -np.inf, -np.inf])
    high = np.array([max(g.freq), 30.0, 20.0]) if bounded else np.array([np.inf, np.inf, np.inf])

    def op(batches):
        for b in batches:
            e = unpack(b.column(len(names)), flat)[:, :, 0]
            fp, hs = (b.column(len(names) + k).to_numpy(zero_copy_only=False) for k in (1, 2))
            found, shapes = np.full((len(e), 3), np.nan), np.full(e.shape, np.nan)
            known = np.flatnonzero(np.isfinite(fp) & np.isfinite(hs) & (hs > 0))
            if len(known):
                found[known] = least_squares(log_shape, g, e[known], np.stack([fp[known], hs[known], np.full(len(known), guess)], axis=1), low, high)
                fitted = np.flatnonzero(np.isfinite(found[:, 0]))
                shapes[fitted] = modelled(log_shape, g, found[fitted])[0]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(found[:, j], from_pandas=True) for j in range(3)), pack(shapes)], [*names, "fp", "hs", third, EFTH])

    return SpectraFrame(rows.mapInArrow(op, schema), flat)


def fit_jonswap(frame: SpectraFrame, gamma0: float = 1.5) -> SpectraFrame:
    return _fit(frame, "gamma", log_jonswap, gamma0, True)


def fit_gaussian(frame: SpectraFrame, gw0: float = 1.5) -> SpectraFrame:
    return _fit(frame, "gw", log_gaussian, gw0, False)
