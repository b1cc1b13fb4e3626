"""Operators that change the spectra or their grid: projection, splitting, smoothing, regridding, rotation, scaling."""

from __future__ import annotations

import ast
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..functions import scalars as S
from ..grid import Grid
from . import stats as ST


def oned(frame: SpectraFrame, skipna: bool = True) -> SpectraFrame:
    """Spectra over frequency only."""
    return frame.map_spectra(ST.oned_array(F.col(EFTH), frame.grid, skipna), Grid(frame.grid.freq))


def to_energy(frame: SpectraFrame) -> SpectraFrame:
    """Energy of each bin: density times its steps of frequency and direction."""
    g = frame.grid
    w = np.repeat(g.df * g.dd, g.nd)
    return frame.map_spectra(F.zip_with(EFTH, ST.lits(w), lambda e, x: e * x))


def gather(frame: SpectraFrame, rows: list[tuple[int, int, float]], columns: list[int], grid: Grid) -> SpectraFrame:
    """Spectra whose row k is (1 - w) x row a + w x row b for (a, b, w) in rows, with the directions at columns."""
    g, e = frame.grid, F.col(EFTH)
    flat = [(a * g.nd + j, b * g.nd + j, w) for a, b, w in rows for j in columns]
    at = F.lit([x for x, _, _ in flat])
    if all(w == 0 for _, _, w in flat):
        return frame.map_spectra(F.transform(at, lambda i: F.get(e, i)), grid)
    three = F.arrays_zip(at.alias("a"), F.lit([y for _, y, _ in flat]).alias("b"), ST.lits(w for _, _, w in flat).alias("w"))
    return frame.map_spectra(F.transform(three, lambda x: F.when(x["w"] == 0, F.get(e, x["a"])).otherwise(F.get(e, x["a"]) * (1 - x["w"]) + F.get(e, x["b"]) * x["w"])), grid)


def split(frame: SpectraFrame, fmin=None, fmax=None, dmin=None, dmax=None, interpolate: bool = True) -> SpectraFrame:
    """Bins within the limits, which count; a bin is added at a frequency limit that isn't one (within 1e-10).

    Directions come out sorted if they are limited. Reversed limits and cut-offs outside the frequencies raise.
    """
    g = frame.grid
    for low, high in ((fmin, fmax), (dmin, dmax)):
        if low is not None and high is not None and high <= low:
            raise ValueError("limits are reversed")
    f = g.f
    rows = [(k, k, 0.0, f[k]) for k in np.argsort(f, kind="stable") if (fmin is None or f[k] >= fmin) and (fmax is None or f[k] <= fmax)]
    if interpolate:
        for limit, end in ((fmin, 0), (fmax, -1)):
            if limit is None or (rows and abs(rows[end][3] - limit) <= 1e-10):
                continue
            if not f.min() < limit < f.max():
                raise ValueError(f"the cut-off {limit} is outside the frequencies")
            a = int(np.flatnonzero(f < limit)[np.argmax(f[f < limit])])
            b = int(np.flatnonzero(f > limit)[np.argmin(f[f > limit])])
            row = (a, b, (limit - f[a]) / (f[b] - f[a]), limit)
            rows.insert(0 if end == 0 else len(rows), row)
    columns, dirs = list(range(g.nd)), g.dir
    if dmin is not None or dmax is not None:
        order = np.argsort(g.directional().theta, kind="stable")
        columns = [int(j) for j in order if (dmin is None or g.theta[j] >= dmin) and (dmax is None or g.theta[j] <= dmax)]
        dirs = tuple(g.theta[columns])
    if not rows or not columns:
        raise ValueError("nothing is left within the limits")
    return gather(frame, [(int(a), int(b), float(w)) for a, b, w, _ in rows], columns, Grid(tuple(r[3] for r in rows), dirs))


def sort_dirs(frame: SpectraFrame) -> SpectraFrame:
    order = [int(j) for j in np.argsort(frame.grid.theta, kind="stable")]
    return gather(frame, [(k, k, 0.0) for k in range(frame.grid.nf)], order, Grid(frame.grid.freq, tuple(frame.grid.theta[order])))


def smooth_block(block: np.ndarray, g: Grid, freq_window: int = 3, dir_window: int = 3) -> np.ndarray:
    """Centred means over full windows of bins, round the circle where the directions close it; other bins keep their value."""
    if freq_window % 2 == 0 or dir_window % 2 == 0:
        raise ValueError("windows must be odd")
    order = np.argsort(g.theta, kind="stable")
    x = block[:, :, order]
    a, b = freq_window // 2, dir_window // 2
    pad = b if g.circular else 0
    wide = np.concatenate([x[:, :, x.shape[2] - pad :], x, x[:, :, :pad]], axis=2) if pad else x
    out = x.copy()
    nf, nd = wide.shape[1] - 2 * a, wide.shape[2] - 2 * b
    if nf > 0 and nd > 0:
        mean = sum(wide[:, i : i + nf, j : j + nd] for i in range(freq_window) for j in range(dir_window)) / (freq_window * dir_window)
        first = 0 if pad else b
        part = out[:, a : a + nf, first : first + nd]
        part[...] = np.where(np.isnan(mean), part, mean)
    back = np.empty_like(out)
    back[:, :, order] = out
    return back


def smooth(frame: SpectraFrame, freq_window: int = 3, dir_window: int = 3) -> SpectraFrame:
    g = frame.grid
    if freq_window % 2 == 0 or dir_window % 2 == 0:
        raise ValueError("windows must be odd")
    return frame.apply(lambda x, _: smooth_block(x, g, freq_window, dir_window))


def linear_weights(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(new, old) weights of linear interpolation on ascending old; targets outside get none."""
    w = np.zeros((len(new), len(old)))
    for k, x in enumerate(new):
        if old[0] <= x <= old[-1]:
            i = min(int(np.searchsorted(old, x, "right")) - 1, len(old) - 2) if len(old) > 1 else 0
            if len(old) == 1:
                w[k, 0] = 1
            else:
                t = (x - old[i]) / (old[i + 1] - old[i])
                w[k, i], w[k, i + 1] = 1 - t, t
    return w


def regrid_weights(old: Grid, new: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and direction weights: below the lowest frequency density falls to 0 at 0 Hz, above the highest it is 0; directions go round."""
    order = np.argsort(old.f, kind="stable")
    f = old.f[order]
    if min(new.freq) < f[0]:
        wf = linear_weights(np.concatenate([[0.0], f]), new.f)[:, 1:]
    else:
        wf = linear_weights(f, new.f)
    out = np.zeros_like(wf)
    out[:, order] = wf
    if old.dir is None or new.dir is None:
        return out, np.eye(old.nd)
    turned = np.mod(old.theta, 360)
    d, first = np.unique(turned, return_index=True)
    target = np.mod(new.theta, 360)
    ext, src = list(d), list(first)
    if target.min() < d[0]:
        ext, src = [d[-1] - 360, *ext], [first[-1], *src]
    if target.max() > d[-1]:
        ext, src = [*ext, d[0] + 360], [*src, first[0]]
    w = linear_weights(np.array(ext), target)
    wd = np.zeros((new.nd, old.nd))
    for k, j in enumerate(src):
        wd[:, j] += w[:, k]
    return out, wd


def block_m0(x: np.ndarray, g: Grid) -> np.ndarray:
    """(hs / 4)**2 of each spectrum of a block, with the tail."""
    e = np.nansum(x, axis=2) * (g.dd if g.dir is not None else 1)
    return (e * g.df).sum(axis=1) + e[:, -1] * g.tail()


def regrid_block(x: np.ndarray, old: Grid, new: Grid, wf: np.ndarray, wd: np.ndarray, maintain_m0: bool = True) -> np.ndarray:
    y = np.einsum("af,nfd,bd->nab", wf, x, wd, optimize=True)
    if maintain_m0:
        with np.errstate(invalid="ignore", divide="ignore"):
            y *= (block_m0(x, old) / block_m0(y, new))[:, None, None]
    return y


def interp(frame: SpectraFrame, freq=None, dir=None, maintain_m0: bool = True) -> SpectraFrame:
    """Linear regridding, one matrix product a batch. Spectra without energy have no scale and become NaN if m0 is kept."""
    old = frame.grid
    new = Grid(tuple(freq) if freq is not None else old.freq, tuple(dir) if dir is not None else old.dir)
    wf, wd = regrid_weights(old, new)
    return frame.apply(lambda x, _: regrid_block(x, old, new, wf, wd, maintain_m0), new)


def interp_like(frame: SpectraFrame, other: SpectraFrame, maintain_m0: bool = True) -> SpectraFrame:
    return interp(frame, other.grid.freq, other.grid.dir, maintain_m0)


def interp_plane(frame: SpectraFrame, freq=None, dir=None, method: str = "linear") -> SpectraFrame:
    """Spectra on other frequencies and directions, without keeping energy; what lies outside the frequencies is 0.

    With the same directions: "linear" by frequency. With others: "nearest", in the plane whose radius is frequency.
    One matrix product a batch either way.
    """
    old = frame.grid
    new = Grid(tuple(freq) if freq is not None else old.freq, tuple(dir) if dir is not None else old.dir)
    if new.dir == old.dir:
        order = np.argsort(old.f, kind="stable")
        wf = np.zeros((new.nf, old.nf))
        wf[:, order] = linear_weights(old.f[order], new.f)
        return frame.apply(lambda x, _: np.einsum("af,nfd->nad", wf, x), new)
    if method != "nearest":
        raise ValueError("other directions need the method nearest, or interp")
    plane = lambda g: (g.f[:, None] * np.exp(1j * np.radians(270 - g.theta))[None, :]).ravel()
    near = np.array([np.abs(plane(old) - z).argmin() for z in plane(new.directional() and new)])
    return frame.apply(lambda x, _: x.reshape(len(x), -1)[:, near].reshape(-1, new.nf, new.nd), new)


def rotate(frame: SpectraFrame, angle: float) -> SpectraFrame:
    """Turn clockwise by degrees, then regrid to the old directions; m0 is kept."""
    g = frame.grid.directional()
    turned = Grid(g.freq, tuple(np.mod(g.theta + angle, 360)))
    wf, wd = regrid_weights(turned, g)
    return frame.apply(lambda x, _: regrid_block(x, turned, g, wf, wd))


def expression(text: str, hs: Column) -> Column:
    """A Column of arithmetic text over hs: numbers, hs, + - * / ** and parentheses only."""

    def walk(n) -> Column:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id == "hs":
            return hs
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            for kind, op in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: S.ratio(a, b)), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(n.op, kind):
                    return op()
        raise ValueError(f"not allowed in an expression: {text}")

    return walk(ast.parse(text, mode="eval"))


def scale_by_hs(frame: SpectraFrame, expr: str, hs_min=-math.inf, hs_max=math.inf, tp_min=-math.inf, tp_max=math.inf, dpm_min=-math.inf, dpm_max=math.inf) -> SpectraFrame:
    """Spectra times (expr(hs) / hs)**2 where hs, tp and dpm lie in their ranges, limits included; others stay."""
    limits = {"hs": (hs_min, hs_max), "tp": (tp_min, tp_max), "dpm": (dpm_min, dpm_max)}
    need = ["hs", *(k for k, (a, b) in limits.items() if k != "hs" and (a > -math.inf or b < math.inf))]
    kept = frame.with_df(frame.df.select(*frame.others, EFTH, F.col(EFTH).alias("__efth")))
    df = ST.stats(kept, need, names=[f"__{n}" for n in need])
    inside = F.lit(True)
    for n in need:
        a, b = limits[n]
        if a > -math.inf:
            inside = inside & (F.col(f"__{n}") >= a)
        if b < math.inf:
            inside = inside & (F.col(f"__{n}") <= b)
    factor = S.ratio(expression(expr, F.col("__hs")), F.col("__hs"))
    df = df.withColumn("__k", F.when(inside & factor.isNotNull(), factor * factor).otherwise(1.0))
    return frame.with_df(df.select(*frame.others, F.transform("__efth", lambda e: e * F.col("__k")).alias(EFTH)))


def rmse(frame: SpectraFrame, other: SpectraFrame, keys: list[str]) -> DataFrame:
    """keys with rmse: root of the summed squared differences of bin energies over that of the frame's own energies."""
    a, b = to_energy(frame).df.select(*keys, F.col(EFTH).alias("a")), to_energy(other).df.select(*keys, F.col(EFTH).alias("b"))
    if frame.grid != other.grid:
        raise ValueError("the grids differ")
    d2 = ST.total(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)))
    return a.join(b, keys).select(*keys, S.ratio(F.sqrt(d2), F.sqrt(ST.total(F.col("a")))).alias("rmse"))


def plot_data(frame: SpectraFrame, normalised: bool = True, logradius: bool = True, as_period: bool = False, efth_min: float = 1e-3) -> SpectraFrame:
    """Spectra as a polar plot wants them: directions sorted and closed, densities scaled to 0..1 over the frame and floored.

    The grid's frequencies are the radii: periods, or log10 of 1000 f, if asked for.
    """
    closed = sort_dirs(frame)
    g = closed.grid
    closed = gather(closed, [(k, k, 0.0) for k in range(g.nf)], [*range(g.nd), 0], Grid(g.freq, (*g.dir, g.dir[0] + 360)))
    if normalised:
        lim = closed.df.agg(F.min(F.array_min(EFTH)).alias("a"), F.max(F.array_max(EFTH)).alias("b")).first()
        a, b = lim["a"] or 0.0, lim["b"] or 1.0
        closed = closed.map_spectra(F.transform(EFTH, lambda e: F.greatest((e - a) / ((b - a) or 1.0), F.lit(efth_min))))
    r = 1 / closed.grid.f if as_period else np.log10(1000 * closed.grid.f) if logradius else closed.grid.f
    return closed.with_df(closed.df, Grid(tuple(r), closed.grid.dir))
