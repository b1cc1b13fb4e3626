"""Spectral partitioning: a row for each part of each spectrum, with column part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..functions import scalars as S
from ..grid import Grid
from . import shape as SH
from . import stats as ST
from . import watershed as W

#: Usual settings of the methods. Fixed values.
IHMAX, ANGLE_MAX, HS_MIN, KAPPA, ZETA, SWELLS, WINDOW, WSCUT, AGEFAC = 100, 30.0, 0.2, 0.4, 0.65, 3, 3, 0.3333, 1.7


def _kernel(frame: SpectraFrame, method, wind: tuple[str, str, str] | None, agefac: float, strict: bool, smooth: bool, freq_window: int, dir_window: int) -> SpectraFrame:
    """Parts of all spectra of a batch by method(x, shape, grid, mask). Directions are sorted first. A row without wind has an empty mask."""
    frame = SH.sort_dirs(frame)
    g = frame.grid.directional()

    def op(block: np.ndarray, extra: dict[str, np.ndarray]):
        block = np.nan_to_num(block)
        shapes = SH.smooth_block(block, g, freq_window, dir_window) if smooth else block
        mask = W.wind_masks(g, extra[wind[0]], extra[wind[1]], extra.get(wind[2]), agefac, strict) if wind else None
        return method(block, shapes, g, mask)

    return frame.explode_parts(op, tuple(c for c in wind or () if c in frame.df.columns))


def ptm1(frame, wspd="wspd", wdir="wdir", dpt="dpt", agefac=AGEFAC, wscut=WSCUT, swells: int | None = SWELLS, smooth=False, freq_window=WINDOW, dir_window=WINDOW, ihmax=IHMAX) -> SpectraFrame:
    """Part 0 is the wind sea, then swells by height. swells: their fixed number (empty ones fill up), or None for all."""
    return _kernel(frame, lambda x, s, g, m: W.ptm1(x, s, g, m, wscut, swells, ihmax), (wspd, wdir, dpt), agefac, True, smooth, freq_window, dir_window)


def ptm2(frame, wspd="wspd", wdir="wdir", dpt="dpt", agefac=AGEFAC, wscut=WSCUT, swells: int | None = SWELLS, smooth=False, freq_window=WINDOW, dir_window=WINDOW, ihmax=IHMAX) -> SpectraFrame:
    """As ptm1, with the wind-driven bins of swells in part 1."""
    return _kernel(frame, lambda x, s, g, m: W.ptm2(x, s, g, m, wscut, swells, ihmax), (wspd, wdir, dpt), agefac, True, smooth, freq_window, dir_window)


def ptm3(frame, parts: int | None = 3, smooth=False, freq_window=WINDOW, dir_window=WINDOW, ihmax=IHMAX) -> SpectraFrame:
    """Parts by height, without wind."""
    return _kernel(frame, lambda x, s, g, m: W.ptm3(x, s, g, parts, ihmax), None, AGEFAC, True, smooth, freq_window, dir_window)


def hp01(frame, wspd="wspd", wdir="wdir", dpt="dpt", agefac=AGEFAC, wscut=WSCUT, swells: int | None = SWELLS, smooth=False, freq_window=WINDOW, dir_window=WINDOW, kappa=KAPPA, zeta=ZETA, angle_max=ANGLE_MAX, hs_min=HS_MIN, noise_a=None, noise_b=0.0, ihmax=IHMAX, combine_extra_swells=True) -> SpectraFrame:
    """Wind sea and merged swell systems."""
    kw = dict(kappa=kappa, zeta=zeta, angle_max=angle_max, hs_min=hs_min, noise_a=noise_a, noise_b=noise_b, combine_extra_swells=combine_extra_swells)
    return _kernel(frame, lambda x, s, g, m: W.hp01(x, s, g, m, wscut, swells, ihmax, **kw), (wspd, wdir, dpt), agefac, False, smooth, freq_window, dir_window)


def _masked(frame: SpectraFrame, parts: list) -> SpectraFrame:
    """A row for each part; a part is a Column function of a bin's index, from 0, or a list of 0/1 weights."""
    e = F.col(EFTH)
    chosen = lambda p: F.transform(e, lambda x, i: F.when(p(i), x).otherwise(0.0))
    built = [chosen(p) if callable(p) else F.zip_with(e, ST.lits(p), lambda x, w: x * w) for p in parts]
    rows = frame.df.select(*(c for c in frame.others if c != "part"), F.posexplode(F.array(*built)).alias("part", EFTH))
    return frame.with_df(rows)


def ptm4(frame: SpectraFrame, wspd="wspd", wdir="wdir", dpt: str | None = "dpt", agefac=AGEFAC) -> SpectraFrame:
    """Part 0: bins of an age that the wind drives; part 1: the others. No wind: all in part 1."""
    g = frame.grid.directional()
    depth = F.col(dpt) if dpt in frame.df.columns else None
    freq, dirs = ST.lits(g.f), ST.lits(g.theta)
    sea = lambda i: F.coalesce(S.waveage(F.get(freq, F.floor(i / g.nd).cast("int")), F.get(dirs, F.pmod(i, F.lit(g.nd))), F.col(wspd), F.col(wdir), depth, agefac), F.lit(False))
    return _masked(frame, [sea, lambda i: ~sea(i)])


def ptm5(frame: SpectraFrame, fcut: float, interpolate: bool = True) -> SpectraFrame:
    """Part 0: frequencies from fcut on; part 1: up to fcut, which both have. fcut joins the frequencies by regridding."""
    g = frame.grid
    if interpolate and fcut not in g.freq:
        frame = SH.interp(frame, freq=sorted({*g.freq, fcut}))
        g = frame.grid
    by = np.repeat(g.f, g.nd)
    return _masked(frame, [(by >= fcut) * 1.0, (by <= fcut) * 1.0])


def bbox(frame: SpectraFrame, bboxes: list[dict]) -> SpectraFrame:
    """A part for each box (fmin, fmax, dmin, dmax; limits count, missing ones are open), then what no box has.

    Boxes that overlap by more than an edge raise. Directions outside 0..360 aren't turned.
    """
    if not bboxes:
        raise ValueError("one box at least")
    g = frame.grid
    full = {"fmin": min(g.freq), "fmax": max(g.freq), "dmin": g.theta.min(), "dmax": g.theta.max()}
    boxes = [{k: full[k] if b.get(k) is None else b[k] for k in full} for b in bboxes]
    for i, a in enumerate(boxes):
        if a["fmin"] > a["fmax"] or a["dmin"] > a["dmax"]:
            raise ValueError("a box's limits are reversed")
        if any(overlap(a, b) for b in boxes[:i]):
            raise ValueError("boxes overlap")
    f, d = np.repeat(g.f, g.nd), np.tile(g.theta, g.nf)
    masks = [((f >= b["fmin"]) & (f <= b["fmax"]) & (d >= b["dmin"]) & (d <= b["dmax"])) * 1.0 for b in boxes]
    return _masked(frame, [*masks, (sum(masks) == 0) * 1.0])


def overlap(a: dict, b: dict) -> bool:
    """Whether two boxes share an area; touching edges don't count."""
    return a["fmin"] < b["fmax"] and b["fmin"] < a["fmax"] and a["dmin"] < b["dmax"] and b["dmin"] < a["dmax"]


def merge_parts(frame: SpectraFrame, keys: list[str], method: str = "sum") -> SpectraFrame:
    """Parts of each spectrum put together bin by bin: "sum", "max", "min" or "mean"."""
    if method not in ("sum", "max", "min", "mean"):
        raise ValueError(f"no such method: {method}")
    # a spectrum has few parts: their arrays come together and are folded bin by bin
    order = ["part"] if "part" in frame.df.columns and "part" not in keys else []  # sums of doubles don't depend on the shuffle then
    parts = frame.df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, EFTH))).alias("__s"))
    parts = parts.select(*keys, F.transform("__s", lambda x: x[EFTH]).alias("__parts"))
    zipped = {"sum": lambda a, b: a + b, "mean": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}[method]
    folded = F.aggregate(F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0))), F.get("__parts", F.lit(0)), lambda a, b: F.zip_with(a, b, zipped))
    if method == "mean":
        folded = F.transform(folded, lambda x: x / F.size("__parts"))
    return frame.with_df(parts.select(*keys, folded.alias(EFTH)))


def count_parts(frame: SpectraFrame, ihmax: int = IHMAX) -> int:
    """The largest number of parts of any spectrum, 1 at least."""
    g = frame.grid
    counted = frame.apply(lambda x, _: np.broadcast_to(W.watersheds(np.nan_to_num(x), ihmax).max(axis=(1, 2), initial=0)[:, None, None].astype(float), x.shape))
    return max(1, int(counted.df.agg(F.max(F.get(F.col(EFTH), F.lit(0)))).first()[0] or 0))


METHODS = {"ptm1": ptm1, "ptm2": ptm2, "ptm3": ptm3, "ptm4": ptm4, "ptm5": ptm5, "hp01": hp01, "bbox": bbox}
__all__ = [*METHODS, "merge_parts", "count_parts", "overlap", "METHODS", "Grid"]
