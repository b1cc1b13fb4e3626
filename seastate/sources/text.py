"""Readers of text formats of models and buoys.

Each format has a parser, a plain function of one file's text that returns (grid, rows); a row is a dict with efth as a
numpy block and any of time, lat, lon, site, wspd, wdir, dpt. `read` runs a parser on the executors, file by file.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import itertools
import json
import math
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import EFTH, SpectraFrame
from ..grid import Grid
from ..session import prepare
from . import files as FS

Parsed = tuple[Grid, list[dict]]
KINDS = {"time": T.TimestampNTZType(), "site": T.StringType()}


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split()]


def spreading(theta: np.ndarray, dm: np.ndarray, dspr: np.ndarray) -> np.ndarray:
    """Cosine-squared spreading (nf, nd) per degree, by mean direction and spread of each frequency."""
    turn = np.abs(theta[None, :] - dm[:, None]) % 360
    turn = np.radians(np.minimum(turn, 360 - turn)) / 2
    with np.errstate(all="ignore"):
        s = 2 / np.radians(dspr) ** 2 - 1
        g = np.abs(np.cos(turn)) ** (2 * s[:, None])
        return g / (g.sum(axis=1, keepdims=True) * 2 * np.pi / len(theta)) * np.pi / 180


def fourier(theta: np.ndarray, r1, a1, r2, a2, weighted: bool = False) -> np.ndarray:
    """Directional distribution (nf, nd) per degree from the first two harmonics."""
    w1, w2 = (2 / 3, 1 / 6) if weighted else (1.0, 1.0)
    d = 0.5 + w1 * r1[:, None] * np.cos(np.radians(theta[None, :] - a1[:, None])) + w2 * r2[:, None] * np.cos(2 * np.radians(theta[None, :] - a2[:, None]))
    return d / np.pi * np.pi / 180


@dataclass(frozen=True)
class SwanHead:
    """What a SWAN file's head says: the grid in the order that rows have, that order, the places, the factor of densities."""

    grid: Grid
    order: tuple[int, ...]
    points: tuple[tuple[float, float], ...]
    timed: bool
    factor: float


def swan_head(lines: Iterator[str], dirorder: bool = True) -> SwanHead:
    """The head, taken from lines without comments; they stand at the first record then."""
    freq, dirs, cartesian, points, timed, factor = [], [], False, [], False, 1.0
    word = lambda line: line.split()[0].upper()
    if word(next(lines)) != "SWAN":
        raise ValueError("not a SWAN file")
    while True:
        key = word(next(lines))
        if key == "TIME":
            timed = True
            next(lines)
        elif key in ("LONLAT", "LOCATIONS"):
            points = [tuple(numbers(next(lines))[:2]) for _ in range(int(next(lines).split()[0]))]
        elif key in ("AFREQ", "RFREQ"):
            freq = [float(next(lines).split()[0]) for _ in range(int(next(lines).split()[0]))]
        elif key in ("NDIR", "CDIR"):
            cartesian = key == "CDIR"
            dirs = [float(next(lines).split()[0]) for _ in range(int(next(lines).split()[0]))]
        elif key == "QUANT":
            next(lines)
            next(lines)
            unit = next(lines).split()[0]
            factor = 1 / (1025 * 9.81) if unit.upper().startswith("J") else 1.0
            next(lines)
            break
    d = np.array(dirs)
    d = np.mod(270 - d, 360) if cartesian else np.mod(d, 360)
    order = np.argsort(d, kind="stable") if dirorder else np.arange(len(d))
    return SwanHead(Grid(tuple(freq), tuple(d[order]) if dirs else None), tuple(order.tolist()) if dirs else (0,), tuple(points), timed, factor)


def swan_time(line: str) -> dt.datetime:
    return dt.datetime.strptime(line.split()[0][:15], "%Y%m%d.%H%M%S")


def swan_records(lines: Iterator[str], head: SwanHead, wanted: Callable[[dict], bool] | None = None, dense: bool = True, ends: Callable[[dt.datetime], bool] | None = None) -> Iterator[dict]:
    """Rows of the records that follow: NODATA is NaN, ZERO is 0. Rows that aren't wanted by time and place, and all if not dense, are passed over unread. ends: by a record's time, whether reading stops before it."""
    g, order = head.grid, list(head.order)
    shape, time = (g.nf, g.nd), None
    while True:
        if head.timed:
            stamp = next(lines, None)
            if stamp is None or not stamp.strip():
                return
            time = swan_time(stamp)
            if ends is not None and ends(time):
                return
        for k, (x, y) in enumerate(head.points):
            row = {"time": time, "site": str(k), "lon": x, "lat": y}
            read = wanted is None or wanted(row)
            kind = next(lines).split()[0].upper()
            if kind not in ("NODATA", "ZERO"):
                scale, own = next(lines), [next(lines) for _ in range(g.nf)]
            if not read:
                continue
            if dense and kind == "NODATA":
                row[EFTH] = np.full(shape, np.nan)
            elif dense and kind == "ZERO":
                row[EFTH] = np.zeros(shape)
            elif dense:
                block = np.full(shape, np.nan)
                for i, line in enumerate(own):
                    try:
                        values = numbers(line)
                    except ValueError:
                        continue
                    if len(values) == g.nd:
                        block[i] = values
                row[EFTH] = (block * float(scale.split()[0]) * head.factor)[:, order]
            yield row
        if not head.timed:
            return


def parse_swan(text: str, name: str = "", dirorder: bool = True) -> Parsed:
    """SWAN spectra: NODATA is NaN, ZERO is 0; cartesian directions become nautical, energies in J are divided by rho g."""
    lines = iter(line for line in text.splitlines() if not line.startswith("$"))
    head = swan_head(lines, dirorder)
    return head.grid, list(swan_records(lines, head))


def parse_tab(text: str) -> dict[dt.datetime, dict[str, float]]:
    """The rows of a SWAN table by time: wspd and wdir (coming from) of its wind components, and dpt."""
    names, out = [], {}
    for line in text.splitlines():
        if line.startswith("%"):
            names = line[1:].split() if "Time" in line else names
        elif line.strip():
            row = dict(zip(names, line.split()))
            values: dict[str, float] = {}
            if {"X-wsp", "Y-wsp"} <= set(row):
                u, v = float(row["X-wsp"]), float(row["Y-wsp"])
                values = {"wspd": math.hypot(u, v), "wdir": (270 - math.degrees(math.atan2(v, u))) % 360}
            if dpt := next((row[c] for c in row if c.lower() in ("dep", "depth")), None):
                values["dpt"] = float(dpt)
            out[swan_time(row["Time"])] = values
    return out


def octopus_records(lines: Iterable[str]) -> Iterator[tuple[Grid, dict]]:
    """(grid of the first record, row) of each record of a file's lines, one after another; see parse_octopus()."""
    lines, grid, site, line = iter(lines), None, 0, None
    ended = ValueError("an Octopus file ends inside a block")

    def following() -> str:
        if (line := next(lines, None)) is None:
            raise ended
        return line

    for line in lines:
        if not line.startswith("nfreqs"):
            continue
        nf, nd, nrec, lat, lon, depth = (kind((line if k == 0 else following()).split(",")[1]) for k, kind in enumerate((int, int, int, float, float, float)))
        for _ in range(nrec):
            while not following().startswith("CCYYMM"):
                pass
            part = [p.strip().lstrip("'") for p in following().split(",")]
            freq = [float(x) for x in following().split(",")[1 : nf + 1]]
            table = np.array([[float(x) for x in following().split(",")[: nf + 1]] for _ in range(nd)])
            grid = grid or Grid(tuple(freq), tuple(table[:, 0]))
            yield grid, {"time": dt.datetime.strptime(part[0] + part[1], "%Y%m%d%H%M"), "site": str(site), "lon": lon, "lat": lat, "dpt": depth, "wdir": float(part[3]), "wspd": float(part[4]), EFTH: table[:, 1:].T / (grid.df[:, None] * grid.dd)}
        site += 1
    if grid is None:
        raise ValueError("not an Octopus file")


def parse_octopus(text: str, name: str = "") -> Parsed:
    """Blocks of a header and records; energies of bins become densities. A file may hold blocks of several sites."""
    found = list(octopus_records(text.splitlines()))
    return found[0][0], [row for _, row in found]


def parse_ww3_station(text: str, name: str = "") -> Parsed:
    """Point output of a global model: directions in radians going to, densities per radian."""
    head = re.match(r"\s*'[^']*'\s+(\d+)\s+(\d+)\s+(\d+)", text)
    if not head:
        raise ValueError("not a point output file")
    nf, nd, points = map(int, head.groups())
    body = text[text.index("\n") + 1 :]
    quoted = re.findall(r"'([^']*)'", body)
    tokens = re.sub(r"'[^']*'", " ", body).split()
    freq, rad = np.array(tokens[:nf], float), np.array(tokens[nf : nf + nd], float)
    dirs = np.mod(np.degrees(np.abs(np.mod(rad - 2.5 * np.pi, 2 * np.pi))) * 1.0 + 270, 360)
    grid, rows, at, named = Grid(tuple(freq), tuple(dirs)), [], nf + nd, iter(quoted)
    while at + 1 < len(tokens):
        time = dt.datetime.strptime(tokens[at] + tokens[at + 1], "%Y%m%d%H%M%S")
        at += 2
        for _ in range(points):
            lat, lon, dpt, wspd, wdir = map(float, tokens[at : at + 5])
            at += 7
            block = np.array(tokens[at : at + nf * nd], float).reshape(nd, nf).T * np.pi / 180
            at += nf * nd
            rows.append({"time": time, "site": next(named, "").strip(), "lon": lon, "lat": lat, "dpt": dpt, "wspd": wspd, "wdir": wdir, EFTH: block})
    return grid, rows


def parse_funwave(text: str, name: str = "") -> Parsed:
    """Amplitudes on a grid; directions are cartesian going to."""
    lines = text.splitlines()
    nf, nd = map(int, lines[0].split()[:2])
    tp = float(lines[1].split()[0])
    freq = [float(x.split()[0]) for x in lines[2 : 2 + nf]]
    dirs = np.array([float(x.split()[0]) for x in lines[2 + nf : 2 + nf + nd]])
    amp = np.array(" ".join(lines[2 + nf + nd :]).split()[: nf * nd], float).reshape(nd, nf).T
    theta = np.mod(270 - dirs, 360)
    grid = Grid(tuple(freq), tuple(theta) if nd > 1 else None)
    step = abs(dirs[1] - dirs[0]) if nd > 1 else 1.0
    order = np.argsort(theta, kind="stable")
    block = amp**2 / (2 * grid.df[:, None] * step)
    return Grid(tuple(freq), tuple(theta[order])) if nd > 1 else grid, [{"tp": tp, EFTH: block[:, order] if nd > 1 else block}]


def parse_funwave_new(text: str, name: str = "") -> Parsed:
    """Components (frequency, direction, amplitude): variances summed in each bin of their distinct values."""
    lines = [line.split() for line in text.splitlines() if line.strip()]
    n, tp = int(lines[0][0]), float(lines[1][0])
    value = np.array([float(x[0]) for x in lines[2:]])
    f, d, a = value[:n], np.mod(270 - value[n : 2 * n], 360), value[2 * n : 3 * n]
    freq, i = np.unique(f, return_inverse=True)
    dirs, j = np.unique(d, return_inverse=True)
    grid = Grid(tuple(freq), tuple(dirs))
    block = np.zeros((len(freq), len(dirs)))
    np.add.at(block, (i, j), a**2 / 2)
    return grid, [{"tp": tp, EFTH: block / (grid.df[:, None] * grid.dd)}]


def parse_triaxys(text: str, name: str = "", toff: float = 0.0, magnetic_variation: float | None = None) -> Parsed:
    """Directional or one-dimensional buoy spectra; toff hours are taken off the time, the declination is added to directions."""
    value = lambda key: re.search(rf"{key}[^=\n]*=\s*([-\d.]+)", text)
    stamp = re.search(r"DATE\s*=\s*(\d{4}-\d\d-\d\d \d\d:\d\d)", text)
    time = dt.datetime.strptime(stamp[1], "%Y-%m-%d %H:%M") - dt.timedelta(hours=toff)
    nf, f0, df = int(float(value("NUMBER OF FREQUENCIES")[1])), float(value("INITIAL FREQUENCY")[1]), float(value("FREQUENCY SPACING")[1])
    freq = tuple(f0 + df * np.arange(nf))
    body = [line for line in text.splitlines() if re.match(r"\s*[-\d.]+[eE]?[-+\d]*\s", line + " ") and "=" not in line]
    table = np.array([numbers(line) for line in body if line.strip()])
    if "NON-DIRECTIONAL" in text:
        return Grid(freq), [{"time": time, EFTH: table[:nf, 1:2]}]
    nd, dd = int(float(value("NUMBER OF DIRECTIONS")[1])), float(value("DIRECTION SPACING")[1])
    dirs = dd * np.arange(nd) + (magnetic_variation or 0.0)
    return Grid(freq, tuple(dirs)), [{"time": time, EFTH: table[:nf, :nd]}]


def ndbc_table(text: str) -> tuple[list[float], dict[dt.datetime, list[float]], dict[dt.datetime, float]]:
    """Frequencies, values and the separation frequency by time, of a realtime or a history file."""
    lines = [line for line in text.splitlines() if line.strip()]
    head, rows, sep, freq = lines[0], {}, {}, []
    if head.rstrip().endswith(">"):
        for line in (x for x in lines if not x.startswith("#")):
            lead, pairs = line.split()[:5], re.findall(r"([-\d.]+)\s+\(([\d.]+)\)", line)
            time = dt.datetime(*map(int, lead))
            rows[time], freq = [float(v) for v, _ in pairs], [float(f) for _, f in pairs]
            if "Sep_Freq" in head:
                sep[time] = float(line.split()[5])
    else:
        names = head.lstrip("#").split()
        k = 5 if names[4] == "mm" else 4
        freq = [float(x) for x in names[k:]]
        for line in (x for x in lines[1:] if not x.startswith("#")):
            part = line.split()
            year = int(part[0]) + (1900 if len(part[0]) == 2 else 0)
            rows[dt.datetime(year, *map(int, part[1:k]))] = [float(x) for x in part[k:]]
    return freq, rows, sep


def parse_ndbc(text: str, name: str = "", mask: float | None = None) -> Parsed:
    """One-dimensional densities, in time order, on the single direction 0."""
    freq, rows, sep = ndbc_table(text)
    grid = Grid(tuple(freq), (0.0,))
    return grid, [{"time": t, **({"sep_freq": sep[t]} if sep else {}), EFTH: np.array(rows[t])[:, None]} for t in sorted(rows)]


def combine_ndbc(texts: list[str], dirs=tuple(range(0, 360, 10)), weight_coeff: bool = False, missing: float | None = None) -> Parsed:
    """Directional spectra from five files: density, alpha1, alpha2, r1, r2; only times and frequencies of all. missing: a value that becomes NaN."""
    tables = [ndbc_table(t) for t in texts]
    theta, freq = np.array(dirs, float), tables[0][0]
    rows = []
    for time in sorted(set.intersection(*(set(t[1]) for t in tables))):
        e, a1, a2, r1, r2 = (np.array(t[1][time]) if missing is None else np.where(np.array(t[1][time]) == missing, np.nan, t[1][time]) for t in tables)
        sep = {"sep_freq": tables[0][2][time]} if tables[0][2] else {}
        rows.append({"time": time, **sep, EFTH: e[:, None] * fourier(theta, r1, a1, r2, a2, weight_coeff)})
    return Grid(tuple(freq), tuple(theta)), rows


def parse_datawell(text: str, name: str = "", dd: float | None = 5.0) -> Parsed:
    """SPT files: 12 values, then frequency, relative density, direction and spread. The time is that of the file's name."""
    lines = [line for line in text.splitlines() if line.strip()]
    head = [float(x) for x in lines[:12]]
    table = np.array([[float(x) for x in line.split(",")] for line in lines[12:]])
    stamp = re.search(r"(\d{4}-\d\d-\d\dT\d\dh\d\d)", name)
    time = dt.datetime.strptime(stamp[1], "%Y-%m-%dT%Hh%M") if stamp else None
    names = ("tn", "hs", "tz", "smax", "tref", "tsea", "bat", "av", "ax", "ay", "ori", "incl")
    row = {"time": time, **dict(zip(names, head))}
    row["hs"] = head[1] / 100
    e = table[:, 1] * head[3]
    freq = tuple(table[:, 0])
    if dd is None:
        return Grid(freq), [row | {EFTH: e[:, None]}]
    theta = np.arange(0, 360, dd)
    return Grid(freq, tuple(theta)), [row | {EFTH: e[:, None] * spreading(theta, table[:, 2], table[:, 3])}]


def parse_obscape(text: str, name: str = "") -> Parsed:
    """CSV with metadata after "#"; densities per radian become per degree. Times are UTC."""
    meta = dict(m.groups() for line in text.splitlines() if (m := re.match(r"#\s*([^=]+?)\s*=\s*(.*)", line)))
    table = np.array([[float(x) for x in line.split(",") if x.strip()] for line in text.splitlines() if line.strip() and not line.startswith("#")])
    freq = [float(x) for x in meta["Rows [Hz]"].split(",") if x.strip()]
    two = [float(x) for x in re.findall(r"[-\d.]+", meta["Columns [deg]"])[:2]]
    dirs = two[0] + (two[1] - two[0]) * np.arange(table.shape[1])
    time = dt.datetime.fromtimestamp(int(meta["Timestamp"]), dt.timezone.utc).replace(tzinfo=None)
    row = {"time": time, "site": meta.get("Station name", ""), "lat": float(meta.get("Latitude [deg]", "nan")), "lon": float(meta.get("Longitude [deg]", "nan"))}
    return Grid(tuple(freq), tuple(dirs)), [row | {EFTH: table * np.pi / 180}]


def parse_spotter(text: str, name: str = "", dd: float | None = 5.0) -> Parsed:
    """CSV (a row for each spectrum, numbered columns) or JSON; directions by cosine-squared spreading. Varying frequencies raise."""
    spectra = []
    if text.lstrip().startswith("{"):
        data = json.loads(text).get("data", json.loads(text))
        for w in data["frequencyData"]:
            time = dt.datetime.fromisoformat(w["timestamp"].replace("Z", "+00:00")).astimezone(dt.timezone.utc).replace(tzinfo=None)
            spectra.append((time, w.get("latitude"), w.get("longitude"), *(np.array(w[k], float) for k in ("frequency", "varianceDensity", "direction", "directionalSpread"))))
    else:
        head, *rows = [[x.strip() for x in line.split(",")] for line in text.splitlines() if line.strip()]
        at = {h: k for k, h in enumerate(head)}
        numbered = {key: sorted((int(h.removeprefix(f"{key}_")), k) for h, k in at.items() if re.fullmatch(rf"{key}_\d+", h)) for key in ("f", "varianceDensity", "direction", "directionalSpread")}
        many = lambda r, key: np.array([float(r[k]) for _, k in numbered[key]])
        for r in rows:
            time = dt.datetime.fromtimestamp(float(r[at["Epoch Time"]]), dt.timezone.utc).replace(tzinfo=None)
            spectra.append((time, float(r[at["Latitude"]]) if "Latitude" in at else None, float(r[at["Longitude"]]) if "Longitude" in at else None, many(r, "f"), many(r, "varianceDensity"), many(r, "direction"), many(r, "directionalSpread")))
    freq = spectra[0][3]
    if any(not np.array_equal(s[3], freq) for s in spectra):
        raise NotImplementedError("frequencies vary in time")
    theta = np.arange(0, 360, dd) if dd else None
    rows = [{"time": s[0], "lat": s[1], "lon": s[2], EFTH: s[4][:, None] * (spreading(theta, s[5], s[6]) if dd else 1)} for s in spectra]
    return Grid(tuple(freq), tuple(theta) if dd else None), rows


def entropy(a1, b1, a2, b2, theta: np.ndarray) -> np.ndarray:
    """Directional distribution of maximum entropy (nf, nd) from the first two harmonics; each frequency sums to 1."""
    c1, c2 = a1 + 1j * b1, a2 + 1j * b2
    with np.errstate(all="ignore"):
        p1 = (c1 - c2 * np.conj(c1)) / (1 - np.abs(c1) ** 2)
        p2 = c2 - c1 * p1
        e = np.exp(-1j * np.radians(theta))[None, :]
        d = np.real(1 - p1 * np.conj(c1) - p2 * np.conj(c2))[:, None] / np.abs(1 - p1[:, None] * e - p2[:, None] * e**2) ** 2
        return np.nan_to_num(d / d.sum(axis=1, keepdims=True))


def parse_awac(text: str, name: str = "", directions: int = 90) -> Parsed:
    """NMEA lines PNORF (harmonics), PNORE (densities) and PNORW (bulk) of one stamp make a spectrum, scaled to the reported height."""
    groups: dict[str, dict] = {}
    for line in text.splitlines():
        part = line.strip().split("*")[0].split(",")
        if part[0] == "$PNORF":
            groups.setdefault(part[2] + part[3], {})[part[1]] = ([float(x) for x in part[5:7]], np.array([float(x) for x in part[8 : 8 + int(part[7])]]))
        elif part[0] == "$PNORE":
            groups.setdefault(part[1] + part[2], {})["E"] = np.array([float(x) for x in part[7 : 7 + int(part[6])]])
        elif part[0] == "$PNORW":
            groups.setdefault(part[1] + part[2], {})["hs"] = float(part[5])
    rows, grid = [], None
    theta = np.linspace(0, 360, directions, endpoint=False)
    for stamp, g in groups.items():
        if not {"A1", "B1", "A2", "B2", "E", "hs"} <= g.keys():
            continue  # the first and the last are often cut
        (f0, df), a1 = g["A1"]
        n = len(a1)
        freq = np.linspace(f0, f0 + n * df, n)
        grid = grid or Grid(tuple(freq), tuple(theta))
        e = g["E"][:n]
        # harmonics point to where waves come from, counted from north
        block = e[:, None] * entropy(a1, g["B1"][1], g["A2"][1], g["B2"][1], theta) / grid.dd
        m0 = np.trapezoid(block.sum(axis=1) * grid.dd, freq)
        rows.append({"time": dt.datetime.strptime(stamp, "%m%d%y%H%M%S"), "hs": g["hs"], EFTH: block * (g["hs"] ** 2 / 16 / m0 if m0 > 0 else 0.0)})
    if grid is None:
        raise ValueError("no complete spectrum")
    return grid, rows


def parse_json(text: str, name: str = "") -> Parsed:
    """A dataset as a dict of coords, dims and data_vars; the dimensions of efth tell how its values are nested."""
    data = json.loads(text)
    coord = {k: v["data"] for k, v in data["coords"].items()}
    var = data["data_vars"][EFTH]
    dims = list(var["dims"])
    values = np.array([[np.nan if x is None else x for x in np.ravel(np.array(var["data"], dtype=object))]], float).reshape([len(coord[d]) for d in dims])
    other = [d for d in dims if d not in ("freq", "dir")]
    values = np.transpose(values, [dims.index(d) for d in [*other, "freq", *(["dir"] if "dir" in dims else [])]])
    grid = Grid(tuple(coord["freq"]), tuple(coord["dir"]) if "dir" in dims else None)
    rows = []
    for at in np.ndindex(*values.shape[: len(other)]):
        row = {d: coord[d][k] for d, k in zip(other, at)}
        for n, v in {**data["data_vars"], **data["coords"]}.items():
            own = list(v["dims"])
            if n not in row and n not in (EFTH, "freq", "dir") and set(own) <= set(other):
                x = np.array(v["data"], dtype=object)
                row[n] = x[tuple(at[other.index(d)] for d in own)] if own else v["data"]
        if "time" in row:
            row["time"] = dt.datetime.fromisoformat(str(row["time"]).replace("Z", ""))
        rows.append({k: str(v) if k == "site" else v for k, v in row.items()} | {EFTH: values[at].reshape(grid.nf, grid.nd)})
    return grid, rows


PARSERS: dict[str, Callable[..., Parsed]] = {
    "swan": parse_swan, "octopus": parse_octopus, "ww3_station": parse_ww3_station, "funwave": parse_funwave, "funwave_new": parse_funwave_new, "triaxys": parse_triaxys,
    "ndbc_ascii": parse_ndbc, "datawell": parse_datawell, "obscape": parse_obscape, "spotter": parse_spotter, "awac": parse_awac, "json": parse_json,
}

#: Formats whose records are read one after another, and have the same columns in all files.
STREAMS: dict[str, Callable[[Iterable[str]], Iterator[tuple[Grid, dict]]]] = {"octopus": octopus_records}
#: Rows that are parsed at once.
CHUNK = 500


def decode(content: bytes) -> str:
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")


def chunks(engine: str, path: str, content: bytes | None, options: dict) -> Iterator[Parsed]:
    """A file's rows, CHUNK by CHUNK. Without its content, the file of a format of records is opened here, and no more of it is held than a chunk."""
    if engine in STREAMS:
        raw = io.BytesIO(content) if content is not None else None
        if raw is None:
            file = FS.opened(*FS.system(path))[0]
        else:
            file = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
        with io.TextIOWrapper(file, "utf-8", "replace") as lines:
            records = STREAMS[engine](lines, **options)
            while some := list(itertools.islice(records, CHUNK)):
                yield some[0][0], [row for _, row in some]
    else:
        own, rows = PARSERS[engine](decode(content), path, **options)
        for k in range(0, len(rows), CHUNK):
            yield own, rows[k : k + CHUNK]


def reachable(path: str) -> bool:
    """Whether Python processes can open the file themselves."""
    try:
        fs, at = FS.system(path)
        return fs.get_file_info(at).type == pafs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def schema_of(row: dict) -> T.StructType:
    kind = lambda k, v: KINDS.get(k) or (T.StringType() if isinstance(v, str) else T.DoubleType())
    return T.StructType([*(T.StructField(k, kind(k, v)) for k, v in row.items() if k not in (EFTH, "file")), T.StructField("file", T.StringType()), T.StructField(EFTH, T.ArrayType(T.DoubleType()))])


def columns_of(files, parse, options: dict) -> T.StructType:
    """The columns of all files, from one row of each: a pass over the files of which only distinct schemas come back."""

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(decode(bytes(c)), p, **options)[1] for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"schema": sorted({schema_of(r[0]).json() for r in rows if r})})

    found: dict[str, T.StructField] = {}
    for r in sorted(x["schema"] for x in files.select("path", "content").mapInPandas(op, "schema string").distinct().collect()):
        for f in T.StructType.fromJson(json.loads(r)).fields:
            found.setdefault(f.name, f)
    return T.StructType([*(f for n, f in found.items() if n not in ("file", EFTH)), *(found[n] for n in ("file", EFTH) if n in found)])


def read(spark: SparkSession, paths: str | list[str], engine: str, uniform: bool = False, regrid: bool = True, **options) -> SpectraFrame:
    """Spectra of all files of a format, with the columns of all. The first file (by path) sets the grid; a file with another one is regridded to it, or raises if regrid is false.

    Of that file alone the driver sees some: all of it, or one chunk where a format is read record by record. Every file
    is parsed where it is read, by one task, which holds it whole, or one chunk. uniform says that all files have the
    first one's columns, and saves the pass that looks.
    """
    from ..operators.shape import regrid_block, regrid_weights

    files = prepare(spark).read.format("binaryFile").load(paths)
    one = files.orderBy("path").select("path").first()
    if one is None:
        raise FileNotFoundError(str(paths))
    streamed = engine in STREAMS
    opens = streamed and reachable(one["path"])
    if not opens:
        one = files.orderBy("path").select("path", "content").first()
    grid, rows = next(chunks(engine, one["path"], None if opens else bytes(one["content"]), options), (None, None))
    if not rows:
        raise ValueError(f"no spectrum in {one['path']}")
    schema = schema_of(rows[0]) if uniform or streamed else columns_of(files, PARSERS[engine], options)
    names = schema.fieldNames()

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], [None] * len(pdf) if opens else pdf["content"]):
                for own, some in chunks(engine, path, None if opens else bytes(content), options):
                    block = np.stack([r[EFTH] for r in some])
                    if own != grid and not regrid:
                        raise ValueError(f"{path} has another grid than the first file")
                    if own != grid:
                        block = regrid_block(block, own, grid, *regrid_weights(own, grid))
                    out = pd.DataFrame([{n: r.get(n) for n in names if n not in (EFTH, "file")} for r in some])
                    for f in schema.fields:
                        if f.name in out and isinstance(f.dataType, T.DoubleType):
                            out[f.name] = pd.to_numeric(out[f.name])
                    out["file"], out[EFTH] = os.path.basename(path), list(block.reshape(len(some), -1))
                    yield out[names]

    return SpectraFrame(files.select("path", *([] if opens else ["content"])).mapInPandas(op, schema), grid)


def read_tab(spark: SparkSession, paths: str | list[str]):
    """SWAN tables: time and number columns, names taken from the header."""
    lines = prepare(spark).read.text(paths)
    head = [r["value"] for r in lines.where(F.col("value").startswith("%")).limit(20).collect()]
    names = next(line for line in head if "Time" in line)[1:].split()
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    return rows.select(F.to_timestamp_ntz(F.substring(F.get(part, F.lit(0)), 1, 15), F.lit("yyyyMMdd.HHmmss")).alias("time"), *(F.get(part, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names) if k))


def with_tab(frame: SpectraFrame, tab) -> SpectraFrame:
    """Wind and depth of a SWAN table joined to spectra by time."""
    from ..functions import scalars as S

    wspd, wdir = S.uv_to_spddir(F.col("`X-wsp`"), F.col("`Y-wsp`"), True)
    columns = [c.alias(n) for n, c in (("wspd", wspd), ("wdir", wdir)) if "X-wsp" in tab.columns] + ([F.col("dep").alias("dpt")] if "dep" in tab.columns else [])
    return frame.with_df(frame.df.join(tab.select("time", *columns), "time", "left"))


def read_ndbc_directional(spark: SparkSession, paths: list[str], **options) -> SpectraFrame:
    """Five NDBC files (density, alpha1, alpha2, r1, r2) of one buoy; they are small and parsed together."""
    if len(paths) != 5:
        raise ValueError("five files: density, alpha1, alpha2, r1, r2")
    texts = [decode(bytes(prepare(spark).read.format("binaryFile").load(p).first()["content"])) for p in paths]
    grid, rows = combine_ndbc(texts, **options)
    schema = T.StructType([f for f in schema_of(rows[0]).fields if f.name != "file"])
    data = [tuple(r[f.name].ravel().tolist() if f.name == EFTH else r[f.name] for f in schema.fields) for r in rows]
    return SpectraFrame(spark.createDataFrame(data, schema), grid)


def is_grid(points: list[tuple[float, float]]) -> bool:
    return len({x for x, _ in points}) * len({y for _, y in points}) == len(points)


__all__ = ["read", "read_tab", "with_tab", "read_ndbc_directional", "PARSERS", "math"]
