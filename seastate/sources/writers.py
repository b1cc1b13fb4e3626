"""Writers of text formats: `to_files` writes a file for each site (or other keys) from the tasks that have its rows; the others make one local file in the driver, row by row."""

from __future__ import annotations

import gzip
import json
import math
import zipfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..frame import EFTH, SpectraFrame
from ..grid import Grid
from ..operators import shape as SH
from ..operators import stats as ST


def put(path: str, text: str, append: bool = False, level: int = 6) -> None:
    if str(path).endswith(".gz"):
        with gzip.open(path, "at" if append else "wt", compresslevel=level) as f:
            f.write(text)
    else:
        with open(path, "a" if append else "w") as f:
            f.write(text)


def ordered(frame: SpectraFrame, *by: str) -> Iterable[dict]:
    """Rows in order, partition by partition: the driver holds one partition at a time."""
    keys = [c for c in by if c in frame.df.columns]
    for r in (frame.df.orderBy(*keys) if keys else frame.df).toLocalIterator():
        yield r.asDict()


#: Header lines, units and column names below are those of the file formats. Fixed values.


def swan_header(g: Grid, points: list[tuple[float, float]], timed: bool) -> str:
    line = lambda value, note: f"{value:<40}{note}\n"
    out = [line("SWAN   1", "Swan standard spectral file"), "$   Created by seastate\n"]
    if timed:
        out += [line("TIME", "time-dependent data"), line("     1", "time coding option")]
    out += [line("LONLAT", "locations in spherical coordinates"), line(f"{len(points):6d}", "number of locations")]
    out += [f"{x:12.6f}{y:12.6f}\n" for x, y in points]
    out += [line("AFREQ", "absolute frequencies in Hz"), line(f"{g.nf:6d}", "number of frequencies"), *(f"{f:11.5f}\n" for f in g.freq)]
    out += [line("NDIR", "spectral nautical directions in degr"), line(f"{g.nd:6d}", "number of directions"), *(f"{d:11.4f}\n" for d in g.theta)]
    out += [line("QUANT", ""), line("     1", "number of quantities in table"), line("VaDens", "variance densities in m2/Hz/degr"), line("m2/Hz/degr", "unit"), line("   -99", "exception value")]
    return "".join(out)


def swan_block(x: np.ndarray) -> str:
    """NODATA for spectra with NaN, ZERO for those without energy, else whole numbers and their factor."""
    if np.isnan(x).any():
        return "NODATA\n"
    if x.max() <= 0:
        return "ZERO\n"
    factor = x.max() / 9998
    rows = np.rint(x / factor).astype(int)
    return f"FACTOR\n{factor:18.8E}\n" + "".join("".join(f"{v:6d}" for v in row) + "\n" for row in rows)


def to_swan(frame: SpectraFrame, path: str, append: bool = False) -> None:
    """One file of all sites (lon, lat; 0 if missing) and times."""
    g = frame.grid
    has = set(frame.df.columns)
    x, y = (F.col(c) if c in has else F.lit(0.0) for c in ("lon", "lat"))
    keyed = frame.with_df(frame.df.withColumns({"__x": x, "__y": y}))
    order = ["site", "__x", "__y"] if "site" in has else ["__x", "__y"]
    points = [(r["__x"], r["__y"]) for r in keyed.df.select(*order).distinct().orderBy(*order).collect()]
    timed, last = "time" in has, None
    if not append:
        put(path, swan_header(g, points, timed))
    chunk: list[str] = []
    for r in ordered(keyed, "time", *order):
        if timed and r["time"] != last:
            chunk.append(f"{r['time'].strftime('%Y%m%d.%H%M%S'):<40}date and time\n")
            last = r["time"]
        chunk.append(swan_block(np.array(r[EFTH], float).reshape(g.nf, g.nd)))
        if len(chunk) >= 1000:
            put(path, "".join(chunk), True)
            chunk = []
    put(path, "".join(chunk), True)


def octopus_rows(frame: SpectraFrame, fcut: float) -> DataFrame:
    """The parameters of a record: whole, sea (from fcut on) and swell (up to it), in one plan over the same rows."""
    whole = {"hs": {}, "tm01": {}, "dm": {}, "momf1": {"mom": 1}, "momf2": {"mom": 2}, "dpm": {}, "dspr": {}}
    df = frame.df
    cut = df.select("*", F.col(EFTH).alias("__all"))
    g = frame.grid
    for name, low, high in (("sea", fcut, None), ("swell", None, fcut)):
        part = SH.split(SpectraFrame(cut.withColumn(EFTH, F.col("__all")), g), low, high)
        cut = ST.stats(part, ["hs", "tm01", "dm"], names=[f"hs_{name}", f"tm01_{name}", f"dm_{name}"]).withColumn(EFTH, F.col("__all"))
    out = SpectraFrame(cut, g)
    first = ST.stats(out, {"hs": {}, "tm01": {}, "dm": {}, "dpm": {}, "dspr": {}})
    both = ST.stats(SpectraFrame(first.withColumn(EFTH, F.col("__all")), g), {"momf": {"mom": 1}}, names=["momf1"])
    both = ST.stats(SpectraFrame(both.withColumn(EFTH, F.col("__all")), g), {"momf": {"mom": 2}}, names=["momf2"])
    assert set(whole) <= set(both.columns)
    return both.withColumn(EFTH, F.col("__all")).drop("__all")


def to_octopus(frame: SpectraFrame, path: str, site_id: str = "spec", fcut: float = 0.125, missing: float = -99999) -> None:
    """A block for each site; needs times. Directional spectra only."""
    g = frame.grid.directional()
    if "time" not in frame.df.columns:
        raise ValueError("times are needed")
    has = set(frame.df.columns)
    fill = {c: F.coalesce(F.col(c), F.lit(missing)) if c in has else F.lit(float(missing)) for c in ("wspd", "wdir", "dpt", "lat", "lon")}
    df = octopus_rows(frame.with_df(frame.df.withColumns(fill)), fcut)
    sites: dict = {}
    for r in (df.orderBy("site", "time") if "site" in has else df.orderBy("time")).toLocalIterator():
        sites.setdefault(r["site"] if "site" in has else 0, []).append(r.asDict())
    out = []
    for rows in sites.values():
        step = (rows[1]["time"] - rows[0]["time"]).total_seconds() / 3600 if len(rows) > 1 else 0
        out.append(octopus_header(rows[0], g, len(rows)))
        out += [octopus_record(r, g, k * step, site_id, missing) for k, r in enumerate(rows)]
    put(path, "".join(out))


def octopus_header(first: dict, g: Grid, count: int) -> str:
    return f"Forecast valid for {first['time']:%d-%b-%Y %H:%M:%S}\nnfreqs,{g.nf}\nndir,{g.nd}\nnrecs,{count}\nLatitude,{first['lat']:.6f}\nLongitude,{first['lon']:.6f}\nDepth,{first['dpt']:.2f}\n\n"


def octopus_record(r: dict, g: Grid, tau: float, site_id: str = "spec", missing: float = -99999) -> str:
    v = {n: missing if x is None or (isinstance(x, float) and math.isnan(x)) else x for n, x in r.items() if n != EFTH}
    energy = np.nan_to_num(np.array(r[EFTH], float).reshape(g.nf, g.nd)) * g.df[:, None] * g.dd
    out = ["CCYYMM,DDHHmm,LPoint,WD,WS,ETot,TZ,VMD,ETotSe,TZSe,VMDSe,ETotSw,TZSw,VMDSw,Mo1,Mo2,HSig,DomDr,AngSpr,Tau\n"]
    e = lambda h: 0.25 * v[h] ** 2 if v[h] != missing else missing
    out.append(f"{r['time']:%Y%m},'{r['time']:%d%H%M},{site_id}_{r['time']:%Y%m%d_%Hz},{v['wdir']:.0f},{v['wspd']:.2f},{e('hs'):.4f},{v['tm01']:.2f},{v['dm']:.1f},{e('hs_sea'):.4f},{v['tm01_sea']:.2f},{v['dm_sea']:.1f},{e('hs_swell'):.4f},{v['tm01_swell']:.2f},{v['dm_swell']:.1f},{v['momf1']:.5f},{v['momf2']:.5f},{v['hs']:.4f},{v['dpm']:.0f},{v['dspr']:.0f},{tau:.0f}\n")
    out.append("freq," + "".join(f"{f:.5f}," for f in g.freq) + "anspec\n")
    out += [f"{d:.0f}," + "".join(f"{x:.5f}," for x in energy[:, j]) + f"{energy[:, j].sum():.5f}\n" for j, d in enumerate(g.theta)]
    by = energy.sum(axis=1)
    out.append("fSpec," + "".join(f"{x:.5f}," for x in by) + f"{by.sum():.5f}\n")
    out.append("den," + "".join(f"{x:.5f}," for x in by / g.df) + "\n\n")
    return "".join(out)


def going_to(g: Grid, clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cartesian going-to directions within -180..180, in order, and their places; clip: those within -90..90."""
    d = np.mod(270 - g.theta + 180, 360) - 180
    order = np.argsort(d, kind="stable")
    if clip:
        order = order[(d[order] >= -90) & (d[order] <= 90)]
    return d[order], order


def funwave_text(x: np.ndarray, g: Grid, tp: float, clip: bool = True, seed: int = 0) -> str:
    """Amplitudes on a grid with random phases."""
    d, order = going_to(g, clip)
    amp = np.sqrt(8 * np.maximum(x[:, order], 0) * g.df[:, None] * g.dd) / 2
    phase = np.random.default_rng(seed).uniform(0, 360, amp.shape)
    lines = [f"{g.nf:5d} {len(d):5d}   - NumFreq NumDir ", f"{tp:10.3f}   - PeakPeriod  ", *(f"{f:10.3f}   - Freq " for f in g.freq), *(f"{v:10.3f}   - Dire " for v in d)]
    return "\n".join(lines + ["\t".join(f"{v:.8g}" for v in row) for row in (*amp.T, *phase.T)]) + "\n"


def funwave_new_text(x: np.ndarray, g: Grid, tp: float, clip: bool = True, phases: bool = True, seed: int = 0) -> str:
    """A component for each bin."""
    d, order = going_to(g, clip)
    amp = np.sqrt(8 * np.maximum(x[:, order], 0) * g.df[:, None] * g.dd) / 2
    f, t = np.repeat(g.f, len(d)), np.tile(d, g.nf)
    part = lambda v, name, digits: [f"{a:12.{digits}f}   - {name}" for a in v]
    lines = [f"{amp.size:8d}   - NumFreq", f"{tp:10.3f}   - PeakPeriod", *part(f, "Freq", 6), *part(t, "Dire", 3), *part(amp.ravel(), "Amp", 8)]
    if phases:
        lines += part(np.random.default_rng(seed).uniform(0, 360, amp.size), "Phase", 3)
    return "\n".join(lines) + "\n"


def _to_funwave(frame: SpectraFrame, path: str, text) -> None:
    g = frame.grid.directional()
    df = ST.stats(frame.with_df(frame.df.withColumn("__e", F.col(EFTH))), ["tp"], names=["__tp"])
    rows = list(enumerate(df.toLocalIterator()))
    texts = [text(np.nan_to_num(np.array(r["__e"], float)).reshape(g.nf, g.nd), g, r["__tp"] or 0.0, k) for k, r in rows]
    if len(texts) == 1:
        put(path, texts[0])
        return
    with zipfile.ZipFile(f"{path}.zip" if not str(path).endswith(".zip") else path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, t in enumerate(texts):
            z.writestr(f"{k:06d}.txt", t)


def to_funwave(frame: SpectraFrame, path: str, clip: bool = True) -> None:
    """One file, or a zip of one for each spectrum."""
    _to_funwave(frame, path, lambda x, g, tp, k: funwave_text(x, g, tp, clip, k))


def to_funwave_new(frame: SpectraFrame, path: str, clip: bool = True, phases: bool = True) -> None:
    _to_funwave(frame, path, lambda x, g, tp, k: funwave_new_text(x, g, tp, clip, phases, k))


def to_json(frame: SpectraFrame, path: str, dim: str = "time") -> None:
    """A dataset dict along one dimension, times in ISO form."""
    g = frame.grid
    put(path, json_text(list(ordered(frame, dim)), g, dim, frame.others))


def json_text(rows: list[dict], g: Grid, dim: str, others: list[str]) -> str:
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else None if isinstance(v, float) and math.isnan(v) else v
    dims = [dim, "freq", *(["dir"] if g.dir is not None else [])]
    blocks = [np.array(r[EFTH], float).reshape(g.nf, g.nd) for r in rows]
    efth = [[[plain(float(v)) for v in line] for line in b] if g.dir is not None else [plain(float(v)) for v in b[:, 0]] for b in blocks]
    coords = {dim: {"dims": [dim], "attrs": {}, "data": [plain(r[dim]) for r in rows]}, "freq": {"dims": ["freq"], "attrs": {}, "data": list(g.freq)}}
    if g.dir is not None:
        coords["dir"] = {"dims": ["dir"], "attrs": {}, "data": list(g.dir)}
    variables = {EFTH: {"dims": dims, "attrs": {}, "data": efth}}
    variables |= {c: {"dims": [dim], "attrs": {}, "data": [plain(r[c]) for r in rows]} for c in others if c != dim}
    return json.dumps({"coords": coords, "attrs": {}, "dims": {}, "data_vars": variables})


def wave_trains(frame: SpectraFrame, least: float = 1e-6) -> DataFrame:
    """A row for each direction with more energy than `least` over frequencies: the direction, and its density per Hz."""
    g = frame.grid.directional()
    dirs = ST.lits(g.theta)
    e = F.col(EFTH)
    trains = F.transform(F.sequence(F.lit(0), F.lit(g.nd - 1)), lambda j: F.struct(F.get(dirs, j).alias("direction"), F.transform(F.sequence(F.lit(0), F.lit(g.nf - 1)), lambda i: F.get(e, i * g.nd + j) * g.dd).alias("density")))
    rows = frame.df.select(*frame.others, F.explode(trains).alias("t")).select(*frame.others, "t.*")
    return rows.where(ST.total(F.col("density")) > least).withColumn("freq", ST.lits(g.f))


def ww3_form(frame: SpectraFrame) -> tuple[DataFrame, dict]:
    """Rows and coordinates under a global model's names: density per radian, directions going to, frequency bounds."""
    g = frame.grid.directional()
    names = {"lat": "latitude", "lon": "longitude", "wspd": "wnd", "wdir": "wnddir", "site": "station"}
    df = frame.map_spectra(F.transform(EFTH, lambda x: x * (180 / math.pi))).df
    low, high = g.f - g.df / 2, g.f + g.df / 2
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns}), {"frequency": list(g.freq), "frequency1": low.tolist(), "frequency2": high.tolist(), "direction": [(d + 180) % 360 for d in g.theta]}


def to_files(frame: SpectraFrame, path: str, kind: str, by: list[str], fcut: float = 0.125, clip: bool = True, missing: float = -99999) -> None:
    """A file of a format ("swan", "octopus", "funwave", "funwave_new" or "json") for each value of the columns `by`, as path/by=value/part-....

    One shuffle brings a file's spectra together in the order of time; tasks write their files through Spark, so that a
    lost one leaves nothing behind. A Funwave file holds one spectrum: `by` must tell all spectra apart.
    """
    g, keyed = frame.grid, [F.col(c) for c in by]
    has, timed = set(frame.df.columns), "time" in frame.df.columns
    df = frame.df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if c in ("lon", "lat") else float(missing))) if c in has else F.lit(0.0 if c in ("lon", "lat") else float(missing)) for c in ("lon", "lat", "wspd", "wdir", "dpt")})
    if kind == "octopus":
        if not timed:
            raise ValueError("times are needed")
        df = octopus_rows(SpectraFrame(df, g.directional() and g), fcut)
    elif kind.startswith("funwave"):
        df = ST.stats(SpectraFrame(df.withColumn("__e", F.col(EFTH)), g), ["tp"], names=["__tp"]).withColumnRenamed("__e", EFTH)
    elif kind not in ("swan", "json"):
        raise ValueError(f"no such format: {kind}")
    order = F.col("time") if timed else F.lit(0)
    own, whole = Window.partitionBy(*keyed).orderBy(order), Window.partitionBy(*keyed)
    df = df.withColumns({"__k": F.row_number().over(own) - 1, "__n": F.count("*").over(whole)})
    if kind == "octopus":
        df = df.withColumn("__step", F.coalesce((F.nth_value("time", 2).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("timestamp").cast("double") - F.min("time").over(whole).cast("timestamp").cast("double")) / 3600, F.lit(0.0)))
    others = frame.others

    def text(r: dict) -> str:
        if kind == "octopus":
            return (octopus_header(r, g, r["__n"]) if r["__k"] == 0 else "") + octopus_record(r, g, r["__k"] * r["__step"], missing=missing).removesuffix("\n")
        x = np.array([np.nan if v is None else v for v in r[EFTH]], float).reshape(g.nf, g.nd)
        if kind == "swan":
            head = swan_header(g, [(r["lon"], r["lat"])], timed) if r["__k"] == 0 else ""
            return head + (f"{r['time'].strftime('%Y%m%d.%H%M%S'):<40}date and time\n" if timed else "") + swan_block(x).removesuffix("\n")
        if r["__n"] > 1:
            raise ValueError("a file holds one spectrum")
        write = funwave_text if kind == "funwave" else funwave_new_text
        return write(np.nan_to_num(x), g, r["__tp"] or 0.0, clip).removesuffix("\n")

    keys = T.StructType([df.schema[c] for c in by])
    if kind == "json":
        made = df.groupBy(*by).applyInPandas(lambda key, pdf: pd.DataFrame([[*key, json_text(pdf.sort_values("__k")[[*others, EFTH]].to_dict("records"), g, "time", others)]], columns=[*by, "value"]), T.StructType([*keys.fields, T.StructField("value", T.StringType())]))
    else:

        def op(batches):
            for batch in batches:
                rows = batch.to_pylist()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("__k"), pa.array([text(r) for r in rows], pa.string())], [*by, "__k", "value"])

        made = df.mapInArrow(op, T.StructType([*keys.fields, T.StructField("__k", T.IntegerType()), T.StructField("value", T.StringType())]))
        made = made.sortWithinPartitions(*by, "__k").select(*by, "value")
    made.write.mode("overwrite").partitionBy(*by).text(path)


WRITERS = {"swan": to_swan, "octopus": to_octopus, "funwave": to_funwave, "funwave_new": to_funwave_new, "json": to_json}
