"""SWAN files that belong together: cycles and sites, tiles of one run, and overlapping runs."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import re

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..frame import EFTH, SpectraFrame
from ..grid import Grid, frequencies
from ..numbering import written
from ..operators import shape as SH
from ..operators import stats as ST
from ..session import prepare
from . import files as FS
from . import plugins, text

#: The frequencies that cycles are brought to by default.
COMMON = frequencies(0.04118, 31)


class Cycle:
    """One file, its table of winds and depth beside it, and where its records begin."""

    def __init__(self, fs, path: str, dirorder: bool):
        self.file, _ = FS.opened(fs, path)
        self.lines = (line for _, line in plugins.swan_lines(self.file, 0))
        self.head = text.swan_head(self.lines, dirorder)
        name = os.path.splitext(os.path.basename(path).removesuffix(".gz"))[0]
        self.sites = [name] if len(self.head.points) == 1 else [str(k + 1) for k in range(len(self.head.points))]
        table = os.path.join(os.path.dirname(path), f"{name}.tab")
        self.winds: dict[dt.datetime, dict[str, float]] = {}
        if len(self.sites) == 1 and fs.get_file_info(table).type == pafs.FileType.File:
            with FS.opened(fs, table)[0] as f:
                self.winds = text.parse_tab(f.read().decode("utf-8", "replace"))

    def records(self, ndays: float | None, ntimes: int | None):
        """(rows of a time), from the first one on, up to the limits; nothing behind them is read. A file that ends before ndays are over raises."""
        times: list[dt.datetime] = []
        stopped = False

        def ends(time: dt.datetime) -> bool:
            nonlocal stopped
            stopped = (ntimes is not None and len(times) >= ntimes) or (ndays is not None and bool(times) and time > times[0] + dt.timedelta(days=ndays))
            times.append(time)
            return stopped

        for _, step in itertools.groupby(text.swan_records(self.lines, self.head, ends=ends), lambda row: row["time"]):
            yield [row | {"site": self.sites[int(row["site"])]} for row in step]
        if ndays is not None and times and not stopped and times[-1] < times[0] + dt.timedelta(days=ndays):
            raise OSError(f"the file doesn't span {ndays} days")


def read_swans(spark: SparkSession, paths, ndays: float | None = None, ntimes: int | None = None, int_freq: bool | list[float] = True, int_dir: list[float] | bool = False, dirorder: bool = True) -> SpectraFrame:
    """Spectra of sites and cycles, with column cycle (the first time of each file), and wind and depth from tables beside files of one place.

    A site is a file's name, or the number of the place in it. Limits count from a cycle's start, and reading stops at
    them; a file that ends before ndays raises. A first pass reads heads alone, in tasks: cycles with sites at different
    places (names may hold the cycle, so they aren't compared), and tables beside some files only or with different columns, raise before anything is parsed. A table whose times don't
    hold all that are read is left out, as if it weren't there.
    """
    listed = FS.found(paths)
    if not listed:
        raise FileNotFoundError(str(paths))
    first = paths if isinstance(paths, str) else paths[0]
    root = re.match(r"[^*?{]*", first)[0]
    names = prepare(spark).createDataFrame([(f.path,) for f in listed], "path string")
    names = names.repartition(max(1, min(len(listed), 10_000)))
    grids = T.StructType.fromDDL("path string, cycle timestamp_ntz, freq array<double>, dir array<double>, sites array<struct<site:string,lon:double,lat:double>>, winds string")

    def heads(batches):
        fs = FS.system(root)[0]
        for pdf in batches:
            for path in pdf["path"]:
                c = Cycle(fs, path, dirorder)
                with c.file:
                    some = next(c.records(None, 1))
                columns = ",".join(sorted(next(iter(c.winds.values())))) if some[0]["time"] in c.winds else ""
                places = [(s, x, y) for s, (x, y) in zip(c.sites, c.head.points)]
                yield pd.DataFrame([(path, some[0]["time"], list(c.head.grid.freq), list(c.head.grid.dir) if c.head.grid.dir else None, places, columns)], columns=grids.fieldNames())

    known = written(names.mapInPandas(heads, grids), "heads")
    place = F.transform(F.flatten(F.collect_list("sites")), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    by_cycle = known.groupBy("cycle").agg(F.sort_array(place).alias("s"))  # as long as a cycle has sites
    if by_cycle.select("s").distinct().count() > 1:
        raise OSError("cycles have different sites")
    tables = [r["winds"] for r in known.select("winds").distinct().limit(2).collect()]
    if len(tables) > 1:
        raise OSError("tables stand beside some files only, or have different columns")
    one = known.orderBy("path").select("freq", "dir").first()
    grid = Grid(tuple(one["freq"]), tuple(one["dir"]) if one["dir"] is not None else None)
    columns = [c for c in ("wspd", "wdir", "dpt") if c in tables[0].split(",")]
    fields = "time timestamp_ntz, site string, lon double, lat double, " + "".join(f"{c} double, " for c in columns) + "file string, cycle timestamp_ntz, efth array<double>"
    order = T.StructType.fromDDL(fields).fieldNames()

    def parse(batches):
        fs = FS.system(root)[0]
        for pdf in batches:
            for path in pdf["path"]:
                c = Cycle(fs, path, dirorder)
                weights = SH.regrid_weights(c.head.grid, grid) if c.head.grid != grid else None
                begun = None
                with c.file:
                    for step in c.records(ndays, ntimes):
                        begun = begun or step[0]["time"]
                        if columns and step[0]["time"] not in c.winds:
                            raise OSError(f"the table beside {path} lacks {step[0]['time']}")
                        rows = []
                        for r in step:
                            block = r[EFTH] if weights is None else SH.regrid_block(r[EFTH][None], c.head.grid, grid, *weights)[0]
                            wind = [c.winds[r["time"]].get(w) for w in columns]
                            rows.append((r["time"], r["site"], r["lon"], r["lat"], *wind, os.path.basename(path), begun, block.ravel()))
                        yield pd.DataFrame(rows, columns=order)

    frame = SpectraFrame(names.mapInPandas(parse, fields), grid)
    if int_freq or int_dir:
        freq = None if not int_freq else COMMON if int_freq is True else int_freq
        directions = None if not int_dir else [10.0 * k for k in range(36)] if int_dir is True else int_dir
        frame = SH.interp(frame, freq, directions, maintain_m0=False)
    return frame


def merge_tiles(frame: SpectraFrame) -> SpectraFrame:
    """Tiles of one run, told apart by the column file, as one grid: what neighbouring tiles (in the order of their names) both have comes from one of them, row by row or column by column.

    The common longitudes and latitudes of two neighbours are counted, and the fewer of them are their slices (longitudes,
    if as many). A slice is taken whole from the tile whose spectra have the larger sum over it, at all times and places,
    or from the later one if the sums are equal; NaN counts as nothing. Where tiles that are no neighbours share a place,
    the larger spectrum stays.
    """
    df, others = frame.df, [c for c in frame.others if c not in ("time", "lat", "lon")]
    tiles = df.select("file").distinct().withColumn("k", F.row_number().over(Window.orderBy("file")))  # a row for each file
    rows = df.join(F.broadcast(tiles), "file").withColumn("w", ST.total(ST.clean(F.col(EFTH))))
    sums = {d: rows.groupBy("k", d).agg(F.sum("w").alias(f"{d}_sum")) for d in ("lon", "lat")}
    common = {d: sums[d].join(sums[d].select((F.col("k") - 1).alias("k"), d), ["k", d]).groupBy("k").agg(F.count("*").alias(f"{d}_n")) for d in sums}
    slices = tiles.select("k").join(common["lon"], "k", "left").join(common["lat"], "k", "left")
    slices = slices.select("k", (F.coalesce("lon_n", F.lit(0)) <= F.coalesce("lat_n", F.lit(0))).alias("by_lon"))
    rows = rows.join(sums["lon"], ["k", "lon"]).join(sums["lat"], ["k", "lat"]).join(F.broadcast(slices), "k")
    one = F.struct("k", "by_lon", "lon_sum", "lat_sum", "w", *others, EFTH)

    def kept(a, b):
        """Of a tile's spectrum and the next one's; a tie goes to the later."""
        own = lambda x: F.when(b["k"] == a["k"] + 1, F.when(a["by_lon"], x["lon_sum"]).otherwise(x["lat_sum"])).otherwise(x["w"])
        last = lambda x: F.struct(b["k"].alias("k"), b["by_lon"].alias("by_lon"), *(x[c].alias(c) for c in ("lon_sum", "lat_sum", "w", *others, EFTH)))
        return F.when(own(a) > own(b), last(a)).otherwise(last(b))

    met = rows.groupBy("time", "lat", "lon").agg(F.array_sort(F.collect_list(one)).alias("t"))  # a place is in few tiles
    first = F.get("t", F.lit(0))
    best = F.when(F.size("t") == 1, first).otherwise(F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), first, kept))
    return frame.with_df(met.select("time", "lat", "lon", best.alias("b")).select("time", "lat", "lon", *(F.col("b")[c].alias(c) for c in (*others, EFTH))))


def read_hotswan(spark: SparkSession, paths, dirorder: bool = True) -> SpectraFrame:
    """The tiles of one run as one grid; see merge_tiles."""
    return merge_tiles(text.read(spark, paths, "swan", dirorder=dirorder))


def read_swanow(spark: SparkSession, paths) -> SpectraFrame:
    """Overlapping runs: for each time and place, the file that comes last by name counts; what it lacks (null columns, null or NaN bins) comes from the one before."""
    frame = text.read(spark, paths, "swan")
    keys = ["time", "lat", "lon"]
    others = [c for c in frame.others if c not in keys]
    known = lambda x: F.when(x.isNotNull() & ~F.isnan(x), x)
    files = F.sort_array(F.collect_list(F.struct("file", EFTH)), asc=False)  # few runs have a time
    last = frame.df.groupBy(*keys).agg(files.alias("__s"), *(F.expr(f"max_by(`{c}`, file) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in others))
    filled = F.aggregate(F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0))), F.get("__s", F.lit(0))[EFTH], lambda a, x: F.zip_with(a, x[EFTH], lambda p, q: F.coalesce(known(p), q, p)))
    return frame.with_df(last.select(*keys, *others, filled.alias(EFTH)))


def read_obscape_dir(spark: SparkSession, folder: str, start_date: str | None = None, end_date: str | None = None) -> SpectraFrame:
    """Obscape files whose name's stamp (yyyymmdd_HHMMSS) lies within the dates; others aren't opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    stamp = F.regexp_extract("path", r"(\d{8}_\d{6})[^/]*$", 1)
    for limit, keep in ((start_date, stamp >= (start_date or "")), (end_date, stamp <= (end_date or "") + "~")):
        files = files.where(keep) if limit else files
    paths = [r["path"] for r in files.collect()]  # names only
    if not paths:
        raise FileNotFoundError(folder)
    return text.read(spark, paths, "obscape")
