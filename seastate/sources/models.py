"""Model and buoy datasets with their own names and units, as DataFrames, brought to the canonical form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..functions import scalars as S
from ..grid import Grid, frequencies

KEEP = ["time", "site", "lat", "lon", "wspd", "wdir", "dpt", EFTH]
#: Original name -> canonical name, by format. Fixed values.
NAMES = {
    "ww3": {"time": "time", "station": "site", "efth": EFTH, "longitude": "lon", "latitude": "lat", "wnddir": "wdir", "wnd": "wspd", "dpt": "dpt"},
    "ncswan": {"time": "time", "points": "site", "density": EFTH, "longitude": "lon", "latitude": "lat", "depth": "dpt", "xwnd": "xwnd", "ywnd": "ywnd"},
    "wwm": {"ocean_time": "time", "nbstation": "site", "AC": EFTH, "lon": "lon", "lat": "lat", "DEP": "dpt", "Uwind": "xwnd", "Vwind": "ywnd"},
    "era5": {"time": "time", "d2fd": EFTH, "latitude": "lat", "longitude": "lon"},
}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(a).alias(b) for a, b in names.items() if a in df.columns))


def _wind(df: DataFrame) -> DataFrame:
    if not {"xwnd", "ywnd"} <= set(df.columns):
        return df
    wspd, wdir = S.uv_to_spddir(F.col("xwnd"), F.col("ywnd"), True)
    return df.withColumns({"wspd": wspd, "wdir": wdir})


def _times(factor: float) -> Column:
    return F.transform(EFTH, lambda x: x * factor)


def _kept(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in KEEP if c in df.columns))


def from_ww3(df: DataFrame, freq, dir) -> SpectraFrame:
    """Densities per radian, directions going to."""
    if "station_name" in df.columns:
        df = df.drop("station").withColumnRenamed("station_name", "station")
    df = _renamed(df, NAMES["ww3"]).withColumn(EFTH, _times(math.pi / 180))
    return SpectraFrame(_kept(df), Grid(tuple(freq), tuple((d + 180) % 360 for d in dir)))


def from_ncswan(df: DataFrame, freq, dir) -> SpectraFrame:
    """Densities per radian, directions in radians, wind as components."""
    df = _wind(_renamed(df, NAMES["ncswan"])).withColumn(EFTH, _times(math.pi / 180))
    return SpectraFrame(_kept(df), Grid(tuple(freq), tuple(math.degrees(d) % 360 for d in dir)))


def from_wwm(df: DataFrame, spsig, spdir) -> SpectraFrame:
    """Action by angular frequency and radians becomes energy by frequency and degrees."""
    freq = [s / (2 * math.pi) for s in spsig]
    nd = len(spdir)
    weights = F.lit([s * 2 * math.pi * math.pi / 180 for s in spsig for _ in range(nd)])
    df = _wind(_renamed(df, NAMES["wwm"])).withColumn(EFTH, F.zip_with(EFTH, weights, lambda x, w: x * w))
    return SpectraFrame(_kept(df), Grid(tuple(freq), tuple(math.degrees(d) % 360 for d in spdir)))


def from_era5(df: DataFrame, nf: int = 30, nd: int = 24, f0: float = 0.03453, step: float = 1.1, as_site: bool = False) -> SpectraFrame:
    """Logarithms of densities per radian; missing ones are 0. Frequencies and directions are rebuilt."""
    df = _renamed(df, NAMES["era5"])
    df = df.withColumn(EFTH, F.transform(EFTH, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.pow(F.lit(10.0), x) * (math.pi / 180))))
    if as_site:
        df = df.withColumn("site", F.concat_ws("_", "lat", "lon"))
    return SpectraFrame(_kept(df), Grid(frequencies(f0, nf, step), tuple(((k + 0.5) * 360 / nd + 180) % 360 for k in range(nd))))


def from_ndbc(df: DataFrame, freq, directional: bool = True, dd: float = 10.0, weight_coeff: bool = False) -> SpectraFrame:
    """Density, mean and principal direction and r1, r2 by frequency (arrays); without directional columns, one-dimensional."""
    arrays = {"spectral_wave_density": "e", "mean_wave_dir": "a1", "principal_wave_dir": "a2", "wave_spectrum_r1": "r1", "wave_spectrum_r2": "r2"}
    others = [F.col(a).alias(b) for a, b in (("time", "time"), ("latitude", "lat"), ("longitude", "lon"), ("site", "site")) if a in df.columns]
    if not directional or not set(arrays) <= set(df.columns):
        return SpectraFrame(df.select(*others, F.col("spectral_wave_density").alias(EFTH)), Grid(tuple(freq)))
    theta = [k * dd for k in range(int(360 / dd))]
    w1, w2 = (2 / 3, 1 / 6) if weight_coeff else (1.0, 1.0)
    rows = F.arrays_zip(*(F.col(a).alias(b) for a, b in arrays.items()))

    def spread(x: Column) -> Column:
        return F.transform(F.lit(theta), lambda t: x["e"] * (0.5 + w1 * x["r1"] * F.cos(F.radians(t - x["a1"])) + w2 * x["r2"] * F.cos(2 * F.radians(t - x["a2"]))) / 180)

    return SpectraFrame(df.select(*others, F.flatten(F.transform(rows, spread)).alias(EFTH)), Grid(tuple(freq), tuple(theta)))


def from_dataframe(df: DataFrame, **grid) -> SpectraFrame:
    """The form is told by the names of the columns, in this order: canonical, ww3, ncswan, wwm, era5, ndbc."""
    has = lambda *names: set(names) <= set(df.columns)
    if has(EFTH, "lat", "lon") or (has(EFTH) and not has("longitude")):
        return SpectraFrame(df, Grid(tuple(grid["freq"]), tuple(grid["dir"]) if grid.get("dir") is not None else None))
    if has("efth", "longitude", "latitude"):
        return from_ww3(df, **grid)
    if has("density", "longitude", "latitude"):
        return from_ncswan(df, **grid)
    if has("AC"):
        return from_wwm(df, **grid)
    if has("d2fd"):
        return from_era5(df, **grid)
    if has("spectral_wave_density"):
        return from_ndbc(df, **grid)
    raise ValueError("the columns fit no known form")


def write_parquet(frame: SpectraFrame, path: str, *partitions: str) -> None:
    """The native form: rows as Parquet, the grid beside them."""
    frame.df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/spectra")
    spark = frame.df.sparkSession
    grid = [(list(frame.grid.freq), list(frame.grid.dir) if frame.grid.dir is not None else None)]
    spark.createDataFrame(grid, "freq array<double>, dir array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def read_parquet(spark, path: str) -> SpectraFrame:
    g = spark.read.parquet(f"{path}/grid").first()
    return SpectraFrame(spark.read.parquet(f"{path}/spectra"), Grid(tuple(g["freq"]), tuple(g["dir"]) if g["dir"] is not None else None))
