"""Commands: convert format, convert stats, reconstruct spectra."""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import construct as C
from .operators import stats as ST
from .sources import models, netcdf, single, text, writers


def frame_of(spark: SparkSession, path: str, engine: str, **options):
    if engine == "parquet":
        return models.read_parquet(spark, path)
    if engine in netcdf.SPECTRAL:
        return netcdf.read(spark, path, engine, **options)
    return text.read(spark, path, engine, **options)


def options_of(pairs: list[str] | None) -> dict:
    """name=value options; values are Python literals, else text."""
    out = {}
    for pair in pairs or []:
        name, _, value = pair.partition("=")
        try:
            out[name] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            out[name] = value
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="seastate")
    sub = top.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert").add_subparsers(dest="what", required=True)
    engines, formats = [*text.PARSERS, *netcdf.SPECTRAL, "parquet"], [*writers.WRITERS, "parquet"]
    one = convert.add_parser("format")
    two = convert.add_parser("stats")
    three = sub.add_parser("reconstruct").add_subparsers(dest="what", required=True).add_parser("spectra")
    for p in (one, two, three):
        p.add_argument("infile")
        p.add_argument("engine", choices=engines)
        p.add_argument("outfile", nargs="?")
        p.add_argument("-o", "--out", dest="out")
        p.add_argument("-k", "--read-option", action="append", metavar="NAME=VALUE")
    one.add_argument("format", choices=formats)
    two.add_argument("-p", "--parameter", action="append")
    three.add_argument("format", choices=formats)
    three.add_argument("-n", "--parts", type=int, default=4)
    three.add_argument("-f", "--freq-name", default="jonswap")
    three.add_argument("-d", "--dir-name", default="cartwright")
    three.add_argument("-m", "--partition-method", default="ptm3")
    three.add_argument("-c", "--combine", default="max")
    a = top.parse_args(argv)
    a.outfile = a.out or a.outfile
    if not a.outfile:
        top.error("an output path is needed")
    spark = SparkSession.builder.appName("seastate").getOrCreate()
    frame = frame_of(spark, a.infile, a.engine, **options_of(a.read_option))
    if a.command == "convert" and a.what == "stats":
        ST.stats(frame.with_df(frame.df.withColumn("source", F.lit(a.infile))), a.parameter or ["hs", "tp", "dpm"]).write.mode("overwrite").parquet(a.outfile)
        return 0
    if a.command == "reconstruct":
        keys = [c for c in frame.others if c in ("time", "site", "lat", "lon", "wspd", "wdir", "dpt", "file")]
        frame = C.partition_and_reconstruct(frame, keys, a.parts, a.freq_name, a.dir_name, a.partition_method, a.combine)
    if a.format == "parquet":
        models.write_parquet(frame, a.outfile)
    else:
        (single.WRITERS | {f: w for f, w in writers.WRITERS.items() if f not in single.WRITERS})[a.format](frame, a.outfile)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
