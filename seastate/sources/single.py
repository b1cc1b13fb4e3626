"""One ordered file from many tasks.

Ranges of rows in order are formatted by the tasks that hold them, each into parts of its own. Exact lengths come back,
and nothing else; their sums are the places of the parts in the file. On a file system that can write anywhere in a file
(a local or mounted one) tasks copy parts to their places at once, on others one task appends them in order. The file
gets its name when it is whole. Packed files are made of packed parts, as members of a gzip file follow one another.
"""

from __future__ import annotations

import gzip
import io
import json
import shutil
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import EFTH, SpectraFrame
from ..session import prepare
from . import files as FS
from . import writers

#: Bytes that are copied at once.
COPIED = 8 << 20
#: Formats the rows of a partition, list by list, into a text for each section.
Format = Callable[[], Callable[[list[dict]], list[str]]]


class Assembly:
    """The parts of a file to come: literal bytes, and sections that tasks have written, in the order in which they are added."""

    def __init__(self, spark: SparkSession, path: str, anywhere: bool | None = None):
        """anywhere: whether files can be written at any place; by default, whether they are local or mounted."""
        self.spark, self.packed = prepare(spark), path.endswith(".gz")
        self.uri, (self.fs, self.path) = path, FS.system(path)
        self.anywhere = isinstance(self.fs, pafs.LocalFileSystem) if anywhere is None else anywhere
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.plan: list[tuple[bytes | str, int]] = []

    def bytes(self, text: str) -> bytes:
        return gzip.compress(text.encode(), mtime=0) if self.packed else text.encode()

    def literal(self, text: str) -> None:
        data = self.bytes(text)
        self.plan.append((data, len(data)))

    def sections(self, df: DataFrame, make: Format, count: int) -> list[list[tuple[str, int]]]:
        """(path, bytes) of the parts of each section, in the order of df's partitions; empty ones are left out."""
        uri, folder, packed, tag = self.uri, self.folder, self.packed, uuid.uuid4().hex

        def op(batches):
            fs, number, add = FS.system(uri)[0], TaskContext.get().partitionId(), make()
            names = [f"{folder}/.{uuid.uuid4().hex}" for _ in range(count)]
            outs = [fs.open_output_stream(n, compression=None) for n in names]
            texts = [io.TextIOWrapper(gzip.GzipFile(fileobj=o, mode="wb", mtime=0) if packed else o, "utf-8", newline="") for o in outs]
            some = False
            for batch in batches:
                if batch.num_rows:
                    some = True
                    for out, text in zip(texts, add(batch.to_pylist())):
                        out.write(text)
            for out, raw in zip(texts, outs):
                out.close()
                raw.close()
            sizes = [fs.get_file_info(n).size if some else 0 for n in names]
            for k, (name, size) in enumerate(zip(names, sizes)):
                if size:
                    fs.move(name, f"{folder}/{tag}-{k}-{number:09d}")
                else:
                    fs.delete_file(name)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(count), pa.int32()), "p": pa.array([number] * count, pa.int32()), "n": pa.array(sizes, pa.int64())})

        rows = df.mapInArrow(op, "k int, p int, n long").where("n > 0").collect()  # lengths
        return [[(f"{folder}/{tag}-{k}-{r['p']:09d}", r["n"]) for r in sorted(rows, key=lambda r: r["p"]) if r["k"] == k] for k in range(count)]

    def add(self, parts: list[tuple[str, int]], between: str = "") -> None:
        for k, part in enumerate(parts):
            if k and between:
                self.literal(between)
            self.plan.append(part)

    def finish(self) -> None:
        target, plan, uri = f"{self.folder}/whole", self.plan, self.uri
        if self.anywhere:
            at, moves = 0, []
            with open(target, "wb") as f:
                f.truncate(sum(n for _, n in plan))
                for what, n in plan:
                    if isinstance(what, bytes):
                        f.seek(at)
                        f.write(what)
                    else:
                        moves.append((what, at))
                    at += n

            def copy(batches):
                for pdf in batches:
                    for part, offset in zip(pdf["part"], pdf["at"]):
                        with open(part, "rb") as a, open(target, "r+b") as b:
                            b.seek(offset)
                            shutil.copyfileobj(a, b, COPIED)
                    yield pd.DataFrame({"n": [len(pdf)]})

            if moves:
                self.spark.createDataFrame(moves, "part string, at long").repartition(min(len(moves), 200)).mapInPandas(copy, "n long").agg(F.sum("n")).collect()
        else:

            def append(batches):
                fs = FS.system(uri)[0]
                with fs.open_output_stream(target, compression=None) as b:
                    for what, _ in plan:
                        if isinstance(what, bytes):
                            b.write(what)
                        else:
                            with fs.open_input_stream(what, compression=None) as a:
                                shutil.copyfileobj(a, b, COPIED)
                for pdf in batches:
                    yield pd.DataFrame({"n": [len(pdf)]})

            self.spark.range(1).coalesce(1).mapInPandas(append, "n long").collect()
        self.fs.move(target, self.path)
        self.close()

    def close(self) -> None:
        if self.fs.get_file_info(self.folder).type == pafs.FileType.Directory:
            self.fs.delete_dir(self.folder)


def in_order(df: DataFrame, range_by: list[str], *more: str) -> DataFrame:
    """df in ranges of some columns, so that equal ones are together, sorted by these and others."""
    return df.repartitionByRange(*range_by).sortWithinPartitions(*range_by, *more)


def to_swan(frame: SpectraFrame, path: str) -> None:
    """One file of all sites (lon, lat; 0 if missing) and times; a time that lacks a site, or has one twice, raises."""
    g, has = frame.grid, set(frame.df.columns)
    x, y = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in has else F.lit(0.0) for c in ("lon", "lat"))
    df = frame.df.withColumns({"__x": x, "__y": y})
    order, timed = [*(["site"] if "site" in has else []), "__x", "__y"], "time" in has
    places = df.select(*order).distinct()
    count = places.count()
    each = (df.groupBy("time") if timed else df.groupBy()).agg(F.count("*").alias("n"), F.countDistinct(*(F.coalesce(c, F.lit("")) if c == "site" else F.col(c) for c in order)).alias("m"))
    if not each.where((F.col("n") != count) | (F.col("m") != count)).isEmpty():
        raise ValueError("a time lacks a site, or has it twice")

    def record():
        last = None

        def lines(rows: list[dict]) -> list[str]:
            nonlocal last
            out = []
            for r in rows:
                if timed and r["time"] != last:
                    out.append(f"{r['time'].strftime('%Y%m%d.%H%M%S'):<40}date and time\n")
                    last = r["time"]
                out.append(writers.swan_block(np.array([np.nan if v is None else v for v in r[EFTH]], float).reshape(g.nf, g.nd)))
            return ["".join(out)]

        return lines

    made = Assembly(frame.df.sparkSession, path)
    try:
        head, tail = writers.swan_header(g, [], timed).split(f"{0:6d}".ljust(40), 1)  # the number of places stands between
        made.literal(head + f"{count:6d}".ljust(40) + tail[: tail.index("\n") + 1])
        made.add(*made.sections(in_order(places, order), lambda: lambda rows: ["".join(f"{r['__x']:12.6f}{r['__y']:12.6f}\n" for r in rows)], 1))
        made.literal(tail[tail.index("\n") + 1 :])
        rows = df.select(*(["time"] if timed else []), *order, EFTH)
        made.add(*made.sections(in_order(rows, ["time"], *order) if timed else in_order(rows, order), record, 1))
        made.finish()
    finally:
        made.close()


def to_octopus(frame: SpectraFrame, path: str, site_id: str = "spec", fcut: float = 0.125, missing: float = -99999) -> None:
    """A block for each site, with its header; needs times."""
    g, has = frame.grid.directional() and frame.grid, set(frame.df.columns)
    if "time" not in has:
        raise ValueError("times are needed")
    fill = {c: F.coalesce(F.col(c), F.lit(missing)) if c in has else F.lit(float(missing)) for c in ("wspd", "wdir", "dpt", "lat", "lon")}
    site = "site" if "site" in has else "__site"
    df = frame.df.withColumns(fill) if "site" in has else frame.df.withColumns(fill | {"__site": F.lit(0)})
    df = writers.octopus_rows(SpectraFrame(df, g), fcut)
    own = Window.partitionBy(site).orderBy("time")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    step = F.coalesce((seconds(F.nth_value("time", 2).over(whole)) - seconds(F.first("time").over(whole))) / 3600, F.lit(0.0))
    df = df.withColumns({"__k": F.row_number().over(own) - 1, "__n": F.count("*").over(whole), "__step": step})

    def record():
        return lambda rows: ["".join((writers.octopus_header(r, g, r["__n"]) if r["__k"] == 0 else "") + writers.octopus_record(r, g, r["__k"] * r["__step"], site_id, missing) for r in rows)]

    made = Assembly(frame.df.sparkSession, path)
    try:
        made.add(*made.sections(in_order(df, [site], "time"), record, 1))
        made.finish()
    finally:
        made.close()


def to_json(frame: SpectraFrame, path: str, dim: str = "time") -> None:
    """A dataset dict along one dimension, times in ISO form: each variable's list is a section of the file."""
    g, others = frame.grid, frame.others
    rest = [c for c in others if c != dim]
    template = json.loads(writers.json_text([], g, dim, others))
    template["coords"][dim]["data"] = ["\0"]
    for v in (EFTH, *rest):
        template["data_vars"][v]["data"] = ["\0"]
    literal = json.dumps(template).split('"\\u0000"')

    def lists():
        begun = False

        def texts(rows: list[dict]) -> list[str]:
            nonlocal begun
            own = json.loads(writers.json_text(rows, g, dim, others))
            found = [own["coords"][dim]["data"], own["data_vars"][EFTH]["data"], *(own["data_vars"][c]["data"] for c in rest)]
            out = [(", " if begun else "") + json.dumps(x)[1:-1] for x in found]
            begun = True
            return out

        return texts

    made = Assembly(frame.df.sparkSession, path)
    try:
        found = made.sections(in_order(frame.df, [dim], *(c for c in ("site", "lon", "lat") if c in rest)), lists, 2 + len(rest))
        for text, parts in zip(literal, [*found, []]):
            made.literal(text)
            made.add(parts, ", ")
        made.finish()
    finally:
        made.close()


#: Formats that tasks put together; `writers` has the others.
WRITERS = {"swan": to_swan, "octopus": to_octopus, "json": to_json}

