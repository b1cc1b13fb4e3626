"""The formats as data sources that Spark knows by name: `spark.read.format("seastate.swan")`, its writer, and streams of files.

`register` makes them known to a session. Planning lists files and opens none: the columns of a format are fixed, so a
schema costs nothing, and a schema that the reader is given reads those columns alone. Small files share a partition;
SWAN files are read record by record, and large ones in ranges of bytes. Filters on time, site, position and file are
applied by the source: to names before a file is opened, to SWAN records before their numbers are read.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..frame import EFTH, SpectraFrame
from ..grid import Grid
from ..session import prepare
from . import files as FS
from . import mat, netcdf, text, writers

#: Columns of every format; those that a file doesn't have are null. freq and dir are the row's own grid.
COLUMNS = "time timestamp_ntz, site string, lat double, lon double, wspd double, wdir double, dpt double, file string, freq array<double>, dir array<double>, efth array<double>"
#: Bytes that a partition reads, and spectra that it gives at once.
PARTITION_BYTES, ROWS = 64 << 20, 500
#: Columns that the source filters by, with the filters that it knows.
FILTERED = {"time", "site", "lat", "lon", "file"}
TESTS: dict[type[Filter], Callable] = {
    EqualTo: lambda v, x: v == x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x,
}


@dataclass(frozen=True)
class Piece:
    """A file, or the records of it that begin in a range of its bytes."""

    path: str
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, value: list[Piece]):
        super().__init__(value)


def planned(found: list[FS.File], most: int, split: bool) -> list[Pieces]:
    """Partitions of about `most` bytes: neighbouring small files together, large ones in ranges if they can be split."""
    out: list[Pieces] = []
    own: list[Piece] = []
    size = 0
    for f in found:
        cut = list(range(0, f.size, most)) if split and f.size > most else [0]
        for a, b in zip(cut, [*cut[1:], max(f.size, 1)]):
            if own and size + b - a > most:
                out.append(Pieces(own))
                own, size = [], 0
            own.append(Piece(f.path, a, b))
            size += b - a
    return [*out, Pieces(own)] if own else out


def comparable(value):
    """A filter's value as rows have it: times without a zone."""
    if isinstance(value, (list, tuple)):
        return tuple(map(comparable, value))
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


def accepts(tests: list[tuple[str, type[Filter], object]], row: dict) -> bool:
    """Whether a row passes the tests of the columns that it has so far; null passes none."""
    return all(c not in row or (row[c] is not None and TESTS[kind](row[c], x)) for c, kind, x in tests)


def swan_lines(f, at: int) -> Iterator[tuple[int, str]]:
    """Lines without comments, with the byte at which each begins."""
    for raw in f:
        if not raw.startswith(b"$"):
            yield at, raw.decode("utf-8", "replace")
        at += len(raw)


STAMP = re.compile(r"\s*\d{8}\.\d{6}\b")


def swan_rows(fs: pafs.FileSystem, piece: Piece, wanted: Callable[[dict], bool], dense: bool, dirorder: bool) -> Iterator[tuple[Grid, dict]]:
    """Rows of the records that begin in a piece of a SWAN file. The head is read for each piece; a packed file, and one without times, is its first piece's."""
    f, packed = FS.opened(fs, piece.path)
    with f:
        numbered = swan_lines(f, 0)
        head = text.swan_head((line for _, line in numbered), dirorder)
        if packed or not head.timed:
            if piece.start == 0:
                for row in text.swan_records((line for _, line in numbered), head, wanted, dense):
                    yield head.grid, row
            return
        if piece.start:
            f.seek(piece.start - 1)
            numbered = swan_lines(f, piece.start - 1 + len(f.readline()))

        def lines() -> Iterator[str]:
            """From the piece's first stamp up to the first one behind it."""
            inside = False
            for at, line in numbered:
                if STAMP.match(line):
                    if at >= piece.end:
                        return
                    inside = True
                if inside:
                    yield line

        for row in text.swan_records(lines(), head, wanted, dense):
            yield head.grid, row


def batches(rows: Iterable[tuple[Grid, dict]], schema: T.StructType, name: str, tests: list, grid: Grid | None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the schema's columns; spectra on another grid than `grid`, if there is one, are brought to it."""
    from ..operators.shape import regrid_block, regrid_weights

    kinds, own, weights = to_arrow_schema(schema), [], {}

    def made() -> pa.RecordBatch:
        columns = []
        for field in kinds:
            values = [r.get(field.name) for _, r in own]
            if field.name == "freq":
                values = [list((grid or g).freq) for g, _ in own]
            elif field.name == "dir":
                values = [list(d) if (d := (grid or g).dir) is not None else None for g, _ in own]
            elif field.name == EFTH:
                for k, (g, _) in enumerate(own):
                    if grid is not None and g != grid:
                        weights.setdefault(g, regrid_weights(g, grid))
                        values[k] = regrid_block(values[k][None], g, grid, *weights[g])[0]
                values = [np.asarray(v, float).ravel() for v in values]
            columns.append(pa.array(values, field.type, from_pandas=False))
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    for g, row in rows:
        row["file"] = name
        if accepts(tests, row):
            own.append((g, row))
        if len(own) == ROWS:
            yield made()
            own.clear()
    if own:
        yield made()


class Reading:
    """What readers of tables and of streams share: how a piece becomes rows."""

    def __init__(self, engine: str, schema: T.StructType, options: dict):
        self.engine, self.schema, self.tests = engine, schema, []
        self.path = options.get("path") or options.get("paths")
        if not self.path:
            raise ValueError("a path is needed")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.dirorder = options.get("dirorder", "true").lower() == "true"
        freq, dir = (json.loads(options.get(x, "null")) for x in ("freq", "dir"))
        self.grid = Grid(tuple(freq), tuple(dir) if dir is not None else None) if freq else None
        self.more = json.loads(options.get("parser", "{}"))
        unknown = set(schema.fieldNames()) & {"time"} and not isinstance(schema["time"].dataType, T.TimestampNTZType)
        if unknown:
            raise ValueError("time is a timestamp without zone")

    def listed(self) -> list[FS.File]:
        paths = json.loads(self.path) if self.path.startswith("[") else self.path
        return [f for f in FS.found(paths) if accepts(self.tests, {"file": posixpath.basename(f.path)})]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        first = json.loads(self.path)[0] if self.path.startswith("[") else self.path
        fs, dense = FS.system(re.match(r"[^*?{]*", first)[0])[0], EFTH in self.schema.fieldNames()
        wanted = lambda row: accepts(self.tests, row)
        for piece in partition.value:
            name = posixpath.basename(piece.path)
            if self.engine == "swan":
                rows = swan_rows(fs, piece, wanted, dense, self.dirorder)
            else:
                f, _ = FS.opened(fs, piece.path)
                with f:
                    raw = f.read()
                grid, found = mat.parse_xwaves(raw, piece.path) if self.engine == "xwaves" else text.PARSERS[self.engine](raw.decode("utf-8", "replace"), piece.path, **self.more)
                rows = ((grid, row) for row in found)
            yield from batches(rows, self.schema, name, self.tests, self.grid)


class FileReader(Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[-1]
            if type(f) in TESTS and len(f.attribute) == 1 and column in FILTERED:
                self.tests.append((column, type(f), comparable(f.value)))
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        found = self.listed()
        if not found and not self.tests:
            raise FileNotFoundError(self.path)
        return planned(found, self.most, self.engine == "swan") or [Pieces([])]


class FileStream(Reading, DataSourceStreamReader):
    """Files as they arrive. A log in a folder of the query's own (option `log`) says which files each offset added, so a
    query that starts again gives the same files for the same offsets, whatever their times are."""

    def __init__(self, engine: str, schema: T.StructType, options: dict):
        super().__init__(engine, schema, options)
        if not options.get("log"):
            raise ValueError("a stream needs the option log: a folder that this query alone uses")
        self.fs, self.log = FS.system(options["log"])
        self.most_files = int(options.get("maxFilesPerTrigger", 0))

    def entry(self, n: int) -> str:
        return f"{self.log}/{n:012d}.json"

    def entries(self, after: int = 0, upto: int | None = None) -> dict[int, list[FS.File]]:
        found = self.fs.get_file_info(pafs.FileSelector(self.log, allow_not_found=True))
        numbers = sorted(int(m[1]) for i in found if (m := re.fullmatch(r"(\d{12})\.json", i.base_name)))
        own = [n for n in numbers if n > after and (upto is None or n <= upto)]
        return {n: [FS.File(*x) for x in json.loads(self.fs.open_input_stream(self.entry(n)).read())] for n in own}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        """The number of the last entry, after one for files that no entry has yet."""
        known = self.entries()
        seen = {f.path for own in known.values() for f in own}
        new = [f for f in self.listed() if f.path not in seen]
        new = sorted(new, key=lambda f: (f.stamp, f.path))[: self.most_files or None]
        last = max(known, default=0)
        if not new:
            return {"n": last}
        self.fs.create_dir(self.log, recursive=True)
        part = f"{self.log}/.{uuid.uuid4().hex}"
        FS.put(self.fs, part, json.dumps([[f.path, f.size, f.stamp] for f in new]).encode())
        self.fs.move(part, self.entry(last + 1))
        return {"n": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        added = [f for own in self.entries(start["n"], end["n"]).values() for f in own]
        return planned(added, self.most, self.engine == "swan")


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, name) of each file that a task has made."""

    files: list[tuple[str, str]]


class SwanWriter(DataSourceArrowWriter):
    """A SWAN file for each value of the columns `by`, from rows that come together and in the order of time (`save` deals them so).

    Tasks write under a temporary folder. Once all are through, files are moved to their names, and the list of names is
    written last; a task that is repeated, and a query that fails, leave nothing.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.fs, self.path = FS.system(options["path"])
        self.overwrite, self.names = overwrite, schema.fieldNames()
        self.by = [c for c in options.get("by", "site").split(",") if c]
        freq, dir = (json.loads(options.get(x, "null")) for x in ("freq", "dir"))
        if not freq or EFTH not in self.names or set(self.by) - set(self.names):
            raise ValueError("freq (and dir) as options, efth and the columns named by `by` are needed")
        self.grid = Grid(tuple(freq), tuple(dir) if dir is not None else None)
        self.packed = options.get("compression", "none") == "gzip"
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        made, name, out, g = [], None, None, self.grid
        self.fs.create_dir(self.temporary, recursive=True)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    own = "_".join(f"{c}={row[c]}" for c in self.by).replace("/", "%2F") + ".spec" + ".gz" * self.packed
                    at, time = tuple(0.0 if row.get(c) is None else row[c] for c in ("lon", "lat")), row.get("time")
                    if own != name:
                        if out is not None:
                            out.close()
                        if any(own == n for _, n in made):
                            raise ValueError(f"the rows of {own} don't come together")
                        made.append((f"{self.temporary}/{uuid.uuid4().hex}", own))
                        stream = self.fs.open_output_stream(made[-1][0], compression="gzip" if self.packed else None)
                        out, name, first = io.TextIOWrapper(stream, "utf-8", newline="\n"), own, at
                        out.write(writers.swan_header(g, [first], time is not None))
                    elif at != first or time is None or last is None or time <= last:
                        raise ValueError(f"{own} needs one place, and times that rise")
                    last = time
                    if time is not None:
                        out.write(f"{time.strftime('%Y%m%d.%H%M%S'):<40}date and time\n")
                    out.write(writers.swan_block(np.array([np.nan if x is None else x for x in row[EFTH]], float).reshape(g.nf, g.nd)))
        finally:
            if out is not None:
                out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        new = [x for m in messages if m is not None for x in m.files]
        names = {n for _, n in new}
        old = {posixpath.basename(f.path) for f in FS.found(self.path) if posixpath.dirname(f.path) == self.path.rstrip("/")}
        if len(names) < len(new) or (not self.overwrite and old & names):
            self._clear()
            raise ValueError(f"rows of one file came from two tasks, or a file of this name is there: {self.path}")
        self.fs.create_dir(self.path, recursive=True)
        for temporary, name in new:
            self.fs.move(temporary, f"{self.path}/{name}")
        for name in old - names if self.overwrite else ():
            self.fs.delete_file(f"{self.path}/{name}")
        FS.put(self.fs, f"{self.path}/_SUCCESS", json.dumps(sorted(names if self.overwrite else names | old)).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.fs.get_file_info(self.temporary).type == pafs.FileType.Directory:
            self.fs.delete_dir(self.temporary)


class FileSource(DataSource):
    """A format; options: path (a list in JSON for several), partitionBytes, freq and dir (a grid in JSON to bring all spectra to), dirorder, parser (its own arguments in JSON), columns (more columns, as DDL)."""

    engine = ""

    @classmethod
    def name(cls) -> str:
        return f"seastate.{cls.engine}"

    def schema(self) -> str:
        return ", ".join(filter(None, [COLUMNS, self.options.get("columns")]))

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(self.engine, schema, self.options)

    def streamReader(self, schema: T.StructType) -> FileStream:
        return FileStream(self.engine, schema, self.options)


class SwanSource(FileSource):
    engine = "swan"

    def writer(self, schema: T.StructType, overwrite: bool) -> SwanWriter:
        return SwanWriter(schema, self.options, overwrite)


class OctopusSource(FileSource):
    engine = "octopus"


class StationSource(FileSource):
    engine = "ww3_station"


class FunwaveSource(FileSource):
    engine = "funwave"


class FunwaveNewSource(FileSource):
    engine = "funwave_new"


class TriaxysSource(FileSource):
    engine = "triaxys"


class NdbcSource(FileSource):
    engine = "ndbc_ascii"


class DatawellSource(FileSource):
    engine = "datawell"


class ObscapeSource(FileSource):
    engine = "obscape"


class SpotterSource(FileSource):
    engine = "spotter"


class AwacSource(FileSource):
    engine = "awac"


class JsonSource(FileSource):
    engine = "json"


class XwavesSource(FileSource):
    engine = "xwaves"


class NetcdfReader(DataSourceReader):
    """Rows of NetCDF files under their own names. Small files are read whole, without a look at them in planning; of large ones the header says how they are cut."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.value, *names = netcdf.SPECTRAL[options.get("kind", "native")]
        self.names = [n for n in names if n]

    def partitions(self) -> list[Pieces]:
        out, fs = [], FS.system(re.match(r"[^*?{]*", self.path)[0])[0]
        for f in FS.found(self.path):
            parts = [None]
            if f.size > self.most:
                with fs.open_input_file(f.path) as opened:
                    heads = netcdf.read_layout(opened).heads
                parts = list(netcdf.ranges(heads[self.value], netcdf.described(heads, self.value, self.names), self.most))
            out += [Pieces([(f.path, part)]) for part in parts]
        return out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        fs = FS.system(re.match(r"[^*?{]*", self.path)[0])[0]
        for path, part in partition.value:
            with fs.open_input_file(path) as f:
                rows = netcdf.read_rows(f, netcdf.read_layout(f), self.value, self.names, part)
            yield netcdf.in_columns(rows, self.schema)


class NetcdfSource(DataSource):
    """Classic NetCDF files; options: path, kind (of netcdf.SPECTRAL), partitionBytes. The first file's header tells the columns, or the schema that is asked for."""

    @classmethod
    def name(cls) -> str:
        return "seastate.netcdf"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        found = FS.found(path)
        if not found:
            raise FileNotFoundError(path)
        value, *names = netcdf.SPECTRAL[self.options.get("kind", "native")]
        with FS.system(re.match(r"[^*?{]*", path)[0])[0].open_input_file(found[0].path) as f:
            return netcdf.columns_of(netcdf.read_layout(f), value, [n for n in names if n])

    def reader(self, schema: T.StructType) -> NetcdfReader:
        return NetcdfReader(schema, self.options)


SOURCES: list[type[DataSource]] = [NetcdfSource, SwanSource, OctopusSource, StationSource, FunwaveSource, FunwaveNewSource, TriaxysSource, NdbcSource, DatawellSource, ObscapeSource, SpotterSource, AwacSource, JsonSource, XwavesSource]


def register(spark: SparkSession) -> SparkSession:
    """Make all formats known to the session, and let it hand filters to them."""
    prepare(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
    return spark


def grid_options(grid: Grid) -> dict[str, str]:
    return {"freq": json.dumps(list(grid.freq)), "dir": json.dumps(list(grid.dir) if grid.dir is not None else None)}


def load(spark: SparkSession, engine: str, path: str | list[str], grid: Grid | None = None, schema: str | None = None, **options) -> SpectraFrame:
    """Spectra of files of a format on one grid: the first row's, read from its file's head, if none is given. schema: the columns to read, efth among them."""
    source = register(spark).read.format(f"seastate.{engine}").options(path=path if isinstance(path, str) else json.dumps(path), **options)
    if grid is None:
        own = source.schema("freq array<double>, dir array<double>").load().first()
        if own is None:
            raise ValueError(f"no spectrum in {path}")
        grid = Grid(tuple(own["freq"]), tuple(own["dir"]) if own["dir"] is not None else None)
    source = spark.read.format(f"seastate.{engine}").options(path=path if isinstance(path, str) else json.dumps(path), **grid_options(grid), **options)
    df: DataFrame = (source.schema(schema) if schema else source).load()
    return SpectraFrame(df.drop("freq", "dir"), grid)


def save(frame: SpectraFrame, path: str, by: list[str], engine: str = "swan", mode: str = "overwrite", **options) -> None:
    """A file for each value of the columns `by`: one shuffle brings its rows together in the order of time, and the format's writer commits all files or none."""
    register(frame.df.sparkSession)
    order = [*by, *(c for c in ("time",) if c in frame.df.columns)]
    dealt = frame.df.repartition(*by).sortWithinPartitions(*order)
    dealt.write.format(f"seastate.{engine}").options(by=",".join(by), **grid_options(frame.grid), **options).mode(mode).save(path)
