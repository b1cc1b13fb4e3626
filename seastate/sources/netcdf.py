"""Classic NetCDF files (CDF-1, CDF-2 and CDF-5) without a library: a parser and a builder of one file's bytes, sources and sinks.

A header says where each record is, so a file is cut into ranges and each task reads the bytes of its own; rows carry the
file's names, and `models` brings them to the canonical form. Files are written record by record. HDF5-based files can't
be read.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..frame import BATCH_ROWS, EFTH, SpectraFrame, pack
from ..grid import Grid
from ..session import prepare
from . import files as FS
from . import models, writers

#: Bytes that a header has at most; beyond them it is damaged.
MOST_HEADER = 1 << 28
#: Bytes of spectra that a range of a file has.
RANGE_BYTES = 32 << 20
#: Bytes of files for each task that reads ranges, beyond a few tasks a core.
TASK_BYTES = 32 << 20

#: The format's type numbers. Fixed values.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Names of spectral dimensions and of their coordinates, by format: densities, frequency, direction. Fixed values.
SPECTRAL = {
    "native": ("efth", "freq", "dir"),
    "ww3": ("efth", "frequency", "direction"),
    "ncswan": ("density", "frequency", "direction"),
    "wwm": ("AC", "nfreq", "ndir"),
    "era5": ("d2fd", "frequency", "direction"),
    "ndbc": ("spectral_wave_density", "frequency", None),
}


@dataclass
class Variable:
    dims: tuple[str, ...]
    data: np.ndarray
    attrs: dict


def padded(n: int) -> int:
    return n + -n % 4


class Reader:
    """Big-endian numbers, names and attributes of a header, one after the other."""

    def __init__(self, raw: bytes):
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.raw, self.at = raw, 4
        self.size, self.offset = (">Q" if raw[3] == 5 else ">I"), (">I" if raw[3] == 1 else ">Q")

    def take(self, form: str) -> int:
        (v,) = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return v

    def name(self) -> str:
        n = self.take(self.size)
        text = self.raw[self.at : self.at + n].decode()
        self.at += padded(n)
        return text

    def listed(self, tag: int) -> Iterator[int]:
        found, n = self.take(">I"), self.take(self.size)
        if n and found != tag:
            raise ValueError("a damaged NetCDF header")
        yield from range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.listed(ATTRIBUTE):
            name, kind, n = self.name(), self.take(">I"), self.take(self.size)
            values = np.frombuffer(self.raw, TYPES[kind], n, self.at)
            self.at += padded(values.nbytes)
            out[name] = values.tobytes().decode("utf-8", "replace").rstrip("\0") if kind == 2 else values.tolist()[0] if n == 1 else values.tolist()
        return out


@dataclass(frozen=True)
class Head:
    """A variable as the header describes it; shape holds the number of records where the first dimension is theirs."""

    dims: tuple[str, ...]
    attrs: dict
    kind: str
    shape: tuple[int, ...]
    begin: int
    record: bool

    @property
    def unit(self) -> int:
        """Bytes of one index of the first dimension."""
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.kind).itemsize


@dataclass(frozen=True)
class Layout:
    heads: dict[str, Head]
    attrs: dict
    step: int  # bytes of a record of all record variables


def layout(raw: bytes) -> Layout | None:
    """What a file's header says, from its first bytes; None if they aren't enough."""
    r = Reader(raw)
    try:
        records = r.take(r.size)
        dims: list[tuple[str, int]] = []
        for _ in r.listed(DIMENSION):
            dims.append((r.name(), r.take(r.size)))
        attrs, heads = r.attributes(), {}
        for _ in r.listed(VARIABLE):
            name = r.name()
            own = [r.take(r.size) for _ in range(r.take(r.size))]
            own_attrs, kind = r.attributes(), TYPES[r.take(">I")]
            r.take(r.size)
            record = bool(own) and dims[own[0]][1] == 0
            heads[name] = Head(tuple(dims[d][0] for d in own), own_attrs, kind, tuple(dims[d][1] or records for d in own), r.take(r.offset), record)
    except (struct.error, ValueError, KeyError, IndexError):
        return None
    if r.at > len(raw):
        return None
    over = [h.unit for h in heads.values() if h.record]
    return Layout(heads, attrs, over[0] if len(over) == 1 else sum(map(padded, over)))


def read_layout(f) -> Layout:
    """The header of an open file; no more than twice its bytes are read."""
    size = 1 << 14
    while True:
        f.seek(0)
        raw = f.read(size)
        if (found := layout(raw)) is not None:
            return found
        if len(raw) < size or size >= MOST_HEADER:
            raise ValueError("a damaged NetCDF header")
        size *= 2


def read_block(f, head: Head, step: int, lead: tuple[int, int] | None = None, second: tuple[int, int] | None = None) -> np.ndarray:
    """A variable's data, or those of a range of its first dimension, and of its second one; no other bytes are read."""
    kind, shape = np.dtype(head.kind), list(head.shape)
    if not shape:
        f.seek(head.begin)
        return np.frombuffer(f.read(kind.itemsize), kind)[0]
    k0, k1 = lead or (0, shape[0])
    j0, j1 = second or (0, shape[1] if len(shape) > 1 else 1)
    inner = head.unit // (shape[1] if len(shape) > 1 and shape[1] else 1)
    whole = second is None or (j0, j1) == (0, shape[1])
    if whole and not head.record:
        f.seek(head.begin + k0 * head.unit)
        raw = f.read((k1 - k0) * head.unit)
    else:
        raw = bytearray()
        for k in range(k0, k1):
            f.seek(head.begin + k * (step if head.record else head.unit) + j0 * inner)
            raw += f.read((j1 - j0) * inner if second else head.unit)
    return np.frombuffer(bytes(raw), kind).reshape([k1 - k0, *([j1 - j0] if second else shape[1:2]), *shape[2:]])


def parse(raw: bytes) -> tuple[dict[str, Variable], dict]:
    """Variables, packed numbers unpacked and fill values NaN, and the file's attributes."""
    f = io.BytesIO(raw)
    found = read_layout(f)
    return {name: Variable(h.dims, _unpacked(np.asarray(read_block(f, h, found.step)), h.attrs), h.attrs) for name, h in found.heads.items()}, found.attrs


def _unpacked(data: np.ndarray, attrs: dict) -> np.ndarray:
    if data.dtype.kind == "S":
        return data
    data = data.astype(data.dtype.newbyteorder("="))
    fill = [attrs[a] for a in ("_FillValue", "missing_value") if isinstance(attrs.get(a), (int, float))]
    if fill or "scale_factor" in attrs or "add_offset" in attrs:
        bad = np.isin(data, np.array(fill, data.dtype)) if fill else np.zeros(data.shape, bool)
        data = data.astype(float) * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)
        data[bad] = np.nan
    return data


CODES = {np.dtype(k): n for n, k in TYPES.items() if n <= 6}


def header(sizes: dict[str, int], records: int, attrs: dict, variables: list[tuple[str, tuple[str, ...], dict, np.dtype]]) -> tuple[bytes, list[int], int]:
    """A CDF-2 header, where each variable begins, and the bytes of a record. sizes: of the dimensions, 0 for that of records; kinds are big-endian."""
    text = lambda s: struct.pack(">I", len(s)) + s + b"\0" * (-len(s) % 4)
    names = list(sizes)

    def attributes(own: dict) -> bytes:
        out = struct.pack(">II", ATTRIBUTE if own else 0, len(own))
        for k, v in own.items():
            out += text(k.encode())
            if isinstance(v, str):
                out += struct.pack(">I", 2) + text(v.encode())
            else:
                kind = 4 if isinstance(v, (int, np.integer)) else 6
                x = np.atleast_1d(np.asarray(v, TYPES[kind]))
                out += struct.pack(">II", kind, len(x)) + x.tobytes()
        return out

    unit = [int(np.prod([sizes[d] for d in dims if sizes[d]], dtype=np.int64)) * kind.itemsize for _, dims, _, kind in variables]
    over = [bool(dims) and sizes[dims[0]] == 0 for _, dims, _, _ in variables]
    step = sum(padded(n) for n, x in zip(unit, over) if x)

    def made(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", records) + struct.pack(">II", DIMENSION if names else 0, len(names))
        out += b"".join(text(d.encode()) + struct.pack(">I", sizes[d]) for d in names) + attributes(attrs)
        out += struct.pack(">II", VARIABLE if variables else 0, len(variables))
        for (name, dims, own, kind), n, begin in zip(variables, unit, begins):
            out += text(name.encode()) + struct.pack(">I", len(dims)) + b"".join(struct.pack(">I", names.index(d)) for d in dims)
            out += attributes(own) + struct.pack(">IIQ", CODES[kind], min(padded(n), (1 << 32) - 4), begin)
        return out

    at, begins = len(made([0] * len(variables))), [0] * len(variables)
    for turn in (False, True):  # records stand behind everything else
        for k, x in enumerate(over):
            if x == turn:
                begins[k] = at
                at += padded(unit[k])
    return made(begins), begins, step


def build(variables: dict[str, Variable], attrs: dict | None = None) -> bytes:
    """A CDF-2 file without record dimensions; equal input gives equal bytes."""
    sizes: dict[str, int] = {}
    for v in variables.values():
        for d, n in zip(v.dims, v.data.shape):
            if sizes.setdefault(d, n) != n:
                raise ValueError(f"dimension {d} has two lengths")
    bodies = {k: v.data.astype(v.data.dtype.newbyteorder(">")) if v.data.dtype.kind != "S" else v.data for k, v in variables.items()}
    head, *_ = header(sizes, 0, attrs or {}, [(k, v.dims, v.attrs, bodies[k].dtype) for k, v in variables.items()])
    return head + b"".join(b.tobytes() + b"\0" * (-b.nbytes % 4) for b in bodies.values())


def decoded_times(data: np.ndarray, units: str) -> np.ndarray:
    """Times by units such as "days since 1990-01-01"."""
    m = re.match(r"\s*(\w+?)s?\s+since\s+(\S+(?:\s+[\d:.]+)?)", units)
    if not m or m[1].lower() not in ("second", "minute", "hour", "day"):
        raise ValueError(f"unknown time units: {units}")
    start = pd.Timestamp(m[2]).tz_localize(None)
    unit = {"second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10}[m[1].lower()]
    return start.to_datetime64() + np.round(np.asarray(data, float) * unit).astype("timedelta64[us]")


def rows_of(variables: dict[str, Variable], value: str, spectral: tuple[str, ...], also: tuple[str, ...] = ()) -> pd.DataFrame:
    """A row for each place in the other dimensions: coordinates and variables of these, and arrays of the spectral ones."""
    var = variables[value]
    others = [d for d in var.dims if d not in spectral]
    shape = [dict(zip(var.dims, var.data.shape))[d] for d in others]
    at = np.indices(shape).reshape(len(others), -1)
    out = {}
    for name, v in variables.items():
        dims, data = v.dims, v.data
        if data.dtype.kind == "S" and dims:
            data = np.array([b"".join(x).decode("utf-8", "replace").strip("\0 ") for x in data.reshape(-1, data.shape[-1])], object).reshape(data.shape[:-1])
            dims = dims[:-1]
        own = [d for d in dims if d not in spectral]
        if name in (value, *also):
            flat = np.transpose(data, [dims.index(d) for d in [*own, *(s for s in spectral if s in dims)]]).reshape(*[data.shape[dims.index(d)] for d in own], -1)
            out[name] = list(flat[tuple(at[others.index(d)] for d in own)].astype(float))
        elif set(dims) <= set(others):
            if "since" in str(v.attrs.get("units", "")):
                data = decoded_times(data, v.attrs["units"])
            out[name] = data[tuple(at[others.index(d)] for d in dims)] if dims else np.full(at.shape[1], data[()])
    return pd.DataFrame(out)


@dataclass(frozen=True)
class Described:
    """How a file's variables become rows: dimensions of the spectrum, variables that hold arrays of it beside the value, axes, and those to read."""

    spectral: tuple[str, ...]
    also: tuple[str, ...]
    axes: tuple[str, ...]
    read: tuple[str, ...]
    lead: str | None
    second: str | None


def described(heads: dict[str, Head], value: str, names: list[str]) -> Described:
    if value not in heads:
        raise ValueError(f"no variable {value}")
    var = heads[value]
    spectral = tuple(d for n in names for d in var.dims if d == n or (n in heads and heads[n].dims == (d,)))  # frequency first, as spectra are packed
    axes = tuple(n for n in (*names, "spsig", "spdir") if n in heads)
    others = [d for d in var.dims if d not in spectral]
    also = tuple(n for n, v in heads.items() if n != value and n not in axes and set(v.dims) & set(spectral) and set(spectral) >= set(v.dims) - set(var.dims) and set(v.dims) >= set(var.dims))
    read = tuple(n for n, v in heads.items() if n in (value, *also) or (n not in axes and set(v.dims[:-1] if v.kind == "S1" else v.dims) <= set(others)))
    ahead = list(itertools.takewhile(lambda d: d not in spectral, var.dims))
    return Described(spectral, also, axes, read, *(ahead[k] if len(ahead) > k else None for k in (0, 1)))


def ranges(head: Head, how: Described, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(k0, k1, j0, j1): parts of the first two dimensions whose values take `most` bytes, or those of one index; whole indices of the first one if they fit."""
    if how.lead is None:
        yield 0, 1, 0, 1
        return
    n0, n1 = head.shape[0], head.shape[1] if how.second else 1
    if head.unit <= most or how.second is None:
        step = max(1, most // max(1, head.unit))
        yield from ((k, min(n0, k + step), 0, n1) for k in range(0, n0, step))
    else:
        step = max(1, most // (head.unit // n1))
        yield from ((k, k + 1, j, min(n1, j + step)) for k in range(n0) for j in range(0, n1, step))


def read_rows(f, found: Layout, value: str, names: list[str], part: tuple[int, int, int, int] | None = None) -> pd.DataFrame:
    """The rows of a part of a file: of variables along its dimensions only that range is read."""
    how, made = described(found.heads, value, names), {}
    for name in how.read:
        h = found.heads[name]
        lead = part[:2] if part and how.lead in h.dims[:1] else None
        second = part[2:] if part and lead and how.second and h.dims[1:2] == (how.second,) else None
        data = np.asarray(read_block(f, h, found.step, lead, second))
        for dim, cut in ((how.lead, part[:2]), (how.second, part[2:])) if part else ():
            if dim in h.dims and not (lead if dim == how.lead else second):
                data = np.take(data, np.arange(*cut), axis=h.dims.index(dim))
        made[name] = Variable(h.dims, _unpacked(data, h.attrs), h.attrs)
    return rows_of(made, value, how.spectral, how.also)


def axes_of(f, found: Layout, value: str, names: list[str]) -> dict[str, np.ndarray]:
    how, var = described(found.heads, value, names), found.heads[value]
    axes = {n: np.asarray(read_block(f, found.heads[n], found.step), float) for n in how.axes}
    return axes | {n: np.arange(var.shape[var.dims.index(n)], dtype=float) for n in names if n not in axes and n in var.dims}


def columns_of(found: Layout, value: str, names: list[str]) -> T.StructType:
    """The columns that read_rows() gives, told from the header alone."""
    how, fields = described(found.heads, value, names), []
    for n in how.read:
        h = found.heads[n]
        kind = T.ArrayType(T.DoubleType()) if n in (value, *how.also) else T.StringType() if h.kind == "S1" and h.dims else T.TimestampNTZType() if "since" in str(h.attrs.get("units", "")) else T.DoubleType()
        fields.append(T.StructField(n, kind))
    return T.StructType(fields)


def in_columns(rows: pd.DataFrame, schema: T.StructType) -> pa.RecordBatch:
    """The rows with a schema's columns; those that they lack are null. NaN in a spectrum stays NaN, as a number it is null."""
    out, kinds = [], to_arrow_schema(schema)
    for kind in kinds:
        if kind.name not in rows:
            out.append(pa.nulls(len(rows), kind.type))
        elif pa.types.is_list(kind.type) and len(rows):
            out.append(pack(np.stack(rows[kind.name].to_list())).cast(kind.type))
        else:
            out.append(pa.array(rows[kind.name].astype(float) if kind.type == pa.float64() else rows[kind.name], kind.type, from_pandas=True))
    return pa.RecordBatch.from_arrays(out, schema=kinds)


def open_files(spark: SparkSession, paths: str | list[str], kind: str, tasks: int | None = None, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(rows under the files' own names, axes) of all files, in ranges of about range_bytes of spectra that tasks read by themselves.

    The driver lists names. Headers are read by tasks, and what comes back is their distinct columns and axes: all
    files' columns stay, and axes that differ raise. Another pass over the headers cuts each file into ranges, which are
    dealt over `tasks` tasks, or a few a core and one more for each TASK_BYTES of the files, not more than ranges.
    """
    value, *names = SPECTRAL[kind]
    names = [n for n in names if n]
    files = FS.found(paths)
    if not files:
        raise FileNotFoundError(str(paths))
    first = paths if isinstance(paths, str) else paths[0]
    root = re.match(r"[^*?{]*", first)[0]
    many = tasks or max(1, min(sum(f.size for f in files) // TASK_BYTES + 4 * prepare(spark).sparkContext.defaultParallelism, len(files) + sum(f.size for f in files) // range_bytes))
    listed = prepare(spark).createDataFrame([(f.path,) for f in files], "path string").repartition(max(1, min(many, len(files))))

    def each(op):
        """A batch for each row of the list; a file that the row before had stays open, with its header."""

        def run(batches):
            fs, path, f, found = FS.system(root)[0], None, None, None
            try:
                for pdf in batches:
                    for row in (pdf.to_pandas() if isinstance(pdf, pa.RecordBatch) else pdf).itertuples(index=False):
                        if row.path != path:
                            if f is not None:
                                f.close()
                            path, f = row.path, fs.open_input_file(row.path)
                            found = read_layout(f)
                        yield op(f, found, row)
            finally:
                if f is not None:
                    f.close()

        return run

    def head(f, found, row) -> pd.DataFrame:
        axes = {k: v.tolist() for k, v in axes_of(f, found, value, names).items()}
        return pd.DataFrame({"columns": [columns_of(found, value, names).json()], "axes": [json.dumps(axes)]})

    def cut(f, found, row) -> pd.DataFrame:
        parts = list(ranges(found.heads[value], described(found.heads, value, names), range_bytes))
        return pd.DataFrame([(row.path, *x) for x in parts], columns=["path", "k0", "k1", "j0", "j1"])

    heads = listed.mapInPandas(each(head), "columns string, axes string").distinct().collect()  # as many rows as kinds of files
    axes = {k: np.array(v) for k, v in json.loads(heads[0]["axes"]).items()}
    for own in ({k: np.array(v) for k, v in json.loads(h["axes"]).items()} for h in heads[1:]):
        if any(len(own[a]) != len(axes[a]) or not np.allclose(own[a], axes[a]) for a in axes):
            raise ValueError("files of different frequencies or directions")
    fields: dict[str, T.StructField] = {}
    for h in sorted(x["columns"] for x in heads):
        for field in T.StructType.fromJson(json.loads(h)).fields:
            fields.setdefault(field.name, field)
    schema = T.StructType(list(fields.values()))
    plan = listed.mapInPandas(each(cut), "path string, k0 long, k1 long, j0 long, j1 long")
    plan = plan.repartition(many, F.xxhash64("path", "k0", "j0") % 1_000_003).sortWithinPartitions("path", "k0", "j0")
    read = lambda f, found, row: in_columns(read_rows(f, found, value, names, (row.k0, row.k1, row.j0, row.j1)), schema)
    return plan.mapInArrow(each(read), schema), axes


def read(spark: SparkSession, paths: str | list[str], kind: str = "native", tasks: int | None = None, range_bytes: int = RANGE_BYTES, **options) -> SpectraFrame:
    """Spectra of NetCDF files of a kind of SPECTRAL, read in ranges (see open_files); options go to its normaliser in `models`."""
    return normalised(*open_files(spark, paths, kind, tasks, range_bytes), kind, **options)


def normalised(df: DataFrame, axes: dict[str, np.ndarray], kind: str, **options) -> SpectraFrame:
    """Rows under a kind's own names as spectra; options go to its normaliser in `models`."""
    value, freq, dir = SPECTRAL[kind]
    if kind == "native":
        return SpectraFrame(df, Grid(tuple(axes[freq]), tuple(axes[dir]) if dir in axes else None))
    if kind == "wwm":
        return models.from_wwm(df, axes["spsig"], axes["spdir"])
    if kind == "era5":
        return models.from_era5(df, len(axes[freq]), len(axes[dir]), **options)
    if kind == "ndbc":
        return models.from_ndbc(df, axes[freq], **options)
    return {"ww3": models.from_ww3, "ncswan": models.from_ncswan}[kind](df, axes[freq], axes[dir])


#: Packed densities: the step between numbers, and the number that says that there is none. Fixed values.
STEP, FILL = 1e-5, -32768
#: Global attributes of a point file of the ww3 kind. Fixed values.
POINT_ATTRIBUTES = {"Conventions": "CF-1.6", "data_type": "OCO spectra 2D", "format_version": "seastate"}
#: Units by name in the files of either kind. Fixed values.
UNITS = {"frequency": "s-1", "frequency1": "s-1", "frequency2": "s-1", "freq": "s-1", "direction": "degree", "dir": "degree", "wnd": "m s-1", "wspd": "m s-1", "wnddir": "degree", "wdir": "degree", "dpt": "m", "longitude": "degree_east", "lon": "degree_east", "latitude": "degree_north", "lat": "degree_north", "efth": "m2 s deg-1"}


def packed_densities(x: np.ndarray) -> np.ndarray:
    """Whole numbers of STEP; what is larger than they can be raises."""
    with np.errstate(invalid="ignore"):
        whole = np.rint(x / STEP)
        if (np.abs(whole) >= 1 << 31).any():
            raise ValueError("a density is too large to be packed")
        return np.where(np.isnan(whole), FILL, whole).astype(">i4")


class RecordFile:
    """A file that grows by records. Their number is known before, so that nothing is written twice."""

    def __init__(self, fs, path: str, sizes: dict[str, int], records: int, attrs: dict, fixed: dict[str, Variable], along: list[tuple[str, tuple[str, ...], dict, np.dtype]]):
        kinds = [(n, v.dims, v.attrs, v.data.dtype) for n, v in fixed.items()]
        head, _, step = header(sizes, records, attrs, [*kinds, *along])
        shape = lambda dims: tuple(sizes[d] for d in dims[1:])
        fields, at = [], 0
        for name, dims, _, kind in along:
            fields.append((name, kind, shape(dims), at))
            at += padded(int(np.prod(shape(dims), dtype=np.int64)) * kind.itemsize)
        self.record = np.dtype({"names": [x[0] for x in fields], "formats": [(x[1], x[2]) for x in fields], "offsets": [x[3] for x in fields], "itemsize": step})
        self.out, self.left = fs.open_output_stream(path, compression=None), records
        self.out.write(head + b"".join(v.data.tobytes() + b"\0" * (-v.data.nbytes % 4) for v in fixed.values()))

    def write(self, columns: dict[str, np.ndarray]) -> None:
        n = len(next(iter(columns.values())))
        block = np.zeros(n, self.record)
        for name, x in columns.items():
            block[name] = x.reshape(block[name].shape)
        self.out.write(block.tobytes())
        self.left -= n

    def close(self) -> None:
        self.out.close()
        if self.left:
            raise ValueError("a file has another number of records than its header says")


def chars(values: list[str], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.encode()[:width].ljust(width, b"\0") for x in values), "S1").reshape(len(values), width)


def to_netcdf(frame: SpectraFrame, folder: str, by: list[str], kind: str = "native", packed: bool = True) -> None:
    """A file of a kind ("native" or "ww3") for each value of the columns `by`, with records along time (or along `row`, without times).

    Densities are packed into whole numbers of 1e-5, or are doubles. One shuffle brings a file's rows together in order,
    and they are written as they come, so a task holds a batch and no file. Tasks write under temporary names and then
    rename; a repeated task makes the same file again. folder is a URI that pyarrow.fs can write to. A ww3 file is one
    station's: its name is a variable of characters, and its position is one along time.
    """
    if kind not in ("native", "ww3"):
        raise ValueError("files are native or ww3")
    df, freq, dir = frame.df, frame.grid.f, frame.grid.theta if frame.grid.dir is not None else None
    value, f_name, d_name = SPECTRAL[kind]
    renamed: dict[str, str] = {}
    if kind == "ww3":
        df, axes = writers.ww3_form(frame)
        freq, dir = np.array(axes["frequency"]), np.array(axes["direction"])
        renamed = {"site": "station", "lon": "longitude", "lat": "latitude", "wspd": "wnd", "wdir": "wnddir"}
    keys, others, timed = [renamed.get(c, c) for c in by], [c for c in df.columns if c != EFTH], "time" in df.columns
    rows, strings = "time" if timed else "row", [c for c in others if isinstance(df.schema[c].dataType, T.StringType)]
    own = Window.partitionBy(*keys)
    df = df.withColumns({"__n": F.count("*").over(own), **{f"__w{k}": F.greatest(F.lit(1), F.max(F.octet_length(c)).over(own)) for k, c in enumerate(strings)}})
    if timed:
        df = df.withColumns({"__first": F.min("time").over(own), "__last": F.max("time").over(own)})
    df = df.sortWithinPartitions(*keys, *(["time"] if timed else []))
    shape, epoch = (len(freq), *((len(dir),) if dir is not None else ())), np.datetime64("1970-01-01")
    spectral = (f_name, *((d_name,) if dir is not None else ()))
    double, place = np.dtype(">f8"), (rows, "station") if kind == "ww3" else (rows,)

    def begun(fs, path: str, name: str, first: pd.Series) -> RecordFile:
        half = np.diff(freq) / 2
        fixed = {f_name: Variable((f_name,), freq.astype(">f8"), {"units": UNITS[f_name]})}
        if dir is not None:
            fixed[d_name] = Variable((d_name,), dir.astype(">f8"), {"units": UNITS[d_name]})
        attrs, sizes = {"Conventions": "CF-1.6"}, {rows: 0, **dict(zip(spectral, shape))}
        if kind == "ww3":
            station = str(first["station"]) if "station" in first else "0"
            fixed["frequency1"] = Variable((f_name,), (freq - np.append(0, half)).astype(">f8"), {"units": UNITS[f_name]})
            fixed["frequency2"] = Variable((f_name,), (freq + np.append(half, 0)).astype(">f8"), {"units": UNITS[f_name]})
            sizes |= {"station": 1, "string": max(16, len(station.encode()))}
            fixed["station_name"] = Variable(("station", "string"), chars([station], sizes["string"]), {"long_name": "station name"})
            attrs = POINT_ATTRIBUTES | {"product_name": name} | ({"start_date": str(first["__first"]), "stop_date": str(first["__last"])} if timed else {})
        along = [("time", (rows,), {"units": "seconds since 1970-01-01 00:00:00"}, double)] if timed else []
        for c in others:
            if c == "time" or (kind == "ww3" and c == "station"):
                continue
            if c in strings:
                sizes[f"{c}_length"] = int(first[f"__w{strings.index(c)}"])
                along.append((c, (rows, f"{c}_length"), {}, np.dtype("S1")))
            else:
                along.append((c, place, {"units": UNITS[c]} if c in UNITS else {}, double))
        attrs_of_value = {"units": UNITS["efth"], **({"scale_factor": STEP, "_FillValue": FILL} if packed else {})}
        along.append((value, (*place, *spectral), attrs_of_value, np.dtype(">i4") if packed else double))
        return RecordFile(fs, path, sizes, int(first["__n"]), attrs, fixed, along)

    def write(batches):
        fs, at = FS.system(folder)
        fs.create_dir(at, recursive=True)
        out, name, temporary, done = None, None, "", []

        def end() -> None:
            if out is not None:
                out.close()
                fs.move(temporary, f"{at}/{name}")
                done.append(name)

        for pdf in batches:
            names = pdf[keys].astype(str).apply(lambda r: "_".join(f"{c}={x}" for c, x in zip(by, r)), axis=1) + ".nc"
            for _, own in pdf.groupby((names != names.shift()).cumsum(), sort=False):
                if names[own.index[0]] != name:
                    end()
                    name, temporary = names[own.index[0]], f"{at}/.{uuid.uuid4().hex}"
                    out = begun(fs, temporary, name, own.iloc[0])
                columns = {}
                for c in out.record.names:
                    if c == "time":
                        columns[c] = ((own[c].to_numpy("datetime64[us]") - epoch) / np.timedelta64(1, "s")).astype(float)
                    elif c == value:
                        block = np.stack([np.asarray(x, float) for x in own[EFTH]])
                        columns[c] = packed_densities(block) if packed else block
                    elif c in strings:
                        columns[c] = chars([str(x) for x in own[c]], out.record[c].shape[0])
                    else:
                        columns[c] = own[c].to_numpy(float)
                out.write(columns)
        end()
        yield pd.DataFrame({"files": [len(done)]})

    frame.df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.mapInPandas(write, "files long").agg(F.sum("files")).collect()  # a number


__all__ = ["parse", "build", "read", "open_files", "to_netcdf", "Variable"]
