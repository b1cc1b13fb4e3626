"""Zarr stores (format 2, and the regular arrays of format 3) without a library: a grid of chunks that tasks read and write.

The rows of a store are dealt in boxes, one for each chunk of the densities along the other dimensions. A task reads the
chunks of every array that meet its box; a chunk that isn't there is the fill value. Chunks are raw, zlib's or gzip's;
any other codec raises by its name.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zlib
from collections.abc import Iterator
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
from ..numbering import numbered
from ..session import prepare
from . import files as FS
from . import netcdf

#: Types of format 3 by name. Fixed values.
TYPES = {"bool": "|b1", **{f"{kind}{8 * n}": f"<{code}{n}" for kind, code, sizes in (("int", "i", (1, 2, 4, 8)), ("uint", "u", (1, 2, 4, 8)), ("float", "f", (4, 8))) for n in sizes}}
CODECS = {"zlib": zlib.decompress, "gzip": gzip.decompress}


@dataclass(frozen=True)
class Array:
    """path and the rest as the metadata have them; fill is a number, text or None; codec is "" for raw chunks."""

    path: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    order: str
    fill: object
    codec: str
    prefix: str
    separator: str
    attrs: dict

    def key(self, at: tuple[int, ...]) -> str:
        return f"{self.path}/{self.prefix}{self.separator.join(map(str, at)) or ('0' if not self.prefix else '')}".rstrip("/")


def of_format_2(path: str, meta: dict, attrs: dict) -> Array:
    compressor = meta.get("compressor") or {"id": ""}
    for f in meta.get("filters") or ():
        raise ValueError(f"{path}: filter {f.get('id')} isn't known")
    dims = tuple(attrs.get("_ARRAY_DIMENSIONS", [f"{path.rsplit('/', 1)[-1]}_{k}" for k in range(len(meta["shape"]))]))
    return Array(path, dims, tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], meta.get("order", "C"), meta.get("fill_value"), compressor["id"], "", meta.get("dimension_separator", "."), attrs)


def of_format_3(path: str, meta: dict) -> Array:
    codec, dtype = "", TYPES.get(str(meta["data_type"]))
    if dtype is None or meta["chunk_grid"]["name"] != "regular":
        raise ValueError(f"{path}: type {meta['data_type']} or grid {meta['chunk_grid']['name']} isn't known")
    for c in meta["codecs"]:
        if c["name"] == "bytes":
            dtype = dtype.replace("<", ">") if (c.get("configuration") or {}).get("endian") == "big" else dtype
        else:
            codec = c["name"]
    keys = meta.get("chunk_key_encoding") or {"name": "default"}
    separator = (keys.get("configuration") or {}).get("separator", "/" if keys["name"] == "default" else ".")
    dims = tuple(meta.get("dimension_names") or [f"{path.rsplit('/', 1)[-1]}_{k}" for k in range(len(meta["shape"]))])
    return Array(path, dims, tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), dtype, "C", meta.get("fill_value"), codec, f"c{separator}" if keys["name"] == "default" else "", separator, meta.get("attributes") or {})


def arrays(fs: pafs.FileSystem, root: str) -> dict[str, Array]:
    """All arrays of a group, from its consolidated metadata or from each array's own."""

    def document(path: str) -> dict | None:
        info = fs.get_file_info(path)
        return json.loads(fs.open_input_stream(path).read()) if info.type == pafs.FileType.File else None

    if (whole := document(f"{root}/.zmetadata")) is not None:
        known = whole["metadata"]
        names = [k.removesuffix("/.zarray") for k in known if k.endswith("/.zarray")]
        return {n: of_format_2(f"{root}/{n}", known[f"{n}/.zarray"], known.get(f"{n}/.zattrs") or {}) for n in names}
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.type == pafs.FileType.Directory:
            if (meta := document(f"{info.path}/.zarray")) is not None:
                out[info.base_name] = of_format_2(info.path, meta, document(f"{info.path}/.zattrs") or {})
            elif (meta := document(f"{info.path}/zarr.json")) is not None and meta.get("node_type") == "array":
                out[info.base_name] = of_format_3(info.path, meta)
    return out


def filled(a: Array, shape) -> np.ndarray:
    kind = np.dtype(a.dtype)
    fill = 0 if a.fill is None else float(a.fill.replace("Infinity", "inf")) if isinstance(a.fill, str) and kind.kind == "f" else b"" if kind.kind == "S" else a.fill
    return np.full(shape, fill, kind)


def read_box(fs: pafs.FileSystem, a: Array, box: list[tuple[int, int]]) -> np.ndarray:
    """The values in a box, from the chunks that it meets."""
    out = filled(a, [hi - lo for lo, hi in box])
    for at in itertools.product(*(range(lo // c, -(-hi // c)) for (lo, hi), c in zip(box, a.chunks))):
        path = a.key(at)
        if fs.get_file_info(path).type != pafs.FileType.File:
            continue
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        if a.codec:
            if a.codec not in CODECS:
                raise ValueError(f"{a.path}: codec {a.codec} isn't known")
            raw = CODECS[a.codec](raw)
        chunk = np.frombuffer(raw, a.dtype).reshape(a.chunks, order=a.order)
        cut = [(max(lo, k * c), min(hi, (k + 1) * c, n)) for (lo, hi), k, c, n in zip(box, at, a.chunks, a.shape)]
        out[tuple(slice(x - lo, y - lo) for (x, y), (lo, _) in zip(cut, box))] = chunk[tuple(slice(x - k * c, y - k * c) for (x, y), k, c in zip(cut, at, a.chunks))]
    return out


def as_variable(a: Array, data: np.ndarray) -> netcdf.Variable:
    """Text for bytes; packed whole numbers unpacked, with the fill value as missing."""
    if data.dtype.kind == "S":
        return netcdf.Variable(a.dims, np.char.decode(np.char.rstrip(data, b"\0"), "utf-8", "replace").astype(object), a.attrs)
    packed = {"scale_factor", "add_offset"} & set(a.attrs) and isinstance(a.fill, (int, float))
    return netcdf.Variable(a.dims, netcdf._unpacked(data, a.attrs | ({"_FillValue": a.fill} if packed else {})), a.attrs)


def read(spark: SparkSession, path: str, kind: str = "native", tasks: int | None = None, **options) -> SpectraFrame:
    """Spectra of a store whose arrays have the names of a kind of netcdf.SPECTRAL; options go to its normaliser. A task reads boxes of chunks; the driver reads metadata and axes."""
    fs, root = FS.system(path)
    value, *names = netcdf.SPECTRAL[kind]
    known = arrays(fs, root)
    heads = {n: netcdf.Head(a.dims, a.attrs, "f8", a.shape, 0, False) for n, a in known.items()}
    how, var = netcdf.described(heads, value, [n for n in names if n]), known.get(value)
    axes = {n: np.asarray(as_variable(known[n], read_box(fs, known[n], [(0, s) for s in known[n].shape])).data, float) for n in how.axes}
    axes |= {n: np.arange(var.shape[var.dims.index(n)], dtype=float) for n in names if n and n not in axes and n in var.dims}
    others = [d for d in var.dims if d not in how.spectral]
    sizes, steps = ({d: x[var.dims.index(d)] for d in others} for x in (var.shape, var.chunks))
    counts = [-(-sizes[d] // steps[d]) for d in others]
    kinds = {n: T.StringType() if np.dtype(known[n].dtype).kind == "S" else T.TimestampNTZType() if "since" in str(known[n].attrs.get("units", "")) else T.DoubleType() for n in how.read}
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType()) if n in (value, *how.also) else kinds[n]) for n in how.read])

    def boxes(batches) -> Iterator[pa.RecordBatch]:
        fs, _ = FS.system(path)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                at = np.unravel_index(number, counts) if counts else ()
                box = {d: (int(k) * steps[d], min(sizes[d], (int(k) + 1) * steps[d])) for d, k in zip(others, at)}
                made = {n: as_variable(known[n], read_box(fs, known[n], [box.get(d, (0, s)) for d, s in zip(known[n].dims, known[n].shape)])) for n in how.read}
                yield netcdf.in_columns(netcdf.rows_of(made, value, how.spectral, how.also), schema)

    many = math.prod(counts)
    df = prepare(spark).range(0, many, 1, min(many, tasks or 4 * spark.sparkContext.defaultParallelism) or 1).mapInArrow(boxes, schema)
    return netcdf.normalised(df, axes, kind, **options)


def to_zarr(frame: SpectraFrame, path: str, dims: list[str], chunks: dict[str, int], codec: str = "zlib") -> None:
    """A new store of format 2 with the dimensions `dims` (columns that tell rows apart, such as time and site), freq and dir.

    Values of a dimension are numbered in their order by Spark; rows of one chunk then meet in one task, which writes the
    chunk of each array. Chunks without rows aren't written. Metadata come last, so that a store that isn't whole can't
    be read. Number columns become arrays along all of `dims`; a spectrum that is there twice raises.
    """
    if codec not in ("", *CODECS):
        raise ValueError(f"codec {codec} isn't known")
    g, (fs, root) = frame.grid, FS.system(path)
    if fs.get_file_info(f"{root}/.zmetadata").type == pafs.FileType.File:
        raise ValueError(f"{path} is there")
    pack = {"": bytes, "zlib": zlib.compress, "gzip": lambda x: gzip.compress(x, mtime=0)}[codec]
    fs.create_dir(root, recursive=True)
    df, meta, lengths = frame.df, {".zgroup": {"zarr_format": 2}, ".zattrs": {"Conventions": "CF-1.6"}}, {}

    def described(name: str, dims: list[str], shape: list[int], size: list[int], kind: str, fill, attrs: dict) -> None:
        meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": shape, "chunks": size, "dtype": kind, "order": "C", "fill_value": fill, "filters": None, "compressor": {"id": codec, "level": 6} if codec else None}
        meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | attrs

    def store(fs, root: str, name: str, at, data: np.ndarray) -> None:
        fs.create_dir(f"{root}/{name}", recursive=True)
        FS.put(fs, f"{root}/{name}/{'.'.join(map(str, at))}", pack(np.ascontiguousarray(data).tobytes()))

    def axis(d: str, size: int, code: str, put):
        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            if pdf[d].isna().any():
                raise ValueError(f"{d} has nulls")
            fs, root = FS.system(path)
            data = np.zeros(size, code)
            data[pdf[f"__{d}"] % size] = put(pdf[d])
            store(fs, root, d, [pdf[f"__{d}"].iloc[0] // size], data)
            return pd.DataFrame({"n": [len(pdf)]})

        return write

    for d in dims:
        values = numbered(df.select(d).distinct(), [d], f"__{d}")
        kind, units = df.schema[d].dataType, {}
        if isinstance(kind, T.StringType):
            width = values.agg(F.max(F.octet_length(d))).first()[0] or 1
            code, put = f"|S{width}", lambda x, width=width: np.array([v.encode() for v in x], f"S{width}")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            code, units = "<f8", {"units": "seconds since 1970-01-01 00:00:00"}
            put = lambda x: (x.to_numpy("datetime64[us]") - np.datetime64("1970-01-01")) / np.timedelta64(1, "s")
        else:
            code, put = "<f8", lambda x: x.to_numpy(float)
        size = max(1, chunks[d])

        lengths[d] = values.groupBy(F.floor(F.col(f"__{d}") / size)).applyInPandas(axis(d, size, code, put), "n long").agg(F.sum("n")).first()[0] or 0
        described(d, [d], [lengths[d]], [size], code, None if code[1] == "S" else "NaN", units)
        df = df.join(values, d)
    spectral = {"freq": g.f, **({"dir": g.theta} if g.dir is not None else {})}
    for name, x in spectral.items():
        store(fs, root, name, [0], x.astype("<f8"))
        described(name, [name], [len(x)], [len(x)], "<f8", "NaN", {})
    names = [f.name for f in frame.df.schema if f.name not in (*dims, EFTH) and isinstance(f.dataType, T.NumericType)]
    steps, shape = [max(1, chunks[d]) for d in dims], [len(x) for x in spectral.values()]
    for name in names:
        described(name, dims, [lengths[d] for d in dims], steps, "<f8", "NaN", {})
    described(EFTH, [*dims, *spectral], [*(lengths[d] for d in dims), *shape], [*steps, *shape], "<f8", "NaN", {"units": netcdf.UNITS["efth"]})

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = FS.system(path)
        at = [int(pdf[f"__{d}"].iloc[0]) // s for d, s in zip(dims, steps)]
        own = tuple((pdf[f"__{d}"] % s).to_numpy() for d, s in zip(dims, steps))
        if len(set(zip(*own))) < len(pdf):
            raise ValueError("a spectrum is there twice")
        for name in names:
            data = np.full(steps, np.nan, "<f8")
            data[own] = pdf[name].to_numpy(float)
            store(fs, root, name, at, data)
        data = np.full([*steps, *shape], np.nan, "<f8")
        data[own] = np.stack([np.asarray(x, float) for x in pdf[EFTH]]).reshape(-1, *shape)
        store(fs, root, EFTH, [*at, *(0 for _ in shape)], data)
        return pd.DataFrame({"n": [len(pdf)]})

    by = [F.floor(F.col(f"__{d}") / s) for d, s in zip(dims, steps)]
    df.select(*(f"__{d}" for d in dims), *names, EFTH).groupBy(*by).applyInPandas(chunk, "n long").agg(F.sum("n")).collect()  # a number
    for key, document in meta.items():
        fs.create_dir(f"{root}/{key}".rpartition("/")[0], recursive=True)
        FS.put(fs, f"{root}/{key}", json.dumps(document).encode())
    FS.put(fs, f"{root}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())


__all__ = ["Array", "Grid", "arrays", "read", "read_box", "to_zarr"]
