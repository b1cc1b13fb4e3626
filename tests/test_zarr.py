"""Zarr stores: round trips, both formats from hand-made metadata, missing chunks, codecs by name."""

import datetime as dt
import gzip
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.numbering import numbered
from seastate.sources import files as FS
from seastate.sources import zarr as Z

R = np.random.default_rng(5)
G = Grid((0.05, 0.1, 0.2), (0.0, 90.0, 180.0, 270.0))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(dt.datetime(2001, 1, 1 + k), f"é{s}", 3.0 * s, R.uniform(0, 9, G.size).tolist()) for s in range(7) for k in range(11) if (s < 3 or k < 5) and (s, k) != (0, 0)]
    return SpectraFrame(spark.createDataFrame(rows, "time timestamp_ntz, site string, wspd double, efth array<double>").repartition(4), G)


def rows(df):
    return sorted((x["time"], x["site"], x["wspd"], x[EFTH]) for x in df.collect() if not math.isnan(x[EFTH][0] if x[EFTH][0] is not None else math.nan))


@pytest.mark.parametrize(("codec", "chunks"), [("zlib", {"time": 4, "site": 3}), ("gzip", {"time": 1, "site": 1}), ("", {"time": 50, "site": 2})])
def test_round_trip(spark, frame, tmp_path, codec, chunks):
    path = f"file://{tmp_path}/store"
    Z.to_zarr(frame, path, ["time", "site"], chunks, codec)
    back = Z.read(spark, path, tasks=5)
    assert back.grid == G and rows(back.df) == rows(frame.df) and back.df.count() == 77
    there = [x.name for x in (tmp_path / "store" / EFTH).iterdir() if not x.name.startswith(".")]
    assert len(there) == len({((k - 1) // chunks["time"], int(s[1]) // chunks["site"]) for k, s in ((x["time"].day, x["site"]) for x in frame.df.collect())})
    with pytest.raises(ValueError, match="is there"):
        Z.to_zarr(frame, path, ["time", "site"], chunks)


def test_what_is_no_store(spark, frame, tmp_path):
    twice = frame.with_df(frame.df.union(frame.df))
    with pytest.raises(Exception, match="there twice"):
        Z.to_zarr(twice, f"file://{tmp_path}/a", ["time", "site"], {"time": 4, "site": 3})
    with pytest.raises(Exception, match="has nulls"):
        Z.to_zarr(frame.with_df(frame.df.selectExpr("time", "nullif(site, 'é2') AS site", "efth")), f"file://{tmp_path}/b", ["time", "site"], {"time": 4, "site": 3})
    with pytest.raises(ValueError, match="lz9"):
        Z.to_zarr(frame, f"file://{tmp_path}/c", ["time", "site"], {"time": 4, "site": 3}, "lz9")
    assert not (tmp_path / "a" / ".zmetadata").exists()


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def test_formats_by_hand(spark, tmp_path):
    """Format 2 in Fortran's order with packed numbers and folders of chunks, and format 3, with a chunk left out."""
    e = R.integers(1, 900, (3, 3, 4))
    axis = {"time": np.array([0.0, 6, 12]), "freq": np.array(G.freq), "dir": np.array(G.dir)}
    two, three = tmp_path / "two", tmp_path / "three"
    for name, x in axis.items():
        more = {"units": "hours since 2000-01-01"} if name == "time" else {}
        put(two / name / ".zarray", {"zarr_format": 2, "shape": [len(x)], "chunks": [len(x)], "dtype": "<f8", "order": "C", "fill_value": None, "filters": None, "compressor": None})
        put(two / name / ".zattrs", {"_ARRAY_DIMENSIONS": [name], **more})
        put(two / name / "0", x.tobytes())
        put(three / name / "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": [len(x)], "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [len(x)]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "attributes": more, "dimension_names": [name]})
        put(three / name / "c" / "0", x.tobytes())
    put(two / "efth" / ".zarray", {"zarr_format": 2, "shape": [3, 3, 4], "chunks": [2, 3, 3], "dtype": ">i4", "order": "F", "fill_value": -9, "filters": None, "compressor": {"id": "zlib", "level": 1}, "dimension_separator": "/"})
    put(two / "efth" / ".zattrs", {"_ARRAY_DIMENSIONS": ["time", "freq", "dir"], "scale_factor": 0.5})
    put(three / "efth" / "zarr.json", {"zarr_format": 3, "node_type": "array", "shape": [3, 3, 4], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 3, 3]}}, "chunk_key_encoding": {"name": "v2", "configuration": {"separator": "."}}, "fill_value": -9, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}], "attributes": {"scale_factor": 0.5}, "dimension_names": ["time", "freq", "dir"]})
    padded = np.zeros((4, 3, 6), ">i4")
    padded[:3, :, :4] = e
    for i, j in ((0, 0), (0, 1), (1, 0)):
        chunk = padded[2 * i : 2 * i + 2, :, 3 * j : 3 * j + 3]
        put(two / "efth" / f"{i}/0/{j}", zlib.compress(chunk.tobytes(order="F")))
        put(three / "efth" / f"{i}.0.{j}", gzip.compress(chunk.tobytes()))
    want = e * 0.5
    want[2, :, 3] = np.nan
    for store in (two, three):
        back = Z.read(spark, f"file://{store}")
        np.testing.assert_allclose(np.array([x[EFTH] for x in back.df.orderBy("time").collect()], float).reshape(3, 3, 4), want)
        assert back.grid == G and back.df.agg({"time": "max"}).first()[0] == dt.datetime(2000, 1, 1, 12)
    fs, root = FS.system(str(two))
    a = Z.arrays(fs, root)["efth"]
    for box in ([(0, 3), (0, 3), (0, 4)], [(1, 3), (1, 2), (2, 4)], [(2, 3), (0, 1), (3, 4)]):
        x = Z.read_box(fs, a, box)
        cut = tuple(slice(*b) for b in box)
        assert (np.where(np.isnan(want), -9, e)[cut] == x).all()
    meta = json.loads((two / "efth" / ".zarray").read_text())
    put(two / "efth" / ".zarray", meta | {"compressor": {"id": "blosc"}})
    with pytest.raises(Exception, match="blosc"):
        Z.read(spark, f"file://{two}").df.collect()
    put(two / "efth" / ".zarray", meta | {"filters": [{"id": "delta"}]})
    with pytest.raises(Exception, match="delta"):
        Z.read(spark, f"file://{two}")


def test_numbers(spark):
    df = spark.range(1000).selectExpr("id % 300 AS a", "cast(id AS string) AS b").repartition(7)
    got = [(x["a"], x["b"]) for x in numbered(df, ["a", "b"], "n").orderBy("n").collect()]
    assert got == sorted(got) and [x["n"] for x in numbered(df, ["a", "b"], "n").orderBy("n").collect()] == list(range(1000))
    assert numbered(df.limit(0), ["a"], "n").count() == 0


def test_places_without_a_spectrum_are_nan(spark, frame, tmp_path):
    """In a chunk that some spectra are in, and in one that isn't there."""
    path = f"file://{tmp_path}/store"
    Z.to_zarr(frame, path, ["time", "site"], {"time": 4, "site": 3})
    back = Z.read(spark, path)
    assert back.df.count() == 77
    assert back.df.where(F.exists(EFTH, lambda x: x.isNull())).isEmpty()
    assert back.df.where(~F.isnan(F.get(EFTH, F.lit(0)))).count() == frame.df.count()
