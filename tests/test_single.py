"""One ordered file from many tasks: the same bytes as a writer that sees all rows."""

import datetime as dt
import gzip
import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import SpectraFrame
from seastate.grid import Grid
from seastate.sources import single, text, writers

G = Grid((0.05, 0.1, 0.2, 0.4), (0.0, 90.0, 180.0, 270.0))
R = np.random.default_rng(9)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(dt.datetime(2021, 5, 1) + dt.timedelta(hours=3 * k), f"s{s}", 10.5 + s, -4.25, 7.0 if k % 3 else None, 200.0, 30.0, R.uniform(0, 9, G.size).tolist()) for s in range(5) for k in range(30)]
    rows[7] = (*rows[7][:7], [float("nan")] * G.size)
    rows[8] = (*rows[8][:7], [0.0] * G.size)
    return SpectraFrame(spark.createDataFrame(rows, "time timestamp_ntz, site string, lon double, lat double, wspd double, wdir double, dpt double, efth array<double>").repartition(6), G)


@pytest.mark.parametrize("kind", ["swan", "octopus"])
@pytest.mark.parametrize("end", ["", ".gz"])
def test_same_bytes(spark, frame, tmp_path, kind, end):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        single.WRITERS[kind](frame, str(tmp_path / f"many{end}"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    writers.WRITERS[kind](frame, str(tmp_path / "one"))
    raw = (tmp_path / f"many{end}").read_bytes()
    assert (gzip.decompress(raw) if end else raw) == (tmp_path / "one").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(["many" + end, "one"])
    assert text.read(spark, str(tmp_path / f"many{end}"), kind).df.count() == 150


def test_json(spark, frame, tmp_path):
    one = frame.with_df(frame.df.where("site = 's2'"))
    single.to_json(one, str(tmp_path / "many"))
    writers.to_json(one, str(tmp_path / "one"))
    assert (tmp_path / "many").read_bytes() == (tmp_path / "one").read_bytes()
    none = frame.with_df(frame.df.limit(0))
    single.to_json(none, str(tmp_path / "none"))
    assert json.loads((tmp_path / "none").read_text()) == json.loads(writers.json_text([], G, "time", frame.others))


@pytest.mark.parametrize("anywhere", [True, False])
def test_parts_come_in_order(spark, tmp_path, anywhere):
    """Copied to their places by tasks, or appended by one, where files can only grow."""
    made = single.Assembly(spark, f"file://{tmp_path}/x", anywhere)
    rows = spark.range(1000).repartition(7).repartitionByRange(9, "id").sortWithinPartitions("id")
    made.literal("begin\n")
    made.add(*made.sections(rows, lambda: lambda r: ["".join(f"{x['id']}\n" for x in r)], 1))
    made.literal("end\n")
    made.finish()
    assert (tmp_path / "x").read_text() == "begin\n" + "".join(f"{k}\n" for k in range(1000)) + "end\n"


def test_what_is_no_swan_file(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="lacks a site"):
        single.to_swan(frame.with_df(frame.df.where("NOT (site = 's1' AND hour(time) = 3)")), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="lacks a site"):
        single.to_swan(frame.with_df(frame.df.union(frame.df)), str(tmp_path / "x"))
    still = frame.with_df(frame.df.where("time = timestamp_ntz'2021-05-01 00:00:00'").drop("time"))
    single.to_swan(still, str(tmp_path / "still"))
    writers.to_swan(still, str(tmp_path / "plain"))
    assert (tmp_path / "still").read_bytes() == (tmp_path / "plain").read_bytes()
    with pytest.raises(ValueError, match="times are needed"):
        single.to_octopus(still, str(tmp_path / "y"))
    assert not (tmp_path / "x").exists() and still.df.where(F.col("site").isNull()).count() == 0


def test_a_packed_file_is_read_record_by_record(spark, tmp_path):
    """3,000 records: neither planning nor a task's parser holds the file, and a file cut inside a block raises."""
    rows = [(dt.datetime(2021, 5, 1) + dt.timedelta(hours=k // 2), f"s{k % 2}", 10.5, -4.25, 7.0, 200.0, 30.0, R.uniform(0, 9, 240).tolist()) for k in range(3000)]
    g = Grid(tuple(0.05 * 1.1**k for k in range(20)), tuple(30.0 * k for k in range(12)))
    df = spark.createDataFrame(rows, "time timestamp_ntz, site string, lon double, lat double, wspd double, wdir double, dpt double, efth array<double>")
    path = str(tmp_path / "many.gz")
    single.to_octopus(SpectraFrame(df, g), path)
    size = len(gzip.decompress((tmp_path / "many.gz").read_bytes()))
    tracemalloc.start()
    try:
        found = text.read(spark, path, "octopus")
        planned = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert sum(len(some) for _, some in text.chunks("octopus", path, None, {})) == 3000
        parsed = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(planned, parsed) < size / 2
    assert {(r["site"], r["n"]) for r in found.df.groupBy("site").agg(F.count("*").alias("n")).collect()} == {("0", 1500), ("1", 1500)}
    short = gzip.decompress((tmp_path / "many.gz").read_bytes())[: size // 2]
    assert [len(some) for _, some in text.chunks("octopus", path, (tmp_path / "many.gz").read_bytes(), {})] == [500] * 6
    with pytest.raises(ValueError, match="inside a block"):
        list(text.chunks("octopus", path, short[: short.rindex(b"CCYYMM")], {}))
