"""The formats as registered data sources: ranges, filters, commits and streams."""

import datetime as dt
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.sources import files, plugins, text, writers

G = Grid((0.05, 0.1, 0.2, 0.31), (0.0, 90.0, 180.0, 270.0, 300.0))


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(4)
    rows = [(dt.datetime(2021, 5, 1 + k, 6), f"s{s}", 10.5 + s, -4.25, r.uniform(0, 9, G.size).round(3).tolist()) for s in range(6) for k in range(20)]
    rows[3] = (*rows[3][:4], [float("nan")] * G.size)
    rows[5] = (*rows[5][:4], [0.0] * G.size)
    return SpectraFrame(plugins.register(spark).createDataFrame(rows, "time timestamp_ntz, site string, lon double, lat double, efth array<double>").repartition(3), G)


@pytest.fixture(scope="module")
def folder(frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("swan") / "out")
    plugins.save(frame, path, ["site"])
    return path


def rows(df):
    return sorted((x["lon"], x["time"], np.round(np.array(x[EFTH], float), 2).tolist()) for x in df.select("lon", "time", EFTH).collect())


def same(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], atol=2e-2)


def test_write_and_read_in_ranges(spark, frame, folder):
    assert sorted(json.load(open(f"{folder}/_SUCCESS"))) == [f"site=s{k}.spec" for k in range(6)] == sorted(x for x in os.listdir(folder) if x[0] not in "._")
    whole = plugins.load(spark, "swan", folder)
    assert whole.grid == G
    want = rows(whole.df)
    same(want, rows(frame.df))
    for size in (150, 700, 1111, 5000):
        part = plugins.load(spark, "swan", f"file://{folder}/*.spec", partitionBytes=size)
        assert part.df.rdd.getNumPartitions() > 6 or size == 5000
        assert repr(rows(part.df)) == repr(want)
    assert repr(rows(text.read(spark, folder + "/*.spec", "swan").df)) == repr(want)


def test_packed_files_and_those_without_times(spark, frame, folder, tmp_path):
    for name in os.listdir(folder):
        if name.endswith(".spec"):
            (tmp_path / f"{name}.gz").write_bytes(gzip.compress(open(f"{folder}/{name}", "rb").read()))
    assert repr(rows(plugins.load(spark, "swan", str(tmp_path), partitionBytes=300).df)) == repr(rows(plugins.load(spark, "swan", folder).df))
    one = frame.with_df(frame.df.where("time = timestamp_ntz'2021-05-09 06:00:00'").drop("time"))
    plugins.save(one, str(tmp_path / "still"), ["site"], compression="gzip")
    back = plugins.load(spark, "swan", str(tmp_path / "still"), partitionBytes=50).df
    assert back.count() == 6 and back.where("time is not null").count() == 0


def test_filters_reach_the_source(spark, folder):
    df = spark.read.format("seastate.swan").load(folder)
    picked = df.where("time > timestamp_ntz'2021-05-10 00:00:00' AND lon IN (11.5, 12.5) AND file <> 'x' AND file >= 'site=s2' AND wspd IS NULL")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "lon#" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(lon#", "")
    assert {(x["lon"], x["time"].day) for x in picked.collect()} == {(12.5, d) for d in range(10, 21)}
    assert df.where("file = 'none'").count() == 0
    narrow = spark.read.format("seastate.swan").schema("lat double, time timestamp_ntz").load(folder)
    assert narrow.count() == 120 and narrow.columns == ["lat", "time"]


def test_commit_is_whole_or_nothing(spark, frame, folder, tmp_path):
    path = str(tmp_path / "out")
    apart = frame.df.repartitionByRange(5, "time").sortWithinPartitions("site", "time")
    write = lambda df, mode="append": df.write.format("seastate.swan").options(by="site", **plugins.grid_options(G)).mode(mode).save(path)
    with pytest.raises(Exception, match="two tasks"):
        write(apart)
    with pytest.raises(Exception, match="come together|times that rise"):
        write(frame.df.coalesce(1).orderBy("time", "site"))
    assert not os.path.exists(path) or not [x for x in os.listdir(path) if not x.startswith(".")]
    plugins.save(frame, path, ["site"])
    some = frame.with_df(frame.df.where("site = 's1'"))
    with pytest.raises(Exception, match="is there"):
        plugins.save(some, path, ["site"], mode="append")
    assert plugins.load(spark, "swan", path).df.count() == 120
    plugins.save(some, path, ["site"])
    assert plugins.load(spark, "swan", path).df.count() == 20 and json.load(open(f"{path}/_SUCCESS")) == ["site=s1.spec"]


def test_other_formats_and_grids(spark, frame, tmp_path):
    one = frame.with_df(frame.df.where("site = 's2'").withColumns({"wspd": F.lit(3.0), "wdir": F.lit(4.0), "dpt": F.lit(5.0)}))
    writers.to_octopus(one, str(tmp_path / "a.oct"))
    writers.to_json(one, str(tmp_path / "a.json"))
    assert plugins.load(spark, "octopus", str(tmp_path / "a.oct")).df.count() == 20
    assert plugins.load(spark, "json", [str(tmp_path / "a.json")]).df.where("wspd = 3").count() == 20
    coarse = Grid((0.05, 0.2), (0.0, 180.0))
    plugins.save(one, str(tmp_path / "swan"), ["site"])
    other = plugins.load(spark, "swan", str(tmp_path / "swan"), coarse)
    assert other.grid == coarse and {len(x[EFTH]) for x in other.df.collect()} == {4}
    with pytest.raises(Exception, match="nothing"):
        plugins.load(spark, "swan", str(tmp_path / "nothing")).df.count()


def test_stream_takes_each_file_once(spark, frame, folder, tmp_path):
    """Files of three arrivals, the last ones older than the first by their times, through a query that ends and starts again."""
    into = tmp_path / "in"
    into.mkdir()
    names = sorted(x for x in os.listdir(folder) if x.endswith(".spec"))

    def run():
        source = spark.readStream.format("seastate.swan").options(path=str(into), log=str(tmp_path / "log"), maxFilesPerTrigger=2).load()
        query = source.select("lon", "time", EFTH).writeStream.format("parquet").option("path", str(tmp_path / "to")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    for k, lot in enumerate((names[:3], names[3:4], names[4:])):
        for name in lot:
            (into / name).write_bytes(open(f"{folder}/{name}", "rb").read())
            os.utime(into / name, (1e9 - k, 1e9 - k))
        run()
    run()
    assert repr(rows(spark.read.parquet(str(tmp_path / "to")))) == repr(rows(plugins.load(spark, "swan", folder).df))
    assert len(os.listdir(tmp_path / "log")) == 4


def test_globs(tmp_path):
    for name in ("a/x1.spec", "a/x2.spec", "a/b/x3.spec", "a/_t/x4.spec", "a/.x5.spec"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda glob: [os.path.basename(f.path) for f in files.found(glob)]
    assert names(f"{tmp_path}/a") == ["x3.spec", "x1.spec", "x2.spec"] and names(f"{tmp_path}/a/*.spec") == ["x1.spec", "x2.spec"]
    assert names(f"file://{tmp_path}/a/{{b/x3,x1}}.spec") == ["x3.spec", "x1.spec"] and names([f"{tmp_path}/a/x?.spec", f"{tmp_path}/none/*"]) == ["x1.spec", "x2.spec"]
