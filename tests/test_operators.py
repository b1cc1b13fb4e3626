"""Operators on synthetic spectra: invariants, plain versions, and both sides of the driver's contract."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import EFTH, SpectraFrame
from seastate.functions import scalars as S
from seastate.grid import Grid, frequencies, wavenumber
from seastate.operators import construct as C
from seastate.operators import partition as P
from seastate.operators import select as SE
from seastate.operators import shape as SH
from seastate.operators import stats as ST
from seastate.operators import tracking as TR
from seastate.operators import watershed as W
from seastate.plans import registry

G = Grid(tuple(np.arange(0.04, 0.401, 0.01)), tuple(np.arange(0.0, 360, 10)))


def system(fp, dp, hs, g=G):
    d = np.abs(g.theta - dp) % 360
    x = np.exp(-0.5 * ((g.f - fp) / 0.02) ** 2)[:, None] * np.exp(-0.5 * (np.minimum(d, 360 - d) / 20) ** 2)[None, :]
    return x * (hs / 4) ** 2 / SH.block_m0(x[None], g)[0]


def noisy(seed=42):
    return (system(0.08, 270, 2.0) + system(0.20, 90, 1.5)) * np.random.default_rng(seed).uniform(0.5, 1.5, (G.nf, G.nd))


@pytest.fixture(scope="module")
def frame(spark):
    blocks = [noisy(k) for k in range(6)] + [np.zeros((G.nf, G.nd)), system(0.1, 5, 1.0)]
    rows = [(k, dt.datetime(2020, 1, 1, k), 8.0, 90.0, 50.0, x.ravel().tolist()) for k, x in enumerate(blocks)]
    return SpectraFrame(spark.createDataFrame(rows, "site long, time timestamp_ntz, wspd double, wdir double, dpt double, efth array<double>"), G)


def hs(f, **kw):
    return {r["site"]: r["hs"] for r in ST.stats(f, {"hs": kw}).collect()}


def test_statistics_by_numpy(frame):
    got = ST.stats(frame, ["hs", "tm01", "dm", "dspr", "dp", "tp", "goda", "uss", "mss"]).orderBy("site").toPandas()
    for k, x in enumerate([noisy(0), noisy(1)]):
        e = x.sum(axis=1) * G.dd
        m = lambda n: (e * G.df * G.f**n).sum()  # noqa: B023, E731
        assert got["hs"][k] == pytest.approx(4 * np.sqrt(m(0) + e[-1] * 0.25 * G.f[-1]))
        assert got["tm01"][k] == pytest.approx(m(0) / m(1))
        assert got["dp"][k] == G.theta[x.sum(axis=0).argmax()]
        phi = np.radians(270 - G.theta)
        s, c = (x * np.sin(phi)).sum() * G.dd, (x * np.cos(phi)).sum() * G.dd
        assert got["dm"][k] == pytest.approx((270 - np.degrees(np.arctan2(s, c))) % 360)
        assert got["mss"][k] == pytest.approx((wavenumber(G.f) ** 2 * e * G.df).sum())
    assert got["tp"][6] is None or np.isnan(got["tp"][6])  # a flat spectrum has no peak
    with pytest.raises(ValueError):
        ST.stats(frame, ["nothing"])
    with pytest.raises(ValueError):
        ST.stats(SH.oned(frame), ["dm"])


def test_shapes(frame):
    a = hs(frame)
    for f in (SH.rotate(frame, 33), SH.interp(frame, frequencies(0.04, 25, 1.1), np.arange(0, 360, 15.0)), SH.interp_like(frame, frame)):
        b = hs(f)
        assert all(b[k] == pytest.approx(a[k], rel=1e-9) for k in a if k != 6)
    assert hs(SH.scale_by_hs(frame, "2*hs"))[0] == pytest.approx(2 * a[0])
    assert hs(SH.scale_by_hs(frame, "2*hs", hs_min=100))[0] == pytest.approx(a[0])
    with pytest.raises(ValueError):
        SH.expression("__import__('os')", F.lit(1.0))
    with pytest.raises(ValueError):
        SH.split(frame, 0.2, 0.1)
    with pytest.raises(ValueError):
        SH.split(frame, 0.001)
    with pytest.raises(ValueError):
        SH.smooth(frame, 2, 3)
    part = SH.split(frame, 0.1, 0.2, 0, 90)
    assert min(part.grid.dir) == 0 and max(part.grid.dir) == 90 and part.grid.freq[0] == pytest.approx(0.1)
    turned = ST.stats(SH.rotate(frame, 30), ["dp"]).collect(), ST.stats(frame, ["dp"]).collect()
    assert (turned[0][7]["dp"] - turned[1][7]["dp"]) % 360 == 30
    long = frame.to_long()
    back = SpectraFrame.from_long(long.select("site", "ifreq", "idir", EFTH), G, ["site"])
    assert hs(back)[0] == pytest.approx(a[0])


def test_smooth_is_a_mean():
    x = np.random.default_rng(0).random((1, G.nf, G.nd))
    y = SH.smooth_block(x, G)
    i, j = 5, 0
    assert y[0, i, j] == pytest.approx(np.mean([x[0, i + a, (j + b) % G.nd] for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    assert y[0, 0, 3] == x[0, 0, 3]


def test_watershed():
    assert W.watershed(np.zeros((5, 5))).max() == 0
    with pytest.raises(ValueError):
        W.watershed(np.zeros(5))
    with pytest.raises(ValueError):
        W.watershed(np.ones((5, 5)), 1)
    two = system(0.08, 270, 2.0) + system(0.25, 90, 1.5)
    labels = W.watershed(two)
    assert labels.max() == 2 and (labels > 0).all()
    assert (W.watershed(np.asfortranarray(two)) == labels).all() and (W.watershed(two.astype(np.float32)) == labels).all()
    turned = W.watershed(np.roll(two, 7, axis=1))
    assert turned.max() == 2  # directions close the circle


def test_combine():
    parts = W.label_parts(noisy(), noisy(), 100)
    made = W.combine(parts, G, None)
    assert len(parts) > len(made) == 2
    assert sum(made).sum() == pytest.approx(sum(parts).sum(), rel=1e-9)
    for seed in range(3):
        mixed = [parts[k] for k in np.random.default_rng(seed).permutation(len(parts))]
        assert sorted(p.sum() for p in W.combine(mixed, G, None)) == pytest.approx(sorted(p.sum() for p in made), rel=1e-9)
    assert len(W.combine(parts, G, 1)) == 1


@pytest.mark.parametrize("name", ["ptm1", "ptm2", "ptm3", "hp01", "ptm4"])
def test_partitions_keep_energy(frame, name):
    kw = {"ptm1": {"swells": None}, "ptm2": {"swells": None}, "ptm3": {"parts": None}, "hp01": {"swells": None}, "ptm4": {}}[name]
    parts = P.METHODS[name](frame, **kw)
    got = ST.stats(parts, {"hs": {"tail": False}}).groupBy("site").agg(F.sqrt(F.sum(F.col("hs") * F.col("hs"))).alias("h")).collect()
    whole = hs(frame, tail=False)
    assert all(r["h"] == pytest.approx(whole[r["site"]], rel=1e-6) for r in got)
    if name in ("ptm1", "hp01"):
        fixed = P.METHODS[name](frame, swells=2)
        assert {r["n"] for r in fixed.df.groupBy("site").agg(F.count("*").alias("n")).collect()} == {3}


def test_boxes_and_cuts(frame):
    with pytest.raises(ValueError):
        P.bbox(frame, [{"fmax": 0.2}, {"fmin": 0.1}])
    with pytest.raises(ValueError):
        P.bbox(frame, [])
    two = P.ptm5(frame, 0.125)
    assert 0.125 in two.grid.freq
    assert P.count_parts(frame) >= 2


def test_tracking(frame, spark):
    one = frame.with_df(frame.df.where("site < 6").withColumn("place", F.lit(1)))
    got = TR.track(one, ["place"], "hp01", swells=2).orderBy("time", "part").toPandas()
    tracked = got.dropna(subset=["track_id"])
    assert len(tracked) and tracked["fp"].notna().all() and got["ntracks"].min() > 0
    systems = TR.track(one, ["place"], "hp01", swells=2, systems=True, min_duration=2)
    assert systems.count() <= len(tracked)
    with pytest.raises(ValueError):
        TR.track(one, ["place"], "ptm4")
    again = one.with_df(one.df.withColumn("time", F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz")))
    with pytest.raises(Exception, match="times must increase"):
        TR.track(again, ["place"], "ptm3").collect()
    assert TR.match(np.array([0.1]), np.array([350.0]), np.array([0.1005]), np.array([5.0]), np.array([0.01]), np.array([-0.01]), np.array([20.0])) == {0: 0}


def test_streamed_tracks_equal_batch(frame, spark, tmp_path):
    from seastate.streaming.tracking import track_stream

    stats = ST.stats(P.hp01(frame.with_df(frame.df.where("site < 6")), swells=2), ["fp", "dpm"]).select(F.lit("a").alias("site"), F.col("time").cast("timestamp").alias("time"), "part", "fp", "dpm", "wspd")
    stats.coalesce(1).orderBy("time").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(stats.schema).parquet(f"{tmp_path}/in")
    q = track_stream(stream, nsea=1).writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    a = spark.table("tracked").orderBy("time", "part").toPandas()["track_id"].tolist()
    b = TR.track_stats(stats, ["site"], nsea=1).orderBy("time", "part").toPandas()["track_id"].tolist()
    assert len(a) == len(b) and all(x == y or (x != x and y != y) or str(x) == str(y) for x, y in zip(a, b))


def test_construct_and_fit(spark):
    g = Grid(tuple(np.arange(0.03, 0.3, 0.005)), tuple(np.arange(0.0, 360, 15)))
    df = spark.createDataFrame([(2.0, 0.1, 3.3, 200.0, 25.0), (1.0, 0.08, 1.5, 10.0, 15.0)], "hs0 double, fp0 double, gamma0 double, dm0 double, spr double")
    made = C.construct_partition(df, g, "jonswap", "cartwright", {"fp": "fp0", "hs": "hs0", "gamma": "gamma0"}, {"dm": "dm0", "dspr": "spr"})
    for r in ST.stats(made, ["hs", "dm", "dspr", "fp"]).collect():
        assert r["hs"] == pytest.approx(r["hs0"], rel=1e-3) and r["fp"] == pytest.approx(r["fp0"], rel=0.02)
        assert min(abs(r["dm"] - r["dm0"]), 360 - abs(r["dm"] - r["dm0"])) < 0.5
    for r in C.fit_jonswap(made).df.collect():
        assert (r["hs"], r["fp"], r["gamma"]) == pytest.approx((r["hs0"], r["fp0"], r["gamma0"]), rel=1e-3)
    gauss = made.with_df(df.withColumn(EFTH, C.gaussian(g, F.col("hs0"), F.col("fp0"), 0.015)), Grid(g.freq))
    for r in C.fit_gaussian(gauss, 0.01).df.collect():
        assert (r["hs"], r["fp"], abs(r["gw"])) == pytest.approx((r["hs0"], r["fp0"], 0.015), rel=1e-3)
    with pytest.raises(ValueError):
        C.construct_partition(df, g, "nothing")
    whole = C.partition_and_reconstruct(made, ["hs0"], parts=2)
    assert all(r["hs"] == pytest.approx(r["hs0"], rel=0.1) for r in ST.stats(whole, ["hs"]).collect())


def test_selection(spark):
    g = Grid((0.1, 0.2), (0.0, 180.0))
    rows = [(k, float(x), float(y), [float(k)] * 4) for k, (x, y) in enumerate([(350, 0), (355, 0), (5, 0), (5, 5)])]
    f = SpectraFrame(spark.createDataFrame(rows, "site long, lon double, lat double, efth array<double>"), g)
    assert [r["site"] for r in SE.nearest(f, [-5.0], [0.2]).df.collect()] == [1]
    with pytest.raises(ValueError):
        SE.nearest(f, [100.0], [0.0])
    assert SE.nearest(f, [100.0], [0.0], missing="ignore").df.isEmpty()
    assert SE.sel(f, [355.0], [0.0], method="idw", times=[]).df.first()[EFTH] == [1.0] * 4  # an exact hit
    mid = SE.sel(f, [352.0], [0.0], method="idw", times=[], tolerance=4.0).df.first()[EFTH][0]
    assert mid == pytest.approx((0 / 2 + 1 / 3) / (1 / 2 + 1 / 3))
    assert np.isnan(SE.idw(f, [349.0], [0.0], [], tolerance=1.5).df.first()[EFTH][0])
    assert {r["site"] for r in SE.bbox(f, [-12.0, 6.0], [-1.0, 1.0]).df.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        SE.sel(f, [0.0], [0.0], method="other")


def test_sql_functions(spark):
    S.register(spark)
    r = spark.sql("SELECT sea_wavenumber(0.1D, 20D) AS k, sea_angle(350D, 10D) AS a, sea_nautical(300D) AS n").first()
    assert r["k"] == pytest.approx(float(wavenumber(0.1, 20.0))) and r["a"] == 20 and r["n"] == 330


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["stats_multi", "dm", "alpha", "split_freq", "rotate", "ptm4", "sel_idw", "combine_first"])
def test_oracles(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_shapes_are_computed_in_batches_and_once(spark):
    """Shapes of many rows come from numpy, a spectrum's sums read it once, and nulls, zeros and rounding are as in plain expressions."""
    g = Grid((0.05, 0.1, 0.2), (0.0, 90.0, 180.0, 270.0))
    df = spark.createDataFrame([(1, 0.1, 2.0, 30.0), (2, None, 2.0, 30.0), (3, 0.0, 2.0, 30.0), (4, 0.1, None, 30.0)], "k int, fp double, hs double, dm double")
    made = C.construct_partition(df, g, "jonswap", "cartwright", {"fp": "fp", "hs": "hs"}, {"dm": "dm", "dspr": 20.0})
    plan = ST.stats(made, ["hs"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "slice(transform" not in plan
    assert [x["hs"] for x in ST.stats(made, ["hs"]).orderBy("k").collect()] == [pytest.approx(2.0), 0.0, 0.0, 0.0]
    shapes = {x["k"]: x["e"] for x in df.select("k", C.jonswap(g, F.col("fp"), hs=F.col("hs")).alias("e")).collect()}
    assert shapes[2] == shapes[3] == shapes[4] == [None] * 3 and None not in shapes[1]
    x = spark.createDataFrame([(0.0000005,), (-0.0000015,), (1e300,), (float("nan"),), (None,), (-1e-9,)], "x double")
    assert str([r[0] for r in x.select(registry.near("x", 6)).collect()]) == "[1e-06, -2e-06, 1e+300, nan, None, 0.0]"
