"""NetCDF files in ranges: every layout against the whole file, what a range reads, kinds of models on files, and the record writer."""

import datetime as dt
import io
import math

import numpy as np
import pandas as pd
import pytest

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.operators import stats as ST
from seastate.sources import netcdf as N
from seastate.sources import plugins

R = np.random.default_rng(8)
FREQ, DIR = np.array([0.05, 0.1, 0.2]), np.array([0.0, 90.0, 180.0, 270.0])
TIME = {"units": "hours since 2000-01-01"}


def variable(dims, sizes, attrs=None, kind=float):
    return N.Variable(dims, R.uniform(0.1, 5, [sizes[d] for d in dims]).astype(kind), attrs or {})


def native(n=7, sites=5, dims=("time", "site", "freq", "dir")):
    sizes = {"time": n, "site": sites, "freq": 3, "dir": 4, "w": 2}
    made = {"time": N.Variable(("time",), np.arange(float(n)), TIME), "freq": N.Variable(("freq",), FREQ, {}), "dir": N.Variable(("dir",), DIR, {}), "lon": variable(("site",), sizes), "wspd": variable(("time", "site"), sizes), "turned": variable(("site", "time"), sizes)}
    made["site"] = N.Variable(("site", "w"), np.array([[b"s", str(k).encode()] for k in range(sites)], "S1"), {})
    return made | {"far": N.Variable(("far",), np.zeros(5000), {}), "efth": variable(dims, sizes, {"scale_factor": 2.0})}


def records(variables, lead="time"):
    """The same file with its first dimension as that of records."""
    sizes = {d: n for v in variables.values() for d, n in zip(v.dims, v.data.shape)}
    big = {k: v.data.astype(v.data.dtype.newbyteorder(">")) if v.data.dtype.kind != "S" else v.data for k, v in variables.items()}
    ordered = [k for k, v in variables.items() if lead not in v.dims[:1]] + [k for k, v in variables.items() if lead in v.dims[:1]]
    head, *_ = N.header({d: 0 if d == lead else n for d, n in sizes.items()}, sizes[lead], {}, [(k, variables[k].dims, variables[k].attrs, big[k].dtype) for k in ordered])
    pad = lambda x: x.tobytes() + b"\0" * (-x.nbytes % 4)
    along = [k for k in ordered if lead in variables[k].dims[:1]]
    return head + b"".join(pad(big[k]) for k in ordered if k not in along) + b"".join(pad(big[k][i : i + 1]) for i in range(sizes[lead]) for k in along)


class Counted(io.BytesIO):
    count = 0

    def read(self, n=-1):
        got = super().read(n)
        self.count += len(got)
        return got


@pytest.mark.parametrize("dims", [("time", "site", "freq", "dir"), ("time", "freq", "dir", "site"), ("time", "dir", "site", "freq"), ("freq", "time", "dir", "site")])
@pytest.mark.parametrize("growing", [False, True])
def test_ranges_make_the_whole(dims, growing):
    made = native(dims=dims)
    if growing and dims[0] != "time":
        pytest.skip("records are along the first dimension")
    made = {k: v for k, v in made.items() if k != "turned"} if growing else made
    raw = records(made) if growing else N.build(made)
    f = Counted(raw)
    found = N.read_layout(f)
    names = ["freq", "dir"]
    whole = N.read_rows(f, found, "efth", names)
    assert len(whole) == 35 and "far" not in whole and set(whole["site"]) == {f"s{k}" for k in range(5)}
    for most in (1, 100, 400, 1000, 3000, 1 << 20):
        parts = list(N.ranges(found.heads["efth"], N.described(found.heads, "efth", names), most))
        rows = []
        for part in parts:
            f.count = 0
            rows.append(N.read_rows(f, found, "efth", names, part))
            assert f.count < max(most, 12 * 8 * (1 if dims[:2] == ("time", "site") else 5 if dims[0] == "time" else 35)) + 900
        pd.testing.assert_frame_equal(pd.concat(rows).sort_values(["time", "site"]).reset_index(drop=True), whole.sort_values(["time", "site"]).reset_index(drop=True))
    assert len(list(N.ranges(found.heads["efth"], N.described(found.heads, "efth", names), 100))) == {("time", "site"): 35, ("time", "freq"): 7, ("time", "dir"): 7, ("freq", "time"): 1}[dims[:2]]


def test_header_is_read_in_steps_and_damage_is_told():
    raw = N.build({f"variable_{k}": N.Variable(("x",), np.arange(3.0), {"note": "n" * 50}) for k in range(900)})
    f = Counted(raw + b"\0" * 500_000)
    assert len(N.read_layout(f).heads) == 900 and f.count < 4 * 130_000
    for cut in (10, 40, 5000):
        with pytest.raises(ValueError, match="damaged"):
            N.read_layout(io.BytesIO(raw[:cut]))
    with pytest.raises(ValueError, match="classic"):
        N.read_layout(io.BytesIO(b"\x89HDF\r\n"))


def test_files_of_many_ranges(spark, tmp_path):
    """Columns of all files stay, tasks are as many as asked for, axes that differ raise."""
    one, two = native(), native(sites=2)
    del two["lon"]
    two["dpt"] = variable(("time",), {"time": 7})
    (tmp_path / "a.nc").write_bytes(records({k: v for k, v in one.items() if k != "turned"}))
    (tmp_path / "b.nc").write_bytes(N.build(two))
    back = N.read(spark, f"{tmp_path}/*.nc", tasks=9, range_bytes=200)
    assert back.df.rdd.getNumPartitions() == 9 and {"lon", "dpt", "turned", "wspd"} <= set(back.df.columns)
    got = {(x["site"], x["time"], x["lon"] is None): x[EFTH] for x in back.df.collect()}
    assert len(got) == 49
    for made, lacks in ((one, False), (two, True)):
        for i in range(7):
            for j in range(made["efth"].data.shape[1]):
                np.testing.assert_allclose(got[f"s{j}", dt.datetime(2000, 1, 1, i), lacks], made["efth"].data[i, j].ravel() * 2)
    plain = plugins.register(spark).read.format("seastate.netcdf").option("partitionBytes", 700).load(f"{tmp_path}/a.nc")
    assert plain.count() == 35 and plain.rdd.getNumPartitions() == 7
    few = spark.read.format("seastate.netcdf").schema("site string, efth array<double>").load(str(tmp_path))
    assert few.count() == 49 and few.columns == ["site", "efth"]
    two["freq"] = N.Variable(("freq",), FREQ + 0.01, {})
    (tmp_path / "c.nc").write_bytes(N.build(two))
    with pytest.raises(ValueError, match="different"):
        N.read(spark, f"{tmp_path}/*.nc")
    with pytest.raises(FileNotFoundError):
        N.read(spark, f"{tmp_path}/none/*.nc")


def test_kinds_of_models_on_files(spark, tmp_path):
    """Their own names, units and orders of dimensions, from bytes to canonical rows."""
    e = R.uniform(0.1, 2, (2, 3, 3, 4))  # time, site, freq, dir
    t = {"units": "days since 1990-01-01"}
    put = lambda name, made: (tmp_path / name).write_bytes(N.build(made))
    axis = lambda name, x, a=None: {name: N.Variable((name,), np.asarray(x, float), a or {})}
    put("ncswan.nc", axis("time", [1, 2], t) | axis("frequency", FREQ) | axis("direction", np.radians(DIR)) | {"density": N.Variable(("time", "points", "frequency", "direction"), e * 180 / math.pi, {}), "longitude": N.Variable(("points",), np.arange(3.0), {}), "latitude": N.Variable(("points",), np.arange(3.0), {}), "xwnd": N.Variable(("time", "points"), np.full((2, 3), 3.0), {}), "ywnd": N.Variable(("time", "points"), np.full((2, 3), 4.0), {})})
    got = N.read(spark, f"{tmp_path}/ncswan.nc", "ncswan", range_bytes=100).df.orderBy("time", "lon").collect()
    np.testing.assert_allclose([x[EFTH] for x in got], e.reshape(6, -1))
    assert {x["wspd"] for x in got} == {5.0}
    sigma = 2 * math.pi * FREQ
    put("wwm.nc", axis("ocean_time", [1, 2], t) | {"spsig": N.Variable(("nfreq",), sigma, {}), "spdir": N.Variable(("ndir",), np.radians(DIR), {}), "lon": N.Variable(("nbstation",), np.arange(3.0), {}), "lat": N.Variable(("nbstation",), np.arange(3.0), {}), "AC": N.Variable(("ocean_time", "nbstation", "nfreq", "ndir"), e / (sigma * 2 * math.pi * math.pi / 180)[:, None], {})})
    got = N.read(spark, f"{tmp_path}/wwm.nc", "wwm", range_bytes=100)
    np.testing.assert_allclose([x[EFTH] for x in got.df.orderBy("time", "lon").collect()], e.reshape(6, -1))
    np.testing.assert_allclose(got.grid.f, FREQ)
    put("era5.nc", axis("time", [1, 2], t) | axis("frequency", [1, 2, 3]) | axis("direction", [1, 2, 3, 4]) | axis("latitude", [5, 6, 7]) | axis("longitude", [9]) | {"d2fd": N.Variable(("time", "direction", "frequency", "latitude", "longitude"), np.log10(e * 180 / math.pi).transpose(0, 3, 2, 1)[..., None], {"missing_value": 99.0})})
    got = N.read(spark, f"{tmp_path}/era5.nc", "era5", range_bytes=100).df.orderBy("time", "lat").collect()
    np.testing.assert_allclose([x[EFTH] for x in got], e.reshape(6, -1))
    one = lambda x: N.Variable(("time", "frequency", "latitude", "longitude"), x[..., None, None], {})
    density, turn = R.uniform(0.1, 2, (2, 3)), R.uniform(0, 360, (2, 3))
    put("ndbc.nc", axis("time", [1, 2], t) | axis("frequency", FREQ) | axis("latitude", [5]) | axis("longitude", [9]) | {"spectral_wave_density": one(density), "mean_wave_dir": one(turn), "principal_wave_dir": one(turn), "wave_spectrum_r1": one(np.full((2, 3), 0.4)), "wave_spectrum_r2": one(np.full((2, 3), 0.1))})
    got = N.read(spark, f"{tmp_path}/ndbc.nc", "ndbc", range_bytes=10)
    np.testing.assert_allclose([np.reshape(x[EFTH], (3, -1)).sum(axis=1) * 10 for x in got.df.orderBy("time").collect()], density, rtol=1e-9)


def placed(spark, nan=True):
    g = Grid(tuple(FREQ), tuple(DIR))
    rows = [(dt.datetime(2001, 2, 3, k, 5), f"buoy {s}é", 10.0 + s, -3.5, 7.0 if k % 2 else None, R.uniform(0, 9, g.size).tolist()) for s in range(4) for k in range(12)]
    rows[2] = (*rows[2][:5], [math.nan] * g.size if nan else rows[2][5])
    return SpectraFrame(spark.createDataFrame(rows, "time timestamp_ntz, site string, lon double, lat double, wspd double, efth array<double>").repartition(5), g)


@pytest.mark.parametrize("kind", ["native", "ww3"])
def test_record_writer(spark, tmp_path, kind):
    frame, folder = placed(spark), f"file://{tmp_path}/out"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    N.to_netcdf(frame, folder, ["site"], kind)
    files = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert len([x for x in files if not x.startswith(".")]) == 4 and len(files) == 4
    back = N.read(spark, f"{folder}/*.nc", kind, range_bytes=60)
    rows = lambda f: sorted((x["site"], x["time"], x["lon"], x["wspd"], x[EFTH]) for x in f.df.select("site", "time", "lon", "wspd", EFTH).collect())
    unit = 1e-5 * (math.pi / 180 if kind == "ww3" else 1)
    for a, b in zip(rows(frame), rows(back), strict=True):
        assert a[:3] == b[:3] and (a[3] == b[3] or (a[3] is None and math.isnan(b[3])))
        np.testing.assert_allclose(a[4], np.array(b[4], float), atol=0.51 * unit)
    np.testing.assert_allclose(back.grid.theta, DIR)
    found = N.read_layout(io.BytesIO((tmp_path / "out" / files[0]).read_bytes()))
    assert found.heads["efth"].record and found.heads["efth"].kind == ">i4" and found.heads["efth"].attrs["_FillValue"] == N.FILL
    if kind == "ww3":
        assert found.heads["station_name"].dims == ("station", "string") and found.attrs["start_date"].startswith("2001-02-03") and found.heads["longitude"].dims == ("time", "station")
    exact = f"file://{tmp_path}/exact"
    N.to_netcdf(frame, exact, ["site"], kind, packed=False)
    assert all(np.allclose(a[4], np.array(b[4], float), rtol=1e-14, equal_nan=True) for a, b in zip(rows(frame), rows(N.read(spark, exact, kind))))


def test_what_the_writer_does_not_take(spark, tmp_path):
    frame = placed(spark, nan=False)
    large = frame.with_df(frame.df.selectExpr("time", "site", "transform(efth, x -> x * 1e5) AS efth"))
    with pytest.raises(Exception, match="too large"):
        N.to_netcdf(large, f"file://{tmp_path}/x", ["site"])
    assert not [x for x in (tmp_path / "x").iterdir() if not x.name.startswith(".")]
    still = frame.with_df(frame.df.where("minute(time) = 5 AND hour(time) = 3").drop("time"))
    N.to_netcdf(still, f"file://{tmp_path}/still", ["site"])
    assert ST.stats(N.read(spark, f"file://{tmp_path}/still"), ["hs"]).count() == 4


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges are as small as asked for, and tasks follow the bytes and the cores."""
    (tmp_path / "a.nc").write_bytes(records({k: v for k, v in native().items() if k != "turned"}))
    back = N.read(spark, f"{tmp_path}/a.nc", range_bytes=1)
    assert back.df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and back.df.count() == 35
