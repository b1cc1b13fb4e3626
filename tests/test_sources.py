"""Readers over small made-up files of each format, and round trips through the writers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.operators import stats as ST
from seastate.sources import models, multi, text, writers

G = Grid(tuple(0.04 * 1.15**k for k in range(18)), tuple(5.0 + 15 * k for k in range(24)))


def block(k: int) -> np.ndarray:
    d = np.abs(G.theta - (40 + 30 * k)) % 360
    return np.exp(-0.5 * ((G.f - 0.1 - 0.01 * k) / 0.02) ** 2)[:, None] * np.exp(-0.5 * (np.minimum(d, 360 - d) / 25) ** 2)[None, :] * (0.05 + 0.01 * k)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(dt.datetime(2021, 5, 1, 6 * k), "0", 170.5, -40.25, 8.0, 220.0, 55.0, block(k).ravel().tolist()) for k in range(3)]
    return SpectraFrame(spark.createDataFrame(rows, "time timestamp_ntz, site string, lon double, lat double, wspd double, wdir double, dpt double, efth array<double>"), G)


def table(f, names=("hs", "tp", "dpm")):
    return ST.stats(f, names).orderBy("time").toPandas()[list(names)].astype(float)


@pytest.mark.parametrize("name", ["swan", "octopus", "json"])
def test_round_trip(spark, frame, tmp_path, name):
    path = str(tmp_path / f"file.{name}")
    writers.WRITERS[name](frame, path)
    back = text.read(spark, path, name)
    np.testing.assert_allclose(table(back), table(frame), rtol=2e-3)
    assert {r["lon"] for r in back.df.collect()} == {170.5}


@pytest.mark.parametrize("name", ["funwave", "funwave_new"])
def test_funwave_round_trip(spark, frame, tmp_path, name):
    one = frame.with_df(frame.df.orderBy("time").limit(1))
    path = str(tmp_path / "file.txt")
    writers.WRITERS[name](one, path, clip=False)
    back = text.read(spark, path, name)
    a, b = (ST.stats(f, {"hs": {"tail": False}, "dm": {}}).first() for f in (one, back))
    assert b["hs"] == pytest.approx(a["hs"], rel=2e-2) and b["dm"] == pytest.approx(a["dm"], abs=1)
    writers.WRITERS[name](frame, str(tmp_path / "all"))
    assert (tmp_path / "all.zip").stat().st_size > 0


def test_swan_forms():
    head = "SWAN   1   x\n$ note\nTIME\n 1\nLONLAT\n 3\n 1 2\n 3 4\n 5 6\nAFREQ\n 2\n 0.1\n 0.2\nCDIR\n 2\n 0\n 90\nQUANT\n 1\nEnDens\nJ/m2/Hz/degr\n -99\n20200101.000000 x\n"
    grid, rows = text.parse_swan(head + "NODATA\nZERO\nFACTOR\n 2.0\n 1 2\n 3 4\n")
    assert grid.dir == (180.0, 270.0) and np.isnan(rows[0][EFTH]).all() and not rows[1][EFTH].any()
    np.testing.assert_allclose(rows[2][EFTH], np.array([[4, 2], [8, 6]]) / (1025 * 9.81))


def test_swan_files_together(spark, frame, tmp_path):
    for k, shift in enumerate((0, 6)):
        part = frame.with_df(frame.df.withColumn("time", F.col("time") + F.expr(f"INTERVAL '{shift}' HOUR")))
        writers.to_swan(part, str(tmp_path / f"run{k}.spec"))
    latest = multi.read_swanow(spark, f"{tmp_path}/*.spec")
    assert latest.df.count() == 4 and latest.df.where("file = 'run1.spec'").count() == 3
    cycles = multi.read_swans(spark, f"{tmp_path}/*.spec", ntimes=2)
    assert cycles.df.count() == 4 and cycles.grid.freq == multi.COMMON
    tiles = multi.read_hotswan(spark, f"{tmp_path}/*.spec")
    assert tiles.df.count() == 4


def test_swan_table(spark, frame, tmp_path):
    (tmp_path / "t.tab").write_text("%\n%       Time   hs  X-wsp  Y-wsp  dep\n%  [ ] [m] [m/s] [m/s] [m]\n20210501.000000  1.5  -3.0  -4.0  20.0\n")
    both = text.with_tab(frame.with_df(frame.df.drop("wspd", "wdir", "dpt")), text.read_tab(spark, f"{tmp_path}/t.tab"))
    r = both.df.where("wspd is not null").collect()
    assert len(r) == 1 and r[0]["wspd"] == 5.0 and r[0]["dpt"] == 20.0


def test_point_output(spark, tmp_path):
    rad = np.radians([0, 90, 180, 270])  # going to, clockwise from north
    body = "'MODEL SPECTRA'  2 4 1 'points'\n 0.1 0.2\n " + " ".join(f"{x:.5f}" for x in rad) + "\n20220912 060000\n'P1' 30.0 -70.0 100.0 7.0 200.0 0.1 90.0\n" + " ".join(str(x) for x in range(8)) + "\n"
    (tmp_path / "a.spec").write_text(body)
    f = text.read(spark, f"{tmp_path}/a.spec", "ww3_station")
    r = f.df.first()
    assert (r["site"], r["lat"], r["lon"], r["dpt"], r["wspd"], r["wdir"]) == ("P1", 30.0, -70.0, 100.0, 7.0, 200.0)
    np.testing.assert_allclose(np.cos(np.radians(np.array(f.grid.dir) - [180, 270, 0, 90])), 1, atol=1e-6)
    np.testing.assert_allclose(r[EFTH][:4], np.array([0, 2, 4, 6]) * np.pi / 180)


def test_triaxys():
    head = "REPORT\nTYPE = DIRECTIONAL SPECTRUM\nDATE    = 2018-01-31 21:00(UTC)\nNUMBER OF FREQUENCIES = 2\nINITIAL FREQUENCY (Hz) = 0.1\nFREQUENCY SPACING (Hz) = 0.1\nNUMBER OF DIRECTIONS = 3\nDIRECTION SPACING (DEG) = 120\n"
    grid, rows = text.parse_triaxys(head + " 1.0E+00 2.0E+00 3.0E+00\n 4.0E+00 5.0E+00 6.0E+00\n", toff=1, magnetic_variation=10)
    assert grid.dir == (10.0, 130.0, 250.0) and rows[0]["time"] == dt.datetime(2018, 1, 31, 20)
    assert rows[0][EFTH].tolist() == [[1, 2, 3], [4, 5, 6]]
    flat = head.replace("DIRECTIONAL", "NON-DIRECTIONAL") + "0.1 1.5E+00\n0.2 2.5E+00\n"
    assert text.parse_triaxys(flat)[1][0][EFTH].tolist() == [[1.5], [2.5]]


def test_ndbc(spark, tmp_path):
    real = "#YY  MM DD hh mm Sep_Freq  < spec_1 (freq_1) ... >\n2020 06 08 03 50 0.225 1.000 (0.100) 2.000 (0.200)\n2020 06 08 02 50 0.161 0.500 (0.100) 0.250 (0.200)\n"
    grid, rows = text.parse_ndbc(real)
    assert [r["sep_freq"] for r in rows] == [0.161, 0.225] and grid.freq == (0.1, 0.2)
    old = "YYYY MM DD hh .100 .200\n2000 01 01 00 .10 .20\n"
    assert text.parse_ndbc(old)[1][0]["time"] == dt.datetime(2000, 1, 1)
    paths = []
    for k, values in enumerate((("1.000", "2.000"), ("90.0", "80.0"), ("90.0", "999.0"), ("0.5", "0.4"), ("0.2", "0.1"))):
        head = "#YY MM DD hh mm Sep_Freq < x >" if k == 0 else "#YY MM DD hh mm x >"
        (tmp_path / str(k)).write_text(f"{head}\n2020 06 08 03 50 {'0.2 ' if k == 0 else ''}{values[0]} (0.100) {values[1]} (0.200)\n")
        paths.append(str(tmp_path / str(k)))
    f = text.read_ndbc_directional(spark, paths)
    assert ST.stats(f, ["hs"]).first()["hs"] == pytest.approx(4 * np.sqrt(0.3))


def test_buoys():
    spt = "\n".join(["1", "200", "5", "0.5", *["1"] * 8, "0.1,1.0,270,20", "0.2,0.5,280,30"])
    grid, rows = text.parse_datawell(spt, "buoy}2024-09-09T01h15Z.spt")
    assert rows[0]["hs"] == 2.0 and rows[0]["time"] == dt.datetime(2024, 9, 9, 1, 15)
    np.testing.assert_allclose(rows[0][EFTH].sum(axis=1) * grid.dd, [0.5, 0.25], rtol=1e-9)
    csv = "# Station name = A\n# Latitude [deg] = 1\n# Longitude [deg] = 2\n# Timestamp = 1712136600\n# Columns [deg] = 0,90,... 270\n# Rows [Hz] = 0.1,0.2,\n1,2,3,4,\n5,6,7,8,\n"
    grid, rows = text.parse_obscape(csv)
    assert grid.dir == (0.0, 90.0, 180.0, 270.0) and rows[0]["time"] == dt.datetime(2024, 4, 3, 9, 30)
    spot = "Epoch Time,f_0,f_1,varianceDensity_0,varianceDensity_1,direction_0,direction_1,directionalSpread_0,directionalSpread_1,Latitude,Longitude\n0,0.1,0.2,1,2,90,100,20,30,5,6\n"
    grid, rows = text.parse_spotter(spot)
    np.testing.assert_allclose(rows[0][EFTH].sum(axis=1) * grid.dd, [1, 2], rtol=1e-9)
    js = '{"data": {"frequencyData": [{"timestamp": "2020-01-01T00:00:00Z", "latitude": 1, "longitude": 2, "frequency": [0.1, 0.2], "varianceDensity": [1, 2], "direction": [90, 100], "directionalSpread": [20, 30]}]}}'
    np.testing.assert_allclose(text.parse_spotter(js)[1][0][EFTH], rows[0][EFTH])
    with pytest.raises(NotImplementedError):
        text.parse_spotter(spot + "1,0.1,0.3,1,2,90,100,20,30,5,6\n")


def test_awac():
    lines = [f"$PNORF,{k},010220,030405,3,0.1,0.1,2,{v},{v}" for k, v in (("A1", 0.6), ("B1", 0.0), ("A2", 0.3), ("B2", 0.0))]
    lines += ["$PNORE,010220,030405,3,0.1,0.1,3,1.0,2.0,9.0", "$PNORW,010220,030405,3,4,2.00,1,1*00", "$PNORF,A1,010220,040405,3,0.1,0.1,2,0,0"]
    grid, rows = text.parse_awac("\n".join(lines))
    assert len(rows) == 1 and rows[0]["time"] == dt.datetime(2020, 1, 2, 3, 4, 5)
    x = rows[0][EFTH]
    assert grid.theta[x.sum(axis=0).argmax()] == 0
    assert 4 * np.sqrt(np.trapezoid(x.sum(axis=1) * grid.dd, grid.f)) == pytest.approx(2.0)


def test_parquet_and_forms(spark, frame, tmp_path):
    models.write_parquet(frame, str(tmp_path / "native"))
    back = models.read_parquet(spark, str(tmp_path / "native"))
    assert back.grid == frame.grid and back.df.count() == frame.df.count()
    rows, coords = writers.ww3_form(frame)
    again = models.from_dataframe(rows, freq=coords["frequency"], dir=coords["direction"])
    np.testing.assert_allclose(table(again), table(frame), rtol=1e-9)
    assert writers.wave_trains(frame).count() > 0


def test_forms_by_name(spark):
    e5 = spark.createDataFrame([(0.0, 0.0, [float("nan")] * 3 + [-1.0])], "latitude double, longitude double, d2fd array<double>")
    frame = models.from_dataframe(e5, nf=2, nd=2)
    assert isinstance(frame, SpectraFrame) and frame.df.first()[EFTH][:3] == [0.0] * 3
    with pytest.raises(ValueError):
        models.from_dataframe(spark.range(1))
    nd = spark.createDataFrame([([1.0, 2.0], [90.0, 80.0], [90.0, 80.0], [0.5, 0.5], [0.2, 0.2])], "spectral_wave_density array<double>, mean_wave_dir array<double>, principal_wave_dir array<double>, wave_spectrum_r1 array<double>, wave_spectrum_r2 array<double>")
    frame = models.from_dataframe(nd, freq=[0.1, 0.2])
    assert ST.stats(frame, ["hs"]).first()["hs"] == pytest.approx(4 * np.sqrt(0.3), rel=1e-9)
    sw = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, [1.0, 1.0])], "longitude double, latitude double, xwnd double, ywnd double, density array<double>")
    assert models.from_dataframe(sw, freq=[0.1], dir=[0.0, np.pi]).df.first()["wspd"] == 5.0
    wm = spark.createDataFrame([([1.0, 1.0],)], "AC array<double>")
    assert models.from_dataframe(wm, spsig=[2 * np.pi], spdir=[0.0, np.pi]).df.first()[EFTH][0] == pytest.approx((2 * np.pi) ** 2 * np.pi / 180)


def test_netcdf_bytes():
    """A round trip by bytes, and a hand-made file with records, packed numbers and fill values."""
    import struct

    import numpy as np

    from seastate.sources import netcdf as N

    made = {"x": N.Variable(("a", "b"), np.arange(6.0).reshape(2, 3), {"units": "m", "two": 2.0}), "i": N.Variable(("a",), np.array([1, -2], "i4"), {}), "c": N.Variable(("a", "w"), np.array([[b"a", b"b"], [b"c", b""]], "S1"), {}), "s": N.Variable((), np.array(7.0), {})}
    got, attrs = N.parse(N.build(made, {"title": "odd"}))
    assert attrs == {"title": "odd"} and got["x"].attrs == {"units": "m", "two": 2.0}
    assert all((got[k].data == v.data).all() and got[k].dims == v.dims for k, v in made.items())
    text = lambda s: struct.pack(">I", len(s)) + s + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">I", 2) + struct.pack(">II", 10, 2) + text(b"time") + struct.pack(">I", 0) + text(b"k") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    fill = struct.pack(">II", 12, 2) + text(b"_FillValue") + struct.pack(">II", 3, 1) + struct.pack(">hxx", -9) + text(b"scale_factor") + struct.pack(">II", 6, 1) + struct.pack(">d", 0.5)
    variable = lambda begin: struct.pack(">II", 11, 1) + text(b"v") + struct.pack(">III", 2, 0, 1) + fill + struct.pack(">III", 3, 8, begin)
    raw = head + variable(len(head + variable(0))) + struct.pack(">hhh", 1, -9, 3) + struct.pack(">hhh", 4, 5, 6)
    v = N.parse(raw)[0]["v"].data
    assert np.array_equal(v, [[0.5, np.nan, 1.5], [2.0, 2.5, 3.0]], equal_nan=True)
    with pytest.raises(ValueError):
        N.parse(b"HDF5....")
    assert str(N.decoded_times(np.array([1.5]), "days since 1990-01-01 00:00:00")[0]).startswith("1990-01-02T12:00:00")


def test_columns_of_all_files(spark, tmp_path):
    """A column that only a later file has stays; another grid raises on demand."""
    import json

    def make(name, freq, more):
        coords = {"time": {"dims": ["time"], "data": ["2020-01-01T00:00:00"]}, "freq": {"dims": ["freq"], "data": freq}, "dir": {"dims": ["dir"], "data": [0.0, 180.0]}}
        variables = {"efth": {"dims": ["time", "freq", "dir"], "data": [[[1.0, 2.0]] * len(freq)]}} | {k: {"dims": ["time"], "data": [v]} for k, v in more.items()}
        (tmp_path / name).write_text(json.dumps({"coords": coords, "data_vars": variables, "attrs": {}, "dims": {}}))

    make("a.json", [0.1, 0.2, 0.3], {})
    make("b.json", [0.1, 0.2, 0.3], {"wspd": 5.0})
    got = {r["file"]: r["wspd"] for r in text.read(spark, f"{tmp_path}/*.json", "json").df.collect()}
    assert got == {"a.json": None, "b.json": 5.0}
    make("c.json", [0.1, 0.3], {})
    assert text.read(spark, f"{tmp_path}/*.json", "json").df.count() == 3
    with pytest.raises(Exception, match="another grid"):
        text.read(spark, f"{tmp_path}/*.json", "json", regrid=False).df.collect()
