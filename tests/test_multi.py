"""Files that belong together: cycles with tables, and tiles."""

import datetime as dt
import gzip
import itertools

import numpy as np
import pytest

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.sources import multi, text, writers

G = Grid((0.05, 0.1, 0.2), (0.0, 90.0, 180.0, 270.0))
R = np.random.default_rng(6)
T0 = dt.datetime(2022, 1, 1)


def swan(path, points, times, grid=G, value=None):
    out = writers.swan_header(grid, points, True)
    for t in times:
        out += f"{t:%Y%m%d.%H%M%S}   date and time\n"
        for k in range(len(points)):
            out += writers.swan_block(R.uniform(1, 9, (grid.nf, grid.nd)) if value is None else value(t, k))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(out.encode()) if path.suffix == ".gz" else out.encode())


def table(path, times, columns=("X-wsp", "Y-wsp", "dep")):
    rows = [f"{t:%Y%m%d.%H%M%S} " + " ".join(str(v) for v in (-3.0, -4.0, 20.0 + k)[: len(columns)]) for k, t in enumerate(times)]
    path.write_text("\n".join(["%", "%       Time " + " ".join(columns), "%  [ ] [m/s]", *rows]) + "\n")


def hours(n, begin=0):
    return [T0 + dt.timedelta(hours=begin + k) for k in range(n)]


def test_cycles_sites_and_limits(spark, tmp_path):
    for cycle in (0, 12):
        for k, name in enumerate(("north", "south")):
            swan(tmp_path / f"c{cycle}" / f"{name}.spec{'.gz' if k else ''}", [(k, 2.0)], hours(24, cycle))
            table(tmp_path / f"c{cycle}" / f"{name}.tab", hours(24, cycle))
    glob = f"{tmp_path}/c*/*.spec*"
    whole = multi.read_swans(spark, glob, int_freq=False)
    assert whole.grid == G and whole.df.count() == 96 and {r["wspd"] for r in whole.df.collect()} == {5.0}
    some = multi.read_swans(spark, glob, ndays=0.25).df.collect()
    assert len(some) == 4 * 7 and {(r["site"], r["cycle"]) for r in some} == set(itertools.product(("north", "south"), (T0, T0 + dt.timedelta(hours=12))))
    assert {r["dpt"] - 20 == (r["time"] - r["cycle"]).seconds / 3600 for r in some} == {True}
    assert multi.read_swans(spark, glob, ndays=0.25, ntimes=3).df.count() == 12 and multi.read_swans(spark, glob, ntimes=99).df.count() == 96
    with pytest.raises(Exception, match="span 3 days"):
        multi.read_swans(spark, glob, ndays=3).df.count()
    many = multi.read_swans(spark, glob, int_freq=[0.05, 0.15], int_dir=True)
    assert many.grid.nf == 2 and many.grid.nd == 36 and {len(r[EFTH]) for r in many.df.collect()} == {72}


def test_what_does_not_go_together(spark, tmp_path):
    swan(tmp_path / "a" / "x.spec", [(1, 2), (3, 4)], hours(3))
    swan(tmp_path / "b" / "x.spec", [(1, 2), (3, 4)], hours(3, 6))
    assert {r["site"] for r in multi.read_swans(spark, f"{tmp_path}/*/x.spec").df.collect()} == {"1", "2"}
    swan(tmp_path / "c" / "x.spec", [(1, 2), (3, 5)], hours(3, 12))
    with pytest.raises(OSError, match="different sites"):
        multi.read_swans(spark, f"{tmp_path}/*/x.spec")
    for name in ("p", "q"):
        swan(tmp_path / "d" / f"{name}.spec", [(1, 2)], hours(3))
    table(tmp_path / "d" / "p.tab", hours(3))
    with pytest.raises(OSError, match="tables"):
        multi.read_swans(spark, f"{tmp_path}/d/*.spec")
    table(tmp_path / "d" / "q.tab", hours(3), ("X-wsp", "Y-wsp"))
    with pytest.raises(OSError, match="tables"):
        multi.read_swans(spark, f"{tmp_path}/d/*.spec")
    table(tmp_path / "d" / "q.tab", hours(3, 99))
    with pytest.raises(OSError, match="tables"):
        multi.read_swans(spark, f"{tmp_path}/d/*.spec")
    table(tmp_path / "d" / "q.tab", hours(2))
    with pytest.raises(Exception, match="lacks"):
        multi.read_swans(spark, f"{tmp_path}/d/*.spec").df.count()
    with pytest.raises(FileNotFoundError):
        multi.read_swans(spark, f"{tmp_path}/none/*.spec")


def test_reading_stops_at_the_limit(spark, tmp_path):
    """What stands behind the last record that is wanted may be anything."""
    swan(tmp_path / "x.spec", [(1, 2)], hours(5))
    with open(tmp_path / "x.spec", "a") as f:
        f.write("20220101.060000 date\nFACTOR\nno number\n")
    assert multi.read_swans(spark, str(tmp_path / "x.spec"), ntimes=5, int_freq=False).df.count() == 5
    with pytest.raises(Exception):
        multi.read_swans(spark, str(tmp_path / "x.spec"), int_freq=False).df.count()


def merged(tiles):
    """Slice by slice, in the order of the files: tiles are {(lon, lat): spectrum}."""
    done = [dict(tiles[0])]
    for tile in map(dict, tiles[1:]):
        last = done[-1]
        both = [{p[d] for p in last} & {p[d] for p in tile} for d in (0, 1)]
        d = 0 if len(both[0]) <= len(both[1]) else 1
        for v in both[d]:
            own, other = ([p for p in t if p[d] == v] for t in (last, tile))
            total = lambda t, ps: sum(np.nansum(t[p]) for p in ps)
            if total(last, own) > total(tile, other):
                tile |= {p: last[p] for p in own if p in tile}
            else:
                last |= {p: tile[p] for p in other if p in last}
        done.append(tile)
    return {p: x for t in done for p, x in t.items()}


@pytest.mark.parametrize("along", [0, 1])
def test_tiles_by_slices(spark, tmp_path, along):
    """Strips with one and two common rows or columns, of which each tile has computed some, against the walk over files."""
    spans, tiles = [(0, 5), (4, 9), (8, 13), (12, 15)], []
    for k, (lo, hi) in enumerate(spans):
        tile = {}
        for a, b in itertools.product(range(lo, hi + 1), range(7)):
            weak = (a <= lo + 1 and k and (a + k) % 2) or (a >= hi - 1 and (a + k + 1) % 2)
            tile[(a, b) if along == 0 else (b, a)] = R.uniform(0, 9, G.size) * (0.3 if weak and b != 3 else 1.0)
        tile[next(iter(tile))][2] = np.nan
        tiles.append(tile)
    rows = [(T0, f"hot{k}", float(p[0]), float(p[1]), x.tolist()) for k, t in enumerate(tiles) for p, x in t.items()]
    frame = SpectraFrame(spark.createDataFrame(rows, "time timestamp_ntz, file string, lon double, lat double, efth array<double>").repartition(3), G)
    got = {(r["lon"], r["lat"]): r[EFTH] for r in multi.merge_tiles(frame).df.collect()}
    want = merged(tiles)
    assert set(got) == set(want) and multi.merge_tiles(frame).df.count() == len(want)
    for p, x in want.items():
        np.testing.assert_allclose(np.array(got[p], float), x)
    plain = {p: max((t[p] for t in tiles if p in t), key=np.nansum) for p in want}
    assert any(np.nansum(plain[p]) != np.nansum(want[p]) for p in want)


def test_tiles_from_files(spark, tmp_path):
    for k, (lo, hi) in enumerate(((0, 3), (3, 6))):
        points = [(x, y) for y in range(3) for x in range(lo, hi + 1)]
        swan(tmp_path / f"hot-{k:03}", points, [T0], value=lambda t, i, k=k, points=points: np.full((3, 4), 0.0 if (points[i][0] == 3) == (k == 1) and points[i][0] == 3 else 1.0 + k))
    back = multi.read_hotswan(spark, f"{tmp_path}/hot-*")
    at = {(r["lon"], r["lat"]): r["file"] for r in back.df.collect()}
    assert len(at) == 21 and all(f == ("hot-000" if x <= 3 else "hot-001") for (x, _), f in at.items())
    assert text.is_grid(list(at))
