"""Tracks over blocks of steps against one walk through each site, and wave systems against a plain count."""

import collections
import datetime as dt
import math

import numpy as np
import pytest

from seastate.operators import tracking as TR

R = np.random.default_rng(12)


def parts(site, times, kinds=3):
    """Parts that drift, vanish and come back."""
    fp, dpm = 0.08 + 0.03 * np.arange(kinds), np.linspace(0, 300, kinds)
    for t in times:
        fp, dpm = fp + R.normal(0, 0.0007, kinds), (dpm + R.normal(0, 5, kinds)) % 360
        for p in range(kinds):
            empty = R.random() < 0.1
            yield site, t, p, None if empty else float(fp[p]), None if empty else float(dpm[p]), 9.0, "x"


def walked(rows, **kw):
    """(site, time, part) -> (track, tracks of the site)."""
    out = {}
    for site in {r[0] for r in rows}:
        linker, own = TR.Linker(**kw), collections.defaultdict(list)
        for r in rows:
            if r[0] == site:
                own[r[1]].append(r)
        ids = {}
        for t in sorted(own):
            step = sorted(own[t], key=lambda r: r[2])
            value = lambda k: np.array([math.nan if r[k] is None else r[k] for r in step])  # noqa: E731, B023
            for r, x in zip(step, linker.step(float(t), value(3), value(4), step[0][5])):
                ids[site, t, r[2]] = None if x < 0 else int(x)
        out |= {k: (x, linker.last[-1]) for k, x in ids.items()}
    return out


KIND = "site string, time long, part int, fp double, dpm double, wspd double, last string"


@pytest.mark.parametrize("blocks", [1, 4, 23])
def test_blocks_give_what_a_walk_gives(spark, blocks):
    """A site of most rows, some of a few steps, some of one; a null site; tracks that pass many blocks."""
    rows = [*parts("long", range(0, 3600 * 240, 3600)), *parts(None, range(0, 36000, 3600), 2)]
    for k in range(12):
        rows += parts(f"s{k:02}", range(7, 7 + 1800 * (1 + 2 * (k % 4)), 1800), 1 + k % 3)
    rows += parts("tail", range(0, 3600 * 60, 3600), 2)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {(x["site"], x["time"], x["part"]): (x["track_id"], x["ntracks"]) for x in TR.track_stats(df, ["site"], nsea=1, blocks=blocks).collect()}
    want = walked(rows, nsea=1)
    assert got == want and max(n for _, n in want.values()) > 20
    assert len({k for k in want if k[0] == "long"}) == 720


def test_no_keys_is_one_site(spark):
    rows = list(parts("a", range(0, 3600 * 50, 3600)))
    df = spark.createDataFrame(rows, KIND)
    got = TR.track_stats(df.drop("site"), [], blocks=6, nsea=0).collect()
    want = walked(rows, nsea=0)
    assert {("a", x["time"], x["part"]): (x["track_id"], x["ntracks"]) for x in got} == want and "last" in got[0]
    assert TR.track_stats(df.limit(0), ["site"]).count() == 0
    with pytest.raises(Exception, match="times must increase"):
        TR.track_stats(df.union(df), ["site"]).collect()


def test_two_keys_and_timestamps(spark):
    rows = [(a, b, dt.datetime(2020, 1, 1, t), p, fp, d, w) for a in (1.5, None) for b in ("x", "y") for _, t, p, fp, d, w, _ in parts("q", range(9), 2)]
    df = spark.createDataFrame(rows, "lon double, name string, time timestamp_ntz, part int, fp double, dpm double, wspd double")
    one, many = ({tuple(x)[:4]: tuple(x)[-2:] for x in TR.track_stats(df, ["lon", "name"], blocks=n).collect()} for n in (1, 9))
    assert one == many and len(one) == 72


@pytest.mark.parametrize("keys", [["site"], []])
def test_wave_systems(spark, keys):
    rows = [*parts("long", range(0, 3600 * 60, 3600)), *(list(parts(None, range(0, 36000, 3600))) + list(parts("s", range(0, 36000, 3600))) if keys else [])]
    tracks = TR.track_stats(spark.createDataFrame(rows, KIND), keys, blocks=5)
    known = tracks.collect()
    steps = collections.defaultdict(set)
    for x in known:
        if x["track_id"] is not None:
            steps[x["site"], x["track_id"]].add(x["time"])
    number = {}
    for site in {s for s, _ in steps}:
        long = sorted(t for (s, t), n in steps.items() if s == site and len(n) >= 4)
        number |= {(site, t): k for k, t in enumerate(long)}
    got = {(x["site"], x["time"], x["part"]): x["wave_system"] for x in TR.wave_systems(tracks, keys, min_duration=4).collect()}
    assert got == {(x["site"], x["time"], x["part"]): number[x["site"], x["track_id"]] for x in known if (x["site"], x["track_id"]) in number}
    assert 0 < len(number) < len(steps)


def test_links_of_all_steps_are_those_of_one_after_the_other():
    """Parts that compete, lack a peak or begin a site, against a Linker for each site."""
    r = np.random.default_rng(3)
    sizes, sites = r.integers(1, 5, 400), np.sort(r.integers(0, 12, 400))
    begins = np.cumsum(sizes) - sizes
    n, times = sizes.sum(), np.cumsum(r.integers(600, 9000, 400)).astype(float)
    fp, dpm, wspd = r.choice(np.linspace(0.08, 0.1, 15), n), r.uniform(0, 60, n), np.repeat(r.choice([0.0, 5.0, 12.0], 400), sizes)
    fp[r.random(n) < 0.1] = np.nan
    sites = np.unique(sites, return_inverse=True)[1]
    for kw in ({}, {"nsea": 2, "ddpm_sea_max": 50.0}, {"nsea": 0, "ddpm_swell_max": 90.0}):
        want, births = [], {}
        for s in range(sites[-1] + 1):
            linker = TR.Linker(**kw)
            for k in np.flatnonzero(sites == s):
                own = slice(begins[k], begins[k] + sizes[k])
                want += linker.step(times[k], fp[own], dpm[own], float(wspd[begins[k]])).tolist()
            births[s] = linker.last[-1]
        site = np.repeat(sites, sizes)
        got, many = TR.follow(begins, site, np.diff(times, prepend=0.0), fp, dpm, wspd, **kw)
        assert got.tolist() == want and many.tolist() == [births[s] for s in site.tolist()]
