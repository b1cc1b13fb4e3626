"""Algorithms that SQL doesn't express, against plain versions that take one spectrum, one bin and one pair at a time."""

import math

import numpy as np
import pytest

from seastate.grid import Grid, frequencies
from seastate.operators import tracking as TR
from seastate.operators import watershed as W

G = Grid(frequencies(0.04, 14, 1.15), tuple(np.arange(0.0, 360, 30)))


def spectra(n, seed):
    """Several peaks, noise, steps, ties, flat and broken ones."""
    r, out = np.random.default_rng(seed), []
    for k in range(n):
        x = np.zeros((G.nf, G.nd))
        for _ in range(r.integers(1, 5)):
            d = np.abs(G.theta - r.uniform(0, 360))
            x += r.uniform(0.2, 3) * np.exp(-0.5 * ((G.f - r.uniform(0.05, 0.25)) / 0.03) ** 2)[:, None] * np.exp(-0.5 * (np.minimum(d, 360 - d) / 40) ** 2)
        x = x * r.uniform(0.4, 1.6, x.shape) if k % 3 == 0 else r.random(x.shape) if k % 7 == 0 else np.round(x, 1) if k % 5 == 0 else x
        out.append(x)
    out[1][:] = 0.0
    out[2][3, 4] = np.nan
    return np.array(out)


def around(i, j):
    for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)):
        if 0 <= i + a < G.nf:
            yield i + a, (j + b) % G.nd


def plain_watershed(s, ihmax):
    bins = [(i, j) for j in range(G.nd) for i in range(G.nf)]
    s = s.astype(np.float32).astype(float)
    if not np.isfinite(s).all() or s.max() - s.min() < 1e-9:
        return np.zeros(s.shape, int)
    z = {p: float(np.float32(s.max() - s[p])) for p in bins}
    level = {p: min(ihmax - 1, math.floor(z[p] * (ihmax - 1) / (s.max() - s.min()) + 0.5)) for p in bins}
    label, count = {}, 0
    for water in range(ihmax):
        rest = [p for p in bins if level[p] == water]
        while True:
            seen = {p: [label[q] for q in around(*p) if q in label] for p in rest}
            ring = {p: v for p, v in seen.items() if v}
            for p, v in ring.items():
                own = 0
                for x in v:
                    if x and own and x != own:
                        own = 0
                    elif x:
                        own = x
                label[p] = own
            rest = [p for p in rest if p not in ring]
            if not ring:
                break
        for p in rest:
            if p not in label:
                count += 1
                label[p], todo = count, [p]
                while todo:
                    for q in around(*todo.pop()):
                        if q in rest and q not in label:
                            label[q] = count
                            todo.append(q)
    for _ in range(5):
        changed = {}
        for p in bins:
            if label[p] == 0:
                near = [(abs(z[p] - z[q]), -k, label[q]) for k, q in enumerate(around(*p)) if label[q] > 0]
                if near and min(near)[0] <= max(z.values()):
                    changed[p] = min(near)[2]
        label |= changed
    return np.array([[label[i, j] for j in range(G.nd)] for i in range(G.nf)])


def height(x):
    e = x.sum(axis=1) * G.dd
    return 4 * math.sqrt(max(0.0, sum((e[k] + e[k + 1]) / 2 * (G.f[k + 1] - G.f[k]) for k in range(G.nf - 1)) + e[-1] * G.tail()))


def by_height(parts):
    return sorted(parts, key=height, reverse=True)


def padded(parts, count):
    if count is None:
        return [p for p in parts if p.any()]
    return (parts + [np.zeros((G.nf, G.nd))] * count)[:count]


def parts_of(x, ihmax=100):
    labels = plain_watershed(x, ihmax)
    return [np.where(labels == k, x, 0.0) for k in range(1, labels.max() + 1)]


def sea_and_swell(x, mask):
    sea, swell = np.zeros_like(x), []
    for p in parts_of(x):
        if p.sum() > 0 and p[mask].sum() / p.sum() > 0.3333:
            sea = sea + p
        else:
            swell.append(p)
    return sea, swell


def plain_merge(parts, swells, hs_min, kappa=0.4, zeta=0.65, most=30.0):
    parts = [p for p in parts if p.sum() > 0]
    w, rad = G.df[:, None] * G.dd, np.radians(G.theta)
    fx, fy = G.f[:, None] * np.cos(rad), G.f[:, None] * np.sin(rad)

    def energy(p):
        return (p * w).sum()

    def peak(p):
        return np.unravel_index(p.argmax(), p.shape)

    def gap(p, q):
        return (fx[peak(p)] - fx[peak(q)]) ** 2 + (fy[peak(p)] - fy[peak(q)]) ** 2

    def mean(p):
        return math.degrees(math.atan2((p * w * np.sin(rad)).sum(), (p * w * np.cos(rad)).sum())) % 360

    def spread(p):
        e = energy(p)
        return (p * w * (fx**2 + fy**2)).sum() / e - ((p * w * fx).sum() / e) ** 2 - ((p * w * fy).sum() / e) ** 2

    def saddle(p, q):
        return max((min(p[a], q[b]) for a in zip(*np.nonzero(p)) for b in around(*a) if q[b] > 0), default=0.0)

    def score(p, q):
        turn = abs(mean(p) - mean(q)) % 360
        if min(turn, 360 - turn) > most or saddle(p, q) <= 0:
            return 0.0
        deep, wide = saddle(p, q) / min(p.max(), q.max()), kappa * max(spread(p), spread(q))
        return max(deep if deep >= zeta else 0.0, 1 - gap(p, q) / wide if wide > 0 and gap(p, q) <= wide else 0.0)

    def join(a, b):
        parts[a] = parts[a] + parts[b]
        del parts[b]

    pairs = lambda: [(a, b) for a in range(len(parts)) for b in range(a + 1, len(parts))]
    while pairs():
        best = max(pairs(), key=lambda x: score(parts[x[0]], parts[x[1]]))
        if score(parts[best[0]], parts[best[1]]) <= 0:
            break
        join(*best)
    while len(parts) > 1:
        weak = [k for k in range(len(parts)) if energy(parts[k]) < (hs_min / 4) ** 2]
        if not weak:
            break
        k = min(weak, key=lambda k: energy(parts[k]))
        others = [q for q in range(len(parts)) if q != k]
        near = [q for q in others if saddle(parts[k], parts[q]) > 0]
        join(max(near, key=lambda q: saddle(parts[k], parts[q])) if near else min(others, key=lambda q: gap(parts[k], parts[q])), k)
    while swells is not None and len(parts) > max(1, swells):
        close = [x for x in pairs() if saddle(parts[x[0]], parts[x[1]]) > 0] or pairs()
        join(*min(close, key=lambda x: gap(parts[x[0]], parts[x[1]])))
    return sorted(parts, key=energy, reverse=True)


@pytest.mark.parametrize("ihmax", [2, 25, 100, 300])
def test_watershed_labels(ihmax):
    block = spectra(60, ihmax)
    got = W.watersheds(block, ihmax)
    assert all((g == plain_watershed(x, ihmax)).all() for g, x in zip(got, block))
    assert got[1].max() == got[2].max() == 0
    assert all((W.watershed(x, ihmax) == g).all() for g, x in zip(got[:9], block[:9]))


@pytest.mark.parametrize("count", [2, None])
def test_partitions(count):
    block = np.nan_to_num(spectra(40, 5))
    r = np.random.default_rng(1)
    wspd, wdir, dpt = r.uniform(2, 20, len(block)), r.uniform(0, 360, len(block)), np.where(r.random(len(block)) < 0.3, np.nan, 30.0)
    wspd[5] = np.nan
    masks = [W.wind_masks(G, wspd, wdir, dpt, 1.7, strict) for strict in (True, False)]
    assert not masks[0][5].any()

    def split(sizes, parts):
        ends = np.cumsum(sizes)
        return [parts[e - n : e] for n, e in zip(sizes, ends)]

    made = {
        "ptm1": split(*W.ptm1(block, block, G, masks[0], 0.3333, count, 100)),
        "ptm2": split(*W.ptm2(block, block, G, masks[0], 0.3333, count, 100)),
        "ptm3": split(*W.ptm3(block, block, G, count, 100)),
        "hp01": split(*W.hp01(block, block, G, masks[1], 0.3333, count, 100, hs_min=0.2)),
    }
    for k, x in enumerate(block):
        sea, swell = sea_and_swell(x, masks[0][k])
        windy = [p * masks[0][k] for p in swell]
        wide_sea, wide = sea_and_swell(x, masks[1][k])
        wide = by_height([p for p in wide if p.sum() > 0])
        want = {
            "ptm1": [sea, *padded(by_height(swell), count)],
            "ptm2": [sea, sum(windy, np.zeros_like(x)), *padded(by_height([p * ~masks[0][k] for p in swell]), count)],
            "ptm3": padded(by_height(parts_of(x)), count),
            "hp01": [wide_sea, *padded(plain_merge(wide, count, 0.2) if len(wide) > 1 else wide, count)],
        }
        for name, w in want.items():
            got = made[name][k]
            assert len(got) == len(w), (name, k)
            assert all(np.allclose(a, b) for a, b in zip(got, w)), (name, k)


def test_tracks(spark):
    """Parts of consecutive times are linked closest first, if they are near in frequency and direction."""
    r = np.random.default_rng(3)
    rows = []
    for site in range(4):
        for t in range(12):
            for part in range(3):
                empty = r.random() < 0.15
                rows.append((site, 3600 * t, part, math.nan if empty else 0.1 + 0.02 * part + r.normal() * 0.002, math.nan if empty else (90.0 * part + r.normal() * 12) % 360, 9.0 + site))
    df = spark.createDataFrame(rows, "site long, time long, part int, fp double, dpm double, wspd double")
    got = {(x["site"], x["time"], x["part"]): x["track_id"] for x in TR.track_stats(df, ["site"], nsea=1).collect()}
    for site in range(4):
        free, last = 0, {}
        for t in range(12):
            now = {p: (fp, d, w) for s, tt, p, fp, d, w in rows if (s, tt) == (site, 3600 * t)}
            rise, links = 3600 * 9.81 / (4 * math.pi * 1e6), []
            for p, (fp, d, _) in now.items():
                for q, (fq, dq, wq, track) in last.items():
                    low, turn = -rise, 20.0
                    if q == 0:
                        scale = 15.8 * (9.81 / wq) ** 0.57
                        low, turn = (scale * ((fq / scale) ** (-1 / 0.43) + 3600) ** -0.43 - fq if fq == fq else math.nan), 30.0
                    gap = abs(d - dq) % 360
                    gap = min(gap, 360 - gap)
                    if gap < turn and low < fp - fq < rise:
                        links.append((abs(fp - fq) / max(rise, abs(low)) + gap / turn, p, q, track))
            tracks, used = {}, set()
            for _, p, q, track in sorted(links):
                if p not in tracks and q not in used and track is not None:
                    tracks[p] = track
                    used.add(q)
            for p, (fp, *_) in now.items():
                if fp == fp and p not in tracks:
                    tracks[p], free = free, free + 1
                want = tracks.get(p) if fp == fp else None
                assert got[site, 3600 * t, p] == want, (site, t, p)
            last = {p: (*v, tracks.get(p)) for p, v in now.items()}
