"""Reconstruction against parts rebuilt one by one in plain numpy, from statistics that have oracles of their own."""

import math

import numpy as np
import pytest

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.operators import construct as C
from seastate.operators import partition as P
from seastate.operators import stats as ST

G = Grid(tuple(0.04 * 1.1**k for k in range(24)), tuple(15.0 * k for k in range(24)))
WIDTHS = np.gradient(np.array(G.freq))
COMBINE = {"max": np.max, "sum": np.sum, "mean": np.mean}


def rebuilt(hs, fp, gamma, dm, dspr):
    """A scaled JONSWAP shape times cosine spreading; what is undefined is 0."""
    if any(v is None or math.isnan(v) for v in (hs, fp, gamma, dm, dspr)):
        return np.zeros((G.nf, G.nd))
    e = []
    for f in G.freq:
        sigma = 0.07 if f <= fp else 0.09
        e.append(0.0081 * 9.81**2 * (2 * math.pi) ** -4 * f**-5 * math.exp(-1.25 * (f / fp) ** -4) * gamma ** math.exp(-((f - fp) ** 2) / (2 * sigma**2 * fp**2)))
    e = np.array(e) * (hs**2 / 16) / (np.dot(e, WIDTHS) + (0.25 * G.freq[-1] * e[-1] if G.freq[-1] > 0.333 else 0))
    turn = np.abs(np.array(G.dir) - dm)
    turn = np.where(turn > 180, 360 - turn, turn)
    s = np.abs(np.cos(np.radians(turn) / 2)) ** (2 * (2 / math.radians(dspr) ** 2 - 1))
    return np.outer(e, s / (s.sum() * 2 * math.pi / G.nd) * math.pi / 180)


@pytest.mark.parametrize("combine", list(COMBINE))
def test_reconstruction(spark, combine):
    """200 spectra of two or three systems, one without energy."""
    r = np.random.default_rng(4)
    rows = [(0, [0.0] * G.size)]
    for k in range(1, 200):
        e = sum(rebuilt(r.uniform(0.5, 4), fp, r.uniform(1, 4), r.uniform(0, 360), r.uniform(15, 35)) for fp in (0.07, 0.14, 0.25)[: 2 + k % 2])
        rows.append((k, (e * (1 + 0.05 * r.normal(size=e.shape))).clip(0).ravel().tolist()))
    frame = SpectraFrame(spark.createDataFrame(rows, "k long, efth array<double>").repartition(4), G)
    known = ST.stats(P.ptm3(frame, parts=3), ["hs", "fp", "gamma", "dm", "dspr"]).collect()
    want = {k: [] for k, _ in rows}
    for x in sorted(known, key=lambda x: x["part"]):
        want[x["k"]].append(rebuilt(x["hs"], x["fp"], x["gamma"], x["dm"], x["dspr"]))
    got = {x["k"]: np.array(x[EFTH]).reshape(G.nf, G.nd) for x in C.partition_and_reconstruct(frame, ["k"], 3, method_combine=combine).df.collect()}
    assert set(got) == {k for k, x in want.items() if x}
    for k, x in got.items():
        np.testing.assert_allclose(x, COMBINE[combine](want[k], axis=0), rtol=1e-9, atol=1e-14)
    assert sum(x.any() for x in got.values()) >= 199
