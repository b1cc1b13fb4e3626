"""Fits against a plain model and its cost: nothing of the solver is used to judge it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.frame import EFTH, SpectraFrame
from seastate.grid import Grid
from seastate.operators import construct as C
from seastate.plans import derived as D

G = Grid(tuple(0.03 * 1.08**k for k in range(34)))
N = 1000


def scaled(shape, hs):
    """The shape with the wave height hs: trapezoid-free sum over the grid's widths, and the tail."""
    f, e = G.f, np.asarray(shape, float)
    widths = np.array([f[1] - f[0], *((f[k + 1] - f[k - 1]) / 2 for k in range(1, len(f) - 1)), f[-1] - f[-2]])
    return e * hs**2 / 16 / (sum(e * widths) + (0.25 * e[-1] * f[-1] if f[-1] > 0.333 else 0.0))


def jonswap(fp, hs, gamma):
    out = []
    for f in G.f:
        sigma = 0.07 if f <= fp else 0.09
        out.append(f**-5 * math.exp(-1.25 * (fp / f) ** 4) * gamma ** math.exp(-((f - fp) ** 2) / (2 * sigma**2 * fp**2)))
    return scaled(out, hs)


def gaussian(fp, hs, gw):
    return scaled([math.exp(-0.5 * ((f - fp) / gw) ** 2) for f in G.f], hs)


CASES = {"jonswap": (jonswap, C.fit_jonswap, "gamma", (1.0, 6.0)), "gaussian": (gaussian, lambda fr: C.fit_gaussian(fr, 0.02), "gw", (0.012, 0.04))}


@pytest.mark.parametrize("kind", list(CASES))
def test_no_better_parameters_near_a_fit(spark, kind):
    """1,000 spectra, half of them with noise: the fit's density is the plain model's, and its cost is the least around it."""
    model, fit, third, span = CASES[kind]
    r = np.random.default_rng(11)
    rows, truth = [], []
    for k in range(N):
        p = (r.uniform(0.06, 0.2), r.uniform(0.5, 6), r.uniform(*span))
        noise = 1 + (0.15 * r.normal(size=G.nf) if k % 2 else 0)
        rows.append((k, np.maximum(model(*p) * noise, 0).tolist()))
        truth.append(p)
    frame = SpectraFrame(spark.createDataFrame(rows, "k long, efth array<double>").repartition(4), G)
    got = {x["k"]: x for x in fit(frame).df.collect()}
    settled = 0
    for k, y in rows:
        x = got[k]
        if x["fp"] is None:
            continue
        settled += 1
        p, y = np.array([x["fp"], x["hs"], x[third]]), np.array(y)
        np.testing.assert_allclose(x[EFTH], model(*p), rtol=1e-7, atol=1e-12)
        cost = lambda q: ((model(*q) - y) ** 2).sum()  # noqa: E731, B023
        own, whole = cost(p), (y**2).sum()
        if k % 2 == 0:
            np.testing.assert_allclose(p, truth[k], rtol=1e-4)
        for h in (1e-4, 1e-3, 1e-2):
            for move in (*np.eye(3), *-np.eye(3), *r.normal(size=(4, 3))):
                q = p * (1 + h * move)
                if kind == "jonswap":
                    q = np.clip(q, [min(G.freq), 1e-10, 0.1], [max(G.freq), 30, 20])
                assert cost(q) >= own - 1e-9 * whole, (k, p, q)
    assert settled >= 0.98 * N


def test_what_has_no_fit(spark):
    rows = [(0, [0.0] * G.nf), (1, [float("nan")] * G.nf), (2, [1.0] * G.nf)]
    frame = SpectraFrame(spark.createDataFrame(rows, "k long, efth array<double>"), G)
    assert all(x["fp"] is None and x["hs"] is None for x in C.fit_jonswap(frame).df.collect())


def test_events_of_one_row_group_are_fitted_by_many_tasks(spark, tmp_path):
    """A few bytes a row: the file is one split, the fits are not one task's; each event is fitted once."""
    n = 45_000
    own = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2020-01-01 00:00:00' AS ts", "id % 7 AS user_id", "CAST(id % 200 AS DOUBLE) AS value")
    own.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for sf, tasks in ((str(tmp_path), 3), ("/root/testdata/sf0.001", 1)):
        frame = D.events(spark, sf)
        where = frame.df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("m")).collect()
        assert len(where) == tasks
        if tasks > 1:
            assert sum(r["m"] for r in where) == n and max(r["n"] for r in where) <= 1.1 * n / tasks
