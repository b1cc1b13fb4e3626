"""Tracks of a stream: out of order, split, late and quiet, against tracks of the same rows at once."""

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seastate.operators import tracking as TR
from seastate.streaming.tracking import track_stream

KIND = "site string, time timestamp, part int, fp double, dpm double, wspd double"
R = np.random.default_rng(2)


def steps(site, hours, kinds=2):
    return [(site, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), p, 0.1 + 0.03 * p + R.normal(0, 0.001), (100.0 * p + R.normal(0, 8)) % 360, 8.0) for h in hours for p in range(kinds)]


def run(spark, tmp_path, batches, **kw):
    """Each batch is a file; the query takes one at a time, and ends and starts again in the middle."""
    into = tmp_path / "in"
    into.mkdir()
    progress = []
    for half in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in half:
            k = len(list(into.iterdir()))
            frame = pd.DataFrame(rows, columns=["site", "time", "part", "fp", "dpm", "wspd"]).astype({"part": "int32", "time": "datetime64[us]"})
            frame["time"] = frame["time"].dt.tz_localize("UTC")
            frame.to_parquet(into / f"{k:03}.parquet")
            os.utime(into / f"{k:03}.parquet", (1e9 + k, 1e9 + k))
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(into))
        query = track_stream(stream, nsea=0, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        progress += query.recentProgress
    dropped = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    got = spark.read.schema("site string, time timestamp, part int, fp double, dpm double, track_id int, late long").parquet(str(tmp_path / "out")).collect()
    return {(x["site"], x["time"], x["part"]): x["track_id"] for x in got}, dropped


def at_once(spark, rows):
    got = TR.track_stats(spark.createDataFrame(rows, KIND), ["site"], nsea=0).collect()
    return {(x["site"], x["time"], x["part"]): x["track_id"] for x in got}


def test_order_and_late_rows(spark, tmp_path):
    a, b = steps("a", range(40)), steps("b", range(0, 40, 3), 3)
    end = steps("end", [60])
    mixed = a[:60] + b[:30]
    R.shuffle(mixed)
    batches = [mixed[:30], mixed[30:55], mixed[55:], a[60:63], [a[63]], a[64:] + b[30:], end, steps("end", [60.5]), steps("end", [60.7]), steps("a", [2, 3]), steps("end", [61])]
    got, dropped = run(spark, tmp_path, batches, delay="40 hours")
    # up to the watermark, 61 - 40 hours, everything has come out, as from one table
    want = {k: v for k, v in at_once(spark, a + b).items() if k[1] <= dt.datetime(2024, 1, 1) + dt.timedelta(hours=21)}
    assert got == want and len(want) == 44 + 24
    assert dropped == 4


def test_quiet_sites_are_forgotten(spark, tmp_path):
    one, other = steps("a", range(5)), steps("b", range(0, 60, 4))
    back = steps("a", range(50, 55))
    inside = steps("c", [0, 1, 9, 10])
    batches = [one + inside + other[:10], other[10:20], other[20:26], back + other[26:], steps("end", [70])]
    got, dropped = run(spark, tmp_path, batches, delay="0 seconds", expire="20 hours")
    want = at_once(spark, [(f"{s}1" if r in back else s, *rest) for r in one + inside + other + back for s, *rest in [r]] + steps("end", [70]))
    want = {(s.removesuffix("1"), t, p): x for (s, t, p), x in want.items()}
    assert got == want and dropped == 0
    assert min(x for (s, t, _), x in got.items() if s == "a" and t.day == 3) == 0


def test_null_peaks_and_repeats(spark, tmp_path):
    rows = steps("a", range(6))
    rows[3] = (*rows[3][:3], None, None, 8.0)
    rows[6] = (*rows[6][:3], float("nan"), 1.0, None)
    got, _ = run(spark, tmp_path, [rows[:7], rows[7:]], delay="5 hours")
    assert got == {k: v for k, v in at_once(spark, rows).items() if k[1].hour == 0}
    assert spark.createDataFrame(rows, KIND).where(F.col("fp").isNull()).count() == 1
