"""Tracking of parts on a stream: a site's steps wait until the watermark has passed them, and are then linked in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..frame import SpectraFrame
from ..operators import partition as P
from ..operators import stats as ST
from ..operators.tracking import NSEA, follow

#: The state store that timers and typed state need. Fixed values.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrackProcessor(StatefulProcessor):
    """State of a site: its last step and next free number, and the parts that wait, by time.

    A timer at the earliest step that waits fires once the watermark is there; all steps up to it are linked. A site that
    has nothing waiting is forgotten when the watermark is `expire` milliseconds past its last step; if it comes back, it
    begins anew. Parts that come for a step that has been linked are counted and left out, as links depend on order.
    """

    LAST = "at long, fp array<double>, dpm array<double>, wspd double, ids array<int>, free int"
    WAITING = "at array<long>, part array<int>, fp array<double>, dpm array<double>, wspd array<double>"
    COLUMNS = ("at", "part", "fp", "dpm", "wspd")

    def __init__(self, expire: int, kw: dict):
        self.expire, self.kw = expire, kw

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.LAST)
        self.waiting = handle.getValueState("waiting", self.WAITING)
        self.late = handle.getValueState("late", "n long")

    def held(self) -> pd.DataFrame:
        own = self.waiting.get()
        found = pd.DataFrame(dict(zip(self.COLUMNS, own)) if own is not None else {c: [] for c in self.COLUMNS})
        return found.astype({c: "int64" if c in ("at", "part") else "float64" for c in self.COLUMNS})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, last = pd.concat(list(rows))[list(self.COLUMNS)], self.last.get()
        behind = new["at"] <= last[0] if last is not None else np.zeros(len(new), bool)
        if behind.any():
            self.late.update(((self.late.get() or (0,))[0] + int(behind.sum()),))
        new = new[~behind]
        if len(new):
            every = pd.concat([self.held(), new], ignore_index=True).sort_values(["at", "part"], kind="stable")
            self.waiting.update(tuple(every[c].tolist() for c in self.COLUMNS))
            self.handle.registerTimer(int(every["at"].iloc[0]) // 1000)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, every, last = timerValues.getCurrentWatermarkInMs(), self.held(), self.last.get()
        due = every["at"] // 1000 <= now
        if due.any():
            own = every[due]
            new = np.append(True, np.diff(own["at"]) != 0)
            if (~new & np.append(False, np.diff(own["part"]) == 0)).any():
                raise ValueError("times must increase")
            at0, fp0, dpm0, wspd0, ids0, free = last or (0, [], [], 0.0, [], 0)
            n = len(fp0)
            fp, dpm = (np.append(np.array(x, float), own[c].to_numpy(float)) for x, c in ((fp0, "fp"), (dpm0, "dpm")))
            wspd, at = np.append(np.full(n, wspd0), own["wspd"].to_numpy(float)), np.append(np.full(n, at0, "int64"), own["at"].to_numpy("int64"))
            begins = np.flatnonzero(np.append(np.arange(n) == 0, new))
            ids, births = follow(begins, np.zeros(len(fp), int), np.diff(at[begins], prepend=at[0]) / 1e6, fp, dpm, wspd, np.array(ids0) if n else None, start=free, **self.kw)
            end = int(begins[-1])
            last = (int(at[end]), fp[end:].tolist(), dpm[end:].tolist(), float(wspd[end]), ids[end:].tolist(), free + int(births[0]))
            made = own[["at", "part", "fp", "dpm"]].assign(track_id=pd.arrays.IntegerArray(np.where(ids < 0, 0, ids)[n:].astype("int32"), ids[n:] < 0))
            self.last.update(last)
            made.insert(0, "key", key[0])
            yield made.assign(late=(self.late.get() or (0,))[0])
        left = every[~due]
        if len(left):
            self.waiting.update(tuple(left[c].tolist() for c in self.COLUMNS))
            self.handle.registerTimer(int(left["at"].iloc[0]) // 1000)
        elif last is not None:
            self.waiting.clear()
            end = last[0] // 1000 + self.expire
            if end <= now:
                self.last.clear()
                self.late.clear()
            else:
                self.handle.registerTimer(end)


def track_stream(stats: DataFrame, key: str = "site", time: str = "time", delay: str = "0 seconds", expire: str = "30 days", **kw) -> DataFrame:
    """(key, time, part, fp, dpm, track_id, late) of a stream of parts (key STRING, time TIMESTAMP, part, fp, dpm, wspd).

    Steps come out in order once the watermark, `delay` behind the latest time, has passed them; their parts may arrive in
    several batches and in any order until then. What comes later is dropped by Spark (see numRowsDroppedByWatermark), or
    counted in `late` of the site's next rows. Sites that are quiet for `expire` are forgotten. A null fp is no peak.
    The session gets the state store that this needs, if it names none.
    """
    spark = stats.sparkSession
    if "RocksDB" not in (spark.conf.get(STORE, "") or ""):
        spark.conf.set(STORE, ROCKS)
    millis = spark.sql(f"SELECT cast(unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL '{expire}') AS long)").first()[0] if not expire.isdigit() else int(expire)
    kind = "key string, at long, part int, fp double, dpm double, track_id int, late long"
    rows = stats.withWatermark(time, delay).select(F.col(key).alias("key"), F.unix_micros(time).alias("at"), F.col("part").cast("int").alias("part"), F.col("fp").cast("double").alias("fp"), F.col("dpm").cast("double").alias("dpm"), F.col("wspd").cast("double").alias("wspd"), time)
    made = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=TrackProcessor(millis, kw), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return made.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), "part", "fp", "dpm", "track_id", "late")


def track_spectra(frame: SpectraFrame, method: str = "ptm1", key: str = "site", time: str = "time", wspd: str = "wspd", **kw) -> DataFrame:
    """Spectra of a stream partitioned, described and tracked; everything before the state is a map."""
    parts = P.METHODS[method](frame)
    df = ST.stats(parts, ["fp", "dpm"])
    return track_stream(df.select(F.col(key).cast("string").alias(key), time, "part", "fp", "dpm", F.col(wspd).alias("wspd") if wspd in df.columns else F.lit(float("nan")).alias("wspd")), key, time, nsea=NSEA[method], **kw)


#: Parts that a table of latest rows is dealt to by its keys; a batch rewrites those that it touches.
PARTS = 64


def upsert(path: str, keys: list[str], order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table in which the row latest by `order` counts for each key, read by `latest`.

    Keys are dealt to parts. A batch reads the newest version of those parts only that it has keys of, and writes a new
    version of these; older versions of a part go once a newer one is whole. Batch numbers only need to rise, and a
    repeated batch writes the same again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = sorted(r["__part"] for r in new.select("__part").distinct().collect())  # `parts` rows at most
        known = _versions(spark, path)
        old = [f"{path}/version={known[p][0]}/__part={p}" for p in touched if p in known]
        rows = new
        if old:
            rows = spark.read.option("basePath", f"{path}").parquet(*old).drop("version").select(new.columns).unionByName(new)
        names = [c for c in rows.columns if c not in [*keys, "__part"]]
        latest = rows.groupBy("__part", *keys).agg(F.max_by(F.struct(*names), order).alias("r")).select("__part", *keys, "r.*")
        latest.write.mode("overwrite").partitionBy("__part").parquet(f"{path}/version={number}")
        for p in touched:
            for v in known.get(p, [])[1:]:
                _delete(spark, f"{path}/version={v}/__part={p}")

    return sink


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert has written: the newest version of each part."""
    known = _versions(spark, path)
    return spark.read.option("basePath", path).parquet(*(f"{path}/version={v[0]}/__part={p}" for p, v in sorted(known.items()))).drop("version", "__part")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The whole versions of each part, newest first."""
    fs, at = _fs(spark, path)
    known: dict[int, list[int]] = {}
    if fs.exists(at):
        for v in fs.listStatus(at):
            if fs.exists(_fs(spark, f"{v.getPath().toString()}/_SUCCESS")[1]):
                for p in fs.listStatus(v.getPath()):
                    if p.getPath().getName().startswith("__part="):
                        known.setdefault(int(p.getPath().getName().partition("=")[2]), []).append(int(v.getPath().getName().partition("=")[2]))
    return {p: sorted(v, reverse=True) for p, v in known.items()}


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)
