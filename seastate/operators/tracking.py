"""Tracking of parts in time: consecutive parts of a site are linked by peak frequency and direction."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..frame import SpectraFrame
from ..grid import GRAVITY
from ..numbering import numbered, written
from . import partition as P
from . import stats as ST


def sea_change(wspd: float, fp: np.ndarray, dt: float, scaling: float) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        t = 15.8 * (GRAVITY / wspd) ** 0.57 if wspd else np.nan
        return scaling * t * ((fp / t) ** (-1 / 0.43) + dt) ** -0.43 - fp


def match(fp0, dpm0, fp1, dpm1, upper, lower, turn) -> dict[int, int]:
    """Current part -> previous part, closest first, each once. Limits belong to the previous part and are strict."""
    df = fp1[:, None] - fp0[None, :]
    dd = np.abs(dpm1[:, None] - dpm0[None, :]) % 360
    dd = np.minimum(dd, 360 - dd)
    with np.errstate(invalid="ignore"):
        ok = (dd < turn) & (df < upper) & (df > lower)
        cost = np.abs(df) / np.maximum(upper, np.abs(lower)) + dd / turn
    pairs = [(cost[c, p], c, p) for c, p in zip(*np.nonzero(ok))]
    out: dict[int, int] = {}
    for _, c, p in sorted(pairs, key=lambda x: x[0]):
        if c not in out and p not in out.values():
            out[int(c)] = int(p)
    return out


class Linker:
    """The state of one site: what the last step had, and the next free number."""

    def __init__(self, nsea=1, ddpm_sea_max=30.0, ddpm_swell_max=20.0, dfp_sea_scaling=1.0, dfp_swell_source_distance=1e6, state=None):
        self.nsea, self.sea, self.swell, self.scaling, self.distance = nsea, ddpm_sea_max, ddpm_swell_max, dfp_sea_scaling, dfp_swell_source_distance
        self.last = state

    def step(self, time: float, fp: np.ndarray, dpm: np.ndarray, wspd: float) -> np.ndarray:
        """Track numbers of the parts at this time, -1 for parts without a peak."""
        ids = np.full(len(fp), -1)
        free, known = 0, {}
        if self.last is not None:
            t0, fp0, dpm0, wspd0, ids0, free = self.last
            if time <= t0:
                raise ValueError("times must increase")
            dt = time - t0
            rise = dt * GRAVITY / (4 * math.pi * self.distance)
            upper, lower, turn = np.full(len(fp0), rise), np.full(len(fp0), -rise), np.full(len(fp0), self.swell)
            lower[: self.nsea] = sea_change(wspd0, fp0[: self.nsea], dt, self.scaling)
            turn[: self.nsea] = self.sea
            known = {c: ids0[p] for c, p in match(fp0, dpm0, fp, dpm, upper, lower, turn).items() if ids0[p] >= 0}
        for k in range(len(fp)):
            if np.isnan(fp[k]):
                continue
            if k in known:
                ids[k] = known[k]
            else:
                ids[k], free = free, free + 1
        self.last = (time, fp, dpm, wspd, ids, free)
        return ids


def links(begins: np.ndarray, same: np.ndarray, dt: np.ndarray, fp: np.ndarray, dpm: np.ndarray, wspd: np.ndarray, nsea=1, ddpm_sea_max=30.0, ddpm_swell_max=20.0, dfp_sea_scaling=1.0, dfp_swell_source_distance=1e6) -> np.ndarray:
    """For each row, that of the step before that it goes on from, or -1: `match` for all steps at once.

    begins: the first rows of the steps, in order; for each step, same: whether the one before is its site's, and dt: the
    seconds between them. Pairs are weighed together; only steps where parts compete are gone through pair by pair.
    """
    sizes, follows = np.diff(np.append(begins, len(fp))), np.flatnonzero(same)
    many = sizes[follows] * sizes[follows - 1]
    step = np.repeat(follows, many)
    within = np.arange(len(step)) - np.repeat(np.cumsum(many) - many, many)
    c, place = begins[step] + within // sizes[step - 1], within % sizes[step - 1]
    p, sea = begins[step - 1] + place, place < nsea
    df, dd = fp[c] - fp[p], np.abs(dpm[c] - dpm[p]) % 360
    dd, upper = np.minimum(dd, 360 - dd), dt[step] * GRAVITY / (4 * math.pi * dfp_swell_source_distance)
    lower, turn = -upper, np.where(sea, ddpm_sea_max, ddpm_swell_max)
    with np.errstate(all="ignore"):
        if sea.any():
            w = wspd[begins[step[sea] - 1]]
            t = np.where(w != 0, 15.8 * (GRAVITY / w) ** 0.57, np.nan)
            lower[sea] = dfp_sea_scaling * t * ((fp[p[sea]] / t) ** (-1 / 0.43) + dt[step[sea]]) ** -0.43 - fp[p[sea]]
        cost = np.abs(df) / np.maximum(upper, np.abs(lower)) + dd / turn
        ok = np.flatnonzero((dd < turn) & (df < upper) & (df > lower))
    ok = ok[np.lexsort((cost[ok], step[ok]))]
    c, p = c[ok], p[ok]
    alone = (np.bincount(c, minlength=len(fp))[c] == 1) & (np.bincount(p, minlength=len(fp))[p] == 1)
    out, taken = np.full(len(fp), -1), set()
    out[c[alone]] = p[alone]
    for i, j in zip(c[~alone].tolist(), p[~alone].tolist()):
        if out[i] < 0 and j not in taken:
            out[i] = j
            taken.add(j)
    return out


def follow(begins: np.ndarray, site: np.ndarray, seconds: np.ndarray, fp: np.ndarray, dpm: np.ndarray, wspd: np.ndarray, held: np.ndarray | None = None, start: int = 0, **kw) -> tuple[np.ndarray, np.ndarray]:
    """(track numbers, -1 without a peak; births in the row's site) of rows in the order of site (numbers from 0), step and part.

    seconds: of each step, since the one before. held: the numbers that the first step has already; its rows
    aren't births. start: the first new number.
    """
    same = np.append(False, site[begins[1:]] == site[begins[:-1]])
    before = links(begins, same, seconds, fp, dpm, wspd, **kw)
    born = ~np.isnan(fp) & (before < 0)
    born[: 0 if held is None else len(held)] = False
    so_far, first = np.cumsum(born), np.searchsorted(site, np.arange(site[-1] + 1))
    number = start + so_far - 1 - (so_far[first] - born[first])[site]
    if held is not None:
        number[: len(held)] = held
    root = np.where(before >= 0, before, np.arange(len(fp)))
    while not np.array_equal(far := root[root], root):
        root = far
    return np.where(np.isnan(fp), -1, number[root]), np.bincount(site, born).astype(int)[site]


#: Numbers from here on stand for parts of the step before a block; less than that for tracks born in it.
INHERITED = 1 << 30


def _blocks(df: DataFrame, keys: list[str], time: str, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """df in blocks of neighbouring steps (column __p, in order), each with the last step of the block before it (__halo); and (__p, __next) of the blocks.

    A block is a range of (keys, time), so a site has as many as its steps fill, and a step is in one.
    """
    order = [*keys, time]
    dealt = df.repartitionByRange(*([blocks] if blocks else []), *order).sortWithinPartitions(*order, "part")
    table = written(dealt.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "steps")
    ends = table.groupBy("__p").agg(F.max_by(F.struct(*order), "__m").alias("__end"))
    chain = written(ends.select("__p", F.lead("__p").over(Window.orderBy("__p")).alias("__next"), "__end"), "ends")  # a row for each block
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__end.{c}"))
    halo = table.join(chain.where("__next is not null"), "__p").where(same).select(*df.columns, F.col("__next").alias("__p"), "__m")
    return table.withColumn("__halo", F.lit(False)).unionByName(halo.withColumn("__halo", F.lit(True))), chain.select("__p", "__next")


def _linked(stream: DataFrame, df: DataFrame, keys: list[str], time: str, wspd: str | None, kw: dict) -> DataFrame:
    """df with what its block knows of each row: __site (0 is the site that the block before ends with), __number (of a track born here in its site, or INHERITED and a part of the step before; null without a peak), __births of the site here, and __at, the place in the block's last step (else null)."""
    more = {"__p": "int", "__site": "int", "__number": "int", "__births": "int", "__at": "int"}
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.IntegerType()) for c in more)])
    names = df.columns

    def changed(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
        out = np.arange(len(pdf)) == 0
        for c in columns:
            last = pdf[c].shift()
            out |= ~((pdf[c] == last) | (pdf[c].isna() & last.isna())).to_numpy(bool)
        return out

    def op(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__halo", "__m"], ascending=[False, True], kind="stable").reset_index(drop=True)
        site, new = np.cumsum(changed(pdf, keys)) - 1, changed(pdf, ["__halo", *keys, time])
        if (~new & ~changed(pdf, ["part"])).any():
            raise ValueError("times must increase")
        border, held = np.flatnonzero(new), bool(pdf["__halo"].iloc[0])
        t = pdf[time].iloc[border]
        dt = t.diff().dt.total_seconds().to_numpy() if pd.api.types.is_datetime64_any_dtype(t) else np.diff(t.to_numpy(float), prepend=np.nan)
        w = pdf[wspd].to_numpy(float) if wspd and wspd in pdf else np.full(len(pdf), np.nan)
        first = int(border[1]) if held else 0
        number, births = follow(border, site, dt, pdf["fp"].to_numpy(float), pdf["dpm"].to_numpy(float), w, INHERITED + np.arange(first) if held else None, **kw)
        site_of = site if held else site + 1
        at = np.full(len(pdf), -1)
        at[border[-1] :] = np.arange(len(pdf) - border[-1])
        out = pdf.loc[first:, names].copy()
        for c, x in (("__site", site_of), ("__number", number), ("__births", births), ("__at", at)):
            out[c] = pd.array(np.where(x[first:] < 0, 0, x[first:]), "Int32")
            out.loc[x[first:] < 0, c] = pd.NA
        out.insert(len(names), "__p", pdf["__p"].iloc[0])
        return out[schema.fieldNames()]

    return stream.groupBy("__p").applyInPandas(op, schema)


def _inherited(linked: DataFrame, chain: DataFrame, offsets: DataFrame) -> DataFrame:
    """(__p, __part, __id): the track of each part of the step before a block, by pointer jumping over blocks."""
    ends = linked.where("__at is not null and __number is not null").join(offsets.select("__p", "__carried"), "__p").join(chain, "__p").where("__next is not null")
    born = F.col("__number") < INHERITED
    known = F.when(born, F.col("__number") + F.when(F.col("__site") == 0, F.col("__carried")).otherwise(0))
    hops = ends.select(F.col("__next").alias("__p"), F.col("__at").alias("__part"), known.alias("__id"), F.when(~born, F.col("__p")).alias("to_p"), F.when(~born, F.col("__number") - INHERITED).alias("to_part"))
    hops = written(hops, "hops")
    while not hops.where("__id is null and to_p is not null").isEmpty():  # as often as the longest way doubles
        far = hops.select(F.col("__p").alias("to_p"), F.col("__part").alias("to_part"), F.col("__id").alias("far_id"), F.col("to_p").alias("far_p"), F.col("to_part").alias("far_part"))
        hops = written(hops.join(far, ["to_p", "to_part"], "left").select("__p", "__part", F.coalesce("__id", "far_id").alias("__id"), F.col("far_p").alias("to_p"), F.col("far_part").alias("to_part")), "hops")
    return hops.select("__p", "__part", "__id")


def track_stats(df: DataFrame, keys: list[str], time: str = "time", wspd: str | None = "wspd", blocks: int | None = None, **kw) -> DataFrame:
    """df (keys, time, part, fp, dpm and others) with track_id (null without a peak) and ntracks of the site.

    Links join neighbouring steps alone, so a site isn't a group: steps lie in blocks, ranges of (keys, time), which are
    linked each by itself from the last step of the block before. Tracks get their numbers from sums of births over the
    blocks of a site, and those that come from an earlier block by pointer jumping. blocks: how many there are, else
    Spark's number of shuffle partitions. Null keys are a site of their own; null or NaN fp is no peak; repeated times
    and parts of a site raise; without keys all rows are one site; an empty table gives no rows.
    """
    stream, chain = _blocks(df, keys, time, blocks)
    linked = written(_linked(stream, df, keys, time, wspd, kw), "linked")
    each = linked.groupBy("__p").agg(F.min("__site").alias("first"), F.max("__site").alias("last"), F.min_by("__births", "__site").alias("first_n"), F.max_by("__births", "__site").alias("last_n"))
    along = Window.orderBy("__p")  # over blocks, a row each
    each = each.withColumn("segment", F.sum((F.col("last") != 0).cast("long")).over(along))
    upto = F.sum("last_n").over(Window.partitionBy("segment").orderBy("__p"))
    whole = F.sum("last_n").over(Window.partitionBy("segment")) + F.when((F.lead("first").over(along) == 0) & (F.lead("last").over(along) != 0), F.lead("first_n").over(along)).otherwise(0)
    each = each.withColumns({"upto": upto, "behind": whole})
    total = F.max("behind").over(Window.partitionBy("segment"))  # only the segment's last block sees what follows it
    each = each.withColumn("total", total)
    zero = F.lit(0).cast("long")
    offsets = written(each.select("__p", F.col("last").alias("__last"), F.when(F.col("first") == 0, F.lag("upto").over(along)).otherwise(zero).alias("__carried"), F.col("total").alias("__total"), F.lag("total").over(along).alias("__before")), "offsets")
    ids = _inherited(linked, chain, offsets)
    rows = linked.join(F.broadcast(offsets), "__p")  # a row for each block
    rows = rows.withColumn("__part", F.when(F.col("__number") >= INHERITED, F.col("__number") - INHERITED)).join(ids, ["__p", "__part"], "left")
    held = F.col("__site") == 0
    track = F.when(F.col("__part").isNotNull(), F.col("__id")).otherwise(F.col("__number") + F.when(held, F.col("__carried")).otherwise(0))
    many = F.when(held & (F.col("__last") != 0), F.col("__before")).when(F.col("__site") == F.col("__last"), F.col("__total")).otherwise(F.col("__births"))
    return rows.select(*df.columns, track.cast("int").alias("track_id"), many.cast("int").alias("ntracks"))


#: Wind-sea parts of each method.
NSEA = {"ptm1": 1, "ptm2": 2, "ptm3": 0, "hp01": 1}


def track(frame: SpectraFrame, keys: list[str], method: str = "ptm1", time: str = "time", wspd: str = "wspd", systems: bool = False, min_duration: int = 1, ddpm_sea_max=30.0, ddpm_swell_max=20.0, dfp_sea_scaling=1.0, dfp_swell_source_distance=1e6, **kw) -> DataFrame:
    """Partition, take fp and dpm of each part, and link the parts of each site in time; with systems, only tracks of min_duration steps, numbered anew."""
    if method not in NSEA:
        raise ValueError(f"tracking goes with {sorted(NSEA)}")
    parts = P.METHODS[method](frame, **kw)
    df = ST.stats(parts, ["hs", "fp", "dpm"])
    df = df.select(*keys, time, "part", *([wspd] if wspd in df.columns else []), "hs", "fp", "dpm")
    out = track_stats(df, keys, time, wspd, nsea=NSEA[method], ddpm_sea_max=ddpm_sea_max, ddpm_swell_max=ddpm_swell_max, dfp_sea_scaling=dfp_sea_scaling, dfp_swell_source_distance=dfp_swell_source_distance)
    return wave_systems(out, keys, time, min_duration) if systems else out


def wave_systems(tracks: DataFrame, keys: list[str], time: str = "time", min_duration: int = 1) -> DataFrame:
    """Rows of tracks of at least min_duration steps, with wave_system numbered from 0 in the order of track_id in each site.

    Steps are counted for each track, and the tracks that stay are numbered over all sites in ranges; a site's first number
    is then taken off. No site is a group.
    """
    rows = tracks.where("track_id is not null")
    long = rows.groupBy(*keys, "track_id").agg(F.countDistinct(time).alias("__n")).where(F.col("__n") >= min_duration).drop("__n")
    long = numbered(long, [*keys, "track_id"], "__k")
    named = lambda df, names, tag: df.withColumnsRenamed({c: f"__{tag}_{c}" for c in names})
    same = lambda names, tag: functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{tag}_{c}")) for c in names], F.lit(True))
    first = long.groupBy(*keys).agg(F.min("__k").alias("__first"))
    placed = long.join(named(first, keys, "site"), same(keys, "site")).select(*keys, "track_id", (F.col("__k") - F.col("__first")).cast("int").alias("wave_system")) if keys else long.select("track_id", F.col("__k").cast("int").alias("wave_system"))
    return rows.join(named(placed, [*keys, "track_id"], "of"), same([*keys, "track_id"], "of")).select(*tracks.columns, "wave_system")
