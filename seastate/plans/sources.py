"""Queries of sources, sinks and streams: spectra of the embeddings are written in a format, read back, and described.

Each oracle applies what the format keeps: the digits of its numbers, and nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..grid import Grid
from ..operators import stats as ST
from ..session import scratch
from ..sources import models, multi, netcdf, plugins, single, text, writers, zarr
from ..streaming import tracking as STR
from . import derived as D

queries: dict = {}
oracles: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        queries[name], oracles[name] = f, sql
        return f

    return add


def placed(spark, sf_dir) -> SpectraFrame:
    """The embeddings' spectra at 50 sites (grp, with a position each) and hourly times."""
    fr = D.embeddings(spark, sf_dir, "grp", "step", "wspd", "wdir", "dpt")
    time = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, CAST(step AS INT), 0, 0)")
    place = {"time": time, "lon": F.col("grp").cast("double"), "lat": F.col("grp").cast("double") - 25}
    return fr.with_df(fr.df.withColumns(place).drop("vec_id", "step").withColumn("site", F.col("grp").cast("string")))


def described(frame: SpectraFrame, stats: list[str], digits: int = 5):
    """grp and step from position and time, and rounded statistics."""
    hours = F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2020-01-01 00:00:00'"), F.col("time"))
    df = ST.stats(frame, stats)
    return df.select(F.round("lon").cast("long").alias("grp"), hours.alias("step"), *((F.round(s, digits) + F.lit(0.0)).alias(s) for s in stats))


def rounded_grid(digits: int) -> Grid:
    return Grid(tuple(float(f"{f:.{digits}f}") for f in D.EMB.freq), D.EMB.dir)


def from_bins(g: Grid, value: str, keep: str = "true", before: str = "") -> str:
    """hs by grp and step; value: of a bin, from n (its density), m (the spectrum's largest), df0 (its width as written), i and j."""
    fr = ", ".join(f"({i}, {D.double(f)}, {D.double(d)}, {D.double(w)})" for i, (f, d, w) in enumerate(zip(g.f, g.df, D.EMB.df)))
    return f"""WITH fr(i, f, df, df0) AS (VALUES {fr}),
raw AS (SELECT vec_id AS k, unnest(range(64)) AS p, abs(CAST(unnest(embedding) AS DOUBLE)) AS n FROM embeddings),
b AS (SELECT k, p // 8 AS i, p % 8 AS j, n, max(n) OVER (PARTITION BY k) AS m FROM raw),
e AS (SELECT k, i, sum(CASE WHEN {keep} THEN {value} ELSE 0 END) * 45.0 AS e, any_value(df) AS df FROM b JOIN fr USING (i) GROUP BY k, i)
SELECT k % 50 AS grp, k // 50 AS step, round(4 * sqrt(sum(e * df) + {D.double(g.tail())} * max(CASE WHEN i = 7 THEN e END)), 5) + 0.0 AS hs FROM e GROUP BY k"""


EXACT = from_bins(D.EMB, "n")


def round_trip(kind: str, engine: str | None = None, by: list[str] | None = None):
    def run(spark, sf_dir):
        path, keys = scratch(spark, kind), by or ["grp"]
        writers.to_files(placed(spark, sf_dir), path, kind, keys)
        return described(text.read(spark, path + "/*" * len(keys) + "/*.txt", engine or kind), ["hs"])

    return run


query("swan_files", from_bins(rounded_grid(5), "round_even(n / (m / 9998), 0) * CAST(printf('%.8e', m / 9998) AS DOUBLE)"))(round_trip("swan"))
query("octopus_files", from_bins(rounded_grid(5), "CAST(printf('%.5f', n * df0 * 45.0) AS DOUBLE) / (df * 45.0)"))(round_trip("octopus"))
query("json_files", EXACT)(round_trip("json"))


@query("octopus_one_file", from_bins(rounded_grid(5), "CAST(printf('%.5f', n * df0 * 45.0) AS DOUBLE) / (df * 45.0)"))
def octopus_one_file(spark, sf_dir):
    """One packed file of all sites, put together from the parts of tasks."""
    path = _uri(scratch(spark, "one")) + ".oct.gz"
    single.to_octopus(placed(spark, sf_dir), path)
    return described(text.read(spark, path, "octopus"), ["hs"])


@query("swan_cycles", "SELECT file_start, count(*) AS n, count(DISTINCT step) AS steps FROM (SELECT k % 50 AS grp, k // 50 AS step, min(k // 50) OVER (PARTITION BY k % 50) AS file_start FROM (SELECT vec_id AS k FROM embeddings)) WHERE step <= file_start + 4 GROUP BY file_start")
def swan_cycles(spark, sf_dir):
    path = scratch(spark, "swan")
    writers.to_files(placed(spark, sf_dir), path, "swan", ["grp"])
    df = multi.read_swans(spark, path + "/*/*.txt", ndays=4 / 24).df
    hours = lambda c: F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2020-01-01 00:00:00'"), F.col(c))
    return df.groupBy(hours("cycle").alias("file_start")).agg(F.count("*").alias("n"), F.countDistinct("time").alias("steps"))


_TILES = """WITH b AS (SELECT vec_id % 10 AS lon, vec_id // 10 % 10 AS lat, vec_id // 100 AS step, vec_id, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS w FROM embeddings),
p AS (SELECT *, CASE WHEN lat % 2 = 0 THEN 1.6e0 ELSE CASE WHEN lon = 4 THEN 0.2e0 ELSE 0.9e0 END END AS f FROM b),
s AS (SELECT lon, sum(w * f) > sum(w) AS first FROM p WHERE lon IN (4, 5) GROUP BY lon)
SELECT p.vec_id, CASE WHEN p.lon < 4 OR coalesce(s.first, false) THEN 'a' ELSE 'b' END AS tile FROM p LEFT JOIN s USING (lon)"""


@query("hot_tiles", _TILES)
def hot_tiles(spark, sf_dir):
    """Two tiles with two columns in common: each column is one tile's as a whole, though at half of its places the other has more energy."""
    fr = D.embeddings(spark, sf_dir)
    k = F.col("vec_id")
    df = fr.df.withColumns({"lon": F.pmod(k, F.lit(10)).cast("double"), "lat": F.pmod(F.floor(k / 10), F.lit(10)).cast("double"), "time": F.timestamp_seconds(F.floor(k / 100)).cast("timestamp_ntz")})
    factor = F.when(F.pmod("lat", F.lit(2)) == 0, 1.6).otherwise(F.when(F.col("lon") == 4, 0.2).otherwise(0.9))
    one = df.where("lon <= 5").withColumn(EFTH, F.when(F.col("lon") >= 4, F.transform(EFTH, lambda x: x * factor)).otherwise(F.col(EFTH))).withColumn("file", F.lit("a"))
    two = df.where("lon >= 4").withColumn("file", F.lit("b"))
    return multi.merge_tiles(fr.with_df(one.union(two))).df.select("vec_id", F.col("file").alias("tile"))


@query("native_parquet", EXACT)
def native_parquet(spark, sf_dir):
    path = scratch(spark, "native")
    models.write_parquet(placed(spark, sf_dir), path, "site")
    return described(models.read_parquet(spark, path), ["hs"])


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


@query("netcdf_files", EXACT)
def netcdf_files(spark, sf_dir):
    folder = _uri(scratch(spark, "netcdf"))
    netcdf.to_netcdf(placed(spark, sf_dir), folder, ["site"], packed=False)
    return described(netcdf.read(spark, folder + "/*.nc"), ["hs"])


@query("netcdf_packed", from_bins(D.EMB, "round_even(n / 1e-5, 0) * 1e-5"))
def netcdf_packed(spark, sf_dir):
    """Densities as whole numbers, read in ranges of four records."""
    folder = _uri(scratch(spark, "netcdf"))
    netcdf.to_netcdf(placed(spark, sf_dir), folder, ["site"])
    return described(netcdf.read(spark, folder + "/*.nc", range_bytes=4 * 4 * D.EMB.size), ["hs"])


@query("netcdf_ranges", "WITH r AS (SELECT vec_id AS k, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) SELECT k % 50 AS grp, k // 50 AS step, r AS position FROM r")
def netcdf_ranges(spark, sf_dir):
    """One file of all spectra, written by one task as they come in order and read by many, each its own records."""
    folder = _uri(scratch(spark, "netcdf"))
    fr = D.embeddings(spark, sf_dir, "grp", "step")
    time = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, vec_id)")
    netcdf.to_netcdf(fr.with_df(fr.df.withColumns({"time": time, "all": F.lit("all")})), folder, ["all"])
    back = netcdf.read(spark, folder, tasks=16, range_bytes=20 * 4 * D.EMB.size).df
    rows = ST.stats(SpectraFrame(back, D.EMB), ["hs"]).withColumn("vec_id", F.timestamp_diff("SECOND", F.expr("timestamp_ntz'2020-01-01 00:00:00'"), F.col("time")))
    known = D.table(spark, sf_dir, "embeddings").select("vec_id")
    return rows.join(known, "vec_id").where("hs > 0").select(F.col("grp").cast("long").alias("grp"), F.col("step").cast("long").alias("step"), F.col("vec_id").alias("position"))


@query("ww3_files", EXACT)
def ww3_files(spark, sf_dir):
    folder = _uri(scratch(spark, "ww3"))
    netcdf.to_netcdf(placed(spark, sf_dir), folder, ["site"], "ww3", packed=False)
    return described(netcdf.read(spark, folder + "/*.nc", "ww3"), ["hs"])


@query("ww3_packed", from_bins(D.EMB, "round_even(n * (180 / pi()) / 1e-5, 0) * 1e-5 * (pi() / 180)"))
def ww3_packed(spark, sf_dir):
    folder = _uri(scratch(spark, "ww3"))
    netcdf.to_netcdf(placed(spark, sf_dir), folder, ["site"], "ww3")
    return described(netcdf.read(spark, folder + "/*.nc", "ww3"), ["hs"])


@query("zarr_store", EXACT)
def zarr_store(spark, sf_dir):
    """A store in chunks of times and sites, with chunks that no spectrum is in."""
    folder = _uri(scratch(spark, "zarr"))
    fr = placed(spark, sf_dir)
    zarr.to_zarr(fr.with_df(fr.df.drop("lon", "lat")), folder, ["time", "site"], {"time": 4, "site": 12})
    back = zarr.read(spark, folder)
    rows = back.df.where(~F.isnan(F.get(EFTH, F.lit(0)))).withColumn("lon", F.col("site").cast("double"))
    return described(back.with_df(rows), ["hs"])


_BY_VEC = "SELECT k AS vec_id, round(hs, 5) + 0.0 AS hs FROM h"


def by_vec(frame: SpectraFrame, key: str, *more: str):
    return ST.stats(frame, ["hs"]).select(F.col(key).cast("long").alias("vec_id"), (F.round("hs", 5) + F.lit(0.0)).alias("hs"), *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in more))


@query("ww3_names", f"WITH {D.emb_sql()} SELECT k AS vec_id, round(hs, 5) + 0.0 AS hs, round(dm, 5) + 0.0 AS dm FROM h JOIN (SELECT k, fmod(270 - degrees(atan2(sum(ms), sum(mc))) + 360, 360) AS dm FROM o GROUP BY k) USING (k)")
def ww3_names(spark, sf_dir):
    fr = D.embeddings(spark, sf_dir, "lon", "lat", "wspd", "wdir", "dpt")
    df, axes = writers.ww3_form(fr.with_df(fr.df.withColumnRenamed("vec_id", "site")))
    back = models.from_dataframe(df, freq=axes["frequency"], dir=axes["direction"])
    return by_vec(_with(back, "dm"), "site", "dm")


def _with(frame: SpectraFrame, stat: str) -> SpectraFrame:
    """The frame with a statistic as a column."""
    return frame.with_df(ST.stats(frame.with_df(frame.df.withColumn("__e", F.col(EFTH))), [stat]).withColumnRenamed("__e", EFTH))


_WIND = "sqrt(pow(vec_id % 7 - 3, 2) + pow(vec_id % 11 - 5.5, 2)) AS wspd"


@query("ncswan_names", f"WITH {D.emb_sql()} SELECT k AS vec_id, round(hs, 5) + 0.0 AS hs, round(wspd, 5) + 0.0 AS wspd FROM h JOIN (SELECT vec_id AS k, {_WIND} FROM embeddings) USING (k)")
def ncswan_names(spark, sf_dir):
    fr = D.embeddings(spark, sf_dir, "lon", "lat")
    k = F.col("vec_id")
    df = fr.df.select(k.alias("points"), F.transform(EFTH, lambda x: x * (180 / math.pi)).alias("density"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), (F.pmod(k, F.lit(7)) - 3.0).alias("xwnd"), (F.pmod(k, F.lit(11)) - 5.5).alias("ywnd"))
    return by_vec(models.from_dataframe(df, freq=D.EMB.freq, dir=[math.radians(d) for d in D.EMB.dir]), "site", "wspd")


@query("wwm_names", f"WITH {D.emb_sql()} {_BY_VEC}")
def wwm_names(spark, sf_dir):
    fr = D.embeddings(spark, sf_dir)
    sigma = [2 * math.pi * f for f in D.EMB.freq]
    unit = F.lit([s * 2 * math.pi * math.pi / 180 for s in sigma for _ in range(8)])
    df = fr.df.select(F.col("vec_id").alias("nbstation"), F.zip_with(EFTH, unit, lambda x, w: x / w).alias("AC"))
    return by_vec(models.from_dataframe(df, spsig=sigma, spdir=[math.radians(d) for d in D.EMB.dir]), "site")


@query("era5_names", f"WITH {D.emb_sql()} {_BY_VEC}")
def era5_names(spark, sf_dir):
    fr = D.embeddings(spark, sf_dir)
    df = fr.df.select(F.col("vec_id").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), F.transform(EFTH, lambda x: F.log10(x * (180 / math.pi))).alias("d2fd"))
    return by_vec(models.from_dataframe(df, nf=8, nd=8, f0=0.05, step=1.35), "lat")


@query("ndbc_names", f"WITH {D.grid_sql(D.EMB)}, e AS (SELECT vec_id AS k, unnest(range(64)) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS e FROM embeddings) SELECT k AS vec_id, round(4 * sqrt(sum(e * df) + {D.EMB.tail()!r} * max(CASE WHEN i = 7 THEN e END)), 5) + 0.0 AS hs FROM e JOIN fr USING (i) GROUP BY k")
def ndbc_names(spark, sf_dir):
    fr = D.embeddings(spark, sf_dir)
    part = lambda k, f=1.0: F.transform(F.slice(EFTH, 8 * k + 1, 8), lambda x: x * f)
    df = fr.df.select(F.col("vec_id").alias("site"), part(0).alias("spectral_wave_density"), part(1, 90.0).alias("mean_wave_dir"), part(2, 90.0).alias("principal_wave_dir"), part(3, 0.2).alias("wave_spectrum_r1"), part(4, 0.1).alias("wave_spectrum_r2"))
    return by_vec(models.from_dataframe(df, freq=D.EMB.freq), "site")


def _stream(spark, sf_dir: str, table: str, most: int | None = 4):
    """A table as a stream of its files, so many at a time or all at once; it may be one file or a folder."""
    path = f"{sf_dir}/{table}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = rows.option("maxFilesPerTrigger", most) if most else rows
    return rows.parquet(path) if folder else rows.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@query("stream_stats", f"WITH {D.emb_sql()} {_BY_VEC}")
def stream_stats(spark, sf_dir):
    """Statistics are a projection, so a stream of spectra gives a stream of them."""
    D.prepare(spark)
    rows = _stream(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias(EFTH))
    out = ST.stats(SpectraFrame(rows, D.EMB), ["hs"]).select("vec_id", (F.round("hs", 5) + F.lit(0.0)).alias("hs"))
    path = scratch(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("source_swan", from_bins(rounded_grid(5), "round_even(n / (m / 9998), 0) * CAST(printf('%.8e', m / 9998) AS DOUBLE)"))
def source_swan(spark, sf_dir):
    """Written and read by the registered source; files are read in ranges of bytes."""
    path = scratch(spark, "source")
    plugins.save(placed(spark, sf_dir), path, ["site"])
    return described(plugins.load(spark, "swan", path, partitionBytes=20_000), ["hs"])


@query("source_filter", "SELECT k % 50 AS grp, count(*) AS n, min(k // 50) AS first, max(k // 50) AS last FROM (SELECT vec_id AS k FROM embeddings) WHERE k // 50 >= 3 AND k // 50 < 12 AND k % 50 <= 40 GROUP BY k % 50")
def source_filter(spark, sf_dir):
    """Two columns of the files, with filters that the source applies before it reads a spectrum."""
    path = scratch(spark, "source")
    plugins.save(placed(spark, sf_dir), path, ["site"])
    rows = spark.read.format("seastate.swan").schema("time timestamp_ntz, lon double").load(path)
    rows = rows.where("time >= timestamp_ntz'2020-01-01 03:00:00' AND time < timestamp_ntz'2020-01-01 12:00:00' AND lon <= 40")
    step = F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2020-01-01 00:00:00'"), F.col("time"))
    return rows.groupBy(F.round("lon").cast("long").alias("grp")).agg(F.count("*").alias("n"), F.min(step).alias("first"), F.max(step).alias("last"))


@query("source_stream", from_bins(rounded_grid(5), "round_even(n / (m / 9998), 0) * CAST(printf('%.8e', m / 9998) AS DOUBLE)"))
def source_stream(spark, sf_dir):
    """Files that arrive in two lots, as a stream that stops and starts again."""
    path, all_of_them = scratch(spark, "stream"), placed(spark, sf_dir)
    for lot in (0, 1):
        plugins.save(all_of_them.with_df(all_of_them.df.where(F.pmod(F.xxhash64("site"), F.lit(2)) == lot)), f"{path}/in", ["site"], mode="append")
        rows = spark.readStream.format("seastate.swan").options(path=f"{path}/in", log=f"{path}/log", **plugins.grid_options(rounded_grid(5))).load()
        out = rows.select("time", "lon", EFTH).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return described(all_of_them.with_df(spark.read.parquet(f"{path}/out"), rounded_grid(5)), ["hs"])


@query("track_stream", """WITH p AS (SELECT user_id, epoch_us(ts) AS t, 0.06e0 + 0.001e0 * (event_id % 60) AS fp, event_id * 37 % 360 AS d FROM events),
l AS (SELECT *, (t - lag(t) OVER w) / 1e6 * 9.81 / (4 * pi() * 1e6) AS rise, abs(fp - lag(fp) OVER w) AS df, abs(d - lag(d) OVER w) AS dd FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT CAST(user_id AS VARCHAR) AS site, t AS at, CAST(sum(CASE WHEN df < rise AND least(dd, 360 - dd) < 90 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) - 1 AS INTEGER) AS track_id FROM l""")
def track_stream(spark, sf_dir):
    """The tracks of track_events from a stream, with typed state, a watermark and timers."""
    k, path = F.col("event_id"), scratch(spark, "tracks")
    rows = _stream(D.prepare(spark), sf_dir, "events", None)
    rows = rows.select(F.col("user_id").cast("string").alias("site"), F.col("ts").cast("timestamp").alias("time"), F.lit(0).alias("part"), (0.06 + 0.001 * F.pmod(k, F.lit(60))).alias("fp"), F.pmod(k * 37, F.lit(360)).cast("double").alias("dpm"), F.lit(9.0).alias("wspd"))
    out = STR.track_stream(rows, nsea=0, ddpm_swell_max=90.0).select("site", F.unix_micros("time").alias("at"), "track_id")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    """The latest row of each key from a stream, batch by batch."""
    path = scratch(spark, "latest")
    rows = _stream(D.prepare(spark), sf_dir, "events").select("user_id", "event_id")
    sink = STR.upsert(f"{path}/table", ["user_id"], "event_id")
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return STR.latest(spark, f"{path}/table")
