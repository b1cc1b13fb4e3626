"""Site selection: nearest neighbour, inverse distance and box. Requests and sites meet in cells as wide as the tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import EFTH, SpectraFrame


def convention(frame: SpectraFrame, lon: str) -> tuple[bool, bool]:
    """Whether the longitudes of the frame fit -180..180 and 0..360."""
    r = frame.df.agg(F.min(lon).alias("a"), F.max(lon).alias("b")).first()
    return (r["a"] or 0) < 0 or (r["b"] or 0) <= 180, (r["a"] or 0) >= 0


def to_convention(lons: list[float], is_180: bool, is_360: bool) -> list[float]:
    """Requested longitudes in the convention of the sites."""
    if any(x < 0 for x in lons) and is_360 and not is_180:
        return [x % 360 for x in lons]
    if any(x < 0 for x in lons) and is_360:  # sites between 0 and 180 fit both
        return lons
    if any(x > 180 for x in lons) and not is_360:
        return [x - 360 if x > 180 else x for x in lons]
    return lons


def requests(frame: SpectraFrame, lons, lats, lon: str) -> list[tuple[int, float, float]]:
    lons, lats = [float(x) for x in lons], [float(x) for x in lats]
    if len(lons) != len(lats) or not lons:
        raise ValueError("as many longitudes as latitudes are needed, one at least")
    return list(enumerate_(to_convention(lons, *convention(frame, lon)), lats))


def enumerate_(lons, lats):
    for k, (x, y) in enumerate(zip(lons, lats)):
        yield k, x, y


def distances(frame: SpectraFrame, wanted: list[tuple[int, float, float]], tolerance: float, site: str, lon: str, lat: str) -> DataFrame:
    """(request, rlon, rlat, site, distance) of requests and distinct sites within tolerance, in degrees, without wrapping round.

    Sites are dealt to cells as wide as the tolerance, requests to their own cell and those around it; the two meet by
    an equi-join, so only near pairs are made, however many requests there are.
    """
    spark, width = frame.df.sparkSession, max(float(tolerance), 1e-6)
    cell = lambda c: F.floor(F.col(c) / width)
    sites = frame.df.groupBy(site).agg(F.min(lon).alias("__x"), F.min(lat).alias("__y")).withColumns({"__i": cell("__x"), "__j": cell("__y")})
    asked = spark.createDataFrame(wanted, "request int, rlon double, rlat double")
    around = F.array(*[F.struct((cell("rlon") + a).alias("__i"), (cell("rlat") + b).alias("__j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asked = asked.select("request", "rlon", "rlat", F.explode(around).alias("c")).select("request", "rlon", "rlat", "c.*")
    rows = sites.join(asked, ["__i", "__j"])
    distance = F.sqrt(F.pow(F.col("__x") - F.col("rlon"), F.lit(2.0)) + F.pow(F.col("__y") - F.col("rlat"), F.lit(2.0)))
    return rows.select("request", "rlon", "rlat", site, distance.alias("distance")).where(F.col("distance") <= width)


def nearest(frame: SpectraFrame, lons, lats, tolerance: float = 2.0, unique: bool = False, exact: bool = False, missing: str = "raise", site: str = "site", lon: str = "lon", lat: str = "lat") -> SpectraFrame:
    """Spectra of the site nearest to each request (column request; of equally near sites the first).

    A request without a site within tolerance (exact: at distance 0) raises, or is left out if missing is "ignore".
    unique keeps each site once, for its first request.
    """
    wanted = requests(frame, lons, lats, lon)
    best = distances(frame, wanted, 1e-9 if exact else tolerance, site, lon, lat).groupBy("request").agg(F.min(F.struct("distance", F.col(site).alias("at"))).alias("b"))
    best = best.select("request", F.col("b.at").alias(site), F.col("b.distance").alias("distance")).where(F.col("distance") <= (1e-9 if exact else tolerance))
    found = best.collect()  # a row for each request at most
    if missing == "raise" and len(found) < len(wanted):
        raise ValueError(f"no site for requests {sorted({k for k, _, _ in wanted} - {r['request'] for r in found})}")
    if unique:
        best = best.groupBy(site).agg(F.min("request").alias("request"))
    return frame.with_df(frame.df.join(best.select("request", site), site))


def idw(frame: SpectraFrame, lons, lats, times: list[str], tolerance: float = 2.0, max_sites: int = 4, site: str = "site", lon: str = "lon", lat: str = "lat") -> SpectraFrame:
    """Spectra at each request by inverse distance: the nearest max_sites sites within tolerance, weighing 1 / distance.

    A site at distance 0 is taken alone. With no site, or one that isn't at distance 0, the spectrum is NaN. times: the
    columns that tell spectra of a site apart. Number columns are averaged in the same way; directions too, without a turn.
    """
    wanted = requests(frame, lons, lats, lon)
    order = Window.partitionBy("request").orderBy("distance", site)
    near = distances(frame, wanted, tolerance, site, lon, lat).where(F.col("distance") <= tolerance).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_sites)
    per = Window.partitionBy("request")
    near = near.withColumn("__zero", F.min("distance").over(per) == 0).where(~F.col("__zero") | (F.col("__n") == 1))
    near = near.withColumn("__w", F.when(F.col("__zero"), 1.0).otherwise(1 / F.col("distance"))).withColumn("__ok", F.col("__zero") | (F.count("*").over(per) > 1))
    numbers = [c for c, t in frame.df.dtypes if t in ("double", "float") and c not in (lon, lat, *times)]
    rows = frame.df.join(near.select("request", "rlon", "rlat", site, "__w", "__ok"), site)
    # at most max_sites spectra of a request and time come together, weighted before; their arrays are summed up bin by bin
    own = F.struct(F.col("__w"), F.col("__ok"), F.transform(EFTH, lambda x: x * F.col("__w")).alias("__e"), *(F.col(c).cast("double").alias(c) for c in numbers))
    met = rows.groupBy("request", "rlon", "rlat", *times).agg(F.sort_array(F.collect_list(own)).alias("s"))
    whole = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["__w"])
    ok = F.get("s", F.lit(0))["__ok"]
    summed = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0))["__e"], lambda a, x: F.zip_with(a, x["__e"], lambda p, q: p + q))
    nan = F.lit(float("nan"))
    mean = lambda c: F.when(ok, F.aggregate("s", F.lit(0.0), lambda a, x: a + x[c] * x["__w"]) / F.col("__whole")).otherwise(nan)
    met = met.withColumn("__whole", whole)
    efth = F.transform(summed, lambda x: F.when(ok, x / F.col("__whole")).otherwise(nan))
    out = met.select("request", F.col("rlon").alias(lon), F.col("rlat").alias(lat), *times, *(mean(c).alias(c) for c in numbers), efth.alias(EFTH))
    return frame.with_df(out)


def inside(lons, lats, tolerance: float, is_180: bool, is_360: bool, lon: str, lat: str) -> Column:
    """Whether a site lies in the box; a box that crosses the sites' date line is two ranges."""
    west, east, south, north = min(lons) - tolerance, max(lons) + tolerance, min(lats) - tolerance, max(lats) + tolerance
    x = F.col(lon)
    if west < 0 and is_360 and not is_180:
        across = F.col(lon).between(west % 360, 360) | F.col(lon).between(0, east) if east >= 0 else F.col(lon).between(west % 360, east % 360)
    elif east > 180 and not is_360:
        across = x.between(west, 180) | x.between(-180, east - 360) if west <= 180 else x.between(west - 360, east - 360)
    else:
        across = x.between(west, east)
    return across & F.col(lat).between(south, north)


def bbox(frame: SpectraFrame, lons, lats, tolerance: float = 0.0, lon: str = "lon", lat: str = "lat") -> SpectraFrame:
    """Spectra of the sites within the box of the longitudes and latitudes; none raises."""
    out = frame.df.where(inside([float(x) for x in lons], [float(x) for x in lats], tolerance, *convention(frame, lon), lon, lat))
    if out.isEmpty():
        raise ValueError("no site in the box")
    return frame.with_df(out)


def sel(frame: SpectraFrame, lons, lats, method: str | None = "idw", tolerance: float = 2.0, **kw) -> SpectraFrame:
    """Selection by "idw", "nearest", "bbox" or None (exact positions)."""
    if method == "idw":
        return idw(frame, lons, lats, tolerance=tolerance, **kw)
    if method == "nearest":
        return nearest(frame, lons, lats, tolerance=tolerance, **kw)
    if method == "bbox":
        return bbox(frame, lons, lats, tolerance=tolerance, **kw)
    if method is None:
        return nearest(frame, lons, lats, exact=True, **kw)
    raise ValueError(f"no such method: {method}")


def unique_times(frame: SpectraFrame, time: str, order: list[str], keys: list[str] | None = None) -> SpectraFrame:
    """The first spectrum of each time (and keys) in the order of other columns."""
    w = Window.partitionBy(time, *(keys or [])).orderBy(*order)
    return frame.with_df(frame.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))


def combine_first(first: SpectraFrame, second: SpectraFrame, keys: list[str]) -> SpectraFrame:
    """The spectra of both frames by their keys; what the first one lacks (rows, null columns, null or NaN bins) comes from the second."""
    if first.grid != second.grid:
        raise ValueError("the grids differ")
    a, b = first.df.alias("a"), second.df.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    known = lambda x: F.when(x.isNotNull() & ~F.isnan(x), x)
    bins = F.zip_with(F.col(f"a.{EFTH}"), F.col(f"b.{EFTH}"), lambda x, y: F.coalesce(known(x), y, x))
    out = []
    for c in dict.fromkeys([*first.df.columns, *second.df.columns]):
        sides = [F.col(f"{n}.{c}") for n, d in (("a", first.df), ("b", second.df)) if c in d.columns]
        out.append(F.coalesce(*([bins] if c == EFTH else []), *sides).alias(c))
    return first.with_df(both.select(*out))
