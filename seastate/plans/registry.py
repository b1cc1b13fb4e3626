"""Names of the queries that the driver may run, with their oracle SQL.

Queries run over spectra derived from the driver's tables (see derived). Numbers are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..functions import scalars as S
from ..grid import Grid
from ..operators import construct as C
from ..operators import partition as P
from ..operators import select as SE
from ..operators import shape as SH
from ..operators import stats as ST
from ..operators import tracking as TR
from . import derived as D
from . import sources as SO

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Number columns other than keys rounded; -0 becomes 0."""
    return df.select(*keys, *((F.round(c, digits) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys))


# Statistics of the embeddings' spectra: name, keyword arguments, SQL over emb_sql()'s tables with columns k and v.
_R = "round({}, 6) + 0.0"
_STATS: dict[str, tuple[str, dict, str]] = {
    "hs": ("hs", {}, "SELECT k, hs AS v FROM h"),
    "hs_no_tail": ("hs", {"tail": False}, "SELECT k, 4 * sqrt(m0) AS v FROM h"),
    "hrms": ("hrms", {}, "SELECT k, sqrt(8 * (m0 + tail)) AS v FROM h"),
    "hmax": ("hmax", {}, "SELECT k, 1.86 * hs AS v FROM h"),
    "hmax_interval": ("hmax", {"dt": 3600.0}, "SELECT k, sqrt(0.5 * ln(round_even(3600.0 / sqrt(m0 / m2), 0))) * hs AS v FROM h"),
    "momf0": ("momf", {"mom": 0}, "SELECT k, m0 AS v FROM m"),
    "momf1": ("momf", {"mom": 1}, "SELECT k, m1 AS v FROM m"),
    "momf2": ("momf", {"mom": 2}, "SELECT k, m2 AS v FROM m"),
    "momf4": ("momf", {"mom": 4}, "SELECT k, m4 AS v FROM m"),
    "tm01": ("tm01", {}, "SELECT k, m0 / m1 AS v FROM m"),
    "tm02": ("tm02", {}, "SELECT k, sqrt(m0 / m2) AS v FROM m"),
    "dm": ("dm", {}, "SELECT k, fmod(270 - degrees(atan2(sum(ms), sum(mc))) + 360, 360) AS v FROM o GROUP BY k"),
    "dp": ("dp", {}, "SELECT k, arg_max(th, s - j * 1e-12) AS v FROM (SELECT k, j, th, sum(n) AS s FROM b GROUP BY k, j, th) GROUP BY k"),
    "dpm": ("dpm", {}, "SELECT k, CASE WHEN rn = 1 THEN fmod(270 - degrees(atan2(ms, mc)) + 360, 360) END AS v FROM ids LEFT JOIN pk USING (k)"),
    "dspr": ("dspr", {}, "SELECT k, sqrt(2 * pow(180 / pi(), 2) * (1 - sqrt(pow(sum(ms * df), 2) + pow(sum(mc * df), 2)) / sum(e * df))) AS v FROM o GROUP BY k"),
    "dpspr": ("dpspr", {}, "SELECT k, sqrt(2 * pow(180 / pi(), 2) * (1 - sqrt(ms * ms + mc * mc) / e)) AS v FROM ids LEFT JOIN pk USING (k)"),
    "tp_smooth": ("tp", {}, "SELECT k, tp AS v FROM ids LEFT JOIN tps USING (k)"),
    "tp_discrete": ("tp", {"smooth": False}, "SELECT k, 1 / fd AS v FROM ids LEFT JOIN tps USING (k)"),
    "fp": ("fp", {}, "SELECT k, 1 / tp AS v FROM ids LEFT JOIN tps USING (k)"),
    "swe": ("swe", {}, "SELECT k, CASE WHEN sqrt(greatest(1 - m2 * m2 / (m0 * m4), 0)) < 0.001 THEN 1 ELSE sqrt(greatest(1 - m2 * m2 / (m0 * m4), 0)) END AS v FROM m"),
    "sw": ("sw", {}, "SELECT k, CASE WHEN hs >= 0.001 THEN sqrt(greatest(m0 * m2 / (m1 * m1) - 1, 0)) END AS v FROM h"),
    "gw": ("gw", {}, "SELECT k, CASE WHEN x >= 0 THEN sqrt(x) END AS v FROM (SELECT k, (m0 + tail) / (m0 / m2) - pow(m0 + tail, 2) / pow(m0 / m1, 2) AS x FROM m)"),
    "goda": ("goda", {}, "SELECT k, 2 * sum(e * e * f * df) / pow(sum(e * df), 2) AS v FROM o GROUP BY k"),
    "gamma": ("gamma", {}, """SELECT k, CASE WHEN y >= 1 THEN y ELSE 1 END AS v FROM (SELECT k, 0.12974958 + 0.32524949 * x + 0.64087366 * x * x - 0.13543292 * x * x * x + 0.0378375 * x * x * x * x AS y
        FROM (SELECT k, mx / (0.3125 * hs * hs * 0.2865048 * tp) AS x FROM ids JOIN h USING (k) JOIN (SELECT k, max(e) AS mx FROM o GROUP BY k) USING (k) LEFT JOIN tps USING (k)))"""),
    "gamma_unscaled": ("gamma", {"scaled": False}, "SELECT k, CASE WHEN mx / (0.3125 * hs * hs * 0.2865048 * tp) >= 1 THEN mx / (0.3125 * hs * hs * 0.2865048 * tp) ELSE 1 END AS v FROM ids JOIN h USING (k) JOIN (SELECT k, max(e) AS mx FROM o GROUP BY k) USING (k) LEFT JOIN tps USING (k)"),
    "alpha": ("alpha", {}, """SELECT k, CASE WHEN tp IS NOT NULL THEN pow(2 * pi(), 4) / (9.81 * 9.81) * sv / sn END AS v FROM (
        SELECT k, tp, sum(CASE WHEN used THEN t END) AS sv, count(*) FILTER (WHERE used) AS sn FROM (
          SELECT *, CASE WHEN cnt > 1 THEN ins WHEN cnt = 1 THEN i = first OR i = first + 1 ELSE i >= 6 END AS used FROM (
            SELECT *, sum(CAST(ins AS INT)) OVER (PARTITION BY k) AS cnt, min(CASE WHEN ins THEN i END) OVER (PARTITION BY k) AS first FROM (
              SELECT o.k, i, tp, coalesce(f > 1.35 / tp AND f < 2 / tp, false) AS ins, e * pow(f, 5) * exp(1.25 * pow(1 / tp / f, 4)) AS t FROM o LEFT JOIN tps USING (k)))) GROUP BY k, tp)"""),
    "uss": ("uss", {}, "SELECT k, sum(e * df * 4 * pi() * f * (2 * pi() * f * f / 1.56)) AS v FROM o GROUP BY k"),
    "uss_x": ("uss_x", {}, "SELECT k, sum(mc * df * 4 * pi() * f * (2 * pi() * f * f / 1.56)) AS v FROM o GROUP BY k"),
    "uss_y": ("uss_y", {}, "SELECT k, sum(ms * df * 4 * pi() * f * (2 * pi() * f * f / 1.56)) AS v FROM o GROUP BY k"),
    "mss": ("mss", {}, "SELECT k, sum(e * df * pow(2 * pi() * f * f / 1.56, 2)) AS v FROM o GROUP BY k"),
    "uss_depth": ("uss", {"depth": 25.0}, "SELECT k, sum(e * df * 4 * pi() * f * wk) AS v FROM (SELECT *, yy * sqrt(1 + 1 / (yy * (1 + 0.6522 * yy + 0.4622 * pow(yy, 2) + 0.0864 * pow(yy, 4) + 0.0675 * pow(yy, 5)))) / 25.0 AS wk FROM (SELECT *, 0.10194 * pow(2 * pi() * f, 2) * 25.0 AS yy FROM o)) GROUP BY k"),
    "mss_depth": ("mss", {"depth": 25.0}, "SELECT k, sum(e * df * wk * wk) AS v FROM (SELECT *, yy * sqrt(1 + 1 / (yy * (1 + 0.6522 * yy + 0.4622 * pow(yy, 2) + 0.0864 * pow(yy, 4) + 0.0675 * pow(yy, 5)))) / 25.0 AS wk FROM (SELECT *, 0.10194 * pow(2 * pi() * f, 2) * 25.0 AS yy FROM o)) GROUP BY k"),
}


def _stat(name: str, stat: str, kw: dict):
    def run(spark, sf):
        return rounded(ST.stats(D.embeddings(spark, sf), {stat: kw}, names=[name]), ["vec_id"])

    return run


for _name, (_stat_name, _kw, _body) in _STATS.items():
    _queries[_name] = _stat(_name, _stat_name, _kw)
    _sql[_name] = f"WITH {D.emb_sql()} SELECT k AS vec_id, {_R.format('v')} AS {_name} FROM ({_body})"


def near(x: str, digits: int):
    """x rounded half away from 0, as SQL does; without decimals of any size where a long holds the digits, as rows of bins are many."""
    own, unit = F.col(x), 10.0**digits
    return F.when(F.abs(own) < 2.0**50 / unit, F.signum(own) * (F.floor(F.abs(own) * unit + 0.5) / unit)).otherwise(F.round(own, digits)) + F.lit(0.0)


def binned(frame: SpectraFrame, keys: list[str], value: str = "value", digits: int = 6) -> DataFrame:
    """A row for each bin, with index columns and the rounded value."""
    g = frame.grid
    rows = frame.df.select(*keys, F.posexplode(EFTH).alias("p", "x"))
    at = [F.floor(F.col("p") / g.nd).cast("int").alias("i")] + ([F.pmod("p", F.lit(g.nd)).alias("j")] if g.dir is not None else [])
    return rows.select(*keys, *at, near("x", digits).alias(value))


def by_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + F.lit(0.0)).alias(column))


def emb(body: str) -> str:
    return f"WITH {D.emb_sql()} {body}"


def evt(body: str) -> str:
    return f"WITH {D.evt_sql()} {body}"


@query("stats_multi", emb("""SELECT k AS vec_id, round(hs, 6) + 0.0 AS hs, round(m0 / m1, 6) + 0.0 AS tm01, round(sqrt(m0 / m2), 6) + 0.0 AS tm02, round(tp, 6) + 0.0 AS tp, round(dmv, 6) + 0.0 AS dm
FROM h LEFT JOIN tps USING (k) JOIN (SELECT k, fmod(270 - degrees(atan2(sum(ms), sum(mc))) + 360, 360) AS dmv FROM o GROUP BY k) USING (k)"""))
def stats_multi(spark, sf):
    return rounded(ST.stats(D.embeddings(spark, sf), ["hs", "tm01", "tm02", "tp", "dm"]), ["vec_id"])


@query("oned", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, round(e, 6) + 0.0 AS value FROM o"))
def oned(spark, sf):
    return binned(SH.oned(D.embeddings(spark, sf)), ["vec_id"])


@query("to_energy", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(n * df * 45.0, 6) + 0.0 AS value FROM b"))
def to_energy(spark, sf):
    return binned(SH.to_energy(D.embeddings(spark, sf)), ["vec_id"])


@query("momd", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, round(ms, 6) + 0.0 AS msin, round(mc, 6) + 0.0 AS mcos FROM o"))
def momd(spark, sf):
    fr = D.embeddings(spark, sf)
    both = F.arrays_zip(ST.momd_array(F.col(EFTH), fr.grid, "sin").alias("s"), ST.momd_array(F.col(EFTH), fr.grid, "cos").alias("c"))
    rows = fr.df.select("vec_id", F.posexplode(both).alias("i", "x"))
    return rows.select("vec_id", "i", (F.round("x.s", 6) + F.lit(0.0)).alias("msin"), (F.round("x.c", 6) + F.lit(0.0)).alias("mcos"))


@query("fdspr", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, round(sqrt(2 * pow(180 / pi(), 2) * (1 - sqrt(ms * ms + mc * mc) / e)), 6) + 0.0 AS fdspr FROM o"))
def fdspr(spark, sf):
    return by_frequency(ST.stats(D.embeddings(spark, sf), ["fdspr"]), "fdspr")


@query("crsd", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, round(45.0 * sum(n * s * c), 6) + 0.0 AS crsd FROM b GROUP BY k, i"))
def crsd(spark, sf):
    return by_frequency(ST.stats(D.embeddings(spark, sf), ["crsd"]), "crsd")


@query("stats_by_label", emb("SELECT label, round(avg(hs), 6) AS hs_mean, round(max(hs), 6) AS hs_max, count(*) AS n FROM h JOIN embeddings ON vec_id = k GROUP BY label"))
def stats_by_label(spark, sf):
    return ST.stats(D.embeddings(spark, sf, "label"), ["hs"]).groupBy("label").agg(F.round(F.avg("hs"), 6).alias("hs_mean"), F.round(F.max("hs"), 6).alias("hs_max"), F.count("*").alias("n"))


@query("long_form", emb("SELECT k AS vec_id, CAST(i AS INT) AS ifreq, CAST(j AS INT) AS idir, round(n, 6) + 0.0 AS efth FROM b"))
def long_form(spark, sf):
    return D.embeddings(spark, sf).to_long().select("vec_id", "ifreq", "idir", (F.round(EFTH, 6) + F.lit(0.0)).alias("efth"))


def _split_sql(fmin: float, fmax: float) -> str:
    f = D.EMB.f
    a, b = max(x for x in f if x < fmin), min(x for x in f if x > fmin)
    c, d = max(x for x in f if x < fmax), min(x for x in f if x > fmax)
    inner = [float(x) for x in f if fmin <= x <= fmax]
    new = Grid((fmin, *inner, fmax))
    rows = ", ".join(f"({i}, {float(x)!r}, {float(w)!r})" for i, (x, w) in enumerate(zip(new.f, new.df)))
    return emb(f""", ng(q, f, df) AS (VALUES {rows}),
x AS (SELECT k, j, ng.q, ng.df, CASE WHEN ng.q = 0 THEN lo.n + (hi.n - lo.n) * {float((fmin - a) / (b - a))!r} WHEN ng.q = {new.nf - 1} THEN lo.n + (hi.n - lo.n) * {float((fmax - c) / (d - c))!r} ELSE lo.n END AS n
  FROM ng JOIN (SELECT k, j, i, f, n FROM b) lo ON lo.i = (CASE WHEN ng.q = 0 THEN {int(list(f).index(a))} WHEN ng.q = {new.nf - 1} THEN {int(list(f).index(c))} ELSE ng.q - 1 + {int(list(f).index(inner[0]))} END)
  JOIN (SELECT k AS k2, j AS j2, i AS i2, n FROM b) hi ON hi.k2 = lo.k AND hi.j2 = lo.j AND hi.i2 = least(lo.i + 1, 7))
SELECT k AS vec_id, round(4 * sqrt(sum(n * df * 45.0)), 6) + 0.0 AS hs FROM x GROUP BY k""").replace("ids AS (SELECT DISTINCT k FROM raw) ,", "ids AS (SELECT DISTINCT k FROM raw),")


@query("split_freq", _split_sql(0.06, 0.2))
def split_freq(spark, sf):
    return rounded(ST.stats(SH.split(D.embeddings(spark, sf), 0.06, 0.2), ["hs"]), ["vec_id"])


@query("split_dir", emb("SELECT k AS vec_id, round(4 * sqrt(sum(x) + max(t)), 6) + 0.0 AS hs FROM (SELECT k, i, sum(n) * 45.0 * df AS x, CASE WHEN i = 7 THEN sum(n) * 45.0 * " + repr(D.EMB.tail()) + " ELSE 0 END AS t FROM b WHERE th BETWEEN 90 AND 270 GROUP BY k, i, df) GROUP BY k"))
def split_dir(spark, sf):
    return rounded(ST.stats(SH.split(D.embeddings(spark, sf), dmin=90, dmax=270), ["hs"]), ["vec_id"])


@query("scale_by_hs", emb("SELECT k AS vec_id, round(CASE WHEN hs >= 17.0 THEN 0.5 * hs + 1 ELSE hs END, 6) + 0.0 AS hs FROM h"))
def scale_by_hs(spark, sf):
    return rounded(ST.stats(SH.scale_by_hs(D.embeddings(spark, sf), "0.5*hs + 1", hs_min=17.0), ["hs"]), ["vec_id"])


@query("rmse", emb("SELECT a.k AS vec_id, round(sqrt(sum(pow(a.n * a.df * 45.0 - c.n * a.df * 45.0, 2))) / sqrt(sum(a.n * a.df * 45.0)), 6) + 0.0 AS rmse FROM b a JOIN b c ON c.k = (a.k // 2) * 2 + (1 - a.k % 2) AND a.i = c.i AND a.j = c.j GROUP BY a.k"))
def rmse(spark, sf):
    fr = D.embeddings(spark, sf)
    other = fr.with_df(fr.df.withColumn("vec_id", F.col("vec_id").bitwiseXOR(1)))
    return rounded(SH.rmse(fr, other, ["vec_id"]), ["vec_id"])


def _weights_sql(old: Grid, new: Grid, body: str) -> str:
    """Tables wf(a, i, w) and wd(b, j, w), the non-zero weights of a regridding, in front of a body over emb_sql()."""
    wf, wd = SH.regrid_weights(old, new)
    pairs = lambda m: ", ".join(f"({r}, {c}, {float(m[r, c])!r})" for r, c in zip(*m.nonzero()))
    nf = ", ".join(f"({i}, {float(d)!r}, {float(f)!r})" for i, (d, f) in enumerate(zip(new.df, new.f)))
    own = f""", wf(a, i, w) AS (VALUES {pairs(wf)}), wd(bb, j, w) AS (VALUES {pairs(wd)}), nf(a, df, f) AS (VALUES {nf}),
y AS (SELECT k, a, bb, sum(n * wf.w * wd.w) AS n FROM b JOIN wf USING (i) JOIN wd USING (j) GROUP BY k, a, bb),
full_y AS (SELECT ids.k, nf.a, d.bb, coalesce(y.n, 0) AS n, nf.df FROM ids CROSS JOIN nf CROSS JOIN (SELECT unnest(range({new.nd})) AS bb) d LEFT JOIN y ON y.k = ids.k AND y.a = nf.a AND y.bb = d.bb),
em AS (SELECT k, sum(n * df) * {new.dd!r} + {new.tail()!r} * sum(CASE WHEN a = {new.nf - 1} THEN n ELSE 0 END) * {new.dd!r} AS e FROM full_y GROUP BY k)
"""
    return f"WITH {D.emb_sql()}{own}{body}"


_REGRID = Grid((0.03, 0.06, 0.1, 0.17, 0.3, 0.5), (10.0, 100.0, 190.0, 280.0))


@query("regrid", _weights_sql(D.EMB, _REGRID, "SELECT k AS vec_id, CAST(a AS INT) AS i, CAST(bb AS INT) AS j, round(n * (m0 + tail) / e, 5) + 0.0 AS value FROM full_y JOIN em USING (k) JOIN m USING (k)"))
def regrid(spark, sf):
    return binned(SH.interp(D.embeddings(spark, sf), _REGRID.freq, _REGRID.dir), ["vec_id"], digits=5)


@query("regrid_plain", _weights_sql(D.EMB, _REGRID, "SELECT k AS vec_id, CAST(a AS INT) AS i, CAST(bb AS INT) AS j, round(n, 6) + 0.0 AS value FROM full_y"))
def regrid_plain(spark, sf):
    return binned(SH.interp(D.embeddings(spark, sf), _REGRID.freq, _REGRID.dir, maintain_m0=False), ["vec_id"])


@query("rotate", _weights_sql(Grid(D.EMB.freq, tuple((t + 20.0) % 360 for t in D.EMB.dir)), D.EMB, "SELECT k AS vec_id, CAST(a AS INT) AS i, CAST(bb AS INT) AS j, round(n * (m0 + tail) / e, 5) + 0.0 AS value FROM full_y JOIN em USING (k) JOIN m USING (k)"))
def rotate(spark, sf):
    return binned(SH.rotate(D.embeddings(spark, sf), 20.0), ["vec_id"], digits=5)


@query("smooth", emb("""SELECT x.k AS vec_id, CAST(x.i AS INT) AS i, CAST(x.j AS INT) AS j, round(CASE WHEN x.i BETWEEN 1 AND 6 THEN avg(y.n) ELSE max(x.n) END, 6) + 0.0 AS value
FROM b x JOIN b y ON x.k = y.k AND abs(x.i - y.i) <= 1 AND (abs(x.j - y.j) <= 1 OR abs(x.j - y.j) = 7) GROUP BY x.k, x.i, x.j"""))
def smooth(spark, sf):
    return binned(SH.smooth(D.embeddings(spark, sf)), ["vec_id"])


_WIND = "5.0 + k % 17 AS wspd, CAST(k * 31 % 360 AS DOUBLE) AS wdir, 10.0 + k % 50 AS dpt"


@query("ptm4", emb(f"""SELECT k AS vec_id, CAST(p AS INT) AS part, round(4 * sqrt(sum(x * df) + {D.EMB.tail()!r} * sum(CASE WHEN i = 7 THEN x ELSE 0 END)), 6) + 0.0 AS hs FROM (
  SELECT k, i, df, p, 45.0 * CASE WHEN (p = 0) = sea THEN n ELSE 0 END AS x FROM (
    SELECT *, 2 * pi() * f / (yy * sqrt(1 + 1 / (yy * (1 + 0.6522 * yy + 0.4622 * pow(yy, 2) + 0.0864 * pow(yy, 4) + 0.0675 * pow(yy, 5)))) / dpt) <= 1.7 * wspd * cos(radians(th - wdir)) AS sea
    FROM (SELECT *, 0.10194 * pow(2 * pi() * f, 2) * dpt AS yy FROM (SELECT *, {_WIND} FROM b))) CROSS JOIN (SELECT unnest([0, 1]) AS p)) GROUP BY k, p"""))
def ptm4(spark, sf):
    return rounded(ST.stats(P.ptm4(D.embeddings(spark, sf, "wspd", "wdir", "dpt")), ["hs"]).select("vec_id", "part", "hs"), ["vec_id", "part"])


_FCUT = D.EMB.freq[3]


@query("ptm5", emb(f"""SELECT k AS vec_id, CAST(p AS INT) AS part, round(4 * sqrt(sum(x * df) + {D.EMB.tail()!r} * sum(CASE WHEN i = 7 THEN x ELSE 0 END)), 6) + 0.0 AS hs FROM (
  SELECT k, i, df, p, CASE WHEN (p = 0 AND i >= 3) OR (p = 1 AND i <= 3) THEN e ELSE 0 END AS x FROM o CROSS JOIN (SELECT unnest([0, 1]) AS p)) GROUP BY k, p"""))
def ptm5(spark, sf):
    return rounded(ST.stats(P.ptm5(D.embeddings(spark, sf), _FCUT), ["hs"]).select("vec_id", "part", "hs"), ["vec_id", "part"])


@query("bbox", emb(f"""SELECT k AS vec_id, CAST(p AS INT) AS part, round(4 * sqrt(sum(x * df) + {D.EMB.tail()!r} * sum(CASE WHEN i = 7 THEN x ELSE 0 END)), 6) + 0.0 AS hs FROM (
  SELECT k, i, df, p, 45.0 * CASE WHEN p = (CASE WHEN f <= 0.1 AND th <= 135 THEN 0 WHEN f >= 0.12 AND th >= 180 THEN 1 ELSE 2 END) THEN n ELSE 0 END AS x FROM b CROSS JOIN (SELECT unnest([0, 1, 2]) AS p)) GROUP BY k, p"""))
def bbox(spark, sf):
    parts = P.bbox(D.embeddings(spark, sf), [{"fmax": 0.1, "dmax": 135.0}, {"fmin": 0.12, "dmin": 180.0}])
    return rounded(ST.stats(parts, ["hs"]).select("vec_id", "part", "hs"), ["vec_id", "part"])


@query("merge_parts", emb("SELECT k AS vec_id, round(hs, 6) + 0.0 AS hs FROM h"))
def merge_parts(spark, sf):
    parts = P.bbox(D.embeddings(spark, sf), [{"fmax": 0.1, "dmax": 135.0}, {"fmin": 0.12, "dmin": 180.0}])
    return rounded(ST.stats(P.merge_parts(parts, ["vec_id"]), ["hs"]), ["vec_id"])


# Construction from the events' parameters.
_PARAM = "0.5 + value / 100 AS hs0, 0.06 + 0.001 * (event_id % 60) AS fp0"


def shape_query(name: str, build, sql: str, digits: int = 6):
    def run(spark, sf):
        df = D.parameters(spark, sf).withColumn(EFTH, build())
        return binned(SpectraFrame(df, Grid(D.EVT.freq)), ["event_id"], digits=digits)

    _queries[name] = run
    _sql[name] = sql


_E = "SELECT k AS event_id, CAST(i AS INT) AS i, round({}, 6) + 0.0 AS value FROM {}"
shape_query("pierson_moskowitz", lambda: C.pierson_moskowitz(D.EVT, F.col("fp0"), hs=F.col("hs0")), evt(_E.format("v * (hs0 * hs0 / 16) / t", "(SELECT *, sum(v * df) OVER (PARTITION BY k) AS t FROM pm)")))
shape_query("pierson_moskowitz_alpha", lambda: C.pierson_moskowitz(D.EVT, F.col("fp0")), evt(_E.format("v", "pm")))
shape_query("jonswap", lambda: C.jonswap(D.EVT, F.col("fp0"), hs=F.col("hs0")), evt(_E.format("e", "e1")))
_KH = "(SELECT *, wk * 30.0 AS kh FROM (SELECT *, yy * sqrt(1 + 1 / (yy * (1 + 0.6522 * yy + 0.4622 * pow(yy, 2) + 0.0864 * pow(yy, 4) + 0.0675 * pow(yy, 5)))) / 30.0 AS wk FROM (SELECT e1.*, hs0, 0.10194 * pow(2 * pi() * f, 2) * 30.0 AS yy FROM e1 JOIN par USING (k))))"
_TH = "((exp(kh) - exp(-kh)) / (exp(kh) + exp(-kh)))"
shape_query("tma", lambda: C.tma(D.EVT, F.col("fp0"), 30.0, hs=F.col("hs0")), evt(_E.format("v * (hs0 * hs0 / 16) / t", f"(SELECT *, sum(v * df) OVER (PARTITION BY k) AS t FROM (SELECT *, e * pow({_TH}, 2) / (1 + 2 * kh / ((exp(2 * kh) - exp(-2 * kh)) / 2)) AS v FROM {_KH}))")))
shape_query("gaussian", lambda: C.gaussian(D.EVT, F.col("hs0"), F.col("fp0"), 0.02), evt(_E.format("v * (hs0 * hs0 / 16) / t", "(SELECT *, sum(v * df) OVER (PARTITION BY k) AS t FROM (SELECT par.k, i, df, hs0, exp(-0.5 * pow((f - fp0) / 0.02, 2)) AS v FROM par CROSS JOIN fr))")))
shape_query("conditional", lambda: C.conditional(F.col("hs0") > 1.0, C.jonswap(D.EVT, F.col("fp0"), hs=F.col("hs0")), C.pierson_moskowitz(D.EVT, F.col("fp0"), hs=F.col("hs0"))), evt(_E.format("CASE WHEN e1.hs > 1.0 THEN e ELSE v * (hs * hs / 16) / t END", "(SELECT e1.*, par.hs0 AS hs FROM e1 JOIN par USING (k)) e1 JOIN (SELECT k, i, v, sum(v * df) OVER (PARTITION BY k) AS t FROM pm) USING (k, i)")))


@query("cartwright", evt("SELECT k AS event_id, CAST(j AS INT) AS i, round(g, 8) + 0.0 AS value FROM sp"))
def cartwright(spark, sf):
    df = D.parameters(spark, sf).withColumn(EFTH, C.cartwright(D.EVT, F.col("dm0"), F.col("dspr0")))
    return binned(SpectraFrame(df, Grid(tuple(range(1, 13)))), ["event_id"], digits=8)


@query("cartwright_under_90", evt("SELECT k AS event_id, CAST(j AS INT) AS i, round(v / (sum(v) OVER (PARTITION BY k) * 2 * pi() / 12) * pi() / 180, 8) + 0.0 AS value FROM (SELECT cw.k, cw.j, CASE WHEN d <= 90 THEN v ELSE 0 END AS v FROM cw JOIN tn ON cw.k = tn.k AND cw.j = tn.j)"))
def cartwright_under_90(spark, sf):
    df = D.parameters(spark, sf).withColumn(EFTH, C.cartwright(D.EVT, F.col("dm0"), F.col("dspr0"), under_90=True))
    return binned(SpectraFrame(df, Grid(tuple(range(1, 13)))), ["event_id"], digits=8)


@query("asymmetric", evt("""SELECT k AS event_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v / (sum(v) OVER (PARTITION BY k, i) * 2 * pi() / 12) * pi() / 180, 7) + 0.0 AS value FROM (
  SELECT k, i, j, pow(abs(cos(0.5 * radians(CASE WHEN abs(th - t) > 180 THEN 360 - abs(th - t) ELSE abs(th - t) END))), 2 * (2 / pow(radians(s), 2) - 1)) AS v FROM (
    SELECT par.k, i, j, th, greatest(least(dm0 + 10 + (0 - 10) / 0.02 * (f - fp0), 1.5 * (dm0 + 10)), 0.5 * (dm0 + 10)) AS t,
      greatest(greatest(least(15.0 + (25.0 - 15.0) / 0.02 * (f - fp0), 1.5 * 25.0), 0.5 * 25.0), 0.14) AS s
    FROM par CROSS JOIN fr CROSS JOIN di))"""))
def asymmetric(spark, sf):
    df = D.parameters(spark, sf).withColumn(EFTH, C.asymmetric(D.EVT, F.col("dm0"), F.col("dm0") + 10, 25.0, 15.0, F.col("fp0") + 0.02, F.col("fp0")))
    return binned(SpectraFrame(df, D.EVT), ["event_id"], digits=7)


@query("construct", evt("SELECT k AS event_id, CAST(e1.i AS INT) AS i, CAST(sp.j AS INT) AS j, round(e * g, 6) + 0.0 AS value FROM e1 JOIN sp USING (k)"))
def construct(spark, sf):
    return binned(D.events(spark, sf), ["event_id"])


@query("construct_stats", evt("SELECT k AS event_id, round(hs0, 6) AS hs FROM par"))
def construct_stats(spark, sf):
    return rounded(ST.stats(D.events(spark, sf), ["hs"]), ["event_id"])


# Selection of sites.
def _sites(spark, sf) -> SpectraFrame:
    return D.embeddings(spark, sf, "lon", "lat")


_SITES = "s AS (SELECT vec_id, (vec_id * 7) % 180 - 90.0 AS lon, (vec_id * 11) % 90 - 45.0 AS lat FROM embeddings)"
_REQ = [(10.3, 5.2), (-45.0, -20.7), (60.1, 30.0)]
_REQ_SQL = "r(request, x, y) AS (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_REQ)) + ")"


@query("sel_nearest", f"WITH {_SITES}, {_REQ_SQL} SELECT CAST(request AS INT) AS request, vec_id FROM (SELECT request, vec_id, row_number() OVER (PARTITION BY request ORDER BY sqrt(pow(lon - x, 2) + pow(lat - y, 2)), vec_id) AS n FROM s CROSS JOIN r) WHERE n = 1")
def sel_nearest(spark, sf):
    out = SE.nearest(_sites(spark, sf), [x for x, _ in _REQ], [y for _, y in _REQ], tolerance=20.0, site="vec_id")
    return out.df.select("request", "vec_id")


@query("sel_idw", emb(f""", {_SITES}, {_REQ_SQL}, d AS (SELECT request, vec_id, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) AS dist FROM s CROSS JOIN r),
q AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dist, vec_id) AS nn FROM d WHERE dist <= 20.0), z AS (SELECT *, 1 / dist AS w FROM q WHERE nn <= 4)
SELECT CAST(request AS INT) AS request, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(n * w) / sum(w), 6) + 0.0 AS value FROM z JOIN b ON b.k = z.vec_id GROUP BY request, i, j""").replace("raw) ,", "raw),"))
def sel_idw(spark, sf):
    out = SE.idw(_sites(spark, sf), [x for x, _ in _REQ], [y for _, y in _REQ], [], tolerance=20.0, site="vec_id")
    return binned(out, ["request"])


@query("sel_bbox", f"WITH {_SITES} SELECT vec_id FROM s WHERE lon BETWEEN -20.5 AND 30.5 AND lat BETWEEN -10.5 AND 15.5")
def sel_bbox(spark, sf):
    return SE.bbox(_sites(spark, sf), [-20.0, 30.0], [-10.0, 15.0], tolerance=0.5).df.select("vec_id")


@query("sel_exact", f"WITH {_SITES} SELECT CAST(0 AS INT) AS request, min(vec_id) AS vec_id FROM s WHERE lon = -90.0 + 7 AND lat = -45.0 + 11")
def sel_exact(spark, sf):
    out = SE.sel(_sites(spark, sf), [-83.0], [-34.0], method=None, site="vec_id")
    return out.df.select("request", "vec_id")


@query("interp_like", _weights_sql(D.EMB, _REGRID, "SELECT k AS vec_id, CAST(a AS INT) AS i, CAST(bb AS INT) AS j, round(n, 6) + 0.0 AS value FROM full_y"))
def interp_like(spark, sf):
    fr = D.embeddings(spark, sf)
    return binned(SH.interp_like(fr, SpectraFrame(fr.df, _REGRID), maintain_m0=False), ["vec_id"])


_PLANE = Grid((0.055, 0.1, 0.2, 0.41), (10.0, 100.0, 200.0, 300.0))
_OUT = ", ".join(f"({a}, {b}, {f!r}, {d!r})" for a, f in enumerate(_PLANE.freq) for b, d in enumerate(_PLANE.dir))


@query("interp_nearest", emb(f""", out(a, bb, g, t) AS (VALUES {_OUT}), pick AS (SELECT a, bb, i, j FROM (SELECT a, bb, i, j, row_number() OVER (PARTITION BY a, bb ORDER BY
  pow(g * cos(radians(270 - t)) - f * cos(radians(270 - th)), 2) + pow(g * sin(radians(270 - t)) - f * sin(radians(270 - th)), 2)) AS rn FROM out CROSS JOIN fr CROSS JOIN di) WHERE rn = 1)
SELECT k AS vec_id, CAST(a AS INT) AS i, CAST(bb AS INT) AS j, round(n, 6) + 0.0 AS value FROM pick JOIN b USING (i, j)""").replace("raw) ,", "raw),"))
def interp_nearest(spark, sf):
    return binned(SH.interp_plane(D.embeddings(spark, sf), _PLANE.freq, _PLANE.dir, "nearest"), ["vec_id"])


@query("interp_frequencies", emb("""SELECT k AS vec_id, CAST(q AS INT) AS i, CAST(j AS INT) AS j, round(coalesce(max(CASE WHEN i = lo THEN n * (1 - w) END) + max(CASE WHEN i = lo + 1 THEN n * w END), 0), 6) + 0.0 AS value
FROM b JOIN (SELECT q, max(CASE WHEN f <= x THEN i END) AS lo, any_value(x) AS x FROM (SELECT unnest([0, 1, 2]) AS q, unnest([0.06e0, 0.11e0, 0.9e0]) AS x) CROSS JOIN fr GROUP BY q) ON true
JOIN (SELECT i AS i0, f AS f0, lead(f) OVER (ORDER BY i) AS f1 FROM fr) ON i0 = lo CROSS JOIN LATERAL (SELECT (x - f0) / (f1 - f0) AS w) GROUP BY k, q, j"""))
def interp_frequencies(spark, sf):
    return binned(SH.interp_plane(D.embeddings(spark, sf), (0.06, 0.11, 0.9)), ["vec_id"])


@query("from_long", emb("SELECT k AS vec_id, round(hs, 6) + 0.0 AS hs FROM h"))
def from_long(spark, sf):
    fr = D.embeddings(spark, sf)
    rows = fr.to_long().select("vec_id", "ifreq", "idir", EFTH)
    return rounded(ST.stats(SpectraFrame.from_long(rows, fr.grid, ["vec_id"]), ["hs"]), ["vec_id"])


@query("sorted_directions", emb("SELECT k AS vec_id, CAST(i AS INT) AS i, CAST(7 - j AS INT) AS j, round(n, 6) + 0.0 AS value FROM b"))
def sorted_directions(spark, sf):
    """Directions that are named in falling order come back in rising order, with their bins."""
    fr = D.embeddings(spark, sf)
    return binned(SH.sort_dirs(fr.with_df(fr.df, Grid(fr.grid.freq, tuple(reversed(fr.grid.dir))))), ["vec_id"])


@query("unique_times", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def unique_times(spark, sf):
    df = D.parameters(spark, sf).withColumn(EFTH, F.array(F.lit(1.0)))
    return SE.unique_times(SpectraFrame(df, Grid((0.1,))), "user_id", ["ts", "event_id"]).df.select("event_id", "user_id")


@query("combine_first", "SELECT vec_id * 2 AS vec_id, CAST(1 AS INT) AS origin FROM embeddings UNION ALL SELECT vec_id * 3, 2 FROM embeddings WHERE vec_id * 3 NOT IN (SELECT vec_id * 2 FROM embeddings)")
def combine_first(spark, sf):
    fr = D.embeddings(spark, sf)
    own = lambda n, k: fr.with_df(fr.df.withColumn("vec_id", F.col("vec_id") * k).withColumn("origin", F.lit(n)))
    return SE.combine_first(own(1, 2), own(2, 3), ["vec_id"]).df.select("vec_id", "origin")


# Scalar functions over the events.
def scalar(name: str, spark_columns: Callable[[], dict], sql_columns: dict[str, str]):
    def run(spark, sf):
        rows = D.table(spark, sf, "events").select("event_id", *(c.alias(n) for n, c in spark_columns().items()))
        return rounded(rows, ["event_id"])

    _queries[name] = run
    _sql[name] = "SELECT event_id, " + ", ".join(f"round({v}, 6) + 0.0 AS {n}" for n, v in sql_columns.items()) + " FROM (SELECT *, value + 0.5 AS x, CAST(event_id * 37 % 360 AS DOUBLE) AS d FROM events)"


def _x():
    return F.col("value") + 0.5


def _deg():
    return F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double")


_Y = "(0.10194 * pow(2 * pi() * (0.05 + x / 500), 2) * 20.0)"
_K = f"({_Y} * sqrt(1 + 1 / ({_Y} * (1 + 0.6522 * {_Y} + 0.4622 * pow({_Y}, 2) + 0.0864 * pow({_Y}, 4) + 0.0675 * pow({_Y}, 5)))) / 20.0)"
scalar("uv_to_spddir", lambda: dict(zip(("spd", "direc"), S.uv_to_spddir(_x() - 30, _x() * 0.5 - 20, True))), {"spd": "sqrt(pow(x - 30, 2) + pow(x * 0.5 - 20, 2))", "direc": "fmod(270 - degrees(atan2(x * 0.5 - 20, x - 30)) + 360, 360)"})
scalar("spddir_to_uv", lambda: dict(zip(("u", "v"), S.spddir_to_uv(_x(), _deg(), True))), {"u": "x * sin(radians(d + 180))", "v": "x * cos(radians(d + 180))"})
scalar("angle", lambda: {"angle": S.angle(_deg(), F.lit(300.0))}, {"angle": "least(fmod(abs(d - 300), 360), 360 - fmod(abs(d - 300), 360))"})
scalar("to_nautical", lambda: {"nautical": S.to_nautical(_deg())}, {"nautical": "fmod(270 - d + 360, 360)"})
scalar("wavenumber", lambda: {"deep": S.wavenumber(0.05 + _x() / 500), "shallow": S.wavenumber(0.05 + _x() / 500, 20.0)}, {"deep": "2 * pi() * pow(0.05 + x / 500, 2) / 1.56", "shallow": _K})
scalar("wavelen", lambda: {"deep": S.wavelength(0.05 + _x() / 500), "shallow": S.wavelength(0.05 + _x() / 500, 20.0)}, {"deep": "1.56 / pow(0.05 + x / 500, 2)", "shallow": f"2 * pi() / {_K}"})
scalar("celerity", lambda: {"deep": S.celerity(0.05 + _x() / 500), "shallow": S.celerity(0.05 + _x() / 500, 20.0)}, {"deep": "1.56 / (0.05 + x / 500)", "shallow": f"2 * pi() * (0.05 + x / 500) / {_K}"})
scalar("dfp", lambda: {"wsea": S.dfp_wsea(10.0, 0.1 + _x() / 1000, 3600.0), "swell": S.dfp_swell(_x() * 60)}, {"wsea": "15.8 * pow(9.81 / 10, 0.57) * pow(pow((0.1 + x / 1000) / (15.8 * pow(9.81 / 10, 0.57)), -1 / 0.43) + 3600, -0.43) - (0.1 + x / 1000)", "swell": "x * 60 * 9.81 / (4 * pi() * 1e6)"})
scalar("station_direction", lambda: {"dir": S.station_direction(F.radians(_deg()))}, {"dir": "fmod(degrees(fmod(radians(d) - 2.5 * pi() + 4 * pi(), 2 * pi())) + 270, 360)"})


# Algorithms that SQL doesn't express; tests hold them against invariants and plain versions.
def _partition(name: str, method):
    def run(spark, sf):
        parts = method(D.embeddings(spark, sf, "wspd", "wdir", "dpt"))
        return rounded(ST.stats(parts, ["hs", "tp", "dpm"]).select("vec_id", "part", "hs", "tp", "dpm"), ["vec_id", "part"])

    _queries[name] = run


for _name in ("ptm1", "ptm2", "ptm3", "hp01"):
    _partition(_name, P.METHODS[_name])


@query("track")
def track(spark, sf):
    fr = D.embeddings(spark, sf, "grp", "step", "wspd", "wdir", "dpt")
    fr = fr.with_df(fr.df.withColumn("step", F.col("step") * 3600))
    return TR.track(fr, ["grp"], "ptm3", time="step").select("grp", "step", "part", "track_id", "ntracks")


_EVENT_TRACKS = """WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t, 0.06e0 + 0.001e0 * (event_id % 60) AS fp, event_id * 37 % 360 AS d FROM events),
l AS (SELECT *, (t - lag(t) OVER w) / 1e6 * 9.81 / (4 * pi() * 1e6) AS rise, abs(fp - lag(fp) OVER w) AS df, abs(d - lag(d) OVER w) AS dd FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, CASE WHEN df < rise AND least(dd, 360 - dd) < 90 THEN 0 ELSE 1 END AS born FROM l),
s AS (SELECT event_id, CAST(sum(born) OVER (PARTITION BY user_id ORDER BY t) - 1 AS INTEGER) AS track_id, CAST(sum(born) OVER (PARTITION BY user_id) AS INTEGER) AS ntracks FROM b)"""


@query("track_events", f"{_EVENT_TRACKS} SELECT event_id, track_id, ntracks FROM s")
def track_events(spark, sf):
    """One part a step, in 40 blocks of steps: most users have several blocks, or share one."""
    rows = D.parameters(spark, sf, spectra=False).select("event_id", "user_id", F.col("ts").alias("time"), F.lit(0).alias("part"), F.col("fp0").alias("fp"), F.col("dm0").alias("dpm"))
    return TR.track_stats(rows, ["user_id"], wspd=None, blocks=40, nsea=0, ddpm_swell_max=90.0).select("event_id", "track_id", "ntracks")


@query("wave_systems")
def wave_systems(spark, sf):
    fr = D.embeddings(spark, sf, "grp", "step", "wspd", "wdir", "dpt")
    fr = fr.with_df(fr.df.withColumn("step", F.col("step") * 3600))
    return TR.track(fr, ["grp"], "hp01", time="step", systems=True, min_duration=2).select("grp", "step", "part", "wave_system")


@query("fit_jonswap")
def fit_jonswap(spark, sf):
    return rounded(C.fit_jonswap(D.events(spark, sf)).df.select("event_id", "fp", "hs", "gamma"), ["event_id"], 4)


@query("fit_gaussian")
def fit_gaussian(spark, sf):
    return rounded(C.fit_gaussian(D.events(spark, sf), gw0=0.02).df.select("event_id", "fp", "hs", "gw"), ["event_id"], 4)


@query("reconstruct")
def reconstruct(spark, sf):
    out = C.partition_and_reconstruct(D.embeddings(spark, sf), ["vec_id"])
    return rounded(ST.stats(out, ["hs"]), ["vec_id"], 4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | SO.queries


def oracle_sql() -> dict[str, str]:
    return _sql | SO.oracles
