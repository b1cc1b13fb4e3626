"""Spectra derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import EFTH, SpectraFrame
from ..grid import Grid, frequencies
from ..operators import construct as C
from ..session import prepare

#: Spectra of the embeddings: |value| over 8 frequencies and 8 directions. The last frequency is over 0.333 Hz.
EMB = Grid(frequencies(0.05, 8, 1.35), tuple(45.0 * j for j in range(8)))
#: Spectra of the events.
EVT = Grid(frequencies(0.04, 12, 1.2), tuple(30.0 * j for j in range(12)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Events that a task takes.
ROWS = 20_000


def dealt(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """Narrow rows that make spectra, dealt anew over tasks of about so many: a file of a few bytes a row is cut at its row groups only, and a task would take all the work of one."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def embeddings(spark: SparkSession, sf_dir: str, *more: str) -> SpectraFrame:
    """site = vec_id, and wind and depth by fixed rules."""
    df = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    columns = {"label": F.col("label"), "wspd": 5.0 + F.pmod(k, F.lit(17)), "wdir": F.pmod(k * 31, F.lit(360)).cast("double"), "dpt": 10.0 + F.pmod(k, F.lit(50)), "grp": F.pmod(k, F.lit(50)), "step": F.floor(k / 50).cast("long"), "lon": F.pmod(k * 7, F.lit(180)) - 90.0, "lat": F.pmod(k * 11, F.lit(90)) - 45.0}
    efth = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return SpectraFrame(df.select("vec_id", *(columns[m].alias(m) for m in more), efth.alias(EFTH)), EMB)


def parameters(spark: SparkSession, sf_dir: str, spectra: bool = True) -> DataFrame:
    """event_id, ts, user_id and wave parameters of the events; spectra: whether spectra are made of them."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    rows = dealt(rows) if spectra else rows
    return rows.select("event_id", "ts", "user_id", (0.5 + F.col("value") / 100).alias("hs0"), (0.06 + 0.001 * F.pmod(k, F.lit(60))).alias("fp0"), F.pmod(k * 37, F.lit(360)).cast("double").alias("dm0"), F.lit(20.0).alias("dspr0"))


def events(spark: SparkSession, sf_dir: str, *keep: str) -> SpectraFrame:
    """A JONSWAP spectrum for each event."""
    made = C.construct_partition(parameters(spark, sf_dir), EVT, "jonswap", "cartwright", {"fp": "fp0", "hs": "hs0"}, {"dm": "dm0", "dspr": "dspr0"})
    return made.with_df(made.df.select("event_id", *keep, EFTH))


def double(v: float) -> str:
    """A literal that SQL takes as a double, not a decimal."""
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(double(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def grid_sql(g: Grid) -> str:
    """Tables fr(i, f, df) and di(j, th) with the grid's own numbers."""
    fr = _values([(i, float(f), float(d)) for i, (f, d) in enumerate(zip(g.f, g.df))])
    di = _values([(j, float(t)) for j, t in enumerate(g.theta)])
    return f"fr(i, f, df) AS (VALUES {fr}), di(j, th) AS (VALUES {di})"


def emb_sql() -> str:
    """b(k, i, j, f, df, th, s, c, n): bins with s = sin and c = cos of 270 - th; o(k, i, f, df, e, ms, mc): sums over directions; m(k, m0, m1, m2, m4, tail)."""
    g = EMB
    return f"""{grid_sql(g)},
raw AS (SELECT vec_id AS k, unnest(range(64)) AS p, abs(CAST(unnest(embedding) AS DOUBLE)) AS n FROM embeddings),
b AS (SELECT k, i, j, f, df, th, sin(radians(270 - th)) AS s, cos(radians(270 - th)) AS c, n FROM raw JOIN fr ON i = p // 8 JOIN di ON j = p % 8),
o AS (SELECT k, i, f, df, {g.dd} * sum(n) AS e, {g.dd} * sum(n * s) AS ms, {g.dd} * sum(n * c) AS mc FROM b GROUP BY k, i, f, df),
m AS (SELECT k, sum(e * df) AS m0, sum(e * df * f) AS m1, sum(e * df * f * f) AS m2, sum(e * df * f * f * f * f) AS m4, {g.tail()!r} * max(CASE WHEN i = 7 THEN e END) AS tail FROM o GROUP BY k),
h AS (SELECT *, 4 * sqrt(m0 + tail) AS hs FROM m),
w AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY i) AS e1, lead(e) OVER (PARTITION BY k ORDER BY i) AS e3, lag(f) OVER (PARTITION BY k ORDER BY i) AS f1, lead(f) OVER (PARTITION BY k ORDER BY i) AS f3 FROM o),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e DESC, i) AS rn FROM w WHERE e > e1 AND e > e3) WHERE rn = 1),
tps AS (SELECT k, i AS ip, f AS fd, 2 / (f1 + f - ((e1 - e) / (f1 - f)) / (((e1 - e3) / (f1 - f3) - (e1 - e) / (f1 - f)) / (f3 - f))) AS tp FROM pk),
ids AS (SELECT DISTINCT k FROM raw)"""


def evt_sql() -> str:
    """par(k, hs0, fp0, dm0) and e1(k, i, f, df, e): densities over frequency scaled to hs0; sp(k, j, th, g): spreading; b: bins."""
    g = EVT
    return f"""{grid_sql(g)},
par AS (SELECT event_id AS k, ts, user_id, 0.5 + value / 100 AS hs0, 0.06 + 0.001 * (event_id % 60) AS fp0, CAST(event_id * 37 % 360 AS DOUBLE) AS dm0 FROM events),
pm AS (SELECT k, hs0, fp0, i, f, df, 0.0081 * 9.81 * 9.81 * pow(2 * pi(), -4) * pow(f, -5) * exp(-1.25 * pow(f / fp0, -4)) AS v FROM par CROSS JOIN fr),
js AS (SELECT k, hs0, i, f, df, v * pow(3.3, exp(-(f - fp0) * (f - fp0) / (2 * pow(CASE WHEN f <= fp0 THEN 0.07 ELSE 0.09 END, 2) * fp0 * fp0))) AS v FROM pm),
e1 AS (SELECT k, i, f, df, v * (hs0 * hs0 / 16) / sum(v * df) OVER (PARTITION BY k) AS e FROM js),
tn AS (SELECT k, j, th, CASE WHEN abs(th - dm0) > 180 THEN 360 - abs(th - dm0) ELSE abs(th - dm0) END AS d FROM par CROSS JOIN di),
cw AS (SELECT k, j, th, pow(abs(cos(0.5 * radians(d))), 2 * (2 / pow(radians(20.0), 2) - 1)) AS v FROM tn),
sp AS (SELECT k, j, th, v / (sum(v) OVER (PARTITION BY k) * 2 * pi() / 12) * pi() / 180 AS g FROM cw)"""
