"""Numbers for rows in an order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import scratch

#: Bits of a row's place in its partition, in Spark's increasing ids.
PLACE_BITS = 33


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends, and what was not determined is."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df, written in the order of the columns `by`, with numbers from 0: ranges are sorted by themselves, and what stands before each is summed up from their sizes."""
    table = written(df.orderBy(*by).withColumn("__m", F.monotonically_increasing_id()), name)
    sizes = table.groupBy(F.shiftright("__m", PLACE_BITS).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each partition
    before, at = [], 0
    for r in sizes:
        before.append((r["p"], at))
        at += r["n"]
    known = table.sparkSession.createDataFrame(before, "__p long, __before long")
    rows = table.withColumn("__p", F.shiftright("__m", PLACE_BITS)).join(F.broadcast(known), "__p")  # as small as the list above
    return rows.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << PLACE_BITS) - 1)).drop("__m", "__p", "__before")
