"""Connected components of a link table by repeated contraction, without a hot key's links meeting in one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize

#: With so few links left, one task joins them by union-find.
FEW_LINKS = 10_000


def _finish(links: DataFrame) -> DataFrame:
    """(node, label) of a bounded number of links, by union-find in one task."""

    def op(batches):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "label": pd.Series([root(x) for x in nodes], dtype="int64")})

    return links.coalesce(1).mapInPandas(op, "node long, label long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node in links (a long, b long): nodes joined by links share a label.

    In each round every node goes over to its neighbour of least random rank (a new rank each round), or stays if its
    own is less. A link (u, v) then joins what u and v went over to; self-links and repeats go. The expected number of
    nodes falls by a constant factor each round, whatever the shape. Minima are aggregated before the shuffle, and the
    joins on a hub's key have plain exchanges on either side, so adaptive execution can split them.
    """
    spark = links.sparkSession
    links = materialize(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while links.count() > FEW_LINKS:
        k, old = len(rounds), links
        both = links.union(links.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("rank"), "b")).alias("best"))
        moved = best.select(F.col("a").alias("node"), F.when(F.col("best.rank") < F.xxhash64("a", F.lit(k)), F.col("best.b")).otherwise(F.col("a")).alias("label"))
        moved = materialize(spark, moved, f"moved{k}")
        rounds.append(moved)
        links = links.join(moved.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").select("x", "b")
        links = links.join(moved.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        made = materialize(spark, links, f"links{k}")
        drop(spark, old)
        links = made
    last = materialize(spark, _finish(links), "last")
    drop(spark, links)
    if not rounds:
        return last
    out = rounds[0]
    for step in [*rounds[1:], last]:
        renamed = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        more = materialize(spark, out.join(renamed, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        drop(spark, out, step)
        out = more
    return out
