"""Near-duplicates by the similarity of word-shingle sets, from SimHash and MinHash candidates, each checked on the sets.

SimHash fingerprints of the shingles are searched within RADIUS bits by the generalised pigeonhole principle. Most
copies of a similarity near 0.8 differ in more bits (10 of 64 on average), which no pigeonhole search reaches at a
bearable cost. These come from bands: two texts of similarity s (of their sets: shared over all) share one of BANDS keys
of ROWS MinHashes each with probability 1 - (1 - s^ROWS)^BANDS; at s = 0.8 all but 6e-5 of the pairs do. Nothing is
capped: of a key's texts, all meet the least one, and those that these links leave in different components meet each
other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .passages import mix
from .shared import drop, kept, materialize, pieces, text_batches
from .simhash import links as near_fingerprints
from .simhash import majority, rows_kept, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, RADIUS = 32, 6, 2
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a shingle that all meet.
FEW = 16
#: Shingles whose MinHashes are taken at once.
BLOCK = 1 << 12


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; one for a text without words."""
    return distinct(shingle_hashes(text, words))


def distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes or [0], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set, each of ROWS MinHashes and the band's number."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), BLOCK):
        low = np.minimum(low, (shingles[k : k + BLOCK, None] * FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(row))
    return key


def alike(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two shingle sets have the similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def checked(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (h, text) are similar."""

    def op(batches):
        kept()
        last, x = None, None
        for batch in batches:
            a, b, s, t = (c.to_pylist() for c in batch.columns)
            found = []
            for k in range(len(a)):
                if a[k] != last:
                    last, x = a[k], shingle_set(s[k], words)
                if alike(x, shingle_set(t[k], words), similarity):
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in found], pa.int64()), pa.array([b[k] for k in found], pa.int64())], ["a", "b"])

    right = pairs.join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")
    both = right.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(op, "a long, b long")


def by_fingerprint(keys: DataFrame, radius: int) -> DataFrame:
    """(a, b): of equal fingerprints all texts with the least one, of fingerprints within radius bits the least ones."""
    spark = keys.sparkSession
    first = materialize(spark, keys.groupBy("fp").agg(F.min("h").alias("a")), "fingerprints")
    near = near_fingerprints(first.select("fp"), radius).select(F.col("a").alias("x"), F.col("b").alias("y"))
    of = lambda old, new: first.select(F.col("fp").alias(old), F.col("a").alias(new))
    across = near.join(of("x", "p"), "x").join(of("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return keys.join(first, "fp").where("h <> a").select("a", F.col("h").alias("b")).union(across)


def links(keys: DataFrame, texts, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): components of all similar pairs of distinct texts; keys: (h, keys, fp); texts: gives (h, text) of a table of h."""
    spark = keys.sparkSession
    close = materialize(spark, by_fingerprint(keys, RADIUS), "close")
    dealt = keys.select("h", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spark, dealt.join(sizes, "key"), "shared")
    # the text that shares keys with most others leads: what copies were made of, rather than one of them
    known = shared.groupBy("h").agg(F.sum("n").alias("met"))
    ranked = shared.select("key", "h").join(known, "h")
    leads = ranked.groupBy("key").agg(F.max(F.struct("met", "h")).alias("x")).select("key", F.col("x.h").alias("a"))
    held = materialize(spark, shared.select("key", "h").join(leads, "key"), "held")
    some = held.select("h").union(close.select("a")).union(close.select("b")).distinct()
    own = materialize(spark, texts(some), "texts")
    star = held.where("h <> a").select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b"))
    star = materialize(spark, star.union(close).distinct(), "star")
    found = materialize(spark, checked(star, own, words, similarity), "checked")
    labels = graph.components(found).withColumnRenamed("node", "h")
    # of a key's texts, those in different components so far
    placed = held.join(labels, "h", "left").select("key", "h", F.coalesce("label", "h").alias("label"), F.col("label").isNull().alias("alone"))
    placed = materialize(spark, placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    mixed = materialize(spark, placed.join(mixed, "key", "left_semi"), "mixed")
    near, lonely = possible(mixed, own, words, similarity)
    # texts that are alone meet all; of the components that share a key, all texts of one meet all of the other
    one = mixed.join(lonely, "h", "left_semi").select("key", "label", "h")
    groups = one.join(mixed.select("key", F.col("label").alias("l2")).distinct(), "key").where("label <> l2").select("h", "l2").distinct()
    alone = groups.join(mixed.select(F.col("label").alias("l2"), F.col("h").alias("h2")).distinct(), "l2").select("h", "h2")
    joint = mixed.where("not alone").select("key", "label", "h")
    sides = joint.select("key", "label").distinct()
    meet = sides.alias("p").join(sides.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.label") < F.col("q.label"))).select("p.key", F.col("p.label").alias("la"), F.col("q.label").alias("lb"))
    meet = meet.join(joint.select("key", F.col("label").alias("la"), "h"), ["key", "la"]).join(joint.select("key", F.col("label").alias("lb"), F.col("h").alias("h2")), ["key", "lb"])
    rest = near.union(alone).union(meet.select("h", "h2")).select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    pairs = materialize(spark, rest, "rest")
    rest = materialize(spark, checked(pairs, own, words, similarity), "checked")
    drop(spark, close, shared, held, own, star, placed, mixed, near, lonely, pairs)
    labels = graph.components(found.union(rest))
    drop(spark, found, rest)
    return labels


def possible(mixed: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What may be similar to the texts of mixed (key, h, alone) that are alone: pairs (h, h2) by shingles that stand in FEW texts at most, and the texts (h) that may be similar to others without such a shingle.

    That is exact. Of all shingles of these texts it is known in how many they stand and the size of the smallest set
    that has them. A set shares at most those of its shingles that stand in two texts, with one that is as large as all
    but the largest of these sizes allow; if that gives less than `similarity`, nothing is similar to it.
    """
    spark = mixed.sparkSession
    some = mixed.groupBy("key").agg(F.max("alone").alias("any")).where("any").select("key")
    near = mixed.join(some, "key", "left_semi").groupBy("h").agg(F.max("alone").alias("alone"))

    def op(batches):
        kept()
        for batch in pieces(batches, 1):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            size = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), size.take(at), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["h", "alone", "size", "shingle"])

    made = materialize(spark, texts.join(near, "h").select("h", "text", "alone").mapInArrow(op, "h long, alone boolean, size int, shingle long"), "shingles")
    twice = made.groupBy("shingle").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1")
    own = materialize(spark, made.where("alone").select("h", "size", "shingle").join(twice, "shingle"), "own")

    def fits(rows: DataFrame) -> DataFrame:
        met = rows.groupBy("h", "size").agg(F.count("*").alias("met"), F.sort_array(F.collect_list("least")).alias("least"))
        enough = F.ceil(similarity * F.col("size") - 1e-9).cast("int")  # so many it must share, and so be as large as the sets of all of these
        met = met.where(F.col("met") >= enough).withColumn("least", F.element_at("least", enough))
        return met.where(F.col("met") >= similarity * (F.col("size") + F.greatest("least", "met") - F.col("met"))).select("h")

    rare = own.join(fits(own), "h", "left_semi").where(F.col("n") <= FEW).select("h", "shingle")
    near = rare.join(made.select("shingle", F.col("h").alias("h2")), "shingle").where("h <> h2").select("h", "h2").distinct()
    out = materialize(spark, near, "near"), materialize(spark, fits(own.where(F.col("n") > FEW)), "possible")
    drop(spark, made, own)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, with all columns, without all but one of each component of similar texts: the one with the smallest id stays.

    Texts without words are alike. Of repeated rows (equal id and text) one stays. A component of null ids only keeps
    one row of each text.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))

    def op(batches):
        kept()
        for batch in pieces(batches, 2):
            hashes = [shingle_hashes(t, words) for t in batch.column(2).to_pylist()]
            keys = [band_keys(distinct(x)).view(np.int64) for x in hashes]
            fp = np.array([majority(x) for x in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64())), pa.array(fp)], ["id", "h", "keys", "fp"])

    made = materialize(spark, rows.mapInArrow(op, f"id {rows.schema['id'].dataType.simpleString()}, h long, keys array<long>, fp long"), "keys")
    once = materialize(spark, made.groupBy("h").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "distinct")
    texts = lambda h: rows.select("h", "text").join(h, "h", "left_semi").dropDuplicates(["h"])
    labels = links(once.select("h", "keys", "fp"), texts, words, similarity).withColumnRenamed("node", "h")
    parts = materialize(spark, once.select("h", "first").join(labels, "h", "left").select("h", "first", F.coalesce("label", "h").alias("label")), "of")
    least = parts.groupBy("label").agg(F.min("first").alias("component_id"))
    of = materialize(spark, parts.join(least, "label").select("h", "label", "component_id"), "components")
    ids = made.select("id", "h")
    out = rows_kept(df, ids, ids.join(of, "h"), id_col, text_col)  # reads these tables before it returns
    drop(spark, made, once, parts, of)
    return out
