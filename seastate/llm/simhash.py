"""SimHash near-duplicates: fingerprints linked at a few differing bits by the generalised pigeonhole principle.

The 64 bits are dealt to m partitions. If two fingerprints differ in at most r bits and partition i has threshold t_i
(-1: not searched) with sum t_i = r - m + 1, they differ in at most t_i bits in some partition i. Correlated bits share
a partition; thresholds and m come from dynamic programming on estimated candidate counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .shared import kept, materialize, pieces, text_batches

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: A bucket of at most so many fingerprints is searched pair by pair, a larger one by its members' one-bit variants.
SMALL_BUCKET = 64
#: Cost of checking a candidate pair, in probes.
PAIR_COST = 1.0


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    """The XXH64 hashes of a text's word shingles, repeats included; of fewer words the whole; none without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and the blanks 0x20 and 0x09-0x0D
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if tokens else []
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text: bit b is 1 if set in over half the hashes of its word shingles; 0 without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        h = np.array(hashes[k : k + BLOCK], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """The columns `keep` with fp (long, the fingerprint's bits) of each whole text. Null texts count as empty."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(text_col).alias("__text"), *keep)

    def op(batches):
        kept()
        for batch in pieces(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*keep, "fp"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(op, f"{fields}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have both bits i and j set, over all of fps (fp long)."""

    def op(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total[i, j].round().astype(np.int64), n))], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(op, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2081 rows at most
    both, n = np.zeros((BITS, BITS)), 0
    for cell, count in cells:
        if cell < 0:
            n = count
        else:
            both[cell // BITS, cell % BITS] = both[cell % BITS, cell // BITS] = count
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the bit that correlates most with those it has."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = (BITS - sum(map(len, parts))) // (m - k)
        own = [max(free, key=lambda b: (link[b, free].sum() - link[b, b], -b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (link[b, own].sum(), -b)))
            free.remove(own[-1])
        parts.append(sorted(own))
    return parts


def within(p: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most 0, 1, ... most bits of a partition, its bits taken as independent."""
    at = np.zeros(most + 1)
    at[0] = 1
    for b in part:
        d = 2 * p[b] * (1 - p[b])
        at[1:] = at[1:] * (1 - d) + at[:-1] * d
        at[0] *= 1 - d
    return np.cumsum(at)


def allocate(n: int, p: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """The least estimated cost and its thresholds, by dynamic programming over the partitions and what is left of their sum."""
    need = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        chance, ball, cost = within(p, part, radius), 1.0, {-1: 0.0}
        for t in range(radius + 1):
            ball = ball if t == 0 else ball * (len(part) - t + 1) / t
            cost[t] = cost[t - 1] + n * ball
        cost = {t: c + (PAIR_COST * n * n / 2 * chance[t] if t >= 0 else 0) for t, c in cost.items()}
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, own) in best.items():
            for t, plus in cost.items():
                if total + t not in step or c + plus < step[total + t][0]:
                    step[total + t] = (c + plus, [*own, t])
        best = step
    return best[need]


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, those with -1 left out: the best over all partition counts."""
    p = np.diag(both) / max(1, n)
    made = [(parts, *allocate(n, p, parts, radius)) for m in range(1, radius + 3) for parts in [group_bits(n, both, m)]]
    parts, _, thresholds = min(made, key=lambda x: x[1])
    return [(part, t) for part, t in zip(parts, thresholds) if t >= 0]


def _mask(bits) -> int:
    """A set of bits as a signed long."""
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) over distinct fingerprints fps (fp long): links whose transitive closure is that of all pairs within radius bits.

    Every such pair is in the closure; every link is a true pair. A bucket is probed pair by pair if small. In a larger
    one each member deals itself to its one-bit variants: two fingerprints share a variant (or one is the other's) exactly
    if they differ in two bits at most, and no variant has more than 65 neighbours. Nothing is capped.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    spark = fps.sparkSession
    n, both = bit_statistics(fps)
    if radius == 0 or n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = []
    for i, (part, t) in enumerate(plan(n, both, radius)):
        own = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        flips = [[]] if t == 0 else [[], *([b] for b in part)] if t == 1 else [[], *([b] for b in part), *([b, c] for b in part for c in part if c < b)]
        keys += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(_mask(f))).alias("key"), F.lit(len(f) == 0).alias("own")) for f in flips]
    probes = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    held = materialize(spark, probes.join(sizes.select("part", "key", "n"), ["part", "key"]), "buckets")
    small, large = held.where(F.col("n") <= SMALL_BUCKET), held.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    x, y = small.where("own").alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") != F.col("y.fp")) & near(F.col("x.fp"), F.col("y.fp")))
    out = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    variants = [F.struct(F.lit(True).alias("self"), F.col("fp").alias("key")), *(F.struct(F.lit(False).alias("self"), F.col("fp").bitwiseXOR(F.lit(_mask([b]))).alias("key")) for b in range(BITS))]
    dealt = large.select("fp", F.explode(F.array(*variants)).alias("k")).select("fp", "k.*")
    if radius == 2:
        meet = dealt.groupBy("key").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    else:
        meet = dealt.groupBy("key").agg(F.min(F.when(F.col("self"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all")).where("a is not null")
    star = meet.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return out.union(star)


def near_duplicates(fps: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """fps (id, fp and other columns) with label (a fingerprint of its component) and component_id (its smallest id) added.

    Equal fingerprints always share a component. Null ids are never the smallest; a component of null ids only has a
    null component_id. Repeated rows stay; an empty table gives no rows. fps is read several times: pass a written table.
    The last join brings each fingerprint's label, one row, to its rows: where a fingerprint has a large part of all rows
    (empty texts, copies), both sides are plain exchanges that adaptive execution splits.
    """
    spark = fps.sparkSession
    distinct = materialize(spark, fps.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    labels = graph.components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = materialize(spark, distinct.join(labels, "fp"), "linked")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    found = materialize(spark, linked.join(least, "label").select("fp", "label", "least"), "found")
    of = distinct.join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    of = materialize(spark, of, "of")
    return fps.join(of, "fp", "left")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """The rows of df, with all columns, without all but one of each component: the one with the smallest id stays.

    Of repeated rows (equal id and text) one stays. A component of null ids only keeps one row of each text.
    """
    spark = df.sparkSession
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), key.alias("h"), F.col(text_col).alias("text"))
    fps = materialize(spark, fingerprints(rows, ["id", "h"], "text", words), "fingerprints")
    found = near_duplicates(fps, "id", radius)
    return rows_kept(df, fps, found, id_col, text_col)


def rows_kept(df: DataFrame, rows: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that keep_one keeps; rows: (id, h) of each row, found: with label and component_id, h being the text's XXH64."""
    spark, key = df.sparkSession, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    chosen = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "label").agg(F.min("h").alias("h")).select("id", "h").distinct()
    chosen = materialize(spark, chosen, "chosen")
    k = next(n for i in range(len(df.columns) + 1) if (n := f"__h{i}") not in {c.lower() for c in df.columns})
    out = df.withColumn(k, key).join(chosen, F.col(id_col).eqNullSafe(chosen["id"]) & (F.col(k) == chosen["h"]), "left_semi")
    if not rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, k])
    return out.drop(k)
