"""Audit of how filters interact: what each removes in every order, and which of them are redundant.

`marked` gives each document the set of filters that it fails. One of them looks for texts that a smaller id has: a
partition is refined by length, then by one block hash after another, and what stands alone is dropped; the texts that
are left are compared in full. `audit` counts documents by these sets, and every figure of every order follows from the
counts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, materialize, pieces, text_batches

#: Bytes of the first block; each later one has so many times the bytes of all before it.
FIRST_BLOCK, GROWTH = 256, 15
#: A longer text's words are gone through one by one, without a list of them.
LISTED = 1 << 20

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
#: The bytes of UTF-8 that begin no code point.
INSIDE = bytes(range(0x80, 0xC0))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: bytes) -> tuple[int, int]:
    """How many words, and how many distinct ones."""
    if len(text) <= LISTED:
        found = text.split()  # of bytes: at the six white spaces of ASCII
        return len(found), len(set(found))
    n, seen = 0, set()
    for word in WORD.finditer(text):
        n += 1
        seen.add(word[0])
    return n, len(seen)


def without(text: bytes, signs: bytes) -> int:
    return len(text.translate(None, signs))


#: What fails a filter, by its letter: of a text in UTF-8, its words and its distinct words.
FILTERS: dict[str, Callable[[bytes, int, int], bool]] = {
    "A": lambda text, n, distinct: n < 200,
    "B": lambda text, n, distinct: 100 * distinct < 50 * n,
    "C": lambda text, n, distinct: 100 * (len(text) - without(text, UPPER)) > 2 * without(text, INSIDE),
    "D": lambda text, n, distinct: without(text, SIGNS) < len(text),
}
#: The letter of the filter that no text alone can tell: a smaller id has the same text.
DUPLICATE = "E"
LETTERS = [*FILTERS, DUPLICATE]
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}


def block_hash(block: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(block, seed) - (1 << 63)


def signature(text: bytes, seed: int, hashed: Callable[[bytes, int], int] = block_hash) -> list[int]:
    """The length in code points and the hashes of successive blocks, which grow and together cover the whole text."""
    out, at, end = [without(text, INSIDE)], 0, FIRST_BLOCK
    while at < len(text):
        out.append(hashed(text[at:end], seed))
        at, end = end, end * (1 + GROWTH)
    return out


def signatures(seed: int, hashed: Callable[[bytes, int], int]):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([signature(t, seed, hashed) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return of


def class_of(blocks: int | None = None) -> Column:
    """The class of a text by its length and its first blocks, or by all of them; shorter texts are known by all they have."""
    return F.xxhash64("signature" if blocks is None else F.slice("signature", 1, blocks + 1))


def refined(rows: DataFrame) -> DataFrame:
    """(class) of the texts that no refinement sets apart, from their signatures: by length, then block by block. Only texts that aren't alone go on to the next block."""
    spark = rows.sparkSession
    blocks = rows.agg(F.max(F.size("signature"))).first()[0] or 1
    left = rows.select("signature")
    for k in range(blocks):
        met = left.groupBy(class_of(k).alias("class")).agg(F.count("*").alias("n")).where(F.col("n") > 1).select("class")
        met = materialize(spark, met, f"classes{k}")
        if k + 1 < blocks:
            old, left = left, materialize(spark, left.withColumn("class", class_of(k)).join(met, "class", "left_semi").select("signature"), f"left{k}")
            drop(spark, met, *([old] if k else []))
    return met


def least_ids(rows: DataFrame, texts: DataFrame, seed: int, hashed: Callable[[bytes, int], int]) -> DataFrame:
    """(class, texts, least) of the classes that survive: how many different texts they have, and the least id.

    rows: signatures; texts: (id, text) of the same documents. Texts of a class are compared in full, by each task before
    the shuffle and by groups after it.
    """
    own = texts.withColumn("signature", signatures(seed, hashed)("text")).select("id", "text", class_of().alias("class"))
    own = own.join(refined(rows), "class", "left_semi")
    equal = own.groupBy("class", "text").agg(F.min("id").alias("least"))
    return materialize(rows.sparkSession, equal.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least")), "least")


def failures(df: DataFrame, seed: int, hashed: Callable[[bytes, int], int]) -> DataFrame:
    """(id, part, fails, signature) of rows (id, part, text): the bits of the filters that the text alone fails."""
    kind = df.schema["id"].dataType.simpleString()

    def op(batches):
        for batch in pieces(batches, 2):
            texts = batch.column(2).to_pylist()
            fails = [sum(BIT[letter] for letter, test in FILTERS.items() if test(t, n, d)) for t in texts for n, d in [words(t)]]
            blocks = pa.array([signature(t, seed, hashed) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), blocks], ["id", "part", "fails", "signature"])

    return df.select("id", "part", "text").mapInArrow(op, f"id {kind}, part string, fails int, signature array<long>")


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hashed: Callable[[bytes, int], int] = block_hash) -> DataFrame:
    """(id, part, fails) of each row of df: the sum of BIT of the filters that its whole text fails; part "" for null.

    Null texts count as empty. Of equal texts those fail as duplicates whose id is larger than another's: rows that
    share the least id don't, and a null id neither is nor makes a duplicate. Repeated rows each have a row; an empty
    table gives none; other columns are not read. Two texts that all block hashes confuse are seen as different when
    texts are compared, and the hashes are then made anew by another seed.
    """
    spark = df.sparkSession
    text_batches(spark)
    own = df.select(df[id_col].alias("id"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))
    for seed in itertools.count():
        rows = materialize(spark, failures(own, seed, hashed), "failures")
        least = least_ids(rows.select("signature"), own.select("id", "text"), seed, hashed)
        if least.where(F.col("texts") > 1).isEmpty():
            break
    least = least.where(F.col("least").isNotNull()).select("class", "least")
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    out = rows.withColumn("class", class_of()).join(least, "class", "left")
    return out.select("id", "part", (F.col("fails") + F.when(again, BIT[DUPLICATE]).otherwise(0)).alias("fails"))


def steps() -> Column:
    """(filter_order, step, bit, before) of each step of each order, as rows: its filter's bit and those of the filters before it."""
    each = []
    for order in map("".join, itertools.permutations(LETTERS)):
        each += [f"struct('{order}', {k + 1}, {BIT[letter]}, {sum(BIT[x] for x in order[:k])})" for k, letter in enumerate(order)]
    return F.expr(f"inline(array({', '.join(each)}))").alias("filter_order", "step", "bit", "before")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step, with counts of the part's documents.

    kept after this step, removed by it, redundant (failing its filter, but removed before), unique_fails (failing no
    other), good_lost and toxic_lost (removed here, labelled so), shapley (removed by its filter, summed over all
    orders). labels: (id, quality, toxic); a document without label, or with null ones, is neither good nor toxic; of
    several labels any one counts. See marked() for odd rows; a part stands with all its steps, zeros included.
    """
    spark = df.sparkSession
    rows = materialize(spark, marked(df, id_col, text_col, part_col), "marked")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.groupBy(labels[id_col].alias("id")).agg(flag("quality"), flag("toxic")).where(F.col("quality") + F.col("toxic") > 0)
    none = F.lit(0).cast("long")
    each = rows.groupBy("part", "fails").agg(F.count("*").alias("n")).select("part", "fails", "n", none.alias("good"), none.alias("bad"))
    lost = rows.join(known, "id").groupBy("part", "fails").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("bad")).select("part", "fails", none.alias("n"), "good", "bad")
    sets = each.union(lost).groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    own, earlier = fails.bitwiseAND(bit) > 0, fails.bitwiseAND(before) > 0
    count = lambda name, what, n="n": F.sum(F.when(what, F.col(n)).otherwise(none)).alias(name)
    first = F.floor(F.lit(math.factorial(len(LETTERS))) / F.bit_count(fails))  # orders in which a filter comes first of those that fail
    return (
        sets.select("*", steps())
        .groupBy("part", "filter_order", "step")
        .agg(
            count("kept", ~own & ~earlier),
            count("removed", own & ~earlier),
            count("redundant", own & earlier),
            count("unique_fails", fails == bit),
            count("good_lost", own & ~earlier, "good"),
            count("toxic_lost", own & ~earlier, "bad"),
            F.sum(F.when(own, F.col("n") * first).otherwise(none)).alias("shapley"),
        )
    )


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, part,
             len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                          CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
z AS (SELECT part, filter_order, step, n, good, bad, fails, substr(filter_order, step, 1) AS own,
             length(translate(fails, substr(filter_order, 1, step - 1), '')) < length(fails) AS earlier,
             contains(fails, substr(filter_order, step, 1)) AS failed FROM g, k),
s AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT earlier AND NOT failed THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT earlier AND failed THEN n ELSE 0 END) AS removed, sum(CASE WHEN earlier AND failed THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT earlier AND failed THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT earlier AND failed THEN bad ELSE 0 END) AS toxic_lost FROM z GROUP BY ALL),
y AS (SELECT part, own, sum(removed) AS shapley FROM s GROUP BY part, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM s JOIN y USING (part, own)
"""
