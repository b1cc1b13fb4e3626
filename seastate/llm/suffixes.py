"""Repeated strings by a radix sort of suffixes that goes no deeper than a threshold.

Suffixes are told apart by digits, most significant first, and only so far as `least` bytes: what is still together
after the last digit is a repeated window, and nothing else is. A group of one is left out at once, and so never gets
its next digit.

* First digit: a gram in the window, the least one by a hash of its content, and its distance from the start. Windows
  that are equal have the same. Neighbouring starts share the gram, so one entry stands for a whole run of starts, about
  one for 140 bytes; starts of one run are never equal.
* Entries whose runs are equal to the last byte are decided at once and go on as one.
* Second digit: the core, which is what all windows of a block of neighbouring starts have in common.
* Last digit: the whole window, for blocks that share a core and differ outside it.

Digits are 128-bit hashes. An entry's own bytes are fetched once, for runs that meet another by their first digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, kept, materialize, pieces, text_batches

#: Bits of a position in a buffer, under the bits of a gram's hash.
PLACE_BITS = 20
#: Odd numbers: the base of gram hashes, and one that spreads their bits.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Depth:
    """least: bytes of a window; gram: bytes of the first digit; block: starts that share a core; buffer: bytes that are hashed at once."""

    least: int = 400
    gram: int = 128
    block: int = 32
    buffer: int = 1 << 19

    def __post_init__(self):
        if not (0 < self.gram <= self.least and 0 < self.block <= self.least < self.buffer <= 1 << PLACE_BITS):
            raise ValueError(f"{self} doesn't go together")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2^64."""
    base = np.full(n, BASE, np.uint64)
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


def gram_hashes(raw: np.ndarray, gram: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of the gram at each position, from its content alone."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tables[0][:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * tables[1][: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(SPREAD)
    return h ^ h >> np.uint64(29)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys, from minima up to and from the borders of blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def runs(raw: np.ndarray, valid: np.ndarray, depth: Depth, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(first start, last start, place of the gram, hash of the gram) of the runs of valid starts; of equal grams in a window the leftmost counts."""
    h = gram_hashes(raw, depth.gram, tables)
    place = np.uint64((1 << PLACE_BITS) - 1)
    keys = h & ~place | np.arange(len(h), dtype=np.uint64)
    least = window_minima(keys, depth.least - depth.gram + 1)
    start = np.flatnonzero(valid[: len(least)])
    at = (least[start] & place).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return start[new], start[np.append(new[1:], len(start)) - 1], at[new], h[at[new]]


def buffers(texts: list[bytes], depth: Depth) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, offset, bytes) of parts of texts, in lists that fill a buffer; each start whose window fits is in one part, with its window."""
    step, size, own = depth.buffer - depth.least + 1, 0, []
    for k, text in enumerate(texts):
        for at in range(0, len(text) - depth.least + 1, step):
            part = text[at : at + depth.buffer]
            if size + len(part) > depth.buffer:
                yield own
                size, own = 0, []
            own.append((k, at, part))
            size += len(part)
    if own:
        yield own


def content_key(text: Column) -> Column:
    """16 bytes of the text's SHA-256."""
    return F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, 16), F.lit(b""))


def entries(texts: DataFrame, depth: Depth) -> DataFrame:
    """(t, a, span, back, gram, run) of the runs of starts in texts (t, text): first start, starts after it, distance of the gram from it, and hashes of the gram and of the run's bytes."""

    def op(batches):
        tables = kept(f"powers {depth.buffer}", lambda: powers(depth.buffer))
        for batch in pieces(batches, 1):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for own in buffers(texts, depth):
                joined = b"".join(part for _, _, part in own)
                sizes = np.array([len(part) for _, _, part in own])
                begins = sizes.cumsum() - sizes
                valid = np.arange(len(joined)) + depth.least <= np.repeat(begins + sizes, sizes)
                a, b, p, gram = runs(np.frombuffer(joined, np.uint8), valid, depth, tables)
                part = np.searchsorted(begins, a, "right") - 1
                view = memoryview(joined)
                run = [xxhash.xxh3_128_digest(view[i : j + depth.least]) for i, j in zip(a.tolist(), b.tolist())]
                text, shift = (np.array([x[k] for x in own]) for k in (0, 1))
                columns = [(a - begins[part] + shift[part]).astype(np.int32), (b - a).astype(np.int32), (p - a).astype(np.int32), gram.view(np.int64)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(text[part])), *map(pa.array, columns), pa.array(run, pa.binary())], ["t", "a", "span", "back", "gram", "run"])

    return texts.select("t", "text").mapInArrow(op, "t binary, a int, span int, back int, gram long, run binary")


def met(rows: DataFrame, *digit: str) -> DataFrame:
    """The values of a digit that stand in two rows or more."""
    return rows.groupBy(*digit).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")


def with_bytes(edges: DataFrame, texts: DataFrame, depth: Depth) -> DataFrame:
    """edges (t, a, span, back, gram, run, many) with the run's bytes, each run once. texts: (t, text)."""
    spark = edges.sparkSession
    wanted = materialize(spark, edges.groupBy("t").agg(F.collect_list(F.struct("a", "span", "back", "gram", "run", "many")).alias("runs")), "wanted")
    found = texts.join(wanted, "t").select("t", "text", F.explode("runs").alias("r")).select("t", "r.*", F.substring("text", F.col("r.a") + 1, F.col("r.span") + depth.least).alias("bytes"))
    return found.groupBy("run").agg(*(F.first(c).alias(c) for c in found.columns if c != "run"))


def blocks(edges: DataFrame, depth: Depth) -> DataFrame:
    """(run, many, lo, hi, core, own) of the blocks of each run: the starts lo to hi, counted from the run's first one, and the hashes of what their windows share and of all their bytes."""
    q, least = depth.block, depth.least

    def op(batches):
        for batch in pieces(batches, 4):
            out = []
            for run, many, back, gram, data in zip(*(c.to_pylist() for c in batch.columns)):
                span, view = len(data) - least, memoryview(data)
                for j in range((back - span) // q, back // q + 1):
                    lo, hi = max(0, back - j * q - q + 1), min(span, back - j * q)
                    first = back - j * q
                    core = xxhash.xxh3_128_digest(view[first : first - q + 1 + least], (gram ^ j * BASE) & (1 << 64) - 1)
                    out.append((run, many, lo, hi, core, xxhash.xxh3_128_digest(view[lo : hi + least])))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, types)], ["run", "many", "lo", "hi", "core", "own"])

    return edges.select("run", "many", "back", "gram", "bytes").mapInArrow(op, "run binary, many boolean, lo int, hi int, core binary, own binary")


def windows(asked: DataFrame, depth: Depth) -> DataFrame:
    """(run, done, start, window) of each start in asked (run, bytes, blocks of lo, hi and done): the hash of its window."""

    def op(batches):
        for batch in pieces(batches, 1):
            run, done, start, window = [], [], [], []
            for own, data, asked in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(data)
                for block in asked:
                    at = range(block["lo"], block["hi"] + 1)
                    start += at
                    run += [own] * len(at)
                    done += [block["done"]] * len(at)
                    window += [xxhash.xxh3_128_digest(view[k : k + depth.least]) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.binary()), pa.array(done, pa.bool_()), pa.array(start, pa.int32()), pa.array(window, pa.binary())], ["run", "done", "start", "window"])

    return asked.select("run", "bytes", "blocks").mapInArrow(op, "run binary, done boolean, start int, window binary")


def repeated_starts(texts: DataFrame, depth: Depth) -> DataFrame:
    """(t, lo, hi): starts of repeated windows in each text of texts (t, text), as ranges that may overlap."""
    spark = texts.sparkSession
    every = materialize(spark, entries(texts, depth), "entries")
    grams = materialize(spark, met(every, "gram"), "grams")
    some = materialize(spark, every.join(grams, "gram", "left_semi"), "some")
    drop(spark, every, grams)
    # Equal runs are decided and go on as one.
    apart = some.groupBy("run", "gram", "back", "span").agg(F.count("*").alias("n"), F.min(F.struct("t", "a")).alias("at"))
    apart = materialize(spark, apart.select("run", "gram", "back", "span", (F.col("n") > 1).alias("many"), "at.*"), "apart")
    same = materialize(spark, apart.where("many").select("run"), "same")
    whole = some.join(same, "run", "left_semi").select("t", F.col("a").alias("lo"), (F.col("a") + F.col("span")).alias("hi"))
    grams = materialize(spark, met(apart, "gram"), "grams")
    edges = materialize(spark, with_bytes(apart.join(grams, "gram", "left_semi"), texts, depth), "edges")
    # The core.
    split = materialize(spark, blocks(edges, depth), "blocks")
    cores = materialize(spark, met(split, "core"), "cores")
    split = materialize(spark, split.join(cores, "core", "left_semi"), "split")
    own = split.groupBy("core", "own").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(F.struct("run", "lo", "hi")).alias("at"))
    own = materialize(spark, own.select("core", "own", ((F.col("n") > 1) | F.col("many")).alias("done"), "at.*"), "own")
    decided = materialize(spark, own.where("done").select("core", "own"), "decided")
    by_block = split.where(~F.col("many")).join(decided, ["core", "own"], "left_semi").select("run", "lo", "hi")
    # The whole window, of blocks that share a core with another one.
    cores = materialize(spark, met(own, "core"), "cores")
    left = own.join(cores, "core", "left_semi").groupBy("run").agg(F.collect_list(F.struct("lo", "hi", "done")).alias("blocks"))
    last = materialize(spark, windows(edges.join(left, "run"), depth), "windows")
    equal = materialize(spark, met(last, "window"), "equal")
    by_window = last.where(~F.col("done")).join(equal, "window", "left_semi").select("run", F.col("start").alias("lo"), F.col("start").alias("hi"))
    at = edges.where(~F.col("many")).select("run", "t", "a")
    parts = by_block.union(by_window).join(at, "run").select("t", (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))
    return whole.union(parts).distinct()


def repeated_spans(texts: DataFrame, depth: Depth = Depth()) -> DataFrame:
    """(t, spans) of the texts in (t, text) that hold a repeated window: what such windows cover, as maximal runs of bytes."""

    def op(batches):
        for batch in batches:
            made = []
            for own in batch.column(1):
                x = own.values
                lo, hi = (x.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + depth.least)
                new = np.append(True, lo[1:] > end[:-1])
                first = np.flatnonzero(new)
                made.append([{"start": s, "end": e} for s, e in zip(lo[first].tolist(), end[np.append(first[1:], len(lo)) - 1].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["t", "spans"])

    starts = repeated_starts(texts, depth).groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    return materialize(texts.sparkSession, starts.mapInArrow(op, "t binary, spans array<struct<start:long,end:long>>"), "spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: Depth = Depth()) -> DataFrame:
    """(id, n_bytes, spans, kept) of each row of df: the spans of its text's UTF-8 bytes that repeated strings of `least` bytes cover, and the bytes outside them.

    A string counts as repeated where it starts anywhere else, in the same text or another row's, overlaps included;
    strings never cross rows. A repeated row repeats all it holds. Null texts count as empty and, like all texts under
    `least` bytes, keep everything; null ids stay; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", "text", content_key(F.col("text")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(repeated_spans(rows.select("t", "text"), depth), "t", "left").select("id", "text", "spans")

    def op(batches):
        for batch in pieces(batches, 1):
            texts, left = batch.column(1).to_pylist(), []
            for text, spans in zip(texts, batch.column(2).to_pylist()):
                borders = [0, *(x for s in spans or [] for x in (s["start"], s["end"])), len(text)]
                left.append(b"".join(text[i:j] for i, j in zip(borders[::2], borders[1::2])) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), batch.column(2), pa.array(left, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = found.mapInArrow(op, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col).withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")))
