"""Fill-in-the-middle transformation over an index of distinct texts.

`index` groups identical texts, compares them in full and lists the byte offsets of each distinct text's code points
once, as an Elias-Fano list. `transform` joins the documents back to it by small rows and selects the two offsets of
each document's seeded cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TEXT_BYTES, materialize, pieces, text_batches

#: Documents of one text that meet its index row in one place; more are dealt over several.
COPIES = 500
#: The signs before prefix, suffix and middle.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: Of 100: texts that stay plain, and of the others those with the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of the unary part that share one count of ones.
BLOCK = 64


def starts(text: bytes) -> np.ndarray:
    """The byte offset of each code point, and of the end."""
    raw = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def elias_fano(values: np.ndarray) -> bytes:
    """Non-decreasing numbers in about 2 + log2(largest / how many) bits each.

    Each is cut into some low bits, kept as they are, and the rest, kept as unary gaps; ones before each block of the
    unary part are counted, so that a number is found without reading the list.
    """
    n, largest = len(values), int(values[-1])
    bits = max(0, (largest // n).bit_length() - 1)
    unary = np.zeros(n + (largest >> bits) + 1, np.uint8)
    unary[(values >> bits) + np.arange(n)] = 1
    high = np.packbits(unary, bitorder="little")
    sums = np.add.reduceat(unary, np.arange(0, len(unary), 8 * BLOCK), dtype=np.int64)
    low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
    head = np.array([n, bits, len(sums), len(high)], np.int64)
    return b"".join(x.tobytes() for x in (head, np.cumsum(sums) - sums, high, low))


class EliasFano:
    """Reads numbers of a list that elias_fano() made."""

    def __init__(self, data: bytes):
        self.n, self.bits, blocks, size = (int(x) for x in np.frombuffer(data, np.int64, 4))
        self.ones = np.frombuffer(data, np.int64, blocks, 32)
        at = 32 + 8 * blocks
        self.high = np.frombuffer(data, np.uint8, size, at)
        self.low = np.frombuffer(data, np.uint8, offset=at + size)

    def __getitem__(self, k: int) -> int:
        block = int(np.searchsorted(self.ones, k, "right")) - 1
        own = np.flatnonzero(np.unpackbits(self.high[block * BLOCK : (block + 1) * BLOCK], bitorder="little"))
        rest = 8 * BLOCK * block + int(own[k - self.ones[block]]) - k
        low = 0
        for j in range(self.bits):
            at = k * self.bits + j
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << j
        return rest << self.bits | low


@F.arrow_udf(T.BinaryType())
def boundaries(texts: pa.Array) -> pa.Array:
    """The Elias-Fano list of each text's code points."""
    return pa.array([elias_fano(starts(t)) for t in texts.to_pylist()], pa.binary())


def content_key(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))  # never null, and Spark is to know it


def index(texts: DataFrame) -> DataFrame:
    """(key, text, copies) of each distinct text in texts (key, text), dealt by key; boundaries() lists its code points.

    Texts of one key are compared in full, already before the shuffle; two that differ raise an error.
    """
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
    groups = texts.groupBy("key").agg(F.collect_set("text").alias("texts"), F.count("*").alias("copies"))
    return groups.select("key", one.cast("binary").alias("text"), "copies")


def seeds(id_col: Column) -> list[Column]:
    """h1 to h4 of a document: unsigned 32-bit groups of the SHA-256 of "1:" and its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def cut(text: bytes, offsets: EliasFano, h: tuple[int, int, int, int]) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix_chars, middle_chars, output) of a text for a document's four seeds."""
    if not text or h[2] % 100 >= PLAIN_FROM or any(m in text for m in MARKS.values()):
        return "plain", None, None, text
    a, b = sorted(x % offsets.n for x in h[:2])  # the list holds the end too, so this is one more than the code points
    i, j = offsets[a], offsets[b]
    prefix, middle, suffix = MARKS["P"] + text[:i], MARKS["M"] + text[i:j], MARKS["S"] + text[j:]
    if h[3] % 100 < SUFFIX_FIRST:
        return "spm", a, b - a, suffix + prefix + middle
    return "psm", a, b - a, prefix + suffix + middle


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): a row for each row of df, n in code points.

    A null or empty text is plain and empty; a null id has the seeds of an empty one; repeated rows each have a row, and
    rows with one id and different texts are cut by the same seeds; an empty table gives no rows; other columns are not
    read. Each distinct text crosses the network once for a task that has it, meets its documents' ids and seeds there,
    and is indexed once. Where it has many documents, its index row is repeated and they are dealt over the repeats.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.select("id", "text", content_key(F.col("text")).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    keys = materialize(spark, rows.select("id", "key"), "keys")
    many = materialize(spark, keys.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") > COPIES), "many")
    seeded = F.struct("id", *seeds(F.col("id")))
    dealt = keys.withColumn("row", F.monotonically_increasing_id()).join(many, "key", "left").select("key", "copies", "row", seeded.alias("doc"))
    texts = index(rows.select("key", "text"))
    parts = F.ceil(F.col("copies") / COPIES)
    few = dealt.where(F.col("copies").isNull()).groupBy("key").agg(F.collect_list("doc").alias("docs"))
    alone = texts.where(F.col("copies") <= COPIES).join(few, "key").select("text", "docs").select("text", boundaries("text").alias("list"), "docs")
    some = dealt.where(F.col("copies").isNotNull()).groupBy("key", F.pmod("row", parts).alias("part")).agg(F.collect_list("doc").alias("docs"))
    repeated = texts.where(F.col("copies") > COPIES).select("key", "text", "copies", boundaries("text").alias("list"))
    repeated = repeated.select("key", "text", "list", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = alone.union(repeated.join(some, ["key", "part"]).select("text", "list", "docs"))

    def op(batches):
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.string(), pa.int64(), pa.int64()]
        for batch in pieces(batches):
            docs, made, size = batch.column(2), [], 0
            flat, ends = docs.flatten(), np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False))
            h = list(zip(*(flat.field(k).to_pylist() for k in range(1, 5))))
            at = first = 0
            for text, offsets, end in zip(batch.column(0).to_pylist(), map(EliasFano, batch.column(1).to_pylist()), ends.tolist()):
                for at in range(at, end):
                    made.append((offsets.n - 1, *cut(text, offsets, h[at])))
                    size += len(text)
                    if size > TEXT_BYTES or at + 1 == len(flat):
                        n, *rest, output = zip(*made)
                        columns = [pa.array(x, t) for x, t in zip(rest, types)]
                        yield pa.RecordBatch.from_arrays([flat.field(0).slice(first, len(made)), pa.array(n, pa.int64()), *columns, pa.array(output, pa.binary()).view(pa.string())], names)
                        first, made, size = at + 1, [], 0
                at = end

    out = met.mapInArrow(op, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone: the signs stand nowhere in a text that is cut."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    whole = lambda *order: F.concat(*(part[k] for k in order))
    return F.when(F.col(form) == "psm", whole(1, 3, 2)).when(F.col(form) == "spm", whole(2, 3, 1)).otherwise(F.col(output))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n,
             CAST(concat('0x', substr(s, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(s, 9, 8)) AS BIGINT) AS h2,
             CAST(concat('0x', substr(s, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(s, 25, 8)) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', z, '<P>', x, '<M>', y) ELSE concat('<P>', x, '<S>', z, '<M>', y) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
