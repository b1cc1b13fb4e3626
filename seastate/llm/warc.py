"""A deterministic sharded WARC writer and a reader.

Records are sorted by (page id, digest) over the whole table; shards are ranges of that order with about equal payload
bytes, cut exactly by running sums. Each shard goes to the task of its number, which streams it, one gzip member a
record, and rolls to a new file when the compressed size passes a limit. Files get temporary names. What the tasks that
Spark has accepted have written is a table; by it tasks give the files their final names, and the manifest is written
in parts. A lost or repeated task leaves nothing behind, and nothing but the manifest's totals goes through the driver.
Contents don't depend on partitions or executors.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop, materialize, remove, table_path, text_batches

#: Payload bytes of a shard (more where there would be over MOST_SHARDS, as their cuts are broadcast), compressed bytes after which a file is rolled, and the least payload that is revisited.
SHARD_BYTES, MOST_SHARDS, FILE_BYTES, REVISIT_BYTES = 64 << 20, 100_000, 64 << 20, 100
#: Rows of the sorted metadata in one range partition, at about.
RANGE_ROWS = 200_000
LEVEL = 5
#: Compressed bytes that the reader takes at once.
STEP = 16 << 10
#: A fixed date: archives of equal tables are equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs
MANIFEST = "shard long, number long, name string, records long, bytes long, sha256 string"


def member(raw: bytes) -> bytes:
    """A gzip member without time or name."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def record(page_id, url: str | None, digest: str, payload: bytes, refers_to=None, revisit: bool = False, number: int = 0) -> bytes:
    """A WARC/1.1 record: headers made anew, digests over the full payload. A revisit has no block."""
    name = lambda page, k: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}/{k}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id, number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').encode('ascii', 'backslashreplace').decode().replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = payload
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
        block = b""
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(archive: bytes):
    """(headers, block) of each record of a gzip archive with a member for each record; damage raises."""
    view, at = memoryview(archive), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:  # by small steps, as what follows a member is copied
            step = view[at : at + STEP]
            if not step:
                raise ValueError("a truncated archive")
            parts.append(d.decompress(step))
            at += len(step)
        at -= len(d.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("a damaged record")
        yield headers, block


def _cuts(spark: SparkSession, meta: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first sort key of each shard but the first: so many as the payload fills shards. meta has null, id, digest, size.

    Repeated keys lie in one shard. Sums are exact and the order is total, so the cuts don't depend on the partitioning.
    """
    keys = meta.groupBy("null", "id", "digest").agg(F.sum("size").alias("size"))
    rows, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= shard_bytes:
        return []
    n = max(1, math.ceil(rows / RANGE_ROWS))
    ranged = materialize(spark, keys.repartitionByRange(n, "null", "id", "digest").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("sum"))  # a row for each RANGE_ROWS rows
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("null", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(before, "part").select("null", "id", "digest", F.floor((F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))) / shard_bytes).alias("shard"))
    cuts = placed.groupBy("shard").agg(F.min(F.struct("null", "id", "digest")).alias("first")).collect()  # MOST_SHARDS rows at most
    drop(spark, ranged)
    return sorted(tuple(r["first"]) for r in cuts)[1:]


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of df to archives in folder, a URI that pyarrow.fs can write to; return the manifest, a row for each file.

    The payload is payload_col in UTF-8 (null: empty). Of records with equal payloads of REVISIT_BYTES or more, that
    with the smallest id is the response (of repeated ids the first in the order of URLs; null ids come last); the
    others are revisits. An empty table gives an empty manifest. The id must be a whole number. Other columns aren't read.
    """
    spark = df.sparkSession
    text_batches(spark, 200)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("null", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    meta = materialize(spark, rows.select("null", "id", "digest", "size"), "meta")
    cuts = _cuts(spark, meta, shard_bytes)
    # a mark, before the records of its key, says which id the digest's response has; only equal payloads get marks
    first = meta.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(F.struct("null", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(spark, first, "first")
    marks = meta.where(F.col("size") >= REVISIT_BYTES).join(first, "digest").select("null", "id", "digest").distinct().join(first, "digest")
    marks = marks.select("null", "id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), F.col("first.null").alias("no_id"), F.col("first.id").alias("refers_to"))
    both = rows.select("null", "id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("boolean").alias("no_id"), F.lit(None).cast("long").alias("refers_to")).unionByName(marks)
    place = spark.sparkContext.broadcast(cuts)  # MOST_SHARDS keys at most

    @F.pandas_udf("long")
    def shard(null, id, digest):
        import pandas as pd

        return pd.Series([bisect.bisect_right(place.value, x) for x in zip(null.tolist(), id.tolist(), digest.tolist())], dtype="int64")

    folder = folder.rstrip("/")
    temporary = f"{folder}/_temporary/{uuid.uuid4().hex}"

    def op(batches):
        fs, path = pafs.FileSystem.from_uri(temporary)
        now, stream, size, count, number, refers, seen, key = None, None, 0, 0, 0, None, 0, None
        made = []

        def close():
            nonlocal stream, size, count, number
            if stream is not None:
                stream.close()
                made.append((now, number, name, temp, count, size, digest_of.hexdigest()))
                stream, size, count, number = None, 0, 0, number + 1

        for batch in batches:
            for s, null, id, digest, kind, url, payload, no_id, to in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    close()
                    now, number = s, 0
                if (null, id, digest) != key:
                    key, refers, seen = (null, id, digest), None, 0
                if kind == 0:
                    refers = (no_id, to)
                    continue
                revisit = refers is not None and ((null, id) != refers or seen > 0)
                raw = payload.encode()
                data = member(record(None if null else id, url, digest, raw, None if refers is None or refers[0] else refers[1], revisit, seen))
                seen += 1
                if stream is not None and size + len(data) > file_bytes:
                    close()
                if stream is None:
                    name = f"{now:06d}-{number:05d}.warc.gz"
                    temp = f"{uuid.uuid4().hex}-{name}"  # each attempt has names of its own
                    fs.create_dir(path, recursive=True)
                    stream, digest_of = fs.open_output_stream(f"{path}/{temp}", compression=None), hashlib.sha256()
                stream.write(data)
                digest_of.update(data)
                size, count = size + len(data), count + 1
        close()
        columns = list(zip(*made)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "number", "name", "temporary", "records", "bytes", "sha256"])

    def rename(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        _, temp = pafs.FileSystem.from_uri(temporary)
        for batch in batches:
            for at, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if fs.get_file_info(f"{temp}/{at}").type == pafs.FileType.File:  # else an earlier attempt has done it
                    fs.move(f"{temp}/{at}", f"{path}/{name}")
                elif fs.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
                    raise ValueError(f"{name} is lost")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("shard", "number", "name", "records", "bytes", "sha256")], ["shard", "number", "name", "records", "bytes", "sha256"])

    # each shard to the task of its number
    dealt = both.withColumn("shard", shard("null", "id", "digest")).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "null", "id", "digest", "kind", "url")
    listed = dealt.select("shard", "null", "id", "digest", "kind", "url", "payload", "no_id", "refers_to").mapInArrow(op, "shard long, number long, name string, temporary string, records long, bytes long, sha256 string")
    listed = materialize(spark, listed, "listed")
    listed.mapInArrow(rename, MANIFEST).write.json(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    totals = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first().asDict()
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json", compression=None) as f:  # last: with it the archive is whole
        f.write(json.dumps(totals | {"shards": len(cuts) + 1, "parts": "manifest"}, indent=1).encode())
    remove(spark, f"{folder}/_temporary")
    drop(spark, meta, first, listed)
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record in the archives that the manifest names.

    For a response, bytes and digest are taken from the block read; for a revisit, from its headers, and the payload is
    null. A file that is missing, or whose digest isn't the manifest's, raises.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    folder = folder.rstrip("/")
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        if not json.loads(f.read())["files"]:
            return spark.createDataFrame([], schema)
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest").select("name", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = manifest.join(files, "name", "left").select("name", "sha256", "content")

    def op(batches):
        fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        whole = lambda s: int(s) if s else None
        for batch in batches:
            for name, digest, content in zip(*batch.columns):
                content = content.as_py()
                if content is None or hashlib.sha256(content).hexdigest() != digest.as_py():
                    raise ValueError(f"{name} is missing or damaged")
                out = []
                for h, block in parse(content):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response":
                        if hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError("a payload that differs from its digest")
                        out.append((whole(h["X-Page-ID"]), h["WARC-Target-URI"], len(block), digest, "response", None, block))
                    else:
                        out.append((whole(h["X-Page-ID"]), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, "revisit", whole(h["X-Refers-To-Page-ID"]), None))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)

    return files.mapInArrow(op, schema)


def checked(records: DataFrame) -> DataFrame:
    """The rows of records (page_id, payload_digest, record_type, refers_to and others); a revisit without the response that it refers to raises.

    The responses that revisits refer to are matched by digest, aggregated to one row each before the join.
    """
    answers = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("null"), "page_id")).alias("first"))
    met = records.join(answers, "payload_digest", "left")
    lost = (F.col("record_type") == "revisit") & ~F.coalesce(F.col("refers_to").eqNullSafe(F.col("first.page_id")) & F.col("first").isNotNull(), F.lit(False))
    return met.select(*(F.when(lost, F.raise_error(F.lit("a revisit without its response"))).otherwise(F.col(c)).alias(c) if c == "record_type" else c for c in records.columns))


def round_trip(df: DataFrame, **names) -> DataFrame:
    """Write df to a new folder of the shared one and read the archives back; an empty table gives no rows."""
    folder = table_path(df.sparkSession, "warc")
    if "://" not in folder:  # a bare path, or file:/path
        folder = "file://" + folder.removeprefix("file:")
    write(df, folder, **names)
    return read(df.sparkSession, folder)

