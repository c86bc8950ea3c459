"""WARC archives from a page table and back, as a chunked record table.

Writing: each partition writes one archive into a shared folder, one record per row and one gzip member per record, the
payload in pieces of ``CHUNK`` bytes. A file gets its attempt's own name, and only files named by tasks that succeeded are in the manifest
that the job returns, so that retried and speculative tasks leave nothing behind that is read. Reading: an archive is
streamed as rows (record, chunk number, bytes so far, digest so far, last); each carries the running SHA-256, so no
record is ever whole in memory, and a record's last row has its length and digest. A row holds a chunk at most.

Of records with equal payloads of at least ``SMALLEST`` bytes the smallest id is a response, all others revisits of it
(rows that repeat the smallest id are responses too); shorter payloads are all responses. Null payloads are empty. Rows
with a null id are responses with a null id. Other columns are not read.

Archives go through pyarrow's file systems, so that the folder may be any store that these know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.storage import scratch

CHUNK, SMALLEST, LEVEL = 1 << 20, 100, 3
END = b"\r\n\r\n"


def decisions(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload binary, digest, refers_to): refers_to is null for responses."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= SMALLEST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    # short payloads meet nothing, so their rows are spread by id and not by a digest that many share
    key = F.when(F.octet_length("payload") >= SMALLEST, F.col("digest")).otherwise(F.xxhash64("id", "url").cast("string"))
    joined = rows.withColumn("key", key).join(firsts, F.col("key") == F.col("d"), "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.col("first") < F.col("id"), F.col("first")).alias("refers_to"))


def _head(page: int | None, url: str | None, n: int, digest: str, refers: int | None) -> bytes:
    from uuid import NAMESPACE_URL, uuid5

    uri = re.sub(r"[\x00-\x20\x7f]", "", url or "") or "about:blank"
    name = lambda i: f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{i}:{digest}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"] + ([f"X-Page-ID: {page}"] if page is not None else [])
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Page: {refers}"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {n if refers is None else 0}"]).encode() + END


#: Spark's settings of S3 stores, and what pyarrow calls them.
S3 = {"access.key": "access_key", "secret.key": "secret_key", "session.token": "session_token", "endpoint": "endpoint_override", "endpoint.region": "region"}


def store_options(spark: SparkSession) -> dict[str, str]:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {theirs: v for ours, theirs in S3.items() if (v := conf.get(f"fs.s3a.{ours}"))}


def store_of(folder: str, options: dict[str, str]) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; Spark's s3a and s3n are s3, with Spark's own settings."""
    if re.match(r"s3[an]?://", folder) and options:
        return pafs.S3FileSystem(**options), folder.split("://", 1)[1]
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write archives below ``folder`` (a URI); gives their manifest (path, records) once it is computed."""
    chunk, options = CHUNK, store_options(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = store_of(folder, options)
        store.create_dir(base, recursive=True)
        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n = 0
        with store.open_output_stream(path, compression=None, buffer_size=1 << 20) as f:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, digest, refers = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                    body = memoryview(batch.column(2)[i].as_buffer())
                    with gzip.GzipFile(fileobj=f, mode="wb", compresslevel=LEVEL, mtime=0) as member:
                        member.write(_head(page, url, len(body), digest, refers))
                        for at in range(0, len(body) if refers is None else 0, chunk):
                            member.write(body[at : at + chunk])
                        member.write(END)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return decisions(pages, id_col, payload_col).mapInArrow(run, "path string, records long")


SCHEMA = "page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, bytes_so_far long, digest_so_far string, last boolean, chunk binary"


def chunk_rows(stream, chunk: int = CHUNK, payload: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA from one archive's open stream; an empty payload has one empty chunk."""
    left = b""

    def more(n: int) -> bytes:
        nonlocal left
        while len(left) < n and (got := stream.read(max(n - len(left), 1 << 16))):
            left = left + got if left else got
        out, left = left[:n], left[n:]
        return out

    while True:
        while END not in left and (got := stream.read(1 << 16)):
            left += got
        if not left.strip():
            return
        head, left = left.split(END, 1)
        field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        page, refers = field.get("X-Page-ID"), field.get("X-Refers-To-Page")
        fixed = (int(page) if page else None, field["WARC-Type"], int(refers) if refers else None, field["WARC-Payload-Digest"].removeprefix("sha256:"), int(field["X-Payload-Length"]))
        size, seen, no, running = int(field["Content-Length"]), 0, 0, sha256()
        while True:
            part = more(min(chunk, size - seen))
            if len(part) < min(chunk, size - seen):
                raise OSError("an archive ends inside a record")
            seen += len(part)
            running.update(part)
            yield *fixed, no, seen, running.copy().hexdigest(), seen == size, part if payload else None
            no += 1
            if seen == size:
                break
        if more(len(END)) != END:
            raise OSError("a record is longer than it says")


def read(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The chunked record table (SCHEMA) of the archives in a manifest; without payload, chunks are null."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names, options = [c.split(" ")[0] for c in SCHEMA.split(", ")], store_options(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder, options)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as f:
                    rows, held = [], 0
                    for row in chunk_rows(f, payload=payload):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return manifest.select("path").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to, intact) of each row, from archives written and read."""
    spark: SparkSession = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write(pages, folder, id_col, payload_col).collect()  # one short row per partition
    files = spark.createDataFrame([(r["path"],) for r in manifest], "path string").repartition(max(1, len(manifest)))
    last = read(files, folder, payload=False).where("last")
    whole = F.col("record_type") == "response"
    return last.select(
        F.col("page_id").alias(id_col), F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to",
        (~whole | (F.col("digest_so_far") == F.col("declared_digest"))).alias("intact"),
    )


SQL = """
with p as (select page_id, coalesce(html, '') as body, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p where strlen(body) >= 100 group by h)
select page_id, strlen(body)::bigint as payload_bytes, p.h as payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to, true as intact
from p left join f on f.h = p.h
"""
