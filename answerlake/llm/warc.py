"""Content-addressed web archive.

Each page becomes a WARC record: an exact header block and a payload. The
archive keeps two tables: payloads, each stored once, gzipped, under its SHA-256
and checked against it on reading, and headers, one exact block for each record.
Of records with equal payloads one is the response, the others revisit it and
carry no bytes. Original records come back by joining both tables, and what the
query returns is read from them: page ids, lengths and digests from the rebuilt
records, what a revisit refers to by its WARC-Refers-To and that record's id.

A task stores a payload once however often it meets it, then tasks' copies are
merged by digest. Record ids hash the page id and the row's number, so repeated
rows have ids of their own; they depend on how the rows are divided.

A null payload is the empty payload. Records with equal payloads all but one
revisit, repeated rows of the chosen page included, as many as there are: the
response is marked by page, so these share its mark (ties). A null page id loses
to any other. Null urls give an empty target line. Very long payloads are held
whole, one at a time. Only the columns named are read, clashing ones are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import common
from answerlake.session import shared_path

#: Payloads from this size on are stored once for all records.
MIN_SHARED_BYTES = 0
#: Rows that a task rebuilds at a time.
_ROWS = 64
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_EOL))


def _record_id(page: Column, number: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _stored_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha256, payload, sha1, bytes) of each payload that the task has not met before."""
    met: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            rows = []
            for value in batch.column(0).slice(at, _ROWS):
                payload = value.as_py()
                digest = hashlib.sha256(payload)
                if digest.digest() not in met:
                    met.add(digest.digest())
                    rows.append((digest.hexdigest(), zlib.compress(payload, 1), base32_sha1(payload), len(payload)))
            types = (pa.string(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, types)], names=["sha256", "payload", "sha1", "bytes"])


def _checked(sha256: str, stored: bytes) -> bytes:
    """The payload that is stored under its digest; anything else stops the job."""
    try:
        payload = zlib.decompress(stored)
    except zlib.error:
        payload = None
    if payload is None or hashlib.sha256(payload).hexdigest() != sha256:
        raise ValueError(f"damaged payload {sha256}")
    return payload


def write_archive(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  date: str = "2000-01-01T00:00:00Z", min_shared_bytes: int = MIN_SHARED_BYTES) -> str:
    """Write the tables ``payloads`` and ``headers`` under ``path``."""
    spark = common.ready(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b""))
    once = pages.select(payload.alias("payload")).mapInArrow(_stored_once, "sha256 string, payload binary, sha1 string, bytes long")
    once.groupBy("sha256").agg(*[F.first(c).alias(c) for c in ("payload", "sha1", "bytes")]).write.parquet(f"{path}/payloads")
    raw = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.coalesce(F.col(f"`{url_column}`").cast("string"), F.lit("")).alias("url"), F.sha2(payload, 256).alias("sha256"))
    # Written once, so that the row numbers stay what they are.
    records = common.stored(raw.withColumn("number", F.monotonically_increasing_id()), "warc-records")
    holders = records.groupBy("sha256").agg(F.max(F.struct("page_id", "number")).alias("holder"))
    facts = spark.read.parquet(f"{path}/payloads").select(F.col("sha256").alias("f_sha256"), "sha1", "bytes")
    held = common.stored(holders.join(facts, F.col("sha256") == F.col("f_sha256")).select(F.col("sha256").alias("h_sha256"), "holder", "sha1", "bytes"), "warc-holders")
    linked = records.join(held, F.col("sha256") == F.col("h_sha256"))
    revisit = (F.col("bytes") >= min_shared_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("number"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(_line("X-Page-ID", F.col("page_id").cast("string"))),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), _line("WARC-Date", date), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("holder.page_id"), F.col("holder.number"))), _line("WARC-Profile", _PROFILE))).otherwise(F.lit("")),
        _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(_EOL))
    linked.select("sha256", header.alias("header")).write.parquet(f"{path}/headers")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload): stored payloads whose bytes have the digest they are stored under; others stop the job."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_checked(k.as_py(), p.as_py()) for k, p in zip(*part.columns)], pa.binary())], names=["sha256", "payload"])

    return spark.read.parquet(f"{path}/payloads").select("sha256", "payload").mapInArrow(check, "sha256 string, payload binary")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header table with the fields of each exact block parsed out."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ?([^\r\n]*)", 1), F.lit(""))
    return spark.read.parquet(f"{path}/headers").select(
        "*", field("X-Page-ID").cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to_id"), field("WARC-Target-URI").alias("url"), field("Content-Length").cast("long").alias("content_length"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record, payload): the record as in a WARC file, and the payload that it has or refers to."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(f"{_EOL}{_EOL}").cast("binary")
    return joined.select("page_id", F.concat(F.col("header").cast("binary"), own, end).alias("record"), "payload")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read from its bytes.

    Responses are put together from header and stored payload and read again;
    revisits take length and digest from the response that their header names.
    """
    headers = read_headers(spark, path)
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("sha256").alias("p_sha256"), "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for sha256, header, payload, length, digest in zip(*batch.columns):
                record = header.as_py().encode() + _checked(sha256.as_py(), payload.as_py()) + b"\r\n\r\n"
                block = record[record.index(b"\r\n\r\n") + 4:-4]
                if len(block) != length.as_py() or base32_sha1(block) != digest.as_py():
                    raise ValueError(f"header and payload differ: {sha256.as_py()}")
                sizes.append(len(block))
                digests.append(base32_sha1(block))
            yield pa.RecordBatch.from_arrays([batch.column("header"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["header", "bytes", "digest"])

    whole = headers.filter("record_type = 'response'").join(stored, F.col("sha256") == F.col("p_sha256")).select("sha256", "header", "payload", "content_length", "payload_digest")
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ?([^\r\n]*)", 1), F.lit(""))
    responses = common.stored(whole.mapInArrow(read, "header string, bytes long, digest string").select(
        field("WARC-Record-ID").alias("record_id"), field("X-Page-ID").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")), "warc-responses")
    known = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("found"))
    # A revisit whose response is missing or has another digest stops the job.
    linked = headers.filter("record_type = 'revisit'").select("record_id", "page_id", "payload_digest", "refers_to_id").join(known, "refers_to_id", "left")
    digest = F.when(F.col("found").eqNullSafe(F.col("payload_digest")), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("nothing to revisit for "), F.col("record_id"))))
    return responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        linked.select("record_id", "page_id", "payload_bytes", digest.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_path(common.ready(spark), "warc"))
    common.remember(f"{path}/payloads", f"{path}/headers")
    return rebuilt(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS holder FROM p),
q AS (SELECT *, [CAST('0x' || h[1:10] AS BIGINT), CAST('0x' || h[11:20] AS BIGINT), CAST('0x' || h[21:30] AS BIGINT), CAST('0x' || h[31:40] AS BIGINT)] AS v FROM r)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to
FROM q
"""
