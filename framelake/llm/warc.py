"""WARC archives: write, read in a stream, and resolve revisits by payload digest.

Archives are gzip files of WARC/1.1 records. Spark's text sink writes them:
a record's four closing bytes (CR LF CR LF) are the sink's line separator, so
the committer, not our code, makes each archive appear whole or not at all.
The text source with the same separator hands a gzip file, which can't be
split, to one task piece by piece and in order; :func:`_parse` joins the pieces
and cuts records by ``Content-Length``, so a payload may hold any bytes, also
the separator. A task holds one record and one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

CRLF, END = "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "archive string, record_id string, record_type string, target_uri string, record_date string, "
    "row_key string, payload_digest string, payload_bytes bigint, refers_to_id string, refers_to_key string, payload binary"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("archive", "record_id", "record_type", "target_uri", "record_date", "row_key", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("refers_to_key", pa.string()), ("payload", pa.binary())]
)
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2000


# --- writing -----------------------------------------------------------------


def _line(name: str, value: Column) -> Column:
    """A header line, or null (which concat_ws leaves out) where there is no value; control characters become blanks."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]+", " "))


def _uuid(seed: Column) -> Column:
    h = F.sha1(seed)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(is_revisit: Column) -> Column:
    """The text of one record from the columns of :data:`RECORD_SCHEMA`; a revisit keeps the HTTP head and drops the payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(is_revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("record_date")),
        _line("WARC-Target-URI", F.col("target_uri")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(is_revisit, _line("WARC-Refers-To", F.col("refers_to_id"))),
        F.when(is_revisit, _line("X-Refers-To-Row-Key", F.col("refers_to_key"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("X-Row-Key", F.col("row_key")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    return F.concat(head, F.lit(END), http, body)


def write_archives(records: DataFrame, path: str, is_revisit: Column) -> None:
    """Write one archive for each partition of ``records``.

    Deflated at level 2: on web pages the default level takes four times as
    long to deflate, for archives that are 9 % smaller.
    """
    text = records.select(record_text(is_revisit).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "TWO").text(path)


def as_responses(rows: DataFrame, key: str, uri: str, payload: str, date: str | None = None) -> DataFrame:
    """Rows as response records. A null payload is empty, a null key or URI is left out of the record."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    return rows.select(
        _uuid(F.concat_ws("|", F.col(key).cast("string"), F.col(uri), F.monotonically_increasing_id().cast("string"))).alias("record_id"),
        F.lit(date).alias("record_date"),
        F.col(uri).alias("target_uri"),
        F.col(key).cast("string").alias("row_key"),
        F.sha1(body).alias("payload_digest"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to_id"),
        F.lit(None).cast("string").alias("refers_to_key"),
        body.alias("payload"),
    )


# --- reading -----------------------------------------------------------------


class _Records:
    """Cuts the byte stream of one archive into (header fields, block)."""

    def __init__(self) -> None:
        self.buffer, self.fields, self.started = bytearray(), None, False

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.started:
            self.buffer += END.encode()
        self.started = True
        self.buffer += piece
        while True:
            if self.fields is None:
                start = self.buffer.find(b"WARC/1.")
                stop = self.buffer.find(END.encode(), max(start, 0))
                if start < 0 or stop < 0:
                    return
                lines = self.buffer[start:stop].decode("utf-8", "replace").split(CRLF)[1:]
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                del self.buffer[: stop + 4]
            length = int(self.fields.get("content-length", 0))
            if len(self.buffer) < length:
                return
            fields, block, self.fields = self.fields, bytes(self.buffer[:length]), None
            del self.buffer[:length]
            yield fields, block


def _row(archive: str, f: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    payload = block.partition(END.encode())[2] if "application/http" in f.get("content-type", "") else block
    kind = f.get("warc-type")
    if kind == "revisit":  # its digest and length are those of the payload it stands for
        digest, size = f.get("warc-payload-digest", "").rpartition(":")[2] or None, f.get("x-payload-length")
        size = int(size) if size else None
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return (
        archive, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("x-row-key"),
        digest, size, f.get("warc-refers-to"), f.get("x-refers-to-row-key"), payload if with_payload else None,
    )


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, stream, out, held = None, _Records(), [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        def closing():
            return [_row(archive, f, b, with_payload) for f, b in stream.feed(b"")] if archive is not None else []

        for batch in batches:
            for at, piece in zip(batch.column("archive"), batch.column("piece"), strict=True):
                at = at.as_py()
                if at != archive:
                    out += closing()
                    archive, stream = at, _Records()
                for fields, block in stream.feed(piece.as_py()):
                    out.append(_row(archive, fields, block, with_payload))
                    held += len(block)
                if len(out) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                    if out:
                        yield flush()
                    out, held = [], 0
        out += closing()
        if out:
            yield flush()

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives under ``path``, with the columns of :data:`RECORD_SCHEMA`.

    Digest and length of a response are computed from its payload; a revisit's
    come from its header. Bytes before a record's ``WARC/1.`` are skipped; a
    record cut short at the end of an archive is left out.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_parse(with_payload), RECORD_SCHEMA)


# --- resolving ---------------------------------------------------------------


def resolve_revisits(headers: DataFrame, work: Workspace, min_bytes: int) -> DataFrame:
    """The revisits among response headers: record_id, refers_to_id, refers_to_key.

    Headers are dealt by payload digest. Of at least ``min_bytes`` equal bytes,
    the record with the largest numeric row key stays (ties: the larger record
    id; keys that aren't numbers or are missing rank lowest). Originals are
    aggregated on the map side first, so a digest that holds a third of all
    records sends one row per task, and only digests with several records
    reach the join, whose skewed partitions Spark can split as both sides are
    plain exchanges.
    """
    rank = F.struct(F.expr("try_cast(row_key as bigint)").alias("n"), F.col("record_id"), F.col("row_key"))
    large = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("payload_digest").isNotNull())
    originals = work.stage(
        large.groupBy("payload_digest").agg(F.max(rank).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", "first"), "originals"
    )
    return large.join(originals, "payload_digest").where("record_id <> first.record_id").select("record_id", F.col("first.record_id").alias("refers_to_id"), F.col("first.row_key").alias("refers_to_key"))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 1000, work: Workspace | None = None) -> None:
    """Rewrite the archives under ``source`` to ``target``: equal payloads become revisit records with fresh headers.

    Two passes read the archives: the first keeps headers only. In the second,
    payloads meet the revisits by record id (unique, so never skewed); the
    smaller side, the revisits, is hashed, so payloads aren't sorted.
    """
    work = work or Workspace(spark, "warc")
    headers = work.stage(read_archives(spark, source, with_payload=False).select("record_id", "record_type", "row_key", "payload_digest", "payload_bytes"), "headers")
    revisits = work.stage(resolve_revisits(headers.where("record_type = 'response'"), work, min_bytes), "revisits")
    records = read_archives(spark, source).drop("archive", "refers_to_id", "refers_to_key")
    date = F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    joined = records.join(revisits.hint("shuffle_hash"), "record_id", "left")
    write_archives(joined.withColumn("record_date", date), target, F.col("refers_to_id").isNotNull())
    work.drop("headers", "originals", "revisits")


def warc_revisits(spark: SparkSession, pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives, deduplicate them, and read the result back: one row per page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.
    Nulls: a null payload is the empty payload; a null key or URI comes back as
    null. Payloads under ``min_bytes``, also empty ones, are always responses.
    Repeated rows are separate records: one is the response, the others revisit
    it. An empty table gives no rows. Other columns of ``pages`` are ignored.
    Keys come back as whole numbers, or as the text they are if their column is
    of another type; of texts, those that aren't numbers rank lowest.
    """
    kind = "bigint" if pages.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    work = Workspace(spark, "warc")
    write_archives(as_responses(pages, key, uri, payload), work.at("captured"), F.lit(False))
    deduplicate_archives(spark, work.at("captured"), work.at("deduplicated"), min_bytes, work)
    work.drop("captured")
    found = read_archives(spark, work.at("deduplicated"), with_payload=False)
    return found.select(
        F.col("row_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast(kind).alias("refers_to"), "target_uri",
    )
