"""WARC archives of web pages with revisit records for repeated payloads.

Headers (page id, URL, payload digest and size) are combined by digest to find the
original of each payload.  Revisit records are made of headers alone; of the payloads only
those of originals are written, each record a gzip member of its own, so that records can
be sought, in WARC 1.1 files of bounded size that begin with a warcinfo record.  Reading
takes records by their Content-Length, and revisits join the original responses again.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import body, cut
from mensura.llm.components import joined_unskewed

FILE_BYTES = 16 << 20
BROADCAST_ROWS = 1 << 17  # digests of 32 characters with an id: some 8 MB
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INFO = b"software: mensura\r\nformat: WARC File Format 1.1\r\n"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 digest in upper-case base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Response and revisit records of pages.

    Both have ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``copy``, ``refers_to`` and ``refers_url``, and responses their ``payload`` (text).  Of
    equal payloads of ``least_bytes`` and more, the page with the smallest id is the
    response and the others revisit it; a null id is larger than any other, and of rows of
    one id that with the least URL is the first.  Rows that repeat id, URL and payload are
    one response and revisits with ``copy`` 2, 3 and so on; smaller payloads are responses
    all, of ``copy`` 1.  A null payload counts as empty, and payloads of any size are whole.
    """
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body(html_col).alias("payload"))
    known = known.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    key = ["payload_digest", "payload_bytes"]
    heads = known.where(F.col("payload_bytes") >= least_bytes).groupBy(*key, "page_id", "url").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    originals = cut(
        heads.groupBy(*key)
        .agg(F.sum("rows").alias("n"), F.min(F.struct(order.alias("at"), "rows")).alias("first"))
        .where("n > 1")
        .select(*key, "n", F.col("first.at.page_id").alias("first_id"), F.col("first.at.url").alias("first_url"), (F.col("first.rows") > 1).alias("tied"))
    )
    few = originals.count() <= BROADCAST_ROWS
    found = known.join(F.broadcast(originals), key, "left") if few else joined_unskewed(known, originals, key, "left")
    first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    written = found.where(F.col("n").isNull() | first)
    if not originals.where("tied").isEmpty():
        repeated = F.coalesce("tied", F.lit(False))
        written = written.where(~repeated).unionByName(written.where(repeated).dropDuplicates(key))
    lone = {"copy": F.lit(1), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string"), "record_type": F.lit("response")}
    columns = ["page_id", "url", *key, "record_type", "copy", "refers_to", "refers_url"]

    least = F.when(first, 2).otherwise(1)
    again = joined_unskewed(heads, originals, key).where(~first | (F.col("rows") > 1))
    again = again.withColumn("copy", F.explode(F.sequence(least, F.col("rows").cast("int"))))
    again = again.withColumns({"record_type": F.lit("revisit"), "refers_to": F.col("first_id"), "refers_url": F.col("first_url")})
    return written.withColumns(lone).select(*columns, "payload"), again.select(*columns)


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    code = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(code, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(resolved: DataFrame, payload: Column | None = None) -> DataFrame:
    """WARC records in the column ``value``, with the payload if there is one."""

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def uri(value: Column) -> Column:
        return F.regexp_replace(value, r"[\x00-\x20]", "")

    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    size = F.octet_length(http) + (F.lit(0) if payload is None else F.col("payload_bytes"))
    own = _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("copy"))
    fields = [
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", own),
        header("WARC-Date", now),
        header("WARC-Target-URI", uri(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
    ]
    if payload is None:
        fields += [
            header("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"), F.lit(1))),
            header("WARC-Refers-To-Target-URI", uri(F.col("refers_url"))),
            header("WARC-Refers-To-Date", now),  # originals are written at the same time
            header("WARC-Profile", F.lit(_PROFILE)),
        ]
    fields += [
        header("X-Page-ID", F.col("page_id").cast("string")),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", size.cast("string")),
    ]
    return resolved.select(F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), http, *([] if payload is None else [payload]), F.lit("\r\n\r\n")).alias("value"))


def _archives(batches, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives that end with the record that passes ``file_bytes``, one in a row."""
    held = io.BytesIO()
    for batch in batches:
        for value in batch.column(0):
            if not held.tell():
                head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
                held.write(gzip.compress(head % (len(_INFO), _INFO), mtime=0))
            held.write(gzip.compress(value.as_buffer(), 6, mtime=0))
            if held.tell() > file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["value"])
                held = io.BytesIO()
    if held.tell():
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["value"])


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write deduplicated archives of ``pages`` to ``folder``, a store that all executors share.

    The text writer puts out bytes as they are, one row a file, and after each an empty
    gzip member for a line's end.  No pages make an empty folder.
    """
    responses, revisits = resolve_revisits(pages, **columns)
    every = records(responses, F.col("payload")).unionByName(records(revisits))
    files = every.mapInArrow(lambda batches: _archives(batches, file_bytes), "value binary").select(F.col("value").cast("string"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).option("maxRecordsPerFile", 1).text(folder)


def _parse(content: bytes):
    with gzip.open(io.BytesIO(content)) as archive:
        while line := archive.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields = {}
            while (line := archive.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            block = archive.read(int(fields["content-length"]))
            yield fields, block.partition(b"\r\n\r\n")[2]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``.

    Returns ``page_id``, ``url``, ``record_type``, ``record_id``, ``refers_to_record``,
    ``declared_digest`` and ``payload`` (bytes; empty for a revisit); no rows if there are
    no archives.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())]
    )

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, payload in _parse(content.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    page = fields.get("x-page-id")
                    rows.append(
                        {
                            "page_id": int(page) if page else None,
                            "url": fields.get("warc-target-uri"),
                            "record_type": fields["warc-type"],
                            "record_id": fields["warc-record-id"],
                            "refers_to_record": fields.get("warc-refers-to"),
                            "declared_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                            "payload": payload,
                        }
                    )
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(parsed, "page_id long, url string, record_type string, record_id string, refers_to_record string, declared_digest string, payload binary")


def resolved_records(records_read: DataFrame) -> DataFrame:
    """Records with size and digest of the full payload, which a revisit has from its response.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``intact``, whether the digest is the one declared in the header.
    """
    heads = cut(
        records_read.select(
            "page_id",
            "record_type",
            "record_id",
            "refers_to_record",
            "declared_digest",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
        )
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.expr("payload_digest = declared_digest").alias("intact")]
    own = heads.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    original = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    again = heads.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(original, "refers_to_record", "left")
    return own.unionByName(again.select(*columns))
