"""WARC archives: writing captures, reading records, and joining the records of a capture.

A capture is a response or revisit record with the request and metadata records that name it in
WARC-Concurrent-To.  Readers see records in any order and from any file; a join brings them together in one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_table, open_store, put_file, run_dir

#: Fixed values of the format: version line, profile of a revisit by equal payload.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, http string, fields map<string,string>, payload binary"
ARROW = pa.schema(
    [(x, pa.string()) for x in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("http", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    """The same for the same page and payload wherever and whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{kind}/{page_id}/{digest}')}>"


def record(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """A record as a gzip member of its own, so that archives can be cut at records."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None), b"", b""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + block + b"\r\n\r\n") + z.flush()


def capture(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, date: str, level: int) -> bytes:
    """The request, response or revisit, and metadata records of one page."""
    digest, first = digest32(payload), response_id == page_id
    uri = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    main, asked = record_id("capture", page_id, digest), record_id("request", page_id, digest)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    where = urlsplit(uri or "")
    request = f"GET {where.path or '/'}{'?' + where.query if where.query else ''} HTTP/1.1\r\nHost: {where.netloc}\r\n\r\n".encode()
    fields = f"page_id: {json.dumps(page_id)}\r\nurl: {json.dumps(url)}\r\n".encode()
    refers = [("WARC-Refers-To", record_id("capture", response_id, digest)), ("WARC-Profile", SAME_PAYLOAD)]
    return b"".join(
        [
            record([("WARC-Type", "request"), ("WARC-Record-ID", asked), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http;msgtype=request")], request, level),
            record(
                [("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", main), *common, *([] if first else refers), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")],
                answer + payload if first else answer,
                level,
            ),
            # Metadata names the request, which names the capture: identifiers may chain.
            record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), ("WARC-Concurrent-To", asked), *common, ("Content-Type", "application/warc-fields")], fields, level),
        ]
    )


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2020-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Write the captures of ``pages(page_id, url, html)`` and return the archives' paths.

    A null html is an empty payload, a null url leaves out the target, and a null ``page_id`` counts as below all others.  Of equal
    payloads, empty ones too, the largest ``page_id`` has the response and the others revisit it; rows that repeat its id
    are responses too.  An empty table makes no archive; other columns are ignored.
    """
    folder = folder or run_dir(pages.sparkSession, "warc")
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    # A table of its own, so that the join with it can be split where one payload has much of all rows.
    first = keep_table(rows.groupBy("digest").agg(F.max("page_id").alias("response_id")).withColumnRenamed("digest", "of"), "warc-responses")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def fill(out):
            out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", None, uri)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
            b = head
            while b is not None:
                for k in range(b.num_rows):
                    page_id, url, payload, response_id = (c[k].as_py() for c in b.columns)
                    out.write(capture(page_id, url, payload.encode(), response_id, date, level))
                b = next(batches, None)

        put_file(uri, fill)
        yield pa.RecordBatch.from_pydict({"path": [uri]})

    joined = rows.join(first, F.col("digest") == F.col("of")).select("page_id", "url", "html", "response_id")
    listed = run_dir(pages.sparkSession, "warc-files")
    joined.mapInArrow(write, "path string").write.parquet(listed)
    return pages.sparkSession.read.schema("path string").parquet(listed)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, their names in lower case, and block of each record of an archive, compressed or not."""
    data = io.BufferedReader(stream, 1 << 20)
    if data.peek(2)[:2] == b"\x1f\x8b":
        data = io.BufferedReader(gzip.GzipFile(fileobj=data), 1 << 20)
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:80]!r}")
        headers, last = {}, ""
        while (line := data.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:  # a folded line goes on with the one before
                headers[last] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
        n = int(headers.get("content-length", 0))
        block = data.read(n)
        if len(block) < n:
            raise ValueError("the archive ends within a record")
        yield headers, block


def parsed(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, http, payload, fields, size = headers.get("warc-type", ""), None, None, None, None
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        lengths = [int(x.partition(":")[2]) for x in http.split("\r\n")[1:] if x.lower().startswith("content-length:")]
        if kind == "revisit":
            size, payload = (lengths or [None])[0], None
        elif kind == "response":
            size, found = len(payload), digest32(payload)
            if digest not in (None, found):
                raise ValueError(f"{headers.get('warc-record-id')}: the payload is not that of its digest")
            digest = found
    elif headers.get("content-type", "") == "application/warc-fields":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
    return {
        "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "payload_digest": digest, "payload_bytes": size, "http": http, "fields": None if fields is None else list(fields.items()), "payload": payload if with_payload else None,
    }


def read_records(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives at ``files(path)``, a row each; payloads are hashed and measured even where they are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b[0].to_pylist():
                system, at = open_store(path)
                rows, held = [], 0
                with system.open_input_stream(at) as f:
                    for headers, block in records(io.BytesIO(f.read()) if not hasattr(f, "readinto") else f):
                        rows.append(parsed(headers, block, with_payload))
                        held += len(block)
                        if len(rows) >= 2000 or held > 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each response or revisit among the records ``found``: capture, request and metadata.

    A record belongs to the capture that its concurrent-to identifier names, or that the request so named
    names.  A capture without request or metadata has null there; records whose identifier names nothing are left out.  If several
    requests or metadata records name one capture, the one with the smallest identifier is taken.
    """
    main = found.filter(F.col("type").isin("response", "revisit"))
    side = found.filter(F.col("type").isin("request", "metadata"))
    one = lambda df, key, name: df.groupBy(F.col(key).alias("of")).agg(F.min_by(F.struct("record_id", "http", "fields"), "record_id").alias(name))
    asked = side.filter("type = 'request'")
    # Metadata that names a request is passed on to the capture that the request names.
    relay = asked.select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("to")).dropDuplicates(["via"])
    told = side.filter("type = 'metadata'").join(relay, F.col("concurrent_to") == F.col("via"), "left").withColumn("of_capture", F.coalesce("to", "concurrent_to"))
    requests, notes = one(asked, "concurrent_to", "request"), one(told, "of_capture", "metadata")
    with_request = main.join(requests, main["record_id"] == requests["of"], "left").drop("of")
    return with_request.join(notes, with_request["record_id"] == notes["of"], "left").drop("of").select(
        "record_id", "target_uri", "date", F.struct("type", "http", "payload_digest", "payload_bytes", "refers_to", "payload").alias("capture"), "request", "metadata"
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back, and return per page what its capture says."""
    found = keep_table(captures(read_records(write_archives(pages), with_payload=False)), "warc-captures")
    page = F.get_json_object(F.concat(F.lit('{"x":'), F.col("metadata.fields")["page_id"], F.lit("}")), "$.x").cast("long")
    rows = found.select("record_id", page.alias("page_id"), "capture.payload_bytes", "capture.payload_digest", F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"))
    origin = rows.filter("record_type = 'response'").select(F.col("record_id").alias("origin"), F.col("page_id").alias("refers_to")).dropDuplicates(["origin"])
    return rows.join(origin, F.col("to") == F.col("origin"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) AS BIGINT) * (16 >> k))) AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
