"""WARC archives of captures: written by Spark's text writer, read back and put together again.

Each capture is a transaction of three records, a request, a response (or a revisit of a response
with the same payload) and metadata; request and metadata name the response's record in
WARC-Concurrent-To. Captures lie together in gzipped files of about ``FILE_BYTES``, by the mean length of a page,
in a folder that all executors share. Reading walks each file record by record, by Content-Length.

Which capture of a payload is the response comes from one aggregate over payload digests; the
pages are shuffled once, by page_id, to meet that decision.

Null html is an empty payload; null urls are empty. Null page_ids are kept and never the first of
a payload unless all are null. Repeated rows of one page are each a capture of their own; all of
those with a payload's smallest page_id are responses. No pages make no records. Pages with
differing html under one page_id are separate captures.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.llm.storage import shared_path

#: The format's line end and the gap after each record.
END, GAP = "\r\n", "\r\n\r\n"
BATCH = 4 << 20
#: A file holds captures of about FILE_BYTES, and PER_FILE of them at most; one page is never cut.
FILE_BYTES, PER_FILE = 64 << 20, 20_000


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: 40 bits at a time, from digits 0-9A-V to A-Z2-7."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, rid: Column, headers: list[tuple[str, Column]], content: str, block: Column, date: str) -> Column:
    head = [F.lit("WARC/1.1" + END + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(END + "WARC-Record-ID: "), rid, F.lit(f"{END}WARC-Date: {date}{END}")]
    for name, value in headers:
        head.append(F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(END))).otherwise(""))
    return F.concat(*head, F.lit(f"Content-Type: {content}{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)


def write(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives (page_id, url, html). Payloads of fewer than ``least`` bytes are never revisited."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = base32(F.sha1(F.col("html").cast("binary"))).alias("digest")
    size = rows.agg(F.coalesce(F.avg(F.octet_length("html") + F.octet_length("url")), F.lit(0.0))).first()[0]
    per_file = int(max(1, min(PER_FILE, FILE_BYTES // (size + 1000))))  # headers are some hundred bytes
    light = rows.select("page_id", digest, F.octet_length("html").cast("long").alias("bytes"))
    captures = light.groupBy("page_id", "digest", "bytes").agg(F.count("*").alias("copies"))
    firsts = captures.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"))
    first = F.when(F.col("bytes") >= least, F.col("first")).otherwise(F.col("page_id"))
    decided = captures.join(firsts, ["digest", "bytes"]).select(F.col("page_id").alias("id"), F.col("digest").alias("key"), "copies", first.alias("first"))
    whole = rows.withColumn("digest", digest)
    joined = whole.join(decided.hint("shuffle_hash"), whole.page_id.eqNullSafe(decided.id) & (whole.digest == decided.key))
    copy = F.when(F.col("copies") > 1, F.concat(F.lit("-"), F.expr("uuid()"))).otherwise("")
    joined = joined.select("page_id", "url", "html", "digest", "first", copy.alias("copy"))

    def rid(kind: str, page: str = "page_id", copy: Column | None = None) -> Column:
        own = F.concat(F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit("-"), F.col("digest"))
        return F.concat(F.lit(f"<urn:capture:{kind}-"), own, F.col("copy") if copy is None else copy, F.lit(">"))

    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("html").cast("string"), F.lit(GAP))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    address = F.regexp_replace("url", r"[\r\n]", " ")
    request = _record("request", rid("request"), [("WARC-Target-URI", address), ("WARC-Concurrent-To", rid("response"))], "application/http;msgtype=request", F.concat(F.lit("GET / HTTP/1.1" + END + "Host: "), host, F.lit(GAP)), date)
    response = _record(
        F.when(again, "revisit").otherwise("response"), rid("response"),
        [("WARC-Target-URI", address), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(again, rid("response", "first", F.lit(""))))],
        "application/http;msgtype=response", F.concat(http, F.when(again, "").otherwise(F.col("html"))), date,
    )
    fields = F.concat(F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END)), F.when(again, F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"), F.lit(END))).otherwise(""))
    metadata = _record("metadata", rid("metadata"), [("WARC-Target-URI", address), ("WARC-Concurrent-To", rid("response"))], "application/warc-fields", fields, date)
    text = F.concat(request, F.lit(GAP), response, F.lit(GAP), metadata)
    (
        joined.select(text.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)
    )


def unzipped(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces."""
    view, z = memoryview(data), zlib.decompressobj(31)
    at = 0
    while at < len(view):
        yield z.decompress(view[at : at + (1 << 18)])
        at += 1 << 18
        while z.eof and (z.unused_data or at < len(view)):
            rest, z = z.unused_data, zlib.decompressobj(31)
            if not rest:
                break
            yield z.decompress(rest)
    yield z.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a gzipped file."""
    held, at = bytearray(), 0
    stream = unzipped(data)

    def more(n: int) -> bool:
        """Whether n bytes from ``at`` could be had."""
        nonlocal at
        while len(held) - at < n:
            piece = next(stream, None)
            if piece is None:
                return False
            if at > BATCH:
                del held[:at]
                at = 0
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more(len(held) - at + 1):
                if bytes(held[at:]).strip():
                    raise ValueError("an archive ends inside a record")
                return
        head = held[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size, at = int(fields["content-length"]), end + 4
        if not head[0].startswith("WARC/") or not more(size + 4):
            raise ValueError("an archive holds a broken record")
        yield {"version": head[0], **fields}, bytes(held[at : at + size])
        at += size + 4


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, payload string, fields map<string,string>"


def records(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """One row per record of the given types below a folder.

    A response's digest and length are those of its payload as read, which must agree with its header;
    a revisit's are what its headers say of the payload that it doesn't repeat.
    """
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.string()) for n in names[:7]] + [("payload_bytes", pa.int64()), ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def row(head: dict[str, str], block: bytes) -> list:
        kind = head["warc-type"]
        digest = size = payload = None
        fields = []
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                payload, size = body.decode("utf-8", "replace"), len(body)
                if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} isn't what its digest says")
            else:
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        elif kind == "metadata":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
        elif kind == "request":
            payload = block.decode("utf-8", "replace")
        return [head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, size, payload, fields]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    if head["warc-type"] in kinds:
                        rows.append(row(head, block))
                        held += len(block)
                        if held > BATCH or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, request, response, metadata), joined through WARC-Concurrent-To.

    A response without request or metadata keeps a null there.
    """
    main = records(spark, path, ("response", "revisit"))
    asked = records(spark, path, ("request",)).select(F.col("concurrent_to").alias("asked_with"), F.struct("record_id", F.col("payload").alias("http")).alias("request"))
    told = records(spark, path, ("metadata",)).select(F.col("concurrent_to").alias("told_with"), F.struct("record_id", "fields").alias("metadata"))
    return (
        main.join(asked, main.record_id == F.col("asked_with"), "left").join(told, main.record_id == F.col("told_with"), "left")
        .select(F.col("record_id").alias("capture_id"), "target_uri", "request", F.struct("type", "record_id", "refers_to", "warc_date", "payload_digest", "payload_bytes", "payload").alias("response"), "metadata")
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to the shared folder as archives and reads their captures back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return captures(pages.sparkSession, path)
