"""WARC archives: writing records in segments, and reassembling them."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches
from signals.sources.scratch import scratch_path, write_once

#: Bytes of a block after which a record goes on in a continuation, of a transfer chunk, and records of a file.
SEGMENT, CHUNK, RECORDS = 1 << 14, 1 << 12, 2_000
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 100
#: The archives carry no clock of their own, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column, url: Column, digest: Column) -> Column:
    """The record id of a page as a URN, from its content alone; a null part differs from a blank, and each carries its length."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    h = F.md5(F.concat(part(page.cast("string")), part(url), part(digest)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the text writer adds."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    head = "WARC/1.1\r\n" + "\r\n".join(line.replace("\n", " ").replace("\r", " ") for line in lines)
    return head.encode() + b"\r\n\r\n" + block + b"\r\n"


def _records(page: int | None, url: str | None, rid: str, digest: str, refers: str | None, payload: bytes) -> Iterator[bytes]:
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page)]
    payload_digest = ("WARC-Payload-Digest", f"sha256:{digest}")
    if refers is not None:
        own = [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), payload_digest]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, *own], b"")
        return
    body = b"".join(
        b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[at : at + CHUNK] for at in range(0, len(payload), CHUNK))
    )
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + body + b"0\r\n\r\n"
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, payload_digest]
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= SEGMENT:
        yield _record([*first, kind], block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1), kind], block[:SEGMENT])
    starts = range(SEGMENT, len(block), SEGMENT)
    for number, at in enumerate(starts, start=2):
        total = len(block) if at == starts[-1] else None
        own = [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)]
        rest = f"{rid[:-1]}-{number}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", rest), *common, *own], block[at : at + SEGMENT])


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> None:
    """Write one response or revisit record per row into archives of at most ``RECORDS`` records under ``path``.

    The payload is the body in UTF-8, null as empty, sent in transfer chunks; blocks of more than
    ``SEGMENT`` bytes go on in continuation records. Of rows with equal payloads of at least ``MIN_REVISIT`` bytes
    that with the smallest id (null last) is a response and the others revisit it; rows that repeat its id
    too are responses. Archives are compressed with gzip. Null ids and addresses are left out of the headers. Further columns are ignored. The rows are
    written by Spark's text writer, so a lost task leaves nothing behind.
    """
    bound_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    smallest = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "url"))
    repeated = write_once(
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(smallest.alias("o"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", F.col("o.page").alias("origin"), record_id(F.col("o.page"), F.col("o.url"), F.col("digest")).alias("origin_id"))
    )
    revisits = F.col("origin_id").isNotNull() & ~F.col("page").eqNullSafe(F.col("origin"))
    planned = rows.join(repeated, "digest", "left").select(
        "page",
        "url",
        record_id(F.col("page"), F.col("url"), F.col("digest")).alias("rid"),
        "digest",
        F.when(revisits, F.col("origin_id")).alias("refers"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            size = 0
            for row in zip(*batch.columns, strict=True):
                page, url, rid, digest, refers, payload = (x.as_py() for x in row)
                for record in _records(page, url, rid, digest, refers, payload or b""):
                    held.append(record)
                    size += len(record)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    records = planned.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("maxRecordsPerFile", RECORDS).text(path, compression="gzip", lineSep="\r\n")


def archive_bytes(content: bytes) -> bytes:
    """An archive as it is, unpacked if it is compressed with gzip, in one member or many."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (names in lower case) and block of each record; a record cut short ends the archive."""
    at = 0
    while True:
        start = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", start)
        if start < 0 or end < 0:
            return
        headers = {}
        for line in data[start:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(headers.get("content-length", "0"))
        if end + 4 + size > len(data):
            return
        yield start, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP message, with chunked framing taken off; nothing if the framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(parts[-1]) < size or body[at : at + 2] != b"\r\n":
            return None
        at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: ``page_id, url, record_id, record_type, refers_to_id, complete, payload``.

    Segments are grouped by the id of the record they continue, ordered by number, and the joined block is
    held against the total length that the last one states. ``complete`` is false, and the payload null, where a segment is
    missing, the length differs or the transfer framing is broken. Segments may lie in other archives than their first.
    Records that repeat an id are told apart by their place. Revisits have no payload. No archives give no rows.
    """
    bound_batches(spark)
    columns = {
        "file": pa.string(), "at": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(),
        "record_type": pa.string(), "refers_to_id": pa.string(), "origin": pa.string(), "number": pa.int64(),
        "total": pa.int64(), "block": pa.binary(),
    }
    schema = (
        "file string, at bigint, page_id bigint, url string, record_id string, record_type string, refers_to_id string,"
        " origin string, number bigint, total bigint, block binary"
    )
    arrow = pa.schema(list(columns.items()))
    whole = lambda text: int(text) if text is not None else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for at, h, block in parse_archive(archive_bytes(content.as_py())):
                    rows.append(
                        {
                            "file": file.as_py(), "at": at, "page_id": whole(h.get("warc-page-id")), "url": h.get("warc-target-uri"),
                            "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "refers_to_id": h.get("warc-refers-to"),
                            "origin": h.get("warc-segment-origin-id"), "number": whole(h.get("warc-segment-number")),
                            "total": whole(h.get("warc-segment-total-length")), "block": block,
                        }
                    )
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    records = files.mapInArrow(parse, schema)
    names = ["page_id", "url", "record_id", "record_type", "refers_to_id"]
    single = records.where(F.col("number").isNull()).select(*names, F.lit(True).alias("complete"), "block")
    place = Window.partitionBy("origin", "number").orderBy("file", "at")
    segments = (
        records.where(F.col("number").isNotNull())
        .withColumn("origin", F.coalesce("origin", "record_id"))
        .withColumn("copy", F.row_number().over(place))
    )
    opening = F.col("number") == 1
    joined = (
        segments.groupBy("origin", "copy")
        .agg(
            *[F.max(F.when(opening, F.col(c))).alias(c) for c in names],
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        )
        .withColumn("block", F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary"))
        .withColumn(
            "complete",
            F.coalesce(
                (F.element_at("parts", -1)["number"] == F.size("parts"))
                & (F.element_at("parts", 1)["number"] == 1)
                & (F.octet_length("block") == F.col("total")),
                F.lit(False),
            ),
        )
        .select(*names, "complete", "block")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sure = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            payloads = [
                http_payload(b.as_py()) if ok and kind == "response" else None
                for b, kind, ok in zip(batch.column(6), kinds, sure, strict=True)
            ]
            told = [ok and (kind != "response" or p is not None) for p, kind, ok in zip(payloads, kinds, sure, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(told, pa.bool_()), pa.array(payloads, pa.binary())],
                names=[*names, "complete", "payload"],
            )

    head = "page_id bigint, url string, record_id string, record_type string, refers_to_id string"
    return single.unionByName(joined).mapInArrow(decode, f"{head}, complete boolean, payload binary")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back; the folder is one of the shared ones unless named."""
    path = path or scratch_path(pages.sparkSession)
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
