"""WARC archives: written with revisit records, segments and chunked payloads, and read back whole.

Writing: of pages with equal payloads one is a response, the others revisit it. A response is an HTTP message with
chunked transfer coding; one longer than a segment goes on in continuation records. Reading: continuation records
are grouped by the id of their origin, put in order of segment number and held against the total length; then the
chunks are decoded and the payload's digest is compared. Archives are written by Spark's text writer with
the record end as line separator, so files are plain (or gzipped) WARC; each is read as a whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches
from tidemark.session import stage

END = "\r\n\r\n"
#: Bytes of a record's block, of a chunk, and records of a file: their product bounds what a task reads at once.
SEGMENT, CHUNK, FILE_RECORDS = 1 << 14, 1 << 12, 4096
#: Parsed bytes that leave a task together.
BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Transfer coding: each chunk after its length in hex, a chunk of none at the end."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)  # trailers, if any, follow
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than its length says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes:
    """The decoded payload of an HTTP response."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the HTTP head has no end")
    lines = head.lower().split(b"\r\n")[1:]
    coded = any(x.partition(b":")[0].strip() == b"transfer-encoding" and b"chunked" in x for x in lines)
    return unchunked(body) if coded else body


def _record(headers: dict, block: bytes) -> bytes:
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in headers.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}{END}").encode() + block


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{page_id}:{digest}").urn


def records(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, revisit: bool, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page, without their ends; ``first_id``: page of the response with the same payload."""
    digest = sha1_base32(payload)
    about = {"WARC-Target-URI": url, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    response = record_id(first_id, digest, "response")
    if revisit:
        own = record_id(page_id, digest, "revisit")
        refers = {"WARC-Refers-To": f"<{response}>", "WARC-Profile": PROFILE}
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{own}>", **about, **refers}, head)
        return
    own = record_id(page_id, digest, "response")
    message = head + chunked(payload, chunk)
    kind = {"Content-Type": "application/http; msgtype=response"}
    if len(message) <= segment:
        yield _record({"WARC-Type": "response", "WARC-Record-ID": f"<{own}>", **about, **kind}, message)
        return
    count = -(-len(message) // segment)
    for i in range(count):
        block = message[i * segment : (i + 1) * segment]
        numbered = {"WARC-Segment-Number": i + 1, "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
        if i == 0:
            yield _record({"WARC-Type": "response", "WARC-Record-ID": f"<{own}>", **about, **kind, **numbered}, block)
            continue
        total = {"WARC-Segment-Total-Length": len(message)} if i == count - 1 else {}
        part = uuid.uuid5(uuid.NAMESPACE_URL, f"{own}:{i + 1}").urn
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{part}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<{own}>", **numbered, **total}, block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, file_records: int = FILE_RECORDS) -> None:
    """Write a response or revisit record for each row of ``pages``; a null html is an empty payload.

    Of equal payloads of at least ``least`` bytes the row with the largest page_id is the response (null only if there
    is no other; repeated rows with that id are all responses); smaller payloads are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    same = F.sha2(payload, 256)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), same.alias("same"))
    # Only ids and digests are grouped; the payloads are shuffled once, and a payload many pages have is split.
    firsts = rows.groupBy("same").agg(F.max("page_id").alias("first_id"))
    joined = rows.join(firsts, "same").drop("same")
    large = F.octet_length("payload") >= least
    joined = joined.withColumn("revisit", large & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                for record in records(row["page_id"], row["url"], row["payload"], row["first_id"], row["revisit"], segment, chunk):
                    held.append(record)
                    size += len(record)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    written = in_batches(joined.select("page_id", "url", "payload", "first_id", "revisit"), run, "record binary")
    writer = written.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _plain(content: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, unpacked if gzipped (one member or many)."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        unpack = zlib.decompressobj(wbits=31)
        while not unpack.eof and at < len(content):
            piece = content[at : at + (1 << 20)]
            yield unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    held, pieces = bytearray(), _plain(content)

    def reach(size: int) -> bool:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        end, seen = held.find(b"\r\n\r\n"), 0
        while end < 0 and reach(len(held) + 1):
            end, seen = held.find(b"\r\n\r\n", max(0, seen - 3)), len(held)
        if end < 0:
            if held.strip():
                raise ValueError("a record's head has no end")
            return
        lines = held[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        pairs = (x.partition(":") for x in lines[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
        size = int(headers["content-length"])
        if not reach(end + 4 + size):
            raise ValueError("a record is shorter than its length says")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        reach(end + 8 + size)
        del held[: end + 8 + size]


PARSED = (
    "record_id string, record_type string, page_id long, url string, digest string, refers_to string, origin string, number int, total long, "
    "block binary, payload_bytes long, payload_digest string"
)
_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)

    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for h, block in parsed(content.as_buffer().to_pybytes()):
                kind, bare = h.get("warc-type"), lambda k: (h.get(k) or "").strip("<>") or None  # noqa: B023, E731
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                origin = bare("warc-segment-origin-id") or (bare("warc-record-id") if number else None)
                page = int(h["x-page-id"]) if "x-page-id" in h else None
                length = own = None
                if kind == "response" and number is None:
                    block, length, own = _decoded(block)
                elif kind == "revisit":
                    block = None
                digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                held.append((bare("warc-record-id"), kind, page, h.get("warc-target-uri"), digest, bare("warc-refers-to"), origin, number, total, block, length, own))
                size += len(block or b"")
                if size >= BATCH:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)


def _decoded(message: bytes) -> tuple[bytes | None, int | None, str | None]:
    try:
        payload = payload_of(message)
    except ValueError:
        return None, None, None
    return payload, len(payload), sha1_base32(payload)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = [s["number"] for s in row["segments"]] == list(range(1, len(row["segments"]) + 1))
            message = b"".join(s["block"] for s in row["segments"])
            out.append(_decoded(message) if whole and len(message) == row["total"] else (None, None, None))
        payloads, lengths, digests = zip(*out) if out else ((), (), ())
        arrays = [batch.column("origin"), pa.array(payloads, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["record_id", "block", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record below ``path``: record_id, page_id, url, record_type, refers_to (page_id of the
    response a revisit repeats), payload_bytes, payload_digest, payload (of responses), valid.

    Segments that occur repeatedly count once. If segments are missing or contradict one another, the length differs from the
    total, or the framing is broken, then payload, its bytes and digest are null and valid is false; so is a
    payload whose digest isn't the recorded one, or a revisit without a valid response.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = stage(in_batches(files, _parse, PARSED), "records")
    # A segment's key is a record's id; its segments are bounded by that record, whatever the archive.
    segments = rows.filter("number is not null").select("origin", "number", "total", "block").distinct()
    one = segments.groupBy("origin").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"))
    whole = in_batches(one, _reassemble, "record_id string, block binary, payload_bytes long, payload_digest string")
    about = ["record_id", "page_id", "url", "digest"]
    heads = rows.filter("record_type = 'response'")
    single = heads.filter("number is null").select(*about, "block", "payload_bytes", "payload_digest")
    joined = heads.filter("number is not null").select(*about).join(whole, "record_id", "left")
    responses = single.unionByName(joined).withColumn("valid", F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(False)))
    revisits = rows.filter("record_type = 'revisit'").select(*about, F.col("refers_to").alias("target"))
    # Repeated rows write equal responses, of which any is the target.
    targets = responses.groupBy(F.col("record_id").alias("target")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"), F.max("valid").alias("found")
    )
    revisits = revisits.join(targets, "target", "left")
    agree = F.coalesce(F.col("found") & (F.col("digest") == F.col("payload_digest")), F.lit(False))
    columns = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "valid"]
    first = responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).withColumnRenamed("block", "payload")
    again = revisits.withColumn("record_type", F.lit("revisit")).withColumn("payload", F.lit(None).cast("binary")).withColumn("valid", agree)
    return first.select(*columns).unionByName(again.select(*columns))
