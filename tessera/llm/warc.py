"""WARC archives: writing with revisits and segments, and segment reassembly.

Writing. Each payload becomes an HTTP response, chunked where it is long, in a
``response`` record; a block beyond the segment size goes on in ``continuation``
records. Of equal payloads from a least size on, the one with the largest page
id is kept and the others become ``revisit`` records that refer to it. Every
record is a gzip member of its own. Archives are written by the text writer, which
puts an empty member between bundles of records, so they are committed like any
table and may lie in any store; a file has a bounded number of bundles, and those
are of bounded bytes.

Reading. Archives are read as binary files, decompressed as a stream and cut into
records by their lengths, so one record is held at a time. Segments are grouped by the identifier of their origin, ordered by
number, checked against the total length, and the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import new_path, small_or_shuffled, stored

#: Least payload that others may revisit; block bytes of a segment; bytes of a chunk.
REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 1000, 65_536, 8_192
#: Compressed bytes after which a bundle ends, and bundles of a file: 64 MB, and less than a record for each bundle.
BUNDLE_BYTES, FILE_BUNDLES = 1 << 20, 64
#: An empty gzip member: what the text writer puts after each bundle, byte for byte.
_SEPARATOR = gzip.compress(b"", mtime=0).decode("latin-1")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%X\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if len(body) < end + 4 + size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(kind: str, identifier: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """A whole record, with the two line breaks after its block."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", _DATE), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def records_of(page_id, url: str | None, payload: bytes, owner, where: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page; ``where`` tells repeated rows apart, owner is the page that a revisit refers to."""
    sha = hashlib.sha1(payload)
    identifier = f"urn:page:{page_id}:{sha.hexdigest()}:{where}"
    fields = [("WARC-Page-ID", str(page_id)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode())]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    kind = ("Content-Type", "application/http;msgtype=response")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if owner is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", identifier, block, [*fields, kind, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{owner}:{sha.hexdigest()}>")])
        return
    if len(payload) > CHUNK_BYTES:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    if len(block) <= segment:
        yield _record("response", identifier, block, [*fields, kind])
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, start=1):
        part = block[at : at + segment]
        more = [("WARC-Segment-Number", str(number))]
        if number == 1:
            yield _record("response", identifier, part, [*fields, kind, *more])
            continue
        more.append(("WARC-Segment-Origin-ID", f"<{identifier}>"))
        if number == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{identifier}:{number}", part, more)


def _writer(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, row = context.partitionId() if context else 0, 0
        made: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            bundle = pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["bundle"])
            made.clear()
            return bundle

        for batch in batches:
            for page, url, html, owner in zip(*(batch.column(k) for k in range(4)), strict=True):
                for record in records_of(page.as_py(), url.as_py(), html.as_py() or b"", owner.as_py(), f"{part}-{row}", segment):
                    made.append(gzip.compress(record, mtime=0))
                    size += len(made[-1])
                    if size >= BUNDLE_BYTES:
                        yield out()
                        size = 0
                row += 1
        if made:
            yield out()

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write a record (or segments of one) per row of pages (page_id, url, html, ...) under path; a null html is an empty payload."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    narrow = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    owners = stored(narrow.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 AND owner IS NOT NULL").select("digest", "owner"), "owners")
    revisits = narrow.join(small_or_shuffled(owners, owners.count()), "digest").where(~F.col("page_id").eqNullSafe(F.col("owner"))).distinct()
    revisits = stored(revisits.select(F.col("page_id").alias("page"), F.col("digest").alias("sha"), "owner"), "revisits")
    side = small_or_shuffled(revisits, revisits.count())
    joined = rows.join(side, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("sha")), "left")
    made = joined.select("page_id", "url", "html", "owner").mapInArrow(_writer(segment), "bundle binary")
    # the text writer copies the bytes of a string as they are
    made = made.select(F.col("bundle").cast("string").alias("value"))
    made.write.option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR).option("maxRecordsPerFile", FILE_BUNDLES).text(path)


def decompressed(archive: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Pieces of the content of a gzip file of any number of members; other bytes are taken as they are."""
    if not archive.startswith(b"\x1f\x8b"):
        yield archive
        return
    view, at = memoryview(archive), 0
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = member.decompress(view[at : at + step])
            at = min(at + step, len(view)) - len(member.unused_data)
            yield piece


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive's content, given in pieces; one record is held at a time."""
    source, held = iter(pieces), bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while have(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not have(seen + 1):
                raise ValueError("a record is cut off")
        if not held.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if not have(end + 8 + size) or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield fields, block


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Decoded payload and HTTP fields of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return (unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body), fields


_ROW = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, number int, total long, piece binary"


def _page(value: str) -> int | None:
    return None if value == "None" else int(value)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for value in batch.column(0):
            rows, size = [], 0
            for fields, block in parse_records(decompressed(value.as_py())):
                number = fields.get("warc-segment-number")
                page = _page(fields["warc-page-id"]) if "warc-page-id" in fields else None
                digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in fields else None
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                kind, piece, length, refers = fields["warc-type"], None, None, None
                if number is not None:
                    piece = block
                    size += len(block)
                elif kind == "revisit":
                    length = int(payload_of(block)[1]["content-length"])
                    refers = int(fields["warc-refers-to"].split(":")[2])
                else:
                    payload, _ = payload_of(block)
                    length, found = len(payload), hashlib.sha1(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                total = fields.get("warc-segment-total-length")
                rows.append((origin, page, length, digest, None if kind == "continuation" else kind, refers, number and int(number), total and int(total), piece))
                if size > 4 << 20 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


def assemble(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a segmented record; numbers must run from 1 and lengths add up."""
    ordered = sorted(segments)
    if [n for n, _ in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(b for _, b in ordered)
    if total is None or len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes, not {total}")
    return block


def _assembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(1).to_pylist()
        for k, (digest, total, pieces) in enumerate(zip(batch.column(2), batch.column(5), batch.column(6), strict=True)):
            if pieces.is_valid and len(pieces):
                payload, _ = payload_of(assemble([(p["number"], p["piece"]) for p in pieces.as_py()], total.as_py()))
                if hashlib.sha1(payload).hexdigest() != digest.as_py():
                    raise ValueError("a reassembled payload does not match its digest")
                lengths[k] = len(payload)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), *(batch.column(k) for k in (2, 3, 4))],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives under path.

    A record's segments meet by the identifier of their origin, wherever they
    were written; missing, repeated or cut segments and wrong digests are errors.
    A file is one row of the source, so it must be below 2 GB; those written here are.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_reader, _ROW)
    pieces = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("number", "piece")))
    whole = rows.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "total")), pieces.alias("pieces")
    )
    return whole.drop("origin").mapInArrow(_assembler, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """What reading tells of the archives that hold pages (page_id, url, html, ...): one row per row.

    Rows that repeat a page id and payload are all responses or all revisits; a
    null page id can revisit but not be revisited; of equal payloads the largest page
    id is the response, so there are no ties. A very long page is written in segments
    and put together again in one row. An empty table gives no rows; other columns
    are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, segment)
    return read_archives(spark, path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> owner THEN owner END AS refers_to
FROM o
"""
