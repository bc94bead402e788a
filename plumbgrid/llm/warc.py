"""WARC archives: written as record files, read back with segment reassembly.

Writing: every page becomes one record.  Of pages with equal payloads the one with the largest id is a ``response``; the
others are ``revisit`` records that refer to it.  Payloads travel in chunked transfer framing; a block of more than
``SEGMENT_BYTES`` is cut into a first segment and ``continuation`` records.

Reading: files are parsed record by record.  Continuations are grouped by their origin's id, ordered by segment number,
and joined only if the numbers run without gap from 1 to the last and the total length is the one the last segment
states; then the HTTP head is parted off and the chunked framing decoded.  Digests are compared with the payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import pick, slices, to_bytes

SEGMENT_BYTES = 4 << 10
CHUNK = 1 << 10
READ_BYTES = 16 << 10  # of a compressed file at a time
END = "\r\n\r\n"
FILE_RECORDS = 2000  # of a segment at most each
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of ``data``."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The data in a chunked body; extensions and trailers are skipped.  None if the framing is broken or cut short."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            return None
        try:
            n = int(body[at:eol].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def record_id(page_id: object, sha: str) -> str:
    return f"<urn:page:{page_id}:{sha}>"


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str, payload: bytes, revisits: str | None, segment_bytes: int) -> list[bytes]:
    """Records of one page, without the blank lines that end each."""
    sha = base32_sha1(payload)
    rid = record_id(page_id, sha)
    common = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisits is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Refers-To", record_id(revisits, sha)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record("revisit", [*common, *more, ("Content-Type", "application/http;msgtype=response")], block)]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", [*common, ("Content-Type", "application/http;msgtype=response")], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", [*common, ("WARC-Segment-Number", 1), ("Content-Type", "application/http;msgtype=response")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        own = [("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", rid)]
        out.append(_record("continuation", [*own, ("WARC-Segment-Number", k), *last], part))
    return out


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url or "") or "about:blank"


def write_archives(pages: DataFrame, path: str, least_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files (gzip) under ``path``.

    Payload: the html in UTF-8, empty for null.  Pages with equal payloads of at least ``least_revisit`` bytes are one
    response, that of the largest page_id, and revisits.  Rows that repeat this id and payload are responses each; null
    ids are smaller than any other.  Control characters and spaces in URLs are written as ``%20``.
    """
    ws = Workspace(pages.sparkSession, "warc-write")
    p = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    # who is the response of each payload: ids and digests only
    keys = ws.keep(p.where(F.octet_length("html") >= least_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("c")), "keys")
    chief = keys.groupBy("digest").agg(F.count("*").alias("c"), F.max("page_id").alias("chief")).where("c > 1").select("digest", "chief")
    roles = keys.join(chief, "digest").where(~F.col("page_id").eqNullSafe(F.col("chief")))
    roles = ws.keep(roles.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("chief").cast("string").alias("revisits")), "roles")
    p = p.join(roles, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", 4 << 20):
                out = []
                for pid, url, html, revisits in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), to_bytes(b.column("html")), b.column("revisits").to_pylist()):
                    out += page_records(pid, _clean(url), html, revisits, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = p.select("page_id", "url", "html", "revisits").mapInArrow(records, "value binary")
    # each record ends with two line breaks, which is what the text writer puts after a row; it writes the bytes as they are
    out = lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def plain_pieces(raw: bytes) -> Iterator[bytes]:
    """The content of a file, plain or in any number of gzip members, piece by piece; members cost their own bytes."""
    if not raw.startswith(b"\x1f\x8b"):
        yield from (raw[i : i + READ_BYTES] for i in range(0, len(raw), READ_BYTES))
        return
    z = zlib.decompressobj(31)
    for i in range(0, len(raw), READ_BYTES):
        piece = raw[i : i + READ_BYTES]
        while piece:
            if z.eof:  # the next member
                z = zlib.decompressobj(31)
            out = z.decompress(piece)
            if out:
                yield out
            piece = z.unused_data
    if not z.eof:
        raise ValueError("gzip member cut short")


def parse_records(pieces: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed WARC file: lower-cased header names, block.  Broken or cut records raise ValueError.

    Holds one record and one piece at a time.
    """
    source = iter((pieces,) if isinstance(pieces, bytes) else pieces)
    held, gone = bytearray(), 0

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while held or more():
        seen = 0
        while (head_end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                break
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {gone}")
        if head_end < 0:
            raise ValueError(f"record head without end at byte {gone}")
        head = {}
        for line in bytes(held[:head_end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        size = int(head.get("content-length", "-1"))
        begin = head_end + 4
        while size >= 0 and len(held) < begin + size + 4 and more():
            pass
        if size < 0 or len(held) < begin + size + 4:
            raise ValueError(f"record cut short at byte {gone}")
        yield head, bytes(held[begin : begin + size])
        del held[: begin + size + 4]
        gone += begin + size + 4


def http_payload(block: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers (lower-cased names) and payload of an HTTP response, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    return headers, dechunked(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


_RAW = pa.schema([("id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("length", pa.int64()), ("block", pa.binary())])
_OUT = "id string, kind string, uri string, digest string, refers string, payload_bytes long, payload_digest string, ok boolean"


def _finished(head: tuple, block: bytes, with_payload: bool) -> tuple:
    rid, kind, uri, digest, refers = head
    headers, payload = http_payload(block)
    if kind == "revisit":
        own = (int(headers.get("content-length", "0")), digest, True)
    elif payload is None:
        own = (None, None, False)
    else:
        sha = base32_sha1(payload)
        own = (len(payload), sha, sha == digest)
    return (rid, kind, uri, digest, refers, *own) + ((payload,) if with_payload else ())


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """WARC files (``.gz`` or plain) under ``path`` -> one row per record, its segments joined.

    Columns: ``id, kind, uri, digest`` (as stated), ``refers``, ``payload_bytes``, ``payload_digest`` (as computed; for
    revisits as stated), ``ok`` and, if asked for, ``payload``.  ``ok`` is false, and what cannot be known is null,
    where segments are missing, repeated or of another total length than stated, where the chunked framing is broken,
    or where the digest differs.  Continuations without a first segment give a row of kind ``continuation``.  A file
    with a broken record raises.  A file is held as it is stored while it is parsed record by record, records of other types are skipped.
    """
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    names = ["id", "kind", "uri", "digest", "refers", "payload_bytes", "payload_digest", "ok"] + ["payload"] * with_payload
    ddl = _OUT + ", payload binary" * with_payload
    all_names = [*names, "origin", "number", "total", "block"]
    all_types = [*types, pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, room = [], 0
                for head, block in parse_records(plain_pieces(data.as_buffer().to_pybytes())):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    own = (head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, head.get("warc-refers-to"))
                    if "warc-segment-number" in head:
                        total = head.get("warc-segment-total-length")
                        rows.append((*own, *[None] * (len(names) - 5), head.get("warc-segment-origin-id", own[0]), int(head["warc-segment-number"]), int(total) if total else None, block))
                        room += len(block)
                    else:
                        rows.append((*_finished(own, block, with_payload), None, None, None, None))
                        room += len(block) if with_payload else 200
                    if room > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), all_types)], names=all_names)
                        rows, room = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), all_types)], names=all_names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts")):
                every = parts.as_py()
                times = max(1, sum(x["number"] == 1 for x in every))
                p = every[::times]  # pages that were written several times repeat each segment as often
                first, block = p[0], b"".join([x["block"] for x in p])
                sound = [x["number"] for x in every] == [k for k in range(1, len(p) + 1) for _ in range(times)]
                sound &= all(x["block"] == p[i // times]["block"] for i, x in enumerate(every))
                if sound and p[-1]["total"] == len(block):
                    row = _finished((first["id"], first["kind"], first["uri"], first["digest"], first["refers"]), block, with_payload)
                else:
                    row = (origin, first["kind"], first["uri"], first["digest"], first["refers"], None, None, False) + (None,) * with_payload
                yield pa.RecordBatch.from_arrays([pa.array([c] * times, t) for c, t in zip(row, types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    ws = Workspace(spark, "warc-read")
    raw = ws.keep(files.select("content").mapInArrow(parse, f"{ddl}, origin string, number int, total long, block binary"), "records")
    whole = raw.where("origin is null").select(*names)
    part = F.struct("number", "id", "kind", "uri", "digest", "refers", "total", "block")
    groups = raw.where("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.unionByName(groups.mapInArrow(assemble, ddl))


def archive_round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write the pages, read the archives back -> ``page_id, payload_bytes, payload_digest, record_type, refers_to, ok``."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    write_archives(pages, ws.path("archive"), least_revisit)
    back = read_archives(spark, ws.path("archive"), with_payload=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:([^:]*):', 1) as bigint)")
    return back.select(
        page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers").alias("refers_to"), "ok"
    )
