"""WARC archives of pages, compressed with Zstandard and a dictionary per archive.

An archive starts with a skippable frame that holds its dictionary; then comes one frame per
record. Tasks write archives of bounded size to the shared folder under names of their own
attempt and report the paths; only reported archives are read, so what a lost or repeated task
left behind is never counted. The reader loads the dictionary from the leading frame, decodes one
frame per record and checks version, mandatory headers, lengths and digests.

Pages with equal payloads (null html is an empty payload) are stored once: the page with the
smallest id holds the payload, the others are revisits of it. Rows that repeat the smallest id
are responses too. A row without an id is a response on its own, as nothing could refer to it.
Addresses may be null or hold any characters: they are percent-encoded. Extra columns are
ignored; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import in_small_batches
from tallyscope.session import cut, scratch_path

#: Magic number of the leading skippable frame, as fixed for compressed archives.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 32_768
#: Uncompressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 32_000_000
#: Records and bytes of each that an archive's dictionary is made from.
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 4096
#: Fixed values of the record format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Pages have no capture time; a constant keeps archives of equal rows equal.
DATE = "1970-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and its own path of a Hadoop-style path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    text = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _block(headers: list[tuple[str, str]], body: bytes, first: bytes) -> bytes:
    lines = [first, *(f"{k}: {v}".encode() for k, v in headers)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body


def _record(kind: str, identifier: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    fixed = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", DATE)]
    length = [("Content-Length", str(len(block)))]
    return _block([*fixed, *headers, *length], block + b"\r\n\r\n", VERSION)


def page_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str,
                refers_to: int | None) -> bytes:
    """A response that holds the payload, or a revisit of ``refers_to`` without it."""
    http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else record_id(page_id)[1:-1]
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    body = payload if refers_to is None else b""
    block = _block(http, body, b"HTTP/1.1 200 OK")
    return _record("response" if refers_to is None else "revisit", record_id(page_id), headers, block)


def archive_bytes(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary frame, an info record, one frame per record."""
    info = _record("warcinfo", f"<urn:uuid:{uuid.UUID(int=len(records))}>",
                   [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    out, trained = [], None
    step = max(1, len(records) // SAMPLE_RECORDS)
    try:
        trained = zstandard.train_dictionary(
            DICTIONARY_BYTES, [r[:SAMPLE_BYTES] for r in records[::step]], k=256, d=8)
    except zstandard.ZstdError:
        pass  # too little to learn from: an archive without a dictionary is valid
    if trained is not None:
        packed = zstandard.compress(trained.as_bytes())
        out += [DICTIONARY_FRAME.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    out += map(press.compress, [info, *records])
    return b"".join(out)


def _exactly(stream, n: int) -> bytes:
    """``n`` bytes, fewer only at the end."""
    out = b""
    while len(out) < n and (more := stream.read(n - len(out))):
        out += more
    return out


def read_records(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    head, dictionary = _exactly(stream, 8), None
    if head[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        size = int.from_bytes(head[4:8], "little")
        packed = _exactly(stream, size)
        if len(packed) < size:
            raise ArchiveError("the dictionary frame is cut short")
        if packed[:4] == zstandard.FRAME_HEADER:
            packed = zstandard.decompress(packed)
        dictionary, head = zstandard.ZstdCompressionDict(packed), b""
    press = zstandard.ZstdDecompressor(dict_data=dictionary)
    held = head
    while held or (held := stream.read(1 << 16)):
        frame, parts = press.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(1 << 16)):
                raise ArchiveError("the last frame is cut short")
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as broken:
                raise ArchiveError(f"a frame can't be decoded: {broken}") from broken
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _headers(data: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError(f"{what}: no end of headers")
    first, *lines = head.split(b"\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.decode("latin-1").lower() in fields:
            raise ArchiveError(f"{what}: bad header line {line[:80]!r}")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return first, fields, rest


def parse_record(data: bytes) -> dict | None:
    """The checked fields of a page record; None for an info record."""
    version, fields, rest = _headers(data, "record")
    if version != VERSION:
        raise ArchiveError(f"version {version[:20]!r}")
    if missing := [m for m in MANDATORY if m not in fields]:
        raise ArchiveError(f"no {', '.join(missing)}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"a length of {length} for {len(rest) - 4} bytes")
    kind = fields["warc-type"]
    if kind == "warcinfo":
        return None
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"type {kind[:20]}")
    algorithm, _, noted = fields.get("warc-payload-digest", "").partition(":")
    status, http, payload = _headers(rest[:-4], "response")
    size = http.get("content-length", "")
    if algorithm != "sha1" or not size.isdigit() or not status.startswith(b"HTTP/"):
        raise ArchiveError("a record without its digest, status or payload length")
    if kind == "response" and (len(payload) != int(size) or digest(payload) != noted):
        raise ArchiveError("a payload that differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ArchiveError("a revisit with a payload or of nothing")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
        "payload_bytes": int(size), "payload_digest": noted, "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def with_first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the page that holds the same payload, null for a response.

    The smallest ids are found with a partial aggregation per task; only payloads that occur more
    than once are looked up again.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"),
                        F.sha1(payload.cast("binary")).alias("_sha1"))
    firsts = (
        rows.where(F.octet_length("html") >= least_bytes).groupBy("_sha1")
        .agg(F.min("page_id").alias("_first"), F.count("page_id").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    return rows.join(firsts, "_sha1", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, refers_to rows to ``folder``; path and n_records per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        prefix = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def flush(n: int, records: list[bytes]) -> pa.RecordBatch:
            path = f"{prefix}-{n:04d}.warc.zst"
            store, own = store_of(path)
            store.create_dir(own.rpartition("/")[0], recursive=True)
            with store.open_output_stream(own, compression=None) as file:
                file.write(archive_bytes(records))
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(records)]})

        records, size, n = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, html, refers_to = (v.as_py() for v in row)
                payload = html.encode()
                records.append(page_record(page_id, url, payload, digest(payload), refers_to))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush(n, records)
                    records, size, n = [], 0, n + 1
        if records:
            yield flush(n, records)

    rows = pages.select("page_id", "url", "html", "refers_to")
    return in_small_batches(rows).mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """The checked page records of the archives at ``path``; a broken archive ends the job.

    ``n_records``, where given, must be the number of page records in the archive.
    """

    def rows_of(path: str, expected: int | None) -> Iterable[dict]:
        store, own = store_of(path)
        seen = 0
        with store.open_input_stream(own, compression=None) as file:
            try:
                for data in read_records(file):
                    if (found := parse_record(data)) is not None:
                        seen += 1
                        yield found
            except ArchiveError as broken:
                raise ArchiveError(f"{path}, record {seen}: {broken}") from broken
        if expected is not None and seen != expected:
            raise ArchiveError(f"{path}: {seen} records, {expected} expected")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                for row in rows_of(path, expected):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    listed = archives.select("path", archives["n_records"].cast("long") if "n_records" in
                             archives.columns else F.lit(None).cast("long").alias("n_records"))
    return in_small_batches(listed).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, payload binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages to new archives and returns what reading them back gives."""
    folder = scratch_path(pages.sparkSession, "warc")
    written = cut(write_archives(with_first_copies(pages), folder))
    return read_archives(written).drop("url", "payload")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          (CAST('0x' || substr(h, 1 + (i // 8) * 10 , 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31
          AS INTEGER), 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
