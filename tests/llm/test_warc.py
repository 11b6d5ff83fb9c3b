"""Round trips, and archives that must be refused."""

import base64
import hashlib
import io

import pytest
import zstandard

from tallyscope.llm import warc
from tallyscope.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://x/{i}?q=é\r\n", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    return rows + [(60, None, None), (61, "", ""), (62, "u", "a" * 2_000_000), (62, "u", "a" * 2_000_000),
                   (None, "n", "<p>3</p>"), (63, "u", "é\x00\r\n\r\nWARC/1.1\r\n")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as refers_to")
    found = warc.archived_pages(df).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        kind = "response" if i is None or first[html or ""] == i else "revisit"
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind,
                     first[html or ""] if kind == "revisit" else None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(want, key=str)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_only_reported_archives_are_read(spark):
    df = spark.createDataFrame([(1, "u", "x")], SCHEMA).selectExpr("*", "cast(null as long) refers_to")
    folder = scratch_path(spark, "warc-test")
    once = warc.write_archives(df, folder).collect()
    twice = warc.write_archives(df, folder).collect()
    assert once[0].path != twice[0].path
    assert warc.read_archives(spark.createDataFrame(once)).count() == 1


def records():
    return [warc.page_record(i, "http://x", b"payload" * i, warc.digest(b"payload" * i), None)
            for i in range(300)]


def test_dictionary_leads_and_frames_hold_one_record():
    data = warc.archive_bytes(records())
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    read = list(warc.read_records(io.BytesIO(data)))
    assert read[1:] == records() and warc.parse_record(read[0]) is None
    plain = b"".join(map(zstandard.compress, records()[:2]))
    assert list(warc.read_records(io.BytesIO(plain))) == records()[:2]


def test_broken_archives_and_records_are_refused():
    data = warc.archive_bytes(records())
    for cut in (6, 40, len(data) - 5):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(data[:cut])))
    good = records()[3]
    for old, new in [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length", b"Content-Width"), (b"payload", b"PAYLOAD"),
                     (b"WARC-Record-ID", b"X"), (b"response\r\n", b"unheard\r\n"), (b"\r\n\r\n", b"\r\n")]:
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(good.replace(old, new))
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(good + b"x")
