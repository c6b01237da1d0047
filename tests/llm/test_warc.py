"""WARC archives: round trips at every edge, framing, digests, damage."""

import base64
import gzip
import hashlib
import zlib

import pytest

from chronofold.llm import common, warc

HTML = ["<p>one</p>", "<p>two</p>", "", None, "é中😀\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "\x1f\x8b\x08", "a\r\n\r\n"]


@pytest.fixture(scope="module")
def pages(spark):
    """Copies, a third of all rows alike, null and repeated ids, header breaks in urls, columns with names used inside."""
    rows = [(i, f"http://h/{i}", html, 0, "x") for i, html in enumerate(HTML)]
    rows += [(100 + i, "http://copy", "<p>one</p>", 1, "y") for i in range(8)] + [(108, "http://copy", "<p>one</p>", 1, "y")] * 2
    rows += [(None, "u", "<p>two</p>", 2, "z"), (None, None, "no id", 2, "z"), (None, None, "no id", 2, "z"), (-5, "http://a b\r\nX: 1/é", "below", 2, "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, hash int, original string")


def brute(rows):
    """By payload: the largest id is the response."""
    last = {}
    for i, _, html, *_ in rows:
        key = (html or "").encode()
        if i is not None:
            last[key] = max(last.get(key, i), i)
    out = []
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        found = last.get(payload)
        response = found is None or i == found
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else found))
    return sorted(out, key=repr)


def test_round_trip(pages):
    found = warc.archive_round_trip(pages, per_file=3)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute([tuple(r) for r in pages.collect()])
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_small_groups_are_joined_large_ones_looked_up(spark):
    rows = [(i, "u", f"pair {i // 2}") for i in range(3000)] + [(10_000 + i, "u", "hot") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["original"] for r in warc.with_originals(pages).select("page_id", "original").collect()}
    assert all(found[i] == (i + 1 if i % 2 == 0 else None) for i in range(3000))
    assert all(found[10_000 + i] == (None if i == 1499 else 11_499) for i in range(1500))


def test_archives_are_plain_gzip_and_payloads_come_back(spark, pages):
    folder = common.new_folder(spark, "test")
    warc.write_archives(pages, folder, per_file=4)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).select("content").collect()]
    whole = b"".join(gzip.decompress(f) for f in files)
    assert whole.count(b"WARC-Record-ID: ") == pages.count()
    assert b"\r\nX: 1" not in whole  # a url ends no line
    found = warc.read_archives(spark, folder, payload=True).where("record_type = 'response'").collect()
    payloads = {(r["html"] or "").encode() for r in pages.collect()}
    assert {bytes(r["payload"]) for r in found} == payloads
    assert all(r["problem"] is None for r in found)
    assert next(r["url"] for r in found if r["page_id"] == -5) == "http://a%20b%0D%0AX:%201/%C3%A9"


def test_one_member_a_record_also_of_many_megabytes():
    long = warc.record(1, "u", b"ab" * (9 << 20))
    for content in (warc.record(2, "u", b"short"), long):
        packed = warc.member(content)
        assert packed[-1] == 0 and gzip.decompress(packed) == content
    found = list(warc.records(warc.member(long) + warc.member(warc.record(3, "u", b"next"))))
    assert [(r.problem, len(r.http[1])) for r in found] == [(None, 18 << 20), (None, 4)]


def test_damage_is_reported_and_passed_over():
    one, two, three = (warc.member(warc.record(i, "u", b"payload %d" % i)) for i in (1, 2, 3))
    good = lambda found: [warc._page(r.fields.get("warc-record-id")) for r in found if not r.problem]
    bad = bytearray(two)
    bad[40] ^= 255
    found = list(warc.records(one + bytes(bad) + three))
    assert good(found) == [1, 3] and found[1].offset == len(one)
    assert good(warc.records(one + two[:-9])) == [1]
    assert [r.problem for r in warc.records(one + two[:-9])][1] == "the file ends within a member"
    altered = warc.record(4, "u", b"payload 4").replace(b"payload 4", b"payload 5")
    assert [r.problem for r in warc.records(warc.member(altered))] == ["payload digest does not match"]
    longer = warc.record(5, "u", b"x" * 200_000).replace(b"Content-Length: 200", b"Content-Length: 100")
    assert [r.problem for r in warc.records(warc.member(longer))] == ["more content than the content length says"]
    shorter = warc.record(5, "u", b"x" * 50)[:-10] + b"\r\n\r\n"
    assert [r.problem for r in warc.records(warc.member(shorter))] == ["less content than the content length says"]
    assert [r.problem for r in warc.records(warc.member(b"no record\r\n\r\n"))] == ["no WARC record"]
    bomb = zlib.compressobj(wbits=31)
    assert [r.problem for r in warc.records(bomb.compress(b"\0" * (8 << 20)) + bomb.flush())] == ["no end of the headers"]


def test_problems_stop_a_round_trip(spark, pages, monkeypatch):
    missing = warc.read_archives(spark, _written(spark, pages)).where("record_type = 'revisit' OR payload_bytes <> 10")
    assert {r["page_id"] for r in warc.unresolved(missing).collect()} == {1, 108}
    monkeypatch.setattr(warc, "record", lambda *a: b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\n")
    with pytest.raises(ValueError, match="content"):
        warc.archive_round_trip(pages)


def _written(spark, pages):
    folder = common.new_folder(spark, "test")
    warc.write_archives(pages, folder)
    return folder
