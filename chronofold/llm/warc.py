"""WARC archives: written a gzip member a record, read back sequentially.

Writing: equal payloads are found by a hash aggregate (only hashes and ids are shuffled), the record of the largest page_id
carries the payload as a response, the others are revisits that refer to it. Every record is a gzip member of its own, and
Spark's text writer puts the members one behind the other into files, committed with their tasks. That writer ends each row
with a separator, which may be a zero byte: the last byte of a member is the high byte of its length, zero below 16 MB, and
is left to the separator; a longer record is followed by an empty member, as whose last byte the separator stands.

Reading: each file goes through one reader, member by member. It decompresses piece by piece, takes headers up to the blank
line, frames the block by Content-Length (what comes beyond is an error, found before it is held), and holds block and payload
against their SHA-1 digests. A damaged member is reported with its offset, and reading goes on at the next one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import new_folder, slices, written

#: Records of a file, bytes decompressed at a time, bytes of headers at most, and the share of all copies (a 1000th) from which a
#: group of them is looked up by broadcast.
RECORDS, PIECE, HEADERS, HOT_SHARE = 4000, 1 << 16, 1 << 20, 1000
DATE = "2000-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")
_EMPTY = zlib.compressobj(wbits=31).flush()


def digest(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _one_line(url: str | None) -> str:
    """A url without what would end a header line: white space, control and other non-ASCII characters are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or, with refers_to, a revisit with the response's HTTP headers alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url) or 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member that ends with a zero byte: where its own last byte is another, an empty member follows."""
    packer = zlib.compressobj(level, wbits=31)
    found = packer.compress(content) + packer.flush()
    return found if found[-1] == 0 else found + _EMPTY


@dataclass
class Record:
    offset: int
    fields: dict[str, str]
    block: bytes
    problem: str | None = None

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers of the block's HTTP message, and what follows them."""
        head, mark, body = self.block.partition(b"\r\n\r\n")
        return _fields(head)[1], body if mark else b""


class Damaged(ValueError):
    pass


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line, and the named fields behind it, names in lower case."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, mark, v in (line.partition(":") for line in lines) if mark}


def _framed(view: memoryview, start: int) -> tuple[int, dict[str, str], bytes]:
    """(offset behind it, fields, block) of the member at start, or Damaged."""
    unpacker, at, got = zlib.decompressobj(wbits=31), start, bytearray()
    fields, body, length = {}, None, 0
    while not unpacker.eof:
        feed = unpacker.unconsumed_tail
        if not feed:
            feed = view[at : at + PIECE]
            at += len(feed)
        try:
            more = unpacker.decompress(feed, PIECE)
        except zlib.error as e:
            raise Damaged(f"not decompressible: {e}") from None
        if not more and not len(feed):
            raise Damaged("the file ends within a member")
        got += more
        if body is None and (end := got.find(b"\r\n\r\n")) >= 0:
            first, fields = _fields(bytes(got[:end]))
            if not first.startswith("WARC/"):
                raise Damaged("no WARC record")
            if not fields.get("content-length", "").isdigit():
                raise Damaged("no content length")
            body, length = end + 4, int(fields["content-length"])
        if body is None and len(got) > HEADERS:
            raise Damaged("no end of the headers")
        if body is not None and len(got) > body + length + 4:
            raise Damaged("more content than the content length says")
    if got and (body is None or len(got) < body + length + 4 or got[body + length :] != b"\r\n\r\n"):
        raise Damaged("less content than the content length says")
    return at - len(unpacker.unused_data), fields, bytes(got[body : body + length]) if got else b""


def _verified(found: Record) -> Record:
    """With the problem that its digests show, if any. A revisit's payload is not here: see unresolved."""
    said = found.fields.get("warc-block-digest")
    if said and said != f"sha1:{digest(found.block)}":
        found.problem = "block digest does not match"
    said = found.fields.get("warc-payload-digest")
    if said and found.fields.get("warc-type") == "response" and said != f"sha1:{digest(found.http[1])}":
        found.problem = "payload digest does not match"
    return found


def records(content: bytes) -> Iterator[Record]:
    """The records of a file in their order; empty members hold none. A damaged member is a record with a problem, and reading goes
    on at the next beginning of a member behind its own."""
    view, at = memoryview(content), 0
    while at < len(view):
        try:
            behind, fields, block = _framed(view, at)
        except Damaged as e:
            yield Record(at, {}, b"", str(e))
            behind = content.find(MAGIC, at + 1)
            if behind < 0:
                return
        else:
            if fields:
                yield _verified(Record(at, fields, block))
        at = behind


def _page(name: str | None) -> int | None:
    found = _ID.fullmatch(name or "")
    return int(found[1]) if found and found[1] != "none" else None


def with_originals(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, payload, original): the page_id of the response, null where the row is one.

    Groups of equal payloads are counted by hash; of those with more than one row, the ones that hold over a 1000th of all such
    rows - at most 1000 - are looked up by broadcast, the others (each so small) by a join on the hash. Rows of the large groups go
    through that join by a number of their own, so no group meets in one task. A group without any page_id has no
    original: its rows are responses.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("hash", F.unhex(F.sha2("payload", 256)))
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1 AND last IS NOT NULL")
    groups = written(groups, "equal-payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = groups.where(F.col("n") * HOT_SHARE > total).select(F.col("hash").alias("hot_hash"), F.col("last").alias("hot_last"))
    rest = groups.where(F.col("n") * HOT_SHARE <= total).select(F.col("hash").alias("rest_hash"), F.col("last").alias("rest_last"))
    found = rows.join(F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left")
    own = F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")  # never as long as a hash
    found = found.withColumn("key", F.when(F.col("hot_hash").isNull(), F.col("hash")).otherwise(own))
    found = found.join(rest, F.col("key") == F.col("rest_hash"), "left")
    last = F.coalesce("hot_last", "rest_last")
    return found.select("page_id", "url", "payload", F.when(last.isNotNull() & ~last.eqNullSafe(F.col("page_id")), last).alias("original"))


def write_archives(pages: DataFrame, folder: str, per_file: int = RECORDS, level: int = 6, date: str = DATE) -> None:
    """Writes a WARC record for every row of pages(page_id, url, html) into files of ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [member(record(i, u, p, o, date), level)[:-1] for i, u, p, o in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.large_binary() if sum(map(len, found)) >> 31 else pa.binary())], names=["content"])

    packed = with_originals(pages).mapInArrow(run, "content binary")
    packed.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


#: What a record is read as; payload only where asked for.
READ = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, problem string"


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """READ, and the payload of responses if asked for: a row for each record of the folder's files, damaged ones with their
    problem. A file is read by one task from its beginning to its end; a task has files of spark.sql.files.maxPartitionBytes."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[-1], pa.binary())] if payload else []), names=names + ["payload"] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                file = file.as_py()
                for r in records(content.as_py()):
                    f, (http, body) = r.fields, r.http
                    said, length = f.get("warc-payload-digest", ""), http.get("content-length", "")
                    kind = f.get("warc-type")
                    row = (file, r.offset, _page(f.get("warc-record-id")), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")), len(body) if kind == "response" else int(length) if length.isdigit() else None, said.removeprefix("sha1:") or None, r.problem)
                    rows.append((*row, body) if payload else row)
                    size += len(body) if payload else 0
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield told(rows)
                        rows, size = [], 0
        if rows:
            yield told(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, READ + ", payload binary" * payload)


def unresolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) that revisits refer to, but no response has. Both sides are made distinct first,
    so a response that many revisits refer to is one row."""
    what = ["payload_digest", "payload_bytes"]
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *what).distinct()
    there = found.where("record_type = 'response'").select("page_id", *what).distinct()
    return wanted.join(there, ["page_id", *what], "left_anti")


def archive_round_trip(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to), a row for each row of pages. A record that can't be read, or a revisit of nothing, is an error.

    Null html is an empty payload; empty payloads are equal to each other. A null page_id is smaller than all others; rows
    that repeat the largest page_id of their payload are all responses. Urls play no part. An empty table gives an empty result,
    further columns are not read.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(pages, folder, per_file)
    found = written(read_archives(spark, folder), "records")
    bad = found.where("problem IS NOT NULL").select("file", "offset", "problem").first()
    if bad:
        raise ValueError(f"{bad['file']}, byte {bad['offset']}: {bad['problem']}")
    lost = unresolved(found).first()
    if lost:
        raise ValueError(f"no response {lost['page_id']} with digest {lost['payload_digest']}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
