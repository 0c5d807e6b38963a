"""Legacy archives: ARC records read by their declared lengths and converted to WARC, written and read back.

An ARC file starts with a version block whose second line names the version, and whose third line the
fields of the header lines: version 1 has ``URL IP-address Archive-date Content-type Archive-length``,
version 2 adds result code, checksum, location, offset and file name.  Each record is a header line,
a body of exactly the declared length, and a newline.  The converter synthesises what WARC needs:
record id, date, type, block and payload digests.  Of records with equal payloads that with the
smallest id is a ``response``; the others are ``revisit`` records that refer to it and hold no payload.
Every file begins with a ``warcinfo`` record, which the file's other records name.

Scale: one pass makes and reads the ARC archives and writes their records as a table; digests alone are
read from it to find equal payloads (a map-side minimum), and payloads move once, in a sort-merge
join of two written tables, so adaptive execution can split a payload that a third of all pages
share.  WARC files are written by Spark to the shared folder (each row a record, the record separator the
line separator), each of at most ``PART_BYTES`` and one record, and read back by a stream, so a task
holds one such file compressed and a batch of its records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, prepare, write_table
from tessera.sources.tables import scratch

#: Bytes of the records of one WARC file, but for its last; bytes of a file that are unpacked at a time.
PART_BYTES, PIECE = 64 << 20, 1 << 20
#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 0
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: What a header line says where the table knows no date and no address.
_DATE, _IP = "19700101000000", "0.0.0.0"
#: A date of a header line: a year, then pairs of digits down to the second, as far as they are known.
DATE_PATTERN = r"^\d{4}(\d\d){0,5}$"
_END = b"\r\n\r\n"


class ArcRecord(NamedTuple):
    url: str
    date: str
    content_type: str
    body: bytes
    result_code: str | None


def write_arc(records: list[tuple[str, bytes]], version: int = 1, name: str = "pages.arc", date: str = _DATE, dates: list[str] | None = None) -> bytes:
    """An ARC file of (url, body); white space and controls in a url are percent-encoded, an empty url is ``-``.

    ``dates`` are those of the records; without them all have that of the file.
    """
    fields = V1 if version == 1 else V2
    about = f"{version} 0 tessera\n{fields}\n".encode()
    head = f"filedesc://{name} {_IP} {date} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    out = [f"{head} {len(about)}\n".encode(), about, b"\n"]
    offset = sum(map(len, out))
    for (url, body), at in zip(records, dates or [date] * len(records)):
        line = f"{encode_url(url)} {_IP} {at} text/html"
        if version == 2:
            checksum = base64.b32encode(hashlib.sha1(body).digest()).decode()
            line += f" 200 {checksum} - {offset} {name}"
        part = f"{line} {len(body)}\n".encode() + body + b"\n"
        offset += len(part)
        out.append(part)
    return b"".join(out)


def encode_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "-"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, version 1 or 2 by its version block; a broken one raises ValueError."""
    stream = io.BytesIO(data)
    fields: list[str] | None = None
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length at the end of the header line {line[:80]!r}")
        body = stream.read(int(parts[-1]))
        if len(body) < int(parts[-1]):
            raise ValueError("the archive ends inside a record")
        if fields is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("the archive doesn't begin with a version block")
            about = body.decode("utf-8", "replace").split("\n")
            version = about[0].split(" ")[0]
            if version not in ("1", "2") or len(about) < 2:
                raise ValueError(f"version {version!r} is unknown")
            fields = about[1].split(" ")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields in a header line of {len(fields)}")
        row = dict(zip(fields, parts))
        yield ArcRecord(row["URL"], row["Archive-date"], row["Content-type"], body, row.get("Result-code"))


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object, url: str, payload_digest: str) -> str:
    """A record identifier that depends on the record alone, so that a retried task makes the same; a page without a key is named by its url and digest."""
    name = f"page:{key}" if key is not None else f"page:{payload_digest}:{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_date(date: str) -> str:
    d = date + _DATE[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def write_warc(key: int | None, url: str, date: str, content_type: str, payload: bytes, payload_digest: str, refers_to: int | None, info: str | None = None) -> bytes:
    """A WARC record without the two line ends that close it; ``info`` is the id of its file's first record."""
    block = b"" if refers_to is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, url, payload_digest)}", f"WARC-Date: {warc_date(date)}"]
    lines += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if info is not None:
        lines.append(f"WARC-Warcinfo-ID: {info}")
    if key is not None:
        lines.append(f"X-Page-Id: {key}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, '', '')}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def write_warcinfo(info: str, date: str) -> bytes:
    """The record that heads a file, without the two line ends that close it."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {info}", f"WARC-Date: {warc_date(date)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def read_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a file that comes in pieces, by declared lengths; verifies the block digest."""
    held, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        done = piece is None
        held.extend(piece or b"")
        return not done

    while True:
        while (end := held.find(_END)) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record's head")
            return
        first, *rest = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record where {first[:40]!r} is")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in rest)}
        start, size = end + 4, int(head["content-length"])
        while len(held) < start + size + 4 and more():
            pass
        block = bytes(held[start : start + size])
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        if head.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise ValueError(f"the digest of {head.get('warc-record-id')} doesn't fit its block")
        yield head, block
        del held[: start + size + 4]


def unpacked(content: bytes) -> Iterator[bytes]:
    """A gzip file in pieces, member after member."""
    while content:
        unzip = zlib.decompressobj(31)
        piece = unzip.decompress(content, PIECE)
        while piece or unzip.unconsumed_tail:
            yield piece
            piece = unzip.decompress(unzip.unconsumed_tail, PIECE)
        content = unzip.unused_data


def arc_records(pages: DataFrame, key_col: str, url_col: str, payload_col: str, date_col: str | None = None) -> DataFrame:
    """(key, url, date, type, payload, digest) of each page, by way of ARC archives of both versions, written once."""
    date = F.col(date_col).cast("string") if date_col else F.lit(None).cast("string")
    date = F.when(date.rlike(DATE_PATTERN), date).otherwise(_DATE)
    kept = pages.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"), date.alias("date"))

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        turn = [0]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            turn[0] += 1
            archive = write_arc(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), 1 + turn[0] % 2, dates=batch.column(3).to_pylist())
            records = list(read_arc(archive))
            columns = [batch.column(0), pa.array([r.url for r in records]), pa.array([r.date for r in records]), pa.array([r.content_type for r in records])]
            columns += [pa.array([r.body for r in records], pa.binary()), pa.array([digest(r.body) for r in records])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "date", "type", "payload", "digest"])

        return step

    return write_table(arrow_map(kept, "key long, url string, date string, type string, payload binary, digest string", start), "arc", compression="zstd")


def convert(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT, date_col: str | None = None) -> DataFrame:
    """(file, place, key, digest, refers_to, record): the WARC records, the number of a record's file among those of its task, and its place there.

    Besides a record a page there is one a file, its first, which has neither key nor digest.  ``date_col``
    holds dates as header lines do (4 to 14 digits); without it, or where it holds something else, a page is of 1970.
    A null payload is empty; a null url is written as ``-``.  A page without a key revisits the smallest
    key of equal payload, and is a response where there is none.  Rows that repeat a key are records of
    their own; a key refers to another only if that is smaller.
    """
    arc = arc_records(pages, key_col, url_col, payload_col, date_col)
    now = time.strftime("%Y%m%d%H%M%S", time.gmtime())
    # Digests alone are compared; payloads move once, to meet what they refer to.
    sums = arc.select("key", "digest", F.length("payload").alias("n")).where(F.col("n") >= least_revisit) if least_revisit else arc.select("key", "digest")
    first = write_table(sums.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "first")
    refers = F.when(F.col("key").isNull() | (F.col("first") < F.col("key")), F.col("first"))
    joined = arc.join(first, "digest", "left").select("key", "url", "date", "type", "payload", "digest", refers.alias("refers_to"))

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        state = {"bytes": 0, "file": -1, "place": 0, "info": ""}

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for key, url, date, kind, payload, payload_digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                file = state["bytes"] // PART_BYTES
                if file != state["file"]:
                    state.update(file=file, place=0, info=record_id(None, url, f"file:{key}:{payload_digest}"))
                    rows.append((file, 0, None, None, None, write_warcinfo(state["info"], now)))
                state["place"] += 1
                record = write_warc(key, url, date, kind, payload, payload_digest, refers_to, state["info"])
                state["bytes"] += len(record)
                rows.append((file, state["place"], key, payload_digest, refers_to, record))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        return step

    names = ["file", "place", "key", "digest", "refers_to", "record"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return arrow_map(joined, "file int, place long, key long, digest string, refers_to long, record binary", start)


def write_archives(records: DataFrame, path: str) -> None:
    """Write the records of ``convert`` as gzipped WARC files, in their order."""
    text = records.select("file", "place", F.col("record").cast("string").alias("value")).sortWithinPartitions("file", "place").select("file", "value")
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("file").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload_bytes, digest, type, refers_to, url, record_id, date, payload) of the pages' records under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    names = ["key", "payload_bytes", "digest", "type", "refers_to", "url", "record_id", "date", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in read_warc(unpacked(content.as_py())):
                if head["warc-type"] == "warcinfo":
                    continue
                key, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                rows.append((int(key) if key else None, int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(refers) if refers else None, head["warc-target-uri"], head["warc-record-id"], head["warc-date"], block))
                size += len(block)
                if size > PIECE:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return arrow_map(files, "key long, payload_bytes long, digest string, type string, refers_to long, url string, record_id string, date string, payload binary", lambda: step)


def archive(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, least_revisit: int = LEAST_REVISIT, date_col: str | None = None) -> DataFrame:
    """Convert ``pages``, write the WARC files to ``path`` (by default in the shared folder, among the tables that can be dropped), and read them back."""
    spark = prepare(pages.sparkSession)
    path = path or scratch(spark, "warc")
    write_archives(convert(pages, key_col, url_col, payload_col, least_revisit, date_col), path)
    return read_archives(spark, path)
