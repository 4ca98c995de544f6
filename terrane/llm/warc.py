"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. Archives are written by Spark's text sink, so they reach any file system with its commit
protocol; the sink needs a line separator, which here is an empty gzip member and so part of a valid archive.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, chunks, new_path, tidied

#: Uncompressed bytes that an archive holds at most, unless it is one record.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS = "archive string, start long, stop long, gap string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d+)>")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the payload's HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page_id)[1:-1]
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id), "WARC-Target-URI": uri, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at `at` and where it ends. ValueError names the check that failed."""
    if not (m := _VERSION.match(data, at)):
        raise ValueError("no version line")
    if (stop := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        raise ValueError("header without end")
    fields = _fields(data[m.end() : stop])
    if not (length := fields.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no record end where the content length says")
    block = data[stop + 4 : end]
    if fields.get("warc-block-digest", x := f"sha1:{digest(block)}") != x:
        raise ValueError("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    if kind == "response" and fields.get("warc-payload-digest", x := f"sha1:{digest(payload)}") != x:
        raise ValueError("payload digest differs")
    n = _fields(head).get("content-length", "")
    page, refers = (int(m[1]) if (m := _ID.search(fields.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to"))
    out = {"page_id": page, "record_type": kind, "refers_to": refers, "payload_bytes": len(payload) if kind == "response" else int(n) if n.isdigit() else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    return out | {"payload": payload if kind == "response" else None}, end + 4


def _plain(data: bytes, base: int | None, whole: tuple[int, int]) -> Iterator[dict]:
    """Records and gaps of uncompressed bytes. base: where they lie in the archive, or None for a member's content, which lies at `whole`."""
    at, lost, why = 0, None, ""
    place = lambda a, b: {"start": whole[0] if base is None else base + a, "stop": whole[1] if base is None else base + b}
    while at < len(data):
        try:
            found, end = parse(data, at)
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if lost is not None:
            yield place(lost, at) | {"gap": why}
            lost = None
        yield place(at, end) | found
        at = end
    if lost is not None:
        yield place(lost, len(data)) | {"gap": why}


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """Content of the gzip member at `at`, or of it what comes before an error; where that ends, and what is wrong."""
    unzip, out, view, pos = zlib.decompressobj(31), [], memoryview(data), at
    while pos < len(data) and not unzip.eof:
        before = unzip.copy()
        try:
            out.append(unzip.decompress(view[pos : pos + step]))
        except zlib.error as e:
            n = min(step, len(data) - pos)
            while n > 1:  # the last step again, up to the error, by halves
                n = -(-n // 2)
                half = before.copy()
                with contextlib.suppress(zlib.error):
                    out.append(half.decompress(view[pos : pos + n]))
                    before, pos = half, pos + n
            return b"".join(out), pos, f"member: {e}"
        pos += step
    if not unzip.eof:
        return b"".join(out), len(data), "member without end"
    return b"".join(out), min(pos, len(data)) - len(unzip.unused_data), ""


def _whole_records(content: bytes) -> tuple[list[dict], int]:
    """The records at the head of a member's content that pass their checks, and where they end in it."""
    out, at = [], 0
    while at < len(content):
        try:
            found, at = parse(content, at)
        except ValueError:
            break
        out.append(found)
    return out, at


def _reached(data: bytes, at: int, n: int, step: int = 64) -> int:
    """The last byte, in steps, up to which the gzip member at `at` gives no more than n bytes."""
    unzip, held = zlib.decompressobj(31), 0
    while at < len(data):
        held += len(unzip.decompress(data[at : at + step]))
        if held > n:
            break
        at += step
    return min(at, len(data))


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive, compressed or not or mixed, with gaps where bytes could not be read.

    After a failed check the search goes on at whichever comes first and passes its own check: a gzip member whose content starts with
    a version line, or a version line whose record is whole. Of a damaged member the records before the damage count. Gaps carry
    their byte range and the check that failed; in a damaged member they begin behind the last whole record, to within some bytes.
    """
    at, lost, why, line = 0, None, "", -1  # line: the next version line, looked for once it is passed
    while at < len(data):
        made, end, wrong, stopped = [], at, "no version line", at
        if data.startswith(_MAGIC, at):
            content, end, wrong = _inflate(data, at)
            if wrong:
                whole, n = _whole_records(content)
                stopped = _reached(data, at, n) if whole else at
                made = [{"start": at, "stop": stopped} | r for r in whole]
            elif _VERSION.match(content) or lost is None:
                made = list(_plain(content, None, (at, end)))
            elif content:
                wrong = "member without a version line"
        elif _VERSION.match(data, at):
            try:
                found, end = parse(data, at)
                made, wrong = [{"start": at, "stop": end} | found], ""
            except ValueError as e:
                wrong = str(e)
        if lost is not None and made:
            yield {"start": min(lost, at), "stop": at, "gap": why}
            lost = None
        yield from made
        if wrong or lost is not None and not made:
            if lost is None:
                lost, why = stopped if made else at, wrong
            if wrong:
                if line <= at:
                    m = _VERSION.search(data, at + 1)
                    line = m.start() if m else len(data)
                magic = data.find(_MAGIC, at + 1, line)
                at = magic if magic >= 0 else line
            else:
                at = end
        else:
            at = end
    if lost is not None:
        yield {"start": lost, "stop": len(data), "gap": why}


def _members(most: int):
    """A gzip member for each page, and the number of its archive among those of the task: one is full where the next record would bring it
    over `most` bytes of content, so a record that is longer has an archive of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for batch in chunks(batches, "html"):
            page, url, html, refers = (c.to_pylist() for c in batch.columns)
            out, numbers = [], []
            for p, u, h, r in zip(page, url, html, refers):
                content = record(p, u, h or b"", r)
                if held and held + len(content) > most:
                    number, held = number + 1, 0
                held += len(content)
                numbers.append(number)
                out.append(gzip.compress(content, 4, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(numbers, pa.int32())], names=["member", "archive"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record for each page (page_id, url, html).

    Of pages with equal payloads of at least `least_bytes` bytes, that with the largest page_id is a response and the others revisit
    it. A null html is an empty payload. A null page_id is never referred to and always a response; so is each of several rows that
    share the largest page_id.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("_sha", F.unhex(F.sha1("html")))
    keys = pages.select(F.col("page_id").cast("long"), html.alias("html"))
    same = keys.groupBy(F.unhex(F.sha1("html")).alias("_sha")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"), F.max(F.octet_length("html")).alias("_bytes"))
    again = same.filter((F.col("_n") > 1) & (F.col("_bytes") >= least_bytes)).select("_sha", "_last")
    refers = F.when(F.col("page_id") < F.col("_last"), F.col("_last"))
    members = rows.join(again, "_sha", "left").select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_members(archive_bytes), "member binary, archive int")
    sink = members.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive")
    sink.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).text(path)


def _some(records: Iterator[dict], most: int = 4096) -> Iterator[list[dict]]:
    """Records in lists of bounded number and bytes of payload."""
    held, size = [], 0
    for x in records:
        held.append(x)
        size += len(x.get("payload") or b"")
        if len(held) >= most or size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder. Rows with a `gap` are quarantined byte ranges, the others are records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "stop", "gap", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for out in _some(x if payloads else x | {"payload": None} for x in salvage(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(out)), *(pa.array([x.get(n) for x in out], t) for n, t in zip(names, types))], names=["archive", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


@tidied
def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and tell of each record what it says of itself.

    Repeated rows give a record each; an empty table writes no record and gives no rows. Very long payloads are records like others.
    Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
