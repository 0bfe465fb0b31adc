"""Legacy ARC archives converted to WARC, written as files and read back.

The converter parses version-specific ARC header lines and declared lengths:

    version 1: URL IP date type length
    version 2: URL IP date type status checksum location offset file length

and makes WARC records with identifiers from the content, ISO timestamps, types and
SHA-1 digests. Records with equal payloads keep a response, the one with the smallest
page_id; the others become revisits that name it. Pages are first laid down as ARC files
of both versions, and the converter reads nothing but these files.

Shape at scale. Digests alone are grouped, with a minimum that combines before the
shuffle; only revisits join back, by page_id and digest. Payloads are dealt once, by
page_id and digest, into archives of about ARCHIVE_BYTES, so rows that share an id are
spread. Files are gzip members, one a record, replaced as a whole by a retried task.

Edge cases. A null html is an empty payload and takes part like any other. A null
page_id is kept as text "-" and counts as greater than all others: it revisits whatever
id has its payload, and is a response where none has. Rows that share a page_id are
judged by their own payloads; rows that share both are all responses, or all revisits. A null or odd URL
is percent-escaped or "-". An empty table writes no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import batches_of, discard, discard_path, lean, make_dirs, materialize, new_path, parts_for, text_bytes, write_blob

ARCHIVE_BYTES = 16 << 20
#: Fields of the header line by ARC version: fixed values of the format.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
CRLF = b"\r\n"


def arc_header(version: int, origin: str) -> bytes:
    """The version block that opens an ARC file."""
    names = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 {origin}\n".encode() + names + b"\n"
    line = f"filedesc://{origin}.arc 0.0.0.0 20240101000000 text/plain"
    if version == 2:
        line += f" 200 - - 0 {origin}.arc"
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, payload: bytes, status: int = 200, offset: int = 0, file: str = "-") -> bytes:
    """One ARC record: header line, payload of the declared length, line feed."""
    middle = f" {status} - - {offset} {file}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {len(payload)}\n".encode() + payload + b"\n"


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file of either version; the version block decides."""
    line, at = _line(content, 0)
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file opens with its version block")
    size = int(line.rsplit(b" ", 1)[1])
    version = int(content[at : at + size].split(b" ", 1)[0])
    names = FIELDS[version]
    at += size + 1
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        line, at = _line(content, at)
        values = line.decode("utf-8").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC header line of version {version} has {len(names)} fields")
        record = dict(zip(names, values, strict=True))
        size = int(record["length"])
        if at + size > len(content):
            raise ValueError("an ARC record is shorter than it declares")
        record["payload"] = content[at : at + size]
        record["version"] = version
        yield record
        at += size + 1


def _line(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\n", at)
    if end < 0:
        raise ValueError("an ARC header line has no end")
    return content[at:end].rstrip(b"\r"), end + 1


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC timestamp."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    d = (date + "00000101000000"[len(date) :] if len(date) < 8 else date.ljust(14, "0"))[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: dict, page_id: int | None, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of another page's."""
    refers = refers_to is not None
    digest = payload_digest(arc["payload"])
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{arc['url']} {arc['date']} {page_id} {digest}")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if refers else b"response"),
        f"WARC-Record-ID: <urn:uuid:{name}>".encode(),
        f"WARC-Target-URI: {arc['url']}".encode(),
        f"WARC-Date: {iso_date(arc['date'])}".encode(),
        f"WARC-IP-Address: {arc['ip']}".encode(),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"WARC-Identified-Payload-Type: {arc['type']}".encode(),
        f"X-Page-ID: {'-' if page_id is None else page_id}".encode(),
        f"X-Payload-Length: {len(arc['payload'])}".encode(),
    ]
    if refers:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}".encode()]
    body = b"" if refers else arc["payload"]
    head.append(f"Content-Length: {len(body)}".encode())
    return CRLF.join(head) + CRLF * 2 + body + CRLF * 2


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a WARC file, gzip members or plain."""
    if content[:2] == b"\x1f\x8b":
        # A reader goes from member to member without copying what is left of the file.
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
            content = members.read()
    at = 0
    while at < len(content):
        end = content.index(CRLF * 2, at)
        first, *lines = content[at:end].split(CRLF)
        if not first.startswith(b"WARC/"):
            raise ValueError("a WARC record opens with its version")
        head = dict(line.decode().split(": ", 1) for line in lines)
        start = end + 4
        size = int(head["Content-Length"])
        yield head, content[start : start + size]
        at = start + size + 4


#: The record of an ARC file that names its other records' pages, one line each.
PAGES = "metadata://pages"


def _dates(page: int | None) -> tuple[str, str]:
    """The date and address of a page's record, where the table has none: both from its id."""
    k = zlib.crc32(str(page).encode())
    day = datetime.datetime(1996, 1, 1) + datetime.timedelta(seconds=k % (15 * 365 * 86_400))
    return day.strftime("%Y%m%d%H%M%S"), f"10.{k >> 8 & 255}.{k >> 16 & 255}.{k >> 24}"


def write_arcs(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> str:
    """Lay pages (page_id, url, html) down as ARC files, their versions taking turns.

    Each file ends with a record that has, for each of the others, its page_id and the
    page_id that it revisits, if any. Gives the folder.
    """
    spark = pages.sparkSession
    _, size = text_bytes(pages, "html")
    folder = new_path(spark, "arc")
    make_dirs(spark, folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html").cast("long"))
    # Null is a page_id after all others, so it keeps a payload only where no id does.
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit((1 << 63) - 1)))
    digests = rows.select("key", "page_id", "digest", "size")
    groups = digests.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.min("page_id").alias("refers_to")).where("n > 1").drop("n")
    again = digests.join(groups, ["digest", "size"]).where(F.col("key") != F.col("first")).select(F.col("key").alias("k"), F.col("digest").alias("g"), F.col("size").alias("s"), "refers_to").distinct()
    parts = parts_for(size, ARCHIVE_BYTES)
    # Payloads are dealt once, by id and payload: the join takes them as they lie.
    joined = rows.repartition(parts, "key", "digest", "size").join(again, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("g")) & (F.col("size") == F.col("s")), "left")
    dealt = joined.select("key", "page_id", "url", "html", "refers_to").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, notes, size, number, done = [], [], 0, 0, 0

        def close() -> None:
            name = f"part-{part:06d}-{number:05d}"
            held.append(gzip.compress(arc_record(version, PAGES, "0.0.0.0", "20240101000000", "text/plain", "\n".join(notes).encode(), file=name), 1, mtime=0))
            write_blob(folder, f"{name}.arc.gz", b"".join(held))

        for batch in batches_of(batches, "html", 1 << 20):
            part = batch.column("part")[0].as_py()
            version = versions[(part + number) % len(versions)]
            for page, url, html, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if not held:
                    version = versions[(part + number) % len(versions)]
                    held.append(gzip.compress(arc_header(version, f"part-{part:06d}-{number:05d}"), 1, mtime=0))
                payload = html.encode()
                date, ip = _dates(page)
                held.append(gzip.compress(arc_record(version, quote(url, safe=":/?#[]@!$&'()*+,;=%~"), ip, date, "text/html", payload, offset=size), 1, mtime=0))
                notes.append(f"{'-' if page is None else page} {'-' if to is None else to}")
                size += len(payload)
                done += 1
                if size > 2 * ARCHIVE_BYTES:
                    close()
                    held, notes, size, number = [], [], 0, number + 1
        if held:
            close()
        yield pa.record_batch([pa.array([done], pa.int64())], names=["records"])

    discard(materialize(dealt.mapInArrow(lean(write), "records long"), "arc-written"))
    return folder


def convert_arcs(spark, arcs: str) -> str:
    """Convert each ARC file of a folder to a WARC file; gives the folder of these."""
    folder = new_path(spark, "warc")
    make_dirs(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc.gz").load(arcs)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.arc\.gz$", 1).alias("name"), "content")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
                    content = members.read()
                records = list(parse_arc(content))
                if not records or records[-1]["url"] != PAGES:
                    raise ValueError("an ARC file without the record of its pages")
                notes = records.pop()["payload"].decode().split("\n")
                out = []
                for record, note in zip(records, notes, strict=True):
                    page, to = (None if x == "-" else int(x) for x in note.split(" "))
                    out.append(gzip.compress(warc_record(record, page, to), 5, mtime=0))
                write_blob(folder, f"{name}.warc.gz", b"".join(out))
                yield pa.record_batch([pa.array([len(out)], pa.int64())], names=["records"])

    discard(materialize(named.mapInArrow(lean(convert), "records long"), "warc-written"))
    return folder


def write_archives(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> str:
    """Pages as ARC files, converted to WARC files; gives the folder of the WARC files.

    The pages stand in for a legacy archive; its files go once they are converted.
    """
    arcs = write_arcs(pages, versions)
    folder = convert_arcs(pages.sparkSession, arcs)
    discard_path(pages.sparkSession, arcs)
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """(page_id, url, date, payload_bytes, payload_digest, record_type, refers_to, payload).

    All from the archives' bytes; the payload of a revisit is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for head, block in parse_warc(content):
                    page = head["X-Page-ID"]
                    response = head["WARC-Type"] == "response"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and payload_digest(block) != digest:
                        raise ValueError("a payload does not have the digest its record names")
                    to = None if response else head["X-Refers-To-Page-ID"]
                    rows.append((None if page == "-" else int(page), unquote(head["WARC-Target-URI"]), head["WARC-Date"], len(block) if response else int(head["X-Payload-Length"]), digest, head["WARC-Type"], None if to in (None, "None") else int(to), block if response else None))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(lean(read), "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
