"""WARC: converter for the legacy ARC format.

An ARC file starts with a `filedesc://` record whose body names the version and the fields of the header lines that
follow: version 1 has five (URL, IP address, date, type, length), version 2 has ten (with result code, checksum,
location, offset and file name). The parser reads each header line by its file's version, takes exactly the declared
number of bytes as the block, and synthesises an equivalent WARC record: identifier (a name-based UUID of URI, date
and digest), ISO timestamp, record type, content type, and block and payload digests.

Archives hold one gzip member a record, as WARC files usually do, and begin with a warcinfo record; files are cut at
FILE_BYTES. They are put together by the tasks and written by Spark's text writer, one row a file. Parsing takes any
number of gzip members and follows the declared lengths only, so payloads may hold any bytes, separators too.
Records with equal payloads of at least MIN_REVISIT bytes are written once; the others become revisit records.

Defined results: a null html is an empty payload; a null or blank url becomes `urn:page:<id>` in the archive; payloads
under MIN_REVISIT bytes, rows without a page_id, and rows that repeat the smallest page_id with its payload, are
responses; a page_id that stands on rows with different payloads is judged for each payload by itself; an empty table
gives no rows; other columns are not read. A truncated or malformed archive raises ValueError naming the offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path

MIN_REVISIT = 100
#: Bytes after which a new ARC segment, with its own version record, is begun.
SEGMENT_BYTES = 8 << 20
#: Compressed bytes after which an archive file ends; readers hold one file at a time.
FILE_BYTES = 16 << 20
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
#: Written where no address is known.
NO_IP = ("0.0.0.0", "-", "")
INFO = b"software: docgrid\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version record that opens an ARC file."""
    body = f"{version} 0 docgrid\n{TITLES[version]}\n".encode()
    more = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, at: int = 0, name: str = "-") -> bytes:
    more = f"200 {hashlib.md5(block).hexdigest()} - {at} {name} " if version == 2 else ""
    return f"{url} 192.0.2.1 {date} {kind} {more}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file (or of several, one after the other), the version records included."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC: header line at {at} has no end")
        line = data[at:end].decode("utf-8", "surrogateescape")
        first = line.startswith("filedesc://")
        if first:  # its own line has the form that its body is about to declare
            version = 2 if len(line.split(" ")) >= 10 else 1
        if version is None:
            raise ValueError(f"ARC: no version record before {at}")
        values = line.rsplit(" ", len(FIELDS[version]) - 1)  # old writers left blanks in URLs
        if len(values) != len(FIELDS[version]) or not values[-1].isdigit():
            raise ValueError(f"ARC: header line at {at} does not fit version {version}")
        head = dict(zip(FIELDS[version], values))
        block = data[end + 1 : end + 1 + int(head["length"])]
        if len(block) != int(head["length"]):
            raise ValueError(f"ARC: record at {at} declares {head['length']} bytes, {len(block)} follow")
        if first:
            declared = block.split(b" ", 1)[0]
            if not declared.isdigit() or int(declared) != version:
                raise ValueError(f"ARC: version record at {at} does not fit its header line")
        yield head | {"version": version, "block": block, "filedesc": first}
        at = end + 1 + len(block) + 1


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload); ('', block) if it is not an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(END)
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def iso_date(date: str) -> str:
    """14 digits (older files: 12 or 8) as WARC's timestamp."""
    d = (date + "00000101000000"[len(date) :]) if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(head: dict) -> dict:
    """The WARC record equivalent to an ARC record."""
    http, payload = http_parts(head["block"])
    digest = hashlib.sha256(payload).hexdigest()
    kind = "warcinfo" if head["filedesc"] else "response" if http else "resource"
    name = f"{head['url']} {head['date']} {hashlib.sha256(head['block']).hexdigest()}"
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "type": kind,
        "uri": head["url"],
        "date": iso_date(head["date"]),
        "ip": None if head["ip"] in NO_IP else head["ip"],
        "content_type": "application/http; msgtype=response" if http else head["type"],
        "http": http,
        "payload": payload,
        "digest": digest,
    }


def warc_record(rec: dict, refers_to: dict | None = None) -> bytes:
    """A record without the separator that ends it; refers_to: the response whose payload this one repeats."""
    block = rec["http"] if refers_to else rec["http"] + rec["payload"]
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else rec['type']}",
        f"WARC-Record-ID: {rec['record_id']}",
        f"WARC-Date: {rec['date']}",
        *([f"WARC-Target-URI: {rec['uri']}"] if rec["type"] != "warcinfo" else []),
        *([f"WARC-IP-Address: {rec['ip']}"] if rec.get("ip") else []),
        *([f"WARC-Refers-To: {refers_to['record_id']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        f"WARC-Payload-Digest: sha256:{rec['digest']}",
        f"WARC-Block-Digest: {sha1(block)}",
        f"Content-Type: {rec['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block


def info_record(name: str, date: str) -> bytes:
    """The warcinfo record that opens a WARC file."""
    return warc_record({"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "type": "warcinfo", "date": date, "content_type": "application/warc-fields", "http": b"", "payload": INFO, "digest": hashlib.sha256(INFO).hexdigest()})


def member(data: bytes) -> bytes:
    """One gzip member."""
    made = zlib.compressobj(4, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def members(data: bytes) -> bytes:
    """What the gzip members of a file hold together. Read in small pieces, as what follows a member is copied."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        start, made = at, zlib.decompressobj(31)
        while not made.eof:
            piece = view[at : at + 4096]
            if not piece:
                raise ValueError(f"gzip: the member at {start} has no end")
            try:
                out.append(made.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"gzip: no member at {start}") from e
            at += len(piece)
        at -= len(made.unused_data)
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Header fields (lower-cased names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"WARC: no record header at {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != END:
            raise ValueError(f"WARC: record at {at} does not end where it declares")
        yield head | {"block": block}
        at = end + 8 + n


def arc_segments(pages: DataFrame) -> DataFrame:
    """ARC files (column arc, binary) of the pages; the version alternates from segment to segment."""

    def write(batches):
        names, out, at, version = 0, io.BytesIO(), 0, 1
        date = "20240101000000"

        def begin():
            nonlocal out, at, names, version
            version, names = 1 + names % 2, names + 1
            out = io.BytesIO()
            at = out.write(arc_start(version, f"segment-{names}.arc", date))

        begin()
        empty = True
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload, page = html or b"", "" if i is None else f"X-Page-Id: {i}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{page}\r\n".encode() + payload
                uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url and url.strip() else f"urn:page:{"none" if i is None else i}"
                at += out.write(arc_record(version, uri, date, "text/html", block, at, f"segment-{names}.arc"))
                empty = False
                if at >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["arc"])
                    begin()
                    empty = True
        if not empty:
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["arc"])

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(write, "arc binary")


RECORD = "page_id bigint, record_id string, type string, uri string, date string, ip string, content_type string, http binary, payload binary, digest string"


def converted(arcs: DataFrame) -> DataFrame:
    """The WARC records equivalent to the ARC files in column arc, without the version records."""
    fields = [x.split(" ")[0] for x in RECORD.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]] for x in RECORD.split(", ")]

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head in parse_arc(data.as_py()):
                    if not head["filedesc"]:
                        rec = convert(head)
                        found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", rec["http"])
                        rows.append(rec | {"page_id": int(found[1]) if found else None})
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types)], names=fields)

    return arcs.mapInArrow(parse, RECORD)


def revisits(records: DataFrame) -> DataFrame:
    """(record_id, digest, ref_id) of the records that repeat the payload of one with a smaller page_id.

    Only digests move, and each task hands on one row a digest, so a payload that a third of the pages share costs no more than another.
    """
    light = records.where(F.length("payload") >= MIN_REVISIT).where("page_id is not null").select("page_id", "record_id", "digest")
    first = light.groupBy("digest").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return light.join(first, "digest").where("page_id > first.page_id").select("record_id", "digest", F.col("first.record_id").alias("ref_id")).distinct()


def write_archives(records: DataFrame, links: DataFrame, path: str) -> None:
    """WARC files of the records; links: of those that become revisits."""

    def render(batches):
        out, size, files = [], 0, 0
        start = uuid.uuid4().hex  # of this attempt of the task; a file's name in its warcinfo record only
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if not out:
                        out.append(member(info_record(f"{start}-{files}", row["date"]) + END))
                    ref = {"record_id": row["ref_id"]} if row["ref_id"] else None
                    out.append(member(warc_record(row, ref) + END))
                    size += len(out[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
                        out, size, files = [], 0, files + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    whole = records.join(links, ["record_id", "digest"], "left").mapInArrow(render, "value binary")
    # The cast keeps the bytes as they are. Spark's writer ends each row, so each file, by the separator: an empty gzip member.
    end = member(b"").decode("latin-1")
    whole.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Each record of the archives: page_id, type, record_id, refers-to id, payload length and digest.

    Payload digests of responses are computed anew and must equal the declared ones.
    """
    fields = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("ref_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for rec in parse_warc(members(data.as_py())):
                    if rec["warc-type"] == "warcinfo":
                        continue
                    http, payload = http_parts(rec["block"])
                    declared = rec["warc-payload-digest"].removeprefix("sha256:")
                    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                    n = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", http)[1])
                    if rec["warc-type"] != "revisit" and (hashlib.sha256(payload).hexdigest() != declared or n != len(payload)):
                        raise ValueError(f"WARC: {rec['warc-record-id']} does not have its declared payload")
                    rows.append((int(found[1]) if found else None, rec["warc-type"], rec["warc-record-id"], rec.get("warc-refers-to"), n, declared))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), fields)] if rows else [pa.array([], t.type) for t in fields], schema=fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id bigint, record_type string, record_id string, ref_id string, payload_bytes bigint, payload_digest string")


def archived(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC files in the shared folder, and those files read back."""
    spark = pages.sparkSession
    records = converted(arc_segments(pages))
    links = revisits(records)
    path = new_path(spark, "warc")
    write_archives(records, links, path)
    rows = read_archives(spark, path)
    # A revisit names its response by record id; what is referred to is one row a digest at most.
    responses = rows.where("record_type = 'response'").select(F.col("record_id").alias("ref_id"), F.col("page_id").alias("refers_to"))
    wanted = rows.where("ref_id is not null").select("ref_id").distinct()
    named = responses.join(wanted, "ref_id", "left_semi").groupBy("ref_id").agg(F.min("refers_to").alias("refers_to"))
    return rows.join(named, "ref_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives and back."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("record_id")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)"""
