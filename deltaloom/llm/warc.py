"""Operator 6: converting legacy ARC archives to WARC, and writing pages as WARC records.

An ARC file is a version block, whose body names the fields of the header lines that follow, and records: one header
line, then as many bytes as its last field declares, then a line end. The version decides the line: version 1 has URL, IP
address, date, type and length; version 2 has the result code, checksum, location, offset and file name before the
length. URLs with spaces are met in old files, so fields are counted from the line's end.

For each record the converter makes what a WARC file needs and ARC lacks: a record id (from URL, date and payload digest,
so a later run gives the same), the date in ISO form, the type (response with an HTTP head, resource without, warcinfo for
the version block), block and payload digests, and the length. A record whose payload was met before becomes a revisit:
the HTTP head alone, with the payload's digest and a reference to the response's record.

Defined results for pages: a null html is the empty payload; a null url is written as ``unknown:``; a null page id is
written as such and is never referred to; rows that repeat the response's id and payload are responses too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices

#: The field lists of the two versions of ARC header lines.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: A payload of fewer bytes is always written in full.
LEAST = 1000


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes

    @property
    def is_version_block(self) -> bool:
        return self.fields["URL"].startswith("filedesc:")


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(default=b"", repr=False)

    def to_bytes(self) -> bytes:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers.items()) + "\r\n"
        return head.encode() + self.block + b"\r\n\r\n"


def arc_version_block(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 deltaloom\n{' '.join(FIELDS[version])}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, body: bytes, version: int, kind: str = "text/html") -> bytes:
    extra = "" if version == 1 else "200 - - 0 - "
    return f"{url} 0.0.0.0 {date} {kind} {extra}{len(body)}\n".encode() + body + b"\n"


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC stream. The first line's own version block tells how later lines are read."""
    names: list[str] | None = None
    while line := stream.readline():
        if line.strip() == b"":
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        parts = text.split(" ")
        if names is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            own = FIELDS[1] if len(parts) == len(FIELDS[1]) else FIELDS[2]
        else:
            own = names
        if len(parts) < len(own):
            raise ValueError(f"an ARC header line has {len(parts)} fields, not {len(own)}: {text[:80]!r}")
        tail = parts[len(parts) - len(own) + 1 :]
        fields = dict(zip(own, [" ".join(parts[: len(parts) - len(own) + 1]), *tail], strict=True))
        if not fields["Archive-length"].isdigit():
            raise ValueError(f"no length in {text[:80]!r}")
        length = int(fields["Archive-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError(f"{fields['URL'][:80]!r}: {length} bytes are declared, {len(body)} are there")
        if names is None:
            told = body.decode("utf-8", "replace").splitlines()
            version = int(told[0].split(" ")[0])
            names = told[1].split(" ") if len(told) > 1 and told[1].startswith("URL ") else FIELDS[version]
        yield ArcRecord(fields, body)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload); no head if the body doesn't begin as HTTP does."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body, b"") if found is None else (body[: found.end()], body[found.end() :])


def iso_date(date: str) -> str:
    """14 digits, or fewer in the oldest files, as ISO 8601."""
    d = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def convert(arc: ArcRecord, refers_to: dict[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record; ``refers_to``: the headers that name the response that a revisit is a copy of."""
    url, date = arc.fields["URL"], iso_date(arc.fields["Archive-date"])
    if arc.is_version_block:
        block = f"software: deltaloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {url}\r\n".encode()
        return WarcRecord({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", url, date), "WARC-Date": date, "WARC-Block-Digest": sha1(block), "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}, block)
    head, payload = split_http(arc.body)
    digest = sha1(payload)
    headers = {"WARC-Type": ("revisit" if refers_to else "response") if head else "resource", "WARC-Record-ID": record_id(url, date, digest, str(len(arc.body))), "WARC-Target-URI": url, "WARC-Date": date, "WARC-IP-Address": arc.fields["IP-address"], "WARC-Payload-Digest": digest}
    block = arc.body
    if refers_to:
        block = head
        headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Payload-Length": str(len(payload))} | refers_to
    headers |= {"WARC-Block-Digest": sha1(block), "Content-Type": "application/http; msgtype=response" if head else arc.fields["Content-type"], "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def read_warc(source: bytes | io.IOBase) -> Iterator[WarcRecord]:
    """The records of a WARC file or stream, compressed record by record or not, one at a time; digests are checked."""
    stream = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source, 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            headers[name] = value
        n = int(headers["Content-Length"])
        record = WarcRecord(headers, stream.read(n))
        if len(record.block) != n or sha1(record.block) != headers["WARC-Block-Digest"] or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        yield record


DATE = "20260101000000"


def page_arc(page_id: int | None, url: str | None, payload: bytes, version: int) -> bytes:
    """A page as a legacy capture; its id goes in the HTTP head."""
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "unknown:") or "unknown:"
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
    return arc_record(clean, DATE, head.encode() + payload, version)


def with_responses(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, response_id and response_url (of the record with an equal payload that is written in full;
    null where the row's own is). Digests are summed up before they are shuffled, and only those that occur more than
    once are joined back, in salted parts, so a payload that a third of all pages have is not one task's."""
    salts = 16
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    size = F.octet_length("html")
    big = rows.where(size >= least).select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"))
    tops = big.groupBy("digest").agg(F.max_by(F.struct("page_id", "url"), "page_id").alias("top"), F.count("*").alias("n"))
    tops = tops.where("n > 1 and top is not null").select("digest", F.col("top.page_id").alias("response_id"), F.col("top.url").alias("response_url"))
    again = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("digest", F.when(size >= least, F.sha1(F.col("html").cast("binary"))).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.xxhash64("url", "html")).cast("string"))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    return keyed.join(again, ["digest", "salt"], "left").select("page_id", "url", "html", "response_id", "response_url")


def write_archives(rows: DataFrame, folder: str, roll: int = 24 << 20) -> list[str]:
    """Converts every row's legacy capture and writes the WARC records; the archives' paths. An archive is closed when
    it has ``roll`` bytes; a task writes under its attempt's name, and only what ended well is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        made: list[str] = []
        out = io.BytesIO()

        def flush() -> None:
            nonlocal out
            if out.tell():
                name = f"part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz"
                with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(out.getbuffer())
                made.append(f"{folder}/{name}")
                out = io.BytesIO()

        for number, batch in enumerate(slices(batches, "html")):
            version = 1 + (task.partitionId() + number) % 2
            arc = io.BytesIO()
            arc.write(arc_version_block(f"{task.partitionId()}-{number}.arc", DATE, version))
            responses = []
            for page, url, html, response, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response_id", "response_url")), strict=True):
                arc.write(page_arc(page, url, html.encode(), version))
                responses.append(None if response is None or response == page else {"WARC-Refers-To-Target-URI": re.sub(r"[\x00-\x20\x7f]+", "%20", at or "unknown:") or "unknown:", "WARC-Refers-To-Date": iso_date(DATE), "WARC-Refers-To-Page-Id": str(response)})
            arc.seek(0)
            for i, record in enumerate(read_arc(arc)):
                refers_to = responses[i - 1] if i else None
                out.write(gzip.compress(convert(record, refers_to).to_bytes(), 4, mtime=0))
                if out.tell() >= roll:
                    flush()
        flush()
        yield pa.RecordBatch.from_pylist([{"file": x} for x in made], pa.schema([("file", pa.string())]))

    return sorted(r["file"] for r in rows.mapInArrow(run, "file string").collect())  # a row an archive


def read_archives(spark, files: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page's record, from the archives alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as f:
                    for r in read_warc(f):
                        kind = r.headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, payload = split_http(r.block)
                        page = re.search(rb"X-Page-Id: (-?\d+)\r\n", head)
                        digest = base64.b32decode(r.headers["WARC-Payload-Digest"][5:]).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{r.headers['WARC-Record-ID']}: the payload has another digest")
                        size = int(r.headers["WARC-Payload-Length"]) if kind == "revisit" else len(payload)
                        rows.append((int(page[1]) if page else None, size, digest, kind, int(r.headers["WARC-Refers-To-Page-Id"]) if kind == "revisit" else None))
                if rows:
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    frame = spark.createDataFrame([(x,) for x in files], "file string").repartition(max(1, len(files)), "file")
    return frame.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read_archives(spark, write_archives(with_responses(pages), scratch(spark)))
