"""Legacy archives (ARC) to WARC.

``write_arc`` writes pages as ARC files of either version. ``convert`` reads ARC files by their own rules: the version block
says how many fields a header line has, and each line declares the length of what follows. It then makes the WARC fields
that ARC lacks: a record identifier from the capture itself (so a repeated task makes the same one), the date in ISO form,
the record type, block and payload digests. Of captures with equal payloads of some size the one with the smallest page_id
is a response, the others are revisits that refer to it and carry no payload. Every ARC file becomes one WARC file; both
kinds are gzip files with one member per record, read and written record by record. A capture without an HTTP header (an
ARC file's dns: or ftp: captures) becomes a resource of the content type that its header line names, and is no revisit. Records that cannot be
read are left out, counted and reported.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import warnings
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, open_folder, shared_folder, texts_of, write_file, write_once

# The field names of the header lines of ARC versions 1 and 2.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOT_IN_URL = re.compile(r"[^\x21-\x7e]")


def url_of(text: str | None) -> str:
    """A URL that fits into a header line: what is no printable ASCII is percent-encoded, an empty or null one is '-'."""
    return _NOT_IN_URL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode(errors="replace")), text or "") or "-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_fields(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the payload begins; a block without a header is all payload."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, 0
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


class _Members:
    """Writes each record as a gzip member of its own."""

    def __init__(self, out):
        self.out, self.plain = out, 0  # plain: bytes before compression so far

    def write(self, record: bytes) -> None:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(squeeze.compress(record) + squeeze.flush())
        self.plain += len(record)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 duskwatch\n{ARC_FIELDS[version]}\n".encode()
    rest = ["text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return f"filedesc://{name} 0.0.0.0 {date} {' '.join(rest)} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, block: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"


@dataclass
class Capture:
    ordinal: int
    url: str
    address: str
    date: str
    content_type: str
    result_code: str
    block: bytes

    @property
    def http(self) -> bool:
        return http_fields(self.block)[1] > 0

    @property
    def payload(self) -> bytes:
        return self.block[http_fields(self.block)[1] :]

    @property
    def page_id(self) -> int | None:
        own = http_fields(self.block)[0].get("x-page-id")
        return None if own is None else int(own)


_ADDRESS = re.compile(r"[0-9a-fA-F.:]+\Z")
_DATE = re.compile(r"\d{8,14}\Z")
_STARTS = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:\S.* [0-9a-fA-F.:]+ \d{8,14} .*\d+\r?\n?\Z")


def header_of(line: bytes, fields: list[str]) -> dict[str, str]:
    """A header line by the names of its version's fields.

    Old crawlers left blanks in addresses and content types. Both stand beside fields of a known form: the address ends
    before the first pair of an IP address and a date, and what stands after the content type is counted from the right.
    """
    parts = line.decode("latin-1").rstrip("\r\n").split(" ")
    if len(parts) < len(fields):
        raise ValueError(f"a header line with {len(parts)} fields, not {len(fields)}")
    extra = len(parts) - len(fields)
    at = next((k for k in range(1, extra + 2) if _ADDRESS.match(parts[k]) and _DATE.match(parts[k + 1])), None)
    if at is None or not parts[-1].isdecimal():
        raise ValueError("a header line without an IP address and a date, or without a length")
    tail = len(parts) - (len(fields) - 4)
    return dict(zip(fields, [" ".join(parts[:at]), parts[at], parts[at + 1], " ".join(parts[at + 2 : tail]), *parts[tail:]]))


def read_arc(source, defects: list[str] | None = None) -> Iterator[Capture]:
    """Captures of an open, uncompressed ARC stream, by the fields that its version block names.

    A record with a bad header line or length is an error; with ``defects`` it is added to that list, and reading goes on at
    the next line that has the form of a header line.
    """
    fields: list[str] = []
    ordinal, lost = -1, False
    while line := source.readline():
        if not line.strip() or (lost and not _STARTS.match(line)):
            continue  # records are parted by a line end
        if not fields:  # the version block's own line may have either form; its length is last in both
            size = int(line.split(b" ")[-1])
            body = source.read(size).split(b"\n")
            version = int(body[0].split(b" ")[0])
            fields = body[1].decode().split(" ")
            if fields != ARC_FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown fields of ARC version {version}")
            continue
        try:
            head = header_of(line, fields)
            size = int(head["Archive-length"])
            block = source.read(size)
            if len(block) != size:
                raise ValueError("an ARC record ends before its declared length")
        except ValueError as problem:
            if defects is None:
                raise
            defects.append(str(problem))
            lost = True
            continue
        ordinal, lost = ordinal + 1, False
        yield Capture(ordinal, url_of(head["URL"]), head["IP-address"], head["Archive-date"], head["Content-type"], head.get("Result-code", "-"), block)


def iso_date(date: str) -> str:
    """An ARC date of 14 digits (8 in old files) as WARC writes it."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, ordinal: int, url: str, date: str) -> str:
    """The identifier of a capture: the same for every attempt, and no other capture's."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{ordinal} {date} {url}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an open, uncompressed WARC stream."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not the start of a WARC record")
        fields = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = source.read(int(fields["content-length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
            raise ValueError("a WARC block does not have its digest")
        yield fields, block


@contextmanager
def opened(folder: str, name: str):
    system, path = open_folder(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
        yield plain


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> DataFrame:
    """Write one ARC file for each input partition that has rows, versions 1 and 2 in turn. Returns their names (file)."""
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        version, name = part % 2 + 1, f"part-{part:05d}.arc.gz"

        def content(out) -> None:
            members = _Members(out)
            members.write(arc_version_block(name, version, date))
            for batch in (b for source in ([first], batches) for b in source):
                ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for begin, _, texts in texts_of(batch, 2):
                    for k, html in enumerate(texts, begin):
                        members.write(arc_record(url_of(urls[k]), http_block(ids[k], (html or "").encode(errors="replace")), version, date, name, members.plain))

        yield pa.RecordBatch.from_arrays([pa.array([write_file(folder, name, content)])], names=["file"])

    return write_once(arrow_map(texts, run, "file string"), "arc-files")


CAPTURES = "file string, ordinal int, page_id long, url string, date string, payload_bytes long, digest string, http boolean, defect string"


def captures(files: DataFrame, folder: str) -> DataFrame:
    """What ARC files hold, without the payloads; a record that cannot be read has a row of file and defect alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, defects = [], []
                with opened(folder, file) as source:
                    for c in read_arc(source, defects):
                        rows.append((file, c.ordinal, c.page_id, c.url, c.date, len(c.payload), hashlib.sha256(c.payload).hexdigest(), c.http, None))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                rows += [(file, *[None] * 7, d) for d in defects]
                if rows:
                    yield _batch(rows)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(files.repartition(parts, "file"), run, CAPTURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in CAPTURES.split(", ")])


def convert(files: DataFrame, folder: str, target: str, least: int = 100) -> DataFrame:
    """Write a WARC file for each ARC file of ``files``. Returns their names (file).

    A capture refers to another if both payloads are equal and of at least ``least`` bytes; the smallest page_id (null last,
    then file and place) of equal ones is the response. Only digests and names are shuffled: minima are taken in each task
    first, and the join back by digest may be cut by adaptive execution where one payload is very frequent. A warning gives
    the number of records that cannot be read; ``captures`` lists them.
    """
    found = write_once(captures(files, folder), "captures")
    if lost := found.where("defect is not null").count():
        warnings.warn(f"{lost} ARC records cannot be read and are left out", stacklevel=2)
    found = found.where("defect is null")
    shared = F.col("http") & (F.col("payload_bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "ordinal", "url", "date")
    firsts = found.where(shared).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    plan = found.join(firsts, "digest", "left").select("file", "ordinal", "digest", F.when(shared, F.col("first")).alias("first"))
    revisit = ~((F.col("first.file") == F.col("file")) & (F.col("first.ordinal") == F.col("ordinal")))
    plan = plan.select("file", "ordinal", "digest", *(F.when(revisit, F.col(f"first.{c}")).alias(f"r_{c}") for c in ("file", "ordinal", "url", "date")))
    plan = write_once(plan, "record-types")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            file, name = row[0], row[0].split(".arc")[0].rsplit("-", 1)[0] + ".warc.gz"

            def content(out) -> None:
                nonlocal row
                members = _Members(out)
                about = f"software: duskwatch\r\nformat: WARC File Format 1.1\r\nconverted-from: {file}\r\n".encode()
                members.write(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, -1, "warcinfo", "")), ("WARC-Date", iso_date("20000101")), ("Content-Type", "application/warc-fields")], about))
                with opened(folder, file) as source:
                    for c in read_arc(source, []):
                        if row is None or row[:2] != (file, c.ordinal):
                            raise ValueError(f"{file} has a capture that the list of captures lacks")
                        _, _, digest, r_file, r_ordinal, r_url, r_date = row
                        own = record_id(file, c.ordinal, c.url, c.date)
                        kind = "revisit" if r_file else "response" if c.http else "resource"
                        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", iso_date(c.date)), ("WARC-Target-URI", c.url), ("WARC-IP-Address", c.address)]
                        fields += [("Content-Type", "application/http; msgtype=response" if c.http else c.content_type), ("WARC-Payload-Digest", f"sha256:{digest}")]
                        fields += [(k, v) for k, v in (("ARC-Content-Type", c.content_type), ("ARC-Result-Code", c.result_code)) if v != "-"]
                        block = c.block
                        if r_file:
                            fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r_file, r_ordinal, r_url, r_date)), ("WARC-Refers-To-Target-URI", r_url), ("WARC-Refers-To-Date", iso_date(r_date))]
                            block = block[: http_fields(block)[1]]
                        members.write(warc_record(fields, block))
                        row = next(rows, None)

            yield pa.RecordBatch.from_arrays([pa.array([write_file(target, name, content)])], names=["file"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plan.repartition(parts, "file").sortWithinPartitions("file", "ordinal")
    return write_once(arrow_map(ordered, run, "file string"), "warc-files")


RECORDS = "record_id string, page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def records(files: DataFrame, folder: str) -> DataFrame:
    """The captures in WARC files, one row per response, revisit or resource record.

    Length and digest are those of the whole payload: a response's are counted here and held against its fields, a revisit's
    are read from its fields.
    """
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with opened(folder, file) as source:
                    for fields, block in read_warc(source):
                        if fields["warc-type"] not in ("response", "revisit", "resource"):
                            continue
                        http, start = http_fields(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(http["content-length"]) if "content-length" in http else len(block) - start
                        if fields["warc-type"] != "revisit":
                            counted = hashlib.sha256(block[start:]).hexdigest()
                            if counted != digest or size != len(block) - start:
                                raise ValueError("a payload does not have its digest or length")
                        page = http.get("x-page-id")
                        rows.append((fields["warc-record-id"], None if page is None else int(page), fields["warc-target-uri"], fields["warc-date"], fields["warc-type"], size, digest, fields.get("warc-refers-to")))
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(files.repartition(parts, "file"), run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files hold: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url is '-', a null page_id has no field of its own and is null again. Of repeated
    rows one is the response and the others refer to its page_id. An empty table makes no file; other columns are not
    looked at.
    """
    folder = folder or shared_folder(pages.sparkSession, "archives")
    arcs = write_arc(pages, f"{folder}/arc")
    held = write_once(records(convert(arcs, f"{folder}/arc", f"{folder}/warc"), f"{folder}/warc"), "records")
    first = held.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # Only revisits have a record to look up; the null keys of all others would meet in one task.
    revisits = held.where("record_type = 'revisit'").join(first, "refers_to_id", "left").select(*columns)
    return held.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(revisits)
