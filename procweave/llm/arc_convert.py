"""Legacy web archives to WARC.

An ARC file is a version block and records; each record is one header line, whose fields depend on the version, and
as many bytes as that line declares. The converter parses both versions and synthesises the equivalent WARC record:
an identifier derived from the record itself, the timestamp in WARC form, the record type, and digests of block and
payload. Of records with equal payloads one is the response and the others revisit it.

Header lines are read from the right, where the declared length stands, so spaces in a URL or a content type do no
harm. Where no header line can be read, or a declared length does not fit, reading goes on at the next line that is a
header; ``convert`` returns how often that happened beside the number of records, so nothing is lost without a word.

Only slim rows (key, identifier, digest, length) are grouped by digest, so a payload that a third of all records share
costs nothing; the decisions then meet the archives that hold their records, and no payload is shuffled. Archives are written by Spark's text sink, which
commits whole tasks, one archive of bounded size a row, and are read back as binary files. Every WARC record is a gzip
member of its own behind one warcinfo record; the sink names the files .txt, and readers go by content.

Defined results: a null or empty payload has zero bytes and its digest; a null url is written as "unknown:". The response
is the record with the smallest key; records without a key come after all others, in the order of their identifiers (which
follow from archive and place). Repeated rows of the chosen response are responses too. A record cut off inside its
declared length counts as broken. Extra columns are not carried. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm.shared import fresh_path, materialize, read_spread

#: Bytes of records that are packed into one archive; a single larger record makes an archive of its own.
ARCHIVE_BYTES = 8_000_000

#: Header fields by version of the format.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
NAMES = {v: " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}[f] for f in fields) for v, fields in ARC_FIELDS.items()}

#: Header lines by version. The last field is the length; what stands before it may hold spaces in url, mime and location.
HEADERS = {
    "1": re.compile(r"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{4,14})(?: (?P<mime>.*?))? (?P<length>\d+)\s*"),
    "2": re.compile(
        r"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{4,14})(?: (?P<mime>.*?))? (?P<status>\d{3}|-) (?P<checksum>\S+) (?P<location>\S.*?)"
        r" (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)\s*"
    ),
}

#: What a header line looks like, for finding the next one after a broken record.
NEXT_HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^\n]* \S+ \d{14} [^\n]*\d\s*?$", re.M)

KEY_HEADER = b"X-Record-Key"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int = 0

    def http(self) -> tuple[bytes, bytes]:
        """HTTP head (empty if there is none) and payload."""
        if not self.block.startswith(b"HTTP/"):
            return b"", self.block
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return head, payload


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_head(version: str, name: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 procweave\n{NAMES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20000101000000", "mime": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: str, url: str, date: str, mime: str, block: bytes) -> bytes:
    fields = {"url": re.sub(r"\s", "%20", url) or "unknown:", "ip": "0.0.0.0", "date": date, "mime": mime, "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def header_at(data: bytes, at: int, version: str) -> tuple[dict[str, str], int] | None:
    """The fields of the header line at a place and where its block begins; none if it is no header or its block does not fit."""
    end = data.find(b"\n", at)
    found = HEADERS[version].fullmatch(data[at:end].decode("utf-8", "replace")) if end >= 0 else None
    if not found or end + 1 + int(found["length"]) > len(data):
        return None
    return found.groupdict(""), end + 1


def parse_arc(data: bytes) -> Iterator[ArcRecord | None]:
    """The records of an ARC file after its version block; None for every stretch that is no record."""
    at, version = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        found = next((f for v in ([version] if version else ["2", "1"]) if (f := header_at(data, at, v))), None)
        if not found:
            yield None
            ahead = NEXT_HEADER.finditer(data, at + 1)
            at = next((m.start() for m in ahead if any(header_at(data, m.start(), v) for v in ([version] if version else HEADERS))), len(data))
            continue
        fields, start = found
        block = data[start : start + int(fields["length"])]
        if fields["url"].startswith("filedesc:"):
            # The version block's first word says which fields the header lines have.
            told = block.split(b" ", 1)[0].decode("ascii", "replace")
            version = told if told in HEADERS else version
        else:
            yield ArcRecord(fields, block, at)
        at = start + len(block)


def http_block(key: int | None, mime: str, payload: bytes) -> bytes:
    own = KEY_HEADER + b": " + str(key).encode() + b"\r\n" if key is not None else b""
    return b"HTTP/1.1 200 OK\r\nContent-Type: " + mime.encode() + b"\r\n" + own + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload


def to_arc(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as legacy archives, one a row (``archive`` binary); both versions take turns by archive."""
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))

    def write(batches):
        version, held, size = "1", [], 0
        for batch in batches:
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                date, block = f"20{(key or 0) % 100:02d}0101{(key or 0) % 24:02d}0000", http_block(key, "text/html", payload)
                if held and size + len(block) > ARCHIVE_BYTES:
                    yield one_row(arc_head(version, "part.arc") + b"".join(held), "archive")
                    version, held, size = "2" if version == "1" else "1", [], 0
                held.append(arc_record(version, url, date, "text/html", block))
                size += len(block)
        if held:
            yield one_row(arc_head(version, "part.arc") + b"".join(held), "archive")

    return rows.mapInArrow(write, "archive binary")


def one_row(data: bytes, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], [name])


def member(data: bytes) -> bytes:
    """One gzip member."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_files(archives: DataFrame, column: str, path: str) -> None:
    """Write each row's bytes, gzip members, as a file. The sink ends a row with one zero byte, which it is left to add.

    A gzip member ends with its length, low byte first, so an empty member at the end has that zero byte to give.
    """
    value = F.col(column)
    closed = F.when(value.endswith(F.lit(b"\0")), value).otherwise(F.concat(value, F.lit(member(b""))))
    rows = archives.select(F.substring(closed, F.lit(1), F.octet_length(closed) - 1).cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_arc(archives: DataFrame, path: str) -> None:
    """Write archives as gzipped files."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(a.as_buffer()) for a in batch.column(0)], pa.binary())], ["archive"])

    write_files(archives.select("archive").mapInArrow(pack, "archive binary"), "archive", path)


def read_arc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """ARC files under a path, plain or gzipped, as rows of ``name`` and ``archive`` bytes (as they are stored)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("name"), F.col("content").alias("archive"))


def opened(data: bytes) -> io.BufferedIOBase:
    """A stream over an archive, gzipped (in one member or many) or not."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if bytes(memoryview(data)[:2]) == b"\x1f\x8b" else io.BytesIO(data)


def head_value(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else None


def key_of(head: bytes) -> int | None:
    found = head_value(head, KEY_HEADER)
    return int(found) if found and re.fullmatch(rb"-?\d{1,18}", found) else None


SLIM = "name string, key long, record_id string, url string, date string, payload_digest string, payload_bytes long, broken long"


def record_uri(name: str, offset: int, date: str, url: str) -> str:
    """An identifier that follows from the record's archive and place, its time and its URL."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {offset} {date} {url}')}>"


def parsed(name: str, archive: pa.Scalar) -> list[tuple[str | None, ArcRecord | None]]:
    """The records of an archive, each with its identifier."""
    if not archive.is_valid:
        return []
    with opened(archive.as_buffer()) as stream:
        data = stream.read()
    return [(r and record_uri(name, r.offset, r.fields["date"], r.fields["url"]), r) for r in parse_arc(data)]


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def named(archives: DataFrame) -> DataFrame:
    """Archives with a name; those without one are named by their content."""
    given = F.col("name") if "name" in archives.columns else F.lit(None).cast("string")
    return archives.select(F.coalesce(given, F.sha1("archive"), F.lit("")).alias("name"), "archive")


def arc_digests(archives: DataFrame) -> DataFrame:
    """Key, identifier, digest and length of every record of ARC files; one row with broken = 1 for each stretch that is none."""

    def digest(batches):
        for batch in batches:
            for name, archive in zip(batch.column("name").to_pylist(), batch.column("archive"), strict=True):
                rows = []
                for uri, record in parsed(name, archive):
                    if record is None:
                        rows.append((name, None, None, None, None, None, None, 1))
                    else:
                        head, payload = record.http()
                        rows.append((name, key_of(head), uri, record.fields["url"], record.fields["date"], sha1_base32(payload), len(payload), 0))
                yield record_batch(rows, SLIM)

    return named(archives).mapInArrow(digest, SLIM)


def warc_date(date: str) -> str:
    d = re.sub(r"\D", "", date).ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_info() -> bytes:
    """The record that opens a WARC file."""
    block = b"software: procweave\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'procweave warcinfo')}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(record_id: str, record: ArcRecord, refers: dict | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    head, payload = record.http()
    url, date, mime = (record.fields[f] for f in ("url", "date", "mime"))
    key, digest, revisit, plain = key_of(head), sha1_base32(payload), refers is not None, not head
    block = head + b"\r\n\r\n" if revisit and not plain else b"" if revisit else payload if plain else head + b"\r\n\r\n" + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'resource' if plain else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {warc_date(date)}", f"WARC-Target-URI: {url}"]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {refers['record_id']}",
            f"WARC-Refers-To-Target-URI: {refers['url']}",
            f"WARC-Refers-To-Date: {warc_date(refers['date'])}",
            f"X-Payload-Length: {len(payload)}",
        ]
        lines += [f"X-Refers-To-Key: {refers['key']}"] if refers["key"] is not None else []
    lines += [f"{KEY_HEADER.decode()}: {key}"] if key is not None else []
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {mime if plain else 'application/http; msgtype=response'}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> dict[str, int]:
    """Convert ARC files (rows of ``archive`` bytes, gzipped or not, and ``name``) to WARC files under path.

    Of records with equal payloads of at least least_bytes, that with the smallest key is the response. Returns how many
    records there were and how many stretches between them were none (``broken``).
    """
    slim = materialize(arc_digests(archives), "arc-digests")
    counts = slim.agg(F.count("record_id").alias("records"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken")).first().asDict()
    slim = slim.filter("broken = 0")
    own = F.struct(F.col("key").isNull().alias("late"), "key", "record_id", "url", "date")
    first = slim.filter(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("of")).agg(F.min(own).alias("first"))
    same = (F.col("key") == F.col("first.key")) | (F.col("record_id") == F.col("first.record_id"))
    revisits = slim.join(first, F.col("payload_digest") == F.col("of")).filter(~F.coalesce(same, F.lit(False)))
    # Gathered by archive, so no payload is shuffled: archives meet their decisions as they are stored, and packed.
    decided = revisits.groupBy("name").agg(F.collect_set(F.struct("record_id", F.struct("first.*").alias("first"))).alias("decided"))
    joined = named(archives).join(decided, "name", "left").select("name", "archive", "decided")

    def write(batches):
        held, size = [member(warc_info())], 0
        for batch in batches:
            for name, archive, decided in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                refers = {d["record_id"]: d["first"] for d in decided.as_py() or []}
                for uri, found in parsed(name, archive):
                    if found is None:
                        continue
                    record = warc_record(uri, found, refers.get(uri))
                    if size and size + len(record) > ARCHIVE_BYTES:
                        yield one_row(b"".join(held), "warc")
                        held, size = held[:1], 0
                    held.append(member(record))
                    size += len(record)
        if size:
            yield one_row(b"".join(held), "warc")

    write_files(joined.mapInArrow(write, "warc binary"), "warc", path)
    return counts


READ = "key long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_id string, payload binary"


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of every record, gzipped or not; records pass one by one."""
    with opened(data) as stream:
        lines = []
        while line := stream.readline():
            if line.strip():
                lines.append(line)
            elif lines:
                head = b"".join(lines)
                yield head, stream.read(int(head_value(head, b"Content-Length")))
                lines = []


def read_warc(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*") -> DataFrame:
    """Read WARC files back, one row a record but for warcinfo; a response's payload digest is computed anew and must agree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(content.as_buffer()):
                    text = lambda name: (head_value(head, name) or b"").decode()  # noqa: B023, E731
                    kind, digest = text(b"WARC-Type"), text(b"WARC-Payload-Digest").removeprefix("sha1:")
                    if kind == "warcinfo":
                        continue
                    refers, refers_id = text(b"X-Refers-To-Key"), text(b"WARC-Refers-To")
                    payload, length = None, int(text(b"X-Payload-Length") or 0)
                    if kind != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
                        length = len(payload)
                        if sha1_base32(payload) != digest:
                            raise ValueError(f"payload digest of {text(b'WARC-Record-ID')} does not agree")
                    rows.append((key_of(head), text(b"WARC-Target-URI"), text(b"WARC-Record-ID"), kind, digest, length, int(refers) if refers else None, refers_id or None, payload if payloads else None))
                yield record_batch(rows, READ)

    return files.mapInArrow(parse, READ)


def op1_arc_to_warc(spark, sf_dir):
    """Pages as legacy archive files, converted to WARC files and read back."""
    old, new = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(to_arc(read_spread(spark, sf_dir, "pages", "page_id", "url", "html")), old)
    convert(read_arc(spark, old), new)
    return read_warc(spark, new, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes,
         list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (g * 5 + 1)::INT, 5))::INT >> s) & 31) + 1, 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM coded GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded JOIN firsts USING (payload_digest)
"""
