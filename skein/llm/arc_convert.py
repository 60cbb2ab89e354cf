"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and back to rows.

ARC records are found by their header line, whose fields the file's version block
names, and by the length that it declares. A WARC record gets an identifier, a
timestamp, a type and digests made from them. Records whose payload equals that of
another one become revisits of it.

Archives are read with ``binaryFile`` and written with the text sink, one record per
row and the record separator as line separator, so the files go through Spark's output
committer to any file system. A file is parsed as a stream: memory holds its
compressed bytes and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unique_subdir

#: Fixed values of the formats: field names of the two ARC versions, and WARC lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_SEPARATOR, WARC_SEPARATOR = "\n", "\r\n\r\n"
#: Shorter payloads are never replaced by a revisit.
LEAST_REVISIT = 1000
ID_HEADER = b"x-page-id"
EPOCH = datetime(2000, 1, 1)
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- ARC

@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes
    error: str | None = None


def _opened(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 skein\n{ARC_FIELDS[version]}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000",
            "Content-type": "text/plain", "Archive-length": str(len(body)), "Result-code": "200", "Checksum": "-",
            "Location": "-", "Offset": "0", "Filename": name}
    return " ".join(head[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + body


def arc_record(url: str, date: str, mime: str, block: bytes, version: int, name: str, ip: str = "0.0.0.0") -> bytes:
    head = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Archive-length": str(len(block)),
            "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    return " ".join(head[f] for f in ARC_FIELDS[version].split()).encode("utf-8") + b"\n" + block


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of one archive, the version block first. Blank lines between records are
    skipped. A header that does not fit the version's fields, or a block shorter than
    declared, ends the file with a record that has ``error`` set."""
    f = _opened(content)
    names: list[str] | None = None
    offset = 0
    try:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                offset += len(line)
                continue
            parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            want = names or (ARC_FIELDS[2 if len(parts) == 10 else 1].split())
            if len(parts) < len(want) or not parts[-1].isdigit():
                yield ArcRecord(offset, {}, line, "header line does not fit the version")
                return
            # a URL may hold spaces: the other fields are counted from the end
            extra = len(parts) - len(want)
            fields = dict(zip(want, [" ".join(parts[:extra + 1]), *parts[extra + 1:]]))
            n = int(parts[-1])
            block = f.read(n)
            if len(block) < n:
                yield ArcRecord(offset, fields, block, "block shorter than declared")
                return
            if names is None:
                lines = block.decode("utf-8", "replace").split("\n")
                version = int(lines[0].split(" ")[0]) if lines[0][:1].isdigit() else 1
                names = lines[1].split(" ") if len(lines) > 1 and lines[1].startswith("URL ") else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
            yield ArcRecord(offset, fields, block)
            offset += len(line) + n
    except (OSError, EOFError) as e:
        yield ArcRecord(offset, {}, b"", f"unreadable: {type(e).__name__}")


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(headers with their blank line, payload) of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    head, sep, payload = block.partition(b"\r\n\r\n")
    return (head + sep, payload) if sep else (block, b"")


def http_header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("latin-1")
    return None


# ---------------------------------------------------------------- WARC

def record_id(path: str, offset: int) -> str:
    """An identifier of a place: the whole path counts, as folders may repeat file names."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}"


def warc_date(arc_date: str) -> str:
    """ISO time of a 14-digit (or shorter, then completed) ARC date."""
    d = (arc_date if arc_date.isdigit() else "")[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing separator."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8")
    return WARC_VERSION + b"\r\n" + head + b"\r\n" + block


def to_warc(path: str, r: ArcRecord, refers: str | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers`` makes it a revisit of that record."""
    ident = [("WARC-Record-ID", f"<{record_id(path, r.offset)}>")]
    if r.error:
        return warc_record("metadata", [*ident, ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "text/plain")],
                           f"conversion stopped at byte {r.offset}: {r.error}".encode())
    url, mime = r.fields["URL"], r.fields["Content-type"]
    ident.append(("WARC-Date", warc_date(r.fields["Archive-date"])))
    if url.startswith("filedesc://"):
        return warc_record("warcinfo", [*ident, ("WARC-Filename", url[11:]), ("Content-Type", "text/plain")], r.block)
    ident += [("WARC-Target-URI", url), ("WARC-IP-Address", r.fields["IP-address"])]
    parts = http_parts(r.block)
    if parts is None:
        return warc_record("resource", [*ident, ("Content-Type", mime), ("WARC-Payload-Digest", digest(r.block))], r.block)
    fields = [*ident, ("Content-Type", "application/http; msgtype=response"), ("WARC-Identified-Payload-Type", mime),
              ("WARC-Payload-Digest", digest(parts[1]))]
    if refers:
        return warc_record("revisit", [*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers}>")], parts[0])
    return warc_record("response", fields, r.block)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    f = _opened(content)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.partition(b":")
            fields[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
        n = int(fields["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("WARC block shorter than declared")
        yield fields, block


# ---------------------------------------------------------------- jobs

def _emitted(rows: Iterator[tuple], schema: pa.Schema, sizes=lambda r: 64) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_BYTES."""
    out: list[tuple] = []
    size = 0
    for r in rows:
        out.append(r)
        size += sizes(r)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


_RECORD = pa.schema([("record", pa.binary())])


def _write(records: DataFrame, path: str, separator: str) -> str:
    """One archive per partition that has records."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option(
        "compression", "gzip").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder, nested ones too; Spark leaves out names that start with
    an underscore or a dot, as its own marker files do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str) -> str:
    """``pages`` (page_id, url, html) as ARC files, even partitions in version 1, odd
    ones in version 2. The payload is the html in UTF-8 (null: empty); the page_id
    travels in an HTTP header. White space in a URL is escaped, a null URL is "-"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def rows() -> Iterator[tuple]:
            first = True
            for b in batches:
                for i, url, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                    if first:
                        yield (arc_version_block(name, version),)
                        first = False
                    payload = (html or "").encode("utf-8", "replace")
                    ident = "" if i is None else f"X-Page-Id: {i}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(payload)}\r\n\r\n"
                    date = (EPOCH + timedelta(seconds=abs(i or 0) % (3600 * 24 * 3650))).strftime("%Y%m%d%H%M%S")
                    link = "".join(f"%{ord(c):02X}" if c.isspace() and c.isascii() else c for c in url or "") or "-"
                    yield (arc_record(link, date, "text/html", head.encode() + payload, version, name),)

        yield from _emitted(rows(), _RECORD, lambda r: len(r[0]))

    return _write(pages.select("page_id", "url", "html").mapInArrow(run, "record binary"), path, ARC_SEPARATOR)


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("id", pa.string()), ("page_id", pa.int64()),
                    ("size", pa.int64()), ("sha1", pa.binary())])


def _page_id(head: bytes) -> int | None:
    v = http_header(head, ID_HEADER)
    try:
        return int(v) if v is not None else None
    except ValueError:
        return None


def arc_index(files: DataFrame) -> DataFrame:
    """One slim row per archived HTTP response: place, identifier, payload size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for r in parse_arc(content):
                        parts = None if r.error else http_parts(r.block)
                        if parts:
                            yield (path, r.offset, record_id(path, r.offset), _page_id(parts[0]), len(parts[1]),
                                   hashlib.sha1(parts[1]).digest())

        yield from _emitted(rows(), _INDEX, lambda r: 200)

    return files.mapInArrow(run, "path string, offset bigint, id string, page_id bigint, size bigint, sha1 binary")


def revisits(index: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(path, offset, refers): records that equal another one of at least ``least``
    bytes, with the identifier of the one of their group with the largest page id
    (then the last place). Groups are pre-aggregated; their members are joined as slim
    rows, whose skew adaptive execution splits. Records without a page id stay."""
    big = index.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    last = (big.groupBy("sha1", "size").agg(F.max(F.struct("page_id", "path", "offset", "id")).alias("last"), F.count("*").alias("n"))
            .where("n > 1").select("sha1", "size", F.col("last.id").alias("refers")))
    return big.join(last, ["sha1", "size"]).where("id <> refers").select("path", "offset", "refers")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> str:
    """All ARC files under ``arc_path`` as WARC files under ``warc_path``."""
    files = _files(spark, arc_path)
    # the revisits of one file: bounded by its records
    marks = revisits(arc_index(files), least).groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, content, found in zip(*(b.column(c).to_pylist() for c in range(3))):
                    refers = {m["offset"]: m["refers"] for m in found or ()}
                    for r in parse_arc(content):
                        yield (to_warc(path, r, refers.get(r.offset)),)

        yield from _emitted(rows(), _RECORD, lambda r: len(r[0]))

    joined = files.join(marks, "path", "left").select("path", "content", "marks")
    return _write(joined.mapInArrow(run, "record binary"), warc_path, WARC_SEPARATOR)


_READ = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource or revisit record. Sizes and digests of payloads
    are computed from the bytes read; a revisit's digest is the one it states, and its
    size null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for content in b.column(1).to_pylist():
                    for h, block in parse_warc(content):
                        kind = h["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        head, payload = http_parts(block) or (b"", block)
                        if kind == "revisit":
                            size, sha = None, base64.b32decode(h["warc-payload-digest"][5:]).hex()
                        else:
                            size, sha = len(payload), hashlib.sha1(payload).hexdigest()
                        yield (h["warc-record-id"][1:-1], kind, _page_id(head), size, sha, h.get("warc-refers-to", "")[1:-1] or None,
                               h.get("warc-target-uri"), h["warc-date"])

        yield from _emitted(rows(), _READ, lambda r: 300)

    return _files(spark, path).mapInArrow(
        run, "id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_id string, "
             "target_uri string, date string")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page,
    read back from WARC files that were converted from ARC files of ``pages``.

    Null html is an empty payload. Rows with a null page_id are responses. Of rows that
    repeat a page_id and payload all but one are revisits. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, unique_subdir(spark, "arc"))
    back = read_warc(spark, convert(spark, arc, unique_subdir(spark, "warc")))
    first = back.where("record_type <> 'revisit'").select(
        F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_size"))
    return (back.join(first, "refers_id", "left")
            .select("page_id", F.coalesce("payload_bytes", "_size").alias("payload_bytes"), "payload_digest",
                    F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"), "refers_to"))


def oracle(least: int = LEAST_REVISIT) -> str:
    """DuckDB SQL for :func:`round_trip` over the table pages with distinct ids."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {least} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {least} AND page_id < last THEN last END AS refers_to
FROM w
"""
