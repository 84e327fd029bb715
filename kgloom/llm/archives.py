"""WARC: a converter of legacy ARC archives, a WARC writer and a WARC reader.

`read_arc` parses an archive's version block, learns from it which header line the records have (version 1: URL, IP,
date, type, length; version 2 adds result code, checksum, location, offset and file name), and cuts records by their
declared lengths. `convert` makes the equivalent WARC records: identifiers derived from the content, ISO timestamps from
the 14-digit dates, record types and SHA-1 digests of blocks and payloads. Payloads seen before become `revisit` records
that refer to the first one and keep its HTTP headers, so nothing of the payload is stored twice.

The query turns pages into ARC segments of bounded size, converts each in the worker that holds it, writes one
gzip member a record to WARC files in the cluster's shared folder, and reads the files back with Spark.

Defined results: a null html is the empty payload; a null url is written as 'urn:page'; characters that an ARC header
line can't hold are percent-encoded; of equal payloads of at least `min_bytes` bytes the one with the smallest page_id is
the response; where rows share this page_id, that with the smallest url is, and the others revisit it; rows with null
page_id come last; record identifiers differ even where page_ids don't; other columns of the pages are ignored, whatever
their names; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import documents, join_hot, new_folder, written

# The header fields of each ARC version, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
_SEGMENT = 8 << 20


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's digest


def _line_safe(text: str) -> str:
    """A URL as a header line can hold it: blanks, control and other than ASCII characters are percent-encoded; what is encoded already stays."""
    return re.sub(r"\s|[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text) or "-"


def write_arc(records: list[tuple[str, str, str, bytes]], version: int = 1, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC archive of (url, date, content type, network document) records."""
    block = f"{version} 0 kgloom\n" + "URL IP-address Archive-date Content-type " + ("Archive-length\n" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length\n")

    def head(url: str, when: str, kind: str, length: int, code: str, offset: int) -> bytes:
        more = "" if version == 1 else f" {code} - - {offset} {name}"
        return f"{url} 0.0.0.0 {when} {kind}{more} {length}\n".encode()

    out = bytearray(head(f"filedesc://{name}", date, "text/plain", len(block), "200", 0) + block.encode() + b"\n")
    for url, when, kind, body in records:
        out += head(_line_safe(url), when, kind, len(body), "200", len(out)) + body + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Each record's header fields and `body`; the version block comes first, as such. Broken input raises ValueError."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line without end")
        parts = data[at:end].decode("latin-1").split()
        if version is None:
            if not parts or not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            first = data[end + 1 : data.find(b"\n", end + 1)].split()
            version = int(first[0])
        fields = ARC_FIELDS.get(version)
        if fields is None or len(parts) < len(fields):
            raise ValueError(f"not a header line of version {version}: {parts}")
        # A URL with blanks takes what the other fields leave.
        extra = len(parts) - len(fields)
        row = dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
        n = int(row["length"])
        if end + 1 + n > len(data):
            raise ValueError("record longer than the archive")
        yield row | {"body": data[end + 1 : end + 1 + n], "offset_at": at, "version": version}
        at = end + 1 + n


@dataclass
class Warc:
    """A WARC record."""

    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def bytes(self) -> bytes:
        head = {"WARC-Type": self.kind, **self.headers, "Content-Length": str(len(self.block))}
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + self.block + b"\r\n\r\n"


def _timestamp(date: str) -> str:
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(*parts: bytes) -> str:
    """The same for the same parts, so that a retried task writes the same archive."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'|'.join(parts)).digest()[:16], version=5)}>"


def convert(data: bytes, name=None) -> Iterator[Warc]:
    """An ARC archive's records as WARC. name(payload digest, HTTP headers), called for each record in order, gives its own identifier (None: derived from the content) and that of an earlier record with an equal payload (None: there is none)."""
    for row in read_arc(data):
        when, url = _timestamp(row["date"]), row["url"]
        if url.startswith("filedesc:"):
            info = f"software: kgloom\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {row['version']}\r\n".encode()
            yield Warc("warcinfo", {"WARC-Record-ID": record_id(b"info", data[:256], str(len(data)).encode()), "WARC-Date": when, "WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}, info)
            continue
        body = row["body"]
        cut = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -1
        head, payload = (body[: cut + 4], body[cut + 4 :]) if cut >= 0 else (b"", body)
        sha = digest(payload)
        own, earlier = name(sha, head) if name else (None, None)
        own = own or record_id(url.encode(), when.encode(), str(row["offset_at"]).encode(), head, sha.encode())
        shared = {"WARC-Record-ID": own, "WARC-Date": when, "WARC-Target-URI": url, "WARC-IP-Address": row["ip"], "WARC-Payload-Digest": f"sha1:{sha}"}
        kind = "application/http; msgtype=response" if head else row["type"]
        if earlier is not None and head:
            shared |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": earlier, "WARC-Block-Digest": f"sha1:{digest(head)}", "Content-Type": kind}
            yield Warc("revisit", shared, head)
        else:
            yield Warc("response" if head else "resource", shared | {"WARC-Block-Digest": f"sha1:{digest(body)}", "Content-Type": kind}, body)


def read_warc(data: bytes) -> Iterator[Warc]:
    """The records of a WARC file's bytes, gzipped by record or plain."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("header without end")
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and headers:  # a folded line goes on
                headers[next(reversed(headers))] += " " + line.strip()
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a header line: {line[:40]}")
            headers[key.strip()] = value.strip()
        n = int(headers.pop("Content-Length"))
        if end + 4 + n > len(data):
            raise ValueError("record longer than the file")
        block = data[end + 4 : end + 4 + n]
        yield Warc(headers.pop("WARC-Type"), headers, block)
        at = end + 4 + n + 4


def http_document(page_id: int | None, payload: bytes) -> bytes:
    """A page as the network document that a crawler would have stored."""
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _http(block: bytes) -> dict[str, str]:
    lines = block[: block.index(b"\r\n\r\n")].decode("latin-1").split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if ": " in x)}


def _fetch(folder: str, name: str) -> bytes:
    """A file of the shared folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as file:
        return file.read()


def _store(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the shared folder, whole or not at all; a retried task writes the same bytes again."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, version: int = 1) -> DataFrame:
    """Writes the pages as ARC segments of this version, converts these to WARC files in the folder; gives the files' names and numbers of records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("urn:page")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    keys = written(rows.select("page_id", "sha", F.octet_length("html").alias("n")), "payloads")
    # Only payloads that come more than once; the smallest id is the response.
    same = keys.where(F.col("n") >= min_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "rows")).alias("first")
    twice = same.groupBy("sha").agg(F.sum("rows").alias("times"), first).where("times > 1")
    twice = written(twice.select("sha", "times", F.col("first.page_id").alias("first"), F.col("first.rows").alias("sharing")), "repeated-payloads")
    rows = join_hot(rows, twice, ["sha"], "times", "again")
    leads = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("again.first"))
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "sha", leads.alias("lead"), F.col("again.first").alias("first"), F.coalesce("again.sharing", F.lit(1)).alias("sharing"), F.col("again").isNotNull().alias("again"))
    if twice.where("sharing > 1").take(1):
        # Rows that share the id of a response: one of them is it. Only these rows are ranked.
        tied = rows.where("lead AND sharing > 1").withColumn("lead", F.row_number().over(Window.partitionBy("sha").orderBy("url")) == 1)
        rows = rows.where("NOT (lead AND sharing > 1)").unionByName(tied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Segments of equal bytes differ by partition and number; a retried task gives them the same ones again.
        mark = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            part, size = [], 0
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                part.append(row)
                size += len(row["html"])
                if size >= _SEGMENT:
                    yield segment(part, next(mark))
                    part, size = [], 0
            if part:
                yield segment(part, next(mark))

    def segment(part: list[dict], mark: int) -> pa.RecordBatch:
        documents_ = [http_document(r["page_id"], r["html"]) for r in part]
        arc = write_arc([(r["url"], "20000101000000", "text/html", d) for r, d in zip(part, documents_, strict=True)], version)
        follows, numbers = iter(part), itertools.count()

        def name_of(sha: str, head: bytes) -> tuple[str | None, str | None]:
            row, at = next(follows), next(numbers)
            page = lambda x, more: f"<urn:page:{'' if x is None else x}:{more}>"
            # Only responses of repeated payloads are referred to, one for each; all others are named by their place.
            if row["lead"] and row["again"]:
                return page(row["page_id"], sha), None
            return page(row["page_id"], f"{mark:x}-{at}"), None if row["lead"] else page(row["first"], sha)

        out = bytearray()
        for record in convert(arc, name_of):
            out += gzip.compress(record.bytes(), 1, mtime=0)
        name = f"{mark:016x}-{hashlib.sha256(bytes(out)).hexdigest()[:32]}.warc.gz"
        _store(folder, name, bytes(out))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(part)], pa.int64())], names=["name", "records"])

    return rows.select("page_id", "url", "html", "lead", "first", "again").mapInArrow(run, "name string, records long")


_PAGE = re.compile(r"<urn:page:(-?\d*):\w+>")


def read_back(spark: SparkSession, names: DataFrame, folder: str) -> DataFrame:
    """The named WARC files' records, read by the workers: page_id, payload_bytes, payload_digest, record_type, refers_to. A digest that doesn't fit its payload raises, and so does a file that is missing or has another number of records than was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out: list[list] = [[], [], [], [], []]
                for record in read_warc(_fetch(folder, name)):
                    if record.kind not in ("response", "revisit"):
                        continue
                    http, sha = _http(record.block), record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = record.block[record.block.index(b"\r\n\r\n") + 4 :]
                    if record.kind == "response" and digest(payload) != sha:
                        raise ValueError(f"payload of {record.headers['WARC-Record-ID']} doesn't fit its digest")
                    to = _PAGE.fullmatch(record.headers.get("WARC-Refers-To", ""))
                    row = (int(http["x-page-id"]) if http["x-page-id"] else None, int(http["content-length"]), sha, record.kind, int(to[1]) if to and to[1] else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) != records:
                    raise ValueError(f"{len(out[0])} records read of {records} written")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Only files that a finished task has named are read: what a lost task left isn't.
    parts = names.count() // 4 + 1
    return names.select("name", "records").repartition(parts, "name").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    names = written(write_pages(documents(spark, sf_dir, "pages"), folder), "warc-names")
    return read_back(spark, names, folder)


QUERIES = {"op4_warc": op4_warc}
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(p), {5 * k + 1}, 5))::INT >> {15 - 5 * j}) % 32 + 1, 1)" for k in range(8) for j in range(4))
SQL = {
    "op4_warc": f"""
WITH x AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest FROM x),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM f""",
}
