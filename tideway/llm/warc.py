"""WARC archives: a transaction of records for each page, and their assembly into one nested row for each capture.

Writing. A page is four kinds of fact in three records, each a gzip member: the
``response`` with the payload or, where an equal payload is already stored, a
``revisit`` that refers to it; the ``request``; and ``metadata`` with the
page_id. Request and metadata name the capture's record in WARC-Concurrent-To.
Of equal payloads (SHA-256) the row with the largest page_id is the response;
payloads of fewer than ``least`` bytes are stored each on its own.

Rows are dealt by ranges of (payload hash, page_id downwards), and one marker for
each payload stands before its first row: the row behind a marker is the
response, any other a revisit, also where a payload's rows go on in the next
task. So a payload that a third of the rows share is spread over many tasks, and
nothing but the sort moves a text; rows alike in all columns, if they are very
many, travel as counts. Files have a bounded size and get their final name when
they are whole.

Reading. Records are streamed from their files, plain or gzip, and a response
whose payload has another SHA-1 than its header says raises an error.
``captures`` joins request, response and metadata records of any archive through
the concurrent-to identifiers: in either direction, and through other members
(metadata that names the request), round by round until no record finds its
capture. ``resolved`` joins revisits to what they refer to.

Edge cases: a null html is the empty payload; a null page_id is smaller than any
other and absent from the metadata; a null url is absent from the records, and
characters that no header can hold are percent-encoded in it; repeated rows are
captures each, one of them the response; an empty table writes no file; other
columns are not read. A payload is held whole by the task that handles it,
however long. A record that names no capture stays out of ``captures``; one that
names several belongs to the one with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import BATCH_BYTES, batch, collapsed, cut, new_folder, small_batches
from tideway.llm.token_files import _open

#: Bytes after which a task goes on in a new file, and the compression level.
FILE_BYTES, LEVEL = 256 << 20, 4
#: Capture dates are not in the table; one that the caller names stands for all.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of revisits that the standard defines.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("response", "revisit", "resource")

_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
_RECORDS = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string())]
    + [("digest", pa.string()), ("payload_bytes", pa.int64()), ("http_head", pa.string()), ("payload", pa.binary())]
)
RECORDS = "record_id string, type string, target_uri string, date string, content_type string, concurrent_to array<string>, refers_to string, digest string, payload_bytes long, http_head string, payload binary"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """The bytes of one record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def named(*parts: bytes) -> str:
    """A record id that the parts decide."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(bytes([0]).join(parts)).digest()[:16], version=4)}"


def safe_uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def transaction(capture: str, refers_to: str | None, page_id: int | None, url: str | None, payload: bytes, date: str) -> Iterator[bytes]:
    """The records of one page."""
    uri, digest = safe_uri(url), f"sha1:{sha1(payload)}"
    about = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        yield record("response", capture, about + http, head + payload)
    else:
        yield record("revisit", capture, [*about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), *http], head)
    host, _, path = (uri or "").partition("://")[2].partition("/")
    beside = [*about, ("WARC-Concurrent-To", f"<{capture}>")]
    yield record("request", named(b"request", capture.encode()), [*beside, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    fields = "" if page_id is None else f"page_id: {page_id}\r\n"
    yield record("metadata", named(b"metadata", capture.encode()), [*beside, ("Content-Type", "application/warc-fields")], fields.encode())


class Archive:
    """Writes members to files of bounded size in one folder."""

    def __init__(self, folder: str, part: int, most: int):
        self.folder, self.part, self.most, self.nth, self.sink = folder, part, most, 0, None
        self.fs, self.root = _open(folder)
        self.fs.create_dir(self.root, recursive=True)

    def add(self, members: Iterable[bytes], date: str) -> None:
        if self.sink is None:
            self.name, self.size, self.n = f"{self.root}/.{uuid.uuid4().hex}.open", 0, 0
            self.sink = self.fs.open_output_stream(self.name, compression=None)
            self.put(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        for m in members:
            self.put(m)

    def put(self, member: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = z.compress(member) + z.flush()
        self.sink.write(packed)
        self.size, self.n = self.size + len(packed), self.n + 1

    def close(self) -> pa.RecordBatch:
        self.sink.close()
        final = f"part-{self.part:06d}-{self.nth:06d}-{uuid.uuid4().hex}.warc.gz"
        self.fs.move(self.name, f"{self.root}/{final}")
        self.sink, self.nth = None, self.nth + 1
        return batch(_MANIFEST, [f"{self.folder}/{final}"], [self.n])


def _write(folder: str, run: str, least: int, date: str, most: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, marked = TaskContext.get().partitionId(), 0, None
        files = Archive(folder, part, most)
        for b in batches:
            for key, mark, page_id, url, html, copies in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if mark:
                    marked = key
                    continue
                payload = (html or "").encode()
                for _ in range(copies):
                    nth += 1
                    own, first = named(run.encode(), b"row", str(part).encode(), str(nth).encode()), named(run.encode(), b"payload", key)
                    if len(payload) < least:
                        capture, refers = own, None
                    elif key == marked:
                        capture, refers, marked = first, None, None
                    else:
                        capture, refers = own, first
                    files.add(transaction(capture, refers, page_id, url, payload, date), date)
                    if files.size >= most:
                        yield files.close()
        if files.sink:
            yield files.close()

    return work


def write(pages: DataFrame, folder: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as archives; the manifest (path, n_records), a row a file."""
    small_batches(pages.sparkSession)
    rows = collapsed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    rows = rows.withColumns({"key": F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)), "mark": F.lit(False)})
    marks = rows.groupBy("key").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("top"))
    order = [F.col("key"), F.desc_nulls_last("page_id"), F.col("chunk")]
    marks = marks.selectExpr("key", "top.page_id", "0L AS chunk", "true AS mark")
    dealt = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order, F.desc("mark"), "url")
    return cut(dealt.select("key", "mark", "page_id", "url", "html", "copies").mapInArrow(_write(folder, uuid.uuid4().hex, least, date, file_bytes), "path string, n_records long"))


class Source:
    """The bytes of a plain or gzip archive, in order. Holds one piece and what was asked for."""

    def __init__(self, f, packed: bool, piece: int = 1 << 20):
        self.f, self.piece, self.held, self.at = f, piece, b"", 0
        self.z = zlib.decompressobj(31) if packed else None
        self.started = False

    def more(self) -> bool:
        got = self.f.read(self.piece)
        if not got:
            if self.z and self.started and not self.z.eof:
                raise ValueError("the archive ends within a member")
            return False
        out = [] if self.z else [got]
        while self.z and got:
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.started = True
            out.append(self.z.decompress(got))
            got = self.z.unused_data
        self.held, self.at = self.held[self.at :] + b"".join(out), 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None when nothing is left."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.more():
                if self.at < len(self.held):
                    raise ValueError("the archive ends within a line")
                return None
        got, self.at = self.held[self.at : end], end + 1
        return got.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while True:
            parts.append(self.held[self.at : self.at + need])
            self.at += len(parts[-1])
            need -= len(parts[-1])
            if not need:
                return b"".join(parts)
            if not self.more():
                raise ValueError("the archive ends within a block")


def parsed(source: Source) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record."""
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version")
        headers: dict[str, list[str]] = {}
        last = None
        while line := source.line():
            if line[:1] in b" \t" and last:
                headers[last][-1] += " " + line.strip().decode("utf-8", "replace")
            else:
                k, _, v = line.decode("utf-8", "replace").partition(":")
                last = k.strip().lower()
                headers.setdefault(last, []).append(v.strip())
        yield headers, source.take(int(headers["content-length"][0]))


def fields(headers: dict[str, list[str]], block: bytes) -> tuple:
    """One row of RECORDS."""

    def of(name: str) -> str | None:
        return headers.get(name, [None])[0]

    kind, content = of("warc-type"), of("content-type")
    head, payload = None, block
    if (content or "").startswith("application/http"):
        top, blank, payload = block.partition(b"\r\n\r\n")
        head = (top + blank).decode("utf-8", "replace")
    said = of("warc-payload-digest")
    if kind == "revisit":
        digest, size = said and said.rpartition(":")[2], None
    else:
        digest, size = sha1(payload), len(payload)
        if kind == "response" and said and said.lower().startswith("sha1:") and said[5:] != digest:
            raise ValueError(f"record {of('warc-record-id')} is damaged")
    beside = [x.strip("<>") for x in headers.get("warc-concurrent-to", [])]
    return (of("warc-record-id") or "").strip("<>"), kind, of("warc-target-uri"), of("warc-date"), content, beside, (of("warc-refers-to") or "").strip("<>") or None, digest, size, head, payload


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, at = _open(uri)
            rows, held = [], 0
            with fs.open_input_stream(at, compression=None) as f:
                for headers, block in parsed(Source(f, uri.endswith(".gz"))):
                    rows.append(fields(headers, block))
                    held += len(block) + 500
                    if held >= BATCH_BYTES:
                        yield batch(_RECORDS, *zip(*rows, strict=True))
                        rows, held = [], 0
            if rows:
                yield batch(_RECORDS, *zip(*rows, strict=True))


def read(paths: DataFrame) -> DataFrame:
    """The records of the archives that the column path names. As many tasks as files."""
    spark = paths.sparkSession
    small_batches(spark)
    paths = paths.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(_read, RECORDS)


def links(records: DataFrame) -> DataFrame:
    """(record_id, capture): the capture of each request, metadata or other record that names one, or that one names."""
    ids = records.select("record_id", F.col("type").isin(*CAPTURE).alias("main"), F.explode_outer("concurrent_to").alias("other"))
    ids = cut(ids)
    mains = ids.where("main").select("record_id").distinct()
    pairs = ids.where("not main and other is not null").select("record_id", "other")
    pairs = pairs.unionByName(ids.where("main and other is not null").select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    settled = pairs.join(mains.select(F.col("record_id").alias("other")), "other", "left_semi").groupBy("record_id").agg(F.min("other").alias("capture"))
    settled = settled.join(mains, "record_id", "left_anti")
    done = settled = cut(settled)
    members = ids.where("not main and other is not null").select("record_id", "other")
    both = members.unionByName(members.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    while not (left := both.join(mains, "record_id", "left_anti").join(done, "record_id", "left_anti")).isEmpty():
        near = left.join(settled.select(F.col("record_id").alias("other"), "capture"), "other").groupBy("record_id").agg(F.min("capture").alias("capture"))
        settled = cut(near)
        if settled.isEmpty():
            break
        done = done.unionByName(settled)
    return done


def captures(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource: its columns, ``requests`` and ``metadata``, arrays of structs of the records that belong to it, by id."""
    of = links(records)
    inner = F.struct("record_id", "target_uri", "date", "content_type", "http_head", "payload")
    joined = records.where(~F.col("type").isin(*CAPTURE)).select("record_id", "type", inner.alias("it")).join(of, "record_id")
    lists = [F.sort_array(F.collect_list(F.when(F.col("type") == k, F.col("it")))).alias(a) for k, a in (("request", "requests"), ("metadata", "metadata"))]
    beside = joined.groupBy(F.col("capture").alias("record_id")).agg(*lists)
    none = F.array().cast(joined.select(F.array("it")).schema[0].dataType)
    mains = records.where(F.col("type").isin(*CAPTURE)).drop("concurrent_to").join(beside, "record_id", "left")
    return mains.withColumns({c: F.coalesce(c, none) for c in ("requests", "metadata")})


def page_of(capture: DataFrame) -> DataFrame:
    """captures() with the page_id that the metadata holds."""
    said = F.element_at(F.filter(F.transform("metadata", lambda m: F.regexp_extract(m["payload"].cast("string"), r"(?m)^page_id: (-?\d+)\r?$", 1)), lambda x: x != ""), 1)
    return capture.withColumn("page_id", F.when(F.size("metadata") > 0, said).cast("long"))


def resolved(capture: DataFrame) -> DataFrame:
    """page_of() with, for revisits, refers_to_page and the payload_bytes of the capture that they refer to; digests must agree."""
    to = capture.where("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("payload_bytes").alias("full"), F.col("digest").alias("stored"))
    found = capture.where("type = 'revisit'").join(to, "refers_to", "left")
    agreed = F.when(F.col("stored").isNull() | (F.col("stored") == F.col("digest")), F.col("full")).otherwise(F.raise_error(F.concat(F.lit("digests differ: "), "record_id")))
    found = found.withColumn("payload_bytes", agreed).drop("full", "stored")
    return capture.where("type <> 'revisit'").withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(found)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written to a new shared folder and read back."""
    spark: SparkSession = pages.sparkSession
    records = read(write(pages, new_folder(spark, "warc"), least))
    # What the result does not tell is not stored; of payloads only the metadata's.
    untold = {c: F.lit(None).cast("string") for c in ("target_uri", "date", "content_type", "http_head")}
    bare = cut(records.withColumns(untold | {"payload": F.when(F.col("type") == "metadata", F.col("payload"))}).where("type <> 'warcinfo'"))
    rows = resolved(page_of(captures(bare)))
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
