"""Token ids in binary files: independent zstandard frames with a trailing seek table and a checksum for each frame.

File layout
    frames      zstandard frames, each the ids of consecutive documents (little
                endian, 2 or 4 bytes an id) of about FRAME_IDS ids; a document
                longer than that has its frame(s) to itself only as a run of ids.
    index       a skippable frame (0x184D2A50): 1 byte id width, then a zstandard
                frame of the documents' ids (int64, null is NULL_ID) and token
                counts (int64).
    seek table  a skippable frame (0x184D2A5E) in the published seekable layout:
                for each frame compressed size, size, and the low 32 bits of the
                XXH64 of its content (all uint32), then the frame count (uint32),
                a descriptor byte 0x80 (checksums present) and 0x8F92EAB1.

A reader takes the last bytes, then only the frames that hold the documents it
wants; a frame whose checksum differs raises an error.

Documents are dealt by ranges of doc_id, MOST_RANGES at most, sorted inside, and
a range is one file or, beyond FILE_IDS ids, several; the order of ranges and
files and their token counts give each document's place among all ids. Files
are written under a name of their own attempt, then renamed, so a task that
runs again leaves no half file in the manifest.

Edge cases: a null text is the empty text, whose ids are the end id alone; a
null doc_id comes first; rows with one doc_id are ordered by their ids; a very
long text is encoded whole and spread over frames; an empty table writes no
file; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.llm import tokens
from tideway.llm.common import batch, cut, new_folder, range_bounds, small_batches

FRAME_IDS = 1 << 17
#: Documents that a range is made for, and ids after which a range goes on in a new file.
RANGE_ROWS, FILE_IDS = 4_096, 1 << 25
NULL_ID = -(1 << 63)
INDEX, SEEK, END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 1


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes documents' ids in the order given. Holds one frame at a time."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.z = sink, width, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held, self.size, self.table, self.docs, self.counts = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // self.width)
        step = FRAME_IDS * self.width
        for i in range(0, len(ids), step):
            self.held.append(part := ids[i : i + step])
            self.size += len(part)
            if self.size >= step:
                self.flush()

    def flush(self) -> None:
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            packed = self.z.compress(raw)
            self.sink.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> int:
        self.flush()
        index = bytes([self.width]) + self.z.compress(np.array([self.docs, self.counts], "<i8").tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, END)
        self.sink.write(struct.pack("<II", INDEX, len(index)) + index + struct.pack("<II", SEEK, len(table)) + table)
        return sum(self.counts)


class Reader:
    """Reads single documents, or all, of one file."""

    def __init__(self, source):
        import zstandard

        self.source, self.z = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, end = struct.unpack("<IBI", source.read_at(9, size - 9))
        if end != END or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        raw = source.read_at(12 * n, size - 9 - 12 * n)
        self.frames = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        head = int(self.at[-1])
        magic, length = struct.unpack("<II", source.read_at(8, head))
        if magic != INDEX:
            raise ValueError("no document index before the seek table")
        index = source.read_at(length, head + 8)
        self.width = index[0]
        self.docs, self.counts = np.frombuffer(self.z.decompress(index[1:]), "<i8").reshape(2, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            raw = self.z.decompress(self.source.read_at(int(self.frames[k, 0]), int(self.at[k])))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only the frames that hold it are read."""
        a, b = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        out, k = [], int(np.searchsorted(self.first, a, "right")) - 1
        while a < b:
            part = self.frame(k)[a - int(self.first[k]) : b - int(self.first[k])]
            out.append(part)
            a, k = a + len(part), k + 1
        return np.frombuffer(b"".join(out), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        i = int(np.searchsorted(self.docs, doc_id))
        return self.ids(i) if i < len(self.docs) and self.docs[i] == doc_id else None


_CODED = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_MANIFEST = pa.schema([("bucket", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _encode(path: str, bounds: list[int], end_id: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, edges = tokens.encoder(path), np.array(bounds, np.int64)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            ids = [e.encode(t or "") + end for t in b.column(1).to_pylist()]
            at = [0 if d is None else int(np.searchsorted(edges, d, "right")) for d in b.column(0).to_pylist()]
            yield batch(_CODED, at, b.column(0), ids)

    return work


def _write(folder: str, width: int, file_ids: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        now, nth, size, w, sink, name = None, 0, 0, None, None, ""

        def done():
            n = w.close()
            sink.close()
            final = f"{root}/{now:06d}-{nth:06d}-{uuid.uuid4().hex}.ids"
            fs.move(name, final)
            return batch(_MANIFEST, [now], [nth], [f"{folder}/{final.rsplit('/', 1)[1]}"], [len(w.docs)], [n])

        for b in batches:
            for at, doc, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != now or size >= file_ids * width:
                    if w:
                        yield done()
                    nth, now, size, name = nth + 1 if at == now else 0, at, 0, f"{root}/.{uuid.uuid4().hex}.open"
                    sink = fs.open_output_stream(name)
                    w = Writer(sink, width)
                w.add(doc, ids)
                size += len(ids)
        if w:
            yield done()

    return work


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes docs(doc_id, text) and writes them in ascending doc_id order; the manifest (bucket, nth, path, n_docs, n_tokens), a row a file."""
    small_batches(docs.sparkSession)
    path = path or tokens.tokenizer_path()
    bounds = range_bounds(docs, "doc_id", max(1, docs.count() // RANGE_ROWS))
    width = tokens.encoder(path).dtype.itemsize
    coded = docs.select("doc_id", "text").mapInArrow(_encode(path, bounds, end_id), "bucket int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    return cut(dealt.mapInArrow(_write(folder, width, file_ids), "bucket int, nth int, path string, n_docs long, n_tokens long"))


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, at = _open(uri)
            with fs.open_input_file(at) as f:
                r = Reader(f)
                for i in range(0, len(r.docs), 1024):
                    rows = range(i, min(i + 1024, len(r.docs)))
                    crc = [zlib.crc32(r.ids(k).astype("<u4").tobytes()) for k in rows]
                    docs = [None if d == NULL_ID else d for d in r.docs[i : i + 1024].tolist()]
                    yield batch(_READ, docs, (r.starts[rows.start : rows.stop] + start).tolist(), r.counts[i : i + 1024].tolist(), crc)


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. One row for each range, MOST_RANGES at most, reaches the driver."""
    starts, start = [], 0
    for r in sorted(manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).collect(), key=lambda r: r["bucket"]):
        starts.append((r["bucket"], start, r["files"]))
        start += r["n"]
    offsets = spark.createDataFrame([s[:2] for s in starts], "bucket int, before long")
    earlier = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(offsets), "bucket")
    files = files.select("path", (F.col("before") + F.col("earlier")).alias("start")).repartition(max(1, sum(s[2] for s in starts)))
    return files.mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs to a new shared folder and reads the files back."""
    spark = docs.sparkSession
    return read_back(spark, write(docs, new_folder(spark, "token-files")))
