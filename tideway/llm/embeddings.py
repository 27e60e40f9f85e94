"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates a vector at random (three rounds of random signs and a fast
Hadamard transform) and takes the nearest of the 2d points +-e_i. A table joins
several of them, the more the more vectors a label has, so that a bucket holds
few vectors that are not alike at any size of the table; each vector goes to
its own bucket and to the PROBES next ones, those whose coordinates fall least
short of the largest. A pair is a candidate where the own bucket of one is
among the buckets of the other, and is verified by its cosine in double
precision.

Equal vectors of a label are one class first, so copies never meet. First only
bucket numbers travel: a bucket that no two classes share, one of them as its
own, is left out, and vectors travel to the others alone. Within a bucket
vectors are compared block by block; a bucket with more than BLOCK_ROWS rows is
dealt to tasks by pairs of blocks, which is the only way its rows are repeated.
A pair that meets in several buckets counts in the first of them only, as both
vectors' bucket lists tell. Tasks hand on, for each class, how many vectors it
links to and one link of a spanning forest, so a dense group costs its members,
not its pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do rows without a label; vectors of other
lengths or labels are never compared; repeated rows are copies of one vector;
an empty table gives no rows; other columns, whatever their names, are not
read; a row without vec_id has no component id unless a linked row has an id,
and is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, components, cut, small_batches
from tideway.llm.simhash import NO_ID, joined

COSINE = 0.93
TABLES, PROBES = 6, 7
#: Hashes of a table: at least, at most (beyond it recall falls below 0.95), and buckets wanted for each entry.
LEAST_HASHES, MOST_HASHES, ROOM = 2, 4, 8
BLOCK_ROWS = 4_096
#: Coordinates of each rotation that probes may take.
NEXT = 4
SEED = 17
#: Bits of a bucket number that tell the code.
CODE_BITS = 34


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x


@lru_cache(maxsize=8)
def signs(width: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(SEED + width).choice([-1.0, 1.0], (hashes, TABLES, 3, width)).swapaxes(0, 1)


def padded(length: int) -> int:
    return 1 << max(2, (length - 1).bit_length())


def hashes_for(rows: int, length: int) -> int:
    """Hashes of a table, so that a label's entries have ROOM buckets each."""
    bits = padded(length).bit_length()  # of 2d points
    wanted = (max(1, rows) * (1 + PROBES) * ROOM - 1).bit_length()
    return max(LEAST_HASHES, min(MOST_HASHES, CODE_BITS // bits, -(-wanted // bits)))


def buckets(x: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, tables, 1 + PROBES) codes; the first is the own bucket."""
    width = padded(x.shape[1])
    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    ways = np.array(list(product(range(NEXT), repeat=hashes)))
    for t in range(TABLES):
        code, lack = [], []
        for k in range(hashes):
            y = wide
            for s in signs(width, hashes)[t, k]:
                y = hadamard(y * s) / np.sqrt(width)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :NEXT]
            top = np.take_along_axis(size, best, 1)
            code.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
            lack.append((top[:, :1] - top) ** 2)
        cost = sum(lack[k][:, ways[:, k]] for k in range(hashes))
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t] = sum(np.take_along_axis(code[k], ways[:, k][order], 1) * (2 * width) ** k for k in range(hashes))
    return out


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of a list column's vectors, in double precision."""
    flat, edge = column.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    lengths = np.diff(edge)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[edge[at][:, None] + np.arange(d)]


_ENTRY = pa.schema([("bucket", pa.int64()), ("cls", pa.int64()), ("own", pa.bool_())])
_CODED = pa.schema([("cls", pa.int64()), ("first", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary())])


def _entries(hashes: int):
    """cls, label, vector -> a row for each bucket of each class."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TABLES * (1 + PROBES)
        for b in batches:
            for at, x in vectors_of(b.column(2)):
                codes, row = buckets(x, hashes), np.repeat(at, n)
                table = np.tile(np.repeat(np.arange(TABLES, dtype=np.int64), 1 + PROBES), len(at))
                label = b.column(1).to_numpy()[row].astype(np.int64)
                bucket = ((label * 1_000_003 + x.shape[1]) << 40) + (table << CODE_BITS) + codes.reshape(-1)
                own = np.tile(np.arange(1 + PROBES) == 0, len(at) * TABLES)
                yield batch(_ENTRY, pa.array(bucket), b.column(0).take(pa.array(row)), pa.array(own))

    return work


def _coded(hashes: int):
    """cls, first, copies, label, vector -> the same with the vector as bytes, and all its codes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, codes = [b""] * b.num_rows, [b""] * b.num_rows
            kind = "<f4" if pa.types.is_float32(b.column(4).type.value_type) else "<f8"
            for at, x in vectors_of(b.column(4)):
                narrow = "<u4" if (2 * padded(x.shape[1])) ** hashes <= 1 << 32 else "<i8"
                for i, v, c in zip(at.tolist(), x.astype(kind), buckets(x, hashes).astype(narrow), strict=True):
                    raw[i], codes[i] = v.tobytes(), c.tobytes()
            yield batch(_CODED, *(b.column(i) for i in range(4)), raw, codes)

    return work


def first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and code of the first bucket in which pairs meet; a and b hold codes (pairs, tables, 1 + PROBES), a's class being the smaller."""
    in_b = (a[:, :, :1] == b).any(2)
    in_a = (b[:, :, :1] == a).any(2)
    table = (in_a | in_b).argmax(1)
    at = np.arange(len(a))
    return table, np.where(in_b[at, table], a[at, table, 0], b[at, table, 0])


def compare(bucket: int, cls: np.ndarray, copies: np.ndarray, label: np.ndarray, own: np.ndarray, side: np.ndarray, x: np.ndarray, codes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of one bucket (or one pair of its blocks): linked vectors that count here, and the place of its root in the forest, for each row."""
    order = np.argsort(cls, kind="stable")
    inverse = np.argsort(order)
    cls, copies, label, own, side, x, codes = (v[order] for v in (cls, copies, label, own, side, x, codes))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    count, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
    here = (np.int64(bucket) >> CODE_BITS) & 63, np.int64(bucket) & ((1 << CODE_BITS) - 1)
    several = (side != side[0]).any()
    for i in range(0, len(cls), 1024):
        near = unit[i : i + 1024] @ unit.T >= cosine
        a, b = np.nonzero(near)
        a += i
        keep = (a < b) & (own[a] | own[b]) & (label[a] == label[b])
        if several:  # rows of one block meet in its pair with itself
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        for j in range(0, len(a), 1 << 17):
            p, q = a[j : j + (1 << 17)], b[j : j + (1 << 17)]
            table, code = first_meeting(codes[p], codes[q])
            mine = (table == here[0]) & (code == here[1])
            p, q = p[mine], q[mine]
            np.add.at(count, p, copies[q])
            np.add.at(count, q, copies[p])
            joined(root, p, q)
    return count[inverse], order[root][inverse]


_PART = pa.schema([("cls", pa.int64()), ("first", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("root_first", pa.int64())])


def _compared(cosine: float, float32: bool):
    """Rows sorted by bucket and pair of blocks (columns 0 to 2), then own, side and the columns of _CODED."""

    def one(t: pa.Table) -> pa.RecordBatch | None:
        own, side, cls, first, copies, label = (t.column(i).to_numpy(zero_copy_only=False) if i == 3 else t.column(i).to_numpy() for i in range(3, 9))
        if len(cls) < 2 or not own.any():
            return None
        raw, packed, out = t.column(9).to_pylist(), t.column(10).to_pylist(), []
        for d in {len(v) for v in raw}:  # lengths that share a bucket number
            at = np.flatnonzero([len(v) == d for v in raw])
            x = np.frombuffer(b"".join(raw[i] for i in at), "<f4" if float32 else "<f8").reshape(len(at), -1).astype(np.float64)
            kind = "<u4" if len(packed[at[0]]) == 4 * TABLES * (1 + PROBES) else "<i8"
            codes = np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(len(at), TABLES, 1 + PROBES).astype(np.int64)
            count, root = compare(t.column(0)[0].as_py(), cls[at], copies[at], label[at], own[at], side[at], x, codes, cosine)
            hit = count > 0
            out.append([v[at][hit] for v in (cls, first)] + [count[hit]] + [v[at][root][hit] for v in (cls, first)])
        return batch(_PART, *(pa.array(np.concatenate(v)) for v in zip(*out, strict=True)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of a bucket that may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            keys = [t.column(i).to_numpy() for i in range(3)]
            edge = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if t.num_rows else np.zeros(0, int)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if j - i > 1 and (got := one(t.slice(i, j - i))) is not None:
                    yield got
            rest = t.slice(int(edge[-1])) if len(edge) else rest
        if rest is not None and (got := one(rest)) is not None:
            yield got

    return work


def links(classes: DataFrame, hashes: int, cosine: float = COSINE) -> DataFrame:
    """cls, first, links, root, root_first for classes(cls, first, copies, label, vector): partial counts and forests, several rows a class."""
    entries = classes.select("cls", "label", "vector").mapInArrow(_entries(hashes), "bucket long, cls long, own boolean")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 AND owners > 0")
    shared = shared.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    live = entries.join(shared, "bucket")
    coded = classes.select("cls", "first", "copies", "label", "vector").mapInArrow(_coded(hashes), "cls long, first long, copies long, label long, vector binary, codes binary")
    rows = live.join(coded, "cls")
    side = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "own", "side", *_CODED.names)
    float32 = classes.schema["vector"].dataType.elementType.simpleString() == "float"
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compared(cosine, float32), "cls long, first long, links long, root long, root_first long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    small_batches(spark, 2 << 20)
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Zero has one sign, so that equal vectors have equal hashes.
    plain = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda v: v + F.lit(0.0).cast(kind))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.when(usable, plain).alias("vector"))
    # A class is known by its label and 96 bits of its vector from here on.
    whole = rows.where("vector is not null").withColumns({"h1": F.xxhash64("vector"), "h2": F.hash("vector")})
    classes = whole.groupBy("label", "h1", "h2").agg(F.count("*").alias("copies"), F.coalesce(F.min("vec_id"), F.lit(NO_ID)).alias("first"), F.any_value("vector").alias("vector"))
    classes = cut(classes).select(F.monotonically_increasing_id().alias("cls"), "*")
    most, length = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).agg(F.max("n"), F.max("d")).first()
    part = cut(links(classes, hashes_for(most or 1, length or 1), cosine))
    counts = part.groupBy("cls").agg(F.sum("links").alias("links"))
    # A node is ordered by its smallest vec_id, so that a component's smallest node names it.
    edges = part.where("cls <> root").select(F.struct("first", "cls").alias("a"), F.struct(F.col("root_first").alias("first"), F.col("root").alias("cls")).alias("b"))
    roots = components(edges).select(F.col("node.cls").alias("cls"), F.col("root.first").alias("root"))
    told = classes.drop("vector").join(roots, "cls", "left").join(counts, "cls", "left")
    told = told.select("label", "h1", "h2", F.nullif(F.coalesce("root", "first"), F.lit(NO_ID)).alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = whole.select("vec_id", "label", "h1", "h2").join(told, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
