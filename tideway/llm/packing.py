"""Packing documents into sequences of fixed length by sum-of-squares packing.

Open sequences are counted by their residual gap. A piece goes where the sum
of the squared counts becomes smallest afterwards: into a gap that many open
sequences share, leaving one that few share, or exactly closing one. Pieces
come longest first, so the short ones are there to close what is left.

Only documents longer than a sequence are cut: the pieces have full length but
for the first, which takes the rest, and full pieces are sequences of their
own. Pieces are dealt evenly to groups of about GROUP_ROWS rows, whatever their
ids, packed side by side. A sequence is final when it is FULL, or when its gap
is smaller than every piece in a sequence that is not. Of the others a group
hands on the emptiest, GROUP_ROWS / FAN_IN rows at most, to be packed again
among those of FAN_IN groups, until one group is left. So no task ever has more
than about GROUP_ROWS rows, whatever the sizes, and the open sequences of a few
tasks at a time meet.

Edge cases: a null text is empty and has one id, the end id; repeated rows are
packed each on its own; an empty table gives no rows; other columns, whatever
their names, are not read; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm import tokens
from tideway.llm.common import batch, cut, small_batches

LENGTH = 2048
GROUP_ROWS = 65_536
#: Groups whose leftovers meet in one task, and the share of a sequence above which it is final.
FAN_IN, FULL = 16, 0.995

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % length or length
    return [(0, min(first, n)), *((s, length) for s in range(first, n, length))]


def _pieces(path: str, length: int, end_id: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(path)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(e.encode(text or "") + end, e.dtype).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cuts(len(ids) // 4, length)):
                    for to, x in zip(out, (doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])), strict=True):
                        to.append(x)
            yield batch(_PIECES, *out)

    return work


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document, tokenised."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or tokens.tokenizer_path(), length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, in the order given.

    With N open sequences of gap g, moving one from gap g to g - s changes the
    sum of squares by 2 - 2 N(g) + 2 N(g - s), or 1 - 2 N(g) when it closes;
    a new sequence adds 1 + 2 N(length - s). Equal changes take the smaller gap.
    """
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(length + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    made, far = 0, np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s >= length:
            seq[i], off[i], made = made, 0, made + 1
            continue
        here = count[s:]
        change = np.where(here > 0, 2 - 2 * here + 2 * count[: length + 1 - s], far)
        if here[0]:
            change[0] = 1 - 2 * here[0]
        k = int(change.argmin())
        if change[k] == far or change[k] > 1 + 2 * count[length - s]:
            b, g, made = made, length, made + 1
        else:
            g = k + s
            b = open_at[g].pop()
            count[g] -= 1
        seq[i], off[i] = b, length - g
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return seq, off


def final(seq: np.ndarray, sizes: np.ndarray, length: int, most: int) -> np.ndarray:
    """Which sequences stay as they are: all but the emptiest that may still gain, with ``most`` pieces in all."""
    fill, pieces = np.bincount(seq, sizes), np.bincount(seq)
    done = fill >= FULL * length
    least = np.full(len(fill), length)
    np.minimum.at(least, seq, sizes)
    if not done.all():
        done |= length - fill < least[~done].min()
    order = np.argsort(fill, kind="stable")
    order = order[~done[order]]
    done[order[np.cumsum(pieces[order]) > most]] = True
    return done


_PACKED = pa.schema([*_PIECES, ("grp", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
_PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, open boolean"


def _packed(length: int, level: int, last: bool):
    def work(rows: pa.Table) -> pa.Table:
        n, crc = rows["length"].to_numpy(), rows["ids_crc32"].to_numpy()
        rows = rows.take(pa.array(np.lexsort((crc, -n))))
        n = rows["length"].to_numpy()
        seq, off = sum_of_squares(n, length)
        done = np.ones(len(n), bool) if last else final(seq, n, length, GROUP_ROWS // FAN_IN)[seq]
        group = rows["grp"][0].as_py()
        columns = [rows[f] for f in _PIECES.names] + [np.full(len(n), group // FAN_IN), (np.int64(level) << 58) + (np.int64(group) << 26) + seq, off, ~done]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], schema=_PACKED)

    return work


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    columns = _PIECES.names
    parts = cut(parts.select(*columns))
    groups = max(1, -(-parts.count() // GROUP_ROWS))
    # The rows are stored, so their numbers are the same whenever a task runs again.
    rows = parts.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    done, level = [], 0
    while True:
        last = groups == 1
        rows = cut(rows.select(*columns, "grp").groupBy("grp").applyInArrow(_packed(length, level, last), _PACKED_DDL))
        done.append(rows.where("not open"))
        if last:
            break
        rows, groups, level = rows.where("open"), -(-groups // FAN_IN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*columns, "sequence_id", "offset")


def packed(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
