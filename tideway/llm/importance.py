"""Resampling documents towards a target's distribution, by hashed n-grams and the algebra of CRCs.

A feature is a run of 1 to N words, its bucket the CRC-32 of its bytes modulo
BUCKETS. No feature's string is ever built: each word's CRC is taken once, and
the CRC of a run followed by a space and a word is

    crc(run + " " + word) = M^len(word) (M crc(run) ^ crc(" ")) ^ crc(word)

where M, a 32 x 32 matrix over GF(2), appends a zero byte. M^(2^k) is kept as
four tables of 256 entries, which the rule itself makes, so a shift by any
length is as many lookups as the length has bits set, over whole arrays.

A bucket's gain is the logarithm, in thousandths and rounded down, of its share
of the target over its share of the documents, one added to each count. A
document's weight is the mean gain of its features, rounded down, and Gumbel
noise that only its doc_id decides turns the highest weights into a draw
without replacement.

At scale: counts leave a task as one row for each bucket at most; BUCKETS gains
go to the tasks; texts are read twice and never shuffled. Ranks come from one
sort of (doc_id, score), each range of it numbered in its own task.

Edge cases: null and empty texts, and texts without a word, have no feature and
weight 0; a text is taken whole, however long; an empty target counts nothing,
so rare buckets gain; repeated rows each have a rank of their own, and ties go
to the smaller doc_id, null last; a null doc_id draws its noise as the empty
text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, binary, cut, indexed, small_batches

BUCKETS, ORDER, SEED = 10_000, 2, 7
#: Percent of the long enough documents that are drawn, and the words that are enough.
PERCENT, LEAST_WORDS = 25, 20
#: The generator polynomial of CRC-32, its bits reversed (a fixed value).
POLYNOMIAL = 0xEDB88320
#: Words a worker remembers, and the longest of them.
KEEP, LONGEST = 1_000_000, 64

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII; A-Z are lowered."""
    return text.translate(_FOLD).split()


class Crcs(dict):
    """word -> CRC-32, for words met lately."""

    def __missing__(self, word: bytes) -> int:
        got = zlib.crc32(word)
        if len(word) <= LONGEST:
            if len(self) >= KEEP:
                self.clear()
            self[word] = got
        return got


_CRCS = Crcs()


@lru_cache(maxsize=64)
def shift(k: int) -> np.ndarray:
    """M^(2^k) as four tables: the image of each value of each byte."""
    if k:
        half = shift(k - 1)
        columns = [_apply(half, _apply(half, np.uint32([1 << i])))[0] for i in range(32)]
    else:
        columns = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
            columns.append(np.uint32(c))
    tables = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            tables[place, np.arange(256) >> bit & 1 == 1] ^= columns[8 * place + bit]
    return tables


def _apply(m: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return m[0, crc & 255] ^ m[1, crc >> 8 & 255] ^ m[2, crc >> 16 & 255] ^ m[3, crc >> 24]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times M to its own power."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        out[at] = _apply(shift(k), out[at])
    return out


def codes(texts: Iterable[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRCs of all features of the texts, the number of the text each is from, and the words of each text."""
    listed = [words(t) for t in texts]
    counts = np.array([len(x) for x in listed], np.int64)
    flat = [w for x in listed for w in x]
    crc = np.fromiter(map(_CRCS.__getitem__, flat), np.uint32, len(flat))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(listed)), counts)
    space, one = np.uint32(zlib.crc32(b" ")), shift(0)
    found, of, run = [crc], [owner], crc
    for n in range(1, order):
        if len(flat) <= n:
            break
        run = shifted(_apply(one, run[:-1]) ^ space, size[n:]) ^ crc[n:]
        whole = owner[:-n] == owner[n:]
        found.append(run[whole])
        of.append(owner[:-n][whole])
    return np.concatenate(found), np.concatenate(of), counts


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def _counted(buckets: int, order: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(codes(binary(b.column(0)), order)[0] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield batch(_COUNTS, pa.array(at, pa.int32()), pa.array(total[at]))

    return work


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all texts by bucket. As many rows as there are buckets reach the driver."""
    small_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(_counted(buckets, order), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """What each bucket adds to a document's weight, in thousandths."""
    s, t = (bucket_counts(x, buckets, order) for x in (docs, target))
    most, least = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * most / ((a + 1) * least))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(table: np.ndarray, order: int = ORDER):
    """A function of a text column: n_words, n_features, weight."""

    def work(texts: pd.Series) -> pd.DataFrame:
        crc, owner, n_words = codes([t or b"" for t in texts], order)
        n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner, table[crc % len(table)])
        return pd.DataFrame({"n_words": n_words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    return F.pandas_udf(work, "n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down: uniform by the SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def free_name(docs: DataFrame) -> str:
    name, taken = "_scored", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """docs with a struct (n_words, n_features, weight, score) in a column named by free_name."""
    small_batches(docs.sparkSession)
    name, w = free_name(docs), weigh(gains(docs, target, buckets, order), order)(F.col("text").cast("binary"))
    return docs.withColumn(name, w).withColumn(name, F.col(name).withField("score", F.col(f"{name}.weight") + noise(F.col("doc_id"), seed)))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **kinds: int) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document, drawn ones numbered from 1 by score."""
    rows = cut(scored(docs.select("doc_id", "text"), target, **kinds).select(F.col("doc_id").cast("long").alias("doc_id"), "_scored.*"))
    able, rest = rows.where(F.col("n_words") >= least_words), rows.where(F.col("n_words") < least_words)
    most = percent * able.count() // 100
    placed = indexed(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "at").withColumn("rank", F.when(F.col("at") < most, F.col("at") + 1))
    return placed.unionByName(rest.withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **kinds: int) -> DataFrame:
    """The drawn documents with all their columns. Texts are filtered where they are read; rows that tie with the last one drawn, doc_id included, come with it."""
    last = ranked(docs, target, percent, least_words, **kinds).where("rank is not null").agg(F.max(F.struct("rank", "score", "doc_id")).alias("last")).first()["last"]
    if last is None:
        return docs.where("false")
    name, at = free_name(docs), last["doc_id"]
    s = F.col(f"{name}.score")
    tied = F.col("doc_id").isNotNull() & (F.col("doc_id") <= at) if at is not None else F.lit(True)
    rows = scored(docs, target, **kinds).where((F.col(f"{name}.n_words") >= least_words) & ((s > last["score"]) | (s == last["score"]) & tied))
    return rows.drop(name)
