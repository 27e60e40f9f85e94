"""Hashed words of texts, and the bounded labelled samples that classifiers are fitted on."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, held_out, small_batches

BITS = 20
LETTERS = re.compile(r"[^\W\d_]+")
MEMORY = 300_000


def words(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(LETTERS.findall(text.lower()))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


class Places(dict):
    """Word -> place among the chosen buckets, or -1; remembers the words it met."""

    def __init__(self, chosen: np.ndarray):
        self.place = {int(b): i for i, b in enumerate(chosen)}

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = self.place.get(bucket(word), -1)
        return got


_SAMPLE = pa.schema([("label", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary())])


def _hashed(numbers: Callable[[str, int | None], list[float]] | None):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars = ([t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist())
            packed = [np.unique(np.fromiter(map(bucket, words(t)), np.uint32)).astype("<u4").tobytes() for t in texts]
            yield batch(_SAMPLE, b.column(0), packed, [np.array(numbers(t, n), "<f8").tobytes() if numbers else b"" for t, n in zip(texts, chars, strict=True)])

    return work


def sample_ids(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, label), chosen by a hash of the id: the same on each run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def gathered(docs: DataFrame, ids: DataFrame, numbers: Callable[[str, int | None], list[float]] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Labels, distinct word buckets and numbers(text, n_chars) of the sampled documents, computed where they are read.

    ids(doc_id, label) is bounded by the caller, which is why it may be
    broadcast and why one row for each of its rows may come to the driver. Of
    documents that share an id the least text counts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", stated_length(docs)).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d"))
    rows = rows.select("label", "d.text", "d.n_chars").mapInArrow(_hashed(numbers), "label int, words binary, numbers binary").toArrow()
    label = np.array(rows["label"].to_pylist(), np.int64)
    found = [np.frombuffer(x, "<f8") for x in rows["numbers"].to_pylist()]
    return label, [np.frombuffer(x, "<u4") for x in rows["words"].to_pylist()], np.array(found) if found else np.zeros((0, 0))


def stated_length(docs: DataFrame):
    """The length that a row's metadata states; null where there is none."""
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def training(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label of the rows that may be learnt from; an id with both labels counts by its larger one."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def chosen_buckets(label: np.ndarray, found: list[np.ndarray], most: int | None, least_docs: int = 5, least_z: float = 3.5) -> np.ndarray:
    """Buckets whose share of documents differs between label 1 and label 0 by least_z, a two-proportion z; the clearest ``most`` of them where that is given."""
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    count = [np.bincount(np.concatenate([np.zeros(0, np.uint32), *(x for x, y in zip(found, label, strict=True) if y == k)]), minlength=1 << BITS) for k in (0, 1)]
    p = (count[0] + count[1]) / (n0 + n1)
    z = np.abs(count[1] / n1 - count[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    z[(count[0] + count[1] < least_docs) | (z < least_z)] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 0])


def presence(found: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found), len(chosen)), np.float32)
    for row, x in zip(out, found, strict=True):
        if len(chosen):
            at = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)
            row[at[chosen[at] == x]] = 1
    return out


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
