"""Quality by a factorisation machine.

Inputs are hashed words, statistics of a text's structure, and the length its
metadata states. Beside a weight for each input, each has a vector of RANK
numbers; a pair of inputs counts by the product of their vectors. The sum over
all pairs is half the sum, over the RANK places, of the square of the sum less
the sum of the squares, so scoring is linear in the inputs.

Fitted in numpy on at most most_labelled rows of each label (a parameter of
``fit``), chosen by a hash of their ids among rows that may be learnt from. The
words are those whose share of documents differs between the labels by least_z
standard errors, all of them unless most_words is given. Words, statistics and
the stated length are taken in the tasks that read the texts, the same way for
fitting and for scoring. Every document is scored whole.

Edge cases: null and empty texts have the statistics of the empty text; a null
length is the text's own; with only one label, or none, each score is the
smoothed share of label 1; repeated rows score alike; an empty table gives no
rows; other columns, whatever their names, are left alone; of labelled documents
that share an id the least text is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, held_out, small_batches
from tideway.llm.features import Adam, Places, chosen_buckets, gathered, presence, sample_ids, sigmoid, stated_length, training, words

MOST_LABELLED = 4_000
LEAST_Z = 5.0
RANK = 8
THRESHOLD = 0.5


def structure(text: str, n_chars: int | None = None) -> list[float]:
    """Statistics of a text's structure."""
    raw = text.encode()
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    n = max(1, len(text))
    tokens = raw.split()
    k = max(1, len(tokens))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.array([len(t) for t in tokens]) if tokens else np.zeros(1)
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    symbols = byte[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]].sum()
    return [
        float(np.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text))), float(np.log1p(len(tokens))), float(np.log1p(len(lines))),
        float(lengths.mean()), float(lengths.std()), float(upper / max(1, upper + lower)), float(byte[48:58].sum() / n), float(symbols / n),
        float((byte[33] + byte[63]) / k), float((byte[46] + byte[44]) / k), float(byte[124] / k), float(len(set(tokens)) / k),
        1 - len(set(lines)) / max(1, len(lines)), float(byte[:9].sum() / n), float(byte[128:].sum() / max(1, len(raw))), float(max(map(len, lines), default=0) / max(1, len(raw))),
        float(sum(t[-1:] in b".!?" for t in lines) / max(1, len(lines))), float(byte[47] / k),
    ]


@dataclass
class Model:
    chosen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weight: np.ndarray  # of words, then statistics
    vectors: np.ndarray

    def scores(self, texts: list[str], lengths: list[int | None]) -> list[float]:
        if not len(self.weight):
            return [float(sigmoid(self.bias))] * len(texts)
        if not hasattr(self, "places"):
            self.places = Places(self.chosen)
            self.square = (self.vectors**2).sum(1)
        k, out = len(self.chosen), []
        for t, n in zip(texts, lengths, strict=True):
            at = np.unique(np.fromiter((p for p in map(self.places.__getitem__, words(t)) if p >= 0), np.int64))
            s = np.clip((np.array(structure(t, n)) - self.mean) / self.scale, -4, 4)
            total = self.vectors[at].sum(0) + s @ self.vectors[k:]
            pairs = 0.5 * (total @ total - self.square[at].sum() - (s * s) @ self.square[k:])
            out.append(self.bias + self.weight[at].sum() + s @ self.weight[k:] + pairs)
        return sigmoid(np.array(out, float)).tolist()


def factorise(x: np.ndarray, y: np.ndarray, balance: np.ndarray, steps: int = 700, rows: int = 512, rate: float = 0.02, decay: float = 2e-3, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors of a factorisation machine with logistic loss; balance weighs the rows."""
    rng = np.random.default_rng(seed)
    b, w, v = np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], RANK))
    adam = Adam([b, w, v], rate)
    for _ in range(steps):
        at = rng.integers(0, len(x), rows)
        z = x[at]
        total = z @ v
        s = b + z @ w + 0.5 * ((total**2).sum(1) - (z**2) @ (v**2).sum(1))
        g = balance[at] * (sigmoid(s) - y[at]) / rows
        gv = (z * g[:, None]).T @ total - v * ((z**2).T @ g)[:, None]
        adam.step([np.array([g.sum()]), z.T @ g + decay * w, gv + decay * v])
    return float(b[0]), w, v


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_words: int | None = None, least_z: float = LEAST_Z) -> Model:
    known = training(labels, "quality")
    ids = sample_ids(known.where("label = 1"), most_labelled).unionByName(sample_ids(known.where("label = 0"), most_labelled))
    label, found, stats = gathered(docs, ids, structure)
    ones, n = int((label == 1).sum()), len(label)
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.ones(0), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, RANK)))
    chosen = chosen_buckets(label, found, most_words, least_z=least_z)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x = np.hstack([presence(found, chosen), np.clip((stats - mean) / scale, -4, 4)])
    balance = np.where(label == 1, n / (2 * ones), n / (2 * (n - ones)))
    return Model(chosen, mean, scale, *factorise(x, label.astype(float), balance))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_SCORED, b.column(0), b.column(1), model.scores([t or "" for t in b.column(2).to_pylist()], b.column(3).to_pylist()))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", stated_length(docs)).mapInArrow(work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
