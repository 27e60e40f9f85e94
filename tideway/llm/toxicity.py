"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is fitted in numpy from confirmed toxic
texts and unlabelled text. With class prior p, the risk of what is not toxic is
the unlabelled risk less p times the positive texts' share of it; where that
estimate falls below zero the step goes against it, so the classifier cannot
profit from fitting the unlabelled texts as all clean.

Fitted on at most most_positive toxic and most_unlabelled other rows (parameters
of ``fit``), chosen by a hash of their ids among rows that may be learnt from;
the class prior is the share of label 1 among the labelled ones. The inputs of
the model are the hashed words whose share of documents differs between the two
samples by least_z standard errors, all of them unless most_words is given.
Every document is then scored whole, in the task that reads it.

Edge cases: null and empty texts score what a text without known words scores;
without any toxic example each score is the prior; repeated rows score alike;
an empty table gives no rows; other columns, whatever their names, are left
alone; of labelled documents that share an id the least text is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, held_out, small_batches
from tideway.llm.features import Adam, Places, chosen_buckets, gathered, presence, sample_ids, sigmoid, training, words

MOST_POSITIVE, MOST_UNLABELLED = 4_000, 8_000
LEAST_Z = 5.0
THRESHOLD = 0.7


@dataclass
class Model:
    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> list[float]:
        if not hasattr(self, "places"):
            self.places = Places(self.chosen)
        at, w = self.places, [*self.weight.tolist(), 0.0]  # place -1 is the weight 0
        return sigmoid(np.array([self.bias + sum([w[k] for k in map(at.__getitem__, words(t))]) for t in texts], float)).tolist()


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier by the non-negative risk estimator. Equal rows are one row with a share."""
    (pos, p_rows), (unl, u_rows) = (np.unique(x, axis=0, return_counts=True) for x in (pos, unl))
    p_share, u_share = p_rows / p_rows.sum(), u_rows / u_rows.sum()
    w, b = np.zeros(pos.shape[1]), np.array([np.log(prior / (1 - prior))])
    adam = Adam([w, b], rate)
    for _ in range(steps):
        zp, zu = pos @ w + b, unl @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = u_share @ np.logaddexp(0, zu) - prior * (p_share @ np.logaddexp(0, zp))
        # By z, the loss of a positive has slope s - 1 and that of a negative s.
        gp, gu = prior * p_share * (sp - 1), np.zeros(len(unl))
        if negative >= 0:
            gp, gu = gp - prior * p_share * sp, u_share * su
        else:
            gp, gu = prior * p_share * sp, -u_share * su
        adam.step([pos.T @ gp + unl.T @ gu + decay * prior * w, np.array([gp.sum() + gu.sum()])])
    return w, float(b[0])


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_words: int | None = None, least_z: float = LEAST_Z) -> Model:
    known = training(labels, "toxic")
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    prior = min(0.95, max(0.001, (ones or 0) / n)) if n else 0.01
    positive = sample_ids(known.where("label = 1"), most_positive)
    others = sample_ids(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct(), most_unlabelled).select("doc_id", F.lit(0).alias("label"))
    label, found, _ = gathered(docs, positive.select("doc_id", "label").unionByName(others))
    if not (label == 1).any() or not (label == 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    chosen = chosen_buckets(label, found, most_words, least_z=least_z)
    x = presence(found, chosen)
    w, b = nnpu(x[label == 1].astype(float), x[label == 0].astype(float), prior)
    return Model(chosen, w, b)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. The model is as large as the words of its bounded samples allow."""
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_SCORED, b.column(0), b.column(1), model.scores([t or "" for t in b.column(2).to_pylist()]))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; all columns stay."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    score = F.pandas_udf(lambda t: t.__class__(model.scores(t.fillna("").tolist())), "double")
    return docs.where(score("text") < threshold)
