"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words is trained from confirmed toxic texts and
unlabelled texts. Unlabelled texts hold toxic ones at the class prior's rate, so the risk
of calling them clean is corrected by what toxic texts add to it, and kept from going
below zero. Documents labelled as clean only serve to estimate the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, with_text_columns
from .features import LETTERS, bounded_sample, word_hashes


def words_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's words (runs of letters, lower case)."""
    return np.unique(word_hashes((text or "").lower().encode("utf-8", "replace"), LETTERS))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def nnpu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss: of toxic texts, and of clean ones before clipping at 0."""
    return prior * float(softplus(-gp).mean()), float(softplus(gu).mean()) - prior * float(softplus(gp).mean())


@dataclass(frozen=True)
class Presence:
    """A 0/1 matrix as the row and column of each one."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.shape[0])

    def transposed_times(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=c[self.rows], minlength=self.shape[1])


def fit_nnpu(xp: Presence, xu: Presence, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, least: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam from zero.

    While the corrected risk of clean texts is under ``-least``, steps go against its
    gradient instead, as the estimator asks for.
    """
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = xp.times(w) + b, xu.times(w) + b
        sp, su = sigmoid(gp), sigmoid(gu)
        clean = nnpu_risk(gp, gu, prior)[1]
        of_clean_p, of_clean_u = -prior * sp / len(gp), su / len(gu)
        if clean < -least:
            cp, cu = -of_clean_p, -of_clean_u
        else:
            cp, cu = of_clean_p + prior * (sp - 1) / len(gp), of_clean_u
        g = np.append(xp.transposed_times(cp) + xu.transposed_times(cu) + l2 * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        if not len(self.vocabulary):
            return float(sigmoid(np.array(self.bias)))
        words = words_of(text)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return float(sigmoid(np.array(self.weights[at[self.vocabulary[at] == words]].sum() + self.bias)))


def train(docs: DataFrame, labels: DataFrame, use: Column, most_positive: int = 3000, most_unlabelled: int = 9000, vocabulary: int = 800) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text) where ``use`` holds, with ``labels`` (doc_id, toxic).

    Bounded samples serve: about ``most_positive`` texts labelled toxic, and about
    ``most_unlabelled`` texts whose labels are not looked at. The ``vocabulary`` words whose
    share differs most between the two are the inputs. Without toxic labels every score is 0.
    """
    known = labels.filter(use & F.col("toxic").isNotNull()).select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic:
        return Model(np.empty(0, np.uint64), np.empty(0), -30.0)
    prior = min(0.95, max(1e-4, n_toxic / n_known))
    texts = docs.filter(use).select("doc_id", "text")
    ids = bounded_sample(known.filter("toxic = 1").select("doc_id"), most_positive, n_toxic, F.col("doc_id"))
    # One text of each toxic id, and rows by their id and text: repeated ids neither enlarge a sample nor empty it.
    toxic = _word_sets(texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    plain = _word_sets(bounded_sample(texts, most_unlabelled, texts.count(), F.xxhash64("doc_id", "text")))
    words, n_p = np.unique(np.concatenate(toxic), return_counts=True)
    frequent = n_p >= max(2, 0.004 * len(toxic))
    words, n_p = words[frequent], n_p[frequent]
    u_words, counts = np.unique(np.concatenate([*plain, words]), return_counts=True)
    n_u = counts[np.searchsorted(u_words, words)] - 1
    share_p, share_u = (n_p + 0.5) / (len(toxic) + 1), (n_u + 0.5) / (len(plain) + 1)
    gain = share_p * np.log(share_p / share_u) + (1 - share_p) * np.log((1 - share_p) / (1 - share_u))
    chosen = np.sort(words[np.argsort(-gain, kind="stable")[:vocabulary]])
    w, b = fit_nnpu(_presence(toxic, chosen), _presence(plain, chosen), prior)
    return Model(chosen, w, b)


def _word_sets(texts: DataFrame) -> list[np.ndarray]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([words_of(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "words"])

    got = map_texts(texts.select("doc_id", "text"), sets, "doc_id long, words binary").toArrow().sort_by("doc_id")
    return [np.frombuffer(x, dtype=np.uint64) for x in got["words"].to_pylist()]


def _presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> Presence:
    """Which of the sorted ``vocabulary`` each set has."""
    words = np.concatenate([*sets, np.empty(0, np.uint64)])
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), dtype=bool)
    return Presence(rows[known], at[known], (len(sets), len(vocabulary)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) with score and predicted (score >= 0.5) appended, other columns as they are.

    Columns that have these names already are replaced. Null text counts as empty and, like any text without known words, gets the score of the
    bias alone. Whole texts count, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        s = np.array([sent.value.score(t) for t in texts], dtype=np.float64)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return with_text_columns(docs, run, {"score": "double", "predicted": "integer"})
