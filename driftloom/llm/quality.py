"""Text quality by nearest-neighbour voting in a latent-semantic space.

Texts are unit TF-IDF vectors of hashed words, of hashed n-grams of their spelling shape
(letters of one case, digits and each other sign are one class) and of markers of
repetition. A truncated
singular value decomposition of a bounded sample of labelled texts gives the space; those
texts' vectors are broadcast, every document's cosine with all of them is computed
exactly, block by block, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, with_text_columns
from .features import LETTERS, SPACED, bounded_sample, document_frequencies, ngram_counts, weigh, word_hashes

DIMS, SIZES, BLOCK = 1 << 12, (1, 2, 3), 512
#: The slots after those of shapes count repetition, the last ones words.
REPEATED_WORD, REPEATED_LINE, RARE_WORDS = DIMS, DIMS + 1, DIMS + 2
WORD_BITS = 13
WIDTH = DIMS + 3 + (1 << WORD_BITS)
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


def counts_of(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    out = np.zeros(WIDTH, dtype=np.float32)
    out[:DIMS] = ngram_counts(data, SHAPE, SIZES, DIMS)
    words = word_hashes(data, SPACED)
    if len(words) > 1:
        out[REPEATED_WORD] = (words[1:] == words[:-1]).sum()
        out[RARE_WORDS] = max(0, len(words) // 2 - len(np.unique(words)))
    lines = text.split("\n")
    out[REPEATED_LINE] = len(lines) - len(set(lines))
    letters = word_hashes(data.lower(), LETTERS)
    out[DIMS + 3 :] = np.bincount(letters >> np.uint64(64 - WORD_BITS), minlength=1 << WORD_BITS)
    return out


def truncated_svd(x: np.ndarray, rank: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the ``rank`` largest singular values (columns by rank), by subspace iteration."""
    rank = max(1, min(rank, *x.shape))
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray  # slots by rank
    vectors: np.ndarray  # labelled texts by rank, unit rows
    labels: np.ndarray
    k: int

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), dtype=np.float32)
        for i, t in enumerate(texts):
            at, v = weigh(counts_of(t or ""), self.idf)
            out[i] = v @ self.basis[at]
        return unit(out)

    def vote(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among each text's k nearest labelled texts, weighted by cosine; their mean if none is alike."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        k, out = min(self.k, len(self.labels)), []
        for at in range(0, len(texts), BLOCK):
            cosines = self.project(texts[at : at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0) ** 4
            total = w.sum(axis=1)
            out.append(np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.labels.mean()))
        return np.concatenate(out) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, use: Column, most_labelled: int = 4000, rank: int = 48, k: int = 15) -> Neighbours:
    """Fit on the rows of ``docs`` (doc_id, text) where ``use`` holds and ``labels`` (doc_id, quality) has a label.

    Document frequencies cover all of them; at most about ``most_labelled`` make the space
    and vote, one text of each id. Without labels every score is 0.5.
    """
    known = labels.filter(use & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    n = known.count()
    rows = docs.filter(use).select("doc_id", "text")
    df, total = document_frequencies(rows, counts_of, WIDTH)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    chosen = bounded_sample(known, most_labelled, n, F.col("doc_id"))

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [weigh(counts_of(t or ""), idf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["doc_id", "label", "slots", "values"])

    got = map_texts(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality"), vectors_of, "doc_id long, label int, slots binary, values binary").toArrow().sort_by("doc_id").to_pydict()
    x = np.zeros((len(got["label"]), WIDTH), dtype=np.float32)
    for i, (a, v) in enumerate(zip(got["slots"], got["values"], strict=True)):
        x[i, np.frombuffer(a, dtype="<i4")] = np.frombuffer(v, dtype=np.float32)
    if not len(x):
        return Neighbours(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.empty(0), k)
    basis = truncated_svd(x, rank)
    return Neighbours(idf, basis, unit(x @ basis), np.array(got["label"], dtype=np.float64), k)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``docs`` (with a column text) with score and predicted (score >= 0.5) appended, other columns as they are.

    Columns that have these names already are replaced. Null text counts as empty. Texts alike to no labelled one, empty ones among them, get
    the mean label. Whole texts count, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        s = np.clip(sent.value.vote(texts), 0.0, 1.0).astype(np.float64)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return with_text_columns(docs, run, {"score": "double", "predicted": "integer"})
