"""Language identification by nearest centroids of character n-gram vectors.

Texts are unit TF-IDF vectors of hashed byte n-grams. Document frequencies cover every
training document. The centroids, several per language, come from spherical k-means over
a bounded sample of them (``per_language``). A text gets the language of the centroid
with the largest cosine. A text too far from all of them can be rejected: chance raises the
cosine of any text with its number of n-grams, so ``floors`` learns from every training text
how near texts of each size are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, with_text_columns
from .features import LETTERS, document_frequencies, ngram_counts, weigh

DIMS, SIZES = 1 << 13, (1, 2, 3)
UNKNOWN = "und"


def counts_of(text: str) -> np.ndarray:
    return ngram_counts(b" " + text.lower().encode("utf-8", "replace") + b" ", LETTERS, SIZES, DIMS)


@dataclass(frozen=True)
class Centroids:
    languages: list[str]
    vectors: np.ndarray  # centroids by dimensions, unit rows
    idf: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and cosine; UNKNOWN and 0 for null and for texts without letters."""
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, int]:
        """Language, cosine, and size: the doublings of the number of distinct n-grams."""
        if text is None or not any(map(str.isalpha, text)) or not self.languages:
            return UNKNOWN, 0.0, 0
        at, v = weigh(counts_of(text), self.idf)
        cosines = self.vectors[:, at] @ v
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), len(at).bit_length()


@dataclass(frozen=True)
class Floors:
    """The least cosine of a text of each language found and size; a language that is not listed has that of all."""

    of: dict[str, list[float]]
    all: list[float]

    def under(self, lang: str, score: float, size: int) -> bool:
        return score < self.of.get(lang, self.all)[size]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from the rows farthest from each other."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        label = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (label == j).any():
                c[j] = x[label == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, use: Column, per_language: int = 600, centroids: int = 4, most_texts: int = 24_000, most_centroids: int = 1200) -> Centroids:
    """Fit centroids on the rows of ``docs`` (doc_id, text, lang) where ``use`` holds and text and lang are not null.

    Every language is learned. About ``per_language`` texts of each are clustered, fewer
    where all languages together would have more than ``most_texts`` (but a few of each),
    into ``centroids`` groups, fewer where there would be more than ``most_centroids``;
    frequencies are of all texts. Of texts that share an id one at most is clustered. One
    scan samples all languages.
    """
    rows = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, total = document_frequencies(rows, counts_of, DIMS)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    languages = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    if not languages:
        return Centroids([], np.zeros((0, DIMS), np.float32), idf)
    each, parts = max(4, min(per_language, most_texts // len(languages))), 1 << 30
    centroids = max(1, min(centroids, most_centroids // len(languages)))
    shares = docs.sparkSession.createDataFrame([(lang, int(parts * min(1.0, each / n))) for lang, n in languages], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(parts)) < F.col("share")).select("doc_id", "text", "lang")

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [weigh(counts_of(t), idf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["doc_id", "lang", "slots", "values"])

    texts = map_texts(sample, vectors_of, "doc_id long, lang string, slots binary, values binary")
    got = texts.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id").to_pydict()
    names, vectors = [], []
    for lang, _ in languages:
        mine = [i for i, of in enumerate(got["lang"]) if of == lang]
        x = np.zeros((len(mine), DIMS), dtype=np.float32)
        for row, i in enumerate(mine):
            x[row, np.frombuffer(got["slots"][i], dtype="<i4")] = np.frombuffer(got["values"][i], dtype=np.float32)
        if len(x):
            c = spherical_kmeans(x, centroids)
            names += [lang] * len(c)
            vectors.append(c)
    return Centroids(names, np.concatenate(vectors) if vectors else np.zeros((0, DIMS), np.float32), idf)


def floors(docs: DataFrame, model: Centroids, least: float, share: float = 0.5, low: float = 0.01, enough: int = 50) -> Floors:
    """Floors from the cosines of all rows of ``docs`` (text) that are not null.

    A floor is ``share`` of the ``low`` quantile of its language and size. Each text counts
    whole and with a beginning of 4 to 512 code points (by a hash of it), so that short
    sizes are known where short texts are rare. With fewer than ``enough`` texts the floor is
    that of all languages, then of the next smaller size, then ``least``, which no floor is below.
    """
    bins, sizes = 200, (DIMS).bit_length() + 1
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for t in {text, text[: 4 << zlib.crc32(text.encode("utf-8", "replace")) % 8]}:
                    lang, score, size = m.measured(t)
                    if lang != UNKNOWN:
                        at = (lang, size, int(score * (bins - 1)))
                        seen[at] = seen.get(at, 0) + 1
        columns = list(zip(*seen, strict=True)) if seen else [[]] * 3
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, list(seen.values())], types, strict=True)], names=["lang", "size", "bin", "n"])

    texts = docs.filter(F.col("text").isNotNull()).select("text")
    got = map_texts(texts, measure, "lang string, size int, bin int, n long").groupBy("lang", "size", "bin").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    counts: dict[str, np.ndarray] = {}
    for r in got:
        counts.setdefault(r["lang"], np.zeros((sizes, bins), dtype=np.int64))[r["size"], r["bin"]] += r["n"]

    def floor_of(row: np.ndarray, otherwise: float) -> float:
        if row.sum() < enough:
            return otherwise
        return max(least, share * int(np.searchsorted(np.cumsum(row), low * row.sum())) / (bins - 1))

    whole: list[float] = []
    for row in sum(counts.values(), np.zeros((sizes, bins), dtype=np.int64)):
        whole.append(floor_of(row, whole[-1] if whole else least))
    return Floors({lang: [floor_of(row, f) for row, f in zip(n, whole, strict=True)] for lang, n in counts.items()}, whole)


def predict(docs: DataFrame, model: Centroids, reject_below: float | Floors = 0.0, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` (with a column text) with the language and its cosine appended as ``names``, other columns as they are.

    Columns that have these names already are replaced. Null texts, texts without letters,
    and texts whose best cosine is under ``reject_below`` (a number, or floors by language
    and size) are ``und``. Whole texts count, however long.
    """
    under = reject_below.under if isinstance(reject_below, Floors) else lambda lang, score, size: score < reject_below
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list[str | None]) -> list[pa.Array]:
        got = [sent.value.measured(t) for t in texts]
        pred = [UNKNOWN if under(*found) else found[0] for found in got]
        return [pa.array(pred, pa.string()), pa.array([s for _, s, _ in got], pa.float64())]

    return with_text_columns(docs, label, {names[0]: "string", names[1]: "double"})
