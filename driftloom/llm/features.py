"""Vectorised text features: hashed words and hashed character n-grams, on numpy arrays of bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Base of the polynomial word hash and the constants of its final mixing (odd 64-bit numbers).
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes that are hashed at once; longer texts are cut at white space.
PIECE = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def byte_table(keep: str | bytes, fold: bool = True, high: bool = False) -> np.ndarray:
    """256 byte values: 0 for bytes between words, A-Z folded to a-z, others as they are."""
    table = np.zeros(256, dtype=np.uint8)
    for b in keep.encode("latin-1") if isinstance(keep, str) else keep:
        table[b] = b
    if fold:
        table[65:91] = np.where(table[65:91] > 0, np.arange(97, 123), 0)
    if high:
        table[128:] = np.arange(128, 256)
    return table


#: Words between ASCII white space (a zero byte counts as 1 so that 0 can mean "between").
SPACED = byte_table(bytes(b for b in range(1, 256) if b not in b" \t\n\v\f\r"))
SPACED[0] = 1
#: Runs of letters: ASCII letters and whatever is not ASCII.
LETTERS = byte_table(bytes([*range(65, 91), *range(97, 123)]), high=True)


def word_hashes(data: bytes, table: np.ndarray = SPACED) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text in order; ``table`` says what words are."""
    if len(data) <= PIECE:
        return _word_hashes(np.frombuffer(data, dtype=np.uint8), table)
    out, at = [], 0
    buffer = np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gaps = np.flatnonzero(table[buffer[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one very long word: up to the next gap
                while end < len(data) and table[buffer[end]] != 0:
                    end += 1
        out.append(_word_hashes(buffer[at:end], table))
        at = end
    return np.concatenate(out)


def exact_word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the bytes of every word between ASCII white space, A-Z in lower case.

    ``word_hashes`` is a polynomial, for which unlike words can be made that agree: enough
    for features, not for links between texts.
    """
    out, at = [np.empty(0, dtype=np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = data[at:end].lower().split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = end
    return np.concatenate(out)


def _word_hashes(buffer: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(buffer)
    if not n:
        return np.empty(0, dtype=np.uint64)
    up, down = _tables(n + 1)
    b = table[buffer]
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = b > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(b.astype(np.uint64) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; fewer words, but some, are one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(BASE) + words[j : len(words) - size + 1 + j])
    return h


def ngram_counts(data: bytes, table: np.ndarray, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams (mapped by ``table``) in ``dims`` (a power of two) slots."""
    shift = np.uint32(32 - (dims.bit_length() - 1))
    counts = np.zeros(dims, dtype=np.float32)
    for at in range(0, max(len(data), 1), PIECE):
        b = table[np.frombuffer(data[at : at + PIECE + max(sizes) - 1], dtype=np.uint8)].astype(np.uint32)
        for n in sizes:
            if len(b) < n:
                continue
            h = np.full(len(b) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j] + np.uint32(1)
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> shift, minlength=dims)
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the TF-IDF vector of unit length (log term frequency)."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = float(np.sqrt((v * v).sum()))
    return at, (v / norm if norm > 0 else v).astype(np.float32)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def document_frequencies(texts: DataFrame, counts_of, dims: int) -> tuple[np.ndarray, int]:
    """Documents with each slot, over every row of ``texts`` (one column ``text``), and their number.

    Each task adds its documents up and sends one row for each slot at most.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts_of(text or "") > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*total[at], n], pa.int64())], names=["slot", "n"])

    found = map_texts(texts.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    df, total = np.zeros(dims, dtype=np.float64), 0
    for slot, n in zip(found["slot"], found["n"], strict=True):
        if slot < 0:
            total = n
        else:
            df[slot] = n
    return df, total


def bounded_sample(rows: DataFrame, most: int, n_rows: int, key: Column) -> DataFrame:
    """About ``most`` of ``n_rows`` rows, and never over twice as many, chosen by a hash of ``key``: the same ones each time."""
    if n_rows <= most:
        return rows
    parts = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(parts)) < int(parts * most / n_rows)).limit(2 * most)
