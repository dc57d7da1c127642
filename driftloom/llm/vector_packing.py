"""Packing documents into sequences by vector best fit.

A document is its token ids and an end token. Documents above the sequence length are cut
from the end into full pieces, so that only the first piece may be shorter. Pieces are
dealt by hash to groups of about GROUP_DOCS documents; each group packs its pieces, longest
first, and every piece goes to the open sequence that fits best under three capacities:
tokens, documents and attention cost (the sum of squared lengths). Sequences that stay
emptier than most are packed again across groups.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import map_texts, materialise

GROUP_DOCS = 10_000
END = 2
#: Sequences filled less than this are packed again together with those of other groups.
FULL = 0.97
PACKED = "doc_id, piece, start, length, ids_crc32, slot, sequence_id, offset, open"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder for a byte-level BPE vocabulary file, whose ids are merge ranks.

    The file spells each byte as a printable character: those that are printable stand for
    themselves, the others take the code points from 256 on in order. The file's added
    tokens, wherever they stand in a text, are their ids.
    """
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    added = model.get("added_tokens", [])
    unusual = [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if unusual or model.get("normalizer"):
        raise ValueError(f"{path} has a normalizer or added tokens with conditions ({unusual}), which this encoder does not know")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    # The pattern of byte-level BPE: contractions, words, numbers, other signs, white space.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: White space runs from this length on are cut out before the pattern sees them.
LONG_RUN = 10_000
# The white space of the pattern.
BLANK = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and END. Very long white space, on which the pattern would exhaust its stack, is one word by the pattern's own rule.

    That is all of a run at the end of the text or before an added token, else all but its
    last character, which belongs to what follows.
    """
    code, text = encoder(path), text or ""
    ids, at = [], 0
    for m in LONG_BLANK.finditer(text):
        end = m.end()
        if end < len(text) and not any(text.startswith(t, end) for t in code.special_tokens_set):
            end -= 1
        ids += code.encode(text[at : m.start()], allowed_special="all")
        ids += code._encode_single_piece(text[m.start() : end])
        at = end
    ids += code.encode(text[at:], allowed_special="all")
    ids.append(END)
    return np.array(ids, dtype="<u4")


def pieces(docs: DataFrame, vocabulary: str, length: int = 1024) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, slot): the pieces of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, vocabulary)
                edges = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), slot))
                    slot += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, slot long")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset for each piece, given longest first.

    Each piece takes one document and its squared length of a bin's (tokens, documents,
    attention cost). Of the bins where it fits under every capacity it goes to the one with
    the smallest weighted residual norm afterwards ("norm") or the largest weighted dot
    product of need and residual, full bins preferred on ties ("dot"). Ties: the oldest bin.
    """
    caps = np.array(capacity, dtype=np.float64)
    w = np.array(weights, dtype=np.float64)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rest, ids, used, opened = np.empty((max(n, 1), 3)), np.empty(max(n, 1), dtype=np.int64), 0, 0
    least = lengths.min() if n else 0
    for i, size in enumerate(lengths):
        need = np.array([size, 1.0, float(size) * float(size)])
        here = rest[:used]
        fits = np.flatnonzero((here >= need).all(axis=1)) if used else ()
        if len(fits):
            if rule == "dot":
                score = -(here[fits] / caps * (need / caps) * w).sum(axis=1)
            else:
                score = (((here[fits] - need) / caps) ** 2 * w).sum(axis=1)
            b = fits[int(np.argmin(score))]
        else:
            b, ids[used] = used, opened
            rest[used] = caps
            used, opened = used + 1, opened + 1
        bins[i], offsets[i] = ids[b], caps[0] - rest[b, 0]
        rest[b] -= need
        if rest[b, 0] < least or rest[b, 1] < 1:  # nothing fits any more: keep the open ones together
            used -= 1
            rest[b : used], ids[b : used] = rest[b + 1 : used + 1].copy(), ids[b + 1 : used + 1].copy()
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, most_docs: int = 1024, most_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``length`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    text is empty and is the end token alone. Of the capacities, ``most_docs`` and
    ``most_cost`` (attention cost, the sum of squared lengths; default: length squared)
    never bind at their defaults, as each document has a token and the square of a sum is
    at least the sum of squares: fewest sequences are asked for. Smaller ones bind, and then
    cost sequences; ``most_cost`` is raised to a piece's own cost where that is above it.

    Every group packs its pieces, then the sequences that were left emptier than FULL are
    opened again and their pieces packed once more, many groups together. Repeated rows
    are packed each for themselves; which of them gets which place depends on how the
    input is split. An empty table gives an empty result; other columns are ignored.
    """
    cost = length * length if most_cost is None else most_cost
    groups = max(1, round(docs.count() / GROUP_DOCS))
    cut = pieces(docs, vocabulary, length).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "slot"), F.lit(groups)).cast("long"))

    def fill(first: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "slot"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
            sizes = rows["length"].to_numpy()
            single = (sizes >= length) | (sizes.astype(np.float64) ** 2 >= cost)  # a sequence each
            bins, offsets = best_fit(sizes[~single], (length, most_docs, cost), weights, rule)
            number, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            number[single] = np.arange(single.sum())
            number[~single], offset[~single] = bins + single.sum(), offsets
            filled = np.bincount(number, weights=sizes)[number]
            return rows.assign(sequence_id=(key[0] + first) * (1 << 40) + number, offset=offset, open=filled < FULL * length)[[*PACKED.split(", ")]]

        return run

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, sequence_id long, offset long, open boolean"
    once = shipped(cut).groupBy("g").applyInPandas(fill(0), schema)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if groups == 1:
        return once.select(*columns)
    once = materialise(once)
    again = once.filter("open").drop("sequence_id", "offset", "open")
    regroups = max(1, round(again.count() / GROUP_DOCS))
    again = again.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "slot"), F.lit(regroups)).cast("long"))
    twice = again.groupBy("g").applyInPandas(fill(groups), schema)
    return once.filter("not open").select(*columns).unionByName(twice.select(*columns))


def fill_rate(packed: DataFrame, length: int = 1024) -> DataFrame:
    """One row: sequences, tokens, and the share of the sequences' places that tokens take."""
    sequences = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return sequences.agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * length)).alias("fill_rate"))
