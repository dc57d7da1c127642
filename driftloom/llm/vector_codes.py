"""Compression of vectors by codes of their parts, on integers, so that every run gives the same codes.

Vectors are cut into equal parts, and each position has a codebook. Equal parts of a
position are one weighted row: Lloyd's rounds and the last assignment go over these
distinct rows, and codes and errors are then joined back to the vectors. A part that many
vectors have (a padded end, a repeated vector) costs one row in the rounds; in the join
such parts are broadcast, as no more than ``HEAVY`` of a position can be that frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import shipped
from .common import join_bounded, materialise

#: Parts of a vector, entries of a codebook, rounds, and units of one (a component x is floor(x * UNITS)).
PARTS, ENTRIES, ROUNDS, UNITS = 16, 64, 2, 256
#: A part is heavy if more than one in HEAVY vectors have it.
HEAVY = 1000
#: Integers are clipped to this size; one that large is from a component over 2**53.
LARGEST = 2**61
#: Differences that one step of an assignment holds at once.
CELLS = 1 << 21


def integers(embedding: Column) -> Column:
    """Components as integers, rounded down; held within LARGEST."""
    bound = F.lit(float(LARGEST))
    return F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * UNITS, bound), -bound)).cast("long"))


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def exact_type(width: int, largest: int) -> type:
    """A number type in which sums of ``width`` squared differences of such integers are exact."""
    most = width * (2 * max(largest, 1)) ** 2
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each of ``rows``, the lowest among equals, and the squared distance."""
    if rows.dtype == np.float64:
        gaps = (rows * rows).sum(1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(1)[None, :]
    else:
        gaps = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(2)
    at = gaps.argmin(1)
    return at, gaps[np.arange(len(rows)), at]


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a column of arrays, all of ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return flat.astype(kind)


def assigned(batches: Iterator[pa.RecordBatch], books: list[list[list[int]]], width: int, kind: type):
    """For every slice of a batch (position, part, ...): the slice, its matrix, codes and distances."""
    own = [np.array(b, dtype=kind).reshape(len(b), width) for b in books]
    step = max(1, CELLS // (ENTRIES * width))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            some = batch.slice(start, step)
            position = some.column(0).to_numpy()
            x = matrix(some.column(1), width, kind)
            codes, gaps = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=kind)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                codes[at], gaps[at] = nearest(x[at], own[p])
            yield some, position, x, codes, gaps


def lloyd(distinct: DataFrame, books: list[list[list[int]]], width: int, kind: type) -> list[list[list[int]]]:
    """Codebooks after one round over ``distinct`` (position, part, weight); an entry without parts stays.

    Tasks add up what their rows give to each entry; only a row for each entry comes back.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for some, position, x, codes, _ in assigned(batches, books, width, kind):
            weights = some.column(2).to_numpy()
            cell = position.astype(np.int64) * ENTRIES + codes
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0]) if len(order) else order
            whole = np.int64 if kind is np.float64 else object
            exact, w = x.astype(whole), weights.astype(whole)
            totals = np.add.reduceat(exact[order] * w[order][:, None], starts, axis=0)
            masses = np.add.reduceat(w[order], starts)
            for c, t, m in zip(cell[order][starts], totals, masses, strict=True):
                key = (int(c) // ENTRIES, int(c) % ENTRIES)
                had = sums.setdefault(key, [0] * (width + 1))
                sums[key] = [a + int(b) for a, b in zip(had, [*t, m], strict=True)]
        rows = [(p, c, i, str(v)) for (p, c), values in sums.items() for i, v in enumerate(values)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["position", "entry", "i", "v"])

    parts = shipped(distinct).mapInArrow(add, "position int, entry int, i int, v string")
    got = parts.groupBy("position", "entry", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # at most PARTS * ENTRIES * (width + 1) rows
    sums = {(r.position, r.entry, r.i): int(r.v) for r in got}
    return [[[sums[p, e, i] // sums[p, e, width] for i in range(width)] if (p, e, width) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def codes_of(distinct: DataFrame, books: list[list[list[int]]], width: int, kind: type) -> DataFrame:
    """``distinct`` with code and gap, the squared distance to its entry (at most the largest long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, _, codes, gaps in assigned(batches, books, width, kind):
            held = np.minimum(gaps, 2**63 - 1) if kind is object else gaps
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(codes, pa.int32()), pa.array(held.astype(np.int64))], names=[*some.schema.names, "code", "gap"])

    return shipped(distinct).mapInArrow(run, StructType(list(distinct.schema.fields)).add("code", "integer").add("gap", "long"))


def joined_back(parts: DataFrame, coded: DataFrame, n: int) -> DataFrame:
    """``parts`` (rid, position, part) with code and gap: heavy parts by a broadcast, the others by a shuffle."""
    heavy = F.col("weight") > n / HEAVY
    frequent = coded.filter(heavy)  # at most HEAVY of each position
    key = F.xxhash64("position", "part")
    of_parts = parts.withColumn("_k", key)
    hot = frequent.select("position", "part", "code", "gap", key.alias("_k"))
    first = of_parts.join(F.broadcast(hot), ["_k", "position", "part"], "left")
    rest = coded.filter(~heavy).select("position", "part", key.alias("_k"), F.col("code").alias("code2"), F.col("gap").alias("gap2"))
    light = first.filter("code is null").drop("code", "gap").join(rest, ["_k", "position", "part"])
    return first.filter("code is not null").select("rid", "position", "code", "gap").unionByName(light.select("rid", "position", F.col("code2").alias("code"), F.col("gap2").alias("gap")))


def compress(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one for each usable row of ``vectors`` (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are left out. A component
    becomes floor(256 x), clipped to 2^61. Vectors shorter than the longest are padded with zeros, as all
    are to a multiple of PARTS. Codebooks start from the ENTRIES smallest ids (null last, equal ids
    by vector); if fewer vectors are there, codebooks have as many entries. Repeated rows
    count each. ``error`` is the sum of squared distances, ``label_error`` its sum over rows
    of the label (nulls together), null where it exceeds a long. No usable rows give no rows.
    """
    embedding = F.col("embedding")
    kept = vectors.filter(usable(embedding)).select(F.col("vec_id").alias("vec_id"), F.col("label").alias("label"), integers(embedding).alias("x"))
    kept = materialise(kept.withColumn("rid", F.monotonically_increasing_id()))
    n, longest, largest = kept.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width = max(1, -(-(longest or 0) // PARTS))
    kind = exact_type(width, largest or 0)
    full = width * PARTS
    padded = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(full) - F.size("x")))) if n else kept
    first = padded.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    books = [[list(r.x[p * width : (p + 1) * width]) for r in first] for p in range(PARTS)]
    narrow = "smallint" if (largest or 0) < 2**15 else "int" if (largest or 0) < 2**31 else "long"  # shuffles carry the narrowest
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice(F.col("x"), p * width + 1, width).cast(f"array<{narrow}>"))
    parts = padded.select("rid", F.posexplode(cut).alias("position", "part"))
    distinct = materialise(parts.groupBy("position", "part").agg(F.count("*").alias("weight")))
    if n:
        for _ in range(ROUNDS):
            books = lloyd(distinct, books, width, kind)
        coded = materialise(codes_of(distinct, books, width, kind))
    else:
        coded = distinct.withColumn("code", F.lit(0)).withColumn("gap", F.lit(0).cast("long"))
    of_row = joined_back(parts, coded, n).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("position", "code", "gap"))).alias("c"))
    code = F.lower(F.array_join(F.transform("c", lambda v: F.lpad(F.hex(v["code"].cast("long")), 2, "0")), ""))
    wide = F.aggregate("c", F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v["gap"].cast("decimal(20,0)")).cast("decimal(38,0)"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    rows = kept.select("rid", "vec_id", "label").join(of_row, "rid").select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")).alias("_l"), code.alias("code"), F.least(wide, most).cast("long").alias("error"))
    rows = materialise(rows)
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    of_label = rows.groupBy("_l").agg(F.when(total <= most, total).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return join_bounded(rows, materialise(of_label), ["_l"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
