"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes puts a chunk boundary wherever its top bits are
zero, so boundaries depend on the text around them only: an insertion moves the chunks
after it but does not change them. Chunks are compared by a 128-bit digest over the whole
corpus; neighbouring chunks that also stand elsewhere make up a repeated span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_key, fresh, join_bounded, map_texts, materialise, row_hash
from .features import mix

#: A boundary stands after 1 byte in 2**BITS; chunks are LEAST to MOST bytes.
BITS, LEAST, MOST = 4, 16, 512
#: Shorter repeated spans (code points) are left alone.
SPAN = 120
#: Keys from here on are hashes, not ids.
HASHED = 1 << 62
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the hash h = 2 * h + GEAR[byte] (32 bits), which the last 32 bytes decide.

    Sums over the last 1, 2, 4, ... bytes are doubled from one another instead of rolled.
    """
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h = np.concatenate([h[:width], h[width:] + (h[:-width] << np.uint32(width))])
    return h


def chunk_ends(data: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes, in order; none for an empty text.

    An end inside a character moves behind it, so a chunk has whole characters.
    """
    ends, last = [], 0
    for at in range(0, len(data), 1 << 22):  # long texts in pieces, with what a hash needs from before
        back = min(at, 31)
        h = gear_hashes(data[at - back : at + (1 << 22)])[back:]
        for end in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + (at + 1)).tolist():
            while end - last > most:
                last += most
                ends.append(last)
            if end - last >= least:
                ends.append(end)
                last = end
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    e = np.array(ends, dtype=np.int64)
    for _ in range(3):  # a character has at most three bytes more
        inside = e < len(data)
        inside[inside] = (data[e[inside]] & 0xC0) == 0x80
        e += inside
    return np.unique(e).tolist()


def shared_ids(docs: DataFrame) -> DataFrame | None:
    """Ids (dk) that do not name one row each: null, repeated, or too large for a key; None if there are none."""
    counts = docs.groupBy(doc_key().alias("dk")).count()
    found = materialise(counts.filter((F.col("count") > 1) | (F.col("dk") >= HASHED)).select("dk"))
    return None if found.isEmpty() else found


def with_keys(docs: DataFrame, shared: DataFrame | None, key: str) -> DataFrame:
    """``docs`` with a long ``key``: the id where it names one row, else a hash of id and text, which follows all ids."""
    if shared is None:
        return docs.withColumn(key, doc_key())
    dk, mark = fresh(docs.withColumn(key, F.lit(0)), "_dk", "_shared")
    marked = join_bounded(docs.withColumn(dk, doc_key()), shared.select(F.col("dk").alias(dk), F.lit(True).alias(mark)), [dk], "left")
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(dk), row_hash()), 2).bitwiseOR(F.lit(HASHED))
    return marked.withColumn(key, F.when(F.col(mark), hashed).otherwise(F.col(dk))).drop(dk, mark)


def chunks(keyed: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Rows (key, seq, start, stop, d1, d2): every chunk of every text of ``keyed`` (key, text).

    Its digest is two numbers; places are in code points.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                counts, seqs, starts, stops, digests = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "replace")
                    data = np.frombuffer(raw, dtype=np.uint8)
                    ends = chunk_ends(data, bits, least, most)
                    counts.append(len(ends))
                    if not ends:
                        continue
                    e = np.array(ends)
                    places = np.cumsum((data & 0xC0) != 0x80)[e - 1] if len(raw) != len(text) else e
                    seqs.append(np.arange(len(e)))
                    starts.append(np.concatenate([[0], places[:-1]]))
                    stops.append(places)
                    digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
                keys = pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts), pa.int64())
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([keys, join(seqs, pa.int32()), join(starts, pa.int32()), join(stops, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["key", "seq", "start", "stop", "d1", "d2"])

    return map_texts(keyed, cut, "key long, seq int, start int, stop int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, span: int = SPAN, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Spans of ``docs`` (doc_id, text) that also stand elsewhere, in another document or at another place of their own.

    A chunk is repeated if it stands at several places; its first place is the foremost in
    the document of the smallest id. Maximal runs of repeated chunks of at least ``span``
    code points count. A run is split where the document stops being the first place for
    ``span`` code points or more; shorter first places beside such parts have no row. Returns a row for each part: doc_id, start, length,
    first_doc_id (of the first place of most of its chunks), n_places (of its most frequent
    chunk), kept (whether this is the first place), key.

    A run starts and ends at chunk edges inside the repeated text, so up to a chunk at
    either end is not in it. Documents without such spans have no row. Null and empty texts
    have no chunks. Rows without an id or of one id are documents of their own, which
    follow all others; of them, rows with equal texts are one document, whose spans hold
    for each. An empty table gives an empty result; other columns are ignored.
    """
    shared = shared_ids(docs)
    keyed = with_keys(docs.select("doc_id", F.col("text").cast("string").alias("text")), shared, "key")
    texts = keyed.select("key", "text")
    if shared is not None:
        texts = texts.filter(F.col("key") < HASHED).unionByName(texts.filter(F.col("key") >= HASHED).dropDuplicates(["key"]))
    found = chunks(texts, bits, least, most)
    digests = found.groupBy("d1", "d2").agg(F.min(F.struct("key", "seq")).alias("first"), F.count("*").alias("n"))
    repeated = materialise(digests.filter("n > 1").select("d1", "d2", F.col("first.key").alias("first_key"), F.col("first.seq").alias("first_seq"), "n"))
    kept = (F.col("key") == F.col("first_key")) & (F.col("seq") == F.col("first_seq"))
    hits = found.join(repeated, ["d1", "d2"]).select("key", "seq", "start", "stop", "first_key", "n", kept.alias("kept"))
    extent = lambda *by: F.max("stop").over(W.partitionBy("key", *by)) - F.min("start").over(W.partitionBy("key", *by))
    place = lambda *by: F.col("seq") - F.row_number().over(W.partitionBy("key", *by).orderBy("seq"))
    runs = hits.withColumn("run", place()).withColumn("extent", extent("run")).filter(F.col("extent") >= span)
    parts = runs.withColumn("turn", place("run", "kept")).withColumn("kept", F.col("kept") | (extent("run", "kept", "turn") < span))
    spans = parts.withColumn("turn", place("run", "kept")).groupBy("key", "run", "kept", "turn").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.mode("first_key", True).alias("first_key"), F.max("n").alias("n_places"))
    spans = spans.select("key", "start", (F.col("stop") - F.col("start")).alias("length"), "first_key", "n_places", "kept").filter(~F.col("kept") | (F.col("length") >= span))
    if shared is None:
        return spans.select(_id("key").alias("doc_id"), "start", "length", _id("first_key").alias("first_doc_id"), "n_places", "kept", "key")
    names = materialise(keyed.filter(F.col("key") >= HASHED).groupBy("key").agg(F.max("doc_id").cast("long").alias("name")))
    own = spans.join(names.withColumnRenamed("name", "own_name"), "key", "left")
    both = own.join(names.select(F.col("key").alias("first_key"), F.col("name").alias("first_name")), "first_key", "left")
    return both.select(_id("key", "own_name").alias("doc_id"), "start", "length", _id("first_key", "first_name").alias("first_doc_id"), "n_places", "kept", "key")


def _id(key: str, name: str | None = None) -> Column:
    return F.when(F.col(key) < HASHED, F.col(key)).otherwise(F.col(name) if name else F.lit(None).cast("long"))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with every span of ``spans`` (repeated_spans of the same rows) that is not ``kept`` cut out of its text; other columns as they are."""
    key, cuts = fresh(docs, "_key", "_cuts")
    cut = spans.filter("not kept").groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cuts))
    whole = with_keys(docs, shared_ids(docs), key).join(cut, key, "left")
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["start"] + c["length"])), F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length("text"))), lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return whole.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(gaps, ""))).select(*docs.columns)
