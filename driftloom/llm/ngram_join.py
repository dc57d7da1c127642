"""Exact self-join of documents by n-gram Jaccard likeness: grouped prefix join.

Documents with equal shingle sets are one node. Shingles have a global order, rare ones
first; of a set with n shingles only a prefix can matter: two sets that are alike share at
least ``EXTRA`` shingles of their prefixes. Nodes with the same prefix and size make up one
group, groups that share enough prefix shingles and fit in size are candidate pairs, and
these are expanded to their members and verified on the texts.

Large families of near copies are first joined to one pivot each; pairs within a component
that is known already are then left out, as they cannot change it. All other candidate
pairs are verified, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, doc_key, fresh, map_texts, materialise
from .components import components, skewed_join
from .features import exact_word_hashes, shingles

#: Shingles that two alike sets must share in their prefixes (fewer for small sets).
EXTRA = 16
#: Slots in which all shingles are counted for the order, and the bits of a Bloom filter.
SLOT_BITS, BLOOM_BITS = 18, 25
#: Partitions of the input that one task of the first pass counts.
PARTS = 16
#: Row keys up to which texts are found by a Bloom filter of 2**BLOOM_BITS bits; more are joined.
MOST_KEYS = 1 << (BLOOM_BITS - 3)
#: Prefix shingles of so many groups get a pivot first.
FAMILY = 32


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z in lower case); none without words."""
    return np.unique(shingles(exact_word_hashes((text or "").encode("utf-8", "replace")), words))


def row_key() -> Column:
    """One key for each document id and raw text: rows without an id are apart unless their texts are equal."""
    return F.xxhash64(doc_key(), F.col("text").cast("string"), F.col("text").isNull())


def slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of all documents fall into each slot: a rough frequency of every shingle."""
    slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(shingle_set(text, words) >> np.uint64(64 - SLOT_BITS), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    # One row for each slot and task: up to PARTS partitions in a task keep that small beside the input.
    parts = texts.rdd.getNumPartitions()
    few = texts.coalesce(max(4 * texts.sparkSession.sparkContext.defaultParallelism, parts // PARTS))
    got = map_texts(few, count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, dtype=np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def order_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each slot: 0 up to what chance makes of rare shingles, then one more for each doubling."""
    mean = counts.mean()
    chance = 6 * np.sqrt(mean) + 8
    over = np.maximum(counts - mean, 0) / chance
    return np.where(over > 1, np.minimum(15, 1 + np.floor(np.log2(np.maximum(over, 1)))), 0).astype(np.uint64)


def needed(n: Column, percent: int) -> Column:
    """Shingles that any set alike to one of ``n`` shares with it at least."""
    return F.ceil(n * F.lit(percent) / 100).cast("int")


def signatures(docs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, dk, rk, n, d1, d2, gid, prefix): size, digest of the set, and its prefix in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slot = sent.value
        for batch in batches:
            sizes, d1, d2, gids, prefixes = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, words)
                n = len(s)
                alike = -(-n * percent // 100)
                keys = np.sort((of_slot[s >> np.uint64(64 - SLOT_BITS)] << np.uint64(59)) | (s >> np.uint64(5)))
                p = keys[: n - alike + min(EXTRA, alike)]
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(n)
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                gids.append(xxhash.xxh3_64_intdigest(p.tobytes(), seed=n) >> 1)
                prefixes.append(p.astype(np.int64))
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(gids, pa.int64()), prefix], names=["doc_id", "dk", "rk", "n", "d1", "d2", "gid", "prefix"])

    rows = docs.select("doc_id", doc_key().alias("dk"), row_key().alias("rk"), F.col("text").cast("string"))
    return map_texts(rows, sign, "doc_id long, dk long, rk long, n int, d1 long, d2 long, gid long, prefix array<long>")


def fits(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be alike."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def first_shared(percent: int) -> Column:
    """Whether the shingle at at_a and at_b can be the first that alike groups a and b share.

    Places ``at`` and sizes ``p`` leave out shingles that a pair cannot share. All that the
    two must share then stand from this place on in both.
    """
    return F.least(F.col("p_a") - F.col("at_a"), F.col("p_b") - F.col("at_b")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))


def enough_shared(percent: int) -> Column:
    """Whether groups g and h with prefix shingles ``tg`` and ``th`` share as many as an alike pair does.

    Behind the last shingle that the prefixes share, at most the shorter rest can be shared.
    """
    def of(both: Column) -> Column:
        def rest(x: str) -> Column:
            return F.col(f"p{x}") - F.element_at(F.col(f"a{x}"), F.array_position(F.col(f"t{x}"), F.element_at(both, -1)).cast("int"))

        most = F.size(both) + F.least(rest("g"), rest("h")) - 1
        least = F.least(F.lit(EXTRA), needed(F.col("ng"), percent), needed(F.col("nh"), percent))
        return (F.size(both) >= least) & (most * (100 + percent) >= percent * (F.col("ng") + F.col("nh")))

    return F.element_at(F.transform(F.array(F.array_intersect("tg", "th")), of), 1)


def sharable(shared: DataFrame, percent: int) -> DataFrame:
    """``shared`` (token, gid, n, pos) with k, ``p`` and ``at`` in place of pos, for groups that can be in a pair.

    The first EXTRA shingles that an alike pair shares stand in both prefixes. So a prefix
    shingle that no other group has, with fewer than EXTRA before it that another one has,
    is shared in no such pair. ``p`` is the set's size without those, ``at`` the place
    without those. A group goes if it has fewer shingles in common with others than any
    pair needs, or is not alike to any set even if it shares all ``p``.
    """
    rank = F.row_number().over(W.partitionBy("gid", "n").orderBy("pos")) - 1
    ranked = shared.withColumn("rank", rank)
    of_gid = ranked.groupBy("gid", "n").agg(F.count("*").alias("k"), F.max(F.when(F.col("rank") == EXTRA - 1, F.col("pos"))).alias("last"))
    alone = F.when(F.col("last").isNotNull(), F.col("last") - (EXTRA - 1)).otherwise(F.col("n") - F.col("k"))
    of_gid = of_gid.filter(F.col("k") >= F.least(F.lit(EXTRA), needed(F.col("n"), percent))).withColumn("p", (F.col("n") - alone).cast("int"))
    of_gid = of_gid.filter(F.col("p") >= needed(F.col("n"), percent))
    at = F.col("pos") - F.least(F.col("pos") - F.col("rank"), F.col("n") - F.col("p"))
    return ranked.join(of_gid.select("gid", "n", "k", "p"), ["gid", "n"]).select("token", "gid", "n", "cnt", "k", "p", at.alias("at"))


def in_bloom(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose rk may be one of ``keys`` (rk), by a broadcast Bloom filter of fixed size.

    Where the filter would be full, a join by key finds exactly those rows.
    """
    if keys.count() > MOST_KEYS:
        return skewed_join(rows, keys.distinct(), "rk", "left_semi")
    bit = F.pmod(F.xxhash64("rk"), F.lit(1 << BLOOM_BITS))
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rk), {1 << BLOOM_BITS}) & 63 AS int))")
    bloom = keys.select(F.shiftright(bit, 6).alias("word"), mask.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # at most 2**(BLOOM_BITS - 6) rows
    return rows.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(bloom), "word").filter(F.col("bits").bitwiseAND(mask) != 0).drop("word", "bits")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int, repeated: DataFrame | None = None) -> DataFrame:
    """Those ``pairs`` (a, b: row keys) whose texts are alike, compared by 64-bit hashes of all their shingles.

    Texts that can be part of a pair are found with a Bloom filter over the keys, or by a
    join if there are many, then go to their pairs; of ``repeated`` rows (rk) one goes. No text goes anywhere
    if there are no pairs.
    """
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    keys = pairs.select(F.col("a").alias("rk")).union(pairs.select("b"))
    texts = docs.select(row_key().alias("rk"), F.col("text").cast("string").alias("text"))
    some = materialise(in_bloom(texts, keys))
    if repeated is not None:
        several = skewed_join(some, repeated.withColumn("twice", F.lit(True)), "rk", "left")
        some = materialise(several.filter("twice is null").drop("twice").unionByName(several.filter("twice").drop("twice").dropDuplicates(["rk"])))
    with_a = skewed_join(pairs.withColumn("rk", F.col("a")), some.withColumnRenamed("text", "ta"), "rk").drop("rk")
    with_both = skewed_join(with_a.withColumn("rk", F.col("b")), some.withColumnRenamed("text", "tb"), "rk").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            at = (key, hash(text))
            if at not in known:
                if len(known) >= 64:
                    known.clear()
                known[at] = shingle_set(text, words)
            return known[at]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["u", "v"])

    return map_texts(with_both, compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, dk, rk, kept.

    A document's set are its distinct runs of ``words`` words (between ASCII white space,
    A-Z in lower case); a text with fewer words is one run; null and empty texts have none
    and are linked with nothing. Rows are linked when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id reachable by links. A null id
    counts as the largest one. Every row is compared for itself, so rows without an id or of
    one id are together only if their texts are. ``kept`` holds for exactly one row of a
    component, one of the smallest id, and for all rows without words. An empty table gives an empty result; other columns are ignored.
    """
    classes = order_classes(slot_counts(docs.select(F.col("text").cast("string")), words))
    signs = materialise(signatures(docs, classes, words, percent).withColumn("rid", F.monotonically_increasing_id()))
    repeated = materialise(signs.filter("n > 0").groupBy("rk").count().filter("count > 1").select("rk"))
    repeated = None if repeated.isEmpty() else repeated
    nodes = materialise(signs.filter("n > 0").groupBy("d1", "d2", "n", "gid").agg(F.min(F.struct("dk", "rk", "rid")).alias("first")).withColumns({"rk": F.col("first.rk"), "rid": F.col("first.rid")}))
    groups = materialise(nodes.groupBy("gid", "n").agg(F.min("rk").alias("leader"), F.min_by("rid", "rk").alias("rid"), F.count("*").alias("members")))
    leaders = signs.select("rid", "gid", "n", "prefix").join(groups.select("gid", "n", "rid"), ["gid", "n", "rid"], "left_semi")
    postings = leaders.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = postings.groupBy("token").agg(F.count("*").alias("cnt"), F.min("gid").alias("some"), F.max("gid").alias("other"))
    tokens = materialise(tokens.filter("some <> other").select("token", "cnt"))
    shared = materialise(skewed_join(postings, tokens, "token").dropDuplicates(["token", "gid", "n"]))
    shared = materialise(sharable(shared, percent))

    # Families: every group beside the pivots of its frequent shingles (of those, the one that shares
    # most), every member beside its leader.
    sizes = groups.select("gid", "n", "leader")
    frequent = shared.filter(f"cnt >= {FAMILY}")
    pivots = frequent.groupBy("token").agg(F.max(F.struct("k", "gid"))["gid"].alias("pivot"))
    to_pivot = skewed_join(frequent.select("token", "gid", "n"), materialise(pivots), "token").filter("gid <> pivot").groupBy("gid", "n", "pivot").agg(F.count("*").alias("c")).filter("c >= 4")
    to_pivot = skewed_join(to_pivot, sizes.select(F.col("gid").alias("pivot"), F.col("n").alias("m"), F.col("leader").alias("b")), "pivot").filter(fits("n", "m", percent))
    to_pivot = to_pivot.join(sizes.select("gid", "n", F.col("leader").alias("a")), ["gid", "n"]).select("a", "b")
    several = groups.filter("members > 1").select("gid", "n", F.col("leader").alias("b"))
    to_leader = skewed_join(nodes.select("gid", F.col("n").alias("m"), F.col("rk").alias("a")), several, "gid").filter("n = m").select("a", "b")
    families = materialise(components(verified(docs, to_pivot.union(to_leader), words, percent, repeated)))

    # All other pairs: groups that are not in one component, and share enough of their prefixes.
    placed = nodes.select("rk", "gid", "n").join(families.withColumnRenamed("node", "rk"), "rk", "left").withColumn("c", F.coalesce("component", "rk")).drop("component")
    placed = materialise(placed)
    of_group = placed.groupBy("gid", "n").agg(F.min("c").alias("c"), F.max("c").alias("c2")).select("gid", "n", "c", (F.col("c") != F.col("c2")).alias("mixed"))
    places = materialise(shared.select("token", "gid", "n", "at", "p").join(of_group, ["gid", "n"]))
    per_component = places.groupBy("token", "c").agg(F.count("*").alias("k"), F.max("mixed").alias("mixed"))
    open_tokens = per_component.groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("components"), F.max("mixed").alias("any_mixed"))
    open_tokens = open_tokens.filter("components > 1 or any_mixed").select("token", F.col("top.c").alias("major"))
    opened = materialise(skewed_join(places, open_tokens, "token").withColumn("minor", F.col("mixed") | (F.col("c") != F.col("major"))))
    kept = ("gid", "n", "at", "p", "c", "mixed")
    starts = opened.filter(F.col("p") - F.col("at") >= needed(F.col("n"), percent))
    left = starts.filter("minor").select("token", *[F.col(x).alias(f"{x}_a") for x in kept])
    right = starts.select(F.col("token"), *[F.col(x).alias(f"{x}_b") for x in (*kept, "minor")])
    apart = F.expr("(c_a <> c_b or mixed_a or mixed_b) and gid_a <> gid_b and (gid_a < gid_b or not minor_b)")
    met = skewed_join(left, right, "token").filter(apart & fits("n_a", "n_b", percent) & first_shared(percent))
    first = F.col("gid_a") < F.col("gid_b")
    both = {name: (F.when(first, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")), F.when(first, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a"))) for name, x in (("g", "gid"), ("n", "n"))}
    met = materialise(met.select(both["g"][0].alias("g"), both["g"][1].alias("h"), both["n"][0].alias("ng"), both["n"][1].alias("nh")).distinct())
    prefixes = shared.groupBy("gid", "n", "p").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("x"))
    prefixes = materialise(prefixes.select("gid", F.col("n").alias("m"), "p", F.col("x.token").alias("t"), F.col("x.at").alias("a")))
    for x in "gh":
        met = skewed_join(met, prefixes.select(F.col("gid").alias(x), F.col("m"), F.col("p").alias(f"p{x}"), F.col("t").alias(f"t{x}"), F.col("a").alias(f"a{x}")), x).filter(F.col("m") == F.col(f"n{x}")).drop("m")
    met = met.filter(enough_shared(percent)).select("g", "h", "ng", "nh")
    member = placed.select("gid", "n", "rk", "c")
    across = skewed_join(met, member.select(F.col("gid").alias("g"), F.col("n").alias("n1"), F.col("rk").alias("a"), F.col("c").alias("ca")), "g").filter("n1 = ng")
    across = skewed_join(across, member.select(F.col("gid").alias("h"), F.col("n").alias("n2"), F.col("rk").alias("b"), F.col("c").alias("cb")), "h").filter("n2 = nh and ca <> cb")
    mixed = of_group.filter("mixed").select("gid", "n")
    inner = member.join(mixed, ["gid", "n"])
    within = skewed_join(inner.select("gid", "n", F.col("rk").alias("a"), F.col("c").alias("ca")), inner.select("gid", F.col("n").alias("m"), F.col("rk").alias("b"), F.col("c").alias("cb")), "gid").filter("n = m and a < b and ca <> cb")
    more = verified(docs, across.select("a", "b").union(within.select("a", "b")), words, percent, repeated)
    every = families.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
    final = components(every)

    reached = materialise(nodes.join(final.withColumnRenamed("node", "rk"), "rk", "left").select("d1", "d2", "n", "first", F.coalesce("component", "rk").alias("c")))
    reached = skewed_join(reached.drop("first"), reached.groupBy("c").agg(F.min("first").alias("head")), "c").select("d1", "d2", "n", F.col("head.dk").alias("c"), F.col("head.rid").alias("head"))
    reached = materialise(reached)
    rows = skewed_join(signs.select("doc_id", "dk", "rk", "rid", "d1", F.col("d2").alias("e2"), F.col("n").alias("m")), reached, "d1", "left").filter("head is null or (d2 = e2 and n = m)")
    out = rows.select("doc_id", F.col("m").cast("long").alias("n_shingles"), F.coalesce("c", "dk").alias("c"), "dk", "rk", F.coalesce(F.col("head") == F.col("rid"), F.lit(True)).alias("kept"))
    return out.select("doc_id", "n_shingles", F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"), "dk", "rk", "kept")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row, of the smallest id, of each component, all columns as they were.

    Rows without words are components of their own and stay.
    """
    rk = fresh(docs, "_rk")[0]
    keys = materialise(near_duplicates(docs, words, percent).groupBy(F.col("rk").alias(rk)).agg(F.max("kept").alias("some"), F.min("kept").alias("every")))
    keyed = docs.withColumn(rk, row_key())
    whole = keyed.join(keys.filter("not every").select(rk), rk, "left_anti").select(*docs.columns)
    several = keys.filter("some and not every").select(rk)  # repeated rows, of which one stays
    if several.isEmpty():
        return whole
    return whole.unionByName(keyed.join(several, rk, "left_semi").dropDuplicates([rk]).select(*docs.columns))
