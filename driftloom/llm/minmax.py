"""Near duplicates by min-max hashing: both ends of a set under each permutation, banded, then confirmed.

Under one permutation of hash values the smallest and the largest value of two sets agree
with a chance that is their Jaccard likeness, so a permutation gives two values of a
signature for one evaluation; as the ends of one set are not the same shingle, the two err
in opposite directions and the estimate varies less than one of two permutations. A band
hashes ``ROWS`` values of one kind; sets of likeness s share at least one of ``BANDS`` bands
but for (1 - s**ROWS)**BANDS, 4.7e-7 for 0.8. Two sets in one bucket of a band are a
candidate, and all links are confirmed on the full sets.

Equal sets are one node. In a bucket each node first meets the pivot, the node that shares
most buckets with others; what one pivot joins needs no further comparison. A large family
of near copies also has members that are not alike to their pivot, and two of the family
can still be. They are told by what sets them apart from a member P: if A is not alike to P,
and A and B differ from P in no shingle in the same way, A and B are not alike either. So
such links need a shared difference, and are found by joining differences, not members;
the sizes of the sets and the number of shared differences give the likeness exactly. All
other nodes of one bucket that are still in different components are compared pair by pair,
unless their distances from a common pivot rule it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_key, fresh, map_texts, materialise
from .components import components, skewed_join
from .features import BASE, mix
from .ngram_join import fits, in_bloom, shingle_set

#: Values in a band and number of bands; each permutation gives two values.
ROWS, BANDS = 6, 48
PERMUTATIONS = ROWS * BANDS // 2
#: Distance from a pivot up to which differences from it are listed.
NEAR = 0.5
#: Shingles that are permuted at once.
BLOCK = 4096

_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest values under all permutations, then the largest, of a set of 64-bit shingle hashes that is not empty."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, dtype=np.uint32), np.zeros(PERMUTATIONS, dtype=np.uint32)
    for at in range(0, len(x), BLOCK):
        h = x[None, at : at + BLOCK] * FACTORS[:, None] + SHIFTS[:, None]
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.concatenate([low, high])


def bands(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of ``signatures``: ROWS values that are all smallest or all largest ones."""
    v = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2])
    for j in range(ROWS):
        h = mix(h * np.uint64(BASE) + v[:, :, j])
    return h


def keyed() -> list[Column]:
    """128 bits for an id and its raw text."""
    row = (doc_key(), F.col("text").cast("string"), F.col("text").isNull())
    return [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(1), *row).alias("k2")]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, dk, k1, k2, n, d1, d2, bands): size and digest of the set, and the hashes of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, rows = [], [], []
            for text in batch.column(4).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    rows.append(signature(s))
            d1, d2 = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2).T
            flat = bands(np.stack(rows)).astype(np.int64).ravel() if rows else np.empty(0, np.int64)
            offsets = np.cumsum([0, *(BANDS * (n > 0) for n in sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[1:4], pa.array(sizes, pa.int32()), pa.array(d1), pa.array(d2), lists], names=["doc_id", "dk", "k1", "k2", "n", "d1", "d2", "bands"])

    rows = docs.select("doc_id", doc_key().alias("dk"), *keyed(), F.col("text").cast("string"))
    return map_texts(rows, sign, "doc_id long, dk long, k1 long, k2 long, n int, d1 long, d2 long, bands array<long>")


def compared(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, repeated: DataFrame, words: int, percent: int) -> DataFrame:
    """The full sets of ``pairs`` (u, v: nodes): rows (u, v, nu, nv, alike, dist, diff).

    ``dist`` is the Jaccard distance; ``diff`` has what only u has (even numbers) and what
    only v has (odd ones), null for a distance over NEAR.
    """
    pairs = materialise(pairs.filter("u <> v"))
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", F.col("k1").alias("rk"), F.col("k2").alias("o2")), "node")
    wanted = materialise(wanted)
    rows = docs.select(*keyed(), F.col("text").cast("string").alias("text")).withColumnRenamed("k1", "rk")
    some = skewed_join(in_bloom(rows, wanted.select("rk")), wanted, "rk").filter("k2 = o2").select("node", "text")
    some = materialise(some.join(repeated.withColumn("twice", F.lit(True)), "node", "left"))
    texts = some.filter("twice is null").select("node", "text").unionByName(some.filter("twice").select("node", "text").dropDuplicates(["node"]))
    with_u = skewed_join(pairs.select("u", "v"), texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    with_both = skewed_join(with_u, texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingle_set(text, words)
            return known[node]

        for batch in batches:
            sizes, dists, alike, diffs = [], [], [], []
            for u, v, tu, tv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(u, tu), of(v, tv)
                shared = np.isin(x, y, assume_unique=True)
                both = int(shared.sum())
                union = len(x) + len(y) - both
                sizes.append((len(x), len(y)))
                alike.append(100 * both >= percent * union)
                dists.append(1 - both / union)
                one = np.uint64(1)
                diffs.append(np.concatenate([x[~shared] & ~one, np.setdiff1d(y, x[shared], assume_unique=True) | one]).astype(np.int64) if dists[-1] <= NEAR else None)
            nu, nv = ([n[i] for n in sizes] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nu, pa.int64()), pa.array(nv, pa.int64()), pa.array(alike, pa.bool_()), pa.array(dists, pa.float64()), pa.array(diffs, pa.list_(pa.int64()))], names=["u", "v", "nu", "nv", "alike", "dist", "diff"])

    return map_texts(with_both, compare, "u long, v long, nu long, nv long, alike boolean, dist double, diff array<long>")


def by_differences(first: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of nodes with the same pivot, by the differences they share.

    A pivot can be an odd one of its family, which all others then differ from alike. So
    each family is first seen from its middle: the member nearest to what most of it has.
    """
    members = first.filter("diff is not null").select(F.col("u").alias("node"), F.col("v").alias("pivot"), F.col("nu").alias("n"), "alike", "diff")
    open_ = materialise(members.filter("not alike").select("pivot").distinct())
    heads = skewed_join(first.filter("diff is not null").select(F.col("v").alias("pivot"), F.col("nv").alias("n")).distinct(), open_, "pivot", "left_semi")
    members = skewed_join(members, open_, "pivot", "left_semi").drop("alike")
    members = materialise(members.unionByName(heads.select(F.col("pivot").alias("node"), "pivot", "n", F.array().cast("array<long>").alias("diff"))))
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m"))
    counts = members.select("pivot", F.explode("diff").alias("token")).groupBy("pivot", "token").agg(F.count("*").alias("cnt"))
    common = counts.join(sizes, "pivot").filter("2 * cnt > m").groupBy("pivot").agg(F.collect_list("token").alias("most"))  # within one text's size
    common = materialise(sizes.join(common, "pivot", "left").select("pivot", F.coalesce("most", F.array().cast("array<long>")).alias("most")))
    away = F.size("diff") + F.size("most") - 2 * F.size(F.array_intersect("diff", "most"))
    ranked = skewed_join(members, common, "pivot").select("pivot", "node", "n", "diff", away.alias("away"))
    middle = ranked.groupBy("pivot").agg(F.min(F.struct("away", "node", "n", "diff")).alias("x")).select("pivot", F.col("x.node").alias("middle"), F.col("x.n").alias("nm"), F.col("x.diff").alias("dm"))
    seen = skewed_join(members, materialise(middle), "pivot").withColumn("diff", F.concat(F.array_except("diff", "dm"), F.array_except("dm", "diff"))).drop("dm").withColumn("k", F.size("diff"))

    def alike(apart: Column, size: Column) -> Column:
        return 100 * (size - apart) >= percent * (size + apart)

    seen = materialise(seen.withColumn("alike", alike(F.col("k"), F.col("n") + F.col("nm"))))
    near = seen.filter("alike and node <> middle").select(F.col("node").alias("u"), F.col("middle").alias("v"))
    seen = skewed_join(seen, families, "node", "left").withColumn("c", F.coalesce("component", "node"))
    # Two nodes that are alike share at least so many differences, at least one of which is among the rarest of both.
    q, r = 100 + percent, 100 - percent
    attributes = ["node", "pivot", "n", "nm", "alike", "c", "k"]
    tokens = materialise(seen.select(*attributes, F.explode("diff").alias("token")).withColumn("at", F.xxhash64("pivot", "token")))
    often = materialise(tokens.groupBy("at", "pivot", "token").agg(F.count("*").alias("cnt")).select("at", F.col("pivot").alias("pivot2"), F.col("token").alias("token2"), "cnt"))
    counted = skewed_join(tokens, often, "at").filter("pivot = pivot2 and token = token2")
    ranked = counted.groupBy(*attributes).agg(F.sort_array(F.collect_list(F.struct("cnt", "token"))).alias("rarest"))  # within one text's size
    first_of = F.expr(f"k - greatest(1, ({q} * k + {r} * (nm - n)) div {2 * q} + 1) + 1")
    deep_of = F.expr(f"k - greatest(1, k - ({r} * n) div {percent}) + 1")  # for partners near the middle
    ranked = ranked.withColumn("reach", first_of).withColumn("deep", F.when(F.col("alike"), F.col("reach")).otherwise(deep_of))
    rare = ranked.select(*attributes, "reach", "deep", F.posexplode(F.slice("rarest", 1, F.greatest("reach", "deep").cast("int"))).alias("pos", "x"))
    rare = materialise(rare.select(*attributes, (F.col("pos") < F.col("reach")).alias("near"), (F.col("pos") < F.col("deep")).alias("deep"), F.col("x.token").alias("token")).withColumn("at", F.xxhash64("pivot", "token")))
    one = rare.filter("not alike").select("at", "pivot", "token", *[F.col(x).alias(f"{x}1") for x in ("node", "n", "c", "k", "near", "deep")])
    two = rare.filter("near").select("at", F.col("pivot").alias("pivot2"), F.col("token").alias("token2"), *[F.col(x).alias(f"{x}2") for x in ("node", "n", "c", "k", "alike")])
    can = F.expr("pivot = pivot2 and token = token2 and c1 <> c2 and ((alike2 and deep1) or (not alike2 and near1 and node1 < node2))")
    both = skewed_join(one, two, "at").filter(can & alike(F.abs(F.col("k1") - F.col("k2")), F.col("n1") + F.col("n2")))
    both = materialise(both.select("pivot", "node1", "node2", "n1", "n2", "k1", "k2").distinct())
    whole = seen.select(F.xxhash64("node", "pivot").alias("row"), F.col("node").alias("node_"), F.col("pivot").alias("pivot_"), "diff")
    for i in (1, 2):
        both = skewed_join(both.withColumn("row", F.xxhash64(f"node{i}", "pivot")), whole, "row").filter(f"node_ = node{i} and pivot_ = pivot").withColumnRenamed("diff", f"diff{i}").drop("row", "node_", "pivot_")
    same = F.size(F.array_intersect("diff1", "diff2"))
    far = both.filter(alike(F.col("k1") + F.col("k2") - 2 * same, F.col("n1") + F.col("n2")))
    return near.unionByName(far.select(F.col("node1").alias("u"), F.col("node2").alias("v")))


def still_apart(shared: DataFrame, first: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes that share a bucket of ``shared`` and fit in size, in different components, and not compared yet.

    In a bucket the members of its largest component are not paired with each other.
    """
    of_pivot = first.select(F.col("u").alias("node"), F.col("v").alias("p"), "dist", F.col("diff").isNotNull().alias("near"))
    placed = skewed_join(shared.select("band", "node", "n"), families, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    placed = materialise(placed)
    parts = placed.groupBy("band", "c").agg(F.count("*").alias("k"))
    opened = parts.groupBy("band").agg(F.max(F.struct("k", "c"))["c"].alias("major"), F.count("*").alias("parts")).filter("parts > 1").select("band", "major")
    opened = materialise(skewed_join(skewed_join(placed, opened, "band"), of_pivot, "node", "left").fillna({"p": -1, "near": False, "dist": 0.0}))
    minor = opened.filter("c <> major").select("band", *[F.col(x).alias(f"{x}1") for x in ("node", "n", "c", "p", "dist", "near")])
    other = opened.select("band", (F.col("c") != F.col("major")).alias("small"), *[F.col(x).alias(f"{x}2") for x in ("node", "n", "c", "p", "dist", "near")])
    new = "c1 <> c2 and (node1 < node2 or not small) and node1 <> p2 and node2 <> p1"
    same = "(p1 = p2 and p1 >= 0)"
    far = f"{same} and ((near1 and near2) or abs(dist1 - dist2) > {1 - percent / 100 + 1e-9})"
    found = skewed_join(minor, other, "band").filter(F.expr(f"{new} and not ({far})") & fits("n1", "n2", percent))
    return found.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set are its distinct runs of ``words`` words (between ASCII white space,
    A-Z in lower case); a text with fewer words is one run; null and empty texts have none
    and are linked with nothing. Rows are linked when 100 * intersection >= ``percent`` *
    union; component_id is the smallest doc_id reachable by links, a null id counts as the
    largest. Every row stands for itself, whatever its id. ``kept`` holds for exactly one row
    of a component, one of the smallest id, and for all rows without words. An empty table
    gives an empty result; other columns are ignored. Bands are made for likeness 0.8 and
    above: lower thresholds lose links more often.
    """
    signs = materialise(signed(docs, words).withColumn("node", F.monotonically_increasing_id()))
    some = signs.filter("n > 0")
    nodes = some.groupBy("d1", "d2", "n").agg(F.min(F.struct(F.struct(F.col("dk") == NULL_ID, "dk"), "node", "k1", "k2", "dk")).alias("first"))
    nodes = materialise(nodes.select("d1", "d2", "n", "first.node", "first.k1", "first.k2", "first.dk"))
    rows_of = some.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
    repeated = materialise(nodes.join(rows_of, ["k1", "k2"]).select("node"))

    # Buckets with several nodes, and in each the node that shares most with others.
    postings = signs.join(nodes.select("node"), "node", "left_semi").select("node", "n", F.explode("bands").alias("band"))
    several = postings.groupBy("band").agg(F.count("*").alias("cnt")).filter("cnt > 1")
    shared = materialise(skewed_join(postings, several, "band"))
    central = shared.groupBy("node").agg(F.sum("cnt").alias("mass"))
    central = skewed_join(shared.select("band", "node", "n"), central, "node")
    pivots = materialise(central.groupBy("band").agg(F.max(F.struct("mass", "node", "n")).alias("p")).select("band", "p.mass", F.col("p.node").alias("pivot"), F.col("p.n").alias("m")))
    met = skewed_join(shared.select("band", "node", "n"), pivots, "band").filter(F.col("node") != F.col("pivot")).filter(fits("n", "m", percent))
    met = met.groupBy("node", "pivot").agg(F.count("*").alias("c"), F.max("mass").alias("mass"))
    most = met.groupBy("node").agg(F.max("c").alias("most"))
    met = met.join(most, "node").filter("2 * c >= most").groupBy("node").agg(F.max(F.struct("mass", "pivot"))["pivot"].alias("v"))
    first = materialise(compared(docs, met.select(F.col("node").alias("u"), "v"), nodes, repeated, words, percent))
    links = first.filter("alike").select("u", "v")
    links = materialise(links.unionByName(by_differences(first, materialise(components(links)), percent)))
    families = materialise(components(links))
    more = compared(docs, still_apart(shared, first, families, percent), nodes, repeated, words, percent)
    final = components(links.unionByName(more.filter("alike").select("u", "v")))

    reached = skewed_join(nodes.select("d1", "d2", "n", "node", "dk"), final, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    reached = materialise(reached)
    heads = reached.groupBy("c").agg(F.min(F.struct(F.col("dk") == NULL_ID, "dk", "node")).alias("head"))
    reached = skewed_join(reached, heads, "c").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), F.col("head.dk").alias("least"), F.col("head.node").alias("head"))
    reached = materialise(reached)
    same = (F.xxhash64("d1", "d2") == F.xxhash64("e1", "e2")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m"))
    rows = signs.drop("bands").join(reached, same, "left")
    least = F.coalesce("least", "dk")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(least != NULL_ID, least).alias("component_id"), F.coalesce(F.col("head") == F.col("node"), F.lit(True)).alias("kept"))
