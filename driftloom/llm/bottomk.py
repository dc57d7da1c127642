"""Document fingerprints: bottom-k sketches of hashed word shingles, on built-in functions only.

A fingerprint holds the k smallest distinct hashes of a text's shingles in ascending order.
The k smallest of two fingerprints' union are the fingerprint of both texts together, so
sketches of parts merge into that of the whole. Resemblance is the share of the merged
sketch that both have; containment and the number of distinct shingles follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, doc_key, join_bounded, materialise, row_hash, text_or_empty

K, WORDS = 256, 5
#: Hashes are cut to so many bits, which a fingerprint spells as hexadecimal digits.
BITS = 48
#: Documents of one cell, which are put next to their neighbours together.
RANGE_DOCS, MOST_RANGES = 2000, 10_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of every run of ``words`` words; of fewer words, of all of them as one; of none, none."""
    parts = F.filter(F.split(text, SPACE), lambda w: w != "")
    whole = lambda p: F.array(F.xxhash64(p))
    runs = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(p, i + j) for j in range(words)]))
    # Hash each word once; a shingle is the hash of its words' hashes.
    hashed = F.transform(parts, lambda w: F.xxhash64(w))
    bound = F.transform(F.array(hashed), lambda p: F.when(F.size(p) == 0, F.array().cast("array<bigint>")).when(F.size(p) < words, whole(p)).otherwise(runs(p)))
    return F.element_at(bound, 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text as a sorted array of longs; empty for a text without words."""
    return bottom(F.transform(shingle_hashes(text, words), lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1))), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what ``a`` and ``b`` are sketches of."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets; two empty ones are alike (1), one empty: 0."""
    def of(u: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared / F.size(u))

    return F.element_at(F.transform(F.array(merge(a, b, k)), of), 1)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) / the k-th smallest hash."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / (F.element_at(s, -1) + 1) * float(1 << BITS))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def spell(s: Column) -> Column:
    """A fingerprint as text: hashes of BITS / 4 hexadecimal digits, one after the other."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def unspell(text: Column) -> Column:
    digits = BITS // 4
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.length(text) / digits).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.conv(F.substring(text, i * digits + 1, F.lit(digits)), 16, 10).cast("long"))


def with_next(docs: DataFrame, **carried: Column) -> DataFrame:
    """Rows (doc_id, text, next_text, and columns c and next_c for each of ``carried``, made of ``text``).

    Every document stands beside the next one by id, the last beside the first. Null ids
    come last, equal ids are ordered by text hash. Documents are dealt to cells: ranges of
    ids, and for an id with many rows ranges of its text hashes. The first document of each
    cell is also put at the end of the cell before, so no task sees more than one cell. Of
    rows that repeat id and text one is dealt; the others are each followed by themselves.
    """
    rows = docs.select("doc_id", doc_key().alias("dk"), row_hash().alias("rh"), text_or_empty().alias("text"))
    names = ["text", *carried]
    keys = materialise(rows.groupBy("dk", "rh").count())
    of_id = keys.groupBy("dk").agg(F.count("*").alias("m"))
    n, low = keys.agg(F.count("*"), F.min("dk")).first()
    if not n:
        return rows.withColumns(carried).select("doc_id", *names, *[F.col(c).alias(f"next_{c}") for c in names])
    repeated = materialise(keys.filter("count > 1"))
    once, copies = rows, None
    if not repeated.isEmpty():
        marked = join_bounded(rows, repeated, ["dk", "rh"], "left")
        one = marked.filter("count is not null").dropDuplicates(["dk", "rh"])
        once = marked.filter("count is null").drop("count").unionByName(one.drop("count"))
        more = one.withColumn("turn", F.explode(F.sequence(F.lit(2), F.col("count").cast("int")))).withColumns(carried)
        copies = more.select("doc_id", *names, *[F.col(c).alias(f"next_{c}") for c in names])

    # At most MOST_RANGES ranges and as many ids with cells of their own.
    parts = max(1, min(MOST_RANGES, n // RANGE_DOCS))
    each = max(RANGE_DOCS, n // parts)
    hot = materialise(of_id.filter(F.col("m") > 2 * each).select("dk", F.ceil(F.log2(F.col("m") / each)).cast("int").alias("bits")))
    cuts = keys.agg(F.percentile_approx("dk", [i / parts for i in range(parts)], max(10_000, 20 * parts))).first()[0]
    alone = {x for r in hot.collect() for x in (r.dk, min(r.dk + 1, NULL_ID))}
    place = _place(sorted({low, *cuts, *alone}))

    def celled(keyed: DataFrame) -> DataFrame:
        sub = F.coalesce(F.expr("shiftright(rh, 64 - bits)"), F.lit(0))
        return keyed.join(F.broadcast(hot), "dk", "left").withColumn("cell", F.struct(place.alias("range"), sub.alias("sub"))).drop("bits")

    cells = celled(keys).groupBy("cell").agg(F.min(F.struct("dk", "rh")).alias("first"))
    before = F.coalesce(F.lag("cell").over(W.orderBy("cell")), F.max("cell").over(W.partitionBy()))
    firsts = materialise(cells.select("first.dk", "first.rh", before.alias("before")))
    dealt = celled(once).join(F.broadcast(firsts), ["dk", "rh"], "left").withColumns(carried)
    here, there = F.struct("cell", F.lit(0).alias("turn")), F.struct(F.col("before").alias("cell"), F.lit(1).alias("turn"))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("doc_id", "dk", "rh", *names, "at.cell", "at.turn")
    in_cell = W.partitionBy("cell").orderBy("turn", "dk", "rh")
    out = dealt.select("doc_id", *names, *[F.lead(c).over(in_cell).alias(f"next_{c}") for c in names], "turn").filter("turn = 0").drop("turn")
    return out if copies is None else out.unionByName(copies)


def _place(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most dk, by a tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(F.col("dk") < bounds[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(bounds))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): fingerprints of its text and of its edited text.

    The edited text has the last quarter (floor) of the code points replaced by the first
    as many, or all, of the next document's. Null text is empty: its fingerprint is the
    empty string. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated). A single document is its own next one;
    an empty table gives an empty result; other columns are ignored.
    """
    q = F.floor(F.col("n_chars") / 4).cast("int")
    d = with_next(docs, a=sketch(F.col("text"), k, words)).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - q).cast("int")), F.substring(F.col("next_text"), F.lit(1), q))
    d = d.withColumn("edited", edited)
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", sketch(F.col("edited"), k, words).alias("b"), F.col("next_a").alias("c"))
    return d.select("doc_id", "n_chars", "edited_sha256", spell(F.col("a")).alias("fingerprint"), spell(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"), distinct_count(F.col("a"), k).alias("n_shingles"))
