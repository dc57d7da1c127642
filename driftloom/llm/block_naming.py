"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Sorting the blocks
gives every distinct block an integer name; adjacent names are paired and the sorted
pairs named in turn, level by level, until each document has one name. Two documents
have the same (level, name) exactly when their texts are equal: names stand for contents
that were compared, not for hashes. Hashes only route rows to sort groups.

Names are a function of the contents of a sort group and of fixed numbers, so a task that
runs again gives the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, doc_key, fresh, materialise, row_hash, text_or_empty

BLOCK_BYTES = 2048
#: Sort groups of blocks and of pairs. A group's rows are sorted and ranked together.
GROUPS = 1 << 20
#: The most frequent block hashes, whose occurrences are spread over SALTS sort groups each.
HOT, SALTS = 512, 64
#: A class's rows are counted in so many parts first.
CLASS_SALTS = 256


def normalised() -> F.Column:
    return F.regexp_replace(text_or_empty(), SPACE, " ")


def _name(group: F.Column, rank: F.Column) -> F.Column:
    return F.shiftleft(group.cast("long"), 40) + rank.cast("long")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows (dk, rh, level, name), one for each document row key, and the rows they come from.

    The second table has doc_id, dk, rh and text_sha256 for every input row.
    """
    count = lambda b: F.greatest(F.lit(1), F.ceil(F.length(b) / F.lit(block_bytes))).cast("int")
    cut = lambda b: F.transform(F.sequence(F.lit(0), count(b) - 1), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes)))
    keyed = docs.select(F.col("doc_id"), doc_key().alias("dk"), row_hash().alias("rh"), normalised().cast("binary").alias("b"))
    cut_up = keyed.select("doc_id", "dk", "rh", F.sha2("b", 256).alias("text_sha256"), cut(F.col("b")).alias("blocks"))
    rows = materialise(cut_up.select("doc_id", "dk", "rh", "text_sha256", F.transform("blocks", lambda x: F.xxhash64(x)).alias("hashes")))
    top = rows.select(F.explode_outer("hashes").alias("h")).groupBy("h").count().orderBy(F.desc("count"), "h").limit(HOT)
    hot = [r.h for r in top.filter("count >= 64").collect()]

    occurrences = cut_up.select("dk", "rh", F.size("blocks").alias("n"), F.posexplode_outer("blocks").alias("pos", "block"))
    h = F.xxhash64("block")
    is_hot = h.isin(hot) if hot else F.lit(False)
    occurrences = occurrences.select("dk", "rh", "n", "pos", "block", F.pmod(h, F.lit(GROUPS)).cast("int").alias("g"), F.when(is_hot, F.pmod(F.xxhash64("dk", "rh"), F.lit(SALTS)).cast("int") + 1).otherwise(0).alias("salt"))
    w = W.partitionBy("g", "salt").orderBy("block")
    before = F.lag("block").over(w)
    ranked = occurrences.select("dk", "rh", "n", "pos", "g", "salt", F.dense_rank().over(w).alias("rank"), F.when((F.col("salt") > 0) & (before.isNull() | (before != F.col("block"))), F.col("block")).alias("first"))
    ranked = materialise(ranked)
    current = ranked.filter("salt = 0").select("dk", "rh", "n", "pos", _name(F.col("g"), F.col("rank")).alias("name"))
    if hot:
        # One copy of each hot block per salt, HOT * SALTS rows at most, agrees on a common name.
        agreed = ranked.filter("first is not null").select("g", "salt", "rank", (F.dense_rank().over(W.partitionBy("g").orderBy("first")) + F.lit(1 << 38)).alias("common"))
        spread = ranked.filter("salt > 0").join(F.broadcast(agreed), ["g", "salt", "rank"])
        current = current.unionByName(spread.select("dk", "rh", "n", "pos", _name(F.col("g"), F.col("common")).alias("name")))

    longest = ranked.agg(F.max("n")).first()[0] or 1
    level, done = 0, [current.filter("n = 1").select("dk", "rh", F.lit(0).alias("level"), "name")]
    while longest > 1:
        level += 1
        half = (F.col("pos") / 2).cast("int")
        pairs = current.filter("n > 1").groupBy("dk", "rh", ((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("pos"))
        pairs = pairs.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        g = F.pmod(F.xxhash64("l", "r"), F.lit(GROUPS))
        named = pairs.select("l", "r").distinct().withColumn("g", g)
        named = named.select("l", "r", _name(F.col("g"), F.row_number().over(W.partitionBy("g").orderBy("l", "r"))).alias("name"))
        current = materialise(pairs.join(named, ["l", "r"]).select("dk", "rh", "n", "pos", "name"))
        done.append(current.filter("n = 1").select("dk", "rh", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("dk", "rh").agg(F.max(F.struct("level", "name")).alias("c")).select("dk", "rh", "c.level", "c.name"), rows


def exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, dk, rh.

    Texts are equal when they are identical once each run of ASCII white space is one
    space; null counts as empty, and empty texts are equal to one another. Of equal texts
    the row with the smallest doc_id is kept (a null id comes last; of one id with several
    raw texts, the smallest text hash; of rows that repeat id and raw text, exactly one). An empty table gives an empty result; other columns are ignored.
    """
    ids, rows = identities(docs, block_bytes)
    of_rows = rows.select("doc_id", "dk", "rh", "text_sha256").join(ids, ["dk", "rh"])
    of_rows = materialise(of_rows.withColumns({"salt": F.pmod(F.xxhash64("dk", "rh"), F.lit(CLASS_SALTS)).cast("int"), "rid": F.monotonically_increasing_id()}))
    parts = of_rows.groupBy("level", "name", "salt").agg(F.min(F.struct("dk", "rh", "rid")).alias("k"), F.count("*").alias("c"))
    whole = parts.groupBy("level", "name").agg(F.min("k").alias("k"), F.sum("c").alias("group_size"))
    per_part = parts.select("level", "name", "salt").join(whole, ["level", "name"])
    joined = of_rows.join(per_part, ["level", "name", "salt"])
    keep = F.when(F.col("k.dk") != NULL_ID, F.col("k.dk"))
    kept = F.col("k.rid") == F.col("rid")
    return joined.select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "dk", "rh")


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each class of equal texts, all columns as they were."""
    dk, rh = fresh(docs, "_dk", "_rh")
    copies = exact_copies(docs, block_bytes).groupBy(F.col("dk").alias(dk), F.col("rh").alias(rh)).agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    kept = materialise(copies.filter("some"))
    keyed = docs.withColumns({dk: doc_key(), rh: row_hash()})
    once = keyed.join(kept.filter("every").select(dk, rh), [dk, rh], "left_semi").select(*docs.columns)
    several = kept.filter("not every").select(dk, rh)  # repeated rows, of which one stays
    if several.isEmpty():
        return once
    return once.unionByName(keyed.join(several, [dk, rh], "left_semi").dropDuplicates([dk, rh]).select(*docs.columns))
