"""Merkle manifest of a table: a tree for each source, a tree over the sources, and a proof for every row.

A row is a leaf; H is SHA-256 over concatenated inputs, digests as lowercase hex text. In a
tree every ``FAN`` consecutive nodes of a level (the last run may have fewer, even one) make
up one node of the next, while a level has several. All nodes are written as one table
keyed by coordinates (tree, level, place). A proof is made by coordinate lookup: from its
place and the size of its tree a leaf lists the coordinates of all its siblings, these are
joined with the node table, ordered and folded.

Paths are looked up ``STRIDE`` levels at a time: a leaf asks for the siblings in its lowest
levels, the node above them for the next ones, and so on. So no node is asked for by more
than FAN**STRIDE others, however many rows a source has, and a leaf never carries the upper
part of its path that it shares with all rows around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import join_bounded, materialise, ranked
from .features import fold

#: Nodes that make up one of the next level, and levels that are built and looked up at once.
FAN, STRIDE = 3, 6


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def levels(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def grown(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes (tree, level, place, digest) over ``leaves`` (tree, place, size, digest), of at most ``most`` in a tree.

    A block of FAN**STRIDE neighbours is folded in one task, so a job adds STRIDE levels and
    the next one starts from a fraction of the rows.
    """
    block = FAN**STRIDE

    def fold_blocks(start: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int, int, str]] = []
                for tree, at, size, run_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row, last = run_, levels(size)
                    for level in range(start + 1, min(start + STRIDE, last) + 1):
                        row = [hashlib.sha256("".join(row[i : i + FAN]).encode()).hexdigest() for i in range(0, len(row), FAN)]
                        first = at * FAN ** (STRIDE - (level - start))
                        out += [(tree, level, first + i, size, d) for i, d in enumerate(row)]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "level", "place", "size", "digest"])

        return run

    made = leaves.select("tree", F.lit(0).alias("level"), "place", "size", "digest")
    nodes, start = [made], 0
    while start < levels(most):
        lowest = nodes[-1].filter(F.col("level") == start)
        blocks = lowest.groupBy("tree", F.expr(f"place div {block}").alias("at"), "size").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("row"))
        rows = blocks.select("tree", "at", "size", F.col("row.digest").alias("row"))
        nodes.append(materialise(shipped(rows).mapInArrow(fold_blocks(start), "tree long, level int, place long, size long, digest string")))
        start += STRIDE
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out


def coordinates(start: int) -> Column:
    """For a node at level ``start``: (level, place) of its siblings up to STRIDE levels on, from its place and the tree's size."""
    def of(level: int) -> Column:
        own = F.expr(f"place div {FAN**(level - start)}")
        first = F.expr(f"place div {FAN**(level - start + 1)}") * FAN
        count = F.ceil(F.col("size") / F.lit(FAN**level)).cast("long")
        run = F.filter(F.array(*[first + i for i in range(FAN)]), lambda p: (p < count) & (p != own))
        return F.when(count > 1, F.transform(run, lambda p: F.struct(F.lit(level).alias("level"), p.alias("at"))))

    return F.flatten(F.filter(F.array(*[of(level) for level in range(start, start + STRIDE)]), lambda x: x.isNotNull()))


def steps(start: int) -> Column:
    """Path of the levels that a node at level ``start`` has looked up: (left, right), the siblings on both sides, level by level."""
    def of(level: int) -> Column:
        own = F.expr(f"place div {FAN**(level - start)}")

        def side(test) -> Column:
            return F.array_join(F.transform(F.filter("_found", lambda x: (x["level"] == level) & test(x["at"], own)), lambda x: x["digest"]), "")

        count = F.ceil(F.col("size") / F.lit(FAN**level))
        return F.when(count > 1, F.struct(side(lambda p, o: p < o).alias("left"), side(lambda p, o: p > o).alias("right")))

    return F.filter(F.array(*[of(level) for level in range(start, start + STRIDE)]), lambda x: x.isNotNull())


def paths(leaves: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Rows (tree, place, path): the path of every leaf of ``leaves`` (tree, place, size) to the top of its tree."""
    above = None
    for start in reversed(range(0, max(levels(most), 1), STRIDE)):
        asking = leaves if start == 0 else nodes.filter(F.col("level") == start)
        asking = asking.select("tree", "place", "size")
        asked = asking.select("tree", "place", F.explode(coordinates(start)).alias("c")).select("tree", "place", F.col("c.level").alias("level"), F.col("c.at").alias("at"))
        known = nodes.filter((F.col("level") >= start) & (F.col("level") < start + STRIDE)).select("tree", "level", F.col("place").alias("at"), "digest")
        found = asked.join(known, ["tree", "level", "at"]).groupBy("tree", "place").agg(F.sort_array(F.collect_list(F.struct("level", "at", "digest"))).alias("_found"))
        path = asking.join(found, ["tree", "place"], "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<level:int,at:bigint,digest:string>>")))
        path = path.select("tree", "place", steps(start).alias("path"))
        if above is not None:
            upper = above.select("tree", F.col("place").alias("_up"), F.col("path").alias("_upper"))
            path = path.withColumn("_up", F.expr(f"place div {FAN**STRIDE}")).join(upper, ["tree", "_up"], "left")
            path = path.select("tree", "place", F.concat("path", F.coalesce("_upper", F.array().cast("array<struct<left:string,right:string>>"))).alias("path"))
        above = path if start == 0 else materialise(path)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The top that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda top, s: F.sha2(F.concat(s["left"], top, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, leaf: str, key: str, source: str) -> DataFrame:
    """``rows`` with leaf, subroot, root and path, one row for each: the tree of every source and the tree over them.

    ``leaf`` names a column of digests. Leaves of a source ascend by ``key`` (null first,
    equal keys by digest); sources ascend by UTF-8 bytes, null first, a source of its own.
    ``path`` lists (left, right): the siblings of the row's leaf, level by level up to the
    root, so ``folded(leaf, path)`` is the root of an untampered leaf. Other columns of
    ``rows`` stay, ones named like a result are replaced. No rows give no rows. All columns
    are sorted and written, so digest texts first and leave them out.
    """
    made = ("leaf", "subroot", "root", "path")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in made]
    keyed = rows.select(F.struct(*kept).alias("row"), F.col(source).cast("string").alias("source"), F.col(key).alias("key"), F.col(leaf).alias("leaf"))
    placed = ranked(keyed, "source", "key", "leaf").withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    sources = ranked(placed.groupBy("source").agg(F.count("*").alias("size"), F.min("rank").alias("first")), "first")
    sources = materialise(sources.withColumnRenamed("rank", "tree"))
    most, trees = (x or 0 for x in sources.agg(F.max("size"), F.count("*")).first())
    placed = join_bounded(placed, sources, ["source"]).withColumn("place", F.col("rank") - F.col("first"))
    placed = materialise(placed.select("row", "leaf", "tree", "place", "size"))

    nodes = grown(placed.select("tree", "place", "size", F.col("leaf").alias("digest")), most)
    tops = nodes.groupBy("tree").agg(F.max(F.struct("level", "digest"))["digest"].alias("subroot"))
    upper = materialise(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("size"), F.col("subroot").alias("digest")))
    top_nodes = grown(upper, trees)
    root = top_nodes.groupBy().agg(F.max(F.struct("level", "digest"))["digest"]).first()[0]
    of_source = paths(upper, top_nodes, trees).select(F.col("place").alias("tree"), F.col("path").alias("_top"))
    of_source = materialise(upper.select(F.col("place").alias("tree"), F.col("digest").alias("subroot")).join(of_source, "tree"))

    out = placed.join(paths(placed, nodes, most), ["tree", "place"])
    out = join_bounded(out, of_source, ["tree"])
    return out.select("row.*", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.concat("path", "_top").alias("path"))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Leaf, proof and check of every document (doc_id, source, lang, n_chars, text) after every second one was tampered with.

    Tampering deletes the line feeds of a text, for documents whose crc32 of the decimal id
    is even; a null text stays, and a row without an id is not tampered with. A row's leaf
    is computed again from what tampering left and folded with the original siblings:
    ``verified`` is false exactly where the text had a line feed to lose. Repeated rows are
    leaves of their own. Other columns are ignored.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    text = F.col("text").cast("string")
    even = F.coalesce(fold(F.col("doc_id"), 2) == 0, F.lit(False))
    after = F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    first = docs.select("doc_id", "source", leaf_digest([*map(F.col, fields), text]).alias("leaf"), leaf_digest([*map(F.col, fields), after]).alias("now"))
    proofs = manifest(first, "leaf", "doc_id", "source")  # digests stand in for the texts from here on
    top = folded(F.col("now"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), top.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
