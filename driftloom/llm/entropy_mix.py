"""Mixing sources to target token weights by entropy balancing.

The mix gives each document a rate r_d, the expected number of its copies. Among all rates
that meet the token constraint of every source (sum of size_d * r_d = target) and are at
most ``most``, it takes those of least relative entropy to one copy of every document.
These are exponentially tilted by size: r_d = min(most, exp(lambda_source * x_d)), where
x_d is the size in units of the source's mean size. The multipliers maximise a concave
dual; a Newton step adds up gradient and curvature of all documents, grouped by source.
Documents of one source and size have one rate, so they are counted by size first.

Rates become whole copies by systematic rounding over documents sorted by size, in parts
of about PART documents. What is then missing or over per source is moved by a greedy
choice among a few documents of each size class. Everything runs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, doc_key, join_bounded, materialise, numbered, ranked, row_hash, text_or_empty

PART = 1024
#: Newton steps end when every source is within this share of its target, or after so many.
TOLERANCE, MOST_STEPS = 1e-8, 60
#: Rates are rounded in units of 2**-UNIT, so that sums of them are exact.
UNIT = 30
#: Candidates of each size class and source for the last correction.
CHOICES = 8
#: What makes a row a document; rows that agree on all of it are interchangeable.
KEY = ["src", "dk", "rh"]


def word_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def source_key() -> Column:
    """Orders sources by code point with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def waterfill(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add ``target`` to (src, source_size, n_docs): shares of ``share`` times all sizes by repeating ``weights``.

    A target is never above ``most`` times its source's size; what that cuts off is shared
    again by weight. All sources then stand at weight * level or at their limit. The sum of
    the targets grows with the level in ever flatter pieces, so Newton steps from below,
    each one aggregation over the sources, meet the level after finitely many.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked(sources, "src").select("src", "source_size", "n_docs", w.alias("w"), (F.col("source_size") * most).alias("limit"))
    total, of_all, limits = t.agg(F.sum("source_size"), F.sum("w"), F.sum("limit")).first()
    budget = share * (total or 0)
    level = budget / of_all if of_all else 0.0
    while of_all and budget < limits:
        full = F.col("limit") <= F.col("w") * level
        at_limit, rest = t.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("w")))).first()
        step = (budget - (at_limit or 0.0)) / rest if rest else level
        if step <= level:
            break
        level = step
    target = F.col("limit") if budget >= (limits or 0) else F.least(F.col("limit"), F.col("w") * level)
    return t.select("src", "source_size", "n_docs", target.alias("target"))


def tilted(lam: Column, x: Column, most: float) -> Column:
    """Rate of a document of relative size ``x`` under multiplier ``lam``."""
    return F.exp(F.least(lam * x, F.log(F.lit(float(most)))))


def newton_step(points: DataFrame, state: DataFrame, most: float, few: bool) -> DataFrame:
    """``state`` (src, goal, lam, lo, hi, done) after one step, which adds up ``points`` (src, n, x) once.

    ``few`` says that the sources are few enough to be broadcast.
    """
    at = state.filter("not done").select("src", "lam")
    rate = tilted(F.col("lam"), F.col("x"), most)
    free = F.col("lam") * F.col("x") < F.log(F.lit(float(most)))
    met = points.join(F.broadcast(at), "src") if few else join_bounded(points, at, ["src"])
    moments = met.groupBy("src").agg(F.sum(F.col("n") * F.col("x") * rate).alias("mass"), F.sum(F.when(free, F.col("n") * F.col("x") * F.col("x") * rate)).alias("curvature"))
    gap = F.col("goal") - F.col("mass")
    lo, hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))
    newton = F.col("lam") + gap / F.col("curvature")
    inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
    outwards = F.col("lam") * 2 + F.signum(gap)
    lam = F.when(inside, newton).when(lo.isNull() | hi.isNull(), outwards).otherwise((lo + hi) / 2)
    done = F.col("done") | (F.abs(gap) <= F.col("goal") * TOLERANCE)
    moments = F.broadcast(moments) if few else moments
    return state.join(moments, "src", "left").select("src", "goal", F.when(done, F.col("lam")).otherwise(lam).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.coalesce(done, F.col("done")).alias("done"))


def multipliers(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Rows (src, lam): the dual's maximum for each source, by Newton steps inside a bracket.

    ``sizes`` has (src, size, n), ``sources`` (src, source_size, n_docs, target). Each step
    is one aggregation: gradient target / mean - sum(n * x * rate), curvature the sum of
    n * x^2 * rate where the rate is under the limit. A step that leaves the bracket is
    replaced by its middle, or by one twice as far out where that side is still open.
    Multipliers are rounded, so that the order of additions does not show. Sources at their limit or without words need no multiplier:
    their rate is the limit everywhere.
    """
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    goal = F.col("target") * F.col("n_docs") / F.col("source_size")
    active = sources.filter((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most))
    points = materialise(join_bounded(sizes.filter("size > 0"), active.select("src", "source_size", "n_docs"), ["src"]).select("src", "n", x.alias("x")))
    unknown = F.lit(None).cast("double")
    state = materialise(active.select("src", goal.alias("goal"), F.lit(0.0).alias("lam"), unknown.alias("lo"), unknown.alias("hi"), F.lit(False).alias("done")))
    few = sources.count() <= 200_000
    for _ in range(MOST_STEPS):
        state = materialise(newton_step(points, state, most, few))
        if state.filter("not done").isEmpty():
            break
    return state.select("src", F.round("lam", 9).alias("lam"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, source): how often the mix takes it.

    Returns doc_id, size (words; null text: 0), source_size, target (its source's), taken
    (size * copies), copies, rate, src, dk, rh, occ. ``weights`` go to the sources by code
    point, null last, repeating. Copies are whole, 0 to ``most`` (rounded up). Sources whose
    documents have no words get target 0. Ties in size are broken by key; rows that repeat
    id, text and source are documents of their own, numbered by ``occ``. An empty table
    gives an empty result; other columns are ignored.
    """
    base = docs.select("doc_id", doc_key().alias("dk"), row_hash().alias("rh"), source_key().alias("src"), word_count().alias("size"))
    base = materialise(base.withColumn("rid", F.monotonically_increasing_id()))
    sizes = materialise(base.groupBy("src", "size").agg(F.count("*").alias("n")))
    sources = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = materialise(waterfill(sources, weights, share, most))
    sources = materialise(sources.join(multipliers(sizes, sources, most), "src", "left"))
    rows = join_bounded(numbered(base, KEY).drop("rid"), sources, ["src"])
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    limit = F.when(F.col("source_size") > 0, F.lit(float(most))).otherwise(1.0)
    rows = rows.withColumn("rate", F.when(F.col("lam").isNull(), limit).otherwise(tilted(F.col("lam"), x, most)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("dk", "rh", "occ"), F.greatest(F.lit(1), F.floor(F.col("n_docs") / PART))))
    whole = F.lit(1 << UNIT)
    in_part = W.partitionBy("src", "part").orderBy(F.desc("size"), "dk", "rh", "occ").rowsBetween(W.unboundedPreceding, 0)
    units = F.round(F.col("rate") * whole).cast("long")
    upto = F.sum("units").over(in_part) + F.pmod(F.xxhash64("src", "part"), whole)
    floor = lambda v: F.shiftright(v, UNIT)
    copies = F.least(floor(F.col("upto")) - floor(F.col("upto") - F.col("units")), F.lit(-int(-most // 1)))
    rounded = rows.withColumn("units", units).withColumn("upto", upto).withColumn("copies", copies)
    rounded = materialise(rounded.select("doc_id", *KEY, "occ", "size", "source_size", "target", "rate", "copies"))

    mixed = rounded.join(corrections(rounded, most), [*KEY, "occ"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *KEY, "occ")


def corrections(rounded: DataFrame, most: float) -> DataFrame:
    """Rows (src, dk, rh, occ, change of copies): at most 2 * CHOICES documents of each size class and source.

    Each may gain a copy, if it has less than ``most``, or lose one, if it has any. A greedy
    pass from large to small makes every such change that brings its source nearer to the
    target, so what remains is about the size of a small document.
    """
    gap = rounded.groupBy("src").agg(F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("gap"))
    kind = F.floor(F.log2(F.col("size"))).cast("int")
    pick = F.struct(F.xxhash64("dk", "rh", "occ").alias("h"), "dk", "rh", "occ", "size")
    options = rounded.filter("size > 0").select("src", kind.alias("kind"), pick.alias("d"), (F.col("copies") + 1 <= int(most)).alias("more"), (F.col("copies") > 0).alias("less"))
    best = options.groupBy("src", "kind", F.pmod("d.h", F.lit(CHOICES)).alias("of")).agg(F.max(F.when(F.col("more"), F.col("d"))).alias("up"), F.max(F.when(F.col("less"), F.col("d"))).alias("down"))
    move = lambda d, sign: F.struct(d["size"].alias("size"), F.lit(sign).cast("long").alias("change"), d["dk"].alias("dk"), d["rh"].alias("rh"), d["occ"].alias("occ"))
    moves = best.select("src", F.explode(F.array(move(F.col("up"), 1), move(F.col("down"), -1))).alias("m")).filter("m.size is not null")
    lists = moves.groupBy("src").agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms")).join(gap, "src")
    empty = F.filter("ms", lambda m: F.lit(False))

    def take(acc: Column, m: Column) -> Column:
        left = acc["left"] - m["change"] * m["size"]
        better = F.abs(left) < F.abs(acc["left"])
        return F.struct(F.when(better, left).otherwise(acc["left"]).alias("left"), F.when(better, F.concat(acc["taken"], F.array(m))).otherwise(acc["taken"]).alias("taken"))

    taken = F.aggregate("ms", F.struct(F.col("gap").alias("left"), empty.alias("taken")), take)["taken"]
    return lists.select("src", F.explode(taken).alias("m")).groupBy("src", "m.dk", "m.rh", "m.occ").agg(F.sum("m.change").alias("change"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it has copies, columns as they were.

    Of rows that repeat id, text and source, which one has which number of copies is not
    defined.
    """
    plan = materialise(mix(docs, weights, share, most).select(*KEY, "occ", F.col("copies").cast("int").alias("copies")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, source_key().alias("src"), doc_key().alias("dk"), row_hash().alias("rh"))
    several = plan.filter("occ > 0").select(*KEY).distinct()
    taken = plan.filter("copies > 0")
    if several.isEmpty():
        out = keyed.join(taken.drop("occ"), KEY)
    else:
        several = materialise(several)
        out = keyed.join(several, KEY, "left_anti").join(taken.drop("occ"), KEY).select("row", "copies")
        repeated = materialise(keyed.join(several, KEY, "left_semi").withColumn("rid", F.monotonically_increasing_id()))
        out = out.unionByName(numbered(repeated, KEY).join(taken, [*KEY, "occ"]).select("row", "copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
