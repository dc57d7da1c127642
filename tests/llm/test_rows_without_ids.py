"""Rows without an id, or of one id, are documents for themselves."""

import collections

from driftloom.llm.block_naming import exact_copies
from driftloom.llm.ngram_join import drop_near_copies, near_duplicates

SCHEMA = "doc_id long, text string"


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 99999)}" for _ in range(n))


def test_near_copies_among_rows_without_ids_and_of_one_id(spark):
    a, b, c, d = (prose(200, i) for i in range(4))
    near = lambda t: t + " end"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (None, c), (None, c), (None, c), (2, c + " more"), (7, d), (7, prose(200, 9)), (8, prose(200, 9) + " x"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = collections.Counter(map(tuple, drop_near_copies(docs).collect()))
    loose = [t for t in kept if t[1] in (b, near(b))]
    assert len(loose) == 1
    assert kept == collections.Counter([(1, a), *loose, (2, c + " more"), (7, d), (7, prose(200, 9)), (None, ""), (None, None)])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 2), (7, 7), (7, 7), (8, 7)]


def test_repeated_rows_keep_one_of_the_largest_component(spark):
    t = prose(100, 5)
    docs = spark.createDataFrame([(None, t)] * 50 + [(3, prose(100, 6))] * 2, SCHEMA)
    assert sorted(map(str, drop_near_copies(docs).collect())) == sorted(map(str, docs.distinct().collect()))


def test_exactly_one_of_repeated_rows_is_kept(spark):
    docs = spark.createDataFrame([(None, "same text")] * 40 + [(5, "other")] * 3 + [(None, "third")], SCHEMA)
    got = exact_copies(docs).filter("kept").collect()
    assert sorted((r.group_size, r.doc_id or 0) for r in got) == [(1, 0), (3, 5), (40, 0)]
