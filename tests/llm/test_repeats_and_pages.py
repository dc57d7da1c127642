"""Repeated spans by row identity, the mix of repeated rows, pages of any form, and exact token ids."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import entropy_mix, html_extraction, queries
from driftloom.llm.entropy_mix import apply_mix, mix
from driftloom.llm.substring_dedup import chunk_ends, repeated_spans, without_repeats
from driftloom.llm.vector_packing import END, fill_rate, pack, token_ids


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 99999)}" for _ in range(n))


def brute_spans(texts, span):
    """Runs of repeated chunks of all texts, {key: text}, by plain dictionaries."""
    places, cut = collections.defaultdict(list), {}
    for key in sorted(texts):
        raw = texts[key].encode()
        ends = chunk_ends(np.frombuffer(raw, np.uint8))
        cut[key] = list(zip([0, *ends], ends, strict=False))
        for i, (a, b) in enumerate(cut[key]):
            places[raw[a:b]].append((key, i))
    out = set()
    for key, edges in cut.items():
        raw, run = texts[key].encode(), []
        for i, (a, b) in enumerate([*edges, (None, None)]):
            if a is not None and len(places[raw[a:b]]) > 1:
                run.append((a, b, places[raw[a:b]][0] == (key, i)))
                continue
            if run and run[-1][1] - run[0][0] >= span:
                flags = []
                for a, b, first in run:
                    if flags and flags[-1][2] == first:
                        flags[-1][1] = b
                    else:
                        flags.append([a, b, first])
                merged = []
                for a, b, first in flags:
                    first = first or b - a < span
                    if merged and merged[-1][2] == first:
                        merged[-1][1] = b
                    else:
                        merged.append([a, b, first])
                out |= {(key, a, b - a, first) for a, b, first in merged if not first or b - a >= span}
            run = []
    return out


def test_spans_against_brute_force(spark):
    passages = [prose(40, 70 + i) for i in range(5)]
    r = random.Random(4)
    texts = {i: " ".join([prose(30, i), *r.sample(passages, r.randint(0, 3)), prose(20, 1000 + i), *r.sample(passages, r.randint(0, 2))]) for i in range(60)}
    got = repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 120).collect()
    assert {(x.doc_id, x.start, x.length, x.kept) for x in got} == brute_spans(texts, 120)


def test_a_passage_twice_in_one_text(spark):
    p = prose(60, 1)
    docs = spark.createDataFrame([(1, f"{prose(40, 2)} {p} {prose(40, 3)} {p} {prose(40, 4)}")], "doc_id long, text string")
    spans = sorted(repeated_spans(docs).collect(), key=lambda x: x.start)
    assert [x.kept for x in spans] == [True, False] and all(x.length > 200 and x.first_doc_id == 1 for x in spans)
    assert without_repeats(docs, repeated_spans(docs)).first().text.count(p[100:200]) == 1


def test_rows_without_an_id_lose_only_what_they_repeat(spark):
    p, clean = prose(60, 1), prose(150, 9)
    rows = [(None, f"{prose(40, 2)} {p}"), (None, clean), (None, f"{p} {prose(50, 3)}"), (7, prose(80, 5)), (7, f"{p} {prose(90, 6)}"), (8, prose(10, 8)), (8, prose(10, 8)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [x.text for x in without_repeats(docs, repeated_spans(docs)).collect()]
    assert len(out) == len(rows) and clean in out and prose(80, 5) in out and out.count(prose(10, 8)) == 2
    assert sum(p[100:250] in (t or "") for t in out) == 1 and sum(len(t or "") for t in out) > sum(len(t or "") for _, t in rows) - 2 * len(p)


# the mix


def mixed_rows(spark):
    rows = [(5, "a b c " * 50, "x")] * 40 + [(5, "a b c " * 50, "y")] * 30 + [(None, "q w " * 20, "x")] * 10 + [(i, "w " * (i % 90), "xyz"[i % 3]) for i in range(500)] + [(None, None, None)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_repeated_rows_are_changed_one_by_one(spark):
    docs = mixed_rows(spark)
    got = mix(docs).toPandas()
    assert (got["taken"] >= 0).all() and (got["taken"] <= 2 * got["size"]).all() and len(got) == docs.count()
    by = got.groupby("src").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 3).all()
    copies = collections.Counter()
    for r in got.itertuples():
        copies[r.src, r.dk, r.rh] += r.copies
    out = apply_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(copies.values())
    again = collections.Counter(map(tuple, apply_mix(docs).collect()))
    assert again == collections.Counter(map(tuple, out.collect()))


def test_rates_are_optimal_tilts_by_size(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + (i * 13) % 200), f"s{i % 4}") for i in range(800)], "doc_id long, text string, source string")
    got = mix(docs).toPandas()
    for _, g in got.groupby("src"):
        expected = (g["rate"] * g["size"]).sum()
        assert abs(expected - g["target"].iloc[0]) < 1e-5 * expected  # the dual's gradient is zero
        free = g[(g["rate"] < 2 - 1e-9) & (g["size"] > 0)]
        if len(free):  # log rates are proportional to size
            slope = np.log(free["rate"]) / free["size"]
            assert slope.std() < 1e-6 and (g["rate"] <= 2 + 1e-12).all()
    assert got.groupby("src")["rate"].nunique().max() == 50  # as many as sizes


def test_targets_of_many_sources_stay_a_water_level(spark):
    sources = spark.range(2000).selectExpr("concat('0', lpad(id, 6, '0')) src", "(id * id * 7919) % 1000 + 1 source_size", "3L n_docs")
    got = entropy_mix.waterfill(sources, (3.0, 1.0, 2.0), 1.5, 2.0).toPandas().sort_values("src")
    w = np.tile([3.0, 1.0, 2.0], 667)[:2000]
    size = got["source_size"].to_numpy()
    level = (got["target"] / w)[got["target"] < 2 * size - 1e-9]
    assert abs(got["target"].sum() - 1.5 * size.sum()) < 1e-6 * size.sum() and level.std() < 1e-9 and (got["target"] <= 2 * size).all()
    assert (2 * size[got["target"] >= 2 * size - 1e-9] / w[got["target"] >= 2 * size - 1e-9] <= level.max() + 1e-9).all()


# pages


@pytest.mark.parametrize("piece", ["<a ", "<div>x ", "<p '", "<p x='y", '<p a="', "</p>", "<li>", "<!", "</", "<table><td>x", "<div class=a>x", "&", "<script>"])
def test_hostile_pages_take_time_in_proportion(piece):
    model = html_extraction.train(html_extraction.labelled_pages(40, seed=1), steps=5)
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        model.extract("<div>" * 600 + piece * n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0] + 0.5


def test_references_and_depth_never_fail():
    assert html_extraction.blocks("<p>&#" + "9" * 10_000 + "; &#x41;&bogus; b")[0].text == "� A&bogus; b"
    found = html_extraction.blocks("<div>" * 2000 + "in" + "</div>" * 2000 + "<p>out")
    assert [b.text for b in found] == ["in", "out"]
    assert [b.text for b in html_extraction.blocks("a < b <c d <p>e</p> </ x> f")] == ["a < b", "e", "f"]


# packing


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "it's 123\n\n  x y", "漢字👍🏽 ñ", "a" * 3000, "\r\n\t \x00"])
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    assert token_ids(text, path).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, END]


def test_random_texts_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    path, r = queries.vocabulary_path(), random.Random(1)
    tokenizer, parts = Tokenizer.from_file(path), ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "It's", "漢", "é", " ", " ", "\x85", "12", "!!", "👍🏽", "\r\n", "ſ", "'S", "​", "﻿", "\x1c"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert token_ids(t, path).tolist()[:-1] == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tails_of_groups_are_packed_together(spark, sf_dir, monkeypatch):
    from driftloom.llm import vector_packing

    monkeypatch.setattr(vector_packing, "GROUP_DOCS", 20)
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.vocabulary_path()
    packed = pack(docs, path)
    rows = packed.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    whole = fill_rate(packed).first()
    monkeypatch.setattr(vector_packing, "FULL", 0.0)
    assert whole.fill_rate > fill_rate(pack(docs, path)).first().fill_rate and whole.fill_rate > 0.93
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 and [o for o, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]] for v in by.values())


def test_capacities_bind_when_they_are_small(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', int(id % 40))").alias("text"))
    path = queries.vocabulary_path()
    rows = pack(docs, path, length=256, most_docs=5, most_cost=20_000).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r.length)
    assert all(sum(v) <= 256 and len(v) <= 5 and (sum(x * x for x in v) <= 20_000 or len(v) == 1) for v in by.values())
    assert len(by) > len({r.sequence_id for r in pack(docs, path, length=256).collect()})
