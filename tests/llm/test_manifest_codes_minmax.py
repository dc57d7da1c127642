"""Merkle manifests, vector codes and min-max near duplicates against plain Python, and repaired edge cases."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import merkle, minmax, quality, queries, toxicity
from driftloom.llm.html_extraction import blocks
from driftloom.llm.ngram_join import near_duplicates as joined
from driftloom.llm.substring_dedup import chunk_ends
from driftloom.llm.vector_codes import compress
from driftloom.llm.vector_packing import token_ids

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, row int, rank int"


@pytest.mark.parametrize("name", ["op11_merkle_lookup", "op12_weighted_codes", "op13_minmax_near", "op8_ngram_join"])
def test_queries_give_the_rows_of_their_sql(spark, duck, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def run_up(row):
    """All levels over a row of digests."""
    out = [row]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        g = i // 3 * 3
        out.append(("".join(level[g:i]), "".join(level[i + 1 : g + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    leaves = [H(*(enc(v) for v in r)) for r in rows]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])) for s in sources}
    trees = {s: run_up([leaves[i] for i in order[s]]) for s in sources}
    top = run_up([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for place, i in enumerate(order[s]):
            steps = path(trees[s], place) + path(top, at)
            r = list(rows[i])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                r[4] = r[4].replace("\n", "")
            now = H(*(enc(v) for v in r))
            for left, right in steps:
                now = H(left, now, right)
            out.append((r[0], leaves[i], trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_against_a_plain_tree(spark):
    r = random.Random(3)
    rows = [(i if i % 11 else None, r.choice(["a", "b", "é", None, "a", "a"]), None if i % 7 == 0 else "en", i if i % 5 else None, r.choice([None, "", "x\ny", "漢字\n\n", f"t{i}"])) for i in range(900)]
    rows += [(5000, "lone", "en", 1, "\n"), (7, "a", "en", 3, "x\ny"), (7, "a", "en", 3, "x\ny")]
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], DOCS)
    got = merkle.verify_tampered(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


def test_manifest_of_a_deep_tree_passes_block_edges(spark):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(2300)]  # more than three blocks of 729
    df = spark.createDataFrame([(*x, None, None, None) for x in rows], DOCS)
    got = merkle.verify_tampered(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert sum(not r.verified for r in got) == sum(zlib.crc32(str(i).encode()) % 2 == 0 for i in range(2300))


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.verify_tampered(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS)
    row = merkle.verify_tampered(df).first()
    assert row.leaf == row.root == row.subroot == row.folded_root == H("1:1", "-", "-", "-", "-") and row.proof_sha256 == H("") and row.verified


def plain_codes(rows, parts=16):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(2):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in kept:
                own[near(cut(v, p), book)[1]].append(cut(v, p))
            new.append([tuple(sum(c) // len(c) for c in zip(*m, strict=True)) if m else e for m, e in zip(own, book, strict=True)])
        books = new
    digest = H(",".join(str(x) for book in books for e in book for x in e))
    out, total = [], {}
    for i, v, label in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(g for g, _ in got)
        total[label] = total.get(label, 0) + error
        out.append([i, "".join(f"{j:02x}" for _, j in got), error, label])
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, x int, rid string"


def test_codes_against_plain_lloyd(spark):
    r = np.random.default_rng(4)
    f32 = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]
    rows = [(i, f32(r.normal(0, 1, 32)), int(i % 4) if i % 9 else None) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(200)]  # a vector that many rows have
    rows += [(None, rows[6][1], None), (2, rows[7][1], 2), (2, f32(r.normal(0, 1, 20)), 2), (9000, None, 1), (9001, [1.0, None], 1), (9002, [float("nan")] * 32, 1), (9003, [float("inf")] * 32, None), (9004, [], 3), (9005, f32([3e4] * 32), 3)]
    got = compress(spark.createDataFrame([(*x, 1, "r") for x in rows], VECTORS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_codes(rows)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e15])
def test_codes_of_large_components_are_exact(spark, size):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.uniform(-size, size, 16)], i % 2) for i in range(80)]
    got = compress(spark.createDataFrame([(*x, 1, "r") for x in rows], VECTORS.replace("array<float>", "array<double>"))).collect()
    want = [(i, c, min(e, 2**63 - 1), t if t < 2**63 else None, d) for i, c, e, t, d in plain_codes(rows)]
    assert sorted([(x[0], x[1], x[4]) for x in map(tuple, got)], key=str) == sorted([(x[0], x[1], x[4]) for x in want], key=str)
    if size < 1e9:
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1, 1, "r")], VECTORS)
    assert compress(df).count() == 0 and compress(df.limit(0)).count() == 0


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_near(rows, k, percent):
    s = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), math.inf), math.inf if doc is None else doc)
    return sorted(((doc, len(s[i]), None if least[root(i)] == math.inf else least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str), len({root(i) for i in range(len(rows))})


def edited(words, r, share):
    return [r.choice("aeiou") + str(r.randint(0, 10**6)) if r.random() < share else w for w in words]


def hostile(seed, families=6, size=30):
    """Families around the threshold, whose members differ from their base by a share of words, with shared edits too."""
    r, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{r.randint(0, 500)}" for _ in range(r.randint(30, 120))]
        twist = edited(base, r, 0.06)
        for _ in range(size):
            rows.append((len(rows), " ".join(edited(r.choice([base, twist]), r, r.choice([0.01, 0.04, 0.06, 0.1])))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE"), (None, "one"), (len(rows) + 6, rows[0][1]), (None, rows[0][1]), (0, rows[0][1]), (3, "x" * 9000), (len(rows) + 9, "é ß 漢字 " * 50)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_minmax_finds_every_link(spark, seed):
    rows = hostile(seed)
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, node string")
    got = minmax.near_duplicates(df, 2, 80).collect()
    want, components = plain_near(rows, 2, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert sum(r.kept for r in got) == components


def test_minmax_of_nothing(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2, 80).count() == 0


def test_min_and_max_estimate_the_likeness_without_bias():
    r = np.random.default_rng(8)
    errors = []
    for _ in range(60):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        s, t = minmax.signature(np.concatenate([both, a])), minmax.signature(np.concatenate([both, b]))
        errors.append((s == t).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.03


def test_words_that_a_polynomial_confuses_are_not_linked(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    for f in (lambda: joined(df, 4, 85), lambda: minmax.near_duplicates(df, 2, 80)):
        assert {r.component_id for r in f().collect()} == {1, 2}


@pytest.mark.parametrize("text", [" " * 50_000, "a" + "\n" * 30_000 + "b", "x" + " \t" * 20_000 + "<|endoftext|>" + " " * 20_000, "　" * 15_000 + " y", "q" * 50_000, " " * 9_999 + "z"])
def test_long_runs_have_the_ids_of_the_tokenizer(text):
    import tokenizers

    path_ = queries.vocabulary_path()
    assert token_ids(text, path_)[:-1].tolist() == tokenizers.Tokenizer.from_file(path_).encode(text, add_special_tokens=False).ids


def test_very_long_white_space_is_encoded():
    for c in (" ", "\n", "\t"):
        assert len(token_ids(c * 10**6 + "end", queries.vocabulary_path())) > 1


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>t</title><article><p>Text of it.</p></article>", ["Text of it."]),
    ("<head><title>t</title>Text <b>of</b> it.", ["Text of it."]),
    ("<body><noscript><p>Shown.</p><p>And this.</p>", ["Shown.", "And this."]),
    ("<body><noscript>hidden</noscript><p>Shown.</p>", ["Shown."]),
    ("<head><title>t</title><noscript><link></noscript><meta><div>Body.</div>", ["Body."]),
])
def test_omitted_tags_do_not_hide_the_page(page, want):
    assert [b.text for b in blocks(page)] == want


def test_chunks_have_whole_characters():
    r = random.Random(1)
    for _ in range(200):
        raw = "".join(r.choice("абвгдежзиклмнопрст漢字👍ab ") for _ in range(400)).encode()
        ends = chunk_ends(np.frombuffer(raw, np.uint8))
        assert ends[-1] == len(raw) and all(e == len(raw) or raw[e] & 0xC0 != 0x80 for e in ends)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    docs = spark.range(4000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, toxic int, quality int")
    seen = []
    sets = toxicity._word_sets
    monkeypatch.setattr(toxicity, "_word_sets", lambda t: seen.append(sets(t)) or seen[-1])
    toxicity.train(docs, labels, F.lit(True), most_positive=10, most_unlabelled=50)
    assert len(seen[0]) == 2 and 20 <= len(seen[1]) <= 100
    assert len(quality.train(docs, labels, F.lit(True), most_labelled=10).labels) == 4


def test_links_by_differences_equal_all_pairs(spark):
    """A family around one middle, with members on both sides of the threshold: links through rarest differences against all pairs."""
    import random

    from driftloom.llm.minmax import by_differences

    rng = random.Random(4)
    middle = set(range(0, 200, 2))
    sets = {}
    for node in range(1, 90):
        s = set(middle) if node < 60 else set(sets[rng.randrange(1, node)])
        for x in rng.sample(sorted(s), rng.randrange(0, 22)):
            s.remove(x)
        sets[node] = s | {1000 * node + 2 * i for i in range(rng.randrange(0, 12))} | set(rng.sample(range(5000, 5080, 2), rng.randrange(0, 14)))
    rows = []
    for node, s in sets.items():
        same = len(s & middle)
        union = len(s | middle)
        rows.append((node, 0, len(s), 100, 100 * same >= 80 * union, 1 - same / union, sorted(s - middle) + [x + 1 for x in middle - s]))
    first = spark.createDataFrame(rows, "u long, v long, nu long, nv long, alike boolean, dist double, diff array<long>")
    apart = spark.createDataFrame([], "node long, component long")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in by_differences(first, apart, 80).collect()}
    sets[0] = middle

    def linked(a, b):
        return 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])

    def classes(pairs):
        of = {n: n for n in sets}

        def top(n):
            while of[n] != n:
                n = of[n]
            return n

        for a, b in pairs:
            of[max(top(a), top(b))] = min(top(a), top(b))
        return {n: top(n) for n in sets}

    every = {(a, b) for a in sets for b in sets if a < b and linked(a, b)}
    assert got <= every and sum(not r[4] for r in rows) > 20
    assert classes(got) == classes(every) and len(every - got) > 0
