"""Corpus operators against brute force and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import bottomk, html_extraction, language_id, queries, quality, toxicity
from driftloom.llm.block_naming import drop_exact_copies, exact_copies
from driftloom.llm.components import components
from driftloom.llm.entropy_mix import apply_mix, mix
from driftloom.llm.features import word_hashes
from driftloom.llm.ngram_join import drop_near_copies, near_duplicates
from driftloom.llm.substring_dedup import chunk_ends, repeated_spans, without_repeats
from driftloom.llm.vector_packing import END, best_fit, pack, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, _dk string, salt int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 9999)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    long = prose(9000, 1)
    near = prose(300, 2)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (6, "a  b\tc"), (7, "a b c"), (8, long), (9, long), (10, long + " end"), (11, near), (12, near.replace("alpha", "omega", 1)), (13, "é ß 漢字 👍 " * 40), (14, "0123 456"), (15, "ALPHA beta"), (16, "alpha BETA"), (None, "a b c"), (17, "x" * 5000), (18, near[:900] + " " + prose(200, 3))]
    rows = docs_of(spark, texts)
    return rows.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in SPACE.split(t or "") if w]


# exact copies


def test_exact_copies_against_brute_force(spark, awkward):
    got = exact_copies(awkward, block_bytes=64).collect()
    rows = [(r.doc_id, SPACE.sub(" ", r.text or "")) for r in awkward.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted(str((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in rows)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert {r.doc_id for r in got if r.kept} == {min(x for x in g if x is not None) for g in groups.values()}


def test_block_size_does_not_matter(spark, awkward):
    a, b = (sorted(map(str, exact_copies(awkward, n).select("doc_id", "keep_id", "group_size").collect())) for n in (7, 2048))
    assert a == b


def test_hot_blocks_are_spread_and_still_equal(spark):
    texts = [(i, "same text " * 30 if i % 3 else f"text {i} " + "same text " * 30) for i in range(600)]
    got = exact_copies(docs_of(spark, texts), 32)
    sizes = collections.Counter(r.group_size for r in got.collect())
    assert sizes == {400: 400, 1: 200}


def test_drop_exact_copies_keeps_columns_and_one_of_each(spark, awkward):
    kept = drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 6: 1, 8: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 15: 1, 16: 1, 17: 1, 18: 1} | {3: 1}


def test_exact_copies_of_nothing(spark):
    assert exact_copies(empty(spark)).count() == 0 and drop_exact_copies(empty(spark)).count() == 0


# mixing


def targets(sizes, share=1.5, most=2.0):
    """Targets by resharing what limits cut off until nothing is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, budget, left = {}, share * sum(sizes.values()), set(order)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: budget * weight[s] / total for s in left}
            break
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            left.remove(s)
    return out


def test_mix_targets_and_what_is_taken(spark):
    texts = [(i, prose(5 + (i * 37) % 200, i)) for i in range(400)]
    docs = docs_of(spark, texts)
    source = {r.doc_id: r.source for r in docs.collect()}
    got = mix(docs).collect()
    sizes = collections.Counter()
    for i, t in texts:
        sizes[source[i]] += len(words(t))
    want = targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.size == len(words(dict(texts)[r.doc_id])) and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(10, 0.002 * want[s]) for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs).collect()))


def test_apply_mix_repeats_rows(spark):
    docs = docs_of(spark, [(i, prose(20 + i % 50, i)) for i in range(90)])
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = apply_mix(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {i: c for i, c in copies.items() if c}


def test_mix_of_awkward_rows(spark, awkward):
    got = mix(awkward).collect()
    assert len(got) == awkward.count() and all(r.taken <= 2 * r.size for r in got)
    assert mix(empty(spark)).count() == 0 and apply_mix(empty(spark)).count() == 0
    assert mix(docs_of(spark, [(1, None), (2, "")])).filter("taken = 0 and target = 0").count() == 2


# fingerprints


def shingles(t, k):
    w = words(t)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark):
    texts = [(i * 3, prose(20 + 25 * (i % 9), i % 5)) for i in range(60)] + [(1000, None), (1001, ""), (1002, "é漢👍 a b c d e f g h")]
    got = {r.doc_id: r for r in bottomk.fingerprints(docs_of(spark, texts)).collect()}
    prints = collections.defaultdict(set)
    for at, (i, t) in enumerate(texts):
        t, after, r = t or "", texts[(at + 1) % len(texts)][1] or "", got[i]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(t, 5), shingles(edited, 5))) < 0.15
        assert abs(r.near_next - jaccard(shingles(t, 5), shingles(after, 5))) < 0.15
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "RANGE_DOCS", 5)
    ids = [3, 1, 4, 15, 9, 26, 5, 35, 8, 97, 93, 23, 84, 62, 64, 33, 83, 27, 95, 2, 88, 41, 97_000, -7]
    got = {r.doc_id: r.next_text for r in bottomk.with_next(docs_of(spark, [(i, str(i)) for i in ids])).collect()}
    ordered = sorted(ids)
    assert got == {a: str(b) for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def test_sketches_merge_and_estimate(spark):
    a, b = prose(900, 5), prose(900, 6)
    both = a + " " + b
    s = spark.createDataFrame([(a, b, both)], "a string, b string, c string").select(*[bottomk.sketch(F.col(c)).alias(c) for c in "abc"])
    row = s.select(bottomk.resemblance(F.col("c"), bottomk.merge(F.col("a"), F.col("b"))).alias("same"), bottomk.containment(F.col("a"), F.col("c")).alias("inside"), bottomk.distinct_count(F.col("c")).alias("n"), (bottomk.unspell(bottomk.spell(F.col("a"))) == F.col("a")).alias("round")).first()
    assert row.same > 0.97 and row.inside > 0.85 and abs(row.n - len(shingles(both, 5))) < 0.2 * len(shingles(both, 5)) and row.round


def test_fingerprints_of_awkward_rows(spark, awkward):
    assert bottomk.fingerprints(awkward).count() == awkward.count()
    assert bottomk.fingerprints(empty(spark)).count() == 0
    assert bottomk.fingerprints(docs_of(spark, [(1, "one two")])).first().near_next == 1.0


# near copies


def union_find(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent, monkeypatch):
    from driftloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FAMILY", 6)
    r = random.Random(k)
    texts = []
    for family in range(6):
        base = prose(120, 100 + family).split(" ")
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 999)}"
            texts.append(" ".join(w))
    passage = prose(60, 7)
    texts += [passage + " " + prose(60, 200 + i) for i in range(20)] + ["one", "ONE", "one two", "", None, "a b c", "a b c d e"]
    texts = list(enumerate(texts))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {i: shingles((t or "").translate(low), k) for i, t in texts}
    got = {x.doc_id: x for x in near_duplicates(docs_of(spark, texts), k, percent).collect()}
    assert {i: x.component_id for i, x in got.items()} == union_find(sets, percent)
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = near_duplicates(awkward, 4, 85).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[9] == 8 and by_id[10] == 8 and by_id[12] == 11 and by_id[16] == 15 and by_id[1] == 1 and by_id[3] == 3
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns and {8, 11, 15, 1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_components_of_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {200: 200, 300: 200}


def test_word_hashes_split_at_ascii_space_only():
    a = word_hashes("Ab\tcd e \x0b ab".encode())
    assert len(a) == 3 and a[0] == a[2] and a[0] != a[1]
    long = ("wörter " * 400_000).encode()
    assert len(word_hashes(long)) == 400_000 and len(np.unique(word_hashes(long))) == 1


# substring dedup


def test_chunks_resynchronise_after_an_insertion():
    a = prose(400, 8).encode()
    b = a[:50] + b"inserted words " + a[50:]
    cut = lambda x: {x[i:j] for i, j in zip([0, *chunk_ends(np.frombuffer(x, np.uint8))], chunk_ends(np.frombuffer(x, np.uint8)))}
    assert len(cut(a) & cut(b)) > 0.9 * len(cut(a))
    assert chunk_ends(np.frombuffer(b"", np.uint8)) == [] and chunk_ends(np.zeros(2000, np.uint8))[-1] == 2000


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    passages = [prose(60, 900 + i) for i in range(8)]
    texts = [(i, f"{prose(80, i)} {passages[i % 8]} {prose(50, 500 + i)}" if i < 40 else prose(150, i)) for i in range(80)]
    docs = docs_of(spark, texts)
    spans = repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == set(range(40))
    for r in spans:
        assert dict(texts)[r.doc_id][r.start : r.start + r.length - 40] in dict(texts)[r.first_doc_id] and r.kept == (r.doc_id < 8)
    out = {r.doc_id: r.text for r in without_repeats(docs, repeated_spans(docs)).collect()}
    assert all(out[i] == t for i, t in texts if i < 8 or i >= 40) and all(len(out[i]) < len(t) for i, t in texts if 8 <= i < 40)


def test_repeats_of_awkward_rows(spark, awkward):
    found = {r.doc_id for r in repeated_spans(awkward).collect()}
    assert {8, 9, 10, 11, 12, 18} <= found and not found & {1, 2, 3, 4, 14}
    assert repeated_spans(empty(spark)).count() == 0
    assert without_repeats(awkward, repeated_spans(awkward)).count() == awkward.count()


# packing


def test_pieces_round_trip_through_the_tokenizer(spark, awkward):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    rows = pack(awkward, path).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in zip(s, s[1:])) and sum(r.length for r in s) <= 1024
    expected = collections.Counter()
    for d in awkward.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, END], dtype="<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        expected.update((d.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected


@pytest.mark.parametrize("text", ["<|endoftext|> a", "it's 123\n\n  x y", "漢字👍🏽 ñ", "a" * 3000, "\r\n\t \x00"])
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    assert token_ids(text, queries.vocabulary_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, END]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    sizes = np.sort(np.random.default_rng(1).integers(1, 200, 400))[::-1]
    bins, offsets = best_fit(sizes, (256, 4, 30_000), (1.0, 0.3, 0.3), rule)
    for b in set(bins.tolist()):
        own = sizes[bins == b]
        assert own.sum() <= 256 and len(own) <= 4 and ((own.astype(float) ** 2).sum() <= 30_000 or len(own) == 1)
    free, _ = best_fit(sizes, (256, 1000, 10**9), (1.0, 0.0, 0.0), rule)
    assert len(set(free.tolist())) <= 1.03 * sizes.sum() / 256 + 1


def test_pack_nothing(spark):
    assert pack(empty(spark), queries.vocabulary_path()).count() == 0


# classifiers


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = int(labels.sum())
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark, larger):
    got = queries.op6_centroid_language(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet"), "doc_id")
    held = got.filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


@pytest.mark.parametrize("name,label,least", [("op3_toxicity_nnpu", "toxic", 0.85), ("op9_quality_neighbours", "quality", 0.9)])
def test_scores_on_held_out_documents(spark, larger, name, label, least):
    got = queries.queries()[name](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(got[label].to_numpy(), got["score"].to_numpy()) > least and got["score"].between(0, 1).all()


def test_languages_of_awkward_rows(spark, awkward):
    model = language_id.train(awkward, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(awkward.select("doc_id", "text"), model).collect()}
    assert got[1] == got[2] == got[14] == "und" and got[11] == "en"
    nothing = language_id.train(empty(spark), F.lit(True))
    assert language_id.predict(awkward.select("doc_id", "text"), nothing).filter("lang_pred = 'und'").count() == awkward.count()


def test_classifiers_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 0, 1), (8, 1, 0), (11, None, None), (None, 1, 1), (13, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (toxicity, quality):
        for known in (labels, none):
            got = module.score(awkward.select("doc_id", "text"), module.train(awkward, known, F.lit(True)))
            assert got.filter("score between 0 and 1").count() == awkward.count()
        assert module.score(empty(spark).select("doc_id", "text"), module.train(empty(spark), none, F.lit(True))).count() == 0


def test_nnpu_recovers_positives_from_unlabelled_texts():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    signal = rng.random((4000, 12)) < np.where(truth[:, None], 0.5, 0.05)
    signal = np.concatenate([signal, rng.random((4000, 20)) < 0.3], axis=1)
    known = np.flatnonzero(truth)[:200]
    as_presence = lambda x: toxicity.Presence(*np.nonzero(x), x.shape)
    w, b = toxicity.fit_nnpu(as_presence(signal[known]), as_presence(signal), 0.2)
    predicted = signal @ w + b > 0
    assert (predicted == truth).mean() > 0.95


# HTML


def test_extraction_of_generated_pages_not_seen_before():
    model = html_extraction.train()
    right = wrong = missed = 0
    for page in html_extraction.labelled_pages(150, seed=4242):
        found = html_extraction.blocks(page)
        for b, y in zip(found, model.viterbi(model.scores(found)), strict=True):
            right, wrong, missed = right + (y == b.main == 1), wrong + (y > b.main), missed + (y < b.main)
    assert wrong < 0.03 * right and missed < 0.03 * right


def test_viterbi_is_the_best_of_all_labelings():
    import itertools

    rng = np.random.default_rng(5)
    for n in range(1, 7):
        f = html_extraction.Field({}, rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
        s = rng.normal(size=n).tolist()

        def total(y, f=f, s=s):
            return f.first[y[0]] + f.last[y[-1]] + sum(a * b for a, b in zip(s, y)) + sum(f.moves[a][b] for a, b in zip(y, y[1:]))

        assert tuple(f.viterbi(s)) == max(itertools.product((0, 1), repeat=n), key=total)


def test_blocks_of_broken_markup():
    page = "<p>One &amp; two<p>three<br>four <b>five</b><script>x='<p>'</script><!-- no --><li>a<li>b</ul></div>&nbsp;six &lt;7&gt;"
    assert [b.text for b in html_extraction.blocks(page)] == ["One & two", "three four five", "a", "b", "six <7>"]
    assert html_extraction.blocks("") == [] and html_extraction.blocks("<<<>") != None  # noqa: E711


def test_extract_of_pages_and_awkward_rows(spark, sf_dir):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title here</h1><p>Some  text\nof it, long enough.</p><p>More.</p></article><footer>&copy; x</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 5, "t"), (2, None, None, None, None), (3, "w", "", 1, ""), (3, "w", "", 1, "")], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(rows).collect()}
    assert got == {1: ("Title here\nSome text of it, long enough.\nMore.", 46), 2: ("", 0), 3: ("", 0)}
    assert html_extraction.extract(rows.limit(0)).count() == 0
    pages = queries.op10_html_crf(spark, sf_dir)
    assert pages.count() == pages.filter("n_chars > 0").count()
