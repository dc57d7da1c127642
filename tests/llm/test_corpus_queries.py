"""The registered corpus queries and the pipeline."""

import collections

import corpus_pipeline
from driftloom.llm import queries


def test_op4_gives_the_rows_of_its_sql(spark, duck, sf_dir):
    got = queries.op4_block_naming(spark, sf_dir).toPandas()
    want = duck.execute(queries.OP4_SQL).df()
    columns = sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def test_op2_sizes_and_targets_are_those_of_its_sources(spark, duck, sf_dir):
    got = queries.op2_entropy_mix(spark, sf_dir).toPandas().merge(duck.execute("SELECT doc_id, source, text FROM documents").df(), on="doc_id")
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3
    assert ((by.taken - by.target).abs() <= by.target * 0.02 + 15).all()


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sizes[0] >= 0.99 * start and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] > sizes[2]


def test_pipeline_packs_every_copy(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_pipeline_of_nothing_and_of_nulls(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    no_text, no_lang = docs.selectExpr("doc_id", "cast(null as string) text", "lang", "source", "n_chars"), docs.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars")
    for i, (some, any_left) in enumerate(((docs.limit(0), False), (no_text, False), (no_lang, True))):
        some.write.parquet(str(tmp_path / str(i) / "documents.parquet"))
        # No texts have no language; without languages nothing is learned, so nothing is rejected.
        assert (corpus_pipeline.run(spark, str(tmp_path / str(i))).count() > 0) == any_left
