"""Queries over the corpus tables, one per operator, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, language_id, minmax, quality, toxicity
from .block_naming import exact_copies
from .bottomk import fingerprints
from .common import table
from .entropy_mix import mix
from .features import fold
from .merkle import verify_tampered
from .ngram_join import near_duplicates
from .substring_dedup import repeated_spans
from .vector_codes import compress
from .vector_packing import pack


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), part != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_bottomk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold(F.col("doc_id"), 3)
    model = language_id.train(docs, part != 1)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), part != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_merkle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tampered(table(spark, sf_dir, "documents"))


def op12_weighted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_minmax_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    near13 = near_sql(2, 80).replace("n_shingles, component_id FROM", "n_shingles, component_id, doc_id = component_id AS kept FROM")
    return {"op4_block_naming": OP4_SQL, "op8_ngram_join": near_sql(4, 85), "op11_merkle_lookup": OP11_SQL, "op12_weighted_codes": OP12_SQL, "op13_minmax_near": near13}


QUERIES = (op1_substring_dedup, op2_entropy_mix, op3_toxicity_nnpu, op4_block_naming, op5_bottomk_fingerprint, op6_centroid_language, op7_vector_packing, op8_ngram_join, op9_quality_neighbours, op10_html_crf, op11_merkle_lookup, op12_weighted_codes, op13_minmax_near)

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY n) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept,
       sha256(n) AS text_sha256
FROM t
"""


def near_sql(words: int, percent: int) -> str:
    """Components of documents whose sets of ``words``-word shingles are alike, by comparing all pairs that share one."""
    return rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' '))) END AS s
  FROM t
), items AS (
  SELECT r, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.r AS u, b.r AS v
  FROM items a JOIN items b ON a.item = b.item AND a.r < b.r AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT r, r AS other FROM sets
  UNION
  SELECT reach.r, e.y FROM reach JOIN (SELECT u AS x, v AS y FROM links UNION ALL SELECT v, u FROM links) e ON reach.other = e.x
), final AS (
  SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
  FROM reach JOIN sets a ON a.r = reach.r JOIN sets b ON b.r = reach.other
  GROUP BY a.r, a.doc_id, a.s
)
SELECT doc_id, n_shingles, component_id FROM final
"""


OP11_SQL = r"""
WITH RECURSIVE ops AS (
  SELECT *, [4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS op
  FROM documents
), told AS (
  SELECT *, coalesce(list_reduce(op, lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) & 1, 0) AS odd_before_flip FROM ops
), after AS (
  SELECT *, CASE WHEN odd_before_flip = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM told
), digests AS (
  SELECT doc_id, source,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS now
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM after)
), leaves AS (
  SELECT *, row_number() OVER () AS r,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM digests
), nodes(s, level, i, n, d) AS (
  SELECT s, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY s, level, i // 3, n
), subroots AS (
  SELECT s, d AS subroot, (SELECT count(*) FROM nodes WHERE n = 1) AS n FROM nodes WHERE n = 1
), tops(level, i, n, d) AS (
  SELECT 0, s, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n
), steps AS (
  SELECT r, 0 AS phase, own.level, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i < own.i), '') AS lhs, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i > own.i), '') AS rhs
  FROM leaves l
  JOIN nodes own ON own.s = l.s AND own.n > 1 AND own.i = l.i // CAST(pow(3, own.level) AS BIGINT)
  JOIN nodes o ON o.s = own.s AND o.level = own.level AND o.i // 3 = own.i // 3
  GROUP BY r, own.level, own.i
  UNION ALL
  SELECT r, 1, own.level, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i < own.i), ''), coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (o.i > own.i), '')
  FROM leaves l
  JOIN tops own ON own.n > 1 AND own.i = l.s // CAST(pow(3, own.level) AS BIGINT)
  JOIN tops o ON o.level = own.level AND o.i // 3 = own.i // 3
  GROUP BY r, own.level, own.i
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY phase, level) - 1 AS k FROM steps
), fold(r, k, acc) AS (
  SELECT r, 0, now FROM leaves
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(o.lhs || fold.acc || o.rhs) FROM fold JOIN ordered o ON o.r = fold.r AND o.k = fold.k
), ends AS (
  SELECT r, arg_max(acc, k) AS folded_root FROM fold GROUP BY r
), proofs AS (
  SELECT r, sha256(string_agg(lhs || rhs, '' ORDER BY k)) AS proof FROM ordered GROUP BY r
)
SELECT l.doc_id, l.leaf, sr.subroot, root.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.d AS verified
FROM leaves l JOIN subroots sr ON sr.s = l.s JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r, (SELECT d FROM tops WHERE n = 1) root
"""

_ASSIGN = """a{0} AS (
  SELECT r, pos, min(gap * 64 + e) % 64 AS e, min(gap * 64 + e) // 64 AS gap
  FROM (SELECT c.r, c.pos, b.e, sum((c.v - b.v) * (c.v - b.v)) AS gap FROM comps c JOIN b{0} b ON b.pos = c.pos AND b.j = c.j GROUP BY c.r, c.pos, b.e)
  GROUP BY r, pos
)"""
_MOVE = """b{1} AS (
  SELECT b.pos, b.e, b.j, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.v) AS v
  FROM b{0} b LEFT JOIN (SELECT c.pos, a.e, c.j, sum(c.v) AS s, count(*) AS n FROM comps c JOIN a{0} a ON a.r = c.r AND a.pos = c.pos GROUP BY c.pos, a.e, c.j) m
  ON m.pos = b.pos AND m.e = b.e AND m.j = b.j
)"""
OP12_SQL = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding, len(embedding) // 16 AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT r, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM kept
), comps AS (
  SELECT r, place // width AS pos, place % width AS j, CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT) AS v FROM flat
), b0 AS (SELECT pos, r - 1 AS e, j, v FROM comps WHERE r <= 64), """
    + ", ".join([_ASSIGN.format(0), _MOVE.format(0, 1), _ASSIGN.format(1), _MOVE.format(1, 2), _ASSIGN.format(2)])
    + """, coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos, e, j)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
)
