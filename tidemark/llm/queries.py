"""Queries of the training-data operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe_codec, embed_dedup, line_dedup, packing, pii, quality, simhash, suffix_dedup, topk_search, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op2_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5, 256)


def op3_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_bpe(spark, sf_dir):
    return bpe_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark, sf_dir):
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def queries():
    own = (op1_embedding_dedup, op2_topk_search, op3_quality, op4_bpe, op5_packing, op6_simhash, op7_warc, op8_suffix_dedup, op9_pii, op10_line_dedup)
    import corpus_pipeline

    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
), u AS (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v
), link AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9
), reach(i, j) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.i, l.j FROM reach r JOIN link l ON r.j = l.i
), comp AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
deg AS (SELECT i, count(*) AS n FROM link GROUP BY i)
SELECT c.i AS vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, c.i = c.component_id AS kept
FROM comp c LEFT JOIN deg d ON c.i = d.i
"""

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), t AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

_OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, html FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""

_OP10 = """
WITH l AS (
  SELECT doc_id, list_extract(x, i::INTEGER + 1) AS line, i FROM (
    SELECT doc_id, x, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), f AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos,
    length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS w
  FROM l WHERE trim(line) <> ''
), n AS (
  SELECT doc_id, pos, line, w, lead(line) OVER o AS l2, lead(w) OVER o AS w2, lead(line, 2) OVER o AS l3 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, CASE WHEN w >= 50 THEN 1 WHEN l2 IS NOT NULL AND w + w2 >= 50 THEN 2 WHEN l3 IS NOT NULL THEN 3 END AS m, line, l2, l3 FROM n
), k AS (
  SELECT doc_id, pos, m, line AS a, CASE WHEN m >= 2 THEN l2 END AS b, CASE WHEN m >= 3 THEN l3 END AS c FROM r WHERE m IS NOT NULL
), g AS (
  SELECT doc_id, pos, m, row_number() OVER (PARTITION BY m, a, b, c ORDER BY doc_id, pos) AS nth FROM k
), cut AS (
  SELECT DISTINCT doc_id, pos + step AS pos FROM (SELECT doc_id, pos, unnest(range(m)) AS step FROM g WHERE nth > 1)
), gone AS (SELECT f.doc_id, f.i FROM f JOIN cut ON f.doc_id = cut.doc_id AND f.pos = cut.pos),
flag AS (
  SELECT l.doc_id, l.i, l.line, gone.i IS NOT NULL AS out, lag(gone.i IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS before
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE out)::BIGINT AS n_removed, count(*) FILTER (WHERE out AND NOT before)::BIGINT AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '')) AS kept_sha256
FROM flag GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; tests/llm hold the others against brute force, libraries or held-out labels."""
    import corpus_pipeline

    out = {"op1_embedding_dedup": _OP1, "op2_topk_search": _OP2, "op7_warc": _OP7, "op10_line_dedup": _OP10}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
