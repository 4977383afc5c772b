"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.fill_in_middle import fill_in_middle, restored
from notewright.llm.hard_negatives import hard_negatives
from notewright.llm.kd_sharding import kd_shards
from notewright.llm.line_dedup import drop_common_lines
from notewright.llm.packing import pack
from notewright.llm.quality_classifier import classify_quality
from notewright.llm.quality_rules import rate_quality
from notewright.llm.secret_scan import scan_secrets
from notewright.llm.shingle_join import jaccard_components
from notewright.llm.source_mixing import mix_sources
from notewright.llm.token_counts import count_tokens
from notewright.llm.toxicity import classify_toxicity
from notewright.llm.vector_search import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=5, percent=75)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank file holds the vocabulary of byte_bpe_50k.json and gives the same counts several times faster."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, limit=1024)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(_table(spark, sf_dir, "documents"), min_words=50, most_repeat_percent=50)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), max_length=2048, buckets=8, budget=16384)


def op7_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, weights=[5.0, 2.0, 1.0], cap=3).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_int8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100, positives=5, negatives=5, low=80, high=100, scale=256)


def op12_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(fill_in_middle(_table(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_compression_bands": op4_compression_bands,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_random_indexing_quality": op7_random_indexing_quality,
    "op8_entropy_mixing": op8_entropy_mixing,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_int8_block_join": op10_int8_block_join,
    "op11_anchor_tree_negatives": op11_anchor_tree_negatives,
    "op12_ngram_toxicity": op12_ngram_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LINES = r"""
lines AS (
  SELECT doc_id, i, ls[i] AS line,
         trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
"""

#: SQL for the operators whose whole result SQL expresses.
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT ws, min(doc_id) AS node FROM w WHERE len(ws) > 0 GROUP BY ws),
s AS (SELECT DISTINCT node, array_to_string(ws[i:i + 4], ' ') AS t
      FROM (SELECT node, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM n)),
z AS (SELECT node, count(*) AS size FROM s GROUP BY node),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS met FROM s a JOIN s b ON a.t = b.t AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE 100 * met >= 75 * (x.size + y.size - met)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS root FROM n UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node),
lowest AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(z.size, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (ws) LEFT JOIN z ON z.node = n.node LEFT JOIN lowest c ON c.node = n.node
""",
    "op5_line_dedup": f"""
WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (k) GROUP BY doc_id
""",
    "op10_int8_block_join": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e <> 0)) > 0
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_anchor_tree_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id AS id, list_dot_product(a.x, c.x)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.x) = len(c.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM documents),
e AS (SELECT *, len(ts) AS n, ('0x' || h[1:8])::BIGINT % (len(ts) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(ts) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(ts[1:least(a, b)], '') AS prefix, array_to_string(ts[least(a, b) + 1:greatest(a, b)], '') AS middle,
             array_to_string(ts[greatest(a, b) + 1:n], '') AS suffix FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
""",
}
