"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import ann, codes, hardneg, htmltext, langid, mixing, packing, quality, sharding, simhash, substring, tokenstore, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), parts=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.stored_digests(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(rows), rows, F.col("vec_id") % 20 == 0)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    flipped = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, flipped)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_mixing, op3_langid, op4_tokenstore, op5_sharding, op6_html, op7_ann, op8_topk, op9_simhash, op10_substring, op11_hard_negatives, op12_vector_codes, op13_quality)}


#: The same mix, with each source sorted whole.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, length(text) AS chars FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight,
    (source_size * 2)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s
), l AS (
  SELECT *, most / weight AS fills_at FROM w
), v AS (
  SELECT *, row_number() OVER f AS k,
    (budget - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l WINDOW f AS (ORDER BY fills_at, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, CASE WHEN a IS NULL OR fills_at <= a THEN most ELSE a * weight END AS target
  FROM v, (SELECT arg_min(level, k) FILTER (level <= fills_at) AS a FROM v)
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), k AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS lack, d.source,
    -ln((('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '-') || '|' || d.size), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / (CASE WHEN chars / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS es_key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY es_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM k
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * epochs + greatest(0, least(size, floor(lack - prefix + 0.5::DOUBLE))))::BIGINT AS taken
FROM p
"""


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _round_sql(k: int) -> str:
    """Parts with their nearest entry of codebook b{k}, and codebook b{k + 1}."""
    return f"""
, d{k} AS (
  SELECT n, position, part, code, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i])))::BIGINT AS d FROM p JOIN b{k} USING (position)
), a{k} AS (
  SELECT n, position, any_value(part) AS part, min(d * 64 + code) % 64 AS code, min(d * 64 + code) // 64 AS error FROM d{k} GROUP BY n, position
), m{k} AS (
  SELECT position, code, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS x FROM a{k}, range(1, 1000) t(i) WHERE i <= len(part) GROUP BY position, code, i
), b{k + 1} AS (
  SELECT b{k}.position, b{k}.code, coalesce(new, entry) AS entry FROM b{k} LEFT JOIN (SELECT position, code, list(x ORDER BY i) AS new FROM m{k} GROUP BY position, code) USING (position, code)
)"""


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT n, position, e[position * (len(e) // 16) + 1 : (position + 1) * (len(e) // 16)] AS part FROM v, range(16) t(position)
), b0 AS (
  SELECT position, n - 1 AS code, part AS entry FROM p WHERE n <= 64
){_round_sql(0)}{_round_sql(1)}{_round_sql(2)}, c AS (
  SELECT n, string_agg(printf('%02x', code), '' ORDER BY position) AS code, sum(error)::BIGINT AS error FROM a2 GROUP BY n
), h AS (
  SELECT sha256(string_agg(entry[i]::VARCHAR, ',' ORDER BY position, code, i)) AS codebooks_sha256 FROM b2, range(1, 1000) t(i) WHERE i <= len(entry)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (n), h
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op8_topk": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": OP12_SQL}
