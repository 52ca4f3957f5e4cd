"""One query per operator, on the whole of its table, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.llm.alignment import alignment_digest
from quartergrid.llm.chosen_path import class_table
from quartergrid.llm.class_lm import score_documents as score_language
from quartergrid.llm.content_dedup import mark_copies
from quartergrid.llm.hard_negatives import hard_negatives
from quartergrid.llm.language import Model, fit_table, label_documents
from quartergrid.llm.metric_topk import top_products
from quartergrid.llm.mixing import mix
from quartergrid.llm.packing import pack
from quartergrid.llm.secret_forest import scan
from quartergrid.llm.token_files import round_trip
from quartergrid.llm.toxicity import fit_table as fit_toxicity
from quartergrid.llm.toxicity import score_documents
from quartergrid.llm.weak_quality import fit_table as fit_quality
from quartergrid.llm.weak_quality import score_quality

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(column: str, divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def op1_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(_table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_subsequence_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = fit_toxicity(documents, labels.where(_remainder("doc_id", 5) != 0))
    scored = score_documents(documents, model)
    return scored.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return score_quality(documents, *fit_quality(documents))


def op4_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return scan(_table(spark, folder, "documents")).select("doc_id", "start", "length", "score", "is_secret")


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op6_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_metric_tree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return class_table(_table(spark, folder, "documents"))


def op9_content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_copies(_table(spark, folder, "documents"))


def language_model(documents: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out quarter."""
    return fit_table(documents.where(_remainder("doc_id", 4) != 2))


def op10_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    labelled = label_documents(documents, language_model(documents))
    return labelled.select(
        "doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "words", "switches"
    )


def op11_pointer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in (BYTE_BPE, PIECE_BPE))
    return alignment_digest(_table(spark, folder, "documents"), *paths)


def op12_class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return score_language(_table(spark, folder, "documents"), _remainder("doc_id", 7) != 2)


def op13_secondary_sort_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_packing": op1_vector_packing,
    "op2_subsequence_toxicity": op2_subsequence_toxicity,
    "op3_weak_label_quality": op3_weak_label_quality,
    "op4_secret_forest": op4_secret_forest,
    "op5_token_files": op5_token_files,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_metric_tree_topk": op7_metric_tree_topk,
    "op8_chosen_path_join": op8_chosen_path_join,
    "op9_content_dedup": op9_content_dedup,
    "op10_language_crf": op10_language_crf,
    "op11_pointer_alignment": op11_pointer_alignment,
    "op12_class_bigrams": op12_class_bigrams,
    "op13_secondary_sort_negatives": op13_secondary_sort_negatives,
}

SQL: dict[str, str] = {
    "op6_pareto_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM by_source
), filled AS (
  SELECT *,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
      ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
    sum(weight) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed
), stopped AS (
  SELECT *, 3 * source_size * weights <= weight * left_words AS stops FROM filled
), targeted AS (
  SELECT source, source_size, source_rows,
    CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
         ELSE weight * CAST(max(left_words) FILTER (NOT stops) OVER () AS DOUBLE)
              / max(weights) FILTER (NOT stops) OVER () END AS target
  FROM stopped
), ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targeted
), shares AS (
  SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS remainder,
    target - floor(ratio) * source_size AS wanted, source_size / source_rows AS mean_size
  FROM ratios
), drawn AS (
  SELECT d.doc_id, d.size, s.*,
    (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|mix'), 1, 13) AS BIGINT) + 0.5)
      / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, CASE WHEN size > 0 AND remainder > 0 THEN
    draw / (1 - draw) / (remainder / (1 - remainder) * sqrt(size / mean_size)) END AS odds
  FROM drawn
), summed AS (
  SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source
    ORDER BY odds / (1 + odds) NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0
       ELSE (whole + CASE WHEN odds IS NOT NULL AND up_to - size / 2 <= wanted THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken
FROM summed
""",
    "op7_metric_tree_topk": """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_content_dedup": r"""
WITH normal AS (
  SELECT doc_id, coalesce(text, '') AS original,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), grouped AS (
  SELECT doc_id, content,
    first_value(doc_id) OVER (PARTITION BY content ORDER BY length(original) DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY content) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM grouped
""",
    "op13_secondary_sort_negatives": """
WITH usable AS (
  SELECT DISTINCT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT DISTINCT a.id AS anchor_id, a.label AS anchor_label, a.v AS anchor_v, c.id, c.label,
    CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.id <> c.id
  WHERE a.id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor_v ORDER BY score DESC, id) AS place
  FROM scored WHERE label = anchor_label
), paired AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor_v, p.place
      ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n
    ON n.anchor_id = p.anchor_id AND n.anchor_label = p.anchor_label AND n.anchor_v = p.anchor_v
      AND n.label <> p.anchor_label
  WHERE p.place <= 5 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM paired WHERE rank <= 10
""",
}
