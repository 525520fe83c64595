"""The contract queries of the llm operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontamination import decontaminate
from .huffman import read_token_ids, write_token_ids
from .language_id import held_out, predict, train
from .line_quality import line_quality
from .ngram_join import ngram_components
from .packing import pack_documents
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .wrapper_induction import extract_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver does
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"), length=50)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_revisit import captures_of_pages, resolve_revisits

    found = resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat_ws(":", F.lower(h["name"]), h["value"]))
    body = F.coalesce("body", F.lit(""))
    return found.select("record_id", "kind", "canonical_url", "state", "response_id", F.col("status").cast("long").alias("status"), F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("headers_sha256"), F.length(body).cast("long").alias("n_chars"), F.sha2(body, 256).alias("body_sha256"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def op4_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_ids(spark, path)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(_table(spark, sf_dir, "documents"), words=5, percent=80)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=40).withColumnRenamed("_id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_revisit": op2_warc_revisit,
    "op3_line_quality": op3_line_quality,
    "op4_huffman_token_ids": op4_huffman_token_ids,
    "op5_ngram_join": op5_ngram_join,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_wrapper_induction": op10_wrapper_induction,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op2_warc_revisit": oracles.OP2,
    "op3_line_quality": oracles.OP3,
    "op5_ngram_join": oracles.OP5,
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, array_to_string(w[s : s + 12], ' ') AS k, least(len(w), 13) AS n FROM bs),
sizes AS (SELECT DISTINCT n FROM p),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT ds.doc_id, ds.s, ds.n, p.item FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM ds) ds JOIN p ON ds.k = p.k AND ds.n = p.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}
