"""The corpus pipeline: five stages, each an operator of skein.llm.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, the last one
the packed pieces. run() writes what a stage returns as Parquet to the shared folder and
reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._shared import recorded, released, removed, written
from skein.llm.decontamination import decontaminate
from skein.llm.line_quality import line_quality
from skein.llm.ngram_join import ngram_components
from skein.llm.packing import pack_documents
from skein.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Keys up to this count (16 bytes each) are broadcast to filter documents; more are joined.
BROADCAST_KEYS = 500_000


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
        return f(spark, docs, sf_dir)

    return call


def _counted(keys: DataFrame) -> DataFrame:
    """Written keys, marked for broadcast if they are few."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside _id and _row (hash of the text), so no column of ``docs`` can clash with a stage's own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_row"))


def _same_row() -> Column:
    return F.expr("_id <=> _gone_id and _row = _gone_row")


def _gone(found: DataFrame) -> DataFrame:
    return found.select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"))


def _as_before(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars (if there) counted anew."""
    out = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failed lines."""
    return _as_before(line_quality(docs, clean=True, prefix="_rule_").where("_rule_kept"), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id."""
    found = written(ngram_components(docs).select("_id", "_row", "_first", "n_shingles"), "components")
    each = found.where("n_shingles > 0").groupBy("_id", "_row").agg(F.max("_first").alias("_first"), F.count("*").alias("_rows"))
    left = _packed(docs).join(_counted(_gone(each.where("not _first"))), _same_row(), "left_anti")
    again = _counted(_gone(each.where("_first and _rows > 1")))
    if not again.isEmpty():  # rows that repeat the one to keep, id and text
        left = left.join(again, _same_row(), "left_anti").unionByName(left.join(again, _same_row(), "left_semi").dropDuplicates(["_id", "_row"]))
    return left.select("doc.*")


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document holds; a text of nothing else goes."""
    cut = substring_dedup(docs).where("n_removed > 0").select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"), "_kept", (F.col("n_removed") == F.col("n_words")).alias("_all")).dropDuplicates(["_gone_id", "_gone_row"])
    joined = _packed(docs).join(cut, F.expr("_id = _gone_id and _row = _gone_row"), "left").where("not coalesce(_all, false)")
    text = F.coalesce(F.col("_kept"), F.col("doc.text")).alias("text")
    return _as_before(joined.select(*(text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns)), docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test passage of weight."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = _counted(_gone(decontaminate(docs, tests).where("contaminated").select("_id", "_row").distinct()))
    return _packed(docs).join(gone, _same_row(), "left_anti").select("doc.*")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the fourth is expressible in SQL on whole tables; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        scratch: list[str] = []
        with recorded(scratch):
            found = stage(spark, docs, sf_dir)
        docs = written(found, name.replace(" ", "-"))
        removed(spark, scratch)  # what the stage wrote on its way, and the table that it read
        if last is not None:
            released(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
