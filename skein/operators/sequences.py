"""Ordered-sequence operators: gaps and islands, phases, as-of look-up, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key: a row for which ``starts`` holds opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_history(history: DataFrame) -> DataFrame:
    """Of each pair and turn the longest description, the first of equals."""
    best = F.min_by(F.struct("ord", "rel_type", "description"), F.struct(-F.char_length("description"), F.col("ord"), F.col("description")))
    return history.groupBy("source_id", "target_id", "turn").agg(best.alias("b")).select("source_id", "target_id", "turn", "b.rel_type", "b.description")


def arc_chunks(history: DataFrame, gap: int = 20, least: int = 4) -> DataFrame:
    """Arcs of each pair's history: a new one where the type changes or more than ``gap`` turns pass; short histories have none."""
    keys = ["source_id", "target_id"]
    w = Window.partitionBy(*keys).orderBy("turn")
    own = history.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least)
    flagged = islands(own.withColumn("_t", F.lag("rel_type").over(w)).withColumn("_p", F.lag("turn").over(w)), keys, ["turn"], F.col("_p").isNull() | (F.col("_t") != F.col("rel_type")) | (F.col("turn") - F.col("_p") > gap), "arc")
    return flagged.groupBy(*keys, "arc").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.any_value("rel_type").alias("rel_type"), F.count("*").alias("entries"))


def season_runs(timeline: DataFrame) -> DataFrame:
    """Runs of equal seasons in a session's order of turns."""
    w = Window.partitionBy("session_id").orderBy("turn_no")
    flagged = islands(timeline.withColumn("_s", F.lag("season").over(w)), ["session_id"], ["turn_no"], F.col("_s").isNull() | (F.col("_s") != F.col("season")), "run")
    return flagged.groupBy("session_id", "run").agg(F.any_value("season").alias("season"), F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.count("*").alias("entries"))


def asof_season(turns: DataFrame, timeline: DataFrame) -> DataFrame:
    """The season at each turn: that of the latest transition up to it (one sort of the union, no range join)."""
    both = turns.select("session_id", "turn_no", F.lit(1).alias("_side"), F.lit(None).cast("string").alias("season")).unionByName(timeline.select("session_id", "turn_no", F.lit(0).alias("_side"), "season"))
    w = Window.partitionBy("session_id").orderBy("turn_no", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("season", F.last("season", ignorenulls=True).over(w)).where("_side = 1").select("session_id", "turn_no", "season")


def without_flicker(timeline: DataFrame, confidence: float = 0.6, support: int = 1, rows: int = 5) -> DataFrame:
    """Season entries that are sure or that share their base season with neighbours within ``rows`` rows."""
    base = F.regexp_extract("season", "(winter|spring|summer|autumn)", 1)
    own = timeline.withColumn("_base", base)
    near = F.collect_list("_base").over(Window.partitionBy("session_id").orderBy("turn_no").rowsBetween(-rows, rows))
    own = own.withColumn("_near", near).withColumn("support", (F.size(F.expr("filter(_near, x -> x = _base)")) - 1).cast("bigint"))
    return own.where((F.col("confidence") >= confidence) | (F.col("support") >= support)).select("session_id", "turn_no", "season", "support")


def story_buckets(events: DataFrame, width: int = 25, priority: tuple[str, ...] = ("arrival", "encounter"), most: int = 3, fallback: int = 2) -> DataFrame:
    """Of each bucket of turns up to ``most`` events of priority types, else the first ``fallback``."""
    own = events.withColumn("bucket", F.floor((F.col("turn_no") - 1) / width)).withColumn("_prio", F.col("type").isin(*priority))
    w = Window.partitionBy("bucket", "_prio").orderBy("turn_no", "ord")
    ranked = own.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(most, fallback))
    has = F.max(F.col("_prio").cast("int")).over(Window.partitionBy("bucket"))
    return ranked.withColumn("_has", has).where((F.col("_prio") & (F.col("_k") <= most)) | (~F.col("_prio") & (F.col("_has") == 0) & (F.col("_k") <= fallback))).select("bucket", "id", "turn_no", "type")


def npc_phases(events: DataFrame, least: int = 10, gap: int = 10, splits: int = 3, halve_at: int = 20) -> DataFrame:
    """Phases of each entity's events (entity_id, turn_no, ord): split at its largest gaps; without a gap, halved if many."""
    w = Window.partitionBy("entity_id").orderBy("turn_no", "ord")
    own = events.withColumn("_i", F.row_number().over(w)).withColumn("_gap", F.col("turn_no") - F.lag("turn_no").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("entity_id")))
    wide = F.when(F.col("_gap") >= gap, F.col("_gap"))
    own = own.withColumn("_rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_last(wide), "_i"))).withColumn("_gaps", F.count(wide).over(Window.partitionBy("entity_id")))
    cut = (F.col("_n") >= least) & ((wide.isNotNull() & (F.col("_rank") <= splits)) | ((F.col("_gaps") == 0) & (F.col("_n") >= halve_at) & (F.col("_i") == F.floor(F.col("_n") / 2) + 1)))
    own = islands(own, ["entity_id"], ["turn_no", "ord"], cut, "phase")
    return own.groupBy("entity_id", "phase").agg(F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.count("*").alias("events"))


def type_shifts(events: DataFrame, size: int = 5) -> DataFrame:
    """Whole chunks of ``size`` events of an entity whose commonest type (the earliest of equals) differs from the chunk before."""
    w = Window.partitionBy("entity_id").orderBy("turn_no", "ord")
    own = events.withColumn("_i", F.row_number().over(w)).withColumn("chunk", F.floor((F.col("_i") - 1) / size))
    kinds = own.groupBy("entity_id", "chunk", "type").agg(F.count("*").alias("n"), F.min("_i").alias("at"))
    modal = kinds.groupBy("entity_id", "chunk").agg(F.sum("n").alias("_all"), F.min_by("type", F.struct(-F.col("n"), F.col("at"))).alias("type")).where(F.col("_all") == size)
    return modal.withColumn("before", F.lag("type").over(Window.partitionBy("entity_id").orderBy("chunk"))).where("before <> type").select("entity_id", "chunk", "before", "type")
