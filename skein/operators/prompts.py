"""Prompt accounting and budgets: token metrics by phase, compression, relationships by tier under a budget, previews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prompt_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, phase, calls, input_tokens, raw_tokens, avg_per_call, ratio) of calls (by, phase, tokens, raw_tokens: null as tokens).

    The average is whole and null for a single call; the ratio has four digits, 1 where there is nothing raw.
    """
    raw = F.coalesce("raw_tokens", "tokens")
    out = calls.groupBy(*by, "phase").agg(F.count("*").alias("calls"), F.sum("tokens").alias("input_tokens"), F.sum(raw).alias("raw_tokens"))
    ratio = F.when(F.col("raw_tokens") > 0, F.bround(F.col("input_tokens") / F.col("raw_tokens"), 4)).otherwise(1.0)
    return out.withColumns({"avg_per_call": F.when(F.col("calls") > 1, F.floor(F.col("input_tokens") / F.col("calls"))), "ratio": ratio})


def turn_compression(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a turn's phases, and the phases that were compressed, sorted."""
    out = metrics.groupBy(*by).agg(F.sum("raw_tokens").alias("raw_total"), F.sum("input_tokens").alias("input_total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ratio") < 1, F.col("phase")))), ",").alias("activated"))
    return out.withColumn("ratio", F.when(F.col("raw_total") > 0, F.bround(F.col("input_total") / F.col("raw_total"), 4)).otherwise(1.0))


def compression_signals(entities: Column, relationships: Column) -> Column:
    """The baseline strategy's record: nothing dropped, all of both included."""
    return F.struct(F.lit("baseline").alias("strategy"), F.lit(0).alias("dropped_relationships"), entities.alias("entities_included"), entities.alias("entities_total"), relationships.alias("relationships_included"), relationships.alias("relationships_total"))


def budgeted_relationships(tiers: DataFrame, budget: int) -> DataFrame:
    """Each owner's relationships with the tier that they are written at, so that the owner's text fits the budget.

    tiers: source_id, target_id, tier (1..4), full, brief, bare (token counts as written at tiers 1, 2 and 3). If the total is
    over the budget tier 3 is left out, then tier 2 written bare. Tier 4 is never written. level: 1, 2, 3 or 4 (left out).
    """
    w = Window.partitionBy("source_id")
    cost = lambda t: F.when(t == 1, F.col("full")).when(t == 2, F.col("brief")).when(t == 3, F.col("bare")).otherwise(0)
    first = F.when(F.col("tier") == 3, 4).otherwise(F.col("tier"))
    second = F.when(F.col("tier") == 2, 3).otherwise(first)
    sums = tiers.withColumns({"_a": F.sum(cost(F.col("tier"))).over(w), "_b": F.sum(cost(first)).over(w)})
    level = F.when(F.col("_a") <= budget, F.col("tier")).when(F.col("_b") <= budget, first).otherwise(second)
    return sums.select("source_id", "target_id", "tier", level.cast("bigint").alias("level"))


def demotions(tiers: DataFrame, mentioned: DataFrame, degrees: DataFrame, turn: int) -> DataFrame:
    """What would be demoted, as a shadow record: staleness, the target's degree, why it was kept in view, and the verdict.

    tiers: source_id, target_id, rel_type, last_turn, tier; mentioned: id; degrees: id, degree.
    """
    m = mentioned.select("id").distinct().withColumn("_m", F.lit(True))
    met = tiers.join(m.withColumnsRenamed({"id": "source_id", "_m": "_s"}), "source_id", "left").join(m.withColumnsRenamed({"id": "target_id", "_m": "_t"}), "target_id", "left")
    met = met.join(degrees.select(F.col("id").alias("target_id"), "degree"), "target_id", "left")
    why = F.when(F.coalesce("_s", "_t", F.lit(False)), "real_mention").when(F.col("source_id") == "char-player", "injected_floor").otherwise("none")
    return met.select("source_id", "target_id", "rel_type", (F.lit(turn) - F.col("last_turn")).alias("staleness"), F.coalesce("degree", F.lit(0)).alias("degree"), why.alias("mention_source"), (F.col("tier") == 4).alias("would_demote"))


def recent_turns(turns: DataFrame, most: int, key: str = "session_id") -> DataFrame:
    """The last ``most`` turns of each session; all where it is 0."""
    if most <= 0:
        return turns
    return turns.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn_no")))).where(F.col("_k") <= most).drop("_k")


def turn_previews(turns: DataFrame, full: bool = False, most: int = 50, key: str = "session_id") -> DataFrame:
    """(key, turn_no, preview) of the last three turns of the dm, or of the first ``most`` in full mode: 200 characters on one line."""
    own = turns.where("speaker = 'dm'")
    w = Window.partitionBy(key).orderBy("turn_no" if full else F.desc("turn_no"))
    kept = own.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= (most if full else 3))
    text = F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" "))
    return kept.select(key, "turn_no", F.concat(text, F.when(F.char_length("text") > 200, "...").otherwise("")).alias("preview"))


def segment_size(requested: int | None, turns: int, auto_from: int = 150, auto_size: int = 100) -> int:
    """Turns of a segment: as asked for, else a fixed size for long sessions, else none."""
    if requested is not None:
        return requested
    return auto_size if turns > auto_from else 0


def checkpoint_interval(raw: object, default: int = 25) -> int:
    """A whole number of turns from 1 on; anything else is the default."""
    try:
        value = int(raw)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
    return value if value >= 1 else default


def peak_context(turns: Column, limit: Column, answer: int, existing: int = 0, growth: float = 0.4, entity: int = 30, template: int = 2000, framing: int = 100, text: int = 300) -> Column:
    """Estimated peak tokens of a session of ``turns``, the headroom in percent of the limit, and whether it suffices."""
    entities = F.lit(existing) + F.ceil(turns * F.lit(growth))
    peak = F.lit(template + framing + text + answer) + entities * entity
    headroom = F.when(limit > 0, (limit - peak) / limit * 100).otherwise(0.0)
    return F.struct(peak.cast("bigint").alias("peak"), F.bround(headroom, 1).alias("headroom"), (headroom >= 0).alias("sufficient"), entities.cast("bigint").alias("entities"))


def player_phases(events: DataFrame, gap: int = 10, size: int = 5, chunk: int = 40, least: int = 4, most: int = 8, target: int = 7) -> DataFrame:
    """Phases of player characters' events (entity_id, turn_no, ord, type): entity_id, phase, first_turn, last_turn, events.

    Fewer than ten events are one phase. Others are cut behind gaps of ``gap`` turns and where the commonest type of ``size``
    events changes; with more than ``most`` phases the cuts are thinned evenly, without a cut chunks of ``chunk`` events are
    phases, the smallest neighbours merged down to ``target`` if they are over ``most``. If under ``least`` come out, chunks
    of a sixth of the events are taken instead.
    """
    w = Window.partitionBy("entity_id").orderBy("turn_no", "ord")
    own = events.withColumn("type", F.coalesce("type", F.lit("other"))).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("entity_id"))).withColumn("_gap", F.col("turn_no") - F.lag("turn_no").over(w))
    kinds = own.withColumn("_c", F.floor(F.col("_i") / size)).groupBy("entity_id", "_c", "type").agg(F.count("*").alias("k"), F.min("_i").alias("at"))
    modal = kinds.groupBy("entity_id", "_c").agg(F.sum("k").alias("_all"), F.min_by("type", F.struct(-F.col("k"), F.col("at"))).alias("type")).where(F.col("_all") == size)
    turned = modal.withColumn("_b", F.lag("type").over(Window.partitionBy("entity_id").orderBy("_c"))).where("_b <> type").select("entity_id", (F.col("_c") * size).alias("_i"), F.lit(True).alias("_shift"))
    met = own.join(turned, ["entity_id", "_i"], "left").withColumn("_cut", (F.coalesce(F.col("_gap") >= gap, F.lit(False)) | F.coalesce("_shift", F.lit(False))) & (F.col("_i") > 0))
    cuts = F.sum(F.col("_cut").cast("int"))
    met = met.withColumn("_all", cuts.over(Window.partitionBy("entity_id"))).withColumn("_nth", cuts.over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # of too many cuts every (all / (most - 1))-th stays: those whose number is the whole part of a multiple
    step = F.col("_all") / F.lit(most - 1)
    picked = F.exists(F.sequence(F.lit(0), F.lit(most - 2)), lambda i: F.floor(i * step) == F.col("_nth"))
    met = met.withColumn("_cut", F.col("_cut") & (~(F.col("_all") + 1 > most) | picked))
    parts = F.sum(F.col("_cut").cast("int"))
    met = met.withColumn("_by_cut", parts.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_cuts", parts.over(Window.partitionBy("entity_id")))
    count = F.when(F.col("_cuts") > 0, F.col("_cuts") + 1).otherwise(F.ceil(F.col("_n") / chunk))
    sixth = F.greatest(F.lit(1), F.floor(F.col("_n") / 6))
    phase = F.when(F.col("_n") < 10, 0).when(count < least, F.floor(F.col("_i") / sixth)).when(F.col("_cuts") > 0, F.col("_by_cut")).otherwise(F.floor(F.col("_i") / chunk))
    many = (F.col("_n") >= 10) & (F.col("_cuts") == 0) & (F.ceil(F.col("_n") / chunk) > most)
    out = met.withColumn("phase", phase.cast("bigint") + 1).groupBy("entity_id", "phase").agg(F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.count("*").alias("events"), F.max(many).alias("_many"))
    from skein.operators.ordered import merge_phases

    return out.where("not _many").drop("_many").unionByName(merge_phases(out.where("_many").drop("_many"), target))


def plain_arcs(chunks: DataFrame) -> DataFrame:
    """Arc summaries without a model: (source_id, target_id, phase, first_turn, last_turn, type, summary, key_turn) of chunks with a number."""
    return chunks.select("source_id", "target_id", F.concat(F.lit("Phase "), "chunk").alias("phase"), "first_turn", "last_turn", "type", F.lit("").alias("summary"), F.col("first_turn").alias("key_turn"))
