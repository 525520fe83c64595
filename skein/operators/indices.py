"""Derived indices over entities, edges and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_index(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, type, 80 characters of status or identity, turns, and relationships with status exactly active."""
    active = edges.where("status = 'active'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("active"))
    text = F.coalesce(F.nullif("current_status", F.lit("")), F.col("identity"))
    return entities.join(active, "id", "left").select("id", "name", "type", F.substring(text, 1, 80).alias("status_summary"), "first_seen", "last_updated", F.coalesce("active", F.lit(0)).cast("bigint").alias("active_relationships"))


def adjacency_degree(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Forward and reverse edges of each id on either side; the type falls back on the id's prefix."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(edges.select(F.col("target_id").alias("id"), F.lit(0).alias("f"), F.lit(1).alias("r")))
    counts = ends.groupBy("id").agg(F.sum("f").alias("forward"), F.sum("r").alias("reverse"))
    kind = F.expr("case split_part(id, '-', 1) when 'char' then 'character' when 'faction' then 'faction' when 'item' then 'item' when 'loc' then 'location' else 'unknown' end")
    return counts.join(entities.select("id", "name", "type"), "id", "left").select("id", "name", F.coalesce("type", kind).alias("type"), "forward", "reverse", (F.col("forward") + F.col("reverse")).alias("degree"))


def location_index(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """location, entity: where entities are by their own state, else by unresolved spatial relationships (which name the relationship)."""
    own = entities.where("location is not null").select(F.col("location").alias("location_id"), F.col("id").alias("entity_id"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("relationship"))
    spatial = edges.where("rel_type = 'spatial' and coalesce(status, '') <> 'resolved'").select(F.col("target_id").alias("location_id"), F.col("source_id").alias("entity_id"), F.lit(1).alias("rank"), F.col("rel_type").alias("relationship"))
    return own.unionByName(spatial).groupBy("location_id", "entity_id").agg(F.when(F.min("rank") == 0, "state").otherwise("relationship").alias("found_by"), F.max("relationship").alias("relationship"))


def location_edges(edges: DataFrame) -> DataFrame:
    """Undirected live connections between locations, each once, with its earliest turn."""
    live = edges.where("source_id like 'loc-%' and target_id like 'loc-%' and coalesce(status, 'active') = 'active'")
    return live.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.min("first_turn").alias("since"))


def turn_activity(entities: DataFrame) -> DataFrame:
    """(turn, id), distinct: entities seen first or updated last at a turn."""
    return entities.select(F.explode(F.array("first_seen", "last_updated")).alias("turn"), "id").distinct()


def event_refs(events: DataFrame) -> DataFrame:
    return events.select(F.col("id").alias("event_id"), "ord", "turn_no", "type", F.explode("refs").alias("entity_id"))


def event_profile(events: DataFrame) -> DataFrame:
    """Events of each entity: number, first and last turn, commonest type (ties: first in order)."""
    kinds = event_refs(events).groupBy("entity_id", "type").agg(F.count("*").alias("n"), F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"))
    top = F.min_by("type", F.struct(-F.col("n"), F.col("type")))
    return kinds.groupBy("entity_id").agg(F.sum("n").alias("events"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), top.alias("top_type"), F.count("*").alias("types"))


def cooccurrence(events: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of entities in the same events, both ways round once, with the number of events."""
    pairs = events.select(F.array_sort(F.array_distinct("refs")).alias("r")).where(F.size("r") > 1)
    each = pairs.select("r", F.posexplode("r").alias("i", "a")).select("a", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("events")).where(F.col("events") >= least)


def orphan_refs(events: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """References of at least ``least`` events to entities that no catalog has, with the first turn."""
    missing = event_refs(events).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    return missing.groupBy("entity_id").agg(F.countDistinct("event_id").alias("events"), F.min("turn_no").alias("first_turn")).where(F.col("events") >= least)


def dangling_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose target no catalog has."""
    return edges.join(entities.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id", "rel_type")


def dormant_edges(edges: DataFrame, entities: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Active edges that fall dormant: the source is stale, the target stale or unknown."""
    seen = entities.select("id", "last_updated")
    both = edges.where("status = 'active'").join(seen.selectExpr("id as source_id", "last_updated as s"), "source_id").join(seen.selectExpr("id as target_id", "last_updated as t"), "target_id", "left")
    return both.where((F.lit(turn) - F.col("s") >= threshold) & (F.col("t").isNull() | (F.lit(turn) - F.col("t") >= threshold))).select("source_id", "target_id", F.col("s").alias("source_last"), F.col("t").alias("target_last"))


def stale_items(entities: DataFrame, refs: DataFrame, targets: DataFrame, turn: int, age: int = 25, least_refs: int = 2) -> DataFrame:
    """Items old and long unseen, with few event references, and not the target of a relationship."""
    counts = refs.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("refs"))
    old = entities.where((F.col("type") == "item") & (F.lit(turn) - F.col("first_seen") >= age) & (F.lit(turn) - F.col("last_updated") >= age))
    left = old.join(targets.select(F.col("target_id").alias("id")), "id", "left_anti").join(counts, "id", "left")
    return left.where(F.coalesce("refs", F.lit(0)) < least_refs).select("id", "first_seen", "last_updated", F.coalesce("refs", F.lit(0)).cast("bigint").alias("refs"))


def name_discovery(events: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Capitalised words of event texts in at least ``least`` events that no entity's name has."""
    words = events.select("id", "turn_no", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit("([A-Z][a-z]{2,})"), F.lit(1)))).alias("word"))
    fresh = words.select("id", "turn_no", F.lower("word").alias("word")).join(known.select(F.lower("name").alias("word")).distinct(), "word", "left_anti")
    return fresh.groupBy("word").agg(F.countDistinct("id").alias("events"), F.min("turn_no").alias("first_turn")).where(F.col("events") >= least)
