"""State and planning documents, context order, users' notes, and parallel results, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import catalog
from skein.operators.rules import is_placeholder


def context_order(entities: DataFrame, mentioned: DataFrame, colocated: DataFrame, one_hop: DataFrame, turn: int | None = None, stale: int = 50, cap: float = 0.5, cap_from: int = 20) -> DataFrame:
    """Entities (id, last_updated) in the order in which a context lists them, with their tier: mentioned, colocated, one_hop, backfill.

    The three sets are of ids. Where they hold over ``cap`` of a catalog of ``cap_from`` entities and more, one-hop ids are no tier of
    their own. Backfill older than ``stale`` turns before ``turn`` is left out. Within a tier the latest come first, then by id.
    """
    rank = mentioned.select("id", F.lit(0).alias("_t")).unionByName(colocated.select("id", F.lit(1).alias("_t"))).unionByName(one_hop.select("id", F.lit(2).alias("_t"))).groupBy("id").agg(F.min("_t").alias("_t"))
    met = entities.join(rank, "id", "left")
    n = met.agg(F.count("*").alias("all"), F.count("_t").alias("some")).first()
    if n["all"] >= cap_from and n["some"] > n["all"] * cap:
        met = met.withColumn("_t", F.when(F.col("_t") < 2, F.col("_t")))
    met = met.withColumn("_t", F.coalesce("_t", F.lit(3)))
    if turn is not None:
        met = met.where((F.col("_t") < 3) | (F.coalesce("last_updated", F.lit(0)) >= turn - stale))
    tier = F.element_at(F.array(*map(F.lit, ("mentioned", "colocated", "one_hop", "backfill"))), F.col("_t") + 1)
    return met.select("id", tier.alias("tier"), F.coalesce("last_updated", F.lit(0)).alias("last_updated")).orderBy(F.col("_t"), F.desc("last_updated"), "id")


def player_state(sessions: DataFrame, player: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each session's player state (session_id, location, condition, inventory_notes, relationships_summary), placeholders filled from
    the player's entity (id, location, condition, equipment): the location's name, and its live relationships in order of target."""
    places = entities.select(F.col("id").alias("_loc"), F.col("name").alias("_place"))
    own = player.join(places, F.col("location") == F.col("_loc"), "left")
    live = edges.where("coalesce(status, 'active') = 'active'").join(player.select(F.col("id").alias("source_id")), "source_id").join(entities.select(F.col("id").alias("target_id"), F.col("name").alias("_who")), "target_id", "left")
    ties = live.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_id", F.concat(F.coalesce("_who", "target_id"), F.lit(": "), F.coalesce("rel_type", F.lit("related"))).alias("t")))), lambda x: x["t"]), "; ").alias("_ties"))
    one = own.join(ties, own["id"] == ties["source_id"], "left").select(F.coalesce("_place", "location").alias("_location"), F.col("condition").alias("_condition"), F.array_join("equipment", ", ").alias("_inventory"), "_ties")
    filled = lambda c, v: F.when(is_placeholder(F.col(c)) & (F.coalesce(F.col(v), F.lit("")) != ""), F.col(v)).otherwise(F.col(c)).alias(c)
    return sessions.join(F.broadcast(one.limit(1)), F.lit(True), "left").select("session_id", filled("location", "_location"), filled("condition", "_condition"), filled("inventory_notes", "_inventory"), filled("relationships_summary", "_ties"))


def risks(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, statement) of live adversarial relationships."""
    names = entities.select("id", "name")
    hot = edges.where("rel_type = 'adversarial' and coalesce(status, 'active') = 'active'")
    met = hot.join(names.withColumnsRenamed({"id": "source_id", "name": "_a"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "_b"}), "target_id", "left")
    return met.select("source_id", "target_id", F.concat(F.lit("Adversarial: "), "_a", F.lit(" vs "), F.coalesce("_b", "target_id")).alias("statement"))


def opportunities(threads: DataFrame) -> DataFrame:
    """(thread_id, statement) of active threads (id, title, status, open_questions): each question, else the thread itself."""
    live = threads.where("status = 'active'")
    asked = live.select(F.col("id").alias("thread_id"), F.explode("open_questions").alias("q")).select("thread_id", F.concat(F.lit("Investigate: "), "q").alias("statement"))
    rest = live.where((F.size(F.coalesce("open_questions", F.array().cast("array<string>"))) == 0) & (F.coalesce("title", F.lit("")) != ""))
    return asked.unionByName(rest.select(F.col("id").alias("thread_id"), F.concat(F.lit("Pursue thread: "), "title").alias("statement")))


def constraints(attributes: DataFrame) -> DataFrame:
    """(id, kind, statement, confidence) of attributes (id, name, key, value, inference, confidence, source_turn): known facts, and inferences with how sure they are."""
    own = attributes.where("coalesce(value, '') <> '' and coalesce(source_turn, '') <> ''")
    guess = F.coalesce("inference", F.lit(False))
    known = F.concat("name", F.lit("'s "), "key", F.lit(": "), "value", F.lit(" (from "), "source_turn", F.lit(")"))
    maybe = F.concat("name", F.lit("'s "), "key", F.lit(" may be "), "value")
    return own.select("id", F.when(guess, "inferred").otherwise("known").alias("kind"), F.when(guess, maybe).otherwise(known).alias("statement"), F.when(guess, F.coalesce("confidence", F.lit(0.5))).alias("confidence"))


def with_user_notes(profiles: DataFrame, sections: DataFrame) -> DataFrame:
    """Profiles (session_id, adversarial_level, tone, notes, hints, patterns, confidence) after the user's sections (session_id, section, content).

    A level that the user names wins; tone and notes are added to unless they say so already; hints and patterns get a marked entry;
    the confidence of a profile with sections is held to 0.3..0.9 (a surer one stays) and rounded to two digits, halves to even.
    """
    wide = sections.groupBy("session_id").agg(
        *(F.max(F.when(F.col("section") == s, F.col("content"))).alias(c) for s, c in (("Adversarial Level (Your Assessment)", "_level"), ("Tone and Content Preferences", "_tone"), ("Known DM Tendencies", "_tend"), ("Hint and Clue Style", "_hint"), ("DM Experience and Style", "_style"))),
        F.array_sort(F.collect_list(F.when(F.col("section").isin("House Rules", "Session Zero Agreements", "Campaign Setting"), F.concat("section", F.lit(": "), "content")))).alias("_more"),
    )
    p = profiles.join(wide, "session_id", "left").withColumn("_has", F.col("_more").isNotNull())
    low = F.lower(F.trim("_level"))
    level = F.when(low.isin("low", "moderate", "high", "unknown"), low).when(low.contains("low"), "low").when(low.contains("moderate") | low.contains("medium"), "moderate").when(low.contains("high"), "high").otherwise(F.col("adversarial_level"))
    tone = F.when(F.col("_tone").isNull() | F.coalesce("tone", F.lit("")).contains(F.col("_tone")), F.col("tone")).when(F.coalesce("tone", F.lit("")) == "", F.col("_tone")).otherwise(F.concat("tone", F.lit("; User notes: "), "_tone"))
    lines = F.concat(F.when(F.col("_tend").isNotNull(), F.array(F.concat(F.lit("User-provided: "), "_tend"))).otherwise(F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
    start = F.when(F.coalesce("notes", F.lit("")) == "Profile not yet established.", F.lit("")).otherwise(F.coalesce("notes", F.lit("")))
    fresh = F.filter(lines, lambda x: ~start.contains(x))
    notes = F.when(F.size(fresh) == 0, F.col("notes")).otherwise(F.array_join(F.concat(F.filter(F.array(start), lambda x: x != ""), fresh), "\n\n"))
    add = lambda c, v: F.when(F.col(v).isNull(), F.col(c)).otherwise(F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.array(F.concat(F.lit("[user-provided] "), v)))).alias(c)
    sure = F.when(F.col("confidence") > 0.9, F.bround("confidence", 2)).otherwise(F.bround(F.least(F.greatest(F.col("confidence"), F.lit(0.3)), F.lit(0.9)), 2))
    return p.select("session_id", F.when(F.col("_level").isNull(), F.col("adversarial_level")).otherwise(level).alias("adversarial_level"), tone.alias("tone"), notes.alias("notes"), add("hints", "_hint"), add("patterns", "_style"), F.when(F.col("_has"), sure).otherwise(F.col("confidence")).alias("confidence"))


def merged_results(base: DataFrame, results: DataFrame, events: DataFrame, new_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, events) after parallel results: entities of turns that did not fail, one after the other by turn and place, then new events once.

    results: the catalog's columns with turn_no, ord, failed; new_events: the events' columns with failed and ord. Each
    pass takes every entity's next update, so there are as many passes as one entity has updates at most.
    """
    from pyspark.sql import Window

    ok = results.where("not failed").withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("turn_no", "ord")))
    most = ok.agg(F.max("_k")).first()[0] or 0
    for k in range(1, most + 1):
        base = catalog.upserted(base, ok.where(F.col("_k") == k).select(*base.columns))
    fresh = new_events.where("not failed").join(events.select("id"), "id", "left_anti")
    return base, events.unionByName(catalog.first_events(fresh, "ord").select(*events.columns))
