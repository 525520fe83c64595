"""Relationships and entities as scenes show them: adjacency, envelopes, tiers with permanent types, merged histories, stale entities to
refresh, and a catalog after its duplicates were merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import type_of_prefix
from skein.operators import resolution, rules
from skein.operators.catalog import _low

#: Single words that are no mention of who is named so.
NO_MENTION = "any echo field fire head land new quiet snow song two weave attack defense move action skill ability water earth wind light dark shadow death life blood spirit soul magic disruption reinforced geometric southern triangular".split()


def mention_names(entities: DataFrame, blocklist: bool = True) -> DataFrame:
    """(id, name) of each name and alias that texts are searched for: three characters at least and, with ``blocklist``, no common single word."""
    each = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where(F.char_length("name") >= 3)
    if not blocklist:
        return each.distinct()
    bare = rules.without_article(F.lower("name"))
    return each.where(bare.contains(" ") | ~bare.isin(NO_MENTION)).distinct()


def adjacency(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, type, forward, reverse): each entity's or reference's relationships from it and to it, sorted, with both ends' names.

    A reference without an entity has an empty name and the type of its prefix. An end's edges are gathered by one aggregation.
    """
    names = entities.select("id", "name", "type")
    own = edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id", "left")
    edge = F.struct("source_id", F.coalesce("source_name", F.lit("")).alias("source_name"), "target_id", F.coalesce("target_name", F.lit("")).alias("target_name"), F.coalesce("rel_type", F.lit("other")).alias("rel_type"), F.coalesce("status", F.lit("active")).alias("status"), "first_turn", "last_turn")
    each = own.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("side"), edge.alias("e")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("side"), edge.alias("e")))).alias("x")).select("x.*")
    gathered = each.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("e")))).alias(c) for k, c in ((0, "forward"), (1, "reverse"))))
    met = gathered.join(names, "id", "left")
    return met.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", type_of_prefix(F.col("id"), None), F.lit("")).alias("type"), "forward", "reverse")


def scene_envelopes(wanted: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What a scene tells of each wanted id: id, name, identity, current_status, location, and its live relationships (target_id,
    target_name, rel_type, status), sorted by target. A location's envelope has no location and no relationships."""
    live = edges.where("coalesce(status, 'active') = 'active'").join(wanted.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    named = live.join(entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id", "left")
    ties = named.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "rel_type", "target_name", "status"))).alias("_ties"))
    met = entities.join(wanted.select("id").distinct(), "id", "left_semi").join(ties, "id", "left")
    place = F.col("type") == "location"
    none = F.array().cast("array<struct<target_id:string,rel_type:string,target_name:string,status:string>>")
    return met.select("id", "name", "identity", "current_status", F.when(~place, F.col("location")).alias("location"), F.when(place, none).otherwise(F.coalesce("_ties", none)).alias("relationships"))


def typed_tiers(edges: DataFrame, mentioned: DataFrame, turn: int, permanent: tuple[str, ...], recent: int = 15) -> DataFrame:
    """resolution.relationship_tiers, but relationships of permanent types come up: from 4 to 3, and to 2 where one end is mentioned."""
    m = mentioned.select(F.col("entity_id").alias("id")).distinct()
    tiers = resolution.relationship_tiers(edges, mentioned, turn, recent)
    both = tiers.join(m.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(m.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    lasting, one = F.col("rel_type").isin(*permanent), F.coalesce("_s", "_t", F.lit(False))
    tier = F.when(lasting & one & (F.col("tier") >= 3), 2).when(lasting & (F.col("tier") == 4), 3).otherwise(F.col("tier"))
    return both.select("source_id", "target_id", "rel_type", "last_turn", tier.cast("bigint").alias("tier"))


def player_relationships(edges: DataFrame, mentioned: DataFrame, permanent: tuple[str, ...], tail: int) -> DataFrame:
    """A player's relationships that are shown: all of permanent types, all with mentioned targets, and the ``tail`` latest of the others."""
    m = mentioned.select(F.col("entity_id").alias("target_id")).distinct().withColumn("_m", F.lit(True))
    kind = F.when(F.col("rel_type").isin(*permanent), "permanent").when(F.col("_m"), "mentioned").otherwise("volatile")
    own = edges.join(m, "target_id", "left").withColumn("kind", kind)
    w = Window.partitionBy("source_id", "kind").orderBy(F.desc("last_turn"), "target_id", "rel_type")
    return own.withColumn("_k", F.row_number().over(w)).where((F.col("kind") != "volatile") | (F.col("_k") <= tail)).select("source_id", "target_id", "rel_type", "last_turn", "kind")


def scene_relationships(edges: DataFrame, mentioned: DataFrame, turn: int, recent: int = 30, most: int = 20) -> DataFrame:
    """Each source's relationships for a scene, ``most`` of them: in full where the target is mentioned or it is live and recent, else in short."""
    m = mentioned.select(F.col("entity_id").alias("target_id")).distinct().withColumn("_m", F.lit(True))
    full = F.coalesce("_m", F.lit(False)) | ((F.coalesce("status", F.lit("active")) == "active") & (F.lit(turn) - F.col("last_turn") <= recent))
    own = edges.join(m, "target_id", "left").withColumn("in_full", full)
    w = Window.partitionBy("source_id").orderBy(F.desc("in_full"), F.desc("last_turn"), "target_id", "rel_type")
    return own.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most).select("source_id", "target_id", "rel_type", "in_full", "rank")


def written_relationship(tier: Column, history: Column, without_history: bool = False) -> Column:
    """A relationship as JSON as its tier is written: 1 with all its history, 2 with the last entry, 3 bare, 4 not at all.

    Reads source_id, target_id, rel_type, status, description; history: array of (turn, description)."""
    some = F.when(tier == 1, history).when((tier == 2) & (F.size(history) > 0), F.slice(history, -1, 1))
    shown = F.lit(None).cast("array<struct<turn:bigint,description:string>>") if without_history else some
    whole = F.to_json(F.struct("source_id", "target_id", "rel_type", "status", "description", shown.alias("history")))
    bare = F.to_json(F.struct("source_id", "target_id", "rel_type", F.coalesce("status", F.lit("active")).alias("status")))
    return F.when(tier <= 2, whole).when(tier == 3, bare)


def consolidated(updates: DataFrame) -> DataFrame:
    """One relationship a pair out of its updates (source_id, target_id, turn, ord, rel_type, status, description) in order: the last
    told type, status and description, the first and last turn, and the history of descriptions that were followed by others, at the turn
    of the update that told them last. Updates of one turn and ord go by description. Types are held to the known ones; the first update's lacking status is active."""
    w = Window.partitionBy("source_id", "target_id").orderBy("turn", "ord", "description")
    told = F.nullif(F.col("description"), F.lit(""))
    own = updates.withColumn("_d", told).withColumn("_before", F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_bturn", F.lag("turn").over(w))
    changed = F.col("_d").isNotNull() & F.col("_before").isNotNull() & (F.col("_d") != F.col("_before"))
    entry = F.when(changed, F.struct("turn", "ord", F.col("_d").alias("after"), F.col("_bturn").alias("at"), F.col("_before").alias("description")))
    last = lambda c: F.max_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct("turn", "ord", "description")))
    out = own.groupBy("source_id", "target_id").agg(last("rel_type").alias("rel_type"), F.coalesce(last("status"), F.lit("active")).alias("status"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.struct("turn", "ord", "_d"))).alias("description"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(entry)).alias("_h"))
    return out.withColumns({"rel_type": rules.relationship_type(F.coalesce("rel_type", F.lit(""))), "history": F.transform("_h", lambda h: F.struct(h["at"].alias("turn"), h["description"].alias("description")))}).drop("_h")


def filled_first_seen(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """Entities whose first_seen is missing get the first turn that refers to them (refs: entity_id, turn_no), else their last."""
    first = refs.groupBy(F.col("entity_id").alias("id")).agg(F.min("turn_no").alias("_first"))
    return entities.join(first, "id", "left").withColumn("first_seen", F.coalesce("first_seen", "_first", "last_updated")).drop("_first")


def stale_entities(entities: DataFrame, mentions: DataFrame, events: DataFrame, turn: int, interval: int, batch: int, shares: dict[str, float], most: int = 25) -> DataFrame:
    """Entities (id, type, last_updated) to refresh: unseen for over ``interval`` turns, but mentioned since (mentions: entity_id, turn_no),
    char-player never. Of each type the longest unseen, then those with the most events (events: entity_id), by its share of the batch
    (largest remainders); free places go to the others by the same order. Large catalogs have batches of a fifth, ``most`` at most.
    """
    size = entities.count()
    batch = min(max(batch, size // 5) if size >= 60 else batch, most)
    raw = {t: batch * s for t, s in shares.items()}
    slots = {t: int(x) for t, x in raw.items()}
    for t in sorted(raw, key=lambda t: slots[t] - raw[t])[: batch - sum(slots.values())]:
        slots[t] += 1
    since = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.max("turn_no").alias("_seen"))
    told = events.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("_events"))
    gap = F.lit(turn) - F.col("last_updated")
    own = entities.where((F.col("id") != "char-player") & (gap > interval)).join(since, "id").where("_seen > last_updated").join(told, "id", "left").select("id", "type", gap.alias("gap"), F.coalesce("_events", F.lit(0)).alias("events"))
    order = [F.desc("gap"), F.desc("events"), F.col("id")]
    slot = F.coalesce(*(F.when(F.col("type") == t, n) for t, n in slots.items()), F.lit(0))
    ranked = own.withColumn("_k", F.row_number().over(Window.partitionBy("type").orderBy(*order)))
    # of each type no more than a batch can be wanted, so what is left is small
    few = ranked.where(F.col("_k") <= batch).withColumn("_own", F.col("_k") <= slot)
    return few.orderBy(F.desc("_own"), *order).limit(batch).select("id", "type", "gap", "events")


def without_duplicates(entities: DataFrame, edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, events) after duplicates were merged (resolution.merged_catalog): survivors take the names of the others as
    aliases and the widest turns, references go to survivors, edges from an entity to itself go."""
    merged = resolution.merged_catalog(entities)
    met = entities.join(merged, "id", "left").withColumn("_keep", F.coalesce("survivor", "id"))
    head = F.when(F.col("survivor").isNull(), F.struct("type", "name"))
    others = F.collect_set(F.when(F.col("survivor").isNotNull(), F.col("name")))
    cat = met.groupBy(F.col("_keep").alias("id")).agg(F.max(head).alias("_e"), F.min("first_seen").alias("first_seen"), F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))), others))).alias("_a"))
    cat = cat.select("id", "_e.type", "_e.name", "first_seen", F.filter("_a", lambda x: F.lower(F.trim(x)) != _low("_e.name")).alias("aliases"))
    to = merged.select(F.col("id").alias("_old"), F.col("survivor").alias("_new"))
    for c in ("source_id", "target_id"):
        edges = edges.join(to, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return cat, edges.where("source_id <> target_id"), resolution.rewrite_refs(events, merged)


def event_rules() -> dict[str, Column]:
    """What an event document must meet: id, source_turns, type, description."""
    turns = F.col("source_turns")
    return {
        "id": F.col("id").rlike("^evt-[0-9]+$"),
        "source_turns": (F.size(turns) > 0) & F.forall(turns, lambda t: t.rlike(r"^turn-[0-9]{3,}$")),
        "type": F.col("type").isin(rules.EVENT_TYPES),
        "description": F.coalesce("description", F.lit("")) != "",
    }


def finding(path: Column, message: Column) -> Column:
    """A finding as text: its path in brackets, (root) for none, and the message."""
    return F.concat(F.when(F.size(path) == 0, "(root)").otherwise(F.array_join(F.transform(path, lambda p: F.concat(F.lit("['"), p, F.lit("']"))), "")), F.lit(": "), message)


def validated_folder(spark, path: str, ddl: str, checks: dict[str, Column], key: str = "id") -> DataFrame:
    """(file, key, rule) for each rule that a JSON document below ``path`` does not meet; a file that is no JSON has the rule ``json``."""
    rows = spark.read.schema(ddl + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("file"))
    rows = rows.where("file <> 'index.json'")
    failed = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in checks.items())), lambda x: x.isNotNull())
    found = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("json"))).otherwise(failed)
    return rows.select("file", F.col(key).alias("key"), F.explode(found).alias("rule"))
