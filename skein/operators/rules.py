"""Rules on single entities, aliases and events, as Columns: rejections, coercions, stub and placeholder tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import mapped

# Words that are no alias of the player character, words that are no character, words that are no location.
META_LABELS = ("player character", "pc", "player", "the player", "main character", "protagonist", "the protagonist", "hero", "the hero", "adventurer", "the adventurer")
COMMON_WORDS = (
    "broken covering disruption hunters method one pattern plague precision protocol treatment the a an this that it you me "
    "attack defense move action skill ability fire water earth wind light dark shadow death life blood spirit soul magic "
    "echo field geometric head new quiet reinforced song southern triangular tribes two weave "
    "chief elder healer raider warrior guard scout shaman merchant captain"
).split()
ROLES = "chief elder healer raider warrior guard scout shaman merchant captain hunters spirit".split()
NO_CHARACTER = [w for w in COMMON_WORDS if w not in ROLES] + "birth belly feast meal sickness disease structure fragment celebration".split()
NO_LOCATION = "feast celebration fragment birth death".split()
GENERIC = "stranger figure someone person creature thing guard villager traveler merchant soldier voice shadow spirit beast animal she he they it her him them his hers its their theirs".split()
ABSTRACT = "method protocol technique process procedure approach strategy practice discipline".split()
COMMON_SUFFIXES = "tion sion ness ment ance ence ity ular ical ive ous ful less ern".split()
#: Corpus frequency from which a word is too common for a name.
COMMON_FREQUENCY = 3e-6
STUB_NOTES = ("auto-created by event-stub.", "auto-created by post-batch orphan sweep.", "auto-created by post-batch-orphan-sweep.", "auto-created by name-mention-discovery.")
PLACEHOLDERS = ("unknown", "not established", "no npcs contacted yet")
PLAYER_ATTRIBUTES = ("race", "class", "abilities", "appearance", "hp_change", "condition", "equipment", "quest", "allegiance", "status", "aliases")
PLAYER_STATE = ("condition", "equipment", "location", "current_activity", "last_updated_turn")
EVENT_TYPES = "birth death arrival departure construction decision encounter recruitment discovery anomaly capture trap ritual healing communication examination release offering other".split()
EVENT_TYPE_OF = {
    "acquisition": "discovery", "trade": "offering", "purchase": "offering", "sale": "offering", "injury": "other", "conflict": "encounter", "combat": "encounter", "negotiation": "decision", "exploration": "discovery",
    "investigation": "examination", "rest": "other", "travel": "arrival", "reward": "other", "quest": "other", "interaction": "encounter", "observation": "examination", "transformation": "other",
}
RELATIONSHIP_WORDS = {
    "kinship": "kinship family parent child sibling kin mother father daughter son",
    "partnership": "partnership collaborating collaborating_with collaborator cooperating partner working_with",
    "mentorship": "mentorship mentor teacher student apprentice teaching",
    "political": "political diplomatic",
    "factional": "factional faction guild tribal",
    "social": "social ally ally_of friend companion supporter supports",
    "adversarial": "adversarial captive captive_of prisoner captor rival competitor enemy caught_by ensnared_by",
    "romantic": "romantic lover romantic_partner",
    "spatial": "spatial resides_at located_at traveling_to departed_from visited stationed_at moved_to lives_in headquartered_at based_in connected_to adjacent_to near inside contains",
    "other": "other task_related_to using",
}
#: Of the two-word labels, those that are also known with an underscore.
UNDERSCORED = "ally_of resides_at located_at traveling_to departed_from stationed_at moved_to lives_in headquartered_at based_in".split()


def without_article(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^(?:the|a|an)\s+", "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def no_character(type_: Column, name: Column) -> Column:
    """A character or creature that by its name, or the last word of it, is none, or is someone's possession."""
    low = F.lower(_trimmed(name))
    bare = _trimmed(without_article(low))
    head = F.regexp_extract(bare, r"(\S+)$", 1)
    return F.coalesce(type_.isin("character", "creature"), F.lit(False)) & (low.isin(NO_CHARACTER) | bare.isin(NO_CHARACTER) | head.isin(NO_CHARACTER) | low.startswith("my "))


def no_location(type_: Column, name: Column) -> Column:
    low = _trimmed(F.lower(name))
    bare = _trimmed(without_article(low))
    return F.coalesce(type_ == "location", F.lit(False)) & (low.isin(NO_LOCATION) | bare.isin(NO_LOCATION) | low.rlike(r"^(?:his|her|their|my|your|its)\s+"))


def no_item(type_: Column, name: Column) -> Column:
    return F.coalesce(type_ == "item", F.lit(False)) & F.coalesce(name, F.lit("")).rlike(r"(?iU)\b(?:" + "|".join(ABSTRACT) + r")\b")


def concept_among_items(type_: Column, entity_id: Column) -> Column:
    """Rows that say item and have a concept's id; they are dropped."""
    return F.coalesce((type_ == "item") & entity_id.startswith("concept-"), F.lit(False))


def plausible_character(name: Column, frequency: Column) -> Column:
    """Whether a name could be a character's: several words, or one that is no generic noun, has no common ending (but
    for long capitalised ones) and is rare. ``frequency`` is the word's share of a corpus, null for an unknown word."""
    own = _trimmed(name)
    low = F.lower(own)
    common_end = low.rlike("(?:" + "|".join(COMMON_SUFFIXES) + ")$") & ~(own.rlike(r"^\p{Lu}") & (F.char_length(low) > 6))
    single = ~low.isin(GENERIC) & ~common_end & (F.coalesce(frequency, F.lit(0.0)) < COMMON_FREQUENCY)
    return low.contains(" ") | low.contains("-") | single


def word_frequency(texts: DataFrame, text: str) -> DataFrame:
    """(word, frequency): each lower-cased word's share of all words of a column."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    return words.select("word", (F.col("n") / F.lit(total)).alias("frequency"))


def real_identity(identity: Column) -> Column:
    return F.coalesce((identity != "") & ~F.lower(identity).contains("stub"), F.lit(False))


def is_stub(notes: Column, identity: Column) -> Column:
    """Created by a sweep (by its note), or without identity."""
    flat = F.concat(F.regexp_replace(_trimmed(F.lower(notes)), r"\.+$", ""), F.lit("."))
    return flat.isin(*STUB_NOTES) | F.coalesce(identity == "", F.lit(True))


def is_placeholder(value: Column) -> Column:
    return F.coalesce((value == "") | _trimmed(F.lower(value)).isin(*PLACEHOLDERS) | value.startswith("TODO:"), F.lit(True))


def is_empty_value(value: Column, kind: str = "string") -> Column:
    """Null, or of size zero: an empty string, array or map."""
    return value.isNull() | ((value == "") if kind == "string" else (F.size(value) == 0))


def worth_a_page(type_: Column, events: Column, least: int = 3) -> Column:
    return F.coalesce(type_.isin("character", "location", "faction", "item") & (events >= least), F.lit(False))


def pages_to_write(counts: DataFrame, sidecars: DataFrame, force: bool = False) -> DataFrame:
    """(id, events, stale) of (id, events) against sidecars (id, events, phases: array of struct with title): those without
    one, with another count or with a phase without title are stale."""
    old = sidecars.select("id", F.col("events").alias("_n"), F.coalesce(F.exists("phases", lambda p: p["title"].isNull()), F.lit(False)).alias("_untitled"), F.lit(True).alias("_has"))
    stale = F.lit(force) | F.col("_has").isNull() | (F.col("events") != F.coalesce("_n", F.lit(0))) | F.col("_untitled")
    return counts.join(old, "id", "left").select("id", "events", stale.alias("stale"))


def skip_player(failures: Column, since: Column, threshold: int = 20, cooldown: int = 50, retry: int = 5) -> Column:
    """Whether the player character's extraction rests: after ``threshold`` failures in a row, ``cooldown`` turns of each cycle."""
    return (failures >= threshold) & (since % (cooldown + retry) < cooldown)


def player_attributes(entity_id: Column, attributes: Column) -> Column:
    """The map without the keys that the player character must not have; other entities' maps as they are."""
    return F.when(entity_id == "char-player", F.map_filter(attributes, lambda k, v: k.isin(*PLAYER_ATTRIBUTES))).otherwise(attributes)


def pruned_state(entries: Column, most: int = 30) -> Column:
    """State entries (array of struct with key, in order of recency): over ``most``, the core keys and the last others."""
    core, other = F.filter(entries, lambda e: e["key"].isin(*PLAYER_STATE)), F.filter(entries, lambda e: ~e["key"].isin(*PLAYER_STATE))
    room = F.greatest(F.lit(0), F.lit(most) - F.size(core))
    last = F.slice(other, F.greatest(F.lit(1), F.size(other) - room + 1), F.greatest(F.lit(0), room))
    return F.when(F.size(entries) <= most, entries).otherwise(F.concat(core, last))


def filtered_aliases(rows: DataFrame, known: DataFrame, player: bool = False, least: int = 3, most: int = 10) -> DataFrame:
    """(id, aliases) of (id, name, aliases): without those that are another entity's name (``known``: name).

    player: aliases are trimmed, those that are labels, common words or too short go too, and the last ``most`` stay.
    """
    each = rows.select("id", F.lower(_trimmed(F.col("name"))).alias("_own"), F.posexplode_outer("aliases").alias("_at", "_alias"))
    flat = F.lower(_trimmed(F.col("_alias")))
    names = known.select(F.lower(_trimmed(F.col("name"))).alias("_low")).where("_low <> ''").distinct().withColumn("_known", F.lit(True))
    met = each.withColumn("_low", flat).join(names, "_low", "left")
    good = (F.col("_low") != "") & ~(F.coalesce("_known", F.lit(False)) & (F.col("_low") != F.col("_own")))
    if player:
        good = good & ~F.col("_low").isin(*META_LABELS, *COMMON_WORDS) & (F.char_length("_low") >= least)
    kept = F.array_sort(F.collect_list(F.when(good, F.struct("_at", (_trimmed(F.col("_alias")) if player else F.col("_alias")).alias("a")))))
    out = met.groupBy("id").agg(F.transform(kept, lambda x: x["a"]).alias("aliases"))
    return out.select("id", F.slice("aliases", F.greatest(F.lit(1), F.size("aliases") - most + 1), most).alias("aliases")) if player else out


def event_type(raw: Column) -> Column:
    """One of the known types; known others by meaning, the rest ``other``; null stays."""
    low = _trimmed(F.lower(raw))
    return F.when(raw.isNull(), None).when(low.isin(EVENT_TYPES), low).otherwise(F.coalesce(mapped(low, EVENT_TYPE_OF), F.lit("other")))


def relationship_type(raw: Column) -> Column:
    low = _trimmed(F.lower(raw))
    table = {w.replace("_", " "): kind for kind, words in RELATIONSHIP_WORDS.items() for w in words.split()}
    table |= {w: table[w.replace("_", " ")] for w in UNDERSCORED}
    return F.coalesce(mapped(low, table), F.lit("other"))


def near_source_turns(sources: Column, turn_id: Column, most: int = 5) -> Column:
    """Source turns; those over ``most`` turns away from the event's turn become that turn, and then each stays once."""
    number = lambda t: F.regexp_extract(t, r"^turn-(\d+)$", 1).try_cast("bigint")
    far = lambda t: F.coalesce(F.abs(number(t) - number(turn_id)) > most, F.lit(False))
    return F.when(F.exists(sources, far), F.array_distinct(F.transform(sources, lambda t: F.when(far(t), turn_id).otherwise(t)))).otherwise(sources)


def category(text: Column, name: Column, is_new: Column, description: Column, entity_id: Column) -> Column:
    """active (new or described), passive (named in the text, by name or by the words of its id) or spurious."""
    low = F.lower(text)
    stem = F.lower(F.regexp_replace(F.regexp_replace(entity_id, r"^[^-]*-", ""), "-", " "))
    named = lambda x: F.coalesce((x != "") & low.contains(x), F.lit(False))
    active = F.coalesce(is_new, F.lit(False)) | F.coalesce(description != "", F.lit(False))
    return F.when(active, "active").when(named(F.lower(name)) | named(stem), "passive").otherwise("spurious")


def next_ids(rows: DataFrame, prefix: str, by: list[str], id_col: str = "id", pad: int = 3) -> DataFrame:
    """(by, next_number, next_id): one more than the greatest number of ids ``prefix-N``, 1 where there is none."""
    number = F.max(F.regexp_extract(id_col, rf"^{prefix}-(\d+)$", 1).try_cast("bigint"))
    out = rows.groupBy(*by).agg((F.coalesce(number, F.lit(0)) + 1).alias("next_number"))
    return out.withColumn("next_id", F.format_string(f"{prefix}-%0{pad}d", "next_number"))


def digested_state(entries: DataFrame, turn: int, window: int = 50) -> DataFrame:
    """(id, key, items) of state lists (id, key, items: array of strings): items that name a turn over ``window`` back become
    one line of how many they were and their themes."""
    themes = "pregnancy birth construction harvest defense ritual expedition council illness healing teaching craft".split()  # fixed values
    number = lambda x: F.regexp_extract(x, r"turn-(\d+)", 1).try_cast("bigint")
    old = lambda x: F.coalesce(F.lit(turn) - number(x) > window, F.lit(False))
    gone = F.filter("items", old)
    # the first five themes in order of item, then of theme
    found = F.slice(F.array_distinct(F.flatten(F.transform(gone, lambda x: F.filter(F.array(*map(F.lit, themes)), lambda t: F.substring(F.lower(F.substring(x, 1, 200)), 1, 200).contains(t))))), 1, 5)
    line = F.concat(F.lit("["), F.size(gone), F.lit(f" earlier entries through ~turn-{turn - window}, including: "), F.when(F.size(found) > 0, F.array_join(F.array_sort(found), ", ")).otherwise(F.concat(F.size(gone), F.lit(" observations"))), F.lit("]"))
    return entries.select("id", "key", F.when(F.size(gone) > 0, F.concat(F.array(line), F.filter("items", lambda x: ~old(x)))).otherwise(F.col("items")).alias("items"))


def cooled_down(attempts: DataFrame, key: str = "session_id", order: str = "turn_no", ok: str = "ok") -> DataFrame:
    """Each attempt's failures in a row before it."""
    w = Window.partitionBy(key).orderBy(order)
    runs = attempts.withColumn("_run", F.coalesce(F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("failures", F.coalesce(F.sum((~F.col(ok)).cast("int")).over(own), F.lit(0)).cast("bigint")).drop("_run")
