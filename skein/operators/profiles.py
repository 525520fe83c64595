"""Profiles merged from observations, entities merged across segments, item and effect states, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that tell a level.
LEVELS = {"low": "low|permissive|generous|forgiving|easy", "moderate": "moderate|balanced|fair|medium", "high": "high|adversarial|punishing|harsh|strict|challenging"}


def merge_profile(observations: DataFrame, fields: int = 5, turns: int = 20) -> DataFrame:
    """By subject: the surest tone, the sorted patterns, the level of most weight, and a confidence up to 0.9."""
    o = F.col
    level = F.explode(F.filter(F.array(*(F.when(F.lower("observation").rlike(rf"(?U)\b({p})\b"), F.lit(k)) for k, p in LEVELS.items())), lambda x: x.isNotNull()))
    votes = observations.where("field = 'adversarial_level'").select("subject", level.alias("level"), "confidence").groupBy("subject", "level").agg(F.sum("confidence").alias("w"))
    winner = votes.groupBy("subject").agg(F.min_by("level", F.struct(-F.round("w", 9), "level")).alias("level"))
    own = observations.groupBy("subject").agg(
        F.min_by("observation", F.when(o("field") == "tone", F.struct(-o("confidence"), o("ord")))).alias("tone"),
        F.array_join(F.array_sort(F.collect_set(F.when(o("field") == "structure_patterns", o("observation")))), ",").alias("patterns"),
        F.avg("confidence").alias("_a"),
        F.countDistinct("field").alias("_f"),
        F.countDistinct("turn_no").alias("_t"),
    )
    raw = o("_a") * 0.4 + F.least(o("_f") / fields, F.lit(1.0)) * 0.3 + F.least(o("_t") / turns, F.lit(1.0)) * 0.3
    return own.join(winner, "subject", "left").select("subject", "tone", "patterns", F.coalesce("level", F.lit("unknown")).alias("level"), F.bround(F.least(raw, F.lit(0.9)), 2).alias("confidence"))


def merge_segments(entities: DataFrame) -> DataFrame:
    """One row an id of several segments' entities (id, segment, identity, status, first_turn, last_turn): widest
    turns, the longest identity that is no stub (else the longest), the status told last."""
    stub = F.lower("identity").contains("stub")
    said = F.when(F.col("status").isNotNull(), F.struct("last_turn", "segment"))
    return entities.groupBy("id").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.min_by("identity", F.struct(stub, -F.char_length("identity"), F.col("segment"))).alias("identity"), F.max_by("status", said).alias("status"))


def distinct_events(events: DataFrame) -> DataFrame:
    """Events of different turn and first 100 characters, the first of each."""
    key = F.lower(F.trim(F.substring("description", 1, 100)))
    w = Window.partitionBy("turn_no", key).orderBy("ord")
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", "turn_no", "description")


def merge_effects(effects: DataFrame) -> DataFrame:
    """Effects of a session with the earliest turn of each."""
    return effects.groupBy("session_id", "effect").agg(F.min("turn_no").alias("since_turn"))


def provenance(texts: DataFrame, turns: DataFrame) -> DataFrame:
    """Cited turns ([turn-N], each written form once) of each text, and which of them do not exist: key, cited, missing."""
    cited = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[turn-(\d+)\]"), F.lit(1)))).alias("turn_no")).withColumn("turn_no", F.col("turn_no").cast("bigint"))
    known = cited.join(turns.select("turn_no").distinct().withColumn("_k", F.lit(True)), "turn_no", "left")
    return known.groupBy("key").agg(F.count("*").alias("cited"), F.count_if(F.col("_k").isNull()).alias("missing"))


def stub_context(refs: DataFrame, turns: DataFrame, most: int = 10, chars: int = 500) -> DataFrame:
    """Texts around an entity: of the turns of its events and their neighbours, ``chars`` each, the first ``most`` by turn."""
    wanted = refs.select("entity_id", F.explode(F.array(F.col("turn_no") - 1, F.col("turn_no"), F.col("turn_no") + 1)).alias("turn_no")).distinct()
    own = wanted.join(turns.select("turn_no", F.substring("text", 1, chars).alias("text")), "turn_no")
    w = Window.partitionBy("entity_id").orderBy("turn_no", "text")
    return own.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most).select("entity_id", "rank", "turn_no", F.char_length("text").cast("bigint").alias("chars"))


# What begins a section of a season's summary, and the section it is.
_SECTIONS = {
    "regional_changes": r"Regional\s+Changes?",
    "faction_actions": r"Faction\s+Actions?",
    "economic_shifts": r"Economic\s+(?:(?:or\s+)?Ecological\s+)?(?:Shifts?|Changes?|Updates?)",
    "environmental_notes": r"Environmental\s+(?:Notes?|Conditions?|Changes?)",
    "rumors": r"Rumors?\s+(?:Reaching|and\s+)[^\n]*?",
    "consequences": r"Consequences?\s+of\s+[^\n]*?",
}
_SEASONS = ("spring", "summer", "fall", "winter", "autumn")
_SECTION = r"(?im)^\*{0,2}(" + "|".join(_SECTIONS.values()) + r"):?\s*?\*{0,2}[ \t]*:?[ \t]*$"
_SUMMARY = r"(?i)(?:^|\n)(?:\*{0,2})(?:Season\s+(?:\d+\s+)?Summary|(?:" + "|".join(_SEASONS) + r")\s+(?:Summary|Overview|Report|Update))(?:\*{0,2})\s*(?::\s*(?:\*{0,2})?(?:" + "|".join(_SEASONS) + r")?(?:\*{0,2})?)?\s*\n"


def season_sections(turns: DataFrame) -> DataFrame:
    """(session_id, turn_no, section, content) of the sections that turns hold under their headings; empty ones are left out.

    A section ends at the next heading; the last one at a blank line that a line of prose follows, or at the end. Of a section that comes
    twice the last counts.
    """
    heads, bodies = F.regexp_extract_all("text", F.lit(_SECTION), F.lit(1)), F.slice(F.split("text", _SECTION), 2, 1 << 30)
    each = turns.select("session_id", "turn_no", F.size(heads).alias("_n"), F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("_at", "s"))
    first = F.lower(F.regexp_extract("s.h", r"^(\w+)", 1))
    kind = F.coalesce(*(F.when(first.isin(*([k.split("_")[0]] + (["rumor"] if k == "rumors" else ["consequence"] if k == "consequences" else []))), k) for k in _SECTIONS))
    body = F.when(F.col("_at") == F.col("_n") - 1, F.element_at(F.split("s.b", r"\n\n(?=[^\s\-*])"), 1)).otherwise(F.col("s.b"))
    own = each.select("session_id", "turn_no", "_at", kind.alias("section"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content")).where("content <> ''")
    return own.groupBy("session_id", "turn_no", "section").agg(F.max_by("content", "_at").alias("content"))


def season_summaries(turns: DataFrame, least: int = 2) -> DataFrame:
    """Turns that sum up a season: under a header, or with ``least`` different sections: session_id, turn_no, season, year, sections.

    The season is the one that the header tells, else the first name (in the order of _SEASONS) within the first 300 characters.
    """
    from skein.functions.ids import season_of_state
    from skein.operators.timeline import year_of

    sections = season_sections(turns).groupBy("session_id", "turn_no").agg(F.count("*").alias("sections"))
    told = F.nullif(F.regexp_extract("text", r"(?i)Season\s+(?:\d+\s+)?Summary\s*:\s*(?:\*{0,2})?(" + "|".join(_SEASONS) + ")", 1), F.lit(""))
    seen = F.coalesce(*(F.when(F.substring("text", 1, 300).rlike(rf"(?iU)\b{x}\b"), x) for x in _SEASONS))
    own = turns.join(sections, ["session_id", "turn_no"], "left").withColumn("sections", F.coalesce("sections", F.lit(0)))
    return own.where(F.col("text").rlike(_SUMMARY) | (F.col("sections") >= least)).select("session_id", "turn_no", season_of_state(F.coalesce(told, seen)).alias("season"), year_of(F.col("text")).alias("year"), "sections")
