"""Entity ids: prefixes, stems, names and season vocabularies, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes by kind; the wider set that synthesis knows; season names.
PREFIX_OF = {"character": "char", "location": "loc", "faction": "faction", "item": "item", "creature": "creature", "concept": "concept"}
KIND_OF = {**{p: t for t, p in PREFIX_OF.items()}, "npc": "character", "entity": "unknown"}
SEASON_NOW = {
    "autumn": "fall", "early_autumn": "early_fall", "mid_autumn": "fall", "late_autumn": "late_fall", "mid_spring": "spring", "mid_summer": "summer", "mid_fall": "fall",
    "midwinter": "mid_winter", "midsummer": "summer", "midspring": "spring", "midfall": "fall", "deep_winter": "mid_winter", "deep_summer": "summer",
}
SEASON_LINE = {"spring": "mid_spring", "summer": "mid_summer", "fall": "mid_autumn", "autumn": "mid_autumn", "winter": "mid_winter"}


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The table's value, null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def stem(entity_id: Column) -> Column:
    """Without a leading ``letters-``."""
    return F.regexp_replace(entity_id, r"^[a-z]+-", "")


def kind(entity_id: Column, default: str = "unknown") -> Column:
    return F.coalesce(mapped(F.regexp_extract(entity_id, r"^([a-z]+)-", 1), KIND_OF), F.lit(default))


def type_of_prefix(entity_id: Column, default: str | None = "character") -> Column:
    """The type that owns the id's prefix; ``default`` for any other."""
    return F.coalesce(mapped(F.regexp_extract(entity_id, r"^([a-z]+)-", 1), {p: t for t, p in PREFIX_OF.items()}), F.lit(default))


def fixed_prefix(entity_id: Column, type_: Column) -> Column:
    """The id with the prefix of its type, in place of any other ``letters-`` or before it."""
    own = mapped(type_, PREFIX_OF)
    return F.when(own.isNull(), entity_id).when(entity_id.startswith(F.concat(own, F.lit("-"))), entity_id).otherwise(F.concat_ws("-", own, stem(entity_id)))


def name_of(entity_id: Column) -> Column:
    """Words of the stem, each with a capital."""
    return F.initcap(F.regexp_replace(stem(entity_id), "-", " "))


def resolved(entity_id: Column, aliases: dict[str, str]) -> Column:
    low = F.lower(entity_id)
    return F.coalesce(mapped(low, aliases), low) if aliases else low


def without_turn_tag(entity_id: Column) -> Column:
    return F.regexp_replace(entity_id, r"-turn-\d{3,}$", "")


def season_of_state(name: Column) -> Column:
    """The state's vocabulary: bare names, fall for autumn."""
    flat = F.regexp_replace(F.lower(F.trim(name)), "[ -]", "_")
    return F.coalesce(mapped(flat, SEASON_NOW), F.replace(flat, F.lit("autumn"), F.lit("fall")))


def season_of_timeline(name: Column) -> Column:
    """The timeline's vocabulary: always a prefix, autumn for fall."""
    flat = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    prefixed = F.when(flat.rlike("^(early|mid|late)_"), F.regexp_replace(flat, "^(early|mid|late)_fall$", "$1_autumn"))
    return F.coalesce(prefixed, mapped(flat, SEASON_LINE), flat)


def season_label(season: Column) -> Column:
    return F.initcap(F.replace(season, F.lit("_"), F.lit(" ")))
