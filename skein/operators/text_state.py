"""Game state out of turn texts: markers, temporal signals, hit points, effects, items.

Patterns are Java regular expressions with Unicode word boundaries; every function is a narrow
projection (or an explode of one), so a scan's text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.turns import count_word, first_word, has_word

# Marker families in their order, with pattern, and the group that holds the value.
MARKERS = (
    ("hp_loss", r"(?i)\x{1FA78}\s*\n?\s*(\d+)\s*HP\s+lost"),
    ("hp_restore", r"(?i)\x{2764}\x{FE0F}\x{200D}\x{1FA79}\s*\n?\s*(\d+)\s*HP\s+restored"),
    ("long_rest", r"(?i)(---\s*Long\s+rest\s*---)"),
    ("spell_use", r"(?im)^Used\s+(.+?)$"),
    ("item_acquired", r"(?im)New\s+item\s+acquired:\s*(.+?)$"),
    ("level_up", r"(?i)(?:Level(?:ed)?\s+up|Reached\s+level)\s+(\d+)"),
)
SPELL_WORDS = 6
# Words of each season; labels of finer seasons in order of trial.
SEASON_WORDS = {
    "winter": ("snow", "frost", "ice", "frozen", "cold", "biting cold", "deep winter", "first snow", "winter"),
    "spring": ("thaw", "melt", "sprout", "bloom", "spring", "first green", "snow melt", "snow gives way"),
    "summer": ("harvest", "warm", "growth", "summer", "heat", "full span of summer"),
    "autumn": ("leaves", "cooling", "autumn", "fall", "preparation", "first frost"),
}
FINE_SEASONS = (
    ("early[_ ]winter", "early_winter"), ("mid[_ ]winter", "mid_winter"), ("late[_ ]winter", "late_winter"), ("deep winter", "mid_winter"), ("first snow", "early_winter"), ("winter.*settle[ds]?", "early_winter"),
    ("early[_ ]spring", "early_spring"), ("mid[_ ]spring", "mid_spring"), ("late[_ ]spring", "late_spring"), ("first.*signs? of thaw", "early_spring"), ("thaw", "early_spring"), ("snow melt", "early_spring"),
    ("early[_ ]summer", "early_summer"), ("mid[_ ]summer", "mid_summer"), ("late[_ ]summer", "late_summer"), ("full span of summer", "mid_summer"),
    ("early[_ ]autumn", "early_autumn"), ("mid[_ ]autumn", "mid_autumn"), ("late[_ ]autumn", "late_autumn"), ("autumn does not linger", "late_autumn"),
)
TIME_SKIPS = (("days? (?:pass|bleed|unfold)", "days_pass"), ("weeks? (?:pass|continue|unfold)", "weeks_pass"), ("months? pass", "months_pass"), ("time (?:pass|advance)[ds]?", "time_passes"), ("following months?", "months_pass"), ("three weeks", "weeks_pass"))
LIFE_MARKERS = ((r"pregnan\w*", "pregnancy"), (r"belly.*?swell\w*", "pregnancy_progression"), ("morning sickness", "pregnancy_early"), ("life.*?taken root", "pregnancy_discovery"), ("labor", "labor"), ("birth", "birth"), ("born", "birth"), ("new ?born", "birth"))
EFFECTS = ("poisoned", "exhausted|fatigued", "stunned", "frightened|afraid", "charmed", "blinded", "paralyzed|paralysed", "inspired", "blessed", "cursed", "invisible", "prone", "restrained")
CONDITIONS = (r"slight(?:ly)?\s+wounded", r"badly\s+wounded|grievously\s+wounded", r"barely\s+conscious|near\s+death", r"unhurt|uninjured|healthy|fully?\s+healed?", "wounded|injured|hurt")


def markers(turns: DataFrame) -> DataFrame:
    """One row for each marker: session_id, turn_no, seq (from 1 in the turn, by family and place), type, value."""

    def family(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(name).alias("name"), F.trim(v).alias("value")))

    found = F.flatten(F.array(*(family(*m) for m in MARKERS)))
    kept = F.filter(found, lambda m: (m["name"] != "spell_use") | (F.size(F.split(m["value"], r"\s+")) <= SPELL_WORDS))
    rows = turns.select("session_id", "turn_no", F.posexplode(kept).alias("_i", "m"))
    kind = F.when(F.col("m.name").startswith("hp_"), "hp_change").otherwise(F.col("m.name"))
    value = F.when(F.col("m.name") == "hp_loss", F.concat(F.lit("-"), F.col("m.value"))).when(F.col("m.name") == "long_rest", "").otherwise(F.col("m.value"))
    return rows.select("session_id", "turn_no", (F.col("_i") + 1).cast("bigint").alias("seq"), kind.alias("type"), value.alias("value"))


def seasons(turns: DataFrame) -> DataFrame:
    """With fine (the first fine label found) and base (the season with most of its words in the
    text: two different ones at least, and two more than the next season).

    The steps stay apart, so that each pattern is counted once and the generated code stays small.
    """
    names, c = list(SEASON_WORDS), F.col
    own = turns.withColumn("_t", F.lower("text"))
    own = own.withColumns({f"_c_{s}": F.array(*(count_word(c("_t"), w) for w in ws)) for s, ws in SEASON_WORDS.items()} | {"fine": F.coalesce(*(F.when(has_word(c("_t"), p), label) for p, label in FINE_SEASONS))})
    own = own.withColumns({f"_s_{s}": F.aggregate(f"_c_{s}", F.lit(0), lambda a, x: a + x) for s in names} | {f"_k_{s}": F.size(F.filter(f"_c_{s}", lambda x: x > 0)) for s in names})
    best = (F.when((c(f"_k_{s}") >= 2) & (c(f"_s_{s}") - F.greatest(*(c(f"_s_{o}") for o in names if o != s)) >= 2), s) for s in names)
    return own.select(*turns.columns, "fine", F.coalesce(*best).alias("base"))


def season_signals(turns: DataFrame) -> DataFrame:
    """The season of each turn that tells one: fine (confidence 0.8) before base (0.5)."""
    own = seasons(turns.select("session_id", "turn_no", "text")).where("fine is not null or base is not null")
    return own.select("session_id", "turn_no", F.coalesce("fine", F.concat(F.lit("mid_"), F.col("base"))).alias("season"), F.when(F.col("fine").isNotNull(), 0.8).otherwise(0.5).alias("confidence"))


def _first_hits(turns: DataFrame, patterns: tuple, kind: str, confidence: float) -> DataFrame:
    found = F.array(*(F.struct(F.lit(label).alias("label"), first_word(F.col("_t"), p).alias("raw")) for p, label in patterns))
    rows = turns.withColumn("_t", F.lower("text")).select("session_id", "turn_no", F.explode(F.filter(found, lambda m: m["raw"] != "")).alias("m"))
    raw = F.when(F.char_length("m.raw") > 120, F.concat(F.substring("m.raw", 1, 117), F.lit("..."))).otherwise(F.col("m.raw"))
    return rows.select("session_id", "turn_no", F.lit(kind).alias("type"), F.concat_ws(": ", "m.label", raw).alias("signal"), F.lit(confidence).alias("confidence"))


def temporal_signals(turns: DataFrame) -> DataFrame:
    """Season, time-skip and life signals of turns: session_id, turn_no, type, signal, confidence."""
    s = season_signals(turns).select("session_id", "turn_no", F.lit("season_transition").alias("type"), F.col("season").alias("signal"), "confidence")
    return s.unionByName(_first_hits(turns, TIME_SKIPS, "time_skip", 0.6)).unionByName(_first_hits(turns, LIFE_MARKERS, "biological_marker", 0.7))


def hp_state(turns: DataFrame) -> DataFrame:
    """Hit points told by a turn: numeric, max_hp, delta (damage before loss, heal, restore) and narrative."""
    text = F.col("text")
    one = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    numeric = r"(?i)HP[:\s]+(\d+)\s*/\s*(\d+)"
    delta = F.coalesce(*(F.concat(F.lit(sign), one(rf"(?i){verb}\s+(\d+)\s*(?:{unit})")) for sign, verb, unit in (("-", "takes?", r"(?:points?\s+of\s+)?damage"), ("-", "loses?", r"HP|hit\s+points?"), ("+", "heals?", r"HP|hit\s+points?"), ("+", "restores?", r"HP|hit\s+points?"))))
    told = F.lower(F.coalesce(*(one(rf"(?iU)\b({p})\b") for p in CONDITIONS)))
    own = turns.select("session_id", "turn_no", one(numeric).cast("bigint").alias("numeric"), one(numeric, 2).cast("bigint").alias("max_hp"), delta.alias("delta"), told.alias("_told")).where("numeric is not null or delta is not null or _told is not null")
    return own.select("session_id", "turn_no", "numeric", "max_hp", "delta", F.coalesce("_told", F.when(F.col("numeric").isNotNull(), F.format_string("HP %d/%d", "numeric", "max_hp")), F.lit("unknown")).alias("narrative"))


def status_effects(turns: DataFrame) -> DataFrame:
    """Effects named by a turn, each once: session_id, turn_no, effect."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?U)\b({p})\b"), F.lit(1)) for p in EFFECTS))))
    return turns.select("session_id", "turn_no", F.explode(found).alias("effect"))


ACQUIRED = r"(?im)(?:picks?\s+up|receives?|obtains?|finds?|gains?|acquires?|takes?|is\s+given)\s+(?:a\s+|an\s+|the\s+)?(.+?)(?:\.|,|$)"


def inventory(turns: DataFrame, items: DataFrame) -> DataFrame:
    """Items that turns acquire, once for each turn and name, with the catalog's least id of that name.

    A marker line names an item, and so does prose that tells of taking, finding or being given something of up to five words.
    """
    trimmed = lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    marked = F.transform(F.regexp_extract_all("text", F.lit(dict(MARKERS)["item_acquired"]), F.lit(1)), trimmed)
    told = F.filter(F.transform(F.regexp_extract_all("text", F.lit(ACQUIRED), F.lit(1)), trimmed), lambda x: F.size(F.split(x, r"\s+")) <= 5)
    ids = items.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("item_id"))
    return turns.select("session_id", "turn_no", F.explode(F.array_union(marked, told)).alias("name")).join(ids, "name", "left").select("session_id", "turn_no", "name", "item_id")


def mechanical_state(turns: DataFrame, items: DataFrame) -> DataFrame:
    """What a turn tells of hit points, inventory and effects, in one row: session_id, turn_no, hp (struct), items, effects (sorted arrays); turns that tell nothing are left out."""
    key = ["session_id", "turn_no"]
    hp = hp_state(turns).select(*key, F.struct("numeric", "max_hp", "delta", "narrative").alias("hp"))
    own = inventory(turns, items).groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("items"))
    effects = status_effects(turns).groupBy(*key).agg(F.array_sort(F.collect_list("effect")).alias("effects"))
    none = F.array().cast("array<string>")
    return hp.join(own, key, "full").join(effects, key, "full").select(*key, "hp", F.coalesce("items", none).alias("items"), F.coalesce("effects", none).alias("effects"))
