"""Timeline entries: anchors, period labels, the summary of now, and small detections in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import turns as T
from skein.functions.ids import season_label

#: Phrases by time of day, and ordinals of years.
TIMES = (("at first light", "dawn"), ("first light", "dawn"), ("first blush of dawn", "dawn"), ("dawn", "dawn"), ("dusk", "dusk"), ("nightfall", "night"), ("by night", "night"), ("morning", "morning"))
ORDINALS = {"second": 2, "third": 3, "fourth": 4, "fifth": 5}


def times_of_day(text: Column) -> Column:
    """The label of each phrase that the text holds, in the phrases' order; a label may come twice."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(T.has_word(low, phrase), label) for phrase, label in TIMES)), lambda x: x.isNotNull())


def year_of(text: Column) -> Column:
    """The number behind the word year, else the ordinal before it, else null."""
    number = F.regexp_extract(text, r"[Yy]ear\s+(\d+)", 1).try_cast("bigint")
    word = F.lower(F.regexp_extract(text, r"(?i)(?:the\s+)?(" + "|".join(ORDINALS) + r")\s+year", 1))
    return F.coalesce(number, *(F.when(word == w, F.lit(n).cast("bigint")) for w, n in ORDINALS.items()))


def change_source(text: Column, at: Column) -> Column:
    """Who or what the sentence around position ``at`` (from 1) names behind from or by, 50 characters of it; else unknown."""
    before = F.substring(text, F.lit(1), at - 1)
    start = F.char_length(F.substring_index(before, ".", -1))
    sentence = F.substring_index(F.substring(text, at - start, F.char_length(text)), ".", 1)
    found = F.regexp_extract(F.regexp_replace(sentence, r"^\s+|\s+$", ""), r"(?is)\b(?:from|by)\s+(?:the\s+|a\s+|an\s+)?([^,\n]+?)(?=,|$)", 1)
    return F.when(found != "", F.substring(F.regexp_replace(found, r"^\s+|\s+$", ""), 1, 50)).otherwise("unknown")


def anchors(timeline: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, turn_no, label, day): each session's first anchor event, else its first time skip or biological marker.

    timeline: key, ord, type, turn_no, description, raw_text, estimated_day. A label that is missing is the raw text, if it
    is short, with a capital, else ``First`` and the type. Sessions with neither get no row: day 0 at turn 1.
    """
    rank = F.when(F.col("type") == "anchor_event", 0).when(F.col("type").isin("time_skip", "biological_marker"), 1)
    own = timeline.withColumn("_rank", rank).where("_rank is not null")
    first = own.groupBy(key).agg(F.min_by(F.struct("type", "turn_no", "description", "raw_text", "estimated_day", "_rank"), F.struct("_rank", F.coalesce("turn_no", F.lit(0)), "ord")).alias("a")).select(key, "a.*")
    raw = F.trim("raw_text")
    short = F.when((F.coalesce("raw_text", F.lit("")) != "") & (F.char_length("raw_text") <= 80), F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, F.lit(2), F.char_length(raw)))))
    label = F.when(F.col("_rank") == 0, F.coalesce("description", F.lit("Anchor event"))).otherwise(F.coalesce(F.when(F.col("description") != "", F.col("description")), short, F.concat(F.lit("First "), F.replace("type", F.lit("_"), F.lit(" ")))))
    return first.select(key, "turn_no", label.alias("label"), F.coalesce("estimated_day", F.lit(0)).cast("bigint").alias("day"))


def period_labels(transitions: DataFrame, key: str = "session_id", width: int = 25) -> DataFrame:
    """(key, bucket, label): the first season noted in each bucket of turns (key, ord, turn_no, season)."""
    own = transitions.where("turn_no is not null").withColumn("bucket", F.floor((F.col("turn_no") - 1) / width).cast("bigint"))
    first = own.groupBy(key, "bucket").agg(F.min_by("season", "ord").alias("season"))
    low = F.col("bucket") * width
    return first.select(key, "bucket", F.concat(season_label(F.col("season")), F.lit(" (turns "), low + 1, F.lit("–"), low + width, F.lit(")")).alias("label"))


def summary_of_now(timeline: DataFrame, key: str = "session_id", at: Column | None = None) -> DataFrame:
    """(key, last_turn, season, anchor_turn, anchor_label, turn_span, estimated_day, confidence) of each session's timeline.

    at: the season is that of the entry with the greatest ``at``; by turn, then ord, if none is given and among equals.
    """
    order = F.struct(*([] if at is None else [at.alias("_at")]), "turn_no", "ord")
    last = timeline.groupBy(key).agg(F.coalesce(F.max("turn_no"), F.lit(1)).alias("last_turn"), F.max_by("season", F.when(F.col("season").isNotNull(), order)).alias("season"))
    out = last.join(anchors(timeline, key).select(key, F.col("turn_no").alias("anchor_turn"), F.col("label").alias("anchor_label"), "day"), key, "left")
    out = out.withColumns({"anchor_turn": F.coalesce("anchor_turn", F.lit(1)).cast("bigint"), "anchor_label": F.coalesce("anchor_label", F.lit("Day 0")), "day": F.coalesce("day", F.lit(0))})
    span = F.col("last_turn") - F.col("anchor_turn")
    far = F.abs(span)
    confidence = F.when(far <= 10, 0.7).when(far <= 50, 0.5).when(far <= 150, 0.3).otherwise(0.2)
    return out.select(key, "last_turn", "season", "anchor_turn", "anchor_label", span.alias("turn_span"), (F.col("day") + F.bround(span * F.lit(3.5))).cast("bigint").alias("estimated_day"), confidence.alias("confidence"))
