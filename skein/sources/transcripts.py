"""Transcripts as turns: format detection, three parsers, turn files, logs and entity documents.

All parsing is by Spark expressions: one text row in, an exploded row for each turn out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HEADER = r"(?im)^##\s+turn-(\d+)\s+\[(player|dm)\]"


def _quoted(labels: list[str]) -> str:
    return "|".join("\\Q" + x.replace("\\E", "") + "\\E" for x in labels)


def detect_format(content: Column, labels: list[str]) -> Column:
    """markdown, labeled or alternating: the first whose pattern is found."""
    labelled = rf"(?im)^\s*(?:\*\*)?\[?(?:{_quoted(labels)})\]?(?:\*\*)?\s*:" if labels else r"(?!)"
    return F.when(content.rlike(_HEADER), "markdown").when(content.rlike(labelled), "labeled").otherwise("alternating")


def _edges_off(text: Column) -> Column:
    """Without white space and rules of dashes at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:\s|(?m:^---+[ \t]*$))+", ""), r"(?:\s|(?m:^---+[ \t]*$))+\z", "")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_pos")
    return rows.withColumn("turn_no", F.row_number().over(w).cast("bigint")).select(key, "turn_no", "speaker", "text")


def parse_markdown(sessions: DataFrame, key: str = "session_id", content: str = "content") -> DataFrame:
    """Turns under ``## turn-N [speaker]`` headers, with the header's number; empty ones are dropped."""
    heads = F.regexp_extract_all(content, F.lit(_HEADER), F.lit(0))
    bodies = F.slice(F.split(content, _HEADER), 2, 1 << 30)
    rows = sessions.select(key, F.explode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("t"))
    out = rows.select(key, F.regexp_extract("t.h", _HEADER, 1).cast("bigint").alias("turn_no"), F.lower(F.regexp_extract("t.h", _HEADER, 2)).alias("speaker"), _edges_off(F.col("t.b")).alias("text"))
    return out.where("text <> ''")


def parse_labeled(sessions: DataFrame, dm_labels: list[str], player_labels: list[str], key: str = "session_id", content: str = "content") -> DataFrame:
    """Turns behind speaker labels (plain, in ** or in []), numbered from 1 without the empty ones."""
    head = rf"(?im)^\s*(?:\*\*)?\[?({_quoted(dm_labels + player_labels)})\]?(?:\*\*)?\s*:(?:\*\*)?"
    heads, bodies = F.regexp_extract_all(content, F.lit(head), F.lit(1)), F.slice(F.split(content, head), 2, 1 << 30)
    rows = sessions.select(key, F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("_pos", "t"))
    who = F.when(F.lower("t.h").isin([x.lower() for x in dm_labels]), "dm").otherwise("player")
    return _numbered(rows.select(key, "_pos", who.alias("speaker"), F.trim(F.regexp_replace("t.b", r"^\s+|\s+$", "")).alias("text")).where("text <> ''"), key)


def parse_alternating(sessions: DataFrame, first: str = "player", key: str = "session_id", content: str = "content") -> DataFrame:
    """Blocks between blank lines, the speakers by turns."""
    second = "dm" if first == "player" else "player"
    rows = sessions.select(key, F.posexplode(F.filter(F.transform(F.split(content, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")).alias("_pos", "text"))
    return _numbered(rows.withColumn("speaker", F.when(F.col("_pos") % 2 == 0, first).otherwise(second)), key)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session_id: the file's name, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("session_id"), F.col("value").alias("content"))


def read_turn_files(spark: SparkSession, path: str) -> DataFrame:
    """Turns of files ``turn-NNN-(player|dm).md``: turn_no, speaker, text without heading lines."""
    name = F.col("_metadata.file_name")
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="turn-*.md").select(name.alias("f"), "value")
    own = r"^turn-(\d+)-(player|dm)\.md$"
    return rows.where(F.col("f").rlike(own)).select(F.regexp_extract("f", own, 1).cast("bigint").alias("turn_no"), F.regexp_extract("f", own, 2).alias("speaker"), F.regexp_replace(F.regexp_replace("value", r"(?m)^#.*$\n?", ""), r"^\s+|\s+$", "").alias("text"))


def turn_texts(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """One text a turn: the dm's, then the player's."""
    part = lambda s: F.max(F.when(F.col("speaker") == s, F.col("text")))
    return turns.groupBy(key, "turn_no").agg(F.concat_ws("\n", part("dm"), part("player")).alias("text"))


def repeated_speakers(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Turns by the same speaker as the turn before."""
    w = Window.partitionBy(key).orderBy("turn_no")
    return turns.withColumn("_b", F.lag("speaker").over(w)).where("_b = speaker").drop("_b")


def slice_turns(turns: DataFrame, start: int = 1, most: int | None = None, key: str = "session_id") -> DataFrame:
    """Turns from ``start`` on, ``most`` of each session."""
    own = turns.where(F.col("turn_no") >= start)
    if most is None:
        return own
    return own.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("turn_no"))).where(F.col("_k") <= most).drop("_k")


def next_turn(turns: DataFrame, key: str = "session_id") -> DataFrame:
    return turns.groupBy(key).agg((F.coalesce(F.max("turn_no"), F.lit(0)) + 1).alias("next_turn"))


def write_turns(turns: DataFrame, path: str, mode: str = "append") -> None:
    turns.write.mode(mode).partitionBy("session_id").parquet(path)


ATTRIBUTE = "struct<value:array<string>,inference:boolean,confidence:double,source_turn:string>"
ENTITY_DDL = (
    "id string, name string, type string, identity string, current_status string, status_updated_turn string, "
    f"stable_attributes map<string,{ATTRIBUTE}>, volatile_state struct<condition:string,equipment:array<string>,location:string,last_updated_turn:string>, "
    "relationships array<struct<target_id:string,current_relationship:string,type:string,direction:string,status:string,confidence:double,first_seen_turn:string,last_updated_turn:string,resolved_turn:string,history:array<struct<turn:string,description:string>>>>, "
    "first_seen_turn string, last_updated_turn string, notes string"
)
EVENT_DDL = "id string, source_turns array<string>, type string, related_entities array<string>, description string, related_threads array<string>"


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity documents (one JSON file each, index.json left out); broken files are dropped."""
    rows = spark.read.schema(ENTITY_DDL + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True, mode="PERMISSIVE", recursiveFileLookup=True, pathGlobFilter="*.json")
    return rows.where(F.col("id").isNotNull() & (F.col("_metadata.file_name") != "index.json")).drop("_corrupt_record")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_DDL).json(path, multiLine=True, mode="DROPMALFORMED")


def edges_of(entities: DataFrame) -> DataFrame:
    """Relationships as rows; source_id is the entity that holds them."""
    return entities.select(F.col("id").alias("source_id"), F.explode("relationships").alias("r")).select("source_id", "r.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Extraction-log records, the last of each turn_id; records without one are dropped.

    JSON lines keep their order within a file by _metadata.file_block_start and the row's place in its partition.
    """
    rows = spark.read.schema(schema).json(path).where("turn_id is not null").withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    w = Window.partitionBy("turn_id").orderBy(F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_at")


def write_documents(entities: DataFrame, path: str) -> None:
    """Entities as JSON lines, a folder for each type."""
    entities.withColumn("catalog", F.col("type")).write.mode("overwrite").partitionBy("catalog").json(path)
