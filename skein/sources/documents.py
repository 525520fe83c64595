"""Documents beside the tables: events, timelines, scene graphs, sidecars, logs, progress, transcripts and metadata, as files that executors write.

A kind of document is a folder; records are JSON lines in it, so any number of tasks write at once. A document that replaces another
is written whole (``overwrite``), a log is appended to. Transcripts are text files, one folder for each session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import indices

TIMELINE_DDL = "session_id string, id string, type string, turn_no long, season string, description string, raw_text string, estimated_day long, confidence double"
ARC_DDL = "entity_id string, target_id string, current_relationship string, interaction_count long, arc_summary array<struct<phase:string,first_turn:long,last_turn:long,type:string,summary:string,key_turn:long>>"
PAGE_DDL = "entity_id string, events long, phases array<struct<title:string,first_turn:long,last_turn:long,events:long>>"
CALL_DDL = "turn string, phase string, entity_id string, system_prompt string, user_prompt string, answer string, error string"
DEMOTION_DDL = "turn string, source_id string, target_id string, rel_type string, staleness long, degree long, mention_source string, would_demote boolean"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of a kind; none where nothing was written. Broken lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)


def write(rows: DataFrame, path: str, dry_run: bool = False) -> None:
    """Replace a kind's records by these; they must not be read from ``path`` themselves."""
    if not dry_run:
        rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Add log records: extraction logs, demotion shadows, raw calls."""
    rows.write.mode("append").json(path)


def scene_graph(entities: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The scene graph's parts: location_index, turn_activity, location_connections, and summary (as_of_turn, entity_count)."""
    return {
        "location_index": indices.location_index(entities, edges),
        "turn_activity": indices.turn_activity(entities),
        "location_connections": indices.location_edges(edges),
        "summary": entities.agg(F.coalesce(F.max(F.greatest("first_seen", "last_updated")), F.lit(0)).alias("as_of_turn"), F.count("*").alias("entity_count")),
    }


def write_scene_graph(graph: dict[str, DataFrame], path: str) -> None:
    for name, part in graph.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def read_scene_graph(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    names = ("location_index", "turn_activity", "location_connections", "summary")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names} if exists(spark, f"{path}/summary") else None


def write_sidecars(rows: DataFrame, path: str, kind: str) -> None:
    """One folder ``<entity_id>.<kind>`` for each entity with its records; other entities' sidecars stay."""
    named = rows.withColumn("sidecar", F.concat("entity_id", F.lit(f".{kind}")))
    old = rows.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        named.write.mode("overwrite").partitionBy("sidecar").json(f"{path}/{kind}")
    finally:
        rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def read_sidecars(spark: SparkSession, path: str, kind: str, ddl: str) -> DataFrame:
    return read(spark, f"{path}/{kind}", ddl)


def transcript_text(turns: DataFrame) -> DataFrame:
    """(session_id, turn_no, block): each turn as its block of a full transcript."""
    head = F.format_string("\n---\n\n## turn-%03d [%s]\n\n", "turn_no", "speaker")
    return turns.select("session_id", "turn_no", F.concat(head, F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n")).alias("block"))


def write_full_transcripts(turns: DataFrame, path: str, overwrite: bool = False, replace_raw: bool = False) -> str:
    """Each session's full transcript as text in a folder of its own. What is there stays unless both flags are given; then it is
    kept beside as ``.bak-<time>``. Returns written or skipped."""
    spark = turns.sparkSession
    at, fs = _fs(spark, path)
    if fs.exists(at):
        if not (overwrite and replace_raw):
            return "skipped"
        import time

        fs.rename(at, _fs(spark, f"{path}.bak-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}")[0])
    rows = transcript_text(turns).withColumn("block", F.when(F.col("turn_no") == 1, F.concat(F.lit("# Full Transcript\n"), "block")).otherwise(F.col("block")))
    rows.repartition("session_id").sortWithinPartitions("session_id", "turn_no").select("session_id", F.regexp_replace("block", r"\n\z", "").alias("value")).write.partitionBy("session_id").text(path)
    return "written"


def append_to_transcripts(turns: DataFrame, path: str) -> None:
    """Add turns behind the sessions' transcripts, as further files of their folders."""
    rows = transcript_text(turns).repartition("session_id").sortWithinPartitions("session_id", "turn_no")
    rows.select("session_id", F.regexp_replace("block", r"\n\z", "").alias("value")).write.mode("append").partitionBy("session_id").text(path)


def session_metadata(turns: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, title, description, turn_count): new sessions get a title from their id; known ones (current) keep theirs, and the greater count."""
    n = turns.groupBy("session_id").agg(F.countDistinct("turn_no").alias("_n"))
    both = n.withColumn("session_id", F.col("session_id").cast("string")).join(current.withColumnRenamed("turn_count", "_old"), "session_id", "full")
    title = F.coalesce("title", F.initcap(F.replace("session_id", F.lit("-"), F.lit(" "))))
    return both.select("session_id", title.alias("title"), F.coalesce("description", F.lit("From an existing transcript.")).alias("description"), F.greatest(F.coalesce("_n", F.lit(0)), F.coalesce("_old", F.lit(0))).alias("turn_count"))


def progress(turns: DataFrame, done: DataFrame, entities: DataFrame) -> DataFrame:
    """(session_id, last_completed_turn, total_turns, entities_discovered, completed) of sessions; done: session_id, turn_no."""
    last = done.groupBy("session_id").agg(F.max("turn_no").alias("last_completed_turn"))
    total = turns.groupBy("session_id").agg(F.max("turn_no").alias("total_turns"))
    n = entities.count()
    out = total.join(last, "session_id", "left")
    return out.select("session_id", "last_completed_turn", "total_turns", F.lit(n).alias("entities_discovered"), F.coalesce(F.col("last_completed_turn") >= F.col("total_turns"), F.lit(False)).alias("completed"))


def dm_turns(turns: DataFrame, start: int = 0, most: int = 0) -> DataFrame:
    """The dm's turns of each session from ``start`` on, the first ``most`` of them (0: all)."""
    from skein.sources.transcripts import slice_turns

    return slice_turns(turns.where("speaker = 'dm'"), start, most or None)


def user_sections(files: DataFrame) -> DataFrame:
    """(session_id, section, content) of notes (session_id, content): text under ``## `` headings without comments, the last of a name; empty ones are dropped."""
    heads, bodies = F.regexp_extract_all("content", F.lit(r"(?m)^## (.*)$"), F.lit(1)), F.slice(F.split("content", r"(?m)^## .*$"), 2, 1 << 30)
    each = files.select("session_id", F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("_at", "s"))
    text = F.trim(F.regexp_replace(F.regexp_replace("s.b", r"(?s)<!--.*?-->", ""), r"^\s+|\s+$", ""))
    own = each.select("session_id", F.trim("s.h").alias("section"), text.alias("content"), "_at").where("content <> ''")
    return own.groupBy("session_id", "section").agg(F.max_by("content", "_at").alias("content"))
