"""The narrative domain on relational tables: turns, entities, edges, events and logs.

Each function maps driver tables to one domain table with narrow expressions (and one
aggregation for edges), so filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_turn(date: Column) -> Column:
    """Orders' months as turns, from January 1995 on."""
    return ((F.year(date) - 1995) * 12 + F.month(date)).cast("long")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: session_id, turn_no, turn_id, speaker, text (some name entities)."""
    seed = F.expr("""case conv_id % 5 when 0 then ' The red plate gleams.' when 1 then ' A small widget, and char-customer-7 waits.'
                     when 2 then ' Redplate and char-customer-77.' when 3 then ' Old rod! hot ring?' else '' end""")
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("turn_no"),
        F.format_string("turn-%03d", F.col("turn") + 1).alias("turn_id"),
        F.when(F.col("role") == "assistant", "dm").otherwise("player").alias("speaker"),
        F.concat(F.col("text"), seed).alias("text"),
    )


#: Lines with game state that the generated prose lacks, by divisor of the document id.
SEEDS = (
    (3, "Used fire bolt"),
    (5, "--- Long rest ---"),
    (7, "Early winter arrives. The first snow and frost cover frozen ground."),
    (11, "New item acquired: silver key"),
    (13, "Kael takes 7 damage from the wolf. HP: 12/20."),
    (17, "The scout is poisoned by nightshade, and days pass before the thaw."),
    (19, "Reached level 4"),
    (23, "Warm heat of summer and harvest growth. A child is born at dawn."),
    (29, "The guard is badly wounded and exhausted from the march."),
)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as turns of one session for each source: session_id, turn_no, turn_id, text."""
    parts = [F.when(F.col("doc_id") % k == 0, F.lit("\n" + line)).otherwise("") for k, line in SEEDS]
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("session_id"),
        (F.col("doc_id") + 1).alias("turn_no"),
        F.format_string("turn-%03d", F.col("doc_id") + 1).alias("turn_id"),
        F.concat(F.coalesce("text", F.lit("")), *parts).alias("text"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: id, name, type, identity, current_status, location, first_seen, last_updated."""
    rows = [
        ("customer", ["'char-customer-' || c_custkey", "c_name", "'character'", "c_mktsegment", "if(c_custkey % 3 = 0, null, 'trades in ' || lower(c_mktsegment))", "'loc-nation-' || c_nationkey", "1 + c_custkey % 40", "41 + c_custkey % 60"]),
        ("supplier", ["'faction-supplier-' || s_suppkey", "s_name", "'faction'", "'supplier'", "null", "'loc-nation-' || s_nationkey", "1 + s_suppkey % 50", "51 + s_suppkey % 50"]),
        ("part", ["'item-part-' || p_partkey", "p_name", "'item'", "p_type", "null", "null", "1 + p_partkey % 80", "1 + p_partkey % 80 + p_partkey % 21"]),
        ("nation", ["'loc-nation-' || n_nationkey", "n_name", "'location'", "'nation'", "null", "'loc-region-' || n_regionkey", "1", "100"]),
        ("region", ["'loc-region-' || r_regionkey", "r_name", "'location'", "'region'", "null", "null", "1", "100"]),
    ]
    names = ["id", "name", "type", "identity", "current_status", "location", "first_seen", "last_updated"]
    out = None
    for source, exprs in rows:
        one = table(spark, sf_dir, source).selectExpr(*(f"cast({e} as {'bigint' if n in ('first_seen', 'last_updated') else 'string'}) as {n}" for e, n in zip(exprs, names)))
        out = one if out is None else out.unionByName(one)
    return out


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: source_id (customer), target_id (supplier), turn, ord, status, rel_type, description."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("char-customer-"), F.col("o_custkey")).alias("source_id"),
        F.concat(F.lit("faction-supplier-"), F.col("l_suppkey")).alias("target_id"),
        month_turn(F.col("o_orderdate")).alias("turn"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "active").otherwise("dormant").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "alliance").when(F.col("o_orderpriority").startswith("2"), "rivalry").otherwise("trade").alias("rel_type"),
        F.concat(F.lit("order "), F.col("o_orderpriority"), F.lit(" of "), F.col("l_quantity").cast("int")).alias("description"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships: source_id, target_id, rel_type, status (may be null), first_turn, last_turn."""
    latest = F.max(F.struct("turn", "ord", "status", "rel_type"))
    trade = interactions(spark, sf_dir).groupBy("source_id", "target_id").agg(F.min("turn").alias("first_turn"), latest.alias("m"))
    trade = trade.selectExpr("source_id", "target_id", "m.rel_type as rel_type", "m.status as status", "first_turn", "m.turn as last_turn")
    homes = table(spark, sf_dir, "customer").selectExpr("'char-customer-' || c_custkey as source_id", "'loc-nation-' || c_nationkey as target_id", "'spatial' as rel_type", "cast(null as string) as status", "1L as first_turn", "1L + c_custkey % 90 as last_turn")
    lands = table(spark, sf_dir, "nation").selectExpr("'loc-nation-' || n_nationkey as source_id", "'loc-region-' || n_regionkey as target_id", "'spatial' as rel_type", "'active' as status", "1L as first_turn", "100L as last_turn")
    return trade.unionByName(homes).unionByName(lands)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrative events: id, ord, turn_no, type, refs (array), description."""
    k = F.get_json_object("props", "$.k")
    kind = F.expr("case event_type when 'view' then 'examination' when 'click' then 'encounter' when 'purchase' then 'offering' when 'signup' then 'arrival' else 'other' end")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("id"),
        F.col("event_id").alias("ord"),
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("turn_no"),
        kind.alias("type"),
        F.array(F.concat(F.lit("char-user-"), F.col("user_id")), F.concat(F.lit("item-k-"), k)).alias("refs"),
        F.concat(F.initcap("event_type"), F.lit(" by User"), F.col("user_id"), F.lit(" near Gate"), k).alias("description"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction logs of two runs of each arm: run, arm, turn_no, calls, tokens."""
    hour = F.hour("ts") + 24 * F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    own = table(spark, sf_dir, "events").select(F.expr("case user_id % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end").alias("run"), (hour + 1).cast("long").alias("turn_no"), (F.col("event_id") % 500 + 100).alias("tokens"))
    return own.groupBy("run", "turn_no").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).withColumn("arm", F.substring("run", 1, 1))
