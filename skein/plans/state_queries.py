"""Queries of documents, prompts around model calls, links, planning and season sections, with oracles that state the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import details, planning, profiles, text_state
from skein.plans.queries import query
from skein.sources import documents, domain


@query("entities edges", "SELECT CAST(max(greatest(first_seen, last_updated)) AS BIGINT) AS as_of_turn, count(*) AS entity_count, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE source_id LIKE 'loc-%' AND target_id LIKE 'loc-%' AND coalesce(status, 'active') = 'active')) AS connections FROM entities")
def scene_graph_summary(s, d):
    g = documents.scene_graph(domain.entities(s, d), domain.edges(s, d))
    n = g["location_connections"].agg(F.count("*").alias("connections"))
    return g["summary"].withColumn("_j", F.lit(1)).join(n.withColumn("_j", F.lit(1)), "_j").drop("_j")


@query("turns", ", n AS (SELECT CAST(session_id AS VARCHAR) AS session_id, count(DISTINCT turn_no) AS n FROM turns GROUP BY 1) SELECT session_id, CASE WHEN session_id LIKE '%3' THEN 'Known' ELSE session_id END AS title, CASE WHEN session_id LIKE '%3' THEN 'told' ELSE 'From an existing transcript.' END AS description, CASE WHEN session_id LIKE '%3' THEN greatest(n, 4) ELSE n END AS turn_count FROM n")
def session_metadata(s, d):
    t = domain.turns(s, d)
    known = t.select(F.col("session_id").cast("string").alias("session_id")).distinct().where("session_id like '%3'").select("session_id", F.lit("Known").alias("title"), F.lit("told").alias("description"), F.lit(4).cast("bigint").alias("turn_count"))
    return documents.session_metadata(t, known)


@query("turns", "SELECT session_id, turn_no, chr(10) || '---' || chr(10) || chr(10) || '## ' || turn_id || ' [' || speaker || ']' || chr(10) || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) AS block FROM turns")
def transcript_blocks(s, d):
    return documents.transcript_text(domain.turns(s, d))


@query("turns", ", m AS (SELECT session_id, max(turn_no) AS total_turns, max(turn_no) FILTER (session_id % 3 = 0 OR turn_no <= 4) AS last_completed_turn FROM turns GROUP BY 1) SELECT session_id, last_completed_turn, total_turns, CAST((SELECT count(*) FROM part) AS INTEGER) AS entities_discovered, last_completed_turn >= total_turns AS completed FROM m")
def run_progress(s, d):
    t = domain.turns(s, d)
    return documents.progress(t, t.where("session_id % 3 = 0 or turn_no <= 4"), domain.table(s, d, "part"))


@query("turns", ", k AS (SELECT session_id, turn_no, row_number() OVER (PARTITION BY session_id ORDER BY turn_no) AS k FROM turns WHERE speaker = 'dm' AND turn_no >= 2) SELECT session_id, turn_no FROM k WHERE k <= 2")
def dm_turns(s, d):
    return documents.dm_turns(domain.turns(s, d), 2, 2).select("session_id", "turn_no")


_NOTES = "'# Notes' || chr(10) || 'x' || chr(10) || '## Tone and Content Preferences' || chr(10) || '<!-- say -->' || c_mktsegment || chr(10) || '## House Rules' || chr(10) || '  rule ' || c_custkey || '  ' || chr(10) || '## Adversarial Level (Your Assessment)' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'pretty HIGH' WHEN 1 THEN '<!-- none -->' ELSE 'medium' END"


def _sections(s, d):
    return documents.user_sections(domain.table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.expr(_NOTES.replace("chr(10)", "'\\n'")).alias("content")))


@query("", "SELECT c_custkey AS session_id, 'Tone and Content Preferences' AS section, c_mktsegment AS content FROM customer UNION ALL SELECT c_custkey, 'House Rules', 'rule ' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'Adversarial Level (Your Assessment)', CASE c_custkey % 3 WHEN 0 THEN 'pretty HIGH' ELSE 'medium' END FROM customer WHERE c_custkey % 3 <> 1")
def user_sections(s, d):
    return _sections(s, d)


@query("", "SELECT c_custkey AS session_id, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'unknown' ELSE 'moderate' END AS adversarial_level, CASE WHEN c_custkey % 2 = 0 THEN 'grim; User notes: ' ELSE '' END || c_mktsegment AS tone, CASE WHEN c_custkey % 4 = 0 THEN 'n' || chr(10) || chr(10) ELSE '' END || 'House Rules: rule ' || c_custkey AS notes, CAST(CASE c_custkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 WHEN 3 THEN 0.9 ELSE 0.3 END AS DOUBLE) AS confidence FROM customer")
def profiles_with_notes(s, d):
    c = domain.table(s, d, "customer")
    none = F.array().cast("array<string>")
    p = c.select(F.col("c_custkey").alias("session_id"), F.lit("unknown").alias("adversarial_level"), F.when(F.col("c_custkey") % 2 == 0, "grim").alias("tone"), F.when(F.col("c_custkey") % 4 == 0, "n").when(F.col("c_custkey") % 4 == 1, "Profile not yet established.").alias("notes"), none.alias("hints"), none.alias("patterns"), F.expr("cast(case c_custkey % 5 when 0 then 0.95 when 1 then 0.1 when 2 then 0.5 when 3 then 0.9 else 0.3 end as double)").alias("confidence"))
    return planning.with_user_notes(p, _sections(s, d)).select("session_id", "adversarial_level", "tone", "notes", "confidence")


@query("entities", """, r AS (SELECT id, last_updated, CASE WHEN id LIKE '%17' THEN 0 WHEN id LIKE '%5' THEN 1 WHEN id LIKE '%8' THEN 2 ELSE 3 END AS t FROM entities) SELECT id, ['mentioned', 'colocated', 'one_hop', 'backfill'][t + 1] AS tier, last_updated FROM r WHERE t < 3 OR last_updated >= 40""")
def context_order(s, d):
    e = domain.entities(s, d)
    return planning.context_order(e.select("id", "last_updated"), e.where("id like '%17'"), e.where("id like '%5'"), e.where("id like '%8' or id like '%17'"), 90)


@query("entities edges", """, p AS (SELECT string_agg(coalesce(e.name, target_id) || ': ' || rel_type, '; ' ORDER BY target_id) AS ties FROM edges LEFT JOIN entities e ON e.id = target_id WHERE source_id = 'char-customer-7' AND coalesce(status, 'active') = 'active'), l AS (SELECT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 7)
SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'the camp' ELSE n_name END AS location, CASE WHEN conv_id % 3 = 0 THEN 'well' ELSE 'tired' END AS condition, CASE WHEN conv_id % 4 = 0 THEN 'a map' ELSE 'rod, ring' END AS inventory_notes, coalesce(ties, 'Unknown') AS relationships_summary FROM conversations, p, l""")
def player_states(s, d):
    k = F.col("session_id")
    sessions = domain.table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().select("session_id", F.when(k % 2 == 0, "the camp").otherwise("Unknown").alias("location"), F.when(k % 3 == 0, "well").alias("condition"), F.when(k % 4 == 0, "a map").otherwise("TODO: list").alias("inventory_notes"), F.lit("Unknown").alias("relationships_summary"))
    e = domain.entities(s, d)
    player = e.where("id = 'char-customer-7'").select("id", "location", F.lit("tired").alias("condition"), F.array(F.lit("rod"), F.lit("ring")).alias("equipment"))
    return planning.player_state(sessions, player, e, domain.edges(s, d))


@query("entities edges", " SELECT source_id, target_id, 'Adversarial: ' || a.name || ' vs ' || b.name AS statement FROM edges JOIN entities a ON a.id = source_id JOIN entities b ON b.id = target_id WHERE rel_type = 'rivalry' AND coalesce(status, 'active') = 'active'")
def state_risks(s, d):
    return planning.risks(domain.entities(s, d), domain.edges(s, d).withColumn("rel_type", F.when(F.col("rel_type") == "rivalry", "adversarial").otherwise(F.col("rel_type"))))


@query("", "SELECT p_partkey AS thread_id, CASE WHEN p_partkey % 3 = 0 THEN 'Pursue thread: ' || p_name ELSE 'Investigate: ' || unnest([p_name || '?', p_brand || '?']) END AS statement FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'Pursue thread: ' || p_name FROM part WHERE p_partkey % 6 = 0")
def state_opportunities(s, d):
    none = F.array().cast("array<string>")
    t = domain.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "active").otherwise("closed").alias("status"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.concat("p_name", F.lit("?")), F.concat("p_brand", F.lit("?")))).otherwise(none).alias("open_questions"))
    return planning.opportunities(t)


@query("", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'inferred' ELSE 'known' END AS kind, p_name || '''s brand' || CASE WHEN p_size % 2 = 0 THEN ' may be ' || p_brand ELSE ': ' || p_brand || ' (from turn-' || p_size || ')' END AS statement, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS confidence FROM part WHERE p_partkey % 5 <> 0")
def state_constraints(s, d):
    a = domain.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("brand").alias("key"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("value"), (F.col("p_size") % 2 == 0).alias("inference"), F.when(F.col("p_size") % 4 != 0, F.lit(0.25)).alias("confidence"), F.concat(F.lit("turn-"), "p_size").alias("source_turn"))
    return planning.constraints(a)





@query("", f"""WITH p AS (SELECT c_custkey, c_name || ' met ' AS a, 'Customer#' || printf('%09d', c_custkey + 1) AS n FROM customer) SELECT 'char-customer-' || c_custkey AS id, a || CASE WHEN c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN '[' || n || '](char-customer-' || (c_custkey + 1) || '.md)' ELSE n END || ' and [Nation_x](../locations/loc-x.md), [Nation_y] near Nation_x and no one.' AS text FROM p""")
def linked_prose(s, d):
    c = domain.table(s, d, "customer")
    prose = c.select(F.concat(F.lit("char-customer-"), "c_custkey").alias("id"), F.lit("characters").alias("folder"), F.concat("c_name", F.lit(" met "), F.format_string("Customer#%09d", F.col("c_custkey") + 1), F.lit(" and Nation_x, [Nation_y] near Nation_x and no one.")).alias("text"))
    places = s.createDataFrame([("loc-x", "Nation_x", "locations"), ("loc-y", "Nation_y", "locations"), ("loc-n", "one", "locations")], "id string, name string, folder string")
    return details.linkified(prose, prose.select("id", F.substring_index("text", " met ", 1).alias("name"), "folder").unionByName(places))


def _answer(prompts: list[str]) -> list[str]:
    """A model's stand-in: the entity, relationship and event that the prompt's own words make."""
    import json
    import re

    out = []
    for p in prompts:
        if p.startswith("Describe the"):
            m = re.match(r"Describe the (\w+) '(.*?)' \((.*?)\)", p)
            out.append("<think>hm</think>" + json.dumps({"entity": {"id": m[3], "name": m[2], "type": m[1], "identity": f"{m[2]}, by {len(p) % 7}", "last_updated": 95}}))
        elif p.startswith("Relationships"):
            who = p[len("Relationships between ") : p.index(" as JSON")].split(", ")
            out.append(json.dumps({"relationships": [{"source_id": who[0], "target_id": who[1], "type": "Ally of"}, {"source_id": who[0], "target_id": ""}]}))
        elif p.startswith("Events"):
            out.append(json.dumps({"events": [{"type": "Combat", "description": p.split("\n", 1)[1][:20], "source_turns": ["turn-500"]}]}))
        else:
            out.append("so it went: " + p)
    return out


@query("entities", "SELECT id, name, CASE WHEN id LIKE 'char-%' AND id LIKE '%3' THEN name || ', by ' || (length('Describe the character ''' || name || ''' (' || id || ') as JSON {\"entity\": {...}} by this text:') + 1 + length('of ' || name)) % 7 WHEN id LIKE 'char-%' AND id LIKE '%5' THEN '' ELSE identity END AS identity, CASE WHEN id LIKE 'char-%' AND id LIKE '%3' THEN greatest(last_updated, 95) ELSE last_updated END AS last_updated FROM entities WHERE type = 'character'")
def stub_backfill(s, d):
    stub = F.col("id").like("%3") | F.col("id").like("%5")
    e = domain.entities(s, d).where("type = 'character'").select("id", "type", "name", F.when(stub, "").otherwise(F.col("identity")).alias("identity"), "current_status", "first_seen", "last_updated", F.array().cast("array<string>").alias("aliases"))
    context = e.where("id like '%3'").select("id", F.concat(F.lit("of "), "name").alias("text"))
    return details.backfilled(e, e.select("id", F.lit(None).cast("string").alias("notes")), context, _answer).select("id", "name", "identity", "last_updated")


@query("turns edges entities", """, m AS (SELECT DISTINCT session_id, turn_no, id AS entity_id FROM (SELECT session_id, turn_no, unnest(['char-customer-' || (turn_no % 5), 'char-customer-' || (session_id % 5), 'loc-nation-1']) AS id FROM turns)), w AS (SELECT session_id, turn_no, list_sort(list(entity_id)) AS who FROM m GROUP BY ALL HAVING count(*) >= 2) SELECT session_id || '/' || turn_no AS id, who[1] AS source_id, who[2] AS target_id, 'social' AS rel_type, 'active' AS status FROM w""")
def relationship_answers(s, d):
    t = domain.turns(s, d)
    m = t.select("session_id", "turn_no", F.explode(F.array(F.concat(F.lit("char-customer-"), F.col("turn_no") % 5), F.concat(F.lit("char-customer-"), F.col("session_id") % 5), F.lit("loc-nation-1"))).alias("entity_id"))
    from skein.functions.provider import complete

    return details.answered_relationships(complete(details.relationship_prompts(t, m, ["session_id", "turn_no"]), _answer))


@query("turns", "SELECT session_id || '/' || turn_no AS id, 'encounter' AS type, substr(text, 1, 20) AS description, turn_id AS sources FROM turns WHERE trim(text) <> ''")
def event_answers(s, d):
    from skein.functions.provider import complete

    turn = F.format_string("turn-%03d", F.substring_index("id", "/", -1).cast("bigint"))
    found = details.answered_events(complete(details.event_prompts(domain.turns(s, d), ["session_id", "turn_no"]), _answer), turn)
    return found.select("id", "type", "description", F.array_join("sources", ",").alias("sources"))


_SECT = "CASE doc_id % 6 WHEN 0 THEN '**Season 2 Summary: Autumn**' || chr(10) || 'Regional Changes:' || chr(10) || 'The river froze.' || chr(10) || '**Rumors Reaching the Camp:**' || chr(10) || '- a wolf' || chr(10) || chr(10) || 'Prose again' WHEN 1 THEN 'In spring of year 4' || chr(10) || 'Faction Actions' || chr(10) || 'They met.' || chr(10) || 'Economic or Ecological Shifts:' || chr(10) || 'Trade grew.' WHEN 2 THEN 'Environmental Notes:' || chr(10) || 'only one' WHEN 3 THEN 'Winter Report:' || chr(10) || 'cold' ELSE 'no summary' END"


def _seasons(s, d):
    return domain.table(s, d, "documents").select(F.col("source").alias("session_id"), (F.col("doc_id") + 1).alias("turn_no"), F.expr(_SECT.replace("chr(10)", "'\\n'")).alias("text"))


@query("", "SELECT source AS session_id, doc_id + 1 AS turn_no, unnest(CASE doc_id % 6 WHEN 0 THEN ['regional_changes', 'rumors'] WHEN 1 THEN ['faction_actions', 'economic_shifts'] WHEN 2 THEN ['environmental_notes'] ELSE [] END) AS section, unnest(CASE doc_id % 6 WHEN 0 THEN ['The river froze.', '- a wolf'] WHEN 1 THEN ['They met.', 'Trade grew.'] WHEN 2 THEN ['only one'] ELSE [] END) AS content FROM documents")
def season_sections(s, d):
    return profiles.season_sections(_seasons(s, d))


@query("", "SELECT source AS session_id, doc_id + 1 AS turn_no, CASE doc_id % 6 WHEN 0 THEN 'fall' WHEN 1 THEN 'spring' ELSE 'winter' END AS season, CASE WHEN doc_id % 6 = 1 THEN 4 END AS year, CASE WHEN doc_id % 6 = 3 THEN 0 ELSE 2 END AS sections FROM documents WHERE doc_id % 6 IN (0, 1, 3)")
def season_summaries(s, d):
    return profiles.season_summaries(_seasons(s, d))


_MECH = "CASE doc_id % 5 WHEN 0 THEN 'Kael takes 7 damage from the wolf. HP: 12/20.' WHEN 1 THEN 'She picks up a silver key, and finds the old map.' WHEN 2 THEN 'He is poisoned and prone.' WHEN 3 THEN 'New item acquired: Red Rod' ELSE 'nothing here' END"


@query("", "SELECT source AS session_id, doc_id + 1 AS turn_no, CASE WHEN doc_id % 5 = 0 THEN 12 END AS hp, CASE WHEN doc_id % 5 = 0 THEN '-7' END AS delta, CASE doc_id % 5 WHEN 0 THEN '7 damage from the wolf' WHEN 1 THEN 'old map,silver key' WHEN 3 THEN 'red rod' ELSE '' END AS items, CASE WHEN doc_id % 5 = 2 THEN 'poisoned,prone' ELSE '' END AS effects FROM documents WHERE doc_id % 5 <> 4")
def mechanical_state(s, d):
    t = domain.table(s, d, "documents").select(F.col("source").alias("session_id"), (F.col("doc_id") + 1).alias("turn_no"), F.expr(_MECH).alias("text"))
    m = text_state.mechanical_state(t, s.createDataFrame([], "id string, name string"))
    return m.select("session_id", "turn_no", F.col("hp.numeric").alias("hp"), F.col("hp.delta").alias("delta"), F.array_join("items", ",").alias("items"), F.array_join("effects", ",").alias("effects"))
