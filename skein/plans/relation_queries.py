"""Queries of relationships and envelopes, stale entities and phases of paired runs, with oracles that state the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import indices, relations, stats, validation
from skein.plans.queries import query
from skein.sources import domain


@query("entities edges", """, x AS (SELECT source_id AS id, 0 AS side, edges.* FROM edges UNION ALL SELECT target_id, 1, edges.* FROM edges), g AS (SELECT id, string_agg(CASE WHEN side = 0 THEN source_id || '>' || target_id || ':' || coalesce(status, 'active') END, ',' ORDER BY source_id, target_id) AS forward, string_agg(CASE WHEN side = 1 THEN source_id || '>' || target_id || ':' || coalesce(status, 'active') END, ',' ORDER BY source_id, target_id) AS reverse FROM x GROUP BY id)
SELECT g.id, coalesce(name, '') AS name, coalesce(type, CASE split_part(g.id, '-', 1) WHEN 'char' THEN 'character' WHEN 'loc' THEN 'location' WHEN 'faction' THEN 'faction' WHEN 'item' THEN 'item' ELSE '' END) AS type, coalesce(forward, '') AS forward, coalesce(reverse, '') AS reverse FROM g LEFT JOIN entities USING (id)""")
def relationship_adjacency(s, d):
    a = relations.adjacency(domain.entities(s, d), domain.edges(s, d))
    line = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["source_id"], F.lit(">"), e["target_id"], F.lit(":"), e["status"])), ",").alias(c)
    return a.select("id", "name", "type", line("forward"), line("reverse"))


@query("entities edges", """, l AS (SELECT source_id, string_agg(target_id || '=' || coalesce(e.name, '?'), ',' ORDER BY target_id) AS ties FROM edges LEFT JOIN entities e ON e.id = target_id WHERE coalesce(status, 'active') = 'active' GROUP BY 1) SELECT id, name, identity, current_status, CASE WHEN type <> 'location' THEN location END AS location, CASE WHEN type = 'location' THEN '' ELSE coalesce(ties, '') END AS relationships FROM entities LEFT JOIN l ON source_id = id WHERE id LIKE '%1'""")
def scene_envelopes(s, d):
    e = domain.entities(s, d)
    out = relations.scene_envelopes(e.where("id like '%1'"), e, domain.edges(s, d))
    return out.withColumn("relationships", F.array_join(F.transform("relationships", lambda r: F.concat(r["target_id"], F.lit("="), F.coalesce(r["target_name"], F.lit("?")))), ","))


_T = "m AS (SELECT id FROM (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) WHERE id LIKE '%3'), k AS (SELECT *, source_id IN (SELECT id FROM m) AS s, target_id IN (SELECT id FROM m) AS t FROM edges), b AS (SELECT *, CASE WHEN s AND t THEN 1 WHEN (s OR t) AND 90 - last_turn <= 15 THEN 2 WHEN (s OR t) AND status = 'active' THEN 3 ELSE 4 END AS tier FROM k)"


def _mentioned(s, d):
    return domain.edges(s, d).select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).where("entity_id like '%3'").distinct()


@query("edges", ", " + _T + " SELECT source_id, target_id, rel_type, last_turn, CAST(CASE WHEN rel_type = 'alliance' AND (s OR t) AND tier >= 3 THEN 2 WHEN rel_type = 'alliance' AND tier = 4 THEN 3 ELSE tier END AS BIGINT) AS tier FROM b")
def typed_tiers(s, d):
    return relations.typed_tiers(domain.edges(s, d), _mentioned(s, d), 90, ("alliance",))


@query("edges", ", " + _T + ", c AS (SELECT *, CASE WHEN rel_type = 'alliance' THEN 'permanent' WHEN t THEN 'mentioned' ELSE 'volatile' END AS kind FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind ORDER BY last_turn DESC, target_id, rel_type) AS n FROM c) SELECT source_id, target_id, rel_type, last_turn, kind FROM r WHERE kind <> 'volatile' OR n <= 3")
def player_relationships(s, d):
    return relations.player_relationships(domain.edges(s, d), _mentioned(s, d), ("alliance",), 3)


@query("edges", ", " + _T + ", c AS (SELECT *, t OR (coalesce(status, 'active') = 'active' AND 90 - last_turn <= 30) AS in_full FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY in_full DESC, last_turn DESC, target_id, rel_type) AS rank FROM c) SELECT source_id, target_id, rel_type, in_full, rank FROM r WHERE rank <= 5")
def scene_relationships(s, d):
    return relations.scene_relationships(domain.edges(s, d), _mentioned(s, d), 90, 30, 5)


@query("interactions", """, o AS (SELECT *, lag(description) OVER w AS b, lag(turn) OVER w AS bt, row_number() OVER (PARTITION BY source_id, target_id ORDER BY turn DESC, ord DESC, description DESC) AS k FROM interactions WINDOW w AS (PARTITION BY source_id, target_id ORDER BY turn, ord, description))
SELECT source_id, target_id, 'other' AS rel_type, any_value(status) FILTER (k = 1) AS status, any_value(description) FILTER (k = 1) AS description, min(turn) AS first_turn, max(turn) AS last_turn, coalesce(string_agg(CASE WHEN b <> description THEN bt || ':' || b END, ',' ORDER BY turn, ord, description), '') AS history FROM o GROUP BY 1, 2""")
def consolidated_relationships(s, d):
    out = relations.consolidated(domain.interactions(s, d))
    return out.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat(h["turn"], F.lit(":"), h["description"])), ","))


@query("edges interactions", """, h AS (SELECT source_id, target_id, list({'turn': turn, 'description': description} ORDER BY turn, ord, description) AS h FROM interactions GROUP BY 1, 2), t AS (SELECT e.*, coalesce(h, []) AS h, e.last_turn % 4 + 1 AS tier FROM edges e JOIN h USING (source_id, target_id)),
j AS (SELECT *, array_to_string(list_transform(CASE tier WHEN 1 THEN h ELSE h[-1:] END, lambda x: '{"turn":' || x.turn || ',"description":"' || x.description || '"}'), ',') AS shown FROM t)
SELECT source_id, target_id, CASE WHEN tier <= 2 THEN '{"source_id":"' || source_id || '","target_id":"' || target_id || '","rel_type":"' || rel_type || '","status":"' || status || '","description":"of ' || rel_type || '","history":[' || shown || ']}' WHEN tier = 3 THEN '{"source_id":"' || source_id || '","target_id":"' || target_id || '","rel_type":"' || rel_type || '","status":"' || status || '"}' END AS written FROM j""")
def written_relationships(s, d):
    h = domain.interactions(s, d).groupBy("source_id", "target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "ord", "description"))), lambda x: F.struct(x["turn"].alias("turn"), x["description"].alias("description"))).alias("h"))
    e = domain.edges(s, d).join(h, ["source_id", "target_id"]).withColumn("description", F.concat(F.lit("of "), "rel_type"))
    return e.select("source_id", "target_id", relations.written_relationship(F.col("last_turn") % 4 + 1, F.col("h")).alias("written"))


@query("nevents", ", r AS (SELECT unnest(refs) AS id, turn_no FROM nevents), f AS (SELECT id, min(turn_no) AS t FROM r GROUP BY 1) SELECT 'char-user-' || u AS id, CASE WHEN u % 2 = 0 THEN coalesce(f.t, 50) ELSE 2 END AS first_seen FROM (SELECT unnest(range(0, 300)) AS u) LEFT JOIN f ON f.id = 'char-user-' || u")
def filled_first_seen(s, d):
    e = s.range(300).select(F.concat(F.lit("char-user-"), "id").alias("id"), F.when(F.col("id") % 2 != 0, F.lit(2).cast("bigint")).alias("first_seen"), F.lit(50).cast("bigint").alias("last_updated"))
    return relations.filled_first_seen(e, indices.event_refs(domain.events(s, d))).select("id", "first_seen")


_STALE = """, s AS (SELECT id, type, 120 - last_updated AS gap, CASE WHEN id LIKE '%7' THEN 3 ELSE 0 END AS events FROM entities WHERE 120 - last_updated > 20 AND id NOT LIKE '%2'), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY gap DESC, events DESC, id) AS k FROM s), f AS (SELECT *, k <= CASE type WHEN 'character' THEN 13 WHEN 'location' THEN 5 WHEN 'item' THEN 5 WHEN 'faction' THEN 2 ELSE 0 END AS own FROM k WHERE k <= 25)"""


@query("entities", _STALE + " SELECT id, type, gap, events FROM f ORDER BY own DESC, gap DESC, events DESC, id LIMIT 25")
def stale_entities(s, d):
    e = domain.entities(s, d)
    mentions = e.select(F.col("id").alias("entity_id"), F.when(F.col("id").like("%2"), 1).otherwise(119).alias("turn_no"))
    events = e.where("id like '%7'").select(F.explode(F.array_repeat("id", 3)).alias("entity_id"))
    return relations.stale_entities(e, mentions, events, 120, 20, 10, {"character": 0.5, "location": 0.2, "item": 0.2, "faction": 0.1})


@query("turns", ", n AS (SELECT 'char-customer-' || c_custkey AS id, unnest([c_name, 'The ' || ['Fire', 'Old Fire', 'xy', 'Snow', 'Kael'][c_custkey % 5 + 1]]) AS name FROM customer) SELECT DISTINCT id, name FROM n WHERE lower(name) NOT IN ('the fire', 'the snow')")
def mention_names(s, d):
    e = domain.table(s, d, "customer").select(F.concat(F.lit("char-customer-"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("The "), F.element_at(F.array(*map(F.lit, ("Fire", "Old Fire", "xy", "Snow", "Kael"))), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("aliases"))
    return relations.mention_names(e)


_LOG = "l AS (SELECT CASE user_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' ELSE 'B2' END AS run, event_type AS phase, event_id // 50 + 1 AS turn_no, event_id % 500 + 100 AS tokens FROM events), g AS (SELECT run, run[1] AS arm, phase, turn_no, count(*) AS calls, sum(tokens) AS tokens FROM l GROUP BY ALL)"


def _log(s, d):
    own = domain.table(s, d, "events").select(F.expr("case user_id % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end").alias("run"), F.col("event_type").alias("phase"), (F.floor(F.col("event_id") / 50) + 1).cast("long").alias("turn_no"), (F.col("event_id") % 500 + 100).alias("tokens"))
    return own.select("run", F.substring("run", 1, 1).alias("arm"), "phase", "turn_no", F.lit(1).alias("calls"), "tokens")


@query("", "WITH " + _LOG + " SELECT phase, turn_no, avg(CASE WHEN arm = 'A' THEN tokens / calls END) AS a, avg(CASE WHEN arm = 'B' THEN tokens / calls END) AS b, avg(CASE WHEN arm = 'B' THEN tokens / calls END) - avg(CASE WHEN arm = 'A' THEN tokens / calls END) AS delta, CAST(sum(calls) AS BIGINT) AS weight FROM g GROUP BY 1, 2 HAVING count(*) = 4 AND min(calls) = max(calls)")
def phase_deltas(s, d):
    return stats.phase_deltas(_log(s, d), 4)


@query("", "WITH " + _LOG + " SELECT phase, turn_no, avg(CASE WHEN arm = 'A' THEN tokens END)::DOUBLE AS a, avg(CASE WHEN arm = 'B' THEN tokens END)::DOUBLE AS b, avg(CASE WHEN arm = 'B' THEN tokens END)::DOUBLE - avg(CASE WHEN arm = 'A' THEN tokens END)::DOUBLE AS delta, CAST(sum(calls) AS BIGINT) AS weight FROM g GROUP BY 1, 2 HAVING count(*) = 4")
def phase_totals(s, d):
    return stats.phase_deltas(_log(s, d), 4, per_call=False)


@query("", "SELECT key, rule FROM (SELECT event_id AS key, unnest([CASE WHEN event_id % 3 = 0 THEN 'id' END, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'source_turns' END, CASE WHEN event_type = 'click' THEN 'type' END, CASE WHEN event_id % 11 = 0 THEN 'description' END]) AS rule FROM events) WHERE rule IS NOT NULL")
def event_checks(s, d):
    k = F.col("event_id")
    e = domain.table(s, d, "events").select(
        k.alias("key"),
        F.when(k % 3 != 0, F.concat(F.lit("evt-"), k)).otherwise(F.concat(F.lit("event-"), k)).alias("id"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("turn-1"))).otherwise(F.array(F.lit("turn-001"), F.lit("turn-1234"))).alias("source_turns"),
        F.when(F.col("event_type") == "click", "teleport").otherwise("birth").alias("type"),
        F.when(k % 11 != 0, "said").alias("description"),
    )
    return validation.check(e, "key", relations.event_rules())
