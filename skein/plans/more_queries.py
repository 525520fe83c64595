"""Further queries, registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import ids
from skein.operators import indices, profiles, resolution, selection, text_state, validation
from skein.plans.queries import _NAMES, _REFS, SQL, _mentions, query
from skein.sources import domain


@query("nevents", ", e AS (SELECT id, turn_no, regexp_replace(description, ' by User\\d+', '') AS description, ord FROM nevents) SELECT id, turn_no, description FROM (SELECT *, row_number() OVER (PARTITION BY turn_no, lower(trim(substr(description, 1, 100))) ORDER BY ord) AS k FROM e) WHERE k = 1")
def event_dedup(s, d):
    return profiles.distinct_events(domain.events(s, d).withColumn("description", F.regexp_replace("description", r" by User\d+", "")))


def _odd_ids(c):
    """Ids of characters without prefix, of locations with an unknown one, of items as they are, of factions with two."""
    return F.expr("case type when 'character' then replace(id, '-', '_') when 'location' then concat('npc-', replace(id, 'loc-', '')) when 'item' then id else concat('char-', replace(id, 'faction-', 'x-')) end")


@query("entities", r""" SELECT id, regexp_replace(id, '^[a-z]+-', '') AS stem, CASE split_part(id, '-', 1) WHEN 'char' THEN 'character' WHEN 'loc' THEN 'location' ELSE split_part(id, '-', 1) END AS kind, CASE type WHEN 'character' THEN 'char-' || replace(id, '-', '_') WHEN 'location' THEN 'loc-' || replace(id, 'loc-', '') WHEN 'item' THEN id ELSE 'faction-' || replace(id, 'faction-', 'x-') END AS fixed, upper(regexp_replace(id, '^[a-z]+-', '')[1]) || replace(regexp_replace(id, '^[a-z]+-', '')[2:], '-', ' ') AS name_of FROM entities""")
def id_helpers(s, d):
    e, c = domain.entities(s, d), F.col("id")
    return e.select("id", ids.stem(c).alias("stem"), ids.kind(c).alias("kind"), ids.fixed_prefix(_odd_ids(c), F.col("type")).alias("fixed"), ids.name_of(c).alias("name_of"))


_RAW_SEASONS = "CASE doc_id % 13 WHEN 0 THEN 'Autumn' WHEN 1 THEN 'mid-winter' WHEN 2 THEN 'Late fall' WHEN 3 THEN 'deep winter' WHEN 4 THEN 'early_spring' WHEN 5 THEN ' Summer ' WHEN 6 THEN 'late autumn' WHEN 7 THEN 'mid_spring' WHEN 8 THEN 'mid summer' WHEN 9 THEN 'Mid-Autumn' WHEN 10 THEN 'midfall' WHEN 11 THEN 'indian autumn' ELSE 'monsoon' END"


@query("", "SELECT 1")
def season_vocabularies(s, d):
    raw = domain.table(s, d, "documents").select("doc_id", F.expr(_RAW_SEASONS).alias("raw"))
    c = F.col("raw")
    return raw.select("doc_id", ids.season_of_state(c).alias("state"), ids.season_of_timeline(c).alias("timeline"), ids.season_label(ids.season_of_timeline(c)).alias("label"))


SQL["season_vocabularies"] = f"""WITH r AS (SELECT doc_id, {_RAW_SEASONS} AS raw FROM documents), f AS (SELECT doc_id, replace(replace(lower(trim(raw)), ' ', '_'), '-', '_') AS a, replace(lower(trim(raw)), ' ', '_') AS b FROM r),
t AS (SELECT doc_id, CASE WHEN a IN ('mid_spring', 'midspring') THEN 'spring' WHEN a IN ('mid_summer', 'midsummer', 'deep_summer') THEN 'summer' WHEN a IN ('autumn', 'mid_autumn', 'mid_fall', 'midfall') THEN 'fall' WHEN a IN ('deep_winter', 'midwinter') THEN 'mid_winter' ELSE replace(a, 'autumn', 'fall') END AS state, CASE WHEN b LIKE 'early\\_%' ESCAPE '\\' OR b LIKE 'mid\\_%' ESCAPE '\\' OR b LIKE 'late\\_%' ESCAPE '\\' THEN CASE WHEN b IN ('early_fall', 'mid_fall', 'late_fall') THEN split_part(b, '_', 1) || '_autumn' ELSE b END
  ELSE CASE b WHEN 'spring' THEN 'mid_spring' WHEN 'summer' THEN 'mid_summer' WHEN 'fall' THEN 'mid_autumn' WHEN 'autumn' THEN 'mid_autumn' WHEN 'winter' THEN 'mid_winter' ELSE b END END AS timeline FROM f)
SELECT doc_id, state, timeline, array_to_string(list_transform(string_split(replace(timeline, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM t"""


_OBS = """, obs AS (SELECT user_id % 12 AS subject, event_id AS ord, event_id % 40 + 1 AS turn_no, CASE event_type WHEN 'view' THEN 'tone' WHEN 'click' THEN 'structure_patterns' ELSE 'adversarial_level' END AS field, CASE event_type WHEN 'view' THEN 'tone ' || (event_id % 9) WHEN 'click' THEN 'p' || (event_id % 5) WHEN 'error' THEN 'a harsh turn' WHEN 'signup' THEN 'easy and fair' ELSE 'highly unclear' END AS observation, (event_id % 64) / 64.0::DOUBLE AS confidence FROM events)"""


@query("", "SELECT 1")
def profile_merge(s, d):
    e = domain.table(s, d, "events")
    return profiles.merge_profile(
        e.select(
            (F.col("user_id") % 12).alias("subject"),
            F.col("event_id").alias("ord"),
            (F.col("event_id") % 40 + 1).alias("turn_no"),
            F.expr("case event_type when 'view' then 'tone' when 'click' then 'structure_patterns' else 'adversarial_level' end").alias("field"),
            F.expr("case event_type when 'view' then 'tone ' || (event_id % 9) when 'click' then 'p' || (event_id % 5) when 'error' then 'a harsh turn' when 'signup' then 'easy and fair' else 'highly unclear' end").alias("observation"),
            ((F.col("event_id") % 64) / F.lit(64.0)).alias("confidence"),
        )
    )


SQL["profile_merge"] = "WITH " + _OBS[2:] + """, v AS (SELECT subject, unnest(CASE observation WHEN 'a harsh turn' THEN ['high'] WHEN 'easy and fair' THEN ['low', 'moderate'] ELSE [] END) AS level, confidence FROM obs WHERE field = 'adversarial_level'), w AS (SELECT subject, level, sum(confidence) AS w FROM v GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(w, 9) DESC, level) AS rn FROM w), t AS (SELECT subject, observation AS tone, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, ord) AS rn FROM obs WHERE field = 'tone'),
a AS (SELECT subject, coalesce(string_agg(DISTINCT CASE WHEN field = 'structure_patterns' THEN observation END, ',' ORDER BY CASE WHEN field = 'structure_patterns' THEN observation END), '') AS patterns, avg(confidence) * 0.4 + least(count(DISTINCT field) / 5, 1.0) * 0.3 + least(count(DISTINCT turn_no) / 20, 1.0) * 0.3 AS raw FROM obs GROUP BY 1)
SELECT a.subject, t.tone, patterns, coalesce(k.level, 'unknown') AS level, round_even(least(raw, 0.9), 2) AS confidence FROM a LEFT JOIN t ON t.subject = a.subject AND t.rn = 1 LEFT JOIN k ON k.subject = a.subject AND k.rn = 1"""


@query("turns entities", _NAMES + """, h AS (SELECT m.session_id, m.turn_no, lower(location) AS place FROM mentions m JOIN entities e ON e.id = entity_id WHERE location IS NOT NULL), c AS (SELECT DISTINCT h.session_id, h.turn_no, e.id AS entity_id FROM h JOIN entities e ON lower(e.location) = place OR (e.type = 'location' AND lower(e.id) = place))
SELECT session_id, turn_no, entity_id FROM c ANTI JOIN mentions USING (session_id, turn_no, entity_id)""")
def colocated(s, d):
    return selection.colocated(_mentions(s, d), domain.entities(s, d), ["session_id", "turn_no"])


@query("nevents", _REFS + " SELECT entity_id, count(*) AS events FROM refs WHERE entity_id NOT LIKE '%0' GROUP BY 1 ORDER BY 2 DESC, min(ord), 1 LIMIT 15")
def top_entities(s, d):
    r = indices.event_refs(domain.events(s, d))
    return selection.top_entities(r, r.where("entity_id like '%0'"), 15)


@query("nevents", "SELECT id, turn_no, type FROM nevents WHERE type IN ('arrival', 'offering') ORDER BY turn_no, ord LIMIT 15")
def critical_events(s, d):
    return selection.critical_events(domain.events(s, d), ("arrival", "offering"))


@query("entities", ", n AS (SELECT *, count(*) OVER (PARTITION BY type) AS n FROM entities), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY last_updated DESC, id) AS rank FROM n WHERE last_updated >= 70 OR (type = 'location' AND n <= 15)) SELECT id, type, last_updated, rank FROM k WHERE rank <= 20")
def catalog_summary(s, d):
    return selection.catalog_summary(domain.entities(s, d), 100, 30)


_TASKS = ", tasks AS (SELECT turn_no AS session_id, ord, ord % 7 = 0 AS is_new, (ord % 10) / 10.0::DOUBLE AS confidence FROM nevents)"


def _tasks(s, d):
    return domain.events(s, d).select(F.col("turn_no").alias("session_id"), "ord", (F.col("ord") % 7 == 0).alias("is_new"), ((F.col("ord") % 10) / F.lit(10.0)).alias("confidence"))


@query("nevents", _TASKS + """, o AS (SELECT *, is_new OR confidence >= 0.8 AS solo FROM tasks), g AS (SELECT *, CASE WHEN NOT solo THEN CAST(floor((row_number() OVER (PARTITION BY session_id, solo ORDER BY ord) - 1) / 4) AS BIGINT) END AS g FROM o)
SELECT session_id, ord, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY session_id, solo, g) > 1 THEN g END AS "group" FROM g""")
def detail_groups(s, d):
    return selection.detail_groups(_tasks(s, d), 4, 0.8)


@query("nevents", _TASKS + ", p AS (SELECT session_id, ord, is_new, row_number() OVER (PARTITION BY session_id, is_new ORDER BY confidence DESC, ord) AS k, count(*) FILTER (is_new) OVER (PARTITION BY session_id) AS n FROM tasks) SELECT session_id, ord AS id, is_new AS protected FROM p WHERE is_new OR k <= 22 - n")
def relevance_ceiling(s, d):
    from pyspark.sql import Window

    t = _tasks(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("confidence"), "ord")))
    return selection.with_ceiling(t.select("session_id", F.col("ord").alias("id"), F.col("is_new").alias("protected"), "rank"), 22)


@query("nevents", """, u AS (SELECT DISTINCT 'char-user-' || user_id AS id, 'User' || user_id AS name FROM events WHERE user_id % 3 = 0), a AS (SELECT unnest(refs) AS id, turn_no FROM nevents), b AS (SELECT lower(unnest(regexp_extract_all(description, '[\\p{L}\\p{N}_]+'))) AS name, turn_no FROM nevents)
SELECT id, min(turn_no) AS first_turn FROM (SELECT u.id, turn_no FROM a JOIN u USING (id) UNION ALL SELECT u.id, turn_no FROM b JOIN u ON lower(u.name) = b.name) GROUP BY 1""")
def earliest_mention(s, d):
    u = domain.table(s, d, "events").where("user_id % 3 = 0").select(F.concat(F.lit("char-user-"), F.col("user_id")).alias("id"), F.concat(F.lit("User"), F.col("user_id")).alias("name")).distinct()
    return selection.earliest_mention(domain.events(s, d), u)


@query("nevents entities", _REFS + ", n AS (SELECT entity_id AS id, count(*) AS refs, min(turn_no) AS first_turn FROM refs WHERE entity_id NOT IN (SELECT id FROM entities) GROUP BY 1) SELECT id, CASE WHEN id LIKE 'char-%' THEN 'User ' || substr(id, 11) ELSE 'K ' || substr(id, 8) END AS name, CASE WHEN id LIKE 'char-%' THEN 'character' ELSE 'item' END AS type, refs, first_turn FROM n WHERE refs >= CASE WHEN id LIKE 'char-%' THEN 5 ELSE 3 END")
def orphan_stubs(s, d):
    return selection.orphan_stubs(indices.event_refs(domain.events(s, d)), domain.entities(s, d), {"character": 5, "location": 2, "faction": 1})


@query("", "SELECT 1")
def segment_merge(s, d):
    o = domain.table(s, d, "orders")
    seg = o.select(F.concat(F.lit("char-"), F.col("o_custkey")).alias("id"), F.col("o_orderkey").alias("segment"), F.expr("if(o_orderkey % 4 = 0, 'stub of ' || o_orderpriority, 'buyer ' || o_orderpriority)").alias("identity"), F.expr("if(o_orderkey % 3 = 0, null, o_orderstatus)").alias("status"), domain.month_turn(F.col("o_orderdate")).alias("first_turn"), (domain.month_turn(F.col("o_orderdate")) + F.col("o_orderkey") % 5).alias("last_turn"))
    return profiles.merge_segments(seg)


SQL["segment_merge"] = """WITH s AS (SELECT 'char-' || o_custkey AS id, o_orderkey AS segment, CASE WHEN o_orderkey % 4 = 0 THEN 'stub of ' || o_orderpriority ELSE 'buyer ' || o_orderpriority END AS identity, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS first_turn FROM orders),
t AS (SELECT *, first_turn + segment % 5 AS last_turn FROM s), i AS (SELECT id, identity, row_number() OVER (PARTITION BY id ORDER BY contains(identity, 'stub'), length(identity) DESC, segment) AS rn FROM t), k AS (SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY last_turn DESC, segment DESC) AS rn FROM t WHERE status IS NOT NULL)
SELECT a.id, a.first_turn, a.last_turn, i.identity, k.status FROM (SELECT id, min(first_turn) AS first_turn, max(last_turn) AS last_turn FROM t GROUP BY id) a JOIN i ON i.id = a.id AND i.rn = 1 LEFT JOIN k ON k.id = a.id AND k.rn = 1"""


_EFFECTS = "SELECT session_id, turn_no, effect FROM (" + SQL["status_effects"].split("\n", 1)[1] + ")" if "status_effects" in SQL else ""


@query("scenes", "SELECT session_id, effect, min(turn_no) AS since_turn FROM (" + _EFFECTS + ") GROUP BY 1, 2")
def effect_states(s, d):
    return profiles.merge_effects(text_state.status_effects(domain.scenes(s, d)))


_CITES = "'See [turn-' || (doc_id % 90) || '] and [turn-0' || (doc_id % 13) || '], not turn-5, [turn-' || (doc_id % 90) || '].'"


@query("turns", f""", x AS (SELECT doc_id AS key, unnest(list_distinct(regexp_extract_all({_CITES}, '\\[turn-(\\d+)\\]', 1))) AS t FROM documents), k AS (SELECT DISTINCT turn_no FROM turns) SELECT key, count(*) AS cited, count(*) FILTER (turn_no IS NULL) AS missing FROM x LEFT JOIN k ON turn_no = CAST(t AS BIGINT) GROUP BY 1""")
def provenance(s, d):
    return profiles.provenance(domain.table(s, d, "documents").select(F.col("doc_id").alias("key"), F.expr(_CITES).alias("text")), domain.turns(s, d))


@query("nevents scenes", _REFS + """, w AS (SELECT DISTINCT entity_id, turn_no + unnest([-1, 0, 1]) AS turn_no FROM refs WHERE entity_id LIKE 'char-%5'), o AS (SELECT entity_id, turn_no, substr(text, 1, 500) AS text FROM w JOIN scenes USING (turn_no)), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY turn_no, text) AS rank FROM o)
SELECT entity_id, rank, turn_no, length(text) AS chars FROM k WHERE rank <= 10""")
def stub_context(s, d):
    return profiles.stub_context(indices.event_refs(domain.events(s, d)).where("entity_id like 'char-%5'"), domain.scenes(s, d))


@query("entities", "SELECT id AS key, rule FROM (SELECT id, unnest([CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN coalesce(identity, '') IN ('', 'SMALL') THEN 'identity' END, CASE WHEN last_updated - first_seen < 3 THEN 'span' END]) AS rule FROM entities) WHERE rule IS NOT NULL")
def entity_checks(s, d):
    c = F.col
    rules = {"name": F.coalesce(c("name"), F.lit("")) != "", "identity": ~F.coalesce(c("identity"), F.lit("")).isin("", "SMALL"), "span": c("last_updated") - c("first_seen") >= 3}
    return validation.check(domain.entities(s, d), "id", rules)


@query("entities edges", """ SELECT 'dangling' AS section, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS findings FROM edges WHERE target_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'duplicates', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM (SELECT 1 FROM edges GROUP BY source_id, target_id HAVING count(*) > 1)
UNION ALL SELECT 'stale', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM entities WHERE 120 - last_updated > 50""")
def quality_report(s, d):
    e, r = domain.entities(s, d), domain.edges(s, d)
    return validation.report({"dangling": indices.dangling_edges(r, e), "duplicates": validation.duplicate_relationships(r), "stale": validation.staleness(e, 120).where("status = 'FAIL'")})


@query("nevents", ", c AS (SELECT ord, CASE WHEN ord % 6 = 0 THEN '' WHEN ord % 6 < 3 THEN 'char-' || (ord % 5) END AS existing_id, CASE WHEN ord % 4 = 0 THEN '' ELSE 'item-' || ord END AS proposed_id, CASE WHEN ord % 5 > 0 THEN (ord % 5) / 5.0::DOUBLE END AS confidence FROM nevents) SELECT ord, coalesce(nullif(existing_id, ''), nullif(proposed_id, ''), '') AS ref FROM c WHERE coalesce(confidence, 0) >= 0.6")
def confident_refs(s, d):
    c = domain.events(s, d).selectExpr("ord", "case when ord % 6 = 0 then '' when ord % 6 < 3 then 'char-' || (ord % 5) end as existing_id", "case when ord % 4 = 0 then '' else 'item-' || ord end as proposed_id", "case when ord % 5 > 0 then (ord % 5) / 5.0D end as confidence")
    return selection.reference_id(selection.confident(c)).select("ord", "ref")


@query("", "SELECT 1")
def coreference_hints(s, d):
    from skein.plans.queries import _item_names

    return resolution.components(resolution.fuzzy_pairs(_item_names(s, d), 1)).groupBy(F.col("survivor").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("survivor"), F.col("id")))), ",").alias("variants"))


SQL["coreference_hints"] = SQL["dedup_components"].replace("<= 2)", "<= 1)").replace("SELECT id, min(r) AS survivor FROM reach GROUP BY id", "SELECT canonical, string_agg(id, ',' ORDER BY id) FILTER (id <> canonical) AS variants FROM (SELECT id, min(r) AS canonical FROM reach GROUP BY id) GROUP BY 1")
