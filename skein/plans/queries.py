"""Every query of the engine by name: domain tables bound to operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import turns as T
from skein.operators import indices, mentions, resolution, sequences, stats, text_state
from skein.plans.sql_base import over
from skein.sources import domain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_B = r"[^\p{L}\p{N}_]"  # what bounds a word in the oracle's regular expressions


def query(tables: str, body: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the named domain tables."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        SQL[f.__name__] = over(tables, body)
        return f

    return add


def _item_names(s: SparkSession, d: str) -> DataFrame:
    return domain.table(s, d, "part").select(F.concat(F.lit("item-"), F.regexp_replace("p_name", " ", "-")).alias("id"), F.col("p_name").alias("name"), F.lit("item").alias("type")).distinct()


def _names(s: SparkSession, d: str) -> DataFrame:
    people = domain.table(s, d, "customer").select(F.concat(F.lit("char-customer-"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    return _item_names(s, d).select("id", "name").unionByName(people)


_NAMES = """, names AS (SELECT DISTINCT 'item-' || replace(p_name, ' ', '-') AS id, p_name AS name FROM part UNION ALL SELECT 'char-customer-' || c_custkey, c_name FROM customer),
mentions AS (SELECT DISTINCT session_id, turn_no, id AS entity_id FROM turns JOIN (SELECT * FROM names WHERE id LIKE 'item-%') n ON CASE WHEN contains(lower(text), lower(name)) THEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || lower(name) || '([^\\p{L}\\p{N}_]|$)') ELSE false END
  UNION SELECT DISTINCT session_id, turn_no, id FROM (SELECT session_id, turn_no, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) AS id FROM turns) JOIN (SELECT DISTINCT id FROM names) USING (id)
  UNION SELECT DISTINCT session_id, turn_no, n.id FROM (SELECT session_id, turn_no, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM turns) t JOIN names n ON lower(n.name) = t.w)"""


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return mentions.mention_join(domain.turns(s, d), _names(s, d), ["session_id", "turn_no"], longest=3)


@query("turns", _NAMES + " SELECT session_id, turn_no, entity_id FROM mentions")
def mention_pairs(s, d):
    return _mentions(s, d)


_HOP = _NAMES + """, hop AS (SELECT DISTINCT m.session_id, m.turn_no, e.target_id AS entity_id FROM mentions m JOIN edges e ON e.source_id = m.entity_id WHERE coalesce(e.status, 'active') = 'active'
  AND NOT EXISTS (SELECT 1 FROM mentions k WHERE k.session_id = m.session_id AND k.turn_no = m.turn_no AND k.entity_id = e.target_id))"""


@query("turns edges", _HOP + " SELECT session_id, turn_no, entity_id FROM hop")
def one_hop_active(s, d):
    return mentions.one_hop(_mentions(s, d), domain.edges(s, d), ["session_id", "turn_no"])


@query("turns edges entities", _HOP + ", b AS (SELECT *, 'mentioned' AS role FROM mentions UNION ALL SELECT *, 'one_hop' FROM hop) SELECT session_id, turn_no, entity_id, role, name, type, location FROM b LEFT JOIN entities ON id = entity_id")
def scene_context(s, d):
    return mentions.scene_context(_mentions(s, d), domain.edges(s, d), domain.entities(s, d), ["session_id", "turn_no"])


@query("entities", "SELECT id, last_updated FROM entities WHERE 90 - last_updated <= 10")
def nearby_fallback(s, d):
    return mentions.nearby(domain.entities(s, d), 90, 10)


_ACTIVITY = ", activity AS (SELECT first_seen AS turn, id FROM entities UNION SELECT last_updated, id FROM entities)"


@query("entities", _ACTIVITY + " SELECT DISTINCT id FROM activity WHERE turn BETWEEN 80 AND 90")
def nearby_indexed(s, d):
    return mentions.nearby_indexed(indices.turn_activity(domain.entities(s, d)), 90, 10)


@query("entities", _ACTIVITY + " SELECT turn, count(*) AS entities, min(id) AS first_id FROM activity GROUP BY turn")
def turn_activity(s, d):
    return indices.turn_activity(domain.entities(s, d)).groupBy("turn").agg(F.count("*").alias("entities"), F.min("id").alias("first_id"))


@query("entities edges", "SELECT id, name, type, substr(coalesce(nullif(current_status, ''), identity), 1, 80) AS status_summary, first_seen, last_updated, coalesce(n, 0) AS active_relationships FROM entities LEFT JOIN (SELECT source_id, count(*) AS n FROM edges WHERE status = 'active' GROUP BY 1) ON source_id = id")
def entity_index(s, d):
    return indices.entity_index(domain.entities(s, d), domain.edges(s, d))


@query("entities edges", """, ends AS (SELECT source_id AS id, 1 AS f, 0 AS r FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges), c AS (SELECT id, CAST(sum(f) AS BIGINT) AS forward, CAST(sum(r) AS BIGINT) AS reverse FROM ends GROUP BY id)
SELECT c.id, name, coalesce(type, 'unknown') AS type, forward, reverse, forward + reverse AS degree FROM c LEFT JOIN entities e ON e.id = c.id""")
def adjacency_degree(s, d):
    return indices.adjacency_degree(domain.edges(s, d), domain.entities(s, d))


@query("entities edges", """, l AS (SELECT location AS location_id, id AS entity_id, 0 AS rank, NULL AS relationship FROM entities WHERE location IS NOT NULL UNION ALL SELECT target_id, source_id, 1, rel_type FROM edges WHERE rel_type = 'spatial' AND coalesce(status, '') <> 'resolved')
SELECT location_id, entity_id, CASE WHEN min(rank) = 0 THEN 'state' ELSE 'relationship' END AS found_by, max(relationship) AS relationship FROM l GROUP BY 1, 2""")
def location_index(s, d):
    return indices.location_index(domain.entities(s, d), domain.edges(s, d))


@query("edges", "SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, CAST(min(first_turn) AS BIGINT) AS since FROM edges WHERE source_id LIKE 'loc-%' AND target_id LIKE 'loc-%' AND coalesce(status, 'active') = 'active' GROUP BY 1, 2")
def location_edges(s, d):
    return indices.location_edges(domain.edges(s, d))


@query("nevents entities", ", r AS (SELECT id, turn_no, unnest(refs) AS entity_id FROM nevents) SELECT entity_id, count(DISTINCT id) AS events, min(turn_no) AS first_turn FROM r WHERE entity_id NOT IN (SELECT id FROM entities) GROUP BY 1 HAVING count(DISTINCT id) >= 3")
def orphan_refs(s, d):
    return indices.orphan_refs(domain.events(s, d), domain.entities(s, d), 3)


@query("edges entities", "SELECT source_id, target_id, rel_type FROM edges WHERE target_id NOT IN (SELECT id FROM entities WHERE id NOT LIKE '%7')")
def dangling_edges(s, d):
    return indices.dangling_edges(domain.edges(s, d), domain.entities(s, d).where("not id like '%7'"))


@query("edges entities", "SELECT source_id, target_id, a.last_updated AS source_last, b.last_updated AS target_last FROM edges JOIN entities a ON a.id = source_id LEFT JOIN (SELECT * FROM entities WHERE id NOT LIKE '%7') b ON b.id = target_id WHERE status = 'active' AND 90 - a.last_updated >= 10 AND (b.last_updated IS NULL OR 90 - b.last_updated >= 10)")
def dormant_edges(s, d):
    e = domain.entities(s, d)
    out = domain.edges(s, d)
    return indices.dormant_edges(out, e.where("not (id like '%7' and type = 'faction')"), 90, 10)


SQL["dormant_edges"] = SQL["dormant_edges"].replace("WHERE id NOT LIKE '%7') b", "WHERE NOT (id LIKE '%7' AND type = 'faction')) b")


def _item_refs(s: SparkSession, d: str) -> DataFrame:
    return domain.table(s, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("item-part-"), F.col("l_partkey")).alias("entity_id"))


@query("entities", """, refs AS (SELECT 'item-part-' || l_partkey AS id, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT e.id, first_seen, last_updated, coalesce(n, 0) AS refs FROM entities e LEFT JOIN refs USING (id) WHERE type = 'item' AND 100 - first_seen >= 25 AND 100 - last_updated >= 25 AND coalesce(n, 0) < 2 AND e.id NOT IN (SELECT 'item-part-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5)""")
def stale_items(s, d):
    targets = domain.table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity < 5").select(F.concat(F.lit("item-part-"), F.col("l_partkey")).alias("target_id"))
    return indices.stale_items(domain.entities(s, d), _item_refs(s, d), targets, 100)


_REFS = ", refs AS (SELECT id AS event_id, ord, turn_no, type, unnest(refs) AS entity_id FROM nevents)"


@query("nevents", _REFS + " SELECT entity_id, event_id, turn_no, row_number() OVER (PARTITION BY entity_id ORDER BY turn_no, ord) AS nth FROM refs")
def events_by_entity(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("turn_no", "ord")
    return indices.event_refs(domain.events(s, d)).select("entity_id", "event_id", "turn_no", F.row_number().over(w).cast("bigint").alias("nth"))


@query("nevents", " SELECT least(refs[1], refs[2]) AS a, greatest(refs[1], refs[2]) AS b, count(*) AS events FROM nevents WHERE refs[1] <> refs[2] GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccurrence(s, d):
    return indices.cooccurrence(domain.events(s, d), 2)


@query("nevents", _REFS + ", k AS (SELECT entity_id, type, count(*) AS n, min(turn_no) AS a, max(turn_no) AS b FROM refs GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, type) AS rn FROM k) SELECT entity_id, CAST(sum(n) AS BIGINT) AS events, min(a) AS first_turn, max(b) AS last_turn, max(CASE WHEN rn = 1 THEN type END) AS top_type, count(*) AS types FROM t GROUP BY 1")
def event_profile(s, d):
    return indices.event_profile(domain.events(s, d))


@query("nevents", r""", w AS (SELECT DISTINCT id, turn_no, lower(unnest(regexp_extract_all(description, '[A-Z][a-z]{2,}'))) AS word FROM nevents)
SELECT word, count(DISTINCT id) AS events, min(turn_no) AS first_turn FROM w WHERE word NOT IN (SELECT lower(n_name) FROM nation) GROUP BY 1 HAVING count(DISTINCT id) >= 2""")
def name_discovery(s, d):
    return indices.name_discovery(domain.events(s, d), domain.table(s, d, "nation").select(F.col("n_name").alias("name")))


_MERGED = """, h AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, turn ORDER BY length(description) DESC, ord, description) AS rn FROM interactions), merged AS (SELECT source_id, target_id, turn, rel_type, description FROM h WHERE rn = 1)"""


@query("interactions", _MERGED + " SELECT * FROM merged")
def rel_history_merged(s, d):
    return sequences.merged_history(domain.interactions(s, d))


_BY_NATION = """, hn AS (SELECT 'loc-nation-' || c_nationkey AS source_id, target_id, turn, min(ord) AS ord, min(rel_type) AS rel_type FROM interactions JOIN customer ON source_id = 'char-customer-' || c_custkey WHERE rel_type <> 'trade' GROUP BY 1, 2, 3)"""


@query("interactions", _BY_NATION + """, f AS (SELECT *, lag(rel_type) OVER w AS pt, lag(turn) OVER w AS pp, count(*) OVER (PARTITION BY source_id, target_id) AS n FROM hn WINDOW w AS (PARTITION BY source_id, target_id ORDER BY turn)),
g AS (SELECT *, CAST(sum(CASE WHEN pp IS NULL OR pt <> rel_type OR turn - pp > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, target_id ORDER BY turn) AS BIGINT) AS arc FROM f WHERE n >= 4)
SELECT source_id, target_id, arc, min(turn) AS first_turn, max(turn) AS last_turn, any_value(rel_type) AS rel_type, count(*) AS entries FROM g GROUP BY 1, 2, 3""")
def arc_chunks(s, d):
    homes = domain.table(s, d, "customer").select(F.concat(F.lit("char-customer-"), F.col("c_custkey")).alias("source_id"), F.concat(F.lit("loc-nation-"), F.col("c_nationkey")).alias("home"))
    h = domain.interactions(s, d).where("rel_type <> 'trade'").join(homes, "source_id").groupBy(F.col("home").alias("source_id"), "target_id", "turn").agg(F.min("ord").alias("ord"), F.min("rel_type").alias("rel_type"))
    return sequences.arc_chunks(h)


def _b(p: str) -> str:
    return f"regexp_matches(lower(text), '(^|{_B})({p})({_B}|$)')"


def _c(p: str) -> str:
    # doubled bounds, so that neighbours do not share one
    return f"len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '({_B})', '\\1\\1', 'g'), '{_B}{p.replace(' ', '  ')}{_B}'))"


_FINE = "CASE " + " ".join(f"WHEN {_b(p)} THEN '{label}'" for p, label in text_state.FINE_SEASONS) + " END"
_SCORES = ", ".join("(" + " + ".join(_c(w) for w in ws) + f") AS s_{s}, (" + " + ".join(f"CAST({_b(w)} AS INTEGER)" for w in ws) + f") AS k_{s}" for s, ws in text_state.SEASON_WORDS.items())
_BASE = "CASE " + " ".join(f"WHEN k_{s} >= 2 AND s_{s} - greatest({', '.join(f's_{o}' for o in text_state.SEASON_WORDS if o != s)}) >= 2 THEN '{s}'" for s in text_state.SEASON_WORDS) + " END"
_SEASONS = f""", sc AS (SELECT session_id, turn_no, {_FINE} AS f, {_SCORES} FROM scenes), st AS (SELECT session_id, turn_no, f, {_BASE} AS b FROM sc),
timeline AS (SELECT session_id, turn_no, coalesce(f, 'mid_' || b) AS season, CAST(CASE WHEN f IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence FROM st WHERE f IS NOT NULL OR b IS NOT NULL)"""


@query("scenes", _SEASONS + " SELECT * FROM timeline")
def season_signals(s, d):
    return text_state.season_signals(domain.scenes(s, d))


@query("scenes", _SEASONS + """, f AS (SELECT *, lag(season) OVER (PARTITION BY session_id ORDER BY turn_no) AS p FROM timeline), g AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> season THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_no) AS BIGINT) AS run FROM f)
SELECT session_id, run, any_value(season) AS season, min(turn_no) AS first_turn, max(turn_no) AS last_turn, count(*) AS entries FROM g GROUP BY 1, 2""")
def season_runs(s, d):
    return sequences.season_runs(text_state.season_signals(domain.scenes(s, d)))


@query("scenes", _SEASONS + " SELECT t.session_id, t.turn_no, l.season FROM scenes t ASOF LEFT JOIN timeline l ON t.session_id = l.session_id AND t.turn_no >= l.turn_no")
def season_asof(s, d):
    t = domain.scenes(s, d)
    return sequences.asof_season(t.select("session_id", "turn_no"), text_state.season_signals(t))


@query("scenes", _SEASONS + """, b AS (SELECT *, regexp_extract(season, '(winter|spring|summer|autumn)', 1) AS base FROM timeline), n AS (SELECT *, list(base) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM b),
q AS (SELECT session_id, turn_no, season, confidence, CAST(len(list_filter(near, lambda x: x = base)) - 1 AS BIGINT) AS support FROM n) SELECT session_id, turn_no, season, support FROM q WHERE confidence >= 0.6 OR support >= 1""")
def flicker_filtered(s, d):
    return sequences.without_flicker(text_state.season_signals(domain.scenes(s, d)))


@query("nevents", """, b AS (SELECT *, CAST(floor((turn_no - 1) / 25) AS BIGINT) AS bucket, type IN ('arrival', 'encounter') AS prio FROM nevents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, prio ORDER BY turn_no, ord) AS k, max(CAST(prio AS INTEGER)) OVER (PARTITION BY bucket) AS has FROM b)
SELECT bucket, id, turn_no, type FROM r WHERE (prio AND k <= 3) OR (NOT prio AND has = 0 AND k <= 2)""")
def story_buckets(s, d):
    return sequences.story_buckets(domain.events(s, d))


@query("nevents", _REFS + """, o AS (SELECT *, row_number() OVER w AS i, turn_no - lag(turn_no) OVER w AS gap, count(*) OVER (PARTITION BY entity_id) AS n FROM refs WINDOW w AS (PARTITION BY entity_id ORDER BY turn_no, ord)),
g AS (SELECT *, CASE WHEN gap >= 3 THEN gap END AS wide FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY wide DESC NULLS LAST, i) AS rank, count(wide) OVER (PARTITION BY entity_id) AS gaps FROM g),
c AS (SELECT *, CAST(sum(CASE WHEN n >= 10 AND ((wide IS NOT NULL AND rank <= 3) OR (gaps = 0 AND n >= 20 AND i = floor(n / 2) + 1)) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY turn_no, ord) AS BIGINT) AS phase FROM k)
SELECT entity_id, phase, min(turn_no) AS first_turn, max(turn_no) AS last_turn, count(*) AS events FROM c GROUP BY 1, 2""")
def npc_phases(s, d):
    return sequences.npc_phases(indices.event_refs(domain.events(s, d)), gap=3)


@query("nevents", _REFS + """, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY turn_no, ord) AS i FROM refs), c AS (SELECT *, CAST(floor((i - 1) / 5) AS BIGINT) AS chunk FROM o), k AS (SELECT entity_id, chunk, type, count(*) AS n, min(i) AS first_i FROM c GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY entity_id, chunk ORDER BY n DESC, first_i) AS rn, sum(n) OVER (PARTITION BY entity_id, chunk) AS total FROM k), x AS (SELECT entity_id, chunk, type, lag(type) OVER (PARTITION BY entity_id ORDER BY chunk) AS before FROM m WHERE rn = 1 AND total = 5)
SELECT entity_id, chunk, before, type FROM x WHERE before <> type""")
def type_shifts(s, d):
    return sequences.type_shifts(indices.event_refs(domain.events(s, d)))


_MARKERS = r""", f AS (SELECT session_id, turn_no, text, 2 AS family, regexp_extract_all(text, '(?i)(---\s*Long\s+rest\s*---)', 1) AS v FROM scenes UNION ALL SELECT session_id, turn_no, text, 3, list_filter(regexp_extract_all(text, '(?im)^Used\s+(.+?)$', 1), lambda x: len(regexp_split_to_array(trim(x), '\s+')) <= 6) FROM scenes
UNION ALL SELECT session_id, turn_no, text, 4, regexp_extract_all(text, '(?im)New\s+item\s+acquired:\s*(.+?)$', 1) FROM scenes UNION ALL SELECT session_id, turn_no, text, 5, regexp_extract_all(text, '(?i)(?:Level(?:ed)?\s+up|Reached\s+level)\s+(\d+)', 1) FROM scenes),
u AS (SELECT session_id, turn_no, family, unnest(v) AS value, unnest(range(len(v))) AS i FROM f WHERE len(v) > 0), m AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY family, i) AS seq FROM u)
SELECT session_id, turn_no, seq, CASE family WHEN 2 THEN 'long_rest' WHEN 3 THEN 'spell_use' WHEN 4 THEN 'item_acquired' ELSE 'level_up' END AS type, CASE family WHEN 2 THEN '' ELSE trim(value) END AS value FROM m"""


@query("scenes", _MARKERS)
def markers(s, d):
    return text_state.markers(domain.scenes(s, d))


def _hits(patterns, kind: str, confidence: float) -> str:
    rows = " UNION ALL ".join(f"SELECT session_id, turn_no, '{kind}' AS type, '{label}: ' || regexp_extract(lower(text), '(^|{_B})({p})({_B}|$)', 2) AS signal, CAST({confidence} AS DOUBLE) AS confidence FROM scenes WHERE {_b(p)}" for p, label in ((p.replace(chr(92) + 'w', '[a-z]'), label) for p, label in patterns))
    return rows


@query("scenes", _SEASONS + " SELECT session_id, turn_no, 'season_transition' AS type, season AS signal, confidence FROM timeline UNION ALL " + _hits(text_state.TIME_SKIPS, "time_skip", 0.6) + " UNION ALL " + _hits(text_state.LIFE_MARKERS, "biological_marker", 0.7))
def temporal_signals(s, d):
    return text_state.temporal_signals(domain.scenes(s, d))


def _x(p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract(text, '{p}', {g}), '')"


_TOLD = ", ".join(f"nullif(regexp_extract(text, '(?i)(^|{_B})({p})({_B}|$)', 2), '')" for p in text_state.CONDITIONS)


@query("scenes", rf""", h AS (SELECT session_id, turn_no, CAST({_x(r'(?i)HP[:\s]+(\d+)\s*/\s*(\d+)')} AS BIGINT) AS numeric, CAST({_x(r'(?i)HP[:\s]+(\d+)\s*/\s*(\d+)', 2)} AS BIGINT) AS max_hp,
coalesce('-' || {_x(r'(?i)takes?\s+(\d+)\s*(?:(?:points?\s+of\s+)?damage)')}, '-' || {_x(r'(?i)loses?\s+(\d+)\s*(?:HP|hit\s+points?)')}, '+' || {_x(r'(?i)heals?\s+(\d+)\s*(?:HP|hit\s+points?)')}, '+' || {_x(r'(?i)restores?\s+(\d+)\s*(?:HP|hit\s+points?)')}) AS delta, lower(coalesce({_TOLD})) AS told FROM scenes)
SELECT session_id, turn_no, numeric, max_hp, delta, coalesce(told, CASE WHEN numeric IS NOT NULL THEN 'HP ' || numeric || '/' || max_hp END, 'unknown') AS narrative FROM h WHERE numeric IS NOT NULL OR delta IS NOT NULL OR told IS NOT NULL""")
def hp_state(s, d):
    return text_state.hp_state(domain.scenes(s, d))


@query("scenes", " UNION ALL ".join(f"SELECT session_id, turn_no, '{e}' AS effect FROM scenes WHERE regexp_matches(text, '(?i)(^|{_B}){e}({_B}|$)')" for p in text_state.EFFECTS for e in p.split("|")))
def status_effects(s, d):
    return text_state.status_effects(domain.scenes(s, d))


@query("scenes", r""", a AS (SELECT session_id, turn_no, lower(trim(unnest(regexp_extract_all(text, '(?im)(picks?\s+up|receives?|obtains?|finds?|gains?|acquires?|takes?|is\s+given)\s+(a\s+|an\s+|the\s+)?(.+?)(\.|,|$)', 3)))) AS name FROM scenes),
v AS (SELECT DISTINCT session_id, turn_no, lower(trim(unnest(regexp_extract_all(text, '(?im)New\s+item\s+acquired:\s*(.+?)$', 1)))) AS name FROM scenes UNION SELECT session_id, turn_no, name FROM a WHERE len(regexp_split_to_array(name, '\s+')) <= 5) SELECT session_id, turn_no, v.name, i.item_id FROM v LEFT JOIN (SELECT 'silver key' AS name, 'item-key' AS item_id) i USING (name)""")
def inventory(s, d):
    return text_state.inventory(domain.scenes(s, d), s.range(1).select(F.lit("item-key").alias("id"), F.lit("Silver Key").alias("name")))


@query("turns", "SELECT session_id, turn_no, CAST(round_even((turn_no - 1) * 3.5, 0) AS BIGINT) AS estimated_day, CAST(CASE WHEN abs(turn_no - 1) <= 10 THEN 0.7 WHEN abs(turn_no - 1) <= 50 THEN 0.5 WHEN abs(turn_no - 1) <= 150 THEN 0.3 ELSE 0.2 END AS DOUBLE) AS confidence FROM turns")
def day_estimate(s, d):
    t = domain.turns(s, d)
    return t.select("session_id", "turn_no", T.estimated_day(F.col("turn_no")).alias("estimated_day"), T.day_confidence(F.col("turn_no")).alias("confidence"))


@query("turns", r""", x AS (SELECT session_id, turn_no, CASE turn_no % 4 WHEN 0 THEN turn_id WHEN 1 THEN 'x-' || turn_id WHEN 2 THEN turn_id || 'b' ELSE 'none' END AS t FROM turns)
SELECT session_id, turn_no, t, TRY_CAST(regexp_extract(t, '^turn-(\d+)$', 1) AS BIGINT) AS anchored, coalesce(TRY_CAST(regexp_extract(t, '^turn-(\d+)$', 1) AS BIGINT), 0) AS anchored_or_zero, coalesce(TRY_CAST(regexp_extract(t, '(\d+)', 1) AS BIGINT), 0) AS digits_or_zero, TRY_CAST(regexp_extract(t, 'turn-(\d+)', 1) AS BIGINT) AS anywhere FROM x""")
def turn_parsers(s, d):
    t = domain.turns(s, d).select("session_id", "turn_no", F.expr("case turn_no % 4 when 0 then turn_id when 1 then 'x-' || turn_id when 2 then turn_id || 'b' else 'none' end").alias("t"))
    c = F.col("t")
    return t.select("session_id", "turn_no", "t", T.turn_or_null(c).alias("anchored"), T.turn_or_zero(c).alias("anchored_or_zero"), T.first_digits_or_zero(c).alias("digits_or_zero"), T.turn_anywhere(c).alias("anywhere"))


@query("turns", "SELECT session_id, CAST(sum(greatest(1, length(text) // 3)) AS BIGINT) AS tokens, count(*) AS turns, count(*) FILTER (repeated) AS repeated_speakers FROM (SELECT *, coalesce(lag(speaker) OVER (PARTITION BY session_id ORDER BY turn_no) = speaker, false) AS repeated FROM turns) GROUP BY 1")
def session_summary(s, d):
    from pyspark.sql import Window

    t = domain.turns(s, d).withColumn("_r", F.coalesce(F.lag("speaker").over(Window.partitionBy("session_id").orderBy("turn_no")) == F.col("speaker"), F.lit(False)))
    return t.groupBy("session_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("turns"), F.count_if("_r").alias("repeated_speakers"))


_MENTIONED = ", me AS (SELECT DISTINCT id FROM entities WHERE last_updated >= 95 AND type IN ('character', 'faction')), tiers AS (SELECT source_id, target_id, rel_type, last_turn, CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL THEN 1 WHEN (s.id IS NOT NULL OR t.id IS NOT NULL) AND 79 - last_turn <= 15 THEN 2 WHEN (s.id IS NOT NULL OR t.id IS NOT NULL) AND status = 'active' THEN 3 ELSE 4 END::BIGINT AS tier FROM edges LEFT JOIN me s ON s.id = source_id LEFT JOIN me t ON t.id = target_id)"


def _tiers(s: SparkSession, d: str) -> DataFrame:
    m = domain.entities(s, d).where("last_updated >= 95 and type in ('character', 'faction')").select(F.col("id").alias("entity_id"))
    return resolution.relationship_tiers(domain.edges(s, d), m, 79)


@query("edges entities", _MENTIONED + " SELECT * FROM tiers")
def relationship_tiers(s, d):
    return _tiers(s, d)


@query("edges entities", _MENTIONED + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY tier, last_turn DESC, target_id, rel_type) AS rank FROM tiers WHERE tier < 4) WHERE rank <= 8")
def tier_topk(s, d):
    return resolution.top_relationships(_tiers(s, d), 8)


@query("entities", "SELECT id, type, last_updated, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY last_updated, id) AS rank FROM entities WHERE 120 - last_updated > 30) WHERE rank <= CASE type WHEN 'character' THEN 13 WHEN 'location' THEN 5 WHEN 'faction' THEN 5 WHEN 'item' THEN 2 ELSE 0 END")
def refresh_slots(s, d):
    return resolution.refresh_slots(domain.entities(s, d), 120, 30, 25, {"character": 0.5, "faction": 0.2, "item": 0.1, "location": 0.2})


_PAIRS = ", names AS (SELECT DISTINCT 'item-' || replace(p_name, ' ', '-') AS id, p_name AS name FROM part), pairs AS (SELECT x.id AS a, y.id AS b, levenshtein(x.name, y.name) AS distance FROM names x JOIN names y ON x.id < y.id AND levenshtein(x.name, y.name) <= 2)"


@query("", "SELECT 1")
def dedup_pairs(s, d):
    return resolution.fuzzy_pairs(_item_names(s, d), 2)


SQL["dedup_pairs"] = "WITH " + _PAIRS[2:] + " SELECT a, b, distance FROM pairs"


@query("", "SELECT 1")
def dedup_components(s, d):
    return resolution.components(resolution.fuzzy_pairs(_item_names(s, d), 2))


SQL["dedup_components"] = "WITH RECURSIVE " + _PAIRS[2:] + """, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT id, b FROM reach JOIN both_ways ON a = r)
SELECT id, min(r) AS survivor FROM reach GROUP BY id"""


@query("nevents", ", u AS (SELECT id, unnest(refs) AS ref, unnest([1, 2]) AS i FROM nevents), r AS (SELECT id, i, CASE WHEN ref LIKE 'char-user-%' THEN 'char-user-' || (CAST(split_part(ref, '-', 3) AS BIGINT) // 3) ELSE ref END AS ref FROM u), m AS (SELECT id, ref, min(i) AS i FROM r GROUP BY 1, 2) SELECT id, string_agg(ref, ',' ORDER BY i) AS refs FROM m GROUP BY 1")
def id_rewrite(s, d):
    e = domain.events(s, d)
    ids = e.select(F.explode("refs").alias("id")).where("id like 'char-user-%'").distinct()
    merged = ids.withColumn("survivor", F.expr("'char-user-' || (cast(split_part(id, '-', 3) as bigint) div 3)"))
    return resolution.rewrite_refs(e, merged).select("id", F.array_join("refs", ",").alias("refs"))


@query("nevents edges", "SELECT DISTINCT 'explicit_evidence' AS classification, substr(description, 1, 80) AS statement, turn_no, array_to_string(list_sort(refs), ',') AS entities FROM nevents UNION SELECT DISTINCT 'inference', source_id || ' ' || rel_type || ' ' || target_id, last_turn, least(source_id, target_id) || ',' || greatest(source_id, target_id) FROM edges WHERE status IS NULL")
def evidence(s, d):
    return resolution.evidence(domain.events(s, d), domain.edges(s, d))


@query("scenes", _SEASONS + """, cur AS (SELECT session_id, turn_no, season FROM timeline WHERE turn_no % 2 = 0), up AS (SELECT session_id, turn_no - turn_no % 3 AS turn_no, season, turn_no AS o FROM timeline),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no, season ORDER BY o) AS k FROM up u WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.session_id = u.session_id AND c.turn_no = u.turn_no AND c.season = u.season))
SELECT session_id, turn_no, season, turn_no AS ord FROM cur UNION ALL SELECT session_id, turn_no, season, o FROM n WHERE k = 1""")
def timeline_merge(s, d):
    t = text_state.season_signals(domain.scenes(s, d)).select("session_id", "turn_no", "season")
    cur = t.where("turn_no % 2 = 0").withColumn("ord", F.col("turn_no"))
    up = t.select("session_id", (F.col("turn_no") - F.col("turn_no") % 3).alias("turn_no"), "season", F.col("turn_no").alias("ord"))
    return resolution.merge_keep_first(cur, up, ["session_id", "turn_no", "season"], "ord")


@query("interactions", "SELECT source_id, target_id, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(rel_type, turn * 100000000 + ord) AS rel_type, arg_max(status, turn * 100000000 + ord) AS status, count(DISTINCT description) AS descriptions FROM interactions GROUP BY 1, 2")
def dedup_relationships(s, d):
    return resolution.dedup_relationships(domain.interactions(s, d))


@query("entities", """, up AS (SELECT 'char-customer-' || o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'buyer ' || o_orderpriority END AS identity, CASE WHEN o_orderkey % 3 = 0 THEN 'status ' || o_orderstatus END AS st, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS turn FROM orders),
a AS (SELECT id, arg_max(identity, ord) FILTER (identity IS NOT NULL) AS identity, arg_max(st, ord) FILTER (st IS NOT NULL) AS st, min(turn) AS lo, max(turn) AS hi FROM up GROUP BY id)
SELECT coalesce(e.id, a.id) AS id, e.name, e.type, coalesce(a.identity, e.identity) AS identity, coalesce(a.st, e.current_status) AS current_status, e.location, least(e.first_seen, a.lo) AS first_seen, greatest(e.last_updated, a.hi) AS last_updated FROM (SELECT * FROM entities WHERE type = 'character') e FULL JOIN a ON a.id = e.id""")
def upsert_entities(s, d):
    none = F.lit(None).cast("string")
    up = domain.table(s, d, "orders").select(F.concat(F.lit("char-customer-"), F.col("o_custkey")).alias("id"), none.alias("name"), none.alias("type"), F.expr("if(o_orderkey % 2 = 0, 'buyer ' || o_orderpriority, null)").alias("identity"), F.expr("if(o_orderkey % 3 = 0, 'status ' || o_orderstatus, null)").alias("current_status"), none.alias("location"), domain.month_turn(F.col("o_orderdate")).alias("first_seen"), domain.month_turn(F.col("o_orderdate")).alias("last_updated"), F.col("o_orderkey").alias("ord"))
    return resolution.upsert_entities(domain.entities(s, d).where("type = 'character'"), up)


@query("", "SELECT 1")
def compound_fragments(s, d):
    one = domain.table(s, d, "part").select(F.concat(F.lit("item-"), F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "item").alias("type"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return resolution.compound_fragments(one, _item_names(s, d))


SQL["compound_fragments"] = "WITH n AS (SELECT DISTINCT p_name AS compound, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT 'item-' || p_partkey AS id, split_part(p_name, ' ', 2) AS word, count(DISTINCT compound) AS compounds FROM part JOIN n ON n.word = split_part(p_name, ' ', 2) WHERE length(n.word) >= 3 GROUP BY 1, 2"


@query("run_log", "SELECT CASE WHEN turn_no <= 20 THEN '1-20' WHEN turn_no <= 50 THEN '21-50' WHEN turn_no <= 100 THEN '51-100' ELSE '101+' END AS band, arm, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round_even(sum(tokens) / sum(calls), 4) AS per_call FROM run_log GROUP BY 1, 2")
def token_bands(s, d):
    return stats.token_bands(domain.run_log(s, d))


_MATCHED = ", mt AS (SELECT turn_no, min(calls) AS calls FROM run_log GROUP BY 1 HAVING count(run) = 4 AND min(calls) = max(calls)), pop AS (SELECT turn_no FROM run_log GROUP BY 1 HAVING count(DISTINCT run) = 4), pd AS (SELECT turn_no, avg(tokens / calls) FILTER (arm = 'A') AS a, avg(tokens / calls) FILTER (arm = 'B') AS b, CAST(sum(calls) AS BIGINT) AS weight FROM run_log JOIN pop USING (turn_no) GROUP BY 1)"


@query("run_log", _MATCHED + " SELECT turn_no, calls FROM mt")
def matched_turns(s, d):
    return stats.matched_turns(domain.run_log(s, d), 4)


@query("run_log", _MATCHED + " SELECT turn_no, round(a, 6) AS a, round(b, 6) AS b, weight, round(b - a, 6) AS delta FROM pd")
def paired_deltas(s, d):
    log = domain.run_log(s, d)
    return stats.paired_deltas(log, stats.population_turns(log, 4)).select("turn_no", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "weight", F.round("delta", 6).alias("delta"))


@query("run_log", _MATCHED + f""", s AS (SELECT count(*) AS n, avg(b - a) AS mean, median(b - a) AS median, stddev_samp(b - a) AS stdev, sum((b - a) * weight) / sum(weight) AS weighted_mean FROM pd), h AS (SELECT *, CASE WHEN n - 1 > 30 THEN {stats.Z_95} ELSE CAST([{', '.join(map(str, stats.T_95))}] AS DOUBLE[])[greatest(n - 1, 1)] END * stdev / sqrt(n) AS half FROM s)
SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(stdev, 6) AS stdev, round(weighted_mean, 6) AS weighted_mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, round(mean / stdev, 6) AS effect, n >= 10 AND (mean - half > 0 OR mean + half < 0) AND abs(mean) > 5 AS separable FROM h""")
def paired_summary(s, d):
    log = domain.run_log(s, d)
    return stats.paired_summary(stats.paired_deltas(log, stats.population_turns(log, 4)))


@query("run_log", ", p AS (SELECT run, turn_no, coalesce(sum(tokens) OVER (PARTITION BY run ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM run_log) SELECT turn_no, count(DISTINCT prior) AS states FROM p GROUP BY 1 HAVING count(DISTINCT prior) > 1")
def prior_divergence(s, d):
    return stats.prior_divergence(domain.run_log(s, d))


@query("", "SELECT 1")
def log_last_status(s, d):
    e = domain.table(s, d, "events")
    return stats.last_status(e.select(F.concat(F.lit("turn-"), F.col("user_id")).alias("key"), F.col("event_id").alias("ord"), F.when(F.col("event_type") != "view", F.col("event_type") != "error").alias("ok")))


SQL["log_last_status"] = "SELECT 'turn-' || user_id AS key, max(event_id) AS last_ord FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error'"


@query("entities", ", a AS (SELECT id, type FROM entities WHERE id NOT LIKE '%3'), b AS (SELECT id, type FROM entities WHERE id NOT LIKE '%41' AND id NOT LIKE '%4') SELECT coalesce(a.type, b.type) AS type, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS retained, count(*) FILTER (b.id IS NULL) AS removed, count(*) FILTER (a.id IS NULL) AS added, count(*) FILTER (b.id IS NULL) > 0.2 * count(*) FILTER (a.id IS NOT NULL) AS flagged FROM a FULL JOIN b ON a.id = b.id GROUP BY ROLLUP (coalesce(a.type, b.type))")
def retention(s, d):
    e = domain.entities(s, d)
    return stats.retention(e.where("not id like '%3'"), e.where("not id like '%41' and not id like '%4'"))
