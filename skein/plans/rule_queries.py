"""Queries of the rules and of the catalog operators, with oracles that state the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import catalog, indices, rules
from skein.plans.queries import query
from skein.sources import domain

# Values for names, types and turns that the tables lack, by key; the same text is SQL for both engines.
_NAME = """CASE p_partkey % 17 WHEN 0 THEN 'The Feast' WHEN 1 THEN 'my arm' WHEN 2 THEN 'Kael' WHEN 3 THEN 'Their camp' WHEN 4 THEN 'a healing Technique' WHEN 5 THEN 'old Raider' WHEN 6 THEN 'broken pattern' WHEN 7 THEN 'Constance'
  WHEN 8 THEN 'darkness' WHEN 9 THEN 'guard' WHEN 10 THEN 'An Elder' WHEN 11 THEN 'Plague' WHEN 12 THEN 'iron-wolf' ELSE p_name END"""
_TYPE = "CASE p_partkey % 5 WHEN 0 THEN 'character' WHEN 1 THEN 'location' WHEN 2 THEN 'item' WHEN 3 THEN 'creature' ELSE 'concept' END"
_TEXT = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'TODO: fill' WHEN 3 THEN 'a STUB for now' WHEN 4 THEN ' not established ' ELSE p_type END"
_NOTE = "CASE p_partkey % 4 WHEN 0 THEN 'Auto-created by event-stub' WHEN 1 THEN 'auto-created by name-mention-discovery..' WHEN 2 THEN 'seen' END"


def _parts(s, d):
    return domain.table(s, d, "part").select("p_partkey", "p_name", F.expr(_NAME).alias("name"), F.expr(_TYPE).alias("type"), F.expr(_TEXT).alias("text"), F.expr(_NOTE).alias("note"))


_P = f"WITH p AS (SELECT p_partkey, p_name, {_NAME} AS name, {_TYPE} AS type, {_TEXT} AS text, {_NOTE} AS note FROM part)"
_NO_CHAR = "('broken','covering','disruption','method','one','pattern','plague','precision','protocol','treatment','the','a','an','this','that','it','you','me','attack','defense','move','action','skill','ability','fire','water','earth','wind','light','dark','shadow','death','life','blood','soul','magic','echo','field','geometric','head','new','quiet','reinforced','song','southern','triangular','tribes','two','weave','birth','belly','feast','meal','sickness','disease','structure','fragment','celebration')"


@query("", _P + f""", n AS (SELECT *, lower(trim(name)) AS low, regexp_replace(lower(trim(name)), '^(the|a|an)\\s+', '') AS bare FROM p),
w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS word FROM part), f AS (SELECT word, count(*) / (SELECT count(*) FROM w) AS frequency FROM w GROUP BY 1)
SELECT p_partkey, type IN ('character', 'creature') AND (low IN {_NO_CHAR} OR bare IN {_NO_CHAR} OR regexp_extract(bare, '([^ ]+)$', 1) IN {_NO_CHAR} OR starts_with(low, 'my ')) AS no_character,
  type = 'location' AND (bare IN ('feast', 'celebration', 'fragment', 'birth', 'death') OR regexp_matches(low, '^(his|her|their|my|your|its) ')) AS no_location,
  type = 'item' AND regexp_matches(low, '\\b(method|protocol|technique|process|procedure|approach|strategy|practice|discipline)\\b') AS no_item,
  CASE WHEN contains(low, ' ') OR contains(low, '-') THEN true WHEN low IN ('guard', 'shadow', 'spirit') THEN false WHEN regexp_matches(low, '(tion|sion|ness|ment|ance|ence|ity|ular|ical|ive|ous|ful|less|ern)$') AND NOT (name[1] = upper(name[1]) AND length(low) > 6) THEN false ELSE coalesce(frequency, 0) < 0.000003 END AS plausible
FROM n LEFT JOIN f ON word = low""")
def type_rejections(s, d):
    p, freq = _parts(s, d), rules.word_frequency(domain.table(s, d, "part"), "p_name")
    t, n = F.col("type"), F.col("name")
    met = p.join(freq, F.lower(n) == F.col("word"), "left")
    return met.select("p_partkey", rules.no_character(t, n).alias("no_character"), rules.no_location(t, n).alias("no_location"), rules.no_item(t, n).alias("no_item"), rules.plausible_character(n, F.col("frequency")).alias("plausible"))


@query("", _P + """ SELECT p_partkey, text <> '' AND NOT contains(lower(text), 'stub') AS real_identity, coalesce(regexp_replace(lower(note), '\\.*$', ''), '') IN ('auto-created by event-stub', 'auto-created by post-batch orphan sweep', 'auto-created by post-batch-orphan-sweep', 'auto-created by name-mention-discovery') OR text = '' AS stub,
  text = '' OR lower(trim(text)) IN ('unknown', 'not established', 'no npcs contacted yet') OR starts_with(text, 'TODO:') AS placeholder, text = '' AS empty_value, type <> 'creature' AND type <> 'concept' AND p_partkey % 6 >= 3 AS worth_a_page, p_partkey % 9 * 5 >= 20 AND p_partkey % 55 < 50 AS skips FROM p""")
def entity_predicates(s, d):
    c = F.col
    return _parts(s, d).select(
        "p_partkey",
        rules.real_identity(c("text")).alias("real_identity"),
        F.coalesce(rules.is_stub(c("note"), c("text")), F.col("text") == "").alias("stub"),
        rules.is_placeholder(c("text")).alias("placeholder"),
        rules.is_empty_value(c("text")).alias("empty_value"),
        rules.worth_a_page(c("type"), c("p_partkey") % 6).alias("worth_a_page"),
        rules.skip_player(c("p_partkey") % 9 * 5, c("p_partkey")).alias("skips"),
    )


_KIND = "CASE event_id % 9 WHEN 0 THEN ' Combat' WHEN 1 THEN 'trade' WHEN 2 THEN 'ritual' WHEN 3 THEN 'REST' WHEN 4 THEN 'teleport' WHEN 5 THEN 'observation' WHEN 6 THEN NULL WHEN 7 THEN 'Arrival' ELSE 'negotiation' END"
_BOND = "CASE event_id % 11 WHEN 0 THEN 'Ally of' WHEN 1 THEN 'ally_of' WHEN 2 THEN 'caught by' WHEN 3 THEN 'mother' WHEN 4 THEN ' Based In ' WHEN 5 THEN 'based_in' WHEN 6 THEN '' WHEN 7 THEN 'nemesis' WHEN 8 THEN 'working with' WHEN 9 THEN 'guild' ELSE 'lover' END"


@query("", f"""WITH e AS (SELECT event_id, lower(trim({_KIND})) AS k, lower(trim({_BOND})) AS b, event_id % 40 + 1 AS t, user_id % 40 + 1 AS u FROM events)
SELECT event_id, CASE k WHEN 'combat' THEN 'encounter' WHEN 'trade' THEN 'offering' WHEN 'ritual' THEN 'ritual' WHEN 'rest' THEN 'other' WHEN 'teleport' THEN 'other' WHEN 'observation' THEN 'examination' WHEN 'arrival' THEN 'arrival' WHEN 'negotiation' THEN 'decision' END AS type,
  CASE b WHEN 'ally of' THEN 'social' WHEN 'ally_of' THEN 'social' WHEN 'caught by' THEN 'adversarial' WHEN 'mother' THEN 'kinship' WHEN 'based in' THEN 'spatial' WHEN 'based_in' THEN 'spatial' WHEN 'working with' THEN 'partnership' WHEN 'guild' THEN 'factional' WHEN 'lover' THEN 'romantic' ELSE 'other' END AS bond,
  CASE WHEN abs(t - u) > 5 THEN printf('turn-%03d,soon', t) ELSE printf('turn-%03d,turn-%03d,soon', u, t) END AS sources FROM e""")
def event_coercions(s, d):
    e, turn = domain.table(s, d, "events"), F.format_string("turn-%03d", F.col("event_id") % 40 + 1)
    sources = F.array(F.format_string("turn-%03d", F.col("user_id") % 40 + 1), turn, F.lit("soon"))
    return e.select("event_id", rules.event_type(F.expr(_KIND)).alias("type"), rules.relationship_type(F.expr(_BOND)).alias("bond"), F.array_join(rules.near_source_turns(sources, turn), ",").alias("sources"))


_ALIASES = "CASE WHEN c_custkey % 3 = 0 THEN ['Player', ' Kael ', c_name, 'Fire', 'xo', 'Customer#000000007'] WHEN c_custkey % 3 = 1 THEN ['The Hero', NULL, ''] ELSE ['a1b', 'b2c', 'c3d', 'd4e', 'e5f', 'f6g', 'g7h', 'h8i', 'i9j', 'j0k', 'k1l', c_name || ' II'] END"


def _aliases(s, d):
    own = _ALIASES.replace("[", "array(").replace("]", ")")
    return domain.table(s, d, "customer").select(F.concat(F.lit("char-customer-"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr(own).alias("aliases"))


@query("", f"""WITH a AS (SELECT c_custkey, c_name, {_ALIASES} AS al FROM customer), x AS (SELECT c_custkey, c_name, unnest(al) AS alias, generate_subscripts(al, 1) AS pos FROM a), k AS (SELECT *, lower(trim(alias)) AS low, lower(trim(alias)) IN (SELECT lower(c_name) FROM customer) AND lower(trim(alias)) <> lower(c_name) AS taken FROM x),
g AS (SELECT c_custkey, list(trim(alias) ORDER BY pos) FILTER (low <> '' AND NOT taken AND low NOT IN ('player', 'the hero', 'fire') AND length(low) >= 3) AS p, list(alias ORDER BY pos) FILTER (low <> '' AND NOT taken) AS o FROM k GROUP BY 1)
SELECT 'char-customer-' || c_custkey AS id, coalesce(array_to_string(p[-10:], '|'), '') AS as_player, coalesce(array_to_string(o, '|'), '') AS as_other FROM g""")
def alias_filters(s, d):
    rows, known = _aliases(s, d), domain.table(s, d, "customer").select(F.col("c_name").alias("name"))
    one = rules.filtered_aliases(rows, known, player=True).select("id", F.array_join("aliases", "|").alias("as_player"))
    return one.join(rules.filtered_aliases(rows, known).select("id", F.array_join("aliases", "|").alias("as_other")), "id")


_DESC = "CASE turn_no % 4 WHEN 0 THEN 'a turn' ELSE '' END"


@query("turns", """, c AS (SELECT session_id, turn_no, lower(text) AS low, [{'id': 'item-red-plate', 'name': 'Red Plate'}, {'id': 'item-old-rod', 'name': NULL}, {'id': 'char-customer-7', 'name': 'Zed'}, {'id': '', 'name': ''}] AS l FROM turns), e AS (SELECT session_id, turn_no, low, unnest(l) AS e, generate_subscripts(l, 1) AS k FROM c)
SELECT session_id, turn_no, k, CASE WHEN k = 4 AND turn_no % 3 = 0 OR k = 1 AND turn_no % 4 = 0 THEN 'active' WHEN contains(low, 'red plate') AND k = 1 OR contains(low, 'old rod') AND k = 2 OR (contains(low, 'zed') OR contains(low, 'customer 7')) AND k = 3 THEN 'passive' ELSE 'spurious' END AS category FROM e""")
def discovery_categories(s, d):
    found = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(i).alias("id"), F.lit(n).alias("name")) for k, i, n in ((1, "item-red-plate", "Red Plate"), (2, "item-old-rod", None), (3, "char-customer-7", "Zed"), (4, "", ""))))
    each = domain.turns(s, d).select("session_id", "turn_no", "text", F.explode(found).alias("e"))
    new, says = (F.col("e.k") == 4) & (F.col("turn_no") % 3 == 0), F.when((F.col("e.k") == 1) & (F.col("turn_no") % 4 == 0), "seen")
    return each.select("session_id", "turn_no", "e.k", rules.category(F.col("text"), F.col("e.name"), new, says, F.col("e.id")).alias("category"))


@query("nevents", """ SELECT type, CAST(greatest(max(CAST(regexp_extract(id, '^evt-(\\d+)$', 1) AS BIGINT)), 0) + 1 AS BIGINT) AS next_number, printf('evt-%03d', max(CAST(regexp_extract(id, '^evt-(\\d+)$', 1) AS BIGINT)) + 1) AS next_id FROM nevents GROUP BY type""")
def next_event_ids(s, d):
    return rules.next_ids(domain.events(s, d), "evt", ["type"])


@query("", """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)
SELECT user_id, event_id, CAST(coalesce(sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS failures FROM r""")
def failures_in_a_row(s, d):
    e = domain.table(s, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return rules.cooled_down(e, "user_id", "event_id").select("user_id", "event_id", "failures")


# --- the catalog

def _named(s, d):
    """Entities with aliases and an order: parts under their names, customers with aliases."""
    parts = domain.table(s, d, "part").select(F.concat(F.lit("item-part-"), "p_partkey").alias("id"), F.lit("item").alias("type"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "The ").otherwise(""), F.col("p_name")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("p_partkey").alias("ord"))
    people = _aliases(s, d).select("id", F.lit("character").alias("type"), "name", F.filter("aliases", lambda x: x.isNotNull()).alias("aliases"), (F.regexp_extract("id", r"(\d+)$", 1).cast("long") + 1_000_000).alias("ord"))
    return parts.unionByName(people)


_NAMED = f"""named AS (SELECT 'item-part-' || p_partkey AS id, 'item' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || p_name AS name, CAST([] AS VARCHAR[]) AS aliases, p_partkey AS ord FROM part
  UNION ALL SELECT 'char-customer-' || c_custkey, 'character', c_name, list_filter({_ALIASES}, lambda x: x IS NOT NULL), c_custkey + 1000000 FROM customer),
keyed AS (SELECT id, type, ord, pos, unnest([lower(trim(n)), regexp_replace(lower(trim(n)), '^(the|a|an)\\s+', '')]) AS key FROM (SELECT id, type, ord, unnest([name] || aliases) AS n, generate_subscripts([name] || aliases, 1) AS pos FROM named)),
name_index AS (SELECT key, arg_min(id, ord * 100 + pos) AS id, arg_min(type, ord * 100 + pos) AS type FROM keyed WHERE key <> '' GROUP BY key)"""


@query("", "WITH " + _NAMED + " SELECT key, id, type FROM name_index")
def catalog_name_index(s, d):
    return catalog.name_index(_named(s, d))


@query("", "WITH " + _NAMED + f""", p AS (SELECT p_partkey AS cid, lower(trim({_NAME})) AS low, {_TYPE} AS type FROM part), f AS (SELECT cid, type, unnest([low, regexp_replace(low, '^(the|a|an)\\s+', '')]) AS key, unnest([0, 1]) AS form FROM p)
SELECT cid, arg_min(n.id, form) AS id, arg_min(n.type, form) AS known_type FROM f JOIN name_index n USING (key) WHERE f.type <> n.type GROUP BY cid""")
def cross_type_conflicts(s, d):
    c = _parts(s, d).select(F.col("p_partkey").alias("cid"), "name", "type")
    return catalog.type_conflicts(c, catalog.name_index(_named(s, d)))


_REFS_OF = "CASE p_partkey % 5 WHEN 0 THEN 'char-customer-' || p_partkey WHEN 1 THEN 'char-nobody' WHEN 2 THEN '' WHEN 3 THEN 'loc-nation-' || p_partkey ELSE NULL END"
_NEW_ID = "CASE p_partkey % 3 WHEN 0 THEN 'item-fresh-' || p_partkey WHEN 1 THEN 'item-part-' || p_partkey ELSE 'thing-x' END"


def _records(s, d):
    return domain.table(s, d, "part").select(F.col("p_partkey").alias("cid"), F.expr(_REFS_OF).alias("existing_id"), F.expr(_NEW_ID).alias("proposed_id"), (F.col("p_partkey") % 2 == 0).alias("is_new"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("name"), F.lit(None).cast("string").alias("type"))


@query("entities", f""", r AS (SELECT p_partkey AS cid, {_REFS_OF} AS x, {_NEW_ID} AS p, p_partkey % 2 = 0 AS is_new FROM part), m AS (SELECT *, coalesce(x, '') <> '' AND x NOT IN (SELECT id FROM entities) AS wrong, is_new AND (starts_with(p, 'item-')) AND p NOT IN (SELECT id FROM entities) AS fresh FROM r)
SELECT cid, CASE WHEN wrong AND fresh THEN NULL ELSE x END AS existing_id, p AS proposed_id, CASE WHEN NOT wrong THEN 'kept' WHEN fresh THEN 'new' ELSE 'dropped' END AS verdict FROM m""")
def existing_id_checks(s, d):
    return catalog.checked_ids(_records(s, d), domain.entities(s, d))


@query("entities", f""", r AS (SELECT p_partkey AS cid, {_REFS_OF} AS existing_id, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name FROM part), j AS (SELECT r.*, coalesce(r.existing_id, '') <> '' AND r.name IS NULL AS bare, e.id AS eid, e.name AS ename, e.type AS etype FROM r LEFT JOIN entities e ON e.id = r.existing_id)
SELECT cid, existing_id, CASE WHEN bare THEN ename ELSE name END AS name, CASE WHEN bare THEN etype END AS type, bare AS expanded FROM j WHERE NOT bare OR eid IS NOT NULL""")
def compact_entries(s, d):
    return catalog.expanded(_records(s, d), domain.entities(s, d))


_BIRTH = "CASE event_id % 50 WHEN 0 THEN 'A child named Ada Vale is born' WHEN 1 THEN 'twins, one named User' || user_id || ' here' WHEN 2 THEN 'A girl named Mira arrives' ELSE 'a birth, unnamed child' END"


def _births(s, d):
    e = domain.table(s, d, "events")
    return e.select(F.concat(F.lit("evt-"), "event_id").alias("id"), F.when(F.col("event_type") == "signup", "birth").otherwise("other").alias("type"), (F.col("event_id") % 40 + 1).alias("turn_no"), F.array(F.concat(F.lit("char-user-"), "user_id")).alias("refs"), F.expr(_BIRTH).alias("description"))


@query("", f"""WITH e AS (SELECT event_id, event_id % 40 + 1 AS turn_no, regexp_extract({_BIRTH}, '\\bnamed\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1) AS name FROM events WHERE event_type = 'signup')
SELECT 'char-' || replace(lower(name), ' ', '-') AS id, name, 'character' AS type, 'Child born during the narrative, named ' || name || '.' AS identity, min(turn_no) AS first_seen FROM e WHERE name <> '' GROUP BY name""")
def born_entities(s, d):
    return catalog.birth_entities(_births(s, d), domain.entities(s, d))[1]


@query("", f"""SELECT 'evt-' || event_id AS id, 'char-user-' || user_id || CASE WHEN event_type = 'signup' AND regexp_extract({_BIRTH}, 'named ([A-Z][a-z]+( [A-Z][a-z]+)*)', 1) <> '' THEN ',char-' || replace(lower(regexp_extract({_BIRTH}, 'named ([A-Z][a-z]+( [A-Z][a-z]+)*)', 1)), ' ', '-') ELSE '' END AS refs FROM events""")
def birth_event_refs(s, d):
    return catalog.birth_entities(_births(s, d), domain.entities(s, d))[0].select("id", F.array_join("refs", ",").alias("refs"))


_PLACE = "CASE c_custkey % 6 WHEN 0 THEN ' LOC-Nation-3 ' WHEN 1 THEN 'france' WHEN 2 THEN ' Twin Peaks' WHEN 3 THEN 'the road' WHEN 4 THEN NULL ELSE 'Old ' || c_mktsegment END"


@query("", f"""WITH l AS (SELECT 'loc-nation-' || n_nationkey AS id, unnest([n_name, CASE WHEN n_nationkey < 2 THEN 'twin peaks' ELSE 'old ' || n_name END, CASE n_nationkey WHEN 4 THEN 'OLD BUILDING' END]) AS n FROM nation), k AS (SELECT lower(n) AS n, min(id) AS loc FROM l WHERE n IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) = 1),
c AS (SELECT 'char-customer-' || c_custkey AS id, {_PLACE} AS place FROM customer)
SELECT c.id, CASE WHEN lower(trim(place)) LIKE 'loc-%' THEN lower(trim(place)) ELSE coalesce(loc, place) END AS location FROM c LEFT JOIN k ON n = lower(trim(place))""")
def normal_locations(s, d):
    own = F.array(F.when(F.col("n_nationkey") < 2, F.lit("twin peaks")).otherwise(F.concat(F.lit("old "), "n_name")), F.when(F.col("n_nationkey") == 4, "OLD BUILDING"))
    places = domain.table(s, d, "nation").select(F.concat(F.lit("loc-nation-"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), own.alias("aliases"))
    people = domain.table(s, d, "customer").select(F.concat(F.lit("char-customer-"), "c_custkey").alias("id"), F.expr(_PLACE).alias("location"))
    return catalog.located(people, places)


_RAW_ID = "CASE c_custkey % 6 WHEN 0 THEN 'CHAR-customer-' || c_custkey WHEN 1 THEN 'customer-' || c_custkey WHEN 2 THEN 'char-custmer-' || c_custkey || 'x' WHEN 3 THEN 'loc-' || c_custkey WHEN 4 THEN 'npc-newcomer' || c_custkey ELSE 'char-zzcustomer' || c_custkey END"


@query("", f"""WITH known AS (SELECT 'char-customer-' || c_custkey AS id FROM customer UNION ALL SELECT 'loc-nation-' || n_nationkey FROM nation), r AS (SELECT DISTINCT {_RAW_ID} AS raw FROM customer),
n AS (SELECT raw, CASE WHEN regexp_matches(lower(raw), '^(char|loc|faction|item|creature|concept)-') THEN lower(raw) ELSE 'char-' || regexp_replace(lower(raw), '^[a-z]+-', '') END AS id FROM r),
p AS (SELECT raw, n.id, known.id AS kid, regexp_replace(n.id, '^[a-z]+-', '') AS a, regexp_replace(known.id, '^[a-z]+-', '') AS b FROM n, known),
q AS (SELECT *, list_distinct(string_split(a, '-')) AS ta, list_distinct(string_split(b, '-')) AS tb FROM p),
m AS (SELECT raw, id, kid, CASE WHEN id = kid THEN 0 WHEN len(list_intersect(ta, tb)) = least(len(ta), len(tb)) THEN 1 WHEN levenshtein(a, b) <= 2 AND a[1] = b[1] THEN 2 END AS how, levenshtein(a, b) AS dist FROM q),
best AS (SELECT raw, id, kid, how, row_number() OVER (PARTITION BY raw ORDER BY how, CASE WHEN how = 1 THEN length(kid) ELSE dist END, kid) AS k FROM m)
SELECT raw, CASE WHEN how IS NULL THEN id ELSE kid END AS id FROM best WHERE k = 1""")
def normal_ids(s, d):
    people = domain.table(s, d, "customer")
    known = people.select(F.concat(F.lit("char-customer-"), "c_custkey").alias("id")).unionByName(domain.table(s, d, "nation").select(F.concat(F.lit("loc-nation-"), "n_nationkey").alias("id")))
    return catalog.normalized_ids(people.select(F.expr(_RAW_ID).alias("raw")), known)


@query("entities", """, i AS (SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'char-customer-' || p_partkey WHEN 1 THEN 'char-old-' || p_partkey WHEN 2 THEN 'loc-new-' || p_partkey ELSE '' END AS id, CASE p_partkey % 3 WHEN 0 THEN ' FRANCE ' WHEN 1 THEN 'Customer#000000001' ELSE p_name END AS name FROM part),
n AS (SELECT lower(name) AS n, type, min(id) AS kid FROM entities GROUP BY ALL), o AS (SELECT lower(name) AS n, min(id) AS kid FROM entities GROUP BY 1 HAVING count(*) = 1)
SELECT key, i.id, coalesce(e.id, CASE WHEN i.id LIKE 'char-old-%5' THEN 'char-survivor' END, CASE WHEN i.id <> '' THEN n.kid ELSE o.kid END) AS canonical FROM i LEFT JOIN entities e ON e.id = i.id LEFT JOIN n ON n.n = lower(trim(i.name)) AND n.type = CASE WHEN i.id LIKE 'loc-%' THEN 'location' ELSE 'character' END LEFT JOIN o ON o.n = lower(trim(i.name))""")
def canonical_of_segment(s, d):
    i = domain.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'char-customer-' || p_partkey WHEN 1 THEN 'char-old-' || p_partkey WHEN 2 THEN 'loc-new-' || p_partkey ELSE '' END").alias("id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' FRANCE ' WHEN 1 THEN 'Customer#000000001' ELSE p_name END").alias("name"))
    old = i.where("id like 'char-old-%5'").select("id", F.lit("char-survivor").alias("survivor"))
    return catalog.canonical_ids(i, domain.entities(s, d).select("id", "name", "type"), old)


@query("", "WITH " + _NAMED + """ SELECT id, id || ' | ' || name || ' | ' || type || CASE WHEN ord % 2 = 0 THEN ' — of ' || type ELSE '' END || CASE WHEN len(aliases) > 0 THEN ' (aliases: ' || array_to_string(aliases, ', ') || ')' ELSE '' END AS line FROM named""")
def known_entities(s, d):
    return catalog.known_list(_named(s, d).withColumn("identity", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("of "), "type"))))


_COLS = ["id", "type", "name", "identity", "current_status", "first_seen", "last_updated"]
_UPD_NAME = "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'the ' || c_name WHEN 2 THEN 'Stranger' WHEN 3 THEN '' ELSE c_name || '-Elder' END"


def _update_rows(s, d):
    own = domain.table(s, d, "customer").selectExpr(
        "CASE WHEN c_custkey % 7 = 0 THEN 'item-customer-' || c_custkey ELSE 'char-customer-' || (c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END) END AS id",
        "'character' AS type", f"{_UPD_NAME} AS name", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'now ' || c_mktsegment END AS identity", "CASE WHEN c_custkey % 4 = 0 THEN 'resting' END AS current_status",
        "CAST(NULL AS BIGINT) AS first_seen", "CAST(40 + c_custkey % 50 AS BIGINT) AS last_updated", "CASE WHEN c_custkey % 9 = 0 THEN array('Nick', 'customer#000000001', ' ') END AS aliases")
    return own


@query("entities", f""", u AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'item-customer-' || c_custkey ELSE 'char-customer-' || (c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END) END AS id, {_UPD_NAME} AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'now ' || c_mktsegment END AS identity, CASE WHEN c_custkey % 4 = 0 THEN 'resting' END AS status, 40 + c_custkey % 50 AS t, c_custkey % 9 = 0 AS al FROM customer),
v AS (SELECT * FROM u WHERE id LIKE 'char-%'), c AS (SELECT * FROM entities WHERE type = 'character'),
k AS (SELECT c.*, v.name AS un, v.identity AS ui, v.status AS us, v.t, v.al, coalesce(v.name = 'Stranger', false) AS refused, coalesce(v.name, '') <> '' AND v.name <> c.name AND v.name <> 'Stranger' AS renamed FROM c LEFT JOIN v USING (id))
SELECT id, type, CASE WHEN renamed THEN un ELSE name END AS name, CASE WHEN NOT refused AND coalesce(ui, '') <> '' THEN ui ELSE identity END AS identity, CASE WHEN NOT refused AND us IS NOT NULL THEN us ELSE current_status END AS current_status, first_seen, greatest(last_updated, coalesce(t, 0)) AS last_updated,
  CASE WHEN NOT refused AND coalesce(al, false) THEN 'Nick' || CASE WHEN renamed THEN '|' || name ELSE '' END WHEN renamed THEN name ELSE '' END AS aliases FROM k
UNION ALL SELECT id, 'character', name, identity, status, t, t, CASE WHEN al THEN 'Nick' ELSE '' END FROM v WHERE id NOT IN (SELECT id FROM c) AND name <> '' AND identity <> ''""")
def entity_upsert(s, d):
    current = domain.entities(s, d).where("type = 'character'").select(*_COLS, F.array().cast("array<string>").alias("aliases"))
    return catalog.upserted(current, _update_rows(s, d)).withColumn("aliases", F.array_join("aliases", "|"))


@query("entities", "SELECT id, name FROM entities WHERE id IN (SELECT 'char-customer-' || event_id FROM events) ")
def entities_by_id(s, d):
    wanted = domain.table(s, d, "events").select(F.concat(F.lit("char-customer-"), "event_id").alias("id"))
    return catalog.by_id(domain.entities(s, d).withColumn("ord", F.lit(0)), wanted).select("id", "name")


@query("entities", "SELECT min(id) AS id FROM entities WHERE id LIKE 'char-customer-1%'")
def player_of_catalog(s, d):
    e = domain.entities(s, d).withColumn("id", F.regexp_replace("id", "^char-customer-1", "char-player1")).withColumn("ord", F.lit(0))
    return catalog.player_entity(e).select(F.regexp_replace("id", "^char-player1", "char-customer-1").alias("id"))


@query("nevents", ", r AS (SELECT unnest(refs) AS id FROM nevents), n AS (SELECT id, count(*) AS events FROM r GROUP BY 1), s AS (SELECT id, events - CASE WHEN events % 3 = 0 THEN 1 ELSE 0 END AS old, events % 5 = 0 AS untitled FROM n WHERE events % 4 <> 0) SELECT n.id, n.events, s.id IS NULL OR n.events <> s.old OR untitled AS stale FROM n LEFT JOIN s USING (id)")
def pages_to_write(s, d):
    n = indices.event_refs(domain.events(s, d)).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("events"))
    old = n.where("events % 4 <> 0").select("id", (F.col("events") - F.when(F.col("events") % 3 == 0, 1).otherwise(0)).alias("events"), F.array(F.struct(F.when(F.col("events") % 5 != 0, "a title").alias("title"))).alias("phases"))
    return rules.pages_to_write(n, old)
