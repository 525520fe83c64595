"""Files and loops around the tables: documents, transcripts, sidecars, retries, refreshes, audit pairs, parallel results."""

import collections
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions.provider import complete
from skein.operators import details, planning, prompts, resolution
from skein.sources import documents, transcripts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kinds_of_documents(spark, tmp_path):
    path = str(tmp_path)
    assert documents.read(spark, f"{path}/timeline", documents.TIMELINE_DDL).count() == 0
    t = spark.createDataFrame([("s", "time-001", "time_skip", 3, None, "a week", None, 7, 0.5)], documents.TIMELINE_DDL)
    documents.write(t, f"{path}/timeline", dry_run=True)
    assert not documents.exists(spark, f"{path}/timeline")
    for _ in range(2):
        documents.write(t, f"{path}/timeline")
    assert rows(documents.read(spark, f"{path}/timeline", documents.TIMELINE_DDL)) == rows(t)
    e = spark.createDataFrame([("evt-001", ["turn-001"], "birth", ["char-a"], "a child", None)], transcripts.EVENT_DDL)
    documents.write(e, f"{path}/events")
    assert documents.read(spark, f"{path}/events", transcripts.EVENT_DDL).collect() == e.collect()
    for k in range(3):
        documents.append(spark.createDataFrame([(f"turn-{k}", "events", None, "s", "u", "a", None)], documents.CALL_DDL), f"{path}/calls")
    assert documents.read(spark, f"{path}/calls", documents.CALL_DDL).count() == 3


def test_sidecars_replace_their_own(spark, tmp_path):
    page = lambda i, n: spark.createDataFrame([(i, n, [("t", 1, 2, n)])], documents.PAGE_DDL)
    documents.write_sidecars(page("char-a", 3).unionByName(page("char-b", 4)), str(tmp_path), "synthesis")
    documents.write_sidecars(page("char-a", 9), str(tmp_path), "synthesis")
    assert rows(documents.read_sidecars(spark, str(tmp_path), "synthesis", documents.PAGE_DDL).select("entity_id", "events")) == [("char-a", 9), ("char-b", 4)]


def test_scene_graph_files(spark, tmp_path):
    e = spark.createDataFrame([("loc-a", "A", "location", None, 1, 4), ("char-b", "B", "character", "loc-a", 2, 9)], "id string, name string, type string, location string, first_seen long, last_updated long")
    g = spark.createDataFrame([("char-b", "loc-a", "spatial", "active", 2, 9)], "source_id string, target_id string, rel_type string, status string, first_turn long, last_turn long")
    assert documents.read_scene_graph(spark, f"{tmp_path}/g") is None
    documents.write_scene_graph(documents.scene_graph(e, g), f"{tmp_path}/g")
    found = documents.read_scene_graph(spark, f"{tmp_path}/g")
    assert rows(found["summary"]) == [(9, 2)] and found["turn_activity"].count() == 4 and found["location_index"].count() == 1


def test_full_transcripts_are_kept(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, "dm", " hello \n"), ("s", 2, "player", "yes"), ("t", 1, "dm", "x")], "session_id string, turn_no long, speaker string, text string")
    path = f"{tmp_path}/raw"
    text = lambda p, s: "".join(x.read_text() for x in sorted((p / f"session_id={s}").glob("*.txt"), key=lambda x: x.stat().st_mtime_ns))
    assert documents.write_full_transcripts(t, path) == "written"
    whole = "# Full Transcript\n\n---\n\n## turn-001 [dm]\n\nhello\n\n---\n\n## turn-002 [player]\n\nyes\n"
    assert text(tmp_path / "raw", "s") == whole
    documents.append_to_transcripts(spark.createDataFrame([("s", 3, "dm", "more")], t.schema), path)
    assert text(tmp_path / "raw", "s") == whole + "\n---\n\n## turn-003 [dm]\n\nmore\n"
    read = transcripts.parse_markdown(spark.createDataFrame([("s", text(tmp_path / "raw", "s"))], "session_id string, content string"))
    assert rows(read) == [("s", 1, "dm", "hello"), ("s", 2, "player", "yes"), ("s", 3, "dm", "more")]
    for flags in ({}, {"overwrite": True}, {"replace_raw": True}):
        assert documents.write_full_transcripts(t, path, **flags) == "skipped"
    assert documents.write_full_transcripts(t, path, overwrite=True, replace_raw=True) == "written"
    kept = [p for p in tmp_path.iterdir() if ".bak-" in p.name]
    assert len(kept) == 1 and "more" in text(kept[0], "s") and text(tmp_path / "raw", "s") == whole


class _Error(Exception):
    def __init__(self, status=None, retry_after=None):
        self.status, self.retry_after = status, retry_after


def test_retries():
    waits, errors = [], [_Error(503), _Error(None, 7), _Error(None, 500)]

    def flaky(p):
        if errors:
            raise errors.pop(0)
        return p

    assert details.retrying(flaky, attempts=4, wait=waits.append)(["a"]) == ["a"] and waits == [1.0, 7, 4.0]

    def limited(p):
        raise _Error(429)

    with pytest.raises(details.QuotaExhausted):
        details.retrying(limited, attempts=9, limits_in_a_row=3, wait=waits.append)(["a"])
    with pytest.raises(_Error):
        details.retrying(limited, attempts=2, wait=waits.append)(["a"])
    both = details.alternating([lambda p: ["x"], lambda p: ["y"]])
    assert [both([""])[0] for _ in range(3)] == ["x", "y", "x"]


def test_batched_prompts_hold_all(spark):
    c = spark.createDataFrame([(1, f"char-{k}", f"N{k}", "character") for k in range(7)] + [(2, "loc-a", "A", "location")], "turn_no long, id string, name string, type string")
    found = details.batched_prompts(c, spark.createDataFrame([(1, "one"), (2, "two")], "turn_no long, text string"), ["turn_no"], most=3).collect()
    assert sorted((r.id, len(r.ids)) for r in found) == [("1/0", 3), ("1/1", 3), ("1/2", 1), ("2/0", 1)] and sum((r.ids for r in found), []).count("char-6") == 1


CATALOG = "id string, type string, name string, identity string, current_status string, first_seen long, last_updated long, aliases array<string>"


def _tells(prompts_):
    return [json.dumps({"entity": {"id": "other", "identity": f"seen in {p.count('[turn-')} turns"}}) if "Ada" in p else "no json" for p in prompts_]


def test_refresh(spark):
    e = spark.createDataFrame([("char-a", "character", "Ada", "old", None, 1, 5, []), ("char-b", "character", "Bo", "old", None, 1, 5, []), ("char-c", "character", "Ada C", "old", None, 1, 99, [])], CATALOG)
    turns = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "turn_no long, text string")
    mentions = spark.createDataFrame([(k, i) for k in range(30) for i in ("char-a", "char-b", "char-c")], "turn_no long, entity_id string")
    context = details.refresh_context(e.select("id", "last_updated"), mentions, turns)
    assert sorted(r.id for r in context.collect()) == ["char-a", "char-b"] and context.where("id = 'char-a'").first().text.startswith("[turn-006] text 6\n")
    found = details.refreshed(e, context, 30, _tells)
    assert rows(found.select("id", "identity", "last_updated")) == [("char-a", "seen in 15 turns", 30), ("char-b", "old", 5), ("char-c", "old", 99)]


def test_pages_and_arcs(spark):
    e = spark.createDataFrame([("char-a", "Ada", "character"), ("char-b", "Bo", "character"), ("x-c", "C", "concept")], "id string, name string, type string")
    n = spark.createDataFrame([("char-a", 3), ("char-b", 2), ("x-c", 9)], "id string, events long")
    facts = spark.createDataFrame([("char-a", 2, "left"), ("char-a", 1, "came"), ("x-c", 1, "is")], "id string, ord long, fact string")
    assert rows(details.page_prompts(e, n, facts)) == [("char-a", "Tell the story of Ada (character) by these facts:\ncame\nleft")]
    chunks = spark.createDataFrame([("a", "b", 1, 1, 4, "trade"), ("a", "c", 1, 2, 2, "rivalry")], "source_id string, target_id string, chunk long, first_turn long, last_turn long, type string")
    assert rows(details.summarized_arcs(chunks, lambda p: [x[:11] for x in p])) == [("a", "b", 1, "Sum up a an"), ("a", "c", 1, "Sum up a an")]
    assert {r.summary for r in details.summarized_arcs(chunks).collect()} == {""} and rows(prompts.plain_arcs(chunks).select("phase", "key_turn")) == [("Phase 1", 1), ("Phase 1", 2)]


def test_audit_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + rng.choice(["", " of " + rng.choice("abc")]) for _ in range(120)]
    ents = [(f"{rng.choice(['char', 'loc'])}-{k}", n, rng.choice([None, 1, 2, 3])) for k, n in enumerate(made)]
    targets = [(i, f"t{rng.randrange(5)}") for i, _, _ in ents for _ in range(rng.randint(0, 4))]
    held = collections.defaultdict(set)
    for i, t in targets:
        held[i].add(t)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    bare = lambda n: n[2:] if n.startswith("a ") else n
    expected = {}
    for x, (i, n, t) in enumerate(sorted(ents)):
        for j, m, u in sorted(ents)[x + 1 :]:
            a, b, n, m = held[i], held[j], bare(n), bare(m)
            if i.split("-")[0] != j.split("-")[0] or (len(a) >= 3 and len(b) >= 3 and 2 * len(a & b) < min(len(a), len(b))):
                continue
            d = distance(n, m)
            if 0 < d <= 3:
                expected[i, j] = f"edit_distance={d}"
            elif len(n) >= 3 and len(m) >= 3 and (n in m or m in n):
                expected[i, j] = "substring"
            elif t is not None and t == u and (r := difflib.SequenceMatcher(None, n, m).ratio()) >= 0.6:
                expected[i, j] = f"same_turn+similar(ratio={r:.2f})"
    found = resolution.audit_pairs(spark.createDataFrame(ents, "id string, name string, first_seen long"), spark.createDataFrame(targets, "id string, target_id string"))
    got = {(r.a, r.b): r.reason for r in found.collect()}
    assert set(got.values()) and got == expected


def test_parallel_results(spark):
    base = spark.createDataFrame([("char-a", "character", "Ada", "old", None, 1, 5, [])], CATALOG)
    results = spark.createDataFrame(
        [("char-a", "character", "Ada", "second", None, 6, 7, None, 7, 0, False), ("char-a", "character", "Ada", "first", None, 6, 6, None, 6, 0, False), ("char-a", "character", "Ada", "lost", None, 6, 9, None, 9, 0, True), ("char-n", "character", "New", "one", None, None, 6, None, 6, 1, False)],
        CATALOG + ", turn_no long, ord long, failed boolean",
    )
    events = spark.createDataFrame([("evt-1", "a")], "id string, description string")
    fresh = spark.createDataFrame([("evt-1", "b", 1, False), ("evt-2", "c", 2, False), ("evt-2", "d", 3, False), ("evt-3", "e", 4, True)], "id string, description string, ord long, failed boolean")
    cat, ev = planning.merged_results(base, results, events, fresh)
    assert rows(cat.select("id", "identity", "first_seen", "last_updated")) == [("char-a", "second", 1, 7), ("char-n", "one", 6, 6)] and rows(ev) == [("evt-1", "a"), ("evt-2", "c")]


def test_numbers_from_settings():
    assert [prompts.segment_size(*x) for x in ((None, 150), (None, 151), (0, 500), (30, 10))] == [0, 100, 0, 30]
    assert [prompts.checkpoint_interval(x) for x in (None, "7", "x", 0, 3.9)] == [25, 7, 25, 25, 3]


def test_failed_calls_leave_nothing(spark):
    def broken(_):
        raise RuntimeError

    t = spark.createDataFrame([("s/1", "p")], "id string, prompt string")
    assert details.answered_entities(complete(t, broken)).count() == 0
    assert details.answered_events(complete(t, broken), F.lit("turn-001")).count() == 0


def test_catalog_without_duplicates(spark):
    from skein.operators import relations

    e = spark.createDataFrame([("char-kael", "character", "Kael", ["the scout"], 3), ("char-scout-x", "character", "The Scout", None, 1), ("char-lyra", "character", "Lyra Vane", [], 2), ("item-kael", "item", "Kael", [], 2)], "id string, type string, name string, aliases array<string>, first_seen long")
    edges = spark.createDataFrame([("char-kael", "char-lyra", "trade"), ("char-lyra", "char-kael", "trade"), ("char-kael", "char-scout-x", "other")], "source_id string, target_id string, rel_type string")
    events = spark.createDataFrame([("evt-1", ["char-lyra", "char-kael", "char-scout-x"])], "id string, refs array<string>")
    cat, ed, ev = relations.without_duplicates(e, edges, events)
    assert rows(cat.select("id", "name", "first_seen")) == [("char-lyra", "Lyra Vane", 2), ("char-scout-x", "The Scout", 1), ("item-kael", "Kael", 2)]
    assert cat.where("id = 'char-scout-x'").first().aliases == ["Kael"]
    assert rows(ed) == [("char-lyra", "char-scout-x", "trade"), ("char-scout-x", "char-lyra", "trade")] and ev.first().refs == ["char-lyra", "char-scout-x"]


def test_documents_of_a_folder_are_validated(spark, tmp_path):
    from skein.operators import relations

    docs = {"a/evt-1.json": '{"id": "evt-1", "source_turns": ["turn-001"], "type": "birth", "description": "x"}', "b/evt-2.json": '{"id": "two", "source_turns": [], "type": "birth", "description": ""}', "c.json": "{no json", "index.json": "[]"}
    for name, text in docs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = rows(relations.validated_folder(spark, str(tmp_path), transcripts.EVENT_DDL, relations.event_rules()).select("file", "rule"))
    assert found == [("c.json", "json"), ("evt-2.json", "description"), ("evt-2.json", "id"), ("evt-2.json", "source_turns")]
    d = spark.createDataFrame([(["a", "0"], "is short"), ([], "is no object")], "path array<string>, message string")
    assert rows(d.select(relations.finding(F.col("path"), F.col("message")))) == [("(root): is no object",), ("['a']['0']: is short",)]


def test_small_rules(spark):
    from skein.operators import rules

    d = spark.createDataFrame([("item", "concept-x", 3), ("concept", "concept-x", 4), (None, None, 5)], "type string, id string, n long")
    assert [r[0] for r in d.select(rules.concept_among_items(F.col("type"), F.col("id"))).collect()] == [True, False, False]
    s = d.select(prompts.compression_signals(F.col("n"), F.col("n") * 2).alias("s")).first().s
    assert (s.strategy, s.dropped_relationships, s.entities_included, s.relationships_total) == ("baseline", 0, 3, 6)
    attrs = spark.createDataFrame([("char-player", {"race": "elf", "mood": "x"}), ("char-a", {"mood": "x"})], "id string, a map<string,string>")
    assert [r[0] for r in attrs.select(rules.player_attributes(F.col("id"), F.col("a"))).collect()] == [{"race": "elf"}, {"mood": "x"}]
    keys = ["location"] + [f"k{k}" for k in range(40)] + ["condition"]
    state = spark.createDataFrame([([(k, "v") for k in keys],), ([("a", "b")],)], "e array<struct<key:string,value:string>>")
    kept = [[x.key for x in r[0]] for r in state.select(rules.pruned_state(F.col("e"))).collect()]
    assert kept == [["location", "condition"] + [f"k{k}" for k in range(12, 40)], ["a"]]
