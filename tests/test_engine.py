"""The narrative engine: traps, parsers, ordered operators against plain Python, streams against batches."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from skein.functions import provider, turns as T
from skein.operators import indices, mentions, ordered, resolution, sequences, stats, text_state, validation
from skein.plans import check_queries as _checks  # noqa: F401
from skein.plans import more_queries as _more  # noqa: F401
from skein.plans import relation_queries as _relations  # noqa: F401
from skein.plans import rule_queries as _rules  # noqa: F401
from skein.plans import state_queries as _states  # noqa: F401
from skein.plans import queries as engine
from skein.sources import domain, transcripts
from skein.streaming import turns as streaming


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_turn_parsers_differ_on_failures(spark):
    d = spark.createDataFrame([("turn-007",), ("turn-12b",), ("x turn-3",), ("none",), (None,)], "t string")
    c = F.col("t")
    got = [tuple(r) for r in d.select(T.turn_or_null(c), T.turn_or_zero(c), T.first_digits_or_zero(c), T.turn_anywhere(c)).collect()]
    assert got == [(7, 7, 7, 7), (None, 0, 12, 12), (None, 0, 3, 3), (None, 0, 0, None), (None, 0, 0, None)]


def test_days_round_half_to_even(spark):
    d = spark.range(1, 6).select(T.estimated_day(F.col("id")).alias("d"))
    assert [r.d for r in d.collect()] == [round((n - 1) * 3.5) for n in range(1, 6)]


def test_words_keep_unicode_bounds(spark):
    d = spark.createDataFrame([("the äiceä melts",), ("ice.",), ("Ice ice",)], "text string")
    assert [tuple(r) for r in d.select(T.has_word(F.lower("text"), "ice"), T.count_word(F.lower("text"), "ice")).collect()] == [(False, 0), (True, 1), (True, 2)]


def test_mentions_need_bounds(spark):
    names = spark.createDataFrame([("char-kael", "Kael"), ("item-fire", "camp fire"), ("x", "ab"), ("loc-a", "Sankt Ärn")], "id string, name string")
    texts = spark.createDataFrame([(1, "Kael sits by the camp fire"), (2, "ökael and campfire, char-kael2"), (3, "char-kael."), (4, "the camp, fire; ab"), (5, "In sankt ärn!"), (6, None), (7, "")], "k long, text string")
    assert rows(mentions.mention_join(texts, names, ["k"])) == [(1, "char-kael"), (1, "item-fire"), (3, "char-kael"), (5, "loc-a")]


def test_mention_plan_has_no_nested_loop(spark, sf_dir):
    plan = engine.QUERIES["mention_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_status_rules_differ(spark):
    edges = spark.createDataFrame([("a", "b", "t", None, 1, 1), ("a", "c", "t", "active", 1, 1), ("a", "d", "t", "resolved", 1, 1)], "source_id string, target_id string, rel_type string, status string, first_turn long, last_turn long")
    m = spark.createDataFrame([(1, "a"), (1, "c")], "k long, entity_id string")
    assert rows(mentions.one_hop(m, edges, ["k"])) == [(1, "b")]
    e = spark.createDataFrame([("a", "A", "character", "i", None, None, 1, 5)], "id string, name string, type string, identity string, current_status string, location string, first_seen long, last_updated long")
    assert indices.entity_index(e, edges).first().active_relationships == 1
    assert rows(indices.dormant_edges(edges, e, 20, 10)) == [("a", "c", 5, None)]
    assert rows(mentions.nearby(e, 3, 1)) == [("a", 5)]
    assert mentions.nearby_indexed(indices.turn_activity(e), 3, 1).count() == 0


def test_markers_and_states(spark):
    t = spark.createDataFrame([("s", 1, "Used fire bolt\nUsed a b c d e f g\n--- Long rest ---\n\U0001FA78 7 HP lost\nReached level 4"), ("s", 2, "Kael takes 5 damage. HP: 3/10. He is badly wounded, poisoned by a snake."), ("s", 3, "calm")], "session_id string, turn_no long, text string")
    assert [tuple(r)[2:] for r in text_state.markers(t).orderBy("seq").collect()] == [(1, "hp_change", "-7"), (2, "long_rest", ""), (3, "spell_use", "fire bolt"), (4, "level_up", "4")]
    assert rows(text_state.hp_state(t)) == [("s", 2, 3, 10, "-5", "badly wounded")]
    assert rows(text_state.status_effects(t)) == [("s", 2, "poisoned")]


def test_base_season_needs_margin(spark):
    t = spark.createDataFrame([("warm heat of harvest",), ("warm heat and frost",), ("snow snow snow",), ("leaves cooling autumn",)], "text string")
    assert [r[0] for r in text_state.seasons(t).select("base").collect()] == ["summer", None, None, "autumn"]


def test_flicker_window_counts_rows(spark):
    t = spark.createDataFrame([("s", 1, "mid_winter", 0.5), ("s", 500, "early_winter", 0.5), ("s", 501, "mid_summer", 0.5)], "session_id string, turn_no long, season string, confidence double")
    assert [r[1] for r in rows(sequences.without_flicker(t))] == [1, 500]


def test_within_turn_dedup(spark):
    names = [(1, "Old Rod"), (1, "old rod of fire"), (1, "Gandlaf"), (1, "Gandalf"), (1, "Bo"), (1, "Bi"), (1, ""), (2, "Old Rod"), (3, "elder"), (3, "eldorman"), (3, "raven"), (4, "camp"), (4, "camping grounds"), (5, "Thorne"), (5, "Lyra"), (5, "Lyr")]
    c = spark.createDataFrame([(t, k, n) for k, (t, n) in enumerate(names)], "turn_no long, ord long, name string")
    kept = collections.defaultdict(list)
    for r in ordered.dedup_within_turn(c).orderBy("ord").collect():
        kept[r.turn_no].append(r.name)
    assert kept == {1: ["old rod of fire", "Gandlaf", "Bo", "Bi", ""], 2: ["Old Rod"], 3: ["eldorman", "raven"], 4: ["camping grounds"], 5: ["Thorne", "Lyra"]}


def test_long_names_are_found(spark):
    names = spark.createDataFrame([("item-ring", "Ring of the Last King of All"), ("x", "Ring")], "id string, name string")
    texts = spark.createDataFrame([(1, "The ring of the last king of all, and a ring."), (2, "a ring of the last")], "k long, text string")
    assert rows(mentions.mention_join(texts, names, ["k"])) == [(1, "item-ring"), (1, "x"), (2, "x")]


def test_markdown_headers_of_any_case(spark):
    d = spark.createDataFrame([("s", "## Turn-001 [DM]\nhello\n## turn-2 [player] (late)\nyes\n")], "session_id string, content string")
    assert [tuple(r) for r in transcripts.parse_markdown(d).orderBy("turn_no").select("turn_no", "speaker").collect()] == [(1, "dm"), (2, "player")]


def test_entity_matching(spark):
    a = spark.createDataFrame([("1", "c", ["x"]), ("2", "c", ["y", "z"]), ("3", "c", ["q"])], "id string, type string, keys array<string>")
    b = spark.createDataFrame([("1", "c", ["w"]), ("9", "c", ["z"]), ("8", "c", ["n"])], "id string, type string, keys array<string>")
    assert sorted(map(str, ordered.match_entities(a, b).select("a", "b", "outcome").collect())) == sorted(map(str, [r for r in spark.createDataFrame([("1", "1", "retained"), ("2", "9", "renamed"), ("3", None, "removed"), (None, "8", "added")], "a string, b string, outcome string").collect()]))


def test_phase_merge_and_budget(spark):
    p = spark.createDataFrame([("e", k, k * 10, k * 10 + 5, n) for k, n in enumerate([5, 1, 2, 9], 1)], "entity_id string, phase long, first_turn long, last_turn long, events long")
    assert rows(ordered.merge_phases(p, 2)) == [("e", 1, 10, 35, 8), ("e", 2, 40, 45, 9)]
    r = spark.createDataFrame([("s", k, f"e{k}", 10, 4, 1) for k in range(4)], "session_id string, rank long, id string, full long, brief long, name_only long")
    assert [x[3] for x in rows(ordered.fit_budget(r, 28))] == ["full", "full", "brief", "brief"]
    assert [x[3] for x in rows(ordered.fit_budget(r, 3))] == ["id", "id", "id", "omitted"]


def test_lifecycles_and_repair(spark):
    m = spark.createDataFrame([("s", 1, "pregnancy"), ("s", 10, "birth"), ("s", 12, "labor"), ("s", 60, "labor")], "session_id string, turn_no long, marker string")
    assert rows(ordered.lifecycles(m)) == [("s", 1, 10, True, 2), ("s", 12, 12, False, 1), ("s", 60, 60, False, 1)]
    t = spark.createDataFrame([("a", '{"entities": [{"n": "x}"}, {"m": {"k": 1}}, {"cut": ')], "id string, text string")
    assert [json.loads(r.object) for r in ordered.repair_json_objects(t).orderBy("nth").collect()] == [{"n": "x}"}, {"m": {"k": 1}}]


def test_components_are_an_equivalence(spark):
    chain = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(15)] + [("x", "y")]
    got = dict(rows(resolution.components(spark.createDataFrame(chain, "a string, b string"))))
    assert {got[f"n{k:02d}"] for k in range(16)} == {"n00"} and got["y"] == "x"


def test_fuzzy_pairs_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    names = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() or "z" for _ in range(60)]
    n = spark.createDataFrame([(f"i{k:02d}", "t", x) for k, x in enumerate(names)], "id string, type string, name string")
    flat = dict(n.select("id", T.normal_name(F.col("name"))).collect())
    expected = {(a, b) for a, b in itertools.combinations(sorted(flat), 2) if flat[a] and flat[b] and ordered._edits(flat[a], flat[b], 2) <= 2}
    assert {(r.a, r.b) for r in resolution.fuzzy_pairs(n, 2).collect()} == expected


def test_upsert_is_idempotent(spark, sf_dir):
    once = engine.QUERIES["upsert_entities"](spark, sf_dir)
    none = once.limit(0).withColumn("ord", F.lit(1).cast("long"))
    assert rows(resolution.upsert_entities(once, none).select(*once.columns).na.fill("-")) == rows(once.na.fill("-"))


def test_edges_seen_from_both_sides(spark, sf_dir):
    d = engine.QUERIES["adjacency_degree"](spark, sf_dir).agg(F.sum("forward"), F.sum("reverse")).first()
    assert d[0] == d[1] == domain.edges(spark, sf_dir).count()


def test_bands_and_summary(spark):
    log = spark.createDataFrame([("A1", "A", t, 2, 200 + t) for t in range(1, 13)] + [("B1", "B", t, 2, 260 + 2 * t) for t in range(1, 13)], "run string, arm string, turn_no long, calls long, tokens long")
    s = stats.paired_summary(stats.paired_deltas(log, stats.matched_turns(log, 2))).first()
    assert s.n == 12 and s.separable and s.low < s.mean < s.high
    assert stats.token_bands(log).where("arm = 'A'").first().band == "1-20"


def test_transcript_formats(spark):
    md = "## turn-003 [dm]\n---\nThe gate.\n---\n\n## turn-004 [player]\n\n\n## turn-005 [player]\nI go.\n"
    lab = "**GM:** Hello\nthere\n[Ann]: Hi\nGM:\nAnn: Bye"
    alt = "one\n\ntwo\nlines\n\n\nthree"
    d = spark.createDataFrame([("m", md), ("l", lab), ("a", alt)], "session_id string, content string")
    assert dict(rows(d.select("session_id", transcripts.detect_format(F.col("content"), ["GM", "Ann"])))) == {"m": "markdown", "l": "labeled", "a": "alternating"}
    assert rows(transcripts.parse_markdown(d.where("session_id = 'm'"))) == [("m", 3, "dm", "The gate."), ("m", 5, "player", "I go.")]
    assert rows(transcripts.parse_labeled(d.where("session_id = 'l'"), ["GM"], ["Ann"])) == [("l", 1, "dm", "Hello\nthere"), ("l", 2, "player", "Hi"), ("l", 3, "player", "Bye")]
    t = transcripts.parse_alternating(d.where("session_id = 'a'"))
    assert rows(t) == [("a", 1, "player", "one"), ("a", 2, "dm", "two\nlines"), ("a", 3, "player", "three")]
    assert rows(transcripts.next_turn(t)) == [("a", 4)] and transcripts.repeated_speakers(t).count() == 0 and transcripts.slice_turns(t, 2, 1).count() == 1


def test_file_sources(spark, tmp_path):
    (tmp_path / "turns").mkdir()
    (tmp_path / "turns/turn-002-dm.md").write_text("# Turn\nThe hall.\n")
    (tmp_path / "turns/notes.md").write_text("no")
    assert rows(transcripts.read_turn_files(spark, str(tmp_path / "turns"))) == [(2, "dm", "The hall.")]
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat/a.json").write_text(json.dumps({"id": "char-a", "name": "A", "relationships": [{"target_id": "loc-b", "status": "active"}]}))
    (tmp_path / "cat/index.json").write_text(json.dumps({"id": "char-x"}))
    (tmp_path / "cat/broken.json").write_text("{")
    e = transcripts.read_entities(spark, str(tmp_path / "cat"))
    assert [r.id for r in e.collect()] == ["char-a"] and transcripts.edges_of(e).first().target_id == "loc-b"
    (tmp_path / "log.jsonl").write_text('{"turn_id": "turn-1", "n": 1}\n\n{"n": 9}\n{"turn_id": "turn-1", "n": 2}\n')
    assert [(r.turn_id, r.n) for r in transcripts.read_log(spark, str(tmp_path / "log.jsonl"), "turn_id string, n int").collect()] == [("turn-1", 2)]


def test_validation_rules(spark):
    e = spark.createDataFrame([("char-a", "A", "character", "x", 1, 2), ("loc-b", "", "item", None, 3, 2)], "id string, name string, type string, identity string, first_seen long, last_updated long")
    found = validation.check(e, "id", validation.entity_rules())
    assert rows(found) == [("loc-b", r) for r in ("identity", "name", "prefix", "turns")]
    assert rows(validation.report({"entities": found, "none": found.limit(0)})) == [("entities", "FAIL", 4), ("none", "PASS", 0)]


def test_provider(spark):
    p = spark.createDataFrame([("1", "Then Kaelthas met Bob in Stormwind"), ("2", None)], "id string, prompt string")
    assert rows(provider.discovered(provider.complete(p))) == [("1", "Kaelthas", 0.9), ("1", "Stormwind", 0.9)]

    def broken(prompts):
        raise RuntimeError("quota")

    assert {r.answer for r in provider.complete(p, broken).collect()} == {None}
    assert spark.range(1).select(provider.clean_answer(F.lit('<think>x</think>```json\n{"confidence": 0-0.95}\n```'))).first()[0] == '{"confidence": 0.95}'


def _stream(spark, tmp_path, batches, schema):
    src = tmp_path / "in"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_streamed_activity_equals_batch(spark, tmp_path):
    schema = "session_id string, turn_no long, text string"
    batches = [[("s", t, "x" * t) for t in range(1, 30)], [("s", t, "y") for t in range(30, 60)], [("s", 28, "late")], [("s", 300, "end")]]
    live = streaming.activity_by_bucket(_stream(spark, tmp_path, batches, schema))
    q = live.writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    all_rows = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = dict((r[1], r[2]) for r in rows(streaming.activity_by_bucket(all_rows)))
    assert dict((r[1], r[2]) for r in rows(spark.table("activity"))).items() <= batch.items() and batch[0] == 24
    assert rows(streaming.activity_sessions(all_rows))[0][1:] == (1, 60)


def test_streamed_upserts_equal_batch(spark, tmp_path):
    schema = "id string, name string, type string, identity string, current_status string, location string, first_seen long, last_updated long, ord long"
    batches = [[("a", "A", "character", None, "x", None, 3, 3, 1), ("b", "B", "item", "i", None, None, 4, 4, 2)], [("a", None, None, "late", None, "loc", 1, 2, 3)]]
    own = schema.removesuffix(", ord long")
    empty = spark.createDataFrame([], own)
    merge = lambda now, new: resolution.upsert_entities(now, new).select(*empty.columns)
    q = streaming.upsert_stream(_stream(spark, tmp_path, batches, schema), str(tmp_path / "table"), str(tmp_path / "cp"), merge, empty)
    q.processAllAvailable()
    q.stop()
    batch = merge(empty, spark.createDataFrame([r for b in batches for r in b], schema))
    assert sorted(map(str, streaming.latest(spark, str(tmp_path / "table"), 1).collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_queries_have_rows_and_sql(spark, sf_dir, name):
    assert name in engine.SQL and not engine.QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns == ["session_id", "turn_no", "entity_id", "role", "name", "type", "location"]
