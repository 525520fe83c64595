"""Queries and operators on what only larger tables hold, against their SQL, plain versions or plans."""

import datetime as dt
import random
import re

import duckdb

import __spark_entry__ as entry


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_sql(spark, folder, name):
    """A query's rows over Parquet tables of a folder, which are those of its SQL."""
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = rows(entry.queries()[name](spark, str(folder)))
    assert got == sorted(c.execute(entry.oracle_sql()[name]).fetchall(), key=repr)
    return got


def test_timeline_summary_beyond_a_million_events(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    events = [(398, 7, "view"), (5_000_397, 7, "click"), (399, 8, "view"), (400, 8, "click")]  # turns 399, 398; 400, 1
    spark.createDataFrame([(i, ts, u, t, 0.0, "{}") for i, u, t in events], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert [r[2] for r in same_as_sql(spark, tmp_path, "timeline_summary")] == ["mid_winter", "early_spring"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_ids_broadcast_no_exploded_rows(spark, sf_dir):
    plan = plan_of(entry.queries()["normal_ids"](spark, sf_dir))
    assert "SortMergeJoin [_p#" in plan and "BroadcastHashJoin [_p#" not in plan


def test_normal_ids_equal_brute_force(spark):
    from skein.operators.catalog import normalized_ids

    r = random.Random(5)
    some = lambda: "-".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3)))
    known = sorted({r.choice(("char-", "loc-", "")) + some() for _ in range(60)} | {"char-a-b", "loc-a-b", "char-Abc", "char-a--b"})
    raw = sorted({r.choice(("char-", "CHAR-", "npc-", "")) + some() for _ in range(150)} | {"char-a--", "b-a", "char-a", "char-", "char-bcabcA"})
    stem = lambda x: re.sub("^[a-z]+-", "", x)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def best(x):
        low = x.lower()
        i = low if re.match("(char|loc|faction|item|creature|concept)-", low) else "char-" + stem(low)
        if same := [k for k in known if k.lower() == i and stem(i)]:
            return min(same, key=lambda k: (k != i, k))
        a, own = stem(i), []
        for k in known:
            b = stem(k.lower())
            s, t = set(a.split("-")), set(b.split("-"))
            if a and b and len(s & t) == min(len(s), len(t)):
                own.append((0, len(k), k))
            elif a and b and a[0] == b[0] and edits(a, b) <= 2:
                own.append((1, edits(a, b), k))
        return min(own)[2] if own else i

    got = dict(map(tuple, normalized_ids(spark.createDataFrame([(x,) for x in raw], "raw string"), spark.createDataFrame([(x,) for x in known], "id string")).collect()))
    assert got == {x: best(x) for x in raw}


def test_wildcards_meet_ids_by_equality(spark, sf_dir):
    plan = plan_of(entry.queries()["truth_characters"](spark, sf_dir))
    assert "SortMergeJoin [_end#" in plan


def test_wildcards_equal_brute_force(spark):
    from skein.operators.truth import _wild_matches

    ids = ["char-a", "char-b", "char-ab", "loc-ab", "b-a", "", "a", "char-\U0001f600b", "cha?-a", "char-a.b"]
    patterns = ["char-*", "ch?r-?", "*-ab", "*-?b", "?-a", "[cl]*", "*h*", "*", "?", "??ar-*b", "char-[ab]", "*.b", "zz*", "char-?b", "*?", "[cl]*-ab", "cha?-a*"]
    fits = lambda p, i: re.fullmatch("".join({"*": ".*", "?": "."}.get(x, x) if x in "*?[]" else re.escape(x) for x in p), i)
    got = dict(map(tuple, _wild_matches(spark.createDataFrame([(p,) for p in patterns], "p string"), spark.createDataFrame([(i,) for i in ids], "id string")).collect()))
    assert got == {p: min(own) for p in patterns if (own := [i for i in ids if fits(p, i)])}


def test_same_names_keep_their_own_patterns(spark):
    from skein.operators.truth import independent_characters

    expected = spark.createDataFrame([("Kim", ["char-k1*"], False, None), ("Kim", ["char-k2*"], False, None)], "name string, id_patterns array<string>, optional boolean, least_turn long")
    characters = spark.createDataFrame([("char-k1", "x", None, 1), ("char-k2", "y", None, 1)], "id string, name string, aliases array<string>, last_updated long")
    assert sorted(r.detail for r in independent_characters(expected, characters, spark.createDataFrame([("z",)], "alias string")).collect()) == ["char-k1", "char-k2"]


def test_one_hop_makes_edges_of_mentioned_ids_alone(spark, sf_dir, monkeypatch):
    from skein.operators import mentions

    df = entry.queries()["one_hop_active"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*o_custkey#.* IN(SET)? .*char-customer-7", plan)  # below the join of orders with lineitem
    monkeypatch.setattr(mentions, "MOST_SOURCES", 1)
    assert rows(entry.queries()["one_hop_active"](spark, sf_dir)) == rows(df)


def test_mentions_shuffle_no_texts_by_word(spark):
    from skein.operators.mentions import mention_join

    texts = spark.createDataFrame([(None, 1, "The Red plate, by item-a."), ("s", 1, "red-plate"), ("s", 2, "red plates")], "s string, t long, text string")
    got = mention_join(texts, spark.createDataFrame([("item-a", "red plate"), ("item-b", "red-plate"), ("item-c", "the")], "id string, name string"), ["s", "t"], 2)
    assert "SortMergeJoin [_h#" in plan_of(got)
    assert rows(got) == sorted([(None, 1, "item-a"), (None, 1, "item-c"), ("s", 1, "item-b")], key=repr)


def test_colocated_equals_sets_and_shuffles_no_result(spark):
    from skein.operators.selection import colocated

    r = random.Random(3)
    entities = [(f"loc-{i}", r.choice([None, "LOC-0", "loc-1", "loc-2"]), "location") for i in range(4)] + [(f"char-{i}", r.choice([None, "loc-0", "Loc-3", "away"]), "character") for i in range(12)]
    mentioned = [(r.choice(["s", None]), r.randrange(4), r.choice(entities)[0]) for _ in range(25)]
    places = lambda i: {p.lower() for j, at, kind in entities if j == i for p in (at, j if kind == "location" else None) if p}
    want = {(s, t, e[0]) for s, t, i in mentioned for e in entities if places(i) & places(e[0])} - set(mentioned)
    got = colocated(spark.createDataFrame(mentioned, "s string, t long, entity_id string"), spark.createDataFrame(entities, "id string, location string, type string"), ["s", "t"])
    assert rows(got) == sorted(want, key=repr)
    assert "Exchange hashpartitioning(s" not in plan_of(got)


def test_catalog_merges_broadcast_no_exploded_rows(spark, sf_dir):
    from skein.operators.resolution import same_entities
    from skein.plans.check_queries import _entities

    plan = plan_of(same_entities(_entities(spark, sf_dir)))
    assert re.search(r"SortMergeJoin \[[^\]]*_h#", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*(piece|part|key|_h)#", plan)


def test_token_links_have_the_components_of_all_pairs(spark, monkeypatch):
    from skein.operators import resolution

    def groups(pairs, ids):
        label = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    for seed, words, most, long in ((1, 90, 9, 24), (2, 200, 12, 8), (3, 30, 3, 24)):
        r = random.Random(seed)
        monkeypatch.setattr(resolution, "LONG_NAME", long)
        sets = {f"{i:02d}": (r.choice("xy"), {f"w{r.randrange(words)}" for _ in range(r.randint(1, most))}) for i in range(60)}
        alike = lambda a, b: len(a & b) == min(len(a), len(b)) if min(len(a), len(b)) <= 2 else 2 * len(a & b) >= min(len(a), len(b))
        want = [(i, j) for i, (t, a) in sets.items() for j, (u, b) in sets.items() if i < j and t == u and alike(a, b)]
        got = resolution._token_links(spark.createDataFrame([(i, t, sorted(s, reverse=True)) for i, (t, s) in sets.items()], "id string, type string, parts array<string>")).collect()
        assert groups(got, sets) == groups(want, sets)
        assert {tuple(sorted(x)) for x in got} <= set(want)
