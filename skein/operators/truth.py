"""Catalog checks against a ground truth: expected characters, aliases, pairs that must stay apart, groups, staleness, places.

Every check gives rows (check, subject, status, detail) with status PASS, WARN or FAIL; ground-truth tables are small, the
catalog is not: each check joins by id, name, alias or word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Patterns with wildcards that are broadcast; they are written by hand.
MOST_PATTERNS = 10_000


def _rows(df: DataFrame, check: str, subject: Column, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.alias("subject"), status.alias("status"), detail.alias("detail"))


def _aliases() -> Column:
    return F.coalesce("aliases", F.array().cast("array<string>"))


def found_by_name(names: DataFrame, characters: DataFrame) -> DataFrame:
    """(name, id, how): the character with that name, else the one with such an alias; the least id of several."""
    own = characters.select("id", F.lower("name").alias("key"), F.lit(0).alias("_how"))
    also = characters.select("id", F.explode(F.transform(_aliases(), lambda a: F.lower(a))).alias("key"), F.lit(1).alias("_how"))
    hit = names.select("name", F.lower("name").alias("key")).distinct().join(own.unionByName(also), "key")
    best = hit.groupBy("name").agg(F.min(F.struct("_how", "id")).alias("m"))
    return best.select("name", F.col("m.id").alias("id"), F.when(F.col("m._how") == 0, "name").otherwise("alias").alias("how"))


def _like(pattern: Column) -> Column:
    """A shell pattern (* and ?) as a regular expression."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"([.+(){}|^$\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))


def _wild_matches(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """(p, id): the least id that fits each shell pattern (p).

    What stands before a pattern's first * or class, and where that says nothing behind its last, has a fixed length: ids meet it
    by the characters at the places without ?, once for each form (length and places) that patterns have. Only patterns
    that say nothing at either end are compared with every id.
    """
    head, tail = F.regexp_extract("p", r"^[^*\[]*", 0), F.regexp_extract(F.reverse("p"), r"^[^*\]]*", 0)
    says = lambda c: F.replace(c, F.lit("?"), F.lit("")) != ""
    ends = patterns.withColumn("_re", _like(F.col("p"))).withColumn("_end", F.when(says(head), 0).when(says(tail), 1)).withColumn("_key", F.when(F.col("_end") == 0, head).otherwise(tail))
    own = ends.where("_end is not null").withColumn("_form", F.regexp_replace("_key", r"(?s)[^?]", "x"))
    forms = own.select("_end", "_form").distinct()
    few = lambda df: F.broadcast(df) if df.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS else df
    turned = ids.select("id", F.posexplode(F.array("id", F.reverse("id"))).alias("_end", "_id")).join(few(forms), "_end").where(F.char_length("_id") >= F.char_length("_form"))
    at = F.expr("if(instr(_form, '?') = 0, substring(_id, 1, char_length(_form)), array_join(transform(sequence(1, char_length(_form)), i -> if(substring(_form, i, 1) = '?', '?', substring(_id, i, 1))), ''))")
    met = own.select("p", "_re", "_end", "_form", "_key").join(turned.select("id", "_end", "_form", at.alias("_key")).hint("merge"), ["_end", "_form", "_key"]).where(F.expr("id rlike _re")).select("p", "id")
    rest = ends.where("_end is null").select("p", "_re")
    open_ = ids.select("id").join(few(rest), F.expr("id rlike _re")).select("p", "id")
    return met.unionByName(open_).groupBy("p").agg(F.min("id").alias("id"))


def independent_characters(expected: DataFrame, characters: DataFrame, player_aliases: DataFrame) -> DataFrame:
    """expected: name, id_patterns, optional, least_turn; characters: id, name, aliases, last_updated; player_aliases: alias.

    A character is found by id (the first pattern that fits, then the least id), else by name, else by alias.
    """
    key = ["name", "id_patterns"]
    patterns = expected.select(*key).distinct().select(*key, F.posexplode("id_patterns").alias("_at", "p"))
    is_wild = F.col("p").rlike(r"[*?\[]")
    whole = patterns.where(~is_wild).join(characters.select(F.col("id").alias("p")), "p").select(*key, "_at", F.col("p").alias("id"))
    loose = patterns.where(is_wild).join(_wild_matches(patterns.where(is_wild).select("p").distinct(), characters.select("id")).hint("merge"), "p").select(*key, "_at", "id")
    by_id = whole.unionByName(loose).groupBy(*key).agg(F.min(F.struct("_at", "id")).alias("m")).select(*key, F.col("m.id").alias("_id"))
    met = expected.join(by_id, key, "left").join(found_by_name(expected, characters).withColumnRenamed("id", "_named"), "name", "left")
    met = met.withColumn("id", F.coalesce("_id", "_named")).withColumn("_note", F.when(F.col("_id").isNull() & F.col("_named").isNotNull(), F.concat(F.lit(" (matched by "), "how", F.lit(")"))).otherwise(""))
    merged = player_aliases.select(F.lower("alias").alias("_low")).distinct().withColumn("_merged", F.lit(True))
    met = met.join(characters.select("id", "last_updated"), "id", "left").withColumn("_low", F.lower("name")).join(merged, "_low", "left")
    gap = F.col("least_turn") - F.col("last_updated")
    status = (
        F.when(F.col("id").isNull(), F.when(F.coalesce("_merged", F.lit(False)) | ~F.coalesce("optional", F.lit(False)), "FAIL").otherwise("WARN"))
        .when(F.col("least_turn").isNotNull() & F.col("last_updated").isNull(), "FAIL")
        .when(gap > 50, "FAIL")
        .when(gap > 0, "WARN")
        .otherwise("PASS")
    )
    detail = (
        F.when(F.col("id").isNull(), F.when(F.coalesce("_merged", F.lit(False)), "merged as an alias of the player").otherwise("not found"))
        .when(F.col("least_turn").isNotNull() & F.col("last_updated").isNull(), F.concat("id", F.lit(": no last turn"), "_note"))
        .when(gap > 0, F.concat("id", F.lit(": stale by "), gap, "_note"))
        .otherwise(F.concat("id", "_note"))
    )
    return _rows(met, "independent", F.col("name"), status, detail)


def player_aliases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected, actual: alias. Missing ones and those that should not be there fail."""
    e = expected.select(F.lower("alias").alias("alias")).distinct().withColumn("_e", F.lit(True))
    a = actual.select(F.lower("alias").alias("alias")).distinct().withColumn("_a", F.lit(True))
    both = e.join(a, "alias", "full")
    status = F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), "PASS").otherwise("FAIL")
    return _rows(both, "player_alias", F.col("alias"), status, F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "false positive").otherwise("present"))


def must_not_merge(pairs: DataFrame, expected: DataFrame, characters: DataFrame, player: DataFrame) -> DataFrame:
    """pairs: a, b (names or ids); expected: name, id_patterns; player: alias. Merged are pairs that share an id, of which one's
    name is the other's alias, or, against char-player, whose name is the player's alias."""
    sides = pairs.select("a", "b", F.col("a").alias("name"), F.col("b").alias("other")).unionByName(pairs.select("a", "b", F.col("b").alias("name"), F.col("a").alias("other")))
    own = characters.select("id", F.lower("name").alias("key")).unionByName(characters.select("id", F.explode(F.transform(_aliases(), lambda x: F.lower(x))).alias("key")))
    truth = expected.select(F.lower("name").alias("key"), F.explode("id_patterns").alias("id"))
    listed = expected.select(F.lower("name").alias("key")).distinct()
    by_id = sides.where("name like 'char-%'").withColumn("id", F.col("name"))
    rest = sides.where("not name like 'char-%'").withColumn("key", F.lower("name"))
    ids = by_id.unionByName(rest.join(truth, "key").drop("key")).unionByName(rest.join(listed, "key", "left_anti").join(own, "key").drop("key")).distinct()
    said = ids.join(characters.select("id", F.explode(F.transform(_aliases(), lambda x: F.lower(x))).alias("_alias")), "id").where(F.col("_alias") == F.lower("other")).select("a", "b")
    x, y = ids.where("name = a").select("a", "b", "id"), ids.where("name = b").select("a", "b", "id")
    shared = x.join(y, ["a", "b", "id"]).select("a", "b")
    low = player.select(F.lower("alias").alias("_low"))
    taken = sides.where("other = 'char-player'").withColumn("_low", F.lower("name")).join(low, "_low").select("a", "b")
    normal = lambda df: df.join(pairs.where("a = 'char-player' or b = 'char-player'").select("a", "b"), ["a", "b"], "left_anti")
    merged = normal(said).unionByName(normal(shared)).unionByName(taken).distinct().withColumn("_m", F.lit(True))
    out = pairs.join(merged, ["a", "b"], "left")
    return _rows(out, "must_not_merge", F.concat_ws(" <-> ", "a", "b"), F.when(F.col("_m"), "FAIL").otherwise("PASS"), F.when(F.col("_m"), "merged").otherwise("separate"))


def coreference_groups(groups: DataFrame, characters: DataFrame) -> DataFrame:
    """groups: canonical_name, expected_id, variants. WARN where a variant still has an entity of its own."""
    met = groups.join(characters.select(F.col("id").alias("expected_id"), F.lit(True).alias("_has")), "expected_id", "left")
    met = met.join(found_by_name(groups.select(F.col("canonical_name").alias("name")), characters).select(F.col("name").alias("canonical_name"), F.col("id").alias("_named")), "canonical_name", "left")
    actual = F.when(F.col("_has"), F.col("expected_id")).otherwise(F.col("_named"))
    met = met.withColumn("_actual", actual).select("canonical_name", "expected_id", "_actual", F.posexplode_outer("variants").alias("_at", "v"))
    met = met.withColumn("id", F.concat(F.lit("char-"), F.replace(F.lower("v"), F.lit(" "), F.lit("-")))).join(characters.select("id", F.lit(True).alias("_own")), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("_own"), F.struct("_at", "id"))))
    out = met.groupBy("canonical_name", "expected_id", "_actual").agg(F.transform(parts, lambda x: x["id"]).alias("_parts"))
    status = F.when(F.col("_actual").isNull(), "FAIL").when(F.size("_parts") > 0, "WARN").otherwise("PASS")
    detail = F.when(F.col("_actual").isNull(), F.concat("expected_id", F.lit(" not found"))).otherwise(F.array_join(F.concat(F.array("_actual"), "_parts"), ", "))
    return _rows(out, "coreference", F.col("canonical_name"), status, detail)


def staleness(targets: DataFrame, characters: DataFrame) -> DataFrame:
    """targets: id, least_turn. Over 50 turns behind fails, over 20 warns; an id that is missing is looked up by its words as a name."""
    met = targets.withColumn("name", F.initcap(F.replace(F.replace("id", F.lit("char-"), F.lit("")), F.lit("-"), F.lit(" "))))
    met = met.join(characters.select("id", F.col("last_updated").alias("_t"), F.lit(True).alias("_has")), "id", "left")
    named = found_by_name(met, characters).join(characters.select("id", F.col("last_updated").alias("_nt")), "id").select("name", F.col("id").alias("_named"), "_nt")
    met = met.join(named, "name", "left")
    turn = F.when(F.col("_has"), F.col("_t")).otherwise(F.col("_nt"))
    gap = F.col("least_turn") - turn
    missing = F.col("_has").isNull() & F.col("_named").isNull()
    status = F.when(missing | turn.isNull() | (gap > 50), "FAIL").when(gap > 20, "WARN").otherwise("PASS")
    return _rows(met, "staleness", F.col("id"), status, F.when(missing, "not found").when(turn.isNull(), "no last turn").otherwise(F.concat(F.lit("turn-"), turn)))


def expected_places(names: DataFrame, ids: DataFrame, prefix: str) -> DataFrame:
    """names: name; ids: id. A location or faction counts as found if a word of its name is a word of some id."""
    words = ids.select(F.explode(F.split(F.replace("id", F.lit(f"{prefix}-"), F.lit("")), "-")).alias("w")).distinct()
    each = names.select("name", F.explode_outer(F.filter(F.split(F.replace(F.lower("name"), F.lit("/"), F.lit(" ")), r"\s+"), lambda x: x != "")).alias("w"))
    out = each.join(words.withColumn("_has", F.lit(True)), "w", "left").groupBy("name").agg(F.coalesce(F.max("_has"), F.lit(False)).alias("_has"))
    return _rows(out, prefix, F.col("name"), F.when(F.col("_has"), "PASS").otherwise("FAIL"), F.when(F.col("_has"), "found").otherwise("not found"))


def report(checks: list[DataFrame]) -> DataFrame:
    """(check, passed, warned, failed) of all checks."""
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return every.groupBy("check").agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"))


def todo_paths(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of the strings in JSON documents that hold the word TODO; a document that is no JSON gives none."""
    import json as _json
    import re

    import pandas as pd

    word = re.compile(r"\bTODO\b", re.IGNORECASE)

    def leaves(text: str) -> list[tuple[str, str]]:
        try:
            todo, out = [("", _json.loads(text))], []
        except (TypeError, ValueError):
            return []
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
            elif isinstance(x, str) and word.search(x):
                out.append((path, x))
        return out

    def run(frames):
        for pdf in frames:
            found = [(k, p, v) for k, t in zip(pdf[key], pdf[json]) for p, v in leaves(t)]
            yield pd.DataFrame(found, columns=[key, "path", "value"])

    return rows.select(F.col(key).cast("string").alias(key), json).mapInPandas(run, f"{key} string, path string, value string")


def completeness(sessions: DataFrame) -> DataFrame:
    """(session_id, warning) of derived state: session_id, dm_turns, evidence, objectives (counts, null: no file), state (struct of
    location, condition, inventory_notes, relationships_summary: strings; known_constraints, active_threads: arrays; null: no file)."""
    scaffold = ("Unknown", "Not established", "No NPCs contacted yet")  # fixed values
    has = F.col("dm_turns") > 0
    tests = [F.when(has & (F.col(c) == 0), f"{c} is empty") for c in ("evidence", "objectives")]
    tests += [F.when(has & F.col(f"state.{c}").isin(*scaffold), f"state.{c} is a scaffold default") for c in ("location", "condition", "inventory_notes", "relationships_summary")]
    tests += [F.when(has & F.col("state").isNotNull() & (F.size(F.coalesce(F.col(f"state.{c}"), F.array().cast("array<string>"))) == 0), f"state.{c} is empty") for c in ("known_constraints", "active_threads")]
    return sessions.select("session_id", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("warning"))
