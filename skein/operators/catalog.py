"""The catalog as a whole: look-ups by id and name, checks of references, upserts with their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import PREFIX_OF, fixed_prefix, type_of_prefix
from skein.operators.rules import without_article

_TRIVIAL = ("a", "an", "the", "of", "and", "with")


def _low(name: str | Column) -> Column:
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def by_id(entities: DataFrame, wanted: DataFrame, order: str = "ord") -> DataFrame:
    """The first entity of each wanted id, by one join."""
    first = entities.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*(c for c in entities.columns if c != "id")), order).alias("e"))
    return first.select("id", "e.*")


def name_index(entities: DataFrame, order: str = "ord") -> DataFrame:
    """(key, id, type): each lower-cased name and alias, with and without article, and the first entity that has it.

    entities: id, type, name, aliases (array, may be null) and an order; an entity's name comes before its aliases.
    """
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = entities.select("id", "type", F.col(order).alias("_ord"), F.posexplode(names).alias("_at", "_name")).where("_name is not null")
    keys = each.select("id", "type", "_ord", "_at", F.posexplode(F.array(_low("_name"), F.trim(without_article(_low("_name"))))).alias("_form", "key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min_by(F.struct("id", "type"), F.struct("_ord", "_at", "_form")).alias("e")).select("key", "e.id", "e.type")


def type_conflicts(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates (cid, name, type) whose name, or name without article, is an entity's of another type: cid, id, known_type."""
    forms = candidates.select("cid", F.coalesce("type", F.lit("")).alias("_type"), F.posexplode(F.array(_low("name"), F.trim(without_article(_low("name"))))).alias("_form", "key")).where("key <> ''")
    hit = forms.join(index.select("key", "id", F.col("type").alias("known_type")), "key").where("_type <> known_type")
    return hit.groupBy("cid").agg(F.min_by(F.struct("id", "known_type"), "_form").alias("h")).select("cid", "h.id", "h.known_type")


def expanded(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates (cid, existing_id, name, type): those with an id only take the entity's name and type, or go if there is none."""
    known = entities.select(F.col("id").alias("existing_id"), F.col("name").alias("_name"), F.col("type").alias("_kind"), F.lit(True).alias("_has"))
    bare = F.coalesce((F.col("existing_id") != "") & (F.coalesce("name", F.lit("")) == ""), F.lit(False))
    met = candidates.join(known, "existing_id", "left").where(~bare | F.col("_has"))
    kind = F.coalesce("type", "_kind", type_of_prefix(F.col("existing_id")))
    return met.select("cid", "existing_id", F.when(bare, F.coalesce("_name", "existing_id")).otherwise(F.col("name")).alias("name"), F.when(bare, kind).otherwise(F.col("type")).alias("type"), bare.alias("expanded"))


def checked_ids(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records (cid, existing_id, proposed_id, is_new) with a verdict: kept, new (a wrong id is cleared) or dropped."""
    ids = entities.select("id").distinct()
    met = records.join(ids.select(F.col("id").alias("existing_id"), F.lit(True).alias("_has")), "existing_id", "left").join(ids.select(F.col("id").alias("proposed_id"), F.lit(True).alias("_taken")), "proposed_id", "left")
    prefixed = F.col("proposed_id").rlike("^(?:" + "|".join(PREFIX_OF.values()) + ")-")
    wrong = F.coalesce(F.col("existing_id") != "", F.lit(False)) & F.col("_has").isNull()
    fresh = F.coalesce("is_new", F.lit(False)) & F.coalesce(prefixed, F.lit(False)) & F.col("_taken").isNull()
    verdict = F.when(~wrong, "kept").when(fresh, "new").otherwise("dropped")
    return met.select("cid", F.when(wrong & fresh, None).otherwise(F.col("existing_id")).alias("existing_id"), "proposed_id", verdict.alias("verdict"))


def birth_entities(events: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with the child's id among their refs, children that are no entity yet) of birth events that name a child.

    events: id, type, turn_no, refs, description. A child is created once, by its first event.
    """
    name = F.regexp_extract("description", r"\bnamed\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1)
    child = F.concat(F.lit("char-"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"))
    own = events.withColumn("_child", F.when((F.col("type") == "birth") & (name != ""), F.struct(child.alias("id"), name.alias("name"))))
    after = own.withColumn("refs", F.when(F.col("_child").isNotNull(), F.array_union(F.coalesce("refs", F.array().cast("array<string>")), F.array("_child.id"))).otherwise(F.col("refs"))).drop("_child")
    born = own.where("_child is not null").groupBy("_child.id").agg(F.min_by("_child.name", F.struct("turn_no", "id")).alias("name"), F.min("turn_no").alias("first_seen"))
    fresh = born.join(entities.select("id").distinct(), "id", "left_anti").select("id", "name", F.lit("character").alias("type"), F.concat(F.lit("Child born during the narrative, named "), F.col("name"), F.lit(".")).alias("identity"), "first_seen")
    return after, fresh


def located(entities: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, location): a location's id in lower case, or the one location that a free text names (by name or alias), else as it is.

    locations: id, name, aliases.
    """
    names = locations.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n")).select(F.col("id").alias("_loc"), _low("_n").alias("_key")).where("_key <> ''").distinct()
    one = names.groupBy("_key").agg(F.min("_loc").alias("_loc"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    trimmed = F.trim("location")
    out = entities.select("id", "location", F.lower(trimmed).alias("_key")).join(one, "_key", "left")
    return out.select("id", F.when(F.lower(trimmed).startswith("loc-"), F.lower(trimmed)).otherwise(F.coalesce("_loc", "location")).alias("location"))


def player_entity(entities: DataFrame) -> DataFrame:
    """The player's entity: id char-player, else the first id that begins so, else the first whose name holds the word."""
    rank = F.when(F.col("id") == "char-player", 0).when(F.col("id").startswith("char-player"), 1).when(F.lower("name").contains("player"), 2)
    return entities.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", F.when(F.col("_rank") == 1, F.col("id")), "ord").limit(1).drop("_rank")


def _edit_keys(stem: str, most: int = 2) -> Column:
    """Hashes of which two stems with one first letter within ``most`` (1 or 2) edits share one: of the letter and the rest with up to ``most`` characters left out."""
    rest = f"substring({stem}, 2)"
    left_out = f"concat(substring({rest}, 1, i - 1), substring({rest}, i + 1, j - i - 1), substring({rest}, j + 1))"
    last = f"char_length({stem})"  # one place behind the rest: nothing is left out
    return F.expr(f"array_distinct(flatten(transform(sequence(1, {last}), i -> transform(sequence({'i' if most > 1 else last}, {last}), j -> xxhash64(substring({stem}, 1, 1), {left_out})))))")


def _near_stems(stems: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (_stem, _kstem, _d) of different stems within 2 edits and with the same first letter. stems: _stem; known: _kstem."""
    sized = lambda df, c: df.select(c).distinct().withColumn("_c", F.substring(c, 1, 1)).withColumn("_n", F.char_length(c))
    around = lambda df: df.select("_c", F.explode(F.sequence(F.col("_n") - 2, F.col("_n") + 2)).alias("_n")).distinct()
    own, ids = sized(stems, "_stem"), sized(known, "_kstem")
    # only stems of which the other table has one of the letter and about the length are taken apart
    left = own.join(around(ids), ["_c", "_n"], "left_semi").select("_stem", F.explode(_edit_keys("_stem")).alias("_p"))
    right = ids.join(around(own), ["_c", "_n"], "left_semi").select("_kstem", F.explode(_edit_keys("_kstem")).alias("_p"))
    return left.join(right.hint("merge"), "_p").withColumn("_d", F.levenshtein("_stem", "_kstem", 2)).where(F.col("_d").between(0, 2)).select("_stem", "_kstem", "_d").distinct()


def _contained(small: DataFrame, large: DataFrame, strict: bool) -> DataFrame:
    """Pairs of rows (_x, _ws: distinct words) and (_y, _vs) of which the first's words are all in the second's, which are more if ``strict``.

    They meet by the word of the first that fewest of the second have; one that has a word of none is left out before.
    """
    each = large.select("_y", "_vs", F.explode("_vs").alias("_w"))
    df = each.groupBy("_w").agg(F.count("*").alias("_df"))
    known = small.select("_x", "_ws", F.explode("_ws").alias("_w")).join(df.hint("merge"), "_w").groupBy("_x", "_ws").agg(F.count("*").alias("_k"), F.min_by("_w", F.struct("_df", "_w")).alias("_w"))
    met = known.where(F.col("_k") == F.size("_ws")).join(each.hint("merge"), "_w")
    more = F.size("_vs") > F.size("_ws") if strict else F.lit(True)
    return met.where(more & (F.size(F.array_intersect("_ws", "_vs")) == F.size("_ws"))).select("_x", "_y")


def normalized_ids(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, id): each raw id in lower case with a valid prefix, as the known id that it is, or is written nearly like.

    A known id matches whole, else by its stem: all words of the shorter stem are in the longer (the shortest such id, then
    the least, wins), else at most 2 edits away with the same first letter (the nearest, then the least). Else the id is new.
    Candidates meet by the rarest word of the shorter stem, or by hashes of the stem with up to two characters left out, so no pair
    of all ids is formed. Joins of exploded rows are merged by hint: Spark takes them for as few as the rows before, and would broadcast them.
    """
    from skein.sources.scratch import written

    kind = type_of_prefix(F.lower("raw"))
    own = raw.select("raw").where("raw <> ''").distinct().select("raw", fixed_prefix(F.lower("raw"), kind).alias("_id")).withColumn("_stem", F.regexp_replace("_id", r"^[a-z]+-", ""))
    ids = known.select(F.col("id").alias("_known"), F.regexp_replace(F.lower("id"), r"^[a-z]+-", "").alias("_kstem")).where("_kstem <> ''").distinct()
    least = ids.groupBy(F.lower("_known").alias("_id")).agg(F.min_by("_known", F.struct(F.col("_known") != F.lower("_known"), F.col("_known"))).alias("_exact"))
    exact = written(own.join(least.hint("merge"), "_id", "left"), "exact-ids")
    stems = exact.where("_exact is null and _stem <> ''").select("_stem").distinct()
    # of equal stems the shortest id, then the least, and the least id: the ones that can win
    best = ids.groupBy("_kstem").agg(F.min_by("_known", F.struct(F.char_length("_known"), "_known")).alias("_short"), F.min("_known").alias("_least"))
    tokens = lambda c: F.array_distinct(F.split(c, "-"))
    ours, theirs = stems.select(F.col("_stem").alias("_s"), tokens(F.col("_stem")).alias("_t")), best.select(F.col("_kstem").alias("_s"), tokens(F.col("_kstem")).alias("_t"))
    within = _contained(ours.toDF("_x", "_ws"), theirs.toDF("_y", "_vs"), False).toDF("_stem", "_kstem")
    around = _contained(theirs.toDF("_x", "_ws"), ours.toDF("_y", "_vs"), True).toDF("_kstem", "_stem")
    met = within.unionByName(around).join(best.hint("merge"), "_kstem")
    words = written(met.groupBy("_stem").agg(F.min_by("_short", F.struct(F.char_length("_short"), "_short")).alias("_by_word")), "by-word")
    near = _near_stems(stems.join(words.hint("merge"), "_stem", "left_anti"), best).join(best.hint("merge"), "_kstem").groupBy("_stem").agg(F.min_by("_least", F.struct("_d", "_least")).alias("_by_edit"))
    out = exact.join(words.hint("merge"), "_stem", "left").join(near.hint("merge"), "_stem", "left")
    return out.select("raw", F.when(F.col("_exact").isNotNull(), F.col("_exact")).otherwise(F.coalesce("_by_word", "_by_edit", "_id")).alias("id"))


def canonical_ids(incoming: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, id, canonical) of incoming (key, id, name): itself if known, what an alias table (id, survivor) says, or the known
    entity (id, name, type; its least id) of the same name and type; without an id, the only one of that name; else null."""
    own = incoming.join(known.select("id", F.col("id").alias("_same")), "id", "left").join(aliases.select("id", "survivor").dropDuplicates(["id"]), "id", "left")
    names = known.select(_low("name").alias("_name"), F.coalesce("type", type_of_prefix(F.col("id"))).alias("_type"), F.col("id").alias("_kid")).where("_name <> ''")
    typed = names.groupBy("_name", "_type").agg(F.min("_kid").alias("_typed"))
    only = names.groupBy("_name").agg(F.min("_kid").alias("_only"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    met = own.withColumn("_name", F.coalesce(_low("name"), F.lit(""))).withColumn("_type", F.when(F.col("id") != "", type_of_prefix(F.col("id")))).join(typed, ["_name", "_type"], "left").join(only, "_name", "left")
    by_name = F.when(F.col("_type").isNotNull(), F.col("_typed")).otherwise(F.col("_only"))
    return met.select("key", "id", F.coalesce("_same", "survivor", by_name).alias("canonical"))


def known_list(entities: DataFrame) -> DataFrame:
    """(id, line) of entities (id, name, type, identity, aliases): one line each, as prompts list them."""
    text = lambda c: F.coalesce(c, F.lit(""))
    says = F.when(text(F.col("identity")) != "", F.concat(F.lit(" — "), "identity")).otherwise("")
    also = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (aliases: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    return entities.select("id", F.concat(F.concat_ws(" | ", "id", "name", "type"), says, also).alias("line"))


def _words(name: str) -> Column:
    return F.array_except(F.filter(F.split(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), r"\s+"), lambda x: x != ""), F.array(*map(F.lit, _TRIVIAL)))


def upserted(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The catalog after one update of each entity at most, with the guards of a merge.

    Both: id, type, name, identity, current_status, first_seen, last_updated (turn numbers), aliases. A prefix that is not the
    type's drops the update. A new entity needs name, type, identity and a turn (last_updated serves for first_seen). For a known one
    the update's non-empty values win; a name without a word in common is refused with all but the turn; another name
    makes the old one an alias; aliases that are other entities' names go; char-player keeps name and identity.
    """
    none = F.array().cast("array<string>")
    prefix = F.col("id").rlike("^[a-z]+-") & F.coalesce(type_of_prefix(F.col("id"), None) == F.col("type"), F.lit(False))
    new = updates.where(prefix).withColumn("first_seen", F.coalesce("first_seen", "last_updated"))
    columns = [c for c in current.columns if c != "id"]
    both = current.select("id", F.struct(*columns).alias("c")).join(new.select("id", F.struct(*columns).alias("u")), "id", "full")
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    both = both.where(F.col("c").isNotNull() | (filled("u.name") & filled("u.identity") & F.col("u.first_seen").isNotNull()))
    a, b = _words("c.name"), _words("u.name")
    player, known, said = F.col("id") == "char-player", F.col("c").isNotNull(), F.col("u").isNotNull()
    renamed = known & filled("u.name") & (F.lower("u.name") != F.lower("c.name"))
    refused = F.coalesce(renamed & ~player & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))
    both = both.withColumns({"_refused": refused, "_known": known, "_takes": said & ~(known & refused)})
    takes, spelled = F.col("_takes"), F.col("_known") & filled("u.name") & (F.col("u.name") != F.col("c.name"))
    value = lambda c, keep: F.when(takes & filled(f"u.{c}") & ~keep, F.col(f"u.{c}")).otherwise(F.col(f"c.{c}"))
    turn = F.when(F.col("c.last_updated").isNull() | (F.col("u.last_updated") >= F.col("c.last_updated")), F.coalesce("u.last_updated", "c.last_updated")).otherwise(F.col("c.last_updated"))
    listed = F.when(takes & F.col("u.aliases").isNotNull(), F.col("u.aliases")).otherwise(F.coalesce("c.aliases", none))
    extra = F.when(takes & spelled, F.when(player, F.array("u.name")).otherwise(F.array("c.name"))).otherwise(none)
    out = both.select(
        "id",
        F.coalesce("c.type", "u.type").alias("type"),
        value("name", player & F.col("_known")).alias("name"),
        value("identity", player & F.col("_known")).alias("identity"),
        value("current_status", F.lit(False)).alias("current_status"),
        F.coalesce("c.first_seen", "u.first_seen").alias("first_seen"),
        turn.alias("last_updated"),
        listed.alias("_listed"),
        extra.alias("_extra"),
        (takes & (F.size(listed) > 0)).alias("_check"),
    )
    # listed aliases of touched entities must not be another entity's name
    names = current.select(_low("name").alias("_key")).where("_key <> ''").distinct().withColumn("_other", F.lit(True))
    each = out.where("_check").select("id", _low("name").alias("_own"), F.posexplode("_listed").alias("_at", "_alias")).withColumn("_key", _low("_alias")).join(names, "_key", "left")
    good = each.where("_key <> '' and (_other is null or _key = _own)").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_alias"))), lambda x: x["_alias"]).alias("_good"))
    listed = F.when(F.col("_check"), F.coalesce("_good", none)).otherwise(F.col("_listed"))
    return out.join(good, "id", "left").select(*(c for c in ["id", *columns] if c != "aliases"), F.array_union(listed, "_extra").alias("aliases"))


def first_events(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each id."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_k = 1").drop("_k")
