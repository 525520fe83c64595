"""Entity resolution: names, fuzzy pairs by blocks, components, merges and id rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.turns import normal_name


def fuzzy_pairs(names: DataFrame, most: int = 2, raw: bool = False) -> DataFrame:
    """Pairs of ids (a < b) of one type whose names are within ``most`` edits.

    Blocks by deletion neighbourhoods would be wider than needed here: names within k edits
    share one of k + 1 pieces at a shifted place, so pieces meet by equality and only those pairs are measured.
    Joins of exploded rows are merged by hint, here and below: Spark takes them for as few as the rows before, and would broadcast them.
    raw: names are compared as they are, not normalised.
    """
    n = names.select("id", "type", (F.col("name") if raw else normal_name(F.col("name"))).alias("name")).where("name <> ''")
    own = n.select("type", "name").distinct().withColumn("n", F.char_length("name"))
    whole = own.where(F.floor(F.col("n") / (most + 1)) > 0)
    # left: its own pieces; right: every substring of a piece's size near the piece's place, for the lengths that names have
    at = lambda m: f"int(k * floor({m} / {most + 1}) + 1)"
    size = lambda m: f"if(k = {most}, {m}, int(floor({m} / {most + 1})))"
    cut = F.expr(f"transform(sequence(0, {most}), k -> xxhash64(n, k, substring(name, {at('n')}, {size('n')})))")
    left = whole.select("type", "name", F.explode(cut).alias("_h"))
    right = own.select("type", F.col("name").alias("name_b"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - most), F.col("n") + most)).alias("m")).join(whole.select("type", F.col("n").alias("m")).distinct(), ["type", "m"], "left_semi")
    near_by = F.expr(f"array_distinct(flatten(transform(sequence(0, {most}), k -> transform(sequence(-{most}, {most}), d -> xxhash64(m, k, substring(name_b, greatest(1, {at('m')} + d), {size('m')}))))))")
    met = left.join(right.select("type", "name_b", F.explode(near_by).alias("_h")).hint("merge"), ["type", "_h"]).select("type", "name", "name_b")
    few = own.where(F.floor(F.col("n") / (most + 1)) == 0).select("type", "name").join(own.where(F.col("n") <= 2 * most).select("type", F.col("name").alias("name_b")), "type")
    close = met.unionByName(few).where("name <> name_b").withColumn("distance", F.levenshtein("name", "name_b", most)).where(F.col("distance").between(0, most)).distinct()
    ids = n.select(F.col("id").alias("id_b"), "type", F.col("name").alias("name_b")).hint("merge")
    unlike = close.join(n.hint("merge"), ["type", "name"]).join(ids, ["type", "name_b"]).select("id", "id_b", "distance")
    # names that several ids have
    copies = n.join(n.groupBy("type", "name").agg(F.count("*").alias("_n")).where("_n > 1").hint("merge"), ["type", "name"], "left_semi")
    alike = copies.join(copies.select(F.col("id").alias("id_b"), "type", "name").hint("merge"), ["type", "name"]).where("id < id_b").select("id", "id_b", F.lit(0).alias("distance"))
    return unlike.unionByName(alike).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), F.col("distance").cast("bigint").alias("distance")).where("a <> b").distinct()


# Words of names that say nothing of who it is.
FILLERS = "a an the of and with in on to figure material party bowl tool small large old new dark light some other".split()


def _by_shared(parts: DataFrame, need: str, good: str, smaller: str = "true", larger: str = "true") -> DataFrame:
    """Pairs (a, b) of rows (id, type, parts) with enough parts in common, counted on the smaller set of the two.

    need: SQL for the parts that a smaller set of size n must share; good: SQL over n (its size), k (shared). smaller, larger: SQL
    over n, the sizes of which the two may be.
    Only the rarest n - need + 1 parts of a set are looked up, in all parts of the sets at least as large: a
    pair that shares enough has one of them in common. So frequent words make no pairs unless a set has nothing rarer.
    """
    sized = parts.where(F.size("parts") > 0).withColumn("n", F.size("parts"))
    each = sized.select("id", "type", "n", "parts", F.explode("parts").alias("part"))
    df = each.groupBy("type", "part").agg(F.count("*").alias("df"))
    w = Window.partitionBy("type", "id").orderBy("df", "part")
    rare = each.where(smaller).join(df.hint("merge"), ["type", "part"]).withColumn("_k", F.row_number().over(w)).where(F.expr(f"_k <= n - ({need}) + 1"))
    met = rare.select("type", "part", F.col("id").alias("a"), "n", F.col("parts").alias("pa")).join(each.where(larger).select("type", "part", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb")).hint("merge"), ["type", "part"])
    met = met.where("n < nb or (n = nb and a <> b)").withColumn("k", F.size(F.array_intersect("pa", "pb"))).where(good)
    return met.select("a", "b").distinct()


#: Tokens of the longest name that is found by each three of its tokens.
LONG_NAME = 24


def _token_links(parts: DataFrame) -> DataFrame:
    """Links (a, b) of rows (id, type, parts), few, with the components of the pairs that share all of a set of two or one, or half of a larger one's.

    All sets that have one, two or three parts in common are linked with the smallest of them, where that many are enough for its
    size: one, up to four, five and six parts. Sets of seven parts on as the smaller ones, and very large ones of those of five and six, meet as pairs.
    """
    sized = parts.where(F.size("parts") > 0).select("id", "type", F.array_sort("parts").alias("parts"), F.size("parts").alias("n"))
    single = sized.where("n = 1").groupBy("type", F.col("parts")[0].alias("_key")).agg(F.min("id").alias("a"))
    ones = sized.select("type", "id", F.explode("parts").alias("_key")).join(single.hint("merge"), ["type", "_key"]).select("a", F.col("id").alias("b"))
    two = F.expr("flatten(transform(sequence(1, n - 1), i -> transform(sequence(i + 1, n), j -> concat_ws(' ', parts[i - 1], parts[j - 1]))))")
    three = F.expr("flatten(flatten(transform(sequence(1, n - 2), i -> transform(sequence(i + 1, n - 1), j -> transform(sequence(j + 1, n), k -> concat_ws(' ', parts[i - 1], parts[j - 1], parts[k - 1]))))))")
    out = ones
    for have, keys, enough in (("n >= 2", two, 4), (f"n between 5 and {LONG_NAME}", three, 6)):
        each = sized.where(have).select("type", "id", "n", F.explode(keys).alias("_key"))
        least = each.groupBy("type", "_key").agg(F.min(F.struct("n", "id")).alias("m"), F.count("*").alias("_all")).where((F.col("_all") > 1) & (F.col("m.n") <= enough)).select("type", "_key", F.col("m.id").alias("a"))
        out = out.unionByName(each.select("type", "id", "_key").join(least.hint("merge"), ["type", "_key"]).select("a", F.col("id").alias("b")))
    for smaller, larger in (("n >= 7", "true"), ("n between 5 and 6", f"n > {LONG_NAME}")):
        out = out.unionByName(_by_shared(parts, "(n + 1) div 2", "2 * k >= n", smaller, larger))
    return out.where("a <> b").distinct()


def same_entities(entities: DataFrame, links: bool = False) -> DataFrame:
    """Pairs (a, b) of ids of one type that mean one entity, by any of six rules. entities: id, type, name, aliases (array).

    A name or alias in common; two tokens at least of the smaller name, all in the other; all tokens of a smaller name of
    two or one, half of a longer one's, in common (tokens without FILLERS); a name of four letters and more that begins
    a token of the other; two parts at least of the smaller id, all in the other; ids' stems of six letters and more within
    two edits, with the same first letter. Each rule meets its pairs by equality, none by a product. links: not all pairs that share
    tokens, which grow by the square, but enough for the same components.
    """
    own = entities.select("id", "type", F.lower(F.trim("name")).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    keys = own.select("id", "type", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda x: F.lower(F.trim(x))))).alias("key")).where("key <> ''")
    first = keys.groupBy("type", "key").agg(F.min("id").alias("a"))
    named = keys.join(first.hint("merge"), ["type", "key"]).where("a <> id").select("a", F.col("id").alias("b"))

    # equal names are linked above: one id stands for each name
    one = own.where("name <> ''").groupBy("type", "name").agg(F.min("id").alias("id"))
    tokens = F.array_except(F.filter(F.split(F.replace("name", F.lit("-"), F.lit(" ")), r"\s+"), lambda x: x != ""), F.array(*map(F.lit, FILLERS)))
    words = one.select("id", "type", tokens.alias("parts"))
    by_token = _token_links(words) if links else _by_shared(words, "if(n <= 2, n, (n + 1) div 2)", "k = n and n <= 2 or n > 2 and 2 * k >= n")
    # only a name without a space or hyphen begins a token, and only of a token with its first four letters
    starts = one.where(F.col("name").rlike(r"^[^\s-]{4,}$"))
    begins = one.select("type", F.col("id").alias("b"), F.explode(F.array_distinct(F.filter(F.split(F.replace("name", F.lit("-"), F.lit(" ")), r"\s+"), lambda t: F.char_length(t) > 4))).alias("t"))
    begins = begins.withColumn("_4", F.substring("t", 1, 4)).join(starts.select("type", F.substring("name", 1, 4).alias("_4")).distinct().hint("merge"), ["type", "_4"], "left_semi")
    begins = begins.select("type", "b", F.explode(F.transform(F.sequence(F.lit(4), F.char_length("t") - 1), lambda k: F.substring("t", F.lit(1), k))).alias("name")).distinct()
    by_start = starts.select("type", "name", F.col("id").alias("a")).join(begins.hint("merge"), ["type", "name"]).where("a <> b").select("a", "b")

    stem = F.regexp_replace("id", "^[^-]*-", "")
    stems = own.select("id", "type", stem.alias("name")).where("name <> ''")
    by_part = _by_shared(stems.select("id", "type", F.array_distinct(F.split("name", "-")).alias("parts")).where(F.size("parts") >= 2), "n", "k = n")
    near = fuzzy_pairs(stems.where(F.char_length("name") >= 6), 2, raw=True)
    first_letter = F.substring(F.regexp_replace(F.col("a"), "^[^-]*-", ""), 1, 1) == F.substring(F.regexp_replace(F.col("b"), "^[^-]*-", ""), 1, 1)
    both = named.unionByName(by_token).unionByName(by_start).unionByName(by_part).unionByName(near.where(first_letter).select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged_catalog(entities: DataFrame) -> DataFrame:
    """(id, survivor) of every entity (id, type, name, aliases, first_seen) that is merged: the survivor is the one seen first, the least id of equals."""
    groups = components(same_entities(entities, links=True)).join(entities.select("id", "first_seen").hint("merge"), "id")
    best = groups.groupBy("survivor").agg(F.min_by("id", F.struct(F.coalesce("first_seen", F.lit(-1)), "id")).alias("keep"))
    return groups.join(best.hint("merge"), "survivor").where("id <> keep").select("id", F.col("keep").alias("survivor"))


def audit_pairs(entities: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (a, b, reason) of ids of one prefix to be looked at: names within 3 edits, one name within the other, or, of entities seen
    first in the same turn, similar names. Pairs of entities with three targets and more each that share under half are no candidates.

    entities: id, name, first_seen; targets: id, target_id. Similar names of one turn are compared in groups of one turn and prefix.
    """
    own = entities.select("id", F.regexp_extract("id", "^([a-z]+)-", 1).alias("type"), F.regexp_replace(F.lower(F.trim("name")), r"^(the|a|an)\s+", "").alias("name"), "first_seen").where("type <> '' and name <> ''")
    near = fuzzy_pairs(own.select("id", "type", "name"), 3, raw=True).where("distance > 0").select("a", "b", F.lit(0).alias("rank"), F.concat(F.lit("edit_distance="), "distance").alias("reason"))
    # a name within another: every substring of the longer one as long as some name is, by equality
    sizes = own.where(F.char_length("name") >= 3).groupBy("type").agg(F.array_sort(F.collect_set(F.char_length("name"))).alias("sizes"))
    subs = own.join(sizes, "type").select("type", F.col("id").alias("b"), F.explode(F.array_distinct(F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.char_length("name")), lambda n: F.transform(F.sequence(F.lit(1), F.char_length("name") - n + 1), lambda i: F.substring("name", i, n)))))).alias("name"))
    within = own.select("type", "name", F.col("id").alias("a")).join(subs, ["type", "name"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("rank"), F.lit("substring").alias("reason")).distinct()

    def alike(pdf):
        import pandas as pd
        from difflib import SequenceMatcher

        rows = sorted(zip(pdf["id"], pdf["name"]))
        found = [(i, j, r) for k, (i, x) in enumerate(rows) for j, y in rows[k + 1 :] if (r := SequenceMatcher(None, x, y).ratio()) >= 0.6]
        return pd.DataFrame([(i, j, 2, f"same_turn+similar(ratio={r:.2f})") for i, j, r in found], columns=["a", "b", "rank", "reason"])

    similar = own.where("first_seen is not null").groupBy("type", "first_seen").applyInPandas(alike, "a string, b string, rank int, reason string")
    every = near.unionByName(within).unionByName(similar).groupBy("a", "b").agg(F.min_by("reason", "rank").alias("reason"))
    t = targets.groupBy("id").agg(F.collect_set("target_id").alias("t"))
    met = every.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a", "left").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b", "left")
    apart = (F.size("ta") >= 3) & (F.size("tb") >= 3) & (2 * F.size(F.array_intersect("ta", "tb")) < F.least(F.size("ta"), F.size("tb")))
    return met.where(~F.coalesce(apart, F.lit(False))).select("a", "b", "reason")


def judged_pairs(scored: DataFrame, merge_from: float = 0.9, review_from: float = 0.6) -> DataFrame:
    """Scored pairs (a, b, same, confidence, canonical) with an action: merge, review or discard; confidence is held to 0..1."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    action = F.when(~F.coalesce("same", F.lit(False)) | (sure < review_from), "discard").when(sure >= merge_from, "merge").otherwise("review")
    keep = F.when(F.col("canonical").isin(F.col("a"), F.col("b")), F.col("canonical")).otherwise(F.col("a"))
    return scored.select("a", "b", sure.alias("confidence"), keep.alias("canonical"), F.when(keep == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("variant"), action.alias("action"))


def hinted_merges(entities: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, survivor) by coreference hints (canonical_id, variant_ids, variant_names): entities of the canonical's type with such an
    id or name. Hints whose canonical entity is missing do nothing; an entity goes to the least canonical id that claims it."""
    there = hints.join(entities.select(F.col("id").alias("canonical_id"), "type"), "canonical_id")
    ids = there.select("canonical_id", "type", F.explode("variant_ids").alias("id"))
    names = there.select("canonical_id", "type", F.explode("variant_names").alias("_v")).select("canonical_id", "type", F.lower(F.trim("_v")).alias("key")).where("key <> ''")
    by_id = entities.select("id", "type").join(ids, ["id", "type"]).select("id", "canonical_id")
    by_name = entities.select("id", "type", F.lower(F.trim("name")).alias("key")).join(names, ["key", "type"]).select("id", "canonical_id")
    return by_id.unionByName(by_name).where("id <> canonical_id").groupBy("id").agg(F.min("canonical_id").alias("survivor"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, survivor): the least id that each id of the pairs reaches, by neighbours' labels and label jumps."""
    from skein.sources.scratch import written

    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    now = written(both.select("a").distinct().withColumn("l", F.col("a")), "labels")
    while True:
        near = both.join(now.selectExpr("a as b", "l"), "b").groupBy("a").agg(F.min("l").alias("near"))
        step = now.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        hop = step.groupBy("old").agg(F.min("l").alias("hop"))
        nxt = written(step.join(hop, "old").select("a", "old", F.least("l", "hop").alias("l")), "labels")
        now = nxt.select("a", "l")
        if nxt.where("l < old").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("l").alias("survivor"))


def rewrite_refs(events: DataFrame, merged: DataFrame) -> DataFrame:
    """Events with references (one hop) replaced by survivors, each once in the first's place."""
    each = events.select("id", F.posexplode("refs").alias("_i", "ref")).join(merged.select(F.col("id").alias("ref"), "survivor"), "ref", "left")
    first = each.groupBy("id", F.coalesce("survivor", "ref").alias("ref")).agg(F.min("_i").alias("_i"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "ref"))), lambda x: x["ref"]).alias("refs"))


def compound_fragments(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Single-word candidates that are a word of a longer known name of the same or an unknown type."""
    words = known.select(F.col("type").alias("of_type"), F.col("name").alias("compound"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"), F.size(F.split(F.trim("name"), r"\s+")).alias("_n")).where("_n >= 2").select("word", "of_type", "compound").distinct()
    single = candidates.where("not trim(name) like '% %'").select("id", "type", F.lower(F.trim("name")).alias("word"))
    hit = single.join(words, "word").where("type is null or of_type is null or type = of_type")
    return hit.groupBy("id", "word").agg(F.count_distinct("compound").alias("compounds"))


def dedup_relationships(history: DataFrame) -> DataFrame:
    """One edge a pair: the newest entry's type and status, the earliest turn, and the number of different descriptions."""
    newest = F.max_by(F.struct("rel_type", "status"), F.struct("turn", "ord"))
    return history.groupBy("source_id", "target_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), newest.alias("m"), F.countDistinct("description").alias("descriptions")).select("source_id", "target_id", "first_turn", "last_turn", "m.rel_type", "m.status", "descriptions")


def merge_keep_first(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Current rows and those updates whose keys are new, the first of each key; nulls in keys are equal."""
    same = F.lit(True)
    known = current.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = updates.join(known, same, "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")
    return current.unionByName(fresh)


def upsert_entities(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Entities after updates (id, ord and the catalog's columns): last non-null value wins, turns take the least and the most."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in ("name", "type", "identity", "current_status", "location")}
    both = current.withColumn("ord", F.lit(-1).cast("bigint")).unionByName(updates.select(*current.columns, "ord"))
    return both.groupBy("id").agg(*last.values(), F.min("first_seen").alias("first_seen"), F.max("last_updated").alias("last_updated"))


def relationship_tiers(edges: DataFrame, mentioned: DataFrame, turn: int, recent: int = 15) -> DataFrame:
    """Tier of each edge: 1 both ends mentioned, 2 one and recent, 3 one and active, else 4."""
    m = mentioned.select(F.col("entity_id").alias("id")).distinct()
    both = edges.join(m.select(F.col("id").alias("source_id"), F.lit(1).alias("s")), "source_id", "left").join(m.select(F.col("id").alias("target_id"), F.lit(1).alias("t")), "target_id", "left")
    n = F.coalesce("s", F.lit(0)) + F.coalesce("t", F.lit(0))
    tier = F.when(n == 2, 1).when((n == 1) & (F.lit(turn) - F.col("last_turn") <= recent), 2).when((n == 1) & (F.col("status") == "active"), 3).otherwise(4)
    return both.select("source_id", "target_id", "rel_type", "last_turn", tier.cast("bigint").alias("tier"))


def top_relationships(tiers: DataFrame, most: int = 8) -> DataFrame:
    """Up to ``most`` edges of each source by tier, then newest; tier 4 is left out."""
    w = Window.partitionBy("source_id").orderBy("tier", F.desc("last_turn"), "target_id", "rel_type")
    return tiers.where("tier < 4").withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)


def refresh_slots(entities: DataFrame, turn: int, interval: int, batch: int, shares: dict[str, float]) -> DataFrame:
    """Stale entities to refresh: of each type the longest unseen, as many as the type's share of the batch (largest remainders)."""
    raw = {t: s * batch for t, s in shares.items()}
    slots = {t: int(x) for t, x in raw.items()}
    for t in sorted(raw, key=lambda t: (slots[t] - raw[t], t))[: batch - sum(slots.values())]:
        slots[t] += 1
    slot = F.coalesce(*(F.when(F.col("type") == t, n) for t, n in slots.items()), F.lit(0))
    w = Window.partitionBy("type").orderBy("last_updated", "id")
    return entities.where(F.lit(turn) - F.col("last_updated") > interval).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= slot).select("id", "type", "last_updated", "rank")


def evidence(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of events (stated) and of unsure relationships (inferred), once a key: classification, statement, turn_no, entities."""
    a = events.select(F.lit("explicit_evidence").alias("classification"), F.substring("description", 1, 80).alias("statement"), "turn_no", F.array_join(F.array_sort("refs"), ",").alias("entities"))
    b = edges.where("status is null").select(F.lit("inference").alias("classification"), F.concat_ws(" ", "source_id", "rel_type", "target_id").alias("statement"), F.col("last_turn").alias("turn_no"), F.array_join(F.array_sort(F.array("source_id", "target_id")), ",").alias("entities"))
    return a.unionByName(b).distinct()
