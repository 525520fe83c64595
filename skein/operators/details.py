"""Work around model calls: prompts for entities, relationships, events and pages, their answers as rows, and the loops that
re-extract stubs and stale entities. The provider is the caller's; nothing here calls a model by itself.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.provider import Provider, clean_answer, complete, stub
from skein.operators import catalog, rules

_ENTITY = "entity struct<id:string,name:string,type:string,identity:string,current_status:string,first_seen:long,last_updated:long,aliases:array<string>>"


class QuotaExhausted(Exception):
    """Too many rate limits in a row: the run ends."""


def retrying(provider: Provider, attempts: int = 3, limits_in_a_row: int = 5, wait: Callable[[float], None] = time.sleep) -> Provider:
    """A provider that tries again: after the error's ``retry_after`` (up to 60 s), else 1, 2, 4 .. 60 s. An error with ``status`` 429
    counts as a rate limit; after ``limits_in_a_row`` of them QuotaExhausted is raised. The last attempt's error is raised on."""
    limits = 0

    def call(prompts: list[str]) -> list[str]:
        nonlocal limits
        for attempt in range(attempts):
            try:
                answers = provider(prompts)
                limits = 0
                return answers
            except Exception as e:
                limits = limits + 1 if getattr(e, "status", None) == 429 else 0
                if limits >= limits_in_a_row:
                    raise QuotaExhausted(f"{limits} rate limits in a row") from e
                if attempt == attempts - 1:
                    raise
                after = getattr(e, "retry_after", None)
                wait(after if after is not None and after <= 60 else min(2.0**attempt, 60.0))
        raise ValueError("attempts must be 1 at least")

    return call


def alternating(providers: list[Provider]) -> Provider:
    """Calls go to the providers in turn."""
    turn = itertools.cycle(providers)
    return lambda prompts: next(turn)(prompts)


def detail_prompts(candidates: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """(id, prompt) for each candidate (key, id, name, type) of a text (key, text)."""
    ask = F.format_string("Describe the %s '%s' (%s) as JSON {\"entity\": {...}} by this text:\n", "type", "name", "id")
    return candidates.join(texts.select(*key, "text"), key).select("id", F.concat(ask, "text").alias("prompt"))


def batched_prompts(candidates: DataFrame, texts: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """(id, ids, prompt): up to ``most`` candidates of a text in one prompt; id is the text's key and the batch's number."""
    w = Window.partitionBy(*key).orderBy("id")
    part = candidates.withColumn("_b", F.floor((F.row_number().over(w) - 1) / most))
    own = part.groupBy(*key, "_b").agg(F.array_sort(F.collect_list(F.struct("id", "name", "type"))).alias("e"))
    names = F.array_join(F.transform("e", lambda x: F.concat(x["type"], F.lit(" "), x["name"], F.lit(" ("), x["id"], F.lit(")"))), ", ")
    return own.join(texts.select(*key, "text"), key).select(F.concat_ws("/", *key, "_b").alias("id"), F.transform("e", lambda x: x["id"]).alias("ids"), F.concat(F.lit("Describe as JSON {\"entities\": [...]}: "), names, F.lit("\n"), "text").alias("prompt"))


def relationship_prompts(turns: DataFrame, mentioned: DataFrame, key: list[str]) -> DataFrame:
    """(id, prompt) for each turn that names two entities at least."""
    who = mentioned.groupBy(*key).agg(F.array_sort(F.collect_set("entity_id")).alias("who")).where(F.size("who") >= 2)
    return turns.join(who, key).select(F.concat_ws("/", *key).alias("id"), F.concat(F.lit("Relationships between "), F.array_join("who", ", "), F.lit(" as JSON {\"relationships\": [...]}:\n"), "text").alias("prompt"))


def event_prompts(turns: DataFrame, key: list[str]) -> DataFrame:
    return turns.where("trim(text) <> ''").select(F.concat_ws("/", *key).alias("id"), F.concat(F.lit("Events as JSON {\"events\": [...]}:\n"), "text").alias("prompt"))


def answered_entities(answers: DataFrame) -> DataFrame:
    """Entities of answers (id, answer): id, type, name, identity, current_status, first_seen, last_updated, aliases; the asked-for id wins."""
    own = answers.select("id", F.from_json(clean_answer(F.col("answer")), _ENTITY)["entity"].alias("e")).where("e is not null")
    return own.select("id", *(F.col(f"e.{c}").alias(c) for c in ("type", "name", "identity", "current_status", "first_seen", "last_updated", "aliases")))


def answered_relationships(answers: DataFrame) -> DataFrame:
    """(id, source_id, target_id, rel_type, status) of answers, types held to the known ones; without an end they are dropped."""
    ddl = "relationships array<struct<source_id:string,target_id:string,type:string,status:string>>"
    own = answers.select("id", F.explode(F.from_json(clean_answer(F.col("answer")), ddl)["relationships"]).alias("r")).where("r.source_id <> '' and r.target_id <> ''")
    return own.select("id", "r.source_id", "r.target_id", rules.relationship_type(F.coalesce("r.type", F.lit(""))).alias("rel_type"), F.coalesce("r.status", F.lit("active")).alias("status"))


def answered_events(answers: DataFrame, turn: Column) -> DataFrame:
    """(id, type, description, sources, refs) of answers, types and source turns mended; ``turn`` is the answer's turn id, from its id."""
    ddl = "events array<struct<type:string,description:string,source_turns:array<string>,related_entities:array<string>>>"
    own = answers.select("id", turn.alias("_turn"), F.explode(F.from_json(clean_answer(F.col("answer")), ddl)["events"]).alias("e")).where("e.description <> ''")
    sources = F.coalesce("e.source_turns", F.array("_turn"))
    return own.select("id", rules.event_type(F.coalesce("e.type", F.lit("other"))).alias("type"), "e.description", rules.near_source_turns(sources, F.col("_turn")).alias("sources"), F.coalesce("e.related_entities", F.array().cast("array<string>")).alias("refs"))


def _renewed(entities: DataFrame, prompts: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    found = answered_entities(complete(prompts, provider))
    known = entities.select("id", F.col("type").alias("_type"))
    update = found.join(known, "id").withColumn("type", F.col("_type")).drop("_type")
    return catalog.upserted(entities, update), update.select("id").distinct()


def backfilled(entities: DataFrame, notes: DataFrame, context: DataFrame, provider: Provider = stub) -> DataFrame:
    """The catalog after stubs were extracted anew: entities as catalog.upserted takes them; notes: id, notes; context: id, text. Stubs
    without context, and those whose answer is no entity, stay as they are."""
    stubs = entities.join(notes, "id", "left").where(rules.is_stub(F.col("notes"), F.col("identity"))).select("id", "name", "type")
    prompts = detail_prompts(stubs, context, ["id"])
    return _renewed(entities, prompts, provider)[0]


def refresh_context(stale: DataFrame, mentions: DataFrame, turns: DataFrame, most: int = 15, chars: int = 500) -> DataFrame:
    """(id, text): for each stale entity (id, last_updated) the later turns that mention it (mentions: turn_no, entity_id), the first ``most``."""
    later = stale.join(mentions.withColumnRenamed("entity_id", "id"), "id").where("turn_no > last_updated").select("id", "turn_no").distinct()
    w = Window.partitionBy("id").orderBy("turn_no")
    own = later.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).join(turns.select("turn_no", "text"), "turn_no")
    line = F.concat(F.format_string("[turn-%03d] ", "turn_no"), F.substring("text", 1, chars))
    return own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def refreshed(entities: DataFrame, context: DataFrame, turn: int, provider: Provider = stub) -> DataFrame:
    """The catalog after the entities with a context (id, text) were extracted anew; what was renewed is of ``turn``, unless it is later already."""
    prompts = detail_prompts(entities.select("id", "name", "type").join(context.select("id"), "id", "left_semi"), context, ["id"])
    out, touched = _renewed(entities, prompts, provider)
    marked = out.join(touched.withColumn("_t", F.lit(True)), "id", "left")
    return marked.withColumn("last_updated", F.when(F.col("_t"), F.greatest("last_updated", F.lit(turn))).otherwise(F.col("last_updated"))).drop("_t")


def page_prompts(entities: DataFrame, counts: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, prompt) for each entity worth a page (counts: id, events), with its facts (id, ord, fact) in order."""
    own = entities.join(counts, "id").where(rules.worth_a_page(F.col("type"), F.col("events")))
    text = facts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact"))), lambda x: x["fact"]), "\n").alias("text"))
    return own.join(text, "id").select("id", F.concat(F.format_string("Tell the story of %s (%s) by these facts:\n", "name", "type"), "text").alias("prompt"))


def summarized_arcs(chunks: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(source_id, target_id, chunk, summary) of arc chunks (source_id, target_id, chunk, first_turn, last_turn, type): the model's
    words, or none where there is no provider or its call failed."""
    key = F.concat_ws("/", "source_id", "target_id", "chunk")
    if provider is None:
        return chunks.select("source_id", "target_id", "chunk", F.lit("").alias("summary"))
    ask = F.format_string("Sum up %s and %s (%s) from turn %d to %d.", "source_id", "target_id", "type", "first_turn", "last_turn")
    answers = complete(chunks.select(key.alias("id"), ask.alias("prompt")), provider)
    return chunks.withColumn("id", key).join(answers, "id", "left").select("source_id", "target_id", "chunk", F.coalesce("answer", F.lit("")).alias("summary"))


def linkified(prose: DataFrame, names: DataFrame, most_names: int = 200_000, least: int = 4) -> DataFrame:
    """(id, text) of prose (id, folder, text) with the first mention of each other entity as a link.

    names: id, name, folder. Longer names go first (the lesser id of equals), names under ``least`` characters are left out, a
    mention within brackets is none, and a link leads to the same folder by file name alone. Names are looked up by one automaton for each
    block of ``most_names``, so the broadcast is bounded at any size of the catalog.
    """
    own = names.where(F.char_length("name") >= least).select("id", "name", "folder")
    blocks = max(1, -(-own.count() // most_names))
    hits = None
    for k in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # about most_names rows

        def find(frames, words=sorted({r.name for r in part})):
            import ahocorasick
            import pandas as pd

            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            if words:
                automaton.make_automaton()
            for pdf in frames:
                found = [(i, w) for i, t in zip(pdf["id"], pdf["text"]) for w in {w for _, w in automaton.iter(t or "")}] if words else []
                yield pd.DataFrame(found, columns=["id", "name"])

        one = prose.select("id", "text").mapInPandas(find, "id string, name string")
        hits = one if hits is None else hits.unionByName(one)
    met = hits.join(own.withColumnsRenamed({"id": "target", "folder": "_folder"}), "name").where("id <> target")
    links = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("name")).alias("n"), "target", "name", "_folder"))).alias("links"))

    def replace(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for i, folder, text, links_ in zip(pdf["id"], pdf["folder"], pdf["text"], pdf["links"]):
                for x in links_ if links_ is not None else ():
                    at, name = text.find(x["name"]), x["name"]
                    while at >= 0 and text.count("[", 0, at) > text.count("]", 0, at):
                        at = text.find(name, at + len(name))
                    if at >= 0:
                        to = f"{x['target']}.md" if x["_folder"] == folder else f"../{x['_folder']}/{x['target']}.md"
                        text = f"{text[:at]}[{name}]({to}){text[at + len(name):]}"
                out.append((i, text))
            yield pd.DataFrame(out, columns=["id", "text"])

    return prose.join(links, "id", "left").select("id", "folder", "text", "links").mapInPandas(replace, "id string, text string")
