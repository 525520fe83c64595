"""Benchmark decontamination: a distributed positional inverted index, in DataFrame operations only.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

1. Counts of the test terms over all documents, so each phrase knows its rarest terms.
2. The index: one scan stores, as a table in the shared folder, the postings (term, document, position) of the terms that are
   one of the ``LISTS`` rarest of some phrase; very frequent words are in it only for phrases that have nothing rarer. A
   last posting of the empty term holds each document's length.
3. Intersection, from the rarest term: a posting at position p puts the phrase at p - offset; the lists so adjusted meet by phrase,
   document and place. What is in all of them is a candidate.
4. A phrase's other terms are compared with the words of the candidates' documents, so matches are exact; only documents with a
   candidate are read for it.

No list is gathered in one place. Phrases and anchors are broadcast when counted to be at most ``broadcast_rows`` (of ``window`` words
each), and joined by term otherwise; candidates (numbers alone) likewise.

Nulls: a null text has no words and is reported with zeros; test rows without an id
or a word are left out. Repeated rows are reported once each; of equal phrases each item counts. Ties: of a phrase's equally rare terms the
first serves. Texts of any length are read whole. Without documents there are no rows, without tests all figures are zero. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import columns_as, written

WINDOW, LISTS = 13, 2
BROADCAST_ROWS = 200_000
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; an array without nulls, null for null."""
    # lower() does as asked on ASCII, fast; beyond it only A-Z may change
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(folded, _BREAK), "")


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = columns_as(docs, id_col, text_col)
    return base.select("_id", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_row"), F.coalesce(words(F.col("_text")), F.array().cast("array<string>")).alias("_words"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index as a stream: _id, _row, _words, _pos, _term; and for each row of
    ``docs`` a last posting of the empty term at the position of its length.
    """
    own = _with_words(docs, id_col, text_col)
    return own.select("*", F.posexplode_outer(F.concat("_words", F.array(F.lit("")))).alias("_pos", "_term"))


def phrases_of(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items (_phrase) with the ids that hold them (_items, strings)."""
    own = items.select(F.col(f"`{id_col}`").cast("string").alias("_item"), words(F.col(f"`{text_col}`")).alias("_w")).where("_item is not null and size(_w) > 0")
    n = F.size("_w")
    at = F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))))
    return own.select("_item", "_w", at.alias("_at")).select("_item", F.slice("_w", F.col("_at"), window).alias("_phrase")).groupBy("_phrase").agg(F.array_sort(F.collect_set("_item")).alias("_items"))


def rarest_terms(docs: DataFrame, phrases: DataFrame, small: bool, lists: int = LISTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each phrase that can occur with its ``lists`` rarest different terms over all documents: _phrase, _items, _term, _offset (of its
    first place), _nth (1: the rarest), _lists (how many it has)."""
    hint = F.broadcast if small else (lambda x: x)
    terms = phrases.select(F.explode("_phrase").alias("_term")).distinct()
    seen = postings(docs, id_col, text_col).select("_term").join(hint(terms), "_term").groupBy("_term").agg(F.count("*").alias("_n"))
    each = phrases.select("*", F.posexplode("_phrase").alias("_offset", "_term")).join(hint(seen), "_term", "left")
    term = each.groupBy("_phrase", "_term").agg(F.min("_offset").alias("_offset"), F.any_value("_n").alias("_n"), F.any_value("_items").alias("_items"))
    best = term.groupBy("_phrase").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_term", "_offset"))), 1, lists).alias("_best"), F.any_value("_items").alias("_items"))
    can = best.where(F.col("_best")[0]["n"] > 0)
    return can.select("_phrase", "_items", F.size("_best").alias("_lists"), F.posexplode("_best").alias("_nth", "_b")).select("_phrase", "_items", "_b._term", F.col("_b._offset").cast("int").alias("_offset"), (F.col("_nth") + 1).alias("_nth"), "_lists")


def stored_postings(docs: DataFrame, terms: DataFrame, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table: _id, _row, _pos, _term of the wanted terms (_term) and of the empty one."""
    ends = docs.sparkSession.range(1).select(F.lit("").alias("_term"))
    wanted = terms.select("_term").distinct().unionByName(ends)
    found = postings(docs, id_col, text_col).select("_id", "_row", "_pos", "_term").join(F.broadcast(wanted) if small else wanted, "_term")
    return written(found.select("_id", "_row", "_pos", "_term"), "postings")


def phrase_matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every occurrence of a phrase: _id, _row, _start, _size, _items; and a row for each row of
    ``docs`` with its length in _start and null in _size and _items.
    """
    small = phrases.limit(broadcast_rows + 1).count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    anchors = written(rarest_terms(docs, phrases, small, LISTS, id_col, text_col).withColumn("_pid", F.xxhash64("_phrase")), "anchors")
    index = stored_postings(docs, anchors, small, id_col, text_col)
    # lists adjusted by offset, from the rarest term on; equal places of all lists are candidates
    place = ["_pid", "_id", "_row", "_start"]
    adjusted = lambda nth, *more: index.join(hint(anchors.where(F.col("_nth") == nth).select("_pid", "_term", "_offset", *more)), "_term").select("_pid", "_id", "_row", (F.col("_pos") - F.col("_offset")).alias("_start"), *more).where("_start >= 0")
    met = adjusted(1, "_lists")
    for nth in range(2, LISTS + 1):
        other = adjusted(nth).select(*(F.col(c).alias(f"{c}2") for c in place)).distinct()
        same = F.expr("_pid = _pid2 and _id <=> _id2 and _row = _row2 and _start = _start2")
        met = met.where(F.col("_lists") >= nth).join(other, same, "left_semi").unionByName(met.where(F.col("_lists") < nth))
    found = written(met.select(*place).distinct(), "candidates")
    few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
    # a document's candidates meet its text as one row; the words from each place on meet the phrase, of which a pid is only a name
    asked = found.groupBy(F.col("_id").alias("_own"), F.col("_row").alias("_own_row")).agg(F.collect_list(F.struct("_pid", "_start")).alias("_at"))
    size = phrases.agg(F.max(F.size("_phrase"))).first()[0] or 1
    held = _with_words(docs, id_col, text_col).join(F.broadcast(asked) if few else asked, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_row") == F.col("_own_row")))
    pieces = held.select("_id", "_row", F.explode(F.transform("_at", lambda c: F.struct(c["_pid"].alias("_pid"), c["_start"].alias("_start"), F.slice("_words", c["_start"] + 1, size).alias("_piece")))).alias("c")).select("_id", "_row", "c.*")
    whole = F.slice("_piece", F.lit(1), F.size("_phrase")) == F.col("_phrase")
    hits = pieces.join(hint(anchors.where("_nth = 1").select("_pid", "_phrase", "_items")), "_pid").where(whole).select("_id", "_row", "_start", F.size("_phrase").alias("_size"), "_items")
    none = F.lit(None).cast("array<string>")
    ends = index.where("_term = ''").select("_id", "_row", F.col("_pos").alias("_start"), F.lit(None).cast("int").alias("_size"), none.alias("_items"))
    return hits.unionByName(ends)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of ``docs``: _id, _row, n_words, n_hit, n_items, items_sha256, contaminated, and _hits
    (ranges of hit words) with _items (ids of the items found).
    """
    phrases = phrases_of(items, window, item_col, item_text_col)
    found = phrase_matches(docs, phrases, id_col, text_col, broadcast_rows)
    doc = found.groupBy("_id", "_row").agg(
        F.max(F.when(F.col("_size").isNull(), F.col("_start"))).alias("n_words"),
        F.count_if(F.col("_size").isNull()).alias("_rows"),
        F.array_sort(F.collect_set(F.when(F.col("_size").isNotNull(), F.struct(F.col("_start").alias("s"), (F.col("_start") + F.col("_size")).alias("e"))))).alias("_found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"),
    )
    joined = F.aggregate(
        "_found",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(done, F.lit(-1))["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    doc = doc.withColumn("_hits", F.when(F.size("_found") > 0, joined).otherwise(F.array().cast("array<struct<s:int,e:int>>")))
    doc = doc.withColumn("n_hit", F.aggregate("_hits", F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["s"])))
    doc = doc.select(
        "_id",
        "_row",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "_hits",
        "_items",
        "_rows",
    )
    return doc.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_nth")).drop("_nth", "_rows")


def proximity_matches(docs: DataFrame, queries: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in which all terms of a query stand within ``span`` words, in any order.

    queries: query_id and terms (array of lower-case words). One row for each match and
    place of the query's rarest term: _id, query_id, _pos.
    """
    asked = queries.select("query_id", F.array_distinct("terms").alias("_phrase")).where("size(_phrase) > 0")
    small = queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = rarest_terms(docs, asked.groupBy("_phrase").agg(F.collect_set(F.col("query_id").cast("string")).alias("_items")), small, 1, id_col, text_col)
    hint = F.broadcast if small else (lambda x: x)
    near = F.exists(F.sequence(F.greatest(F.col("_pos") - span + 1, F.lit(0)), F.col("_pos")), lambda s: F.size(F.array_except("_phrase", F.slice("_words", s + 1, span))) == 0)
    return postings(docs, id_col, text_col).join(hint(keyed), "_term").where(near).select("_id", F.explode("_items").alias("query_id"), "_pos")
