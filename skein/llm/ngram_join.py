"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct ``words``-word shingles (tokens, as 64-bit hashes);
two documents link when 100 * |intersection| >= ``percent`` * |union|.

Plan
1. Equal sets are one node, whose number is its first document's.
2. Filter: of each set's first tokens by hash, about 2 (1 - p) n for a threshold p, a linked set must have
   p (1 - p) n in common with others. Sets with less, the most, link with nothing and leave here.
3. Order: the tokens of the sets left are counted, and each set is ordered by ascending count (then hash). A token
   of one set only takes a place but needs no index, so prefixes are mostly such tokens.
4. Prefixes: the smaller set x of a pair is indexed by its first I + 1 tokens and the larger y probes with its first
   P + 1, I and P being the most tokens that they can lack of each other. The sets' first common token lies in both.
5. Stars: in each token's bucket every component is paired with the bucket's pivot, the set with the fewest
   tokens before the bucket's; pairs are verified on whole texts, and components joined, until that finds no more
   (``STARS`` rounds at most). A large group of near copies collapses here at a cost in proportion to its size.
6. Closure, exact, over buckets that still hold several components. A token in up to ``RARE`` sets is a bucket
   by itself, and a pair meets there if the tokens behind it suffice. Where a pair's first common token
   is frequent, all are: prefixes are extended so that two common tokens lie in both, and each combination of two
   frequent tokens of a prefix is a bucket. Sets of over ``SHORT`` tokens are extended by an ``EXTEND``-th instead: in two
   such prefixes neighbouring common tokens have few others between somewhere, so combinations at most ``gap`` apart do.
   Pairs across components that can reach the overlap are verified.

Every linked pair of nodes is verified or already in one component, so the components
are those of the full join.

Texts with fewer words have their whole word sequence as the one token; null or
wordless texts have none and stand alone. Null ids link, but name a component
only where no member has an id; it is null then. Repeated rows are equal sets. Ties: tokens of one count are ordered by hash, pivots of one
place by row. An empty table gives no rows. Texts of any length are read whole. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import columns_as, released, written
from ._text import U64, Words, chunks, mix, shingles, text_buffers

WORDS, PERCENT = 5, 80
RARE, STARS, SALT, BROADCAST_NODES = 8, 3, 64, 500_000
#: Prefixes are extended by one token up to this size of a set, by this part of it beyond.
SHORT, EXTEND = 256, 64
#: Names from here on are of rows without an id: they name components of which no member has an id.
_NO_ID = 1 << 62


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each document of a chunk."""
    w = Words(buf, offs, fold=True)
    runs, out = shingles(w.hash, k), []
    for a, e in zip(w.first[:-1], w.first[1:]):
        if e - a >= k:
            out.append(np.unique(runs[a : e - k + 1]))
        elif e > a:
            out.append(mix(shingles(w.hash[a:e], int(e - a)) + U64(e - a)))
        else:
            out.append(runs[:0])
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set that are indexed: those of it that a linked set lacks, those that either lacks, and three.

    With p = percent / 100 the first two are at most 2 (1 - p) n, or n / p - n where that is more.
    """
    return min(n, max(-(-2 * n * (100 - percent) // 100), -(-n * (100 - percent) // percent)) + 3)


def gap(percent: int, short: bool) -> int:
    """How far apart, at most, two neighbours among the first common tokens stand in both prefixes somewhere.

    The tokens that x and y lack of each other, I + P of the smaller n, lie in one gap or in n / EXTEND.
    """
    return (SHORT if short else EXTEND) * (100 - percent) * (100 + 2 * percent) // (percent * (100 + percent)) + 1


def _extension(n: str) -> str:
    return f"if({n} <= {SHORT}, 1, ({n} + {EXTEND - 1}) div {EXTEND})"


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(2))
            for i, j in chunks(offs):
                sets = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sums = [int(np.bitwise_xor.reduce(mix(s), initial=U64(0)).view(np.int64)) for s in sets]
                more = [int(np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), initial=U64(0)).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], b.column(3)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(sums, pa.int64()), pa.array(more, pa.int64())], ["_rid", "_id", "_row", "_n", "_sum", "_more"])

    return run


def _tokens(k: int, percent: int | None):
    """Rows (token, document, size of its set): of each set's prefix by hash, or all where ``percent`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(1))
            for i, j in chunks(offs):
                sets = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                tokens = sets if percent is None else [s[: prefix_length(len(s), percent)] for s in sets]
                sizes = [len(t) for t in tokens]
                flat = np.concatenate(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column(0)[i:j].to_numpy(), sizes)), pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), sizes))], ["_token", "_rid", "_n"])

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose value is not alone."""
    held, twice = None, False
    for b in batches:
        key = b.column(0).to_numpy()
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if held is not None:
            if held.column(0)[0].as_py() == key[0]:
                keep[0] = twice = True
            if twice:
                yield held
        last = b.slice(len(key) - 1)
        twice = bool(keep[-1])
        yield b.filter(pa.array(np.r_[keep[:-1], False]))
        held = last
    if held is not None and twice:
        yield held


def _verify(k: int, percent: int):
    """Rows (x, salt, kind, y, text) sorted so that x's own text leads -> linked (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            buf, offs = text_buffers(b.column(4))
            xs, kinds, ys = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            out: list[tuple[int, int]] = []
            for i, j in chunks(offs):
                for d, s in enumerate(shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k), i):
                    if kinds[d] == 0:
                        own = s
                    elif linked(own, s, percent):
                        out.append((xs[d], ys[d]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["_x", "_y"])

    return run


def components(edges: DataFrame, nodes: DataFrame, key: str, label: str) -> DataFrame:
    """Least ``label`` that each node of ``nodes`` (key, label) reaches over ``edges`` (_x, _y)."""
    both = written(edges.select(F.col("_x").alias("_a"), F.col("_y").alias("_b")).unionByName(edges.select(F.col("_y").alias("_a"), F.col("_x").alias("_b"))).distinct(), "edges")
    now = table = written(nodes.select(F.col(key).alias("_a"), F.col(label).alias("_l")), "labels")
    while True:
        # the least label around a node, then the label that this label's own node has by now
        near = both.join(now.select(F.col("_a").alias("_b"), "_l"), "_b").groupBy("_a").agg(F.min("_l").alias("_near"))
        step = now.join(near, "_a", "left").select("_a", F.col("_l").alias("_old"), F.least("_l", F.coalesce("_near", "_l")).alias("_l"))
        jump = step.groupBy("_old").agg(F.min("_l").alias("_hop"))
        nxt = written(step.join(jump, "_old").select("_a", "_old", F.least("_l", "_hop").alias("_l")), "labels")
        changed = not nxt.where("_l < _old").isEmpty()
        released(table)
        table, now = nxt, nxt.select("_a", "_l")
        if not changed:
            released(both)
            return now.select(F.col("_a").alias(key), F.col("_l").alias(label))


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: _id, _row (hash of the text), n_shingles, component_id,
    and _first (whether it is the one row of its component to keep)."""
    # row numbers are written down: a later scan could number the rows otherwise
    base = written(columns_as(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_rid"), "_id", "_text"), "rows")
    sets = written(base.select("*", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_row")).mapInArrow(_sets(words), "_rid long, _id long, _row long, _n long, _sum long, _more long"), "sets")
    named = sets.where("_n > 0").withColumn("_name", F.coalesce("_id", F.col("_rid") + F.lit(_NO_ID)))
    nodes = named.groupBy("_n", "_sum", "_more").agg(F.min("_name").alias("_name"), F.min_by("_rid", F.struct("_name", "_rid")).alias("_node"))
    nodes = written(nodes, "nodes")

    index = "_token long, _rid long, _n int"
    prefixes = base.select("_rid", "_text").mapInArrow(_tokens(words, percent), index).select("_token", "_rid")
    met = written(prefixes.repartition("_token").sortWithinPartitions("_token").mapInArrow(_shared_only, "_token long, _rid long"), "met")
    slim = nodes.select(F.col("_node").alias("_rid"), "_n")
    enough = met.join(slim, "_rid").groupBy("_rid").agg(F.count("*").alias("_u"), F.max("_n").alias("_n")).where(F.col("_u") * 10000 >= F.col("_n") * (percent * (100 - percent)) - 9999)
    left = written(enough.select("_rid"), "left")
    released(met)
    few = left.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    texts = written(base.select("_rid", "_text").join(F.broadcast(left) if few else left, "_rid", "left_semi"), "texts")
    released(base, left)

    # from here on only the sets that are left, whole, their tokens by ascending count
    tokens = texts.mapInArrow(_tokens(words, None), index)
    shared = tokens.join(tokens.groupBy("_token").agg(F.count("*").alias("_df")).where("_df > 1"), "_token")
    whole = Window.partitionBy("_rid")
    ranked = shared.select("*", F.row_number().over(whole.orderBy("_df", "_token")).alias("_at"), F.count("*").over(whole).alias("_s"))
    # _i and _p: tokens that the set can lack of a larger and of any partner; _at: shared tokens before; _place: all tokens before
    lacks = {"_i": f"(_n * {100 - percent}) div {100 + percent}", "_p": f"(_n * {100 - percent}) div 100", "_e": _extension("_n")}
    ranked = ranked.withColumns({"_at": F.col("_at") - 1, "_place": F.expr("_n - _s + _at - 1"), **{c: F.expr(x) for c, x in lacks.items()}})
    prefix = written(ranked.where("_n - _s <= _p and _place <= _p + _e").withColumn("_indexed", F.expr("_place <= _i + _e")).drop("_e"), "prefix")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("_x", "_y"), "pairs")
        parts = pairs.groupBy("_x").agg(F.ceil(F.count("*") / SALT).cast("long").alias("_parts"))
        own = parts.join(texts.withColumnRenamed("_rid", "_x"), "_x").select("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_y"), "_text")
        other = pairs.join(parts, "_x").join(texts.withColumnRenamed("_rid", "_y"), "_y").select("_x", F.pmod(F.xxhash64("_y"), "_parts").alias("_salt"), F.lit(1).alias("_kind"), "_y", "_text")
        rows = own.unionByName(other).repartition("_x", "_salt").sortWithinPartitions("_x", "_salt", "_kind")
        links = written(rows.mapInArrow(_verify(words, percent), "_x long, _y long"), "links")
        released(pairs)
        return links

    # a component is known by the least row number among its nodes; a node that is in none of the tables stands alone
    labels = written(prefix.select("_rid").distinct().withColumn("_label", F.col("_rid")), "labels")

    def joined(found: DataFrame) -> bool:
        """Join the components that the links connect; only those are walked."""
        nonlocal labels
        own = labels.select("_rid", "_label")
        edges = found.join(own.toDF("_x", "_lx"), "_x").join(own.toDF("_y", "_ly"), "_y").where("_lx <> _ly")
        edges = written(edges.select(F.col("_lx").alias("_x"), F.col("_ly").alias("_y")).distinct(), "edges")
        released(found)
        if edges.isEmpty():
            released(edges)
            return False
        ends = edges.select(F.explode(F.array("_x", "_y")).alias("_label")).distinct()
        moved = components(edges, ends.withColumn("_to", F.col("_label")), "_label", "_to")
        before, labels = labels, written(labels.join(moved, "_label", "left").select("_rid", F.coalesce("_to", "_label").alias("_label")), "labels")
        released(before, edges)
        return True

    def opened(rows: DataFrame) -> DataFrame:
        """Rows with labels, of tokens that stand in an indexed prefix and in several components."""
        own = rows.join(labels, "_rid")
        several = own.groupBy("_token").agg(F.min("_label").alias("_l"), F.max("_label").alias("_h"), F.max("_indexed").alias("_any")).where("_l < _h and _any")
        return own.join(several.select("_token"), "_token", "left_semi")

    fits = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
    for turn in range(STARS):
        first = opened(prefix.where("_place <= _p"))
        by = F.struct(F.col("_place") if turn == 0 else F.xxhash64("_rid", F.lit(turn)), "_rid", "_n")
        one = first.groupBy("_token", "_label").agg(F.min(by).alias("_m"))
        pivot = one.groupBy("_token").agg(F.min("_m").alias("_c"))
        stars = one.join(pivot, "_token").where(F.col("_m._rid") != F.col("_c._rid")).where(fits(F.col("_m._n"), F.col("_c._n"))).select(F.col("_c._rid").alias("_x"), F.col("_m._rid").alias("_y")).distinct()
        if not joined(verified(stars)):
            break

    # what is left open: pairs across components, by a rare token or by two frequent ones
    still = written(opened(prefix), "open")
    own = Window.partitionBy("_rid").orderBy("_place")
    rare = still.where(F.col("_df") <= RARE).where("_place <= _p").select("_token", "_rid", "_label", "_n", "_s", (F.col("_place") <= F.col("_i")).alias("_indexed"), F.lit(0).cast("long").alias("_before"), F.expr("_s - _at").cast("long").alias("_more"))
    after = F.struct(F.col("_token").alias("t"), F.col("_at").alias("at"), F.col("_indexed").alias("x"))
    frequent = still.where(F.col("_df") > RARE)
    pairs = [frequent.where(cond).withColumn("_after", F.collect_list(after).over(own.rowsBetween(1, gap(percent, short)))) for short, cond in ((True, f"_n * {percent} <= {SHORT * 100}"), (False, f"_n * {percent} > {SHORT * 100}"))]
    pairs = pairs[0].unionByName(pairs[1]).select("*", F.explode("_after").alias("_next"))
    combined = pairs.select(F.xxhash64("_token", "_next.t").alias("_token"), "_rid", "_label", "_n", "_s", F.col("_next.x").alias("_indexed"), F.col("_at").cast("long").alias("_before"), F.expr("_s - _next.at + 1").cast("long").alias("_more"))
    both = written(opened(rare.drop("_label")).unionByName(opened(combined.drop("_label"))), "both")
    x, y = (both.select("_token", *(F.col(c).alias(c + side) for c in ("_rid", "_label", "_n", "_s", "_before", "_more", "_indexed"))) for side in "xy")
    need = f"({percent} * (_nx + _ny) + {99 + percent}) div {100 + percent}"
    # two neighbours among the first e + 1 common tokens have less than e of these before them, e being x's extension
    able = f"least(_sx, _sy) >= {need} and least(_beforex, _beforey, {_extension('_nx')} - 1) + least(_morex, _morey) >= {need}"
    met = x.where("_indexedx").join(y, "_token").where(f"_labelx <> _labely and (_nx < _ny or _nx = _ny and _ridx < _ridy) and 100 * _nx >= {percent} * _ny and {able}")
    joined(verified(met.select(F.col("_ridx").alias("_x"), F.col("_ridy").alias("_y")).distinct()))
    released(prefix, still, both, texts)

    of = nodes.select("_n", "_sum", "_more", F.col("_node").alias("_rid"), "_name").join(labels, "_rid", "left").withColumn("_label", F.coalesce("_label", "_rid"))
    named = of.groupBy("_label").agg(F.min("_name").alias("_least"), F.min_by("_rid", F.struct("_name", "_rid")).alias("_keep"))
    out = sets.join(of.join(named, "_label").select("_n", "_sum", "_more", "_least", "_keep"), ["_n", "_sum", "_more"], "left")
    return out.select(
        "_id",
        "_row",
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_least") >= _NO_ID, None).otherwise(F.coalesce("_least", "_id")).alias("component_id"),
        F.coalesce(F.col("_rid") == F.col("_keep"), F.lit(True)).alias("_first"),
    )
