"""Sharding by balanced label propagation.

Documents with equal texts are linked. A label is a shard. Each group's
documents start spread over the shards; in each round the documents of a group
move towards the shard where most of their neighbours are, as far as that shard's
quota of free places allows, until no move is left or ``rounds`` are done. No
shard takes more linked documents than its share of rows; where a start leaves more there, the
surplus moves out after the rounds, smallest parts of groups first. Documents without a
link have no edge to cut: they fill the shards up to the law ``rows``: row
counts of any two shards differ by one at most.

Documents of a group are interchangeable, so the rounds join and move counts
(group, shard, documents), not rows: a group with a third of all rows is at
most ``shards`` such counts. Where rows need an order, it is counted within the
partitions in which they were read and added up, never in one task.

A null text has size 16 and crc 0 and is linked with nothing. Repeated rows are
rows of their own; a null id is kept as it is. Equal parts of a group: the one in the shard that a hash names stays. An empty table gives no
rows. Texts of any length are read whole, once, for their size, crc and digest. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import columns_as, running_before, written

ROUNDS, BUCKETS = 8, 1024


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = columns_as(docs, id_col, text_col)
    text = F.coalesce("_text", F.lit(""))
    found = base.select(
        "_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.when(F.col("_text").isNotNull(), F.unhex(F.md5("_text"))).alias("_group"),
        F.monotonically_increasing_id().alias("_rid"),
    )
    return written(found.withColumn("_pid", F.shiftright("_rid", 33)).withColumn("_one", F.lit(1).cast("long")), "rows")


def _propagate(cells: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """(_group, _label, _n) after the moves."""
    spark = cells.sparkSession
    cells = written(cells, "cells")
    for _ in range(rounds):
        load = cells.groupBy("_label").agg(F.sum("_n").alias("_load"))
        free = F.broadcast(  # a row for each shard
            spark.range(shards).select(F.col("id").cast("int").alias("_label")).join(load, "_label", "left").select("_label", (F.lit(capacity) - F.coalesce("_load", F.lit(0))).alias("_free"))
        )
        # a group's target: its most common shard with free places
        open_ = cells.join(free.where("_free > 0"), "_label")
        target = open_.groupBy("_group").agg(F.max_by(F.struct("_label", "_n"), F.struct("_n", F.xxhash64("_group", "_label"), "_label")).alias("_t"), F.sum("_n").alias("_size"))
        wish = cells.join(target, "_group").select("_group", "_label", "_n", F.col("_t._label").alias("_to"), F.col("_t._n").alias("_there"), "_size")
        # the larger part stays; of equals, the target does
        wish = wish.where("_to <> _label and _there >= _n")
        # groups that can be kept whole go first
        wish = wish.withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(BUCKETS)) + F.when(F.col("_size") * 8 > capacity, BUCKETS).otherwise(0))
        ranked = running_before(wish, ["_to"], "_bucket", ["_group", "_label"], "_n", "_before")
        moves = ranked.join(free.select(F.col("_label").alias("_to"), "_free"), "_to").select("_group", "_label", "_to", F.least("_n", F.greatest(F.col("_free") - F.col("_before"), F.lit(0))).alias("_moved")).where("_moved > 0")
        moves = written(moves, "moves")
        if moves.isEmpty():
            break
        out = moves.select("_group", "_label", (-F.col("_moved")).alias("_n"))
        in_ = moves.select("_group", F.col("_to").alias("_label"), F.col("_moved").alias("_n"))
        cells = written(cells.unionByName(out).unionByName(in_).groupBy("_group", "_label").agg(F.sum("_n").alias("_n")).where("_n > 0"), "cells")
    return cells


def _levelled(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """(_group, _label, _n) without surplus: parts beyond a shard's quota go to the free places of others."""
    load = {r._label: r.n for r in cells.groupBy("_label").agg(F.sum("_n").alias("n")).collect()}  # a row for each shard
    spare = [q - load.get(s, 0) for s, q in enumerate(quotas)]
    if min(spare) >= 0:
        return cells
    schema = "_label int, _from long, _over long, _to long"
    places, given = [], 0
    for s, x in enumerate(spare):  # free places are numbered over all shards, and so is the surplus
        places.append((s, given, 0, given := given + max(x, 0)))
    over, given = [], 0
    for s, x in enumerate(spare):
        over.append((s, given, max(-x, 0), given := given + max(-x, 0)))
    spark = cells.sparkSession
    shed = F.broadcast(spark.createDataFrame(over, schema).where("_over > 0"))
    order = F.least(F.log2("_n").cast("int"), F.lit(63)) * BUCKETS + F.pmod(F.xxhash64("_group"), F.lit(BUCKETS))
    parts = running_before(cells.join(shed.select("_label"), "_label").withColumn("_bucket", order), ["_label"], "_bucket", ["_group"], "_n", "_before")
    parts = parts.join(shed, "_label").withColumn("_moved", F.least("_n", F.col("_over") - F.col("_before"))).where("_moved > 0")
    parts = parts.select("_group", "_label", "_moved", (F.col("_from") + F.col("_before")).alias("_a"))
    free = F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip("sab", (s, a, b)))) for s, a, _, b in places if b > a))
    both = lambda p: F.least(p["b"], F.col("_a") + F.col("_moved")) - F.greatest(p["a"], F.col("_a"))
    to = parts.select("_group", F.explode(F.transform(F.filter(free, lambda p: both(p) > 0), lambda p: F.struct(p["s"].cast("int").alias("_label"), both(p).alias("_n")))).alias("_t")).select("_group", "_t.*")
    out = parts.select("_group", "_label", (-F.col("_moved")).alias("_n"))
    return written(cells.unionByName(out).unionByName(to).groupBy("_group", "_label").agg(F.sum("_n").alias("_n")).where("_n > 0"), "cells")


def _step(value: Column, limits: list[int]) -> Column:
    """How many of the ascending ``limits`` the value reaches."""
    return F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in limits)), lambda x: x <= value))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: _id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = _rows(docs, id_col, text_col)
    total = rows.count()
    counts = rows.where("_group is not null").groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").select("_group", "_n")
    start = F.pmod(F.xxhash64("_rid"), F.lit(shards)).cast("int").alias("_label")
    linked = written(rows.join(counts.select("_group"), "_group"), "linked")
    cells = _propagate(linked.groupBy("_group", start).agg(F.count("*").alias("_n")), shards, total // shards, rounds)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    cells = _levelled(cells, quotas)

    # the k-th document of a group goes where its k-th place is
    ends = cells.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_label", "_n"))).alias("_cells"))
    nth = running_before(linked.select("_rid", "_group", "_pid", "_one"), ["_group"], "_pid", ["_rid"], "_one", "_nth")
    walk = F.aggregate(
        "_cells",
        F.struct(F.col("_nth").alias("left"), F.lit(-1).alias("label")),
        lambda a, c: F.when(a["label"] >= 0, a).otherwise(F.struct((a["left"] - c["_n"]).alias("left"), F.when(a["left"] < c["_n"], c["_label"]).otherwise(-1).alias("label"))),
    )
    placed = nth.join(ends, "_group").select("_rid", walk["label"].alias("shard"))

    load = {r._label: r.n for r in cells.groupBy("_label").agg(F.sum("_n").alias("n")).collect()}  # a row for each shard
    limits, reached = [], 0
    for s in range(shards):
        reached += quotas[s] - load.get(s, 0)
        limits.append(reached)
    rest = rows.join(linked.select("_rid"), "_rid", "left_anti").withColumn("_all", F.lit(0))
    rest = running_before(rest, ["_all"], "_pid", ["_rid"], "_one", "_nth")
    filled = rest.select("_rid", _step(F.col("_nth"), limits).alias("shard"))
    out = rows.join(placed.unionByName(filled), "_rid")
    out = running_before(out, ["shard"], "_pid", ["_rid"], "_one", "slot")
    return out.select("_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
