"""Substring dedup: matching statistics against suffix automata of reference shards.

A window is ``length`` consecutive words. A word goes if a window over it also
starts in a document with a smaller id; windows are judged on the input.

Plan
1. Exact copies: grouped by digest. A copy of a document with a smaller id is
   covered by earlier windows wholly, so only the first of each text goes on.
2. Fingerprints: of the ``k``-word shingles in a window the least hash is kept
   (winnowing). Equal windows have equal fingerprints, so a window repeats only
   if its fingerprint is in two documents. One aggregation finds those; the
   group of a fingerprint is the smallest document that holds it.
3. Reference shards: the stretches of words whose windows have repeated
   fingerprints go to their group's shard, equal stretches once. In a shard,
   groups are handled one by one in order of doc id: a stretch is streamed
   through the group's suffix automaton, which gives for each word the longest
   match ending there (matching statistics), and each match of ``length`` words
   or more is a maximal span to remove. What no match covers is then added.
4. Spans are gathered by document and cut out.

Two documents that share a window share its fingerprint and so its group:
nothing is lost. Fingerprints in more than ``hot`` documents would make large
groups; their windows are dealt out in runs of ``RUN`` starts, counted from the
fingerprint's place, by the words that all windows of a run hold. Equal windows
lie at the same distance from their fingerprint, so they still meet, and stretches
that go on differently part. Beyond ``VERY_HOT`` documents runs are single
windows, which meet only their equals. Shards are sent only the stretches that
need them, so no broadcast grows with the corpus.

Nulls: a null text has no words; a row with a null id is kept unchanged.
Rows that repeat an id are judged against other ids only. Of equal windows the one in the smallest id stays, all others go. An empty
table gives no rows. Texts of any length are read whole. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns_as, written
from ._text import U64, Words, chunks, mix, shingles, sliding_min, text_buffers

#: Words in a fingerprint's shingle, and the number of documents from which a fingerprint is hot.
SHINGLE, HOT = 20, 128
#: Windows dealt out together when hot, and the number of documents from which they go one by one.
RUN, VERY_HOT = 10, 50_000


class SuffixAutomaton:
    """Suffix automaton over word numbers; several sequences may be added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for c in sequence:
            p = last
            if c in nxt[p]:  # a sequence after the first may walk along what is there
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    last = q
                    continue
                last = self._clone(p, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def spans(self, sequence, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Union of all matches of ``least`` words or more, as ranges of positions; and the
        ranges over windows of ``least`` words that did not match."""
        nxt, link, length = self.next, self.link, self.len
        out: list[tuple[int, int]] = []
        rest: list[tuple[int, int]] = []
        state = have = 0
        for i, c in enumerate(sequence):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                have = length[state]
                to = nxt[state].get(c)
            if to is None:
                have = 0
            else:
                state, have = to, have + 1
            if have >= least:
                if out and i + 1 - have <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - have), i + 1)
                else:
                    out.append((i + 1 - have, i + 1))
            elif i + 1 >= least:
                if rest and rest[-1][1] == i:
                    rest[-1] = (rest[-1][0], i + 1)
                else:
                    rest.append((i + 1 - least, i + 1))
        return out, rest


def _fingerprints(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(1))
            for i, j in chunks(offs):
                w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                least = sliding_min(shingles(w.hash, k), length - k + 1)
                out = []
                for a, e in zip(w.first[:-1], w.first[1:]):
                    own = least[a : e - length + 1] if e - a >= length else least[:0]
                    out.append(np.unique(own).view(np.int64) if len(own) else own.view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(2)[i:j], b.column(3)[i:j], lists], ["_id", "_row", "_sum", "_prints"])

    return run


def _stretches(length: int, k: int):
    """Rows of documents with their repeated fingerprints -> stretches for the shards."""
    run_of_hot = min(RUN, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(2))
            cand = b.column(3)
            for i, j in chunks(offs):
                w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                grams = shingles(w.hash, k)
                least = sliding_min(grams, length - k + 1)
                shared = {r: shingles(w.hash, length - r + 1) for r in (run_of_hot, 1)}
                rows: list[list] = [[] for _ in range(7)]
                for d in range(i, j):
                    a, e = w.first[d - i], w.first[d - i + 1]
                    if e - a < length:
                        continue
                    c = cand[d].values
                    prints = c.field(0).to_numpy(zero_copy_only=False).view(U64)
                    order = np.argsort(prints)
                    prints, group, hot = prints[order], c.field(1).to_numpy(zero_copy_only=False)[order], c.field(2).to_numpy(zero_copy_only=False)[order]
                    mine: dict[tuple, list[int]] = {}
                    own = least[a : e - length + 1]
                    at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
                    known = prints[at] == own
                    is_hot = known & (hot[at] > 0)
                    s = np.flatnonzero(is_hot)
                    if len(s):  # runs of windows: place of the fingerprint, then distance from it
                        place = s + np.lib.stride_tricks.sliding_window_view(grams[a : e - k + 1], length - k + 1)[s].argmin(1)
                        step = np.where(hot[at][s] > 1, 1, run_of_hot)
                        nth = (place - s) // step
                        new = np.flatnonzero(np.r_[True, (np.diff(s) != 1) | (np.diff(place) != 0) | (np.diff(nth) != 0) | (np.diff(step) != 0)])
                        for x, y in zip(new, np.r_[new[1:], len(s)]):
                            common = shared[int(step[x])][a + place[x] - nth[x] * step[x]]
                            own_group = mix(np.array([common ^ U64(nth[x])]))[0].view(np.int64)
                            stretch(mine, w, a, int(s[x]), int(s[y - 1]) + length, int(own_group), True)
                    # one stretch for each group: its windows, those less than a window apart joined
                    cold = np.flatnonzero(known & ~is_hot)
                    if len(cold):
                        g = group[at[cold]]
                        by = np.lexsort((cold, g))
                        cold, g = cold[by], g[by]
                        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (np.diff(cold) >= length)])
                        for x, y in zip(new, np.r_[new[1:], len(cold)]):
                            stretch(mine, w, a, int(cold[x]), int(cold[y - 1]) + length, int(g[x]), False)
                    for (group_of, is_it_hot, text), places in mine.items():
                        for to, x in zip(rows, (b.column(0)[d].as_py(), b.column(1)[d].as_py(), group_of, is_it_hot, places, len(text.split()), text)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.binary()))],
                    ["_id", "_row", "_group", "_hot", "_at", "_n", "_words"],
                )

    def stretch(mine: dict, w: Words, a: int, s: int, e: int, group: int, hot: bool) -> None:
        """A text that repeats its stretches gives each once, with all its places."""
        text = b" ".join(w.buf[w.start[a + s] : w.end[a + e - 1]].tobytes().split())
        mine.setdefault((group, hot, text), []).append(s)

    return run


def _shard(length: int):
    """Stretches sorted by group and first document -> spans matched in an earlier document."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        numbers: dict[bytes, int] = {}
        automaton, i = SuffixAutomaton(), 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][2] == rows[i][2]:
                j += 1
            later = []
            for r in rows[i:j]:  # one document's stretches do not match each other
                seq = [numbers.setdefault(x, len(numbers)) for x in r[4].split()]
                spans, rest = automaton.spans(seq, length) if i else ([], [(0, len(seq))])
                if spans:
                    yield r[0], r[1], r[3], spans
                later += [seq[s:e] for s, e in rest]
            if j < len(rows):
                for part in later:
                    automaton.add(part)
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.binary()), pa.array([[{"s": s, "e": e} for s, e in o[3]] for o in out], kind)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["_group", "_hot", "_key", "_spans"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in range(5))):
                if held and held[0][:2] != r[:2]:
                    if len(held) > 1:
                        out.extend(group(held))
                    held = []
                held.append(r)
                if len(out) >= 4096:
                    yield batch()
        if len(held) > 1:
            out.extend(group(held))
        yield batch()

    return run


def _cut(length: int):
    """Documents with their spans -> digests of what is kept, and the text without the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(2))
            spans, copy = b.column(3), b.column(4)
            for i, j in chunks(offs):
                w = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], hashed=False)
                n, gone, digest, left, ranges = [], [], [], [], []
                for d in range(i, j):
                    a, e = int(w.first[d - i]), int(w.first[d - i + 1])
                    text = w.buf[w.offs[d - i] : w.offs[d - i + 1]].tobytes()
                    cut = np.zeros(e - a + 1, np.int32)
                    if copy[d].as_py() and e - a >= length:
                        cut[0] += 1
                        cut[-1] -= 1
                    elif spans[d].is_valid:
                        for x in spans[d].as_py():
                            cut[x["s"]] += 1
                            cut[x["e"]] -= 1
                    removed = np.cumsum(cut[:-1]) > 0
                    n.append(e - a)
                    gone.append(int(removed.sum()))
                    if not gone[-1]:
                        digest.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                        left.append(text)
                        ranges.append([])
                        continue
                    words = text.split()
                    digest.append(hashlib.sha256(b" ".join([words[x] for x in np.flatnonzero(~removed)])).hexdigest())
                    edge = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
                    ranges.append([{"s": int(x), "e": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    base, parts, at = w.offs[d - i], [], 0
                    for x, y in zip(edge[::2], edge[1::2]):  # a span goes with the white space behind it
                        parts.append(text[at : w.start[a + x] - base])
                        at = w.start[a + y] - base if a + y < e else len(text)
                    parts.append(text[at:])
                    left.append(b"".join(parts))
                kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                cols = [b.column(0)[i:j], b.column(1)[i:j], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary()).cast(pa.string()), pa.array(ranges, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_row", "n_words", "n_removed", "kept_sha256", "_kept", "_ranges"])

    return run


_SPANS = "array<struct<s:int,e:int>>"


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: _id, _row (hash of the text), n_words, n_removed,
    kept_sha256, _kept (the text without the removed spans) and _ranges (of removed words).
    """
    k = min(shingle, length)
    base = columns_as(docs, id_col, text_col)
    keyed = base.withColumn("_row", F.xxhash64(F.coalesce("_text", F.lit(""))))
    prints = written(
        keyed.where("_id is not null and _text is not null").select("_id", "_text", "_row", F.unhex(F.md5("_text")).alias("_sum")).mapInArrow(_fingerprints(length, k), "_id long, _row long, _sum binary, _prints array<long>").where(F.size("_prints") > 0),
        "prints",
    )
    first = prints.groupBy("_sum").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"))
    copies = prints.select("_id", "_row", "_sum").join(first.where("_copies > 1"), "_sum").where("_id > _first").select("_id", "_row", F.lit(True).alias("_copy")).distinct()
    # of equal texts the first document only; a row that repeats another wholly changes nothing
    single = prints.join(first.select("_sum", F.col("_first").alias("_id")), ["_sum", "_id"], "left_semi")
    rows = single.select("_id", "_row", F.explode("_prints").alias("_print"))
    repeated = rows.groupBy("_print").agg(F.min("_id").alias("_group"), F.max("_id").alias("_last"), F.count("*").alias("_docs")).where("_group < _last")
    wanted = rows.join(repeated.select("_print", "_group", ((F.col("_docs") > hot).cast("int") + (F.col("_docs") > VERY_HOT).cast("int")).alias("_hot")), "_print").groupBy("_id", "_row").agg(F.collect_list(F.struct("_print", "_group", "_hot")).alias("_cand"))
    # the rows with an id are dealt once: both joins below take the same shuffle of them
    dealt = keyed.where("_id is not null")
    stretches = (
        dealt.join(wanted, ["_id", "_row"])
        .select("_id", "_row", "_text", "_cand")
        .mapInArrow(_stretches(length, k), "_id long, _row long, _group long, _hot boolean, _at array<int>, _n int, _words binary")
        .withColumn("_key", F.unhex(F.md5("_words")))
    )
    distinct = stretches.groupBy("_group", "_hot", "_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.min("_words").alias("_words"))
    matched = (
        distinct.select("_group", "_hot", "_first", "_key", "_words")
        .repartition("_group", "_hot")
        .sortWithinPartitions("_group", "_hot", "_first", "_key")
        .mapInArrow(_shard(length), f"_group long, _hot boolean, _key binary, _spans {_SPANS}")
    )
    judged = distinct.select("_group", "_hot", "_key", "_first", "_last").join(matched, ["_group", "_hot", "_key"], "left").where("_first < _last or size(_spans) > 0")
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("_n").alias("e")))
    spans = (
        stretches.select("_id", "_row", "_group", "_hot", "_key", "_at", "_n")
        .join(judged, ["_group", "_hot", "_key"])
        .withColumn("_spans", F.when(F.col("_id") > F.col("_first"), whole).otherwise(F.coalesce("_spans", F.array().cast(_SPANS))))
        .select("_id", "_row", F.flatten(F.transform("_at", lambda at: F.transform("_spans", lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"))))).alias("_spans"))
        .groupBy("_id", "_row")
        .agg(F.flatten(F.collect_list("_spans")).alias("_spans"))
    )
    found = dealt.join(spans, ["_id", "_row"], "left").join(copies, ["_id", "_row"], "left")
    unnamed = keyed.where("_id is null").select("*", F.lit(None).cast(_SPANS).alias("_spans"), F.lit(None).cast("boolean").alias("_copy"))
    return (
        found.unionByName(unnamed)
        .select("_id", "_row", "_text", "_spans", F.coalesce("_copy", F.lit(False)).alias("_copy"))
        .mapInArrow(_cut(length), f"_id long, _row long, n_words long, n_removed long, kept_sha256 string, _kept string, _ranges {_SPANS}")
    )
