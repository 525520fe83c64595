"""Lexical retrieval packing: windows of tokens filled with a seed document and its neighbours.

Documents lie in shards: the partitions in which they are read, cut further at ``SHARD_BYTES`` of text (a longer text is
a shard of its own), whatever the size of an Arrow batch. A seed asks its own shard alone, so
better neighbours in other shards are out of its reach. Each shard has its own BM25 inverted index: terms are words
hashed to ``TERMS`` buckets, weighted by their number of documents over the whole
corpus (one count for each bucket, a bounded table). The shard's next unused document is the
seed of a window; all its terms are looked up in the index over their whole lists, and the
unused documents of best score follow it until the window is full. What does not
fit is cut and opens the next window, whose seed it then is. So every window
but a shard's last is full. Lists of terms in over a ``DENSE``-th of the
shard's documents lie as rows of a matrix; used documents leave the index when they are half of it. Where the
neighbours run out, the next unused documents in order fill the window.

A shard is one task's work and its memory is bounded by ``SHARD_BYTES`` and its longest
text; nothing is shuffled but the term counts.

A null text is empty and has the end id alone; a null id is kept. Repeated rows are packed as often as they
occur. Ties in score go to the earlier row. An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns_as
from ._text import U64, Words, chunks, give_back, text_buffers
from ._tokens import encoder

WINDOW, TERMS, SHARD_BYTES, DENSE, FIRST = 1024, 1 << 16, 8 << 20, 8, 256
_K1, _B = 1.2, 0.75


def _doc_terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) of a chunk in that order, and how often each occurs."""
    w = Words(buf, offs, fold=True)
    key = w.doc() * TERMS + (w.hash & U64(TERMS - 1)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key // TERMS, key % TERMS, n


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS + 1, np.int64)
    for b in batches:
        buf, offs = text_buffers(b.column(0))
        total[TERMS] += b.num_rows
        for i, j in chunks(offs):
            total[:TERMS] += np.bincount(_doc_terms(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1], minlength=TERMS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])


def term_weights(texts: DataFrame) -> np.ndarray:
    """BM25's idf of each term bucket over all documents."""
    df = np.zeros(TERMS + 1)
    for r in texts.mapInArrow(_count_terms, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most TERMS + 1 rows
        df[r.term] = r.n
    n, df = df[TERMS], df[:TERMS]
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


class Index:
    """BM25 inverted index of a shard, with the documents' terms for seeds."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, n_docs: int, idf: np.ndarray):
        length = np.bincount(doc, n, n_docs)
        norm = _K1 * (1 - _B + _B * length / max(1.0, length.mean() if n_docs else 1.0))
        score = (idf[term] * n * (_K1 + 1) / (n + norm[doc])).astype(np.float32)
        self.first, self.term = np.searchsorted(doc, np.arange(n_docs + 1)), term
        self.used = np.zeros(n_docs, bool)
        self.live = np.arange(n_docs)  # the documents in the lists, which hold places in it
        order = np.argsort(term, kind="stable")
        doc, score, term = doc[order], score[order], term[order]
        n_of = np.bincount(term, minlength=TERMS)
        hot = np.flatnonzero(n_of > n_docs / DENSE)
        self.row = np.full(TERMS, -1)
        self.row[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), n_docs), np.float32)
        is_hot = self.row[term] >= 0
        self.dense[self.row[term[is_hot]], doc[is_hot]] = score[is_hot]
        self._lists(doc[~is_hot], term[~is_hot], score[~is_hot])

    def _lists(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray) -> None:
        self.doc, self.list_term, self.by_term = doc, term, score
        self.list_first = np.searchsorted(term, np.arange(TERMS + 1))

    def _shrink(self) -> None:
        """Take used documents out of the lists, when they are half of them."""
        keep = ~self.used[self.live]
        n = np.count_nonzero(keep)
        if 2 * n > len(keep):
            return
        place, left = np.cumsum(keep) - 1, keep[self.doc]
        self.live, self.dense = self.live[keep], self.dense[:, keep]
        self._lists(place[self.doc[left]], self.list_term[left], self.by_term[left])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document of ``live`` for the seed's terms."""
        self._shrink()
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        rows = self.row[terms]
        terms = terms[rows < 0]
        total = np.add.reduce(self.dense[rows[rows >= 0]], axis=0)
        begin = self.list_first[terms]
        n = self.list_first[terms + 1] - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return total + np.bincount(self.doc[at], self.by_term[at], len(self.live))

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first."""
        total = self.scores(seed)
        found = np.flatnonzero((total > 0) & ~self.used[self.live])
        total = total[found]
        least = np.partition(total, -FIRST)[-FIRST] if len(total) > FIRST else 0
        for part in (total >= least, total < least):  # mostly the first are enough
            at = np.flatnonzero(part)
            for k in at[np.argsort(-total[at], kind="stable")]:
                yield int(self.live[found[k]])


def pack(index: Index, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of all pieces."""
    out: list[tuple[int, int, int, int, int]] = []
    done = np.zeros(len(sizes), np.int64)
    sequence = offset = after = 0

    def put(d: int) -> None:
        nonlocal sequence, offset
        index.used[d] = True
        n = min(int(sizes[d] - done[d]), window - offset)
        out.append((d, int(done[d]), n, sequence, offset))
        done[d] += n
        offset += n
        if offset == window:
            sequence, offset = sequence + 1, 0

    open_doc = None
    while True:
        if open_doc is None:
            while after < len(sizes) and index.used[after]:
                after += 1
            if after == len(sizes):
                break
            open_doc = after
        seed, open_doc = open_doc, None
        put(seed)
        while done[seed] < sizes[seed]:  # only at a window's start: whole windows of its own
            put(seed)
        if offset:
            for d in index.neighbours(seed):
                put(d)
                if done[d] < sizes[d]:
                    open_doc = d
                    break
                if not offset:
                    break
    return np.array(out, np.int64).reshape(-1, 5)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows (id, text) of a partition in runs of ``SHARD_BYTES`` of text at most, one row at least: ids, bytes, offsets."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def shard() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        sizes = np.concatenate([np.diff(o) for _, _, o in held])
        return pa.concat_arrays([i for i, _, _ in held]), np.concatenate([t for _, t, _ in held]), np.concatenate([[0], np.cumsum(sizes)])

    for b in batches:
        buf, offs = text_buffers(b.column(1))
        k = 0
        while k < b.num_rows:
            j = int(np.searchsorted(offs, offs[k] + SHARD_BYTES - size, "right")) - 1
            if j <= k:
                if held:
                    yield shard()
                    held, size = [], 0
                    continue
                j = k + 1
            j = min(j, b.num_rows)
            held.append((b.column(0)[k:j], buf[offs[k] : offs[j]], offs[k : j + 1] - offs[k]))
            size += int(offs[j] - offs[k])
            k = j
    if held:
        yield shard()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    with_ids: and ids (array). A sequence has at most ``window`` ids; a shorter one is to be padded.
    """
    base = columns_as(docs, id_col, text_col)
    idf = term_weights(base.select("_text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first_sequence = encoder(tokenizer, keeps_space=True), TaskContext.get().partitionId() << 33
        for doc_ids, buf, offs in _shards(batches):
            parts, terms, at = [], [], 0
            for x, y in chunks(offs):
                own, cut = buf[offs[x] : offs[y]], offs[x : y + 1] - offs[x]
                ids, bounds = enc.encode(own, cut)
                parts.append((np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1))
                d, t, n = _doc_terms(own, cut)
                terms.append((d + at, t, n))
                at += y - x
            ids, sizes = (np.concatenate(x) for x in zip(*parts))
            pieces = pack(Index(*(np.concatenate(x) for x in zip(*terms)), len(doc_ids), idf), sizes, window)
            begin = (np.cumsum(sizes) - sizes)[pieces[:, 0]] + pieces[:, 1]
            raw = ids.astype("<u4")
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(begin.tolist(), pieces[:, 2].tolist())]
            cols = [doc_ids.take(pa.array(pieces[:, 0])), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(sizes[pieces[:, 0]]), pa.array(pieces[:, 3] + first_sequence), pa.array(pieces[:, 4])]
            if with_ids:
                cols.append(pa.array([raw[s : s + n] for s, n in zip(begin.tolist(), pieces[:, 2].tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)
            first_sequence += int(pieces[:, 3].max(initial=-1)) + 1
        give_back()

    return base.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
