"""Token ids in a binary file format: canonical length-limited Huffman codes of ids.

Writing: texts are tokenized once into a scratch table; ids are counted over
all documents (at most one row for each id of the vocabulary reaches the
driver); package-merge gives code lengths of at most ``MAX_LENGTH`` bits; ids are dealt
by range of doc id, sorted and coded in blocks of whole documents.

Format: a Parquet folder ``blocks`` of (part, block, first_doc, start,
n_tokens, payload) and a folder ``codes`` of (id, length), from which the
canonical codes follow. ``start`` counts the ids before the block in its part.
A payload, little-endian: b"SKH1", documents n, ids m, checkpoint distance c
(3 uint32); n doc ids (int64; the least value: null); n id counts (uint32);
ceil(m / c) bit offsets (uint32), one for each c ids; then the bits, most
significant first. Blocks decode independently, and within one so does each
stretch between checkpoints, so all stretches of a batch are decoded in step
by table look-up.

Null text: no ids but the end id. Null doc ids come last. Ties by id go by content; repeated rows are written as often as they
occur. Texts of any length are encoded whole. An empty table gives a file without blocks, and reading it no rows. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns_as, shared_dir, written
from ._text import chunks, text_buffers
from ._tokens import encoder

MAX_LENGTH, BLOCK_IDS, CHECKPOINT = 18, 1 << 16, 256
_NO_ID = np.iinfo(np.int64).min
_BLOCKS = "part int, block int, first_doc long, start long, n_tokens long, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count (package-merge); else 0."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    n = len(ids)
    if n < 2:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    own = counts[order].astype(np.int64)
    row, leaf_rows = own, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        leaf_rows.append(at < n)
    take = 2 * n - 2
    for leaf in reversed(leaf_rows):
        leaves = int(leaf[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code = (code + len(ids)) << 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes in a row, and the bit offset of each id."""
    size = lengths[ids].astype(np.int64)
    stop = np.cumsum(size)
    at = stop - size
    if not len(ids):
        return b"", at
    code, word, over = codes[ids], at >> 6, (at & 63) + size - 64
    first = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(stop[-1] >> 6) + 1, np.uint64)
    out[word[begin]] = np.bitwise_or.reduceat(first, begin)
    spill = np.flatnonzero(over > 0)
    out[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(stop[-1] + 7) >> 3], at


class Decoder:
    """Table look-up of codes by their first MAX_LENGTH bits."""

    def __init__(self, lengths: np.ndarray):
        limit = self.limit = max(1, int(lengths.max(initial=0)))
        codes = canonical_codes(lengths)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spread = np.left_shift(1, limit - lengths[order].astype(np.int64))
        self.symbol, self.size = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
        self.symbol[: spread.sum()], self.size[: spread.sum()] = np.repeat(order, spread), np.repeat(lengths[order], spread)
        assert len(order) == 0 or int(codes[order[0]]) == 0

    def ids(self, bits: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Decode counts[i] ids from bit offsets[i] on, all stretches in step."""
        b = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        steps = int(counts.max(initial=0))
        out = np.zeros((steps, len(offsets)), np.uint32)
        order = np.argsort(-counts, kind="stable")
        pos, left = offsets[order].astype(np.int64), counts[order]
        mask = np.uint32((1 << self.limit) - 1)
        for k in range(steps):
            live = int(np.searchsorted(-left, -k, "left"))
            p = pos[:live]
            peek = (window[p >> 3] >> (32 - self.limit - (p & 7)).astype(np.uint32)) & mask
            out[k, :live] = self.symbol[peek]
            pos[:live] += self.size[peek]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        rows = out.T[back]
        return rows[np.arange(steps)[None, :] < counts[:, None]]


def block_payload(doc_ids: list, parts: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    bits, at = pack_bits(ids, codes, lengths)
    return b"".join([
        b"SKH1",
        np.array([len(parts), len(ids), CHECKPOINT], "<u4").tobytes(),
        np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([len(p) for p in parts], "<u4").tobytes(),
        at[::CHECKPOINT].astype("<u4").tobytes(),
        bits,
    ])


def read_payloads(payloads: list[bytes], decoder: Decoder) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, id counts, ids) of each block."""
    heads, bits, offsets, counts, base = [], [], [], [], 0
    for p in payloads:
        if p[:4] != b"SKH1":
            raise ValueError("not a block of token ids")
        n, m, c = np.frombuffer(p, "<u4", 3, 4)
        n, m, c, at = int(n), int(m), int(c), 16
        docs = np.frombuffer(p, "<i8", n, at)
        sizes = np.frombuffer(p, "<u4", n, at + 8 * n)
        k = -(-m // c)
        marks = np.frombuffer(p, "<u4", k, at + 12 * n).astype(np.int64)
        raw = np.frombuffer(p, np.uint8, -1, at + 12 * n + 4 * k)
        own = np.full(k, c, np.int64)
        if k:
            own[-1] = m - c * (k - 1)
        heads.append((docs, sizes, m))
        bits.append(raw)
        offsets.append(marks + 8 * base)
        counts.append(own)
        base += len(raw)
    ids = decoder.ids(np.concatenate(bits), np.concatenate(offsets), np.concatenate(counts))
    stops = np.cumsum([m for *_, m in heads])
    return [(d, s, ids[e - m : e]) for (d, s, m), e in zip(heads, stops)]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space=False)
        for b in batches:
            buf, offs = text_buffers(b.column(1))
            for i, j in chunks(offs):
                ids, bounds = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                whole = np.insert(ids, bounds[1:], end_id).astype("<u2")
                cut = 2 * (bounds + np.arange(len(bounds)))
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], packed], ["_id", "_ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        buf, _ = text_buffers(b.column(0))
        total += np.bincount(np.frombuffer(buf.tobytes(), "<u2"), minlength=1 << 16)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], ["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = canonical_codes(lengths), TaskContext.get().partitionId()
        held: tuple[list, list[np.ndarray]] = ([], [])
        size = block = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, block, start
            row = [[part], [block], [held[0][0]], [start], [size], [block_payload(*held, codes, lengths)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "block", "first_doc", "start", "n_tokens", "payload"])
            block, start, size = block + 1, start + size, 0
            held[0].clear()
            held[1].clear()
            return out

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                if held[0] and size + len(ids) > BLOCK_IDS:
                    yield flush()
                held[0].append(d)
                held[1].append(ids)
                size += len(ids)
        if held[0]:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all texts, ``end_id`` behind each, in ascending order of id; the folder's path."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    ids = written(columns_as(docs, id_col, text_col).mapInArrow(_tokenize(tokenizer, end_id), "_id long, _ids binary"), "ids")
    counts = np.zeros(1 << 16, np.int64)
    for r in ids.select("_ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    present = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in present], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    ordered = ids.withColumn("_tie", F.xxhash64("_ids"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    order = [F.col("_id").asc_nulls_last(), F.col("_tie")]
    ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_ids").mapInArrow(_encode(lengths), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; with_ids: and ids (array)."""
    codes = spark.read.schema("id int, length int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max([r.id for r in codes], default=0) + 1, np.uint8)
    for r in codes:
        lengths[r.id] = r.length
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one total for each part: as many as the writer had partitions
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r.part], total = total, total + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in batches:
            for k in range(0, b.num_rows, 16):
                rows = b.slice(k, 16)
                for part, start, (docs, sizes, ids) in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), read_payloads(rows.column(2).to_pylist(), decoder)):
                    stop = np.cumsum(sizes.astype(np.int64))
                    raw = ids.astype("<u4")
                    view = memoryview(raw).cast("B") if len(raw) else b""
                    crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), stop.tolist())]
                    cols = [pa.array([None if d == _NO_ID else d for d in docs.tolist()], pa.int64()), pa.array(base[part] + start + stop - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("part", "start", "payload").mapInArrow(run, kinds)
