"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its words, cut to ``PIECE`` bytes, and the byte n-grams of
``GRAMS`` sizes of each word with marks at both ends, hashed to ``BUCKETS``. Each bucket
has an embedding; a text is the mean of those of its features, and a linear softmax over it
gives the languages. Both are trained together by stochastic gradient descent in numpy on
the driver, over at most ``SAMPLE`` labelled rows (least hash of id first) with ``SAMPLE_BYTES`` of text together (a text of
over an eighth of these is in no sample), of whose lang and text alone it learns. A fifth of the sample is held back to fit a
temperature (calibration) and the score below which a prediction is to be rejected
(the score that ``REJECT`` of the held-back texts fall below).

To predict, embeddings and softmax weights are multiplied out to one table of
bucket x language (bounded: BUCKETS x languages floats), so a whole batch is a gather and a
mean. Whole texts are read.

Null texts and those without a letter are ``und`` with score 0. With no labelled
row at all every text is ``und``. Ties go to the first language in order. Repeated rows get equal predictions, an empty table gives no
rows. Columns of the table pass through; one that is named as a result is replaced by it, other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import U64, Words, chunks, mix, text_buffers

SAMPLE_BYTES = 64 << 20
SAMPLE, BUCKETS, DIM, GRAMS, EPOCHS, RATE, REJECT = 3000, 1 << 16, 16, (2, 3, 4), 6, 0.5, 0.005
_P = U64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each feature of a chunk."""
    w = Words(buf, offs, fold=True)
    doc = w.doc()
    buckets, docs = [(w.hash & U64(BUCKETS - 1)).astype(np.int64)], [doc]
    if not len(w):
        return buckets[0], doc
    # words with a mark at each end, laid out one behind the other
    size = w.end - w.start + 2
    first = np.cumsum(size) - size
    line = np.full(int(size.sum()), ord("<"), np.uint8)
    inner = np.repeat(w.start - first - 1, size - 2)
    spots = np.ones(len(line), bool)
    spots[first] = spots[first + size - 1] = False
    at = np.flatnonzero(spots)
    line[at] = w.buf[at + inner]
    line[first + size - 1] = ord(">")
    for n in GRAMS:
        fits = np.flatnonzero(size >= n)
        count = size[fits] - n + 1
        pos = np.arange(int(count.sum())) + np.repeat(first[fits] - (np.cumsum(count) - count), count)
        value = np.full(len(pos), n, U64)
        for k in range(n):
            value = value * U64(257) + line[pos + k]
        buckets.append((mix(value * _P) & U64(BUCKETS - 1)).astype(np.int64))
        docs.append(np.repeat(doc[fits], count))
    return np.concatenate(buckets), np.concatenate(docs)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: calibrated logits of a feature
    bias: np.ndarray
    reject_below: float = 0.0
    losses: list[float] = field(default_factory=list)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities (documents x languages); equal ones where a text has no feature."""
        n = len(offs) - 1
        bucket, doc = features(buf, offs)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        logit = np.stack([np.bincount(doc, self.table[bucket, k], n) / count + self.bias[k] for k in range(len(self.langs))], 1)
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Train on labelled texts."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        buf, offs = text_buffers(pa.array([t]))
        b, n = np.unique(features(buf, offs)[0], return_counts=True)
        bags.append((b, n / max(1, n.sum())))
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(held):
        held = train
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    losses, step, steps = [], 0, max(1, epochs * len(train))
    for _ in range(epochs):
        loss = 0.0
        for i in rng.permutation(train):
            b, n = bags[i]
            if not len(b):
                continue
            lr = rate * (1 - step / steps)
            step += 1
            h = n @ emb[b]
            p = _softmax(h @ out + bias)
            loss -= np.log(max(p[y[i]], 1e-12))
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * p
            emb[b] -= lr * np.outer(n * len(b) ** 0.5, back)
        losses.append(loss / max(1, len(train)))
    logits = np.stack([n @ emb[b] @ out + bias if len(b) else bias for b, n in (bags[i] for i in held)])
    grid = np.geomspace(0.05, 20, 60)
    nll = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    heat = grid[int(np.argmin(nll))]
    top = _softmax(logits / heat).max(1)
    return Model(names, emb @ out / heat, bias / heat, float(np.quantile(top, REJECT)), losses)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` rows with a language and a text; None if there is none."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l"), F.xxhash64(f"`{id_col}`").alias("h"), F.col(f"`{id_col}`").alias("i"))
    size = F.octet_length("t").cast("long")
    rows = rows.where("t is not null and l is not null").where(size <= SAMPLE_BYTES // 8)
    n = rows.count()
    if n > 2 * sample:  # a share of the hashes first, so that no partition sends more than its part of the sample
        rows = rows.where(F.pmod("h", F.lit(1 << 31)) < int((1 << 31) * 1.3 * sample / n))
    order = [F.pmod("h", F.lit(1 << 31)), F.col("h"), F.col("i"), F.col("t")]
    first = rows.orderBy(*order).limit(sample)
    together = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample's rows alone
    got = first.withColumn("_bytes", together).where(F.col("_bytes") <= SAMPLE_BYTES).select("t", "l").collect()
    return fit([r.t for r in got], [r.l for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score and accepted (the score is not below the rejection bound)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    has_letter: Column = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    src = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), has_letter.alias("letter"))  # by place, so that no name clashes
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(at))
            letter = b.column(len(names)).to_numpy(zero_copy_only=False)
            for i, j in chunks(offs, 1 << 20):
                seen = letter[i:j]
                if model is None:
                    best, top = np.zeros(j - i, int), np.zeros(j - i)
                    seen = np.zeros(j - i, bool)
                else:
                    p = model.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    best, top = p.argmax(1), p.max(1)
                lang = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, seen)]
                top = np.where(seen, np.clip(top, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(len(names))), pa.array(lang, pa.string()), pa.array(top), pa.array(seen & (top >= (model.reject_below if model else 0)))], [*names, "lang_pred", "score", "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return src.mapInArrow(run, kinds + ", lang_pred string, score double, accepted boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "utf-8")) % 5 == 0, F.lit(False))
