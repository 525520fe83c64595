"""Line-first cleaning: judge each line, remove failures, then reject documents losing too much.

Line rules, on \\n-split lines that hold a word:

* punctuation: a line of ``min_line_words`` words or more fails if neither it
  nor a sentence in it ends in closing punctuation; so does a line in which
  symbol characters reach ``max_symbol_ratio`` of its words, or one mostly in
  capitals.
* navigation: separators (words such as | or >) between most of its words.
* boilerplate: a licence, rights or consent phrase in a short line.

A document is rejected if its base test fails (fewer than ``min_words`` words,
or over half of its words in repeated 3-word windows), or if the failed lines
hold more than ``max_lost`` of its words.

A null or empty text has no words, so its base test fails. Long texts, ties
and repeated rows need no care: each row is judged by itself, whole, in one narrow
stage without a shuffle. An empty table gives no rows. A column that is named as a figure is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, U64, Words, chunks, mix, shingles, span_hash, text_buffers, utf8_lengths

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that may end a finished line; bytes over 127 end it too (closing quotes, ellipses, other scripts' stops).
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?:;,\"')]}-")] = True
_CLOSING[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_SEPARATORS = (b"|", b">", b">>", "»".encode(), "•".encode(), "·".encode(), b"/")
#: Phrases of licences, rights, consent and page furniture.
_BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "is licensed", "terms of use", "terms of service", "privacy policy", "cookie",
    "copyright (c)", "subscribe to our", "sign up for", "log in to", "click here", "enable javascript", "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    min_line_words: int = 8
    max_symbol_ratio: float = 0.1
    max_separator_ratio: float = 0.25
    max_capital_ratio: float = 0.7
    max_boilerplate_words: int = 20
    max_lost: float = 0.5


def _before(marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def judge(buf: np.ndarray, offs: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each document; then start, end and verdict (True: fails) of each line."""
    w = Words(buf, offs)
    n_words = w.counts()
    points = utf8_lengths(buf)
    symbols = _before(_SYMBOL[buf])
    per_word = np.zeros(len(w) + 1, np.int64)
    np.cumsum(points[w.end] - points[w.start], out=per_word[1:])

    # three-word windows found twice or more in their document
    doc = w.doc()
    covered = np.zeros(len(w) + 2, bool)
    tri = shingles(w.hash, 3)
    if len(tri):
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        own = mix(tri[inside] ^ mix(doc[inside].astype(U64) + U64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        twice = inside[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else inside
        for k in range(3):
            covered[twice + k] = True
    repeat = np.zeros(len(w) + 1, np.int64)
    np.cumsum(covered[: len(w)], out=repeat[1:])

    # lines
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.r_[offs[:-1], breaks + 1])
    begin = begin[begin < len(buf)] if len(buf) else begin[:0]
    line_doc = np.searchsorted(offs, begin, "right") - 1
    stop = np.r_[begin[1:], len(buf)][: len(begin)]
    stop = stop - ((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    a, e = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    size = e - a
    full = size > 0
    dup = np.zeros(len(begin), bool)
    if full.any():
        lines = np.flatnonzero(full)
        key = mix(span_hash(buf, begin[lines], stop[lines]) ^ mix(line_doc[lines].astype(U64) + U64(7)))
        order = np.argsort(key, kind="stable")
        dup[lines[order[1:][key[order][1:] == key[order][:-1]]]] = True

    upper = _before(((buf >= 65) & (buf <= 90)))
    letter = _before(((buf | 32) >= 97) & ((buf | 32) <= 122))
    last = buf[w.end[np.maximum(e - 1, 0)] - 1] if len(w) else np.zeros(len(begin), np.uint8)
    stops = _before(_STOP[buf[w.end - 1]])
    wide = np.flatnonzero(w.end - w.start <= 3)
    words_short = np.zeros(len(w), bool)
    for sep in _SEPARATORS:
        hit = wide[(w.end - w.start)[wide] == len(sep)]
        for k, c in enumerate(sep):
            hit = hit[buf[w.start[hit] + k] == c]
        words_short[hit] = True
    separators = _before(words_short)
    phrase = np.zeros(len(begin), bool)
    if len(begin):
        at, folded = [], LOWER[buf].tobytes()
        for p in map(str.encode, _BOILERPLATE):
            x = folded.find(p)
            while x >= 0:
                at.append(x)
                x = folded.find(p, x + len(p))
        phrase[np.searchsorted(begin, np.array(at, np.int64), "right") - 1] = True
    n_sym, n_let = symbols[stop] - symbols[begin], letter[stop] - letter[begin]
    fails = full & (
        ((size >= rules.min_line_words) & ~_CLOSING[last] & (stops[e] == stops[a]))
        | (n_sym >= np.maximum(1, rules.max_symbol_ratio * size))
        | ((n_let >= 12) & (upper[stop] - upper[begin] > rules.max_capital_ratio * n_let))
        | ((separators[e] - separators[a] >= 2) & (separators[e] - separators[a] >= rules.max_separator_ratio * size))
        | (phrase & (size <= rules.max_boilerplate_words))
    )
    per_doc = lambda x: np.bincount(line_doc, x, w.n_docs).astype(np.int64)
    lost = per_doc(size * fails)
    f = w.first
    figures = {
        "n_words": n_words,
        "word_chars": per_word[f[1:]] - per_word[f[:-1]],
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": per_doc(dup),
        "n_repeat_words": repeat[f[1:]] - repeat[f[:-1]],
        "n_lines": per_doc(full),
        "n_failed_lines": per_doc(fails),
        "n_lost_words": lost,
    }
    figures["base_failed"] = (n_words < rules.min_words) | (100 * figures["n_repeat_words"] > 50 * n_words)
    figures["kept"] = ~figures["base_failed"] & (lost <= rules.max_lost * n_words)
    return figures, begin, stop, fails


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "n_lost_words")
_FIGURES = ", ".join(f"{c} long" for c in _LONGS) + ", base_failed boolean, kept boolean"


def line_quality(docs: DataFrame, rules: Rules | None = None, text_col: str = "text", clean: bool = False, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the figures of each document, their names after ``prefix``.

    clean: the text loses its failed lines; those of rejected documents stay.
    A figure whose name a column of ``docs`` has replaces that column.
    """
    rules = rules or Rules()
    names = {f"{prefix}{c}": c for c in (*_LONGS, "base_failed", "kept")}
    passed = [c for c in docs.columns if c not in names or c == text_col]
    at = passed.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffers(b.column(at))
            for i, j in chunks(offs):
                own, cut = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                figures, begin, stop, fails = judge(own, cut, rules)
                cols = [b.column(k)[i:j] for k in range(len(passed))]
                if clean and fails.any():
                    texts = cols[at].to_pylist()
                    of = np.searchsorted(cut, begin, "right") - 1
                    for d in np.unique(of[fails]):
                        if figures["kept"][d]:
                            lines = range(*np.searchsorted(of, [d, d + 1]))
                            texts[d] = "\n".join(own[begin[x] : stop[x]].tobytes().decode() for x in lines if not fails[x])
                    cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols + [pa.array(figures[c]) for c in names.values()], [*passed, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in passed)
    # passed by place: mapInArrow does not take names with dots
    return docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(passed))).mapInArrow(run, kinds + ", " + ", ".join(f"`{n}` {'boolean' if c in ('base_failed', 'kept') else 'long'}" for n, c in names.items()))
