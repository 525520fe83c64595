"""The ten operators against brute force on documents with nulls, empties, ties, repeated rows and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from . import fixtures as X

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(X.rows(), X.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in X.rows()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], X.SCHEMA)


def same(got, expected):
    assert collections.Counter(got) == collections.Counter(expected)


@pytest.mark.parametrize("hot", [128, 1])
def test_substring_dedup(docs, pairs, hot):
    from skein.llm.substring_dedup import substring_dedup

    found = substring_dedup(docs, length=50, hot=hot).collect()
    same([(r._id, r.n_words, r.n_removed, r.kept_sha256) for r in found], X.substring_reference(pairs, 50))
    texts = dict()
    for i, t in pairs:
        texts.setdefault(i, []).append(t or "")
    for r in found:
        if r.n_removed == 0:
            assert r._kept in texts[r._id]
        assert len(X.words(r._kept)) == r.n_words - r.n_removed


def test_substring_dedup_short_windows(docs, pairs):
    from skein.llm.substring_dedup import substring_dedup

    same([(r._id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, length=4).collect()], X.substring_reference(pairs, 4))


def test_suffix_automaton_matches_all_substrings():
    from skein.llm.substring_dedup import SuffixAutomaton

    rng = random.Random(1)
    for _ in range(60):
        held = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(3)]
        a = SuffixAutomaton()
        for h in held:
            a.add(h)
        asked = [rng.randrange(4) for _ in range(20)]
        spans, rest = a.spans(asked, 3)
        covered = {k for s, e in spans for k in range(s, e)}
        known = {tuple(h[i : i + 3]) for h in held for i in range(len(h) - 2)}
        hit = [i for i in range(18) if tuple(asked[i : i + 3]) in known]
        assert covered >= {k for i in hit for k in range(i, i + 3)} and {i for s, e in rest for i in range(s, e - 2)} == set(range(18)) - set(hit)


def test_line_quality(docs):
    from skein.llm.line_quality import line_quality

    found = line_quality(docs).collect()
    got = []
    for r in found:
        got.append((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert r.kept is False or not r.base_failed
    expected = []
    for i, t, *_ in X.rows():
        w, t = X.words(t), t or ""
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {y for a, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for y in (a, a + 1, a + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if X.words(line):
                dup += line in seen
                seen.add(line)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    same(got, expected)


def test_line_rules_remove_lines_and_reject(spark):
    from skein.llm.line_quality import line_quality

    rng = random.Random(3)
    good = "\n".join(X.prose(rng, 40) for _ in range(4))
    nav = "Home | News | Sport | Weather | Shop | Help"
    licence = "Licensed under the Apache License, Version 2.0."
    shout = "BUY NOW!! CHEAP PILLS!! BEST PRICE!! TODAY ONLY!!"
    rows = [(1, good), (2, good + "\n" + nav + "\n" + licence), (3, good[:300] + "\n" + "\n".join([shout + f" N{k} X" for k in range(60)])), (4, " ".join(w + "***" for w in good.split()))]
    found = {r.k: r for r in line_quality(spark.createDataFrame(rows, "k long, text string"), clean=True).collect()}
    assert found[1].kept and found[1].text == good and found[1].n_failed_lines == 0
    assert found[2].kept and found[2].text == good and found[2].n_failed_lines == 2
    assert not found[3].kept and not found[4].kept


def _encoded(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [end]


def test_token_id_files(spark, docs):
    from skein.llm.huffman import read_token_ids, write_token_ids

    path = write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = sorted(read_token_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    enc, at = _encoded("word_bpe_49k.json", 1), 0
    ids = [r.doc_id for r in found]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and ids[-2:] == [None, None]
    expected = collections.Counter((i, tuple(enc(t))) for i, t, *_ in X.rows())
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), X.crc(r.ids))
        at += r.n_tokens
        expected[r.doc_id, tuple(r.ids)] -= 1
    assert not +expected


def test_huffman_is_optimal_and_limited():
    import heapq

    from skein.llm.huffman import Decoder, canonical_codes, code_lengths, pack_bits

    rng = np.random.default_rng(2)
    counts = np.zeros(500, np.int64)
    counts[:300] = rng.zipf(1.2, 300) % 100000 + 1
    full = code_lengths(counts, 40)
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, x := heapq.heappop(heap) + heapq.heappop(heap))
        cost += x
    assert (counts * full).sum() == cost
    short = code_lengths(counts, 10)
    assert short.max() <= 10 and (2.0 ** -short[short > 0].astype(float)).sum() <= 1
    ids = rng.integers(0, 300, 5000).astype(np.uint16)
    bits, at = pack_bits(ids, canonical_codes(short), short)
    assert (Decoder(short).ids(np.frombuffer(bits, np.uint8), at[::100], np.full(50, 100)) == ids).all()
    assert code_lengths(np.zeros(4, np.int64)).sum() == 0


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_tokens_equal_the_library(name, keeps):
    from skein.llm._text import text_buffers
    from skein.llm._tokens import Encoder

    enc, e = _encoded(name, 0), Encoder(public_tokenizers.path(name), keeps)
    rng = random.Random(4)
    parts = ["'s", "’s", " ", "  ", "\n", "\n\n", "\t", " \n", " ", " ", "é", "É,", "×", "x", "don't", "12", "3a", "é", "≠", ".", "...", "<|endoftext|>", "<|", "İ", "Σ", "中文", "🙂", "\x85", "“a", "'ll", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(800)] + [t or "" for _, t, *_ in X.rows()]
    buf, offs = text_buffers(pa.array(texts))
    for _ in range(2):
        ids, bounds = e.encode(buf, offs)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == enc(t)[:-1], t


def _thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_structured_words_differ():
    from skein.llm._text import Words, shingles, span_ends, text_buffers
    from skein.llm._tokens import Encoder

    for n in range(4, 12):
        pair = _thue_morse(n)
        buf, offs = text_buffers(pa.array(pair))
        w = Words(buf, offs)
        assert w.hash[0] != w.hash[1] and len(set(span_ends(buf, w.start, w.end).tolist())) == 2
        runs = Words(*text_buffers(pa.array([" ".join(x) for x in pair])))
        for k in (2**n, 2 ** (n - 1)):
            both = [shingles(runs.hash[a:e], k)[0] for a, e in zip(runs.first[:-1], runs.first[1:])]
            assert both[0] != both[1]
    e, enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True), _encoded("byte_bpe_50k.json", 0)
    for t in _thue_morse(10):
        assert e.encode(*text_buffers(pa.array([t])))[0].tolist() == enc(t)[:-1]
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 300))) for _ in range(3000)]
    w = Words(*text_buffers(pa.array([" ".join(words)])))
    assert len(set(w.hash.tolist())) == len(set(words))


def test_structured_words_do_not_link(spark):
    from skein.llm.line_quality import line_quality
    from skein.llm.ngram_join import ngram_components

    a, b = _thue_morse(10)
    d = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w"), (5, f"{a}\n{b}\n{a}")], "doc_id long, text string")
    assert {r._id: r.component_id for r in ngram_components(d).collect()} == {i: i for i in range(1, 6)}
    assert {r.doc_id: r.n_dup_lines for r in line_quality(d).collect()}[5] == 1


@pytest.mark.parametrize("settings", [{}, {"STARS": 0, "RARE": 1}, {"STARS": 0, "RARE": 1, "SHORT": 8}, {"STARS": 0, "RARE": 4, "SHORT": 40, "EXTEND": 16}, {"STARS": 1}])
def test_ngram_components_of_large_groups(spark, settings, monkeypatch):
    """Groups of edited copies of a few texts, and texts that share long passages only, against brute force."""
    from skein.llm import ngram_join

    for k, v in settings.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (30, 90, 200, 400)]
    passage, rows = [f"p{k}" for k in range(60)], []
    for k in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12]) * len(w) // 100 + rng.choice([0, 1])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(400)}" for _ in range(rng.randint(0, 2))]
        if k % 5 == 0:
            w = passage + w[: rng.randint(0, 60)]
        rows.append((k, " ".join(w)))
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = X.component_reference(rows)
    assert 20 < len({c for _, _, c in expected}) < 250
    same([(r._id, r.n_shingles, r.component_id) for r in found], expected)


@pytest.mark.parametrize("settings", [{}, {"STARS": 0, "RARE": 1}, {"STARS": 0, "RARE": 3}])
def test_ngram_components(docs, pairs, settings, monkeypatch):
    from skein.llm import ngram_join

    for k, v in settings.items():
        monkeypatch.setattr(ngram_join, k, v)
    found = ngram_join.ngram_components(docs).collect()
    same([(r._id, r.n_shingles, r.component_id) for r in found], X.component_reference(pairs))
    twice = {i for i, n in collections.Counter(i for i, _ in set(pairs)).items() if n > 1}  # an id of different texts may name two components
    kept = collections.Counter(r.component_id for r in found if r._first and r.n_shingles and r.component_id not in twice)
    assert set(kept.values()) == {1}


def test_language_id(spark):
    from skein.llm.language_id import fit, held_out, predict, train

    rng = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["ßu", "ör", "gl"], "cc": ["ell", "qui", "ción"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(3, 30))), lang))
    d = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", None), (902, "12 34 !!", None), (903, "kato mi", None)], "doc_id long, text string, lang string")
    model = train(d.where(~held_out()))
    found = {r.doc_id: r for r in predict(d.withColumn("held_out", held_out()), model).collect()}
    test = [r for r in found.values() if r.held_out and r.lang and r.text]
    assert len(test) > 20 and sum(r.lang_pred == r.lang for r in test) >= 0.95 * len(test)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].accepted for i in (900, 901, 902))
    assert found[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert train(d.where("false")) is None and {r.lang_pred for r in predict(d, None).collect()} == {"und"}
    assert fit(["ab"], ["x"]).langs == ["x"]


def test_sharding(spark, docs):
    from skein.llm.sharding import shard_documents

    big = docs.unionByName(docs.where("text like 'line one%'").limit(1).crossJoin(spark.range(40)).drop("id"))
    found = shard_documents(big, shards=7).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    raw = big.select("doc_id", "text").collect()
    same([(r._id, r.size, r.text_crc32) for r in found], [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in raw])
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    assert shard_documents(big.limit(3), shards=7).count() == 3


def test_sharding_keeps_small_groups_together(spark):
    from skein.llm.sharding import shard_documents

    d = spark.range(600).selectExpr("id as doc_id", "if(id < 120, 't' || (id % 40), 'u' || id) as text").repartition(5)
    own = d.join(shard_documents(d, shards=6).withColumnRenamed("_id", "doc_id"), "doc_id")
    split = own.where("doc_id < 120").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split <= 2


@pytest.mark.parametrize("texts", ["'one'", "'t' || (id % 997)", "if(id < 3700, 't' || (id % 3), 'u' || id)"])
def test_sharding_levels_tables_of_copies(spark, texts):
    from skein.llm.sharding import shard_documents

    d = spark.range(4003).selectExpr("id as doc_id", f"{texts} as text").repartition(5)
    found = shard_documents(d, shards=40).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert sorted(r._id for r in found) == list(range(4003)) and set(by) == set(range(40))
    assert sorted(map(len, by.values())) == [100] * 37 + [101] * 3
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_packing(docs):
    from skein.llm.packing import pack_documents

    enc = _encoded("byte_bpe_50k.json", 0)
    found = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=64, with_ids=True).collect()
    sequences, seen = collections.defaultdict(list), collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, *_ in X.rows():
        texts[i].append(enc(t))
    for r in found:
        assert any(r.ids == w[r.start : r.start + r.length] and r.doc_tokens == len(w) for w in texts[r.doc_id])
        assert r.ids_crc32 == X.crc(r.ids) and r.length == len(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert {i: sum(map(len, w)) for i, w in texts.items()} == dict(seen)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(sum(n for _, n in s) < 64 for s in sequences.values()) <= 3  # one at most for each of the partitions


def test_packing_ignores_arrow_batches(spark, docs):
    from skein.llm.packing import pack_documents

    one = docs.coalesce(1)
    pack = lambda: sorted(map(tuple, pack_documents(one, public_tokenizers.path("byte_bpe_50k.json"), window=64).collect()), key=repr)
    found = pack()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert pack() == found
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_shards_by_bytes(docs, monkeypatch):
    from skein.llm import packing

    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    batches = docs.select("doc_id", "text").toArrow().to_batches(max_chunksize=7)
    shards = list(packing._shards(iter(batches)))
    rows = [(i, buf[a:e].tobytes()) for ids, buf, offs in shards for i, a, e in zip(ids.to_pylist(), offs[:-1], offs[1:])]
    assert rows == [(i, (t or "").encode()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(shards) > 3 and all(offs[-1] <= 2000 or len(ids) == 1 for ids, _, offs in shards)


def test_packing_puts_neighbours_together(spark):
    from skein.llm.packing import Index, _doc_terms, pack
    from skein.llm._text import text_buffers

    texts = [("apple pear plum " if k % 2 else "steel iron zinc ") + f"w{k}" for k in range(12)]
    buf, offs = text_buffers(pa.array(texts))
    index = Index(*_doc_terms(buf, offs), len(texts), np.ones(1 << 16, np.float32))
    pieces = pack(index, np.full(12, 10), window=30)
    first = [d for d, _, _, s, _ in pieces.tolist() if s == 0]
    assert len(first) == 3 and len({d % 2 for d in first}) == 1


def test_packing_ranks_by_all_terms():
    from skein.llm.packing import _B, _K1, TERMS, Index, _doc_terms
    from skein.llm._text import text_buffers

    rng = random.Random(12)
    # a third of the documents is a group whose common words are in over 10% of all; others share many rarer words
    hot = [f"hot{k}" for k in range(20)]
    texts = [" ".join(rng.sample(hot, 15) if k % 3 == 0 else map(str, rng.sample(range(1000, 1400), 25))) for k in range(600)]
    texts = [t + f" only{k} x{rng.randrange(50)}" for k, t in enumerate(texts)] + ["", "nowhere"]
    buf, offs = text_buffers(pa.array(texts))
    doc, term, n = _doc_terms(buf, offs)
    idf = np.random.default_rng(3).uniform(0.5, 5, TERMS).astype(np.float32)
    index = Index(doc, term, n, len(texts), idf)
    own = [{t: c for t, c in zip(term[doc == d].tolist(), n[doc == d].tolist())} for d in range(len(texts))]
    mean = sum(sum(x.values()) for x in own) / len(own)
    for seed in rng.sample(range(600), 40) + [600, 601]:
        index.used[seed] = True
        expected = {}
        for d, x in enumerate(own):
            if not index.used[d]:
                norm = _K1 * (1 - _B + _B * sum(x.values()) / mean)
                score = sum(float(idf[t]) * x[t] * (_K1 + 1) / (x[t] + norm) for t in own[seed] if t in x)
                if score:
                    expected[d] = score
        got = list(index.neighbours(seed))
        assert set(got) == set(expected) and len(got) == len(expected)
        ranked = [expected[d] for d in got]
        assert all(a >= b - 1e-3 for a, b in zip(ranked, ranked[1:]))
        index.used[got[:20]] = True


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(spark, docs, pairs, broadcast_rows):
    from skein.llm.decontamination import decontaminate

    texts = [t for _, t in pairs if t and len(X.bench_words(t)) > 40]
    take = lambda t, a, n: " ".join(t.split()[a : a + n])
    items = [("i1", take(texts[0], 3, 20)), ("i2", take(texts[1], 0, 13).upper()), ("i3", "one"), ("i3", take(texts[2], 5, 15)), ("i4", None), (None, take(texts[3], 0, 14)), ("i5", "nowhere to be found"), ("i6", ""), ("i7", take(texts[0], 5, 20))]
    got = decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"), broadcast_rows=broadcast_rows).collect()
    same([(r._id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], X.contamination_reference(pairs, items))
    assert any(r.contaminated for r in got)


def test_decontamination_is_native(spark, docs):
    from skein.llm.decontamination import decontaminate

    plan = decontaminate(docs, spark.createDataFrame([("a", "one two")], "item_id string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_proximity(spark):
    from skein.llm.decontamination import proximity_matches

    d = spark.createDataFrame([(1, "a red b fox c"), (2, "red x x x x fox"), (3, "fox red"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([("q", ["red", "fox"])], "query_id string, terms array<string>")
    assert {r._id for r in proximity_matches(d, q, span=3).collect()} == {1, 3}


def test_wrapper_induction(spark):
    from skein.llm.wrapper_induction import extract_pages

    rng = random.Random(8)
    rows, expected = [], {}
    for k in range(12):
        paras = [X.prose(rng, 25).replace("\n", " ") for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p} &amp; <b>bold</b>\n  x<br>y" for p in paras)
        html = f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>n{k}</a></ul></nav><div class='ad box'>buy {k}</div><div id=content><h1>H{k}</h1>{body}<div class=share>Share this page</div><p>Printed in the daily paper.</p></div><aside>side</aside><form>f</form><div class=comments>nice {k}</div><footer>&copy; {k}</footer><script>var a='</p>';</script></body>"
        rows.append((k, "https://a.example.com/x", html))
        expected[k] = "\n".join([f"H{k}"] + [f"{p} & bold x y" for p in paras])
    rows += [(100, "http://b.example.com/", "<article><h1>T</h1><p>only &eacute; one</article>"), (101, None, None), (102, "http://b.example.com/", ""), (103, "x", "no tags & text <b>here"), (104, "http://b.example.com/", "<body><header>top</header><p>a<p>b")]
    expected |= {100: "T\nonly é one", 101: "", 102: "", 103: "no tags & text here", 104: "a\nb"}
    found = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in expected.items():
        assert (found[k].text, found[k].n_chars) == (text, len(text)), k


def test_wrapper_keeps_short_slots(spark):
    from skein.llm.wrapper_induction import extract_pages

    rng = random.Random(9)
    texts = [X.prose(rng, 500 if k == 0 else 4).replace("\n", " ") for k in range(12)]
    rows = [(k, "http://a.example/", f"<body><nav>n{k}</nav><div><h1>Title {k}</h1><div class=text><p>{t}</p></div><p>End {k}</p></div></body>") for k, t in enumerate(texts)]
    # a long page first, whichever it is by hash
    rows += [(100 + k, "http://b.example/", h.replace("</p></div>", "</p><p>" + X.prose(rng, 500).replace("\n", " ") + "</p></div>", 1)) for k, _, h in rows]
    found = {r.page_id: r.text.split("\n") for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, t in enumerate(texts):
        assert found[k] == [f"Title {k}", t, f"End {k}"]
        assert found[100 + k][:2] == [f"Title {k}", t] and found[100 + k][-1] == f"End {k}" and len(found[100 + k]) == 4


@pytest.mark.parametrize("settings", [{}, {"HELD": 20}, {"BROADCAST_ROWS": 0}])
def test_wrapper_counts_all_pages(spark, settings, monkeypatch):
    from skein.llm import wrapper_induction as W

    for k, v in settings.items():
        monkeypatch.setattr(W, k, v)
    page = lambda k, first, last="Printed daily.": f"<body><h2>{first}</h2><div><p>text {k}</p></div><h3>{last}</h3></body>"
    # a text that all but the last page share is content; one in every page is template
    rows = [(k, f"http://a.example/{k}", page(k, "Part two" if k == 199 else "Part one")) for k in range(200)]
    # mostly copies: 8 draws meet few of the 12 different pages
    rows += [(1000 + k, f"http://b.example/{k}", page(-1, "First")) for k in range(600)] + [(2000 + k, f"http://b.example/x{k}", page(k, f"Part {k}")) for k in range(11)] + [(2000, "http://b.example/x0", page(0, "Part 0"))]
    # a text of another layout with the same words is kept where it stands
    rows += [(3000 + k, f"http://c.example/{k}", page(k, f"H{k}") if k < 30 else f"<body><ul><li>Printed daily.<li>item {k}</ul></body>") for k in range(40)]
    found = {r.page_id: r.text.split("\n") for r in W.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    assert all(found[k] == ["Part two" if k == 199 else "Part one", f"text {k}"] for k in range(200))
    assert all(found[1000 + k] == ["First", "text -1"] for k in range(600)) and all(found[2000 + k] == [f"Part {k}", f"text {k}"] for k in range(11))
    assert all(found[3000 + k] == ([f"H{k}", f"text {k}"] if k < 30 else ["Printed daily.", f"item {k}"]) for k in range(40))


def _matching(a, b):
    """Simple tree matching as its recurrence says, on folded trees given as each path's parent."""
    kids = lambda t, x: [p for p, above in t.items() if above == x]

    def best(x, y):
        if x != y:
            return 0
        p, q = kids(a, x), kids(b, y)
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, u in enumerate(p):
            for j, v in enumerate(q):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(u, v))
        return table[-1][-1] + 1

    return best(0, 0)


def test_simple_tree_matching():
    from skein.llm.wrapper_induction import align, content

    a, b = (content(h)[2] for h in ("<div><h1>x</h1><p>1</p><ul><li>q</ul></div>", "<div><p>2</p><p>3</p><h1>y</h1><ul><li>q<li>r</ul></div>"))
    assert len(align(a, b)) == _matching(a, b) == 5  # the root, div, ul, li and one of h1 and p
    rng = random.Random(4)
    for _ in range(200):
        trees = []
        for _ in range(2):
            make = lambda depth: "".join(f"<div class={c}>{make(depth - 1) if depth else ''}</div>" for c in rng.sample("abcde", rng.randint(0, 4)))
            trees.append(content(make(3))[2])
        matched = align(*trees)
        assert len(matched) == _matching(*trees) and all(p == 0 or trees[0][p] in matched for p in matched)


def test_wrapper_on_deep_and_wide_pages(spark):
    from skein.llm.wrapper_induction import extract_pages

    deep = lambda k: "<body>" + "<div>" * 5000 + f"<p>deep {k}</p>" + "</div>" * 5000 + "<p>x</p></body>"
    wide = lambda k: "<body>" + "".join(f"<h2 class=c{i}>h{k} {i}</h2><p class=d{i}>p{k} {i}</p>" for i in range(5000)) + "</body>"
    long = "<body><article>" + "<p>word " * 200_000 + "</article></body>"
    rows = [(k, "http://a.example/", deep(k)) for k in range(6)] + [(10 + k, "http://b.example/", wide(k)) for k in range(6)] + [(20, "http://c.example/", long)]
    found = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"deep {k}" for k in range(6))
    assert all(found[10 + k].split("\n") == [x for i in range(5000) for x in (f"h{k} {i}", f"p{k} {i}")] for k in range(6))
    assert found[20] == "\n".join(["word"] * 200_000)


@pytest.mark.parametrize("settings", [{}, {"HELD": 20}, {"BROADCAST_HOSTS": 0}])
def test_wrapper_matches_pages_that_name_an_article(spark, settings, monkeypatch):
    """Which of a page's article and main elements are its text is found by matching it with the other pages of its host."""
    from skein.llm import wrapper_induction as W

    for k, v in settings.items():
        monkeypatch.setattr(W, k, v)
    card = "<article class=card><h2>Our app</h2><p>Try it.</p></article>"
    story = "<article class=story><h2>Introduction</h2><p>text {k}</p></article>"
    hosts = [
        # the same element in every page is template; what repeats inside one that varies is its text
        ([f"<body><nav>n{{k}}</nav>{card}{story}</body>"] * 8, ["Introduction\ntext {k}"] * 8),
        # one page that differs there makes it a slot of all
        ([f"<body>{card}{story}</body>"] * 7 + [f"<body>{card.replace('Try', 'Buy')}{story}</body>"], ["Our app\nTry it.\nIntroduction\ntext {k}"] * 7 + ["Our app\nBuy it.\nIntroduction\ntext {k}"]),
        # all that is named is template: it stays, and so do the slots outside it
        ([f"<body>{card}<div><h1>Title {{k}}</h1><p>body {{k}}</p><p>Printed daily.</p></div></body>"] * 8, ["Our app\nTry it.\nTitle {k}\nbody {k}"] * 8),
        # there are none
        ([f"<body><nav>n{{k}}</nav>{card}<footer>f{{k}}</footer></body>"] * 8, ["Our app\nTry it."] * 8),
        # too few pages to tell
        ([f"<body>{card}{story}</body>"] * 4, ["Our app\nTry it.\nIntroduction\ntext {k}"] * 4),
        # the pages that name an article and those that do not are counted apart
        ([f"<body>{card}{story}</body>"] * 12 + ["<body><h1>T{k}</h1><p>Printed daily.</p></body>"] * 6, ["Introduction\ntext {k}"] * 12 + ["T{k}"] * 6),
        # most pages of another order: the one node matches that stands in the order of the commonest layout
        ([f"<body>{card}<main>m {{k}}</main></body>"] * 8 + [f"<body><main>m {{k}}</main>{card}</body>"] * 3, ["m {k}"] * 11),
    ]
    rows = [(100 * g + k, f"http://h{g}.example/{k}", html.replace("{k}", str(k))) for g, (pages, _) in enumerate(hosts) for k, html in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    kinds = {r._named for r in table.selectExpr("split(url, '/')[2] _host", "html _html").mapInArrow(W._layouts, "_host string, _named boolean, _layout long, _n long, _paths array<long>, _above array<long>").collect()}
    assert kinds == {True, False}
    found = {r.page_id: r.text for r in W.extract_pages(table).collect()}
    assert found == {100 * g + k: text.replace("{k}", str(k)) for g, (_, expected) in enumerate(hosts) for k, text in enumerate(expected)}


def test_simple_tree_matching_of_named_articles():
    from skein.llm.wrapper_induction import align, content

    a, b = (content(h)[2] for h in ("<body><h1>x</h1><article><p>1</p><ul><li>q</ul></article></body>", "<body><article><p>2</p><ul><li>q<li>r</ul><h2>y</h2></article><h1>z</h1></body>"))
    assert len(align(a, b, 1)) == 6  # the root, body, article, p, ul and li, without the h1 of another place


GOLD = [
    ("<body><nav>n</nav><article><h2>Introduction</h2><p>text {k}</p></article></body>", "Introduction\ntext {k}"),
    ("<body><article><div class='ad-hoc'>made {k}</div><section id=share-prices><p>up {k}</p></section></article></body>", "made {k}\nup {k}"),
    ("<body><article title='a > b' data-x=\"c > d\"><p title='x>y'>main {k}</p><div class='share-buttons'>s</div><div class=adBox>buy</div></article></body>", "main {k}"),
    ("<body><main><p>a {k}<article class=comment>no</article><div class='site-footer'>f</div><ul id=comments-list><li>c</ul></main></body>", "a {k}"),
    ("<body><div id=masthead>top</div><h1>T{k}</h1><div role=navigation>go</div><p>b {k}<p hidden>h<p>Printed daily.<div class='cookie_notice'>ok?</div></body>", "T{k}\nb {k}"),
    ("<article><header><h1>Title {k}</h1></header><p>x &lt; y &amp;amp; {k}<form>f<input></form><script>if (a < b) '</p>'</script><pre>one\n  two</pre></article>", "Title {k}\nx < y &amp; {k}\none two"),
]


def test_wrapper_gold_pages(spark):
    """Pages whose main text is known: every line of it is found, and nothing else."""
    from skein.llm.wrapper_induction import extract_pages

    rows = [(100 * g + k, f"http://g{g}.example/{k}", html.replace("{k}", str(k)), "x", "y") for g, (html, _) in enumerate(GOLD) for k in range(8)]
    rows += [rows[0], rows[0]]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, _host string, text string")).collect()
    assert collections.Counter((r.page_id, r.text) for r in found) == collections.Counter((i, GOLD[i // 100][1].replace("{k}", str(i % 100))) for i, *_ in rows)


def _all_operators():
    from skein.llm.decontamination import decontaminate
    from skein.llm.huffman import read_token_ids, write_token_ids
    from skein.llm.language_id import predict, train
    from skein.llm.line_quality import line_quality
    from skein.llm.ngram_join import ngram_components
    from skein.llm.packing import pack_documents
    from skein.llm.sharding import shard_documents
    from skein.llm.substring_dedup import substring_dedup

    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    items = lambda d: d.sparkSession.createDataFrame([("i1", "one", 1), ("i2", "a b c d", 2)], "item_id string, text string, _id long")
    return {
        "op1": lambda d: substring_dedup(d),
        "op3": lambda d: line_quality(d).select("doc_id", "n_words", "n_repeat_words", "base_failed"),
        "op4": lambda d: read_token_ids(d.sparkSession, write_token_ids(d, word)).select("doc_id", "n_tokens"),
        "op5": lambda d: ngram_components(d),
        "op6": lambda d: predict(d, train(d)).select("doc_id", "lang_pred", "score"),
        "op7": lambda d: shard_documents(d, shards=5).select("_id", "size", "text_crc32"),
        "op8": lambda d: pack_documents(d, byte, window=64).groupBy("doc_id").sum("length"),
        "op9": lambda d: decontaminate(d, items(d)).drop("_items"),
    }


@pytest.mark.parametrize("op", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_clashing_columns(docs, op):
    """Columns that are named as operators name their own change nothing."""
    from pyspark.sql import functions as F

    plain = docs.select("doc_id", "text", "lang")
    names = ("_id", "_row", "_text", "_rid", "_n", "_token", "_label", "_group", "_words", "_pid", "size", "shard", "slot", "letter", "c0", "score", "start", "ids", "doc", "a.b")
    run = _all_operators()[op]
    found = lambda d: collections.Counter(map(repr, run(d).collect()))
    assert found(plain.withColumns({c: F.lit(k) for k, c in enumerate(names)})) == found(plain)


def test_very_long_texts(spark):
    """Texts of two hundred thousand words, alone, copied and nearly copied, against the plain versions."""
    from skein.llm.ngram_join import ngram_components
    from skein.llm.line_quality import line_quality
    from skein.llm.substring_dedup import substring_dedup

    rng = random.Random(12)
    long = [f"w{rng.randrange(60000)}" for _ in range(200_000)]
    near = long[:1000] + ["x"] + long[1001:]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "\n".join(long[50_000:60_000])), (4, " ".join(long)), (5, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r._id, r.n_shingles, r.component_id) for r in ngram_components(d).collect()], X.component_reference(rows))
    same([(r._id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(d).collect()], X.substring_reference(rows, 50))
    assert {r.doc_id: r.n_words for r in line_quality(d).collect()} == {i: len(t.split()) for i, t in rows}
    for op in ("op4", "op7", "op8"):
        found = _all_operators()[op](d.where("doc_id in (1, 5)")).collect()
        assert sorted({r[0] for r in found}) == [1, 5]


def test_language_scores_equal_a_plain_softmax(spark):
    """The mean of the features' calibrated logits, feature by feature."""
    import math

    from skein.llm.language_id import GRAMS, features, fit, predict
    from skein.llm._text import text_buffers

    rng = random.Random(2)
    texts = [" ".join(rng.choice(w) for _ in range(30)) for w in (["ka", "tomi", "ro"], ["bel", "gor", "xi"]) for _ in range(40)]
    model = fit(texts, ["a"] * 40 + ["b"] * 40)
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts + ["ka bel", "q", "ka " * 5000])], "doc_id long, text string")
    for r in predict(d, model).collect():
        buckets, _ = features(*text_buffers(pa.array([r.text])))
        words = r.text.split()
        assert len(buckets) == len(words) + sum(max(0, len(w) + 3 - n) for w in words for n in GRAMS)
        logit = [sum(float(model.table[b, k]) for b in buckets) / len(buckets) + float(model.bias[k]) for k in range(2)]
        odds = [math.exp(x - max(logit)) for x in logit]
        assert r.lang_pred == model.langs[odds.index(max(odds))] and abs(r.score - max(odds) / sum(odds)) < 1e-9


def test_sharding_cuts_fewer_edges_than_its_start(spark):
    """Pairs of equal texts in different shards, against dealing rows by hash and against the least that quotas allow."""
    from skein.llm.sharding import shard_documents

    rng = random.Random(5)
    groups = [rng.randrange(1, 30) for _ in range(120)]
    rows = [(k, f"t{g}") for k, g in enumerate(g for g, n in enumerate(groups) for _ in range(n))] + [(10_000 + k, f"u{k}") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shard = {r._id: r.shard for r in shard_documents(d, shards=8).collect()}

    def cut(at):
        cells = collections.Counter((t, at[i]) for i, t in rows)
        whole = collections.Counter(t for _, t in rows)
        return sum(n * (n - 1) // 2 for n in whole.values()) - sum(n * (n - 1) // 2 for n in cells.values())

    start = cut({i: hash((i, "x")) % 8 for i, _ in rows})
    assert cut(shard) <= 0.1 * start


def test_empty_tables(spark, nothing):
    from skein.llm.decontamination import decontaminate
    from skein.llm.huffman import read_token_ids, write_token_ids
    from skein.llm.language_id import predict, train
    from skein.llm.line_quality import line_quality
    from skein.llm.ngram_join import ngram_components
    from skein.llm.packing import pack_documents
    from skein.llm.sharding import shard_documents
    from skein.llm.substring_dedup import substring_dedup
    from skein.llm.wrapper_induction import extract_pages

    items = spark.createDataFrame([], "item_id string, text string")
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for found in (substring_dedup(nothing), line_quality(nothing), read_token_ids(spark, write_token_ids(nothing, word)), ngram_components(nothing), predict(nothing, train(nothing)), shard_documents(nothing), pack_documents(nothing, byte), decontaminate(nothing, items), extract_pages(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert found.count() == 0
