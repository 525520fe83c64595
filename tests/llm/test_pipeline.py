"""The pipeline against a plain-Python version of each stage, each on the stage's own input."""

import collections

import pytest

from . import fixtures as X

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input and output; the input also holds repeated, null and empty rows."""
    from skein.llm._shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(2).unionByName(docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(1).selectExpr("9000001L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    docs, out = written(docs.unionByName(odd), "docs"), {}
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == list(stages) and len(stages) == 5
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert all(n == len(t or "") for _, t, _, _, n in _rows(after))


def test_quality_rules(stages):
    before, after = stages["quality rules"]
    kept = collections.Counter(r[0] for r in _rows(after))
    for i, t, *_ in _rows(before):
        if len(X.words(t)) < 50:
            assert kept[i] == 0
    texts = {r[0]: r[1] or "" for r in _rows(before)}
    assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t, *_ in _rows(after)) and len(_rows(after)) > 0.6 * len(texts)


def test_near_duplicates(stages):
    before, after = stages["n-gram Jaccard join"]
    docs = [r[:2] for r in _rows(before)]
    names = {c for _, n, c in X.component_reference(docs) if n}
    got = [r[0] for r in _rows(after)]
    assert collections.Counter(got) == collections.Counter(names)


def test_substring_dedup(stages):
    before, after = stages["substring dedup"]
    docs = [r[:2] for r in _rows(before)]
    expected = {i: (n, gone) for i, n, gone, _ in X.substring_reference(docs, 50)}
    got = {r[0]: r[1] for r in _rows(after)}
    assert set(got) == {i for i, (n, gone) in expected.items() if gone < n or n == 0}
    texts = dict(docs)
    for i, t in got.items():
        n, gone = expected[i]
        assert len(X.words(t)) == n - gone and (gone or t == texts[i])


def test_decontamination(stages, spark, sf_dir):
    before, after = stages["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flagged = {i for i, *_, bad in X.contamination_reference([r[:2] for r in _rows(before)], items) if bad}
    assert collections.Counter(r[:2] for r in _rows(after)) == collections.Counter(r[:2] for r in _rows(before) if r[0] not in flagged)


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x, *_ in _rows(before)}
    covered, filled = collections.Counter(), collections.defaultdict(list)
    for r in after.collect():
        assert r.ids_crc32 == X.crc(ids[r.doc_id][r.start : r.start + r.length])
        covered[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: len(w) for i, w in ids.items()}
    assert sum(sum(n for _, n in s) == 1024 for s in filled.values()) >= len(filled) - after.rdd.getNumPartitions()


def test_clashing_columns(stages, spark, sf_dir):
    """Columns named as the stages name their own come through unchanged."""
    from pyspark.sql import functions as F

    for name, stage in pipeline.STAGES[:-1]:
        before, after = stages[name]
        extra = {c: F.lit(k) for k, c in enumerate(("_id", "_row", "_text", "_kept", "n_words", "_gone_id", "doc", "a.b"))}
        found = stage(spark, before.withColumns(extra), sf_dir)
        assert found.columns == before.columns + list(extra)
        assert collections.Counter(r[:2] for r in _rows(found)) == collections.Counter(r[:2] for r in _rows(after)), name
        assert {r[5:] for r in _rows(found)} == {tuple(range(len(extra)))}


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
