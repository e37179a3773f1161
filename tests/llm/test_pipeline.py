import pytest

import corpus_pipeline
from quantfeed.llm import mixing
from tests.llm.test_documents import check_packing
from tests.llm.test_minhash import brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, language), (_, dedup), (_, mixture), (_, pack) = corpus_pipeline.STAGES
    a = language(spark, docs, sf)
    assert a.columns == docs.columns and a.count() == docs.filter("text rlike '\\\\p{L}'").count()
    b = dedup(spark, a, sf)
    want = brute([(r.doc_id, r.text) for r in a.collect()], percent=80)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(i for i, v in want.items() if v[2])
    c = mixture(spark, b, sf)
    assert c.columns == docs.columns
    kept = {r.doc_id: r.text for r in c.collect()}
    before = sum(len(r.text.split()) for r in b.collect())
    assert 0.8 * before < sum(len(t.split()) for t in kept.values()) <= 0.9 * before
    check_packing(pack(spark, c, sf).collect(), kept)


def test_run_gives_the_same_pieces(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({(r.doc_id, r.start) for r in rows}) == len(rows)


@pytest.mark.parametrize("ids", [(1, 2, 3, 4), (1, 1, None, 4)])
def test_stages_keep_columns_of_clashing_names(spark, sf, ids):
    texts = ["the story of a house and the river and all the people in it", "the story of a house and the river and all the people in it", "a town that nobody has seen for years and years", "words of another kind are in this one here"]
    rows = [(i, t, "en", "s", f"mine{k}", "k", "t", "n", "c") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row string, key string, tokens string, n string, component_id string")
    (_, language), (_, dedup), (_, mixture), (_, pack) = corpus_pipeline.STAGES
    a = language(spark, docs, sf)
    b = dedup(spark, a, sf)
    c = mixing.mixed_documents(b, percent=100)
    for out in (a, b, c):
        assert out.columns == docs.columns
    same = [r for r in rows if r[4] in ("mine0", "mine1")]
    assert sorted(tuple(r) for r in a.collect()) == sorted(rows, key=str) if None not in ids else a.count() == 4
    kept = {tuple(r) for r in b.collect()}
    assert len(kept) == 3 and len(kept & set(same)) == 1 and kept < set(rows)
    assert {tuple(r) for r in c.collect()} == kept
    assert {r.doc_id for r in pack(spark, c, sf).collect()} == {r[0] for r in kept}


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
