"""Jobs that must do their whole work: each test failed while an operator cut something."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantfeed.llm import mixing, urlrules


def test_url_rules_are_not_crowded_out(spark, monkeypatch):
    labels = "abcdefghijklmno"
    hosts = [".".join(f"{x}{k}" for x in labels[:5]) + ".com" for k in range(12)]
    urls = [(f"http://{h}/p{'qrst'[i % 4]}", True) for h in hosts for i in range(10)] + [(f"http://ok{i}.net/x", False) for i in range(130)]
    urls += [("http://late.org/y", i > 1) for i in range(10)]
    host, path = urlrules.host_and_path(F.col("u"))
    labelled = spark.createDataFrame(urls, "u string, bad boolean").select(urlrules.url_tokens(host, path).alias("tokens"), "bad")
    # ten URLs a host are too few for the default limits
    mined = urlrules.mine(labelled, least=5, lift=0.95)
    rules = {tuple(r.tokens): r.confidence for r in mined.collect()}
    assert rules[("host:late.org",)] == 0.8 and rules[("word:a0",)] == 1.0
    assert all(len(t) == 1 for t in rules)
    pages = spark.createDataFrame([(1, "http://late.org/z"), (2, "http://ok1.net/x"), (None, "http://x.b3.net/x"), (None, "http://x.b3.net/x")], "page_id long, url string")
    want = sorted(urlrules.judge(pages, mined, rules=()).collect(), key=str)
    assert [(r.page_id, r.verdict) for r in want] == [(1, "block"), (2, "allow"), (None, "block"), (None, "block")]
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    assert sorted(urlrules.judge(pages, mined, rules=()).collect(), key=str) == want


def test_pipeline_keeps_rows_with_null_and_repeated_ids(spark):
    sf = "/root/testdata/sf0.001"
    (_, language), (_, dedup), (_, mixture), (_, pack) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    said = {k: " ".join(f"the {k}{i} story of a house and the river" for i in range(40)) for k in ("null", "other", "twice", "again", "copied")}
    odd = [(None, said["null"]), (None, said["other"]), (7_000_001, said["twice"]), (7_000_001, said["again"]), (None, said["copied"]), (7_000_002, said["copied"]), (7_000_002, said["copied"])]
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "odd") for i, t in odd], "doc_id long, text string, lang string, source string"))
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.filter("source = 'odd'").collect())
    a = language(spark, both, sf)
    assert rows(a) == Counter(odd)
    b = dedup(spark, a, sf)
    assert b.columns == both.columns and rows(b) == Counter([*odd[:4], (7_000_002, said["copied"])])
    with pytest.MonkeyPatch.context() as m:
        whole = mixing.mixed_documents
        m.setattr(mixing, "mixed_documents", lambda d, percent: whole(d, percent=100))
        c = mixture(spark, b, sf)
    assert rows(c) == rows(b)
    packed = Counter(r.doc_id for r in pack(spark, c, sf).filter("start = 0 and (doc_id is null or doc_id > 7000000)").collect())
    assert packed == {None: 2, 7_000_001: 2, 7_000_002: 1}
