"""Source divergence: against plain counting, with levels, slices and blocks made small."""

import re
from collections import Counter, defaultdict

import pytest

from quantfeed.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank string"


def brute(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(c, kept=kept):
            base = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // base for t in kept}

        mine, whole = p(own), p(sum((c for (of, _), c in counts.items() if of == lang), Counter()))
        pairs = [(sum((mine[t] - q) ** 2 // q for t, q in p(c).items()), s) for (of, s), c in counts.items() if of == lang and s != source]
        terms = [((mine[t] - q) ** 2 // q, t) for t, q in whole.items() if own[t] and mine[t] > q]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(df.dtypes)["value"] == "bigint"
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counting(spark, sf, small, monkeypatch):
    if small:
        for name, v in (("FIRST", 1), ("SLICE_BYTES", 300), ("SOURCES", 3), ("CELLS", 50), ("HELD", 10)):
            monkeypatch.setattr(divergence, name, v)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert got(divergence.audit(docs)) == brute(rows)
    assert got(divergence.audit(docs, least_docs=1, ranks=2)) == brute(rows, 1, 2)


def test_odd_rows(spark):
    long = "x" * 5000
    odd = [(None, None, None), ("", None, ""), ("Ä ä Ä", "de", "a"), ("ä ÄB äb", "de", "b"), ("ab-cd ab'CD ab", "de", None), ("ab", "de", ""), ("AB cd", "de", "a"),
           (long, "xx", "s"), (long + " " + long, "xx", "s"), (long.upper() + "z", "xx", "t"), (long, "xx", "t"), ("1 2 3 . _ [ ` {", "yy", "one"), ("日本 日本語", "de", "b"), ("日本", "de", "b"), ("日本", "de", "b"), ("ab cd " * 3000, "de", "b")]
    rows = odd + [("same words here", "en", "s")] * 4 + [("same words", "en", "u")]
    docs = spark.createDataFrame([(None, t, lang, s, "t", "r") for t, lang, s in rows], SCHEMA)
    assert got(divergence.audit(docs)) == brute(rows)
    assert got(divergence.audit(docs.limit(0))) == []


def test_counts_beyond_64_bits(spark):
    sql = "SELECT " + divergence._p("occ", "n") + " AS p FROM VALUES (50000000000L, 70000000000L, 10L) AS t(occ, n, v)"
    assert spark.sql(sql).first()["p"] == 1 + 10**9 * (5 * 10**10 + 1) // (7 * 10**10 + 10)
