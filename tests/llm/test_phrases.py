"""Collocations: against plain counting of all phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantfeed.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = [p for p, a in found.items() if not any(len(q) > len(p) and b == a and inside(p, q) for q, b in found.items())]
        scored = []
        for p in kept:
            a = found[p]
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((score, a, " ".join(p), left, right))
        scored.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k, p, a, left, right, n[lang], s) for k, (s, a, p, left, right) in enumerate(scored[:top], 1)]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("shards", "slots"), [(2, 1 << 24), (3, 1 << 15)])
def test_equals_plain_counting(spark, sf, shards, slots, monkeypatch):
    """Also with a table so small that most slots are shared."""
    monkeypatch.setattr(phrases, "SHARDS", shards)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(phrases, "SLOTS", slots)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert got(phrases.collocations(docs, least=8, top=300)) == brute(rows, 8, 300)


def test_odd_rows(spark):
    hot = "The quick  brown\tfox jumps over, the quick brown fox; a a a a a a a"
    rows = [(hot, "en")] * 6 + [(None, "en"), ("", "en"), ("new york new york new york", None), ("New York.new york", "und"), ("one\x0btwo\x85three x", "xx"), (",.;", "yy"), ("ça va? Ça va ça va", "fr")]
    rows += [("long words here " * 4000 + "!" + "w" * 9000, "zz"), ("late bird sings " * 3, "en"), ("late bird sings " * 3, "en")]
    docs = spark.createDataFrame([(None, t, lang, "p", "n") for t, lang in rows], SCHEMA)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "SLICE_BYTES", 5_000)
        assert got(phrases.collocations(docs, least=3)) == brute(rows, 3)
    assert got(phrases.collocations(docs.limit(0))) == []


def test_bitmap_of_keys(spark):
    keys = [("en", "a b"), ("en", "ç"), ("", "x"), ("de", "")]
    taken = common.slots_taken(spark.createDataFrame(keys, "lang string, key string"), common.key_slot("lang", "key"))
    bits = np.frombuffer(taken, np.uint8)
    assert all(common.slots_hold(bits, common.slots_of(lang, [key.encode()]))[0] for lang, key in keys)
    assert np.unpackbits(bits).sum() == len(keys)
    assert common.slots_taken(spark.createDataFrame([], "lang string, key string"), common.key_slot("lang", "key")) is None
