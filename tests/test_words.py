"""Words in texts by an index of grams: equal to testing each."""

import random

from quantfeed.operators import words


def test_index_equals_testing_each(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "Aabc", "股票立案调查公告", "立案", "a"]
    table = ["".join(rng.choices("abcde ", k=rng.randint(1, 9))) for _ in range(400)] + [None, "", "立案", "立案调查", "a", "abcabcabc", "zz", "é"]
    t = spark.createDataFrame([(x, "w") for x in texts], "text string, gram string")
    w = spark.createDataFrame([(x, 1) for x in table], "word string, c int")
    want = {(x, y) for x in texts if x for y in table if y and y in x}
    for gram in (1, 3, 4):
        rows = [tuple(r) for r in words.contained(t, w, gram).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    rules = spark.createDataFrame([("ab", 5, "x"), ("abc", 9, "y"), ("立案", 9, "z"), ("zz", 99, "n"), ("aa", 9, "first"), (None, 100, "none")], "word string, severity int, category string")
    got = {r.text: (r.severity, r.category, r.words) for r in words.rated(t, rules).collect()}
    named = [("ab", 5, "x"), ("abc", 9, "y"), ("立案", 9, "z"), ("aa", 9, "first")]
    for x in filter(None, texts):
        hits = [r for r in named if r[0] in x]
        assert (x in got) == bool(hits)
        if hits:
            best = min(hits, key=lambda r: (-r[1], r[0]))
            assert got[x] == (best[1], best[2], len(hits))
    assert words.contained(t.limit(0), w).collect() == words.contained(t, w.limit(0)).collect() == []
