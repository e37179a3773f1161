import re
from itertools import combinations

import pytest

from quantfeed.llm import graph, minhash
from quantfeed.llm.queries import op9_near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def brute_set(text, width=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=85):
    sets = [(i, brute_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_word = {}
    for i, s in sets:
        for x in s:
            by_word.setdefault(x, []).append(i)
    of = {}
    for i, s in sets:
        of.setdefault(i, s)
    for a, b in {p for ids in by_word.values() if len(ids) < 400 for p in combinations(sorted(set(ids)), 2)}:
        inter = len(of[a] & of[b])
        if inter * 100 >= percent * (len(of[a]) + len(of[b]) - inter):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, scale):
    d = f"/root/testdata/{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op9_near_duplicates(spark, d)) == brute(rows)


def test_chain_of_near_copies_is_one_component(spark):
    """Each text differs from the next by few words, the ends by many: links must carry through."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        words = words.copy()
        words[(k * 7) % 200] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + i, " ".join(f"p{j}" for j in range(30)) + " " + " ".join(f"u{i}-{j}" for j in range(300))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (6, "", "x", 1), (7, " \t\n", "x", 1), (8, "A b", "x", 1), (9, "a B", "x", 1), (8, "A b", "x", 1), (10, "a\u00a0b", "x", 1), (None, "a b", "x", 1), (11, "w " * 50_000, "x", 1)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert by == {5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (1, 8, True), 9: (1, 8, False), 10: (1, 10, True), None: (1, 8, False), 11: (1, 11, True)}
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_under_one_id_and_without_id(spark):
    """Every text is compared by its own set; links through rows without an id carry on."""
    words = [f"w{i}" for i in range(100)]
    b, c, d = words.copy(), words.copy(), words.copy()
    b[3], c[3], c[40], d[99] = "x", "x", "y", "z"
    other = [f"o{i}" for i in range(100)]
    rows = [(1, " ".join(other)), (1, " ".join(words)), (3, " ".join(d)), (4, " ".join(other) + " more"), (None, " ".join(b)), (7, " ".join(c)), (None, "alone here"), (9, "Alone HERE")]
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r[2:])
    assert by == {1: [(1, True), (1, True)], 3: [(1, False)], 4: [(1, False)], None: [(1, False), (9, False)], 7: [(1, False)], 9: [(9, True)]}


def test_long_lists_in_parts(spark, monkeypatch):
    """Pairs are the same however small the parts of a list are."""
    monkeypatch.setattr(minhash, "PART", 2)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    shared = [f"s{j}" for j in range(60)]
    rows = [(i * 10 + k, " ".join(shared + [f"u{i}-{j}" for j in range(300)] + [f"k{k}"])) for i in range(8) for k in range(3)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(99, 97), (97, 98), (60, 60), (99, 97)], "a long, b long")
    found = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
    assert found == {i: 0 for i in range(51)} | {97: 97, 98: 97, 99: 97, 60: 60}


def test_pages_of_one_template_meet_in_no_list(spark, monkeypatch):
    """179 of 204 words are shared (Jaccard 0.77): no link, and no pair is even looked at; larger and smaller pages still find theirs."""
    template = [f"t{i}" for i in range(179)]
    rows = [(k, " ".join([*(f"own{k}x{i}" for i in range(25)), *template])) for k in range(400)]
    near = [(1000, " ".join(template[:170])), (1001, " ".join(template[:150])), (1002, " ".join(template)), (1003, " ".join([*template, *(f"more{i}" for i in range(28))]))]
    seen = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    assert all(x.count() == 0 for x in seen)
    both = rows[:60] + near
    assert got(minhash.near_duplicates(spark.createDataFrame(both, "doc_id long, text string"))) == brute(both)
