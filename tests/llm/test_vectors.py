import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfeed.llm import ann, embdedup
from quantfeed.llm.queries import op1_nearest, op6_vector_groups

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def load(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), np.array([r.label for r in rows])


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_and_scores_of_nearest(spark, scale):
    d = f"/root/testdata/{scale}"
    ids, x, _ = load(spark, d)
    found = {}
    for r in op1_nearest(spark, d).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, dist)) if i != q][:10]
        mine = sorted(found[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11))
        for _, v, s in mine:
            assert abs(dist[list(ids).index(v)] - s) < 1e-12
        hits += len({m[1] for m in mine} & {ids[i] for i in order})
        total += 10
    assert hits / total >= 0.92


def test_nearest_of_few_and_odd_vectors(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [float("nan"), 1.0], [2.0, None], []]
    df = spark.createDataFrame([(i, x, 0, "a") for i, x in enumerate(v)], SCHEMA)
    out = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(2**0.5)), (2, 1, 0, pytest.approx(2**0.5)), (2, 2, 1, pytest.approx(2**0.5))]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


def test_nearest_among_vectors_of_several_sizes_and_ties(spark):
    """Each size is searched by itself; repeated rows count once, clashing columns are ignored."""
    v = [(0, [1.0, 0.0]), (1, [1.0, 1.0, 1.0]), (2, [2.0, 1.0, 1.0]), (3, [0.0, 1.0, 1.0]), (4, [3.0, 0.0]), (4, [3.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 0, "a", "q", 7, 0.5) for i, x in v], "vec_id long, embedding array<float>, label int, n_links string, query_id string, list int, score double")
    out = [tuple(r) for r in ann.nearest(df, F.col("vec_id") < 2).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 4, 2.0), (1, 1, 2, 1.0), (1, 2, 3, 1.0)]


def test_task_output_is_bounded(spark, monkeypatch):
    """Held candidates are cut to the best of each query, however often."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v], 0, "a") for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(ann, "HELD", 500)
    monkeypatch.setattr(ann, "BLOCK", 64)
    out = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.col("vec_id") % 3 == 0, k=3).collect()}
    assert len(out) == 600
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    hits = sum(len({out[q, r] for r in (1, 2, 3)} & set(np.argsort(d[q])[:3])) for q in range(0, 600, 3))
    assert hits / 600 > 0.9


def brute_links(ids, x, labels, threshold=0.98):
    n = np.sqrt((x * x).sum(axis=1))
    same = (x @ x.T) / n[:, None] / n[None, :] >= threshold
    same &= labels[:, None] == labels[None, :]
    np.fill_diagonal(same, False)
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[same[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return {int(i): (int(k), int(c), bool(i == c)) for i, k, c in zip(ids, same.sum(axis=1), comp, strict=True)}
        comp = new


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_groups_equal_brute_force(spark, scale):
    d = f"/root/testdata/{scale}"
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_vector_groups(spark, d).collect()}
    assert out == brute_links(*load(spark, d))


def test_large_group_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    x = base + 0.01 * rng.standard_normal((700, 16))
    rows = [(i, [float(np.float32(a)) for a in v], 1, "a") for i, v in enumerate(x)] + [(1000 + i, [float(a) for a in rng.standard_normal(16)], 1, "a") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicate_vectors(df).collect()}
    want = brute_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float), np.ones(len(rows)))
    assert out == want


def test_doubles_stay_doubles(spark):
    """Two pairs on either side of the threshold by less than a float can tell."""
    import math

    turn = math.acos(0.98)
    v = [[1.0, 0.0], [math.cos(turn - 1e-10), math.sin(turn - 1e-10)], [-1.0, 0.0], [math.cos(math.pi + turn + 1e-10), math.sin(math.pi + turn + 1e-10)]]
    df = spark.createDataFrame([(i, x, 1, "a", 5) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int, n_links string, component_id int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicate_vectors(df).collect()}
    assert out == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}


def test_groups_of_odd_vectors(spark):
    v = [([1.0, 0.0], 1), ([1.0, 0.0], 1), ([2.0, -0.0], 1), ([1.0, 0.0], None), ([0.0, 0.0], 1), (None, 1), ([float("inf"), 1.0], 1), ([1.0, 0.0], 2), ([1.0], 1)]
    df = spark.createDataFrame([(i, x, k, "a") for i, (x, k) in enumerate(v)] + [(None, [1.0, 0.0], 1, "a")], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicate_vectors(df).collect()}
    assert out == {0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), None: (3, 0, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}
    assert embdedup.near_duplicate_vectors(df.limit(0)).collect() == []


def test_blocks_are_unpacked_in_slices(spark, monkeypatch):
    """Groups of several labels over many small blocks, few of them unpacked at once; unrelated vectors fetch nothing."""
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    monkeypatch.setattr(embdedup, "MEMBERS", 40)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal(24) + 0.05 * rng.standard_normal((70, 24)) for _ in range(5)] + [rng.standard_normal((150, 24))]).astype(np.float32)
    label = np.arange(len(x)) % 3
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k), "a") for i, (v, k) in enumerate(zip(x, label, strict=True))], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicate_vectors(df).collect()}
    assert out == brute_links(np.arange(len(x)), x.astype(float), label)


def test_links_of_very_large_and_small_doubles(spark):
    rows = [(0, [1e200, 1e198], 1), (1, [1e200, 1.01e198], 1), (2, [1e-200, 0.0], 2), (3, [2e-200, 1e-203], 2), (4, [5e-324, 0.0], 2), (5, [0.0, 1e308], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicate_vectors(df).collect()}
    assert out == {0: (1, 0), 1: (1, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (0, 5)}
