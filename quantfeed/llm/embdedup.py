"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are scaled to length 1 and turned by a seeded random rotation. A vector's code holds the signs
of its turned coordinates, and its correction factor is the inner product of the turned vector with
the code's own unit vector. For another vector q, <code, q> / factor is an unbiased estimate of the
cosine. For a pair at the threshold its error has a known spread, so an estimate more than ``SIGMAS``
below settles the pair; all others are computed exactly.

Each vector's code and factor are worked out once and stored, with its turned coordinates rounded to
one byte each as the q of others; the bound allows for the rounding. Pairs meet in buckets: bands of
code bits, as wide as the largest label asks for and as many as lose one pair in MISS at the
threshold. Only what is stored travels there, not the vectors. Buckets are cut into blocks of bounded
size, and each pair of blocks is a row of its own, so a large group doesn't meet in one place. A pair
counts in the first band that it shares, so its vectors are fetched for that band alone. What leaves
a pair of blocks is one row per linked member, with its number of links and a root; pairs are never
written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, slices
from quantfeed.llm.graph import components

MISS = 1e-5
SIGMAS = 5.0
BLOCK = 256
#: Members that a bucket of unrelated vectors should have at most.
BUCKET = 16
#: Members of blocks that a task unpacks at once.
MEMBERS = 65_536


def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """dim x (at least bits) matrix of orthonormal rotations side by side."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))])


def bands_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for so many rows under one label."""
    same = 1 - math.acos(threshold) / math.pi
    width = min(24, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET))) if rows > BUCKET else 4)
    return width, math.ceil(math.log(MISS) / math.log(1 - same**width))


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _rows_of(a: np.ndarray) -> pa.Array:
    """A list column whose rows are the rows of ``a``."""
    flat = pa.array(a.ravel())
    return pa.FixedSizeListArray.from_arrays(flat, a.shape[1]).cast(pa.list_(flat.type))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def near_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Links of ``vectors`` (id, label, v, n): pairs of equal label with cosine >= threshold.

    Rows (id, root, others), several per linked id: ``others`` add up to the copies ``n`` of all that
    the id is linked with, and the edges (root, id) connect whatever links connect.
    """
    first = vectors.select(F.size("v").alias("d")).first()
    if first is None:
        return vectors.select("id", F.col("id").alias("root"), F.col("n").alias("others")).limit(0)
    rows = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    width, count = bands_for(rows, threshold)
    dim = first["d"]
    turn = rotations(dim, max(width * count, dim))
    powers = 1 << np.arange(width)
    kind, numbers = (vectors.schema[c].dataType.simpleString() for c in ("label", "v"))

    def keys_of(signs: np.ndarray) -> np.ndarray:
        return signs[:, : width * count].reshape(len(signs), count, width) @ powers

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(2))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            turned = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ turn
            head, signs = turned[:, :dim], turned > 0
            step = np.abs(head).max(axis=1) / 127
            levels = np.rint(head / step[:, None]).astype(np.int8)
            factor = np.abs(head).sum(axis=1) / math.sqrt(dim)
            stored = [_rows_of(np.packbits(signs, axis=1).view(np.int8)), pa.array(factor), _rows_of(levels), pa.array(step), _rows_of(keys_of(signs).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *stored], ["id", "label", "v", "copies", "code", "factor", "levels", "step", "keys"])

    coded = "copies long, code array<tinyint>, factor double, levels array<tinyint>, step double"
    codes = vectors.select("id", "label", "v", "n").mapInArrow(encode, f"id long, label {kind}, v {numbers}, {coded}, keys array<int>")
    codes = durable(codes)
    stored = ["id", "copies", "code", "factor", "levels", "step"]
    bucket = ["label", "band", "key"]
    posted = codes.select("label", *stored, F.posexplode("keys").alias("band", "key"))
    sizes = codes.select("label", F.posexplode("keys").alias("band", "key")).groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("c")).filter("c > 1").drop("c")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    blocks = posted.join(sizes, bucket).select(*bucket, "parts", part, F.struct(*stored).alias("m"))
    blocks = durable(blocks.groupBy(*bucket, "parts", "part").agg(F.collect_list("m").alias("x")))
    # A block meets itself where it lies; in buckets of several blocks it also goes to each one before it.
    itself = blocks.select(*bucket, F.col("part").alias("p"), F.col("part").alias("q"), "x", F.when(F.lit(False), F.col("x")).alias("y"))
    several = blocks.filter("parts > 1")
    before = several.filter("part > 0").select(*bucket, F.col("part").alias("q"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"))
    others = several.withColumnRenamed("part", "p").join(before, [*bucket, "p"])
    meetings = itself.unionByName(others.select(*bucket, "p", "q", "x", "y"))

    sine = math.sqrt(1 - threshold * threshold)

    def read(lists: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        """The members of all blocks one after another and where each block begins."""
        members = lists.flatten()
        code = np.asarray(members.field("code").flatten()).view(np.uint8).reshape(len(members), -(-turn.shape[1] // 8))
        step = np.asarray(members.field("step"))
        turned = np.asarray(members.field("levels").flatten()).reshape(len(members), dim) * step[:, None]
        vectors = [np.asarray(members.field("v").flatten(), np.float64).reshape(len(members), dim)] if members.type.get_field_index("v") >= 0 else []
        begins = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        return [np.asarray(members.field("id")), np.unpackbits(code, axis=1), np.asarray(members.field("factor")), turned, step, np.asarray(members.field("copies")), *vectors], begins

    def pairs_of_blocks(lefts: pa.ListArray, rights: pa.ListArray):
        """(row, whether a block meets itself, its members, the other's members), read some thousand members at a time."""
        sizes = np.asarray(lefts.value_lengths().fill_null(0)) + np.asarray(rights.value_lengths().fill_null(0))
        for lo, hi in slices(sizes, MEMBERS):
            (xs, x_begins), (ys, y_begins) = read(lefts.slice(lo, hi - lo)), read(rights.slice(lo, hi - lo))
            for r in range(hi - lo):
                x = [a[x_begins[r] : x_begins[r + 1]] for a in xs]
                own = y_begins[r] == y_begins[r + 1]
                yield lo + r, own, x, x if own else [a[y_begins[r] : y_begins[r + 1]] for a in ys]

    def undecided(x: list[np.ndarray], y: list[np.ndarray], band: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share this band first and whose bound reaches the threshold."""
        (ids, signs, factor), (other, other_signs, _, turned, step) = x[:3], y[:5]
        estimate = ((signs[:, :dim] * 2.0 - 1) @ turned.T) / (math.sqrt(dim) * factor[:, None])
        spread = sine * np.sqrt(np.maximum(1 - factor * factor, 0)) / factor / math.sqrt(max(dim - 1, 1))
        rounding = math.sqrt(dim) / 2 * step[None, :] / factor[:, None]
        i, j = np.nonzero(estimate >= threshold - SIGMAS * spread[:, None] - rounding - 1e-9)
        if own:
            i, j = i[ids[i] < other[j]], j[ids[i] < other[j]]
        if not len(i):
            return i, j
        keys, other_keys = keys_of(signs), keys_of(other_signs)
        keep = (keys[i] == other_keys[j]).argmax(axis=1) == band
        return i[keep], j[keep]

    def bounds(batches):
        for batch in batches:
            at, left, right = [], [], []
            bands = np.asarray(batch.column(1))
            for r, own, x, y in pairs_of_blocks(batch.column(5), batch.column(6)):
                i, j = undecided(x, y, bands[r], own)
                if len(i):
                    at.append(r)
                    left.append(np.unique(x[0][np.append(i, j) if own else i]))
                    right.append(np.unique(y[0][j])[: 0 if own else None])
            if at:
                place = [c.take(pa.array(at)) for c in batch.columns[:5]]
                lists = [pa.array(ids, pa.list_(pa.int64())) for ids in (left, right)]
                yield pa.RecordBatch.from_arrays([*place, *lists], ["label", "band", "key", "p", "q", "left", "right"])

    near = durable(meetings.mapInArrow(bounds, f"label {kind}, band int, key int, p int, q int, left array<long>, right array<long>"))
    wanted = near.select(*bucket, F.col("p").alias("part"), F.explode("left").alias("id")).union(near.select(*bucket, "q", F.explode("right"))).distinct()
    fetched = wanted.join(codes.select(*stored, "v"), "id").groupBy(*bucket, "part").agg(F.collect_list(F.struct(*stored, "v")).alias("ms"))
    fetched = durable(fetched)
    other_part = F.when(F.col("p") < F.col("q"), F.col("q")).alias("q")
    open_meetings = near.select(*bucket, "p", other_part)
    open_meetings = open_meetings.join(fetched.select(*bucket, F.col("part").alias("p"), F.col("ms").alias("x")), [*bucket, "p"])
    open_meetings = open_meetings.join(fetched.select(*bucket, F.col("part").alias("q"), F.col("ms").alias("y")), [*bucket, "q"], "left").select("band", "x", "y")

    def exact(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            bands = np.asarray(batch.column(0))
            for r, own, a, b in pairs_of_blocks(batch.column(1), batch.column(2)):
                i, j = undecided(a, b, bands[r], own)
                x, y = _scaled(a[-1])[i], _scaled(b[-1])[j]
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                nodes, weights = a[0], a[5]
                if not own:
                    nodes, weights, j = np.append(nodes, b[0]), np.append(weights, b[5]), j + len(nodes)
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                linked = links > 0
                root = _roots(len(nodes), i, j)
                for col, v in zip(found, (nodes[linked], nodes[root[linked]], links[linked]), strict=True):
                    col.append(v)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["id", "root", "others"])

    return open_meetings.mapInArrow(exact, "id long, root long, others long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per row of ``vectors``.

    Two rows are linked if their labels are equal and their cosine, in double precision, is at least
    the threshold. Null labels and vectors that are null, empty, zero or hold null or non-finite
    components: no links, component of their own. Equal vectors of one label are compared as one and
    counted as many. Vectors of several sizes link with their own size only. Floats stay floats and all
    other numbers become doubles. Null ids: n_links as others, kept false. Extra columns are left out,
    whatever their names. An empty table gives no rows.
    """
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    ok = usable("v") & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(ok, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x))))
    classes = durable(rows.filter("v is not null").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("rep is not null"))
    sizes = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    links = None
    for d in sizes:  # one, unless vectors of several sizes are mixed
        found = near_links(classes.filter(F.size("v") == d).select(F.col("rep").alias("id"), "label", "v", "n"), threshold)
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = durable(links)
    degree = links.groupBy(F.col("id").alias("rep")).agg(F.sum("others").alias("others"))
    edges = links.filter("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b"))
    comps = components(edges).withColumnRenamed("node", "rep")
    of_class = classes.join(degree, "rep", "left").join(comps, "rep", "left").select("label", "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    out = rows.join(of_class, ["label", "v"], "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("comp"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
