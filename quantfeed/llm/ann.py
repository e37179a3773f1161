"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Training takes a bounded sample; every usable row is indexed. A row goes to the list of its nearest
coarse centroid, and its residual is kept as one code for each group of dimensions. A query adds up
code distances from a table made for its residual, in two rounds. The first visits its nearest lists;
the distance of the last candidate that they leave room for bounds all that can still get in. The
second visits the other lists with that bound, so what it sends on hardly grows with the table. The
best of both are ranked again by the exact distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.llm.common import durable
from quantfeed.llm.embdedup import usable

#: Coarse centroids and codebooks are fitted on about so many vectors, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Sampled vectors a coarse centroid should have at least; bounds the number of lists.
TRAIN_A_LIST = 16
#: Share of the lists that a query visits, and the least number of them.
PROBE_SHARE, PROBE_LEAST = 0.65, 16
#: Share of the visited rows that the first round looks at.
FIRST_SHARE = 0.1
CODES = 256
#: Codes, and queries, of a list that meet at once in a task.
BLOCK, CHUNK = 4096, 256
#: Candidates of a query that are ranked exactly, for each neighbour asked for.
RERANK = 20
#: Candidates that a task holds before it keeps the best of each query.
HELD = 1_000_000


def _near(x: np.ndarray, c: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and the squared distance to it, few rows at a time."""
    near, d = np.empty(len(x), np.int64), np.empty(len(x))
    square = (c * c).sum(axis=1)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        s = square - 2 * part @ c.T
        near[i : i + step] = s.argmin(axis=1)
        d[i : i + step] = s.min(axis=1) + (part * part).sum(axis=1)
    return near, d


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of at most k clusters; empty ones restart at the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near, d = _near(x, c)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        used = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.cumsum(n)[used] - n[used], axis=0)
        c = c.copy()
        c[used] = sums / n[used, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-d, kind="stable")[: len(empty)]
            c[empty[: len(far)]] = x[far]
    return c


@dataclass
class Index:
    """Coarse centroids (lists x dim) and one codebook (codes x dims) for each group of dimensions."""

    centroids: np.ndarray
    books: list[np.ndarray]
    groups: list[np.ndarray]

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, residual: np.ndarray) -> np.ndarray:
        out = np.empty((len(residual), len(self.groups)), np.uint8)
        for g, (dims, book) in enumerate(zip(self.groups, self.books, strict=True)):
            out[:, g] = _near(residual[:, dims], book)[0]
        return out

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to the codes of a list, from each query's own tables."""
        out = np.zeros((len(residual), len(codes)))
        for g, (dims, book) in enumerate(zip(self.groups, self.books, strict=True)):
            r = residual[:, dims]
            table = (r * r).sum(axis=1)[:, None] - 2 * r @ book.T + (book * book).sum(axis=1)
            out += table[:, codes[:, g]]
        return out


def fit(sample: np.ndarray, lists: int, dims_a_code: int = 4) -> Index:
    centroids = kmeans(sample, lists)
    residual = sample - centroids[_near(sample, centroids)[0]]
    groups = np.array_split(np.arange(sample.shape[1]), math.ceil(sample.shape[1] / dims_a_code))
    return Index(centroids, [kmeans(residual[:, g], CODES, rounds=8) for g in groups], groups)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that ``queries`` holds for, the k nearest found.

    Score: Euclidean distance in double precision; ties go to the smaller id, and a row is no neighbour
    of itself. With fewer candidates, all are returned. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do null ids. Repeated ids: the row whose vector sorts
    first counts. Vectors of several sizes: no distance joins two sizes, so each size has an index
    of its own. Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = durable(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")))
    asks = F.count(F.when(F.col("asks"), 1)).alias("asked")
    sizes = [r for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), asks).orderBy("d").collect() if r["asked"]]
    if not sizes:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    found = [_candidates(rows.filter(F.size("v") == r["d"]), r["d"], r["n"], r["asked"], RERANK * k) for r in sizes]
    near = found[0]
    for other in found[1:]:
        near = near.union(other)
    origin = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = near.join(rows.select("id", "v"), "id").join(origin, "query_id")
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = exact.select("query_id", F.col("id").alias("vec_id"), F.sqrt(square).alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(rows: DataFrame, dim: int, total: int, asked: int, most: int) -> DataFrame:
    """Rows (query_id, id): each asking row's ``most`` nearest by code distance, of vectors of one size."""
    sc = rows.sparkSession.sparkContext
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    sample = np.array([r["v"] for r in rows.filter(draw < math.ceil(1e6 * min(1.0, TRAIN_ROWS / total))).select("v").collect()]).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r["v"] for r in rows.select("v").limit(TRAIN_ROWS).collect()])
    index = fit(sample, max(1, min(TRAIN_ROWS // TRAIN_A_LIST, round(math.sqrt(total)))))
    lists = len(index.centroids)
    probes = min(lists, max(PROBE_LEAST, math.ceil(PROBE_SHARE * lists)))
    # Arrays alone are broadcast; workers put the index together again.
    held = sc.broadcast((index.centroids, index.books, index.groups))

    def assign(batches):
        at = Index(*held.value)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                near = _near(x, at.centroids)[0]
                codes = at.encode(x - at.centroids[near])
                flat = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), code], ["id", "list", "code"])

    coded = durable(rows.select("id", "v").mapInArrow(assign, "id long, list int, code binary"))
    # One row a list: at most TRAIN_ROWS / TRAIN_A_LIST.
    sizes = coded.groupBy("list").agg(F.count("*").alias("n"))
    held_rows = np.zeros(lists, np.int64)
    for r in sizes.collect():
        held_rows[r["list"]] = r["n"]
    first_rows = max(2 * most, round(FIRST_SHARE * PROBE_SHARE * total))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("part")
    blocks = coded.join(F.broadcast(sizes), "list").select("list", part, F.struct("id", "code").alias("m")).groupBy("list", "part").agg(F.collect_list("m").alias("ms"))
    blocks = durable(blocks)
    chunk = F.pmod(F.xxhash64("query_id", "list"), F.lit(math.ceil(asked / CHUNK))).alias("chunk")

    def visits(asking: DataFrame, first: bool) -> DataFrame:
        def visit(batches):
            at = Index(*held.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = at.lists(_matrix(batch.column(1)), probes)
                before = np.cumsum(held_rows[near], axis=1) - held_rows[near]
                r, c = np.nonzero((held_rows[near] > 0) & ((before < first_rows) == first))
                cols = [batch.column(i).take(pa.array(r)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(near[r, c].astype(np.int32))], ["query_id", "q", "bound", "list"])

        going = asking.select("query_id", "q", "bound").mapInArrow(visit, "query_id long, q array<double>, bound double, list int")
        going = going.select("list", chunk, F.struct("query_id", "q", "bound").alias("m")).groupBy("list", "chunk").agg(F.collect_list("m").alias("qs"))
        return going.join(blocks, "list").select("list", "qs", "ms").mapInArrow(scan, "query_id long, id long, adc double")

    def best_of(cols: list[np.ndarray]) -> list[np.ndarray]:
        """The ``most`` nearest of each query; of equal ones the smaller ids."""
        order = np.lexsort((cols[1], cols[2], cols[0]))
        q = cols[0][order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return [c[order[place < most]] for c in cols]

    def scan(batches):
        at = Index(*held.value)
        parts: list[list[np.ndarray]] = []
        n = 0

        def kept() -> list[np.ndarray]:
            return best_of([np.concatenate(c) for c in zip(*parts, strict=True)])

        def sent(cols):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "adc"])

        for batch in batches:
            for r in range(batch.num_rows):
                centroid = at.centroids[batch.column(0)[r].as_py()]
                qs, ms = batch.column(1)[r].values, batch.column(2)[r].values
                ids, codes = np.asarray(ms.field("id")), np.frombuffer(b"".join(ms.field("code").to_pylist()), np.uint8).reshape(len(ms), -1)
                asking, bound = np.asarray(qs.field("query_id")), np.asarray(qs.field("bound"))
                d = at.distances(_matrix(qs.field("q")) - centroid, codes)
                near = (d <= bound[:, None]) & (asking[:, None] != ids)
                if len(ids) > most:  # no block gives more than `most` to a query; ties are settled in best_of
                    near &= d <= np.partition(np.where(near, d, np.inf), most - 1, axis=1)[:, most - 1, None]
                i, j = np.nonzero(near)
                parts.append([asking[i], ids[j], d[i, j]])
                n += len(i)
                if n > HELD:
                    cols = kept()
                    parts, n = [cols], len(cols[0])
                    if n > HELD // 2:  # many queries meet in this task: send what it has
                        yield sent(cols)
                        parts, n = [], 0
        if n:
            yield sent(kept())

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("adc", "id"))
    asking = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    first = visits(asking.withColumn("bound", F.lit(float("inf"))), first=True)
    first = durable(first.withColumn("place", place).filter(F.col("place") <= most))
    bounds = first.filter(F.col("place") == most).select("query_id", F.col("adc").alias("bound"))
    bounded = asking.join(bounds, "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    both = first.drop("place").union(visits(bounded, first=False))
    return both.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "id")
