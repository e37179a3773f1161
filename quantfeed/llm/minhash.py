"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles. Its sketch is the k smallest of them.

1. Documents with equal sets form a class and go on as one row.
2. The smallest retained values of every class are posted to inverted lists. A pair over the
   threshold shares at least ``t`` of them, up to five standard deviations of the sketch's error,
   so each class needs only the lists of its rarest ``m - t + 1`` values among the ``m`` it shares
   with anyone; a passage that many documents hold seldom gets into these.
3. In each list, members are compared with one leader. Links give components, and only members of
   different components are compared again: first with better leaders, in the end pair by pair where
   exact prefixes of the full sets meet. A large group of near copies costs a few comparisons a
   member instead of all pairs.
4. The sketch of the union estimates each pair's similarity and drops what is far below; full sets
   confirm the rest exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, mix64, slices
from quantfeed.llm.graph import components

SLICE_CHARS = 400_000
STAR_ROUNDS = 2
#: Members of a list that meet its strays in one task.
PART = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles of ``width`` words.

    A-Z count as a-z, words are runs of other bytes than 0x20 and 0x09-0x0D. A text of fewer words
    is one shingle; a text without words or a null has none.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[buf]
    ink = np.flatnonzero(~space)
    if not len(ink):
        return [np.empty(0, np.uint64) for _ in texts]
    new = np.empty(len(ink), bool)
    new[0] = True
    new[1:] = np.diff(ink) > 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ink)))
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power, dtype=np.uint64)
    place = np.arange(len(ink)) - np.repeat(first, size)
    words = mix64(np.add.reduceat(_BYTE[buf[ink]] * power[place], first) + size.astype(np.uint64) * _STEP)
    ends = np.cumsum([len(b) + 1 for b in raw])
    bounds = np.concatenate([[0], np.searchsorted(ink[first], ends)])
    rolled = np.zeros(len(words), np.uint64)
    if len(words) >= width:
        for i in range(width):
            rolled[: len(words) - width + 1] = rolled[: len(words) - width + 1] * _STEP + words[i : len(words) - width + 1 + i]
    rolled = mix64(rolled + np.uint64(width)) >> np.uint64(1)
    out = []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if j - i >= width:
            out.append(np.unique(rolled[i : j - width + 1]))
        elif j > i:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[i:j]:
                    short = short * _STEP + w
                short += np.uint64(int(j - i))
            out.append(mix64(np.array([short])) >> np.uint64(1))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _each_set(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """The other columns and the sets of rows whose last column is a text."""
    for batch in batches:
        others, texts = batch.columns[:-1], batch.columns[-1].to_pylist()
        for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
            yield [c.slice(i, j - i) for c in others], shingle_sets(texts[i:j], width)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([*parts, np.empty(0, np.uint64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketch(width: int, k: int):
    def run(batches):
        for ids, sets in _each_set(batches, width):
            h1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            h2 = [int(np.bitwise_xor.reduce(mix64(s ^ _STEP)).view(np.int64)) if len(s) else 0 for s in sets]
            cols = [*ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists([s[:k] for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "t", "n", "h1", "h2", "sketch"])

    return run


def _full(width: int):
    def run(batches):
        for ids, sets in _each_set(batches, width):
            yield pa.RecordBatch.from_arrays([*ids, _lists(sets)], ["id", "shingles"])

    return run


def _least_shared(retained: int, percent: int) -> int:
    """Of so many retained values, a pair over the threshold shares this many but for five sigmas."""
    s = percent / 100
    return max(1, math.floor(retained * s - 5 * math.sqrt(retained * s * (1 - s))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, k: int = 64, posted: int = 32) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one per row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id
    is the smallest id reachable by links, kept tells whether it is the row's own. Null text, empty
    text and text without words: n_shingles 0, linked with nothing. Texts of any length count whole.
    Rows are compared by their texts: repeated rows share a class, and each is kept if its id is the
    smallest; two texts under one id are compared each for itself. Null ids link like others but come
    after all ids: kept is false, and component_id is the smallest id of the group or null. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    base = durable(texts.mapInArrow(_sketch(width, k), "id long, t long, n long, h1 long, h2 long, sketch array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    classes = durable(base.filter("n > 0").groupBy("n", "h1", "h2").agg(first, F.first("sketch").alias("sketch")))
    # A class goes by its smallest id; by a number in the order of ids if two classes share one or one has none.
    clash = classes.groupBy("first.id").agg(F.count("*").alias("c")).filter("c > 1 or id is null")
    numbered = not clash.isEmpty()
    if numbered:
        classes = durable(classes.orderBy("first", "h1", "h2").withColumn("rep", F.monotonically_increasing_id()))
    else:
        classes = classes.withColumn("rep", F.col("first.id"))

    postings = classes.select("rep", "n", F.explode(F.slice("sketch", 1, posted)).alias("v"))
    # Written down, here and below: a join of two plain tables can split a value that many hold, one with an
    # aggregate that is dealt by the same value can't.
    shared = durable(postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"))
    t = F.least(F.lit(_least_shared(posted, percent)), F.ceil(F.col("n") * percent / 100)).cast("int")
    ranked = postings.join(shared, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    keys = ranked.withColumn("t", t).filter(F.size("vs") >= F.col("t")).select("rep", "n", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("t") + 1)).alias("e"))
    lists = durable(keys.select("rep", "n", F.col("e.v").alias("v")))

    members = durable(classes.join(lists.select("rep").distinct(), "rep", "left_semi").select("rep", "first", "sketch"))
    # One row of each class, known by id and text, brings its text.
    wanted = members.select("rep", F.col("first.t").alias("t"), F.col("first.id").alias("of"))
    fetched = texts.join(wanted, "t").filter(F.col("id").eqNullSafe(F.col("of"))).dropDuplicates(["t", "rep"])
    sets = durable(fetched.select("rep", "text").mapInArrow(_full(width), "id long, shingles array<long>"))
    sketches = members.select("rep", "sketch")

    links = None
    comps = None
    for last in [False] * STAR_ROUNDS + [True]:
        at = lists.withColumn("comp", F.col("rep")) if comps is None else lists.join(comps, F.col("rep") == F.col("node"), "left").select("rep", "n", "v", F.coalesce("comp", "rep").alias("comp"))
        open_lists = durable(at.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v"))
        at = durable(at.join(open_lists, "v", "left_semi"))
        if at.isEmpty():
            break
        if last:
            pairs = _across(at, sets, percent)
        else:
            pairs = _with_leaders(at, links, percent)
        found = durable(_confirmed(pairs, sketches, sets, percent, k))
        links = found if links is None else durable(links.union(found))
        comps = components(links)

    if comps is None:
        grouped = classes.select("n", "h1", "h2", F.col("rep").alias("component_id"))
    else:
        grouped = classes.join(comps, F.col("rep") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    if numbered:
        named = classes.select(F.col("rep").alias("component_id"), F.col("first.id").alias("smallest"))
        grouped = grouped.join(named, "component_id").select("n", "h1", "h2", F.col("smallest").alias("component_id"))
    out = base.drop("sketch").join(grouped, ["n", "h1", "h2"], "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def _fits(percent: int):
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _with_leaders(at: DataFrame, links: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of each list's members with its leader: the one with the most links so far, then the smallest."""
    if links is None:
        leader = at.groupBy("v").agg(F.min_by(F.struct("rep", "n", "comp"), "rep").alias("l"))
    else:
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("d"))
        rank = F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("rep")).alias("r"))
        leader = at.join(degree, "rep", "left").groupBy("v").agg(F.max_by(F.struct("rep", "n", "comp"), rank).alias("l"))
    leader = durable(leader.select("v", F.col("l.rep").alias("other"), F.col("l.n").alias("m"), F.col("l.comp").alias("other_comp")))
    return _ordered(at.join(leader, "v").filter((F.col("comp") != F.col("other_comp")) & _fits(percent)))


def _across(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may still reach the threshold, by exact prefixes of full sets.

    With all sets in one order, rarest values first, a pair that must share ``o`` values has one in
    common among the first n - o + 1 of either set. Copies with many edits of their own have these all
    in rare values, so they don't meet in a large group's lists. The later a value stands in a prefix, the smaller
    a set must be to still share enough, so a member looks only into the lists of the size classes that its place
    allows: pages of one template whose own words come first meet in none. Within a list, only members outside
    its largest component are joined with the others, and a long list is cut into parts that meet them
    in tasks of their own.
    """
    members = durable(at.select("rep", "n", "comp").distinct())
    posts = members.select("rep").join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", F.explode("shingles").alias("v"))
    counts = durable(posts.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"))
    ranked = posts.join(counts, "v", "left").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "v"))).alias("vs"))
    longest = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    keys = ranked.join(members, "rep").select("rep", "n", "comp", F.posexplode(F.slice("vs", F.lit(1), longest)).alias("pos", "e"))
    keys = durable(keys.filter("e.df > 1").select("rep", "n", "comp", "pos", F.col("e.v").alias("v")))
    sizes = keys.groupBy("v", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    keys = keys.join(durable(largest), "v").withColumn("kind", _size_class(F.col("n")))
    parts = durable(keys.groupBy("v", "kind").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    # At place pos a set of n shares enough with no set of more than this many values.
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n"))
    fewest = F.ceil(F.col("n") * percent / 100)
    strays = keys.filter("comp <> main").filter(most >= fewest).withColumn("kind", F.explode(F.sequence(_size_class(fewest), _size_class(most))))
    strays = strays.join(parts, ["v", "kind"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")
    others = keys.join(parts, ["v", "kind"]).select("v", "kind", own, F.col("rep").alias("other"), F.col("n").alias("m"), F.col("comp").alias("other_comp"), F.col("pos").alias("other_pos"))
    different = (F.col("comp") != F.col("other_comp")) & ((F.col("other_comp") == F.col("main")) | (F.col("rep") < F.col("other")))
    least = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    near = (F.col("pos") <= F.col("n") - least) & (F.col("other_pos") <= F.col("m") - least)
    return _ordered(strays.join(others, ["v", "kind", "part"]).filter(different & _fits(percent) & near))


def _size_class(n: Column) -> Column:
    """Sizes of one class differ by five percent at most."""
    return F.floor(F.ln(F.greatest(n, F.lit(1))) / math.log(1.05)).cast("int")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, after the estimate from the union's sketch."""
    sa = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    enough = F.when(F.size(union) < k, F.ceil(F.size(union) * percent / 100)).otherwise(_least_shared(k, percent))
    likely = pairs.join(sa, "a").join(sb, "b").filter(common >= enough).select("a", "b")
    fa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("fa"))
    fb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("fb"))
    both = likely.join(fa, "a").join(fb, "b").select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("i"), (F.size("fa") + F.size("fb")).alias("s"))
    return both.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")
