"""Audit of how sources of a language differ: iceberg prefix refinement finds the terms, then counts are compared.

1. Terms grow level by level. A level counts, for each language, the distinct documents that hold a
   prefix of so many bytes; terms that end within it are counted as they are. What falls below the threshold
   is dropped, and only terms whose prefix is left are looked at in the next level, with prefixes
   twice as long, until no prefix is open. A rare term's bytes are never dealt out beyond the level that drops it.
2. Open prefixes go to the next level's tasks as a bitmap of fixed size. A slot that two prefixes share
   lets a rare one through, which only costs work: whether a term stays is decided by its own count.
3. Kept terms of all sources of a language stand in one row, so a group without the term is known to hold none.
   Tasks fill small dense blocks of terms by sources and add up the pairs' differences in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, key_slot, sent_slots, slices, slots_here, slots_hold, slots_of, slots_taken

#: Bytes of the first level's prefixes; every level doubles them.
FIRST = 4
#: Bytes of text that one task looks at together; a longer text comes alone, cut between terms.
SLICE_BYTES = 4_000_000
#: Sources whose rows of pair sums are held together, terms by sources in one dense block, sums held at once.
SOURCES, CELLS, HELD = 256, 1_000_000, 8_000_000
#: Probabilities are whole numbers in this unit.
UNIT = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_COUNTS = "lang string, source string, term binary, occ long, docs long, whole boolean"


def words_of(buf: np.ndarray, begins: np.ndarray, longer: int) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of more than ``longer`` bytes, and the row of each; ``begins`` has each row's first byte."""
    ink = np.flatnonzero(_LETTER[buf])
    new = np.ones(len(ink), bool)
    new[1:] = np.diff(ink) > 1
    at = np.searchsorted(ink, begins)
    new[at[at < len(ink)]] = True
    first = np.append(np.flatnonzero(new), len(ink))
    rows = np.searchsorted(begins, ink[first[:-1]], side="right") - 1
    words = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(_LOWER[buf[ink]])])
    if longer:
        long = np.diff(first) > longer
        words, rows = words.filter(pa.array(long)), rows[long]
    return words, rows


def _pieces(buf: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``most`` bytes, cut before a byte that is in no term."""
    begin = 0
    while begin < len(buf):
        end = min(begin + most, len(buf))
        if end < len(buf):
            rest = np.flatnonzero(~_LETTER[buf[end:]])
            end = end + int(rest[0]) if len(rest) else len(buf)
        yield buf[begin:end]
        begin = end


def _terms(buf: np.ndarray, begins: np.ndarray, longer: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; and for each row and term that it holds: row, place of the term, occurrences."""
    if len(begins) > 1 or len(buf) <= 2 * SLICE_BYTES:
        words, rows = words_of(buf, begins, longer)
        coded = words.dictionary_encode()
        code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        key, occ = np.unique(rows * max(1, len(terms)) + code, return_counts=True)
        return terms, key // max(1, len(terms)), key % max(1, len(terms)), occ
    parts = []
    for piece in _pieces(buf, SLICE_BYTES):
        terms, _, code, occ = _terms(piece, np.zeros(1, np.int64), longer)
        parts.append(pa.table({"t": terms.take(pa.array(code)), "n": pa.array(occ, pa.int64())}))
    whole = pa.concat_tables(parts).group_by("t").aggregate([("n", "sum")])
    terms, occ = whole["t"].combine_chunks(), whole["n_sum"].to_numpy()
    return terms, np.zeros(len(occ), np.int64), np.arange(len(occ)), occ


def _level(before: int, length: int, sent):
    """Counts of the terms of ``before`` + 1 to ``length`` bytes, and of the prefixes of longer ones."""

    def run(batches):
        bits = None if sent is None else slots_here(sent)
        for batch in batches:
            offsets = np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: len(batch) + 1].astype(np.int64)
            data = batch.column(2).buffers()[2]
            every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            for i, j in slices(np.diff(offsets).tolist(), SLICE_BYTES):
                yield from counted(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), every[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], bits)

    def counted(lang, source, buf, begins, bits):
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        sources = len(source.dictionary)
        terms, row, code, occ = _terms(buf, begins, before)
        if not len(terms):
            return
        if bits is not None:
            prefix = pc.binary_slice(terms, 0, before).dictionary_encode()
            place = prefix.indices.to_numpy().astype(np.int64)
            many = len(prefix.dictionary)
            pairs, back = np.unique(of_lang[row] * many + place[code], return_inverse=True)
            names, keys = lang.dictionary.to_pylist(), prefix.dictionary.to_pylist()
            live = np.zeros(len(pairs), bool)
            for k in np.unique(pairs // many):
                own = pairs // many == k
                live[own] = slots_hold(bits, slots_of(names[k], [keys[p] for p in pairs[own] % many]))
            left = live[back]
            row, code, occ = row[left], code[left], occ[left]
        size = pc.binary_length(terms).to_numpy()
        ends = size[code] <= length
        n = len(terms)
        key, back, docs = np.unique((of_lang[row[ends]] * sources + of_source[row[ends]]) * n + code[ends], return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=occ[ends], minlength=len(key)).astype(np.int64)
        group = key // n
        yield batch_of(lang.dictionary.take(pa.array(group // sources)), source.dictionary.take(pa.array(group % sources)), terms.take(pa.array(key % n)), total, docs, True)
        prefix = pc.binary_slice(terms, 0, length).dictionary_encode()
        place, n = prefix.indices.to_numpy().astype(np.int64), len(prefix.dictionary)
        held = np.unique(row[~ends] * n + place[code[~ends]])  # a document counts once for a prefix
        key, docs = np.unique(of_lang[held // n] * n + held % n, return_counts=True)
        langs = lang.dictionary.take(pa.array(key // n))
        yield batch_of(langs, pa.nulls(len(key), pa.string()), prefix.dictionary.take(pa.array(key % n)), np.zeros(len(key), np.int64), docs, False)

    def batch_of(lang, source, term, occ, docs, whole):
        cols = [lang, source, term, pa.array(occ, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.full(len(docs), whole))]
        return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "occ", "docs", "whole"])

    return run


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """Rows (lang, term, at): the terms in at least so many documents (rows) of a language, with occurrences by source.

    ``docs`` has lang, source and text without nulls. ``at`` holds a struct (source, occ) for every source with the term.
    """
    spark = docs.sparkSession
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    found, before, length, sent = None, 0, FIRST, None
    while True:
        counts = texts.mapInArrow(_level(before, length, sent), _COUNTS)
        # Sums a source first, so that a row a source is all that meets in one place.
        counts = counts.groupBy("whole", "lang", "term", "source").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))
        level = counts.groupBy("whole", "lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("source"), "occ")).alias("at"))
        level = durable(level.filter(F.col("docs") >= least_docs).drop("docs"))
        whole = level.filter("whole").select("lang", F.col("term").cast("string").alias("term"), "at")
        found = whole if found is None else found.union(whole)
        taken = slots_taken(level.filter("not whole"), key_slot("lang", "term"))
        if sent is not None:
            sent.destroy()  # the level is written down
        if taken is None:
            return found
        sent = sent_slots(spark, taken)
        before, length = length, 2 * length


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) that tell how each source departs from the others of its language.

    Part ``pair`` has every other source of the language, part ``term`` the terms that the source holds more
    often than its language, the first ``ranks`` of them. Null lang, source and text are read as ''. Every row is a
    document of its own, repeated rows and null ids included; ids and other columns are ignored, whatever their
    names. A group without terms takes part with counts of 0, a language without kept terms has pairs of value 0,
    one with a single source no pairs; empty tables give no rows. Texts of any length count whole. Ties
    go by the item's bytes. A row for every pair of sources is the result itself, so the list of all
    (lang, source) groups, its square root, is small enough to be sent to every task.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_terms(docs, least_docs)
    apart = kept.select("lang", "term", F.expr("aggregate(at.occ, 0L, (x, y) -> x + y)").alias("occ_lang"), F.explode("at").alias("e")).select("lang", "term", "occ_lang", "e.source", "e.occ")
    sums = apart.groupBy("lang", "source").agg(F.sum("occ").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    by_lang = Window.partitionBy("lang")
    groups = durable(groups.withColumn("n_lang", F.sum("n").over(by_lang)).withColumn("place", F.row_number().over(by_lang.orderBy("source")) - 1))
    return _terms_above(apart, groups, ranks).union(_pairs(kept, groups))


def _p(occ: str, n: str) -> str:
    """SQL of 1 + floor(UNIT * (occ + 1) / (n + v)), by decimals where the product may pass 64 bits."""
    plain, wide = f"({UNIT}L * ({occ} + 1)) div ({n} + v)", f"(cast({occ} + 1 as decimal(28, 0)) * {UNIT}) div cast({n} + v as decimal(20, 0))"
    return f"1 + if({occ} < 9000000000, {plain}, {wide})"


def _terms_above(apart: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    x = apart.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(_p("occ", "n")).alias("p"), F.expr(_p("occ_lang", "n_lang")).alias("q"))
    x = x.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= ranks)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    spark = kept.sparkSession
    rows = groups.select("lang", "source", "n", "v", "place").collect()  # the square root of the result
    known: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        known.setdefault(r["lang"], []).append((r["source"], r["n"] + r["v"]))
    sent = spark.sparkContext.broadcast(known)
    blocks = max((-(-len(x) // SOURCES) for x in known.values()), default=1)
    x = kept.select("lang", F.col("at.source").alias("source"), F.col("at.occ").alias("occ"))
    if blocks > 1:
        x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("lang", "block", F.pmod(F.xxhash64("source", "occ"), F.lit(16)))
    else:
        x = x.withColumn("block", F.lit(0))
    sums = x.mapInArrow(_pair_sums(sent), "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    a = groups.select("lang", "source", F.col("place").alias("i"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    pairs = a.join(b, "lang").filter("i <> j").join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _pair_sums(sent):
    """Sums of floor((p - q)^2 / q) over a task's terms for each two sources of a language, a block of first sources at a time."""

    def chances(occ, base):
        if occ.max(initial=0) < 9_000_000_000:
            return 1 + UNIT * (occ + 1) // base
        return np.array([1 + UNIT * (int(c) + 1) // int(b) for c, b in zip(occ, np.broadcast_to(base, occ.shape), strict=True)], np.int64)

    def run(batches):
        bases = {lang: (pa.array([s for s, _ in of], pa.string()), np.array([b for _, b in of], np.int64)) for lang, of in sent.value.items()}
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            where = pa.table({"lang": batch.column(0), "block": batch.column(3)})
            codes = [(lang, block) for lang, block in zip(*(where[c].to_pylist() for c in ("lang", "block")), strict=True)]
            for lang, block in set(codes):
                names, base = bases[lang]
                mine = batch.filter(pa.array([c == (lang, block) for c in codes]))
                lo, hi = block * SOURCES, min((block + 1) * SOURCES, len(base))
                if lo >= len(base):
                    continue
                total = sums.setdefault((lang, block), np.zeros((hi - lo, len(base)), np.int64))
                step = max(1, CELLS // len(base))
                for k in range(0, len(mine), step):
                    part = mine.slice(k, step)
                    lists, occ = part.column(1), part.column(2)
                    term = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
                    place = pc.index_in(lists.flatten(), value_set=names).to_numpy()
                    p = np.tile(chances(np.zeros(len(base), np.int64), base), (len(part), 1))
                    p[term, place] = chances(occ.flatten().to_numpy().astype(np.int64), base[place])
                    for i in range(lo, hi):
                        gap = p[:, i : i + 1] - p
                        total[i - lo] += (gap * gap // p).sum(axis=0)
            if sum(x.size for x in sums.values()) > HELD:
                yield from told(sums)
                sums.clear()
        yield from told(sums)

    def told(sums):
        for (lang, block), total in sums.items():
            i, j = np.indices(total.shape)
            cols = [pa.array([lang] * total.size, pa.string()), pa.array((i + block * SOURCES).ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "i", "j", "value"])

    return run


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS occ FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(occ) AS n FROM c GROUP BY lang, source),
stat AS (SELECT g.lang, g.source, coalesce(n.n, 0) AS n, v.v FROM g LEFT JOIN n USING (lang, source) LEFT JOIN v ON v.lang = g.lang),
chance AS (SELECT s.lang, s.source, k.term, coalesce(c.occ, 0) AS occ, 1 + (1000000000::HUGEINT * (coalesce(c.occ, 0) + 1)) // (s.n + s.v)::HUGEINT AS p
  FROM stat s JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM chance a JOIN chance b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
whole AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.occ) + 1)) // (any_value(t.n) + any_value(v.v))::HUGEINT AS q
  FROM c JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) t ON t.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term),
terms AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, CAST(((x.p - w.q) * (x.p - w.q)) // w.q AS BIGINT) AS value
  FROM chance x JOIN whole w ON w.lang = x.lang AND w.term = x.term WHERE x.occ > 0 AND x.p > w.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
