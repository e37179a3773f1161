"""Phrase collocations by dynamic itemset counting.

Documents are dealt into a few shards that are scanned in a cycle, one Spark job a shard. A phrase becomes
active at the first stop at which both of its subphrases (without its last and without its first word) have
reached the threshold in what was counted so far, and is counted in every shard once from there on. So
longer phrases start while shorter ones are still being counted: most of the work is done after one cycle
and a few shards more, where counting one length after the other reads all documents five times.

What is active goes to the tasks as a table of fixed size: for each slot the last stop at which a phrase there reached
the threshold. A phrase is counted if both subphrases' slots are filled, for one cycle after the later stop. A slot
that two phrases share makes tasks count more and longer than they have to; shards that a count holds
are remembered, so counting one twice changes nothing, and a phrase that really has the threshold is counted
in all shards, as its subphrases have it too. Rare phrases are forgotten when their cycle is over.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, slices, slots_taken

#: Shards of the cycle, and words of the longest phrase.
SHARDS, LONGEST = 2, 5
#: Bytes of text that one task looks at together; a longer text comes alone, in parts that end where a piece ends.
SLICE_BYTES = 10_000_000
#: Slots of the table of stops, a byte each, and the factor by which a word turns a phrase's slot on.
SLOTS, TURN = 1 << 24, 1_000_003

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_COUNTS = "lang string, phrase string, n long, state long"


def _piece_ends(buf: np.ndarray, most: int) -> list[int]:
    """Where to cut a long text into parts of about ``most`` bytes; pieces stay whole."""
    cuts, begin = [0], 0
    while len(buf) - begin > most:
        rest = np.flatnonzero(_BREAK[buf[begin + most :]])
        if not len(rest):
            break
        begin += most + int(rest[0])
        cuts.append(begin)
    return [*cuts, len(buf)]


def words_and_links(buf: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words, the row of each, and whether the next word stands in the same piece."""
    ends_piece = _BREAK[buf]
    ink = np.flatnonzero(~(ends_piece | _GAP[buf]))
    new = np.ones(len(ink), bool)
    new[1:] = np.diff(ink) > 1
    at = np.searchsorted(ink, begins)
    new[at[at < len(ink)]] = True
    first = np.append(np.flatnonzero(new), len(ink))
    starts = ink[first[:-1]]
    rows = np.repeat(np.arange(len(begins)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    piece = np.searchsorted(np.flatnonzero(ends_piece), starts)
    linked = np.zeros(len(rows), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    words = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(_LOWER[buf[ink]])])
    return words, rows, linked


def _key_slot() -> Column:
    """Slot of a phrase: its language's and words' checksums, one after the other."""
    begin = F.crc32("lang") % SLOTS
    return F.aggregate(F.split("phrase", " ", -1), begin, lambda slot, word: (slot * TURN + F.crc32(word)) % SLOTS)


def _scan(step: int, sent):
    """Counts of active phrases in a task's texts, and the step with which each has been counted everywhere.

    Single words are counted in the first SHARDS steps. ``sent``: for each slot 1 + the last step at which a phrase there
    reached the threshold, 0 for none.
    """

    def run(batches):
        latest = None if sent is None else np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for batch in batches:
            text = batch.column(1)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1].astype(np.int64)
            data = text.buffers()[2]
            every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            for i, j in slices(np.diff(offsets).tolist(), SLICE_BYTES):
                lang = batch.column(0).slice(i, j - i).dictionary_encode()
                buf = every[offsets[i] : offsets[j]]
                cuts = _piece_ends(buf, SLICE_BYTES) if j == i + 1 else [0, len(buf)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    begins = offsets[i:j] - offsets[i] if j > i + 1 else np.zeros(1, np.int64)
                    yield from counted(lang.dictionary, lang.indices.to_numpy().astype(np.int64), buf[a:b], begins, latest)

    def counted(langs, of_lang, buf, begins, latest):
        words, rows, linked = words_and_links(buf, begins)
        if not len(words):
            return
        coded = words.dictionary_encode()
        lexicon, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lang = of_lang[rows]
        if step < SHARDS:
            keys, occ = np.unique(lang * len(lexicon) + code, return_counts=True)
            yield told(langs, keys // len(lexicon), lexicon.take(pa.array(keys % len(lexicon))), occ, np.full(len(occ), SHARDS - 1))
        if latest is None:
            return
        sums = np.fromiter(map(zlib.crc32, lexicon.to_pylist()), np.int64, len(lexicon))
        begin = np.fromiter((zlib.crc32(x.encode()) % SLOTS for x in langs.to_pylist()), np.int64, len(langs))
        at, slot = np.arange(len(code)), (begin[lang] * TURN + sums[code]) % SLOTS
        for size in range(2, LONGEST + 1):
            since = latest[slot].astype(np.int64)
            # A phrase goes on from place i if the shorter ones at i and i + 1 are both frequent.
            keep = since > 0
            at, slot, since = at[keep], slot[keep], since[keep]
            joins = np.flatnonzero((np.diff(at) == 1) & linked[at[:-1]])
            until = np.maximum(since[joins], since[joins + 1]) - 1 + SHARDS
            at = at[joins]
            slot = (slot[joins] * TURN + sums[code[at + size - 1]]) % SLOTS
            active = until >= step
            if active.any():
                begins_at, until = at[active], until[active]
                ids = lang[begins_at]
                for k in range(size):
                    _, shown, ids, occ = np.unique(ids * len(lexicon) + code[begins_at + k], return_index=True, return_inverse=True, return_counts=True)
                first = begins_at[shown]
                phrases = pc.binary_join_element_wise(*(words.take(pa.array(first + k)) for k in range(size)), b" ")
                yield told(langs, lang[first], phrases, occ, until[shown])
            if not len(at):
                return

    def told(langs, lang, phrases, occ, until):
        cols = [langs.take(pa.array(lang)), phrases.cast(pa.string()), pa.array(occ, pa.int64()), pa.array(until, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n", "state"])

    return run


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, words, phrase, f) of all phrases of up to LONGEST words with at least ``least`` occurrences, and rows (lang, n) of all words.

    ``docs`` has lang and text without nulls.
    """
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARDS)).cast("int")
    texts = durable(docs.select("lang", F.col("text").cast("binary").alias("text"), shard.alias("shard")), "shard")
    words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).alias("words")
    # state: the shards that f counts (32 bits), 1 + the step at which f reached the threshold, the last step that counts.
    counts = totals = None
    latest = np.zeros(SLOTS, np.uint8)
    step = last = 0
    while step <= last or step < SHARDS:
        sent = spark.sparkContext.broadcast(zlib.compress(latest, 1)) if latest.any() else None
        rows = texts.filter(F.col("shard") == step % SHARDS).select("lang", "text").mapInArrow(_scan(step, sent), _COUNTS)
        if counts is not None:
            rows = rows.union(counts)
        old = F.col("state") >= 1 << 32
        rows = rows.groupBy("lang", "phrase").agg(F.sum(F.when(~old, F.col("n"))).alias("new"), F.max(F.when(old, F.col("n"))).alias("f"), F.max("state").alias("state"), F.max(F.col("state") % (1 << 16)).alias("until"))
        bit = F.lit(1 << (32 + step % SHARDS))
        held = F.when(F.col("state") >= 1 << 32, F.col("state") - F.col("state") % (1 << 16)).otherwise(F.lit(0))
        fresh = F.col("new").isNotNull() & (held.bitwiseAND(bit) == 0)
        n = F.coalesce("f", F.lit(0)) + F.when(fresh, F.col("new")).otherwise(0)
        rows = rows.select("lang", "phrase", n.alias("n"), "until", F.when(fresh, held + bit).otherwise(held).alias("held"))
        since = F.when((F.col("held") % (1 << 32) == 0) & (F.col("n") >= least), F.lit((1 + step) << 16)).otherwise(0)
        counts = durable(rows.select("lang", "phrase", "n", (F.col("held") + since + F.col("until")).alias("state")))
        if sent is not None:
            sent.destroy()  # the counts are written down
        if step == SHARDS - 1:
            totals = durable(counts.filter(words == 1).groupBy("lang").agg(F.sum("n").alias("n")))
        reached = F.floor(F.col("state") % (1 << 32) / (1 << 16)).cast("long")
        taken = slots_taken(counts.filter((reached == 1 + step) & (words < LONGEST)), _key_slot(), SLOTS)
        if taken is not None:
            latest[np.flatnonzero(np.unpackbits(np.frombuffer(taken, np.uint8), bitorder="little"))] = 1 + step
            last = step + SHARDS
        # Rare phrases that have been counted everywhere are done with.
        counts = counts.filter((reached > 0) | (F.col("state") % (1 << 16) > step))
        step += 1
    return counts.filter(F.col("n") >= least).select("lang", words, "phrase", F.col("n").alias("f")), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to five words.

    A phrase's score is that of the cut that scores lowest, of equal cuts the first. Phrases that stand in a longer
    frequent one as often as anywhere are left out; as counts can't rise with the length, only phrases
    with one word more need be looked at. Null lang is 'und', null text is empty; every row counts,
    repeated ones and null ids too; ids and other columns are ignored, whatever their names. Equal scores go
    by the count, then by the phrase's bytes. Texts of any length count whole; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found, totals = frequent_phrases(docs, least)
    parts = F.split("phrase", " ", -1)
    joined = lambda begin, size: F.array_join(F.slice(parts, begin, size), " ")
    longer = found.filter("words > 1").withColumnRenamed("f", "a")
    shorter = longer.filter("words > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"))
    within = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    alone = durable(longer.join(within, ["lang", "phrase"], "left").filter("within is null or within < a").drop("within"))
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left, right = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    score = "cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    scored = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    scored = scored.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(size) WHERE len(ws) >= size),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 100),
inner_of AS (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : size - 1], ' '), array_to_string(string_split(phrase, ' ')[2 : size], ' ')]) AS phrase FROM f WHERE size > 2),
covered AS (SELECT lang, phrase, max(f) AS f FROM inner_of GROUP BY ALL),
alone AS (SELECT f.* FROM f LEFT JOIN covered c ON c.lang = f.lang AND c.phrase = f.phrase WHERE f.size > 1 AND (c.f IS NULL OR c.f < f.f)),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS rp FROM alone, range(1, 5) AS t(k) WHERE k < size),
scored AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""
