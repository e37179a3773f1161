"""Long repeats: bytes covered by a string of LENGTH bytes that occurs earlier in the corpus.

1. Sparse suffix arrays. Of all suffixes of a text those are taken that begin at a place chosen by content, the
   least hash of HEAD bytes in any window of LENGTH bytes. Two equal strings of LENGTH bytes choose the same place,
   so a repeat always shows as two suffixes with the same head. An array is a table of suffixes in the order of
   their heads' fingerprints: a merge scan needs equal heads side by side, not the alphabet.
2. A logarithmic family. Batches of documents come in the order of ids. Each gets its array, which is
   merge-scanned against the arrays of all levels; then it joins the family as a level, and levels of equal size
   merge to one of twice the size. Arrays are bucketed alike, so scans and merges are sort-merge joins without
   a shuffle. What comes out are the heads that occur more than once.
3. Matches are extended from these heads to whole strings in three steps, each exact: the span of all windows that chose
   a place, then parts of up to PART windows, then single windows. In each, all but the first of equal
   ones are repeats, and only what shares its core with others but differs from them goes on. A hot passage
   is counted before it is dealt out, and firsts are joined back as tables that can be split.

Fingerprints of two bases, 128 bits together, stand for bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import SLOTS, bucketed, durable, mix64, sent_slots, slices, slots_here, slots_hold, slots_taken, unique_ids, with_row_key

#: Bytes of a string that counts as a repeat, of a suffix's head, and windows of a part.
LENGTH, HEAD, PART = 100, 32, 18
#: Bytes that any window of a part holds, counted from the part's first offset.
CORE = LENGTH - PART + 1
#: Bytes of text looked at together; a longer text is cut into pieces that overlap.
SLICE_BYTES = 1 << 20
BATCHES = 4
#: Bytes of text behind a bucket of an array, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 10_000

_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FAR = np.iinfo(np.uint64).max

_ENTRY = "k long, s long, ord long, lo long, n int"


class Powers:
    """Powers of both bases and of their inverses modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.known = 0

    def reach(self, n: int) -> None:
        if n > self.known:
            self.known = max(n, 2 * SLICE_BYTES)
            self.up, self.down = ([self._of(b, self.known) for b in bases] for bases in (_BASES, [pow(b, -1, 1 << 64) for b in _BASES]))

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)


class Hashed:
    """Fingerprints of any span of a buffer, by sums over all prefixes."""

    def __init__(self, buf: np.ndarray, powers: Powers, bases: int = 2):
        powers.reach(len(buf) + 1)
        code = _CODE[buf]
        self.sums = []
        self.down = powers.down
        for up in powers.up[:bases]:
            s = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(code * up[: len(buf)], out=s[1:])
            self.sums.append(s)

    def span(self, base: int, lo: np.ndarray, hi: np.ndarray, shape: np.ndarray | int = 0) -> np.ndarray:
        s = self.sums[base]
        return mix64((s[hi] - s[lo]) * self.down[base][lo] + mix64(np.asarray(shape, np.uint64)))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` in a row."""
    n = len(x)
    y = np.full(-(-n // w) * w, _FAR, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def chosen(buf: np.ndarray, ends: np.ndarray, hashed: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (heads' hashes, place, first window, windows) chosen by runs of windows; ``ends``: the end of each byte's text."""
    if len(buf) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(len(buf) - HEAD + 1)
    heads = hashed.span(0, at, at + HEAD)
    packed = (heads >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)  # of equal hashes the first
    least = _least(packed, LENGTH - HEAD + 1)
    windows = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[: len(least)])
    place = (least[windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    place = place[first]
    return heads[place], place, windows[first], np.diff(np.append(first, len(windows)))


def _buffers(text: pa.BinaryArray) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """Pieces (bytes, first row, begin of each row in them, bytes of the row before them) of a column of texts."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1].astype(np.int64)
    every = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    for i, j in slices(np.diff(offsets).tolist(), SLICE_BYTES):
        begin, end = offsets[i], offsets[j]
        if j > i + 1 or end - begin <= 2 * SLICE_BYTES:
            yield every[begin:end], i, offsets[i:j] - begin, 0
        else:
            for lo in range(0, end - begin - LENGTH + 1, SLICE_BYTES):
                yield every[begin + lo : min(begin + lo + SLICE_BYTES + LENGTH - 1, end)], i, np.zeros(1, np.int64), lo


def _ends(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and end of the text of every byte."""
    ends = np.append(begins[1:], len(buf))
    return np.repeat(np.arange(len(begins)), ends - begins), np.repeat(ends, ends - begins)


def _heads(batches):
    """Distinct heads of a piece, and whether a head occurs more than once there."""
    powers = Powers()
    for batch in batches:
        for buf, _, begins, _ in _buffers(batch.column(1)):
            heads, *_ = chosen(buf, _ends(buf, begins)[1], Hashed(buf, powers, bases=1))
            k, n = np.unique(heads, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n > 1)], ["k", "many"])


def _spans(sent):
    """Entries of the places whose heads may occur more than once."""

    def run(batches):
        powers, bits = Powers(), slots_here(sent)
        for batch in batches:
            ords = batch.column(0).to_numpy()
            for buf, row, begins, shift in _buffers(batch.column(1)):
                hashed = Hashed(buf, powers)
                of, ends = _ends(buf, begins)
                heads, place, lo, n = chosen(buf, ends, hashed)
                hit = slots_hold(bits, (heads & np.uint64(SLOTS - 1)).astype(np.int64))
                heads, place, lo, n = heads[hit], place[hit], lo[hit], n[hit]
                s = hashed.span(1, lo, lo + n + LENGTH - 1, (place - lo) * LENGTH + n)
                t = of[lo]
                cols = [heads.view(np.int64), s.view(np.int64), ords[row + t], lo - begins[t] + shift, n.astype(np.int32), (place - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "s", "ord", "lo", "n", "ahead"])

    return run


def _parts(batches):
    """Open spans of texts, cut at fixed offsets from their place into parts, with the bytes of each."""
    powers = Powers()
    for batch in batches:
        ords, text, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1].astype(np.int64)
        every = np.frombuffer(text.buffers()[2], np.uint8)
        many = pc.list_value_length(lists).to_numpy()
        told = lists.flatten()
        spans = np.stack([told.field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "ahead")], axis=1)
        row = np.repeat(np.arange(len(batch)), many)
        spans[:, 0] += offsets[row]
        order = np.argsort(spans[:, 0], kind="stable")
        spans, row = spans[order], row[order]
        begin = 0
        while begin < len(spans):  # about as much text at a time, of one row or of several
            end = int(np.searchsorted(spans[:, 0], spans[begin, 0] + SLICE_BYTES))
            base = max(0, int(spans[begin, 0]) - LENGTH)
            buf = every[base : int(spans[end - 1, 0] + spans[end - 1, 1]) + 2 * LENGTH]
            yield _cut(buf, base, spans[begin:end] - [base, 0, 0], ords[row[begin:end]], offsets[row[begin:end]], Hashed(buf, powers))
            begin = end


def _cut(buf, base, spans, ords, begins, hashed):
    cols = [[] for _ in range(7)]
    for j in range(-(-(LENGTH - HEAD + 1) // PART)):
        lo, n, ahead = spans.T
        # Windows of part j have the place at offset PART * j to PART * j + PART - 1.
        last = np.minimum(lo + n - 1, lo + ahead - PART * j)
        lo = np.maximum(lo, lo + ahead - PART * j - PART + 1)
        place = spans[:, 0] + ahead
        some = last >= lo
        lo, n, place = lo[some], (last - lo + 1)[some], place[some]
        core = place - PART * j
        for col, v in zip(cols, (hashed.span(0, core, core + CORE, j + 1), hashed.span(1, lo, lo + n + LENGTH - 1, (place - lo) * LENGTH + n), lo, n, lo + n + LENGTH - 1, ords[some], begins[some]), strict=True):
            col.append(v)
    k, s, lo, n, hi, ords, begins = (np.concatenate(c) for c in cols)
    ends = np.append(0, np.cumsum(hi - lo))
    spread = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)
    held = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[spread])])
    out = [pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ords), pa.array(lo + base - begins), pa.array(n.astype(np.int32)), held]
    return pa.RecordBatch.from_arrays(out, ["k", "s", "ord", "lo", "n", "bytes"])


def _windows(batches):
    """Every window of the open parts."""
    powers = Powers()
    for batch in batches:
        for buf, row, begins, _ in _buffers(batch.column(2)):
            hashed = Hashed(buf, powers)
            of, ends = _ends(buf, begins)
            at = np.flatnonzero(np.arange(len(buf)) + LENGTH <= ends)
            t = of[at]
            ords, lo = (batch.column(c).to_numpy()[row + t] for c in (0, 1))
            cols = [hashed.span(0, at, at + LENGTH).view(np.int64), hashed.span(1, at, at + LENGTH).view(np.int64), ords, lo + at - begins[t], np.ones(len(at), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "s", "ord", "lo", "n"])


class Family:
    """Levels of suffix arrays, each twice as large as the next."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.levels: list[tuple[int, DataFrame]] = []

    def array(self, texts: DataFrame) -> DataFrame:
        """The suffix array (k, many) of a batch (ord, text)."""
        heads = texts.mapInArrow(_heads, "k long, many boolean").groupBy("k").agg(((F.count("*") > 1) | F.max("many")).alias("many"))
        return bucketed(heads, "k", self.buckets)

    def repeated(self, array: DataFrame) -> DataFrame:
        """Heads (k) of the array that occur more than once in it or somewhere in the family."""
        found = array.filter("many").select("k")
        for _, level in self.levels:
            found = found.union(array.select("k").join(level, "k", "left_semi"))
        return durable(found)

    def add(self, array: DataFrame) -> None:
        size, new = 1, array.select("k")
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            size, new = 2 * size, bucketed(old.join(new, "k", "full_outer"), "k", self.buckets)
        self.levels.append((size, new))


def _settled(entries: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Spans (ord, lo, hi) of all entries but the first of equal ones; and firsts (k, s, ord, lo) that share k with others.

    ``small``: ord is below 2^31, so that a place is one number and the aggregation stays in hash tables. The tables joined
    to entries and texts have a row for each key, so no partition's hash table is larger than its share.
    """
    place = F.shiftleft("ord", 32) + F.col("lo") if small else F.struct("ord", "lo")
    at = (F.shiftright("f", 32), F.col("f") % (1 << 32)) if small else (F.col("f.ord"), F.col("f.lo"))
    firsts = durable(entries.groupBy("k", "s").agg(F.min(place).alias("f"), F.count("*").alias("c")).select("k", "s", at[0].alias("ord"), at[1].alias("lo"), "c"))
    several = firsts.filter("c > 1").select("k", "s", F.col("ord").alias("first_ord"), F.col("lo").alias("first_lo"))
    later = (F.col("ord") != F.col("first_ord")) | (F.col("lo") != F.col("first_lo"))
    spans = entries.join(several.hint("shuffle_hash"), ["k", "s"]).filter(later).select("ord", "lo", (F.col("lo") + F.col("n") + LENGTH - 1).alias("hi"))
    shared = durable(firsts.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k"))
    return durable(spans), firsts.join(shared.hint("shuffle_hash"), "k").select("k", "s", "ord", "lo")


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, text): ord is the id, or the place in the order of ids where these are null or not unique."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    if unique_ids(docs):
        return docs.select("doc_id", F.col("doc_id").alias("ord"), "text")
    return with_row_key(docs.orderBy(F.asc_nulls_last("doc_id"), F.sha2("text", 256)), "ord").select("doc_id", "ord", "text")


def repeated_spans(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Spans (ord, lo, hi) that cover each repeated byte of (ord, text); they may overlap."""
    texts = texts.select("ord", "text")
    marks = [k / batches for k in range(1, batches)]
    about = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("ord", F.array(*map(F.lit, marks or [1.0])), 1000).alias("marks"), F.min("ord").alias("least"), F.max("ord").alias("most")).first()
    small = about["least"] is None or (about["least"] >= 0 and about["most"] < 1 << 31)
    family = Family(min(MOST_BUCKETS, max(8, (about["bytes"] or 0) // BUCKET_BYTES)))
    bounds = [None, *(sorted(set(about["marks"] or [])) if marks else []), None]
    found = []
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        batch = texts.filter(F.lit(True) if lo is None else F.col("ord") > lo).filter(F.lit(True) if hi is None else F.col("ord") <= hi)
        array = family.array(batch)
        found.append(family.repeated(array))
        if k < len(bounds) - 2:
            family.add(array)
    keys = found[0]
    for x in found[1:]:
        keys = keys.union(x)
    taken = slots_taken(keys, F.col("k").bitwiseAND(F.lit(SLOTS - 1))) or bytes(SLOTS // 8)
    sent = sent_slots(texts.sparkSession, taken)

    entries = durable(texts.mapInArrow(_spans(sent), _ENTRY + ", ahead int"))
    sent.destroy()
    whole, left = _settled(entries, small)
    wanted = entries.join(left.hint("shuffle_hash"), ["k", "s", "ord", "lo"], "left_semi").groupBy("ord").agg(F.collect_list(F.struct("lo", "n", "ahead")).alias("spans"))
    parts = durable(texts.join(wanted.hint("shuffle_hash"), "ord").mapInArrow(_parts, _ENTRY + ", bytes binary"))
    some, left = _settled(parts.drop("bytes"), small)
    opened = parts.join(left.select("ord", "lo").hint("shuffle_hash"), ["ord", "lo"], "left_semi").select("ord", "lo", "bytes")
    windows = durable(opened.mapInArrow(_windows, _ENTRY))
    single, _ = _settled(windows, small)
    return whole.union(some).union(single)


def _kept(batches):
    for batch in batches:
        ids, texts, lists = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        kept, merged = [], []
        for i, told in enumerate(lists):
            text = texts[i].as_buffer()
            runs = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in told or []):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            ends = [0, *(hi for _, hi in runs)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(lo for lo, _ in runs), len(text)], strict=True)))
            merged.append([{"lo": lo, "hi": hi} for lo, hi in runs])
        yield pa.RecordBatch.from_arrays([ids, texts, pa.array(kept, pa.binary()), pa.array(merged, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["doc_id", "text", "kept", "removed"])


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, text, kept, removed), one per row of ``docs``, with text and kept as bytes.

    Each byte in a string of LENGTH bytes that starts earlier too (in a smaller doc_id, or further ahead in the same
    text) is left out of ``kept``; ``removed`` has the maximal runs (lo, hi) of such bytes. Strings are judged on the
    input. Null texts are empty. Null ids come after all others; rows of one id are taken in the order of
    their texts' hashes, so of equal rows one is the first. Texts of any length count whole, shorter ones
    than LENGTH stay; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    texts = _in_order(docs)
    spans = repeated_spans(texts, batches).groupBy("ord").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), "ord", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, "doc_id long, text binary, kept binary, removed array<struct<lo: long, hi: long>>")


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of without_repeats."""
    size = F.octet_length("text").cast("long")
    removed = size - F.octet_length("kept")
    return without_repeats(docs).select("doc_id", size.alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
