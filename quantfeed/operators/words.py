"""Large tables of words against texts: words are looked up among a text's parts in place of one test a word and text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words up to this length are looked up whole, longer ones by so many first characters.
GRAM = 8
#: Characters of texts and number of words that a task works on together.
CHARS, WORDS = 32_000_000, 2_000_000
#: Characters of texts that are looked up at once.
LOOKED = 400_000
#: What parts two texts: no character has this number, which takes 21 bits as theirs do.
NOTHING = 0x1FFFFF
#: Odd numbers that spread hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Words of one length: all places of a text are looked up at once by a hash of so many characters, and what is found there is compared."""

    def __init__(self, codes: np.ndarray):
        number, n = codes.shape
        hashes = np.zeros(number, np.uint64)
        for c in codes.T:
            hashes = hashes * STEP + c
        bits = max(10, (number * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        place = self._place(hashes)
        order = np.argsort(place, kind="stable")
        new = np.append(True, place[order[1:]] != place[order[:-1]])
        self.first, self.next = np.full(1 << bits, -1, np.int32), np.full(number, -1, np.int32)
        self.first[place[order[new]]] = order[new]
        self.next[order[:-1][~new[1:]]] = order[1:][~new[1:]]  # words of one place hang together
        wide = np.full((number, n + 2), 0, np.uint32)
        wide[:, :n] = codes
        self.mask = np.uint64((1 << 21 * min(n, 3)) - 1)
        self.parts = [(j, _packed(wide[:, j : j + 3].ravel())[::3][:number] & self.mask) for j in sorted({0, *range(3, n - 3, 3), max(0, n - 3)})]

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * MIX >> self.shift).view(np.int64)

    def found(self, hashes: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text and the words that stand there."""
        known = self.first.take(self._place(hashes))
        at = np.flatnonzero(known >= 0)
        word = known[at]
        places, words = [at[:0]], [word[:0]]
        while len(at):
            same = np.ones(len(at), bool)
            for j, part in self.parts:
                same &= packed.take(at + j) & self.mask == part.take(word)
            places.append(at[same])
            words.append(word[same])
            word = self.next.take(word)
            more = np.flatnonzero((word >= 0) & ~same)
            at, word = at[more], word[more]
        return np.concatenate(places), np.concatenate(words)


class _Index:
    """Distinct words by length; of those longer than ``gram`` the heads are looked up and then the words."""

    def __init__(self, words: Sequence[str], gram: int):
        by_size: dict[int, list[str]] = {}
        for w in set(words):
            by_size.setdefault(min(len(w), gram + 1), []).append(w)
        self.words, self.gram = [w for n in sorted(by_size) for w in by_size[n]], gram
        self.tables: dict[int, tuple[_Table, int]] = {}
        self.longer: dict[str, list[int]] = {}
        begin = 0
        for n in sorted(by_size):
            if n <= gram:
                self.tables[n] = _Table(_codes("".join(by_size[n])).reshape(-1, n)), begin
                begin += len(by_size[n])
        for k in range(begin, len(self.words)):
            self.longer.setdefault(self.words[k][:gram], []).append(k)
        self.heads = list(self.longer)
        self.head_table = _Table(_codes("".join(self.heads)).reshape(-1, gram)) if self.heads else None

    def found(self, texts: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Some texts at a time: (number of the first, of the one after the last, text, word), each word of a text once; both count from 0, texts from the first."""
        begin, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= LOOKED or k == len(texts) - 1:
                yield begin, k + 1, *self._some(texts[begin : k + 1])
                begin, size = k + 1, 0

    def _some(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) + 1 for t in texts])
        total = int(sizes.sum())
        inside = np.ones(total, bool)
        inside[np.cumsum(sizes) - 1] = False
        text = np.full(total + self.gram + 2, NOTHING, np.uint32)  # no word goes on after a text
        text[:total][inside] = _codes("".join(texts))
        packed, owner = _packed(text), np.repeat(np.arange(len(texts)), sizes)
        at, words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        hashes = np.zeros(total, np.uint64)
        for n in range(1, max([*self.tables, self.gram if self.heads else 0], default=0) + 1):
            hashes *= STEP
            hashes += text[n - 1 : n - 1 + total]
            if n in self.tables:
                table, begin = self.tables[n]
                place, word = table.found(hashes, packed)
                mine, word = _once(owner[place], word, len(texts), len(table.next))
                at.append(mine)
                words.append(word + begin)
            if n == self.gram and self.heads:
                place, head = self.head_table.found(hashes, packed)
                pairs = [(t, w) for t, h in zip(*(x.tolist() for x in _once(owner[place], head, len(texts), len(self.heads))), strict=True) for w in self.longer[self.heads[h]] if self.words[w] in texts[t]]
                at.append(np.array([t for t, _ in pairs], np.int64))
                words.append(np.array([w for _, w in pairs], np.int64))
        return np.concatenate(at), np.concatenate(words)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Three characters from each place on as one number."""
    c = np.append(codes, np.zeros(2, np.uint32)).astype(np.uint64)
    return c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _once(text: np.ndarray, word: np.ndarray, texts: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of two columns of numbers: by marks if these are few, else sorted."""
    key = text.astype(np.int64) * words + word
    if texts * words <= 16 * len(key):
        marks = np.zeros(texts * words, bool)
        marks[key] = True
        key = np.flatnonzero(marks)
    else:
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return np.divmod(key, words)


def _met(texts: DataFrame, words: DataFrame, gram: int, made: Callable[[list[tuple], _Index, pa.Table], Iterable[tuple]], schema: T.StructType, most: int | None = None) -> DataFrame:
    """Rows that ``made`` makes of blocks of texts against slices of words: it gets rows (..., text), the index of the
    slice's words, and the slice.

    Texts are dealt to blocks by hash, so equal ones meet; words are cut into slices. Each text is sent once a slice, each
    word once a block, and nothing that is found is shuffled here. Null and empty texts and words find nothing.
    """
    rows, looked = texts.filter(F.length("text") > 0), words.filter(F.length("word") > 0)
    most = most or CHARS
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-looked.count() // WORDS))
    blocks = max(-(-chars // most), min(64, -(-chars * 16 // most)), 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_block", deal("text", blocks)).withColumn("_slice", every(slices))
    right = looked.withColumn("_slice", deal("word", slices)).withColumn("_block", every(blocks))
    keys, shown = ["_block", "_slice"], [c for c in texts.columns if c != "text"]

    made_of = to_arrow_schema(schema)

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        index = _Index(known["word"].to_pylist(), gram)
        rows = list(zip(*(mine[c].to_pylist() for c in [*shown, "text"]), strict=True))
        columns = list(zip(*made(rows, index, known), strict=True)) or [()] * len(made_of)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, made_of, strict=True)], schema=made_of)

    dealt = [x.repartition(blocks * slices, *keys).groupBy(*keys) for x in (left, right)]  # small tasks, as texts differ in work
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, schema)


def contained(texts: DataFrame, words: DataFrame, gram: int = GRAM) -> DataFrame:
    """Distinct rows (text, word): the words that stand anywhere in a text.

    A text's parts of the words' lengths are looked up among the words; of words longer than ``gram`` the heads are, and
    those whose head occurs are tested. Null and empty texts and words find nothing; upper and lower case differ; repeated
    rows count once; other columns are left out.
    """

    def made(rows: list[tuple], index: _Index, _: pa.Table) -> Iterable[tuple]:
        texts = [text for (text,) in set(rows)]
        for begin, end, at, words in index.found(texts):
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=end - begin))
            for k, mine in enumerate(np.split(words[order], ends[:-1]), begin):
                if len(mine):
                    yield texts[k], [index.words[w] for w in mine.tolist()]

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
    met = _met(texts.select("text"), words.select("word"), gram, made, schema, CHARS // 16)
    return met.select("text", F.explode("words").alias("word"))


def counted(texts: DataFrame, words: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows (word, texts): how many distinct texts hold each word that any holds.

    Counts are added up in the tasks that find the words, so the pairs never travel.
    """

    def made(rows: list[tuple], index: _Index, _: pa.Table) -> Iterable[tuple]:
        counts = np.zeros(len(index.words), np.int64)
        for _, _, _, words in index.found([text for (text,) in set(rows)]):
            np.add.at(counts, words, 1)
        return [(index.words[w], int(counts[w])) for w in np.flatnonzero(counts)]

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("texts", T.LongType())])
    met = _met(texts.select("text"), words.select("word"), gram, made, schema)
    return met.groupBy("word").agg(F.sum("texts").alias("texts"))


def rated_rows(rows: DataFrame, rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """The columns of ``rows`` but text, with (severity, category, words) as rated() has them; rows without any rule's word aren't there."""
    shown = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f.dataType for f in rules.schema}
    schema = T.StructType([T.StructField("_row", T.LongType()), *(rows.schema[c] for c in shown), T.StructField("word", T.StringType()), T.StructField("severity", kinds["severity"]), T.StructField("category", kinds["category"]), T.StructField("words", T.LongType())])

    def made(rows: list[tuple], index: _Index, known: pa.Table) -> Iterable[tuple]:
        best = {}
        for w, severity, category in zip(*(known[c].to_pylist() for c in ("word", "severity", "category")), strict=True):
            # As the aggregate below orders them: a null severity or category first, words by their bytes.
            rule = (severity is not None, -(severity or 0), w.encode(), category is not None, "" if category is None else category)
            if w not in best or rule < best[w][0]:
                best[w] = (rule, w, severity, category)
        ranked = sorted(best.values(), key=lambda b: b[0])
        place = {b[1]: k for k, b in enumerate(ranked)}
        rank = np.array([place[w] for w in index.words], np.int64)
        number = {text: k for k, text in enumerate(dict.fromkeys(r[-1] for r in rows))}
        first, hits = np.full(len(number), len(ranked)), np.zeros(len(number), np.int64)
        for begin, end, at, words in index.found(list(number)):
            np.minimum.at(first[begin:end], at, rank[words])
            hits[begin:end] = np.bincount(at, minlength=end - begin)
        for *row, text in rows:
            if hits[k := number[text]]:
                yield (*row, *ranked[first[k]][1:], int(hits[k]))

    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), *rows.columns)
    met = _met(numbered, rules.select("word", "severity", "category"), gram, made, schema)
    rule = F.min(F.struct((-F.col("severity")).alias("s"), "word", "category")).alias("b")
    best = met.groupBy("_row", *shown).agg(rule, F.sum("words").alias("words"))
    return best.select(*shown, (-F.col("b.s")).alias("severity"), F.col("b.category").alias("category"), "words")


def rated(texts: DataFrame, rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows (text, severity, category, words): the severest rule whose word stands in a text, and how many rules' words do.

    ``rules``: rows (word, severity, category); of equal severities the first word counts. Texts without any rule's word
    aren't there.
    """
    once = texts.select("text").distinct().withColumn("_text", F.col("text"))
    return rated_rows(once, rules, gram).withColumnRenamed("_text", "text")
