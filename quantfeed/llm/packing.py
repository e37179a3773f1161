"""Packing documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, mix64, slices
from quantfeed.llm.shards import PART_ROWS, PARTS, numbered

#: Words kept per worker, some 60 bytes each; then the cache starts anew.
CACHE_WORDS = 300_000
#: Characters that are cut into words at once; a longer text comes alone.
SLICE_CHARS = 400_000
#: The normalizer and word pattern of the tokenizers that are encoded word by word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Endings that an apostrophe makes one word with, by their length.
ENDINGS = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
#: Kind of each Latin-1 character; controls and the signs between 0x7F and 0xBF are left to the tokenizer.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x20:0x7F] = _MARK
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = _LETTER
_KIND[[0xD7, 0xF7]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[c for c in (*range(0x41, 0x5B), *range(0xC0, 0xDF)) if c != 0xD7]] += 32
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER, _SALT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)

_encoders: dict[tuple[int, int], WordEncoder] = {}


def cut_words(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First characters and lengths of the words in lower-case text that ends with white space.

    Runs of letters, single digits and runs of marks, but a run of marks that begins with an apostrophe
    in front of one of ENDINGS is a word with that ending.
    """
    begins = kind != _SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    marks = np.flatnonzero(begins & (low == ord("'")))
    after, next_after = low[marks + 1], low[np.minimum(marks + 2, len(low) - 1)]
    for size, endings in ENDINGS.items():
        fits = np.zeros(len(marks), bool)
        for e in endings:
            fits |= (after == ord(e[0])) & ((next_after == ord(e[-1])) | (size == 1))
        at = marks[fits]
        begins[at + 1] = False
        rest = at + 1 + size
        begins[rest[kind[rest] == _LETTER]] = True
    ink = np.flatnonzero(kind != _SPACE)
    first = np.flatnonzero(begins[ink])
    return ink[first], np.diff(np.append(first, len(ink)))


class WordEncoder:
    """Token ids by the given tokenizer (its file's text), with the ids of words remembered.

    A tokenizer with the NORMALIZERS and WORDS above splits lower-cased text into words and merges
    inside words only, so the ids of a text are those of its words in order. Texts of plain Latin-1
    are cut and looked up by arrays; any other text, texts that hold an added token such as an end of text,
    and every text of another kind of tokenizer, are encoded by the tokenizer as they are.
    """

    def __init__(self, written: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(written)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        said = json.loads(written)
        self.special = [t["content"] for t in said.get("added_tokens") or []]
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_words = (
            (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": WORDS}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and (steps[1]["add_prefix_space"], steps[1]["use_regex"]) == (False, False)
            and said["model"]["type"] == "BPE"
            and not said["model"]["dropout"]
        )
        self.clear()

    def clear(self) -> None:
        """Sorted hashes of words; for each its first place and length in the words' characters and in the ids."""
        self.hash = np.empty(0, np.uint64)
        self.word, self.word_size, self.begin, self.size = (np.empty(0, np.int64) for _ in range(4))
        self.chars, self.flat = np.empty(0, np.uint8), np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        merge, ids = self.tokenizer.model.tokenize, []
        for word in words:
            text = word.decode("latin-1")
            plain = text.isascii() and text.isprintable()
            ids.append([t.id for t in merge(text if plain else self.bytes.pre_tokenize_str(text)[0][0])])
        if len(self.hash) + len(words) > CACHE_WORDS:
            self.clear()
        size, word_size = np.array([len(i) for i in ids]), np.array([len(w) for w in words])
        order = np.argsort(np.append(self.hash, hashes), kind="stable")
        for name, v in (("hash", hashes), ("word", len(self.chars) + np.cumsum(word_size) - word_size), ("word_size", word_size), ("begin", len(self.flat) + np.cumsum(size) - size), ("size", size)):
            setattr(self, name, np.append(getattr(self, name), v)[order])
        self.chars = np.append(self.chars, np.frombuffer(b"".join(words), np.uint8))
        self.flat = np.append(self.flat, np.array([i for part in ids for i in part], np.uint32))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            raw = None
            if self.by_words and not any(t in text for t in self.special):
                try:
                    raw = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if raw is None or (_KIND[np.frombuffer(raw, np.uint8)] == _ODD).any():
                out[i] = self.encode(text)
            else:
                plain.append((i, raw))
        for i, j in slices([len(raw) for _, raw in plain], SLICE_CHARS):
            for (k, _), ids in zip(plain[i:j], self._of_words([raw for _, raw in plain[i:j]]), strict=True):
                out[k] = self.encode(texts[k]) if ids is None else ids
        return out

    def _of_words(self, raw: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each Latin-1 text; None for all if two words have the same hash."""
        buf = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        first, length = cut_words(buf, _KIND[buf])
        ends = np.cumsum([len(r) + 1 for r in raw])
        if not len(first):
            return [np.empty(0, np.uint32)] * len(raw)
        total = np.cumsum(length)
        start = total - length
        place = np.arange(total[-1]) - np.repeat(start, length)
        ink = buf[place + np.repeat(first, length)]
        power = np.ones(int(length.max()), np.uint64)
        power[1:] = _POWER
        power = np.cumprod(power, dtype=np.uint64)
        h = mix64(np.add.reduceat(_CODE[ink] * power[place], start) + length.astype(np.uint64) * _SALT)
        at = self._find(h)
        if (at < 0).any():
            new, shown = np.unique(h[at < 0], return_index=True)
            shown = np.flatnonzero(at < 0)[shown]
            self.learn(new, [buf[f : f + n].tobytes() for f, n in zip(first[shown], length[shown], strict=True)])
            at = self._find(h)
            if (at < 0).any():  # the cache was cleared: learn all words of this slice
                self.clear()
                new, shown = np.unique(h, return_index=True)
                self.learn(new, [buf[f : f + n].tobytes() for f, n in zip(first[shown], length[shown], strict=True)])
                at = self._find(h)
                if (at < 0).any():
                    return [None] * len(raw)
        if (self.word_size[at] != length).any() or (self.chars[np.repeat(self.word[at], length) + place] != ink).any():
            return [None] * len(raw)
        size = self.size[at]
        last = np.cumsum(size)
        ids = self.flat[np.arange(last[-1]) + np.repeat(self.begin[at] - last + size, size)]
        words = np.searchsorted(first, ends)
        bounds = np.concatenate([[0], last])[words]
        return np.split(ids, bounds[:-1])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known ones, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)


def _encoder(written: str) -> WordEncoder:
    """One encoder a worker; zlib's checksum and the length tell tokenizers apart."""
    key = (zlib.crc32(written.encode()), len(written))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(written)
    return _encoders[key]


def pieces_of(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut every ``length``."""

    # The file goes along (a few MB, whatever the input), so executors need no copy of it.
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(held.value)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or "" for t in texts]
            rows: list[list] = [[], [], [], [], []]
            for i, j in slices([len(t) for t in texts], SLICE_CHARS):
                for doc_id, ids in zip(docs_ids[i:j], encoder.encode_many(texts[i:j]), strict=True):
                    tokens = np.append(ids, end).astype("<u4")
                    for start in range(0, len(tokens), length):
                        part = tokens[start : start + length]
                        for col, v in zip(rows, (doc_id, start, len(part), zlib.crc32(part), len(tokens)), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(histogram: Mapping[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths in order) that place every length of the histogram.

    Longest lengths first; each goes to the packs with the most room left, a whole pattern's count
    at a time, and opens new packs when none has room.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        moved = []
        for space in sorted((s for s in room if s >= size), reverse=True):
            while left and room[space]:
                count, pattern = room[space].pop()
                used = min(count, left)
                if used < count:
                    room[space].append((count - used, pattern))
                moved.append((space - size, used, (*pattern, size)))
                left -= used
            if not left:
                break
        for space, used, pattern in moved:
            room[space].append((used, pattern))
        while left:  # what remains opens packs, as many of the same length in each as fit
            fit = min(length // size, left)
            count = left // fit
            room[length - fit * size].append((count, (size,) * fit))
            left -= count * fit
    return [(count, pattern) for space in sorted(room) for count, pattern in room[space] if count]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Null and empty texts hold the end id alone; a text of any length is cut into as many pieces as it
    needs. Repeated rows and null ids are packed like others; other columns are ignored, whatever their
    names; an empty table gives no rows. The driver gets the histogram, at most
    ``length`` rows, and sends back one row for each place in a pattern.
    """
    pieces = durable(pieces_of(docs, tokenizer, length, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, used, sequence = [], defaultdict(int), 0
    for count, pattern in pack_histogram(histogram, length):
        offset = 0
        for size in pattern:
            ranges.append((size, used[size], used[size] + count, sequence - used[size], offset))
            used[size] += count
            offset += size
        sequence += count
    places = docs.sparkSession.createDataFrame(ranges, "length long, lo long, hi long, shift long, offset long")
    parts = max(PARTS, sum(histogram.values()) // PART_ROWS)
    ranked = numbered(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "rank", parts)
    # A few places for each of at most `length` lengths, whatever the input.
    inside = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    joined = ranked.join(F.broadcast(places), inside)
    return joined.select("doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
