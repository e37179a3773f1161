import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantfeed.llm import langid, mixing, packing, shards
from quantfeed.llm.queries import default_tokenizer, op5_languages, op8_shards, op10_packed

SCHEMA = "doc_id long, text string, lang string, source string, epoch int"
ODD = [(1, None, "en", "src1", 0), (2, "", None, None, 0), (3, "a b c", "en", "src1", 0), (3, "a b c", "en", "src1", 0), (None, "d e", "de", "src20", 0), (5, "x " * 60_000, "de", "src20", 0), (6, "12 !", "fr", "src2", 0)]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_languages_of_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    out = op5_languages(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    fold = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang == r.lang_pred for r in fold) / len(fold) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_scores_do_not_depend_on_the_batch(spark):
    model = langid.LanguageModel(["a", "b"], __import__("numpy").random.default_rng(0).standard_normal((langid.BUCKETS, 2)).astype("float32"), __import__("numpy").zeros(2))
    texts = ["abc def", "ghi", "", "é", "12 3", "ein langer Text ohne Ende", "x"]
    together = model.score(texts)
    apart = [model.score([t]) for t in texts]
    assert together[0] == [a[0][0] for a in apart]
    assert together[1] == pytest.approx([a[1][0] for a in apart], abs=1e-12)
    assert [i for i, n in enumerate(together[0]) if n == langid.UNKNOWN] == [2, 4]


def plain_naive_bayes(train, texts, smoothing=0.5):
    """The same model by loops over characters: counts, smoothed log shares, sums for each text."""
    import math
    from collections import Counter

    def buckets(text):
        raw = [ord(c) for c in text.lower()] + [0, 0, 0]
        ink = [chr(c).isalpha() for c in raw]
        keep = [k for k in range(len(raw)) if ink[k] or k == 0 or ink[k - 1] or k >= len(raw) - 2]
        codes = [raw[k] if ink[k] else 0 for k in keep]
        out = []
        for n in (1, 2, 3):
            for i in range(len(codes)):
                h = 0
                for step in range(n):
                    h = (h * 0x9E3779B1) % 2**32
                    if i + step < len(codes):
                        h = (h + codes[i + step]) % 2**32
                h = (h * 0x85EBCA6B + n * 0x27D4EB2F) % 2**32
                out.append((((h ^ (h >> 15)) * 0xC2B2AE35) % 2**32) >> 16)
        return out

    counts, docs = {}, Counter()
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(buckets(text))
        docs[lang] += 1
    out = []
    for text in texts:
        logs = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + smoothing * langid.BUCKETS
            logs[lang] = math.log(docs[lang] / len(train)) + sum(math.log((c[b] + smoothing) / whole) for b in buckets(text))
        top = max(logs.values())
        share = {k: math.exp(v - top) for k, v in logs.items()}
        best = max(sorted(share), key=lambda k: share[k])
        out.append((best, share[best] / sum(share.values())) if any(c.isalpha() for c in text) else ("und", 0.0))
    return out


def test_predictions_equal_plain_naive_bayes(spark):
    train = [("the cat and the dog", "en"), ("a dog of the house", "en"), ("der Hund und die Katze", "de"), ("das Haus  ist groß!", "de"), ("le chien et la maison", "fr")]
    texts = ["the house", "die Maus", "chien", "x", "", "12!", "é 3 ß", "Hund 1-2 dog", "the dog " * 40]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][: len(train)]
    asked = [i for i in range(200) if not zlib.crc32(str(i).encode()) % 5][: len(texts)]
    rows = [(i, t, k) for i, (t, k) in zip(ids, train, strict=True)] + [(i, t, None) for i, t in zip(asked, texts, strict=True)]
    df = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, score int, held_out string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(df).collect()}
    for i, (lang, score) in zip(asked, plain_naive_bayes(train, texts), strict=True):
        assert out[i][0] == lang and out[i][1] == pytest.approx(score, abs=1e-4), i


def test_languages_of_odd_rows(spark):
    out = {(r.doc_id, r.lang_pred) for r in langid.identified(odd(spark)).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= out
    assert langid.identified(odd(spark).limit(0)).collect() == []
    assert langid.accepted_documents(odd(spark)).columns == odd(spark).columns


def test_fill_matches_water_filling(spark):
    rows = [("p", n, w, c, 100.0) for n, w, c in [("a", 1.0, 5.0), ("b", 3.0, 500.0), ("c", 1.0, 60.0), ("d", 0.0, 9.0)]]
    df = spark.createDataFrame(rows, "g string, n string, w double, c double, b double")
    out = {r.n: r.s for r in mixing.fill(df, ["g"], "n", "b", "w", "c", "s").collect()}
    assert out == pytest.approx({"a": 5.0, "b": 71.25, "c": 23.75, "d": 0.0})


def test_mix_takes_exact_budgets_and_epochs(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"src{i % 12}", 0) for i in range(400)], SCHEMA)
    out = mixing.mix(df, percent=150, max_epochs=2).collect()
    total = sum(1 + i % 7 for i in range(400))
    assert abs(sum(r.take_tokens for r in out) - total * 150 // 100) <= 12
    seen = defaultdict(set)
    for r in out:
        assert r.epoch not in seen[r.doc_id] and r.epoch < 2 and 0 < r.take_tokens <= r.tokens
        seen[r.doc_id].add(r.epoch)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns


def test_shards_are_balanced_and_hold_groups(spark):
    d = "/root/testdata/sf0.1"
    out = op8_shards(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    loads, slots, group = defaultdict(int), defaultdict(list), {}
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert group.setdefault(texts[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(loads) == 40 and max(loads.values()) < 1.02 * min(loads.values())


def test_shards_of_odd_rows(spark):
    out = shards.shard_documents(odd(spark), shards=2).collect()
    assert len(out) == len(ODD)
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (1, 2)} == {(16, 0)}
    assert shards.shard_documents(odd(spark).limit(0)).collect() == []


def tokens_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, texts):
    import numpy as np

    ids = {i: t for i, t in zip(texts, tokens_of([x or "" for x in texts.values()]), strict=True)}
    seqs, got = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(part.tobytes()), len(part), r.doc_tokens) == (r.ids_crc32, r.length, len(ids[r.doc_id]))
        seqs[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.start, r.length))
    for pieces in [*seqs.values(), *got.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    assert all(sum(n for _, n in s) <= 2048 for s in seqs.values())
    assert {i: sum(n for _, n in p) for i, p in got.items()} == {i: len(t) for i, t in ids.items()}
    return seqs


def test_packing_keeps_every_token(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seqs = check_packing(op10_packed(spark, d).collect(), texts)
    full = sum(n for s in seqs.values() for _, n in s) / (2048 * len(seqs))
    assert full > 0.97, full


def test_packing_of_odd_texts(spark):
    odd_texts = ["", None, "It's <|endoftext|> ok", "ΑΣ ΟΔΟΣ", "e\u0301 \u00e9", "İstanbul", "a\u00a0b\u2003c", "日本語 text", "x" * 5000, "1²3 _a_", "\x00\x1f a", "don't we'll I'M", "word " * 5000, "ß ſ ǅ", "_-a_b ×÷ Àé'S", "ÿÞ\t1\n2\x7f"]
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    check_packing(packing.pack(df, default_tokenizer()).collect(), dict(enumerate(odd_texts)))
    assert packing.pack(df.limit(0), default_tokenizer()).collect() == []


def test_words_are_cut_like_the_tokenizer_does(spark):
    import random

    from tokenizers import Tokenizer

    path = default_tokenizer()
    encoder, t = packing.WordEncoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert encoder.by_words
    rng = random.Random(2)
    parts = ["'", "'s", "'S", "'re", "'r", "'ll", "'l", "''", "d", "ve", "Ab", "é", "ÀÈ", "ß", "×", "÷", "9", "42", "-", "...", " ", "  ", "\n", "\t", "\r", "_", "<|endoftext|>", "ÿ", "İ", "…", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["'", "'s", "x'", "'l", "'re"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [e.tolist() for e in encoder.encode_many(texts)] == want


def test_word_cache_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    encoder = packing.WordEncoder(open(default_tokenizer(), encoding="utf-8").read())
    texts = [" ".join(f"{a}{b}" for b in ("na", "ne", "no")) for a in "abcdefghijklmnop"]
    want = [encoder.encode(x).tolist() for x in texts]
    for _ in range(2):
        assert [e.tolist() for x in texts for e in encoder.encode_many([x])] == want
        assert [e.tolist() for e in encoder.encode_many(texts)] == want


def test_other_tokenizers_are_asked_themselves(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.WordEncoder(open(path, encoding="utf-8").read())
    assert not encoder.by_words
    assert encoder.encode_many(["Some text."])[0].tolist() == encoder.encode("Some text.").tolist()


def test_histogram_packing_places_every_length():
    import random

    rng = random.Random(1)
    for _ in range(30):
        h = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        out = defaultdict(int)
        for count, pattern in packing.pack_histogram(h, 64):
            assert count > 0 and sum(pattern) <= 64
            for n in pattern:
                out[n] += count
        assert out == h


def test_clashing_columns_and_ties(spark):
    """Columns named like the operators' own are left out, and equal sizes are dealt alike each time."""
    rows = [(i, "same size %d" % (i % 10), "en", "src1", 1, 2, "x", 3, "y") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size int, g string, tokens int, start string")
    out = [tuple(r) for r in shards.shard_documents(df, shards=3).orderBy("doc_id").collect()]
    assert out == [tuple(r) for r in shards.shard_documents(df.repartition(5), shards=3).orderBy("doc_id").collect()]
    per_text = {(r[0] % 10, r[4]) for r in out}
    assert len(per_text) == 10 and {sum(s == k for _, s in per_text) for k in range(3)} == {3, 4}
    assert packing.pack(df, default_tokenizer()).count() == 30
    assert {r.doc_id for r in langid.identified(df).collect()} == set(range(30))
    assert mixing.mix(df).columns == ["doc_id", "domain", "lang", "source", "tokens", "epoch", "take_tokens"]


def test_shards_equal_plain_scheduling(spark):
    """The heap's choice beside a plain search for the least-loaded shard."""
    import random

    rng = random.Random(3)
    sizes = [(f"g{i:03}", rng.choice([5, 7, 7, 30, 31, 900])) for i in range(300)]
    loads, want = [0] * 7, {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        want[unit] = min(range(7), key=lambda s: (loads[s], s))
        loads[want[unit]] += size
    assert shards.schedule(sizes, 7) == want


def test_numbering(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    rows = shards.numbered(df, ["g"], ["id"], "n", parts=8).collect()
    for g in range(3):
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
