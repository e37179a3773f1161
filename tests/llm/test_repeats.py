"""Long repeats: against a set of all strings seen so far."""

import hashlib

import pytest

from quantfeed.llm import repeats
from quantfeed.llm.queries import op12_long_repeats

SCHEMA = "doc_id long, text string, ord string, spans string"


def brute(rows, length=100):
    """Rows (doc_id, text) in order."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        runs = sum(b and not a for a, b in zip(b"\0" + gone, gone, strict=False))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, scale):
    d = f"/root/testdata/{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(op12_long_repeats(spark, d)) == brute(sorted(rows))


@pytest.mark.parametrize("batches", [1, 5])
def test_odd_rows(spark, batches, monkeypatch):
    """Passages with ends of their own, periodic and long texts, pieces, null and repeated ids, repeated rows."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
    passage = "".join(f"line {k} of a passage that many hold, " for k in range(9))
    rows = [(k, f"begin {k * 7919} " + passage[k % 7 : len(passage) - k % 5] + f" end {k}") for k in range(40)]
    rows += [(100, "ab" * 900), (101, "x" * 400), (102, "x" * 99), (103, "é" * 60), (104, "".join(f"{k * k} " for k in range(900)) + passage + "".join(f"{k * k} " for k in range(900)))]
    rows += [(None, passage), (None, None), (105, ""), (105, passage), (105, passage), (105, "y" * 150), (None, passage), (None, "z" * 100)]
    docs = spark.createDataFrame([(i, t, "o", "s") for i, t in rows], SCHEMA)
    frame = repeats.without_repeats(docs, batches)
    found = [(r.doc_id, len(r.text), sum(x.hi - x.lo for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in frame.collect()]
    assert sorted(found, key=str) == brute(in_order(rows))
    assert got(repeats.digests(docs.limit(0))) == []
