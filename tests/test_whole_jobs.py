"""Jobs that must do their whole work: each test failed while an operator cut something."""

import hashlib

from __spark_entry__ import queries
from quantfeed.operators import reports

#: The SHA-256 of these two begins with the same 48 bits.
SAME_PREFIX = ("text 44519985", "text 46698260")


def test_merged_reports_stay_rows_and_hashes_are_whole(spark):
    rows = [(1, "a", SAME_PREFIX[0]), (2, "a", SAME_PREFIX[1]), (3, "b", SAME_PREFIX[0]), (4, "b", "# Head\nbody"), (5, "a", "last"), (5, "a", "last")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    dup = {r.doc_id: (r.sha, r.duplicate_of) for r in reports.distinct_documents(docs).collect()}
    assert dup[1][0] == dup[2][0] and len(dup[1][0]) == 12
    assert [dup[i][1] for i in (1, 2, 3, 4)] == [None, None, 1, None]
    sections = reports.merged(docs, "source")
    assert sections.count() == 5
    a = [f"## 1\n\n{SAME_PREFIX[0]}", f"## 2\n\n{SAME_PREFIX[1]}", "## 5\n\nlast", "## 5\n\nlast"]
    assert [r.section for r in sections.filter("source = 'a'").orderBy("doc_id").collect()] == a
    out = {r.source: (r.sources, r.total_chars, r.digest) for r in reports.merged_totals(sections, "source").collect()}
    assert out["a"] == (4, 34, hashlib.md5("\n\n".join(a).encode()).hexdigest())
    assert out["b"] == (1, 11, hashlib.md5(b"## Head\n\nbody").hexdigest())
    assert reports.merged_totals(reports.merged(docs.limit(0), "source"), "source").collect() == []


def test_feeds_without_limits_see_every_event(spark):
    d = "/root/testdata/sf0.01"
    found = queries()
    events = spark.read.parquet(f"{d}/events.parquet").count()
    counters = found["feed_counters_all"](spark, d).collect()
    assert sum(r.fetched for r in counters) == events
    digest = found["feed_digest_all"](spark, d).collect()
    places = {}
    for r in digest:
        places.setdefault(r.source, []).append(r.place)
    assert {s: len(p) for s, p in places.items()} == {r.source: r.kept for r in counters if r.kept}
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) > 40 for p in places.values())
    whole, limited = ({r.key for r in found[q](spark, d).collect()} for q in ("ledger_update_all", "ledger_update"))
    assert limited < whole
