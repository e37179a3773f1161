"""Streams over several rounds, each a run of its own from the same checkpoint."""

import datetime as dt

from quantfeed.streaming import digest

SCHEMA = "key string, read_at timestamp, ord int"
T0 = dt.datetime(2024, 1, 1)


def test_keys_come_back_after_their_time(spark, tmp_path):
    """A round doesn't dedupe itself, memory isn't refreshed, and runs take it over from the checkpoint."""
    hours = [(0, "a", 1), (0, "a", 2), (0, None, 3), (50, "a", 4), (50, "b", 5), (71, "a", 6), (72, "a", 7), (73, "a", 8), (73, None, 9), (73, "a", 10), (145, "a", 11), (146, "b", 12)]
    rounds = [[(k, T0 + dt.timedelta(hours=h), i) for h, k, i in hours if h == at] for at in sorted({h for h, _, _ in hours})]
    frames = [spark.createDataFrame(r, SCHEMA) for r in rounds]

    def start(stream):
        return digest.unsent(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()

    assert digest.in_rounds(frames, str(tmp_path), start) == len(rounds)
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 5, 8, 9, 10, 12]


def test_windows_are_written_once(spark, tmp_path):
    minute = lambda m, i: ("s", T0 + dt.timedelta(minutes=m), i)
    rounds = [[minute(5, 1), minute(40, 2)], [minute(400, 3), minute(6, 4)], [minute(7, 5), minute(401, 6)], [minute(2000, 7)]]
    frames = [spark.createDataFrame(r, "source string, published_at timestamp, ord int") for r in rounds]

    def start(stream):
        made = digest.sliding(stream, 30, 30, late="60 minutes")
        return made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()

    digest.in_rounds(frames, str(tmp_path), start)
    out = [((r.window_start - T0).seconds // 60, r["items"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()]
    # item 4 comes while its window is open, item 5 after it was written
    assert out == [(0, 2), (30, 1), (390, 2)]
