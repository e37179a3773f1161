"""The feed digest as a Structured Streaming query."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantfeed.functions.timestamps import in_quiet_hours, is_fresh

#: Batches of the ledger that lie longer behind are forgotten.
LEDGER_HOURS = 72


def valid(items: DataFrame, window_minutes: int) -> DataFrame:
    """Items that were fresh when they were read (``read_at``)."""
    return items.filter(is_fresh(F.col("published_at"), F.col("read_at"), window_minutes))


def once(items: DataFrame, hours: int = 72) -> DataFrame:
    """Each key once; the memory of a key ends ``hours`` behind the newest stamp."""
    return items.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(["key"])


def unsent(items: DataFrame, hours: float = LEDGER_HOURS, late: str = "0 seconds") -> DataFrame:
    """Items of a stream whose key wasn't sent in an earlier round within the last ``hours``.

    A round is what was read at one time (``read_at``) and doesn't dedupe itself: its items of a new key all pass. A key
    is remembered from the round that sent it, not refreshed by later ones, and forgotten when the watermark on
    ``read_at`` is so far ahead, by a timer of its state. Null keys are a key; items without ``read_at`` go.
    """
    memory = dt.timedelta(hours=hours)

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        for read_at, rows in pd.concat(list(parts)).groupby("read_at", sort=True):
            if sent is None or read_at - sent > memory:
                sent = read_at
                yield rows
        state.update((int(sent.value // 1000),))
        # A timer can't lie behind the watermark.
        state.setTimeoutTimestamp(max(int((sent + memory).value // 1_000_000) + 1, state.getCurrentWatermarkMs() + 1))

    held = items.filter("read_at is not null").withWatermark("read_at", late)
    return held.groupBy("key").applyInPandasWithState(pick, items.schema, "sent long", "append", GroupStateTimeout.EventTimeTimeout)


def in_rounds(rounds: Iterable[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> int:
    """Run a stream once a round: rows of a round are added to its source, then it runs until it has read them.

    Each run starts anew from its checkpoint, so what it remembers comes from there. Gives the number of rounds.
    """
    n = 0
    for rows in rounds:
        rows.write.mode("append").parquet(f"{folder}/source")
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/source")
        start(stream).awaitTermination()
        n += 1
    return n


def land_streams(streams: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Run one streaming query a feed at the same time, each with a checkpoint and a folder of its own below ``path``.

    Rows (source, ok, batches, error): a feed that fails, at its start or in a later batch, keeps the batches that it has
    written and stops alone. The others run on until they have read their input.
    """
    running, went = {}, []
    for name, stream in streams.items():
        try:
            begun = stream().writeStream.format("parquet").option("path", f"{path}/source={name}").option("checkpointLocation", f"{path}/_log/{name}")
            running[name] = begun.trigger(availableNow=True).start()
        except PySparkException as e:
            went.append((name, False, 0, type(e).__name__))
    for name, query in running.items():
        error = None
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            error = type(e).__name__
        went.append((name, error is None, sum(p.numInputRows > 0 for p in query.recentProgress), error))
    return SparkSession.active().createDataFrame(went, "source string, ok boolean, batches long, error string")


def sliding(items: DataFrame, window_minutes: int = 180, every: int = 30, late: str = "72 hours") -> DataFrame:
    """Counts per source over sliding windows; batch or stream."""
    w = F.window("published_at", f"{window_minutes} minutes", f"{every} minutes")
    counted = (items.withWatermark("published_at", late) if items.isStreaming else items).groupBy(w.alias("w"), "source").agg(F.count("*").alias("items"))
    return counted.select(F.col("w.start").alias("window_start"), "source", "items")


def deliver(items: DataFrame, publish: Callable[[DataFrame, int], None], ledger_path: str, checkpoint: str, hours: int = LEDGER_HOURS) -> StreamingQuery:
    """Each batch: publish what the ledger lacks, then append its keys; a failed delivery is tried again.

    The ledger is parted by the day on which a key was sent, and only the days of the last ``hours`` are
    read, so a batch's work doesn't grow with the ledger's age. A batch, known by checkpoint and number,
    that comes again after a failure sees its own keys as new.
    """
    kinds = "key string, batch string, sent_at timestamp, day date"
    items.sparkSession.createDataFrame([], kinds).write.mode("append").partitionBy("day").parquet(ledger_path)

    def batch(rows: DataFrame, batch_id: int) -> None:
        now, name = F.current_timestamp(), f"{checkpoint}:{batch_id}"
        sent = rows.sparkSession.read.schema(kinds).parquet(ledger_path).filter(F.col("day") >= F.to_date(now) - F.lit(hours // 24 + 1))
        earlier = sent.filter((F.col("batch") != name) & (F.unix_micros("sent_at") >= F.unix_micros(now) - hours * 3_600_000_000)).select("key")
        new = rows.join(earlier, "key", "left_anti")
        publish(new, batch_id)
        new.select("key", F.lit(name).alias("batch"), now.alias("sent_at"), F.to_date(now).alias("day")).write.mode("append").partitionBy("day").parquet(ledger_path)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat(batch: DataFrame, batch_id: int) -> DataFrame:
    """One row of a round's figures (batch_id, items, newest), also for an empty round."""
    return batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count("*").alias("items"), F.max("published_at").alias("newest"))


def outside_quiet_hours(publish: Callable[[DataFrame, int], None], start: str, end: str, now=F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """A publish function that does nothing inside the quiet hours; what fell into them isn't made up for."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        publish(batch.filter(~in_quiet_hours(now(), start, end)), batch_id)

    return guarded


def land_feeds(spark: SparkSession, feeds: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Write each feed below ``path`` by itself; rows (source, ok, error) say how each one went.

    A feed that can't be read or written gives a status row and no items; the others go on.
    """
    went = []
    for name, feed in feeds.items():
        try:
            feed().write.mode("overwrite").parquet(f"{path}/source={name}")
            went.append((name, True, None))
        except PySparkException as e:
            went.append((name, False, type(e).__name__))
    return spark.createDataFrame(went, "source string, ok boolean, error string")
