"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_path(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/checkpoints")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when the job has ended: what it wrote is read again, they are not."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage: rows are written to the shared checkpoint folder and read from there.

    A written table also gives later joins its true size; a checkpoint keeps the plan's estimate,
    which multiplies with every join of a loop. The files stay until the folder is cleared, so they are
    packed by zstd, which takes less room than the default. ``by``: columns with a folder for each of their values.
    """
    spark = df.sparkSession
    path = _shared_path(spark)
    with shuffles_dropped(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Written down like durable, dealt and sorted by a key that is unique, so that tables of equal buckets join without a shuffle."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", _shared_path(spark)).saveAsTable(name)
    return spark.table(name)


def with_row_key(df: DataFrame, key: str) -> DataFrame:
    """Adds a long that no two rows share, equal rows included; written down, so that it stays the same."""
    return durable(df.withColumn(key, F.monotonically_increasing_id()))


def unique_ids(df: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null and none comes twice."""
    return df.groupBy(id_col).agg(F.count("*").alias("c")).filter(F.col("c") > 1).isEmpty() and df.filter(F.col(id_col).isNull()).isEmpty()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows that hold about ``most`` units together; a longer row comes alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


#: Slots of a bitmap of keys, 8 MB whatever the input; Spark builds it in parts of 32,768 slots.
SLOTS, SLOTS_A_PART = 1 << 26, 1 << 15


def slots_taken(keys: DataFrame, slot: Column, slots: int = SLOTS) -> bytes | None:
    """Bitmap of the slots (below ``slots``) that the keys fall into; None for no keys at all.

    It is put together where the keys are, so the driver gets at most slots / 8 bytes.
    """
    parts = keys.select(slot.alias("s")).groupBy(F.expr(f"s div {SLOTS_A_PART}").alias("part")).agg(F.expr(f"bitmap_construct_agg(s % {SLOTS_A_PART})").alias("bits")).collect()
    if not parts:
        return None
    size = SLOTS_A_PART // 8
    taken = bytearray(slots // 8)
    for r in parts:
        taken[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return bytes(taken)


def key_slot(first: str, key: str) -> Column:
    """Slot of a key made of two columns."""
    return F.crc32(F.concat(F.col(first).cast("binary"), F.lit(b"\0"), F.col(key).cast("binary"))) % SLOTS


def sent_slots(spark: SparkSession, taken: bytes) -> Broadcast:
    """The bitmap for a job's tasks, packed: an almost empty one is small on disk."""
    return spark.sparkContext.broadcast(zlib.compress(taken, 1))


def slots_here(sent: Broadcast) -> np.ndarray:
    """A sent bitmap, unpacked once a task."""
    return np.frombuffer(zlib.decompress(sent.value), np.uint8)


def slots_of(first: str, keys: list[bytes]) -> np.ndarray:
    """What key_slot gives for keys (first, key)."""
    begin = zlib.crc32(first.encode() + b"\0")
    return np.fromiter((zlib.crc32(k, begin) for k in keys), np.int64, len(keys)) % SLOTS


def slots_hold(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
