"""The corpus pipeline: language, near-duplicates, mixture, packing.

Each stage reads what its predecessor wrote. run() writes every stage to the shared folder named in
spark.checkpoint.dir, so a lost executor costs the stage it was in, not the ones before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfeed.llm import langid, minhash, mixing, packing
from quantfeed.llm.common import free_name, unique_ids, with_row_key
from quantfeed.llm.queries import default_tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts and texts without letters go. Ids decide nothing."""
    return langid.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Where ids are null or come twice, rows get keys of their own in the order of ids, so such an id takes nothing away: null ids
    come after the others, and of equal ids the smallest hash of the text is kept. Texts without words
    are in no group and stay.
    """
    if unique_ids(docs):
        key, keyed = "doc_id", docs
    else:
        key = free_name(docs, "_row")
        keyed = with_row_key(docs.orderBy(F.asc_nulls_last("doc_id"), F.sha2("text", 256)), key)
    kept = minhash.near_duplicates(keyed, id_col=key, percent=80).filter("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of nine tenths of the tokens takes, rows with null or repeated ids each for itself."""
    return mixing.mixed_documents(docs, percent=90)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; rows with null or repeated ids are packed like others."""
    return packing.pack(docs, default_tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: Hashed features, sketches and token ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{shared or tempfile.gettempdir() + '/checkpoints'}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
