"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfeed.llm import ann, chat, divergence, embdedup, htmltext, langid, minhash, mixing, packing, phrases, repeats, shards, urlrules
from quantfeed.llm.common import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op6_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{told}'), (-1L, 1L, 'assistant', '{told}') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {f.__name__: f for f in (op1_nearest, op2_mix, op3_main_text, op4_url_verdicts, op5_languages, op6_vector_groups, op7_chats, op8_shards, op9_near_duplicates, op10_packed, op11_source_divergence, op12_long_repeats, op13_collocations)}

_PATTERNS = ("\\", "<|", "</s>", "<s>", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{p}', ''))) // {len(p)}" for p in _PATTERNS)


def _written(col: str) -> str:
    return f"length({col}) + " + _ESCAPES.format(col)


ORACLES = {
    "op2_mix": mixing.MIX_SQL,
    "op11_source_divergence": divergence.AUDIT_SQL,
    "op13_collocations": phrases.COLLOCATIONS_SQL,
    "op7_chats": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS x(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)} + {_written('role')} + {_written('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
