r"""Chat formatting with typed content parts, on DataFrame functions alone.

A turn's content is a list of parts: text, image, audio or document. The visitor flattens them in
order; a part that isn't text leaves a placeholder ``<|image|>`` and goes to the list of attachments
with its reference and the tokens that the placeholder expands to.

The template writes ``<|role:ROLE|>``, the content and ``<|end|>`` for each turn. Inside texts and roles
a backslash doubles, and a control string gets one after its first character, so that none is left and
dropping each backslash in front of another character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that each kind of attachment expands to, if the part doesn't say.
PART_TOKENS = {"image": 576, "audio": 250, "document": 1000}
PART_SCHEMA = "array<struct<type:string,text:string,ref:string,tokens:int>>"

OPEN, CLOSE, END = "<|role:", "|>", "<|end|>"
#: First characters of control strings: the template's own and those of common chat templates.
_CONTROL = r"(<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\])|<(?=</?SYS>>))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as its one part; null counts as empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return F.array(part).cast(PART_SCHEMA)


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The content with placeholders, and the attachments (position, type, ref, tokens) in order.

    A null list or part counts as an empty text; an unknown type is shown by a placeholder of its own
    and expands to 0 tokens unless it says more.
    """
    kinds = F.create_map(*[F.lit(x) for kv in PART_TOKENS.items() for x in kv])
    parts = F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(PART_SCHEMA))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    content = F.array_join(F.transform(parts, lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|part:"), escaped(p["type"]), F.lit("|>")))), "")
    others = F.filter(parts, lambda p: ~is_text(p))
    attachments = F.transform(
        others, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.try_element_at(kinds, p["type"]), F.lit(0)).alias("tokens"))
    )
    return content, attachments


def format_chats(turns: DataFrame, parts: Column | None = None, order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Rows (conv_id, formatted, attachments, attachment_tokens), one per conversation.

    Turns (conv_id, turn, role, text) are ordered by turn; equal turns by role and text, nulls first.
    Null role and null text count as empty, so an empty turn stays a turn; null conv_ids form one
    conversation. Repeated rows are turns of their own. Other columns are ignored; an empty table gives
    no rows. A conversation is one output row, so its turns meet in one task, and no more than those.
    """
    content, attachments = flatten_parts(text_parts(F.col("text")) if parts is None else parts)
    said = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit(CLOSE), content, F.lit(END))
    rows = turns.select("conv_id", F.struct(*[F.col(c) for c in order], said.alias("_said"), attachments.alias("_attachments")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    refs = F.flatten(F.col("ts._attachments"))
    return convs.select(
        "conv_id",
        F.array_join("ts._said", "").alias("formatted"),
        refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation, texts without escapes."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t.startswith(OPEN))
    bare = F.transform(turns, lambda t: F.substring(t, len(OPEN) + 1, 2147483647))
    return F.transform(
        bare,
        lambda t: F.struct(
            unescaped(F.substring_index(t, CLOSE, 1)).alias("role"),
            unescaped(F.regexp_replace(t, r"(?s)^.*?\|>", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, role: str = "assistant") -> Column:
    """What a model is trained to say: the role's texts in order."""
    return F.array_join(F.transform(F.filter(read_turns(formatted), lambda t: t["role"] == role), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    turns = F.col("turns")
    listed = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    x = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    x = x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars")
    return x.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
