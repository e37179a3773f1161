"""Boards of instruments: members, matching of topics, leaders, code mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risky_name(name: Column) -> Column:
    """Names with ST, 退 or * once spaces are out."""
    return F.coalesce(F.upper(F.regexp_replace(name, r"(?U)\s", "")).rlike(r"ST|退|\*"), F.lit(False))


def exchange_symbol(code: Column) -> Column:
    """A six-digit code with its exchange's suffix; null for other codes."""
    six = code.rlike(r"^\d{6}$")
    return F.when(six & code.rlike("^[69]"), F.concat(code, F.lit(".SS"))).when(six & code.rlike("^[023]"), F.concat(code, F.lit(".SZ"))).when(six & code.rlike("^[48]"), F.concat(code, F.lit(".BJ")))


def market_id(code: Column) -> Column:
    """The code after its market's number: 1 for Shanghai, else 0."""
    return F.concat(F.when(F.trim(code).rlike("^[69]"), "1.").otherwise("0."), F.trim(code))


def symbol_of_id(ident: Column) -> Column:
    """Symbol of a market id, a symbol or a plain code. The market's number tells an index from a share of its code."""
    s = F.trim(ident)
    left, right = F.regexp_extract(s, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(s, r"^(.*)\.([^.]*)$", 2)
    suffix = F.when(left == "1", ".SS").when(left == "0", ".SZ").when(left == "2", ".BJ")
    return F.when(~s.contains("."), exchange_symbol(s)).when(F.upper(right).isin("SS", "SZ", "BJ"), s).otherwise(F.coalesce(F.concat(right, suffix), exchange_symbol(right)))


def plain_code(ident: Column) -> Column:
    """The digits of a market id, a symbol or a plain code."""
    s = F.trim(F.coalesce(ident, F.lit("")))
    left, right = F.regexp_extract(s, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(s, r"^(.*)\.([^.]*)$", 2)
    return F.when(~s.contains("."), s).when(F.upper(right).isin("SS", "SZ", "BJ"), left).otherwise(right)


def estimated_amount(price: Column, volume: Column) -> Column:
    """Price times volume, 0 where either is missing."""
    return F.coalesce(price * volume, F.lit(0.0))


def top_members(members: DataFrame, n: int) -> DataFrame:
    """The n members of each board with the largest amount, risky names left out beforehand."""
    w = Window.partitionBy("board").orderBy(F.desc("amount"), "code")
    return members.filter(~risky_name(F.col("name"))).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_of_market(members: DataFrame, n: int) -> DataFrame:
    """The n instruments of the whole market with the largest amount."""
    return members.filter(~risky_name(F.col("name"))).orderBy(F.desc("amount"), "code").limit(n).withColumn("universe", F.lit("market"))


def of_topics(topics: DataFrame, matched: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Each topic's n instruments with the largest amount: over its matched boards or, where none matches, of the market.

    topics (topic), matched (topic, board), members (board, code, name, amount). An instrument of several boards counts
    once. Adds place and universe (boards or market); the market's leaders are n rows, so each topic takes them as a list.
    """
    safe = members.filter(~risky_name(F.col("name")))
    own = matched.select("topic", "board").distinct().join(safe, "board").groupBy("topic", "code").agg(F.min("name").alias("name"), F.max("amount").alias("amount"))
    w = Window.partitionBy("topic").orderBy(F.desc("amount"), "code")
    own = own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn("universe", F.lit("boards"))
    market = top_of_market(safe.groupBy("code").agg(F.min("name").alias("name"), F.max("amount").alias("amount")), n)
    listed = market.agg(F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), "code", "name", "amount"))).alias("ms")).scalar()
    others = topics.select("topic").distinct().join(own.select("topic").distinct(), "topic", "left_anti")
    others = others.select("topic", F.posexplode(listed).alias("at", "m"))
    others = others.select("topic", "m.code", "m.name", "m.amount", (F.col("at") + 1).alias("place"), F.lit("market").alias("universe"))
    return own.select("topic", "code", "name", "amount", "place", "universe").union(others)


def board_summary(members: DataFrame) -> DataFrame:
    """Mean change of a board and its leader; a change of null or 0 never leads."""
    weight = F.struct(F.coalesce(F.nullif("change", F.lit(0.0)), F.lit(-999.0)).alias("c"), (-F.col("code")).alias("t"))
    return members.groupBy("board").agg(F.count("*").alias("members"), F.avg("change").alias("change"), F.max_by("name", weight).alias("leader"))


def match_score(word: Column, name: Column) -> Column:
    """How well a topic's word names a board; null if not at all."""
    n, m = F.length(word), F.length(name)
    return (
        F.when(word == name, 100.0 + n)
        .when(F.contains(name, word), 60.0 + 2 * n - 0.5 * (m - n))
        .when(F.contains(word, name) & (m >= 2), 50.0 + 2 * m)
    )


def _parts(text: Column) -> Column:
    """All distinct parts of a name; their number grows with the square of its length."""
    starts = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.transform(starts(n), lambda i: F.substr(text, i, n)))))


def matched_boards(words: DataFrame, boards: DataFrame, n: int = 5) -> DataFrame:
    """The n boards that match each topic best; the longest word counts where scores tie.

    One of a word and a board that fit holds the other, so the parts of either are joined with the other
    as a whole; nothing is broadcast or compared pair by pair.
    """
    named = boards.filter(F.length("board") > 0)
    looked = words.select("word").distinct().filter(F.length("word") > 0)
    inside = named.select("board", F.explode(_parts(F.col("board"))).alias("word")).join(looked, "word")
    around = looked.select("word", F.explode(_parts(F.col("word"))).alias("board")).join(named.select("board"), "board")
    fitting = inside.select("word", "board").union(around.select("word", "board")).distinct()
    scored = fitting.join(named, "board").withColumn("score", match_score(F.col("word"), F.col("board"))).filter("score is not null")
    pairs = words.join(scored, "word").select("topic", "word", "board", "change", "score").repartition("topic")
    best = pairs.groupBy("topic", "board", "change").agg(F.max("score").alias("score"), F.max_by("word", F.struct(F.col("score"), F.length("word"), F.col("word"))).alias("matched_by"))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.desc(F.abs("change")), "board")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def universe(members: DataFrame) -> DataFrame:
    """Distinct members over all boards with the first board's name for each."""
    return members.groupBy("code").agg(F.min_by("name", "ord").alias("name"))


def all_boards(industries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Members (board, code, name, ...) of both lists with kind.

    A board in both lists has the concept's members, but counts as an industry.
    """
    both = industries.withColumn("_concept", F.lit(False)).unionByName(concepts.withColumn("_concept", F.lit(True)), allowMissingColumns=True)
    lists = both.groupBy("board").agg(F.bool_or("_concept").alias("_wins"), F.when(F.bool_or(~F.col("_concept")), "industry").otherwise("concept").alias("kind"))
    return both.join(lists, "board").filter(F.col("_concept") == F.col("_wins")).drop("_concept", "_wins")
