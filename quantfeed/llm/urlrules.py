"""URL filters by association rules: FP-growth mines token combinations of labelled URLs."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import durable

#: Explicit rules (host, path, verdict); the longest that fits wins over what was mined.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Stands for the label in mined item sets; no URL token holds a blank.
BAD = "is bad"
#: Rules that rest on fewer labelled URLs than this are chance, whatever their share.
LEAST_URLS = 20
#: Standard deviations below the seen confidence at which a rule must still beat the rest.
DEVIATIONS = 2.0
#: So many rules are broadcast to the URLs as an index (a few hundred bytes each); more are joined by shuffle.
BROADCAST_RULES = 10_000
_RULES = "rule_id long, tokens array<string>, confidence double, support double"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict, or nulls.

    A rule fits its host and subdomains if the path starts with the rule's. Of equal length the one
    with the longer host wins, then the first in order.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's domain suffixes and words, the path's segments with digits as 0."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "0")))
    return F.array_distinct(F.concat(suffixes, words, parts))


def lower_bound(hits: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """Wilson's lower bound of a share that was seen as hits of n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, lift: float = 1.5, least: int = LEAST_URLS) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) whose tokens make a URL bad.

    ``labelled``: rows (tokens, bad). A rule is kept if it rests on ``least`` bad URLs and a share of
    ``min_support`` of all, its confidence reaches the limit, even its lower bound beats the share of bad
    URLs ``lift`` times, and no shorter rule within it is as confident; their number isn't limited.
    Rows with a null in either column don't count. Tokens that always occur together are mined as one, since a
    rule needs only one of them, and each of them gives a rule. No labelled rows, or none bad: no rules.
    """
    spark = labelled.sparkSession
    rows = durable(labelled.filter("bad is not null and tokens is not null").select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "bad"))
    n, share = rows.agg(F.count("*"), F.avg(F.col("bad").cast("int"))).first()
    if not share:
        return spark.createDataFrame([], _RULES)
    # Equal counts and equal 128 bits of the rows' hashes: the same rows.
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("h2"))
    least = max(least, math.ceil(min_support * n))
    frequent = seen.filter(F.col("n") >= least)
    reps = frequent.groupBy("n", "h1", "h2").agg(F.min("token").alias("rep"), F.sort_array(F.collect_list("token")).alias("members"))
    reps = durable(reps.select("rep", "members"))
    held = rows.select("row", F.explode("tokens").alias("rep")).join(reps.select("rep"), "rep").groupBy("row").agg(F.collect_list("rep").alias("reps"))
    items = F.coalesce("reps", F.array().cast("array<string>"))
    items = rows.join(held, "row", "left").select(F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items).alias("items"))
    sets = durable(FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(items).freqItemsets)
    bad = sets.filter(F.array_contains("items", BAD)).select(F.sort_array(F.array_remove("items", BAD)).alias("needs"), F.col("freq").alias("both"))
    free = sets.filter(~F.array_contains("items", BAD)).select(F.sort_array("items").alias("needs"), "freq")
    rated = durable(bad.join(free, "needs").select("needs", "freq", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / n).alias("support")))
    limits = (F.col("confidence") >= min_confidence) & (lower_bound(F.col("confidence") * F.col("freq"), F.col("freq")) >= lift * share)
    kept = _irredundant(rated).filter(limits)

    parts = kept.withColumn("rule", F.monotonically_increasing_id()).select("rule", "confidence", "support", F.explode("needs").alias("rep"))
    parts = parts.join(reps, "rep").groupBy("rule").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.collect_list("members").alias("members"))
    each = parts.select("confidence", "support", "members").mapInArrow(_choices, "tokens array<string>, confidence double, support double")
    return durable(each.select(F.monotonically_increasing_id().alias("rule_id"), "tokens", "confidence", "support"))


def _irredundant(rated: DataFrame) -> DataFrame:
    """The sets (needs, confidence, ...) that are more confident than any smaller set within them.

    Every part of a frequent set is there, so the most confident part comes up by one size at a time.
    """
    longest = rated.agg(F.max(F.size("needs"))).first()[0] or 0
    out = below = rated.filter(F.size("needs") == 1).withColumn("inner", F.lit(-1.0))
    for size in range(2, longest + 1):
        x = rated.filter(F.size("needs") == size)
        part = x.select(F.col("needs").alias("whole"), F.explode(F.transform("needs", lambda t: F.array_remove("needs", t))).alias("needs"))
        best = part.join(below.select("needs", F.greatest("confidence", "inner").alias("c")), "needs").groupBy("whole").agg(F.max("c").alias("inner"))
        below = durable(x.join(best.withColumnRenamed("whole", "needs"), "needs"))
        out = out.unionByName(below)
    return out.filter(F.col("confidence") > F.col("inner")).drop("inner")


def _choices(batches):
    """One rule for each way to take a token from every class."""
    for batch in batches:
        rules = ((sorted(tokens), r["confidence"], r["support"]) for r in batch.to_pylist() for tokens in itertools.product(*r["members"]))
        while part := list(itertools.islice(rules, 10_000)):
            cols = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.string()), pa.float64(), pa.float64()), strict=True)], ["tokens", "confidence", "support"])


def judge(urls: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, mined_rule), one per row of ``urls``.

    An explicit rule decides first. Otherwise the URL is blocked if all tokens of a mined rule are among
    its own; mined_rule is the most confident such rule's tokens, of equal ones the first in order.
    Candidate rules come from an inverted index that lists each rule under one token, its rarest: the
    tokens of distinct token sets are joined with it. Null and odd URLs have empty host and path and are
    allowed; a URL of any length is judged whole; repeated rows and null ids are judged alike; other
    columns are left out, whatever their names; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    x = urls.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    number = mined.count()
    if number:
        used = mined.select(F.explode("tokens").alias("token"), "rule_id").groupBy("token").agg(F.count("*").alias("uses"))
        index = mined.withColumn("token", F.explode("tokens")).join(used, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("uses", "token")).alias("token"), F.first("tokens").alias("needs"), F.first("confidence").alias("confidence"))
        if number <= BROADCAST_RULES:
            index = F.broadcast(index)
        kinds = x.select("tokens").distinct()
        pairs = kinds.withColumn("token", F.explode("tokens")).join(index.drop("rule_id"), "token")
        ranked = F.struct((-F.col("confidence")).alias("c"), "needs")
        fitting = pairs.filter(F.size(F.array_except("needs", "tokens")) == 0).groupBy("tokens").agg(F.min(ranked).alias("best"))
        x = x.join(fitting, "tokens", "left").withColumn("needs", F.col("best.needs"))
    else:
        x = x.withColumn("needs", F.lit(None).cast("array<string>"))
    name, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    x = x.select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"), F.array_join("needs", " ").alias("mined_rule"))
    return x.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule")


def judged_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts on all pages, by rules mined from those that labels call toxic or of low quality.

    A label belongs to the page of its number. Pages and labels may hold columns of any name besides
    page_id, url, doc_id, quality and toxic; several labels of one page: one bad one is enough.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    labelled = urls.join(bad, "page_id").select(url_tokens(host, path).alias("tokens"), "bad")
    return judge(urls, mine(labelled))
