"""Mixing sources to target weights by hierarchical budgets, on DataFrame functions alone.

A token budget runs down a tree of domain, language and source. At each node the children share the
node's budget by weight; no child gets more than its documents hold over all allowed epochs, and
what it can't take goes to its siblings by weight. A node's limit is the sum of its leaves' limits,
so a shortage leaves a family only if the whole family is used up. Each leaf then takes whole epochs
and a token-prefix of one more, in an order drawn from seed, epoch and id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.llm.common import durable, free_name, unique_ids, with_row_key

#: Default tree: web crawls are the sources src0 to src9, curated ones the rest.
DOMAIN_WEIGHTS = {"web": 3.0, "curated": 2.0}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
WEB_SOURCE = r"^src\d$"
#: Words between ASCII spaces count as tokens.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that form a bucket, at each of LEVELS levels: 256 buckets a leaf, then
#: 256 in the one where the prefix ends. Only one bucket of the last level is ever sorted.
BUCKET_DIGITS, LEVELS = 2, 2
#: Leaf tables up to this many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_LEAVES = 20_000

_LEAF = ("domain", "lang", "source")


def _weight(weights: Mapping[str, float], key: str) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(1.0))


def fill(children: DataFrame, parent: list[str], child: str, budget: str, weight: str, limit: str, out: str) -> DataFrame:
    """Share the parent's budget among its children by weight, up to each child's limit.

    In the order of limit / weight the children that are filled up come first, so running sums decide
    who they are. A weight of 0 gets nothing; equal ratios are ordered by the child's name.
    """
    w = Window.partitionBy(*parent).orderBy("_ratio", child)
    whole = Window.partitionBy(*parent)
    ratio = F.when(F.col(weight) > 0, F.col(limit) / F.col(weight)).otherwise(F.lit(0.0))
    usable = F.when(F.col(weight) > 0, F.col(limit).cast("double")).otherwise(F.lit(0.0))
    x = children.withColumn("_ratio", ratio).withColumn("_usable", usable)
    before = F.coalesce(F.sum("_usable").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("_full", before + F.col("_ratio") * F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing)) <= F.col(budget))
    taken = F.sum(F.when(F.col("_full"), F.col("_usable")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(weight))).over(whole)
    x = x.withColumn("_level", F.try_divide(F.col(budget) - taken, rest))
    share = F.when(F.col("_full"), F.col("_usable")).otherwise(F.col(weight) * F.coalesce("_level", F.lit(0.0)))
    return x.withColumn(out, share).drop("_ratio", "_usable", "_full", "_level")


def budgets(leaves: DataFrame, percent: int, max_epochs: int, domain_weights: Mapping[str, float], language_weights: Mapping[str, float], source_weights: Mapping[str, float]) -> DataFrame:
    """Leaves (domain, lang, source, leaf_tokens) with alloc, the tokens that each may take."""
    x = leaves.withColumn("limit", F.col("leaf_tokens") * F.lit(max_epochs))
    total = F.floor(F.sum("leaf_tokens").over(Window.partitionBy(F.lit(1))) * percent / 100).cast("double")
    x = x.withColumn("budget", total)
    for depth, (name, weights) in enumerate((("domain", domain_weights), ("lang", language_weights), ("source", source_weights))):
        path = list(_LEAF[: depth + 1])
        if depth < 2:
            nodes = x.groupBy(*path).agg(F.sum("limit").alias("limit"), F.first("budget").alias("budget"))
        else:
            nodes = x
        nodes = fill(nodes.withColumn("weight", _weight(weights, name)), path[:-1] or [F.lit(1)], name, "budget", "weight", "limit", "share")
        x = x.drop("budget").join(nodes.select(*path, F.col("share").alias("budget")), path)
    return x.select(*_LEAF, "leaf_tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("alloc"))


def mix(
    docs: DataFrame,
    percent: int = 50,
    max_epochs: int = 2,
    seed: int = 7,
    domain: Column | None = None,
    domain_weights: Mapping[str, float] = DOMAIN_WEIGHTS,
    language_weights: Mapping[str, float] = LANGUAGE_WEIGHTS,
    source_weights: Mapping[str, float] | None = None,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, domain, lang, source, tokens, epoch, take_tokens): what each document gives to the mix.

    percent: budget as a share of all tokens. A document is chosen once an epoch at most; the last one
    of a leaf's prefix may give only its first take_tokens. Unknown names weigh 1. Null lang or source
    forms a leaf named ``(none)``; documents without tokens are never chosen; a null doc_id takes part
    like the empty id. Repeated rows count as documents of their own. An empty table gives no rows.
    Columns named in ``carried`` come along and order rows of equal id and tokens; others are left out,
    whatever their names. A text of any length is counted whole.
    """
    if domain is None:
        domain = F.when(F.col("source").rlike(WEB_SOURCE), "web").otherwise("curated")
    source = F.coalesce("source", F.lit("(none)"))
    lang = F.coalesce("lang", F.lit("(none)"))
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*carried, "doc_id", domain.alias("domain"), lang.alias("lang"), source.alias("source"), tokens.alias("tokens"))
    rows = durable(rows.filter("tokens > 0"))

    leaves = rows.groupBy(*_LEAF).agg(F.sum("tokens").alias("leaf_tokens"))
    plan = budgets(leaves, percent, max_epochs, domain_weights, language_weights, source_weights or {})
    full = F.floor(F.col("alloc") / F.col("leaf_tokens")).cast("long")
    plan = durable(plan.withColumn("full", full).withColumn("rest", F.col("alloc") - F.col("full") * F.col("leaf_tokens")).select(*_LEAF, "full", "rest"))
    small = plan.count() <= BROADCAST_LEAVES
    of_leaf = (lambda x: F.broadcast(x)) if small else (lambda x: x)

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = rows.join(of_leaf(plan), list(_LEAF)).withColumn("key", key)

    out = (*carried, "doc_id", *_LEAF, "tokens", "epoch", "take_tokens")
    taken = keyed.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1))).withColumn("take_tokens", F.col("tokens")).select(*out)
    # The prefix's end lies in one bucket a leaf: those before go in whole, only that one is looked into.
    cut = keyed.filter("rest > 0")
    for level in range(LEVELS):
        cut = cut.withColumn("bucket", F.substring("key", 1 + level * BUCKET_DIGITS, BUCKET_DIGITS))
        sums = cut.groupBy(*_LEAF, "rest", "bucket").agg(F.sum("tokens").alias("t"))
        running = F.sum("t").over(Window.partitionBy(*_LEAF).orderBy("bucket"))
        edge = sums.withColumn("end", running).filter("end - t < rest and end >= rest").select(*_LEAF, F.col("bucket").alias("edge"), (F.col("rest") - F.col("end") + F.col("t")).alias("left"))
        cut = cut.join(of_leaf(durable(edge)), list(_LEAF))
        before = cut.filter("bucket < edge").withColumn("epoch", F.col("full")).withColumn("take_tokens", F.col("tokens"))
        taken = taken.unionByName(before.select(*out))
        cut = cut.filter("bucket = edge").withColumn("rest", F.col("left")).drop("bucket", "edge", "left")
    order = Window.partitionBy(*_LEAF).orderBy("key", "tokens", *carried).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("start", F.sum("tokens").over(order) - F.col("tokens")).filter("start < rest")
    cut = cut.withColumn("epoch", F.col("full")).withColumn("take_tokens", F.least("tokens", F.col("rest") - F.col("start")))
    return taken.unionByName(cut.select(*out))


def mixed_documents(docs: DataFrame, percent: int = 90, seed: int = 7) -> DataFrame:
    """The documents that one epoch's mix takes whole, with all their columns.

    Each row is taken or left for itself: rows with a null or repeated id are documents of their own, and
    ties are broken by row. Null and empty texts have no tokens and aren't taken, nor is the one document
    of each leaf that the budget would cut. An empty table gives no rows.
    """
    if unique_ids(docs):
        key, keyed = "doc_id", docs
    else:
        key = free_name(docs, "_row")
        keyed = with_row_key(docs, key)
    input_columns = ["doc_id", "lang", "source", "text"]
    rows = keyed.select(*(F.col(c) for c in dict.fromkeys([*input_columns, key])))
    carried = () if key == "doc_id" else (key,)
    taken = mix(rows, percent=percent, max_epochs=1, seed=seed, carried=carried).filter("take_tokens = tokens").select(key)
    return keyed.join(taken, key, "left_semi").select(*docs.columns)


#: The same mix in SQL, for the default parameters.
MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents WHERE text IS NOT NULL),
r AS (SELECT * FROM d WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS leaf_tokens, CAST(sum(tokens) * 2 AS DOUBLE) AS lim FROM r GROUP BY ALL),
a0 AS (SELECT domain, sum(lim) AS lim, CASE domain WHEN 'web' THEN 3.0 WHEN 'curated' THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
              (SELECT floor(sum(leaf_tokens) * 50 / 100) FROM leaf)::DOUBLE AS b FROM leaf GROUP BY domain),
a1 AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + lim / w * sum(w) OVER (ORDER BY lim / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS full_ FROM a0),
a2 AS (SELECT domain, CASE WHEN full_ THEN lim ELSE w * (b - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS b FROM a1),
b0 AS (SELECT l.domain, l.lang, sum(lim) AS lim, any_value(a2.b) AS b,
              CASE l.lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf l JOIN a2 USING (domain) GROUP BY l.domain, l.lang),
b1 AS (SELECT *, coalesce(sum(lim) OVER (PARTITION BY domain ORDER BY lim / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + lim / w * sum(w) OVER (PARTITION BY domain ORDER BY lim / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS full_ FROM b0),
b2 AS (SELECT domain, lang, CASE WHEN full_ THEN lim ELSE w * (b - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER (PARTITION BY domain)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY domain) END AS b FROM b1),
c0 AS (SELECT l.*, b2.b, 1.0::DOUBLE AS w FROM leaf l JOIN b2 USING (domain, lang)),
c1 AS (SELECT *, coalesce(sum(lim) OVER (PARTITION BY domain, lang ORDER BY lim, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + lim * sum(w) OVER (PARTITION BY domain, lang ORDER BY lim, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS full_ FROM c0),
c2 AS (SELECT domain, lang, source, leaf_tokens, CAST(floor(1e-6 + CASE WHEN full_ THEN lim ELSE (b - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER (PARTITION BY domain, lang)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY domain, lang) END) AS BIGINT) AS alloc FROM c1),
p AS (SELECT *, alloc // leaf_tokens AS full_, alloc % leaf_tokens AS rest FROM c2),
e AS (SELECT r.*, p.full_, p.rest, g.i AS epoch FROM r JOIN p USING (domain, lang, source), LATERAL (SELECT unnest(range(0, p.full_ + 1)) AS i) g),
k AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('7:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), tokens ROWS UNBOUNDED PRECEDING) - tokens AS start_ FROM e)
SELECT doc_id, domain, lang, source, tokens, epoch, CAST(CASE WHEN epoch < full_ THEN tokens ELSE least(tokens, rest - start_) END AS BIGINT) AS take_tokens
FROM k WHERE epoch < full_ OR start_ < rest
"""
