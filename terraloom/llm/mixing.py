"""Hierarchical token budgets over a domain-language-source tree and seeded epochs of each leaf's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.tables import running_totals, words_of
from terraloom.session import materialize

LEVELS = ["domain", "lang", "source"]
#: Relative weights among siblings; a name that is not listed weighs 1.
WEIGHTS = {"domain": {"web": 3, "library": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: Passes over a leaf's documents at most.
EPOCHS = 2


def default_domain() -> Column:
    """Sources with an even last digit belong to the web, all others (also unnamed ones) to the library."""
    return F.when(F.coalesce(F.col("source"), F.lit("")).rlike("[02468]$"), "web").otherwise("library")


def weight_of(level: str, weights: dict[str, int]) -> Column:
    listed = [F.when(F.col(level) == name, F.lit(w)) for name, w in weights.items()]
    return F.coalesce(*listed, F.lit(1)).cast("bigint")


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` among its children by `weight`, none above its `capacity`; adds `granted`.

    Children are filled in the order of capacity per weight: while what is left grants a child its whole capacity it is
    full, and the rest divides what remains by weight, rounded so that the sum is exact. A child's shortage so goes to
    its siblings; the parent returns budget only when all its children are full, that is through its own capacity.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*parents)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = F.col("capacity") * F.sum("weight").over(after) <= F.col("weight") * left
    df = children.withColumn("_full", full)
    open_weight = F.when(F.col("_full"), 0).otherwise(F.col("weight"))
    df = df.withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(whole))
    df = df.withColumn("_open", F.sum(open_weight).over(whole)).withColumn("_sum", F.sum(open_weight).over(upto))
    part = F.expr("_left * _sum div _open - _left * (_sum - weight) div _open")
    return df.withColumn("granted", F.when(F.col("_full"), F.col("capacity")).otherwise(part)).drop("_full", "_left", "_open", "_sum")


def leaf_budgets(leaves: DataFrame, budget: int | None, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, granted) from (domain, lang, source, tokens); the default budget is all tokens."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1))) if budget is None else F.lit(budget)
    domains = share_out(domains.withColumn("budget", total.cast("bigint")).withColumn("weight", weight_of("domain", weights["domain"]))
                        .withColumn("_root", F.lit(1)), ["_root"], "domain")
    langs = langs.join(domains.select("domain", F.col("granted").alias("budget")), "domain").withColumn("weight", weight_of("lang", weights["lang"]))
    langs = share_out(langs, ["domain"], "lang")
    nodes = nodes.join(langs.select("domain", "lang", F.col("granted").alias("budget")), ["domain", "lang"]).withColumn(
        "weight", weight_of("source", weights["source"]))
    return share_out(nodes, ["domain", "lang"], "source").select(*LEVELS, "tokens", "granted")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixture(docs: DataFrame, budget: int | None = None, weights: dict[str, dict[str, int]] | None = None, epochs: int = EPOCHS, seed: int = 11,
            domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, domain, lang, source, epoch, n_tokens, taken): which documents fill each leaf's budget.

    Tokens are words unless `tokens` gives another count. A leaf with budget b over a tokens is read b div a times whole
    and then, in the seeded order of the next epoch, as the prefix of b mod a tokens; `taken` is n_tokens but for the
    document that the budget cuts. Documents without tokens are in every whole epoch and never in a prefix.

    Null lang or source is a name of its own (empty string); null doc_id orders first; repeated rows count as often as
    they occur; an empty table gives an empty result; other columns are ignored.
    """
    count = tokens if tokens is not None else F.size(words_of(F.col("text")))
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                                   (domain if domain is not None else default_domain()).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
                                   F.coalesce("source", F.lit("")).alias("source"), count.cast("bigint").alias("n_tokens")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = materialize(leaf_budgets(leaves, budget, weights or WEIGHTS, epochs))
    whole = F.when(F.col("tokens") > 0, F.expr("granted div tokens")).otherwise(F.lit(1)).cast("int")
    budgets = budgets.withColumn("whole", whole).withColumn("rest", F.col("granted") - F.col("whole") * F.col("tokens"))
    placed = rows.join(budgets.drop("tokens", "granted"), LEVELS)
    placed = placed.withColumn("_order", order_key(seed, F.col("whole"), F.col("doc_id"))).withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63))))
    placed = running_totals(placed, LEVELS, ["_order", "_id", "text_hash"], "n_tokens", "before")
    cut = F.least(F.col("n_tokens"), F.col("rest") - F.col("before"))
    epoch = F.filter(F.sequence(F.lit(0), F.col("whole")), lambda e: (e < F.col("whole")) | ((F.col("before") < F.col("rest")) & (F.col("n_tokens") > 0)))
    out = placed.select("doc_id", "text_hash", *LEVELS, "n_tokens", "whole", cut.alias("_cut"), F.explode(epoch).alias("epoch"))
    return out.select("doc_id", "text_hash", *LEVELS, "epoch", "n_tokens", F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.col("_cut")).alias("taken"))


def mixed_documents(docs: DataFrame, domain: Column | None = None, **settings) -> DataFrame:
    """Rows of `docs` as the mixture takes them, all columns kept: once per epoch, the document that a budget cuts whole.

    Of rows equal in doc_id, text, domain, lang and source exactly as many come out as the mixture takes: each as often as
    all of them are, and the first few of a numbering once more. Null doc_ids, texts, langs and sources are names of their
    own; texts without words come with every whole epoch; columns of any name pass through; very long texts are never
    gathered by group; an empty table stays empty.
    """
    keys = ["_id", "_hash", *[f"_{c}" for c in LEVELS]]
    taken = mixture(docs, domain=domain, **settings).groupBy("doc_id", "text_hash", *LEVELS).agg(F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"),
                       (domain if domain is not None else default_domain()).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"))
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, ["doc_id", "text_hash", *LEVELS])]
    times = copies.join(taken, same).select(*[F.col(k).alias(f"t{k}") for k in keys], F.expr("_rows div _copies").alias("_each"), F.expr("_rows % _copies").alias("_more"))
    times = materialize(times)
    joined = rows.join(times, [F.col(k).eqNullSafe(F.col(f"t{k}")) for k in keys]).select("row", *keys, "_each", "_more")
    repeat = lambda df: df.where("_each > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_each")))).select("row.*")
    if times.where("_more > 0").isEmpty():
        return repeat(joined)
    uneven = materialize(joined.where("_more > 0").withColumn("_number", F.monotonically_increasing_id()))
    narrow = uneven.select(*[F.coalesce(F.col(k), F.lit(-(2**63))).alias(k) if k == "_id" else F.col(k) for k in keys], "_number", F.lit(1).alias("_one"))
    place = running_totals(narrow, keys, ["_number"], "_one", "_before").select("_number", "_before")
    more = uneven.join(place, "_number").withColumn("_each", F.col("_each") + (F.col("_before") < F.col("_more")).cast("bigint"))
    return repeat(joined.where("_more = 0").unionByName(more.select("row", *keys, "_each", "_more")))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[02468]$') THEN 'web' ELSE 'library' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * 2 AS capacity, 1 AS weight FROM docs GROUP BY ALL),
langs AS (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight
          FROM leaves GROUP BY ALL),
domains AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CASE domain WHEN 'web' THEN 3 WHEN 'library' THEN 1 ELSE 1 END AS weight FROM langs GROUP BY ALL),
d0 AS (SELECT *, (SELECT CAST(sum(tokens) AS BIGINT) FROM leaves) AS budget FROM domains),
d1 AS (SELECT *, capacity * sum(weight) OVER (ORDER BY capacity * 1e0 / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (budget - coalesce(sum(capacity) OVER (ORDER BY capacity * 1e0 / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM d0),
d2 AS (SELECT *, budget - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER () AS left_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS open_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (ORDER BY capacity * 1e0 / weight, domain ROWS UNBOUNDED PRECEDING) AS sum_ FROM d1),
d AS (SELECT domain, CASE WHEN full_ THEN capacity ELSE left_ * sum_ // open_ - left_ * (sum_ - weight) // open_ END AS granted FROM d2),
l0 AS (SELECT langs.*, d.granted AS budget FROM langs JOIN d USING (domain)),
l1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain ORDER BY capacity * 1e0 / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity * 1e0 / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM l0),
l2 AS (SELECT *, budget - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER (PARTITION BY domain) AS left_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain) AS open_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain ORDER BY capacity * 1e0 / weight, lang ROWS UNBOUNDED PRECEDING) AS sum_ FROM l1),
l AS (SELECT domain, lang, CASE WHEN full_ THEN capacity ELSE left_ * sum_ // open_ - left_ * (sum_ - weight) // open_ END AS granted FROM l2),
s0 AS (SELECT leaves.*, l.granted AS budget FROM leaves JOIN l USING (domain, lang)),
s1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity * 1e0 / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity * 1e0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM s0),
s2 AS (SELECT *, budget - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER (PARTITION BY domain, lang) AS left_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain, lang) AS open_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain, lang ORDER BY capacity * 1e0 / weight, source ROWS UNBOUNDED PRECEDING) AS sum_ FROM s1),
s AS (SELECT domain, lang, source, tokens, CASE WHEN full_ THEN capacity ELSE left_ * sum_ // open_ - left_ * (sum_ - weight) // open_ END AS granted FROM s2),
b AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN granted // tokens ELSE 1 END AS whole_,
          granted - CASE WHEN tokens > 0 THEN granted // tokens ELSE 1 END * tokens AS rest FROM s),
p AS (SELECT docs.*, whole_, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
          ORDER BY md5('11/' || CAST(CAST(whole_ AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM docs JOIN b USING (domain, lang, source)),
e AS (SELECT *, unnest(range(0, CAST(whole_ AS BIGINT) + 1)) AS epoch FROM p)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens,
       CAST(CASE WHEN epoch < whole_ THEN n_tokens ELSE least(n_tokens, rest - before) END AS BIGINT) AS taken
FROM e WHERE epoch < whole_ OR (before < rest AND n_tokens > 0)
"""
