"""Benchmark decontamination: prefix-filtered set join of benchmark windows with documents, verified word by word."""

from __future__ import annotations

import string
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.tables import let
from terraloom.operators.attach import attach
from terraloom.session import materialize

#: Consecutive words of an item that must occur; a shorter item is one window.
WINDOW = 10
#: Words per shingle, the tokens of the set join; a window shorter than that is one shingle.
SHINGLE = 3
#: Windows that share their rarest shingle and travel in one list.
LISTED = 32
#: What separates words, after A-Z are folded.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case; null has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, BETWEEN, -1), "")


def shingles(w: Column, size: int) -> Column:
    """Hash of the `size` words from each position of `w` on."""
    hashed = lambda i: F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) < size, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - size), hashed))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window, n): every window of every item once, its words joined by blanks; items without words have none."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(size))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice(F.col("w"), i + 1, n), " "))
    return items.where("size(w) > 0").select("item_id", n.alias("n"), F.explode(each).alias("window")).distinct()


def rarest(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """(shingle, list): each window at its rarest shingle, with the places of the shingle in the windows listed.

    All shingles of a window must occur for the window to occur, so one of them is prefix enough, and the rarest meets
    the fewest documents. A window with a shingle that no document has cannot occur and is left out.
    """
    counts = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("found"))
    first = F.min_by(F.struct("shingle", "at"), F.struct("found", "at")).alias("first")
    best = terms.join(counts, "shingle").groupBy("window", "n", "owner", "terms").agg(F.count(F.lit(1)).alias("seen"), first).where("seen = terms")
    chosen = best.select("first.shingle", F.struct(F.col("first.at").alias("at"), "n", "window", "owner").alias("entry"))
    lists = chosen.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    chunk = F.pmod(F.xxhash64("entry.window"), F.col("lists")).alias("chunk")
    return chosen.join(lists, "shingle").groupBy("shingle", chunk).agg(F.collect_list("entry").alias("list")).select("shingle", "list")


def bitmap(known: DataFrame) -> tuple[DataFrame, int]:
    """One row with a bit array in which two bits of every known shingle are set, and its number of bits: 64 a shingle, at most 2 MB."""
    bits = 1 << max(10, min(24, (64 * known.count() - 1).bit_length()))
    at = known.select(F.explode(F.array(*probes(F.col("shingle"), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    dense = known.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).cast("bigint").alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("all")).select(F.col("all.bits").alias("bits")), bits


def probes(shingle: Column, bits: int) -> list[Column]:
    return [shingle.bitwiseAND(F.lit(bits - 1).cast("bigint")), F.shiftrightunsigned(shingle, 32).bitwiseAND(F.lit(bits - 1).cast("bigint"))]


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of every row of `docs`: where benchmark windows occur and of which items.

    `spans` are (first word, word after the last) of every occurrence, `items` the item_ids as sorted strings. Shingles of
    the windows are looked up in all documents once (a bit array of bounded size leaves out nearly all others) and taken
    along with the words around them. What is found tells how rare each shingle is; the rarest one of a window proposes
    places, the position and the length of the text bound them, and the words at each place are compared.

    Null or wordless text: no words, no spans. Null doc_id: judged like any other. Repeated rows: each returns, with the
    same answer. An item without words or without id cannot occur; items that share a window are all named. A very long
    text is one row and costs time in proportion to its words. Empty tables: no documents, or nothing found in any.
    Other columns are ignored.
    """
    pairs = materialize(item_windows(benchmark, size))
    # windows with the same items share an owner: sums that two item sets have in common only by a chance of 2^-64
    owner = F.struct(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("item_id").cast("decimal(20,0)")).alias("a"),
                     F.sum(F.xxhash64(F.lit(7), "item_id").cast("decimal(20,0)")).alias("b"))
    windows = pairs.groupBy("window", "n").agg(owner.alias("owner"))
    windows = materialize(windows.select("window", "n", F.xxhash64("owner.c", "owner.a", "owner.b").alias("owner")))
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())  # at most `shingle` values

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), words(F.col("text")).alias("w"))
    counted = keyed.select("doc_id", "text_hash", "_id", F.size("w").cast("bigint").alias("n_words"))
    no_spans, no_items = F.array().cast("array<struct<first:int,after:int>>"), F.array().cast("array<string>")
    if not lengths:
        return counted.select("doc_id", "text_hash", "n_words", no_spans.alias("spans"), no_items.alias("items"))
    own = lambda w: F.coalesce(*[F.when(F.least(F.size(w), F.lit(shingle)) == k, shingles(w, k)) for k in lengths])
    terms = materialize(windows.select("window", "n", "owner", own(F.split("window", " ")).alias("all"))
                        .select("window", "n", "owner", F.size("all").alias("terms"), F.posexplode("all").alias("at", "shingle")))
    known = materialize(terms.select("shingle").distinct())
    mask, bits = bitmap(known)

    def places(k: int) -> Column:
        """(place, shingle, from, near) of the shingles of k words that may be known, with the words a window around could have."""
        may_know = lambda h: reduce(and_, [F.getbit(F.get(F.col("mask"), F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in probes(h, bits)])
        near = lambda i: F.slice("w", F.greatest(i - (size - k), F.lit(0)) + 1, F.lit(2 * size - k))
        hashed = shingles(F.col("w"), k)
        found = lambda hs: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: may_know(F.get(hs, i))),
            lambda i: F.struct(i.alias("place"), F.get(hs, i).alias("shingle"), F.greatest(i - (size - k), F.lit(0)).alias("from"), F.array_join(near(i), " ").alias("near")))
        none = F.array().cast("array<struct<place:int,shingle:bigint,from:int,near:string>>")
        return F.when(F.size("w") < k, none).otherwise(let(hashed, found))

    spread = attach(keyed, mask.withColumnRenamed("bits", "mask"), []).select("_id", "text_hash", F.explode(F.concat(*[places(k) for k in lengths])).alias("e"))
    hits = materialize(spread.select("_id", "text_hash", "e.*").join(known, "shingle"))
    met = hits.join(materialize(rarest(terms, hits)), "shingle")
    start = lambda x: F.col("place") - x["at"]
    bounded = F.filter("list", lambda x: (start(x) >= 0) & (start(x) - F.col("from") + x["n"] <= F.size(F.split("near", " "))))
    same = F.filter(bounded, lambda x: F.array_join(F.slice(F.split("near", " "), start(x) - F.col("from") + 1, x["n"]), " ") == x["window"])
    spans = F.transform(same, lambda x: F.struct(start(x).alias("first"), (start(x) + x["n"]).alias("after"), x["owner"].alias("owner")))
    met = met.select("_id", "text_hash", spans.alias("spans")).where("size(spans) > 0")
    scored = met.groupBy("_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("z")).select(
        "_id", "text_hash", F.array_distinct(F.transform("z", lambda x: F.struct(x["first"].alias("first"), x["after"].alias("after")))).alias("spans"),
        F.array_distinct("z.owner").alias("owners"))
    scored = materialize(scored)

    shown = windows.groupBy("owner").agg(F.min_by("window", F.xxhash64("window")).alias("window"))  # any window stands for its owner's items
    named = shown.join(pairs.select("window", "item_id"), "window").select("owner", "item_id")
    items = scored.select("_id", "text_hash", F.explode("owners").alias("owner")).join(named, "owner")
    items = items.groupBy("_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = materialize(scored.select("_id", "text_hash", "spans").join(items, ["_id", "text_hash"]))
    return counted.join(found, ["_id", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["after"]).alias("end"),
                                 (a["total"] + F.greatest(F.lit(0), x["after"] - F.greatest(a["end"], x["first"]))).alias("total"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["total"].cast("bigint"))


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs`; cases as in `matches`."""
    n_hit = covered(F.col("spans"))
    return matches(docs, benchmark, **settings).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = (rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM s, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(i)),
z AS (SELECT DISTINCT n FROM v),
p AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, z, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(i)),
h AS (SELECT rid, item_id, i, p.n FROM p JOIN v ON p.n = v.n AND p.win = v.win),
k AS (SELECT rid, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS u(j) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
