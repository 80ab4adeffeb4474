"""Quality rules: a learned decision list over counted text statistics, as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, log2, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.tables import let
from terraloom.session import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What a condition may compare with a threshold.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: A list of duplicated windows up to this long is searched per window; a longer one is met by sorting. Same result.
SEARCHED = 16


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by 64-bit hash. Sorted hashes show which occur twice; the places of those are then found, and
    each place adds the words that the place before does not cover.
    """

    def covered(places: Column) -> Column:
        step = lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, k - 1)))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x).cast("bigint")

    def by_search(windows: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))

    def by_sort(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda z: F.filter(z, lambda x, k: ((k > 0) & (F.get(z, k - 1)["h"] == x["h"])) | F.coalesce(F.get(z, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(let(pairs, same), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return let(again, lambda twice: F.when(F.size(twice) == 0, F.lit(0).cast("bigint")).otherwise(
            let(F.when(F.size(twice) <= SEARCHED, by_search(windows, twice)).otherwise(by_sort(windows)), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(windows, count))


def counted(docs: DataFrame) -> DataFrame:
    """`docs` with a struct column `_counts` of the five base counts; null text has none of anything."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
        return let(F.array_remove(F.split(t, "[ \\t-\\r]+", -1), ""), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words")))

    return docs.withColumn("_counts", let(text, counts))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


def conjunction(rule: list[Condition]) -> str:
    return "(" + " AND ".join(c.sql() for c in rule) + ")"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _edges(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Cut points for each feature: quantiles of all rows, and the values at and just below quantiles of the bad ones, ends included."""
    marks = ", ".join(f"{(k + 1) / (cuts + 1)}D" for k in range(cuts))
    ends = ", ".join(f"{k / (cuts + 1)}D" for k in range(cuts + 2))
    found = rows.agg(*[F.expr(f"percentile_approx({e}, array({m}), 10000){w}").alias(f"{f}{i}") for f, e in FEATURES.items()
                       for i, (m, w) in enumerate(((marks, ""), (ends, " FILTER (WHERE bad = 1)")))]).first()
    bad = {f: found[f"{f}1"] or [] for f in FEATURES}
    return {f: sorted({*(found[f"{f}0"] or []), *bad[f], *(nextafter(v, -inf) for v in bad[f])}) for f in FEATURES}


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) rows by feature and bin; what reaches the driver has one row for each."""
    bins = ", ".join(f"'{f}', size(filter(array({', '.join(f'{t!r}D' for t in edges[f])}), t -> {FEATURES[f]} > t))" for f in FEATURES)
    table = rows.selectExpr("bad", f"stack({len(FEATURES)}, {bins}) AS (feature, bin)").groupBy("feature", "bin").agg(
        F.count_if(F.expr("bad = 1")), F.count_if(F.expr("bad = 0"))).collect()
    out = {f: [(0, 0)] * (len(edges[f]) + 1) for f in FEATURES}
    for feature, k, p, n in table:
        out[feature][k] = (p, n)
    return out


def _best(table: dict[str, list[tuple[int, int]]], edges: dict[str, list[float]], barred: set[tuple[str, bool]]) -> Condition | None:
    """Condition of most information gain; of equal gains on a feature the first cut."""
    p0, n0 = (sum(x[i] for x in table["n_words"]) for i in (0, 1))
    if not p0 or not n0:
        return None
    best, gain = None, 0.0
    for f in FEATURES:
        p, n = p0, n0
        for (bad, good), t in zip(table[f], edges[f]):
            p, n = p - bad, n - good
            for above, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                if (f, above) not in barred and (g := _gain(a, b, p0, n0)) > gain:
                    best, gain = Condition(f, above, t), g
    return best


def learn(labelled: DataFrame, precision: float = 0.95, support: int = 10, longest: int = 3, cuts: int = 31) -> list[list[Condition]]:
    """Sequential covering from `labelled` (the base counts, `bad` 0 or 1, `doc_id`): conjunctions that mark bad rows.

    Two thirds of the rows, by hash of doc_id, grow a rule condition by condition for information gain; the other third
    prunes its tail. Cut points are taken anew in each step, over the rows still inside the rule and over its bad ones, so a
    defect of few rows has cuts of its own. A rule is taken if it holds for at least `support` bad pruning rows at
    `precision`; then the rows it covers leave and the next is grown. A rule that fails bars its first feature and
    direction until another one is taken, and the covering ends when all are barred. Each step is one aggregation of the
    labelled rows, so what reaches the driver has features x (3 x cuts) rows at most whatever the input. Without labels,
    without bad rows or without a rule that is good enough the list is empty.
    """
    values = materialize(labelled.select(F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *COUNTS))
    rules: list[list[Condition]] = []
    barred: set[tuple[str, bool]] = set()
    while True:
        rest = values.where(" AND ".join(["true"] + [f"NOT {conjunction(r)}" for r in rules]))
        rule: list[Condition] = []
        while len(rule) < longest:
            inside = rest.where("grow").where(conjunction(rule)) if rule else rest.where("grow")
            edges = _edges(inside, cuts)
            if not all(edges.values()):
                break
            found = _best(_histogram(inside, edges), edges, set() if rule else barred)
            if found is None:
                break
            rule.append(found)
        if not rule:
            return rules
        sides = rest.where("grow").agg(*[F.expr(f"{agg}({FEATURES[c.feature]}) FILTER (WHERE {conjunction(rule[:k]) if k else 'true'} AND {FEATURES[c.feature]} {sign} {c.threshold!r}D)")
                                         for k, c in enumerate(rule) for agg, sign in (("max", "<="), ("min", ">"))]).first()
        ends = [(sides[2 * k], sides[2 * k + 1]) for k in range(len(rule))]
        rule = [Condition(c.feature, c.above, c.threshold if None in e else sum(e) / 2) for c, e in zip(rule, ends)]  # widest margin
        tails = [rule[:k + 1] for k in range(len(rule))]
        sums = rest.where("NOT grow").agg(*[F.count_if(F.expr(f"bad = {v} AND {conjunction(r)}")) for r in tails for v in (1, 0)]).first()
        scores = [((sums[2 * k] - sums[2 * k + 1]) / max(1, sums[2 * k] + sums[2 * k + 1]), k) for k in range(len(tails))]
        k = max(scores, key=lambda x: (x[0], -x[1]))[1]
        if sums[2 * k] < support or sums[2 * k] < precision * (sums[2 * k] + sums[2 * k + 1]):
            barred.add((rule[0].feature, rule[0].above))
        else:
            rules.append(tails[k])
            barred = set()


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered condition: the base rule, then each learned rule, reject; what reaches the end is kept."""
    out = F.when(F.expr(BASE), F.lit(False))
    for rule in rules:
        out = out.when(F.expr(conjunction(rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_counts(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `counts` that pass the base rule and carry a quality label; a row of each label if a doc_id has several."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return counts.where(f"NOT ({BASE})").join(marked.distinct(), "doc_id")


def quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of `docs`.

    Null and empty texts count nothing and so fail the base rule. A null doc_id or one without label is judged but not
    learned from; repeated rows return each; other columns are ignored; an empty table gives an empty result.
    """
    rows = counted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "_counts.*")
    rows = materialize(rows)
    rules = learn(labelled_counts(rows, labels), **settings)
    return rows.select("*", F.expr(BASE).alias("base_failed"), verdict(rules).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows of `docs` that the list keeps, all columns kept; each text is counted once.

    Null and empty texts fail the base rule and go; rows with a null doc_id are judged like any other; of repeated rows
    each is judged; columns of any name pass through; very long texts are counted whole; an empty table stays empty.
    """
    rows = materialize(counted(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("row", "doc_id", "_counts.*"))
    rules = learn(labelled_counts(rows.drop("row"), labels), **settings)
    return rows.where(verdict(rules)).select("row.*")
