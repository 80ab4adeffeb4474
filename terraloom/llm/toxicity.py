"""Toxicity from a learned weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.session import ship_package

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁһӏαβεικνορτυχ0134578@$", "abeekmhopctyxijsdhlabeiknoptuxoieastbas")
#: Phrases in which a lexicon word means no harm; a match inside one does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown nose", "pathetic fallacy", "loser bracket", "pond scum", "idiot proof", "stupid simple")
#: Bound of the labelled rows that are learned from, per label, and of the lexicon.
SAMPLE, LEXICON = 8000, 4000
#: Shortest stem; a stem needs so many different words, a term so many toxic training texts and this log ratio.
STEM, FORMS, SUPPORT, RATIO = 4, 3, 4, 3.0
GAP = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Lower case, look-alikes replaced, one blank around and between words."""
    return f" {GAP.sub(' ', text.lower().translate(LOOKALIKES)).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms (a blank opens a word, a closing blank asks for the whole word) and the line from density to score."""

    weights: dict[str, float]
    slope: float = 1.0
    intercept: float = 0.0


def automaton(lexicon: Lexicon):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in lexicon.weights.items():
        found.add_word(term, (len(term), weight))
    for phrase in EXCEPTIONS:
        found.add_word(folded(phrase), (len(folded(phrase)), None))
    found.make_automaton()
    return found


def density(text: str | None, found) -> float:
    """Weights of the matches outside exception phrases, the heaviest per word, over a slowly growing function of length."""
    if not text:
        return 0.0
    body = folded(text)
    spans, at = [], {}
    for end, (size, weight) in found.iter(body):
        start = end - size + 1
        if weight is None:
            spans.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    if spans:
        at = {s: w for s, w in at.items() if not any(a <= s < b for a, b in spans)}
    return sum(at.values()) / (1.0 + np.log1p(body.count(" ") / 200)) if at else 0.0


def densities(text: Column, lexicon: Lexicon) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton(lexicon)
        for batch in batches:
            yield pa.array([density(t.as_py(), found) for t in batch], pa.float64())

    return run(text.cast("string"))


def scores(text: Column, lexicon: Lexicon) -> Column:
    """0 to 1, higher: likelier toxic. Null and empty text score as text without a match."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-lexicon.intercept) - F.lit(lexicon.slope) * densities(text, lexicon)))


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels outside the held-out third."""
    return labels.where("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 3 <> 1").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of distinct labelled texts outside the held-out third; at most `sample` rows of each label, by hash of doc_id."""
    drawn = [usable(labels).where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * sample rows of two numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    return rows.where("text IS NOT NULL").select("text", "toxic").distinct()


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): texts of each label that hold the word or the word opening, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(folded(text).split())
                sums[toxic].update({f" {w[:k]}" for w in words for k in range(STEM, min(len(w), 9))} | {f" {w} " for w in words if len(w) < 40})
            if len(sums[0]) > 400_000:
                yield from rows_of(sums)
                sums = (Counter(), Counter())
        yield from rows_of(sums)

    def rows_of(sums):
        terms = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64())],
                                         ["term", "toxic", "clean"])

    return rows.mapInArrow(run, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen_terms(weights: dict[str, float]) -> dict[str, float]:
    """Stems that open several of the words, and the words that no stem opens."""
    words = [t.strip() for t in weights if t.endswith(" ")]
    stems: dict[str, float] = {}
    for prefix in sorted((t for t in weights if not t.endswith(" ")), key=len):
        forms = [w for w in words if w.startswith(prefix[1:])]
        if len(forms) >= FORMS and not any(prefix.startswith(s) for s in stems):
            common = " " + os.path.commonprefix(forms)
            stems[common if len(common) >= len(prefix) else prefix] = weights[prefix]
    return stems | {t: w for t, w in weights.items() if t.endswith(" ") and not any(t.startswith(s) for s in stems)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Lexicon:
    """Lexicon with log-ratio weights and a logistic line, from at most 2 * `sample` labelled rows outside the held-out third.

    In the line a sampled row counts for all rows of its label that it was drawn from, so that scores do not depend on
    how far each label is beyond `sample`. Without rows of both labels the lexicon is empty and every text scores 0.
    """
    ship_package(docs.sparkSession)
    labelled = {r.toxic: r["count"] for r in usable(labels).groupBy("toxic").count().collect()}
    rows = training_rows(docs, labels, sample).persist()
    try:
        totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(totals) < 2:
            return Lexicon({}, 0.0, -50.0)
        ratio = F.log((F.col("toxic") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
        found = term_counts(rows).where(F.col("toxic") >= SUPPORT).withColumn("weight", ratio).where(F.col("weight") >= RATIO)
        top = found.orderBy(F.desc("weight"), F.desc("toxic"), "term").limit(size).select("term", "weight").collect()
        lexicon = Lexicon(chosen_terms({r.term: r.weight for r in top}))
        points = rows.select(densities(F.col("text"), lexicon).alias("x"), "toxic").groupBy("x", "toxic").count().collect()
    finally:
        rows.unpersist()
    x, y, n = (np.array([p[k] for p in points], float) for k in range(3))
    n *= np.array([labelled[p.toxic] / min(labelled[p.toxic], sample) for p in points])
    a = b = 0.0
    for _ in range(60):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p) * x).sum() - 1e-1 * a, (n * (y - p)).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    return Lexicon(lexicon.weights, float(a), float(b))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    Null and empty texts score as texts without a match; a null doc_id is scored and not held out; repeated rows return
    each; other columns are ignored; an empty table gives an empty result.
    """
    lexicon = fit(docs, labels, **settings)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), scores(F.col("text"), lexicon).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """Rows of `docs` that score below the threshold, all columns kept."""
    lexicon = fit(docs, labels, **settings)
    rows = docs.select(F.struct("*").alias("row"), scores(F.col("text"), lexicon).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
