"""Language identification: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.text import parts, raw
from terraloom.session import ship_package

#: Family of a language code; a code that is not listed belongs to "other".
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"), "slavic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "ne", "pa", "gu", "fa", "ku"), "indo-iranian"),
    **dict.fromkeys(("zh", "yue", "bo", "my"), "sino-tibetan"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "ky"), "turkic"),
    **dict.fromkeys(("ar", "he", "am", "mt"), "afro-asiatic"),
}
#: Buckets of hashed byte n-grams (lengths 1 to 3), and the bounds of labelled documents learned from, per language and in all.
BUCKETS, SAMPLE, TOTAL = 1 << 13, 1500, 12_000
#: ASCII upper to lower case; digits, signs and white space to a blank, so that only letters and their bytes count.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of folded bytes, n from 1 to 3, and the number of n-grams before each document.

    A blank opens every document; runs of blanks stay, but n-grams that start with two blanks are left out.
    """
    sizes = np.diff(at)
    opened = np.full(len(body) + len(sizes) * 3, 32, np.uint8)
    starts = at[:-1] + 3 * np.arange(len(sizes)) + 1
    opened[np.arange(len(body)) + np.repeat(3 * np.arange(len(sizes)) + 1, sizes)] = LETTERS[body]
    x = opened.astype(np.uint32)
    one, two = np.full_like(x, 32), np.full_like(x, 32)
    one[:-1], two[:-2] = x[1:], x[2:]
    codes = np.stack([x, x << 8 | one | 1 << 24, x << 16 | one << 8 | two | 2 << 24], axis=1)
    use = (x != 32) | (one != 32)
    hashed = (codes * np.uint32(2654435761) >> np.uint32(19)).astype(np.int32)[use]
    before = np.concatenate(([0], np.cumsum(use)))
    ends = starts + sizes + 1
    return hashed.reshape(-1), 3 * before[np.append(starts - 1, len(x) if not len(ends) else ends[-1] + 1).clip(0, len(x))]


@dataclass
class Rows:
    """Sparse rows: bucket and value of the entries of row i from ends[i] to ends[i + 1]."""

    ends: np.ndarray
    buckets: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def norms(self) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.values.astype(np.float64) ** 2)))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def frequencies(columns: list[pa.Array]) -> Rows:
    """N-gram shares of each document; a document takes a few bytes for each n-gram that it has."""
    ends, buckets, values = [0], [], []
    for column in columns:
        for s, e in parts(column, 2_000_000):
            hashed, at = grams(*raw(column.slice(s, e - s)))
            for i in range(e - s):
                found, counts = np.unique(hashed[at[i]:at[i + 1]], return_counts=True)
                buckets.append(found.astype(np.uint16))
                values.append((counts / max(1, counts.sum())).astype(np.float32))
                ends.append(ends[-1] + len(found))
    whole = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return Rows(np.array(ends), whole(buckets, np.uint16), whole(values, np.float32))


def train(rows: Rows, use: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 30) -> np.ndarray:
    """Linear SVM by dual coordinate descent (hinge loss) on the rows `use`, classes weighted to equal totals; y is 1 or -1."""
    limit = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w, norm = np.zeros(len(y)), np.zeros(BUCKETS), rows.norms()[use] + 1e-12
    draw = np.random.default_rng(5)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(y)):
            s, e = rows.ends[use[i]], rows.ends[use[i] + 1]
            at, x = rows.buckets[s:e], rows.values[s:e]
            gradient = y[i] * (x @ w[at]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]) / limit[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Columns of `weights` score, in order, each family against the rest, then each pair of languages of each family; n-gram
    shares count by `scale` and as a direction (divided by their norm)."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    scale: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """Learn from at most `sample` documents of each language, `total` in all, with crc32(doc_id) mod 4 other than 2.

    The number of languages is that of the codes in use, and so bounded. One scan counts their texts; one keeps those
    whose hash lies under a bound of about twice the sample of their language, of which the first by hash are gathered.
    Rows equal in doc_id, lang and text count once, so a doc_id that repeats brings no more than its texts.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND coalesce(crc32(CAST(doc_id AS STRING)) % 4 <> 2, false)").select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("_order"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct("_order").alias("n")).collect()}
    if not counts:
        return Model([], {}, [], np.zeros((BUCKETS, 0)), np.ones(BUCKETS))
    sample = max(1, min(sample, total // len(counts)))
    shares = {lang: min(1.0, (2 * sample + 20) / max(n, 1)) for lang, n in counts.items()}
    bound = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in sorted(shares.items()) for v in kv]), F.col("lang")), F.lit(0.0))
    drawn = usable.where(F.pmod("_order", F.lit(1 << 40)) < bound * (1 << 40)).dropDuplicates(["lang", "doc_id", "_order"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))
    rows = drawn.withColumn("_nth", nth).where(F.col("_nth") <= sample).select("lang", "text", "_order").orderBy("lang", "_order").drop("_order").toArrow()
    langs = np.array(rows["lang"].to_pylist(), dtype=object)
    x = frequencies(rows["text"].chunks)
    mean = np.bincount(x.buckets, weights=x.values, minlength=BUCKETS) / max(1, len(x))
    scale = 1 / np.sqrt(mean + 1e-6)
    x.values = (x.values * scale[x.buckets]).astype(np.float32)
    x.values /= np.repeat(np.maximum(np.sqrt(x.norms()), 1e-9), np.diff(x.ends)).astype(np.float32)
    family = np.array([FAMILIES.get(v, "other") for v in langs], dtype=object)
    families = sorted(set(family))
    members = {f: sorted(set(langs[family == f])) for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    every = np.arange(len(x))
    columns = [train(x, every, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(BUCKETS)] * len(families)
    for a, b in pairs:
        use = np.flatnonzero((langs == a) | (langs == b))
        columns.append(train(x, use, np.where(langs[use] == a, 1, -1)))
    return Model(families, members, pairs, np.stack(columns, axis=1) * scale[:, None], scale)


def decide(model: Model, sums: np.ndarray, norms: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score per row of summed decision values; the score multiplies the two levels' squashed margins."""
    values = sums / np.maximum(norms, 1e-9)[:, None]
    squash = lambda m: 1 / (1 + np.exp(-3 * m))
    names, scores = [], []
    first = values[:, :len(model.families)]
    place = {p: len(model.families) + i for i, p in enumerate(model.pairs)}
    for row, tops in zip(values, np.argmax(first, axis=1) if first.shape[1] else []):
        family = model.families[tops]
        langs = model.members[family]
        rest = np.delete(row[:len(model.families)], tops)
        sure = squash((row[tops] - rest.max()) / 2) if len(rest) else 1.0
        votes = {v: [0, 0.0] for v in langs}
        for a, b in combinations(langs, 2):
            m = float(row[place[a, b]])
            votes[a if m > 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(langs, key=lambda v: (votes[v][0], votes[v][1], v))
        margins = [row[place[p]] * (1 if p[0] == best else -1) for p in combinations(langs, 2) if best in p]
        names.append(best)
        scores.append(float(sure * (squash(min(margins)) if margins else 1.0)))
    return names, scores


def predictions(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score) of a text column, in blocks of bounded memory."""

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], []
            for s, e in parts(batch, 2_000_000):
                column = batch.slice(s, e - s)
                hashed, at = grams(*raw(column))
                n = len(column)
                sums = np.zeros((n, model.weights.shape[1]))
                norms = np.zeros(n)
                for i in range(n):
                    found = np.bincount(hashed[at[i]:at[i + 1]], minlength=BUCKETS)
                    sums[i] = found @ model.weights
                    norms[i] = np.sqrt(((found * model.scale) ** 2).sum())
                a, b = decide(model, sums, norms)
                names += a
                scores += b
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`.

    Null text and text without a letter: `und` with score 0. A null doc_id is predicted, not held out and not learned
    from; without any labelled row everything is `und`. Repeated rows return each, and count once in learning; very long
    texts are read in blocks of whole texts; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    model = fit(docs, sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text.rlike(r"\p{L}").alias("_letters"),
                       (predictions(text, model) if model.families else F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))).alias("_p"))
    known = F.col("_letters")
    return rows.select("doc_id", "held_out", F.when(known, F.col("_p.lang_pred")).otherwise("und").alias("lang_pred"),
                       F.when(known, F.col("_p.score")).otherwise(0.0).alias("score"))
