"""Shrunk covariance from one distributed pass, and what is built on it: Mahalanobis distance and CORAL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray, float]:
    """n, mean, centred second moment and mean fourth power of the centred norm.

    Each task folds its rows into one matrix and emits it as one array per matrix row; Spark sums the arrays by row
    position, so d arrays of d numbers come back, which is also the size of the result.
    """
    means = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").toPandas()["m"].to_numpy()
    d = len(means)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, fourth, n = np.zeros((d, d)), 0.0, 0
        for batch in batches:
            if len(batch):
                z = np.array(batch[vector].tolist(), dtype=float) - means
                gram += z.T @ z
                fourth += float(((z * z).sum(1) ** 2).sum())
                n += len(z)
        if n:
            yield pd.DataFrame({"i": np.arange(d), "v": list(gram), "fourth": fourth, "n": n})

    folded = df.select(vector).mapInPandas(fold, "i int, v array<double>, fourth double, n bigint")
    total = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), d), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    sums = folded.groupBy("i").agg(total.alias("v"), F.sum("fourth").alias("fourth"), F.sum("n").alias("n")).orderBy("i").toPandas()
    n = int(sums["n"].iloc[0])
    return n, means, np.array(sums["v"].tolist()) / n, float(sums["fourth"].iloc[0]) / n


def shrunk_covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, Ledoit-Wolf covariance, shrinkage)."""
    n, mean, s, fourth = moments(df, vector)
    p = len(mean)
    m = np.trace(s) / p
    frob = float((s * s).sum())
    d2 = (frob - p * m * m) / p
    b2 = min(d2, (fourth - frob) / (n * p))
    shrink = 0.0 if b2 == 0 else b2 / d2
    return mean, (1 - shrink) * s + shrink * m * np.eye(p), shrink


def covariance_table(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) of the shrunk covariance."""
    _, cov, _ = shrunk_covariance(df, vector)
    d = len(cov)
    rows = pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "cov": cov.ravel()})
    return df.sparkSession.createDataFrame(rows, "i bigint, j bigint, cov double")


def mahalanobis(df: DataFrame, fit: DataFrame, vector: str, name: str = "mahalanobis") -> DataFrame:
    """Distance to the fitted mean under the shrunk covariance, by Arrow batches."""
    mean, cov, _ = shrunk_covariance(fit, vector)
    inverse = np.linalg.inv(cov)

    @F.pandas_udf("double")
    def distance(batch: pd.Series) -> pd.Series:
        z = np.array(batch.tolist(), dtype=float) - mean
        return pd.Series(np.sqrt(np.einsum("ni,ij,nj->n", z, inverse, z)))

    return df.withColumn(name, distance(vector))


def square_roots(cov: np.ndarray, floor: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric square root of a covariance and its inverse.

    Directions whose variance is below `floor`, taken both relative to the largest variance and absolutely, count as
    having that variance, so a singular matrix whitens without dividing by zero.
    """
    variance, axes = np.linalg.eigh(cov)
    scale = np.sqrt(np.clip(variance, floor * max(1.0, variance[-1]), None))
    return axes @ np.diag(scale) @ axes.T, axes @ np.diag(1.0 / scale) @ axes.T


def coral(source: DataFrame, pool: DataFrame, vector: str, floor: float = 1e-8) -> DataFrame:
    """Correlation alignment: source rows are centred, whitened with their own covariance, coloured with the pool's and put
    around the pool's mean. Both covariances are shrunk."""
    (center, own, _), (goal, wanted, _) = (shrunk_covariance(rows, vector) for rows in (source, pool))
    whiten = square_roots(own, floor)[1]
    colour = square_roots(wanted, floor)[0]
    transport = whiten @ colour
    shift = goal - center @ transport

    @F.pandas_udf("array<double>")
    def moved(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(vectors.to_numpy()) @ transport + shift)) if len(vectors) else vectors

    return source.withColumn(vector, moved(vector))
