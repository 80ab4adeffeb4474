"""Column functions: indices, uncertainty, calibration and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_to_null(value: Column, rule: str = "above") -> Column:
    """Null for NaN and for the -9999 sentinel: exact match ("equal") or anything not above -9990 ("above")."""
    gone = (value == -9999.0) if rule == "equal" else (value <= -9990.0)
    return F.when(F.isnan(value) | gone, F.lit(None)).otherwise(value)


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def db_to_linear(value: Column) -> Column:
    return F.pow(F.lit(10.0), value / 10.0)


def radar_vegetation_index(vv_db: Column, vh_db: Column) -> Column:
    vv, vh = db_to_linear(vv_db), db_to_linear(vh_db)
    return 4.0 * vh / (vv + vh)


def entropy(p: Column, base: str = "e") -> Column:
    """Binary entropy with 0 log 0 = 0; base "2" clips the logarithm's argument at 1e-6."""
    q = 1.0 - p
    if base == "2":
        floor = lambda c: F.log2(F.greatest(c, F.lit(1e-6)))
        return -(p * floor(p) + q * floor(q))
    term = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    return -term(p) - term(q)


def least_confidence(p: Column) -> Column:
    return 1.0 - F.greatest(p, 1.0 - p)


def margin_distrust(p: Column) -> Column:
    return 1.0 - F.abs(2.0 * p - 1.0)


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(c / (1.0 - c))


def density_odds(p: Column, prior: Column) -> Column:
    """Target/source density ratio from a domain probability and n_source / n_target."""
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return c / (1.0 - c) * prior


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v))


def complete(vector: Column) -> Column:
    return F.forall(vector, lambda v: v.isNotNull())


def observed_count(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda v: v.isNotNull()))


def enough_observed(vector: Column) -> Column:
    """At least max(6, floor(length / 4)) observed values."""
    return observed_count(vector) >= F.greatest(F.lit(6), F.floor(F.size(vector) * 0.25))
