"""Hash based randomness and content digests.

Every "random" order is derived from md5 of a seed and a row key, so a draw is a pure function of the
data: it does not depend on partitioning, and a task that is run again produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def md5_int(*parts) -> Column:
    """First 32 bits of md5(part:part:...) as a non-negative bigint."""
    digest = F.md5(F.concat_ws(":", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def md5_wide(*parts) -> Column:
    """First 52 bits of the same hash: still exact as a double, and practically free of collisions."""
    digest = F.md5(F.concat_ws(":", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform double in [0, 1) from the same hash."""
    return md5_int(*parts) / F.lit(4294967296.0)


def row_digest(*columns) -> Column:
    """sha-256 of the row's values, each written as its length, a colon and its text (a null as a dash), so that no two rows
    with different values are written alike."""
    values = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def table_digest(df: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """Order-free content digest per key.

    Row digests are folded with sums of their 48-bit words, which merge map-side; nothing is ever gathered
    in one place the way a sorted concatenation would need.
    """
    words = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = [F.sum(w).cast("string").alias(f"_w{i}") for i, w in enumerate(words)]
    folded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    names = ["n_rows", *[f"_w{i}" for i in range(5)]]
    return folded.select(*keys, "n_rows", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in names]), 256).alias("digest"))
