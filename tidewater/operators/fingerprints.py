"""Comparing results as multisets without sorting or shuffling their rows.

Each row has 128 bits of hash; their sums and the number of rows don't depend on order, merge
from any parts, and tell how often a row stands, unlike an exclusive or. Sums are kept for
buckets of rows, so that only buckets that differ are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.relational import multiset_diff

#: Buckets; so many rows at most are joined, and broadcast.
BUCKETS = 256


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    """The rows with their hashes, which tell null from empty, and their bucket. Columns
    count by position."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    seen = [x for c in columns for x in (c.isNull(), c)]
    low, high = F.xxhash64(F.lit(1), *seen), F.xxhash64(F.lit(2), *reversed(seen))
    return df.select("*", low.alias("_low"), high.alias("_high"), F.pmod(low, F.lit(buckets)).cast("int").alias("_bucket"))


def fingerprint(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, low, high) of a frame's rows: one scan, and a row for each bucket and task."""
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return _hashed(df, buckets).groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"), total("_low").alias("low"), total("_high").alias("high"))


def differing(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, left_n, right_n) of the buckets whose rows differ; none for equal multisets."""
    a, b = (fingerprint(df, buckets).select("bucket", F.struct("n", "low", "high").alias(s)) for df, s in ((left, "a"), (right, "b")))
    n = lambda s: F.coalesce(F.col(f"{s}.n"), F.lit(0))
    return a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket", n("a").alias("left_n"), n("b").alias("right_n"))


def diff(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many rows either side has beyond the other: two rows, (side, n). Only rows of
    differing buckets, of which there are few by definition, are shuffled."""
    found = F.broadcast(differing(left, right, buckets).select(F.col("bucket").alias("_bucket")))

    def rest(df: DataFrame) -> DataFrame:
        return _hashed(df, buckets).join(found, "_bucket", "left_semi").drop("_low", "_high", "_bucket")

    return multiset_diff(rest(left), rest(right))
