"""Operators on frames, built from DataFrame functions alone.

Dimension tables and rates are broadcast where Spark has measured them as small. bounded() does
the same for results of aggregates, whose size is known only when they are there: without it
the other side of their join would be shuffled first, on a few hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_project(df: DataFrame, predicate: Column, *columns: str | Column) -> DataFrame:
    """Filter, then projection: both reach the scan."""
    return df.filter(predicate).select(*columns)


def argmax_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns; partial on the map side."""
    top = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("top")
    names = [k if isinstance(k, str) else None for k in keys]
    return df.groupBy(*keys).agg(top).select(*[n for n in names if n], *[f"top.{c}" for c in columns])


def distinct_on(df: DataFrame, key: Column, name: str, value: str) -> DataFrame:
    """One row per key, with the least value: unlike dropDuplicates, always the same one."""
    return df.groupBy(key.alias(name)).agg(F.min(value).alias(value))


def bounded(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """A frame to broadcast if it has at most so many rows, which is checked by computing it;
    else the frame itself, for a join by shuffle."""
    rows = df.take(most_rows + 1)
    return df if len(rows) > most_rows else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def endpoint(side: str) -> list[Column]:
    return [F.col(f"{side}_bank").alias("bank"), F.col(f"{side}_account").alias("account")]


def split_endpoints(df: DataFrame, *keys: str) -> DataFrame:
    """Each transfer twice, by its source (is_left) and by its destination, in one pass."""
    sides = [F.struct(*endpoint(s), F.lit(s == "from").alias("is_left")) for s in ("from", "to")]
    return df.select(*keys, F.inline(F.array(*sides)))


def union_endpoints(df: DataFrame) -> DataFrame:
    """All sources and then all destinations."""
    return df.select(*endpoint("from"), F.lit(True).alias("is_left")).unionByName(df.select(*endpoint("to"), F.lit(False).alias("is_left")))


EDGE = ["from_bank", "from_account", "to_bank", "to_account"]


def edges(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct pairs of accounts with a transfer from one to the other; those without either
    account fall out. So joins on either side add no filter of their own, and Spark reads and
    shuffles the edges once for all of them."""
    known = [F.col(c).isNotNull() for c in EDGE]
    return df.select(*keys, *EDGE).filter(known[0] & known[1] & known[2] & known[3]).distinct()


def degree(pairs: DataFrame, side: str, *keys: str) -> DataFrame:
    """Distinct neighbours of each account, as source (from) or as destination (to)."""
    return pairs.groupBy(*keys, *endpoint(side)).agg(F.count("*").alias("degree"))


def reduced(pairs: DataFrame, side: str, k: int, *keys: str) -> DataFrame:
    """Edges whose source (from) or destination (to) has at least k distinct neighbours.

    A pair of accounts with k middles between them has k neighbours on either side, so the
    reduction before the self join leaves the answer as it is. The join is an inner one with
    one row for each account: a semi join would be pushed below the distinct edges, which
    would then be made once more.
    """
    often = degree(pairs, side, *keys).filter(F.col("degree") >= k)
    often = often.select(*keys, F.col("bank").alias(f"{side}_bank"), F.col("account").alias(f"{side}_account"))
    return pairs.join(often, [*keys, f"{side}_bank", f"{side}_account"]).select(*keys, *EDGE)


CHAIN = ["left_bank", "left_account", "middle_bank", "middle_account", "right_bank", "right_account"]


def chains(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Two edges that meet in a middle account."""
    a = first.select(*keys, F.col("from_bank").alias("left_bank"), F.col("from_account").alias("left_account"), F.col("to_bank").alias("middle_bank"), F.col("to_account").alias("middle_account"))
    b = second.select(*keys, F.col("from_bank").alias("middle_bank"), F.col("from_account").alias("middle_account"), F.col("to_bank").alias("right_bank"), F.col("to_account").alias("right_account"))
    return a.join(b, [*keys, "middle_bank", "middle_account"]).select(*keys, *CHAIN)


PAIR = ["left_bank", "left_account", "right_bank", "right_account"]


def saturating_count(df: DataFrame, keys: Sequence[str], k: int, name: str) -> DataFrame:
    """How many rows each key has, k at most; a row for each key and task is shuffled."""
    return df.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias(name))


def saturating_distinct(df: DataFrame, keys: Sequence[str], values: Sequence[str], k: int, name: str) -> DataFrame:
    """How many distinct values, not null, each key has, k at most, stopping at k before the
    shuffle: a task keeps a key's k least values only, among which the k least of all are. So a
    key with a third of the rows sends k rows from each task."""
    known = df.select(*keys, *values).dropna(subset=list(values))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*values))
    least = known.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.max("_rank").cast("long").alias(name))


def top_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of the order: n of each partition, and then n of these. The order must
    be total for the rows to be always the same."""
    return df.orderBy(*order).limit(n)


def pair_middles(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """Pairs of endpoints with at least k chains of distinct middles."""
    return found.groupBy(*keys, *PAIR).agg(F.count("*").alias("middles")).filter(F.col("middles") >= k)


def pair_endpoints(pairs: DataFrame, *keys: str) -> DataFrame:
    """Both accounts of each pair, in one pass."""
    sides = [F.struct(F.col(f"{s}_bank").alias("bank"), F.col(f"{s}_account").alias("account"), F.lit(s == "left").alias("is_left")) for s in ("left", "right")]
    return pairs.select(*keys, F.inline(F.array(*sides)))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows either side has beyond the other: two rows, (side, n)."""
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(left.exceptAll(right), "left").unionByName(count(right.exceptAll(left), "right"))


def first_row_max(df: DataFrame, key: Column, amount: str, row: str) -> DataFrame:
    """The first row, by the row column, that has its key's greatest amount."""
    order = Window.partitionBy("_key").orderBy(F.desc(amount), row)
    return df.withColumn("_key", key).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_key")
