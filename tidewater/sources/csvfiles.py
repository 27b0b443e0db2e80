"""Account and transfer files: a header line, no quoting, extra commas go to the last field.

Lines are read as text and split, as Spark's CSV reader would drop lines with extra commas and
depends on which columns are read. The functions take batch and streaming frames of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.exprs import parse_amount, parse_laundering, parse_ts
from tidewater.schema import ACCOUNTS, TRANSFERS


def _fields(lines: DataFrame, header: str, n: int) -> DataFrame:
    """The n fields of each line; short lines and header lines fall out."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), ",", n)
    return lines.filter(~F.col("value").startswith(header)).select(parts.alias("f")).filter(F.size("f") >= n)


def accounts(lines: DataFrame, header: str = "Bank Name,") -> DataFrame:
    names = ACCOUNTS.fieldNames()
    return _fields(lines, header, len(names)).select([F.get("f", i).alias(n) for i, n in enumerate(names)])


def transfers(lines: DataFrame, header: str = "Timestamp,") -> DataFrame:
    """Transfers; lines whose time or amounts don't parse fall out."""
    read = {"event_ts": parse_ts, "amount_received": parse_amount, "amount_paid": parse_amount, "is_laundering": parse_laundering}
    names = TRANSFERS.fieldNames()
    rows = _fields(lines, header, len(names)).select([read.get(n, lambda c: c)(F.get("f", i)).alias(n) for i, n in enumerate(names)])
    return rows.filter("event_ts is not null and amount_received is not null and amount_paid is not null")


def golden(lines: DataFrame, header: str = "Timestamp,") -> DataFrame:
    """Transfers as the lenient reading has them: the first ten fields of each line, whatever
    follows; times stay as they are, and amounts that don't parse are 0.0, so that no line of
    ten fields is lost."""
    names = [n if n != "event_ts" else "raw_ts" for n in TRANSFERS.fieldNames()[:10]]
    parts = F.split(F.regexp_replace("value", "\r$", ""), ",")
    rows = lines.filter(~F.col("value").startswith(header)).select(parts.alias("f")).filter(F.size("f") >= 10)
    amount = lambda c: F.coalesce(parse_amount(c), F.lit(0.0))
    return rows.select([(amount(F.get("f", i)) if n.startswith("amount") else F.get("f", i)).alias(n) for i, n in enumerate(names)])


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return accounts(spark.read.text(path))


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    return transfers(spark.read.text(path))
