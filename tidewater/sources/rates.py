"""Exchange rates from JSON: objects of date, base, quote and rate, one or an array of them, in
a file, in each line or in each row of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "date string, base string, quote string, rate double"
ENTRIES = f"array<struct<{PAYLOAD}>>"


def parsed(payloads: DataFrame, *keep: str) -> DataFrame:
    """(entries, and the columns to keep) of a column of payloads, each an object or an array of
    them; entries is null where a payload is neither."""
    return payloads.select(*keep, "payload", F.from_json("payload", ENTRIES).alias("entries"))


def entries(payloads: DataFrame) -> DataFrame:
    """The entries of payloads(payload, base). An entry without a base has the one beside its
    payload, as answers to a request for one base have. Corrupt payloads give none, and fields
    of another type are null."""
    rows = parsed(payloads, F.col("base").alias("asked")).filter("entries is not null").select("asked", F.inline("entries"))
    return rows.select("date", F.coalesce("base", "asked").alias("base"), "quote", "rate")


def corrupt(payloads: DataFrame, *keep: str) -> DataFrame:
    """Payloads, with the columns to keep, that are no objects or arrays of them, null among them."""
    return parsed(payloads, *keep).filter("entries is null").select(*keep, "payload")


def rates(payloads: DataFrame, base: str = "USD") -> DataFrame:
    """(fx_date, iso, rate) of payloads with this base. Those without a date or a positive
    rate fall out; of a currency's several rates of a day the greatest stays."""
    good = (F.col("base") == base) & (F.col("rate") > 0) & F.col("quote").isNotNull()
    rows = payloads.filter(good).select(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("fx_date"), F.col("quote").alias("iso"), "rate")
    return rows.filter("fx_date is not null").groupBy("fx_date", "iso").agg(F.max("rate").alias("rate"))


def read_rates(spark: SparkSession, path: str, lines: bool = False, base: str = "USD") -> DataFrame:
    """The rates of JSON files. lines: an object in each line, so that files can be split."""
    return rates(spark.read.schema(PAYLOAD).option("multiLine", not lines).json(path), base)


def write_rates(table: DataFrame, path: str, base: str = "USD") -> None:
    """Rates (fx_date, iso, rate) as JSON lines."""
    rows = table.select(F.date_format("fx_date", "yyyy-MM-dd").alias("date"), F.lit(base).alias("base"), F.col("iso").alias("quote"), "rate")
    rows.write.mode("overwrite").json(path)
