"""Transfers, banks, accounts and rates derived from the general tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.schema import FX

#: Euros for one US dollar, by day of the fixture; invented.
EUR_RATES = {"2024-01-01": 0.92, "2024-01-02": 0.95, "2024-01-03": 0.9, "2024-01-04": 0.98, "2024-01-05": 1.04}


def _bank(number) -> F.Column:
    text = (number % 27).cast("string")
    return F.when(number % 2 == 0, F.lpad(text, 3, "0")).otherwise(text)


def as_transfers(events: DataFrame) -> DataFrame:
    """Works on batch and on streaming events alike."""
    # in a projection of its own, which Spark keeps apart, so that the JSON is read once a row
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    currency = F.when(F.col("event_type") == "signup", "Euro").when(F.col("event_type") == "error", "Bitcoin").otherwise("US Dollar")
    formats = F.array(*map(F.lit, ["ACH", "Wire", "Cheque", "Cash", "Credit Card"]))
    return events.select(
        F.col("event_id").alias("transfer_id"), F.col("ts").alias("event_ts"), _bank(F.col("user_id")).alias("from_bank"),
        F.col("user_id").cast("string").alias("from_account"), _bank(k).alias("to_bank"), k.cast("string").alias("to_account"),
        F.col("value").alias("amount_paid"), currency.alias("payment_currency"), F.get(formats, F.col("event_id") % 5).alias("payment_format"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transfers(spark.read.parquet(f"{sf_dir}/events.parquet"))


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("bank_id"), F.col("n_name").alias("bank_name"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("bank_name"), F.col("n_nationkey").cast("string").alias("bank_id"), key.alias("account_number"),
        F.concat(F.lit("E"), key).alias("entity_id"), F.col("c_name").alias("entity_name"),
    )


def fx_rates(spark: SparkSession) -> DataFrame:
    rows = [(datetime.date.fromisoformat(d), iso, r) for d, eur in EUR_RATES.items() for iso, r in (("EUR", eur), ("USD", 1.0))]
    return spark.createDataFrame(rows, FX)


def rate_payloads(transfers: DataFrame) -> DataFrame:
    """Payloads of rates as services send them, (day, payload, base), for each day that has
    transfers: by turns an object for each currency, an array of them, and an array whose base
    stands outside; and with each day one that is cut off and one that is no JSON. The rate of
    a day follows from its number of transfers."""
    days = transfers.groupBy(F.to_date("event_ts").alias("day")).agg(((F.count("*") % 40 + 80) / 100).alias("eur"))
    date, usd = F.date_format("day", "yyyy-MM-dd").alias("date"), F.lit("USD").alias("base")

    def entry(quote: str, rate: F.Column, *base: F.Column) -> F.Column:
        return F.struct(date, *base, F.lit(quote).alias("quote"), rate.alias("rate"))

    euro, dollar = entry("EUR", F.col("eur"), usd), entry("USD", F.lit(1.0), usd)
    outside = F.array(entry("EUR", F.col("eur")), entry("USD", F.lit(1.0)))
    cut = F.concat(F.lit('{"date":"'), F.date_format("day", "yyyy-MM-dd"), F.lit('","base":"USD","quo'))
    none = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" is no payload"))
    form = F.day("day") % 3
    sent = F.when(form == 0, F.array(F.to_json(euro), F.to_json(dollar))).when(form == 1, F.array(F.to_json(F.array(euro, dollar)))).otherwise(F.array(F.to_json(outside)))
    return days.select("day", F.explode(F.concat(sent, F.array(cut, none))).alias("payload"), F.when(form == 2, "USD").alias("base"))


def transfer_lines(transfers: DataFrame) -> DataFrame:
    """Transfers as lines of a file (value); after one in seven comes one whose time is none."""
    good = F.date_format("event_ts", "yyyy/MM/dd HH:mm")
    times = F.when(F.col("transfer_id") % 7 == 0, F.array(good, F.lit("2024/13/99 00:00"))).otherwise(F.array(good))
    amount, flag = F.col("amount_paid").cast("string"), (F.col("transfer_id") % 2).cast("string")
    rest = ["from_bank", "from_account", "to_bank", "to_account", amount, "payment_currency", amount, "payment_currency", "payment_format", flag]
    return transfers.withColumn("time", F.explode(times)).select(F.concat_ws(",", "time", *rest).alias("value"))


def lenient_lines(transfers: DataFrame) -> DataFrame:
    """Transfers as lines (value), among them bad times, bad amounts (one in five), more fields
    than there should be (one in eleven), and, after one in thirteen, a line that is too short."""
    number = F.col("transfer_id")
    time = F.when(number % 7 == 0, "2024/13/99 00:00").otherwise(F.date_format("event_ts", "yyyy/MM/dd HH:mm"))
    amount = F.when(number % 10 == 3, "12.5x").when(number % 10 == 8, "").otherwise(F.col("amount_paid").cast("string"))
    rest = ["from_bank", "from_account", "to_bank", "to_account", amount, "payment_currency", amount, "payment_currency", "payment_format", F.when(number % 11 == 0, "0,more,fields").otherwise("0")]
    whole = F.concat_ws(",", time, *rest)
    return transfers.select(F.explode(F.when(number % 13 == 0, F.array(whole, F.lit("2024/01/01 00:00,short,line"))).otherwise(F.array(whole))).alias("value"))


def account_lines(accounts: DataFrame) -> DataFrame:
    """Accounts as lines of a file (value), whose last column has a comma of its own."""
    return accounts.select(F.concat_ws(",", "bank_name", "bank_id", "account_number", "entity_id", F.concat("entity_name", F.lit(", and others"))).alias("value"))
