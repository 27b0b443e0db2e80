"""Streams with state of their own for each tenant: results at a tenant's end, aborts in the
midst of a run, accounts at the batch in which they reach a threshold, and two live inputs.

State lies in RocksDB, keyed so that a large tenant is many groups; what is done with leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.exprs import normalize_bank, within
from tidewater.operators import relational as R
from tidewater.plans import aml
from tidewater.sources import fixture
from tidewater.streaming import runner

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    with rocksdb(stream.sparkSession):
        return runner.run_to_files(stream, path)


# A tenant's result at the tenant's end

#: Messages of one sender that one group of the first step claims; a multiple of 8.
SPAN = 4_096

TOTALS = "n long, n_low long, largest double"


def _merged(held: tuple | None, n: int, low: int, largest: float | None) -> tuple:
    n0, low0, top = held or (0, 0, None)
    tops = [x for x in (top, largest) if x is not None]
    return n0 + n, low0 + low, max(tops, default=None)


class Claims(StatefulProcessor):
    """A range of one sender's messages: each number once, their totals, and, as soon as the
    sender's end has told how many there are and all are here, one row. What is left then is
    a flag, so that what comes again doesn't begin the range anew."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits binary")
        self.totals = handle.getValueState("totals", TOTALS)
        self.end = handle.getValueState("end", "expected long, ranges long")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        bits = np.unpackbits(np.frombuffer(self.bits.get()[0], np.uint8)) if self.bits.exists() else np.zeros(self.span, np.uint8)
        totals = self.totals.get() if self.totals.exists() else None
        end = self.end.get() if self.end.exists() else None
        for frame in rows:
            ends = frame[frame.expected.notna()]
            if len(ends):
                end = int(ends.expected.iloc[0]), int(ends.ranges.iloc[0])
            sent = frame[frame.place.notna()].drop_duplicates("place")
            new = sent[bits[sent.place.to_numpy(np.int64)] == 0]
            bits[new.place.to_numpy(np.int64)] = 1
            top = new.amount.max()
            totals = _merged(totals, len(new), int(new.low.sum()), None if pd.isna(top) else float(top))
        if end and bits[: end[0]].all():
            yield pd.DataFrame([(key[0], key[1], end[1], *totals)], columns=["client_id", "sender_id", "ranges", "n", "n_low", "largest"])
            for state in (self.bits, self.totals, self.end):
                state.clear()
            self.done.update((True,))
            return
        self.bits.update((np.packbits(bits).tobytes(),))
        self.totals.update(totals)
        if end:
            self.end.update(end)


class Completion(StatefulProcessor):
    """A tenant: one row once all ranges of all its senders are there; then no state is left."""

    def __init__(self, senders: int):
        self.senders = senders

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missing = handle.getMapState("missing", "sender_id long", "ranges long")
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        totals = self.totals.get() if self.totals.exists() else None
        for frame in rows:
            for sender, group in frame.groupby("sender_id"):
                at = (int(sender),)
                left = self.missing.getValue(at)[0] if self.missing.containsKey(at) else int(group.ranges.iloc[0])
                self.missing.updateValue(at, (left - len(group),))
            top = frame.largest.max()
            totals = _merged(totals, int(frame.n.sum()), int(frame.n_low.sum()), None if pd.isna(top) else float(top))
        left = [v[0] for v in self.missing.values()]
        if len(left) >= self.senders and not any(left):
            yield pd.DataFrame([(key[0], *totals)], columns=["client_id", "n", "n_low", "largest"])
            self.missing.clear()
            self.totals.clear()
        else:
            self.totals.update(totals)


def completed(messages: DataFrame, senders: int, span: int = SPAN) -> DataFrame:
    """(client_id, n, n_low, largest) of each tenant, in the batch in which its last message or
    its last sender's end arrives.

    messages: client_id, sender_id, seq, total, amount, low. Each sender numbers a tenant's
    messages from 0 on and ends with a row of their total, without seq; ends and messages come
    in any order, and again. A tenant is complete with the ends of so many senders and all the
    messages that they tell of; what comes again changes nothing. The first step's
    groups are ranges of a sender's messages, the second sees one row for each range.
    """
    ends = F.col("total").isNotNull()
    ranges = F.greatest(F.ceil(F.col("total") / span), F.lit(1))
    at = F.when(ends, F.sequence(F.lit(0).cast("long"), ranges - 1)).otherwise(F.array(F.floor(F.col("seq") / span)))
    rows = messages.filter(ends | F.col("seq").isNotNull()).withColumn("range", F.explode(at))
    expected = F.when(ends, F.least(F.lit(span), F.col("total") - F.col("range") * span))
    low = F.coalesce("low", F.lit(False)).alias("low")
    rows = rows.select("client_id", "sender_id", "range", expected.alias("expected"), F.when(ends, ranges).alias("ranges"), F.when(~ends, F.col("seq") % span).alias("place"), "amount", low)
    claimed = rows.groupBy("client_id", "sender_id", "range").transformWithStateInPandas(Claims(span), f"client_id long, sender_id long, ranges long, {TOTALS}", "append", "None")
    return claimed.groupBy("client_id").transformWithStateInPandas(Completion(senders), f"client_id long, {TOTALS}", "append", "None")


CLIENTS, SENDERS = 3, 5


def as_messages(transfers: DataFrame) -> DataFrame:
    """Transfers as messages of three tenants by five senders, without gaps in their numbers."""
    usd = F.col("payment_currency") == aml.DEFAULT.currency
    sender = F.floor(F.col("transfer_id") / CLIENTS) % SENDERS
    return transfers.select(
        (F.col("transfer_id") % CLIENTS).alias("client_id"), sender.alias("sender_id"), F.floor(F.col("transfer_id") / (CLIENTS * SENDERS)).alias("seq"),
        F.lit(None).cast("long").alias("total"), F.when(usd, F.col("amount_paid")).alias("amount"), (usd & (F.col("amount_paid") < aml.DEFAULT.low_amount)).alias("low"),
    )


def ends_of(messages: DataFrame) -> DataFrame:
    """The end of each sender of each tenant."""
    total = messages.groupBy("client_id", "sender_id").agg(F.count("*").alias("total"))
    return total.select("client_id", "sender_id", F.lit(None).cast("long").alias("seq"), "total", F.lit(None).cast("double").alias("amount"), F.lit(None).cast("boolean").alias("low"))


def client_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants' results at their ends: every third message comes twice, and of the last tenant
    one sender's end is missing."""
    path = runner.scratch(spark)
    ends = ends_of(as_messages(fixture.transfers(spark, sf_dir)))
    ends.filter(~((F.col("client_id") == CLIENTS - 1) & (F.col("sender_id") == SENDERS - 1))).write.parquet(f"{path}/ends")

    def sent() -> DataFrame:
        return as_messages(fixture.as_transfers(runner.event_stream(spark, sf_dir)))

    stream = sent().unionByName(sent().filter("seq % 3 = 0")).unionByName(spark.readStream.schema(ends.schema).parquet(f"{path}/ends"))
    return run_to_files(completed(stream, SENDERS), path)


# Aborts

#: Groups of one tenant.
SHARDS = 8

SHARD = "client_id long, shard int, aborted boolean, n long, n_low long, largest double"


class Abortable(StatefulProcessor):
    """A shard of a tenant's totals; an abort ends them, and all that is left is that flag."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.aborted = handle.getValueState("aborted", "aborted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if self.aborted.exists():
            return
        totals = self.totals.get() if self.totals.exists() else None
        for frame in rows:
            if frame.abort.any():
                self.totals.clear()
                self.aborted.update((True,))
                yield pd.DataFrame([(key[0], key[1], True, 0, 0, None)], columns=SHARD.replace(",", "").split()[::2])
                return
            top = frame.amount.max()
            totals = _merged(totals, len(frame), int(frame.low.sum()), None if pd.isna(top) else float(top))
        self.totals.update(totals)
        yield pd.DataFrame([(key[0], key[1], False, *totals)], columns=SHARD.replace(",", "").split()[::2])


def abortable(rows: DataFrame, aborts: DataFrame) -> DataFrame:
    """Running totals of each tenant's shards (client_id, shard, aborted, n, n_low, largest), in
    update mode. rows: client_id, row_id, amount, low. An abort (client_id) reaches all shards:
    each gives a last row, aborted, which takes the place of what it gave before, and what comes
    after it counts for nothing."""
    own = rows.select("client_id", F.pmod(F.xxhash64("row_id"), F.lit(SHARDS)).cast("int").alias("shard"), "amount", F.coalesce("low", F.lit(False)).alias("low"), F.lit(False).alias("abort"))
    nothing = F.lit(None).cast("double").alias("amount"), F.lit(False).alias("low"), F.lit(True).alias("abort")
    ended = aborts.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), *nothing)
    return own.unionByName(ended).groupBy("client_id", "shard").transformWithStateInPandas(Abortable(), SHARD, "update", "None")


def without_aborted(shards: DataFrame) -> DataFrame:
    """Tenants' totals from the last row of each shard, without those that were aborted."""
    totals = [F.sum("n").alias("n"), F.sum("n_low").alias("n_low"), F.max("largest").alias("largest"), F.bool_or("aborted").alias("aborted")]
    return shards.groupBy("client_id").agg(*totals).filter("not aborted").drop("aborted")


ABORTABLE_CLIENTS = 16


def client_of(transfers: DataFrame) -> DataFrame:
    usd = F.col("payment_currency") == aml.DEFAULT.currency
    client = F.col("from_account").cast("bigint") % ABORTABLE_CLIENTS
    return transfers.select(client.alias("client_id"), F.col("transfer_id").alias("row_id"), F.when(usd, F.col("amount_paid")).alias("amount"), (usd & (F.col("amount_paid") < aml.DEFAULT.low_amount)).alias("low"))


def abort_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of 16 tenants; some transfers of a few accounts abort their tenant."""
    path = runner.scratch(spark)

    def transfers() -> DataFrame:
        return fixture.as_transfers(runner.event_stream(spark, sf_dir))

    account = F.col("from_account").cast("bigint") % (3 * ABORTABLE_CLIENTS)
    aborts = client_of(transfers().filter(account.isin(5, 22) & (F.col("transfer_id") % 20 == 7))).select("client_id")
    with rocksdb(spark):
        last = runner.last_state(abortable(client_of(transfers()), aborts), path, ["client_id", "shard"])
    return without_aborted(last)


# Firing once at a threshold


class Threshold(StatefulProcessor):
    """Counts up to k and gives its key in the batch in which it gets there."""

    def __init__(self, k: int, names: list[str]):
        self.k, self.names = k, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = self.n.get()[0] if self.n.exists() else 0
        if before >= self.k:
            return
        now = before + sum(map(len, rows))
        self.n.update((min(now, self.k),))
        if now >= self.k:
            yield pd.DataFrame([key], columns=self.names)


def reaching(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each key once, in the batch in which it has k different rows for the first time. The
    rows seen are one state, spread over all their columns, and the counts up to k another, so a
    frequent key isn't one group of all its rows."""
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys)
    return pairs.dropDuplicates(pairs.columns).groupBy(*keys).transformWithStateInPandas(Threshold(k, keys), schema, "append", "None")


def scatterers(spark: SparkSession, sf_dir: str, k: int = aml.DEFAULT.middles) -> DataFrame:
    """Accounts with enough distinct destinations, each in the batch in which it gets there."""
    usd = aml.in_currency(fixture.as_transfers(runner.event_stream(spark, sf_dir)))
    edges = usd.filter(within(F.col("event_ts"), aml.DEFAULT.graph_window)).select(R.EDGE).dropna()
    return run_to_files(reaching(edges, R.EDGE[:2], k), runner.scratch(spark))


# Two live inputs


def named(transfers: DataFrame, names: DataFrame, within_: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Transfers (bank_key, at) with the names (bank_key, announced) that their bank gets at that
    time or up to within_ after it. Both are streams; a row leaves the state once the watermark,
    late behind the greater of the times seen of the slower stream, says that no partner comes."""
    left, right = transfers.withWatermark("at", late).alias("t"), names.withWatermark("announced", late).alias("n")
    near = (F.col("n.announced") >= F.col("t.at")) & (F.col("n.announced") < F.col("t.at") + F.expr(f"INTERVAL {within_}"))
    return left.join(right, (F.col("t.bank_key") == F.col("n.bank_key")) & near).select("t.*", "n.bank_name")


def bank_times(usd: DataFrame) -> DataFrame:
    return usd.select("transfer_id", normalize_bank(F.col("from_bank")).alias("bank_key"), "amount_paid", F.col("event_ts").cast("timestamp").alias("at"))


def announcements(usd: DataFrame, banks: DataFrame) -> DataFrame:
    """The name of each bank at the end of each day on which it has a transfer."""
    midnight: Column = F.date_add(F.to_date("event_ts"), 1).cast("timestamp")
    days = usd.select(normalize_bank(F.col("from_bank")).alias("bank_key"), midnight.alias("announced")).distinct()
    return days.join(R.distinct_on(banks, normalize_bank(F.col("bank_id")), "bank_key", "bank_name"), "bank_key")


def banks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with the names of their source banks, from two streams."""
    path = runner.scratch(spark)
    names = announcements(aml.in_currency(fixture.transfers(spark, sf_dir)), fixture.banks(spark, sf_dir))
    names.write.parquet(f"{path}/names")
    usd = aml.in_currency(fixture.as_transfers(runner.event_stream(spark, sf_dir)))
    joined = named(bank_times(usd), spark.readStream.schema(names.schema).parquet(f"{path}/names"))
    return run_to_files(joined, path).select("transfer_id", "bank_key", "bank_name", "amount_paid")
