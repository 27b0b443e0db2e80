"""Streaming ingestion, message de-duplication and the queries that wait for a stream's end.

A run with the availableNow trigger ends when its input does, which is when the blocking
queries may start: they are batch plans over what the stream has written.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.plans import aml
from tidewater.sources.fixture import as_transfers


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the one that spark.checkpoint.dir names. Where that is unset and Spark
    runs in one process, a temporary one is set; on a cluster it's an error. The folder goes
    when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes folders and patterns but no single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/[e]vents.parquet")


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Appends a stream to a Parquet table until its input ends, and returns the table. Run
    again with the same path it goes on from where it stopped and repeats nothing."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hands each micro-batch to a function until the input ends."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def last_state(aggregated: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A stream's aggregate as it stands when its input ends: each batch writes the rows that it
    has changed under its own number, and of each key the last one counts."""
    run_batches(aggregated, path, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/state/batch={i}"), "update")
    changes = aggregated.sparkSession.read.schema(aggregated.schema.add("batch", "long")).parquet(f"{path}/state")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return changes.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", "batch")


MESSAGE = ("client_id", "sender_id", "seq")


def deduplicated(messages: DataFrame) -> DataFrame:
    """Each message once, by client, sender and sequence number."""
    return messages.dropDuplicates(list(MESSAGE))


def claim(seqs: np.ndarray, starts: list[int], ends: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """Which of the numbers are new, and the claimed ranges [start, end) with them: ranges that
    touch become one, so that numbers without gaps take up one range."""
    if starts:
        at = np.searchsorted(np.array(starts), seqs, "right") - 1
        old = (at >= 0) & (seqs < np.array(ends)[np.maximum(at, 0)])
    else:
        old = np.zeros(len(seqs), bool)
    _, first = np.unique(seqs, return_index=True)
    new = np.zeros(len(seqs), bool)
    new[first] = True
    new &= ~old
    low = np.concatenate([np.array(starts, np.int64), seqs[new]])
    high = np.concatenate([np.array(ends, np.int64), seqs[new] + 1])
    order = np.argsort(low)
    low, high = low[order], high[order]
    apart = np.flatnonzero(low[1:] > high[:-1])  # claimed ranges never overlap
    heads, tails = np.concatenate([[0], apart + 1]).astype(int), np.concatenate([apart, [len(low) - 1]]).astype(int)
    return (new, low[heads].tolist(), high[tails].tolist()) if len(low) else (new, [], [])


def once(messages: DataFrame, keys: tuple[str, ...] = MESSAGE[:2], seq: str = MESSAGE[2]) -> DataFrame:
    """Each message of a stream once, by its keys and its number, however late it comes again.

    State is the ranges of numbers that each key has claimed: one, once there are no gaps. A
    message without a number falls out.
    """
    names = messages.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = map(list, state.get) if state.exists else ([], [])
        for frame in frames:
            new, starts, ends = claim(frame[seq].to_numpy(np.int64), starts, ends)
            yield frame.loc[new, names]
        state.update((starts, ends))

    known = messages.filter(F.col(seq).isNotNull())
    return known.groupBy(*keys).applyInPandasWithState(run, messages.schema, "starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def without_aborted(rows: DataFrame, aborted: DataFrame) -> DataFrame:
    """Rows of clients that haven't been aborted."""
    return rows.join(aborted, "client_id", "left_anti")


#: Numbers of one group of a stream's ids.
SPAN = 4_096


def sharded(rows: DataFrame, column: str = "transfer_id", span: int = SPAN) -> DataFrame:
    """Rows with the range of numbers that their id lies in, and its place there: as many groups
    as there are ranges, whose state is one pair of numbers once all of a range are there."""
    return rows.withColumn("shard", F.floor(F.col(column) / span)).withColumn("seq", F.pmod(column, F.lit(span)))


def once_within(messages: DataFrame, at: str, late: str, keys: tuple[str, ...] = MESSAGE) -> DataFrame:
    """Each message of a stream once, where it comes again within a bound of time: the keys
    leave the state with the watermark, and nothing leaves the JVM. Messages later than that
    fall out."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of the event stream, each once, as a table."""
    stream = once(sharded(as_transfers(event_stream(spark, sf_dir))), ("shard",)).drop("shard", "seq")
    return run_to_files(stream, scratch(spark))


def messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the event stream, of which every third comes twice, each once."""
    def sent():
        rows = as_transfers(event_stream(spark, sf_dir))
        client, number = F.col("from_account").cast("bigint") % 3, F.floor(F.col("transfer_id") / 5)
        return rows.select(client.alias("client_id"), (F.col("transfer_id") % 5).alias("sender_id"), number.alias("seq"), "amount_paid")

    return run_to_files(once(sent().unionByName(sent().filter("seq % 3 = 0"))), scratch(spark))


def messages_within(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """messages_once() where what comes twice does so within an hour."""
    def sent():
        rows = as_transfers(event_stream(spark, sf_dir))
        client, number = F.col("from_account").cast("bigint") % 3, F.floor(F.col("transfer_id") / 5)
        at = F.col("event_ts").cast("timestamp").alias("at")
        return rows.select(client.alias("client_id"), (F.col("transfer_id") % 5).alias("sender_id"), number.alias("seq"), "amount_paid", at)

    return run_to_files(once_within(sent().unionByName(sent().filter("seq % 3 = 0")), "at", late), scratch(spark)).drop("at")


def format_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count by payment format, as the stream's aggregate at its end."""
    usd = aml.in_currency(as_transfers(event_stream(spark, sf_dir)))
    totals = usd.groupBy("payment_format").agg(F.sum("amount_paid").alias("total"), F.count("*").alias("n"))
    return last_state(totals, scratch(spark), ["payment_format"]).select("payment_format", F.round("total", 2).alias("total"), "n")


def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 over the transfers that a stream has spooled, batch by batch, each under its own
    number, so that a repeated batch replaces itself."""
    path = scratch(spark)
    usd = aml.in_currency(as_transfers(event_stream(spark, sf_dir)))
    run_batches(usd, path, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/spool/batch={i}"))
    return aml.q3(spark.read.parquet(f"{path}/spool").drop("batch"))


def hourly(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """Transfers by hour and currency. Hours that end before the watermark leave the state;
    what comes later than that falls out."""
    rows = as_transfers(event_stream(spark, sf_dir)).withColumn("at", F.col("event_ts").cast("timestamp")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", "1 hour").alias("w"), "payment_currency").agg(F.count("*").alias("n"))
    return last_state(counts, scratch(spark), ["w", "payment_currency"]).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "payment_currency", "n")
