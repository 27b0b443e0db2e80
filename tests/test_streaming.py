import shutil

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.plans import registry
from tidewater.sources import csvfiles
from tidewater.sources.fixture import as_transfers
from tidewater.streaming import runner

SF = "/root/testdata/sf0.001"


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    events.filter("event_id < 400").write.parquet(source)
    stream = lambda: runner.once(runner.sharded(as_transfers(spark.readStream.schema(events.schema).parquet(source))), ("shard",))
    assert runner.run_to_files(stream(), out).count() == 400
    events.filter("event_id >= 300").write.mode("append").parquet(source)  # a part of it comes twice
    got = runner.run_to_files(stream(), out)
    assert got.count() == got.select("transfer_id").distinct().count() == events.count()
    assert runner.run_to_files(stream(), out).count() == events.count()


def test_replayed_messages_change_nothing(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("client_id"), (F.col("id") % 5).alias("sender_id"), F.col("id").alias("seq"))
    assert runner.deduplicated(rows.unionByName(rows)).count() == 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=6))
def test_claimed_numbers(batches):
    seen, starts, ends = set(), [], []
    for batch in batches:
        new, starts, ends = runner.claim(np.array(batch, np.int64), starts, ends)
        want = [x not in seen and x not in batch[:i] for i, x in enumerate(batch)]
        assert new.tolist() == want
        seen |= set(batch)
        assert {x for a, b in zip(starts, ends) for x in range(a, b)} == seen
        assert all(b < a for b, a in zip(ends, starts[1:]))


def test_hours_are_counted_over_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/in")
    rows = as_transfers(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    rows = rows.withColumn("at", F.col("event_ts").cast("timestamp")).withWatermark("at", "40 days")
    counts = rows.groupBy(F.window("at", "1 hour").alias("w"), "payment_currency").agg(F.count("*").alias("n"))
    got = runner.last_state(counts, f"{tmp_path}/out", ["w", "payment_currency"])
    assert got.agg(F.sum("n")).first()[0] == events.count() and len(list((tmp_path / "out/state").glob("batch=*"))) > 3
    assert got.select("w", "payment_currency").distinct().count() == got.count()


def test_file_lines_stream(spark, tmp_path):
    line = "2022/09/01 00:20,010,A,10,B,1.0,US Dollar,1.0,US Dollar,Wire,0"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.csv").write_text(f"Timestamp,x\n{line}\nbad\n")
    got = runner.run_to_files(csvfiles.transfers(spark.readStream.text(f"{tmp_path}/in")), f"{tmp_path}/out")
    assert got.count() == 1
    shutil.rmtree(tmp_path / "out")


def test_stream_equals_batch(spark):
    a = sorted(map(tuple, registry.QUERIES["stream_q3_foreachbatch"](spark, SF).collect()))
    assert a == sorted(map(tuple, registry.QUERIES["q3_below_avg_fraction"](spark, SF).collect()))


def test_as_many_groups_as_ranges(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.filter("event_id % 7 = 0")).repartition(3).write.parquet(f"{tmp_path}/in")
    rows = as_transfers(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = runner.run_to_files(runner.once(runner.sharded(rows, span=50), ("shard",)), f"{tmp_path}/out")
    assert got.count() == got.select("transfer_id").distinct().count() == events.count()
    held = spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint")
    assert held.count() == -(-events.count() // 50)


def test_repeats_within_a_bound_of_time(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    events.coalesce(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 200).parquet(f"{tmp_path}/in")
    events.filter("event_id % 3 = 0").coalesce(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 70).mode("append").parquet(f"{tmp_path}/in")
    rows = as_transfers(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).withColumn("at", F.col("event_ts").cast("timestamp"))
    got = runner.run_to_files(runner.once_within(rows, "at", "60 days", ("transfer_id",)), f"{tmp_path}/out")
    assert got.count() == got.select("transfer_id").distinct().count() == events.count()
