"""Streams that keep state for each tenant, over many batches and from where they stopped."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.plans import aml, registry
from tidewater.sources import fixture
from tidewater.streaming import tenants as T

SF = "/root/testdata/sf0.01"
MESSAGE = "client_id long, sender_id long, seq long, total long, amount double, low boolean"


def states(spark, path, operator, name):
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(f"{path}/checkpoint")


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def files(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tenants_complete_at_their_own_ends(spark, tmp_path):
    rng = random.Random(1)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def messages(client, sender, n):
        return [(client, sender, i, None, float(i) if i % 2 else None, i % 3 == 0 if i % 5 else None) for i in range(n)]

    def end(client, sender, n):
        return (client, sender, None, n, None, None)

    first = [*messages(0, 0, 100), *messages(0, 1, 16), end(0, 0, 100), end(0, 1, 16), end(0, 2, 0), *messages(1, 0, 60), end(1, 1, 5), end(1, 2, 17)]
    first += first[::3]
    rng.shuffle(first)
    for i in range(3):
        put(spark, first[i::3], MESSAGE, source)
    stream = lambda: T.completed(files(spark, MESSAGE, source), senders=3, span=16)
    want = (0, 116, sum(i % 3 == 0 and i % 5 != 0 for i in range(100)) + sum(i % 3 == 0 and i % 5 != 0 for i in range(16)), 99.0)
    assert list(map(tuple, T.run_to_files(stream(), out).collect())) == [want]
    # nothing of the complete tenant is left in either step but a flag for each range
    assert states(spark, out, 1, "done").filter("key.client_id = 0").count() == 9
    for operator, name in ((1, "bits"), (1, "totals"), (1, "end"), (0, "missing"), (0, "totals")):
        held = states(spark, out, operator, name)
        assert held.filter("key.client_id = 0").count() == 0 and (operator == 0 or name == "end" or held.filter("key.client_id = 1").count())
    # the stream stops between the ends of the second tenant and goes on from its checkpoint
    put(spark, [end(1, 0, 60), *messages(1, 1, 5), *messages(1, 0, 60), *first[:40], end(0, 2, 0), end(0, 0, 100)], MESSAGE, source)
    assert T.run_to_files(stream(), out).count() == 1
    put(spark, [end(1, 1, 5), *messages(1, 2, 17), *messages(2, 0, 9), end(2, 0, 9), end(2, 1, 0)], MESSAGE, source)
    got = sorted(map(tuple, T.run_to_files(stream(), out).collect()))
    assert [r[:2] for r in got] == [(0, 116), (1, 82)]


def test_aborts_take_back_what_came_before(spark, tmp_path):
    schema = "client_id long, row_id long, amount double, low boolean"
    rows, aborts, out = f"{tmp_path}/rows", f"{tmp_path}/aborts", f"{tmp_path}/out"
    put(spark, [(c, i, float(i), i % 2 == 0) for c in range(3) for i in range(60)], schema, rows)
    put(spark, [(9,)], "client_id long", aborts)
    from tidewater.streaming import runner

    def run():
        with T.rocksdb(spark):
            return runner.last_state(T.abortable(files(spark, schema, rows), files(spark, "client_id long", aborts)), out, ["client_id", "shard"])

    assert sorted(map(tuple, T.without_aborted(run()).collect())) == [(c, 60, 30, 59.0) for c in range(3)]
    put(spark, [(1,)], "client_id long", aborts)
    put(spark, [(c, 100 + i, None, None) for c in (1, 2) for i in range(40)], schema, rows)
    got = run()
    assert sorted(map(tuple, T.without_aborted(got).collect())) == [(0, 60, 30, 59.0), (2, 100, 30, 59.0)]
    put(spark, [(1, 500, 7.0, True)], schema, rows)
    assert T.without_aborted(run()).filter("client_id in (1, 9)").count() == 0
    held = states(spark, out, 0, "totals")
    assert held.filter("key.client_id = 1").count() == 0 < held.filter("key.client_id = 2").count()
    assert states(spark, out, 0, "aborted").filter("key.client_id = 1").count() == T.SHARDS
    assert spark.conf.get(T.PROVIDER, None) != T.ROCKSDB


def split(spark, tmp_path, n, order="event_id"):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy(order).coalesce(1).sortWithinPartitions(order).write.option("maxRecordsPerFile", -(-events.count() // n)).parquet(f"{tmp_path}/events")
    return fixture.as_transfers(files(spark, events.schema, f"{tmp_path}/events"))


def test_accounts_fire_once(spark, tmp_path):
    usd = aml.in_currency(split(spark, tmp_path, 5))
    edges = usd.select("from_bank", "from_account", "to_bank", "to_account")
    got = sorted(map(tuple, T.run_to_files(T.reaching(edges, ["from_bank", "from_account"], 5), f"{tmp_path}/out").collect()))
    batch = aml.in_currency(fixture.transfers(spark, SF)).select(edges.columns).distinct()
    want = batch.groupBy("from_bank", "from_account").count().filter("count >= 5").drop("count")
    assert got == sorted(map(tuple, want.collect())) and len(got) == len(set(got)) > 20
    assert states(spark, f"{tmp_path}/out", 0, "n").agg(F.max("value.n")).first()[0] == 5


def test_two_live_inputs(spark, tmp_path):
    usd = aml.in_currency(split(spark, tmp_path, 8, "ts"))
    batch = aml.in_currency(fixture.transfers(spark, SF))
    names = T.announcements(batch, fixture.banks(spark, SF))
    names.coalesce(1).sortWithinPartitions("announced").write.option("maxRecordsPerFile", -(-names.count() // 8)).parquet(f"{tmp_path}/names")
    joined = T.named(T.bank_times(usd), files(spark, names.schema, f"{tmp_path}/names"))
    with T.rocksdb(spark):
        query = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out/data").option("checkpointLocation", f"{tmp_path}/out/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/data").select("transfer_id", "bank_name")
    want = [(r["transfer_id"], r["bank_name"]) for r in registry.QUERIES["stream_join_banks"](spark, SF).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) < batch.count() / 2 and held[-1] < batch.count() / 4


@pytest.mark.parametrize("name", ["stream_client_completion", "stream_abort", "stream_q4_scatterers", "stream_join_banks"])
def test_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > {"stream_client_completion": 1, "stream_abort": 13}.get(name, 50)
