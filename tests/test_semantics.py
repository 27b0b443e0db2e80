"""Small cases at the edges of each query's definition."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import exprs as E
from tidewater.operators import overlap
from tidewater.operators import relational as R
from tidewater.plans import aml
from tidewater.schema import FX

SCHEMA = "transfer_id long, event_ts timestamp_ntz, from_bank string, from_account string, to_bank string, to_account string, amount_paid double, payment_currency string, payment_format string"
FIELDS = dict(transfer_id=0, event_ts="2024-01-02 10:00", from_bank="1", from_account="a", to_bank="2", to_account="b", amount_paid=10.0, payment_currency="US Dollar", payment_format="Wire")


def frame(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        r = {**FIELDS, "transfer_id": i, **r}
        r["event_ts"] = datetime.datetime.fromisoformat(r["event_ts"])
        out.append(tuple(r[c] for c in FIELDS))
    return spark.createDataFrame(out, SCHEMA)


def usd(spark, *rows):
    return aml.in_currency(frame(spark, *rows))


def test_q1_is_strict_and_in_one_currency(spark):
    got = aml.q1(usd(spark, dict(amount_paid=50.0), dict(amount_paid=49.99), dict(amount_paid=1.0, payment_currency="Euro")))
    assert [r["amount_paid"] for r in got.collect()] == [49.99]


@pytest.mark.parametrize(("bank", "key"), [("011", "11"), ("11", "11"), ("000", "0"), ("", "0"), ("100", "100")])
def test_normalized_banks(spark, bank, key):
    assert spark.range(1).select(E.normalize_bank(F.lit(bank)).alias("k")).first()["k"] == key


def q2(spark, rows, banks):
    return [tuple(r) for r in aml.q2(usd(spark, *rows), spark.createDataFrame(banks, "bank_id string, bank_name string")).collect()]


def test_q2_ties_spelling_and_unknown_banks(spark):
    assert q2(spark, [dict(from_account="10"), dict(from_account="9")], [("1", "One")]) == [("1", "9", "One", 10.0)]
    assert q2(spark, [dict(from_bank="011"), dict(from_bank="11", amount_paid=9.0)], [("11", "E"), ("0011", "D")]) == [("011", "a", "D", 10.0)]
    assert q2(spark, [dict(from_bank="7")], [("1", "One")]) == []


def test_q3_periods_and_fraction(spark):
    days = ["2024-01-05 23:59", "2024-01-06 00:00", "2024-01-15 23:59", "2024-01-16 00:00"]
    rows = [dict(event_ts=d, amount_paid=100.0 if i == 0 else 0.5, from_account=d) for i, d in enumerate(days)]
    rows += [dict(event_ts=days[1], amount_paid=1.0, from_account="exact"), dict(event_ts=days[1], amount_paid=0.1, payment_format="Cash", from_account="new")]
    assert sorted(r["from_account"] for r in aml.q3(usd(spark, *rows)).collect()) == days[1:3]


def star(k, end="C", at="2024-01-02 10:00", **more):
    out = []
    for i in range(k):
        out += [dict(from_account="A", to_account=f"B{i}", event_ts=at, from_bank="1", to_bank="1"), dict(from_account=f"B{i}", to_account=end, event_ts=at, from_bank="1", to_bank="1")]
    return [{**r, **more} for r in out]


@pytest.mark.parametrize("reduce", [True, False])
def test_q4(spark, reduce):
    run = lambda rows, **k: sorted(r["account"] for r in aml.q4(usd(spark, *rows), reduce=reduce, **k).collect())
    assert run(star(5)) == ["A", "C"]
    assert run(star(4)) == []
    assert run(star(5, end="A")) == ["A"]
    assert run(star(1) * 9) == []
    late = star(5, at="2024-01-10 00:00")
    assert run(late) == [] and run(late, inclusive_end=True) == ["A", "C"]
    assert run([{**r, "to_bank": "01"} if r["to_account"].startswith("B") else r for r in star(5)]) == []  # spelling is identity here


def executed(df):
    """The nodes of a query that has run, with the plans of its stages; reused ones once."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        out.append((name, node))
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def rows_of(node):
    found = node.metrics().get("numOutputRows")
    return found.get().value() if found.isDefined() else 0


def graph_of(spark, pairs):
    return spark.createDataFrame([("1", a, "1", b) for a, b in pairs], "from_bank string, from_account string, to_bank string, to_account string")


def test_hubs_make_no_chains(spark):
    n = 10_000
    hub = [(f"s{i}", "H") for i in range(n)] + [("H", f"d{i}") for i in range(n)]
    stars = [(f"s{i}", f"m{i}-{j}") for i in range(3) for j in range(4)] + [(f"m{i}-{j}", f"d{i + e}") for i in range(3) for j in range(4) for e in range(2)]
    edges = graph_of(spark, hub + stars)
    want = sorted((f"s{i}", f"d{i + e}", 5) for i in range(3) for e in range(2))  # four of their own and the hub
    got = overlap.overlapping(edges, 5)
    nodes = executed(got)
    assert sorted((r["left_account"], r["right_account"], r["middles"]) for r in got.collect()) == want
    joined = max(rows_of(node) for name, node in nodes if "Join" in name)
    assert 0 < joined <= 3 * n  # the plain join makes n * n chains
    few = graph_of(spark, [e for e in hub + stars if e[0][0] != "s" or int(e[0][1:]) < 9])
    plain = R.pair_middles(R.chains(few, few), 5).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, overlap.overlapping(few, 5, hub_chains=0).select(*R.PAIR, "middles").collect()))


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_equal_the_plain_join(spark, seed):
    rng = random.Random(seed)
    names = [f"a{i}" for i in range(14)]
    edges = graph_of(spark, {(rng.choice(names), rng.choice(names)) for _ in range(90)}).withColumn("client_id", F.lit(1))
    for k, hub_chains in ((1, 0), (2, 0), (3, 4), (5, 10)):
        want = sorted(map(tuple, R.pair_middles(R.chains(edges, edges), k).collect()))
        got = overlap.overlapping(edges, k, "client_id", hub_chains=hub_chains).drop("client_id").collect()
        assert sorted(map(tuple, got)) == want and (want or k > 3)
        least = overlap.overlapping(edges, k, hub_chains=hub_chains, counted=False).collect()
        assert sorted(tuple(r)[:4] for r in least) == [w[:4] for w in want] and all(r["middles"] >= k for r in least)


def test_distinct_counts_stop_before_the_shuffle(spark):
    rows = [("hot", i % 700) for i in range(7000)] + [("few", i % 3) for i in range(50)] + [("none", None), (None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    got = R.saturating_distinct(df, ["k"], ["v"], 5, "n")
    nodes = executed(got)
    assert sorted(map(tuple, got.collect()), key=str) == [("few", 3), ("hot", 5), (None, 1)]
    limits = [rows_of(node) for name, node in nodes if name == "WindowGroupLimit"]
    assert len(limits) == 2 and max(limits) < 1000  # of 7,000 rows, five values a task


RATES = [(datetime.date(2024, 1, 2), "EUR", 2.0), (datetime.date(2024, 1, 2), "USD", 1.0)]


def q5(spark, *rows):
    return aml.q5(frame(spark, *rows), spark.createDataFrame(RATES, FX)).collect()[0]["size"]


def test_q5(spark):
    low = dict(amount_paid=0.5)
    assert q5(spark, low, {**low, "payment_format": "ACH"}, {**low, "payment_format": "Cash"}) == 2
    assert q5(spark, {**low, "payment_currency": "Bitcoin"}, {**low, "payment_currency": "Shell"}, {**low, "event_ts": "2024-01-03 00:00"}) == 0
    assert q5(spark, dict(amount_paid=1.9, payment_currency="Euro"), dict(amount_paid=2.0, payment_currency="Euro")) == 1
    assert q5(spark) == 0


def test_bounded_sides(spark):
    from tidewater.operators.relational import bounded

    few, many = bounded(spark.range(3), 3), bounded(spark.range(4), 3)
    plan = lambda df: spark.range(9).join(df.hint("merge") if df is many else df, "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
    assert spark.range(9).join(few, "id").count() == 3


def test_clients_are_kept_apart(spark):
    rows = frame(spark, *star(5), *star(4))
    both = rows.withColumn("client_id", F.when(F.col("transfer_id") < 10, 1).otherwise(2))
    got = aml.q4(aml.in_currency(both), keys=("client_id",)).collect()
    assert sorted(map(tuple, got)) == [(1, "1", "A"), (1, "1", "C")]
    sizes = aml.q5(both, spark.createDataFrame(RATES, FX), keys=("client_id",)).collect()
    assert sorted(map(tuple, sizes)) == [(1, 0), (2, 0)]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        aml.Params(period_a=("2024-01-01", "2024-01-20"))
    with pytest.raises(ValueError):
        aml.Params(graph_window=("2024-01-05", "2024-01-01"))
    with pytest.raises(ValueError):
        aml.Params(middles=0)


def test_run_all_shares_one_scan(spark):
    from tidewater.sources import fixture

    sf = "/root/testdata/sf0.001"
    got = aml.run_all(fixture.transfers(spark, sf), fixture.banks(spark, sf), fixture.fx_rates(spark))
    assert {k: got[k].count() for k in ("q1", "q2", "q3", "q5")} == {"q1": 370, "q2": 15, "q3": 1, "q5": 1}
    got["usd"].unpersist()


def ran(df):
    """The final plan of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("reduce", [True, False])
def test_q4_reads_its_edges_once(spark, reduce):
    from tidewater.plans import registry

    plan = ran(aml.q4(registry.usd(spark, "/root/testdata/sf0.01"), reduce=reduce))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_q5_of_many_clients_reads_transfers_once(spark):
    from tidewater.plans import registry

    assert ran(registry.QUERIES["multi_client_q5"](spark, "/root/testdata/sf0.01")).count("FileScan") == 1


def test_edges_need_both_accounts(spark):
    rows = star(5)
    assert aml.graph(usd(spark, *rows, {**rows[0], "from_account": None}, {**rows[0], "to_bank": None})).count() == 10


def test_lists_in_settings(spark):
    for text, want in (("", []), (None, []), (" a , ,b\t,", ["a", "b"]), ("x", ["x"])):
        assert spark.range(1).select(E.listed(F.lit(text).cast("string"), ",").alias("x")).first()["x"] == want


def test_plans_push_down_and_prune(spark):
    from tidewater.plans import registry

    plan = registry.QUERIES["q1_low_amount"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan") :]
    assert "Exchange" not in scan and "LessThan(value,50.0)" in scan and "ts:" not in scan.split("ReadSchema")[1]


def test_two_decimals_are_exact(spark):
    rng = random.Random(7)
    values = [0.125, 2.675, 1.005, 0.375, 0.0, -0.0, -0.001, -0.125, 0.995, 99.995, 2.0**53 - 0.5, 2.0**53, 2.0**64 + 2.0**20, 8e37, 5e-324]
    values += [(2 * rng.randrange(10**7) + 1) / 200 for _ in range(100_000)] + [rng.randrange(10**7) / 8 for _ in range(20_000)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-9, 37) for _ in range(20_000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", E.format_amount(F.col("x")).alias("s")).collect()
    assert all(r["s"] == f"{r['x']:.2f}" for r in got) and len(got) == len(values)
    assert spark.range(1).select(E.format_amount(F.lit(None).cast("double")).alias("s")).first()["s"] is None


def test_routes_share_one_scan(spark, tmp_path):
    from tidewater.operators import routes
    from tidewater.plans import registry
    from tidewater.sources import fixture

    sf = "/root/testdata/sf0.01"
    rows = routes.routed(registry.transfers(spark, sf), aml.routes(), "transfer_id", "amount_paid")
    assert ran(rows).count("FileScan") == 1
    got = aml.run_routed(registry.transfers(spark, sf), fixture.fx_rates(spark), str(tmp_path / "routes"))
    for name, query in (("q1", "q1_low_amount"), ("q3", "q3_below_avg_fraction"), ("q5", "q5_count_converted")):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, registry.QUERIES[query](spark, sf).collect()))
    plan = ran(got["q1"])
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(route" in plan
    none = routes.written(routes.routed(spark.range(5), {"a": F.col("id") > 2, "b": F.col("id") > 7, "c": F.lit(None).cast("boolean")}, "id"), str(tmp_path / "few"))
    assert [none[k].count() for k in "abc"] == [2, 0, 0]


def test_fingerprints_of_multisets(spark):
    from tidewater.operators import fingerprints as P

    rows = [("a", 1), ("a", 1), ("", None), (None, None), ("b", 2)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    one, again = frame(rows), frame(rows[::-1]).repartition(3)
    assert P.differing(one, again).count() == 0
    assert {r["side"]: r["n"] for r in P.diff(one, again).collect()} == {"left": 0, "right": 0}
    for other, want in ((rows[1:], (1, 0)), ([*rows, rows[0], rows[0]], (0, 2)), ([*rows[:2], (None, None), (None, None), rows[4]], (1, 1)), ([], (5, 0))):
        assert P.differing(one, frame(other)).count() > 0
        got = {r["side"]: r["n"] for r in P.diff(one, frame(other), buckets=4).collect()}
        assert (got["left"], got["right"]) == want
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"), "id")
    changed = many.filter("id <> 777").unionByName(many.filter("id = 5"))
    nodes = executed(P.diff(many, changed))
    assert {r["side"]: r["n"] for r in P.diff(many, changed).collect()} == {"left": 1, "right": 1}
    assert max(rows_of(node) for name, node in nodes if "Join" in name) < 2_000  # of two buckets, not of all rows
