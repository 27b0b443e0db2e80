import datetime
import json

from tidewater.plans import aml
from tidewater.sources import csvfiles, fixture, rates, sinks

HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"


def test_transfer_files(spark, tmp_path):
    good = "2022/09/01 00:20,010,8000EBD30,10,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0"
    lines = [HEADER, good, good.replace(",0", ",1", 1) + "x", "2022/09/01 00:20,short", good.replace("2022/09", "2022/13"), good.replace("3697.34,US Dollar,R", "abc,US Dollar,R"), good.replace("3697.34", "NaN"), good.replace(",0", ",1,more,commas")[:-1] + "\r"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    got = csvfiles.read_transfers(spark, str(tmp_path / "t.csv"))
    rows = got.collect()
    assert len(rows) == got.count() == 3
    assert rows[0]["event_ts"] == datetime.datetime(2022, 9, 1, 0, 20) and rows[0]["from_bank"] == "010" and rows[0]["is_laundering"] is False


def test_account_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nFirst,007,A1,E1,Smith, and Sons\r\nshort,1\n")
    rows = csvfiles.read_accounts(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("First", "007", "A1", "E1", "Smith, and Sons")]


def test_result_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    usd = aml.in_currency(fixture.transfers(spark, sf))
    sinks.write_result(aml.q1(usd), "q1", str(tmp_path / "q1"), single_file=True)
    sinks.write_result(aml.q5(fixture.transfers(spark, sf), fixture.fx_rates(spark)), "q5", str(tmp_path / "q5"))
    (part,) = (tmp_path / "q1").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "From Bank,Account,To Bank,Account.1,Amount Paid" and len(lines) == 371
    assert all(len(x.rsplit(".", 1)[1]) == 2 for x in lines[1:])
    assert (next((tmp_path / "q5").glob("part-*.csv"))).read_text().split() == ["Size", "2"]


def test_ordered_results(spark, tmp_path):
    rows = spark.createDataFrame([("10", "b"), ("9", "a"), ("10", "B"), ("010", "z")], "bank string, account string").repartition(3)
    sinks.write_result(rows, "q4", str(tmp_path / "q4"), single_file=True, ordered=True)
    (part,) = (tmp_path / "q4").glob("part-*.csv")
    assert part.read_text().split() == ["Bank,Account", "010,z", "10,B", "10,b", "9,a"]


def test_rates_from_json(spark, tmp_path):
    one = {"date": "2024-01-01", "base": "USD", "quote": "EUR", "rate": 0.9}
    many = [one, {**one, "quote": "GBP", "rate": 0.8}, {**one, "base": "EUR"}, {**one, "date": "x", "quote": "A"}, {**one, "rate": 0, "quote": "B"}, {**one, "rate": None, "quote": "C"}, {**one, "quote": None}, {}]
    (tmp_path / "array.json").write_text(json.dumps(many))
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, many)))
    want = [(datetime.date(2024, 1, 1), "EUR", 0.9), (datetime.date(2024, 1, 1), "GBP", 0.8)]
    read = lambda name, **k: sorted(map(tuple, rates.read_rates(spark, str(tmp_path / name), **k).collect()))
    assert read("array.json") == read("lines.json", lines=True) == want and read("one.json") == want[:1]


def test_payloads_in_a_column(spark):
    from pyspark.sql import functions as F

    one = {"date": "2024-01-01", "base": "USD", "quote": "EUR", "rate": 0.9}
    bare = {"date": "2024-01-02", "quote": "EUR", "rate": 0.8}
    good = [(json.dumps(one), None), (json.dumps([{**one, "quote": "GBP", "rate": 2}, {**one, "base": "EUR", "quote": "JPY"}]), "USD"), (json.dumps([bare]), "USD"), (json.dumps(bare), None), ("[]", "USD"), ("{}", "USD")]
    odd = [(json.dumps([{**one, "rate": "high", "quote": "A"}, {**one, "quote": "B", "rate": 3}]), None), (json.dumps({**one, "rate": {"x": 1}, "quote": "C"}), None)]
    bad = [("", None), (None, "USD"), ("null", None), (json.dumps(one)[:-3], None), ("[1, 2]", None), ("7", None), ("no json", "USD")]
    sent = spark.createDataFrame(good + odd + bad, "payload string, base string")
    first, second = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    got = sorted(map(tuple, rates.rates(rates.entries(sent)).collect()))
    assert got == [(first, "B", 3.0), (first, "EUR", 0.9), (first, "GBP", 2.0), (second, "EUR", 0.8)]
    wrong = rates.corrupt(sent.withColumn("day", F.lit(5)), "day").collect()
    assert sorted((r["payload"] for r in wrong), key=str) == sorted((b for b, _ in bad), key=str) and wrong[0]["day"] == 5


def test_the_lenient_reading_keeps_lines_with_bad_amounts(spark, tmp_path):
    lines = [HEADER, "t,1,a,2,b,x,Euro,y,Euro,Wire,0", "t,1,a,2,b,1.5,Euro,2.5,Euro,Wire", "t,1,a,2,b,nan,Euro,inf,Euro,Wire,0,more", "t,1,a,2,b,1,Euro,2,Euro", "", "bad time,,,,,,,,,\r"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    got = csvfiles.golden(spark.read.text(str(tmp_path / "t.csv"))).collect()
    assert [(r["raw_ts"], r["amount_received"], r["amount_paid"], r["payment_format"]) for r in got] == [("t", 0.0, 0.0, "Wire"), ("t", 1.5, 2.5, "Wire"), ("t", 0.0, 0.0, "Wire"), ("bad time", 0.0, 0.0, "")]
