"""Queries by name, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import exprs as E
from tidewater.operators import fingerprints
from tidewater.operators import relational as R
from tidewater.plans import aml
from tidewater.sources import csvfiles, fixture, rates, sinks
from tidewater.streaming import runner, tenants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

A, B, G = aml.DEFAULT.period_a, aml.DEFAULT.period_b, aml.DEFAULT.graph_window
RATES = ", ".join(f"(DATE '{d}', '{iso}', {r})" for d, eur in fixture.EUR_RATES.items() for iso, r in (("EUR", eur), ("USD", 1.0)))
ISO = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.CURRENCY_ISO.items())
KEY = "coalesce(nullif(regexp_replace({0}, '^0+', ''), ''), '0')"
IN_A, IN_B, IN_G = (f"event_ts >= TIMESTAMP '{s}' AND event_ts < TIMESTAMP '{e}'" for s, e in (A, B, G))

PRELUDE = f"""WITH RECURSIVE transfers AS (
  SELECT event_id AS transfer_id, ts AS event_ts,
    CASE WHEN user_id % 2 = 0 THEN lpad(cast(user_id % 27 AS varchar), 3, '0') ELSE cast(user_id % 27 AS varchar) END AS from_bank,
    cast(user_id AS varchar) AS from_account,
    CASE WHEN k % 2 = 0 THEN lpad(cast(k % 27 AS varchar), 3, '0') ELSE cast(k % 27 AS varchar) END AS to_bank,
    cast(k AS varchar) AS to_account, value AS amount_paid,
    CASE event_type WHEN 'signup' THEN 'Euro' WHEN 'error' THEN 'Bitcoin' ELSE 'US Dollar' END AS payment_currency,
    CASE event_id % 5 WHEN 0 THEN 'ACH' WHEN 1 THEN 'Wire' WHEN 2 THEN 'Cheque' WHEN 3 THEN 'Cash' ELSE 'Credit Card' END AS payment_format
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events)
), usd AS (SELECT * FROM transfers WHERE payment_currency = 'US Dollar'),
banks AS (SELECT cast(n_nationkey AS varchar) AS bank_id, n_name AS bank_name FROM nation),
names AS (SELECT {KEY.format("bank_id")} AS bank_key, min(bank_name) AS bank_name FROM banks GROUP BY 1),
fx(fx_date, iso, rate) AS (VALUES {RATES}),
conv AS (
  SELECT t.*, amount_paid / rate AS converted_amount FROM transfers t
  JOIN fx ON fx_date = cast(event_ts AS date) AND iso = CASE payment_currency {ISO} END WHERE payment_currency <> 'Bitcoin'
),
edges AS (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM usd WHERE {IN_G}),
outs AS (SELECT from_bank AS bank, from_account AS account, count(*) AS degree FROM edges GROUP BY 1, 2),
ins AS (SELECT to_bank AS bank, to_account AS account, count(*) AS degree FROM edges GROUP BY 1, 2),
scatter AS (SELECT e.* FROM edges e JOIN outs ON bank = from_bank AND account = from_account WHERE degree >= 5),
gather AS (SELECT e.* FROM edges e JOIN ins ON bank = to_bank AND account = to_account WHERE degree >= 5),
chains AS (
  SELECT a.from_bank AS left_bank, a.from_account AS left_account, a.to_bank AS middle_bank, a.to_account AS middle_account, b.to_bank AS right_bank, b.to_account AS right_account
  FROM scatter a JOIN gather b ON a.to_bank = b.from_bank AND a.to_account = b.from_account
),
pairs AS (SELECT left_bank, left_account, right_bank, right_account, count(*) AS middles FROM chains GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
"""


def query(name: str, sql: str | None = None):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = PRELUDE + sql
        return fn

    return put


def transfers(s: SparkSession, d: str) -> DataFrame:
    return fixture.transfers(s, d)


def usd(s: SparkSession, d: str) -> DataFrame:
    return aml.in_currency(fixture.transfers(s, d))


def converted(s: SparkSession, d: str) -> DataFrame:
    return aml.converted(transfers(s, d), fixture.fx_rates(s))


# Scans, projections and filters

COLUMNS = "transfer_id, event_ts, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format"
query("scan_transfers", f"SELECT {COLUMNS} FROM transfers")(transfers)
query(
    "scan_accounts",
    "SELECT n_name AS bank_name, cast(n_nationkey AS varchar) AS bank_id, cast(c_custkey AS varchar) AS account_number, 'E' || c_custkey AS entity_id, c_name AS entity_name "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)(fixture.accounts)
SEVEN = ["event_ts", *R.EDGE, "amount_paid", "payment_format"]
query("proj_after_currency", f"SELECT {', '.join(SEVEN)} FROM usd")(lambda s, d: usd(s, d).select(SEVEN))
query("proj_edges", f"SELECT {', '.join(R.EDGE)} FROM usd")(lambda s, d: usd(s, d).select(R.EDGE))
query("generic_filter_project", "SELECT transfer_id, from_bank, amount_paid FROM transfers WHERE payment_format = 'Wire' AND amount_paid >= 100")(
    lambda s, d: R.filter_project(transfers(s, d), (F.col("payment_format") == "Wire") & (F.col("amount_paid") >= 100), "transfer_id", "from_bank", "amount_paid")
)
query("filter_currency", "SELECT transfer_id, payment_currency FROM transfers WHERE payment_currency IN ('US Dollar', 'Euro')")(
    lambda s, d: R.filter_project(transfers(s, d), F.col("payment_currency").isin("US Dollar", "Euro"), "transfer_id", "payment_currency")
)
query("filter_date_payment", f"SELECT transfer_id, event_ts, payment_format FROM transfers WHERE payment_format IN ('ACH', 'Wire') AND {IN_A}")(
    lambda s, d: R.filter_project(transfers(s, d), F.col("payment_format").isin(*aml.DEFAULT.formats) & E.within(F.col("event_ts"), A), "transfer_id", "event_ts", "payment_format")
)
query("filter_date_closed", f"SELECT transfer_id, event_ts FROM transfers WHERE event_ts BETWEEN TIMESTAMP '{A[0]}' AND TIMESTAMP '{A[1]}'")(
    lambda s, d: R.filter_project(transfers(s, d), E.within(F.col("event_ts"), A, inclusive_end=True), "transfer_id", "event_ts")
)
query("filter_converted_amount", "SELECT transfer_id, round(converted_amount, 6) AS converted_amount FROM conv WHERE converted_amount < 1")(
    lambda s, d: R.filter_project(converted(s, d), F.col("converted_amount") < 1, "transfer_id", F.round("converted_amount", 6).alias("converted_amount"))
)
RAW = ("2024/01/02", "2024/01/05 12:00")
query("filter_raw_range", f"SELECT transfer_id, strftime(event_ts, '%Y/%m/%d %H:%M') AS raw FROM transfers WHERE raw >= '{RAW[0]}' AND raw <= '{RAW[1]}'")(
    lambda s, d: R.filter_project(transfers(s, d).withColumn("raw", F.date_format("event_ts", "yyyy/MM/dd HH:mm")), E.raw_within(F.col("raw"), RAW), "transfer_id", "raw")
)
query("limit_top_transfers", "SELECT transfer_id, from_account, amount_paid FROM transfers ORDER BY amount_paid DESC, transfer_id LIMIT 25")(
    lambda s, d: R.top_n(transfers(s, d), 25, F.desc("amount_paid"), "transfer_id").select("transfer_id", "from_account", "amount_paid")
)
query("route_periods", f"SELECT transfer_id, CASE WHEN {IN_A} THEN 0 ELSE 1 END AS period FROM transfers WHERE ({IN_A}) OR ({IN_B})")(
    lambda s, d: transfers(s, d)
    .select("transfer_id", F.when(E.within(F.col("event_ts"), A), 0).when(E.within(F.col("event_ts"), B), 1).alias("period"))
    .filter("period is not null")
)
BOTH = "SELECT from_bank AS bank, from_account AS account, true AS is_left FROM {0} UNION ALL SELECT to_bank, to_account, false FROM {0}"
query("split_transfer_endpoints", BOTH.format("usd"))(lambda s, d: R.split_endpoints(usd(s, d)))
query("union_endpoints", BOTH.format("usd"))(lambda s, d: R.union_endpoints(usd(s, d)))
query("pair_endpoints", "SELECT left_bank AS bank, left_account AS account, true AS is_left FROM pairs UNION ALL SELECT right_bank, right_account, false FROM pairs")(
    lambda s, d: R.pair_endpoints(aml.scatter_gather_pairs(usd(s, d)))
)

# Scalar functions


def per_row(name: str, expression, sql: str) -> None:
    query(name, f"SELECT transfer_id, {sql} AS result FROM transfers")(lambda s, d: transfers(s, d).select("transfer_id", expression().alias("result")))


def written_ts():
    """The time as a file has it, with a tail; one in seven is no time."""
    return F.when(F.col("transfer_id") % 7 == 0, "2024/13/99 xx").otherwise(F.concat(F.date_format("event_ts", "yyyy/MM/dd HH:mm"), F.lit(":59 tail")))


def written_flag():
    return F.get(F.array(*map(F.lit, ["1", "0", "1 yes", ""])), F.col("transfer_id") % 4)


per_row("fn_normalize_bank", lambda: E.normalize_bank(F.col("from_bank")), KEY.format("from_bank"))
per_row("fn_currency_iso", lambda: E.currency_iso(F.col("payment_currency")), f"CASE payment_currency {ISO} END")
per_row("fn_date_key", lambda: E.date_key(F.col("event_ts")), "cast(event_ts AS date)")
per_row("fn_format_amount", lambda: E.format_amount(F.col("amount_paid")), "printf('%.2f', amount_paid)")
#: Halves of a cent, a third of them exact in binary, and numbers beyond 2^53.
HALVES = "((transfer_id * 7919 % 20011) * 2 + 1) / 200.0", "(transfer_id % 997) / 8.0", "-(transfer_id + 0.005) * 1e15"
query(
    "fn_format_half_cents",
    f"SELECT transfer_id, printf('%.2f', CASE transfer_id % 3 WHEN 0 THEN cast({HALVES[0]} AS double) WHEN 1 THEN cast({HALVES[1]} AS double) ELSE cast({HALVES[2]} AS double) END) AS result FROM transfers",
)(
    lambda s, d: transfers(s, d).select(
        "transfer_id",
        E.format_amount(F.get(F.array(((F.col("transfer_id") * 7919 % 20011) * 2 + 1) / 200.0, (F.col("transfer_id") % 997) / 8.0, -(F.col("transfer_id") + 0.005) * 1e15), F.col("transfer_id") % 3)).alias("result"),
    )
)
per_row("fn_parse_ts", lambda: E.parse_ts(written_ts()), "CASE WHEN transfer_id % 7 <> 0 THEN date_trunc('minute', event_ts) END")
per_row("fn_parse_laundering", lambda: E.parse_laundering(written_flag()), "transfer_id % 4 IN (0, 2)")

per_row("fn_slashed_date", lambda: E.slashed_date(F.date_format("event_ts", "yyyy-MM-dd")), "strftime(event_ts, '%Y/%m/%d')")
per_row("fn_day_of_raw", lambda: E.day_of(F.date_format("event_ts", "yyyy/MM/dd HH:mm")), "strftime(event_ts, '%Y/%m/%d')")


def setting():
    """A list as settings have it; one in five is empty, one in three has an empty part."""
    written = F.concat(F.lit(" "), "payment_format", F.when(F.col("transfer_id") % 3 == 0, " , ,").otherwise(","), F.lit("\t"), "payment_currency", F.lit(","))
    return F.when(F.col("transfer_id") % 5 == 0, "").otherwise(written)


per_row("fn_split_list", lambda: F.array_join(E.listed(setting(), ","), "|"), "CASE WHEN transfer_id % 5 = 0 THEN '' ELSE payment_format || '|' || payment_currency END")

# Rates, dimensions and aggregates

SENT_RATES = (
    "days AS (SELECT cast(event_ts AS date) AS day, (count(*) % 40 + 80) / 100.0 AS eur FROM transfers GROUP BY 1), "
    "sent(fx_date, iso, rate) AS (SELECT day, 'EUR', cast(eur AS double) FROM days UNION ALL SELECT day, 'USD', 1.0 FROM days)"
)


def sent_rates(s: SparkSession, d: str) -> DataFrame:
    return rates.rates(rates.entries(fixture.rate_payloads(transfers(s, d))))


query("dim_fx_rates", f", {SENT_RATES} SELECT * FROM sent")(sent_rates)


@query("dim_fx_rates_json", f", {SENT_RATES} SELECT * FROM sent")
def dim_fx_rates_json(s: SparkSession, d: str) -> DataFrame:
    """The rates of the payloads, written as files of JSON lines and read back."""
    path = runner.scratch(s)
    rates.write_rates(sent_rates(s, d), path)
    return rates.read_rates(s, path, lines=True)


query(
    "fx_corrupt_payloads",
    f""", {SENT_RATES} SELECT day, '{{"date":"' || day || '","base":"USD","quo' AS payload FROM days UNION ALL SELECT day, day || ' is no payload' FROM days""",
)(lambda s, d: rates.corrupt(fixture.rate_payloads(transfers(s, d)), "day"))
query(
    "q5_payload_rates",
    f", {SENT_RATES} SELECT count(*) AS size FROM transfers JOIN sent ON fx_date = cast(event_ts AS date) AND iso = CASE payment_currency {ISO} END "
    f"WHERE payment_currency <> 'Bitcoin' AND payment_format IN ('ACH', 'Wire') AND {IN_A} AND amount_paid / rate < 1",
)(lambda s, d: aml.q5(transfers(s, d), sent_rates(s, d)))
query("q5_fx_join", "SELECT transfer_id, round(converted_amount, 6) AS converted_amount FROM conv")(
    lambda s, d: converted(s, d).select("transfer_id", F.round("converted_amount", 6).alias("converted_amount"))
)
query("agg_saturating_count", "SELECT payment_format, payment_currency, least(count(*), 100) AS n FROM transfers GROUP BY 1, 2")(
    lambda s, d: R.saturating_count(transfers(s, d), ["payment_format", "payment_currency"], 100, "n")
)
query("agg_saturating_distinct", "SELECT from_bank, from_account, least(count(DISTINCT (to_bank, to_account)), 5) AS n FROM usd GROUP BY 1, 2")(
    lambda s, d: R.saturating_distinct(usd(s, d), ["from_bank", "from_account"], ["to_bank", "to_account"], 5, "n")
)
query("distinct_banks", "SELECT bank_key, bank_name FROM names")(
    lambda s, d: R.distinct_on(fixture.banks(s, d), E.normalize_bank(F.col("bank_id")), "bank_key", "bank_name")
)
TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {{k}}{KEY.format('from_bank')} ORDER BY amount_paid DESC, from_account DESC, from_bank DESC) AS r FROM {{t}}) WHERE r = 1"
LARGEST = f"SELECT from_bank, from_account, amount_paid FROM ({TOP.format(k='', t='usd')})"
query("agg_argmax_by_bank", LARGEST)(lambda s, d: aml.largest_by_bank(usd(s, d)).select("from_bank", "from_account", "amount_paid"))
query("q2_window_variant", LARGEST)(lambda s, d: aml.q2_window(usd(s, d)))
query("agg_sum_count_by_format", f"SELECT payment_format, round(sum(amount_paid), 2) AS total, count(*) AS n FROM usd WHERE {IN_A} GROUP BY 1")(
    lambda s, d: usd(s, d).filter(E.within(F.col("event_ts"), A)).groupBy("payment_format").agg(F.round(F.sum("amount_paid"), 2).alias("total"), F.count("*").alias("n"))
)
query("agg_avg_by_format", f"SELECT payment_format, round(avg(amount_paid), 6) AS average FROM usd WHERE {IN_A} GROUP BY 1")(
    lambda s, d: aml.format_averages(usd(s, d)).select("payment_format", F.round("average", 6).alias("average"))
)

# The five queries

Q1 = "SELECT {c}from_bank, from_account, to_bank, to_account, amount_paid FROM {t} WHERE amount_paid < 50"
Q2 = f"SELECT {{c}}from_bank, from_account, bank_name, amount_paid FROM ({TOP}) JOIN names ON bank_key = {KEY.format('from_bank')}"
Q3 = (
    f"SELECT {{c}}from_bank, from_account, payment_format, amount_paid FROM {{t}} JOIN (SELECT {{c}}payment_format, avg(amount_paid) AS average FROM {{t}} WHERE {IN_A} GROUP BY ALL) "
    f"USING ({{c}}payment_format) WHERE {IN_B} AND amount_paid < average / 100"
)
Q4 = "SELECT left_bank AS bank, left_account AS account FROM pairs UNION SELECT right_bank, right_account FROM pairs"
Q5 = f"SELECT count(*) AS size FROM conv WHERE payment_format IN ('ACH', 'Wire') AND {IN_A} AND converted_amount < 1"
query("q1_low_amount", Q1.format(c="", t="usd"))(lambda s, d: aml.q1(usd(s, d)))
query("q2_max_per_bank", Q2.format(c="", t="usd", k=""))(lambda s, d: aml.q2(usd(s, d), fixture.banks(s, d)))
query("q3_below_avg_fraction", Q3.format(c="", t="usd"))(lambda s, d: aml.q3(usd(s, d)))
query("q4_out_degree", "SELECT * FROM outs")(lambda s, d: R.degree(aml.graph(usd(s, d)), "from"))
query("q4_in_degree", "SELECT * FROM ins")(lambda s, d: R.degree(aml.graph(usd(s, d)), "to"))
query("q4_semi_scatter", "SELECT * FROM scatter")(lambda s, d: R.reduced(aml.graph(usd(s, d)), "from", 5).select(R.EDGE))
query("q4_semi_gather", "SELECT * FROM gather")(lambda s, d: R.reduced(aml.graph(usd(s, d)), "to", 5).select(R.EDGE))


@query("q4_chains", "SELECT * FROM chains")
def q4_chains(s: SparkSession, d: str) -> DataFrame:
    pairs = aml.graph(usd(s, d))
    return R.chains(R.reduced(pairs, "from", 5), R.reduced(pairs, "to", 5))


query("q4_pair_middles", "SELECT * FROM pairs")(lambda s, d: aml.scatter_gather_pairs(usd(s, d)))
query("q4_scatter_gather_accounts", Q4)(lambda s, d: aml.q4(usd(s, d)))
query("q5_count_converted", Q5)(lambda s, d: aml.q5(transfers(s, d), fixture.fx_rates(s)))

# Result lines and files


def result_lines(name: str, make: Callable[[SparkSession, str], DataFrame], columns: str, sql: str) -> None:
    query(f"result_{name}", f"SELECT concat_ws(',', {columns}) AS line FROM ({sql})")(lambda s, d: sinks.lines(make(s, d), name))


MONEY = "printf('%.2f', amount_paid)"
result_lines("q1", lambda s, d: aml.q1(usd(s, d)), f"from_bank, from_account, to_bank, to_account, {MONEY}", Q1.format(c="", t="usd"))
result_lines("q2", lambda s, d: aml.q2(usd(s, d), fixture.banks(s, d)), f"from_bank, from_account, bank_name, {MONEY}", Q2.format(c="", t="usd", k=""))
result_lines("q3", lambda s, d: aml.q3(usd(s, d)), f"from_bank, from_account, payment_format, {MONEY}", Q3.format(c="", t="usd"))
result_lines("q4", lambda s, d: aml.q4(usd(s, d)), "bank, account", Q4)
result_lines("q5", lambda s, d: aml.q5(transfers(s, d), fixture.fx_rates(s)), "size", Q5)


@query("result_q4_file", f"SELECT bank, account, row_number() OVER (ORDER BY bank, account) AS line FROM ({Q4})")
def result_q4_file(s: SparkSession, d: str) -> DataFrame:
    """The lines of Q4's file in the order in which they stand there."""
    path = runner.scratch(s)
    sinks.write_result(aml.q4(usd(s, d)), "q4", path, single_file=True, ordered=True)
    found = s.read.option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())  # one file, read in one piece
    return found.select(F.col("Bank").alias("bank"), F.col("Account").alias("account"), (F.col("at") + 1).alias("line"))


@query(
    "csv_transfers",
    "SELECT date_trunc('minute', event_ts) AS event_ts, from_bank, from_account, to_bank, to_account, amount_paid AS amount_received, payment_currency AS receiving_currency, "
    "amount_paid, payment_currency, payment_format, transfer_id % 2 = 1 AS is_laundering FROM transfers",
)
def csv_transfers(s: SparkSession, d: str) -> DataFrame:
    """Transfers written as lines, those with a bad time among them, and read back."""
    path = runner.scratch(s)
    fixture.transfer_lines(transfers(s, d)).write.text(path)
    return csvfiles.read_transfers(s, path)


@query(
    "csv_accounts",
    "SELECT n_name AS bank_name, cast(n_nationkey AS varchar) AS bank_id, cast(c_custkey AS varchar) AS account_number, 'E' || c_custkey AS entity_id, c_name || ', and others' AS entity_name "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def csv_accounts(s: SparkSession, d: str) -> DataFrame:
    path = runner.scratch(s)
    fixture.account_lines(fixture.accounts(s, d)).write.text(path)
    return csvfiles.read_accounts(s, path)


@query(
    "csv_golden_transfers",
    "SELECT CASE WHEN transfer_id % 7 = 0 THEN '2024/13/99 00:00' ELSE strftime(event_ts, '%Y/%m/%d %H:%M') END AS raw_ts, from_bank, from_account, to_bank, to_account, "
    "CASE WHEN transfer_id % 10 IN (3, 8) THEN 0.0 ELSE amount_paid END AS amount_received, payment_currency AS receiving_currency, "
    "CASE WHEN transfer_id % 10 IN (3, 8) THEN 0.0 ELSE amount_paid END AS amount_paid, payment_currency, payment_format FROM transfers",
)
def csv_golden_transfers(s: SparkSession, d: str) -> DataFrame:
    """Lines with bad times, bad amounts, too many and too few fields, read as leniently as can be."""
    path = runner.scratch(s)
    fixture.lenient_lines(transfers(s, d)).write.text(path)
    return csvfiles.golden(s.read.text(path))


@query(
    "routed_q1_q3_q5",
    f"SELECT 'q1' AS query, concat_ws(',', from_bank, from_account, to_bank, to_account, {MONEY}) AS line FROM ({Q1.format(c='', t='usd')}) "
    f"UNION ALL SELECT 'q3', concat_ws(',', from_bank, from_account, payment_format, {MONEY}) FROM ({Q3.format(c='', t='usd')}) UNION ALL SELECT 'q5', cast(size AS varchar) FROM ({Q5})",
)
def routed_q1_q3_q5(s: SparkSession, d: str) -> DataFrame:
    """Lines of three results from one scan of the transfers."""
    got = aml.run_routed(transfers(s, d), fixture.fx_rates(s), runner.scratch(s))
    first, *others = [sinks.lines(df, name).select(F.lit(name).alias("query"), "line") for name, df in got.items()]
    for df in others:
        first = first.unionByName(df)
    return first


# Variants and exploration

query(
    "q2_notebook_variant",
    f"SELECT DISTINCT from_bank, from_account, b.bank_name, amount_paid FROM (SELECT *, {KEY.format('from_bank')} AS k, row_number() OVER (PARTITION BY {KEY.format('from_bank')} "
    f"ORDER BY amount_paid DESC, transfer_id) AS r FROM usd) JOIN banks b ON k = {KEY.format('b.bank_id')} WHERE r = 1",
)(lambda s, d: aml.q2_first_row(usd(s, d), fixture.banks(s, d)))
SCATTERERS = f"SELECT u.transfer_id, u.from_bank, u.from_account, u.to_bank, u.to_account FROM usd u JOIN outs ON bank = from_bank AND account = from_account WHERE {IN_G} AND degree > 5"
query("group_filter_having", SCATTERERS)(lambda s, d: aml.scatterers(usd(s, d)).select("transfer_id", *R.EDGE))
query(
    "q4_notebook_variant",
    f", sc AS ({SCATTERERS}), pr AS (SELECT a.from_bank AS lb, a.from_account AS la, b.to_bank AS rb, b.to_account AS ra FROM sc a JOIN sc b ON a.to_bank = b.from_bank AND a.to_account = b.from_account "
    "WHERE a.from_bank <> b.to_bank OR a.from_account <> b.to_account GROUP BY ALL HAVING count(*) > 5) SELECT lb AS bank, la AS account FROM pr UNION SELECT rb, ra FROM pr",
)(lambda s, d: aml.q4_counting_rows(usd(s, d)))
query("eda_ts_range", "SELECT min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM transfers")(
    lambda s, d: transfers(s, d).agg(F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
)
query("eda_currencies", "SELECT payment_currency, count(*) AS n FROM transfers GROUP BY 1")(
    lambda s, d: transfers(s, d).groupBy("payment_currency").agg(F.count("*").alias("n"))
)
query("eda_accounts_multi_bank", f"SELECT account, count(DISTINCT bank) AS n_banks FROM ({BOTH.format('transfers')}) GROUP BY 1")(
    lambda s, d: R.split_endpoints(transfers(s, d)).groupBy("account").agg(F.count_distinct("bank").alias("n_banks"))
)

# Clients side by side, messages, verification

MANY = ", many AS (SELECT cast(from_account AS bigint) % 3 AS client_id, * FROM transfers), musd AS (SELECT * FROM many WHERE payment_currency = 'US Dollar') "
CLIENT = ("client_id",)


def clients(s: SparkSession, d: str) -> DataFrame:
    return transfers(s, d).withColumn("client_id", F.col("from_account").cast("bigint") % 3)


def clients_usd(s: SparkSession, d: str) -> DataFrame:
    return aml.in_currency(clients(s, d))


query("multi_client_q1", MANY + Q1.format(c="client_id, ", t="musd"))(lambda s, d: aml.q1(clients_usd(s, d), keys=CLIENT))
query("multi_client_q2", MANY + Q2.format(c="client_id, ", t="musd", k="client_id, "))(lambda s, d: aml.q2(clients_usd(s, d), fixture.banks(s, d), keys=CLIENT))
query("multi_client_q3", MANY + Q3.format(c="client_id, ", t="musd"))(lambda s, d: aml.q3(clients_usd(s, d), keys=CLIENT))
query(
    "multi_client_q4",
    MANY + f", me AS (SELECT DISTINCT client_id, from_bank, from_account, to_bank, to_account FROM musd WHERE {IN_G}), "
    "mp AS (SELECT a.client_id, a.from_bank AS lb, a.from_account AS la, b.to_bank AS rb, b.to_account AS ra FROM me a JOIN me b "
    "ON a.client_id = b.client_id AND a.to_bank = b.from_bank AND a.to_account = b.from_account GROUP BY ALL HAVING count(*) >= 5) "
    "SELECT client_id, lb AS bank, la AS account FROM mp UNION SELECT client_id, rb, ra FROM mp",
)(lambda s, d: aml.q4(clients_usd(s, d), keys=CLIENT))
query(
    "multi_client_q5",
    MANY + f"SELECT client_id, count(*) FILTER (WHERE payment_format IN ('ACH', 'Wire') AND {IN_A} AND converted_amount < 1) AS size "
    "FROM many LEFT JOIN (SELECT transfer_id, converted_amount FROM conv) USING (transfer_id) GROUP BY 1",
)(lambda s, d: aml.q5(clients(s, d), fixture.fx_rates(s), keys=CLIENT))


@query("abort_clients_anti", MANY + "SELECT client_id, transfer_id FROM many WHERE client_id <> 1")
def abort_clients_anti(s: SparkSession, d: str) -> DataFrame:
    aborted = s.createDataFrame([(1,)], "client_id bigint")
    return runner.without_aborted(clients(s, d).select("client_id", "transfer_id"), aborted)


@query("dedup_messages", MANY + "SELECT client_id, transfer_id % 5 AS sender_id, transfer_id // 5 AS seq, amount_paid FROM many")
def dedup_messages(s: SparkSession, d: str) -> DataFrame:
    sent = clients(s, d).select("client_id", (F.col("transfer_id") % 5).alias("sender_id"), F.floor(F.col("transfer_id") / 5).alias("seq"), "amount_paid")
    return runner.deduplicated(sent.unionByName(sent.filter("seq % 3 = 0")))


DIFF = "SELECT from_bank, from_account FROM usd WHERE amount_paid < 50", "SELECT from_bank, from_account FROM usd WHERE amount_paid >= 45 AND amount_paid < 90"
query(
    "verify_multiset_diff",
    f", l AS ({DIFF[0]}), r AS ({DIFF[1]}) SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) "
    "UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)",
)(
    lambda s, d: R.multiset_diff(
        usd(s, d).filter("amount_paid < 50").select("from_bank", "from_account"), usd(s, d).filter("amount_paid >= 45 and amount_paid < 90").select("from_bank", "from_account")
    )
)

query(
    "verify_fingerprint",
    f", l AS ({DIFF[0]}), r AS ({DIFF[1]}) SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) "
    "UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) UNION ALL SELECT 'variants of Q2', 0",
)(
    lambda s, d: fingerprints.diff(
        usd(s, d).filter("amount_paid < 50").select("from_bank", "from_account"), usd(s, d).filter("amount_paid >= 45 and amount_paid < 90").select("from_bank", "from_account")
    ).unionByName(
        fingerprints.differing(aml.largest_by_bank(usd(s, d)).select("from_bank", "from_account", "amount_paid"), aml.q2_window(usd(s, d))).agg(F.lit("variants of Q2").alias("side"), F.count("*").alias("n"))
    )
)

# Streams

query("stream_ingest", f"SELECT {COLUMNS} FROM transfers")(runner.ingest)
query("stream_dedup_messages", MANY + "SELECT client_id, transfer_id % 5 AS sender_id, transfer_id // 5 AS seq, amount_paid FROM many")(runner.messages_once)
query("stream_dedup_within", MANY + "SELECT client_id, transfer_id % 5 AS sender_id, transfer_id // 5 AS seq, amount_paid FROM many")(runner.messages_within)
query("stream_available_now", "SELECT payment_format, round(sum(amount_paid), 2) AS total, count(*) AS n FROM usd GROUP BY 1")(runner.format_totals)
query("stream_q3_foreachbatch", Q3.format(c="", t="usd"))(runner.q3)
query("stream_tumbling_extra", "SELECT date_trunc('hour', event_ts) AS hour, payment_currency, count(*) AS n FROM transfers GROUP BY 1, 2")(runner.hourly)
query(
    "stream_client_completion",
    "SELECT transfer_id % 3 AS client_id, count(*) AS n, count(*) FILTER (WHERE payment_currency = 'US Dollar' AND amount_paid < 50) AS n_low, "
    "max(amount_paid) FILTER (WHERE payment_currency = 'US Dollar') AS largest FROM transfers WHERE transfer_id % 3 <> 2 GROUP BY 1",
)(tenants.client_completion)
query(
    "stream_abort",
    ", c AS (SELECT cast(from_account AS bigint) % 16 AS client_id, * FROM transfers) SELECT client_id, count(*) AS n, count(*) FILTER (WHERE payment_currency = 'US Dollar' AND amount_paid < 50) AS n_low, "
    "max(amount_paid) FILTER (WHERE payment_currency = 'US Dollar') AS largest FROM c WHERE client_id NOT IN (SELECT client_id FROM c WHERE cast(from_account AS bigint) % 48 IN (5, 22) AND transfer_id % 20 = 7) GROUP BY 1",
)(tenants.abort_stream)
query("stream_q4_scatterers", "SELECT DISTINCT from_bank, from_account FROM scatter")(tenants.scatterers)
query(
    "stream_join_banks",
    f"SELECT transfer_id, bank_key, bank_name, amount_paid FROM usd JOIN names ON bank_key = {KEY.format('from_bank')}",
)(tenants.banks_join)
