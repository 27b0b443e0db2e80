"""The five queries. keys are tenant columns (such as client_id) that each query keeps apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import exprs as E
from tidewater.operators import overlap
from tidewater.operators import relational as R
from tidewater.operators import routes as branches


@dataclass(frozen=True)
class Params:
    currency: str = "US Dollar"
    low_amount: float = 50.0
    period_a: tuple[str, str] = ("2024-01-01", "2024-01-06")
    period_b: tuple[str, str] = ("2024-01-06", "2024-01-16")
    fraction: float = 100.0
    graph_window: tuple[str, str] = ("2024-01-01", "2024-01-10")
    middles: int = 5
    #: Chains through one middle from which on Q4 takes it for a hub.
    hub_chains: int = overlap.HUB_CHAINS
    formats: tuple[str, ...] = field(default=("ACH", "Wire"))
    ignored: tuple[str, ...] = field(default=("Bitcoin",))
    converted: float = 1.0
    #: The longest period that conversion takes.
    most_days: int = 10

    def __post_init__(self):
        import datetime

        for start, end in (self.period_a, self.period_b, self.graph_window):
            if datetime.date.fromisoformat(start) > datetime.date.fromisoformat(end):
                raise ValueError(f"the period {start} to {end} ends before it begins")
        start, end = map(datetime.date.fromisoformat, self.period_a)
        if (end - start).days > self.most_days:
            raise ValueError(f"the period {start} to {end} has more than {self.most_days} days")
        if self.middles < 1:
            raise ValueError("middles must be at least 1")


DEFAULT = Params()


def in_currency(transfers: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return transfers.filter(F.col("payment_currency").isin(p.currency))


def q1(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """Transfers of less than the low amount."""
    return R.filter_project(usd, F.col("amount_paid") < p.low_amount, *keys, *R.EDGE, "amount_paid")


def largest_by_bank(usd: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The largest transfer of each source bank: ties go to the greater account, then to the
    greater spelling of the bank, both as strings."""
    rows = usd.withColumn("bank_key", E.normalize_bank(F.col("from_bank")))
    return R.argmax_by(rows, [*keys, "bank_key"], ["amount_paid", "from_account", "from_bank"], ["amount_paid", "from_account", "from_bank"])


def q2(usd: DataFrame, banks: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """The largest transfer of each source bank, with the bank's name; unknown banks fall out."""
    names = R.distinct_on(banks, E.normalize_bank(F.col("bank_id")), "bank_key", "bank_name")
    return largest_by_bank(usd, keys).join(names, "bank_key").select(*keys, "from_bank", "from_account", "bank_name", "amount_paid")


def format_averages(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    early = usd.filter(E.within(F.col("event_ts"), p.period_a))
    return early.groupBy(*keys, "payment_format").agg(F.avg("amount_paid").alias("average"))


def q3(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """Transfers of period B below a fraction of period A's average for their format."""
    late = usd.filter(E.within(F.col("event_ts"), p.period_b))
    found = late.join(R.bounded(format_averages(usd, p, keys)), [*keys, "payment_format"])
    return found.filter(F.col("amount_paid") < F.col("average") / p.fraction).select(*keys, "from_bank", "from_account", "payment_format", "amount_paid")


def graph(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = (), inclusive_end: bool = False) -> DataFrame:
    return R.edges(usd.filter(E.within(F.col("event_ts"), p.graph_window, inclusive_end)), *keys)


def scatter_gather_pairs(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = (), reduce: bool = True, inclusive_end: bool = False, counted: bool = True) -> DataFrame:
    """Pairs with enough distinct middles, and how many; not counted, at least so many.

    reduce: chains of hubs are left out where they can't decide, and looked up where they can;
    else all chains are made.
    """
    pairs = graph(usd, p, keys, inclusive_end)
    if reduce:
        return overlap.overlapping(pairs, p.middles, *keys, hub_chains=p.hub_chains, counted=counted)
    return R.pair_middles(R.chains(pairs, pairs, *keys), p.middles, *keys)


def q4(usd: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = (), reduce: bool = True, inclusive_end: bool = False) -> DataFrame:
    """Accounts at either end of a pair with enough distinct middles between them."""
    pairs = scatter_gather_pairs(usd, p, keys, reduce, inclusive_end, counted=False)
    return R.pair_endpoints(pairs, *keys).select(*keys, "bank", "account").distinct()


def converted(transfers: DataFrame, rates: DataFrame, p: Params = DEFAULT, how: str = "inner") -> DataFrame:
    """Transfers with converted_amount; those of ignored currencies and without a rate for
    their day fall out, or, with a left join, have none."""
    ignored = F.col("payment_currency").isin(*p.ignored)
    rows = transfers.filter(~ignored) if how == "inner" else transfers
    iso = F.when(~ignored, E.currency_iso(F.col("payment_currency")))
    rows = rows.withColumn("iso", iso).withColumn("fx_date", E.date_key(F.col("event_ts")))
    return rows.join(rates, ["fx_date", "iso"], how).withColumn("converted_amount", F.col("amount_paid") / F.col("rate"))


def q5(transfers: DataFrame, rates: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many transfers of the formats in period A convert to less than the limit; without
    keys always one row, with keys one for each tenant that has transfers."""
    picked = F.col("payment_format").isin(*p.formats) & E.within(F.col("event_ts"), p.period_a)
    low = F.col("converted_amount") < p.converted
    if not keys:
        return converted(transfers.filter(picked), rates, p).filter(low).agg(F.count("*").alias("size"))
    every = converted(transfers.withColumn("picked", picked), rates, p, "left")
    return every.groupBy(*keys).agg(F.count_if(F.col("picked") & low).alias("size"))


def run_all(transfers: DataFrame, banks: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """All queries over one persisted scan of the currency's transfers; unpersist() it after."""
    usd = in_currency(transfers, p).persist()
    return {"usd": usd, "q1": q1(usd, p), "q2": q2(usd, banks, p), "q3": q3(usd, p), "q4": q4(usd, p), "q5": q5(transfers, rates, p)}


def routes(p: Params = DEFAULT) -> dict[str, Column]:
    """Which transfers Q1, Q3 (each of its periods) and Q5 take, as predicates on one scan."""
    usd, at = F.col("payment_currency").isin(p.currency), F.col("event_ts")
    return {
        "q1": usd & (F.col("amount_paid") < p.low_amount),
        "q3": usd & (E.within(at, p.period_a) | E.within(at, p.period_b)),
        "q5": F.col("payment_format").isin(*p.formats) & E.within(at, p.period_a) & ~F.col("payment_currency").isin(*p.ignored),
    }


def run_routed(transfers: DataFrame, rates: DataFrame, path: str, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """Q1, Q3 and Q5 from one scan of the transfers, which writes the rows of each to path."""
    columns = ["event_ts", *R.EDGE, "amount_paid", "payment_currency", "payment_format"]
    tables = branches.written(branches.routed(transfers, routes(p), *columns), path)
    return {"q1": q1(tables["q1"], p), "q3": q3(tables["q3"], p), "q5": q5(tables["q5"], rates, p)}


def q2_window(usd: DataFrame) -> DataFrame:
    """largest_by_bank with a ranking window."""
    order = Window.partitionBy("bank_key").orderBy(F.desc("amount_paid"), F.desc("from_account"), F.desc("from_bank"))
    rows = usd.withColumn("bank_key", E.normalize_bank(F.col("from_bank")))
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("from_bank", "from_account", "amount_paid")


def q2_first_row(usd: DataFrame, banks: DataFrame) -> DataFrame:
    """The variant that takes a bank's first row of the greatest amount, and each of its names."""
    top = R.first_row_max(usd, E.normalize_bank(F.col("from_bank")), "amount_paid", "transfer_id")
    named = banks.select(E.normalize_bank(F.col("bank_id")).alias("bank_key"), "bank_name")
    joined = top.withColumn("bank_key", E.normalize_bank(F.col("from_bank"))).join(named, "bank_key")
    return joined.select("from_bank", "from_account", "bank_name", "amount_paid").distinct()


def scatterers(usd: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Transfers of accounts with more than the number of distinct destinations."""
    rows = usd.filter(E.within(F.col("event_ts"), p.graph_window)).select("transfer_id", *R.EDGE)
    often = R.degree(R.edges(rows), "from").filter(F.col("degree") > p.middles)
    often = often.select(F.col("bank").alias("from_bank"), F.col("account").alias("from_account"))
    return rows.join(often, ["from_bank", "from_account"], "left_semi")


def q4_counting_rows(usd: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The variant that counts chains of transfers, not of distinct edges, whose middle is a
    scatterer too, between two different accounts."""
    pairs = scatterers(usd, p).groupBy(*R.EDGE).agg(F.count("*").alias("n"))
    a = pairs.select(F.col("from_bank").alias("left_bank"), F.col("from_account").alias("left_account"), F.col("to_bank").alias("mb"), F.col("to_account").alias("ma"), F.col("n").alias("n1"))
    b = pairs.select(F.col("from_bank").alias("mb"), F.col("from_account").alias("ma"), F.col("to_bank").alias("right_bank"), F.col("to_account").alias("right_account"), F.col("n").alias("n2"))
    found = a.join(b, ["mb", "ma"]).filter("left_bank <> right_bank or left_account <> right_account")
    found = found.groupBy(*R.PAIR).agg(F.sum(F.col("n1") * F.col("n2")).alias("rows")).filter(F.col("rows") > p.middles)
    return R.pair_endpoints(found).select("bank", "account").distinct()
