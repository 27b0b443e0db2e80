"""Pairs of accounts by the middles that they share, without the chains of hubs.

A middle with many sources and many destinations makes a chain of each with each. An account
may leave out any k - 1 of its middles and still meet, through the rest, every account that it
shares k with. So each account leaves out its costliest hubs, up to k - 1 of them, the
remaining chains give the candidates, and what was left out, at most k - 1 edges an account,
is looked up for these alone. Where no middle is a hub, nothing is left out and the plan is
that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.relational import EDGE, PAIR, chains, endpoint

#: Chains through one middle from which on it is a hub.
HUB_CHAINS = 10_000

LEFT, RIGHT = PAIR[:2], PAIR[2:]


def hubs(edges: DataFrame, more_than: int, *keys: str) -> DataFrame:
    """(to_bank, to_account, cost) of middles with more chains than that: sources by
    destinations, both counted in one pass over the edges."""
    ends = [F.struct(*endpoint(s), F.lit(int(s == "to")).alias("ins"), F.lit(int(s == "from")).alias("outs")) for s in ("from", "to")]
    account = F.col("bank").alias("to_bank"), F.col("account").alias("to_account")
    cost = (F.sum("ins") * F.sum("outs")).alias("cost")
    return edges.select(*keys, F.inline(F.array(*ends))).groupBy(*keys, *account).agg(cost).filter(F.col("cost") > more_than)


def left_out(edges: DataFrame, hubs: DataFrame, n: int, *keys: str) -> DataFrame:
    """The edges from each account to its costliest hubs, n at most; each task keeps n an
    account before they are shuffled."""
    order = Window.partitionBy(*keys, "from_bank", "from_account").orderBy(F.desc("cost"), "to_bank", "to_account")
    rank = F.row_number().over(order).alias("rank")
    return edges.join(hubs, [*keys, "to_bank", "to_account"]).select(*keys, *EDGE, rank).filter(F.col("rank") <= n)


def overlapping(edges: DataFrame, k: int, *keys: str, hub_chains: int = HUB_CHAINS, counted: bool = True) -> DataFrame:
    """Pairs of accounts with at least k middles, from distinct edges: PAIR and how many.

    counted: else pairs that have k without the edges left out are not looked up any further,
    and middles is a lower bound that is k at least.
    """
    dropped = left_out(edges, hubs(edges, hub_chains, *keys), k - 1, *keys)
    # outer joins, as a semi or anti join would be pushed below the distinct edges and make them again
    kept = edges.join(dropped, [*keys, *EDGE], "left").filter("rank is null")
    found = chains(kept, edges, *keys).groupBy(*keys, *PAIR).agg(F.count("*").alias("middles"))
    asked = found if counted else found.filter(F.col("middles") < k)
    names = dict(zip(EDGE, [*LEFT, "middle_bank", "middle_account"], strict=True)), dict(zip(EDGE, ["middle_bank", "middle_account", *RIGHT], strict=True))
    out, onward = dropped.withColumnsRenamed(names[0]), edges.withColumnsRenamed(names[1])
    more = asked.join(out, [*keys, *LEFT]).join(onward, [*keys, "middle_bank", "middle_account", *RIGHT])
    more = more.groupBy(*keys, *PAIR).agg(F.count("*").alias("more"))
    middles = F.col("middles") + F.coalesce("more", F.lit(0))
    return found.join(more, [*keys, *PAIR], "left").select(*keys, *PAIR, middles.alias("middles")).filter(F.col("middles") >= k)
