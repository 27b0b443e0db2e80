"""Scalar functions, all as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency names and their ISO codes (fixed values).
CURRENCY_ISO = {
    "US Dollar": "USD", "Euro": "EUR", "Australian Dollar": "AUD", "Brazil Real": "BRL", "Canadian Dollar": "CAD",
    "Swiss Franc": "CHF", "Yuan": "CNY", "UK Pound": "GBP", "Shekel": "ILS", "Rupee": "INR", "Yen": "JPY",
    "Mexican Peso": "MXN", "Ruble": "RUB", "Saudi Riyal": "SAR", "Bitcoin": "BTC",
}


def normalize_bank(bank: Column) -> Column:
    """A bank id without leading zeros; all zeros, and nothing, become 0."""
    return F.coalesce(F.nullif(F.regexp_replace(bank, "^0+", ""), F.lit("")), F.lit("0"))


def parse_ts(text: Column) -> Column:
    """The minute of YYYY/MM/DD HH:MM, whatever follows; null if it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz")


def parse_amount(text: Column) -> Column:
    """A finite double; null for anything else."""
    value = text.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def parse_laundering(text: Column) -> Column:
    """True where the text begins with 1."""
    return F.substring(text, 1, 1) == "1"


def currency_iso(name: Column) -> Column:
    """The ISO code of a currency name; null for unknown names."""
    table = F.create_map(*[F.lit(x) for pair in CURRENCY_ISO.items() for x in pair])
    return F.element_at(table, name)


def date_key(ts: Column) -> Column:
    return F.to_date(ts)


def format_amount(amount: Column) -> Column:
    """Two decimals, as result files have them: of the number's exact binary value, halves to
    the even digit. (Java's own format rounds the shortest decimal that stands for the number, so
    that 1.005, which is less than that, would become 1.01.)

    Below 2^53 the whole part and the rest are apart exactly. A hundred times the rest is the
    sum of a hundred times its first 26 bits and a hundred times the others, both exact; so is
    the distance of the first from half a cent, with which the second is compared. Greater
    numbers are whole: up to 2^126 in two parts, beyond that as Java has them.
    """
    amount = amount.cast("double")
    value = F.abs(amount)
    whole = F.floor(F.when(value < 2.0**53, value))
    rest = value - whole
    first = F.floor(rest * 2.0**26) / F.lit(2.0**26)
    high, low = first * 100, (rest - first) * 100
    cents = F.floor(high)
    gap = F.lit(0.5) - (high - cents)
    up = (low > gap) | ((low == gap) & (cents % 2 == 1))
    total = whole * 100 + cents + up.cast("bigint")
    digits = F.when(total < 100, F.lpad(total.cast("string"), 3, "0")).otherwise(total.cast("string"))
    exact = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))
    great = F.when(value.between(2.0**53, 2.0**126), value)
    upper = F.floor(great / 2.0**63)
    two63 = F.lit(Decimal(2**63)).cast("decimal(19,0)")
    parts = upper.cast("decimal(19,0)") * two63 + F.floor(great - upper * 2.0**63).cast("decimal(19,0)")
    sign = F.when(amount.cast("string").startswith("-"), "-").otherwise("")
    shown = F.when(value < 2.0**53, exact).when(value < 2.0**126, F.concat(parts.cast("string"), F.lit(".00"))).otherwise(F.format_string("%.2f", value))
    return F.when(F.isnan(amount), "NaN").when(amount.isNotNull(), F.concat(sign, shown))


def within(ts: Column, period: tuple[str, str], inclusive_end: bool = False) -> Column:
    """Whether a time lies in [start, end), or in [start, end] with inclusive_end."""
    start, end = (F.lit(x).cast("timestamp_ntz") for x in period)
    return (ts >= start) & ((ts <= end) if inclusive_end else (ts < end))


def raw_within(raw: Column, period: tuple[str, str]) -> Column:
    """Whether a time as files have it lies in [start, end] as a string, byte by byte: a time
    of the end's day is greater than the day alone."""
    return (raw >= F.lit(period[0])) & (raw <= F.lit(period[1]))


def slashed_date(text: Column) -> Column:
    """A date with slashes in place of hyphens, as files have it."""
    return F.translate(text, "-", "/")


def day_of(raw: Column) -> Column:
    """The day of a time as files have it: what stands before the first blank."""
    return F.get(F.split(raw, " ", 2), F.lit(0))


def listed(text: Column, separator: str) -> Column:
    """The parts of a list in a setting, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"\Q" + separator + r"\E"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x != "")
