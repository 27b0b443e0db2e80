"""Result files: one folder for each query, with a header and amounts of two decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.exprs import format_amount
from tidewater.schema import RESULT_HEADERS


def shown(df: DataFrame, query: str) -> DataFrame:
    """A result as its file shows it: strings under the header's names."""
    texts = [format_amount(F.col(f"`{c}`")) if kind == "double" else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes]
    return df.select([c.alias(h) for c, h in zip(texts, RESULT_HEADERS[query], strict=True)])


def lines(df: DataFrame, query: str) -> DataFrame:
    """A result's lines without the header, as line."""
    return shown(df, query).select(F.concat_ws(",", *[f"`{h}`" for h in RESULT_HEADERS[query]]).alias("line"))


def write_result(df: DataFrame, query: str, path: str, single_file: bool = False, ordered: bool = False) -> None:
    """Writes a result as CSV; single_file for results that one reader takes whole, ordered by
    all columns from the first on, byte by byte, over the files in the order of their names."""
    out = shown(df, query)
    if ordered:
        out = out.orderBy(*[f"`{h}`" for h in RESULT_HEADERS[query]])
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)
