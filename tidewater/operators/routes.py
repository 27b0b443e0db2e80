"""Several outputs of one scan: each row goes to every route whose predicate it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def routed(df: DataFrame, routes: dict[str, Column], *columns: str) -> DataFrame:
    """(route, and the columns): a row for each predicate that holds, all judged in one pass."""
    met = F.array_compact(F.array(*[F.when(predicate, F.lit(name)) for name, predicate in routes.items()]))
    return df.select(F.explode(met).alias("route"), *columns)


def written(rows: DataFrame, path: str) -> dict[str, DataFrame]:
    """Rows of each route as a table, from one write; a table's scan reads its own files alone."""
    rows.write.partitionBy("route").parquet(path)
    spark: SparkSession = rows.sparkSession
    table = spark.read.schema(rows.schema).parquet(path)
    return _Routes(table)


class _Routes(dict):
    """Tables by route; a route that no row took is empty."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.table.filter(F.col("route") == name).drop("route")
        return self[name]
