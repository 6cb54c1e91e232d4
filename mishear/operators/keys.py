"""Steps on whole DataFrames that keys need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mishear.functions import text as t


def compatible(df: DataFrame, column: str) -> DataFrame:
    """``column`` in NFKC."""
    return df.withColumn(column, t.compatible(F.col(column)))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; unlike dropDuplicates, in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], n: int, *order, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
