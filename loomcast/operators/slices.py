"""First and last rows, trimming and labels; all arithmetic on idx and n, no sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def head(df: DataFrame, rows: int) -> DataFrame:
    return df.filter(F.col("idx") < rows)


def tail(df: DataFrame, rows: int) -> DataFrame:
    return df.filter(F.col("idx") >= F.col("n") - rows)


def drop_tail(df: DataFrame, rows: int) -> DataFrame:
    """Without the last rows of each series (incomplete periods); n follows."""
    return df.filter(F.col("idx") < F.col("n") - rows).withColumn("n", F.col("n") - rows)


def label_test(df: DataFrame, rows: int, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, F.col("idx") >= F.col("n") - rows)
