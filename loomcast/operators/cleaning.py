"""Filters, reshapes, keyed attachment and patching of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from the value; a missing value differs from it."""
    return df.filter((F.col(column) != F.lit(value)) | F.col(column).isNull())


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_all_missing_periods(df: DataFrame, period: str, value: str) -> DataFrame:
    """Keep the periods where at least one series has a value (wide form: drop empty columns).

    The list of such periods is aggregated first, so a period with many series is never
    gathered; the semi join is broadcast only if Spark finds the list small.
    """
    seen = df.filter(F.col(value).isNotNull()).select(period).distinct()
    return df.join(seen, period, "left_semi")


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def long_to_wide(df: DataFrame, row: Sequence[str], column: str, names: Sequence, value: str, other: str | None = None) -> DataFrame:
    """One column per name, in one aggregation. A cell with two values is an error; ``other`` sums what has no column."""
    def cell(name) -> Column:
        own = F.when(F.col(column) == F.lit(name), F.col(value))
        two = F.raise_error(F.concat(F.lit(f"two values of {column} = "), F.lit(str(name)).cast("string")))
        return F.when(F.count(own) > 1, two.cast(df.schema[value].dataType)).otherwise(F.max(own)).alias(str(name))

    cells = [cell(n) for n in names]
    if other is not None:
        known = F.coalesce(F.col(column).isin(list(names)), F.lit(False))
        cells.append(F.sum(F.when(~known, F.col(value))).alias(other))
    return df.groupBy(*row).agg(*cells)


def column_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The sorted distinct values that become columns of a wide table; more than ``most`` are an error, not a cut."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column} for a wide table")
    return sorted(found)


def column_means(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "mean") -> DataFrame:
    """Mean of every column over all rows, one output row per column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], list(columns), name, value)


def attach_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Match two series by calendar key, never by row position."""
    return left.join(right, list(keys), "inner")


def attach_dimension(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Equi join with a dimension; Spark broadcasts it only while its measured size allows.

    A row without an entry keeps its place, with NULL in the dimension's columns.
    """
    return df.join(dim, key, "left")


def members(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the dimension: a membership filter, as a step of its own."""
    return df.join(dim.select(key), key, "left_semi")


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Union by name; columns that the extra rows lack become NULL."""
    return df.unionByName(extra, allowMissingColumns=True)


def label_split(df: DataFrame, time: Column, cut: Column, name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(time < cut, "train").otherwise("test"))


def hash_split(df: DataFrame, key: str, tenths: int = 7, name: str = "split") -> DataFrame:
    """Repeatable random hold-out split: the first 24 bits of md5(key) decide."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("bigint") % 10
    return df.withColumn(name, F.when(draw < tenths, "train").otherwise("test"))
