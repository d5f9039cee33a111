"""Windows over series of any length, without sending one series to one task.

``Window.partitionBy(series)`` puts a whole series into a single task. A panel may hold one
series with a third of all rows, so every window here partitions by ``(series, chunk)``,
``chunk = idx div size``. A bounded frame needs a few rows of the neighbour chunks: those rows
are copied (``before``/``after`` rows per chunk border) and dropped again after the window.
An unbounded frame is a running value inside the chunk plus a value carried over from a chunk
table, which has one row per chunk. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK = 1 << 16


def chunk_of(idx: str = "idx", size: int = CHUNK) -> Column:
    return F.floor(F.col(idx) / F.lit(size)).cast("bigint")


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    make: Callable[[WindowSpec], dict[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    idx: str = "idx",
    size: int = CHUNK,
) -> DataFrame:
    """Add the columns of ``make(window)``; frames reach at most ``before``/``after`` rows of idx."""
    last = F.floor((F.col(idx) + before) / F.lit(size)).cast("bigint")
    first = F.floor(F.greatest(F.col(idx) - after, F.lit(0)) / F.lit(size)).cast("bigint")
    rows = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    new = make(w)
    return (
        rows.select(*df.columns, "_chunk", *[c.alias(name) for name, c in new.items()])
        .filter(F.col("_chunk") == chunk_of(idx, size))
        .drop("_chunk")
    )


def with_series_totals(
    df: DataFrame,
    keys: Sequence[str],
    totals: dict[str, tuple[Column, str]],
    *,
    idx: str = "idx",
    size: int = CHUNK,
) -> DataFrame:
    """Attach per-series totals to every row.

    ``totals`` maps a name to (aggregate per chunk, 'sum' | 'min' | 'max' to combine chunks).
    The join key is (series, chunk): a long series is spread over many tasks.
    """
    rows = df.withColumn("_chunk", chunk_of(idx, size))
    table = rows.groupBy(*keys, "_chunk").agg(*[a.alias(k) for k, (a, _) in totals.items()])
    whole = Window.partitionBy(*keys)
    table = table.select(
        *keys, "_chunk", *[getattr(F, how)(k).over(whole).alias(k) for k, (_, how) in totals.items()]
    )
    return rows.join(table, [*keys, "_chunk"]).select(*df.columns, *totals)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    *,
    idx: str = "idx",
    size: int = CHUNK,
) -> DataFrame:
    """Sum from the first row of the series to the current row, for each named column."""
    rows = df.select("*", chunk_of(idx, size).alias("_chunk"),
                     *[c.alias(f"_v_{k}") for k, c in sums.items()])
    table = rows.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{k}").alias(f"_c_{k}") for k in sums])
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, "_chunk", *[F.sum(f"_c_{k}").over(prior).alias(f"_c_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(table, [*keys, "_chunk"]).select(
        *df.columns,
        *[(F.sum(f"_v_{k}").over(inside) + F.coalesce(F.col(f"_c_{k}"), F.lit(0.0))).alias(k)
          for k in sums],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "rn"
) -> DataFrame:
    """1-based position of irregular rows. ``bucket`` must not fall when ``order`` rises."""
    rows = df.withColumn("_bucket", bucket)
    table = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    prior = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, "_bucket", F.coalesce(F.sum("_m").over(prior), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return rows.join(table, [*keys, "_bucket"]).select(
        *df.columns, (F.row_number().over(inside) + F.col("_off")).cast("bigint").alias(name)
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, column: str, bucket: Column, name: str | None = None
) -> DataFrame:
    """Last known value at or before each row; ``bucket`` must not fall when ``order`` rises."""
    name = name or f"{column}_filled"
    rows = df.withColumn("_bucket", bucket)
    known = F.when(F.col(column).isNotNull(), F.col(order))
    table = rows.groupBy(*keys, "_bucket").agg(F.max_by(column, known).alias("_last"))
    prior = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(table, [*keys, "_bucket"]).select(
        *df.columns,
        F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_carry")).alias(name),
    )
