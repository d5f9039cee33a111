"""Table sources and sinks with explicit schemas."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with header and a declared schema; ``columns`` limits what the scan parses."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_panel(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> str:
    """Parquet laid out by a hash bucket of the series, so later reads can skip buckets."""
    (
        df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        .repartition("bucket", F.floor(F.col("idx") / (1 << 20)) if "idx" in df.columns else F.lit(0))
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )
    return path


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal dimension as a local relation, so that the planner knows its size."""
    names = [c.strip().split()[0] for c in schema.replace(":", " ").split(",")]
    kinds = [c.strip().split()[1] for c in schema.replace(":", " ").split(",")]
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {k})" for v, k in zip(row, kinds)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def date_spine(df: DataFrame, lo: str, hi: str, *, name: str = "ds", step: str = "1 day") -> DataFrame:
    """One row per period between two date columns of each row, with a running number from 1."""
    keep = [c for c in df.columns if c not in (lo, hi)]
    dates = F.expr(f"sequence({lo}, {hi}, interval {step})")
    return df.select(*keep, F.posexplode(dates).alias("_p", name)).select(
        *keep, name, (F.col("_p") + 1).alias("day_nr"))


def grid(values: dict[str, Sequence], keep=None) -> list[dict]:
    """All combinations of the parameter lists in declared order, numbered by position."""
    combos = [dict(zip(values, c)) for c in itertools.product(*values.values())]
    return [c for c in combos if keep is None or keep(c)]


def grid_column(values: dict[str, Sequence], types: dict[str, str]) -> Column:
    """The combinations as one array-of-structs literal: explode it instead of a cross join."""
    entries = [{"candidate": no, **combo} for no, combo in enumerate(grid(values))]
    fields = ", ".join(f"{k}: {t}" for k, t in {"candidate": "int", **types}.items())
    return F.from_json(F.lit(json.dumps(entries)), f"array<struct<{fields}>>")
