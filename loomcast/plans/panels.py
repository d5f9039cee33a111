"""The series that the queries work on, as Spark panels and as SQL texts with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcast.functions.scalars import nan_to_null
from loomcast.sources.series import panel
from loomcast.sources.tables import read_table

K = ["series_id"]


def orders_monthly(spark: SparkSession, sf: str, fill: float | None = 0.0) -> DataFrame:
    """order value per priority and month."""
    df = read_table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "series_id")
    return panel(df, K, "o_orderdate", "month", {"y": F.sum(nan_to_null("o_totalprice"))}, fill=fill)


def orders_monthly_pair(spark: SparkSession, sf: str) -> DataFrame:
    """order value and number of orders."""
    df = read_table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "series_id")
    return panel(df, K, "o_orderdate", "month",
                 {"y": F.sum(nan_to_null("o_totalprice")), "x": F.count("o_orderkey").cast("double")})


def lineitem_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """line value per return flag and status."""
    df = read_table(spark, sf, "lineitem").withColumn(
        "series_id", F.concat("l_returnflag", F.lit("-"), "l_linestatus"))
    return panel(df, K, "l_shipdate", "month", {"y": F.sum(nan_to_null("l_extendedprice"))})


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """event value per type and hour."""
    df = read_table(spark, sf, "events").withColumnRenamed("event_type", "series_id")
    return panel(df, K, "ts", "hour", {"y": F.sum(nan_to_null("value"))})


def events_daily(spark: SparkSession, sf: str) -> DataFrame:
    """F3d: event value per type and day."""
    df = read_table(spark, sf, "events").withColumnRenamed("event_type", "series_id")
    return panel(df, K, "ts", "day", {"y": F.sum(nan_to_null("value"))})


def parts_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """quantity per part, the wide panel (one series per part)."""
    df = read_table(spark, sf, "lineitem").withColumn("series_id", F.col("l_partkey"))
    return panel(df, K, "l_shipdate", "month", {"y": F.sum(nan_to_null("l_quantity"))})


def _panel_sql(table: str, key: str, time: str, step: str, aggs: dict[str, str], drop: int) -> str:
    if step == "month":
        pos = f"(year({time}) * 12 + month({time}) - 1)"
    elif step == "day":
        pos = f"date_diff('day', DATE '1970-01-01', CAST({time} AS DATE))"
    else:
        pos = f"(date_diff('day', DATE '1970-01-01', CAST({time} AS DATE)) * 24 + hour({time}))"
    sums = ", ".join(f"{a} AS {name}" for name, a in aggs.items())
    filled = ", ".join(f"coalesce(c.{name}, 0.0) AS {name}" for name in aggs)
    return (
        f"cells AS (SELECT {key} AS series_id, CAST({pos} AS BIGINT) AS pos, {sums} FROM {table} GROUP BY 1, 2), "
        f"edge AS (SELECT min(pos) AS lo, max(pos) - {drop} AS hi FROM cells), "
        "spine AS (SELECT s.series_id, e.lo, e.hi, unnest(range(e.lo, e.hi + 1)) AS pos "
        "FROM (SELECT DISTINCT series_id FROM cells) s CROSS JOIN edge e), "
        "panel AS (SELECT p.series_id, p.pos, p.pos - p.lo AS idx, p.hi - p.lo + 1 AS n, "
        f"{filled} FROM spine p LEFT JOIN cells c ON c.series_id = p.series_id AND c.pos = p.pos)"
    )


F1 = _panel_sql("orders", "o_orderpriority", "o_orderdate", "month", {"y": "sum(o_totalprice)"}, 0)
F4 = _panel_sql("orders", "o_orderpriority", "o_orderdate", "month",
                {"y": "sum(o_totalprice)", "x": "CAST(count(o_orderkey) AS DOUBLE)"}, 0)
F2 = _panel_sql("lineitem", "l_returnflag || '-' || l_linestatus", "l_shipdate", "month",
                {"y": "sum(l_extendedprice)"}, 0)
F3 = _panel_sql("events", "event_type", "ts", "hour", {"y": "sum(value)"}, 0)
F3D = _panel_sql("events", "event_type", "ts", "day", {"y": "sum(value)"}, 0)
F5 = _panel_sql("lineitem", "l_partkey", "l_shipdate", "month", {"y": "sum(l_quantity)"}, 0)


# Means of cent values often lie exactly half way between two rounded values; which side they
# fall on would be decided by the order of summation. Both engines add the same small nudge.

def r(expr: str, digits: int = 4) -> str:
    """SQL: round, with ties decided by a nudge and -0.0 turned into 0.0."""
    return f"(round({expr} + 1e-{digits + 3}, {digits}) + 0.0)"


def rnd(col, digits: int = 4):
    """Spark counterpart of :func:`r`."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)
