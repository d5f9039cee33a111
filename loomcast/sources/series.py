"""Raw event tables to gap-free panels."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.functions.calendar import position
from loomcast.operators.split import CHUNK
from loomcast.session import shared_dir


def cells(df: DataFrame, keys: Sequence[str], time: str, step: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per (series, calendar period) that has data; partial aggregation runs map-side.

    Rows without a key or a time belong to no series. The filter is written out because the
    join in ``densify`` would infer it on one side only, and the scan could not be shared.
    """
    known = F.col("pos").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = df.withColumn("pos", position(time, step)).filter(known).groupBy(*keys, "pos").agg(
        *[a.alias(name) for name, a in aggs.items()]
    )
    # true for every row: a branch that needs no values would prune them and scan the table for itself
    return out.filter(F.hash(*aggs) % 2 < 2)


def densify(
    obs: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    fill: float | None = 0.0,
    drop_last: int = 0,
    bounds: str = "panel",
    size: int = CHUNK,
) -> DataFrame:
    """Left join a calendar spine so that every period of a series has a row.

    ``bounds='panel'``: all series share the first and last period of the panel;
    ``'series'``: each its own. ``drop_last`` leaves out incomplete last periods.
    Output: keys, pos, idx (0-based), n (series length), values (gaps = ``fill``).
    A series whose values are all missing keeps its rows.
    The spine is spread by (series, chunk) before it is exploded to single periods, into a
    stated number of partitions: these rows are few, but each becomes up to ``size`` rows, so
    their bytes say nothing about the work to come.
    """
    spread = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = obs.groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    if bounds == "panel":
        edge = span.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        span = span.select(*keys, edge.select("lo").scalar().alias("lo"),
                           edge.select("hi").scalar().alias("hi"))
    spine = (
        span.select(*keys, "lo", (F.col("hi") - F.col("lo") + 1 - drop_last).alias("n"))
        .filter("n > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size))))
        .repartition(spread, *keys, "chunk")
        .withColumn("idx", F.explode(F.sequence(
            F.col("chunk") * size, F.least((F.col("chunk") + 1) * size, F.col("n")) - 1)))
        .select(*keys, (F.col("lo") + F.col("idx")).alias("pos"), "idx", "n")
    )
    filled = [F.col(v) if fill is None else F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values]
    return spine.join(obs, [*keys, "pos"], "left").select(*keys, "pos", "idx", "n", *filled)


def panel(
    df: DataFrame, keys: Sequence[str], time: str, step: str, aggs: dict[str, Column], **densify_options
) -> DataFrame:
    """``cells`` + ``densify``."""
    return densify(cells(df, keys, time, step, aggs), keys, list(aggs), **densify_options)


def stored(df: DataFrame) -> DataFrame:
    """Write a panel to the shared folder and read it back (an action).

    For jobs that use a panel several times: later branches read the cells instead of joining
    the spine again, and a lost executor costs only its own reads.
    """
    path = f"{shared_dir(df.sparkSession)}/panel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
