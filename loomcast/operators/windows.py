"""Differencing, rolling statistics, inversion, alignment and sliding samples on panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from loomcast.operators.recurrence import recurrence
from loomcast.operators.split import CHUNK, running_sum, windowed, with_series_totals


def _shorten(df: DataFrame, lost: int) -> DataFrame:
    """Leave out the first rows of each series and number the rest from 0 again."""
    return (
        df.filter(F.col("idx") >= lost)
        .withColumn("idx", F.col("idx") - lost)
        .withColumn("n", F.col("n") - lost)
    )


def difference(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lag: int = 1, *, size: int = CHUNK
) -> DataFrame:
    """y_t - y_{t-lag}; ``lag`` = 1 is the first, ``lag`` = season length the seasonal difference."""
    out = windowed(
        df, keys, lambda w: {f"_d_{c}": F.col(c) - F.lag(c, lag).over(w) for c in cols},
        before=lag, size=size)
    new = out.select(*[F.col(f"_d_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    return _shorten(new, lag)


def second_difference(df: DataFrame, keys: Sequence[str], col: str, *, size: int = CHUNK) -> DataFrame:
    """y_t - 2 y_{t-1} + y_{t-2}."""
    out = windowed(
        df, keys,
        lambda w: {"_d": F.col(col) - 2 * F.lag(col, 1).over(w) + F.lag(col, 2).over(w)},
        before=2, size=size)
    return _shorten(out.drop(col).withColumnRenamed("_d", col).select(*df.columns), 2)


def lag_by_key(df: DataFrame, keys: Sequence[str], col: str, lag: int, name: str) -> DataFrame:
    """The value ``lag`` periods earlier by an equi join on the calendar position.

    Right on gappy data too, where a positional shift would take the wrong row.
    """
    earlier = df.select(*keys, (F.col("pos") + lag).alias("pos"), F.col(col).alias(name))
    return df.join(earlier, [*keys, "pos"], "left")


def lead(df: DataFrame, keys: Sequence[str], col: str, steps: int, name: str, *, size: int = CHUNK) -> DataFrame:
    return windowed(df, keys, lambda w: {name: F.lead(col, steps).over(w)}, after=steps, size=size)


def _full(w: WindowSpec, col: str, n: int, stat) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, stat(col).over(frame))


def rolling(
    df: DataFrame, keys: Sequence[str], col: str, stats: dict[str, tuple[str, int]], *, size: int = CHUNK
) -> DataFrame:
    """Trailing statistics over complete windows only: ``{name: ('mean' | 'std', rows)}``.

    All of them share one exchange and one sort.
    """
    fn = {"mean": F.avg, "std": F.stddev_samp}
    widest = max(n for _, n in stats.values())
    return windowed(
        df, keys, lambda w: {name: _full(w, col, n, fn[how]) for name, (how, n) in stats.items()},
        before=widest - 1, size=size)


def stationarity_report(
    df: DataFrame, keys: Sequence[str], col: str, mean_rows: int = 12, std_rows: int = 12, *, size: int = CHUNK
) -> DataFrame:
    """The series with its rolling mean and rolling standard deviation."""
    return rolling(df, keys, col, {"roll_mean": ("mean", mean_rows), "roll_std": ("std", std_rows)}, size=size)


def exponential_mean(df: DataFrame, keys: Sequence[str], col: str, span: float, name: str, *, size: int = CHUNK) -> DataFrame:
    """Exponentially weighted mean with bias-adjusted weights.

    A row weighs (1 - alpha) to the power of its distance in rows, known or not; missing values have no
    weight. Both sums, of weighted values and of weights, are recurrences over the whole series. NULL before the first value.
    """
    keep = 1.0 - 2.0 / (span + 1.0)
    known = F.col(col).isNotNull().cast("double")
    out = recurrence(df, keys, [[keep, 0.0], [0.0, keep]], {"_sum": F.coalesce(F.col(col).cast("double"), F.lit(0.0)), "_weight": known}, size=size)
    return out.withColumn(name, F.col("_sum") / F.nullif(F.col("_weight"), F.lit(0.0))).drop("_sum", "_weight")


def align_to_threshold(
    df: DataFrame, keys: Sequence[str], col: str, sentinel: float = -1.0, *, size: int = CHUNK
) -> DataFrame:
    """Shift each series left by its number of sentinel rows; ``day`` counts from 1.

    A series that never holds the sentinel keeps all its rows.
    """
    out = with_series_totals(df, keys, {"_n0": (F.count_if(F.col(col) == sentinel), "sum")}, size=size)
    return (
        out.withColumn("day", F.col("idx") + 1 - F.col("_n0"))
        .filter("day >= 1").drop("_n0")
    )


def undo_difference(
    pred: DataFrame, last_actual: DataFrame, keys: Sequence[str], col: str, base: str, name: str,
    *, idx: str = "h", size: int = CHUNK,
) -> DataFrame:
    """last actual value + running sum of the differenced forecasts (rows h = 0, 1, ...).

    The actual value enters the running sum as step -1, so no join by series is needed.
    """
    start = last_actual.select(*keys, F.lit(-1).cast("bigint").alias(idx), F.col(base).cast("double").alias(col))
    steps = pred.unionByName(start, allowMissingColumns=True)
    return _known_so_far(running_sum(steps, keys, {name: F.col(col), "_gaps": _gap(col)}, idx=idx, size=size), name) \
        .filter(F.col(idx) >= 0)


def _gap(col: str) -> Column:
    return F.when(F.col(col).isNull(), 1.0).otherwise(0.0)


def _known_so_far(df: DataFrame, name: str) -> DataFrame:
    """A running value is unknown from its first unknown step on."""
    return df.withColumn(name, F.when(F.col("_gaps") == 0, F.col(name))).drop("_gaps")


def undo_seasonal_difference(
    pred: DataFrame, last_season: DataFrame, keys: Sequence[str], col: str, base: str, name: str, m: int,
    *, size: int = CHUNK,
) -> DataFrame:
    """Recursive inversion: each step adds its difference to the value one season before.

    ``pred``: keys, h, col; ``last_season``: keys, r (0..m-1), base = the last m actual values.
    """
    steps = pred.withColumn("r", F.pmod("h", F.lit(m)).cast("int")).withColumn(
        "_s", F.floor(F.col("h") / m).cast("bigint"))
    start = last_season.select(
        *keys, F.col("r").cast("int").alias("r"), F.lit(-1).cast("bigint").alias("_s"),
        F.col(base).cast("double").alias(col))
    rows = steps.unionByName(start, allowMissingColumns=True)
    out = running_sum(rows, [*keys, "r"], {name: F.col(col), "_gaps": _gap(col)}, idx="_s", size=size)
    return _known_so_far(out, name).filter("_s >= 0").drop("r", "_s")


def undo_against_fixed(pred: DataFrame, actual: DataFrame, keys: Sequence[str], col: str, base: str, name: str, offset: int) -> DataFrame:
    """Forecast + actual value ``offset`` periods earlier (not recursive)."""
    earlier = actual.select(*keys, (F.col("idx") + offset).alias("idx"), F.col(base).alias("_b"))
    return pred.join(earlier, [*keys, "idx"]).withColumn(name, F.col(col) + F.col("_b")).drop("_b")


def samples(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], n_in: int, n_out: int = 1, *, size: int = CHUNK
) -> DataFrame:
    """Sliding supervised samples: ``inputs`` (n_in values) and ``targets`` (the next n_out).

    One column gives arrays of numbers, several give arrays of arrays. Only full samples are kept.
    """
    value = F.col(cols[0]) if len(cols) == 1 else F.array(*cols)
    keyed = df.withColumn("_v", value)

    def make(w):
        back = [F.col("_v") if i == 0 else F.lag("_v", i).over(w) for i in range(n_in - 1, -1, -1)]
        ahead = [F.lead("_v", i).over(w) for i in range(1, n_out + 1)]
        return {"inputs": F.array(*back), "targets": F.array(*ahead)}

    out = windowed(keyed, keys, make, before=n_in - 1, after=n_out, size=size)
    return out.filter((F.col("idx") >= n_in - 1) & (F.col("idx") + n_out < F.col("n"))).select(
        *keys, (F.col("idx") - (n_in - 1)).alias("sample"), "inputs", "targets")
