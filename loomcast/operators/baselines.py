"""Forecasters with a closed form: mean, random walk, drift, seasonal naive, AR(1), regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.functions import errors
from loomcast.operators.folds import attach_fold_values, test_rows, train_prefix, with_blocks
from loomcast.operators.lag_products import centred
from loomcast.operators.scoring import MODELS
from loomcast.operators.split import CHUNK, windowed



def slope_intercept(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Least squares line from sums; NULL when x does not vary."""
    vx = sxx - sx * sx / n
    slope = (sxy - sx * sy / n) / F.nullif(vx, F.lit(0.0))
    return slope, (sy - slope * sx) / n


def ar1_steps(a: Column, phi: Column, last: Column, steps: Column) -> Column:
    """Value after ``steps`` applications of y -> a + phi y, without a loop."""
    grown = F.pow(phi, steps)
    return F.when(phi == 1.0, last + a * steps).otherwise(a * (1.0 - grown) / (1.0 - phi) + grown * last)


def fold_fits(df: DataFrame, keys: Sequence[str], k: int, min_train: int, *, size: int = CHUNK) -> DataFrame:
    """Everything the closed forms need, per (series, fold), from one pass over the panel."""
    # moments around the level of block 0, which every fold trains on: a high level costs no digits
    level = centred(with_blocks(df, k), keys, ["y"], size=size).withColumn("y", F.col("y") - F.col("mu_y"))
    lagged = windowed(level, keys, lambda w: {"x": F.lag("y", 1).over(w)}, before=1, size=size)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    fits = train_prefix(
        lagged, keys, k,
        {"s_n": F.when(F.col("y").isNotNull(), F.lit(1)), "s_y": F.col("y"), "p_n": F.when(both, F.lit(1)),
         "p_x": x, "p_y": y, "p_xx": x * x, "p_xy": x * y},
        firsts={"y_first": "y", "mu": "mu_y"}, lasts={"y_last": "y"}, min_train=min_train)
    phi, a = slope_intercept(F.col("p_n"), F.col("p_x"), F.col("p_y"), F.col("p_xx"), F.col("p_xy"))
    return fits.select(
        *keys, "fold", "train_size", "test_size",
        (F.col("s_y") / F.col("s_n")).alias("level"), "y_last", "mu",
        ((F.col("y_last") - F.col("y_first")) / (F.col("train_size") - 1)).alias("drift"),
        phi.alias("phi"), a.alias("intercept"))


def seasonal_naive(rows: DataFrame, df: DataFrame, keys: Sequence[str], m: int, name: str) -> DataFrame:
    """Value of the same season in the last m training rows, by an equi join on the position."""
    source = df.select(*keys, F.col("idx").alias("_src"), F.col("y").alias(name))
    return rows.withColumn("_src", F.col("train_size") - m + F.pmod("h", F.lit(m))).join(
        source, [*keys, "_src"], "left").drop("_src")


def forecasts(
    df: DataFrame, keys: Sequence[str], k: int, min_train: int, m: int, *, size: int = CHUNK
) -> DataFrame:
    """Test rows with one forecast column per closed form."""
    rows = test_rows(df.select(*keys, "idx", "n", "y"), k, min_train)
    rows = attach_fold_values(rows, fold_fits(df, keys, k, min_train, size=size), keys, size=size)
    rows = seasonal_naive(rows, df, keys, m, "seasonal_naive")
    step = F.col("h") + 1
    return rows.select(
        *keys, "fold", "idx", "h", "y",
        (F.col("mu") + F.col("level")).alias("mean"),
        (F.col("mu") + F.col("y_last")).alias("random_walk"),
        (F.col("mu") + F.col("y_last") + F.col("drift") * step).alias("drift"),
        "seasonal_naive",
        (F.col("mu") + ar1_steps(F.col("intercept"), F.col("phi"), F.col("y_last"), step)).alias("ar1"))


def long_forecasts(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per forecast, candidates numbered in the order of MODELS."""
    options = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(name).alias("model"),
                                 F.col(name).alias("yhat")) for i, name in enumerate(MODELS)])
    return wide.select(*keys, "fold", "idx", "h", "y", F.inline(options))


def fold_scores(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, candidate, model, fold, mae) of all closed forms: averaged first, then unfolded."""
    means = wide.groupBy(*keys, "fold").agg(*[errors.mae("y", name).alias(name) for name in MODELS])
    options = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(name).alias("model"),
                                 F.col(name).alias("mae")) for i, name in enumerate(MODELS)])
    return means.select(*keys, "fold", F.inline(options))


def regressor_fits(df: DataFrame, keys: Sequence[str], x: str, k: int, min_train: int) -> DataFrame:
    """y on one regressor whose future is known, per (series, fold)."""
    level = centred(with_blocks(df, k), keys, [x, "y"])
    both = F.col(x).isNotNull() & F.col("y").isNotNull()
    u, v = F.when(both, F.col(x) - F.col(f"mu_{x}")), F.when(both, F.col("y") - F.col("mu_y"))
    fits = train_prefix(level, keys, k, {
        "p_n": F.when(both, F.lit(1)), "p_x": u, "p_y": v, "p_xx": u * u, "p_xy": u * v},
        firsts={"mu_x": f"mu_{x}", "mu_y": "mu_y"}, min_train=min_train)
    slope, icpt = slope_intercept(F.col("p_n"), F.col("p_x"), F.col("p_y"), F.col("p_xx"), F.col("p_xy"))
    return fits.select(*keys, "fold", "train_size", "test_size", slope.alias("slope"),
                       (F.col("mu_y") + icpt - slope * F.col("mu_x")).alias("intercept"))
