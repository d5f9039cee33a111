"""Scores per fold, means over folds, best candidate and the result table of all models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomcast.functions import errors

# the closed forms, numbered in this order
MODELS = ["mean", "random_walk", "drift", "seasonal_naive", "ar1"]


def pair(pred: DataFrame, actual: DataFrame, keys: Sequence[str], on: Sequence[str] = ("idx",)) -> DataFrame:
    """Forecasts next to actual values by key."""
    return pred.join(actual, [*keys, *on])


def align_to_actuals(actual: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The whole series with forecasts where they exist and NULL elsewhere."""
    return actual.join(pred, [*keys, "idx"], "left")


def fold_scores(pairs: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pairs.groupBy(*by, "fold").agg(errors.mae(y, yhat).alias("mae"))


def candidate_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over folds and score of the last fold; a fold without score voids the mean, so does a series without folds."""
    return scores.groupBy(*by).agg(
        F.when(F.count("mae") == F.count(F.lit(1)), F.avg("mae")).alias("mean_mae"),
        F.max_by("mae", "fold").alias("last_mae"),
        F.count("fold").alias("folds"),
    )


def selection_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Like ``candidate_scores`` with the last fold kept out of the mean that selects.

    A candidate chosen by its mean over all folds is judged on what it was chosen by; here
    ``mean_mae`` selects and ``holdout_mae`` judges. ``by`` ends with the candidate column(s);
    all candidates of a series share its folds.
    """
    seen = scores.groupBy(*by).agg(
        F.max_by("mae", "fold").alias("holdout_mae"), F.max("fold").alias("last_fold"),
        F.sum("mae").alias("_sum"), F.count("mae").alias("_known"), F.count(F.lit(1)).alias("folds"))
    return seen.select(
        *by,
        F.when((F.col("_known") == F.col("folds")) & (F.col("folds") > 1),
               (F.col("_sum") - F.col("holdout_mae")) / (F.col("folds") - 1)).alias("mean_mae"),
        "holdout_mae", "folds")


def without_folds(df: DataFrame, keys: Sequence[str], k: int, min_train: int) -> DataFrame:
    """Keys of the series of which no fold trains on more than ``min_train`` rows, also for want of periods."""
    block = F.floor(F.col("n") / (k + 1))
    return df.filter((F.col("idx") == 0) & ((block == 0) | (F.col("n") - block <= min_train))).select(*keys)


def with_short(scores: DataFrame, df: DataFrame, keys: Sequence[str], k: int, min_train: int) -> DataFrame:
    """Fold scores with a row per candidate, without fold and score, for every series that has no fold."""
    few = without_folds(df, keys, k, min_train)
    names = [c for c in scores.columns if c not in (*keys, "fold", "mae")]
    models = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(m).alias("model")) for i, m in enumerate(MODELS)])
    rows = few.select(*keys, F.inline(models))
    return scores.unionByName(rows.select(
        *keys, *names, F.lit(None).cast(scores.schema["fold"].dataType).alias("fold"), F.lit(None).cast("double").alias("mae")))


def best_candidate(scores: DataFrame, keys: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """Lowest mean MAE, missing scores last, the first candidate wins a tie; NULL when all failed.

    An aggregate instead of a ranking window: it combines map-side and sorts nothing.
    """
    rank = F.struct(F.coalesce(F.col("mean_mae"), F.lit(float("inf"))).alias("m"), F.col(candidate).alias("c"))
    rest = [c for c in scores.columns if c not in keys]
    best = scores.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("b"))
    out = best.select(*keys, "b.*")
    return out.withColumn(candidate, F.when(F.col("mean_mae").isNotNull(), F.col(candidate)))


def result_table(models: dict[str, DataFrame], digits: int = 3, second_digits: int = 3) -> DataFrame:
    """One row per model (and series): mean MAE, seconds, last MAE, rounded.

    ``models`` maps a label to a frame with mean_mae, last_mae and optionally seconds.
    """
    out = None
    for label, df in models.items():
        seconds = F.col("seconds") if "seconds" in df.columns else F.lit(None).cast("double")
        keys = [c for c in df.columns if c not in ("mean_mae", "last_mae", "seconds", "folds", "candidate")]
        part = df.select(
            *keys, F.lit(label).alias("model"),
            F.round("mean_mae", digits).alias("mean_mae"),
            F.round(seconds, second_digits).alias("seconds"),
            F.round("last_mae", digits).alias("last_mae"))
        out = part if out is None else out.unionByName(part)
    return out
