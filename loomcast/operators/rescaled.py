"""Searches on differenced series whose forecasts come back on the original scale."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomcast.operators import solvers as sv, windows as wn
from loomcast.operators.recurrence import recurrence
from loomcast.operators.solver_tasks import GridSearch


class DifferencedSearch(GridSearch):
    """``GridSearch`` on first (``d`` times) and seasonal (``D`` times, season ``m``) differences of a panel.

    Scores are on the differences. The search knows how it differenced: with w = (1 - B)^d (1 - B^m)^D y, the forecasts
    y are the recurrence y_t = w_t minus the polynomial's other terms, started from the last actual values before
    each fold's test block. One inversion serves all orders, seasonal recursion included. From an unknown forecast
    on, a path is NULL; so is one whose starting values are not all known.
    """

    def __init__(self, series: DataFrame, keys: Sequence[str], cols: Sequence[str], candidates: list[dict], spec: dict, k: int,
                 min_train: int = 0, *, d: int = 0, D: int = 0, m: int = 1, **options):
        self.series, self.poly = series, sv.difference_polynomial(d, D, m)
        diff = series
        for _ in range(d):
            diff = wn.difference(diff, keys, cols)
        for _ in range(D):
            diff = wn.difference(diff, keys, cols, m)
        super().__init__(diff, keys, cols, candidates, spec, k, min_train, **options)

    def forecasts(self, chosen: DataFrame) -> DataFrame:
        """(keys, fold, h, idx, candidate, yhat) on the original scale; ``idx`` is the position in the series."""
        return self._original(super().forecasts(chosen))

    def future(self, chosen: DataFrame, steps: int, known: DataFrame | None = None) -> DataFrame:
        return self._original(super().future(chosen, steps, known))

    def _original(self, paths: DataFrame) -> DataFrame:
        by, lost = [*self.keys, "fold"], len(self.poly) - 1
        block = F.floor(F.col("n") / (self.k + 1))
        ends = self.df.filter("idx = 0").select(*self.keys, "n", F.explode(F.sequence(F.lit(0), F.lit(self.k))).alias("fold")) \
            .select(*by, (F.col("n") - (self.k - F.col("fold")) * block).cast("bigint").alias("_train"))
        placed = paths.join(ends, by)
        if not lost:
            return placed.select(*by, "h", (F.col("_train") + F.col("h")).alias("idx"), "candidate", "yhat")
        # the last values before the forecasts, as inputs that the recurrence turns into themselves
        value = F.col(self.cols[0]).cast("double")
        origin = placed.groupBy(*by).agg(F.max("_train").alias("_train")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(lost - 1))))
        start = origin.withColumn("idx", F.col("_train") + F.col("_p")).join(
            self.series.select(*self.keys, "idx", value.alias("_v")), [*self.keys, "idx"]) \
            .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_s")).withColumn("_s", F.col("_s._v"))
        poly = F.array(*[F.lit(float(x)) for x in self.poly])
        inputs = F.transform("_s", lambda _, p: F.aggregate(
            F.sequence(F.lit(0), p), F.lit(0.0), lambda acc, i: acc + F.get(poly, i) * F.get("_s", p - i)))
        first = start.select(*by, F.posexplode(inputs).alias("_at", "_b")).select(
            *by, F.col("_at").cast("bigint").alias("_at"), "_b", F.lit(None).cast("int").alias("candidate"), F.lit(None).cast("bigint").alias("_train"))
        rows = first.unionByName(placed.select(*by, (F.col("h") + lost).cast("bigint").alias("_at"), F.col("yhat").alias("_b"),
                                               F.col("candidate").cast("int").alias("candidate"), "_train"))
        matrix = np.zeros((lost, lost))
        matrix[0] = -self.poly[1:]
        matrix[1:, :-1] = np.eye(lost - 1)
        states = {f"_y{i}": F.coalesce(F.col("_b"), F.lit(0.0)) if i == 0 else F.lit(0.0) for i in range(lost)}
        back = recurrence(rows, by, matrix.tolist(), states, idx="_at", size=self.size)
        unknown = rows.filter(F.col("_b").isNull()).groupBy(*by).agg(F.min("_at").alias("_gone"))
        return back.filter(F.col("_at") >= lost).join(unknown, by, "left").select(
            *by, (F.col("_at") - lost).alias("h"), (F.col("_train") + F.col("_at")).alias("idx"), "candidate",
            F.when(F.col("_gone").isNull() | (F.col("_at") < F.col("_gone")), F.col("_y0")).alias("yhat"))
