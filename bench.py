"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from loomcast.operators import baselines as bl, scoring as so, trend as tr, windows as wn
from loomcast.operators.solver_tasks import GridSearch
from loomcast.plans import QUERIES, panels as P
from loomcast.plans.models import ARMA, PDQ
from loomcast.session import local_session

K = P.K
FOLDS, MIN_TRAIN = 5, 20


def parts_grid(spark, sf):
    search = GridSearch(P.parts_monthly(spark, sf), K, ["y"], PDQ, ARMA, FOLDS, MIN_TRAIN)
    return so.best_candidate(search.scores(), K)


def parts_closed_forms(spark, sf):
    per_fold = bl.fold_scores(bl.forecasts(P.parts_monthly(spark, sf), K, FOLDS, MIN_TRAIN, 12), K)
    return so.best_candidate(so.candidate_scores(per_fold, ["series_id", "candidate", "model"]), K)


def parts_additive(spark, sf):
    pred = tr.additive_forecasts(P.parts_monthly(spark, sf), K, FOLDS, MIN_TRAIN, 12,
                                 tr.scale_grid([0.01, 0.1, 1, 10]), knots=4, order=2)
    by = ["series_id", "candidate"]
    return so.best_candidate(so.candidate_scores(so.fold_scores(pred, by), by), K)


BENCH = {
    "densify_wide_panel": lambda s, d: P.parts_monthly(s, d),
    "stationarity_wide_panel": lambda s, d: wn.stationarity_report(P.parts_monthly(s, d), K, "y"),
    "seasonal_difference_wide_panel": lambda s, d: wn.difference(P.parts_monthly(s, d), K, ["y"], 12),
    "calendar_lag_join": QUERIES["join7_lag_by_calendar_key"],
    "closed_forms_wide_panel": parts_closed_forms,
    "arima_75_orders_wide_panel": parts_grid,
    "additive_4_scales_wide_panel": parts_additive,
    "seasonal_naive_monthly": QUERIES["val10_model_comparison"],
    "arima_75_orders_monthly": QUERIES["fc4_arima_grid_best"],
    "seasonal_arima_324_orders_hourly": QUERIES["fc5_seasonal_arima_grid"],
    "vector_arma_25_orders_monthly": QUERIES["fc6_vector_arma_grid"],
    "additive_42_scales_monthly": QUERIES["fc8_additive_two_scales"],
    "window_regressor_hourly": QUERIES["fc12_window_regressor"],
    "autocorrelation_hourly": QUERIES["dia1_autocorrelation"],
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # start the JVM's and the Python workers' engines before the clock
    P.orders_monthly(spark, sf).mapInArrow(lambda it: it, "series_id string, pos bigint, idx bigint, n bigint, y double").count()
    times = {}
    for name, run in BENCH.items():
        start = time.perf_counter()
        run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    series = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().count()
    fits = series * len(PDQ) * 4
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else sf,
        "candidate_fits": fits, "candidate_fits_per_second": round(fits / times["arima_75_orders_wide_panel"]),
    }))


if __name__ == "__main__":
    main()
