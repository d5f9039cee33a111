"""Grid-searched models: seasonal and vector ARMA, regressors, additive trend, polynomial, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.operators import diagnostics as dg, scoring as so, slices, trend as tr
from loomcast.operators.folds import test_rows
from loomcast.operators.rescaled import DifferencedSearch
from loomcast.operators.solver_tasks import GridSearch, PooledSearch, arma_grid, with_candidate_parameters
from loomcast.plans import panels as P
from loomcast.plans.panels import r, rnd
from loomcast.plans.registry import query
from loomcast.plans.validation import folds_sql

K = P.K
_TWO = ("(var_pop({u}) * covar_pop({v}, {y}) - covar_pop({u}, {v}) * covar_pop({u}, {y})) "
        "/ (var_pop({u}) * var_pop({v}) - power(covar_pop({u}, {v}), 2))")
ARMA = {"kind": "arma", "long": 4}
PDQ = arma_grid(range(5), range(3), range(5))


def _best(search: GridSearch, digits: int = 2):
    best = search.with_parameters(so.best_candidate(search.scores(), search.keys))
    names = list(search.candidates[0])
    return best.select(*search.keys, "candidate", *names, rnd("mean_mae", digits).alias("mean_mae"),
                       rnd("last_mae", digits).alias("last_mae"), "failed")


def orders_arima(spark, sf) -> GridSearch:
    return GridSearch(P.orders_monthly(spark, sf), K, ["y"], PDQ, ARMA, 5, 20)


@query("fc4_arima_grid_best")
def fc4(spark, sf):
    """75 orders per series, best by mean MAE over the folds."""
    return _best(orders_arima(spark, sf))


@query("fc4_arima_all_scores")
def fc4_all(spark, sf):
    return orders_arima(spark, sf).fold_scores().select(
        "series_id", "candidate", "fold", rnd("mae", 2).alias("mae"), "status")


_AR1_SQL = (
    "l AS (SELECT *, lag(y) OVER (PARTITION BY series_id, fold ORDER BY idx) AS x FROM train), "
    "fit AS (SELECT series_id, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, "
    "max(CASE WHEN idx = train_size - 1 THEN y END) AS y0 FROM l GROUP BY 1, 2), "
    "fc AS (SELECT t.series_id, t.fold, t.y, a * (1 - power(b, h + 1)) / (1 - b) + power(b, h + 1) * y0 AS yhat "
    "FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold)")


def _grid_members_sql():
    return (
        f"WITH {folds_sql(P.F1, 5, 20)}, {_AR1_SQL}, "
        "m AS (SELECT series_id, fold, avg(y) AS level, (max_by(y, idx) - min_by(y, idx)) / (count(*) - 1) AS step, "
        "max_by(y, idx) AS y0 FROM train GROUP BY 1, 2), "
        "a AS (SELECT 0 AS p, 0 AS d, t.series_id, t.fold, abs(y - level) AS e FROM test t JOIN m USING (series_id, fold) "
        "UNION ALL SELECT 0, 1, t.series_id, t.fold, abs(y - y0 - (h + 1) * step) FROM test t JOIN m USING (series_id, fold) "
        "UNION ALL SELECT 1, 0, series_id, fold, abs(y - yhat) FROM fc) "
        f"SELECT p, d, series_id, fold, {r('avg(e)', 2)} AS mae FROM a GROUP BY 1, 2, 3, 4")


@query("fc4_closed_forms_inside_grid", _grid_members_sql())
def fc4_members(spark, sf):
    """(0,0,0), (0,1,0) and (1,0,0) as members of the 75 orders: their scores do not depend on the others."""
    search = orders_arima(spark, sf)
    scores = search.with_parameters(search.fold_scores()).filter("q = 0 and p + d <= 1")
    return scores.select("p", "d", "series_id", "fold", rnd("mae", 2).alias("mae"))


@query("fc4_arima_best_forecast")
def fc4_forecast(spark, sf):
    search = orders_arima(spark, sf)
    best = so.best_candidate(search.scores(), K)
    rows = test_rows(search.df, 5, 20).select("series_id", "fold", "h", "idx", "y")
    return search.forecasts(best).join(rows, ["series_id", "fold", "h"]).select(
        "series_id", "fold", "idx", "candidate", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


def _ar1_sql():
    return (f"WITH {folds_sql(P.F3, 9, 200)}, {_AR1_SQL} "
            f"SELECT series_id, fold, {r('avg(abs(y - yhat))', 4)} AS mae FROM fc GROUP BY 1, 2")


@query("fc4_ar1_by_lag_products", _ar1_sql())
def fc4_ar1(spark, sf):
    """Order (1, 0, 0) through the grid engine; the SQL fits it by plain regression per fold."""
    search = GridSearch(P.events_hourly(spark, sf), K, ["y"], arma_grid([1], [0], [0]), ARMA, 9, 200)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 4).alias("mae"))


_GAPPY = P.F3 + ", gappy AS (SELECT series_id, idx, n, CASE WHEN y >= 60 THEN y END AS y FROM panel)"


@query("fc4_ar1_with_missing_values",
       f"WITH {folds_sql(_GAPPY, 9, 200, 'gappy')}, "
       "l AS (SELECT *, lag(y) OVER (PARTITION BY series_id, fold ORDER BY idx) AS x FROM train), "
       "fit AS (SELECT series_id, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max_by(y, CASE WHEN y IS NOT NULL THEN idx END) AS y0, "
       "max(train_size) - 1 - max(CASE WHEN y IS NOT NULL THEN idx END) AS gone FROM l GROUP BY 1, 2), "
       "fc AS (SELECT t.series_id, t.fold, t.y, a * (1 - power(b, h + 1 + gone)) / (1 - b) + power(b, h + 1 + gone) * y0 AS yhat "
       "FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold) "
       f"SELECT series_id, fold, {r('avg(abs(y - yhat))', 4)} AS mae, 'ok' AS status FROM fc GROUP BY 1, 2")
def fc4_gaps(spark, sf):
    """Hours of little value are unknown: order (1, 0, 0) on the pairs of which both are known."""
    df = P.events_hourly(spark, sf).withColumn("y", F.when(F.col("y") >= 60, F.col("y")))
    search = GridSearch(df, K, ["y"], arma_grid([1], [0], [0]), ARMA, 9, 200, missing=True)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 4).alias("mae"), "status")


@query("fc4_arima_grid_with_missing_values")
def fc4_grid_gaps(spark, sf):
    """36 orders on the panel with unknown hours, best by mean MAE over the folds."""
    df = P.events_hourly(spark, sf).withColumn("y", F.when(F.col("y") >= 60, F.col("y")))
    return _best(GridSearch(df, K, ["y"], arma_grid(range(3), range(2), range(3)), ARMA, 9, 200, missing=True), 4)


@query("fc4_arima_wide_panel")
def fc4_wide(spark, sf):
    """One series per part: orders p, d, q up to 2, 1, 2 for all of them in one job."""
    return _best(GridSearch(P.parts_monthly(spark, sf), K, ["y"], arma_grid(range(3), range(2), range(3)), ARMA, 5, 20), 4)


@query("fc5_seasonal_arima_grid")
def fc5(spark, sf):
    """324 seasonal orders on hourly data, season 24."""
    grid = arma_grid(range(3), range(2), range(3), range(3), range(2), range(3), 24)
    return _best(GridSearch(P.events_hourly(spark, sf), K, ["y"], grid, {"kind": "arma", "long": 3}, 9, 200), 4)


@query("fc6_vector_arma_grid")
def fc6(spark, sf):
    """25 orders of a two-variable model, scored on the first variable."""
    grid = arma_grid(range(5), [0], range(5))
    return _best(GridSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], grid, {"kind": "arma", "long": 3}, 5, 20))


@query("fc7_regression_with_arma_errors")
def fc7_errors(spark, sf):
    """Regressor with known future values, ARMA model on what it leaves."""
    grid = arma_grid(range(3), range(2), range(3))
    return _best(GridSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], grid, ARMA, 5, 20, exog=1))


def _additive(df, k, min_train, m, grid, **options):
    pred = tr.additive_forecasts(df, K, k, min_train, m, grid, **options)
    scores = so.candidate_scores(so.fold_scores(pred, ["series_id", "candidate"]), ["series_id", "candidate"])
    best = with_candidate_parameters(so.best_candidate(scores, K), grid)
    return best.select("series_id", "candidate", *grid[0], rnd("mean_mae", 2).alias("mean_mae"),
                       rnd("last_mae", 2).alias("last_mae"))


# The prior scales that are searched.
YEARLY_SCALES = [0.001, 0.01, 0.1, 1, 2, 5, 10, 15, 20, 25]
MONTHLY_CHANGEPOINT_SCALES = [0.001, 0.01, 0.1, 0.5, 0.75, 1]
MONTHLY_SEASONALITY_SCALES = [0.001, 0.01, 0.1, 1, 2, 5, 10]


@query("fc8_additive_changepoint_scales")
def fc8(spark, sf):
    return _additive(P.lineitem_monthly(spark, sf), 5, 20, 12, tr.scale_grid(YEARLY_SCALES))


@query("fc8_additive_two_scales")
def fc8_two(spark, sf):
    return _additive(P.orders_monthly(spark, sf), 5, 20, 12,
                     tr.scale_grid(MONTHLY_CHANGEPOINT_SCALES, MONTHLY_SEASONALITY_SCALES))


@query("fc8_additive_with_regressor")
def fc8_regressor(spark, sf):
    return _additive(P.orders_monthly_pair(spark, sf), 5, 20, 12, tr.scale_grid(YEARLY_SCALES), regressors=["x"])


@query("fc8_additive_future_line",
       f"WITH {P.F2}, f AS (SELECT series_id, max(n) AS n, regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a FROM panel GROUP BY 1) "
       f"SELECT series_id, CAST(h AS BIGINT) AS h, {r('a + b * (n + h)', 2)} AS yhat FROM f, range(12) t(h)")
def fc8_future_line(spark, sf):
    """Without hinges and waves the additive model is a line in time: 12 months beyond the end."""
    df = P.lineitem_monthly(spark, sf)
    chosen = df.select("series_id").distinct().withColumn("candidate", F.lit(0))
    out = tr.additive_future(df, K, chosen, 12, 12, tr.scale_grid([1]), knots=0, order=0)
    return out.select("series_id", "h", rnd("yhat", 2).alias("yhat"))


@query("fc8_additive_future_regressor",
       f"WITH {P.F4}, two AS (SELECT *, CAST(idx AS DOUBLE) AS w FROM panel), "
       f"f AS (SELECT series_id, {_TWO.format(u='w', v='x', y='y')} AS a, {_TWO.format(u='x', v='w', y='y')} AS b, "
       "avg(y) AS my, avg(x) AS mx, avg(w) AS mw FROM two WHERE idx < n - 12 GROUP BY 1) "
       f"SELECT series_id, CAST(idx - n + 12 AS BIGINT) AS h, {r('my + a * (x - mx) + b * (w - mw)', 1)} AS yhat "
       "FROM two JOIN f USING (series_id) WHERE idx >= n - 12")
def fc8_future_regressor(spark, sf):
    """A line in time and one regressor that is known beyond the end."""
    past, known = _ahead(P.orders_monthly_pair(spark, sf), ["x"], 12)
    chosen = past.select("series_id").distinct().withColumn("candidate", F.lit(0))
    out = tr.additive_future(past, K, chosen, 12, 12, tr.scale_grid([1]), knots=0, order=0, regressors=["x"], known=known)
    return out.select("series_id", "h", rnd("yhat", 1).alias("yhat"))


@query("fc8_additive_future_best")
def fc8_future_best(spark, sf):
    """Two years beyond the end by each series' best prior scale, hinges and waves included."""
    df, grid = P.lineitem_monthly(spark, sf), tr.scale_grid(YEARLY_SCALES)
    pred = tr.additive_forecasts(df, K, 5, 20, 12, grid)
    best = so.best_candidate(so.candidate_scores(so.fold_scores(pred, ["series_id", "candidate"]), ["series_id", "candidate"]), K)
    return tr.additive_future(df, K, best, 24, 12, grid).select("series_id", "h", "candidate", rnd("yhat", 2).alias("yhat"))


@query("fc10_polynomial_trend")
def fc10(spark, sf):
    """Degree 8 in scaled time per series, continued to day 100."""
    fits = tr.polynomial_fits(P.orders_monthly(spark, sf), K, 8)
    return tr.extrapolate(fits, K, 100).select("series_id", "idx", rnd("yhat", 2).alias("yhat"))


@query("fc10_polynomial_degree_one",
       f"WITH {P.F5}, f AS (SELECT series_id, max(n) AS n, regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a FROM panel GROUP BY 1) "
       f"SELECT series_id, i AS idx, {r('a + b * i', 3)} AS yhat FROM (SELECT *, unnest(range(CAST(n AS BIGINT), greatest(100, CAST(n AS BIGINT) + 1))) AS i FROM f)")
def fc10_line(spark, sf):
    fits = tr.polynomial_fits(P.parts_monthly(spark, sf), K, 1)
    return tr.extrapolate(fits, K, 100).select("series_id", "idx", rnd("yhat", 3).alias("yhat"))


@query("fc12_window_regressor")
def fc12(spark, sf):
    """24 values in, 24 out, linear map per series; window length and ridge searched."""
    grid = [dict(n_in=n, ridge=x) for n in (6, 12, 24) for x in (0.0, 0.01, 0.1, 1.0)]
    return _best(GridSearch(P.events_hourly(spark, sf), K, ["y"], grid, {"kind": "window", "n_out": 24}, 9, 200), 4)


@query("fc13_multivariate_window_regressor")
def fc13(spark, sf):
    """4 rows of three variables in, 4 rows out."""
    df = P.orders_monthly_pair(spark, sf).withColumn("z", F.col("y") + F.col("x"))
    grid = [dict(n_in=n, ridge=x) for n in (2, 4) for x in (0.001, 0.01, 0.1, 1.0)]
    return _best(GridSearch(df, K, ["y", "x", "z"], grid, {"kind": "window", "n_out": 4}, 5, 20))


@query("fc16_smoothing_equivalent_orders")
def fc16(spark, sf):
    orders = [(0, 1, 1), (0, 2, 1), (0, 2, 2), (1, 1, 2)]
    grid = [arma_grid([p], [d], [q])[0] for p, d, q in orders]
    return _best(GridSearch(P.lineitem_monthly(spark, sf), K, ["y"], grid, ARMA, 5, 20))


@query("fc7_regression_by_lag_products",
       f"WITH {folds_sql(P.F4, 5, 20)}, fit AS (SELECT series_id, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train GROUP BY 1, 2) "
       f"SELECT t.series_id, t.fold, {r('avg(abs(y - a - b * x))', 2)} AS mae FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold GROUP BY 1, 2")
def fc7_engine(spark, sf):
    """One regressor and order (0, 0, 0) through the grid engine, on all training rows."""
    search = GridSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], arma_grid([0], [0], [0]), ARMA, 5, 20, exog=1)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 2).alias("mae"))


@query("val7_failed_candidates_skipped",
       f"WITH {folds_sql(P.F1, 5, 0)}, s AS (SELECT series_id, fold, "
       # a candidate's own lags, and the parameters of the larger of its two regressions
       f"CASE WHEN greatest(train_size - d - greatest(p, CASE WHEN q > 0 THEN q + {ARMA['long']} ELSE 0 END), 0) "
       f"<= greatest(1 + p + q, CASE WHEN q > 0 THEN 1 + {ARMA['long']} ELSE 0 END) THEN 'short' ELSE 'ok' END AS status "
       "FROM folds, range(5) a(p), range(3) b(d), range(5) c(q)) "
       "SELECT series_id, fold, status, count(*) AS candidates FROM s GROUP BY 1, 2, 3")
def val7(spark, sf):
    """Early folds are too short for the larger orders: those fail, the others go on."""
    search = GridSearch(P.orders_monthly(spark, sf), K, ["y"], PDQ, ARMA, 5, 0)
    return search.fold_scores().groupBy("series_id", "fold", "status").agg(F.count(F.lit(1)).alias("candidates"))


@query("fc14_transfer_three_inputs")
def fc14_three(spark, sf):
    """Model on the last three values of one series, continued on shortened others to equal length."""
    df = P.orders_monthly(spark, sf)
    search = GridSearch(df, K, ["y"], arma_grid([3], [0], [0]), ARMA, 5, 20)
    known = slices.drop_tail(df, 30).filter("series_id <> '1-URGENT'")
    out = search.transfer(F.col("series_id") == "1-URGENT", known, 0, F.lit(30))
    return out.select("series_id", "h", rnd("yhat", 2).alias("yhat"))


@query("set2_observed_and_future")
def set2_future(spark, sf):
    """Every series followed by 12 forecasts of its best order, fitted on all its values."""
    search = GridSearch(P.lineitem_monthly(spark, sf), K, ["y"], arma_grid(range(3), range(2), range(2)), ARMA, 5, 20)
    best = so.best_candidate(search.scores(), K)
    ends = search.df.filter("idx = n - 1").select("series_id", "n")
    ahead = search.future(best, 12).join(ends, "series_id").select(
        "series_id", (F.col("n") + F.col("h")).alias("idx"), F.lit(True).alias("is_forecast"), F.col("yhat").alias("y"))
    seen = search.df.select("series_id", "idx", F.lit(False).alias("is_forecast"), "y")
    return seen.unionByName(ahead).select("series_id", "idx", "is_forecast", rnd("y", 2).alias("y"))


# ---- fitted models whose estimates can be written out in SQL -------------------------------

@query("fc12_window_one_step",
       f"WITH {folds_sql(P.F3, 9, 200)}, {_AR1_SQL} SELECT series_id, fold, {r('avg(abs(y - yhat))', 4)} AS mae FROM fc GROUP BY 1, 2")
def fc12_one(spark, sf):
    """A window of one value in and one out, applied step after step, is an autoregression of order 1."""
    search = GridSearch(P.events_hourly(spark, sf), K, ["y"], [dict(n_in=1, ridge=0.0)], {"kind": "window", "n_out": 1}, 9, 200)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 4).alias("mae"))


_POOLED_Z = ("m AS (SELECT series_id, fold, {moments} FROM train GROUP BY 1, 2), "
             "z AS (SELECT series_id, fold, idx, {values} FROM train JOIN m USING (series_id, fold) WINDOW w AS (PARTITION BY series_id, fold ORDER BY idx))")


@query("fc12_pooled_window_one_step",
       f"WITH {folds_sql(P.F2, 5, 20)}, "
       + _POOLED_Z.format(moments="avg(y) AS my, stddev_pop(y) AS sy", values="(y - my) / sy AS z, lag((y - my) / sy) OVER w AS x")
       + ", f AS (SELECT fold, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM z GROUP BY 1), "
       "e AS (SELECT series_id, fold, max_by(z, idx) AS z0 FROM z GROUP BY 1, 2) "
       "SELECT t.series_id, t.fold, "
       f"{r('avg(abs(y - my - sy * (a * (1 - power(b, h + 1)) / (1 - b) + power(b, h + 1) * z0)))', 2)} AS mae "
       "FROM test t JOIN m USING (series_id, fold) JOIN f USING (fold) JOIN e USING (series_id, fold) GROUP BY 1, 2")
def fc12_pooled_one(spark, sf):
    """One value in, one out, one map for all series: a regression over the standardised pairs of all of them."""
    search = PooledSearch(P.lineitem_monthly(spark, sf), K, ["y"], [dict(n_in=1, ridge=0.0)], 1, 5, 20)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 2).alias("mae"))


@query("fc12_pooled_window_wide_panel")
def fc12_pooled_wide(spark, sf):
    """One map from 6, 12 or 24 months to the next 4 for all part series."""
    grid = [dict(n_in=n, ridge=x) for n in (6, 12, 24) for x in (0.0, 0.01, 0.1)]
    return _best(PooledSearch(P.parts_monthly(spark, sf), K, ["y"], grid, 4, 5, 24), 4)


@query("fc12_pooled_window_future")
def fc12_pooled_future(spark, sf):
    """The next 12 hours of every event type, by one map fitted on all types."""
    search = PooledSearch(P.events_hourly(spark, sf), K, ["y"], [dict(n_in=24, ridge=0.01)], 12, 9, 200)
    chosen = search.df.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.future(chosen, 12).select("series_id", "h", rnd("yhat", 4).alias("yhat"))


def _pair_step_sql(by: str) -> str:
    """First step of a map from one row of (y, x) to the next, fitted over rows grouped by ``by``."""
    return (f"WITH {folds_sql(P.F4, 5, 20)}, "
            + _POOLED_Z.format(moments="avg(y) AS my, stddev_pop(y) AS sy, avg(x) AS mx, stddev_pop(x) AS sx",
                               values="(y - my) / sy AS y, (x - mx) / sx AS x, lag((y - my) / sy) OVER w AS u, lag((x - mx) / sx) OVER w AS v")
            + f", f AS (SELECT {by}, {_TWO.format(u='v', v='u', y='y')} AS a, {_TWO.format(u='u', v='v', y='y')} AS b, "
            f"avg(y) AS ay, avg(u) AS au, avg(v) AS av FROM z WHERE u IS NOT NULL GROUP BY {by}), "
            "e AS (SELECT series_id, fold, max_by(y, idx) AS y0, max_by(x, idx) AS x0 FROM z GROUP BY 1, 2) "
            f"SELECT e.series_id, e.fold, {r('my + sy * (ay + a * (y0 - au) + b * (x0 - av))', 1)} AS yhat "
            f"FROM e JOIN m USING (series_id, fold) JOIN f USING ({by})")


def _pair_step(search):
    chosen = search.df.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.forecasts(chosen).filter("h = 0").select("series_id", "fold", rnd("yhat", 1).alias("yhat"))


@query("fc13_one_row_window", _pair_step_sql("series_id, fold"))
def fc13_one(spark, sf):
    """One row of two variables in, one out, per series."""
    return _pair_step(GridSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], [dict(n_in=1, ridge=0.0)], {"kind": "window", "n_out": 1}, 5, 20))


@query("fc13_pooled_one_row_window", _pair_step_sql("fold"))
def fc13_pooled_one(spark, sf):
    """One row of two variables in, one out, one map for all series."""
    return _pair_step(PooledSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], [dict(n_in=1, ridge=0.0)], 1, 5, 20))


@query("fc13_pooled_multivariate_window")
def fc13_pooled(spark, sf):
    """4 rows of three variables in, 4 rows out, one map for all series."""
    df = P.orders_monthly_pair(spark, sf).withColumn("z", F.col("y") + F.col("x"))
    grid = [dict(n_in=n, ridge=x) for n in (2, 4) for x in (0.001, 0.01, 0.1, 1.0)]
    return _best(PooledSearch(df, K, ["y", "x", "z"], grid, 4, 5, 20))


@query("fc16_simple_smoothing_two_regressions",
       f"WITH {folds_sql(P.F2, 5, 20)}, "
       "d AS (SELECT *, y - lag(y) OVER w AS z, lag(y) OVER w - lag(y, 2) OVER w AS z1, lag(y, 2) OVER w - lag(y, 3) OVER w AS z2 "
       "FROM train WINDOW w AS (PARTITION BY series_id, fold ORDER BY idx)), "
       "one AS (SELECT series_id, fold, regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a FROM d WHERE idx >= 3 GROUP BY 1, 2), "
       "e AS (SELECT d.*, z - a - b * z1 AS shock, z1 - a - b * z2 AS shock1 FROM d JOIN one USING (series_id, fold) WHERE idx >= 3), "
       "two AS (SELECT series_id, fold, regr_slope(z, shock1) AS theta, regr_intercept(z, shock1) AS c, max_by(y, idx) AS y0, "
       "max_by(shock, idx) AS last FROM e GROUP BY 1, 2) "
       f"SELECT t.series_id, t.fold, {r('avg(abs(y - y0 - (h + 1) * c - theta * last))', 2)} AS mae "
       "FROM test t JOIN two USING (series_id, fold) GROUP BY 1, 2")
def fc16_two(spark, sf):
    """Order (0, 1, 1) with a first stage of one lag."""
    search = GridSearch(P.lineitem_monthly(spark, sf), K, ["y"], arma_grid([0], [1], [1]), {"kind": "arma", "long": 1}, 5, 20)
    return search.fold_scores().select("series_id", "fold", rnd("mae", 2).alias("mae"))


@query("fc6_vector_one_step",
       f"WITH {folds_sql(P.F4, 5, 20)}, l AS (SELECT *, lag(y) OVER w AS u, lag(x) OVER w AS v FROM train "
       "WINDOW w AS (PARTITION BY series_id, fold ORDER BY idx)), "
       f"f AS (SELECT series_id, fold, {_TWO.format(u='v', v='u', y='y')} AS a, {_TWO.format(u='u', v='v', y='y')} AS b, "
       "avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM l WHERE u IS NOT NULL GROUP BY 1, 2), "
       "z AS (SELECT series_id, fold, max_by(y, idx) AS y0, max_by(x, idx) AS x0 FROM train GROUP BY 1, 2) "
       f"SELECT series_id, fold, {r('my + a * (y0 - mu) + b * (x0 - mv)', 1)} AS yhat FROM f JOIN z USING (series_id, fold)")
def fc6_one(spark, sf):
    """First step of a vector autoregression of order 1 in two variables."""
    search = GridSearch(P.orders_monthly_pair(spark, sf), K, ["y", "x"], arma_grid([1], [0], [0]), ARMA, 5, 20)
    chosen = search.df.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.forecasts(chosen).filter("h = 0").select("series_id", "fold", rnd("yhat", 1).alias("yhat"))


@query("fc14_transfer_engine_one_lag",
       f"WITH {P.F1}, src AS (SELECT y, lag(y) OVER (ORDER BY idx) AS x FROM panel WHERE series_id = '1-URGENT'), "
       "fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM src), "
       "e AS (SELECT series_id, y AS y0 FROM panel WHERE idx = n - 21 AND series_id <> '1-URGENT') "
       f"SELECT series_id, CAST(h AS BIGINT) AS h, {r('a * (1 - power(b, h + 1)) / (1 - b) + power(b, h + 1) * y0', 2)} AS yhat "
       "FROM e, fit, range(20) t(h)")
def fc14_one_lag(spark, sf):
    """The grid engine's order (1, 0, 0) of one series, continued on the others."""
    df = P.orders_monthly(spark, sf)
    search = GridSearch(df, K, ["y"], arma_grid([1], [0], [0]), ARMA, 5, 20)
    known = slices.drop_tail(df, 20).filter("series_id <> '1-URGENT'")
    out = search.transfer(F.col("series_id") == "1-URGENT", known, 0, F.lit(20))
    return out.select("series_id", "h", rnd("yhat", 2).alias("yhat"))


@query("dia2_first_two_lags",
       f"WITH {P.F3}, c AS (SELECT series_id, idx, y - avg(y) OVER (PARTITION BY series_id) AS v FROM panel), "
       "l AS (SELECT series_id, v, lag(v) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY idx)), "
       "a AS (SELECT series_id, sum(v * v1) / sum(v * v) AS r1, sum(v * v2) / sum(v * v) AS r2 FROM l GROUP BY 1) "
       f"SELECT series_id, 1 AS lag, {r('r1', 8)} AS pacf FROM a UNION ALL "
       f"SELECT series_id, 2, {r('(r2 - r1 * r1) / (1 - r1 * r1)', 8)} FROM a")
def dia2_two(spark, sf):
    acf = dg.autocorrelation(P.events_hourly(spark, sf), K, "y", 2)
    return dg.partial_autocorrelation(acf, K, 2).select("series_id", "lag", rnd("pacf", 8).alias("pacf"))


def _ahead(df, cols, steps):
    """The panel without its last rows, and the regressors of those rows by step."""
    known = df.filter(F.col("idx") >= F.col("n") - steps).select(
        *K, (F.col("idx") - F.col("n") + steps).alias("h"), *cols)
    return slices.drop_tail(df, steps), known


@query("fc7_future_regressor",
       f"WITH {P.F4}, f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM panel WHERE idx < n - 12 GROUP BY 1) "
       f"SELECT series_id, CAST(idx - n + 12 AS BIGINT) AS h, {r('a + b * x', 1)} AS yhat FROM panel JOIN f USING (series_id) WHERE idx >= n - 12")
def fc7_future(spark, sf):
    """Twelve months beyond the end from one regressor that is known there."""
    past, known = _ahead(P.orders_monthly_pair(spark, sf), ["x"], 12)
    search = GridSearch(past, K, ["y", "x"], arma_grid([0], [0], [0]), ARMA, 5, 20, exog=1)
    chosen = past.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.future(chosen, 12, known).select("series_id", "h", rnd("yhat", 1).alias("yhat"))


@query("fc7_future_two_regressors",
       f"WITH {P.F4}, two AS (SELECT *, CAST(pos % 12 AS DOUBLE) AS w FROM panel), "
       f"f AS (SELECT series_id, {_TWO.format(u='w', v='x', y='y')} AS a, {_TWO.format(u='x', v='w', y='y')} AS b, "
       "avg(y) AS my, avg(x) AS mx, avg(w) AS mw FROM two WHERE idx < n - 12 GROUP BY 1) "
       f"SELECT series_id, CAST(idx - n + 12 AS BIGINT) AS h, {r('my + a * (x - mx) + b * (w - mw)', 1)} AS yhat "
       "FROM two JOIN f USING (series_id) WHERE idx >= n - 12")
def fc7_future_two(spark, sf):
    """Number of orders and month of the year as regressors."""
    df = P.orders_monthly_pair(spark, sf).withColumn("w", (F.col("pos") % 12).cast("double"))
    past, known = _ahead(df, ["x", "w"], 12)
    search = GridSearch(past, K, ["y", "x", "w"], arma_grid([0], [0], [0]), ARMA, 5, 20, exog=2)
    chosen = past.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.future(chosen, 12, known).select("series_id", "h", rnd("yhat", 1).alias("yhat"))


@query("dia3_aicc_of_candidates",
       f"WITH {P.F5}, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS x FROM panel), "
       "f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_count(y, x) AS n FROM l GROUP BY 1), "
       "s AS (SELECT l.series_id, max(f.n) AS n, sum(power(y - a - b * x, 2)) AS sse FROM l JOIN f ON f.series_id = l.series_id WHERE x IS NOT NULL GROUP BY 1), "
       "m AS (SELECT series_id, count(*) AS n, var_pop(y) * count(*) AS sse FROM panel GROUP BY 1) "
       f"SELECT series_id, 0 AS candidate, {r('n * ln(sse / n) + 4 + 12.0 / (n - 3)', 6)} AS aicc FROM m "
       f"UNION ALL SELECT series_id, 1, {r('n * ln(sse / n) + 6 + 24.0 / (n - 4)', 6)} FROM s")
def dia3_grid(spark, sf):
    """Orders (0, 0, 0) and (1, 0, 0) of all part series, from the sums that also score them."""
    search = GridSearch(P.parts_monthly(spark, sf), K, ["y"], arma_grid(range(2), [0], [0]), ARMA, 5, 20)
    return search.information(2).select("series_id", "candidate", rnd("aicc", 6).alias("aicc"))


@query("dia4_portmanteau_of_residuals",
       f"WITH {P.F3}, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS x FROM panel), "
       "f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY 1), "
       "e AS (SELECT l.series_id, idx, y - a - b * x AS e FROM l JOIN f USING (series_id) WHERE x IS NOT NULL), "
       "v AS (SELECT series_id, count(*) AS n, sum(e * e) AS s FROM e GROUP BY 1), "
       "c AS (SELECT a.series_id, k, sum(a.e * b.e) AS c FROM e a, range(1, 25) t(k) JOIN e b ON b.series_id = a.series_id AND b.idx = a.idx - k GROUP BY 1, 2) "
       f"SELECT series_id, {r('max(n) * (max(n) + 2) * sum(power(c / s, 2) / (n - k))', 6)} AS q FROM c JOIN v USING (series_id) GROUP BY 1")
def dia4_residuals(spark, sf):
    """Residuals of order (1, 0, 0) of the hourly series, over 24 lags."""
    search = GridSearch(P.events_hourly(spark, sf), K, ["y"], arma_grid([1], [0], [0]), ARMA, 9, 200)
    return search.information(24).select("series_id", rnd("q", 6).alias("q"))


@query("dia3_best_order_by_aicc")
def dia3_best(spark, sf):
    """Of 36 orders of the monthly series, that of the smallest AICc, with its residuals' portmanteau statistic."""
    search = GridSearch(P.lineitem_monthly(spark, sf), K, ["y"], arma_grid(range(3), range(2), range(3)), ARMA, 5, 20)
    found = search.information(12).filter("aicc is not null")
    best = found.groupBy("series_id").agg(F.min_by(F.struct("candidate", "aicc", "q"), F.struct("aicc", "candidate")).alias("b"))
    return best.select("series_id", "b.candidate", rnd("b.aicc", 4).alias("aicc"), rnd("b.q", 4).alias("q"))


def _inverted_sql(lost: int, value: str) -> str:
    """Mean of the differences of training rows, summed back from the last actual values; ``value`` gives a step."""
    diff = "y - lag(y, 12) OVER w" if lost == 12 else "y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w"
    return (f"WITH {P.F2}, d AS (SELECT series_id, idx - {lost} AS idx, n - {lost} AS n, {diff} AS y FROM panel "
            "WINDOW w AS (PARTITION BY series_id ORDER BY idx)), t AS (SELECT * FROM d WHERE idx >= 0), "
            + folds_sql("one AS (SELECT 1)", 5, 20, "t")
            + f", fit AS (SELECT series_id, fold, avg(y) AS c, max(train_size) + {lost} AS origin FROM train GROUP BY 1, 2), "
            "g AS (SELECT t2.series_id, t2.fold, t2.h, c, origin, t2.h // 12 AS q FROM test t2 JOIN fit USING (series_id, fold)) "
            f"SELECT g.series_id, g.fold, CAST(origin + h AS BIGINT) AS idx, {r(value, 1)} AS yhat FROM g "
            "JOIN panel b ON b.series_id = g.series_id AND b.idx = origin - 12 + h % 12 "
            "JOIN panel e ON e.series_id = g.series_id AND e.idx = origin - 1 JOIN panel f ON f.series_id = g.series_id AND f.idx = origin - 13")


def _mean_of_differences(spark, sf, d):
    search = DifferencedSearch(P.lineitem_monthly(spark, sf), K, ["y"], arma_grid([0], [0], [0]), ARMA, 5, 20, d=d, D=1, m=12)
    chosen = search.df.select("series_id").distinct().withColumn("candidate", F.lit(0))
    return search.forecasts(chosen).select("series_id", "fold", "idx", rnd("yhat", 1).alias("yhat"))


@query("fc15_seasonal_difference_inverted", _inverted_sql(12, "b.y + (q + 1) * c"))
def fc15_seasonal(spark, sf):
    """Order (0, 0, 0) on seasonal differences, in original units."""
    return _mean_of_differences(spark, sf, 0)


@query("fc15_both_differences_inverted", _inverted_sql(13, "b.y + (q + 1) * (e.y - f.y) + c * ((q + 1) * (h + 1) - 6 * q * (q + 1))"))
def fc15_both(spark, sf):
    """Order (0, 0, 0) on first and seasonal differences, in original units."""
    return _mean_of_differences(spark, sf, 1)


@query("fc15_best_order_on_original_scale")
def fc15_best(spark, sf):
    """Best of 18 orders on seasonal differences, a year beyond the end in original units."""
    search = DifferencedSearch(P.lineitem_monthly(spark, sf), K, ["y"], arma_grid(range(3), range(2), range(3)), ARMA, 5, 20, D=1, m=12)
    return search.future(so.best_candidate(search.scores(), K), 12).select("series_id", "h", "idx", "candidate", rnd("yhat", 2).alias("yhat"))
