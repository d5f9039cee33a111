"""Folds, scores, closed-form forecasts, best model and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions import errors
from loomcast.operators import baselines as bl, cleaning as cl, diagnostics as dg, folds as fd
from loomcast.operators import scoring as so, slices, split, windows as wn
from loomcast.operators.solver_tasks import GridSearch, arma_grid
from loomcast.plans import panels as P
from loomcast.plans.panels import r, rnd
from loomcast.plans.registry import query
from loomcast.sources import tables as tb

K = P.K
W = "(PARTITION BY series_id ORDER BY idx)"


def folds_sql(panel_cte: str, k: int, min_train: int, source: str = "panel") -> str:
    """Plain formulation: every fold gets its own copy of its training and test rows."""
    return (
        f"{panel_cte}, geo AS (SELECT *, n // {k + 1} AS ts, n - {k} * (n // {k + 1}) AS first FROM {source}), "
        "blk AS (SELECT *, CASE WHEN idx < first THEN 0 ELSE 1 + (idx - first) // ts END AS block FROM geo), "
        f"folds AS (SELECT DISTINCT series_id, CAST(j AS INT) AS fold, first + j * ts AS train_size, ts FROM geo, range({k}) t(j) "
        f"WHERE first + j * ts > {min_train}), "
        "train AS (SELECT b.*, f.fold, f.train_size FROM folds f JOIN blk b ON b.series_id = f.series_id AND b.idx < f.train_size), "
        "test AS (SELECT b.*, f.fold, f.train_size, b.idx - f.train_size AS h FROM folds f JOIN blk b "
        "ON b.series_id = f.series_id AND b.idx >= f.train_size AND b.idx < f.train_size + f.ts)"
    )


def closed_forms_sql(panel_cte: str, k: int, min_train: int, m: int, source: str = "panel") -> str:
    return (
        folds_sql(panel_cte, k, min_train, source)
        + f", lagged AS (SELECT *, lag(y) OVER (PARTITION BY series_id, fold ORDER BY idx) AS x FROM train), "
        "fit AS (SELECT series_id, fold, avg(y) AS level, max(CASE WHEN idx = train_size - 1 THEN y END) AS y_last, "
        "(max(CASE WHEN idx = train_size - 1 THEN y END) - max(CASE WHEN idx = 0 THEN y END)) / (max(train_size) - 1) AS drift, "
        "regr_slope(y, x) AS phi, regr_intercept(y, x) AS a FROM lagged GROUP BY 1, 2), "
        "fc AS (SELECT t.series_id, t.fold, t.idx, t.h, t.y, f.level AS mean, f.y_last AS random_walk, "
        "f.y_last + f.drift * (t.h + 1) AS drift, s.y AS seasonal_naive, "
        "a * (1 - power(phi, t.h + 1)) / (1 - phi) + power(phi, t.h + 1) * f.y_last AS ar1 "
        f"FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold "
        f"LEFT JOIN {source} s ON s.series_id = t.series_id AND s.idx = t.train_size - {m} + t.h % {m}), "
        "lng AS (" + " UNION ALL ".join(
            f"SELECT series_id, fold, idx, h, y, {i} AS candidate, '{name}' AS model, {name} AS yhat FROM fc"
            for i, name in enumerate(bl.MODELS)) + "), "
        "per_fold AS (SELECT series_id, candidate, model, fold, avg(abs(y - yhat)) AS mae FROM lng GROUP BY 1, 2, 3, 4 "
        # a series without a fold has a row per model
        "UNION ALL SELECT series_id, candidate, model, NULL, NULL FROM "
        f"(SELECT series_id FROM geo GROUP BY 1 HAVING max(ts) = 0 OR max(n) - max(ts) <= {min_train}), "
        "(VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(bl.MODELS)) + ") m(candidate, model)), "
        "score AS (SELECT series_id, candidate, model, avg(mae) AS mean_mae, arg_max(mae, fold) AS last_mae, count(fold) AS folds "
        "FROM per_fold GROUP BY 1, 2, 3), "
        "best AS (SELECT * REPLACE (CASE WHEN mean_mae IS NOT NULL THEN candidate END AS candidate) FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_mae ASC NULLS LAST, candidate) AS rn FROM score) WHERE rn = 1)"
    )


F1_FORMS = closed_forms_sql(P.F1, 5, 20, 12)
F3_FORMS = closed_forms_sql(P.F3, 9, 200, 24)


def _f1_long(spark, sf):
    return bl.long_forecasts(bl.forecasts(P.orders_monthly(spark, sf), K, 5, 20, 12), K)


def _f1_fold_scores(spark, sf):
    df = P.orders_monthly(spark, sf)
    return so.with_short(bl.fold_scores(bl.forecasts(df, K, 5, 20, 12), K), df, K, 5, 20)


def _f1_scores(spark, sf):
    return so.candidate_scores(_f1_fold_scores(spark, sf), ["series_id", "candidate", "model"])


# ---- folds -------------------------------------------------------------------------------

@query("val1_rolling_origin_folds",
       f"WITH {folds_sql(P.F1, 5, 0)} SELECT series_id, idx, CAST(block AS INT) AS block, CAST(ts AS BIGINT) AS test_size FROM blk")
def val1(spark, sf):
    out = fd.with_blocks(P.orders_monthly(spark, sf), 5)
    return out.select("series_id", "idx", "block", "test_size")


@query("val2_folds_with_enough_training",
       f"WITH {folds_sql(P.F3, 9, 200)} SELECT series_id, fold, idx, CAST(train_size AS BIGINT) AS train_size, CAST(h AS BIGINT) AS h FROM test")
def val2(spark, sf):
    return fd.test_rows(P.events_hourly(spark, sf), 9, 200).select("series_id", "fold", "idx", "train_size", "h")


@query("val3_fold_sizes",
       f"WITH {folds_sql(P.F3, 9, 200)} SELECT series_id, fold, CAST(train_size AS BIGINT) AS train_size, CAST(ts AS BIGINT) AS test_size FROM folds")
def val3(spark, sf):
    return fd.fold_sizes(P.events_hourly(spark, sf), K, 9, 200)


@query("val4_trim_for_test_length",
       f"WITH {P.F2}, d AS (SELECT series_id, idx - 1 AS idx, n - 1 AS n, y - lag(y) OVER {W} AS y FROM panel), "
       "t AS (SELECT series_id, idx, n - 5 AS n, y FROM d WHERE idx >= 0 AND idx < n - 5), "
       + folds_sql("one AS (SELECT 1)", 18, 30, "t")
       + " SELECT series_id, fold, CAST(train_size AS BIGINT) AS train_size, CAST(ts AS BIGINT) AS test_size FROM folds")
def val4(spark, sf):
    diff = slices.drop_tail(wn.difference(P.lineitem_monthly(spark, sf), K, ["y"]), 5)
    return fd.fold_sizes(diff, K, 18, 30)


@query("val5_hash_split",
       "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) AS BIGINT) % 10 < 7 "
       "THEN 'train' ELSE 'test' END AS split FROM orders")
def val5(spark, sf):
    return cl.hash_split(tb.read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("join3_fold_rows",
       f"WITH {folds_sql(P.F1, 5, 20)} SELECT series_id, fold, 'train' AS role, idx, {r('y', 2)} AS y FROM train "
       f"UNION ALL SELECT series_id, fold, 'test', idx, {r('y', 2)} FROM test")
def join3(spark, sf):
    return fd.fold_rows(P.orders_monthly(spark, sf), 5, 20).select("series_id", "fold", "role", "idx", rnd("y", 2).alias("y"))


@query("join4_candidate_fold_series",
       f"WITH {F1_FORMS} SELECT series_id, fold, idx, candidate, model, {r('yhat', 2)} AS yhat FROM lng")
def join4(spark, sf):
    return _f1_long(spark, sf).select("series_id", "fold", "idx", "candidate", "model", rnd("yhat", 2).alias("yhat"))


@query("join6_pair_forecasts_with_actuals",
       f"WITH {F3_FORMS} SELECT series_id, fold, idx, {r('y', 2)} AS y, {r('seasonal_naive', 2)} AS yhat FROM fc")
def join6(spark, sf):
    df = P.events_hourly(spark, sf)
    rows = fd.test_rows(df.select("series_id", "idx", "n"), 9, 200)
    pred = bl.seasonal_naive(rows, df, K, 24, "yhat").select("series_id", "fold", "idx", "yhat")
    return so.pair(pred, df.select("series_id", "idx", "y"), K).select(
        "series_id", "fold", "idx", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


# ---- scores ------------------------------------------------------------------------------

@query("agg10_mae_per_fold", f"WITH {F1_FORMS} SELECT series_id, model, fold, {r('mae', 2)} AS mae FROM per_fold")
def agg10(spark, sf):
    return so.fold_scores(_f1_long(spark, sf), ["series_id", "model"]).select(
        "series_id", "model", "fold", rnd("mae", 2).alias("mae"))


@query("agg11_mean_and_last_mae",
       f"WITH {F1_FORMS} SELECT series_id, model, {r('mean_mae', 2)} AS mean_mae, {r('last_mae', 2)} AS last_mae, folds FROM score")
def agg11(spark, sf):
    return _f1_scores(spark, sf).select(
        "series_id", "model", rnd("mean_mae", 2).alias("mean_mae"), rnd("last_mae", 2).alias("last_mae"), "folds")


def _metric(name, sql, measure, digits=6, forms=F3_FORMS):
    @query(name, f"WITH {forms} SELECT series_id, model, {r(sql, digits)} AS score FROM lng GROUP BY 1, 2")
    def run(spark, sf):
        long = bl.long_forecasts(bl.forecasts(P.events_hourly(spark, sf), K, 9, 200, 24), K)
        return long.groupBy("series_id", "model").agg(rnd(measure(), digits).alias("score"))


_metric("agg12_rmse", "sqrt(avg(power(y - yhat, 2)))", errors.rmse)
_metric("agg13_mape", "avg(abs((y - yhat) / nullif(y, 0)))", errors.mape, 4)
_metric("agg14_rmspe", "sqrt(avg(power((y - yhat) / nullif(y, 0), 2)))", errors.rmspe, 3)
_metric("agg15_r_squared",
        "1 - sum(power(y - yhat, 2)) / (var_pop(y) * count(y))", errors.r2)
_metric("agg16_sse", "sum(power(y - yhat, 2))", errors.sse, 2)


@query("ord5_best_candidate",
       f"WITH {F1_FORMS} SELECT series_id, candidate, model, {r('mean_mae', 2)} AS mean_mae, {r('last_mae', 2)} AS last_mae FROM best")
def ord5(spark, sf):
    return so.best_candidate(_f1_scores(spark, sf), K).select(
        "series_id", "candidate", "model", rnd("mean_mae", 2).alias("mean_mae"), rnd("last_mae", 2).alias("last_mae"))


@query("ord6_all_candidate_scores",
       f"WITH {F1_FORMS} SELECT series_id, candidate, {r('mean_mae', 2)} AS mean_mae FROM score ORDER BY 1, 2")
def ord6(spark, sf):
    return _f1_scores(spark, sf).select("series_id", "candidate", rnd("mean_mae", 2).alias("mean_mae")).orderBy(
        "series_id", "candidate")


@query("val6_grid_search",
       f"WITH {F3_FORMS} SELECT series_id, candidate, model, {r('mean_mae', 4)} AS mean_mae FROM best")
def val6(spark, sf):
    df = P.events_hourly(spark, sf)
    per_fold = so.with_short(bl.fold_scores(bl.forecasts(df, K, 9, 200, 24), K), df, K, 9, 200)
    best = so.best_candidate(so.candidate_scores(per_fold, ["series_id", "candidate", "model"]), K)
    return best.select("series_id", "candidate", "model", rnd("mean_mae", 4).alias("mean_mae"))


@query("val8_best_candidate_last_forecast",
       f"WITH {F1_FORMS}, last AS (SELECT series_id, max(fold) AS fold FROM lng GROUP BY 1) "
       f"SELECT l.series_id, l.model, l.idx, {r('l.y', 2)} AS y, {r('l.yhat', 2)} AS yhat FROM lng l "
       "JOIN best b ON b.series_id = l.series_id AND b.candidate = l.candidate JOIN last ON last.series_id = l.series_id AND last.fold = l.fold")
def val8(spark, sf):
    long = _f1_long(spark, sf)
    by = ["series_id", "candidate", "model"]
    scores = so.candidate_scores(so.fold_scores(long, by), by)
    best = so.best_candidate(scores, K).select("series_id", "candidate")
    last = long.groupBy("series_id").agg(F.max("fold").alias("fold"))
    return long.join(best, ["series_id", "candidate"]).join(last, ["series_id", "fold"]).select(
        "series_id", "model", "idx", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


@query("val10_model_comparison",
       f"WITH {F1_FORMS} SELECT s.series_id, s.model, {r('s.mean_mae', 2)} AS mean_mae, {r('s.last_mae', 2)} AS last_mae, "
       "s.candidate = b.candidate AS is_best FROM score s JOIN best b ON b.series_id = s.series_id")
def val10(spark, sf):
    scores = _f1_scores(spark, sf)
    best = so.best_candidate(scores, K).select("series_id", F.col("candidate").alias("winner"))
    return scores.join(best, "series_id").select(
        "series_id", "model", rnd("mean_mae", 2).alias("mean_mae"), rnd("last_mae", 2).alias("last_mae"),
        (F.col("candidate") == F.col("winner")).alias("is_best"))


@query("val10_selection_and_holdout",
       f"WITH {F1_FORMS}, sel AS (SELECT series_id, candidate, model, avg(CASE WHEN fold < newest THEN mae END) AS mean_mae, "
       "max(CASE WHEN fold = newest THEN mae END) AS holdout FROM per_fold JOIN (SELECT series_id, max(fold) AS newest FROM per_fold GROUP BY 1) USING (series_id) GROUP BY 1, 2, 3), "
       "pick AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_mae, candidate) AS rn FROM sel) "
       f"SELECT series_id, model, {r('mean_mae', 2)} AS selection_mae, {r('holdout', 2)} AS holdout_mae FROM pick WHERE rn = 1")
def val10_holdout(spark, sf):
    by = ["series_id", "candidate", "model"]
    scores = so.selection_scores(_f1_fold_scores(spark, sf), by)
    return so.best_candidate(scores, K).select(
        "series_id", "model", rnd("mean_mae", 2).alias("selection_mae"), rnd("holdout_mae", 2).alias("holdout_mae"))


@query("fc2_last_year_validation",
       f"WITH {folds_sql(P.F1, 5, 20)}, e AS (SELECT t.series_id, t.fold, avg(abs(t.y - p.y)) AS mae FROM test t "
       "JOIN panel p ON p.series_id = t.series_id AND p.idx = t.idx - 12 GROUP BY 1, 2) "
       f"SELECT series_id, {r('avg(mae)', 2)} AS mean_mae FROM e GROUP BY 1")
def fc2_last_year(spark, sf):
    """Same month of the year before as the forecast (one step ahead of each season)."""
    df = P.orders_monthly(spark, sf)
    lagged = wn.lag_by_key(df, K, "y", 12, "yhat")
    rows = fd.test_rows(lagged, 5, 20)
    return so.candidate_scores(so.fold_scores(rows, K), K).select("series_id", rnd("mean_mae", 2).alias("mean_mae"))


@query("snk2_result_table",
       f"WITH {F1_FORMS} SELECT series_id, model, round(mean_mae, 3) AS mean_mae, CAST(NULL AS DOUBLE) AS seconds, "
       "round(last_mae, 3) AS last_mae FROM score WHERE model IN ('mean', 'ar1', 'seasonal_naive')")
def snk2(spark, sf):
    scores = _f1_scores(spark, sf)
    parts = {name: scores.filter(F.col("model") == name).drop("model") for name in ("mean", "ar1", "seasonal_naive")}
    return so.result_table(parts, 3)


@query("val9_seconds_per_model",
       f"WITH {F1_FORMS} SELECT series_id, model, round(mean_mae, 3) AS mean_mae, round(last_mae, 3) AS last_mae, true AS timed "
       "FROM score WHERE model IN ('mean', 'drift', 'ar1')")
def val9(spark, sf):
    """Seconds of each model's own fits and forecasts, measured in the tasks of the one job that scores them all."""
    labels = {"mean": arma_grid([0], [0], [0]), "drift": arma_grid([0], [1], [0]), "ar1": arma_grid([1], [0], [0])}
    search = GridSearch(P.orders_monthly(spark, sf), K, ["y"], [c for grid in labels.values() for c in grid],
                        {"kind": "arma", "long": 4}, 5, 20)
    scores = search.scores(timed=True)
    table = so.result_table({name: scores.filter(F.col("candidate") == i).select("series_id", "mean_mae", "last_mae", "seconds")
                             for i, name in enumerate(labels)}, 3, second_digits=9)
    return table.select("series_id", "model", "mean_mae", "last_mae", (F.col("seconds") > 0).alias("timed"))


# ---- closed-form forecasts ---------------------------------------------------------------

@query("fc1_mean_random_walk_drift",
       f"WITH {F1_FORMS} SELECT series_id, fold, idx, {r('mean', 2)} AS mean, {r('random_walk', 2)} AS random_walk, {r('drift', 2)} AS drift FROM fc")
def fc1(spark, sf):
    return bl.forecasts(P.orders_monthly(spark, sf), K, 5, 20, 12).select(
        "series_id", "fold", "idx", rnd("mean", 2).alias("mean"), rnd("random_walk", 2).alias("random_walk"),
        rnd("drift", 2).alias("drift"))


@query("fc2_seasonal_naive",
       f"WITH {P.F5}, geo AS (SELECT series_id, max(n) AS n, max(n) // 6 AS ts FROM panel GROUP BY 1), "
       "folds AS (SELECT series_id, CAST(j AS INT) AS fold, n - (5 - j) * ts AS train_size, ts FROM geo, range(5) t(j) WHERE n - (5 - j) * ts > 20), "
       "test AS (SELECT series_id, fold, train_size, unnest(range(0, ts)) AS h FROM folds) "
       f"SELECT t.series_id, fold, train_size + h AS idx, {r('y', 2)} AS yhat FROM test t LEFT JOIN panel p "
       "ON p.series_id = t.series_id AND p.idx = train_size - 12 + h % 12")
def fc2(spark, sf):
    df = P.parts_monthly(spark, sf)
    rows = fd.test_rows(df.select("series_id", "idx", "n"), 5, 20)
    return bl.seasonal_naive(rows, df, K, 12, "yhat").select("series_id", "fold", "idx", rnd("yhat", 2).alias("yhat"))


@query("fc3_ar1",
       f"WITH {F3_FORMS} SELECT series_id, fold, idx, {r('ar1', 4)} AS yhat FROM fc")
def fc3(spark, sf):
    return bl.forecasts(P.events_hourly(spark, sf), K, 9, 200, 24).select(
        "series_id", "fold", "idx", rnd("ar1", 4).alias("yhat"))


@query("fc7_known_regressor",
       f"WITH {folds_sql(P.F4, 5, 20)}, fit AS (SELECT series_id, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM train GROUP BY 1, 2) "
       f"SELECT t.series_id, t.fold, t.idx, {r('a + b * t.x', 2)} AS yhat FROM test t JOIN fit f ON f.series_id = t.series_id AND f.fold = t.fold")
def fc7(spark, sf):
    df = P.orders_monthly_pair(spark, sf)
    rows = fd.attach_fold_values(fd.test_rows(df, 5, 20), bl.regressor_fits(df, K, "x", 5, 20), K)
    return rows.select("series_id", "fold", "idx", rnd(F.col("intercept") + F.col("slope") * F.col("x"), 2).alias("yhat"))


@query("fc9_forecast_frame",
       f"WITH {P.F1} SELECT series_id, strftime(make_date(CAST(pos // 12 AS INT), CAST(pos % 12 + 1 AS INT), 1), '%Y-%m-%d') AS ds, {r('y', 2)} AS y FROM panel")
def fc9(spark, sf):
    from loomcast.functions.calendar import period_start
    return P.orders_monthly(spark, sf).select(
        "series_id", F.date_format(period_start("pos", "month"), "yyyy-MM-dd").alias("ds"), rnd("y", 2).alias("y"))


@query("fc11_linear_regression",
       f"WITH {P.F5} SELECT series_id, {r('regr_slope(y, idx)', 6)} AS slope, {r('regr_intercept(y, idx)', 6)} AS intercept FROM panel GROUP BY 1")
def fc11(spark, sf):
    return P.parts_monthly(spark, sf).groupBy("series_id").agg(
        rnd(F.regr_slope("y", "idx"), 6).alias("slope"), rnd(F.regr_intercept("y", "idx"), 6).alias("intercept"))


@query("fc14_transfer_recursive",
       f"WITH RECURSIVE {P.F1}, src AS (SELECT y, lag(y) OVER (ORDER BY idx) AS x FROM panel WHERE series_id = '1-URGENT'), "
       "fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM src), "
       "rec AS (SELECT series_id, idx, n, y AS v FROM panel WHERE idx = n - 20 UNION ALL "
       "SELECT rec.series_id, rec.idx + 1, rec.n, a + b * v FROM rec, fit WHERE rec.idx + 1 < rec.n) "
       f"SELECT series_id, idx, {r('v', 2)} AS yhat FROM rec WHERE idx > n - 20")
def fc14(spark, sf):
    """One-step model of one series, applied to the others until equal length; the closed form
    gives each step on its own, so the steps need no loop."""
    df = P.orders_monthly(spark, sf)
    source = df.filter("series_id = '1-URGENT'")
    lagged = split.windowed(source, K, lambda w: {"x": F.lag("y", 1).over(w)}, before=1)
    fit = lagged.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    last = df.filter("idx = n - 20").select("series_id", F.col("y").alias("last"))
    steps = df.filter("idx > n - 20").select("series_id", "idx", (F.col("idx") - F.col("n") + 20).alias("step"))
    rows = steps.join(last, "series_id").select(
        "*", fit.select("b").scalar().alias("b"), fit.select("a").scalar().alias("a"))
    return rows.select("series_id", "idx", rnd(bl.ar1_steps(F.col("a"), F.col("b"), F.col("last"), F.col("step")), 2).alias("yhat"))


@query("set2_append_forecasts",
       f"WITH {F1_FORMS}, last AS (SELECT series_id, max(fold) AS fold FROM fc GROUP BY 1) "
       f"SELECT p.series_id, p.idx, false AS is_forecast, {r('p.y', 2)} AS y FROM panel p JOIN "
       "(SELECT f.series_id, max(train_size) AS cut FROM folds f GROUP BY 1) c ON c.series_id = p.series_id AND p.idx < c.cut "
       f"UNION ALL SELECT fc.series_id, fc.idx, true, {r('fc.drift', 2)} FROM fc JOIN last ON last.series_id = fc.series_id AND last.fold = fc.fold")
def set2(spark, sf):
    df = P.orders_monthly(spark, sf)
    last = fd.with_blocks(df, 5)
    seen = last.filter("block < 5").select("series_id", "idx", F.lit(False).alias("is_forecast"), "y")
    paths = bl.forecasts(df, K, 5, 20, 12)
    newest = paths.groupBy("series_id").agg(F.max("fold").alias("fold"))
    pred = paths.join(newest, ["series_id", "fold"]).select(
        "series_id", "idx", F.lit(True).alias("is_forecast"), F.col("drift").alias("y"))
    return seen.unionByName(pred).select("series_id", "idx", "is_forecast", rnd("y", 2).alias("y"))


@query("fc15_forecast_on_original_scale",
       f"WITH {P.F2}, d AS (SELECT series_id, idx - 1 AS idx, n - 1 AS n, y - lag(y) OVER {W} AS y FROM panel), "
       "t AS (SELECT * FROM d WHERE idx >= 0), " + folds_sql("one AS (SELECT 1)", 5, 20, "t")
       + ", fit AS (SELECT series_id, fold, avg(y) AS level, max(train_size) AS train_size FROM train GROUP BY 1, 2) "
       "SELECT t2.series_id, t2.fold, t2.idx + 1 AS idx, "
       f"{r('p.y + f.level * (t2.h + 1)', 2)} AS yhat FROM test t2 JOIN fit f ON f.series_id = t2.series_id AND f.fold = t2.fold "
       "JOIN panel p ON p.series_id = t2.series_id AND p.idx = f.train_size")
def fc15(spark, sf):
    series = P.lineitem_monthly(spark, sf)
    diff = wn.difference(series, K, ["y"])
    fit = fd.train_prefix(diff, K, 5, {"s": F.col("y"), "c": F.lit(1)}, min_train=20).select(
        "series_id", "fold", "train_size", "test_size", (F.col("s") / F.col("c")).alias("level"))
    rows = fd.attach_fold_values(fd.test_rows(diff, 5, 20), fit, K).select(
        "series_id", "fold", (F.col("idx") + 1).alias("idx"), "h", "level")
    # position i of the differences ends at position i + 1 of the series
    base = fit.select("series_id", "fold", F.col("train_size").alias("idx")).join(
        series.select("series_id", "idx", F.col("y").alias("b")), ["series_id", "idx"]).drop("idx")
    out = wn.undo_difference(rows, base, ["series_id", "fold"], "level", "b", "yhat")
    return out.select("series_id", "fold", "idx", rnd("yhat", 2).alias("yhat"))


# ---- diagnostics -------------------------------------------------------------------------

def _acf_sql(cte, lags):
    return (f"WITH {cte}, mu AS (SELECT series_id, avg(y) AS m, count(*) AS n, sum(power(y - (SELECT avg(y) FROM panel q WHERE q.series_id = panel.series_id), 2)) AS v "
            "FROM panel GROUP BY 1), "
            f"acf AS (SELECT a.series_id, CAST(k AS INT) AS lag, sum((a.y - m) * (b.y - m)) / max(v) AS r, max(mu.n) AS n "
            f"FROM range(1, {lags + 1}) t(k), panel a JOIN panel b ON b.series_id = a.series_id JOIN mu ON mu.series_id = a.series_id "
            "WHERE b.idx = a.idx - k GROUP BY 1, 2) ")


@query("dia1_autocorrelation", _acf_sql(P.F3, 48) + f"SELECT series_id, lag, {r('r', 8)} AS r FROM acf")
def dia1(spark, sf):
    return dg.autocorrelation(P.events_hourly(spark, sf), K, "y", 48).select("series_id", "lag", rnd("r", 8).alias("r"))


@query("dia2_partial_autocorrelation")
def dia2(spark, sf):
    acf = dg.autocorrelation(P.events_hourly(spark, sf), K, "y", 24)
    return dg.partial_autocorrelation(acf, K, 24).select("series_id", "lag", rnd("pacf", 8).alias("pacf"))


@query("dia3_aicc_ar1",
       f"WITH {P.F5}, l AS (SELECT *, lag(y) OVER {W} AS x FROM panel), "
       "f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_count(y, x) AS n FROM l GROUP BY 1), "
       "s AS (SELECT l.series_id, max(f.n) AS n, sum(power(y - a - b * x, 2)) AS sse FROM l JOIN f ON f.series_id = l.series_id WHERE x IS NOT NULL GROUP BY 1) "
       f"SELECT series_id, {r('n * ln(sse / n) + 6 + 24.0 / (n - 4)', 6)} AS aicc FROM s")
def dia3(spark, sf):
    lagged = split.windowed(P.parts_monthly(spark, sf), K, lambda w: {"x": F.lag("y", 1).over(w)}, before=1)
    fit = lagged.groupBy("series_id").agg(
        F.regr_count("y", "x").alias("n"),
        (F.regr_syy("y", "x") - F.pow(F.regr_sxy("y", "x"), 2) / F.regr_sxx("y", "x")).alias("sse"))
    return fit.select("series_id", rnd(dg.aicc(F.col("n"), F.col("sse"), 3), 6).alias("aicc"))


@query("dia4_portmanteau",
       _acf_sql(P.F3, 24) + f"SELECT series_id, {r('max(n) * (max(n) + 2) * sum(r * r / (n - lag))', 6)} AS q, CAST(max(lag) AS INT) AS lags FROM acf GROUP BY 1")
def dia4(spark, sf):
    acf = dg.autocorrelation(P.events_hourly(spark, sf), K, "y", 24)
    return dg.portmanteau(acf, K).select("series_id", rnd("q", 6).alias("q"), "lags")
