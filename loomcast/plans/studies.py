"""The whole studies, end to end: prepare two sources, compare models, normalise a country panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomcast.functions import calendar as cal, scalars as sc
from loomcast.operators import baselines as bl, cleaning as cl, scoring as so, split, trend as tr
from loomcast.operators import windows as wn
from loomcast.operators.solver_tasks import GridSearch, arma_grid
from loomcast.plans import panels as P
from loomcast.plans.panels import r, rnd
from loomcast.plans.prep import POPULATION_SQL, _population
from loomcast.plans.registry import query
from loomcast.sources import tables as tb
from loomcast.sources.series import panel

K = P.K


# ---- preparation: two cleaned sources into one monthly and one yearly table ---------------

def prepare_monthly(spark, sf) -> DataFrame:
    """Daily text-dated values of one source, month-named values of the other, joined by key.

    First-of-month rows, years with a thousands comma, the first year and the last months dropped.
    """
    year = F.year("o_orderdate").cast("string")
    raw = tb.read_table(spark, sf, "orders").filter(F.dayofmonth("o_orderdate") == 1).select(
        F.concat(F.substring(year, 1, 1), F.lit(","), F.substring(year, 2, 3)).alias("year_text"),
        F.month("o_orderdate").alias("month"), "o_totalprice")
    temp = raw.withColumn("year", sc.strip_thousands("year_text").cast("int")).filter("year > 1995").groupBy(
        "year", "month").agg(F.avg("o_totalprice").alias("mean_order"))
    lines = tb.read_table(spark, sf, "lineitem").groupBy(
        F.year("l_shipdate").alias("year"), F.date_format("l_shipdate", "MMMM").alias("name")
    ).agg(F.avg("l_extendedprice").alias("mean_line"))
    lines = lines.select("year", cal.month_number("name").alias("month"), "mean_line").filter("year < 2001")
    return cl.attach_series(temp, lines, ["year", "month"])


_PREPARE = (
    "WITH a AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS mean_order FROM orders "
    "WHERE day(o_orderdate) = 1 AND year(o_orderdate) > 1995 GROUP BY 1, 2), "
    "b AS (SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, avg(l_extendedprice) AS mean_line FROM lineitem "
    "WHERE year(l_shipdate) < 2001 GROUP BY 1, 2), "
    "c AS (SELECT a.y, a.m, mean_order, mean_line FROM a JOIN b ON a.y = b.y AND a.m = b.m) ")


@query("study_prepare_monthly",
       _PREPARE + f"SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, {r('mean_order')} AS mean_order, {r('mean_line')} AS mean_line FROM c")
def study_monthly(spark, sf):
    return prepare_monthly(spark, sf).select(
        "year", "month", rnd("mean_order").alias("mean_order"), rnd("mean_line").alias("mean_line"))


@query("study_prepare_yearly",
       _PREPARE + f"SELECT CAST(y AS INT) AS year, {r('avg(mean_order)')} AS mean_order, {r('avg(mean_line)')} AS mean_line FROM c GROUP BY 1")
def study_yearly(spark, sf):
    return prepare_monthly(spark, sf).groupBy("year").agg(
        rnd(F.avg("mean_order")).alias("mean_order"), rnd(F.avg("mean_line")).alias("mean_line"))


# ---- comparison of models ------------------------------------------------------------------

def compare_models(searches: dict[str, GridSearch], extra: dict[str, DataFrame]) -> DataFrame:
    """One row per series and model with its mean and last error, and the winner marked."""
    models = {name: so.best_candidate(s.scores(), K).select("series_id", "mean_mae", "last_mae") for name, s in searches.items()}
    models |= {name: df.select("series_id", "mean_mae", "last_mae") for name, df in extra.items()}
    table = so.result_table(models, 3).drop("seconds")
    order = F.create_map(*[F.lit(x) for pair in zip(models, range(len(models))) for x in pair])
    numbered = table.withColumn("candidate", order[F.col("model")])
    best = so.best_candidate(numbered, K).select("series_id", F.col("candidate").alias("winner"))
    return numbered.join(best, "series_id").select(
        "series_id", "model", "mean_mae", "last_mae", (F.col("candidate") == F.col("winner")).alias("is_best"))


@query("study_univariate_comparison")
def study_univariate(spark, sf):
    """First-differenced series: closed forms, ARMA, seasonal ARMA, windows, additive trend."""
    diff = wn.difference(P.lineitem_monthly(spark, sf), K, ["y"])
    k, least, m = 5, 20, 12
    long = bl.long_forecasts(bl.forecasts(diff, K, k, least, m), K)
    naive = so.candidate_scores(so.fold_scores(long.filter("model = 'seasonal_naive'"), K), K)
    scales = tr.additive_forecasts(diff, K, k, least, m, tr.scale_grid([0.01, 0.1, 1, 10]))
    additive = so.best_candidate(so.candidate_scores(so.fold_scores(scales, [*K, "candidate"]), [*K, "candidate"]), K)
    arma = {"kind": "arma", "long": 3}
    return compare_models({
        "arma": GridSearch(diff, K, ["y"], arma_grid(range(4), [0], range(3)), arma, k, least),
        "seasonal_arma": GridSearch(diff, K, ["y"], arma_grid(range(2), [0], [0], range(2), [0], [0], m), arma, k, least),
        "window": GridSearch(diff, K, ["y"], [dict(n_in=4, ridge=x) for x in (0.01, 0.1, 1.0)], {"kind": "window", "n_out": 4}, k, least),
    }, {"seasonal_naive": naive, "additive": additive})


@query("study_multivariate_comparison")
def study_multivariate(spark, sf):
    """Two differenced variables: vector ARMA against the multivariate window map."""
    diff = wn.difference(P.orders_monthly_pair(spark, sf), K, ["y", "x"]).withColumn("z", F.col("y") + F.col("x"))
    return compare_models({
        "vector_arma": GridSearch(diff, K, ["y", "x"], arma_grid(range(4), [0], range(2)), {"kind": "arma", "long": 3}, 5, 20),
        "window": GridSearch(diff, K, ["y", "x", "z"], [dict(n_in=4, ridge=x) for x in (0.01, 0.1, 1.0)], {"kind": "window", "n_out": 4}, 5, 20),
    }, {})


@query("study_forecast_next_to_actuals")
def study_aligned(spark, sf):
    """Best ARMA order on differences, its last forecast summed back and laid beside the series."""
    series = P.orders_monthly(spark, sf)
    diff = wn.difference(series, K, ["y"])
    search = GridSearch(diff, K, ["y"], arma_grid(range(4), [0], range(3)), {"kind": "arma", "long": 3}, 5, 20)
    k = search.k
    last = search.forecasts(so.best_candidate(search.scores(), K)).filter(F.col("fold") == k - 1)
    start = diff.select("series_id", "idx", "n").filter(F.col("idx") == F.col("n") - F.floor(F.col("n") / (k + 1))) \
        .select("series_id", F.col("idx").alias("first"))
    base = series.join(start, "series_id").filter("idx = first").select("series_id", F.col("y").alias("b"))
    level = wn.undo_difference(last.select("series_id", "h", "yhat"), base, K, "yhat", "b", "forecast")
    placed = level.join(start, "series_id").select(
        "series_id", (F.col("first") + 1 + F.col("h")).alias("idx"), "forecast")
    return so.align_to_actuals(series.select("series_id", "idx", "y"), placed, K).select(
        "series_id", "idx", rnd("y", 2).alias("y"), rnd("forecast", 2).alias("forecast"))


# ---- country panel -------------------------------------------------------------------------

def country_panel(spark, sf) -> DataFrame:
    """Cumulative daily orders per million inhabitants, from the first day over the threshold."""
    orders = tb.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    customers = tb.read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    daily = panel(orders.join(customers, orders.o_custkey == customers.c_custkey), ["n_nationkey"],
                  "o_orderdate", "day", {"y": F.count("o_custkey").cast("double")})
    total = split.running_sum(daily, ["n_nationkey"], {"total": F.col("y")})
    # the panel study's own membership filter: countries whose population is known
    people = cl.attach_dimension(cl.members(total, _population(spark), "n_nationkey"), _population(spark), "n_nationkey")
    marked = people.withColumn("v", sc.sentinel_below("total", 10)).withColumn(
        "v", F.when(F.col("v") == -1, F.lit(-1.0)).otherwise(sc.per_million("v", "population")))
    aligned = wn.align_to_threshold(marked, ["n_nationkey"], "v")
    return aligned.select("n_nationkey", "population", (F.col("day") - 1).cast("bigint").alias("idx"),
                          (F.col("n") - (F.col("idx") + 1 - F.col("day"))).cast("bigint").alias("n"), "v")


_COUNTRY = (
    f"WITH {POPULATION_SQL}, cells AS (SELECT c_nationkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS pos, "
    "CAST(count(*) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), "
    "edge AS (SELECT min(pos) AS lo, max(pos) AS hi FROM cells), "
    "spine AS (SELECT k, unnest(range(lo, hi + 1)) AS pos, lo FROM (SELECT DISTINCT k FROM cells), edge), "
    "tot AS (SELECT s.k, s.pos - s.lo AS idx, sum(coalesce(c.y, 0)) OVER (PARTITION BY s.k ORDER BY s.pos) AS total "
    "FROM spine s LEFT JOIN cells c ON c.k = s.k AND c.pos = s.pos), "
    "mark AS (SELECT k, idx, population, CASE WHEN total < 10 THEN -1.0 ELSE total / population * 1e6 END AS v FROM tot JOIN pop ON n_nationkey = k WHERE k IN (SELECT n_nationkey FROM pop)), "
    "al AS (SELECT k, idx + 1 - sum(CASE WHEN v = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS day, v FROM mark), "
    "al1 AS (SELECT k, day, v FROM al WHERE day >= 1), "
    "roll AS (SELECT k, day, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS m FROM al1 WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), "
    "chg AS (SELECT k, day, m - lag(m) OVER (PARTITION BY k ORDER BY day) AS d FROM roll), "
    "ld AS (SELECT k, day, lead(d, 7) OVER (PARTITION BY k ORDER BY day) AS d FROM chg) ")


@query("study_country_panel",
       _COUNTRY + f"SELECT CAST(k AS INT) AS n_nationkey, CAST(day AS BIGINT) AS day_nr, {r('d', 6)} AS change FROM ld WHERE d IS NOT NULL")
def study_country(spark, sf):
    """Seven-day mean, daily change, moved forward a week and numbered from day 1."""
    by = ["n_nationkey"]
    smooth = wn.rolling(country_panel(spark, sf), by, "v", {"m": ("mean", 7)})
    change = split.windowed(smooth, by, lambda w: {"d": F.col("m") - F.lag("m", 1).over(w)}, before=1)
    ahead = wn.lead(change, by, "d", 7, "ahead")
    return cl.drop_missing(ahead, ["ahead"]).select(
        "n_nationkey", (F.col("idx") + 1).alias("day_nr"), rnd("ahead", 6).alias("change"))


@query("study_country_polynomial")
def study_country_curve(spark, sf):
    """Degree-8 curve through each country's daily change, scaled back to absolute numbers."""
    by = ["n_nationkey"]
    smooth = wn.rolling(country_panel(spark, sf), by, "v", {"m": ("mean", 7)})
    change = wn.difference(smooth.withColumn("y", F.col("m")).select(*by, "population", "idx", "n", "y"), by, ["y"])
    fits = tr.polynomial_fits(change, by, 8)
    value = tr.polynomial_value(F.col("beta"), F.lit(12), F.col("n"))
    people = change.groupBy(*by).agg(F.max("population").alias("population"))
    return fits.join(people, by).select(
        *by, rnd(value, 6).alias("per_million"), rnd(sc.from_per_million(value, "population"), 4).alias("absolute"))
