"""Differences, rolling statistics, inversion, alignment, samples, slices and keyed lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions import scalars as sc
from loomcast.operators import slices, split, windows as wn
from loomcast.operators.scoring import align_to_actuals
from loomcast.plans import panels as P
from loomcast.plans.panels import r, rnd
from loomcast.plans.registry import query
from loomcast.sources import tables as tb

K = P.K
W = "(PARTITION BY series_id ORDER BY idx)"


def _out(df, **cols):
    return df.select("series_id", F.col("idx").cast("bigint").alias("idx"),
                     *[c.alias(k) for k, c in cols.items()])


# ---- differences -------------------------------------------------------------------------

@query("win1_first_difference",
       f"WITH {P.F2} SELECT series_id, idx - 1 AS idx, {r('d', 2)} AS d FROM "
       f"(SELECT *, y - lag(y) OVER {W} AS d FROM panel) WHERE idx >= 1")
def win1(spark, sf):
    return _out(wn.difference(P.lineitem_monthly(spark, sf), K, ["y"]), d=rnd("y", 2))


@query("win2_seasonal_difference",
       f"WITH {P.F3} SELECT series_id, idx - 24 AS idx, {r('d', 2)} AS d FROM "
       f"(SELECT *, y - lag(y, 24) OVER {W} AS d FROM panel) WHERE idx >= 24")
def win2(spark, sf):
    return _out(wn.difference(P.events_hourly(spark, sf), K, ["y"], 24), d=rnd("y", 2))


@query("win3_second_difference",
       f"WITH {P.F2} SELECT series_id, idx - 2 AS idx, {r('d', 2)} AS d FROM "
       f"(SELECT *, y - 2 * lag(y) OVER {W} + lag(y, 2) OVER {W} AS d FROM panel) WHERE idx >= 2")
def win3(spark, sf):
    return _out(wn.second_difference(P.lineitem_monthly(spark, sf), K, "y"), d=rnd("y", 2))


@query("win4_seasonal_and_first_difference",
       f"WITH {P.F1}, a AS (SELECT series_id, idx, y - lag(y, 12) OVER {W} AS s FROM panel), "
       f"b AS (SELECT series_id, idx, s - lag(s) OVER {W} AS d FROM a WHERE idx >= 12) "
       f"SELECT series_id, idx - 13 AS idx, {r('d', 2)} AS d FROM b WHERE idx >= 13")
def win4(spark, sf):
    seasonal = wn.difference(P.orders_monthly(spark, sf), K, ["y"], 12)
    return _out(wn.difference(seasonal, K, ["y"], 1), d=rnd("y", 2))


@query("win1_multivariate_difference",
       f"WITH {P.F4} SELECT series_id, idx - 1 AS idx, {r('dy', 2)} AS y, {r('dx', 2)} AS x FROM "
       f"(SELECT series_id, idx, y - lag(y) OVER {W} AS dy, x - lag(x) OVER {W} AS dx FROM panel) WHERE idx >= 1")
def win1_multi(spark, sf):
    return _out(wn.difference(P.orders_monthly_pair(spark, sf), K, ["y", "x"]), y=rnd("y", 2), x=rnd("x", 2))


@query("win1_difference_wide_panel",
       f"WITH {P.F5} SELECT series_id, idx - 1 AS idx, {r('d', 2)} AS d FROM "
       f"(SELECT *, y - lag(y) OVER {W} AS d FROM panel) WHERE idx >= 1")
def win1_wide(spark, sf):
    return _out(wn.difference(P.parts_monthly(spark, sf), K, ["y"]), d=rnd("y", 2))


@query("win5_lead",
       f"WITH {P.F3D} SELECT series_id, idx, {r('v', 2)} AS ahead FROM "
       f"(SELECT *, lead(y, 7) OVER {W} AS v FROM panel) WHERE v IS NOT NULL")
def win5(spark, sf):
    out = wn.lead(P.events_daily(spark, sf), K, "y", 7, "ahead").na.drop(subset=["ahead"])
    return _out(out, ahead=rnd("ahead", 2))


# ---- rolling -----------------------------------------------------------------------------

def _rolling_sql(agg, n):
    frame = f"OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y) {frame} = {n} THEN {agg}(y) {frame} END"


@query("win6_rolling_mean",
       f"WITH {P.F3D} SELECT series_id, idx, {r(_rolling_sql('avg', 7))} AS mean7, {r(_rolling_sql('avg', 12))} AS mean12 FROM panel")
def win6(spark, sf):
    out = wn.rolling(P.events_daily(spark, sf), K, "y", {"m7": ("mean", 7), "m12": ("mean", 12)})
    return _out(out, mean7=rnd("m7"), mean12=rnd("m12"))


@query("win7_rolling_std",
       f"WITH {P.F2} SELECT series_id, idx, {r(_rolling_sql('stddev_samp', 12))} AS std12, {r(_rolling_sql('stddev_samp', 24))} AS std24 FROM panel")
def win7(spark, sf):
    out = wn.rolling(P.lineitem_monthly(spark, sf), K, "y", {"s12": ("std", 12), "s24": ("std", 24)})
    return _out(out, std12=rnd("s12"), std24=rnd("s24"))


@query("win8_stationarity_report",
       f"WITH {P.F1} SELECT series_id, idx, {r('y', 2)} AS y, {r(_rolling_sql('avg', 12))} AS roll_mean, "
       f"{r(_rolling_sql('stddev_samp', 12))} AS roll_std FROM panel")
def win8(spark, sf):
    out = wn.stationarity_report(P.orders_monthly(spark, sf), K, "y")
    return _out(out, y=rnd("y", 2), roll_mean=rnd("roll_mean"), roll_std=rnd("roll_std"))


@query("win18_exponential_mean",
       f"WITH {P.F1}, w AS (SELECT a.series_id, a.idx, sum(b.y * power(0.75, a.idx - b.idx)) / sum(power(0.75, a.idx - b.idx)) AS e "
       "FROM panel a JOIN panel b ON a.series_id = b.series_id AND b.idx <= a.idx GROUP BY 1, 2) "
       f"SELECT series_id, idx, {r('e', 3)} AS ewm FROM w")
def win18(spark, sf):
    return _out(wn.exponential_mean(P.orders_monthly(spark, sf), K, "y", 7, "ewm"), ewm=rnd("ewm", 3))


# ---- numbering and alignment -------------------------------------------------------------

@query("win9_row_number",
       "SELECT o_orderkey, o_orderstatus AS series_id, "
       "row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS day_nr FROM orders")
def win9(spark, sf):
    df = tb.read_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("series_id"), "o_orderdate")
    # a bucket is a run of keys within one day, so that no single day or status is one task
    bucket = F.struct("o_orderdate", F.floor(F.col("o_orderkey") / split.CHUNK))
    out = split.row_numbers(df, K, ["o_orderdate", "o_orderkey"], bucket, "day_nr")
    return out.select("o_orderkey", "series_id", "day_nr")


@query("win10_align_to_threshold",
       f"WITH {P.F3}, c AS (SELECT series_id, idx, sum(y) OVER {W} AS total FROM panel), "
       "v AS (SELECT series_id, idx, CASE WHEN total < 5000 THEN -1.0 ELSE total END AS v FROM c), "
       "z AS (SELECT *, sum(CASE WHEN v = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id) AS n0 FROM v) "
       f"SELECT series_id, CAST(idx + 1 - n0 AS BIGINT) AS day, {r('v', 2)} AS v FROM z WHERE idx + 1 - n0 >= 1")
def win10(spark, sf):
    total = split.running_sum(P.events_hourly(spark, sf), K, {"total": F.col("y")})
    marked = total.withColumn("v", sc.sentinel_below("total", 5000))
    return wn.align_to_threshold(marked, K, "v").select(
        "series_id", F.col("day").cast("bigint").alias("day"), rnd("v", 2).alias("v"))


# ---- inversion ---------------------------------------------------------------------------

@query("win12_undo_difference",
       f"WITH {P.F2}, d AS (SELECT series_id, idx, n, y, 0.9 * (y - lag(y) OVER {W}) AS p FROM panel), "
       "base AS (SELECT series_id, y AS b FROM panel WHERE idx = n - 25), "
       "t AS (SELECT * FROM d WHERE idx >= n - 24) "
       f"SELECT t.series_id, t.idx, {r(f'b + sum(p) OVER (PARTITION BY t.series_id ORDER BY t.idx ROWS UNBOUNDED PRECEDING)', 2)} AS y "
       "FROM t JOIN base ON t.series_id = base.series_id")
def win12(spark, sf):
    series = P.lineitem_monthly(spark, sf)
    pred = slices.tail(wn.difference(series, K, ["y"]), 24).select(
        "series_id", (F.col("idx") + 1).alias("idx"), (F.col("idx") - F.col("n") + 24).alias("h"),
        (F.col("y") * 0.9).alias("p"))
    base = series.filter("idx = n - 25").select("series_id", F.col("y").alias("b"))
    return _out(wn.undo_difference(pred, base, K, "p", "b", "yhat"), y=rnd("yhat", 2))


_SEASON_SQL = (f"WITH {P.F1}, d AS (SELECT series_id, idx, n, 0.9 * (y - lag(y, 12) OVER {W}) AS p FROM panel), "
               "t AS (SELECT series_id, idx, idx - n + 24 AS h, p FROM d WHERE idx >= n - 24), ")


def _seasonal_forecast(series):
    return slices.tail(wn.difference(series, K, ["y"], 12), 24).select(
        "series_id", (F.col("idx") + 12).alias("idx"), (F.col("idx") - F.col("n") + 24).alias("h"),
        (F.col("y") * 0.9).alias("p"))


@query("win13_undo_seasonal_difference",
       _SEASON_SQL + "base AS (SELECT series_id, idx - (n - 36) AS s, y AS b FROM panel WHERE idx >= n - 36 AND idx < n - 24) "
       f"SELECT t.series_id, t.idx, {r('b + sum(p) OVER (PARTITION BY t.series_id, t.h % 12 ORDER BY t.idx ROWS UNBOUNDED PRECEDING)', 2)} AS y "
       "FROM t JOIN base ON t.series_id = base.series_id AND t.h % 12 = base.s")
def win13(spark, sf):
    series = P.orders_monthly(spark, sf)
    base = series.filter("idx >= n - 36 AND idx < n - 24").select(
        "series_id", (F.col("idx") - (F.col("n") - 36)).alias("r"), F.col("y").alias("b"))
    return _out(wn.undo_seasonal_difference(_seasonal_forecast(series), base, K, "p", "b", "yhat", 12),
                y=rnd("yhat", 2))


@query("win14_undo_against_fixed",
       _SEASON_SQL + "x AS (SELECT 1) "
       f"SELECT t.series_id, t.idx, {r('t.p + a.y', 2)} AS y FROM t JOIN panel a ON a.series_id = t.series_id AND a.idx = t.idx - 24")
def win14(spark, sf):
    series = P.orders_monthly(spark, sf)
    return _out(wn.undo_against_fixed(_seasonal_forecast(series), series, K, "p", "y", "yhat", 24), y=rnd("yhat", 2))


# ---- samples -----------------------------------------------------------------------------

def _samples_sql(cte, n_in, n_out, cols):
    pick = cols[0] if len(cols) == 1 else "CASE c WHEN " + " WHEN ".join(
        f"{i} THEN {c}" for i, c in enumerate(cols)) + " END"
    col = "" if len(cols) == 1 else "CAST(c AS INT) AS c, "
    cross = "" if len(cols) == 1 else f", range({len(cols)}) t(c)"
    return (f"WITH {cte} SELECT p.series_id, s.sample, CAST(p.idx - s.sample AS INT) AS step, {col}{r(pick, 2)} AS v "
            f"FROM (SELECT series_id, idx AS sample FROM panel WHERE idx + {n_in + n_out} <= n) s "
            f"JOIN panel p ON p.series_id = s.series_id AND p.idx >= s.sample AND p.idx < s.sample + {n_in + n_out}{cross}")


def _steps(df):
    return df.select("series_id", F.col("sample").cast("bigint").alias("sample"),
                     F.posexplode(F.concat("inputs", "targets")).alias("step", "v"))


@query("win15_samples_many_out", _samples_sql(P.F3, 24, 24, ["y"]))
def win15(spark, sf):
    out = _steps(wn.samples(P.events_hourly(spark, sf), K, ["y"], 24, 24))
    return out.select("series_id", "sample", "step", rnd("v", 2).alias("v"))


@query("win16_samples_one_out", _samples_sql(P.F1, 3, 1, ["y"]))
def win16(spark, sf):
    out = _steps(wn.samples(P.orders_monthly(spark, sf), K, ["y"], 3, 1))
    return out.select("series_id", "sample", "step", rnd("v", 2).alias("v"))


@query("win17_samples_multivariate", _samples_sql(P.F4, 4, 4, ["y", "x", "(y + x)"]))
def win17(spark, sf):
    df = P.orders_monthly_pair(spark, sf).withColumn("s", F.col("y") + F.col("x"))
    out = _steps(wn.samples(df, K, ["y", "x", "s"], 4, 4))
    return out.select("series_id", "sample", "step", F.posexplode("v").alias("c", "v")).select(
        "series_id", "sample", "step", "c", rnd("v", 2).alias("v"))


# ---- slices and order --------------------------------------------------------------------

@query("ord1_sort", f"WITH {P.F1} SELECT series_id, idx, {r('y', 2)} AS y FROM panel ORDER BY series_id, idx")
def ord1(spark, sf):
    return _out(P.orders_monthly(spark, sf), y=rnd("y", 2)).orderBy("series_id", "idx")


@query("ord2_first_and_last_rows",
       f"WITH {P.F1} SELECT series_id, idx, CASE WHEN idx < 5 THEN 'head' ELSE 'tail' END AS part, {r('y', 2)} AS y "
       "FROM panel WHERE idx < 5 OR idx >= n - 5")
def ord2(spark, sf):
    df = P.orders_monthly(spark, sf)
    both = slices.head(df, 5).withColumn("part", F.lit("head")).unionByName(
        slices.tail(df, 5).withColumn("part", F.lit("tail")))
    return _out(both, part=F.col("part"), y=rnd("y", 2))


@query("ord2_global_top_rows",
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def ord2_global(spark, sf):
    return tb.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("ord3_drop_last_rows", f"WITH {P.F2} SELECT series_id, idx, n - 12 AS n, {r('y', 2)} AS y FROM panel WHERE idx < n - 12")
def ord3(spark, sf):
    df = slices.drop_tail(P.lineitem_monthly(spark, sf), 12)
    return _out(df, n=F.col("n").cast("bigint"), y=rnd("y", 2))


@query("ord4_last_rows_as_test", f"WITH {P.F2} SELECT series_id, idx, idx >= n - 24 AS is_test, {r('y', 2)} AS y FROM panel")
def ord4(spark, sf):
    return _out(slices.label_test(P.lineitem_monthly(spark, sf), 24), is_test=F.col("is_test"), y=rnd("y", 2))


# ---- joins of series ---------------------------------------------------------------------

@query("join5_align_forecast_to_actuals",
       f"WITH {P.F1} SELECT series_id, idx, {r('y', 2)} AS y, CASE WHEN idx >= n - 12 THEN "
       f"{r(f'lag(y, 12) OVER {W}', 2)} END AS yhat FROM panel")
def join5(spark, sf):
    df = P.orders_monthly(spark, sf)
    pred = df.filter("idx >= n - 24 AND idx < n - 12").select(
        "series_id", (F.col("idx") + 12).alias("idx"), F.col("y").alias("yhat"))
    return _out(align_to_actuals(df.select("series_id", "idx", "y"), pred, K), y=rnd("y", 2), yhat=rnd("yhat", 2))


@query("set3_known_prefix_and_prediction",
       f"WITH {P.F1} SELECT series_id, idx, {r(f'CASE WHEN idx >= n - 12 THEN lag(y, 12) OVER {W} ELSE y END', 2)} AS v FROM panel")
def set3(spark, sf):
    df = P.orders_monthly(spark, sf)
    pred = df.filter("idx >= n - 24 AND idx < n - 12").select(
        "series_id", (F.col("idx") + 12).alias("idx"), F.col("y").alias("yhat"))
    out = align_to_actuals(df.select("series_id", "idx", "y"), pred, K)
    return _out(out, v=rnd(F.coalesce("yhat", "y"), 2))


@query("join7_lag_by_calendar_key",
       "WITH c AS (SELECT l_partkey AS series_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS pos, "
       "sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2) "
       f"SELECT a.series_id, a.pos, {r('a.y - b.y', 2)} AS d FROM c a JOIN c b ON a.series_id = b.series_id AND a.pos = b.pos + 12")
def join7(spark, sf):
    from loomcast.sources.series import cells
    df = tb.read_table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "series_id")
    obs = cells(df, K, "l_shipdate", "month", {"y": F.sum("l_quantity")})
    out = wn.lag_by_key(obs, K, "y", 12, "before").na.drop(subset=["before"])
    return out.select("series_id", "pos", rnd(F.col("y") - F.col("before"), 2).alias("d"))
