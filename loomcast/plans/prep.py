"""Sources, projections, filters, reshapes, joins, plain aggregates, unions and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomcast.functions import calendar as cal, scalars as sc
from loomcast.operators import cleaning as cl, split
from loomcast.plans import panels as P
from loomcast.plans.panels import r, rnd
from loomcast.plans.registry import query
from loomcast.session import shared_dir
from loomcast.sources import tables as tb

K = P.K

# Inhabitants of 17 countries in alphabetical order, keyed here by nation number.
POPULATION = [
    9006398, 9449323, 11589623, 10708981, 5792202, 65273511, 83783942, 4937786, 60461826,
    17134872, 5421241, 10196709, 2078938, 46754778, 10099265, 8654622, 67886011,
]
POPULATION_ROWS = list(enumerate(POPULATION))
POPULATION_SQL = (
    "pop AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {v})" for k, v in POPULATION_ROWS)
    + ") AS v(n_nationkey, population))"
)


def _population(spark):
    return tb.inline_rows(spark, POPULATION_ROWS, "n_nationkey int, population bigint")


# ---- sources and sinks -------------------------------------------------------------------

_MONTHLY_SQL = (
    "SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INT) AS year, "
    "CAST(month(o_orderdate) AS INT) AS month, "
    f"{r('avg(o_totalprice)', 6)} AS mean_price, {r('sum(o_totalprice)', 2)} AS total_price "
    "FROM orders GROUP BY 1, 2, 3"
)
_MONTHLY_SCHEMA = "priority string, year int, month int, mean_price double, total_price double"


def _monthly_csv(spark, sf):
    df = tb.read_table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    ).agg(rnd(F.avg("o_totalprice"), 6).alias("mean_price"), rnd(F.sum("o_totalprice"), 2).alias("total_price"))
    return tb.write_csv(df, f"{shared_dir(spark)}/monthly-{uuid.uuid4().hex}")


@query("src1_csv_scan", _MONTHLY_SQL)
def src1(spark, sf):
    return tb.scan_csv(spark, _monthly_csv(spark, sf), _MONTHLY_SCHEMA)


@query("src2_csv_column_subset",
       f"SELECT priority, year, month, mean_price FROM ({_MONTHLY_SQL})")
def src2(spark, sf):
    return tb.scan_csv(spark, _monthly_csv(spark, sf), _MONTHLY_SCHEMA,
                       ["priority", "year", "month", "mean_price"])


@query("src3_rename_by_position",
       "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def src3(spark, sf):
    return tb.rename_by_position(tb.read_table(spark, sf, "supplier"), ["key", "name", "nation", "balance"])


@query("src4_inline_dimension",
       f"WITH {POPULATION_SQL} SELECT CAST(c_nationkey AS INT) AS n_nationkey, "
       "CAST(max(population) AS BIGINT) AS population, count(*) AS customers "
       "FROM customer LEFT JOIN pop ON c_nationkey = n_nationkey GROUP BY 1")
def src4(spark, sf):
    customers = tb.read_table(spark, sf, "customer").groupBy(
        F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return cl.attach_dimension(customers, _population(spark), "n_nationkey").select(
        "n_nationkey", "population", "customers")


@query("src5_date_spine",
       "SELECT o_orderstatus AS status, strftime(d, '%Y-%m-%d') AS ds, "
       "row_number() OVER (PARTITION BY o_orderstatus ORDER BY d) AS day_nr, "
       "100 + row_number() OVER (PARTITION BY o_orderstatus ORDER BY d) AS add1 FROM ("
       "SELECT o_orderstatus, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM ("
       "SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi "
       "FROM orders GROUP BY 1))")
def src5(spark, sf):
    span = tb.read_table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    spine = tb.date_spine(span, "lo", "hi")
    return spine.select("status", F.date_format("ds", "yyyy-MM-dd").alias("ds"),
                        F.col("day_nr").cast("bigint").alias("day_nr"),
                        (F.col("day_nr") + 100).cast("bigint").alias("add1"))


@query("src6_parameter_grid",
       "SELECT DISTINCT o_orderpriority AS series_id, CAST((p.p * 3 + d.d) * 5 + q.q AS INT) AS candidate, "
       "CAST(p.p AS INT) AS p, CAST(d.d AS INT) AS d, CAST(q.q AS INT) AS q "
       "FROM orders, range(5) p(p), range(3) d(d), range(5) q(q)")
def src6(spark, sf):
    grid = tb.grid_column({"p": range(5), "d": range(3), "q": range(5)}, {"p": "int", "d": "int", "q": "int"})
    series = tb.read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    return series.select("series_id", F.inline(grid))


_YEARLY_SQL = (
    "SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INT) AS year, "
    f"{r('avg(l_quantity)', 6)} AS mean_quantity FROM lineitem GROUP BY 1, 2"
)


@query("snk1_csv_sink", _YEARLY_SQL)
def snk1(spark, sf):
    df = tb.read_table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year")
    ).agg(rnd(F.avg("l_quantity"), 6).alias("mean_quantity"))
    path = tb.write_csv(df, f"{shared_dir(spark)}/yearly-{uuid.uuid4().hex}")
    return tb.scan_csv(spark, path, "flag string, year int, mean_quantity double")


@query("snk1_parquet_panel_sink",
       f"WITH {P.F2} SELECT series_id, CAST(idx AS BIGINT) AS idx, {r('y', 2)} AS y FROM panel")
def snk1_panel(spark, sf):
    path = f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    tb.write_panel(P.lineitem_monthly(spark, sf), path, K)
    return spark.read.parquet(path).select("series_id", "idx", rnd("y", 2).alias("y"))


# ---- projections -------------------------------------------------------------------------

@query("prj1_select", "SELECT o_orderkey, o_totalprice FROM orders")
def prj1(spark, sf):
    return tb.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("prj2_rename", "SELECT s_suppkey AS supplier, s_acctbal AS balance, s_name, s_nationkey FROM supplier")
def prj2(spark, sf):
    return tb.read_table(spark, sf, "supplier").withColumnsRenamed(
        {"s_suppkey": "supplier", "s_acctbal": "balance"})


@query("prj3_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def prj3(spark, sf):
    return tb.read_table(spark, sf, "customer").drop("c_name", "c_mktsegment")


@query("prj4_cast",
       "SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(floor(o_totalprice) AS BIGINT) AS price_int, "
       "CAST(o_custkey AS DOUBLE) AS cust_real, "
       "TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, "
       "TRY_CAST(o_orderstatus AS INT) AS bad FROM orders")
def prj4(spark, sf):
    return tb.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.floor("o_totalprice").cast("bigint").alias("price_int"),
        F.col("o_custkey").cast("double").alias("cust_real"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        F.col("o_orderstatus").try_cast("int").alias("bad"))


_COMMA_YEAR_SQL = ("(SELECT o_totalprice, substr(CAST(year(o_orderdate) AS VARCHAR), 1, 1) || ',' || "
                   "substr(CAST(year(o_orderdate) AS VARCHAR), 2, 3) AS year_text FROM orders)")


@query("prj5_replace_values",
       f"SELECT replace(year_text, ',', '') AS year_text, count(*) AS rows_seen FROM {_COMMA_YEAR_SQL} GROUP BY 1")
def prj5(spark, sf):
    year = F.year("o_orderdate").cast("string")
    df = tb.read_table(spark, sf, "orders").select(
        F.concat(F.substring(year, 1, 1), F.lit(","), F.substring(year, 2, 3)).alias("year_text"))
    mapped = df.replace({"1,995": "1995", "1,996": "1996", "1,997": "1997"}, subset=["year_text"])
    return mapped.groupBy(sc.strip_thousands("year_text").alias("year_text")).agg(
        F.count(F.lit(1)).alias("rows_seen"))


@query("prj6_threshold_sentinel",
       "SELECT c_custkey, CASE WHEN c_acctbal < 10 THEN -1.0 ELSE c_acctbal END AS balance FROM customer")
def prj6(spark, sf):
    return tb.read_table(spark, sf, "customer").select(
        "c_custkey", sc.sentinel_below("c_acctbal", 10).alias("balance"))


@query("prj7_sum_of_variables",
       f"WITH {P.F4} SELECT series_id, CAST(idx AS BIGINT) AS idx, {r('y + x', 2)} AS total FROM panel")
def prj7(spark, sf):
    return P.orders_monthly_pair(spark, sf).select("series_id", "idx", rnd(F.col("y") + F.col("x"), 2).alias("total"))


def _balance_per_nation(spark, sf):
    totals = tb.read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.sum("c_acctbal").alias("balance"))
    return cl.attach_dimension(totals, _population(spark), "n_nationkey")


_BALANCE_SQL = (f"WITH {POPULATION_SQL}, b AS (SELECT c_nationkey AS n_nationkey, sum(c_acctbal) AS balance "
                "FROM customer GROUP BY 1) ")


@query("prj8_per_million",
       _BALANCE_SQL + f"SELECT n_nationkey, {r('balance / population * 1e6', 6)} AS per_million FROM b LEFT JOIN pop USING (n_nationkey)")
def prj8(spark, sf):
    return _balance_per_nation(spark, sf).select(
        "n_nationkey", rnd(sc.per_million("balance", "population"), 6).alias("per_million"))


@query("prj9_scale_back",
       _BALANCE_SQL + f"SELECT n_nationkey, CASE WHEN population IS NOT NULL THEN {r('balance', 2)} END AS balance FROM b LEFT JOIN pop USING (n_nationkey)")
def prj9(spark, sf):
    per = _balance_per_nation(spark, sf).withColumn("pm", sc.per_million("balance", "population"))
    return per.select("n_nationkey", rnd(sc.from_per_million("pm", "population"), 2).alias("balance"))


@query("prj10_round",
       "SELECT o_orderkey, round(o_totalprice * 0.00123457, 3) AS rounded, "
       "CAST(round_even(o_totalprice * 0.00123457, 1) AS DOUBLE) AS half_even FROM orders")
def prj10(spark, sf):
    x = F.col("o_totalprice") * F.lit(0.00123457)
    return tb.read_table(spark, sf, "orders").select(
        "o_orderkey", F.round(x, 3).alias("rounded"), F.bround(x, 1).alias("half_even"))


@query("prj11_keys_as_columns",
       "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS orders "
       "FROM orders GROUP BY 1, 2")
def prj11(spark, sf):
    return tb.read_table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).alias("orders"))


# ---- filters -----------------------------------------------------------------------------

@query("fil1_equality", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND day(o_orderdate) = 1")
def fil1(spark, sf):
    return tb.read_table(spark, sf, "orders").filter(
        (F.col("o_orderstatus") == "F") & (F.dayofmonth("o_orderdate") == 1)).select("o_orderkey", "o_orderstatus")


@query("fil2_inequality_keeps_missing",
       "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer "
       "WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY' OR nullif(c_mktsegment, 'BUILDING') IS NULL")
def fil2(spark, sf):
    df = tb.read_table(spark, sf, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return cl.keep_not_equal(df, "segment", "MACHINERY")


@query("fil3_range", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def fil3(spark, sf):
    return tb.read_table(spark, sf, "orders").filter(
        F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    ).select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("fil4_member_and_null",
       "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (0, 2, 4, 6, 8, 10) "
       "AND nullif(c_mktsegment, 'AUTOMOBILE') IS NULL")
def fil4(spark, sf):
    return tb.read_table(spark, sf, "customer").filter(
        F.col("c_nationkey").isin(0, 2, 4, 6, 8, 10)
        & F.nullif(F.col("c_mktsegment"), F.lit("AUTOMOBILE")).isNull()
    ).select("c_custkey", "c_nationkey")


@query("fil5_time_cut",
       "SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS split, count(*) AS rows_seen, "
       f"{r('sum(value)', 2)} AS total FROM events GROUP BY 1")
def fil5(spark, sf):
    df = cl.label_split(tb.read_table(spark, sf, "events"), F.col("ts"),
                        F.lit("2024-01-21").cast("timestamp_ntz"))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows_seen"), rnd(F.sum("value"), 2).alias("total"))


@query("fil6_drop_missing",
       "SELECT event_id, value FROM (SELECT event_id, CASE WHEN value >= 20 THEN value END AS value FROM events) "
       "WHERE value IS NOT NULL")
def fil6(spark, sf):
    df = tb.read_table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return cl.drop_missing(df, ["value"])


@query("fil7_drop_all_missing_periods",
       f"WITH {P.F3}, v AS (SELECT series_id, idx, CASE WHEN y >= 200 THEN y END AS y FROM panel) "
       f"SELECT series_id, CAST(idx AS BIGINT) AS idx, {r('y', 2)} AS y FROM v "
       "WHERE idx IN (SELECT idx FROM v GROUP BY idx HAVING count(y) > 0)")
def fil7(spark, sf):
    df = P.events_hourly(spark, sf).withColumn("y", F.when(F.col("y") >= 200, F.col("y")))
    return cl.drop_all_missing_periods(df, "idx", "y").select("series_id", "idx", rnd("y", 2).alias("y"))


# ---- reshapes ----------------------------------------------------------------------------

@query("rsh1_wide_years_to_long",
       "SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, "
       f"{r('avg(l_quantity)')} AS y FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2")
def rsh1(spark, sf):
    """Monthly means as one column per year of the data, and back to a long series."""
    cells = tb.read_table(spark, sf, "lineitem").select(
        F.month("l_shipdate").alias("month"), F.year("l_shipdate").alias("yr"), "l_quantity")
    means = cells.groupBy("month", "yr").agg(F.avg("l_quantity").alias("y"))
    years = cl.column_values(cells, "yr")
    wide = cl.long_to_wide(means, ["month"], "yr", years, "y")
    long = cl.wide_to_long(wide, ["month"], [str(y) for y in years], "year", "y")
    return cl.drop_missing(long, ["y"]).select(
        F.col("year").cast("int").alias("year"), "month", rnd("y").alias("y")).orderBy("year", "month")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("rsh2_transpose_panel",
       f"WITH {P.F1} SELECT CAST(idx AS BIGINT) AS idx, "
       + ", ".join(r(f"max(CASE WHEN series_id = '{p}' THEN y END)", 2) + f" AS s{i}" for i, p in enumerate(PRIORITIES))
       + ", " + r("sum(CASE WHEN series_id NOT IN (" + ", ".join(f"'{p}'" for p in PRIORITIES) + ") THEN y END)", 2)
       + " AS other FROM panel GROUP BY idx")
def rsh2(spark, sf):
    wide = cl.long_to_wide(P.orders_monthly(spark, sf), ["idx"], "series_id", PRIORITIES, "y", other="other")
    return wide.select("idx", *[rnd(F.col(f"`{p}`"), 2).alias(f"s{i}") for i, p in enumerate(PRIORITIES)], rnd("other", 2).alias("other"))


@query("rsh3_column_stack",
       f"WITH {P.F4} SELECT series_id, CAST(idx AS BIGINT) AS idx, CAST(c AS INT) AS c, "
       f"{r('CASE c WHEN 0 THEN y WHEN 1 THEN x ELSE y + x END', 2)} AS v FROM panel, range(3) t(c)")
def rsh3(spark, sf):
    stacked = P.orders_monthly_pair(spark, sf).select(
        "series_id", "idx", F.array("y", "x", F.col("y") + F.col("x")).alias("m"))
    return stacked.select("series_id", "idx", F.posexplode("m").alias("c", "v")).select(
        "series_id", "idx", "c", rnd("v", 2).alias("v"))


@query("rsh4_flatten",
       "SELECT l_orderkey, CAST(i AS INT) AS i, CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS v "
       "FROM lineitem, range(3) t(i)")
def rsh4(spark, sf):
    return tb.read_table(spark, sf, "lineitem").select(
        "l_orderkey", F.posexplode(F.array("l_quantity", "l_discount", "l_tax")).alias("i", "v"))


# ---- joins -------------------------------------------------------------------------------

@query("join1_attach_second_series",
       "WITH a AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS mean_order FROM orders GROUP BY 1, 2), "
       "b AS (SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, avg(l_extendedprice) AS mean_line FROM lineitem GROUP BY 1, 2) "
       f"SELECT CAST(a.y AS INT) AS year, CAST(a.m AS INT) AS month, {r('mean_order')} AS mean_order, {r('mean_line')} AS mean_line "
       "FROM a JOIN b ON a.y = b.y AND a.m = b.m")
def join1(spark, sf):
    temp = tb.read_table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.avg("o_totalprice").alias("mean_order"))
    named = tb.read_table(spark, sf, "lineitem").groupBy(
        F.year("l_shipdate").alias("year"), F.date_format("l_shipdate", "MMMM").alias("month_name")
    ).agg(F.avg("l_extendedprice").alias("mean_line"))
    lines = named.select("year", cal.month_number("month_name").alias("month"), "mean_line")
    return cl.attach_series(temp, lines, ["year", "month"]).select(
        "year", "month", rnd("mean_order").alias("mean_order"), rnd("mean_line").alias("mean_line"))


@query("join2_population_dimension",
       f"WITH {POPULATION_SQL} SELECT c_custkey, population, {r('c_acctbal / population * 1e6', 6)} AS per_million "
       "FROM customer LEFT JOIN pop ON c_nationkey = n_nationkey")
def join2(spark, sf):
    cust = tb.read_table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return cl.attach_dimension(cust, _population(spark), "n_nationkey").select(
        "c_custkey", "population", rnd(sc.per_million("c_acctbal", "population"), 6).alias("per_million"))


@query("join8_densify",
       f"WITH {P.F3} SELECT series_id, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n, {r('y', 2)} AS y FROM panel")
def join8(spark, sf):
    return P.events_hourly(spark, sf).select("series_id", "idx", "n", rnd("y", 2).alias("y"))


@query("join8_densify_own_span",
       "WITH c AS (SELECT l_suppkey AS series_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS pos, "
       "avg(l_discount) AS y FROM lineitem GROUP BY 1, 2), "
       "s AS (SELECT series_id, lo, unnest(range(lo, hi + 1)) AS pos FROM "
       "(SELECT series_id, min(pos) AS lo, max(pos) AS hi FROM c GROUP BY 1)) "
       f"SELECT s.series_id, s.pos - s.lo AS idx, {r('c.y', 6)} AS y FROM s LEFT JOIN c ON c.series_id = s.series_id AND c.pos = s.pos")
def join8_own(spark, sf):
    from loomcast.sources.series import panel
    df = tb.read_table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "series_id")
    dense = panel(df, K, "l_shipdate", "month", {"y": F.avg("l_discount")}, fill=None, bounds="series")
    return dense.select("series_id", "idx", rnd("y", 6).alias("y"))


# ---- aggregates --------------------------------------------------------------------------

@query("agg1_count_per_group",
       "SELECT c_mktsegment AS segment, count(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) AS n FROM customer "
       "WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def agg1(spark, sf):
    return tb.read_table(spark, sf, "customer").filter("c_mktsegment IS NOT NULL").groupBy(
        F.col("c_mktsegment").alias("segment")
    ).agg(F.count(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("n"))


@query("agg2_count_two_keys",
       "SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS status, count(o_totalprice) AS n FROM orders GROUP BY 1, 2")
def agg2(spark, sf):
    return tb.read_table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")
    ).agg(F.count("o_totalprice").alias("n"))


@query("agg3_mean_per_group",
       f"SELECT CAST(year(o_orderdate) AS INT) AS year, {r('avg(o_totalprice)')} AS mean_price FROM orders GROUP BY 1")
def agg3(spark, sf):
    return tb.read_table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        rnd(F.avg("o_totalprice")).alias("mean_price"))


@query("agg4_mean_in_calendar_order",
       f"SELECT strftime(l_shipdate, '%B') AS month_name, CAST(month(l_shipdate) AS INT) AS month_no, {r('avg(l_quantity)', 6)} AS mean_quantity "
       "FROM lineitem GROUP BY 1, 2 ORDER BY 2")
def agg4(spark, sf):
    means = tb.read_table(spark, sf, "lineitem").groupBy(
        F.date_format("l_shipdate", "MMMM").alias("month_name")).agg(rnd(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return means.withColumn("month_no", cal.month_number("month_name")).orderBy("month_no")


@query("agg5_mean_of_every_column",
       "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS col, {r(f'avg({c})', 6)} AS mean FROM lineitem"
           for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def agg5(spark, sf):
    return cl.column_means(tb.read_table(spark, sf, "lineitem"),
                           ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "col", "mean").select(
        "col", rnd("mean", 6).alias("mean"))


@query("agg6_global_max", "SELECT max(l_extendedprice) AS max_price FROM lineitem")
def agg6(spark, sf):
    return tb.read_table(spark, sf, "lineitem").agg(F.max("l_extendedprice").alias("max_price"))


@query("agg7_frequency_of_value",
       "SELECT c_nationkey, CAST(sum(CASE WHEN c_acctbal < 10 THEN 1 ELSE 0 END) AS BIGINT) AS sentinel_days FROM customer GROUP BY 1")
def agg7(spark, sf):
    v = sc.sentinel_below("c_acctbal", 10)
    return tb.read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(v == -1).alias("sentinel_days"))


@query("agg8_coverage",
       "SELECT o_orderpriority AS series_id, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, "
       "strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS rows_seen, "
       "max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def agg8(spark, sf):
    df = tb.read_table(spark, sf, "orders")
    return df.groupBy(F.col("o_orderpriority").alias("series_id")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
        F.count(F.lit(1)).alias("rows_seen"),
        F.max_by("o_orderkey", "o_orderkey").alias("last_key"))


@query("agg9_annual_rollup",
       f"WITH {P.F4} SELECT series_id, CAST(pos // 12 AS INT) AS year, {r('avg(y)')} AS mean_y, {r('avg(x)', 6)} AS mean_x "
       "FROM panel GROUP BY 1, 2")
def agg9(spark, sf):
    return P.orders_monthly_pair(spark, sf).groupBy(
        "series_id", F.year(cal.period_start("pos", "month")).alias("year")
    ).agg(rnd(F.avg("y")).alias("mean_y"), rnd(F.avg("x"), 6).alias("mean_x"))


# ---- unions ------------------------------------------------------------------------------

@query("set1_append_patch_row",
       "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n, "
       f"{r('avg(o_totalprice)')} AS mean_price FROM orders GROUP BY 1, 2 "
       "UNION ALL SELECT 2001, 9, NULL, 125000.5")
def set1(spark, sf):
    df = tb.read_table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice")).alias("mean_price"))
    patch = tb.inline_rows(spark, [(2001, 9, 125000.5)], "year int, month int, mean_price double")
    return cl.append_rows(df, patch)


# ---- scalars -----------------------------------------------------------------------------

@query("scl1_concat_month_year",
       "SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) || CAST(year(o_orderdate) AS VARCHAR) AS month_year FROM orders")
def scl1(spark, sf):
    return tb.read_table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")).alias("month_year"))


@query("scl2_parse_dates",
       "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, "
       "strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year_start, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def scl2(spark, sf):
    text = tb.read_table(spark, sf, "orders").select(
        "o_orderkey", F.month("o_orderdate").cast("string").alias("m"), F.year("o_orderdate").cast("string").alias("y"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return text.select(
        "o_orderkey",
        cal.month_year_date("m", "y").cast("string").alias("month_start"),
        cal.month_year_date(F.lit("1"), "y").cast("string").alias("year_start"),
        F.to_date("d", "yyyy-MM-dd").cast("string").alias("day"))


@query("scl3_arithmetic",
       f"SELECT l_orderkey, {r('abs(l_extendedprice - l_quantity * 1000)', 2)} AS abs_err, "
       f"{r('l_extendedprice - l_quantity', 2)} AS diff, {r('l_extendedprice / l_quantity')} AS ratio, "
       f"{r('l_extendedprice * l_discount')} AS product FROM lineitem")
def scl3(spark, sf):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return tb.read_table(spark, sf, "lineitem").select(
        "l_orderkey", rnd(F.abs(p - q * 1000), 2).alias("abs_err"), rnd(p - q, 2).alias("diff"),
        rnd(p / q).alias("ratio"), rnd(p * F.col("l_discount")).alias("product"))


@query("scl4_zero_to_missing", "SELECT l_orderkey, nullif(l_discount, 0) AS discount FROM lineitem")
def scl4(spark, sf):
    return tb.read_table(spark, sf, "lineitem").select("l_orderkey", sc.zero_to_null("l_discount").alias("discount"))


@query("scl5_arrays",
       "SELECT l_orderkey, CAST(4 AS INT) AS len, l_discount AS second, l_tax AS third FROM lineitem")
def scl5(spark, sf):
    a = F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    cut = F.slice(a, 2, 2)
    return tb.read_table(spark, sf, "lineitem").select(
        "l_orderkey", F.size(a).alias("len"), cut[0].alias("second"), cut[1].alias("third"))


@query("scl6_integer_label",
       "SELECT CAST(strftime(o_orderdate, '%Y') AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
def scl6(spark, sf):
    return tb.read_table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("scl7_powers",
       "SELECT l_orderkey, CAST(k AS INT) AS k, round(power(l_discount, k), 9) + 0.0 AS v FROM lineitem, range(9) t(k)")
def scl7(spark, sf):
    return tb.read_table(spark, sf, "lineitem").select(
        "l_orderkey", F.posexplode(sc.powers("l_discount", 8)).alias("k", "v")
    ).select("l_orderkey", "k", rnd("v", 9).alias("v"))


@query("win11_forward_fill",
       "WITH d AS (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2), "
       "s AS (SELECT *, CASE WHEN day(day) <= 2 THEN strftime(day, '%B') END AS label FROM d) "
       "SELECT status, strftime(day, '%Y-%m-%d') AS day, n, "
       "last_value(label IGNORE NULLS) OVER (PARTITION BY status ORDER BY day ROWS UNBOUNDED PRECEDING) AS month_name FROM s")
def win11(spark, sf):
    days = tb.read_table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))
    sparse = days.withColumn("label", F.when(F.dayofmonth("day") <= 2, F.date_format("day", "MMMM")))
    filled = split.forward_fill(sparse, ["status"], "day", "label", F.year("day"), "month_name")
    return filled.select("status", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "month_name")
