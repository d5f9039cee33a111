"""Autocorrelation, partial autocorrelation, AICc and the portmanteau statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.operators.split import CHUNK, windowed, with_series_totals


def autocorrelation(df: DataFrame, keys: Sequence[str], col: str, lags: int, *, size: int = CHUNK) -> DataFrame:
    """r_1..r_lags per series as (keys, lag, r, n, pairs), from sums that combine map-side.

    Values are centred before they are multiplied, so a high level costs no digits. A product counts where
    both values are known; ``n`` is the number of known values, ``pairs`` that of products.
    """
    totals = with_series_totals(df.select(*keys, "idx", "n", col), keys,
                                {"_s": (F.sum(col), "sum"), "_m": (F.count(col), "sum")}, size=size)
    flat = totals.withColumn("_v", F.col(col) - F.col("_s") / F.nullif(F.col("_m"), F.lit(0)))
    lagged = windowed(
        flat, keys, lambda w: {f"_l{k}": F.lag("_v", k).over(w) for k in range(1, lags + 1)}, before=lags, size=size)
    span = range(1, lags + 1)
    # SQL texts: two sums per lag, each a single call
    sums = lagged.groupBy(*keys).agg(
        F.expr("count(_v) AS n"), F.expr("sum(_v * _v) AS q"),
        F.expr("array(" + ", ".join(f"sum(_v * _l{k})" for k in span) + ") AS c"),
        F.expr("array(" + ", ".join(f"count(_v * _l{k})" for k in span) + ") AS m"))
    rows = sums.select(*keys, "n", "q", F.posexplode(F.arrays_zip("c", "m")).alias("_p", "z"))
    return rows.select(*keys, "n", (F.col("_p") + 1).alias("lag"),
                       (F.coalesce("z.c", F.lit(0.0)) / F.nullif(F.col("q"), F.lit(0.0))).alias("r"), F.col("z.m").alias("pairs"))


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """Durbin-Levinson recursion over the (short) list of autocorrelations of a series."""
    r = F.transform(F.sort_array(F.collect_list(F.struct("lag", "r"))), lambda e: e["r"])
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"),
                     F.array().cast("array<double>").alias("out"))

    def advance(acc, k):
        phi, v = acc["phi"], acc["v"]
        past = F.transform(phi, lambda p, i: p * F.get(F.col("_r"), k - 2 - i))
        num = F.get(F.col("_r"), k - 1) - F.aggregate(past, F.lit(0.0), lambda s, x: s + x)
        a = num / v
        older = F.transform(phi, lambda p, i: p - a * F.get(phi, F.size(phi) - 1 - i))
        return F.struct(F.concat(older, F.array(a)).alias("phi"), (v * (1.0 - a * a)).alias("v"),
                        F.concat(acc["out"], F.array(a)).alias("out"))

    rows = acf.groupBy(*keys).agg(r.alias("_r")).filter(F.forall("_r", lambda x: x.isNotNull()))
    out = rows.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, advance,
                                         lambda acc: acc["out"]).alias("_o"))
    return out.select(*keys, F.posexplode("_o").alias("_p", "pacf")).select(
        *keys, (F.col("_p") + 1).alias("lag"), "pacf")


def portmanteau(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ljung-Box statistic n (n + 2) sum r_k^2 / (n - k)."""
    return acf.groupBy(*keys).agg(
        (F.max("n") * (F.max("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"),
        F.max("lag").alias("lags"))


def aicc(n: Column, sse: Column, params: int) -> Column:
    """n ln(SSE / n) + 2k + 2k(k+1)/(n-k-1)."""
    k = params
    return n * F.log(sse / n) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)
