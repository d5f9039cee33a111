"""Error measures as aggregate expressions over paired columns (actual y, forecast yhat)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _pair(y, yhat) -> tuple[Column, Column]:
    return (F.col(y) if isinstance(y, str) else y, F.col(yhat) if isinstance(yhat, str) else yhat)


def mae(y="y", yhat="yhat") -> Column:
    """Mean absolute error; NULL if an actual value has no forecast, so that all are compared on the same rows."""
    a, b = _pair(y, yhat)
    return F.when(F.count(a) == F.count(a - b), F.avg(F.abs(a - b)))


def rmse(y="y", yhat="yhat") -> Column:
    a, b = _pair(y, yhat)
    return F.sqrt(F.avg((a - b) * (a - b)))


def mape(y="y", yhat="yhat") -> Column:
    """Mean of |error / actual|; actual 0 is left out (NULL)."""
    a, b = _pair(y, yhat)
    return F.avg(F.abs((a - b) / F.nullif(a, F.lit(0.0))))


def rmspe(y="y", yhat="yhat") -> Column:
    a, b = _pair(y, yhat)
    r = (a - b) / F.nullif(a, F.lit(0.0))
    return F.sqrt(F.avg(r * r))


def sse(y="y", yhat="yhat") -> Column:
    a, b = _pair(y, yhat)
    return F.sum((a - b) * (a - b))


def r2(y="y", yhat="yhat") -> Column:
    """1 - SSE / SST in one pass: SST = (count - 1) * sample variance of the scored actuals."""
    a, b = _pair(y, yhat)
    scored = F.when(b.isNotNull(), a)
    sst = F.var_pop(scored) * F.count(scored)
    return F.lit(1.0) - F.sum((a - b) * (a - b)) / F.nullif(sst, F.lit(0.0))
