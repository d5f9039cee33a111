"""Scalar expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentinel_below(value: Column | str, limit: float, sentinel: float = -1.0) -> Column:
    """Values under ``limit`` become the sentinel; NULL stays NULL."""
    v = _c(value)
    return F.when(v < limit, F.lit(sentinel)).otherwise(v)


def per_million(value: Column | str, population: Column | str) -> Column:
    return _c(value) / _c(population) * 1e6


def from_per_million(value: Column | str, population: Column | str) -> Column:
    return _c(value) * _c(population) / 1e6


def strip_thousands(text: Column | str) -> Column:
    """'2,013' -> '2013'."""
    return F.regexp_replace(_c(text), ",", "")


def nan_to_null(value: Column | str) -> Column:
    v = _c(value)
    return F.when(~F.isnan(v), v)


def zero_to_null(value: Column | str) -> Column:
    return F.nullif(_c(value), F.lit(0.0))


def powers(value: Column | str, degree: int) -> Column:
    """[1, v, v^2, ..., v^degree] by repeated multiplication."""
    v = _c(value)
    terms = [F.lit(1.0)]
    for _ in range(degree):
        terms.append(terms[-1] * v)
    return F.array(*terms)


def scaled_time(idx: Column | str, n: Column | str) -> Column:
    """Positions 0..n-1 mapped to [-1, 1], to keep polynomial sums well conditioned."""
    i, size = _c(idx), _c(n)
    return F.when(size > 1, i * 2.0 / (size - 1) - 1.0).otherwise(F.lit(0.0))
