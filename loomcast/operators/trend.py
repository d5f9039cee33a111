"""Trend models from sums over deterministic columns: polynomial, and additive trend + season.

The design columns are expressions of the calendar position, so their normal matrix is a set of
native sums per (series, block) and the forecast is an expression again; only the tiny solve
runs in an Arrow task. Knots lie on a fixed grid over the whole series: a training set that
ends earlier sees the later hinge columns as zeros and gives them coefficient 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.functions.scalars import powers, scaled_time
from loomcast.operators import solvers as sv
from loomcast.operators.folds import attach_fold_values, test_rows, train_prefix_packed
from loomcast.operators.solver_tasks import DOUBLES_PER_SLICE, _key_ddl, _matrix, _spread
from loomcast.operators.split import CHUNK
from loomcast.shipping import shipped

PENALTY = 1e-3  # penalty on the correlation scale at prior scale 1


def additive_design(m: int, knots: int, order: int, regressors: Sequence[str] = ()) -> list[Column]:
    """[1, time, regressors, hinges, sine and cosine terms] of a row."""
    u = scaled_time("idx", "n")
    cols = [F.lit(1.0), u, *[F.col(c) for c in regressors]]
    for j in range(1, knots + 1):
        at = 2.0 * j / (knots + 1) - 1.0
        cols.append(F.greatest(u - at, F.lit(0.0)))
    for i in range(1, order + 1):
        angle = F.pmod(F.col("pos") * i, F.lit(m)) * (2.0 * math.pi / m)
        cols += [F.sin(angle), F.cos(angle)]
    return cols


def with_design(df: DataFrame, design: Sequence[Column], y: str = "y") -> DataFrame:
    """Add the design as columns _x_0.. and the target as _y, all NULL where any of them is.

    The aggregates below then name columns: the expressions are evaluated once per row and the
    plan stays small.
    """
    names = [f"_x_{i}" for i in range(len(design))]
    out = df.select("*", *[x.alias(n) for n, x in zip(names, design)])
    known = F.col(y).isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    out = out.withColumn("_ok", known)
    return out.select(
        *df.columns, *[F.when(F.col("_ok"), F.col(n)).alias(n) for n in names],
        F.when(F.col("_ok"), F.col(y)).alias("_y"))


def normal_sums(z: int) -> list[str]:
    """Upper triangle of X'X, then X'y and y'y, of the columns of ``with_design``."""
    return ([f"_x_{i} * _x_{j}" for i in range(z) for j in range(i, z)]
            + [f"_x_{i} * _y" for i in range(z)] + ["_y * _y"])


def _unpack(batch: pa.RecordBatch, z: int):
    """Columns, X'X (B, Z, Z), X'y (B, Z) and y'y (B,) from the array ``packed``."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    half = z * (z + 1) // 2
    flat = _matrix(col["packed"], half + z + 1)
    gram = np.empty((batch.num_rows, z, z))
    up = np.triu_indices(z)
    gram[:, up[0], up[1]] = gram[:, up[1], up[0]] = flat[:, :half]
    return col, gram, flat[:, half:half + z], flat[:, -1]


def _nested(values: np.ndarray) -> pa.Array:
    """(B, C, Z) -> list<list<double>>."""
    b, c, z = values.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(b * c + 1) * z, pa.int32()), pa.array(values.ravel(), pa.float64()))
    return pa.ListArray.from_arrays(pa.array(np.arange(b + 1) * c, pa.int32()), inner)


def _penalised_task(keep, z, free, knots, grid):
    seasonal = z - free - knots

    l1 = np.array([[PENALTY / c["changepoint_scale"]] * knots + [0.0] * seasonal for c in grid])
    l2 = np.array([[0.0] * knots + [PENALTY / c["seasonality_scale"] ** 2] * seasonal for c in grid])
    step = max(1, DOUBLES_PER_SLICE // (z * max(z, len(grid))))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                col, gram, rhs, yy = _unpack(part, z)
                out = sv.penalised(gram, rhs, yy, l1, l2, free)
                yield pa.RecordBatch.from_arrays([*[col[c] for c in keep], _nested(out)], names=[*keep, "betas"])

    return run


def _plain_task(keep, z):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col, gram, rhs, _ = _unpack(batch, z)
            beta = sv.least_squares(gram, rhs[:, :, None])[:, :, 0]
            offsets = pa.array(np.arange(batch.num_rows + 1) * z, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[col[c] for c in keep], pa.ListArray.from_arrays(offsets, pa.array(beta.ravel(), pa.float64()))],
                names=[*keep, "beta"])

    return run


def dot(design: Sequence[Column], beta: Column) -> Column:
    total = F.lit(0.0)
    for i, x in enumerate(design):
        total = total + x * F.get(beta, F.lit(i))
    return total


def scale_grid(changepoint_scales, seasonality_scales=(10.0,)) -> list[dict]:
    return [dict(changepoint_scale=float(c), seasonality_scale=float(s)) for c in changepoint_scales for s in seasonality_scales]


def additive_forecasts(
    df: DataFrame, keys: Sequence[str], k: int, min_train: int, m: int, grid: list[dict],
    *, knots: int = 8, order: int = 5, regressors: Sequence[str] = (), size: int = CHUNK,
) -> DataFrame:
    """(keys, fold, idx, h, y, candidate, yhat) for every pair of prior scales in the grid.

    A larger changepoint scale lets the trend bend more (L1 on hinges), a larger seasonality
    scale lets the season swing more (ridge on the waves).
    """
    design = additive_design(m, knots, order, regressors)
    z, free = len(design), 2 + len(regressors)
    sums = train_prefix_packed(
        with_design(df, design), keys, k, normal_sums(z), min_train=min_train).drop("train_size")
    keep = [*keys, "fold", "test_size"]
    fits = _spread(sums, *keys, "fold").transform(shipped).mapInArrow(
        _penalised_task(keep, z, free, knots, grid),
        f"{_key_ddl(df, keys)}, fold int, test_size bigint, betas array<array<double>>")
    rows = attach_fold_values(test_rows(df, k, min_train), fits, keys, size=size)
    return rows.select(
        *rows.columns, F.posexplode("betas").alias("candidate", "beta")
    ).select(*keys, "fold", "idx", "h", "y", "candidate", dot(design, F.col("beta")).alias("yhat"))


def additive_future(
    df: DataFrame, keys: Sequence[str], chosen: DataFrame, steps: int, m: int, grid: list[dict],
    *, knots: int = 8, order: int = 5, regressors: Sequence[str] = (), known: DataFrame | None = None,
) -> DataFrame:
    """(keys, h, idx, candidate, yhat): the candidate chosen per series, fitted on all of it, ``steps`` periods beyond its end.

    Time goes on beyond the fitted range, the last slope of the hinges with it. With regressors, ``known`` has their
    values by (keys, h); a step without them has a NULL forecast, a series without a candidate no row.
    """
    if regressors and known is None:
        raise ValueError("the regressors' values beyond the end are needed")
    design = additive_design(m, knots, order, regressors)
    z, free = len(design), 2 + len(regressors)
    sums = train_prefix_packed(with_design(df, design), keys, 1, normal_sums(z), whole=True).drop("train_size", "test_size")
    keep = [*keys, "fold"]
    fits = _spread(sums, *keys).transform(shipped).mapInArrow(
        _penalised_task(keep, z, free, knots, grid), f"{_key_ddl(df, keys)}, fold int, betas array<array<double>>").drop("fold")
    pick = chosen.filter("candidate is not null").select(*keys, F.col("candidate").cast("int").alias("candidate"))
    ends = df.filter(F.col("idx") == F.col("n") - 1).select(*keys, "n", F.col("pos").alias("_end"))
    rows = ends.join(pick, list(keys)).join(fits, list(keys)).withColumn("beta", F.get("betas", F.col("candidate"))).drop("betas")
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint")))) \
        .withColumns({"idx": F.col("n") + F.col("h"), "pos": F.col("_end") + 1 + F.col("h")})
    if regressors:
        rows = rows.join(known.select(*keys, "h", *regressors), [*keys, "h"], "left")
    return rows.select(*keys, "h", "idx", "candidate", dot(design, F.col("beta")).alias("yhat"))


def polynomial_fits(df: DataFrame, keys: Sequence[str], degree: int, y: str = "y") -> DataFrame:
    """(keys, n, coef) of a polynomial in scaled time over the whole series.

    2 * degree + 1 power sums hold the whole normal matrix.
    """
    z = degree + 1
    known = df.filter(F.col(y).isNotNull()).select(*keys, "n", F.col(y).alias("_y"), scaled_time("idx", "n").alias("_u"))
    power = known.select("*", powers("_u", 2 * degree).alias("_p")).select(
        *keys, "n", "_y", *[F.get("_p", F.lit(i)).alias(f"_p_{i}") for i in range(2 * degree + 1)])
    sums = power.groupBy(*keys, "n").agg(
        F.array(*[F.expr(f"sum(_p_{i})") for i in range(2 * degree + 1)]).alias("p"),
        F.array(*[F.expr(f"sum(_p_{i} * _y)") for i in range(z)]).alias("r"))
    hankel = [F.get("p", F.lit(i + j)) for i in range(z) for j in range(i, z)]
    packed = sums.select(*keys, "n", F.concat(F.array(*hankel), "r", F.array(F.lit(0.0))).alias("packed"))
    keep = [*keys, "n"]
    return _spread(packed, *keys).transform(shipped).mapInArrow(
        _plain_task(keep, z), f"{_key_ddl(df, keys)}, n bigint, beta array<double>")


def polynomial_value(beta: Column, idx: Column, n: Column) -> Column:
    """Horner evaluation at a position, inside or beyond the fitted range."""
    u = F.when(n > 1, idx * 2.0 / (n - 1) - 1.0).otherwise(F.lit(0.0))
    return F.aggregate(F.reverse(beta), F.lit(0.0), lambda acc, b: acc * u + b)


def extrapolate(fits: DataFrame, keys: Sequence[str], upto: int, *, size: int = CHUNK) -> DataFrame:
    """Values of the fitted polynomial for day numbers n+1..upto (rows idx n..upto-1); a longer series has the next day."""
    end = F.greatest(F.lit(upto).cast("bigint"), F.col("n") + 1)
    parts = fits.withColumn("_end", end).withColumn("_part", F.explode(F.sequence(
        F.floor(F.col("n") / size), F.floor((F.col("_end") - 1) / size))))
    rows = parts.withColumn("idx", F.explode(F.sequence(
        F.greatest(F.col("n"), F.col("_part") * size), F.least(F.col("_end"), (F.col("_part") + 1) * size) - 1)))
    return rows.select(*keys, "idx", polynomial_value(F.col("beta"), F.col("idx"), F.col("n")).alias("yhat"))
