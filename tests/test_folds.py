"""Fold geometry, prefix sums, scores and best candidate."""

import pytest
from pyspark.sql import functions as F

from loomcast.operators import baselines as bl, folds as fd, scoring as so

K = ["series_id"]


@pytest.mark.parametrize("n,k,min_train,sizes,test", [
    (39, 8, 20, [23, 27, 31, 35], 4),
    (474, 18, 300, [306, 330, 354, 378, 402, 426, 450], 24),
    (468, 18, 300, [324, 348, 372, 396, 420, 444], 24),
    (79, 5, 20, [27, 40, 53, 66], 13),
])
def test_geometry(panel_of, n, k, min_train, sizes, test):
    p = panel_of({"a": range(n)})
    got = sorted((r.train_size, r.test_size) for r in fd.fold_sizes(p, K, k, min_train).collect())
    assert got == [(s, test) for s in sizes]
    rows = fd.test_rows(p, k, min_train)
    assert sorted(r.idx for r in rows.collect()) == list(range(sizes[0], sizes[-1] + test))
    both = fd.fold_rows(p, k, min_train).groupBy("fold", "role").count().collect()
    assert sorted(r["count"] for r in both if r.role == "train") == sizes


def test_short_series_has_no_folds(panel_of):
    p = panel_of({"a": [1, 2, 3], "b": range(12)})
    assert {r.series_id for r in fd.with_blocks(p, 5).collect()} == {"b"}
    assert {r.series_id for r in fd.fold_sizes(p, K, 5).collect()} == {"b"}


def test_prefix_equals_sum_over_training_rows(panel_of):
    p = panel_of({"a": [i * i % 7 for i in range(25)], "b": [None if i % 5 == 2 else i for i in range(31)]})
    got = fd.train_prefix(p, K, 4, {"s": F.col("y"), "c": "y * y"}, firsts={"f": "y"}, lasts={"l": "y"})
    rows = fd.fold_rows(p, 4).filter("role = 'train'").groupBy("series_id", "fold").agg(
        F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("c"), F.min_by("y", "idx").alias("f"), F.max_by("y", "idx").alias("l"))
    key = lambda df: sorted(tuple(r) for r in df.select("series_id", "fold", "s", "c", "f", "l").collect())
    assert key(got) == key(rows)


def test_long_test_blocks_are_spread(panel_of):
    p = panel_of({"a": range(60)})
    fits = fd.train_prefix(p, K, 2, {"s": F.col("y")})
    got = fd.attach_fold_values(fd.test_rows(p, 2), fits, K, size=7)
    assert sorted((r.fold, r.h, r.s) for r in got.collect()) == [(f, h, sum(range(20 + 20 * f))) for f in (0, 1) for h in range(20)]


def test_best_candidate_rules(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 0, None), ("b", 1, 9.0), ("c", 0, None)],
                               "series_id string, candidate int, mean_mae double")
    best = {r.series_id: r.candidate for r in so.best_candidate(df, K).collect()}
    assert best == {"a": 1, "b": 1, "c": None}


def test_failed_fold_voids_the_mean(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 1.0), ("b", 1, 3.0)], "series_id string, fold int, mae double")
    got = {r.series_id: (r.mean_mae, r.last_mae) for r in so.candidate_scores(df, K).collect()}
    assert got == {"a": (None, None), "b": (2.0, 3.0)}


def test_true_zero_forecast_is_kept(spark, panel_of):
    p = panel_of({"a": [1, 2, 3]})
    pred = spark.createDataFrame([("a", 2, 0.0)], "series_id string, idx bigint, yhat double")
    got = [r.yhat for r in sorted(so.align_to_actuals(p, pred, K).collect(), key=lambda r: r.idx)]
    assert got == [None, None, 0.0]


def test_constant_series(panel_of):
    out = bl.forecasts(panel_of({"a": [5] * 30}), K, 4, 5, 3).collect()
    assert all(r["mean"] == 5 and r.random_walk == 5 and r.drift == 5 and r.seasonal_naive == 5 for r in out)
    assert all(r.ar1 is None for r in out)


def test_partial_autocorrelation_solves_yule_walker(panel_of):
    import numpy as np

    from loomcast.operators import diagnostics as dg

    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=60))
    acf = dg.autocorrelation(panel_of({"a": list(y)}), K, "y", 6, size=11)
    d = y - y.mean()
    r = np.array([1.0] + [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 7)])
    got = [x.r for x in sorted(acf.collect(), key=lambda x: x.lag)]
    assert np.allclose(got, r[1:])
    pacf = [x.pacf for x in sorted(dg.partial_autocorrelation(acf, K, 6).collect(), key=lambda x: x.lag)]
    want = [np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1:k + 1])[-1] for k in range(1, 7)]
    assert np.allclose(pacf, want)
