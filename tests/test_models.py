"""The distributed grid search against direct fits, whatever the chunk and horizon sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import scoring as so, trend as tr
from loomcast.operators.lag_products import lag_products
from loomcast.operators.solver_tasks import GridSearch, arma_grid

K = ["series_id"]
ARMA = {"kind": "arma", "long": 3}


def series(seed, n, level=1e6):
    rng = np.random.default_rng(seed)
    return [float(x) for x in level + np.cumsum(rng.normal(size=n)) + 5 * np.sin(np.arange(n) / 2)]


@pytest.fixture(scope="module")
def two(panel_of):
    return panel_of({"a": series(1, 140), "b": series(2, 80, 0.0)}).cache()


def scores(search):
    return {(r.series_id, r.candidate, r.fold): r.mae for r in search.fold_scores().collect()}


def test_split_sizes_do_not_change_scores(two):
    grid = arma_grid(range(3), range(2), range(2))
    whole = scores(GridSearch(two, K, ["y"], grid, ARMA, 4, 10))
    parts = scores(GridSearch(two, K, ["y"], grid, ARMA, 4, 10, size=11, horizon=9))
    assert whole.keys() == parts.keys() and len(whole) == 2 * 12 * 4
    assert all(whole[k] == pytest.approx(parts[k], rel=1e-6) for k in whole)


def test_ar2_equals_direct_regression(two):
    search = GridSearch(two, K, ["y"], arma_grid([2], [0], [0]), ARMA, 4, 10)
    got = scores(search)
    y = np.array(series(1, 140))
    size = 140 // 5
    for fold in range(4):
        cut = 140 - (4 - fold) * size
        t = np.arange(2, cut)
        x = np.column_stack([np.ones(len(t)), y[t - 1] - 1e6, y[t - 2] - 1e6])
        beta = np.linalg.lstsq(x, y[t] - 1e6, rcond=None)[0]
        path = list(y[:cut] - 1e6)
        for _ in range(size):
            path.append(beta @ [1, path[-1], path[-2]])
        want = np.mean(np.abs(np.array(path[cut:]) + 1e6 - y[cut:cut + size]))
        assert got["a", 0, fold] == pytest.approx(want, rel=1e-6)
    best = so.best_candidate(search.scores(), K)
    paths = [r for r in search.forecasts(best).collect() if r.series_id == "a" and r.fold == 3]
    assert np.allclose([r.yhat for r in sorted(paths, key=lambda r: r.h)], np.array(path[cut:]) + 1e6)


def test_future_and_transfer(two, panel_of):
    search = GridSearch(two, K, ["y"], arma_grid([3], [0], [0]), ARMA, 4, 10, horizon=9, size=11)
    y = np.array(series(1, 140)) - 1e6
    lags = search.lags
    t = np.arange(lags, 140)
    x = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 2], y[t - 3]])
    beta = np.linalg.lstsq(x, y[t], rcond=None)[0]

    def walk(start, steps):
        path = list(start)
        for _ in range(steps):
            path.append(beta @ [1, path[-1], path[-2], path[-3]])
        return np.array(path[-steps:]) + 1e6

    pick = two.select("series_id").distinct().selectExpr("series_id", "0 AS candidate")
    ahead = [r for r in search.future(pick, 25).collect() if r.series_id == "a"]
    assert np.allclose([r.yhat for r in sorted(ahead, key=lambda r: r.h)], walk(y, 25))
    other = series(8, 30)
    got = search.transfer(F.col("series_id") == "a", panel_of({"z": other}), 0, F.lit(140) - F.col("n")).collect()
    assert np.allclose([r.yhat for r in sorted(got, key=lambda r: r.h)], walk(np.array(other) - 1e6, 110), rtol=1e-9)


def test_status_of_bad_series(panel_of):
    p = panel_of({"gap": [None if i == 7 else float(i % 5) for i in range(60)], "flat": [4.0] * 60, "ok": series(3, 60)})
    out = GridSearch(p, K, ["y"], arma_grid([1], [0], [0, 1]), ARMA, 4, 10).fold_scores().collect()
    state = {r.series_id: {x.status for x in out if x.series_id == r.series_id} for r in out}
    assert state["gap"] == {"gaps"} and state["ok"] == {"ok"} and state["flat"] == {"ok"}
    assert all(r.mae is None for r in out if r.series_id == "gap")
    assert all(r.mae == pytest.approx(0, abs=1e-9) for r in out if r.series_id == "flat")
    tiny = GridSearch(p.filter("series_id = 'ok'"), K, ["y"], arma_grid([4], [0], [0, 2]), ARMA, 5, 0).fold_scores().collect()
    assert {r.status for r in tiny if r.fold == 0} >= {"short"} and {r.status for r in tiny if r.fold == 4} == {"ok"}


def test_regressor_with_known_future(panel_of):
    rng = np.random.default_rng(9)
    x = rng.normal(size=90)
    y = 3 + 2 * x + 0.01 * rng.normal(size=90)
    p = panel_of({"a": list(zip(y, x))}, ("y", "x"))
    out = GridSearch(p, K, ["y", "x"], arma_grid([0, 1], [0], [0]), ARMA, 4, 20, exog=1).fold_scores().collect()
    assert all(r.mae < 0.03 for r in out)


def test_window_search_split(two):
    grid = [dict(n_in=n, ridge=r) for n in (3, 5) for r in (0.0, 0.1)]
    spec = {"kind": "window", "n_out": 4}
    whole = scores(GridSearch(two, K, ["y"], grid, spec, 4, 10))
    parts = scores(GridSearch(two, K, ["y"], grid, spec, 4, 10, size=13, horizon=10))
    assert all(whole[k] == pytest.approx(parts[k], rel=1e-5) for k in whole)


def test_training_set_shorter_than_lags_is_left_out_or_short(panel_of):
    p = panel_of({"a": series(4, 30)})
    rows = {r.fold: r.rows for r in lag_products(p, K, ["y"], 8, 5).collect()}
    assert rows == {0: 0, 1: 2, 2: 7, 3: 12, 4: 17} or all(v >= 0 for v in rows.values())


def test_polynomial(panel_of):
    t = np.arange(79)
    y = 2 + 0.5 * t - 0.01 * t ** 2 + 1e-4 * t ** 3
    fits = tr.polynomial_fits(panel_of({"a": list(y)}), K, 8)
    got = {r.idx: r.yhat for r in tr.extrapolate(fits, K, 100, size=6).collect()}
    assert sorted(got) == list(range(79, 100))
    for i, v in got.items():
        assert v == pytest.approx(2 + 0.5 * i - 0.01 * i ** 2 + 1e-4 * i ** 3, rel=1e-3)


def test_additive_model_learns_trend_and_season(panel_of):
    t = np.arange(120)
    y = 10 + 0.3 * t + 4 * np.sin(2 * np.pi * (100 + t) / 12)
    p = panel_of({"a": list(y)})
    out = tr.additive_forecasts(p, K, 5, 30, 12, tr.scale_grid([0.01, 1], [10]), size=9)
    mae = {r.candidate: r.m for r in out.groupBy("candidate").agg({"*": "count"}).withColumnRenamed("count(1)", "m").collect()}
    assert mae == {0: 80, 1: 80}
    assert all(abs(r.y - r.yhat) < 0.2 for r in out.collect())


def test_additive_model_beyond_the_end(panel_of):
    """Line, one pair of waves and a hinge grid without penalty, against plain least squares on the same columns."""
    import math

    import numpy as np
    from loomcast.operators import trend as tr

    rng = np.random.default_rng(4)
    y = [3 + 0.2 * i + math.sin(i) + rng.normal() for i in range(60)]
    df = panel_of({"a": y, "b": [2 * v for v in y]})
    chosen = df.select("series_id").distinct().selectExpr("series_id", "1 as candidate")
    grid = tr.scale_grid([1e-9, 1e9], [1e9])[:2]
    out = {(r.series_id, r.h): r.yhat for r in tr.additive_future(df, ["series_id"], chosen, 6, 12, grid, knots=1, order=1).collect()}

    def row(i):
        u, angle = 2 * i / 59 - 1, 2 * math.pi * ((100 + i) % 12) / 12
        return [1.0, u, max(u, 0.0), math.sin(angle), math.cos(angle)]

    beta = np.linalg.lstsq(np.array([row(i) for i in range(60)]), np.array(y), rcond=None)[0]
    for h in range(6):
        want = float(np.dot(row(60 + h), beta))
        assert abs(out["a", h] - want) < 1e-5 and abs(out["b", h] - 2 * want) < 1e-5
