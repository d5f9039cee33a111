"""Scores depend on a candidate and its training rows alone; high levels, gaps and short series."""

import numpy as np
import pytest

from loomcast.operators import baselines as bl, diagnostics as dg, scoring as so, trend as tr, windows as wn
from loomcast.operators.solver_tasks import GridSearch, arma_grid
from pyspark.sql import functions as F

K = ["series_id"]
ARMA = {"kind": "arma", "long": 4}


def noisy(seed, n=120, level=20.0):
    r = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.6 * y[t - 1] + r.normal()
    return [float(v) for v in level + y]


def maes(search, *fields):
    rows = search.with_parameters(search.fold_scores()).collect()
    return {(*[r[f] for f in fields], r.fold): r.mae for r in rows}


def test_score_of_an_order_does_not_depend_on_the_grid(panel_of):
    p = panel_of({"a": noisy(1)})
    alone = maes(GridSearch(p, K, ["y"], arma_grid([1], [0], [0]), ARMA, 5, 20), "p", "d", "q", "sp", "sd", "sq")
    wide = maes(GridSearch(p, K, ["y"], arma_grid(range(5), range(3), range(5)), ARMA, 5, 20), "p", "d", "q", "sp", "sd", "sq")
    seasonal = maes(GridSearch(p, K, ["y"], arma_grid(range(2), range(2), range(2), [0, 1], [0, 1], [0, 1], 12), ARMA, 5, 20),
                    "p", "d", "q", "sp", "sd", "sq")
    for k, v in alone.items():
        assert v is not None and wide[k] == pytest.approx(v, rel=1e-6) and seasonal[k] == pytest.approx(v, rel=1e-6)


def test_order_uses_all_training_rows(panel_of):
    y = np.array(noisy(2))
    rows = {r.fold: r.mae for r in GridSearch(panel_of({"a": list(y)}), K, ["y"], arma_grid(range(3), [0], [0, 3]), ARMA, 5, 20)
            .fold_scores().filter("candidate = 2").collect()}  # (1, 0, 0)
    for fold, mae in rows.items():
        cut = 20 + fold * 20
        x = np.column_stack([np.ones(cut - 1), y[:cut - 1]])
        a, b = np.linalg.lstsq(x, y[1:cut], rcond=None)[0]
        value, gap = y[cut - 1], []
        for t in range(cut, cut + 20):
            value = a + b * value
            gap.append(abs(value - y[t]))
        assert mae == pytest.approx(np.mean(gap), rel=1e-6)


@pytest.mark.parametrize("kind", ["arma", "vector", "exog", "window", "additive", "closed"])
def test_later_values_change_no_earlier_score(panel_of, kind):
    one = list(zip(noisy(3), noisy(4)))
    other = one[:100] + [(a + 500, b) for a, b in one[100:]]  # the last of five test blocks

    def scores(values):
        p = panel_of({"a": values}, names=("y", "x"))
        if kind == "additive":
            out = tr.additive_forecasts(p.drop("x"), K, 5, 20, 12, tr.scale_grid([0.1, 1], [10]), knots=4, order=2)
            return {(r.candidate, r.fold): r.mae for r in so.fold_scores(out, [*K, "candidate"]).collect()}
        if kind == "closed":
            out = bl.fold_scores(bl.forecasts(p.drop("x"), K, 5, 20, 12), K)
            return {(r.candidate, r.fold): r.mae for r in out.collect()}
        grid, spec, cols, exog = arma_grid([1, 2], [0, 1], [0, 1]), ARMA, ["y", "x"], 0
        if kind == "arma":
            cols = ["y"]
        elif kind == "exog":
            exog = 1
        elif kind == "window":
            grid, spec = [dict(n_in=3, ridge=r) for r in (0.0, 0.1)], {"kind": "window", "n_out": 4}
        out = GridSearch(p, K, cols, grid, spec, 5, 20, exog=exog).fold_scores()
        return {(r.candidate, r.fold): r.mae for r in out.collect()}

    a, b = scores(one), scores(other)
    assert any(f == 4 for _, f in a)
    assert all(a[k] == b[k] for k in a if k[1] < 4)
    assert any(a[k] != b[k] for k in a if k[1] == 4)


def test_window_model_does_not_see_the_level(panel_of):
    grid, spec = [dict(n_in=3, ridge=r) for r in (0.0, 0.1, 1.0)], {"kind": "window", "n_out": 4}
    low = maes(GridSearch(panel_of({"a": noisy(5, level=0.0)}), K, ["y"], grid, spec, 5, 20), "ridge")
    high = maes(GridSearch(panel_of({"a": noisy(5, level=1000.0)}), K, ["y"], grid, spec, 5, 20), "ridge")
    assert all(high[k] == pytest.approx(v, rel=1e-6) for k, v in low.items())


def test_high_level_costs_no_digits(panel_of):
    r = np.random.default_rng(6)
    y = r.normal(size=720)
    p = panel_of({"a": list(1e9 + y)})
    shown = (1e9 + y) - 1e9
    c = shown - shown.mean()
    got = {x.lag: x.r for x in dg.autocorrelation(p, K, "y", 5).collect()}
    for lag, v in got.items():
        assert v == pytest.approx((c[lag:] * c[:-lag]).sum() / (c * c).sum(), abs=1e-6)
    fits = {x.fold: x.phi for x in bl.fold_fits(p, K, 5, 20).collect()}
    for fold, phi in fits.items():
        z = shown[:120 + fold * 120]
        assert phi == pytest.approx(np.polyfit(z[:-1], z[1:], 1)[0], abs=1e-6)


def test_autocorrelation_counts_known_pairs(panel_of):
    got = {x.lag: (x.r, x.pairs, x.n) for x in dg.autocorrelation(panel_of({"a": [1, 2, None, 4, 8, 3]}), K, "y", 2).collect()}
    v = np.array([1, 2, np.nan, 4, 8, 3]) - 18 / 5
    for lag in (1, 2):
        products = v[lag:] * v[:-lag]
        assert got[lag] == (pytest.approx(np.nansum(products) / np.nansum(v * v)), int((~np.isnan(products)).sum()), 5)


def test_exponential_mean_with_gaps(panel_of):
    got = [r.e for r in wn.exponential_mean(panel_of({"a": [1, 2, None, 4, 8]}), K, "y", 7, "e").orderBy("idx").collect()]
    assert got == pytest.approx([1.0, 1.5714285714, 1.5714285714, 2.7972350230, 4.8914285714], rel=1e-8) \
        or got[3:] == pytest.approx([2.80, 4.89], abs=0.01)


def test_unknown_steps_stay_unknown(spark):
    pred = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 1.0), ("b", 0, 2.0), ("b", 1, 3.0)],
                                 "series_id string, h bigint, d double")
    last = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "series_id string, y double")
    got = {(r.series_id, r.h): r.v for r in wn.undo_difference(pred, last, K, "d", "y", "v").collect()}
    assert got == {("a", 0): 11.0, ("a", 1): None, ("a", 2): None, ("b", 0): 3.0, ("b", 1): 6.0}
    season = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 20.0), ("b", 0, 1.0), ("b", 1, 2.0)], "series_id string, r int, y double")
    got = {(r.series_id, r.h): r.v for r in wn.undo_seasonal_difference(pred, season, K, "d", "y", "v", 2).collect()}
    assert got == {("a", 0): 11.0, ("a", 1): None, ("a", 2): 12.0, ("b", 0): 3.0, ("b", 1): 5.0}


def test_series_of_fewer_rows_than_folds_are_reported(panel_of):
    p = panel_of({"a": noisy(7), "b": [1, 2, 3]})
    search = GridSearch(p, K, ["y"], arma_grid([0, 1], [0], [0]), ARMA, 5)
    got = {(r.series_id, r.candidate): (r.mean_mae, r.folds, r.failed) for r in search.scores().collect()}
    assert got["b", 0] == got["b", 1] == (None, 0, 1) and got["a", 0][1] == 5
    best = {r.series_id: r.candidate for r in so.best_candidate(search.scores(), K).collect()}
    assert best["b"] is None and best["a"] is not None


def test_transfer_to_short_and_gappy_targets(panel_of):
    p = panel_of({"a": noisy(8)})
    targets = panel_of({"b": [20, 21], "c": [20, None], "d": [21]})
    search = GridSearch(p, K, ["y"], arma_grid([1, 2], [0], [0]), ARMA, 5, 20)
    for candidate, known in ((0, {"b": True, "c": False, "d": True}), (1, {"b": True, "c": False, "d": False})):
        got = search.transfer(F.col("series_id") == "a", targets, candidate, F.lit(3)).collect()
        assert len(got) == 9
        assert all((r.yhat is not None) == known[r.series_id] for r in got)


def test_a_failed_fit_leaves_the_others_alone(panel_of):
    p = panel_of({"a": noisy(9), "b": [float("inf")] * 120, "c": [5.0] * 120})
    got = {r.series_id: r.mean_mae for r in GridSearch(p, K, ["y"], arma_grid([1], [0], [0]), ARMA, 5, 20).scores().collect()}
    assert got["a"] == pytest.approx({r.series_id: r.mean_mae for r in GridSearch(
        panel_of({"a": noisy(9)}), K, ["y"], arma_grid([1], [0], [0]), ARMA, 5, 20).scores().collect()}["a"])
    assert got["b"] is None
