"""ARMA fits on training sets with missing values, against plain least squares over complete rows."""

import numpy as np
import pytest

from loomcast.operators.solver_tasks import GridSearch, arma_grid

K = ["series_id"]


def gappy(seed, n, share=0.2, level=50.0):
    rng, y = np.random.default_rng(seed), [0.0, 0.0]
    for _ in range(n - 2):
        y.append(0.5 * y[-1] + 0.2 * y[-2] + rng.normal())
    return [None if rng.random() < share else level + v for v in y]


def plain(y, k, p, d):
    """Forecasts of every fold: complete rows, the model's own steps for what is missing before the end."""
    y = np.array([np.nan if v is None else v for v in y])
    n, out = len(y), {}
    size = n // (k + 1)
    for j in range(k):
        train = y[:n - (k - j) * size]
        base = np.nanmean(y[:n - k * size])
        z = train - base
        poly = np.array([1.0])
        for _ in range(d):
            poly = np.convolve(poly, [1.0, -1.0])
        need = d + p
        rows, target = [], []
        for t in range(need, len(z)):
            window = z[t - need:t + 1][::-1]
            if not np.isnan(window).any():
                w = np.convolve(window, poly[::-1], "valid") if d else window
                rows.append([1.0, *w[1:1 + p]])
                target.append(w[0])
        beta = np.linalg.lstsq(np.array(rows), np.array(target), rcond=None)[0]

        def step(past):
            w = [past[-1 - i] for i in range(p)] if not d else [past[-1 - i] - past[-2 - i] for i in range(p)]
            return beta[0] + float(np.dot(beta[1:], w)) + (past[-1] if d else 0.0)

        first = int(np.flatnonzero(~np.isnan(z))[0])
        path = [0.0] * (p + d)
        for t, v in enumerate(z):
            path.append(step(path) if np.isnan(v) and t > first else 0.0 if np.isnan(v) else v)
        ahead = []
        for _ in range(size):
            path.append(step(path))
            ahead.append(path[-1] + base)
        out[j] = ahead
    return out


@pytest.mark.parametrize("p,d,size", [(1, 0, 65536), (2, 0, 16), (1, 1, 16)])
def test_equals_least_squares_over_complete_rows(panel_of, p, d, size):
    data = {"a": gappy(1, 120), "b": gappy(2, 140, 0.25), "whole": gappy(3, 100, 0.0)}
    data["b"][-4:] = [None] * 4
    search = GridSearch(panel_of(data), K, ["y"], arma_grid([p], [d], [0]), {"kind": "arma", "long": 2}, 3, 0, missing=True, size=size)
    chosen = search.df.select("series_id").distinct().selectExpr("series_id", "0 as candidate")
    got = {(r.series_id, r.fold, r.h): r.yhat for r in search.forecasts(chosen).collect()}
    for name, y in data.items():
        for fold, path in plain(y, 3, p, d).items():
            for h, v in enumerate(path):
                assert got[name, fold, h] == pytest.approx(v, rel=1e-6), (name, fold, h)


def test_shocks_and_two_variables_have_scores(panel_of):
    a, b = gappy(4, 500, 0.1), gappy(5, 500, 0.05, 3.0)
    search = GridSearch(panel_of({"s": list(zip(a, b))}, ("y", "x")), K, ["y", "x"], arma_grid(range(3), range(2), range(2)),
                        {"kind": "arma", "long": 2}, 3, 30, missing=True)
    rows = search.fold_scores().collect()
    assert len(rows) == 3 * 12 and all(r.status == "ok" and np.isfinite(r.mae) for r in rows)
    assert min(r.mae for r in rows if r.fold == 2) < 2


def test_gaps_only_where_no_row_is_left(panel_of):
    every_other = [float(i % 7) if i % 2 else None for i in range(60)]
    data = {"none": every_other, "some": gappy(6, 60), "empty": [None] * 60}
    search = GridSearch(panel_of(data), K, ["y"], arma_grid([0, 1], [0], [0]), {"kind": "arma", "long": 2}, 3, 0, missing=True)
    states = {(r.series_id, r.candidate, r.fold): r.status for r in search.fold_scores().collect()}
    assert {s for (name, c, _), s in states.items() if name == "none" and c == 1} == {"gaps"}
    assert {s for (name, c, _), s in states.items() if name == "none" and c == 0} == {"ok"}
    assert {s for (name, _, _), s in states.items() if name == "some"} == {"ok"}
    assert {s for (name, _, _), s in states.items() if name == "empty"} == {"gaps"}


def test_future_of_a_series_with_gaps(panel_of):
    data = {"a": gappy(7, 80), "whole": gappy(8, 80, 0.0)}
    search = GridSearch(panel_of(data), K, ["y"], arma_grid([1], [0], [0]), {"kind": "arma", "long": 2}, 3, 0, missing=True)
    chosen = search.df.select("series_id").distinct().selectExpr("series_id", "0 as candidate")
    rows = search.future(chosen, 5).collect()
    assert len(rows) == 10 and all(r.yhat is not None for r in rows)


def test_other_kinds_say_that_they_cannot(panel_of):
    with pytest.raises(ValueError):
        GridSearch(panel_of({"a": [1.0] * 30}), K, ["y"], [dict(n_in=1, ridge=0.0)], {"kind": "window", "n_out": 1}, 3, 0, missing=True)
