"""Window models that all series of a panel share, against plain least squares."""

import numpy as np
import pytest

from loomcast.operators.solver_tasks import PooledSearch

K = ["series_id"]


def series(seed, n, level=0.0, scale=1.0):
    rng, y = np.random.default_rng(seed), [0.0]
    for _ in range(n - 1):
        y.append(0.7 * y[-1] + rng.normal())
    return [level + scale * v for v in y]


def plain(data, k, n_in, n_out, ridge=0.0):
    """{(series, fold): forecasts} of one map over all standardised training windows of a fold."""
    out = {}
    for j in range(k):
        x, z, ends = [], [], {}
        for name, y in data.items():
            n = len(y)
            size = n // (k + 1)
            if not size:
                continue
            train = np.array(y[:n - (k - j) * size])
            sd = train.std() or 1.0
            own = (train - train.mean()) / sd
            ends[name] = (own, train.mean(), sd, size)
            for t in range(n_in, len(own) - n_out + 1):
                x.append([1.0, *own[t - n_in:t][::-1]])
                z.append(own[t:t + n_out])
        beta = np.linalg.lstsq(np.array(x), np.array(z), rcond=None)[0]
        for name, (own, mean, sd, size) in ends.items():
            if len(own) < n_in:
                continue
            path = list(own)
            while len(path) < len(own) + size:
                path += list(np.array([1.0, *path[::-1][:n_in]]) @ beta)
            out[name, j] = [mean + sd * v for v in path[len(own):len(own) + size]]
    return out


@pytest.mark.parametrize("n_in,n_out", [(1, 1), (3, 2)])
def test_equals_least_squares_over_all_windows(panel_of, n_in, n_out):
    data = {"a": series(1, 60), "b": series(2, 48, 100.0, 5.0), "c": series(3, 30, -1e6, 1e3), "flat": [7.0] * 24}
    search = PooledSearch(panel_of(data), K, ["y"], [dict(n_in=n_in, ridge=0.0)], n_out, 3, 0)
    chosen = search.df.select("series_id").distinct().selectExpr("series_id", "0 as candidate")
    got = {(r.series_id, r.fold, r.h): r.yhat for r in search.forecasts(chosen).collect()}
    want = plain(data, 3, n_in, n_out)
    assert set(got) == {(s, f, h) for (s, f), path in want.items() for h in range(len(path))}
    for (name, fold), path in want.items():
        for h, v in enumerate(path):
            assert got[name, fold, h] == pytest.approx(v, rel=1e-6, abs=1e-6)


def test_scores_do_not_depend_on_partitions(panel_of, spark):
    data = {f"s{i}": series(i, 40 + i % 5, i * 10.0, 1 + i) for i in range(30)}
    grid = [dict(n_in=n, ridge=x) for n in (2, 5) for x in (0.0, 0.1)]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = PooledSearch(panel_of(data).repartition(int(parts) * 2), K, ["y"], grid, 2, 4, 5).fold_scores().collect()
            found.append({(r.series_id, r.candidate, r.fold): r.mae for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and len(found[0]) == 30 * 4 * 4
    for at, mae in found[0].items():
        assert mae == pytest.approx(found[1][at], rel=1e-9)


def test_a_series_with_one_window_is_forecast(panel_of):
    """Too short to be fitted alone, it has the inputs of one window."""
    data = {f"s{i}": series(i, 60) for i in range(5)} | {"short": [1.0, 2.0, 4.0, 3.0, 5.0, 4.0, 6.0, 5.0]}
    search = PooledSearch(panel_of(data), K, ["y"], [dict(n_in=6, ridge=0.01)], 1, 1, 0)
    chosen = search.df.select("series_id").distinct().selectExpr("series_id", "0 as candidate")
    ahead = [r for r in search.future(chosen, 3).collect() if r.series_id == "short"]
    assert len(ahead) == 3 and all(r.yhat is not None and np.isfinite(r.yhat) for r in ahead)
    states = {(r.series_id, r.status) for r in search.fold_scores().collect()}
    assert ("short", "short") in states and ("s0", "ok") in states


def test_gaps_stay_out_of_the_sums(panel_of):
    whole = {f"s{i}": series(i, 40) for i in range(4)}
    broken = whole | {"gap": [None if i == 3 else v for i, v in enumerate(series(9, 40))]}
    scores = [{(r.series_id, r.fold): (r.mae, r.status) for r in PooledSearch(
        panel_of(d), K, ["y"], [dict(n_in=2, ridge=0.0)], 1, 3, 0).fold_scores().collect()} for d in (whole, broken)]
    for at, (mae, status) in scores[0].items():
        assert status == "ok" and mae == pytest.approx(scores[1][at][0], rel=1e-9)
    assert {v for (name, _), v in scores[1].items() if name == "gap"} == {(None, "gaps")}


def test_scores_read_the_rows_that_the_sums_were_taken_from(panel_of):
    search = PooledSearch(panel_of({f"s{i}": series(i, 40) for i in range(4)}), K, ["y"], [dict(n_in=2, ridge=0.0)], 1, 3, 0)
    assert search.fold_scores().inputFiles()
