"""Series summed whole in one task, against the same series summed by chunks."""

import numpy as np
import pytest

from loomcast.operators.lag_products import solver_rows
from loomcast.operators.solver_tasks import GridSearch, arma_grid

K = ["series_id"]


def noisy(seed, n, gap=None):
    rng = np.random.default_rng(seed)
    y = 50 + 10 * rng.normal(size=n)
    return [(None if i == gap else float(v), float(v * v) if i % 7 else None if gap else 0.0) for i, v in enumerate(y)]


DATA = {"a": noisy(1, 60), "b": noisy(2, 47, 20), "c": noisy(3, 9), "d": noisy(4, 3), "e": [(7.0, 1.0)] * 30, "f": noisy(5, 2, 0)}


@pytest.mark.parametrize("lags,horizon,min_train", [(1, 4096, 0), (6, 4, 0), (12, 3, 20)])
def test_whole_series_equal_chunks(panel_of, lags, horizon, min_train):
    df, found = panel_of(DATA, names=("y", "x")), []
    for size in (1 << 16, 13):
        rows = solver_rows(df, K, ["y", "x"], lags, 4, min_train, size=size, horizon=horizon).collect()
        found.append({(r.series_id, r.fold, r.h): r.asDict() for r in rows})
        assert len(found[-1]) == len(rows)
    for other in found[1:]:
        assert found[0].keys() == other.keys()
        for at, row in found[0].items():
            for name in row.keys() - {"series_id"}:
                value = row[name]
                assert value == pytest.approx(other[at][name], rel=1e-9, abs=1e-9, nan_ok=True), (at, name)


def test_series_across_batches(panel_of, spark, monkeypatch):
    data = {f"s{i}": [v for v, _ in noisy(i, 30 + i)] for i in range(9)}
    search = lambda: GridSearch(panel_of(data), K, ["y"], arma_grid([1], [0], [0]), {"kind": "arma", "long": 2}, 3, 5)
    want = {(r.series_id, r.fold): r.mae for r in search().fold_scores().collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr("loomcast.operators.lag_products.TASK_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.series_id, r.fold): r.mae for r in search().fold_scores().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 27 and got == pytest.approx(want, rel=1e-12)
