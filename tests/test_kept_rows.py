"""No series, group or value leaves a result unseen."""

import pytest
from pyspark.sql import functions as F

from loomcast.operators import baselines as bl, cleaning as cl, scoring as so, trend as tr
from loomcast.operators.solver_tasks import GridSearch, arma_grid
from loomcast.sources.series import densify

K = ["series_id"]


def data():
    wave = [float((i * 7) % 5 + i % 3) for i in range(80)]
    return {"long": wave, "middle": wave[:22], "tiny": wave[:4]}


def test_every_series_has_a_row_per_candidate(panel_of):
    search = GridSearch(panel_of(data()), K, ["y"], arma_grid(range(2), [0], [0]), {"kind": "arma", "long": 2}, 5, 20)
    scores = search.fold_scores().collect()
    assert {(r.series_id, r.candidate) for r in scores} == {(s, c) for s in data() for c in (0, 1)}
    assert {(r.fold, r.mae, r.status) for r in scores if r.series_id != "long"} == {(None, None, "short")}
    best = {r.series_id: r.candidate for r in so.best_candidate(search.scores(), K).collect()}
    assert best["middle"] is None and best["tiny"] is None and best["long"] is not None


def test_every_series_has_a_row_per_closed_form(panel_of):
    df = panel_of(data())
    scores = so.with_short(bl.fold_scores(bl.forecasts(df, K, 5, 20, 12), K), df, K, 5, 20)
    table = so.candidate_scores(scores, ["series_id", "candidate", "model"]).collect()
    assert {(r.series_id, r.model) for r in table} == {(s, m) for s in data() for m in so.MODELS}
    assert all((r.mean_mae is None) == (r.series_id != "long") and (r.folds > 0) == (r.series_id == "long") for r in table)


@pytest.mark.parametrize("fill", [None, 0.0])
def test_a_series_without_values_keeps_its_rows(spark, fill):
    cells = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("none", 2, None)], "series_id string, pos long, y double")
    rows = densify(cells, K, ["y"], fill=fill).collect()
    assert sorted((r.series_id, r.idx) for r in rows) == [(s, i) for s in ("a", "none") for i in range(3)]
    assert {r.y for r in rows if r.series_id == "none"} == {fill}


def test_rows_without_a_dimension_entry_stay(spark):
    facts = spark.createDataFrame([(1, 2.0), (2, 3.0), (None, 4.0)], "k int, v double")
    dim = spark.createDataFrame([(1, 10)], "k int, size int")
    assert sorted(map(tuple, cl.attach_dimension(facts, dim, "k").collect()), key=str) == [(1, 2.0, 10), (2, 3.0, None), (None, 4.0, None)]
    assert [r.k for r in cl.members(facts, dim, "k").collect()] == [1]


def test_wide_table_keeps_others_and_refuses_duplicates(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 3.0), (0, "d", 4.0), (1, "a", 5.0), (1, None, 6.0)], "i int, s string, y double")
    wide = cl.long_to_wide(rows, ["i"], "s", ["a", "b"], "y", other="rest").orderBy("i").collect()
    assert [tuple(r) for r in wide] == [(0, 1.0, 2.0, 7.0), (1, 5.0, None, 6.0)]
    assert cl.column_values(rows, "s") == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        cl.column_values(rows, "s", most=3)
    with pytest.raises(Exception, match="two values of s = a"):
        cl.long_to_wide(rows.union(rows.limit(1)), ["i"], "s", ["a"], "y").collect()


def test_extrapolation_of_long_series(panel_of):
    fits = tr.polynomial_fits(panel_of({"short": [1.0, 2.0, 3.0], "long": [float(i) for i in range(12)]}), K, 1)
    out = {(r.series_id, r.idx): r.yhat for r in tr.extrapolate(fits, K, 5).collect()}
    assert set(out) == {("short", 3), ("short", 4), ("long", 12)}
    assert out["long", 12] == pytest.approx(12.0) and out["short", 4] == pytest.approx(5.0)


def test_seconds_of_each_candidate(panel_of):
    search = GridSearch(panel_of(data()), K, ["y"], arma_grid(range(4), [0], [0, 2]), {"kind": "arma", "long": 4}, 5, 20)
    scores = search.scores(timed=True).filter(F.col("series_id") == "long").collect()
    assert len(scores) == 8 and all(r.seconds > 0 for r in scores) and len({r.seconds for r in scores}) > 1
