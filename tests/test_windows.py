"""Hand-made series: differences, inversions, rolling values, alignment, samples, edge cases."""

import pytest
from pyspark.sql import functions as F

from loomcast.functions.scalars import nan_to_null, sentinel_below
from loomcast.operators import cleaning as cl, slices, windows as wn

K = ["series_id"]


def by_idx(df, col, key="idx"):
    return [r[col] for r in sorted(df.collect(), key=lambda r: r[key])]


def test_differences(panel_of):
    p = panel_of({"a": [3, 5, 4, 8]})
    assert by_idx(wn.difference(p, K, ["y"], size=2), "y") == [2, -1, 4]
    assert by_idx(wn.second_difference(p, K, "y", size=2), "y") == [-3, 5]
    s = panel_of({"a": [1, 2, 4, 6, 9]})
    assert by_idx(wn.difference(s, K, ["y"], 2, size=3), "y") == [3, 4, 5]
    assert wn.difference(panel_of({"a": [1, 2]}), K, ["y"], 5).count() == 0


def test_inversions(panel_of, spark):
    pred = spark.createDataFrame([("a", 0, 2.0), ("a", 1, -1.0), ("a", 2, 4.0)], "series_id string, h bigint, p double")
    base = spark.createDataFrame([("a", 3.0)], "series_id string, b double")
    assert by_idx(wn.undo_difference(pred, base, K, "p", "b", "v", size=2), "v", "h") == [5, 4, 8]
    pred = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0), ("a", 2, 5.0)], "series_id string, h bigint, p double")
    last = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "series_id string, r int, b double")
    assert by_idx(wn.undo_seasonal_difference(pred, last, K, "p", "b", "v", 2, size=1), "v", "h") == [4, 6, 9]


def test_rolling_needs_full_windows(panel_of):
    p = panel_of({"a": [1, 2, 4, 4], "b": [1, None, 4, 4]})
    out = wn.rolling(p, K, "y", {"m": ("mean", 3), "s": ("std", 3)}, size=2)
    a = out.filter("series_id = 'a'")
    assert by_idx(a, "m") == [None, None, pytest.approx(7 / 3), pytest.approx(10 / 3)]
    assert by_idx(a, "s")[2] == pytest.approx(1.527525, abs=1e-6)
    assert by_idx(out.filter("series_id = 'b'"), "m") == [None] * 4


def test_threshold_alignment(panel_of):
    p = panel_of({"a": [3, 8, 12, 20], "b": [15, 16, 17, 18]}).withColumn("v", sentinel_below("y", 10))
    out = wn.align_to_threshold(p, K, "v", size=2)
    got = sorted((r.series_id, r.day, r.v) for r in out.collect())
    assert got == [("a", 1, 12), ("a", 2, 20), ("b", 1, 15), ("b", 2, 16), ("b", 3, 17), ("b", 4, 18)]


def test_samples(panel_of):
    p = panel_of({"a": [10, 20, 30, 40, 50, 60, 70, 80, 90], "short": [1, 2]})
    one = sorted((r.sample, r.inputs, r.targets) for r in wn.samples(p, K, ["y"], 3, 1, size=4).collect())
    assert len(one) == 6 and one[0] == (0, [10, 20, 30], [40]) and one[-1] == (5, [60, 70, 80], [90])
    two = sorted((r.sample, r.inputs, r.targets) for r in wn.samples(p, K, ["y"], 3, 2, size=4).collect())
    assert len(two) == 5 and two[-1] == (4, [50, 60, 70], [80, 90])


def test_lag_by_key_ignores_gaps(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 5.0), ("a", 12, 7.0)], "series_id string, pos bigint, y double")
    got = {r.pos: r.z for r in wn.lag_by_key(df, K, "y", 12, "z").collect()}
    assert got == {0: None, 2: None, 12: 1.0}


def test_slices(panel_of):
    p = panel_of({"a": range(5), "b": range(2)})
    assert sorted((r.series_id, r.idx) for r in slices.tail(p, 3).collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]
    cut = slices.drop_tail(p, 3)
    assert sorted((r.series_id, r.idx, r.n) for r in cut.collect()) == [("a", 0, 2), ("a", 1, 2)]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, "x", float("nan")), (2, None, 1.0), (3, "y", None)], "k int, s string, v double")
    clean = df.withColumn("v", nan_to_null("v"))
    assert clean.agg(F.count("v")).first()[0] == 1
    assert sorted(r.k for r in cl.keep_not_equal(df, "s", "x").collect()) == [2, 3]
