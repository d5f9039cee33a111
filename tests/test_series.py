"""Calendar positions, densification, sinks and sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomcast.functions.calendar import STEPS, period_start, position
from loomcast.sources import tables as tb
from loomcast.sources.series import panel, stored

K = ["series_id"]


def test_positions_round_trip(spark):
    stamps = [dt.datetime(1969, 12, 31, 23, 59), dt.datetime(1970, 1, 1), dt.datetime(2000, 2, 29, 5, 30), dt.datetime(2024, 12, 31, 23, 0)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    unit = {"year": "year", "month": "month", "day": "day", "hour": "hour"}
    for step in STEPS:
        rows = df.select(position("t", step).alias("p"), F.date_trunc(unit[step], "t").cast("timestamp_ntz").alias("want"))
        for r in rows.select(period_start("p", step).cast("timestamp_ntz").alias("got"), "want").collect():
            assert r.got == r.want, step


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_densify(spark, size):
    day = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame(
        [("a", day(1), 1.0), ("a", day(1), 2.0), ("a", day(6), 4.0), ("b", day(3), 5.0), (None, day(2), 9.0), ("b", None, 9.0)],
        "series_id string, t timestamp_ntz, v double")
    whole = panel(df, K, "t", "day", {"y": F.sum("v")}, size=size)
    got = sorted((r.series_id, r.idx, r.n, r.y) for r in whole.collect())
    assert got == [("a", i, 6, v) for i, v in enumerate([3, 0, 0, 0, 0, 4])] + [("b", i, 6, v) for i, v in enumerate([0, 0, 5, 0, 0, 0])]
    own = panel(df, K, "t", "day", {"y": F.avg("v")}, fill=None, bounds="series", size=size)
    got = sorted((r.series_id, r.idx, r.n, r.y) for r in own.collect())
    assert got == [("a", i, 6, v) for i, v in enumerate([1.5, None, None, None, None, 4])] + [("b", 0, 1, 5.0)]
    cut = panel(df, K, "t", "day", {"y": F.sum("v")}, drop_last=1, size=size)
    assert cut.filter("series_id = 'a'").count() == 5
    assert panel(df, K, "t", "day", {"y": F.sum("v")}, drop_last=6, size=size).count() == 0


def test_stored_panel_is_the_same(panel_of):
    p = panel_of({"a": [1, None, 3], "b": [4]})
    assert sorted(stored(p).collect(), key=str) == sorted(p.collect(), key=str)


def test_grid_order():
    grid = tb.grid({"p": [0, 1], "d": [0, 1]})
    assert grid == [{"p": 0, "d": 0}, {"p": 0, "d": 1}, {"p": 1, "d": 0}, {"p": 1, "d": 1}]


def test_csv_round_trip_prunes_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, i int, v double")
    path = tb.write_csv(df, str(tmp_path / "t"))
    back = tb.scan_csv(spark, path, "k string, i int, v double", ["k", "v"])
    assert sorted(back.collect()) == [("a", 0.5), ("b", None)]
    assert "ReadSchema: struct<k:string,v:double>" in back._jdf.queryExecution().toString()
