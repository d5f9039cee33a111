"""Split windows give exactly what plain windows give, with one series holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from loomcast.operators import split, windows as wn

K = ["series_id"]


@pytest.fixture(scope="module")
def skewed(panel_of):
    rng = random.Random(1)
    sizes = {"hot": 211, "b": 40, "c": 1, "d": 7, "e": 8}
    return panel_of({k: [rng.choice([None, rng.random()]) if rng.random() < 0.1 else rng.random() for _ in range(n)]
                     for k, n in sizes.items()}).cache()


def rows(df, *cols):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("size", [3, 7, 8, 1000])
def test_bounded_windows(skewed, size):
    def make(w):
        return {"a": F.lag("y", 5).over(w), "b": F.lead("y", 4).over(w),
                "c": F.avg("y").over(w.rowsBetween(-5, 4)), "m": F.count("y").over(w.rowsBetween(-3, 0))}

    plain = Window.partitionBy("series_id").orderBy("idx")
    want = skewed.select("*", *[c.alias(k) for k, c in make(plain).items()])
    got = split.windowed(skewed, K, make, before=5, after=4, size=size)
    cols = ["series_id", "idx", "a", "b", "c", "m"]
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("size", [4, 1000])
def test_running_sum_and_totals(skewed, size):
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("*", F.coalesce(F.sum("y").over(w), F.lit(0.0)).alias("run"))
    got = split.running_sum(skewed, K, {"run": F.coalesce("y", F.lit(0.0))}, size=size)
    assert rows(got, "series_id", "idx", "run") == rows(want, "series_id", "idx", "run")
    whole = Window.partitionBy("series_id")
    want = skewed.select("*", F.count("y").over(whole).alias("m"), F.max("y").over(whole).alias("top"))
    got = split.with_series_totals(skewed, K, {"m": (F.count("y"), "sum"), "top": (F.max("y"), "max")}, size=size)
    assert rows(got, "series_id", "idx", "m", "top") == rows(want, "series_id", "idx", "m", "top")


def test_row_numbers_and_forward_fill(skewed):
    w = Window.partitionBy("series_id").orderBy("idx")
    kept = skewed.filter("idx % 3 <> 1")
    bucket = F.floor(F.col("idx") / 10)
    want = kept.select("*", F.row_number().over(w).cast("bigint").alias("rn"))
    assert rows(split.row_numbers(kept, K, ["idx"], bucket), "series_id", "idx", "rn") == rows(want, "series_id", "idx", "rn")
    sparse = skewed.withColumn("v", F.when(F.col("idx") % 23 == 4, F.col("y")))
    want = sparse.select("*", F.last("v", ignorenulls=True).over(w).alias("f"))
    got = split.forward_fill(sparse, K, "idx", "v", bucket, "f")
    assert rows(got, "series_id", "idx", "f") == rows(want, "series_id", "idx", "f")


def test_exponential_mean_reaches_back_far_enough(panel_of):
    values = [float((i * 37) % 11) for i in range(300)]
    got = {r.idx: r.e for r in wn.exponential_mean(panel_of({"a": values}), K, "y", 7, "e", size=16).collect()}
    for t in (0, 5, 299):
        weights = [0.75 ** (t - u) for u in range(t + 1)]
        want = sum(w * v for w, v in zip(weights, values)) / sum(weights)
        assert got[t] == pytest.approx(want, rel=1e-13)
