"""Linear recurrences over chunks against the plain recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators.recurrence import recurrence, responses
from loomcast.operators.windows import exponential_mean

K = ["series_id"]


def plain(a, b):
    state, out = np.zeros(len(a)), []
    for row in b:
        state = np.array(a) @ state + row
        out.append(state)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_blocks_equal_steps(n):
    rng = np.random.default_rng(n)
    a, b = [[0.5, -0.3], [1.0, 0.0]], rng.normal(size=(n, 2))
    assert np.allclose(responses(np.array(a), b, np.zeros(2)), plain(a, b), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("matrix", [[[0.9]], [[1.0]], [[0.6, 0.3], [1.0, 0.0]]])
def test_a_series_in_a_thousand_chunks(panel_of, matrix):
    rng = np.random.default_rng(1)
    data = {"long": list(rng.normal(size=3000)), "short": [1.0, 2.0], "one": [5.0]}
    inputs = {f"s{i}": F.col("y") if i == 0 else F.lit(0.0) for i in range(len(matrix))}
    rows = recurrence(panel_of(data), K, matrix, inputs, size=3).collect()
    assert len(rows) == 3003
    for name, y in data.items():
        b = np.zeros((len(y), len(matrix)))
        b[:, 0] = y
        want = plain(matrix, b)
        got = {r.idx: [r[f"s{i}"] for i in range(len(matrix))] for r in rows if r.series_id == name}
        assert np.allclose([got[i] for i in range(len(y))], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span", [1.5, 7.0, 5000.0])
def test_exponential_mean_of_any_span_and_gaps(panel_of, span):
    rng = np.random.default_rng(2)
    y = [None, None, *[None if rng.random() < 0.2 else float(v) for v in rng.normal(10, 1, 400)]]
    rows = exponential_mean(panel_of({"a": y, "none": [None] * 5}), K, "y", span, "m", size=7).collect()
    keep, num, den = 1 - 2 / (span + 1), 0.0, 0.0
    got = {r.idx: r.m for r in rows if r.series_id == "a"}
    for i, v in enumerate(y):
        num, den = keep * num + (v or 0.0), keep * den + (v is not None)
        assert got[i] == (pytest.approx(num / den, rel=1e-9) if den else None)
    assert {r.m for r in rows if r.series_id == "none"} == {None}


def test_no_lists_in_the_plan(panel_of):
    plan = exponential_mean(panel_of({"a": [1.0, 2.0]}), K, "y", 7, "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
