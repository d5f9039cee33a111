import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


def make_panel(spark, series: dict, names=("y",)):
    """{'a': [1, 2, ...]} or {'a': [(y, x), ...]} -> panel (series_id, pos, idx, n, values)."""
    rows = []
    for key, values in series.items():
        for i, v in enumerate(values):
            v = v if isinstance(v, tuple) else (v,)
            rows.append((key, 100 + i, i, len(values), *[None if x is None else float(x) for x in v]))
    ddl = "series_id string, pos bigint, idx bigint, n bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def panel_of(spark):
    return lambda series, names=("y",): make_panel(spark, series, names)
