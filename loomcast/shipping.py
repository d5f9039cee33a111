"""Python tasks need the package on every worker: the session hands it out as a zip file, once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

_SHIPPED: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after its session has sent this package to the executors; for ``df.transform``."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="loomcast-zip-"), "loomcast.zip")
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("loomcast", os.path.relpath(path, package)))
        context.addPyFile(target)
        _SHIPPED.add(context.applicationId)
    return df
