"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "loomcast") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all tasks run in this process (tests, a laptop) a fresh local folder is
    set; on a cluster that is an error, as executors do not see each other's folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = known or tempfile.mkdtemp(prefix="loomcast-")
        if not known:
            spark.sparkContext.setCheckpointDir(current)
            current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")
