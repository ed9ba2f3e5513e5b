"""Session factory used by tests, the benchmark and command line runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "millrace", cores: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC time, AQE and fixed shuffle partitions.

    On a cluster the submitter's own settings apply; nothing here is needed by
    the operators except ``spark.checkpoint.dir``, which a cluster names itself.
    """
    master = f"local[{cores or os.cpu_count()}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("MILLRACE_CHECKPOINT_DIR") or "file://" + tempfile.mkdtemp(prefix="millrace-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="millrace-wh-"))
        .getOrCreate()
    )
