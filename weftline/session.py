"""Session factory with the settings that the library is tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None, app: str = "weftline", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, one shuffle partition per core.

    On a cluster, use the session that spark-submit gives; nothing in the
    library depends on this function.
    """
    n = str(cores or os.environ.get("BENCH_CPUS") or 8)
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
