"""Session builder used by tests, the benchmark and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, name: str = "foliospark") -> SparkSession:
    """A local session with the settings that the library expects anywhere: UTC and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
