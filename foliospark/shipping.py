"""Makes the package importable on executors that do not share the driver's file system."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors as one small archive, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="foliospark-")) / "foliospark-modules.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shipped(run: Callable) -> Callable:
    """run(spark, ...) after ship(spark)."""

    @functools.wraps(run, updated=())
    def wrapped(spark, *args, **kwargs):
        ship(spark)
        return run(spark, *args, **kwargs)

    return wrapped
