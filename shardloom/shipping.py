"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_shardloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shardloom-")  # the driver serves the file from there until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "shardloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for place, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(target)
    context._shardloom_shipped = True


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run
