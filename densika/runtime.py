"""Where Python workers find the package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def visible(spark: SparkSession) -> SparkSession:
    """Workers search the folder that the driver imported the package from, whatever its working folder.

    It serves local sessions and clusters with a shared file system; elsewhere ship the package with --py-files.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])
    return spark
