"""Python workers of a session find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def found_by_workers(spark: SparkSession) -> SparkSession:
    """``spark``, whose later Python tasks have the folder of this package on their path.

    The folder has to be at the same place on all machines, as an installation is.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
