"""Makes this package importable in Python workers, wherever the session was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Add the package's folder to the path of Python workers. Executors on other machines
    need the package installed or sent by ``--py-files``."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *known]))
