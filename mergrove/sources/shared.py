"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import IllegalArgument


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session within this process alone may do without, and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise IllegalArgument("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mergrove-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
