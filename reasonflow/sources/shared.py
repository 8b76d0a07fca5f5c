"""The folder that the driver and all executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``; a local session without either gets one of its own."""
    context = spark.sparkContext
    found = spark.conf.get(KEY, None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="reasonflow-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/reasonflow/{name}-{uuid.uuid4().hex}"
