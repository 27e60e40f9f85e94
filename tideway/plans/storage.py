"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share; a temporary one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tideway-streams-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def keeper(spark: SparkSession):
    """A function that writes a frame to a new shared folder and reads it back, so that it is computed once."""

    def keep(rows: DataFrame) -> DataFrame:
        at = f"{folder(spark)}/kept"
        rows.write.parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    return keep
