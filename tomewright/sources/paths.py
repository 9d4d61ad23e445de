"""Scratch folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the cluster's spark.checkpoint.dir; where that is unset, below a temporary folder of a single-machine session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("tomewright.test.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tomewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("tomewright.test.dir", base)
    return f"{base.rstrip('/')}/tomewright-{kind}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, kind: str) -> DataFrame:
    """The rows written to the shared folder and read back: what several branches of a plan read is computed once."""
    path = scratch(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
