"""Shared folder for intermediate tables and files.

The folder is the one that the cluster names in spark.checkpoint.dir. Only where
that setting is missing (single-machine tests) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("tomewright.test.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tomewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = "file://" + folder
            spark.conf.set("tomewright.test.dir", base)
    return f"{base.rstrip('/')}/tomewright-{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: it cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of `taken` equals, in any case."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow filesystem and path of a folder or file."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
