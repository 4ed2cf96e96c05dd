"""Tables in the shared folder: where lineage is cut so that any executor can reread it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        folder = tempfile.mkdtemp(prefix="sylvan-")
        atexit.register(shutil.rmtree, folder, True)
        _own[key] = f"file://{folder}"
    return _own[key]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The table written and reread."""
    path = f"{shared_folder(df.sparkSession)}/sylvan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
