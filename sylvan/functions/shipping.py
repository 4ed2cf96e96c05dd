"""Lets Python workers import this package, as ``--py-files`` does on a cluster, and keeps what they take at once small."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows hold whole texts, so that the default of 10,000 would be hundreds of megabytes a worker; an explicit setting of the user stays.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
#: Texts differ in length, and so would batches of so many rows; they end here too. The default is 64 MB.
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if spark.conf.get(BATCH_KEY, "10000") == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if spark.conf.get(BYTES_KEY, "64MB") in ("64MB", "67108864b"):
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))
