"""What a session needs before Python code of this package runs on its workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048
BYTES_KEY, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
PARALLEL_KEY, SIZE_KEY, SIZE = "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets workers import this package from where the driver has it; where it is installed, that changes nothing.
    Batches that go to Python are ``BATCH`` rows or ``BYTES``, unless the session says otherwise: the defaults of 10,000 rows
    and 64 MB are large where rows are whole texts. Small shuffle partitions are put together up to ``SIZE`` (bytes as written,
    compressed), not into as few tasks as there are cores, so what a task sorts stays small."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH))
    if spark.conf.get(BYTES_KEY, "64MB") == "64MB":
        spark.conf.set(BYTES_KEY, BYTES)
    if spark.conf.get(PARALLEL_KEY) == "true":
        spark.conf.set(PARALLEL_KEY, "false")
        if spark.conf.get(SIZE_KEY) in ("64MB", "67108864b"):
            spark.conf.set(SIZE_KEY, SIZE)
    return spark
