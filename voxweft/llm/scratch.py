"""Reading inputs and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: Removes the shuffle files of a write when it ends (Spark 4.1; others ignore it).
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir``."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, one of our own if all work is done on this
    machine; on a cluster its workers would each write to their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="voxweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run. ``save`` writes a frame to the shared folder and reads it back, so a lost
    executor costs at most a re-read; the folder goes when the driver ends. What was shuffled for the write goes as soon
    as it is done: nothing else reads it, since each write is planned anew."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = self.spark.conf.get(CLEAN_KEY, "false")
        self.spark.conf.set(CLEAN_KEY, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_KEY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A path beside the tables, for files that are written otherwise; it goes with them."""
        return f"{self.root}/{name}"

    def free(self) -> None:
        """Lets Spark's cleaner remove shuffle files and broadcasts of plans that nothing refers to any longer."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended already
            return


def least_common(counts: DataFrame, top: int) -> int:
    """The least power of two of which ``top`` rows at most have a count ``n`` as large; only sums by power are collected."""
    size = F.floor(F.log2("n")).cast("int").alias("size")
    out, rows = 62, 0
    for r in counts.groupBy(size).agg(F.count("*").alias("c")).orderBy(F.desc("size")).collect():
        rows += r["c"]
        if rows > top:
            break
        out = r["size"]
    return 1 << out
