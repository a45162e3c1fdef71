"""Written tables that cut lineage, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def merged(df: DataFrame) -> DataFrame:
    """df, merged whatever its size in the join that it's given to. Spark goes by the bytes of a table's files, of which numbers and repeated names take very few, and would broadcast many times that from the driver."""
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (now := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = now.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="dupforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


class Scratch:
    """Tables of one run. They lie in the shared folder, so a lost executor loses none of them, and are deleted when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.top, self.kept = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", False

    def _place(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.kept:
            top, fs = self._place()
            self.kept = fs.deleteOnExit(top)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """For tables that no later step reads."""
        path, fs = self._place(name)
        fs.delete(path, True)
