"""Tables that a plan uses more than once, written to the folder that all executors share; a lost executor costs nothing that was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Kept:
    """Written tables under one new folder of ``spark.checkpoint.dir``; on a local master without one, of a temporary folder."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='veilflow-')}"
        self.spark, self.base, self._n = spark, f"{root.rstrip('/')}/veilflow-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as it is read again from where it was written."""
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
