"""Tables that cut the lineage of iterative jobs, kept in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master, where nothing is shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='veilflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables under one folder of the shared folder; a table is dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/veilflow-{uuid.uuid4().hex}"
        #: Tasks of a step, if not as many as its last shuffle has partitions: for small tables dealt over very many.
        self.tasks: int | None = None
        self._n = 0
        self._tables: list[str] = []
        self._steps: list[tuple[str, DataFrame]] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def few(self, df: DataFrame) -> DataFrame:
        """``df`` in no more partitions than ``tasks``, before it goes to Python workers or is shuffled by another key; nothing is moved."""
        return df.coalesce(self.tasks) if self.tasks else df

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and go on from the written table."""
        self.few(df).write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """As cut(), under a name of its own for each call."""
        self._n += 1
        out = self.cut(df, f"{name}-{self._n}")
        self._steps.append((f"{name}-{self._n}", out))
        return out

    def sweep(self, *keep: DataFrame | None) -> None:
        """Drop the tables of all steps but those that ``keep`` names."""
        self.drop(*[name for name, df in self._steps if not any(df is k for k in keep)])
        self._steps = [x for x in self._steps if any(x[1] is k for k in keep)]

    def bucketed(self, df: DataFrame, name: str, n: int, key: str) -> DataFrame:
        """As cut(), in ``n`` buckets by ``key``: a join on it then shuffles the other side alone.

        Rows that come dealt by ``key`` into ``n`` partitions are written without another shuffle, one file a bucket.
        """
        table = f"veilflow_{uuid.uuid4().hex}"
        df.write.mode("overwrite").bucketBy(n, key).option("path", self.path(name)).saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that written tables have replaced; it does so when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def last(self, df: DataFrame) -> DataFrame:
        """Write the final rows and drop every other table of this scratch folder."""
        out = self.cut(df, "result")
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.drop(keep="result")
        return out

    def drop(self, *names: str, keep: str | None = None) -> None:
        jvm = self.spark._jvm
        hadoop = self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.base).getFileSystem(hadoop)
        if keep is None:
            for name in names:
                fs.delete(path(self.path(name)), True)
        elif fs.exists(path(self.base)):
            for entry in fs.listStatus(path(self.base)):
                if entry.getPath().getName() != keep:
                    fs.delete(entry.getPath(), True)


def drop_frame(scratch: Scratch, df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads, if it is one."""
    for file in df.inputFiles()[:1]:
        if scratch.base.rsplit("/", 1)[1] in file:
            scratch.drop(file.split(scratch.base.rsplit("/", 1)[1] + "/")[1].split("/")[0])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python workers batches of documents that fit in memory, unless the session sets its own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory of this worker to the system: idle workers are kept for later tasks, and what they hold counts on the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the batches of a task, which gives memory back when the task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
