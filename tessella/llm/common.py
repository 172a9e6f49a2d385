"""Shared plumbing: table access, tables written to the cluster's shared folder, packed arrays."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A temporary folder of this machine serves only where driver and executors are one process.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _FALLBACK[sc.applicationId]


class Scratch:
    """Tables and files of one query in the shared folder.

    ``keep`` writes a frame and returns it as a scan, which cuts the lineage: a lost executor
    costs the running stage and nothing before it.  ``drop`` removes a table no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clean)

    def keep(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        return out

    def folder(self, name: str) -> str:
        """A folder for files that tasks write themselves: a plain path where the shared folder is mounted, else a URI."""
        path = f"{self.root}/{name}"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
        return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path

    def release(self) -> None:
        """Lets Spark remove the shuffle files of frames that nothing refers to any more, such as those kept meanwhile."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        self._delete(df._tessella_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended
            pass


def ids_and_texts(batch: pa.RecordBatch) -> tuple[list, list]:
    """doc_id and text of a batch as lists, a null text as an empty one."""
    return batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]


def runs(batches, size: int = 400):
    """doc_id and text of a few documents at a time, so that what a task makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield ids_and_texts(b.slice(at, size))


def documents(df: DataFrame) -> DataFrame:
    """Only what the operators read, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
