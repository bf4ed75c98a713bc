"""Reading tables and keeping intermediate results where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a local session that sets none."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="auditlake-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


class Scratch:
    """Tables written during one operator call.

    Writing cuts the lineage: a lost executor costs the files' readers nothing, and what is read back has
    known sizes, so that a join picks its strategy by them and both its sides come from plain exchanges,
    which adaptive execution can split where a key is hot. Tables that nobody drops, such as those a result is
    still read from, are deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame) -> DataFrame:
        if not self.count:
            fs, p = self._path(self.root)
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            fs, p = self._path(t._scratch_path)
            fs.delete(p, True)


def text_key(text: Column) -> Column:
    """With doc_id it names a row; rows that agree in both are repeats and get equal results."""
    return F.xxhash64(text)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
