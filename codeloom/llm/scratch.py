"""Intermediate tables in the folder that all machines of a cluster share.

An iterative operator cuts its lineage by writing a table here and reading it again, so a lost executor costs
one step and not the whole history. The folder is ``spark.checkpoint.dir``; only where that is unset (tests on
one machine) a temporary folder is made and set.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from codeloom.storage import shared_dir

_left: list["Scratch"] = []


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """The tables of one call of an operator.

    ``drop`` removes a table that nothing reads any more. What the returned DataFrame still reads stays until
    the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        _left.append(self)

    def keep(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Write df and return the table read back; its shuffle files go as soon as it is written."""
        self._count += 1
        path = f"{self.root}/{self._count}"
        if files:
            df = df.coalesce(files)
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Remove all tables of this call, also those that its result reads."""
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)
        if self in _left:
            _left.remove(self)


@atexit.register
def _clean() -> None:
    for s in list(_left):
        try:
            s.close()
        except Exception:  # the application has ended already; the folder is then its owner's to clear
            pass
