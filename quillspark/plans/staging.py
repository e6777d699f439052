"""Cutting lineage with tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset and the master is local
(tests on one machine) a temporary folder of this process is used instead; on a cluster
that would be a folder of one machine, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


class Staged:
    """A table written once to the shared folder; ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: computed once, with no lineage."""
    return Staged(df).df


class Scratch:
    """Staged tables of one job: ``scratch(df)`` stages, and leaving the ``with`` block deletes them all.

    A frame that is returned must not read them.
    """

    def __init__(self) -> None:
        self.tables: list[Staged] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(Staged(df))
        return self.tables[-1].df

    def __exit__(self, *_: object) -> None:
        for table in self.tables:
            table.drop()
