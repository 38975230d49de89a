"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables; a folder of our own only where none is set and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Written:
    """A table written to the shared folder: its lineage is cut and any executor can read it again.

    Tables that a returned DataFrame still reads are dropped by whoever has read it, by `drop_after`, or when the program ends.
    """

    #: Tables that aren't dropped yet, in order of writing.
    left: ClassVar[list[Written]] = []

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        Written.left.append(self)
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def bytes(self) -> int:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def drop(self) -> None:
        if self in Written.left:
            Written.left.remove(self)
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_after(mark: int, keep: Written | None = None) -> None:
    """Drops the tables written since len(Written.left) was `mark`, but `keep`."""
    for w in Written.left[mark:]:
        if w is not keep:
            w.drop()


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        drop_after(0)
