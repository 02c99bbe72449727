"""Scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import shuffles_dropped


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own if driver and executors are one process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Scratch:
    """The tables that one operator writes on its way; a block whose end deletes all of them but the kept ones.

    Kept tables are what a result is still read from; they go when the session's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in list(self.paths):
            self.delete(path)

    def folder(self, label: str) -> str:
        """A new path in the shared folder, for files that are not a saved table; it is deleted as the block ends or by delete()."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths[path] = label
        return path

    def delete(self, path: str) -> None:
        fs, at = _files(self.spark, path)
        fs.delete(at, True)
        self.paths.pop(path, None)

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        """df, written to the shared folder and read again: what follows no longer depends on its lineage."""
        path = self.folder(label)
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.quill_path = path
        return back

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """saved(), but the table outlives the block."""
        back = self.saved(df, label)
        fs, at = _files(self.spark, back.quill_path)
        fs.deleteOnExit(at)
        self.paths.pop(back.quill_path)
        return back

    def dropped(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing needs any more."""
        self.delete(df.quill_path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder until the session's process ends, and read again."""
    return Scratch(df.sparkSession).kept(df, label)


def dropped(df: DataFrame) -> None:
    """Deletes a saved table that nothing needs any more."""
    Scratch(df.sparkSession).dropped(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *labels: str) -> list[str]:
    """The labels as column names that none of the columns has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in labels:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound; a shuffled join otherwise."""
    return F.broadcast(df) if rows <= most else df
