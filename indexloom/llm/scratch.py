"""Tables written between the phases of an operator.

A phase that is read more than once is written as Parquet below the session's
``spark.checkpoint.dir`` and read again.  That cuts the lineage, survives lost
executors (the folder is shared by all of them), and lets Catalyst prune columns
of what was written.
"""

from __future__ import annotations

import gc
import math
import time
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.plans.tables import shared_folder


class Scratch:
    """Writes intermediate tables and removes those that are no longer needed."""

    #: Those made since a caller emptied the list, for callers that know when results have been written.
    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        Scratch.opened.append(self)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/indexloom-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:02d}-{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """``df`` as a written table, read again."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # with the frame itself, so that no other one can be taken for it
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes the tables of frames that nothing will read again."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path and path.startswith(f"{self.root}/"):
                self._delete(path)

    def clear(self) -> None:
        """Removes all its tables; frames that read them must have been written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished phases now: it does once their plans are collected here and in the JVM.

        Twice, as the plan that ran last is still held the first time.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def number(uid: str | None) -> Column:
    """The column ``uid``, unique and stable, or a number for each row."""
    return F.col(f"`{uid}`") if uid else F.monotonically_increasing_id()


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a number for each row, under a name that it does not have yet."""
    name, taken = "row_number", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return scratch.cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def by_key(side: DataFrame) -> DataFrame:
    """The side of a join with texts whose size follows the corpus: joined by key at every size, not broadcast while it is small."""
    return side.hint("merge")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def spread(rows: int) -> int:
    """Buckets for a two-level ranking of ``rows`` rows: as many buckets as rows in each."""
    return max(1, math.isqrt(max(1, rows)))
