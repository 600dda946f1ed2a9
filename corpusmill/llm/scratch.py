"""Intermediate tables in the shared folder, removed when the operator is done with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.base import shared_folder
from corpusmill.settings import cut_lineage

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of named Parquet tables that all executors share.

    A table is computed once when it is stored, which cuts its lineage: a lost executor costs the
    tasks of one step only, and the files outlive it. ``finish`` moves the result out of the folder
    and removes everything else.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count}-{name}"

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``df`` as a table of its own; the shuffles that made it are freed once it is written."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(_FREE, "false")
        conf.set(_FREE, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a stored table that nothing reads any more."""
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            self._delete(path)

    def remove(self) -> None:
        """Delete the folder; only what ``finish`` returned can be read afterwards."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` as a checkpoint, which Spark's cleaner drops with the last reference to it."""
        return cut_lineage(self.store(df, "result"))


def placed(scratch: Scratch, ordered: DataFrame, name: str, part: str | None = None) -> DataFrame:
    """Adds 1..n to a table whose partitions, and the rows in them, stand in order.

    With ``part`` the number of the partition stays as a column.
    """
    spots = scratch.store(ordered.withColumn("__spot", F.monotonically_increasing_id()), name)
    # High bits number the partition, low bits the row in it.
    number = F.shiftright(F.col("__spot"), 33)
    sizes = spots.groupBy(number.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = spots.withColumn("__part", number).join(F.broadcast(offsets), "__part")
    place = F.col("__before") + F.col("__spot") - F.shiftleft(F.col("__part"), 33) + 1
    kept = joined.withColumn(name, place).drop("__spot", "__before")
    return kept.withColumnRenamed("__part", part) if part else kept.drop("__part")


def numbered(scratch: Scratch, df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds 1..n in the order of ``order``: sorted over all tasks, then an offset per partition."""
    return placed(scratch, df.orderBy(*order), name)
