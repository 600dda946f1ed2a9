"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long expressions are built from many calls; recording where each was made takes longer.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: str | int = "*", shuffle_partitions: int = 8, app: str = "corpusmill"
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in SESSION_DEFAULTS.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.corpusmill.spread", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in one process may do without the setting and gets a temporary
    folder; a cluster without it is refused, since its executors would write to
    their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusmill-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    The files go when nothing refers to the result any more, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it lies."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


# A side with at most this many slim rows is broadcast.
BROADCAST_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a side expected to be small, such as one row per class.

    Its rows are counted first: up to ``BROADCAST_ROWS`` it is broadcast and
    ``df`` stays where it is, above that both sides are shuffled.
    """
    fixed = cut_lineage(small)
    return df.join(F.broadcast(fixed) if fixed.count() <= BROADCAST_ROWS else fixed, on, how)
