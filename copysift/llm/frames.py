"""Small helpers that every operator here shares: reading, cutting lineage, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs up to which a side may be broadcast (about 32 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there, so that a lost executor costs no recomputation.

    Spark removes what is no longer referred to where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, below spark.checkpoint.dir.

    Where that is unset, a temporary one is set in a local session (as in tests); on a cluster that is an error, as its machines share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (then Spark shuffles). Call it on a cut frame."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bytes up to which a side may be broadcast, where its rows differ in size.
BROADCAST_BYTES = 16_000_000


def within_bytes(df: DataFrame, bytes_of_row: F.Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows have ``most`` bytes at most, else as it is (then Spark shuffles). Call it on a cut frame."""
    return F.broadcast(df) if (df.agg(F.sum(bytes_of_row)).first()[0] or 0) <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
