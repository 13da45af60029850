"""The index of a project: a table of block vectors and a table of file states, each an append-only Parquet folder.

A write appends rows with a version, or marks of what is gone; a read takes the last row of each key. So a write costs what it
adds and not what is there, Spark's commit decides whether it counts, and the folder may be in any store that Spark reaches.
``compact`` appends the last rows once more and then removes the older files, the oldest first, so that at every moment the last row of
each key is there, and a mark stays as long as what it hides. One writer at a time.
"""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copysift.frames import cut
from copysift.operators.lookup import perhaps_present

VECTORS = "norm_hash string, vector array<float>, model_id string, created_at timestamp"
STATE = "file string, mtime double, size long, content_hash string, dirty boolean, chunk_hashes array<string>"


def folder_for(root: str, base: str = "~/.cache/copysift") -> str:
    """The index folder of a project: a hash of its lower-cased path."""
    return os.path.join(os.path.expanduser(base), hashlib.sha256(os.path.abspath(root).lower().encode()).hexdigest()[:16])


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by ``order``: an upsert of rows that were appended."""
    columns = rows.columns
    newest = W.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select(*columns)


def left_out(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def present(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_semi")


def orphans(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Vectors that no file's blocks refer to."""
    live = state.select(F.explode("chunk_hashes").alias("norm_hash"))
    return left_out(vectors, live, "norm_hash")


class Store:
    """Reads and writes of one index folder, which driver and executors share, for one model."""

    def __init__(self, spark: SparkSession, path: str, model_id: str) -> None:
        self.spark, self.path, self.model_id = spark, path, model_id
        self._counted: tuple[tuple, dict[str, int]] | None = None

    def _rows(self, name: str, schema: str) -> DataFrame:
        kind = f"{schema}, version long, gone boolean"  # a column that older files lack is read as null
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], kind)

    def _read(self, name: str, schema: str, *key: str) -> DataFrame:
        rows = self._rows(name, schema).withColumn("key", F.concat_ws("|", *key))
        return latest(rows, "key", F.col("version"), F.xxhash64(*(c for c in rows.columns if c != "key"))).where(~F.coalesce("gone", F.lit(False))).drop("key", "version", "gone")

    def _append(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        rows.withColumn("version", F.lit(time.time_ns())).withColumn("gone", F.lit(gone)).write.mode("append").parquet(f"{self.path}/{name}")

    def _files(self, name: str) -> list:
        """The Parquet files of a table, the oldest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")] if system.exists(folder) else []
        return sorted(found, key=lambda f: f.getModificationTime())

    def compact(self) -> None:
        """Leaves the last row of each key only."""
        for name, rows in (("vectors", self.all_vectors()), ("state", self.state())):
            older = self._files(name)
            self._append(name, cut(rows))
            for file in older:
                file.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(file.getPath(), False)

    def all_vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS, "model_id", "norm_hash")

    def vectors(self) -> DataFrame:
        """(norm_hash, vector) of this store's model."""
        return self.all_vectors().where(F.col("model_id") == self.model_id).select("norm_hash", "vector")

    def vectors_of(self, hashes: DataFrame) -> DataFrame:
        """(norm_hash, vector) of this store's model for ``hashes`` (norm_hash): vectors of others are dropped where they are read."""
        wanted = cut(hashes.select("norm_hash").distinct())
        rows = perhaps_present(self._rows("vectors", VECTORS).where(F.col("model_id") == self.model_id), wanted, "norm_hash")
        last = latest(rows, "norm_hash", F.col("version"), F.xxhash64(*rows.columns)).where(~F.coalesce("gone", F.lit(False)))
        return present(last.select("norm_hash", "vector"), wanted, "norm_hash")

    def missing(self, hashes: DataFrame) -> DataFrame:
        """The distinct rows of ``hashes`` by norm_hash that have no vector yet. No vectors are read, only keys and versions."""
        hashes = cut(hashes.dropDuplicates(["norm_hash"]))
        rows = perhaps_present(self._rows("vectors", VECTORS).where(F.col("model_id") == self.model_id).select("norm_hash", "version", "gone"), hashes, "norm_hash")
        there = rows.groupBy("norm_hash").agg(F.max_by(F.coalesce("gone", F.lit(False)), "version").alias("gone")).where("not gone")
        return left_out(hashes, there, "norm_hash")

    def put_vectors(self, rows: DataFrame) -> None:
        """Adds or replaces vectors (norm_hash, vector)."""
        self._append("vectors", rows.select("norm_hash", F.col("vector").cast("array<float>").alias("vector"), F.lit(self.model_id).alias("model_id"), F.current_timestamp().alias("created_at")))

    def drop_vectors(self) -> None:
        """Removes all vectors of this model."""
        self._append("vectors", self.all_vectors().where(F.col("model_id") == self.model_id), gone=True)

    def state(self) -> DataFrame:
        return self._read("state", STATE, "file")

    def dirty_files(self) -> DataFrame:
        return self.state().where("dirty").orderBy("file")

    def merge_state(self, changes: DataFrame, keep: DataFrame | None = None) -> None:
        """Adds or replaces file rows; with ``keep`` (file), others are removed. Null chunk_hashes keep the old ones."""
        old = cut(self.state())
        if keep is not None:
            self._append("state", left_out(old, keep, "file"), gone=True)
            old = present(old, keep, "file")
        rows = changes.join(old.select("file", F.col("chunk_hashes").alias("old_hashes")), "file", "left")
        self._append("state", rows.withColumn("chunk_hashes", F.coalesce("chunk_hashes", "old_hashes", F.array().cast("array<string>"))).select(*old.columns))

    def put_state(self, rows: DataFrame) -> None:
        """Adds or replaces whole file rows."""
        self._append("state", rows.select("file", "mtime", "size", "content_hash", "dirty", "chunk_hashes"))

    def remove_files(self, files: DataFrame) -> None:
        """Removes the rows of ``files`` (file)."""
        self._append("state", present(self.state(), files, "file"), gone=True)

    def mark_all_dirty(self) -> None:
        self._append("state", self.state().withColumn("dirty", F.lit(True)))

    def prune(self) -> int:
        """Removes vectors, of any model, that no file refers to; returns how many."""
        lost = cut(orphans(self.all_vectors(), self.state()))
        n = lost.count()
        if n:
            self._append("vectors", lost, gone=True)
            self.compact()
        return n

    def counts(self) -> dict[str, int]:
        """pending, files and vectors (of this model). They are counted once for each state of the folder: its files are listed, and only new ones bring a job."""
        version = tuple(f.getPath().getName() for name in ("state", "vectors") for f in self._files(name))
        if self._counted is None or self._counted[0] != version:
            row = self.state().agg(F.count_if("dirty").alias("pending"), F.count("*").alias("files")).first()
            self._counted = version, {"pending": row["pending"], "files": row["files"], "vectors": self.vectors().count()}
        return dict(self._counted[1])
