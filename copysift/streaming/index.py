"""Keeping an index current: what changed by stamp, then by content, then by block; only new blocks are embedded.

What is to be read is worked off in batches of bounded size, each of them written before the next one begins: a stop or a crash loses
one batch at most, and the state shows how far the work has come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from copysift import config as C
from copysift.frames import cut
from copysift.functions.text import short_hash
from copysift.operators.blocks import extract_blocks
from copysift.sources.project import EVERY, listings, with_content
from copysift.sources.store import Store, latest, left_out

#: Bytes of source text in a batch, for each core.
BATCH_BYTES = 64 << 20


def to_read(files: DataFrame, state: DataFrame) -> DataFrame:
    """Listed files that are new, still to do, or have another time or size than in the index."""
    old = state.select("file", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), "dirty", F.col("content_hash").alias("old_hash"))
    same = ~F.col("dirty") & (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    return files.join(old, "file", "left").where(~F.coalesce(same, F.lit(False)))


def scan_for_changes(store: Store, files: DataFrame, root: str) -> int:
    """Brings the state table up to date with a listing; returns how many files were read. Files that are gone, left out or too large are removed."""
    files = cut(files.where((F.col("kind") == "file") & (F.col("size") <= C.MAX_FILE_BYTES)).select("file", "mtime", "size"))
    changed = cut(to_read(files, store.state()).select("file", "dirty", "old_hash"))
    gone = cut(left_out(store.state().select("file"), files, "file"))
    if gone.limit(1).count():
        store.remove_files(gone)
    if not changed.limit(1).count():
        return 0
    found = with_content(changed, root).select("file", "mtime", "size", short_hash(F.col("content")).alias("content_hash"))
    found = cut(found.join(changed, "file"))
    # touched, but with the old content: only its stamps are new
    stays = ~F.coalesce("dirty", F.lit(True)) & (F.col("content_hash") == F.col("old_hash"))
    rows = found.select("file", "mtime", "size", "content_hash", (~F.coalesce(stays, F.lit(False))).alias("dirty"), F.lit(None).cast("array<string>").alias("chunk_hashes"))
    store.merge_state(rows)
    return found.count()


def embed_blocks(store: Store, blocks: DataFrame, embedder) -> int:  # noqa: ANN001
    """Embeds the blocks whose hash has no vector yet, each once; returns how many."""
    wanted = cut(store.missing(blocks.select("norm_hash", "text")))
    n = wanted.count()
    if n:
        store.put_vectors(wanted.select("norm_hash", embedder.column(F.col("text")).alias("vector")))
    return n


def finish(store: Store, contents: DataFrame, settings: C.Settings, embedder) -> int:  # noqa: ANN001
    """Blocks, vectors and clean state rows of files (file, mtime, size, content). Vectors are written first, so a stop in between only repeats work."""
    contents = cut(contents)
    blocks = cut(extract_blocks(contents, settings.min_lines))
    n = embed_blocks(store, blocks, embedder)
    hashes = blocks.groupBy("file").agg(F.array_sort(F.collect_set("norm_hash")).alias("chunk_hashes"))
    done = contents.select("file", "mtime", "size", short_hash(F.col("content")).alias("content_hash"), F.lit(False).alias("dirty")).join(hashes, "file", "left")
    store.put_state(done.withColumn("chunk_hashes", F.coalesce("chunk_hashes", F.array().cast("array<string>"))))
    return n


def work_off(store: Store, root: str, dirty: DataFrame, settings: C.Settings, embedder) -> int:  # noqa: ANN001
    """Reads and indexes the files of ``dirty`` (file, size); those that have vanished leave the index. Returns how many blocks were embedded."""
    dirty = cut(dirty)
    contents = cut(with_content(dirty, root))
    gone = dirty.join(contents, "file", "left_anti")
    if gone.limit(1).count():
        store.remove_files(gone)
    return finish(store, contents, settings, embedder)


def batches(store: Store, root: str, settings: Callable[[], C.Settings], embedder, most_bytes: int | None = None) -> Iterator[int]:  # noqa: ANN001
    """Works off the dirty files, a batch for each step; yields how many blocks were embedded. Ends when none is dirty.

    Files are dealt to batches by a hash of their names, so that a batch has about ``most_bytes``; which ones are dirty is looked up again for
    each batch, and the settings are those in force then.
    """
    most = most_bytes or BATCH_BYTES * store.spark.sparkContext.defaultParallelism
    while True:
        left = store.state().where("dirty").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).first()
        if not left["files"]:
            return
        parts = max(1, math.ceil((left["bytes"] or 0) / most))
        for part in range(parts):
            yield work_off(store, root, store.state().where("dirty").where(F.pmod(F.xxhash64("file"), F.lit(parts)) == part).select("file", "size"), settings(), embedder)


def drain(store: Store, root: str, settings: C.Settings, embedder, most_bytes: int | None = None, stop: Callable[[], bool] = lambda: False) -> int:  # noqa: ANN001
    """Works off all dirty files in batches, until ``stop`` says so at the end of one. Returns how many blocks were embedded."""
    done = 0
    for n in batches(store, root, lambda: settings, embedder, most_bytes):
        done += n
        if stop():
            break
    return done


def index_changes(changes: DataFrame, store: Store, settings: C.Settings, embedder, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Maintains the index from a stream of (file, mtime, size, content) that somebody else provides; null content means that the file is gone.

    Every micro-batch keeps the last change of a file; all writes are upserts by content, so a batch that is run
    again after a failure changes nothing. The query ends when the stream has been read.
    """

    def batch(rows: DataFrame, _: int) -> None:
        last = cut(latest(rows.select("file", "mtime", "size", "content"), "file", F.col("mtime"), F.col("content").isNull()))
        gone = last.where("content is null")
        if gone.limit(1).count():
            store.remove_files(gone)
        finish(store, last.where("content is not null"), settings, embedder)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(spark: SparkSession, root: str, store: Store, settings: C.Settings, embedder, checkpoint: str, every: float | None = None, most_bytes: int | None = None) -> StreamingQuery:  # noqa: ANN001
    """Keeps the index of a project current: a micro-batch takes a listing, finds what it changes and works that off in batches.

    With ``every`` (seconds) it goes on until it is stopped; without, it takes one listing and ends. What has been indexed is in the
    state, by file, so a micro-batch that Spark runs again after a failure does only what is left.
    """

    def batch(rows: DataFrame, _: int) -> None:
        scan_for_changes(store, rows, root)
        drain(store, root, settings, embedder, most_bytes)

    stream = listings(spark, root, settings, every or EVERY).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=f"{every} seconds") if every else stream.trigger(availableNow=True)).start()
