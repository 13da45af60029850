"""A project folder as a Spark data source: ``spark.read.format("project").option("root", ...)``, or ``spark.readStream`` alike.

Listing reads no contents. Rows are (kind, file, mtime, size), kind "file" or "repository" (a nested one that is
left out); each top-level folder is a partition of its own. Contents are read in a second step, by tasks, for
the files that are left after filters.

As a stream, a micro-batch is a listing of the whole project, taken by its tasks. The offset is the version of the listing (the
time, in steps of option "every", in seconds) and the commit that is checked out; while a checkout is going on, no new version is
admitted. A listing that was missed is covered by the next, so a batch never has more than one.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from copysift import config as C
from copysift.sources.globs import matches

SCHEMA = "kind string, file string, mtime double, size long"
#: Seconds between two listings of a stream.
EVERY = 2.0
#: A checkout writes several files of the repository; it is over when they have stayed as they are for so long.
SETTLE_SECONDS = 0.3


def git_fingerprint(root: str) -> str | None:
    """Changes when another commit is checked out: HEAD, what it names, and the packed refs. None without a repository."""
    folder = os.path.join(root, ".git")
    try:
        if os.path.isfile(folder):
            with open(folder, encoding="utf-8") as f:
                folder = os.path.join(root, f.read().partition("gitdir:")[2].strip())
        with open(os.path.join(folder, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
    except OSError:
        return None
    parts = [head]
    for name in (head.partition("ref: ")[2], "packed-refs"):
        try:
            stat = os.stat(os.path.join(folder, name))
            parts.append(f"{stat.st_mtime_ns}:{stat.st_size}" if name else "")
        except OSError:
            parts.append("")
    return "|".join(parts)


def settled_fingerprint(root: str, seconds: float = SETTLE_SECONDS, most: float = 5.0) -> str | None:
    """git_fingerprint(), once it has not changed for ``seconds`` (after ``most`` seconds as it is)."""
    until, last = time.monotonic() + most, git_fingerprint(root)
    while last is not None and time.monotonic() < until:
        time.sleep(seconds)
        now = git_fingerprint(root)
        if now == last:
            break
        last = now
    return last


class Scope:
    """Which folders and files of a project are looked at. Excludes win over includes."""

    def __init__(self, include: tuple[str, ...], exclude: tuple[str, ...], nested: bool) -> None:
        self.include, self.exclude, self.nested = include, exclude, nested

    def enters(self, name: str, path: str) -> bool:
        return not (name.startswith(".") or name in C.SKIP_DIRECTORIES or matches(path, self.exclude) or matches(f"{path}/", self.exclude))

    def holds(self, path: str) -> bool:
        return os.path.splitext(path)[1].lower() in C.SOURCE_EXTENSIONS and matches(path, self.include) and not matches(path, self.exclude)

    def walk(self, root: str, folder: str, deep: bool) -> Iterator[tuple]:
        """Rows below a folder, byte-sorted, depth first. What cannot be read is skipped."""
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: os.fsencode(e.name))
        except OSError:
            return
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                if entry.is_dir(follow_symlinks=False):
                    if deep and self.enters(entry.name, path):
                        if not self.nested and os.path.exists(os.path.join(entry.path, ".git")):
                            yield ("repository", path, None, None)
                        else:
                            yield from self.walk(root, path, True)
                elif entry.is_file() and self.holds(path):
                    stat = entry.stat()
                    yield ("file", path, stat.st_mtime_ns / 1e6, stat.st_size)
            except OSError:
                continue


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"]
        self.scope = Scope(tuple(json.loads(options.get("include", '["**"]'))), tuple(json.loads(options.get("exclude", "[]"))), options.get("nested", "false") == "true")

    def partitions(self) -> list[InputPartition]:
        out = [InputPartition("")]
        for entry in sorted(os.scandir(self.root), key=lambda e: os.fsencode(e.name)):
            if entry.is_dir(follow_symlinks=False) and self.scope.enters(entry.name, entry.name):
                out.append(InputPartition(entry.name))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = partition.value
        if folder and not self.scope.nested and os.path.exists(os.path.join(self.root, folder, ".git")):
            yield ("repository", folder, None, None)
        else:
            yield from self.scope.walk(self.root, folder, bool(folder))


class _StreamReader(DataSourceStreamReader):
    """Listings, one version after the other."""

    def __init__(self, options: dict) -> None:
        self.listing, self.every = _Reader(options), float(options.get("every", EVERY))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"version": 0, "tree": None}

    def latestOffset(self) -> dict:
        tree = git_fingerprint(self.listing.root)
        if self.last and self.last["tree"] != tree:
            tree = settled_fingerprint(self.listing.root)
        offset = {"version": int(time.time() / self.every), "tree": tree}
        if self.last and tree != self.last["tree"]:
            offset["version"] = max(offset["version"], self.last["version"] + 1)
        elif self.last and offset["version"] <= self.last["version"]:
            offset = self.last
        self.last = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.listing.partitions()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.listing.read(partition)


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: ANN001
        return _StreamReader(self.options)


def _options(root: str, settings: C.Settings) -> dict[str, str]:
    return {"root": os.path.abspath(root), "include": json.dumps(settings.include), "exclude": json.dumps(settings.exclude), "nested": str(settings.include_nested_repositories).lower()}


def listing(spark: SparkSession, root: str, settings: C.Settings) -> DataFrame:
    spark.dataSource.register(ProjectSource)
    return spark.read.format("project").options(**_options(root, settings)).load()


def listings(spark: SparkSession, root: str, settings: C.Settings, every: float = EVERY) -> DataFrame:
    """A stream of listings, one each ``every`` seconds."""
    spark.dataSource.register(ProjectSource)
    return spark.readStream.format("project").options(**_options(root, settings), every=str(every)).load()


def with_content(files: DataFrame, root: str, max_bytes: int | None = C.MAX_FILE_BYTES) -> DataFrame:
    """(file, mtime, size, content) of the listed files that are there and no larger than ``max_bytes``."""
    root = os.path.abspath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["file"]:
                path = os.path.join(root, file)
                try:
                    stat = os.stat(path)
                    if max_bytes is not None and stat.st_size > max_bytes:
                        continue
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pd.DataFrame({"file": [file], "mtime": [stat.st_mtime_ns / 1e6], "size": [stat.st_size], "content": [content]})

    if max_bytes is not None and "size" in files.columns:
        files = files.where(F.col("size").isNull() | (F.col("size") <= max_bytes))
    return files.select("file").mapInPandas(run, "file string, mtime double, size long, content string")
