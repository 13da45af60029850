"""What a user asks of a project: detect, status, explain, reindex, prune."""

from __future__ import annotations

import os
import threading
import time
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copysift import config as C
from copysift.frames import cut
from copysift.functions.embed import StructureEmbedder
from copysift.functions.report import to_yaml
from copysift.functions.text import short_hash
from copysift.operators import rank
from copysift.operators.blocks import extract_blocks
from copysift.operators.clusters import Clusters, with_occurrences
from copysift.plans.detect import find_clusters
from copysift.sources.project import git_fingerprint, listing, settled_fingerprint, with_content
from copysift.sources.store import Store, folder_for
from copysift.streaming.index import batches, scan_for_changes

CONFIDENCE_GUIDE = {
    "certain": "the blocks are equal but for layout and comments",
    "high": "most lines agree, and the blocks are far more alike than others of their size",
    "moderate": "likely one origin, changed since; worth a look",
    "low": "alike in outline; read both before acting",
}
REFRESH_SECONDS = 2.0
#: What a report says of a cluster, in this order.
SHOWN = ["id", "occurrences", "frequency", "median_lines", "removable_lines", "severity", "similarity", "alignment", "match_type", "confidence", "preview", "suppressed"]


class Findings:
    """The clusters told last, with the content hashes of their files. The longest ago told is forgotten first; a look-up does not count as telling."""

    def __init__(self, limit: int = C.REMEMBERED_FINDINGS) -> None:
        self.limit, self._held = limit, OrderedDict()

    def remember(self, cluster: dict, hashes: dict[str, str]) -> None:
        self._held.pop(cluster["id"], None)
        self._held[cluster["id"]] = (cluster, hashes)
        while len(self._held) > self.limit:
            self._held.popitem(last=False)

    def find(self, cluster_id: str) -> tuple[dict, dict[str, str]] | None:
        return self._held.get(cluster_id)


def listed(paths: list[str], total: int | None = None) -> str:
    """Some paths by name, and how many more there are of ``total``."""
    shown = paths[: C.MAX_LISTED]
    more = (len(paths) if total is None else total) - len(shown)
    return ", ".join(shown) + (f" and {more} more" if more > 0 else "")


class Engine:
    """One project. Requests are served one at a time; indexing lets them pass after each batch (of about ``batch_bytes``)."""

    def __init__(self, spark: SparkSession, root: str, index: str | None = None, embedder: Any = None, settings: C.Settings | None = None, batch_bytes: int | None = None) -> None:
        self.spark, self.root = spark, os.path.abspath(root)
        self.embedder = embedder or StructureEmbedder()
        self._given = settings
        self.settings = C.read_config(self.root) or settings or C.Settings()
        if index is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name an index folder that the driver and all executors share")
        self.store = Store(spark, index or folder_for(self.root), self.embedder.model_id)
        self.findings = Findings()
        self.batch_bytes, self._refreshed, self._tree = batch_bytes, 0.0, None
        self._door, self._lock, self._served, self._stop = threading.Lock(), threading.Lock(), None, threading.Event()
        self._files: DataFrame | None = None
        self._scope: dict[str, Any] | None = None
        self._indexing: threading.Thread | None = None

    @contextmanager
    def _turn(self) -> Iterator[None]:
        """Serves one thread at a time, in the order in which they came: who waits holds the door, so nobody gets past."""
        if self._served == threading.get_ident():
            yield
            return
        with self._door:
            self._lock.acquire()
        self._served = threading.get_ident()
        try:
            yield
        finally:
            self._served = None
            self._lock.release()

    # -- keeping current

    def adopt_config(self) -> None:
        """Reads the settings again; a malformed file leaves the old ones in force."""
        try:
            self.settings = C.read_config(self.root) or self._given or C.Settings()
        except ValueError:
            return

    def refresh(self, force: bool = False) -> None:
        """Looks for changes, at most every two seconds unless the checked-out commit is another."""
        with self._turn():
            tree = git_fingerprint(self.root)
            if tree != self._tree and self._tree is not None:
                tree = settled_fingerprint(self.root)  # another commit is being checked out
            if not force and tree == self._tree and time.monotonic() - self._refreshed < REFRESH_SECONDS and self._files is not None:
                return
            self.adopt_config()
            self._files, self._scope = cut(listing(self.spark, self.root, self.settings)), None
            scan_for_changes(self.store, self._files, self.root)
            self._tree, self._refreshed = tree, time.monotonic()

    def index(self) -> int:
        """Embeds what the index lacks, if the model is there, batch by batch, until stop() is called. Returns how many blocks were embedded."""
        done, parts = 0, batches(self.store, self.root, lambda: self.settings, self.embedder, self.batch_bytes)
        self._stop.clear()
        while self.embedder.status() == "ready" and not self._stop.is_set():
            with self._turn():
                n = next(parts, None)
            if n is None:
                break
            done += n
        return done

    def stop(self, seconds: float | None = None) -> bool:
        """Ends indexing after the batch that is being worked on; what is left stays to be done. Says whether it has ended."""
        self._stop.set()
        return self.wait(seconds)

    def start(self) -> bool:
        """Goes on indexing in the background, if something is left to do and the model is there; says whether it does."""
        if self._indexing is not None and self._indexing.is_alive():
            return True
        if self.embedder.status() != "ready" or not self.store.counts()["pending"]:
            return False
        self._indexing = threading.Thread(target=self.index, name="copysift-index", daemon=True)
        self._indexing.start()
        return True

    def wait(self, seconds: float | None = None) -> bool:
        """Waits for the background indexing; says whether it is done."""
        if self._indexing is not None:
            self._indexing.join(seconds)
        return self._indexing is None or not self._indexing.is_alive()

    def watch(self, seconds: float = REFRESH_SECONDS) -> threading.Event:
        """Looks at the repository's state every few seconds and refreshes when it has settled on another commit, until the returned event is set."""
        stop, seen = threading.Event(), git_fingerprint(self.root)

        def look(seen: str | None = seen) -> None:
            while not stop.wait(seconds):
                if git_fingerprint(self.root) != seen:
                    seen = settled_fingerprint(self.root)
                    self.refresh(force=True)

        threading.Thread(target=look, name="copysift-watch", daemon=True).start()
        return stop

    def _source(self) -> DataFrame:
        return self._files.where("kind = 'file'")

    # -- progress

    def progress(self) -> dict[str, int]:
        counts = self.store.counts()
        scope = self.scope()["files_in_scope"]
        done = max(0, scope - counts["pending"])
        return {"files_in_scope": scope, "files_embedded": done, "pending_files": counts["pending"], "percent_complete": 100 * done // scope if scope else 100}

    def scope(self) -> dict[str, Any]:
        """What is looked at; counted once for each listing."""
        if self._scope is None:
            self._scope = self._counted_scope()
        return dict(self._scope)

    def _counted_scope(self) -> dict[str, Any]:
        skipped = self._files.where("kind = 'repository'")
        out = {"files_in_scope": self._source().count(), "config_file": C.CONFIG_FILE, "configured": os.path.exists(os.path.join(self.root, C.CONFIG_FILE))}
        out["largest_folders"] = [r.asDict() for r in rank.largest_folders(self._source()).collect()]
        if n := skipped.count():
            out |= {"skipped_nested_repositories": [r["file"] for r in skipped.orderBy("file").limit(C.MAX_LISTED).collect()], "skipped_nested_repositories_count": n}
        return out

    @staticmethod
    def scope_notice(scope: dict[str, Any]) -> str | None:
        """What a reader may want to change about the scope: repositories that are left out, or a large project without settings."""
        parts = []
        if names := scope.get("skipped_nested_repositories"):
            parts.append(f"{scope['skipped_nested_repositories_count']} repositories inside this one are left out: {listed(names, scope['skipped_nested_repositories_count'])}. \"includeNestedRepositories\": true in {C.CONFIG_FILE} takes them in.")
        if not scope["configured"] and scope["files_in_scope"] >= C.SMALL_PROJECT_FILES:
            folders = ", ".join(f"{f['folder']} ({f['files']})" for f in scope["largest_folders"])
            parts.append(f"All {scope['files_in_scope']} source files are in scope, as there is no {C.CONFIG_FILE}; most are in {folders}. Name what is not this team's code there, as globs under \"exclude\" (or \"include\"); the next request reads it.")
        return " ".join(parts) or None

    def status(self) -> dict[str, Any]:
        with self._turn():
            self.refresh()
            counts, model = self.store.counts(), self.embedder.status()
            return {"pending_files": counts["pending"], "files_indexed": counts["files"], "chunks_cached": counts["vectors"], "model_status": model, "ready": model == "ready" and not counts["pending"], "progress": self.progress(), "scope": self.scope(), "analysis_mode": "heuristic"}

    # -- answers

    def _contents(self) -> DataFrame:
        return with_content(self._source(), self.root)

    def clusters(self, query: C.Query) -> Clusters:
        blocks = extract_blocks(self._contents(), self.settings.min_lines)
        if query.min_lines is not None:
            blocks = blocks.where(F.col("sig_lines") >= query.min_lines)
        blocks = cut(blocks)
        return find_clusters(blocks, self.store.vectors_of(blocks), query.threshold(self.settings), self.settings.idiom, self.settings.exclude)

    def _empty(self, notice: str, **more: Any) -> dict[str, Any]:
        return {"notice": notice, "analysis_mode": "heuristic", "confidence_guide": CONFIDENCE_GUIDE, "duplications": [], "summary": {"clusters_found": 0, "total_removable_lines": 0, "files_involved": 0, "by_confidence": {}}} | more

    def detect(self, query: C.Query | None = None) -> dict[str, Any]:
        """The report: ranked clusters, totals over all that are trusted enough, and how complete the index is. What is not indexed yet is, in the background, afterwards."""
        query = query or C.Query()
        try:
            return self._detect(query)
        finally:
            self.start()

    def _detect(self, query: C.Query) -> dict[str, Any]:
        with self._turn():
            self.refresh()
            if self.embedder.status() != "ready":
                return self._empty(f"The model is {self.embedder.status()}; nothing is compared without it.")
            progress = self.progress()
            if progress["pending_files"] and progress["files_in_scope"] >= C.SMALL_PROJECT_FILES and progress["percent_complete"] < C.USEFUL_PERCENT:
                return self._empty(f"{progress['percent_complete']} % of the files are indexed; a ranking of so few would mislead.", progress=progress, scope=self.scope())
            rows, places = self.clusters(query)
            judged = cut(rows)
            found = rank.at_least(judged.where("suppressed is null"), query.min_confidence)
            first = self._shown(found, places, query, "suppressed")
            totals = rank.summary(found, places).first().asDict()
            report = {"status": {k: v for k, v in self.store.counts().items()}, "analysis_mode": "heuristic", "confidence_guide": CONFIDENCE_GUIDE, "duplications": first}
            report["summary"] = totals | {"by_confidence": {r["confidence"]: r["clusters"] for r in rank.by_confidence(found).collect()}}
            if progress["pending_files"]:
                report |= {"notice": f"{progress['pending_files']} files are still to be indexed; near copies in them may be missing.", "progress": progress}
            scope = self.scope()
            if notice := self.scope_notice(scope):
                report |= {"scope": scope, "scope_notice": notice}
            if query.include_suppressed:
                report["suppressed_idioms"] = self._shown(judged.where("suppressed is not null"), places, query)
            self._remember(first)
            return report

    def _shown(self, rows: DataFrame, places: DataFrame, query: C.Query, *hidden: str) -> list[dict]:
        """The first clusters of a report, with their places."""
        first = with_occurrences(cut(rank.top(rows, query.order_by, query.top)), places)
        return [r.asDict(True) for r in rank.top(first, query.order_by, query.top).select(*(c for c in SHOWN if c not in hidden)).collect()]

    def _remember(self, clusters: list[dict]) -> None:
        names = sorted({o["file"] for c in clusters for o in c["occurrences"]})
        hashes = self._hashes(names)
        for cluster in clusters:
            self.findings.remember(cluster, {o["file"]: hashes.get(o["file"], "") for o in cluster["occurrences"]})

    def _hashes(self, names: list[str]) -> dict[str, str]:
        if not names:
            return {}
        files = self.spark.createDataFrame([(n,) for n in names], "file string")
        return dict(with_content(files, self.root).select("file", short_hash(F.col("content"))).collect())

    def explain(self, cluster_id: str) -> dict[str, Any]:
        """The places of a cluster with their texts: as told, if its files are unchanged, else as found again with the project's settings."""
        with self._turn():
            self.refresh()
            told = self.findings.find(cluster_id)
            if told and self._hashes(sorted(told[1])) == told[1]:
                cluster = told[0]
            else:
                found, places = self.clusters(C.Query())
                rows = with_occurrences(cut(found.where(F.col("id") == cluster_id).limit(1)), places).select(*SHOWN).collect()
                if not rows:
                    return {"notice": f"There is no cluster {cluster_id} now; the files may have changed."}
                cluster = rows[0].asDict(True)
            return {"cluster": cluster, "occurrences": self.sources(cluster)}

    def sources(self, cluster: dict) -> list[dict[str, Any]]:
        places = self.spark.createDataFrame([(i, o["file"], o["start_line"], o["end_line"]) for i, o in enumerate(cluster["occurrences"])], "nth int, file string, start_line int, end_line int")
        texts = with_content(places.select("file").distinct(), self.root, None).select("file", "content")
        lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
        rows = places.join(texts, "file").select("nth", "file", "start_line", F.array_join(lines, "\n").alias("text")).orderBy("nth").collect()
        return [{"file": r["file"], "start_line": r["start_line"], "text": r["text"]} for r in rows]

    def reindex(self, wait: bool = False, full: bool = False) -> dict[str, Any]:
        """Reads all files again; blocks with a vector keep it unless ``full``."""
        with self._turn():
            self.store.mark_all_dirty()
            if full:
                self.store.drop_vectors()
            self.refresh(force=True)
        embedded = self.index() if wait else 0
        with self._turn():
            return {"embedded": embedded, "pending_files": self.store.counts()["pending"]}

    def prune(self) -> int:
        with self._turn():
            return self.store.prune()


def text_report(report: dict[str, Any]) -> str:
    return to_yaml(report)

