"""Listing, settings, the index, streaming and the engine on small projects."""

import json
import os
import threading
import time

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copysift.config import Query, Settings, load_config, merged
from copysift.functions.embed import StructureEmbedder
from copysift.functions.report import to_yaml
from copysift.plans.engine import Engine, Findings
from copysift.sources.globs import matches
from copysift.sources.project import git_fingerprint, listing, settled_fingerprint
from copysift.sources.store import Store
from copysift.streaming.index import batches, drain, index_changes, index_stream, scan_for_changes

BODY = "function total(items) {\n  let sum = 0;\n  for (const item of items) {\n    if (item.price > 0) {\n      sum += item.price * item.count;\n    }\n  }\n  if (sum > 100) {\n    sum = sum * 0.9;\n  }\n  console.log(sum);\n  return sum;\n}\n"


def project(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(folder)


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("**", "a/b.ts", True), ("**/dist/**", "dist/x.js", True), ("**/dist/**", "a/dist/b/x.js", True), ("**/dist/**", "a/distant/x.js", False), ("**/*.min.*", "a/x.min.js", True), ("*.ts", "a/x.ts", False), ("src/**/*.{ts,js}", "src/a/b.js", True), ("src/**/*.{ts,js}", "src/b.ts", True), ("a?.ts", "ab.ts", True), ("**/.x/*", ".x/y", True), ("[!a]b", "cb", True)],
)
def test_globs(glob, path, want):
    assert matches(path, (glob,)) == want


def test_settings(tmp_path):
    assert load_config(str(tmp_path)) == Settings()
    (tmp_path / "duplication.config.json").write_text(json.dumps({"minLines": 9, "idiom": {"maxLines": 3}}))
    got = load_config(str(tmp_path))
    assert got.min_lines == 9 and got.idiom.max_lines == 3 and got.idiom.min_occurrences == 10 and merged({}) == Settings()
    (tmp_path / "duplication.config.json").write_text("{")
    with pytest.raises(ValueError, match="is not valid JSON"):
        load_config(str(tmp_path))
    for bad in ({"top": -1}, {"top": 1.5}, {"order_by": "x"}, {"min_confidence": "x"}):
        with pytest.raises(ValueError, match="must be"):
            Query(**bad)
    assert Query(similarity_threshold=7).threshold(Settings()) == 1


def test_yaml():
    value = {"a": 1, "b": [{"c": "true", "d": None}, {"e": []}], "f": "1:30", "g": "x: y", "h": "plain text", "i": {"j": 2.5}, "k": "", "l": [[1, 2], [3]]}
    assert to_yaml(value) == 'a: 1\nb:\n - c: "true"\n   d: null\n - e: []\nf: "1:30"\ng: "x: y"\nh: plain text\ni:\n j: 2.5\nk: ""\nl:\n - - 1\n   - 2\n - - 3'
    assert to_yaml([]) == "[]" and to_yaml(float("inf")) == '"Infinity"'


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12) | st.sampled_from(["2024-01-01", ".inf", ".nan", "y", "N", "<<", "=", "~", "1_000", "0x1f", "1e3", "12:30:45", "2001-12-14t21:59:43.10-05:00", "a: b", "a #b", "a:", "-", "? x", "\u0085", "\u2028", "é😀", "No", "off", "+.5", "0b1"]), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=6), v, max_size=4), max_leaves=12))
def test_yaml_is_read_back(value):
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(to_yaml(value)) == value


def test_listing(spark, tmp_path):
    root = project(tmp_path, {"a/__init__.py": "", "a/_x.ts": "", ".eslintrc.js": "", "dist/y.js": "", ".hidden/z.js": "", "lib/own/.git/HEAD": "", "lib/own/q.ts": "", "r.txt": "", "s.min.js": ""})
    rows = listing(spark, root, Settings()).collect()
    assert sorted((r["kind"], r["file"]) for r in rows) == [("file", ".eslintrc.js"), ("file", "a/__init__.py"), ("file", "a/_x.ts"), ("repository", "lib/own")]
    rows = listing(spark, root, Settings(include_nested_repositories=True)).collect()
    assert "lib/own/q.ts" in {r["file"] for r in rows}


def test_store(spark, tmp_path):
    store, other = Store(spark, str(tmp_path), "m1"), Store(spark, str(tmp_path), "m2")
    vectors = lambda *names: spark.createDataFrame([(n, [1.0, 2.0]) for n in names], "norm_hash string, vector array<double>")
    store.put_vectors(vectors("a", "b"))
    store.put_vectors(vectors("b", "c"))
    assert store.counts()["vectors"] == 3 and other.counts()["vectors"] == 0
    assert [r["norm_hash"] for r in store.missing(vectors("a", "d", "d").select("norm_hash")).collect()] == ["d"]
    state = "file string, mtime double, size long, content_hash string, dirty boolean, chunk_hashes array<string>"
    store.merge_state(spark.createDataFrame([("f", 1.0, 1, "x", False, ["a", "b"]), ("g", 1.0, 1, "y", False, ["b"])], state))
    store.merge_state(spark.createDataFrame([("f", 2.0, 1, "z", True, None)], state))
    assert store.state().where("file = 'f'").first()["chunk_hashes"] == ["a", "b"] and [r["file"] for r in store.dirty_files().collect()] == ["f"]
    assert store.prune() == 1 and store.prune() == 0
    store.remove_files(spark.createDataFrame([("f",)], "file string"))
    assert store.counts() == {"pending": 0, "files": 1, "vectors": 2}
    before = sorted(map(str, store.state().collect()))
    store.compact()
    assert sorted(map(str, store.state().collect())) == before and store.counts()["vectors"] == 2
    other.put_vectors(vectors("z"))
    store.drop_vectors()
    assert store.counts()["vectors"] == 0 and other.counts()["vectors"] == 1


def test_findings():
    held = Findings(2)
    for name in ("a", "b"):
        held.remember({"id": name}, {})
    held.find("a")
    held.remember({"id": "b"}, {})
    held.remember({"id": "c"}, {})
    assert held.find("a") is None and held.find("b") and held.find("c")


def test_engine(spark, tmp_path):
    renamed = BODY.replace("total", "amount").replace("items", "rows").replace("item", "row").replace("sum", "acc").replace("price", "cost").replace("count", "n")
    root = project(tmp_path / "p", {"a/x.ts": BODY, "b/_y.ts": "\n" + BODY, "c/z.ts": BODY, "d/w.ts": renamed})
    engine = Engine(spark, root, index=str(tmp_path / "index"))
    engine.refresh(force=True)
    assert engine.status()["pending_files"] == 4
    assert engine.index() == 2  # one body in three files is embedded once
    report = engine.detect()
    exact = [c for c in report["duplications"] if c["match_type"] == "identical"]
    near = [c for c in report["duplications"] if c["match_type"] == "near-identical"]
    assert exact[0]["frequency"] == 3 and near[0]["frequency"] == 4 and report["summary"]["files_involved"] == 4
    told = engine.explain(exact[0]["id"])
    assert [o["file"] for o in told["occurrences"]] == ["a/x.ts", "b/_y.ts", "c/z.ts"] and told["occurrences"][1]["text"] == BODY.rstrip("\n")
    os.utime(os.path.join(root, "a/x.ts"), (1, 1))
    engine.refresh(force=True)
    assert engine.status()["pending_files"] == 0  # touched, same content
    os.remove(os.path.join(root, "d/w.ts"))
    engine.refresh(force=True)
    assert engine.status()["files_indexed"] == 3
    assert engine.prune() == 1
    assert engine.reindex(wait=True) == {"embedded": 0, "pending_files": 0}
    assert "notice" in engine.explain("nothing")


def test_an_answer_goes_on_indexing(spark, tmp_path):
    root = project(tmp_path / "p", {f"a/f{i}.ts": BODY.replace("total", f"t{i}") for i in range(3)} | {"sub/own/.git/HEAD": "ref: refs/heads/main"})
    engine = Engine(spark, root, index=str(tmp_path / "index"))
    report = engine.detect()
    assert report["progress"]["pending_files"] == 3 and "notice" in report
    assert engine.wait(300)
    report = engine.detect()
    assert "progress" not in report and report["status"]["pending"] == 0 and not engine.start()
    assert report["scope"]["skipped_nested_repositories_count"] == 1 and "sub/own" in report["scope_notice"]
    assert engine.wait(0) and engine.scope_notice({"configured": False, "files_in_scope": 900, "largest_folders": [{"folder": "a", "files": 899}]}).count("a (899)") == 1


def test_a_checkout_is_seen_when_it_has_settled(spark, tmp_path):
    root = project(tmp_path / "p", {"a.ts": BODY, ".git/HEAD": "ref: refs/heads/main", ".git/refs/heads/main": "1"})
    engine = Engine(spark, root, index=str(tmp_path / "index"))
    engine.refresh(force=True)
    stop = engine.watch(0.05)
    try:
        (tmp_path / "p" / "b.ts").write_text(BODY)
        (tmp_path / "p" / ".git" / "HEAD").write_text("ref: refs/heads/other")
        until = time.monotonic() + 120
        while engine.store.counts()["files"] < 2 and time.monotonic() < until:
            time.sleep(1)
        assert engine.store.counts()["files"] == 2
    finally:
        stop.set()
    assert settled_fingerprint(root, 0.01) == git_fingerprint(root) and settled_fingerprint(str(tmp_path)) is None


def test_a_stream_of_changes(spark, tmp_path):
    kind = "file string, mtime double, size long, content string"
    store = Store(spark, str(tmp_path / "index"), "structure-64")
    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        index_changes(stream, store, Settings(), StructureEmbedder(), str(tmp_path / "progress")).awaitTermination()

    spark.createDataFrame([("a.ts", 1.0, 9, BODY), ("b.ts", 1.0, 9, BODY), ("a.ts", 0.5, 9, "old")], kind).coalesce(1).write.parquet(str(tmp_path / "log"))
    run()
    assert store.counts() == {"pending": 0, "files": 2, "vectors": 1}
    spark.createDataFrame([("b.ts", 2.0, 0, None)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run()
    assert [r["file"] for r in store.state().collect()] == ["a.ts"]


class Counted(StructureEmbedder):
    """Waits for each batch of texts, and fails once a file is there."""

    def __init__(self, seconds=0.0, fails=None):
        super().__init__()
        object.__setattr__(self, "seconds", seconds)
        object.__setattr__(self, "fails", fails)

    def column(self, text):
        seconds, fails, plain = self.seconds, self.fails, super().column(text)

        @F.pandas_udf("string")
        def waits(texts: pd.Series) -> pd.Series:
            time.sleep(seconds)
            if fails and os.path.exists(fails):
                raise RuntimeError("no model any more")
            return texts

        return F.when(waits(text).isNotNull(), plain)


def bodies(n):
    """Files of equal size with a block each, all different."""
    return {f"f{i:02}.ts": BODY.replace("total", f"total{i:02}").replace("100", f"{100 + i}") for i in range(n)}


def test_the_project_as_a_stream(spark, tmp_path):
    root = project(tmp_path / "p", {**bodies(3), ".git/HEAD": "ref: refs/heads/main", ".git/refs/heads/main": "1"})
    store, model = Store(spark, str(tmp_path / "index"), "structure-64"), StructureEmbedder()
    run = lambda **more: index_stream(spark, root, store, Settings(), model, str(tmp_path / "progress"), **more)
    run().awaitTermination()
    assert store.counts() == {"pending": 0, "files": 3, "vectors": 3}
    written = len(store._files("vectors"))
    time.sleep(2.1)  # the next version of the listing
    run().awaitTermination()
    assert len(store._files("vectors")) == written and store.counts()["files"] == 3  # from its checkpoint, nothing is done twice
    (tmp_path / "p" / "f00.ts").write_text(BODY.replace("total", "edited"))
    (tmp_path / "p" / "f01.ts").unlink()
    before = {r["file"]: r["content_hash"] for r in store.state().collect()}
    time.sleep(2.1)
    run().awaitTermination()
    after = {r["file"]: r["content_hash"] for r in store.state().collect()}
    assert set(after) == {"f00.ts", "f02.ts"} and after["f00.ts"] != before["f00.ts"] and after["f02.ts"] == before["f02.ts"]
    query = run(every=3600.0)  # only another commit brings a new version now
    try:
        until = time.monotonic() + 60
        while not query.recentProgress and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    query = run(every=1.0)
    try:
        (tmp_path / "p" / "g.ts").write_text(BODY.replace("total", "committed"))
        (tmp_path / "p" / ".git" / "HEAD").write_text("ref: refs/heads/other")
        until = time.monotonic() + 90
        while time.monotonic() < until and not (query.lastProgress and "other" in str(query.lastProgress["sources"][0]["endOffset"]) and store.state().where("file = 'g.ts' and not dirty").count()):
            time.sleep(0.5)
        assert "refs/heads/other" in str(query.lastProgress["sources"][0]["endOffset"])
        assert store.state().where("file = 'g.ts' and not dirty").count() == 1
    finally:
        query.stop()


def test_a_drain_that_is_stopped_or_fails_keeps_what_it_has_done(spark, tmp_path):
    root = project(tmp_path / "p", bodies(24))
    store, fails = Store(spark, str(tmp_path / "index"), "structure-64"), tmp_path / "fails"
    model = Counted(0.0, str(fails))
    scan_for_changes(store, listing(spark, root, Settings()), root)
    assert store.counts() == {"pending": 24, "files": 24, "vectors": 0}
    size = os.path.getsize(tmp_path / "p" / "f00.ts")
    steps = batches(store, root, Settings, model, 6 * size)
    first = next(steps) + next(steps)
    assert 0 < first < 24 and store.counts() == {"pending": 24 - first, "files": 24, "vectors": first}
    fails.write_text("")
    with pytest.raises(Exception, match="no model any more"):
        for _ in range(4):
            next(steps)
    assert store.counts() == {"pending": 24 - first, "files": 24, "vectors": first}
    fails.unlink()
    done = drain(store, root, Settings(), model, 6 * size, stop=lambda: True)
    assert store.counts()["vectors"] == first + done
    (tmp_path / "p" / "f07.ts").unlink()
    assert first + done + drain(store, root, Settings(), model, 6 * size) in (23, 24)
    assert store.counts()["pending"] == 0 and store.counts()["files"] in (23, 24)


def test_requests_are_answered_between_batches(spark, tmp_path):
    root = project(tmp_path / "p", bodies(20))
    size = os.path.getsize(tmp_path / "p" / "f00.ts")
    engine = Engine(spark, root, index=str(tmp_path / "index"), embedder=Counted(1.0), batch_bytes=3 * size)
    engine.refresh(force=True)
    assert engine.start() and engine.start()
    told, waited = [], []
    while not engine.wait(0) and len(told) < 3:
        began = time.monotonic()
        told.append(engine.status()["progress"]["files_embedded"])
        waited.append(time.monotonic() - began)
    assert len(told) == 3 and told[-1] < 20 and told == sorted(told) and len(set(told)) > 1, (told, waited)
    assert engine.stop(120)
    left = engine.status()["pending_files"]
    assert 0 < left < 20  # it stopped after a batch
    assert engine.start() and engine.wait(300) and engine.status()["ready"]


def test_turns_are_taken_in_order(spark, tmp_path):
    engine = Engine(spark, project(tmp_path, {}), index=str(tmp_path / "index"))
    order = []

    def busy():
        for _ in range(30):
            with engine._turn(), engine._turn():
                order.append("batch")
                time.sleep(0.02)

    worker = threading.Thread(target=busy)
    worker.start()
    time.sleep(0.05)
    with engine._turn():
        order.append("request")
    worker.join()
    assert order.index("request") < 10


def test_compaction_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), "m")
    rows = lambda *names: spark.createDataFrame([(n, [1.0]) for n in names], "norm_hash string, vector array<double>")
    store.put_vectors(rows("a", "b"))
    store.drop_vectors()
    store.put_vectors(rows("b", "c"))
    want = sorted(r["norm_hash"] for r in store.vectors().collect())
    assert want == ["b", "c"]
    append = store._append

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(store, "_append", broken)
    with pytest.raises(OSError, match="disk full"):
        store.compact()
    assert sorted(r["norm_hash"] for r in store.vectors().collect()) == want
    monkeypatch.setattr(store, "_append", append)
    older = store._files("vectors")
    for kept in range(len(older) + 1):  # broken off after any number of deletions
        monkeypatch.setattr(store, "_files", lambda name, n=kept: older[: n] if name == "vectors" else [])
        store.compact()
        assert sorted(r["norm_hash"] for r in store.vectors().collect()) == want
    monkeypatch.undo()
    assert not {f.getPath().getName() for f in older} & {f.getPath().getName() for f in store._files("vectors")}


def test_an_unchanged_project_is_not_counted_again(spark, tmp_path):
    root = project(tmp_path / "p", bodies(3))
    engine = Engine(spark, root, index=str(tmp_path / "index"))
    engine.refresh(force=True)
    engine.index()
    first, written = engine.status(), len(engine.store._files("state"))
    engine._refreshed = time.monotonic() + 3600  # as if within the two seconds
    spark.sparkContext.setJobGroup("again", "status of an unchanged project")
    try:
        assert engine.status() == first and first["ready"] and first["progress"]["percent_complete"] == 100
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("again")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    engine.refresh(force=True)
    assert len(engine.store._files("state")) == written  # nothing new, nothing written
    Store(spark, str(tmp_path / "index"), engine.embedder.model_id).mark_all_dirty()
    assert engine.status()["pending_files"] == 3  # another writer is seen
