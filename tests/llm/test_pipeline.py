"""The pipeline against a plain version of its stages, with the quality model that it learns."""

import random

import pytest

import corpus_pipeline
from copysift.llm import quality
from tests.llm import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("la", "ne", "so", "vi", "du", "xa")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(300):
        text = say(rng.randrange(60, 120))
        if i % 7 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 11 == 0:
            text = f"{text} {items[i % 4][1]} {say(9)}"
        elif i % 13 == 0:
            text += f" write to user{i}@mail.example now"
        docs.append((i, text))
        labels.append((i, int(i % 7 > 0), 0))
    docs += [(300 + i, docs[i][1] + " again") for i in range(1, 30)] + [(400, docs[5][1]), (401, ""), (402, None)]
    folder = str(tmp_path)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    table = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in quality.classified(table, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["predicted"]}
    kept = [(i, t) for i, t in docs if i in good]
    assert {i for i, _ in docs[:300] if i % 7} <= good and not {i for i, _ in docs[:300] if i % 7 == 0} & good
    groups = brute.near_duplicates(kept, 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    leaks = {d for d, _ in brute.contained_items(kept, items, 5, 80)}
    kept = [(i, t) for i, t in kept if i not in leaks]

    out = corpus_pipeline.run(spark, folder).collect()
    sizes = {i: len((t or "").split()) for i, t in kept}
    assert {r["doc_id"] for r in out} <= set(sizes) and len(out) > 100
    # no document is lost on the way: where a source is taken once or more, all its documents with words are there
    source_of, total = {i: s for i, _, _, s, _ in rows}, {}
    for i, n in sizes.items():
        total[source_of[i]] = total.get(source_of[i], 0) + n
    goals = {r["source"]: r["target"] for r in out}
    whole = {s for s, n in total.items() if goals[s] >= n}
    assert whole and {r["doc_id"] for r in out if r["source"] in whole} == {i for i, n in sizes.items() if n and source_of[i] in whole}
    by_copies = {}
    for r in out:
        by_copies.setdefault(r["doc_id"], []).append(r)
    assert all(sorted(r["copy"] for r in c) == list(range(len(c))) for c in by_copies.values())
    by_source, target = {}, {}
    for r in out:
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["words"]
        target[r["source"]] = r["target"]
        assert "@" not in r["text"] and r["size"] == sizes[r["doc_id"]] and r["words"] <= r["size"]
    assert all(abs(by_source[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == sum(sizes.values()) or abs(sum(target.values()) - sum(sizes.values())) < 1e-6


NAMES = ["row", "score", "part", "doc_of_items", "row_key", "text_key", "added", "spans", "base_spans", "key", "block", "edge", "passes", "doc", "node", "band", "component_id", "kept", "words_before", "draws"]
KIND = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} int" for n in NAMES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def odd_documents(spark):
    texts = [(1, "plain words of a plain text that goes on for a while"), (2, None), (3, ""), (4, " \n"), (5, "x" * 300_000), (6, "word " * 40_000), (7, "before one two three four five six seven behind"), (7, "the same number and another text"), (None, "no number here at all, mail me@x.example"), (None, None)]
    texts += texts[:1] * 3 + [(9, texts[0][1].upper())]
    return texts, spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t or ""), *range(len(NAMES))) for i, t in texts], KIND)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, tables, name):
    texts, docs = odd_documents(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), tables).count() == 0
    out = stage(spark, docs, tables)
    rows = out.collect()
    assert all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in rows)
    found = sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    if name != "source_mixing":
        assert out.columns == docs.columns and out.schema == docs.schema
    if name == "minhash_near_dedup":  # of 1 (four rows) and 9, equal but for case, the rows of 1 stay; what has no number stays
        assert found == sorted((x for x in texts if x[0] != 9), key=str)
    if name == "benchmark_decontamination":
        assert found == sorted((x for x in texts if x[1] != texts[6][1]), key=str)
    if name == "personal_data":
        assert found == sorted(((i, t and t.replace("me@x.example", "<EMAIL>")) for i, t in texts), key=str)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    if name == "source_mixing":
        assert {r["doc_id"] for r in rows} >= {1, 5, 6, 7, None, 9} and not any(r["doc_id"] in (2, 3, 4) for r in rows)
        assert all(len(r["text"].split()) == r["words"] for r in rows)
