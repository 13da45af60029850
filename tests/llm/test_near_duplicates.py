"""MinHash near-dedup and vectors against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from copysift.llm import minhash_dedup
from copysift.llm.components import components
from copysift.llm.minhash_dedup import fast_similarity_sketch
from copysift.llm.vector_dedup import near_duplicate_vectors, possible_pairs, quantise
from copysift.llm.words import shingle_sets
from tests.llm import brute

WORDS = [f"w{i}" for i in range(400)]


def _groups(spark, docs, k=3, percent=85, kind="doc_id long, text string"):
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, kind), k, percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_against_brute_force_with_a_chain_of_edits(spark):
    rng = random.Random(1)
    docs, base = [], [rng.choice(WORDS) for _ in range(120)]
    for i in range(60):  # a chain: each text is a small edit of the one before
        docs.append((i, " ".join(base)))
        base = [*base]
        base[rng.randrange(len(base))] = rng.choice(WORDS)
    docs += [(100 + i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    docs += [(200 + i, docs[i][1].upper()) for i in range(20)]
    assert _groups(spark, docs) == brute.near_duplicates(docs, 3, 85)


def test_large_bucket_goes_through_tiles(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(60)]
    docs = []
    for i in range(80):
        text = [*base]
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(60)] = rng.choice(WORDS)
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", 1500)
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    assert _groups(spark, docs) == brute.near_duplicates(docs, 3, 85)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "a " * 50_000), (8, "a a a b"), (9, "x" * 3_000_000), (9, "x" * 3_000_000)]
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(*d, "s", 7) for d in docs], "doc_id long, text string, node string, band int"), 3, 85).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True) and got[7] == (1, 7, True)
    assert got[9] == (1, 9, True)


def test_null_ids_and_empty_table(spark):
    kind = "doc_id long, text string"
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "q r s t"), (3, "a b c d")], kind), 3, 85).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("3", "3", True), ("None", "3", False), ("None", "None", True)]
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], kind), 3, 85).count() == 0


def test_sketch_fills_all_coordinates_and_estimates():
    import pyarrow as pa

    a, b = shingle_sets(pa.array([" ".join(map(str, range(900))), " ".join(map(str, range(100, 1000)))]), 1)
    x, y = fast_similarity_sketch(a, 512), fast_similarity_sketch(b, 512)
    assert abs((x == y).mean() - 0.8) < 0.08
    tiny = fast_similarity_sketch(a[:2], 512)
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    rows = components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), "a", "b").collect()
    want = brute.smallest_reachable({i for link in links for i in link}, links)
    assert {r["node"]: r["component_id"] for r in rows} == {i: c for i, c in want.items() if any(i in x and x[0] != x[1] for x in links)}


@pytest.mark.parametrize("tile", [4, 1024])
def test_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(0)
    rows, base = [], rng.standard_normal((6, 8))
    for i in range(60):
        v = base[i % 6] + rng.standard_normal(8) * 0.08
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(100, rows[0][1], 0), (101, [2 * x for x in rows[0][1]], 0), (102, rows[0][1], None)]
    bad = [(110, None, 0), (111, [0.0] * 8, 0), (112, [float("nan")] * 8, 0), (113, [float("inf")] * 8, 0), (114, [None] * 8, 0), (115, [], 0), (116, rows[0][1][:5], 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows + bad], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df, 0.98, tile).collect()}
    links = []
    for x, a in enumerate(rows):
        for b in rows[:x]:
            u, v = np.float64(np.float32(a[1])), np.float64(np.float32(b[1]))
            if a[2] is not None and a[2] == b[2] and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98:
                links.append((b[0], a[0]))
    root = brute.smallest_reachable([r[0] for r in rows], links)
    for r in rows:
        n = sum(r[0] in link for link in links)
        assert got[r[0]] == (n, root[r[0]], root[r[0]] == r[0])
    assert all(got[r[0]] == (0, r[0], True) for r in bad)


def test_quantisation_bound_loses_no_pair():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = possible_pairs(quantise(x), quantise(x), 0.6)
    true = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.6), strict=True)}
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert true <= found and len(found) < 1.3 * len(true) + 20


def test_empty_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
