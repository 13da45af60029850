"""Filter audit, spelling variants and sharding: brute force, odd and empty tables, skew."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from copysift.llm import filter_audit, sharding, spelling

KIND = "doc_id long, text string, source string, part string, mask int, word string, n int, shard string, slot string, size int, digest string, quality int"
ODD = [(None, None), (None, "x"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "word " * 60_000), (6, "y" * 400_000), (7, "Éa é 😀 $ A. " * 3), (8, "word " * 60_000), (0, "a")]


def frame(spark, docs):
    """doc_id, text, a source for some rows, and columns with clashing names."""
    return spark.createDataFrame([(i, t, [None, "", "s", "t"][k % 4], "p", 1, "w", 2, "sh", "sl", 3, "d", 1) for k, (i, t) in enumerate(docs)], KIND)


# -- filter audit


def _audited(docs, labels):
    """docs: (doc_id, text, source)."""
    known = collections.defaultdict(set)
    for i, quality, toxic in labels:
        known[i] |= ({"good"} if quality == 1 else set()) | ({"bad"} if toxic == 1 else set())
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, t, source in docs:
        t, words = t or "", re.findall("[^\x20\x09-\x0d]+", t or "")
        told = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        fails.append((source or "", {k for k, v in told.items() if v}, known[i] if i is not None else set()))
    out = {}
    for part in {f[0] for f in fails}:
        total = collections.Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                mine = [(f, l) for p, f, l in fails if p == part]
                removed = [(f, l) for f, l in mine if letter in f and not f & set(order[:k])]
                total[letter] += len(removed)
                out[part, order, k + 1] = [sum(not f & set(order[: k + 1]) for f, _ in mine), len(removed), sum(letter in f and bool(f & set(order[:k])) for f, _ in mine), sum(f == {letter} for f, _ in mine), sum("good" in l for _, l in removed), sum("bad" in l for _, l in removed)]
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                out[part, order, k + 1].append(total[letter])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(1)
    docs = ODD + [(10 + i, " ".join(rng.choice(["a", "B", "c$", "dd", "Ee"]) for _ in range(rng.choice([3, 150, 250])))) for i in range(40)] + [(60 + i, "one text") for i in range(20)]
    rows = frame(spark, docs)
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, 1, 4, 4, 5, *range(8, 90, 2)]]
    got = filter_audit.audited(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = _audited([(r["doc_id"], r["text"], r["source"]) for r in rows.collect()], labels)
    assert len(got) == len(want) == 3 * 120 * 5
    for r in got:
        assert [r[c] for c in (*filter_audit.METRICS, "shapley")] == want[r["part"], r["filter_order"], r["step"]], r
        assert r["filter"] == r["filter_order"][r["step"] - 1]


def test_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(frame(spark, []), labels).count() == 0
    counts = filter_audit.cells(frame(spark, [(1, "a"), (2, "b"), (3, "ab")]), labels.limit(0), {"X": F.contains("text", F.lit("a")), "Y": F.contains("text", F.lit("b"))}, None)
    rows = filter_audit.audit(counts.groupBy(F.lit("all").alias("part"), "mask").agg(F.sum("documents").alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "XY").collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in rows} == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (0, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (0, 1, 1, 1, 3)}


# -- spelling variants


def _edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def _near(counts):
    letters = sorted(set("".join(counts)))
    return {w: {v for v in _edits(w, letters) if v in counts and v != w} for w in counts}


def _told(counts):
    out = {}
    for w, near in _near(counts).items():
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            out[w] = (len(near), counts[best], best)
    return out


def _words(rng, letters, shortest, longest, n):
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(n)}
    return {w: rng.choice([1, 2, 2, 3, 30, 400]) for w in found}


def test_near_words_against_brute_force(spark):
    rng = random.Random(2)
    counts = _words(rng, "ab", 2, 9, 400) | _words(rng, "abé", 7, 8, 300) | _words(rng, "abcdefgh", 7, 12, 200)
    base = list(counts)
    for w in base[:200]:
        counts.update((v, rng.choice([1, 5, 60])) for v in rng.sample(list(_edits(w, "abÿ")), 2) if len(v) > 1)
    counts |= {"a" * n: n for n in (300, 301, 303)} | {"a" * 150 + "b" + "a" * 150: 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = _told(counts)
    for task in (50_000, 30):  # all at once; groups that are split into a grid
        rows = spelling.near_words(words, task).collect()
        assert len(rows) == len(want)
        assert {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in rows} == want


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(30)]
    say = lambda: " ".join((lambda w: w.upper() if rng.random() < 0.2 and w.isascii() else w)(rng.choice(names) if rng.random() < 0.9 else rng.choice(list(_edits(rng.choice(names), "abc")))) for _ in range(200))
    docs = [*ODD, *((100 + i, say()) for i in range(60)), (100, "Straße×a naïveté÷b " * 9)]
    occurrences = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            occurrences[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in occurrences.items() if len(w) >= 7 and n >= 2}
    told = _told(counts)
    forms = {w: f for w, (_, n, f) in told.items() if n >= 10 * counts[w]}

    def root(w):
        return root(forms[w]) if w in forms else w

    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(spark, docs)).collect()}
    assert got == {w: (forms.get(w), root(w), n, told.get(w, (0,))[0], counts[forms[w]] if w in forms else None) for w, n in counts.items()}
    assert len(forms) > 20
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, ODD[:5])).count() == 0


def test_long_ways_to_a_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.with_roots(forms).collect()} == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37"}


def test_a_task_of_queries_only():
    rows = pd.DataFrame({"side": 0, "word": ["abcdefg", "abcdefh"], "n": 1, "half": 4, "spot": 5, "queried": True, "indexed": False})
    assert len(spelling._search(rows)) == 0


# -- sharding


def _exact(n, m, t, u):
    low, high = max(0, n + m - t), min(n, m)
    weights = [math.comb(m, x) * math.comb(t - m, n - x) for x in range(low, high + 1)]
    below, goal = 0, Fraction(u) * math.comb(t, n)
    for x, w in enumerate(weights, low):
        below += w
        if below > goal:
            return x
    return high


def test_quantiles_of_the_hypergeometric_distribution(spark):
    rng = random.Random(4)
    cases = [(0, 0, 0, 0.5), (0, 5, 9, 0.1), (9, 9, 9, 0.9), (3, 0, 7, 0.4), (1, 1, 2, 0.499), (1, 1, 2, 0.501), (500, 1000, 2000, 1e-12), (500, 1000, 2000, 1 - 1e-12)]
    for _ in range(150):
        t = rng.choice([5, 40, 900, 2500])
        cases.append((rng.randint(0, t), rng.randint(0, t), t, rng.random()))
    rows = spark.createDataFrame(cases, "n long, m long, t long, u double")
    got = rows.select("n", "m", "t", "u", sharding.hypergeometric(F.col("n"), F.col("m"), F.col("t"), F.col("u")).alias("x")).collect()
    for r in got:
        assert r["x"] == _exact(r["n"], r["m"], r["t"], r["u"]), r


def _placed(rows):
    """Checks shards and slots of (shard, slot) pairs, and returns how many rows each shard has."""
    slots = collections.defaultdict(list)
    for shard, slot in rows:
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots and [len(slots[k]) for k in sorted(slots)]


def test_shards_are_exact_and_do_not_depend_on_the_input_order(spark):
    rows = spark.range(5003).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("mine").alias("shard"), F.lit(1).alias("rank"), F.lit(2).alias("part"), F.lit(3).alias("bounds"))
    for shards in (8, 3, 1):
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(rows.repartition(5), shards).collect()}
        sizes = _placed(got.values())
        assert len(got) == 5003 and len(sizes) == shards and max(sizes) - min(sizes) <= 1
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(rows.coalesce(1).orderBy(F.desc("doc_id")), shards).collect()}
        assert got == again
    assert set(sharding.shuffled(rows).columns) == {*rows.columns, "slot"}


def test_the_matrix_has_the_moments_of_a_uniform_shuffle(spark):
    counts = spark.createDataFrame([(0, 700), (1, 40), (2, 0), (3, 260)], "part long, n long")
    drawn = np.zeros((16, 4, 12))
    for seed in range(16):
        for r in sharding.matrix(counts, 1000, 4, 3, seed).collect():
            drawn[seed, r["part"], r["block"]] = r["n"]
    sizes = [84, 83, 83] * 4
    assert (drawn.sum(1) == sizes).all() and (drawn.sum(2) == [700, 40, 0, 260]).all()
    for part, n in ((0, 700), (1, 40), (3, 260)):
        p = np.array(sizes) / 1000
        variance = n * p * (1 - p) * (1000 - n) / 999
        assert (abs(drawn[:, part].mean(0) - n * p) < 5 * np.sqrt(variance / 16)).all()
        assert 0.6 < (drawn[:, part].var(0) / variance).mean() < 1.5


def test_many_blocks_are_found_by_two_looks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_PARTS", 256)
    monkeypatch.setattr(sharding, "LEVELS", 3)
    got = sharding.shuffled(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
    assert _placed([(r["shard"], r["slot"]) for r in got]) == [375] * 8


def test_a_row_that_is_repeated_very_often(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    dealt, counts, _, parts = sharding._parts(rows, ("doc_id", "text"), 13, ("d", "p"))
    assert counts.agg(F.max("n")).first()[0] < 3 * 6000 / parts
    got = sharding.shuffled(rows).collect()
    assert _placed([(r["shard"], r["slot"]) for r in got]) == [750] * 8
    assert collections.Counter(r["doc_id"] for r in got)[7] == 3000


def test_assigned_odd_and_empty_tables(spark):
    rows = sharding.assigned(frame(spark, ODD)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert _placed([(r["shard"], r["slot"]) for r in rows]) == [2, 2, 2, 2, 1, 1, 1, 1]
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert sharding.assigned(frame(spark, [])).count() == 0


def test_written_shards_are_in_order(spark, tmp_path):
    sharding.write_shards(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    assert _placed([(r["shard"], r["slot"]) for r in back.collect()]) == [125] * 4
    for path in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = pd.read_parquet(path)["slot"].tolist()
        assert slots == sorted(slots)
