"""Providers of vectors."""

import random

import numpy as np
from pyspark.sql import functions as F

from copysift.functions.embed import ProseEmbedder, StructureEmbedder, prose_vector, structure_vector


def test_renamed_code_is_nearer_than_other_code():
    cos = lambda a, b: float(np.dot(structure_vector(a, 64), structure_vector(b, 64)))
    code = "for (const x of xs) { if (x > 0) { t += x; } }"
    assert cos(code, code.replace("x", "row").replace(" t +=", " total +=")) > 0.99
    assert cos(code, "import a from b; export default class C extends D {}") < 0.8


def test_prose_vectors_tell_edited_copies_from_other_texts(spark):
    rng = random.Random(2)
    text = [f"w{rng.randrange(300)}" for _ in range(200)]
    edited = [w if rng.random() > 0.05 else "changed" for w in text]
    other = [f"w{rng.randrange(300)}" for _ in range(200)]
    cos = lambda a, b: float(np.dot(prose_vector(" ".join(a), 256), prose_vector(" ".join(b), 256)))
    assert cos(text, edited) > 0.8 and abs(cos(text, other)) < 0.3 and cos(text, [w.upper() for w in text]) > 0.999
    assert prose_vector("", 4) == [0.0] * 4 and max(map(abs, prose_vector("one", 4))) == 1.0
    rows = spark.createDataFrame([("a b",), (None,)], "t string").select(ProseEmbedder(8).column(F.col("t")).alias("v")).collect()
    assert [len(r["v"]) for r in rows] == [8, 8] and not any(rows[1]["v"])


def test_providers_keep_the_order_of_rows(spark):
    texts = ["if a", "b = b + b", None, "c(c)"] * 20 + ["d " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    model = StructureEmbedder(16)
    got = {r["i"]: r["v"] for r in rows.select("i", model.column(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], structure_vector(t or "", 16), atol=1e-6)
    assert model.status() == "ready"


def test_prose_vectors_are_signed_counts_of_hashed_pairs(monkeypatch):
    import hashlib

    from copysift.functions import embed

    monkeypatch.setattr(embed, "HASHED", 7)
    for text in ["", " \n", "One", "a b", "Ä b c Ä b c\td\x1ce", "x y " * 40]:
        words = text.lower().replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        want = np.zeros(24)
        for pair in map(" ".join, zip(words, words[1:], strict=False)) if len(words) > 1 else words:
            digest = hashlib.md5(pair.encode()).digest()
            want[int.from_bytes(digest[:4]) % 24] += 1 if digest[4] < 128 else -1
        assert embed.prose_vector(text, 24) == (want / (np.sqrt((want * want).sum()) or 1)).astype(np.float32).tolist()
    assert embed.prose_vectors([], 24).shape == (0, 24)
