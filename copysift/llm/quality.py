"""Quality scores learned by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its whole text. The weights maximise the likelihood
of preferences (a good document is preferred to a bad one), which for Bradley-Terry is the logistic loss on
the difference of their features. A threshold is a quantile of the training scores: the share of bad
documents among the labels. Scores are squashed so that this threshold lies at a given value.

The weights are fitted by numpy on the driver to a bounded sample of labelled documents (``most`` rows of
features, a parameter); scoring is one pass over all documents with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copysift.llm.frames import free_name
from copysift.llm.words import U64, buffers, portions, word_hashes, word_spans

#: Labelled documents that the weights are fitted to, at most (about).
SAMPLE = 12_000
HASHED = 256
PRINTABLE = np.arange(32, 127)


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text: byte shares, word shapes and hashed word frequencies. An empty text gives zeros."""
    data, offsets = buffers(texts)
    n, size = len(texts), np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    shares = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    each = np.maximum(count, 1)
    hashes = word_hashes(data, starts, ends)
    lengths = ends - starts
    sums = lambda x: np.bincount(doc, x, n) / each
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    head, tail = (data[starts], data[ends - 1]) if len(starts) else (data, data)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    buckets = np.bincount(doc * HASHED + (hashes >> U64(56)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    shape = np.stack([np.log1p(size), np.log1p(count), sums(lengths), np.sqrt(sums(lengths.astype(float) ** 2)), np.bincount(doc[order], fresh, n) / each, sums(upper[head]), sums(upper[tail]), sums(~letter[head]), sums(~letter[tail]), sums(lengths == 1)], 1)
    high = np.stack([shares[:, a:b].sum(1) for a, b in ((0, 32), (128, 160), (160, 192), (192, 224), (224, 256))], 1)
    return np.concatenate([np.sqrt(shares[:, PRINTABLE]), np.sqrt(high), shape, np.sqrt(buckets / each[:, None])], 1).astype(np.float32)


def fit(x: np.ndarray, good: np.ndarray, at: float, seed: int = 7, steps: int = 600, pairs: int = 2048, penalty: float = 1e-3) -> dict:
    """Weights, shift and scale of the score. With labels of one kind only (or none) every score is 0.5."""
    x = x.astype(np.float64)
    if good.all() or not good.any():
        return {"weights": np.zeros(x.shape[1] if x.ndim == 2 else 0), "threshold": 0.0, "slope": 0.0, "at": 0.5}
    spread = x.std(0)
    spread[spread < 1e-9] = np.inf
    z = (x - x.mean(0)) / spread
    rng, high, low = np.random.default_rng(seed), np.flatnonzero(good), np.flatnonzero(~good)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, steps + 1):
        d = z[rng.choice(high, pairs)] - z[rng.choice(low, pairs)]
        g = -d.T @ (1 / (1 + np.exp(np.clip(d @ w, -60, 60)))) / pairs + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    bad = (~good).mean()
    threshold = float(np.quantile(s, bad))
    # a quantile that falls into a gap between the two kinds is moved to its middle
    below, above = s[s < threshold], s[s >= threshold]
    if len(below):
        threshold = float((below.max() + above.min()) / 2)
    return {"weights": w / spread, "threshold": threshold + float(x.mean(0) @ (w / spread)), "slope": 4 / max(float(s.std()), 1e-9), "at": at}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if not len(model["weights"]):
        return np.full(len(x), model["at"])
    s = np.clip(model["slope"] * (x @ model["weights"] - model["threshold"]) + np.log(model["at"] / (1 - model["at"])), -35, 35)
    return 1 / (1 + np.exp(-s))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, at: float = 0.3, most: int = SAMPLE) -> dict:
    """A model from the labels of documents that are not held out.

    Of the labels a share is taken by a hash of the doc_id such that about ``most`` are left; that many ids are
    broadcast to find their texts. Null labels and null ids are ignored.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    share = most / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array([row.tobytes() for row in x], pa.binary())], names=["quality", "x"])

    got = texts.mapInArrow(run, "quality int, x binary").toArrow().to_pydict()
    order = sorted(range(len(got["x"])), key=lambda i: (got["x"][i], got["quality"][i]))  # independent of task order
    x = np.array([np.frombuffer(got["x"][i], np.float32) for i in order])
    return fit(x, np.array([got["quality"][i] == 1 for i in order], bool), at)


def quality_scores(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, a double from 0 to 1; a column called so is replaced.

    Null and empty texts have the score of no features; repeated rows have equal scores. An empty table gives no rows.
    """
    kept = docs.drop(name)
    kind = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                yield part.append_column(name, pa.array(scores(model, features(part.column("text"))), pa.float64()))

    return kept.mapInArrow(run, kind)


def accepted(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``at`` or more."""
    name = free_name(docs, "score")
    return quality_scores(docs, learn(docs, labels, at), name).where(F.col(name) >= at).drop(name)


def classified(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; predicted is 1 if score >= at.

    Columns other than doc_id and text are not used. A null doc_id is not held out.
    """
    scored = quality_scores(docs.select("doc_id", "text"), learn(docs, labels, at))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
