"""Masked pseudo-likelihood of documents under a bidirectional window network, trained here with numpy.

Every word is predicted from the two words on either side: hidden = tanh(sum over the four places of the place's scale times
the vector of the word there), class logits = hidden @ O + b. The ``VOCABULARY`` most frequent words have vectors and identifiers
of their own, all others share ``RARE`` buckets by their hash. The most frequent identifiers are classes of their own; the others
are clustered by the words that they occur beside, into more classes the more distinct words the corpus has:
log p(word | sides) = log p(class | sides) + log p(identifier | class) + log p(word | identifier), the last two by counts of the
whole corpus. A document's pseudo-likelihood is the sum over all its words.

Spark counts all words (a table with a row for each distinct word, by its 64-bit hash), encodes all texts once and deals them to
shards by a hash, so that every shard has the same mix of sources; how many shards there are follows from the bytes of text alone.
Every shard adds up what occurs beside each identifier and trains on its words, in ``ROUNDS`` rounds over disjoint parts of the
documents; after a round the models are averaged, weighted by words, in two levels of grouped sums in the order of the shards.
All words take part in counts, training and scoring. Tasks hold the counts of the most frequent ``KNOWN`` words, all other words
of documents are joined to the table. Only the model and those frequent words are ever on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.frames import cut
from copysift.llm.words import U64, buffers, mix, portions, word_hashes, word_spans

#: Identifiers are 16 bits: frequent words, buckets of the others, and the last one for no word.
VOCABULARY, RARE = (15 << 12) - 1, 1 << 12
NONE = VOCABULARY + RARE
IDS = NONE + 1
OWN, HIDDEN, BESIDE = 16, 16, 16
PLACES = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 8192, 0.12
#: Most frequent words whose counts tasks hold (a few MB), so that a join by word has no hot key.
KNOWN = 1 << 19
#: Bytes of text that one task trains on, so that what models take in a shuffle stays a small share of the input.
TASK_BYTES = 24_000_000
#: Parameters of a model that are averaged as one row.
PIECE = 65_536


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each distinct word, by its 64-bit hash, occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                data, offsets = buffers(part.column("text"))
                starts, ends, _ = word_spans(data, offsets)
                word, n = np.unique(word_hashes(data, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The known words by hash with their counts and identifiers, and how often each identifier occurs."""

    def __init__(self, words: DataFrame, known: int = KNOWN, vocabulary: int = VOCABULARY) -> None:
        """words: word_counts(), on a cut frame; vocabulary: so many words have identifiers of their own."""
        self.vocabulary = vocabulary
        sizes = words.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
        self.distinct = int(sizes["words"].sum())
        often = sizes["n"][sizes["words"].cumsum() <= known]
        self.least = int(often.min()) if len(often) else np.iinfo(np.int64).max
        top = words.where(F.col("n") >= self.least).toPandas()
        hashes, n = top["word"].to_numpy(np.int64).view(U64), top["n"].to_numpy(np.int64)
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((hashes, -n))] = np.arange(len(n))
        order = np.argsort(hashes)
        self.hashes, self.n, ids = hashes[order], n[order], np.where(rank < vocabulary, rank, self.rare(hashes))
        self.ids = ids[order].astype(np.uint16)
        self.counts = np.bincount(self.ids, self.n, IDS).astype(np.int64)
        bucket = F.shiftrightunsigned("word", 64 - RARE.bit_length() + 1).cast("int").alias("bucket")
        for row in words.where(F.col("n") < self.least).groupBy(bucket).agg(F.sum("n").alias("n")).collect():  # RARE rows at most
            self.counts[vocabulary + row["bucket"]] += row["n"]

    def rare(self, hashes: np.ndarray) -> np.ndarray:
        return self.vocabulary + (hashes >> U64(64 - RARE.bit_length() + 1)).astype(np.int64)

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(identifier, log p(word | identifier), whether the word is known) of each word; the log is that of 1 / count for words that are not known."""
        ids, logs, here = self.rare(word), np.zeros(len(word)), np.zeros(len(word), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
            here = self.hashes[at] == word
            ids[here], logs[here] = self.ids[at[here]], np.log(self.n[at[here]])
        return ids, logs - np.log(self.counts[ids] + 0.5), here


def encoded(docs: DataFrame, lexicon: Lexicon, shards: int) -> DataFrame:
    """(key, doc_id, ids, term, rare) for every row, dealt to shards and ordered by a hash.

    ids are the 16-bit identifiers of all words, term is what lexicon.look_up() adds for them, rare has the words that it does not
    know. Equal rows have equal keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                data, offsets = buffers(part.column("text"))
                starts, ends, first = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                ids, logs, here = lexicon.look_up(words)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                ids = ids.astype(np.uint16)
                unknown = np.flatnonzero(~here)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(unknown, first).astype(np.int32)), pa.array(words[unknown].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array(np.bincount(doc, logs, len(first) - 1).astype(float)), lists],
                    names=["key", "doc_id", "ids", "term", "rare"],
                )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, doc_id long, ids binary, term double, rare array<long>")
    deal = F.xxhash64("doc_id", "ids")
    return rows.repartition(shards, deal).sortWithinPartitions(deal)


def _sides(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For each place, the identifier of the word there; NONE where the document has none."""
    found = []
    for d in PLACES:
        out = np.full(len(ids), NONE, np.uint16)
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        if len(ids) > abs(d):
            out[a] = np.where(doc[a] == doc[b], ids[b], NONE)
        found.append(out)
    return found


def _signs() -> np.ndarray:
    """For each identifier BESIDE signs (+1 or -1) from a hash of it; zeros for NONE."""
    bits = mix(np.arange(1, IDS + 1, dtype=U64))[:, None] >> np.arange(BESIDE, dtype=U64) & U64(1)
    signs = bits.astype(np.int8) * 2 - 1
    signs[NONE] = 0
    return signs


def _pieces(values: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for i in range(0, len(values), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([part], pa.int32()), pa.array([words], pa.int64()), pa.array([values[i : i + PIECE].tobytes()], pa.binary())], names=["piece", "part", "words", "value"])


_PIECE = "piece int, part int, words long, value binary"


def _folded(pieces: DataFrame, sent: type, mean: bool) -> np.ndarray | None:
    """The sum of what tasks sent, or its mean by words, added in two levels and in the order of the tasks; None if there is nothing."""
    kind = sent if mean else np.int64

    def added(read: type):
        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            words, total = int(rows["words"].sum()), 0
            for value, n in zip(rows["value"], rows["words"], strict=True):
                total = total + np.frombuffer(value, read) * (n / words if mean else np.int64(1))
            return pd.DataFrame([{"piece": key[0], "part": int(key[1]) if len(key) > 1 else 0, "words": words, "value": total.astype(kind).tobytes()}])

        return add

    some = pieces.groupBy("piece", F.pmod("part", F.lit(32)).alias("at")).applyInPandas(added(sent), _PIECE)
    got = some.groupBy("piece").applyInPandas(added(kind), _PIECE).toPandas().sort_values("piece")
    return np.concatenate([np.frombuffer(v, kind) for v in got["value"]]) if len(got) else None


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    each = batch.column("ids").to_pylist()
    sizes = np.array([len(x) // 2 for x in each], np.int64)
    return np.frombuffer(b"".join(each), np.uint16), np.repeat(np.arange(len(each)), sizes), sizes


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """_words() of parts of batches with about two million words each."""
    for batch in batches:
        for part in portions(batch, "ids", 4_000_000):
            yield (*_words(part), part)


def beside(rows: DataFrame) -> np.ndarray:
    """For each identifier the sum, over its occurrences, of the signs of the words on its sides: what it occurs with, folded into BESIDE numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, total, words = _signs(), np.zeros((IDS, BESIDE), np.int32), 0
        for ids, doc, _, _ in _cut_batches(batches):
            near = signs.take(_sides(ids, doc), 0).sum(0, dtype=np.int16)
            order = np.argsort(ids, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))[: len(ids)]
            total[ids[order[begins]]] += np.add.reduceat(near.take(order, 0), begins, dtype=np.int32) if len(ids) else 0
            words += len(ids)
        if words:
            yield from _pieces(total.ravel(), words)

    total = _folded(rows.select("ids").mapInArrow(run, _PIECE), np.int32, False)
    return np.zeros((IDS, BESIDE)) if total is None else total.reshape(IDS, BESIDE).astype(np.float64)


def clusters(points: np.ndarray, weights: np.ndarray, k: int, turns: int = 15) -> np.ndarray:
    """Weighted k-means, begun with heavy points that are spread over the ranks."""
    heavy = np.argsort(-weights, kind="stable")[: 4 * k]
    centres = points[heavy[np.argsort(mix(heavy.astype(U64) + U64(1)), kind="stable")[:k]]].copy()
    for _ in range(turns):
        where = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
        mass = np.bincount(where, weights, k)
        for j in range(points.shape[1]):
            centres[:, j] = np.where(mass > 0, np.bincount(where, weights * points[:, j], k) / np.maximum(mass, 1e-9), centres[:, j])
    return where


def fresh_model(counts: np.ndarray, near: np.ndarray, distinct: int, seed: int = 5) -> dict:
    """Classes by what identifiers occur beside, and small random weights; counts and near: of each identifier, distinct: words of the corpus."""
    smooth = counts + 0.5
    mean = near / (counts[:, None] + 5.0)  # what is seen a few times only is drawn to the middle
    points = mean - (near.sum(0) / smooth.sum())[None, :] * (counts / (counts + 5.0))[:, None]
    k = max(8, math.ceil(distinct**0.25))
    classes = np.concatenate([np.arange(OWN), OWN + clusters(points[OWN:], smooth[OWN:], k)])
    mass = np.bincount(classes, smooth, OWN + k)
    rng = np.random.default_rng(seed)
    return {
        "classes": classes.astype(np.uint16), "within": np.log(smooth / mass[classes]),
        "vectors": (rng.standard_normal((IDS, HIDDEN)) * 0.1).astype(np.float32), "scales": np.ones((len(PLACES), HIDDEN), np.float32),
        "out": (rng.standard_normal((HIDDEN, OWN + k)) * 0.1).astype(np.float32), "bias": np.log(np.maximum(mass, 0.5) / mass.sum()).astype(np.float32),
    }


def _forward(model: dict, sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hidden values, logits less their largest, the vectors of the words on the sides)."""
    seen = [model["vectors"].take(s, 0) for s in sides]
    hidden = seen[0] * model["scales"][0]
    for vectors, scale in zip(seen[1:], model["scales"][1:], strict=True):
        hidden += vectors * scale
    np.tanh(hidden, out=hidden)
    logits = hidden @ model["out"]
    logits += model["bias"]
    logits -= logits.max(1, keepdims=True)
    return hidden, logits, seen


def log_probabilities(model: dict, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """log p of every identifier given its two sides; doc tells which document a word belongs to."""
    out = np.empty(len(ids))
    sides = _sides(ids, doc)
    for k in range(0, len(ids), BATCH * 4):
        at = slice(k, k + BATCH * 4)
        _, logits, _ = _forward(model, [s[at] for s in sides])
        own = logits[np.arange(len(logits)), model["classes"][ids[at]]]
        out[at] = own - np.log(np.exp(logits, out=logits).sum(1)) + model["within"][ids[at]]
    return out


def train(model: dict, ids: np.ndarray, doc: np.ndarray, seen: dict) -> None:
    """One pass of gradient steps over all words, in place; ``seen`` keeps the squares of earlier gradients, which steps are divided by."""
    sides = _sides(ids, doc)

    def step(name: str, gradient: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        squares = gradient * gradient
        seen[name][at] += squares.mean(1, keepdims=True) if name == "vectors" else squares
        model[name][at] -= RATE * gradient / np.sqrt(seen[name][at])

    for k in range(0, len(ids), BATCH):
        near = [s[k : k + BATCH] for s in sides]
        hidden, p, vectors = _forward(model, near)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        n = np.float32(len(p))
        p[np.arange(len(p)), model["classes"][ids[k : k + BATCH]]] -= 1
        back = p @ model["out"].T
        back *= 1 - hidden * hidden
        for at, scale in zip(near, model["scales"], strict=True):
            order = np.argsort(at, kind="stable")
            at = at[order]
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            step("vectors", np.add.reduceat(back.take(order, 0), begins) * (scale / n), at[begins])
        step("scales", np.stack([np.einsum("ij,ij->j", back, v) for v in vectors]) / n)
        step("out", hidden.T @ p / n)
        step("bias", p.sum(0) / n)


_NAMES = ("vectors", "scales", "out", "bias")


def unseen(model: dict) -> dict:
    return {n: np.full((len(model[n]), 1) if n == "vectors" else model[n].shape, 1e-8, np.float32) for n in _NAMES}


def trained(rows: DataFrame, model: dict) -> dict:
    """The model after ROUNDS rounds, each over the documents that a hash puts into it; rows: encoded(), on a cut frame."""
    for turn in range(ROUNDS):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            own = now | {n: now[n].copy() for n in _NAMES}
            words, seen = 0, unseen(now)
            for ids, doc, _, _ in _cut_batches(batches):
                train(own, ids, doc, seen)
                words += len(ids)
            if words:
                yield from _pieces(np.concatenate([own[n].ravel() for n in _NAMES]), words)

        mine = rows.where(F.pmod(F.xxhash64(F.lit("round"), "ids"), F.lit(ROUNDS)) == turn).select("ids")
        flat = _folded(mine.mapInArrow(run, _PIECE), np.float32, True)
        if flat is not None:
            sizes = np.cumsum([model[n].size for n in _NAMES])
            model = model | {n: v.reshape(model[n].shape).copy() for n, v in zip(_NAMES, np.split(flat, sizes[:-1]), strict=True)}
    return model


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """(key, doc_id, n_words, log_likelihood) for every row of encoded(), without what words that the lexicon does not know add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, sizes, part in _cut_batches(batches):
            total = np.bincount(doc, log_probabilities(model, ids, doc), len(sizes)) + part.column("term").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(sizes), pa.array(total)], names=["key", "doc_id", "n_words", "log_likelihood"])

    return rows.select("key", "doc_id", "ids", "term").mapInArrow(run, "key long, doc_id long, n_words long, log_likelihood double")


def rare_terms(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(key, more): the log counts of the words that the lexicon does not know, summed for each document."""
    each = rows.where(F.size("rare") > 0).select("key", F.posexplode("rare").alias("at", "word"))
    found = each.join(words.where(F.col("n") < least), "word")
    # equal rows share a key; each of them has one first word
    return found.groupBy("key").agg((F.sum(F.log("n")) / F.count_if(F.col("at") == 0)).alias("more"))


def pseudo_likelihoods(docs: DataFrame, known: int = KNOWN, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) for every row of ``docs`` (doc_id, text, any other columns), whole texts.

    A text without words, or null, has log_likelihood 0 and per_word null, and trains nothing. Repeated rows and
    rows with a null doc_id are rows like others. Without any words the model stays as it began; an empty table gives no rows.
    Scores do not depend on how the input or the shuffles are partitioned.
    """
    docs = docs.select("doc_id", "text")
    words = cut(word_counts(docs))
    lexicon = Lexicon(words, known, vocabulary)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // TASK_BYTES))
    rows = cut(encoded(docs, lexicon, shards))
    model = trained(rows.coalesce(shards), fresh_model(lexicon.counts, beside(rows.coalesce(shards)), lexicon.distinct))
    out = scored(rows, model)
    if lexicon.distinct > len(lexicon.hashes):
        out = out.join(rare_terms(rows, words, lexicon.least), "key", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))
