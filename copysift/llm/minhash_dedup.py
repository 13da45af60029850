"""MinHash near-duplicate detection with fast similarity sketches, banding and exact verification.

Sketch. Round i of 2t hashes every element of a set to a bin (uniform for i < t, bin i - t after that) and a
value; a coordinate keeps the smallest (round, value) that falls into its bin, and rounds stop once all t bins
are full. So every coordinate is filled, a set of n elements costs O(n + t log t), and the share of equal
coordinates of two sketches concentrates around the Jaccard similarity as with t independent permutations.

Search. Texts with equal sets are folded into one node first, so a group of copies is one row from there on.
Each band of ``rows`` coordinates is a bucket key. Every node is linked with one hub of each of its buckets
(another random member for each bucket), which takes one row for a member and band however large a bucket is.
Nodes of a bucket that the hubs leave in different components are then compared with each other, so that no
link is lost that banding finds: in buckets of up to ``SMALL`` nodes as rows of a join, in larger ones tile by
tile inside tasks, which return only links that join components (fewer than their nodes). All links are
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.components import components
from copysift.llm.frames import cut, small_enough
from copysift.llm.words import U64, mix, portions, shingle_sets

BANDS, ROWS = 32, 6
#: Nodes of a bucket up to which its pairs become rows.
SMALL = 16
#: Shingles in a tile of a larger bucket, about.
TILE_SHINGLES = 200_000
#: Standard errors of the sketch's estimate by which a pair may miss the threshold and still be confirmed on the full sets.
ERRORS = 6


def fast_similarity_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a nonempty set of 64-bit hashes; equal (round, value) words mean the same element."""
    out = np.full(t, np.iinfo(U64).max, U64)
    done, step = 0, max(1, 8 * t // len(elements))
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + step), dtype=U64)
        hashed = mix(elements[None, :] + (rounds[:, None] + U64(1)) * U64(0x9E3779B97F4A7C15))
        bins = (hashed >> U64(32)) * U64(t) >> U64(32)
        fixed = rounds >= U64(t)
        if fixed.any():
            bins[fixed] = rounds[fixed, None] - U64(t)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << U64(32)) | (hashed & U64(0xFFFFFFFF))).ravel())
        done += len(rounds)
        if out.max() != np.iinfo(U64).max:
            break
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    places = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    return mix((sketch[: bands * rows].reshape(bands, rows) * places).sum(1, dtype=U64) + mix(np.arange(77, 77 + bands, dtype=U64)))


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_high, set_low, bands, marks) for every row; marks are one byte for each coordinate.

    (set_high, set_low) is a 128-bit digest of the set. An empty text has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                high, low, keys, marks = [], [], [], []
                for s in sets:
                    high.append(int(np.sum(mix(s ^ U64(0x51)), dtype=U64).view(np.int64)))
                    low.append(int(np.bitwise_xor.reduce(mix(s + U64(0xA7))).view(np.int64)) if len(s) else 0)
                    if len(s):
                        sketch = fast_similarity_sketch(s, bands * rows)
                        keys.append(band_keys(sketch, bands, rows).view(np.int64))
                        marks.append((mix(sketch) >> U64(56)).astype(np.uint8).tobytes())
                    else:
                        keys.append(None)
                        marks.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "set_high", "set_low", "bands", "marks"],
                )

    kind = "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>, marks binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Only texts of the nodes in ``pairs`` are shuffled: the list of those nodes filters the scan, broadcast
    while its counted size allows it.
    """
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_enough(involved), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text_a"):
                for piece in portions(part, "text_b"):
                    keep = []
                    for x, y in zip(shingle_sets(piece.column("text_a"), k), shingle_sets(piece.column("text_b"), k), strict=True):
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                    yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any other columns).

    Texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; component_id is the
    smallest doc_id that links reach. With the defaults a pair at the threshold escapes all bands with
    probability 6e-5 (3e-7 at 0.85); what bands find is confirmed exactly.

    Null and blank texts have no shingles and are linked with nothing. Equal sets are told by a 128-bit digest. A pair whose sketches
    differ by ``ERRORS`` standard errors more than the threshold allows is dismissed before confirmation. Rows with the same doc_id are
    the same document: their links join (in buckets of more than ``SMALL`` nodes those of one of its texts only). A null doc_id takes part as a copy of an equal set only; component_id is then
    that set's, or null, and such a row is kept only if no row with an id has its set. An empty table gives no rows.
    """
    signed = cut(sketches(docs, k, bands, rows))
    full = signed.where("n_shingles > 0")
    nodes = cut(full.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("node"), F.min_by("bands", F.xxhash64("doc_id")).alias("bands"), F.first("marks").alias("marks"), F.first("n_shingles").alias("n")))
    same = full.join(nodes.select("set_high", "set_low", "node"), ["set_high", "set_low"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    members = nodes.where("node is not null").select(F.explode("bands").alias("band"), "node")
    hubs = members.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(F.col("band"))).alias("x"), F.count("*").alias("members")).where("members > 1")
    buckets = cut(members.join(hubs.select("band", F.col("x").bitwiseXOR(F.col("band")).alias("hub")), "band"))
    spokes = cut(buckets.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    links = cut(confirmed(_likely(spokes, nodes, percent), docs, k, percent))
    found = cut(components(links, "a", "b"))

    placed = buckets.join(nodes.select("node", "n"), "node").join(found, "node", "left").select("band", "node", "n", F.coalesce("component_id", "node").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("x != y")
    placed = cut(placed.join(split.select("band", "members", "shingles"), "band"))
    few = placed.where(F.col("members") <= SMALL)
    left, right = few.alias("l"), few.alias("r")
    crossing = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.component") != F.col("r.component")) & (F.lit(100) * F.least("l.n", "r.n") >= F.lit(percent) * F.greatest("l.n", "r.n")))
    crossing = crossing.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct().join(spokes, ["a", "b"], "left_anti")
    more = confirmed(cut(_likely(crossing, nodes, percent)), docs, k, percent)
    more = more.unionByName(_tiled(placed.where(F.col("members") > SMALL), nodes, docs, k, percent))

    found = components(found.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(more).unionByName(same), "a", "b")
    answer = signed.join(nodes.select("set_high", "set_low", F.col("node").alias("copy_of")), ["set_high", "set_low"], "left")
    answer = answer.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("copy_of")).otherwise(F.col("doc_id"))).join(found, "node", "left")
    component = F.coalesce("component_id", "node")
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _least_estimate(percent: int, coordinates: int) -> float:
    p = percent / 100
    return p - ERRORS * (p * (1 - p) / coordinates) ** 0.5


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree in a share of coordinates within ``ERRORS`` standard errors of the threshold, and whose sizes allow it."""
    of = nodes.select("node", "marks", "n")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("marks").alias("marks_a"), F.col("n").alias("n_a")), "a").join(of.select(F.col("node").alias("b"), F.col("marks").alias("marks_b"), F.col("n").alias("n_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= _least_estimate(percent, x.shape[1])))

    sized = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return both.where(sized).select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a long, b long")


def _tiled(placed: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between components within the buckets ``placed`` (band, node, component, shingles), by pairs of tiles."""
    placed = placed.withColumn("tiles", F.ceil(F.col("shingles") / TILE_SHINGLES).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node", "band"), "tiles").cast("int"))
    involved = cut(placed.select(F.col("node").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_enough(involved), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.max("text").alias("text"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("t1"), F.greatest(t, F.col("tile")).alias("t2")))
    rows = placed.select("band", "node", "component", "tile", "tiles").join(nodes.select("node", "n", "marks", "bands"), "node").join(texts, "node").select("band", "node", "n", "component", "tile", "marks", "bands", "text", F.inline(others))

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = key[1] == key[2]
        ids, part, tile = rows["node"].to_numpy(np.int64), rows["component"].to_numpy(np.int64), rows["tile"].to_numpy()
        n = rows["n"].to_numpy(np.int64)
        marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)
        bands = np.array(rows["bands"].tolist(), np.int64)
        estimates, at = [], []
        for i in range(len(rows)):
            open_ = (part != part[i]) & (ids > ids[i] if one else tile > tile[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            j = np.flatnonzero(open_)
            e = (marks[j] == marks[i]).mean(1)
            keep = e >= _least_estimate(percent, marks.shape[1])
            j, e = j[keep], e[keep]
            # of the bands that a pair shares one, picked by a hash, deals with it
            order = mix((bands[j] ^ (ids[j] ^ ids[i])[:, None]).view(U64))
            order[bands[j] != bands[i]] = np.iinfo(U64).max
            mine = bands[i][order.argmin(1)] == key[0] if len(j) else np.zeros(0, bool)
            at += [(i, x) for x in j[mine].tolist()]
            estimates += e[mine].tolist()
        sets = shingle_sets(pa.array(rows["text"].tolist(), pa.large_string()), k)
        root = {c: c for c in part.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for where in np.argsort(estimates, kind="stable")[::-1]:
            i, j = at[where]
            a, b = find(int(part[i])), find(int(part[j]))
            if a != b:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    root[max(a, b)] = min(a, b)
                    found.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("band", "t1", "t2").applyInPandas(links, "a long, b long")
