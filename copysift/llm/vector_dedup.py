"""Near-duplicate vectors by int8 tile products with a rigorous error bound and exact recomputation.

Equal vectors of a label are folded into one first. The rest of a label is dealt into tiles of a bounded number of vectors, by
the side of the label's mean on which they lie along the axes that vary most, so that a tile holds neighbours. A tile knows the
box around its vectors; two tiles whose boxes are farther apart than vectors with the least cosine can be hold no link and
are not multiplied. A label with a third of all vectors becomes many equal tasks. In a task, unit vectors are held
as scale * int8 with the length of the rounding error; integer products are exact in single precision, and

    |x.y - x'.y'| <= |ex| |y'| + |x'| |ey| + |ex| |ey|

for quantised x' and y', so a pair below the threshold by more than that is dismissed without loss. Only int8 values, scales and
errors are shuffled to all pairs of tiles; the vectors themselves go to those pairs where some product may reach the threshold, and
only these products are computed again in double precision. A task returns one row for each linked vector (how many it is
linked with in the pair of tiles, and the smallest vector it reaches there), never one for each link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.components import components
from copysift.llm.frames import cut, within_bytes

TILE = 1024
#: Pairs recomputed at once in double precision.
AGAIN = 1 << 15


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of the rounding error) of each row."""
    scale = np.abs(unit).max(1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    return values, scale, np.sqrt(((unit - values * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-15


def possible_pairs(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose product may reach ``least``, of two results of quantise()."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    step = 1000  # so many squares of 127 stay below 2**24, where single precision is exact
    dots = sum((qa[:, i : i + step].astype(np.float32) @ qb[:, i : i + step].astype(np.float32).T).astype(np.float64) for i in range(0, qa.shape[1], step))
    la, lb = 1 + ea, 1 + eb
    bound = ea[:, None] * lb[None, :] + la[:, None] * eb[None, :] + ea[:, None] * eb[None, :]
    return np.nonzero(dots * sa[:, None] * sb[None, :] + bound >= least - 1e-9)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def linked(x: np.ndarray, y: np.ndarray, a: tuple, b: tuple, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = possible_pairs(a, b, least)
    if same:
        i, j = i[i < j], j[i < j]
    keep = [cosines(x[i[k : k + AGAIN]], y[j[k : k + AGAIN]]) >= least for k in range(0, len(i), AGAIN)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def smallest_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the smallest id that the pairs of places connect it with."""
    out = ids.copy()
    while True:
        before = out.copy()
        low = np.minimum(out[i], out[j])
        np.minimum.at(out, i, low)
        np.minimum.at(out, j, low)
        if (out == before).all():
            return out


#: Axes that vectors are dealt by at most; a tile that is still too large is dealt by a hash.
AXES = 20


def _axes(vectors: DataFrame, tile: int) -> DataFrame:
    """(label, dim, axes, middle): for each label the axes along which its unit vectors vary most, as many as halvings make tiles, and the mean there."""
    kind = "label long, dim int, n long, sums binary, squares binary"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for frame in frames:
            for key, rows in frame.groupby(["label", "dim"]):
                x = np.array(rows["embedding"].tolist(), np.float64)
                x /= np.sqrt((x * x).sum(1))[:, None]
                old = held.setdefault(key, [0, 0.0, 0.0])
                held[key] = [old[0] + len(x), old[1] + x.sum(0), old[2] + (x * x).sum(0)]
        if held:
            yield pd.DataFrame([(*key, n, s.tobytes(), q.tobytes()) for key, (n, s, q) in held.items()], columns=["label", "dim", "n", "sums", "squares"])

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        sums, squares = (sum(np.frombuffer(v) for v in rows[c]) for c in ("sums", "squares"))
        axes = np.argsort(-(squares / n - (sums / n) ** 2), kind="stable")[: min(AXES, max(0, int(np.ceil(np.log2(n / tile)))))]
        return pd.DataFrame([{"label": key[0], "dim": key[1], "axes": axes.tolist(), "middle": (sums / n)[axes].tolist()}])

    return vectors.select("label", "dim", "embedding").mapInPandas(add, kind).groupBy("label", "dim").applyInPandas(choose, "label long, dim int, axes array<int>, middle array<double>")


def _packed(vectors: DataFrame, tile: int) -> DataFrame:
    """One row for each tile: its ids, multiplicities, vectors and their quantised form as bytes, and the box around its unit vectors."""
    axes = within_bytes(cut(_axes(vectors, tile)), 64 + 12 * F.size("axes"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    sides = F.zip_with("axes", "middle", lambda a, m: (F.element_at("embedding", a + 1) / F.col("length") > m).cast("long"))
    dealt = vectors.withColumn("length", length).join(axes, ["label", "dim"]).withColumn("side", F.aggregate(sides, F.lit(0).cast("long"), lambda s, x: s * 2 + x)).drop("axes", "middle", "length")
    sizes = dealt.groupBy("label", "dim", "side").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    dealt = dealt.join(within_bytes(cut(sizes), F.lit(48)), ["label", "dim", "side"]).withColumn("part", F.pmod(F.xxhash64("node", "embedding"), "parts"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["embedding"].tolist(), np.float64)
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        q, s, e = quantise(unit)
        one = {"label": key[0], "dim": key[1], "tile": f"{key[2]}:{key[3]}", "low": unit.min(0), "high": unit.max(0)}
        one |= {"ids": rows["node"].to_numpy(np.int64).tobytes(), "copies": rows["copies"].to_numpy(np.int64).tobytes(), "x": x.tobytes(), "q": q.tobytes(), "s": s.tobytes(), "e": e.tobytes()}
        return pd.DataFrame([one])

    return dealt.groupBy("label", "dim", "side", "part").applyInPandas(pack, "label long, dim int, tile string, low array<double>, high array<double>, ids binary, copies binary, x binary, q binary, s binary, e binary")


def _near_tiles(blocks: DataFrame, least: float) -> DataFrame:
    """(label, dim, t1, t2): the pairs of tiles of a label whose boxes are near enough for a link.

    Unit vectors with a cosine of ``least`` are sqrt(2 - 2 least) apart, no closer than the boxes around them.
    """
    boxes = cut(blocks.select("label", "dim", "tile", "low", "high"))
    one, two = boxes.toDF("label", "dim", "t1", "low1", "high1"), boxes.toDF("label", "dim", "t2", "low2", "high2")
    gap = lambda a, b: F.zip_with(a, b, lambda low, high: F.greatest(F.lit(0.0), low - high))
    apart = F.zip_with(gap("low1", "high2"), gap("low2", "high1"), lambda x, y: F.greatest(x, y))
    squared = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    return one.join(two, ["label", "dim"]).where((F.col("t1") <= F.col("t2")) & (squared <= 2 - 2 * least + 1e-9)).select("label", "dim", "t1", "t2")


def tile_links(vectors: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(node, links, root) for every pair of tiles in which the vector ``node`` is linked; vectors: node, label, dim, embedding, copies."""
    blocks = cut(_packed(vectors, tile))
    pairs = cut(_near_tiles(blocks, least))

    def both(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
        def side(k: int) -> DataFrame:
            return blocks.select("label", "dim", F.col("tile").alias(f"t{k}"), *(F.col(c).alias(f"{c}{k}") for c in names))

        return pairs.join(side(1), ["label", "dim", "t1"]).join(side(2), ["label", "dim", "t2"])

    def read(row, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(getattr(row, name), kind)

    def quantised(row, k: int) -> tuple:
        s = read(row, f"s{k}", np.float64)
        return read(row, f"q{k}", np.int8).reshape(len(s), row.dim), s, read(row, f"e{k}", np.float64)

    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for row in frame.itertuples():
                i, j = possible_pairs(quantised(row, 1), quantised(row, 2), least)
                keep.append(bool((i < j).any() if row.t1 == row.t2 else len(i)))
            yield frame.loc[keep, ["label", "dim", "t1", "t2"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids1, ids2 = (read(row, f"ids{k}", np.int64) for k in (1, 2))
                n1, n2 = (read(row, f"copies{k}", np.int64) for k in (1, 2))
                x1, x2 = (read(row, f"x{k}", np.float64).reshape(-1, row.dim) for k in (1, 2))
                i, j = linked(x1, x2, quantised(row, 1), quantised(row, 2), least, row.t1 == row.t2)
                if len(i):
                    ids = np.concatenate([ids1, ids2])
                    links = np.bincount(i, n2[j], len(ids)) + np.bincount(j + len(ids1), n1[i], len(ids))
                    root = smallest_reached(ids, i, j + len(ids1))
                    yield pd.DataFrame({"node": ids, "links": links.astype(np.int64), "root": root})[links > 0]

    some = cut(both(pairs, ("q", "s", "e")).mapInPandas(possible, "label long, dim int, t1 string, t2 string"))
    return both(some, ("ids", "copies", "x", "q", "s", "e")).mapInPandas(run, "node long, links long, root long")


def near_duplicate_vectors(rows: DataFrame, least: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vec_id, embedding, label (and any other columns).

    Two rows are linked if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``least``. Vectors that are null, empty, zero or hold a null or non-finite
    component, vectors of different lengths, and rows with a null vec_id or label are linked with nothing.
    Copies count as links of each other. Rows with the same vec_id are one vector: their links add up. An empty table gives no rows.
    """
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    length = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    good = rows.where(fit).where((length > 0) & (length < float("inf"))).withColumn("dim", F.size(x))
    nodes = cut(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    found = cut(tile_links(nodes, least, tile))
    same = good.join(nodes, ["label", "dim", "embedding"]).select("vec_id", "node", "copies")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same.select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    reached = components(edges, "a", "b").select(F.col("node").alias("vec_id"), "component_id")
    linked_rows = same.join(counts, "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    answer = rows.select("vec_id").join(linked_rows, "vec_id", "left").join(reached, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return answer.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
