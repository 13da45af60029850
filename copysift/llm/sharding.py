"""Exact uniform sharding by a hypergeometric communication matrix; DataFrame functions only.

1. Rows are dealt into parts by a digest of their key, and counted.
2. The matrix says how many rows of each part go to each block. A shard is a run of blocks, shards and blocks have exact sizes.
   Given the counts, the rows that a uniform shuffle would send are multivariate hypergeometric: a tree halves the blocks, and
   at each node every part in turn draws how many of its rows go left, from the hypergeometric distribution given what
   is left. A draw inverts the distribution around its mode, 9 standard deviations to either side (what is cut off is below 1e-15).
3. Rows of a part are permuted (ordered by digest), and by their rank go to the blocks as the matrix says: the exchange.
4. Rows of a block are permuted again (by another digest), which gives their places.

Parts and blocks are about sqrt(rows) / 32, so a task holds 32 sqrt(rows) rows and the matrix has a thousandth of the rows'
number. All randomness is MD5 of ``seed`` and the key, so reruns agree, however the input is split. A part that is much too
large (one row repeated very often) is dealt again by the place of its rows in the input; equal rows can change places with each other only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copysift.llm.frames import cut, free_name, within_bytes

SEED = 13
SHARDS = 8
LEAST_PARTS = 32
#: A part of more than so many times its share, and so many rows, is dealt again.
HEAVY, HEAVY_ROWS = 4, 64
#: Levels of the tree that one task works on; then its nodes are dealt to tasks.
LEVELS = 5
#: Bounds of a part that are looked at one by one.
STRIDE = 64
DEVIATIONS, LEAST_REACH = 9, 16


def _digest(seed: int, *what: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(w.cast("string"), F.lit("null")) for w in what)).cast("binary"))


def _number(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(draws: Column, marked: Column, total: Column, u: Column) -> Column:
    """How many of ``total`` things, ``marked`` of them, are marked among ``draws`` drawn ones: the quantile ``u`` (0 to 1) of that number. All are longs."""
    given = F.struct(draws.cast("double").alias("n"), marked.cast("double").alias("m"), total.cast("double").alias("t"), F.greatest(F.lit(0).cast("long"), draws + marked - total).alias("low"), F.least(draws, marked).alias("high"), u.alias("u"))

    def window(q: Column) -> Column:
        n, m, t = q["n"], q["m"], q["t"]
        spread = F.sqrt(n * (m / F.greatest(t, F.lit(1.0))) * ((t - m) / F.greatest(t, F.lit(1.0))) * ((t - n) / F.greatest(t - 1, F.lit(1.0))))
        mode = F.least(q["high"], F.greatest(q["low"], F.floor((n + 1) * (m + 1) / (t + 2)).cast("long")))
        around = F.struct(mode.alias("mode"), (F.ceil(DEVIATIONS * spread) + LEAST_REACH).cast("long").alias("reach"))
        return _with(around, lambda r: F.sequence(F.greatest(q["low"], r["mode"] - r["reach"]), F.least(q["high"], r["mode"] + r["reach"])))

    def quantile(q: Column, values: Column) -> Column:
        def grown(weight: Column, x: Column) -> Column:
            return weight * (((q["n"] - x) * (q["m"] - x)) / ((x + 1.0) * (q["t"] - q["n"] - q["m"] + x + 1.0)))

        def add(s: Column, x: Column) -> Column:
            return F.struct(grown(s["weight"], x).alias("weight"), (s["sum"] + s["weight"]).alias("sum"))

        def count(s: Column, x: Column) -> Column:
            return F.struct(grown(s["weight"], x).alias("weight"), (s["sum"] + s["weight"]).alias("sum"), (s["below"] + F.when(s["sum"] + s["weight"] <= s["goal"], 1).otherwise(0)).alias("below"), s["goal"])

        start = (F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        goal = F.aggregate(values, F.struct(*start), add, lambda s: s["sum"] * q["u"])
        below = F.aggregate(values, F.struct(*start, F.lit(0).cast("long").alias("below"), goal.alias("goal")), count, lambda s: s["below"])
        return F.least(q["high"], values[0] + below)

    return _with(given, lambda q: _with(window(q), lambda values: quantile(q, values)))


def block_start(block: Column, rows: int, shards: int, blocks: int) -> Column:
    """How many rows are before a block: shards, and the ``blocks`` of each shard, have sizes that differ by one at most, the larger ones first."""
    shard, k = F.floor(block / blocks).cast("long"), F.pmod(block, F.lit(blocks)).cast("long")
    each, more = divmod(rows, shards)
    size = each + F.when(shard < more, 1).otherwise(0)
    return (shard * each + F.least(shard, F.lit(more)) + k * F.floor(size / blocks) + F.least(k, F.pmod(size, F.lit(blocks)))).cast("long")


def matrix(counts: DataFrame, rows: int, shards: int, blocks: int, seed: int = SEED) -> DataFrame:
    """(part, block, n) for every part and block, from (part, n): how many rows of a part go to a block. Sums by part and block are exact."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("part").cast("long").alias("part"), F.col("n").cast("long").alias("n"))))
    start = lambda block: block_start(block, rows, shards, blocks)
    nodes = counts.agg(pairs.alias("parts")).select(F.lit(0).cast("long").alias("a"), F.lit(shards * blocks).cast("long").alias("b"), "parts")
    middle = F.ceil((F.col("a") + F.col("b")) / 2).cast("long")  # a node of one block sends all rows left, to itself

    def draw(state: Column, part: Column) -> Column:
        u = _number(_digest(seed, F.col("a"), F.col("b"), part["part"]), 1, 13) / F.lit(float(16**13))
        left = hypergeometric(part["n"], state["marked"], state["total"], u)
        return _with(left, lambda x: F.struct((state["total"] - part["n"]).alias("total"), (state["marked"] - x).alias("marked"), F.concat(state["left"], F.array(x)).alias("left")))

    whole = F.struct((start(F.col("b")) - start(F.col("a"))).alias("total"), (start(middle) - start(F.col("a"))).alias("marked"), F.array().cast("array<bigint>").alias("left"))
    drawn = (F.col("a"), middle.alias("m"), F.col("b"), F.col("parts"), F.aggregate("parts", whole, draw, lambda s: s["left"]).alias("left"))
    first = F.zip_with("parts", "left", lambda p, x: F.struct(p["part"].alias("part"), x.alias("n")))
    second = F.zip_with("parts", "left", lambda p, x: F.struct(p["part"].alias("part"), (p["n"] - x).alias("n")))
    halves = F.array(F.struct(F.col("a"), F.col("m").alias("b"), first.alias("parts")), F.struct(F.col("m").alias("a"), F.col("b"), second.alias("parts")))
    halved = F.inline(F.filter(halves, lambda h: h["a"] < h["b"]))
    for level in range(math.ceil(math.log2(shards * blocks))):
        if level and level % LEVELS == 0:
            nodes = cut(nodes.repartition("a"))
        nodes = nodes.select(*drawn).select(halved)
    return nodes.select(F.inline("parts"), F.col("a").alias("block")).select("part", "block", "n")


def _parts(docs: DataFrame, key: tuple[str, ...], seed: int, names: tuple[str, str]) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows with their digest and part, a cut (part, n), rows, parts)."""
    digest, part = names
    rows = docs.count()
    parts = max(LEAST_PARTS, 1 << max(0, math.ceil(math.log2(max(1.0, math.sqrt(rows) / 32)))))
    dealt = docs.withColumn(digest, _digest(seed, *map(F.col, key))).withColumn(part, F.pmod(_number(F.col(digest), 1, 6), F.lit(parts)))
    count = lambda df: cut(df.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")))
    counts = count(dealt)
    heavy = [r["part"] for r in counts.where((F.col("n") > HEAVY * rows / parts) & (F.col("n") > HEAVY_ROWS)).select("part").collect()]  # below parts / HEAVY
    if heavy:
        dealt = cut(dealt)
        dealt = cut(dealt.withColumn(part, F.when(F.col(part).isin(heavy), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).otherwise(F.col(part))))
        counts = count(dealt)
    return dealt, counts, rows, parts


def shuffled(docs: DataFrame, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED) -> DataFrame:
    """Every row of ``docs``, all columns, with shard (int, from 0) and slot (long, from 0 without gaps in each shard), in uniformly random order.

    Numbers of rows of two shards differ by one at most. The order depends on the key columns and on which rows there are, and on
    nothing else; rows with equal keys (repeated rows, null ids) have places of their own, and which of them has which is left open.
    Columns called shard and slot are replaced. Nulls are values like others. An empty table gives no rows.
    ``docs`` is read three times (counted, counted by part, dealt): cut it where it is costly. A part is dealt by the first 24 bits of
    the digest, so there are at most 2^24.
    """
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    digest, part, rank, block, coarse, bounds = (free_name(docs, c) for c in ("digest", "part", "rank", "block", "coarse", "bounds"))
    dealt, counts, rows, parts = _parts(docs, key, seed, (digest, part))
    blocks = math.ceil(parts / shards)
    to = F.sum("n").over(W.partitionBy("part").orderBy("block"))
    cells = matrix(counts, rows, shards, blocks, seed).withColumn("to", to)
    ends = cells.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "to"))), lambda x: x["to"]).alias(bounds))
    ends = cut(ends.withColumn(coarse, F.filter(bounds, lambda x, i: F.pmod(i + 1, F.lit(STRIDE)) == 0)))
    ends = within_bytes(ends, 8 * F.size(bounds) + 8 * F.size(coarse)).withColumnRenamed("part", part)
    local = W.partitionBy(part).orderBy(digest)
    ranked = dealt.withColumn(rank, (F.row_number().over(local) - 1).cast("long")).join(ends, part)
    before = F.size(F.filter(coarse, lambda x: x <= F.col(rank)))
    near = F.slice(F.col(bounds), before * STRIDE + 1, F.lit(STRIDE))
    ranked = ranked.withColumn(block, (before * STRIDE + F.size(F.filter(near, lambda x: x <= F.col(rank)))).cast("long"))
    again = W.partitionBy(block).orderBy(_digest(seed, F.lit("again"), F.col(digest)), digest)
    place = F.row_number().over(again) - 1
    shard = F.floor(F.col(block) / blocks).cast("long")
    inside = block_start(F.col(block), rows, shards, blocks) - block_start(shard * blocks, rows, shards, blocks)
    return ranked.select(*columns, shard.cast("int").alias("shard"), (inside + place).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """The shuffled rows as Parquet, a folder for each shard (shard=0, ...), each file in order of slot."""
    shuffled(docs, shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row: where shuffled() puts it. size is the text's bytes in UTF-8 and one more; a null text has none.

    Texts are read once; what is shuffled is the id, the size and the CRC-32. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    placed = shuffled(rows, shards, key=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
