"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame functions only.

1. Targets. Sources in code-point order weigh 5, 2, 1, repeating, and share all words; a source stops at a
   multiple of its size and the excess is shared again by weight. That fixpoint is a water level over the
   sources ordered by (limit / weight), found with running sums.
2. Quotas. Each source is dealt into blocks by a hash of doc_id, the more the larger it is. A pass takes every block once; the
   last pass of a source takes blocks in a permuted order up to its target, and documents of the one block on the
   edge in hashed order, the last of them in part. So only one block of a source is ever ordered.
3. Shards. A tree halves the shards; at a node the blocks still to deal are split by selection sampling over
   the source quotas, which draws the multivariate hypergeometric distribution exactly. Every shard gets a
   disjoint run of each source's permuted blocks, and its rows are ordered by a hash (a local shuffle). The number of
   shards and of their parts follows from the words counted.

All randomness is MD5 of ``seed`` and names, so reruns agree and other engines can draw the same. What is held in one row or one
task is a number or two for each source (tree and targets), never one for each document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copysift.llm.frames import cut, free_name, within_bytes

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: A source has a power of two of blocks, at least LEAST_BLOCKS, so that a block has about BLOCK_WORDS words, and at most BUCKETS.
BLOCK_WORDS, LEAST_BLOCKS, BUCKETS = 2_000_000, 64, 4096
#: Shards are a power of two, at least LEAST_SHARDS, of SHARD_WORDS words at most; a shard is written in parts of about PART_WORDS.
SHARD_WORDS, LEAST_SHARDS, PART_WORDS = 64_000_000, 8, 2_000_000
SEED = 11


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source name that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _digest(seed: int, *what: Column | str) -> Column:
    """32 hexadecimal digits from the seed and names."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(w).cast("string") if isinstance(w, str) else w.cast("string"), F.lit("null")) for w in what)))


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _uniform(seed: int, *what: Column) -> Column:
    return _number(_digest(seed, *what), 13) / F.lit(float(16**13))


def _power_of_two(x: Column) -> Column:
    """The smallest power of two that is at least x."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x, F.lit(1.0))))).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds weight and target to one row for each source (source, source_size). The table has as many rows as there are sources."""
    named = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("double"))
    rows = rows.withColumn("limit", (F.lit(most) * F.col("source_size")).cast("double"))
    rising = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    filled, all_rows = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(filled), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    rows = rows.withColumn("level", F.struct(F.row_number().over(rising).alias("rank"), (left / open_weight).alias("value")))
    # the water level is that of the first source which stays below its limit; if none does, all are at their limits
    fits = F.when(F.col("level.value") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.min(fits).over(all_rows)["value"]
    return rows.withColumn("target", F.coalesce(F.least(F.col("limit"), level * F.col("weight")), F.col("limit"))).drop("level", "limit")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, key, from, to): for each shard and source the run of the source's draws that the tree gives it. quotas: key, draws."""
    pair = F.struct(F.col("key"), F.col("draws").cast("long").alias("draws"))
    nodes = quotas.agg(F.array_sort(F.collect_list(pair)).alias("quotas")).select(F.lit(0).alias("node"), "quotas")
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["draws"])
        nodes = nodes.withColumn("total", total)

        def halve(state: Column, q: Column) -> Column:
            def draw(k: Column, j: Column) -> Column:
                chance = (state["open"] - k) / (state["left"] - j + 1)
                return k + F.when(_uniform(seed, F.col("node"), q["key"], j) < chance, 1).otherwise(0).cast("long")

            drawn = F.when(q["draws"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(q["draws"], F.lit(1))), F.lit(0).cast("long"), draw)).otherwise(0).cast("long")
            return F.struct((state["left"] - q["draws"]).alias("left"), (state["open"] - drawn).alias("open"), F.concat(state["taken"], F.array(drawn)).alias("taken"))

        start = F.struct(F.col("total").alias("left"), F.floor(F.col("total") / 2).alias("open"), F.array().cast("array<bigint>").alias("taken"))
        nodes = nodes.withColumn("taken", F.aggregate("quotas", start, halve, lambda s: s["taken"]))
        first = F.zip_with("quotas", "taken", lambda q, n: F.struct(q["key"].alias("key"), n.alias("draws")))
        second = F.zip_with("quotas", "taken", lambda q, n: F.struct(q["key"].alias("key"), (q["draws"] - n).alias("draws")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), first.alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), second.alias("quotas")))
        nodes = nodes.select(F.inline(halves))
    rows = nodes.select(F.col("node").alias("shard"), F.inline("quotas"))
    upto = F.sum("draws").over(W.partitionBy("key").orderBy("shard"))
    return rows.select("shard", "key", (upto - F.col("draws")).alias("from"), upto.alias("to"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int, float]:
    """(a row for each source and block, shards, words of the mix): key, block, blocks, source_size, target, passes, edge, shards (one for each draw of the block).

    sized: source, key, bucket, size. A block is what a bucket leaves by the source's ``blocks``. passes counts how often the block is
    taken whole; edge is the number of words to take of it once more, or 0.
    """
    buckets = cut(sized.groupBy("source", "key", "bucket").agg(F.sum("size").alias("bucket_size")))
    goals = targets(buckets.groupBy("source", "key").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    blocks = F.least(F.lit(BUCKETS), F.greatest(F.lit(LEAST_BLOCKS), _power_of_two(F.col("source_size") / float(BLOCK_WORDS))))
    goals = cut(goals.withColumn("blocks", blocks.cast("int")).drop("source", "weight"))
    words = goals.agg(F.sum("target")).first()[0] or 0.0
    if shards is None:
        shards = max(LEAST_SHARDS, 1 << (math.ceil(words / SHARD_WORDS) - 1).bit_length())
    rows = buckets.join(within_bytes(goals, F.lit(64) + F.octet_length("key")), "key").withColumn("block", F.pmod("bucket", "blocks"))
    rows = rows.groupBy("key", "block", "blocks", "source_size", "target").agg(F.sum("bucket_size").alias("block_size"))
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = cut(rows.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    draws = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    permuted = W.partitionBy("key", "pass").orderBy(_digest(seed, "key", "pass", "block"), "block")
    draws = draws.withColumn("rank", F.row_number().over(permuted)).withColumn("before", F.sum("block_size").over(permuted) - F.col("block_size"))
    draws = draws.withColumn("words", F.when(F.col("pass") < F.col("whole"), F.col("block_size")).otherwise(F.greatest(F.lit(0), F.least("block_size", F.col("rest") - F.col("before")))))
    draws = cut(draws.withColumn("drawn", F.col("words") > 0))
    # empty blocks and those behind the edge are not drawn; places of the drawn ones are numbered without gaps
    drawn = draws.where("drawn").withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("pass", "rank")) - 1)
    runs = split_quotas(drawn.groupBy("key").agg(F.count("*").alias("draws")), shards, seed)
    placed = drawn.join(runs, (drawn["key"] == runs["key"]) & (F.col("place") >= F.col("from")) & (F.col("place") < F.col("to"))).select(drawn["key"], "block", "pass", "shard")
    shards_of = placed.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    told = draws.groupBy("key", "block", "blocks", "source_size", "target").agg(
        F.sum(F.when(F.col("drawn") & (F.col("words") == F.col("block_size")), 1).otherwise(0)).alias("passes"),
        F.max(F.when(F.col("drawn") & (F.col("words") < F.col("block_size")), F.col("words")).otherwise(0)).alias("edge"),
    )
    draws_of = F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>"))
    return told.join(shards_of, ["key", "block"], "left").select("key", "block", "blocks", "source_size", "target", "passes", "edge", F.transform(draws_of, lambda d: d["shard"]).alias("shards")), shards, words


RESULTS = ("size", "source_size", "target", "taken", "shards")


def _mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int, float]:
    docs = docs.drop(*RESULTS)
    columns = docs.columns
    key, block, blocks_of, passes, edge, before, part = (free_name(docs, c) for c in ("key", "block", "blocks_of", "passes", "edge", "words_before", "part"))
    bucket = _number(_digest(seed, F.lit("bucket"), "doc_id"), 3)
    sized = docs.withColumns({key: _key(F.col("source")), "size": words_in(F.col("text"))})
    told, shards, words = plan(sized.select("source", F.col(key).alias("key"), bucket.alias("bucket"), "size"), weights, most, shards, seed)
    told = cut(told)
    blocks = within_bytes(cut(told.select("key", "blocks").distinct()), F.lit(24) + F.octet_length("key")).toDF(key, blocks_of)
    told = within_bytes(told, F.lit(64) + F.octet_length("key") + 4 * F.size("shards")).withColumnsRenamed({"key": key, "block": block, "passes": passes, "edge": edge}).drop("blocks")
    rows = sized.join(blocks, key).withColumn(block, F.pmod(bucket, F.col(blocks_of))).drop(blocks_of).join(told, [key, block])
    ordered = W.partitionBy(key, block).orderBy(_digest(seed, F.lit("row"), "doc_id"), "doc_id", "size", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.where(F.col(edge) == 0).withColumn(part, F.lit(0).cast("long"))
    partly = rows.where(F.col(edge) > 0).withColumn(before, F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    partly = partly.withColumn(part, F.greatest(F.lit(0), F.least("size", F.col(edge) - F.col(before)))).drop(before)
    both = inside.unionByName(partly)
    times = F.when(F.col("size") > 0, F.col(passes) + (F.col(part) > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    return both.select(*columns, "size", "source_size", "target", (F.col(passes) * F.col("size") + F.col(part)).cast("long").alias("taken"), F.slice("shards", F.lit(1), times).alias("shards")), shards, words


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source and others) with size, source_size, target, taken and shards.

    size counts words (null text: 0), source_size and target are those of the row's source, taken is the number of
    words that the mix takes of the row (up to ``most`` times its size), and shards names a shard for each time
    the row is taken, the last being the partial one if there is one. A source's taken words are its target,
    rounded. Null sources are one source, ordered last. Rows without words are taken 0 times. Rows with the same
    doc_id are separate rows, a null doc_id is one more. Columns called as the five results are replaced, all others kept. An empty
    table gives no rows. Options: weights, most, shards (a power of two; by the words if None), seed.
    """
    return _mixture(docs, **options)[0]


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with shard, copy and words, dealt and ordered by shard.

    A partial copy has the first ``words`` words of its text. Documents that are taken 0 times are left out. Columns called as the
    results (size, source_size, target, shard, copy, words) are replaced, all others kept.
    """
    rows, shards, words = _mixture(docs.drop("shard", "copy", "words"), **options)
    columns = [c for c in rows.columns if c not in RESULTS]
    rows = rows.select("*", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    head = F.call_function("regexp_extract", "text", F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("words").cast("string"), F.lit("}+")), F.lit(0))
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text")))
    order = _digest(options.get("seed", SEED), F.lit("order"), "doc_id", "copy")
    rows = rows.select(*columns, "size", "source_size", "target", "shard", "copy", "words")
    parts = max(1, math.ceil(words / shards / PART_WORDS))
    return rows.repartition(shards * parts, "shard", F.pmod(_number(order, 8), F.lit(parts))).sortWithinPartitions("shard", order)
