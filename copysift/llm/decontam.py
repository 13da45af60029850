"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

An item with q distinct k-word shingles is contained in a document if at least ``percent`` of them occur there,
so at most m = q - ceil(q * percent / 100) may be missing. Its sketch is its m + 1 smallest shingle hashes
(bottom-k MinHash): a document that contains the item shares at least one of them, so the search
misses nothing. Items are partitioned by size (powers of two); each partition has its largest sketch hash
and its smallest item, and a document's sketch for a partition is its shingles up to that hash, if the document
is long enough for it. Pairs that share a sketch hash are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copysift.llm.frames import cut, free_name, small_enough, within_bytes

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Lower-case words of a text; none for null or blank."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, k: int) -> Column:
    """Hashes of all k-word shingles of a text, from 0 to 2**63 - 1, repeats included; fewer words are one shingle."""

    def of(hashes: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(hashes, i + j) for j in range(k))), 1))
        one = F.array(F.shiftrightunsigned(F.xxhash64(hashes), 1))
        return F.when(F.size(hashes) >= k, many).when(F.size(hashes) > 0, one).otherwise(F.array().cast("array<bigint>"))

    # the word hashes are bound as a lambda's variable, so they are computed once wherever the optimizer moves this
    return F.element_at(F.transform(F.array(F.transform(words_of(text), lambda w: F.xxhash64(w))), of), 1)


def _row_key() -> Column:
    """64 bits for a doc_id and a text."""
    return F.xxhash64("doc_id", "text")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of (item_id, text) that documents of (doc_id, text, ...) contain.

    n_item counts the item's distinct k-word shingles, n_shared those found in the document, whole texts on both
    sides; 100 * n_shared >= percent * n_item. A text of fewer than k words is one shingle and is found in equal
    texts only. Items or documents without words, and null texts, contain nothing and are contained in nothing.
    A document is a doc_id (which may be null) and a text: equal rows are one, others with the same doc_id are apart.
    Items with equal texts are all reported; a null item_id is one more item. Empty tables give no rows.
    """
    return _found(docs, items, k, percent).select("doc_id", "item_id", "n_shared", "n_item")


def _found(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    item_rows = items.select("item_id", F.array_sort(F.array_distinct(shingles(F.col("text"), k))).alias("shingles"))
    item_rows = cut(item_rows.where(F.size("shingles") > 0).withColumn("q", F.size("shingles")).withColumn("partition", F.floor(F.log2("q")).cast("int")))
    need = F.ceil(F.col("q") * percent / 100).cast("int")
    sketched = item_rows.select("partition", "q", F.explode(F.slice("shingles", F.lit(1), F.col("q") - need + 1)).alias("shingle"))
    limits = sketched.groupBy("partition").agg(F.max("shingle").alias("limit"), F.min("q").alias("least")).collect()  # one row for each power of two
    if not limits:
        return docs.sparkSession.createDataFrame([], "row long, doc_id long, item_id long, n_shared long, n_item int")
    index = cut(sketched.groupBy("shingle").agg(F.min("q").alias("least")))
    rows = docs.select(_row_key().alias("row"), shingles(F.col("text"), k).alias("shingles")).withColumn("n", F.size("shingles"))
    in_reach = lambda n, x: F.coalesce(*(F.when((n * 100 >= r["least"] * percent) & (x <= r["limit"]), True) for r in sorted(limits, key=lambda r: -r["limit"])), F.lit(False))
    probes = rows.select("row", "n", F.explode_outer("shingles").alias("shingle")).where(in_reach(F.col("n"), F.col("shingle")))
    hit = probes.join(small_enough(index), "shingle").where(F.col("n") * 100 >= F.col("least") * percent).select("row").distinct()
    suspects = cut(hit)

    wanted = cut(item_rows.select(F.explode("shingles").alias("shingle"), "item_id", "q"))
    texts = docs.withColumn("row", _row_key()).join(small_enough(suspects), "row", "left_semi")
    there = texts.select("row", "doc_id", F.explode_outer(F.array_distinct(shingles(F.col("text"), k))).alias("shingle"))
    shared = there.join(within_bytes(wanted, F.lit(40)), "shingle").groupBy("row", "doc_id", "item_id", "q").agg(F.countDistinct("shingle").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("q") * percent).select("row", "doc_id", "item_id", "n_shared", F.col("q").alias("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; of rows with the same doc_id only those go whose own text contains one."""
    name = free_name(docs, "row")
    found = cut(_found(docs, items, k, percent).select(F.col("row").alias(name)).distinct())
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keyed.join(small_enough(found), name, "left_anti").select(*docs.columns)
