"""How document filters interact: what each one removes in every order in which they may be applied.

1. One pass over the texts gives every document a mask, a bit for each filter that it fails. Documents with one text are told by
   its SHA-256: the smallest id of each text is found by a group-by that combines on the map side, and joined back by text and
   id, which are no hot key even where a third of all documents are copies. Texts themselves are never shuffled.
2. Documents are counted by part and mask: at most 2^filters cells for a part and a kind of label.
3. A recursive query extends filter prefixes by the letters not yet used, starting from the mask cells. Each row carries the bits
   applied so far; each level tells what its last filter does to the cell: keep it, remove it, or find it removed already. For five
   filters these are 325 prefixes and at most 32 cells, whatever the data.
4. The counts are joined with that by mask, and summed by part and prefix; every order takes the rows of its prefixes.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copysift.llm.frames import cut

SPACES, GAP = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
SHORT_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: Spark stops a recursive query at a million rows; for six filters there are 125,184 at most.
MOST_FILTERS = 6
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions on a single text by letter: A few words, B few distinct words, C many capitals, D signs. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, GAP)
    count = F.when(trimmed == "", 0).otherwise(F.size(words))
    return {
        "A": count < SHORT_WORDS,
        "B": (trimmed != "") & (100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * count),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], copies: str | None) -> DataFrame:
    """(part, mask, documents, good, toxic): how many documents of each part fail just the filters in mask, and how many of them are labelled so.

    The n-th letter, in order, is bit 2^n. ``copies`` is the letter that fails documents with the text of any smaller doc_id.
    """
    letters = sorted([*failures, *([copies] if copies else [])])
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    mask = F.lit(0)
    for letter, fails in failures.items():
        mask = mask + F.when(fails, bit[letter]).otherwise(0)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest")))
    one = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = rows.join(known, "doc_id", "left")
    if copies:
        first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        rows = rows.join(first, ["digest", "doc_id"], "left")
        later = F.col("doc_id").isNotNull() & F.col("first").isNull()
        rows = rows.withColumn("mask", F.col("mask") + F.when(later, bit[copies]).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("documents"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))


def fates(masks: DataFrame, letters: str) -> DataFrame:
    """(prefix, step, letter, mask, kept, removed, redundant, unique): what the last filter of each prefix does to each mask, as truth values.

    A prefix is a sequence of different letters, in the order in which they are applied; the n-th of ``letters`` is bit 2^n.
    """
    if len(letters) > MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"{MOST_FILTERS} different filters at most")
    return masks.sparkSession.sql(
        """
WITH RECURSIVE fates(prefix, step, letter, bit, before, applied, mask) AS (
    SELECT '', 0, '', 0, 0, 0, mask FROM {masks}
    UNION ALL
    SELECT concat(prefix, next), step + 1, next, 1 << nth, applied, applied | (1 << nth), mask
    FROM (SELECT prefix, step, applied, mask, posexplode(split({letters}, '')) AS (nth, next) FROM fates)
    WHERE applied & (1 << nth) = 0)
SELECT prefix, step, letter, mask, mask & applied = 0 AS kept, mask & before = 0 AND mask & bit <> 0 AS removed, mask & before <> 0 AND mask & bit <> 0 AS redundant, mask = bit AS unique
FROM fates WHERE step > 0""",
        masks=masks,
        letters=letters,
    )


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of all ``letters`` and step, from (part, mask, documents, good, toxic): see audited()."""
    counts = cut(counts)
    told = F.broadcast(cut(fates(counts.select("mask").distinct(), letters)))  # at most 2^n masks for each prefix of n letters
    total = lambda what, when: F.sum(F.when(F.col(when), F.col(what)).otherwise(0)).alias
    steps = counts.join(told, "mask").groupBy("part", "prefix", "letter").agg(
        total("documents", "kept")("kept"), total("documents", "removed")("removed"), total("documents", "redundant")("redundant"),
        total("documents", "unique")("unique_fails"), total("good", "removed")("good_lost"), total("toxic", "removed")("toxic_lost"),
    )
    # so many orders begin with a prefix: the filters behind it may come in any order
    behind = F.element_at(F.array(*[F.lit(math.factorial(n)) for n in range(len(letters))]), len(letters) - F.length("prefix") + 1)
    steps = cut(steps.withColumn("shapley", F.sum(F.col("removed") * behind).over(W.partitionBy("part", "letter"))))
    orders = [("".join(p)[:k], "".join(p), k) for p in permutations(letters) for k in range(1, len(letters) + 1)]
    orders = F.broadcast(counts.sparkSession.createDataFrame(orders, "prefix string, filter_order string, step int"))
    return steps.join(orders, "prefix").select("part", "filter_order", "step", F.col("letter").alias("filter"), *METRICS, "shapley")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not looked at. A part is a source; null is the empty name.
    Filters A to D are text_failures(), E fails documents with the text of any smaller doc_id of the table, where null and empty texts
    are one text. Repeated rows with one id and text are no copies of each other. A null doc_id is smaller than none and has none that is
    smaller, so it passes E; it has no labels. Where labels repeat an id, one label of 1 is enough. An empty table gives no rows.

    kept and removed are documents after and in this step; redundant ones fail its filter but are gone already; unique_fails fail no
    other filter; good_lost and toxic_lost are removed ones labelled so; shapley is what its filter removes, summed over all orders.
    """
    failures = text_failures(F.col("text"))
    return audit(cells(docs, labels, failures, "E"), "".join([*failures, "E"]))
