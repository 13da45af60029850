"""Spelling variants: words that differ by one code point, found in bidirectional FM-indexes by search schemes for one error.

A word is halved (the second half has the odd code point). A word that differs from it by one insertion, deletion or replacement
has one half unchanged. So there are two searches, each in an index of one direction:

- from the end: the second half is matched exactly, then the first half backwards with one error;
- from the start: the same on reversed words: the first half is matched exactly, then the second with one error.

A search carries an interval of suffix ranks for each partial match and narrows it by one code point at a time (backward search), so its
time does not depend on the number of words. Words are delimited at both ends, so only whole words match, and the rank at
which a match ends tells the word. The two searches share no pair, and neither finds one twice: an edit that could be at several places of
a run of equal code points is made at the one nearest to the half that is matched exactly, and at the seam by the first search only.

Spark deals the work: a word is indexed and searched for in the groups of words that have the half of a query in common (a search
never leaves its group: each has a delimiter of its own), groups are dealt into tasks of bounded size, and the few groups that are
larger are split into a grid of pieces: each part of the queries meets each part of the words. Each search tells a word's
near words by count and by the most frequent one, so pairs are never written.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copysift.llm.frames import cut, small_enough

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A word counts as a form of another that is so many times as frequent.
FORM_RATIO = 10
#: Of crc32(doc_id:word), those that are multiples of this lose a code point.
SLIP = 31
#: Words in a task, about.
TASK_WORDS = 50_000
#: Searches that are worked on at once.
SEARCHES = 20_000


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points with ``count`` occurrences or more.

    A word is a maximal run of [A-Za-z\\u00C0-\\u00FF] with A-Z lower-cased. Of the runs of a document whose crc32(doc_id:run) 31 divides, the
    code point at that number modulo the length is left out. Null texts have none; a null doc_id is written "null".
    """
    letters = "[A-Za-zÀ-ÿ]"
    runs = F.regexp_extract_all("text", F.lit(f"{letters}{{{least},}}"), F.lit(0))  # greedy, so a run of enough letters is found whole
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = docs.where("text is not null").select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", upper, lower).alias("run"))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")).cast("binary"))
    words = words.withColumn("hash", hashed)
    at = F.pmod("hash", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = words.select(F.when(F.col("hash") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


class SuffixRanks:
    """A backward index of words, each with the number of its group: ranks of the suffixes of "<0> word <delimiter of the group>".

    ``step`` takes suffix-rank intervals to those of the suffixes one symbol longer. The symbols of all suffixes' predecessors, each with its
    rank, are kept sorted; the place of (symbol, rank) among them is the rank of the longer suffix, so one binary search is a step.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, groups: np.ndarray, letters: int) -> None:
        """codes: letters (from 1) of all words, one after the other; starts: where each begins, and the end; groups: from 0."""
        lengths = np.diff(starts)
        ends = np.cumsum(lengths + 2)  # behind the delimiter
        begins = ends - lengths - 2
        text = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        text[np.arange(len(codes)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1] = codes
        text[ends - 1] = letters + 1 + groups
        self.size, self.letters, self.first = len(text), letters, letters + 1
        order = self._sorted(text, np.repeat(ends, lengths + 2), int(lengths.max(initial=0)) + 2)
        ahead = np.roll(text, 1)
        ahead[begins] = text[ends - 1]  # each word is a circle of its own
        self.before = ahead[order]  # the symbol before each suffix, in order of rank
        self.keys = np.sort(self.before * (self.size + 1) + np.arange(self.size))
        self.row = np.searchsorted(begins, order[: len(lengths)])  # suffixes that begin with <0> come first

    @staticmethod
    def _sorted(text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """The places of all suffixes, each up to its word's delimiter, in order; equal ones in order of place. Prefixes are doubled until they are whole."""
        at, rank, span = np.arange(len(text)), text, 1
        while True:
            far = at + span
            further = np.where(far < ends, rank[np.minimum(far, len(text) - 1)] + 1, 0) if len(text) else rank
            order = np.lexsort((further, rank))
            changed = np.ones(len(text), bool)
            changed[1:] = (rank[order][1:] != rank[order][:-1]) | (further[order][1:] != further[order][:-1])
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(changed) - 1
            span *= 2
            if span >= longest or changed.all():
                return order

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, symbol * (self.size + 1) + low), np.searchsorted(self.keys, symbol * (self.size + 1) + high)

    def steps(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(of, letter, low, high): every interval with every letter that can be before it."""
        wide = high - low > self.letters
        of = [np.repeat(np.flatnonzero(wide), self.letters)]
        letter = [np.tile(np.arange(1, self.letters + 1), int(wide.sum()))]
        few = np.flatnonzero(~wide)
        width = (high - low)[few]
        inside = np.repeat(low[few] - np.cumsum(width) + width, width) + np.arange(width.sum())
        seen = np.unique(np.repeat(few, width) * (self.letters + 1) + np.where(self.before[inside] <= self.letters, self.before[inside], 0))
        seen = seen[seen % (self.letters + 1) > 0]
        of.append(seen // (self.letters + 1))
        letter.append(seen % (self.letters + 1))
        of, letter = np.concatenate(of), np.concatenate(letter)
        a, b = self.step(letter, low[of], high[of])
        found = a < b
        return of[found], letter[found], a[found], b[found]

    def near(self, words: np.ndarray, exact: int, groups: np.ndarray, seam: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that differ by one edit before the last ``exact`` letters. words: a row of letters (0 if in no indexed word) for each query, of one length.

        seam: whether edits right before the exact letters count that could as well be made in them.
        """
        query = np.arange(len(words))
        low, high = self.step(self.first + groups, np.zeros(len(words), np.int64), np.full(len(words), self.size))
        left = words.shape[1] - exact
        for i in range(words.shape[1] - 1, left - 1, -1):
            low, high = self.step(words[query, i], low, high)
            query, low, high = (x[low < high] for x in (query, low, high))
        wrong = (np.zeros(0, np.int64),) * 3  # (query, low, high) of matches with one error, up to the same letter
        for i in range(left, -1, -1):
            added = []
            here = lambda q: words[q, i - 1]  # noqa: B023, E731
            behind = words[query, i]  # the letter matched last
            of, letter, a, b = self.steps(low, high)
            if i:
                # matches with an error go on
                q, x, y = wrong
                x, y = self.step(here(q), x, y)
                added.append((q[x < y], x[x < y], y[x < y]))
                # another letter instead
                other = letter != here(query[of])
                added.append((query[of][other], a[other], b[other]))
                # no letter instead
                fresh = (here(query) != behind) | (seam and i == left)
                added.append((query[fresh], low[fresh], high[fresh]))
            # a letter more
            fresh = (letter != behind[of]) if i < left else np.full(len(of), seam)
            more = (query[of][fresh], a[fresh], b[fresh])
            if not i:
                wrong = tuple(np.concatenate(x) for x in zip(wrong, more, strict=True))
                break
            # it is before letter i, which is still to be matched
            q, x, y = more
            x, y = self.step(here(q), x, y)
            added.append((q[x < y], x[x < y], y[x < y]))
            wrong = tuple(np.concatenate(x) for x in zip(*added, strict=True))
            low, high = self.step(here(query), low, high)
            query, low, high = (x[low < high] for x in (query, low, high))
        q, x, y = wrong
        x, y = self.step(np.zeros(len(q), np.int64), x, y)
        q, x, y = q[x < y], x[x < y], y[x < y]
        width = y - x
        return np.repeat(q, width), self.row[np.repeat(x - np.cumsum(width) + width, width) + np.arange(width.sum())]


def _letters(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and where each begins (one more at the end)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(words.str.len().to_numpy(np.int64))])


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the queries of a task that have a near word. frame: side, word, n, half, spot, queried, indexed."""
    seam = frame["side"].iat[0] == 0
    frame = frame.assign(turned=frame["word"] if seam else frame["word"].str[::-1])
    tails = pd.Series([w[-h:] for w, h in zip(frame["turned"], frame["half"], strict=True)], index=frame.index)
    group = pd.factorize(tails + "|" + frame["spot"].astype(str))[0].astype(np.int64)
    points, starts = _letters(frame["turned"])
    alphabet = np.unique(points)
    codes = np.searchsorted(alphabet, points) + 1
    kept = frame["indexed"].to_numpy()
    lengths = np.diff(starts)
    index = SuffixRanks(codes[np.repeat(kept, lengths)], np.concatenate([[0], np.cumsum(lengths[kept])]), group[kept], len(alphabet))
    rows, words, counts = np.flatnonzero(kept), frame["word"].to_numpy(object), frame["n"].to_numpy(np.int64)
    asked = np.flatnonzero(frame["queried"].to_numpy())
    order = asked[np.argsort(lengths[asked], kind="stable")]
    out = []
    for length in np.unique(lengths[order]):
        same = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
        size = max(1, min(SEARCHES, (1 << 22) // int(length)))
        for some in np.split(same, range(size, len(same), size)):
            letters = codes[starts[some][:, None] + np.arange(length)]
            q, r = index.near(letters, int(frame["half"].to_numpy()[some[0]]), group[some], seam)
            q, r = some[q], rows[r]
            out.append(pd.DataFrame({"word": words[q], "n": counts[r], "near": words[r]}))
    found = pd.concat(out) if out else pd.DataFrame({"word": [], "n": [], "near": []})
    found = found.sort_values(["word", "n", "near"], ascending=[True, False, True], kind="stable")
    best = found.groupby("word", sort=False).agg(n_near=("n", "size"), form_n=("n", "first"), form=("near", "first")).reset_index()
    return best.astype({"word": object, "n_near": "int64", "form_n": "int64", "form": object})


def near_words(words: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) for each of the distinct (word, n) that has near words: how many, and n and name of the most frequent (the first, of equals).

    Words of one code point are not looked at. Every word is the query once in either direction, with the half that has to agree; as a near word may be a code point shorter or longer, it
    is indexed with each half that a query of such a length has.
    """
    length = F.length("word")
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = words.where(length >= 2).select("word", "n", sides.alias("side"))
    half = lambda n: F.when(F.col("side") == 0, F.ceil(n / 2)).otherwise(F.floor(n / 2)).cast("int")
    halves = F.array_distinct(F.filter(F.array(half(length), half(length - 1), half(length + 1)), lambda h: (h > 0) & (h <= length)))
    rows = rows.withColumn("half", F.explode(halves)).withColumn("queried", F.col("half") == half(length))
    shared = F.when(F.col("side") == 0, F.substring("word", length - F.col("half") + 1, F.col("half"))).otherwise(F.substring("word", F.lit(1), F.col("half")))
    rows = cut(rows.withColumn("key", F.xxhash64("side", "half", shared)))
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > task_words).select("key", F.ceil(F.col("size") / task_words).cast("int").alias("pieces"))
    rows = rows.join(small_enough(cut(large)), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), "pieces").cast("int"))
    # piece (i, j) of a large group has its i-th part of the words and its j-th part of the queries
    each = F.sequence(F.lit(0), F.col("pieces") - 1)
    as_word = F.transform(each, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), ((j == F.col("own")) & F.col("queried")).alias("queried"), F.lit(True).alias("indexed")))
    as_query = F.transform(F.filter(each, lambda i: F.col("queried") & (i != F.col("own"))), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("queried"), F.lit(False).alias("indexed")))
    rows = rows.select("side", "word", "n", "half", "key", F.inline(F.concat(as_word, as_query)))
    rows = cut(rows.withColumn("spot", F.xxhash64("key", "i", "j")).drop("key", "i", "j"))
    tasks = max(1, math.ceil(rows.count() / task_words))
    dealt = rows.withColumn("task", F.pmod("spot", F.lit(tasks)).cast("int"))
    found = dealt.groupBy("side", "task").applyInPandas(_search, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))  # strings are compared by their UTF-8 bytes, which is code-point order
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("form_n"), "first.form")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last word that forms lead to. They lead to ever more frequent words, so they end."""
    reached = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")))
    while reached.where("not done").limit(1).count():
        # each round doubles the length of the ways that have been followed
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("next_done"))
        joined = reached.join(further, "root", "left")
        reached = cut(joined.select("word", F.coalesce("next", "root").alias("root"), (F.col("done") | F.coalesce("next_done", F.lit(True))).alias("done")))
    return reached.select("word", "root")


def variants(docs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of vocabulary(docs); docs: doc_id, text, other columns are not looked at.

    form is the most frequent word (the first in code-point order, of equals) that differs by one code point, if it is at least ``ratio``
    times as frequent, else null, and form_n its n. root is where forms lead to. Repeated rows count as often as they are there; tables without words give no rows.
    """
    words = cut(vocabulary(docs))
    near = near_words(words)
    rows = words.join(near, "word", "left")
    better = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    rows = cut(rows.select("word", F.when(better, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("form_n")).alias("form_n")))
    roots = with_roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
