"""Removes repeated passages: sliding spans of consecutive sentences, hashed and joined over all documents.

A sentence ends with a word that ends in . ! or ?, with a line or with the text. Long ones are cut into pieces of ``LONGEST``
words, so that long passages without marks can be covered in part. A span is the shortest run of consecutive pieces, from each
piece on and up to each piece, that touches ``SENTENCES`` sentences and has ``WORDS`` words, or has more than ``PASSAGE`` words of a single one; so
a repeated passage is covered from its first whole piece to its last, and one repeated sentence of up to ``PASSAGE`` words alone is
none, be it cut or not. Of the occurrences of a span, the
one with the smallest (doc_id, text hash, place) is the first; pieces that any other occurrence covers are removed. Spans
are hashes of words and ignore the case of A-Z and white space.

A span that a third of all documents have is counted with partial aggregation, and its occurrences are joined
with one row. Per document only merged ranges of sentences remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copysift.llm.frames import cut, free_name, within_bytes
from copysift.llm.words import BASE, U64, _powers, buffers, mix, portions, word_hashes, word_spans

SENTENCES, WORDS, LONGEST, PASSAGE = 2, 15, 30, 50

_ends_sentence = np.zeros(256, bool)
_ends_sentence[[ord(c) for c in ".!?"]] = True
_tables: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = _powers(BASE, max(n, 1 << 20)), _powers(pow(BASE, -1, 1 << 64), max(n, 1 << 20))
    return _tables["up"][:n], _tables["down"][:n]


def sentences(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends of words, index of each piece's first word, index of each text's first piece, sentence of each piece); the third and fourth have one more entry."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = _ends_sentence[data[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    full = np.flatnonzero(np.diff(first) > 0)
    last[first[full + 1] - 1] = True
    begins = np.concatenate([[0], np.flatnonzero(last) + 1])
    whole = begins[:-1]
    within = np.arange(len(starts)) - np.repeat(whole, np.diff(begins))
    last |= within % longest == longest - 1
    begins = np.concatenate([[0], np.flatnonzero(last) + 1])
    return starts, ends, begins, np.searchsorted(begins[:-1], first), np.searchsorted(whole, begins[:-1], "right") - 1


def spans(begins: np.ndarray, texts: np.ndarray, sentence: np.ndarray, several: int = SENTENCES, least: int = WORDS, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [s, e) of pieces of all spans, from the results of sentences()."""
    n = len(begins) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(texts)
    low, high = np.repeat(texts[:-1], size), np.repeat(texts[1:], size)
    at = np.arange(n)
    # behind the first piece of the sentence that makes them several, and on the last piece of the one before; no text or table has these where they are out of range
    touched = np.minimum(np.searchsorted(sentence, sentence + several - 1) + 1, n + 1)
    touching = np.searchsorted(sentence, sentence - several + 1, "right") - 1
    touched = np.minimum(touched, np.searchsorted(begins, begins[:-1] + passage + 1))
    touching = np.maximum(touching, np.searchsorted(begins, begins[1:] - passage - 1, "right") - 1)
    onward = np.maximum(np.searchsorted(begins, begins[:-1] + least), touched)
    back = np.minimum(np.searchsorted(begins, begins[1:] - least, "right") - 1, touching)
    a, b = onward <= high, back >= low
    both = np.unique(np.concatenate([at[a] * (n + 1) + onward[a], back[b] * (n + 1) + at[b] + 1]))
    return both // (n + 1), both % (n + 1)


def _occurrences(docs: DataFrame, several: int, least: int) -> DataFrame:
    """(span, doc, version, begin, until): every span of every text, with its sentence range in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                data, offsets = buffers(part.column("text"))
                starts, ends, begins, texts, sentence = sentences(data, offsets)
                s, e = spans(begins, texts, sentence, several, least)
                up, down = _power(len(starts) + 1)
                total = np.zeros(len(starts) + 1, U64)
                np.cumsum(word_hashes(data, starts, ends) * up[: len(starts)], dtype=U64, out=total[1:])
                hashes = mix((total[begins[e]] - total[begins[s]]) * down[begins[s]] + (begins[e] - begins[s]).astype(U64))
                of = pa.array(np.searchsorted(texts, s, "right") - 1)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), part.column("doc").take(of), part.column("version").take(of), pa.array((s - texts[of]).astype(np.int32)), pa.array((e - texts[of]).astype(np.int32))],
                    names=["span", "doc", "version", "begin", "until"],
                )
                for at in range(0, rows.num_rows, 50_000):
                    yield rows.slice(at, 50_000)

    return docs.select("doc", "version", "text").mapInArrow(run, "span long, doc long, version long, begin int, until int")


def repeated_ranges(docs: DataFrame, several: int, least: int) -> DataFrame:
    """(doc, version, ranges, firsts): merged sentence ranges that non-first occurrences cover, and the documents with the first ones. docs: doc, version, text."""
    found = _occurrences(docs, several, least)
    counted = found.groupBy("span").agg(F.count("*").alias("times"), F.min("doc").alias("first_doc")).where("times > 1")
    # counts are cut before each join: both sides are then plain shuffles, of which Spark splits a hot span's partition
    again = cut(found.join(cut(counted.select("span", "first_doc")), "span"))
    first = cut(again.where("doc = first_doc").groupBy("span").agg(F.min(F.struct("version", "begin")).alias("first")).select("span", "first.*").toDF("span", "first_version", "first_begin"))
    later = again.join(first, "span").where("doc != first_doc or version != first_version or begin != first_begin")
    # exact copies make a range for each sentence: partial sets by begin keep the longest only
    longest = later.groupBy("doc", "version", "begin").agg(F.max("until").alias("until"), F.min("first_doc").alias("first_doc"))
    rows = longest.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("begin", "until"))).alias("all"), F.array_sort(F.collect_set("first_doc")).alias("firsts"))

    def merge(state, r):
        one = F.array(F.struct(state["begin"].alias("begin"), state["until"].alias("until")))
        apart = r["begin"] > state["until"]
        return F.struct(F.when(apart, r["begin"]).otherwise(state["begin"]).alias("begin"), F.greatest(state["until"], r["until"]).alias("until"), F.when(apart, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.col("all")[0]["begin"].alias("begin"), F.col("all")[0]["until"].alias("until"), F.array().cast("array<struct<begin:int,until:int>>").alias("out"))
    merged = F.aggregate("all", zero, merge, lambda s: F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["until"].alias("until")))))
    return rows.select("doc", "version", merged.alias("ranges"), "firsts")


#: Stands for a null doc_id, so that such rows come last.
NO_ID = (1 << 63) - 1


def without_repeats(docs: DataFrame, several: int = SENTENCES, least: int = WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` freed of repeated sentences, and n_sentences, n_removed (both count pieces), removed and first_docs.

    removed lists code-point ranges "start-end" of the old text, comma-joined; first_docs the doc_ids that keep the
    passages (null for one without an id). Texts without words, null or of one sentence stay as they are. A document is a
    doc_id and a text: rows that are equal in both lose the same sentences, rows with the same doc_id and different
    texts, or without a doc_id, are documents of their own. Rows without a doc_id come after all others, so they keep a
    passage only if no row with an id has it. Columns called as the four results are replaced, all others kept. An empty table gives no rows.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed", "first_docs")
    columns = docs.columns
    doc, version, ranges, firsts = (free_name(docs, c) for c in ("doc", "version", "ranges", "firsts"))
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(version, F.xxhash64("text"))
    found = cut(repeated_ranges(keyed.select(F.col(doc).alias("doc"), F.col(version).alias("version"), "text"), several, least))
    found = within_bytes(found, 64 + 16 * F.size("ranges") + 8 * F.size("firsts")).toDF(doc, version, ranges, firsts)
    rows = keyed.join(found, [doc, version], "left").select(*columns, ranges, F.transform(firsts, lambda d: F.nullif(d, F.lit(NO_ID))).alias(firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                data, offsets = buffers(part.column("text"))
                starts, _, begins, texts, _ = sentences(data, offsets)
                raw = data.tobytes()
                old, new, gone, told = part.column("text").to_pylist(), [], [], []
                for i, given in enumerate(part.column(ranges).to_pylist()):
                    low, at, n, places, pieces, chars = texts[i], int(offsets[i]), 0, [], [], 0
                    for r in given or ():
                        s, e = low + r["begin"], low + r["until"]
                        a = int(starts[begins[s]])
                        b = int(starts[begins[e]]) if e < texts[i + 1] else int(offsets[i + 1])
                        piece, lost = raw[at:a], raw[a:b].decode("utf-8", "replace")
                        chars += len(piece.decode("utf-8", "replace"))
                        places.append(f"{chars}-{chars + len(lost)}")
                        chars, at, n = chars + len(lost), b, n + int(e - s)
                        pieces.append(piece)
                    new.append(old[i] if not places else (b"".join(pieces) + raw[at : int(offsets[i + 1])]).decode("utf-8", "replace"))
                    gone.append(n)
                    told.append(",".join(places))
                out = {c: part.column(c) for c in columns} | {"text": pa.array(new, part.column("text").type)}
                out |= {"n_sentences": pa.array(np.diff(texts).astype(np.int64)), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(told, pa.string()), "first_docs": part.column(firsts)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = "n_sentences long, n_removed long, removed string, first_docs array<long>"
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields]))
