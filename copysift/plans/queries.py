"""The registered queries: each operator on the driver's tables, and the same in SQL for DuckDB.

Whole documents stand for blocks (file = source/doc_id.txt). Queries of single index operators (look-ups, near pairs) take the
vectors of the embeddings table; the flagship computes a vector from every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copysift.config import Idiom
from copysift.frames import cut, spread
from copysift.functions import measure as M
from copysift.functions import text as X
from copysift.functions.embed import ProseEmbedder, prose_vectors
from copysift.operators import rank
from copysift.operators.blocks import extract_blocks, line_windows
from copysift.operators.idioms import suppression
from copysift.operators.lookup import perhaps_present
from copysift.operators.similar import confirmed_pairs, similar_pairs, stars
from copysift.plans.detect import PLACE, find_clusters
from copysift.sources.globs import glob_regex
from copysift.sources.store import latest, left_out, present
from copysift.streaming.index import to_read

BASE = 0.45


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, text, norm_hash, sig_lines, lines of whole documents; a table in few parts is dealt over all cores."""
    rows = spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", _file().alias("file"), "text", X.normal_lines(F.col("text")).alias("kept")).select("doc_id", "file", "text", X.short_hash(F.array_join("kept", "\n")).alias("norm_hash"), F.size("kept").alias("sig_lines"), F.size(F.split("text", "\n")).alias("lines"))


def norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "norm_hash", "sig_lines")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).groupBy("norm_hash").agg(F.count("*").alias("frequency"), M.median_lines(F.col("sig_lines")).alias("median_lines"), F.min("doc_id").alias("first_doc")).where("frequency > 1")
    return rows.withColumn("removable_lines", M.removable_lines(F.col("median_lines"), F.col("frequency"))).withColumn("severity", M.severity(F.col("median_lines"), F.col("frequency")))


def identical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("norm_hash", "frequency", "first_doc")


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("norm_hash", "frequency", "median_lines", "removable_lines", "severity")


def rank_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top(_groups(spark, sf_dir).withColumnRenamed("first_doc", "place"), "severity", 20).select("norm_hash", "severity", "removable_lines")


def rank_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top(_groups(spark, sf_dir).withColumnRenamed("first_doc", "place"), "frequency", 20).select("norm_hash", "frequency", "severity")


def _windows(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.inline(line_windows(F.lit(1), F.col("lines"), size)))


def line_windows_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 20)


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.preview(F.col("text")).alias("preview"))


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.without_comments("text"), 256).alias("stripped_sha"))


def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


def changed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detection: the index holds each user's last purchase, the listing each user's last event."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").cast("double").alias("mtime"), F.col("event_id").alias("size"), "event_type")
    last = latest(events, "file", F.col("mtime"), F.col("size"))
    known = latest(events.where("event_type = 'purchase'"), "file", F.col("mtime"), F.col("size"))
    state = known.select("file", "mtime", "size", F.lit(False).alias("dirty"), F.lit("").alias("content_hash"))
    return to_read(last.select("file", "mtime", "size"), state).select("file", "size", "old_size")


def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim"))
    return _documents(spark, sf_dir).select("doc_id", "norm_hash").join(vectors, "doc_id", "left")


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).groupBy("norm_hash").agg(F.min("doc_id").alias("doc_id"))
    return left_out(rows, _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def group_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up of few vectors among all: those of the first document of each group of copies."""
    wanted = cut(_groups(spark, sf_dir).select(F.col("first_doc").alias("vec_id")))
    rows = perhaps_present(_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), wanted, "vec_id")
    return present(rows, wanted, "vec_id").select("vec_id", "label", F.size("embedding").alias("dim"))


def retain_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_out(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), _table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "vec_id")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("norm_hash"), (F.coalesce("label", F.lit(0)) + 10).alias("sig_lines"), F.col("embedding").alias("vector"))
    return similar_pairs(rows, BASE)


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), M.rounded(F.col("similarity"), 6).alias("similarity"))


def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars over the near pairs of the embeddings; larger label means a larger block."""
    nodes = _table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("norm_hash"), (F.coalesce("label", F.lit(0)) + 10).alias("sig_lines"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("file"))
    none = F.lit(None).cast("int")
    nodes = nodes.select("*", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("block_start"), none.alias("block_end"))
    rows = stars(nodes, _near(spark, sf_dir).withColumn("alignment", F.lit(1.0)))
    return rows.select(F.col("seed").cast("long").alias("seed"), F.col("member").cast("long").alias("member"), M.rounded(F.col("similarity"), 6).alias("similarity"))


def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each document with the first document of its opening line."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.substring_index("text", "\n", 1).alias("opening"))
    firsts = docs.groupBy("opening").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("f"))
    rows = docs.join(firsts, "opening").where("f.doc_id < doc_id").select(F.col("f.doc_id").cast("string").alias("a"), F.col("doc_id").cast("string").alias("b"), F.lit(1.0).alias("similarity"))
    texts = docs.select(F.col("doc_id").cast("string").alias("norm_hash"), "text")
    return confirmed_pairs(rows, texts, 0.0).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), M.rounded(F.col("alignment"), 3).alias("alignment"))


def size_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block size how many documents have it, and how many are comparable with it."""
    sizes = _documents(spark, sf_dir).groupBy("sig_lines").agg(F.count("*").alias("docs"))
    # sizes within the tolerance lie in one band of the logarithm or in two neighbours
    band = F.floor(F.ln(F.greatest("sig_lines", F.lit(1))) / 0.371).cast("int")
    right = sizes.select(F.col("sig_lines").alias("other"), F.col("docs").alias("other_docs"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    rows = sizes.withColumn("band", band).join(right, "band").where(M.comparable(F.col("sig_lines"), F.col("other")))
    return rows.groupBy("sig_lines", "docs").agg(F.sum("other_docs").alias("comparable_docs"))


def threshold_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", M.rounded(M.threshold(F.col("lines"), F.col("lines"), BASE), 6).alias("threshold"), M.rounded(M.expected_similarity(F.col("lines")), 6).alias("expected"))


def confidence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of documents, taken as near copies, by size and by numbers derived from doc_id."""
    similarity, alignment = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0, F.pmod(F.col("doc_id") * 53, F.lit(101)) / 100.0
    kind = F.when(F.col("doc_id") % 10 == 0, "identical").otherwise("near-identical")
    return _documents(spark, sf_dir).select("doc_id", M.confidence(similarity, F.col("lines"), kind, alignment).alias("confidence"))


def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.by_confidence(confidence_case(spark, sf_dir))


def _line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: each distinct line with how many places and directories have it."""
    docs = spread(_table(spark, sf_dir, "documents")).select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.explode_outer(X.normal_lines(F.col("text"))).alias("line")).where("line is not null")
    folders = docs.groupBy("line", X.directory(F.col("file")).alias("folder")).agg(F.count("*").alias("n"))
    rows = folders.groupBy("line").agg(F.sum("n").alias("frequency"), F.count("*").cast("int").alias("directories"))
    return rows.where("frequency > 1").select(X.short_hash(F.col("line")).alias("norm_hash"), F.col("line").alias("preview"), "frequency", "directories", F.lit(1).alias("median_lines"))


def idiom_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    idiom = Idiom(ignore_patterns=("[Ll]icense", "(unclosed"))
    return _line_groups(spark, sf_dir).select("norm_hash", "frequency", suppression(idiom)["rule"].alias("rule"))


def dir_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_groups(spark, sf_dir).select("norm_hash", "directories")


def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.largest_folders(_documents(spark, sf_dir))


def _meeting(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs of windows (start_line, end_line) and (c, d) of a document that begin within ``size`` lines of each other, and some more.

    Windows meet by the stretch of ``size`` lines in which they begin, so a long text costs its number of windows and not its square.
    """
    stretch = F.floor(F.col("start_line") / size)
    right = right.toDF("doc_id", "c", "d").withColumn("stretch", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("c") / size) + k)))
    return left.withColumn("stretch", stretch).join(right, ["doc_id", "stretch"])


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window of 20 lines how many other windows of its document share a line with it."""
    windows = _windows(spark, sf_dir, 20)
    rows = _meeting(windows, windows, 20).where(M.overlapping(F.col("start_line"), F.col("end_line"), F.col("c"), F.col("d")) & (F.col("start_line") != F.col("c")))
    return rows.groupBy("doc_id", "start_line", "end_line").agg(F.count("*").alias("overlapping"))


def coverage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 lines that a window of 20 lines of the document covers by 80 % or more."""
    share = M.coverage(F.col("start_line"), F.col("end_line"), F.col("c"), F.col("d"))
    rows = _meeting(_windows(spark, sf_dir, 10), _windows(spark, sf_dir, 20), 20).where(share >= 0.8)
    return rows.groupBy("doc_id", "start_line", "end_line").agg(F.count("*").alias("covering"))


def paths_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(F.col("path").rlike(glob_regex("**")) & ~F.col("path").rlike(glob_regex("**/de/**")) & (F.col("path") != "")).select("page_id", "path", X.top_folder(F.col("path")).alias("folder"))


def page_structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block scanner on outlines of pages: each tag on a line of its own, with braces for what it holds."""
    outline = F.regexp_replace(F.regexp_replace(F.col("html"), "</[a-zA-Z0-9]+>", "\n}\n"), "<([a-zA-Z0-9]+)[^>]*>", "\n$1 {\n")
    files = spread(_table(spark, sf_dir, "pages")).select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"), outline.alias("content"))
    return extract_blocks(files, 3).select("file", "start_line", "end_line", "norm_hash", "sig_lines", "block_start", "block_end")


def turn_structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block scanner on turns as indented outlines: a turn holds its sentences, a sentence with commas its parts; blocks of more than 8 lines in windows."""
    clean = lambda x: F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))
    parts = lambda s: F.filter(F.transform(F.split(s, ","), clean), lambda p: p != "")
    indented = lambda p: F.concat(F.array(F.concat(F.lit("  "), p[0], F.when(F.size(p) > 1, ":").otherwise(""))), F.transform(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x: F.concat(F.lit("    "), x)))
    sentences = F.filter(F.transform(F.split("text", "[.?!\n]+"), parts), lambda p: F.size(p) > 0)
    head = F.concat_ws(" ", F.lit("turn"), "turn", F.concat("role", F.lit(":")))
    rows = spread(_table(spark, sf_dir, "conversations")).select(F.concat_ws("/", "conv_id", F.concat(F.col("turn").cast("string"), F.lit(".txt"))).alias("file"), F.array_join(F.concat(F.array(head), F.flatten(F.transform(sentences, indented))), "\n").alias("content"))
    return extract_blocks(rows, 3, 8).select("file", "start_line", "end_line", "norm_hash", "sig_lines", "block_start", "block_end")


def _outlines(docs: DataFrame) -> DataFrame:
    """(file, norm_hash, sig_lines, lines) of (file, text) in one pass over the texts, as _documents() has them; texts without a line are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0), batch.column(1), strict=True):
                if kept := X.lines_of(whole := text.as_py() or ""):
                    rows.append((file.as_py(), X.hash_of(kept), len(kept), whole.count("\n") + 1))
            files, hashes, sizes, lines = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "norm_hash": pa.array(hashes, pa.string()), "sig_lines": pa.array(sizes, pa.int32()), "lines": pa.array(lines, pa.int32())})

    return docs.select("file", "text").mapInArrow(run, "file string, norm_hash string, sig_lines int, lines int")


def _prose(docs: DataFrame) -> DataFrame:
    """(norm_hash, file, vector) of (file, text)."""
    size = ProseEmbedder().size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), X.AT_ONCE):
                some = batch.slice(at, X.AT_ONCE)
                texts = [text or "" for text in some.column(1).to_pylist()]
                flat = pa.array(prose_vectors(texts, size).ravel(), pa.float32())
                vectors = pa.ListArray.from_arrays(pa.array(range(0, size * len(texts) + 1, size), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([X.hash_of(X.lines_of(text)) for text in texts], pa.string()), some.column(0), vectors], ["norm_hash", "file", "vector"])

    return docs.select("file", "text").mapInArrow(run, "norm_hash string, file string, vector array<float>")


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis on all documents as blocks: exact and near clusters, containment, idioms; vectors are those of the whole texts.

    Texts are read once for hashes and sizes, once for the vectors of the first document of each hash, and for a few documents once more; they are never shuffled.
    """
    none = F.lit(None).cast("int")
    docs = _table(spark, sf_dir, "documents").select(_file().alias("file"), "text")
    placed = cut(_outlines(docs))
    blocks = placed.select("file", F.lit(1).alias("start_line"), F.col("lines").alias("end_line"), "norm_hash", "sig_lines", none.alias("block_start"), none.alias("block_end"))
    # texts with one normal form may differ in what parts words, so the vector is that of the first
    first = cut(placed.groupBy("norm_hash").agg(F.min("file").alias("file")).select("file"))
    vectors = _prose(perhaps_present(docs, first, "file")).groupBy("norm_hash").agg(F.min_by("vector", "file").alias("vector"))

    def texts(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted.select(*PLACE).distinct())
        rows = perhaps_present(docs, wanted, "file").select("file", F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "text")
        return rows.join(wanted, PLACE, "left_semi").groupBy(*PLACE).agg(F.min("text").alias("text"))

    rows = find_clusters(blocks, vectors, BASE, texts=texts).rows
    return rows.select("id", "frequency", "median_lines", "removable_lines", "severity", "similarity", "alignment", "match_type", "confidence", "preview", F.col("suppressed.rule").alias("rule"))


NAMES = [
    duplicate_clusters, norm_lines, identical_groups, cluster_stats, rank_severity, rank_frequency, line_windows_20, previews, strip_comments, dedupe_latest, changed_users,
    vector_lookup, group_vectors, missing_vectors, retain_only, orphan_vectors, near_pairs, greedy_groups, line_alignment, size_band_pairs, threshold_by_size, confidence_case, confidence_counts,
    idiom_case, dir_spread, folder_sizes, interval_overlap, coverage_containment, paths_in_scope, page_structure_blocks, turn_structure_blocks,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_DOCS = f"""
WITH cleaned AS (SELECT doc_id, coalesce(source, '') AS source, text,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> '') AS kept,
    len(string_split(text, chr(10))) AS lines FROM documents),
docs AS (SELECT doc_id, source, text, lines, len(kept) AS sig_lines, substr(sha256(array_to_string(kept, chr(10))), 1, 32) AS norm_hash FROM cleaned)"""
_GROUPS = _DOCS + """,
counted AS (SELECT norm_hash, count(*) AS frequency, CAST(floor(median(sig_lines) + 0.5) AS INT) AS median_lines, min(doc_id) AS first_doc FROM docs GROUP BY norm_hash HAVING count(*) > 1),
groups AS (SELECT *, median_lines * (frequency - 1) AS removable_lines,
    CASE WHEN median_lines <= 0 THEN 0.0 ELSE floor(pow(CAST(median_lines AS DOUBLE), 1.5) * log2(CAST(frequency AS DOUBLE)) * 100 + 0.5) / 100 END AS severity FROM counted)"""
_LINES = """
WITH lines AS (SELECT coalesce(source, '') AS folder, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '""" + _SPACE + """', ' ', 'g'))), lambda x: x <> '')) AS line FROM documents),
groups AS (SELECT substr(sha256(line), 1, 32) AS norm_hash, line, count(*) AS frequency, count(DISTINCT folder) AS directories FROM lines GROUP BY line HAVING count(*) > 1)"""


def _window_sql(size: int) -> str:
    step = size // 2
    return f"(SELECT doc_id, CAST(1 + k * {step} AS INT) AS start_line, CAST(least(1 + k * {step} + {size} - 1, lines) AS INT) AS end_line FROM (SELECT doc_id, lines, unnest(range(0, CAST(greatest(0, ceil((lines - {size}) / {step}.0)) AS BIGINT) + 1)) AS k FROM docs))"


_HELD = "CASE WHEN lines <= 25 THEN {low} WHEN lines >= 100 THEN {high} ELSE {low} + least(1.0, (lines - 25) / 75.0) * ({high} - {low}) END"
_CONFIDENCE = _DOCS + f""",
measured AS (SELECT doc_id, lines, ((doc_id * 37) % 101) / 100.0 AS similarity, ((doc_id * 53) % 101) / 100.0 AS alignment, {_HELD.format(low='0.2::DOUBLE', high='0.57::DOUBLE')} AS expected FROM docs),
levels AS (SELECT *, greatest(0, (CASE WHEN similarity::DOUBLE - expected >= 0.25 THEN 2 WHEN similarity::DOUBLE - expected >= 0.1 THEN 1 ELSE 0 END) - (CASE WHEN lines <= 8 THEN 1 ELSE 0 END)) AS level,
    CASE WHEN alignment >= 0.75 THEN 2 WHEN alignment >= 0.7 THEN 1 ELSE 0 END AS by_lines FROM measured),
judged AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'certain' ELSE (['low', 'moderate', 'high'])[least(level, by_lines) + 1] END AS confidence FROM levels)"""
_NEAR = """
WITH e AS (SELECT vec_id, coalesce(label, 0) + 10 AS n, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT l.vec_id AS a, r.vec_id AS b, list_dot_product(l.v, r.v) AS similarity FROM e l JOIN e r ON l.vec_id < r.vec_id AND least(l.n, r.n) / greatest(l.n, r.n)::DOUBLE >= 0.7)"""


#: A text without line comments; strings stay.
_STRIPPED = r"""regexp_replace(text, '("(?:\\[^\n]?|[^"\\\n])*"?|' || chr(39) || '(?:\\[^\n]?|[^' || chr(39) || '\\\n])*' || chr(39) || '?)|//[^\n]*|#[^\n]*', '\1', 'g')"""
#: Of {pairs} (a, b) and {texts} (k, text) the alignment of each pair: words of lines, how far back they were last used, and the common subsequence row by row.
_ALIGNED = f"""
used AS (SELECT k, string_split({_STRIPPED}, chr(10)) AS lines FROM texts WHERE k IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
worded AS (SELECT k, generate_subscripts(lines, 1) AS l, regexp_extract_all(unnest(lines), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+') AS words FROM used),
tokens AS (SELECT k, l, i, word, row_number() OVER (PARTITION BY k ORDER BY l, i) AS pos FROM (SELECT k, l, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM worded)),
reused AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY k, word ORDER BY pos), 0) AS back FROM tokens),
shaped AS (SELECT k, l, list(DISTINCT word) AS words, CASE WHEN max(back) > 0 THEN list(back ORDER BY pos) END AS shape FROM reused GROUP BY k, l),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l) AS n, count(*) OVER (PARTITION BY k) AS lines FROM shaped),
agree AS (SELECT a, b, x.n AS i, list(coalesce(x.shape = y.shape, false) OR len(list_intersect(x.words, y.words)) >= 0.5 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) ORDER BY y.n) AS same, least(any_value(x.lines), any_value(y.lines)) AS shorter
    FROM pairs JOIN numbered x ON x.k = a JOIN numbered y ON y.k = b GROUP BY a, b, x.n),
common AS (SELECT a, b, any_value(shorter) AS shorter, list_reduce(list(same ORDER BY i), lambda best, row: list_reduce(range(1, len(row) + 1), lambda acc, j: list_append(acc, greatest(acc[len(acc)], best[j + 1], CASE WHEN row[j] THEN best[j] + 1 ELSE 0 END)), [0::BIGINT]), list_resize([0::BIGINT], len(any_value(same)) + 1, 0)) AS best FROM agree GROUP BY a, b),
aligned AS (SELECT a, b, coalesce(best[len(best)] / shorter, 0.0)::DOUBLE AS alignment FROM pairs LEFT JOIN common USING (a, b))"""
#: Of {edges} (a, b) and {ranked} (k, i) the stars: one step for each node that has later neighbours.
_STARS = """
later AS (SELECT e.s, list(e.m) AS members, any_value(r.i) AS i FROM (SELECT CASE WHEN x.i < y.i THEN a ELSE b END AS s, CASE WHEN x.i < y.i THEN b ELSE a END AS m FROM edges JOIN ranked x ON x.k = a JOIN ranked y ON y.k = b) e JOIN ranked r ON r.k = e.s GROUP BY e.s),
steps AS (SELECT *, row_number() OVER (ORDER BY i) AS step FROM later),
walk(step, taken, seed, found) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, []::VARCHAR[] UNION ALL
    SELECT s.step, CASE WHEN list_contains(taken, s.s) THEN taken ELSE list_concat(taken, list_filter(members, lambda m: NOT list_contains(taken, m))) END,
        s.s, CASE WHEN list_contains(taken, s.s) THEN [] ELSE list_filter(members, lambda m: NOT list_contains(taken, m)) END FROM walk JOIN steps s ON s.step = walk.step + 1),
stars AS (SELECT seed, unnest(found) AS member FROM walk),
grouped AS (SELECT seed, member FROM stars UNION ALL SELECT DISTINCT seed, seed FROM stars)"""
_FLAG = _DOCS.replace("WITH cleaned", "WITH RECURSIVE cleaned") + f""",
blocks AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS file, source, text, lines, sig_lines, norm_hash FROM docs WHERE sig_lines > 0),
firsts AS (SELECT norm_hash AS k, arg_min(text, file) AS text, arg_min(sig_lines, file) AS n, arg_min(file, file) AS file, arg_min(lines, file) AS lines, count(*) AS copies FROM blocks GROUP BY norm_hash),
words AS (SELECT k, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM firsts),
bigrams AS (SELECT k, md5(unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS h FROM words),
signed AS (SELECT k, ('0x' || substr(h, 7, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT < 128 THEN 1 ELSE -1 END)::DOUBLE AS v FROM bigrams GROUP BY ALL),
vectors AS (SELECT k, bucket, (v / sqrt(sum(v * v) OVER (PARTITION BY k)))::FLOAT::DOUBLE AS v FROM signed),
cosines AS (SELECT x.k AS a, y.k AS b, least(1.0, sum(x.v * y.v)) AS similarity FROM vectors x JOIN vectors y ON x.bucket = y.bucket AND x.k < y.k GROUP BY ALL),
pairs AS (SELECT a, b, similarity FROM cosines JOIN firsts x ON x.k = a JOIN firsts y ON y.k = b WHERE least(x.n, y.n) / greatest(x.n, y.n)::DOUBLE >= 0.7
    AND similarity >= CASE WHEN least(x.n, y.n) <= 25 THEN 0.45 ELSE least(0.98, 0.45 + least(1.0, (least(x.n, y.n) - 25) / 75.0) * 0.35) END::DOUBLE),
texts AS (SELECT k, text FROM firsts),{_ALIGNED},
edges AS (SELECT a, b, similarity, alignment FROM pairs JOIN aligned USING (a, b) WHERE alignment >= 0.65),
ranked AS (SELECT k, row_number() OVER (ORDER BY n DESC, file, k) AS i FROM firsts),{_STARS},
near AS (SELECT seed, member, CASE WHEN seed = member THEN 1.0 ELSE similarity END AS similarity, CASE WHEN seed = member THEN 1.0 ELSE alignment END AS alignment FROM grouped LEFT JOIN edges ON least(seed, member) = a AND greatest(seed, member) = b),
members AS (SELECT true AS near, seed AS cluster, similarity, alignment, seed = member AS is_first, blocks.* FROM near JOIN blocks ON norm_hash = member
    UNION ALL SELECT false, k, 1.0, NULL, blocks.file = firsts.file, blocks.* FROM firsts JOIN blocks ON norm_hash = k WHERE copies > 1),
built AS (SELECT near, cluster, count(*) AS frequency, floor(median(sig_lines) + 0.5)::INT AS median_lines, floor(min(similarity) * 1000 + 0.5) / 1000 AS similarity, floor(min(alignment) * 1000 + 0.5) / 1000 AS alignment,
    min(file) FILTER (is_first) AS head, arg_min(text, file) FILTER (is_first) AS text, list(norm_hash) AS hashes, count(DISTINCT source) AS directories,
    substr(sha256(string_agg(file || ':1-' || lines, '|' ORDER BY file)), 1, 12) AS id FROM members GROUP BY near, cluster HAVING count(*) > 1),
kept AS (SELECT * FROM built e WHERE near OR NOT EXISTS (SELECT 1 FROM built o WHERE o.near AND list_contains(o.hashes, e.cluster) AND o.median_lines > e.median_lines)),
measured AS (SELECT *, {_HELD.replace('lines', 'median_lines').format(low='0.2::DOUBLE', high='0.57::DOUBLE')} AS expected FROM kept),
levels AS (SELECT *, greatest(0, (CASE WHEN similarity - expected >= 0.25 THEN 2 WHEN similarity - expected >= 0.1 THEN 1 ELSE 0 END) - (CASE WHEN median_lines <= 8 THEN 1 ELSE 0 END)) AS level, CASE WHEN alignment >= 0.75 THEN 2 WHEN alignment >= 0.7 THEN 1 ELSE 0 END AS by_lines FROM measured),
shown AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{{space}}|{{space}}$', '', 'g')), lambda x: x <> '')[1:2], ' ') AS line FROM levels)
SELECT id, frequency::INT AS frequency, median_lines, (median_lines * (frequency - 1))::INT AS removable_lines, floor(pow(median_lines::DOUBLE, 1.5) * log2(frequency::DOUBLE) * 100 + 0.5) / 100 AS severity, similarity, alignment,
    CASE WHEN near THEN 'near-identical' ELSE 'identical' END AS match_type, CASE WHEN near THEN (['low', 'moderate', 'high'])[least(level, by_lines) + 1] ELSE 'certain' END AS confidence,
    CASE WHEN length(line) > 120 THEN substr(line, 1, 120) || '...' ELSE line END AS preview,
    CASE WHEN median_lines <= 5 AND frequency >= 10 THEN 'small-and-frequent' WHEN median_lines <= 10 AND frequency >= 10 AND directories >= greatest(4.0, frequency * 0.8) THEN 'widespread-idiom' END AS rule FROM shown"""
_FLAG = _FLAG.replace("{space}", _SPACE)


#: Blocks by braces; the outlines have no line that introduces an indented body.
_STRINGS = r"""'"(?:\\[^\n]?|[^"\\\n])*"?|' || chr(39) || '(?:\\[^\n]?|[^' || chr(39) || '\\\n])*' || chr(39) || '?'"""
_CODE_LINE = _STRIPPED.replace("text,", "line,", 1).replace("#[^\\n]*', '\\1'", "#[^\\n]*|(^|' || '" + _SPACE.removesuffix('+') + "' || ')--[^\\n]*', '\\1\\2'")
_TURNS = r"""
WITH cleaned AS (SELECT conv_id || '/' || turn || '.txt' AS file, 'turn ' || turn || ' ' || role || ':' AS head,
    list_filter(list_transform(string_split_regex(text, '[.?!\n]+'), lambda s: list_filter(list_transform(string_split(s, ','), lambda p: trim(regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g'))), lambda p: p <> '')), lambda p: len(p) > 0) AS sentences FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
outlined AS (SELECT file, list_prepend({'indent': 0, 'line': head}, flatten(list_transform(sentences, lambda p: list_prepend({'indent': 2, 'line': p[1] || CASE WHEN len(p) > 1 THEN ':' ELSE '' END}, list_transform(p[2:], lambda x: {'indent': 4, 'line': x}))))) AS ls FROM cleaned),
lines AS (SELECT file, generate_subscripts(ls, 1) AS n, unnest(ls) AS l, len(ls) AS total FROM outlined),
whole AS (SELECT s.file, s.n AS a, coalesce(min(e.n) - 1, any_value(s.total)) AS z FROM (SELECT * FROM lines QUALIFY l.line LIKE '%:' AND lead(l.indent) OVER (PARTITION BY file ORDER BY n) > l.indent) s
    LEFT JOIN lines e ON e.file = s.file AND e.n > s.n AND e.l.indent <= s.l.indent GROUP BY s.file, s.n),
both_ AS (SELECT file, a, z, NULL AS block_start, NULL AS block_end, z AS ends, a AS begins FROM whole WHERE z - a + 1 BETWEEN 3 AND 8
    UNION ALL SELECT file, low, least(low + 7, z), a, z, z, a FROM (SELECT *, unnest(range(a, a + 4 * ceil((z - a - 7) / 4.0)::INT + 1, 4)) AS low FROM whole WHERE z - a + 1 > 8) WHERE least(low + 7, z) - low + 1 >= 3),
once AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY file, a, z ORDER BY ends, begins DESC) = 1)
SELECT file, a::INT AS start_line, z::INT AS end_line, substr(sha256(array_to_string(list_transform(ls[a:z], lambda l: l.line), chr(10))), 1, 32) AS norm_hash, (z - a + 1)::INT AS sig_lines, block_start::INT AS block_start, block_end::INT AS block_end FROM once JOIN outlined USING (file)"""


_BLOCKS = f"""
WITH lines AS (SELECT file, generate_subscripts(ls, 1) AS n, unnest(ls) AS line, len(ls) AS total FROM (SELECT page_id || '.html' AS file,
    string_split(regexp_replace(regexp_replace(html, '</[a-zA-Z0-9]+>', chr(10) || '}}' || chr(10), 'g'), '<([a-zA-Z0-9]+)[^>]*>', chr(10) || '\\1 {{' || chr(10), 'g'), chr(10)) AS ls FROM pages WHERE html <> '')),
code AS (SELECT *, {_CODE_LINE} AS kept FROM lines),
netted AS (SELECT *, trim(regexp_replace(kept, '{_SPACE}', ' ', 'g')) AS normal, replace(replace(replace(replace(regexp_replace(regexp_replace(kept, {_STRINGS}, '', 'g'), '[^{{}}]', '', 'g'), '{{}}', ''), '{{}}', ''), '{{}}', ''), '{{}}', '') AS braces FROM code),
nested AS (SELECT file, n, total, normal, opened, closed, sum(opened - closed) OVER (PARTITION BY file ORDER BY n) - opened AS depth FROM (SELECT *, length(replace(braces, '}}', '')) AS opened, length(replace(braces, '{{', '')) AS closed FROM netted)),
ended AS (SELECT o.file, o.n AS start_line, any_value(o.total) AS total, min(c.n) AS end_line FROM nested o LEFT JOIN nested c ON c.file = o.file AND c.n > o.n AND c.closed > 0 AND c.depth < o.depth + o.opened WHERE o.opened > 0 GROUP BY o.file, o.n),
whole AS (SELECT file, start_line, coalesce(end_line, total) AS end_line, end_line IS NULL AS open FROM ended),
page AS (SELECT file, list(normal ORDER BY n) AS normal FROM nested GROUP BY file),
sized AS (SELECT w.*, list_filter(normal[start_line:end_line], lambda x: x <> '') AS kept, NULL::BIGINT AS block_start, NULL::BIGINT AS block_end FROM whole w JOIN page USING (file)),
cut AS (SELECT file, a AS start_line, least(a + 119, end_line) AS end_line, open, list_filter(normal[a:least(a + 119, end_line)], lambda x: x <> '') AS kept, start_line AS block_start, end_line AS block_end
    FROM (SELECT *, unnest(range(start_line, start_line + 60 * (greatest(0, ceil((end_line - start_line - 119) / 60.0))::INT + 1), 60)) AS a FROM sized WHERE len(kept) > 120) JOIN page USING (file)),
both_ AS (SELECT * FROM sized WHERE len(kept) BETWEEN 3 AND 120 UNION ALL SELECT * FROM cut WHERE len(kept) >= 3)
SELECT file, start_line::INT AS start_line, end_line::INT AS end_line, substr(sha256(array_to_string(kept, chr(10))), 1, 32) AS norm_hash, len(kept)::INT AS sig_lines, block_start::INT AS block_start, block_end::INT AS block_end FROM both_
QUALIFY row_number() OVER (PARTITION BY file, start_line, end_line ORDER BY open, coalesce(block_end, end_line), coalesce(block_start, start_line) DESC) = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "duplicate_clusters": _FLAG,
        "page_structure_blocks": _BLOCKS,
        "turn_structure_blocks": _TURNS,
        "greedy_groups": _NEAR.replace("WITH e AS", "WITH RECURSIVE e AS") + f""",
            edges AS (SELECT lpad(a::VARCHAR, 12, '0') AS a, lpad(b::VARCHAR, 12, '0') AS b, similarity FROM pairs WHERE similarity >= {BASE}),
            ranked AS (SELECT lpad(vec_id::VARCHAR, 12, '0') AS k, row_number() OVER (ORDER BY coalesce(label, 0) DESC, lpad(vec_id::VARCHAR, 12, '0')) AS i FROM embeddings),{_STARS}
            SELECT seed::BIGINT AS seed, member::BIGINT AS member, CASE WHEN seed = member THEN 1.0 ELSE floor(similarity * 1000000 + 0.5) / 1000000 END AS similarity FROM grouped LEFT JOIN edges ON least(seed, member) = a AND greatest(seed, member) = b""",
        "line_alignment": f"""WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS opening FROM documents WHERE text IS NOT NULL),
            pairs AS (SELECT first::VARCHAR AS a, doc_id::VARCHAR AS b FROM d JOIN (SELECT opening, min(doc_id) AS first FROM d GROUP BY opening) USING (opening) WHERE first < doc_id),
            texts AS (SELECT doc_id::VARCHAR AS k, text FROM d),{_ALIGNED}
            SELECT a::BIGINT AS a, b::BIGINT AS b, floor(alignment * 1000 + 0.5) / 1000 AS alignment FROM aligned""",
        "norm_lines": _DOCS + " SELECT doc_id, norm_hash, sig_lines FROM docs",
        "identical_groups": _GROUPS + " SELECT norm_hash, frequency, first_doc FROM groups",
        "cluster_stats": _GROUPS + " SELECT norm_hash, frequency, median_lines, removable_lines, severity FROM groups",
        "rank_severity": _GROUPS + " SELECT norm_hash, severity, removable_lines FROM groups ORDER BY severity DESC, removable_lines DESC, median_lines DESC, first_doc LIMIT 20",
        "rank_frequency": _GROUPS + " SELECT norm_hash, frequency, severity FROM groups ORDER BY frequency DESC, severity DESC, median_lines DESC, first_doc LIMIT 20",
        "line_windows_20": _DOCS + f" SELECT * FROM {_window_sql(20)}",
        "previews": _DOCS + f""", shown AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda x: x <> '')[1:2], ' ') AS line FROM docs)
            SELECT doc_id, CASE WHEN length(line) > 120 THEN substr(line, 1, 120) || '...' ELSE line END AS preview FROM shown""",
        "strip_comments": r"""SELECT doc_id, sha256(regexp_replace(text, '("(?:\\[^\n]?|[^"\\\n])*"?|' || chr(39) || '(?:\\[^\n]?|[^' || chr(39) || '\\\n])*' || chr(39) || '?)|//[^\n]*|#[^\n]*', '\1', 'g')) AS stripped_sha FROM documents""",
        "dedupe_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "changed_users": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) = 1),
            s AS (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) = 1)
            SELECT CAST(l.user_id AS VARCHAR) AS file, l.event_id AS size, s.event_id AS old_size FROM l LEFT JOIN s USING (user_id)
            WHERE NOT coalesce(epoch_us(l.ts) = epoch_us(s.ts) AND l.event_id = s.event_id, false)""",
        "vector_lookup": _DOCS + " SELECT doc_id, norm_hash, len(embedding)::INT AS dim FROM docs LEFT JOIN embeddings ON vec_id = doc_id",
        "group_vectors": _GROUPS + " SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings WHERE vec_id IN (SELECT first_doc FROM groups)",
        "missing_vectors": _DOCS + " SELECT * FROM (SELECT norm_hash, min(doc_id) AS doc_id FROM docs GROUP BY norm_hash) d WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)",
        "retain_only": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "orphan_vectors": "SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)",
        "near_pairs": _NEAR + f" SELECT a, b, floor(similarity * 1000000 + 0.5) / 1000000 AS similarity FROM pairs WHERE similarity >= {BASE}",
        "size_band_pairs": _DOCS + """, sizes AS (SELECT sig_lines, count(*) AS docs FROM docs GROUP BY sig_lines)
            SELECT l.sig_lines, l.docs, sum(r.docs)::BIGINT AS comparable_docs FROM sizes l JOIN sizes r ON greatest(l.sig_lines, r.sig_lines) > 0 AND least(l.sig_lines, r.sig_lines) / greatest(l.sig_lines, r.sig_lines)::DOUBLE >= 0.7 GROUP BY ALL""",
        "threshold_by_size": _DOCS + f""" SELECT doc_id, floor((CASE WHEN lines <= 25 THEN {BASE}::DOUBLE ELSE least(0.98::DOUBLE, {BASE}::DOUBLE + least(1.0::DOUBLE, (lines - 25) / 75::DOUBLE) * 0.35::DOUBLE) END) * 1000000 + 0.5) / 1000000 AS threshold,
            floor(({_HELD.format(low='0.2::DOUBLE', high='0.57::DOUBLE')}) * 1000000 + 0.5) / 1000000 AS expected FROM docs""",
        "confidence_case": _CONFIDENCE + " SELECT doc_id, confidence FROM judged",
        "confidence_counts": _CONFIDENCE + " SELECT confidence, count(*) AS clusters FROM judged GROUP BY confidence",
        "idiom_case": _LINES + """ SELECT norm_hash, frequency, CASE WHEN regexp_matches(line, '[Ll]icense') THEN 'ignored-content' WHEN frequency >= 10 THEN 'small-and-frequent' END AS rule FROM groups""",
        "dir_spread": _LINES + " SELECT norm_hash, directories::INT AS directories FROM groups",
        "folder_sizes": "SELECT coalesce(source, '') AS folder, count(*) AS files FROM documents GROUP BY ALL ORDER BY files DESC, folder LIMIT 8",
        "interval_overlap": _DOCS + f", w AS {_window_sql(20)} SELECT l.doc_id, l.start_line, l.end_line, count(*) AS overlapping FROM w l JOIN w r ON l.doc_id = r.doc_id AND l.start_line <= r.end_line AND r.start_line <= l.end_line AND l.start_line <> r.start_line GROUP BY ALL",
        "coverage_containment": _DOCS + f", i AS {_window_sql(10)}, o AS {_window_sql(20)} SELECT i.doc_id, i.start_line, i.end_line, count(*) AS covering FROM i JOIN o ON i.doc_id = o.doc_id AND greatest(0, least(i.end_line, o.end_line) - greatest(i.start_line, o.start_line) + 1) / (i.end_line - i.start_line + 1)::DOUBLE >= 0.8 GROUP BY ALL",
        "paths_in_scope": """SELECT page_id, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages)
            WHERE path <> '' AND NOT regexp_matches(path, '^(?:[^/]+/)*de/.*$')""",
    }
