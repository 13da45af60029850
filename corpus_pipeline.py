"""A corpus pipeline of five stages; each reads what the one before it wrote.

Stages: documents that the quality classifier rejects go; one document of each group of near duplicates stays;
documents that contain a benchmark item go; personal data and what gives it away are replaced in the
texts; the rest is mixed to target weights by source. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copysift.llm import decontam, minhash_dedup, mixing, pii, quality
from copysift.llm.frames import cut, new_folder, remove_folder, small_enough, table

#: Score from which a document is kept.
GOOD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of GOOD or more."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), GOOD)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of texts with a similarity of 0.8 or more on five-word shingles.

    Rows without words and rows with a null doc_id stay. Rows with the same doc_id are one document and stay or go together.
    """
    groups = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    gone = small_enough(cut(groups.where("not kept and doc_id is not null").select("doc_id").distinct()))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item (80 % of its five-word shingles)."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text replaced, and n_chars, where there is one, that of the new text."""
    rows = pii.sanitised(docs)
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document: its columns, size, source_size, target, shard, copy and words."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet to the shared folder and read again.

    What a stage has written is deleted once the next one has written its own; the last result stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
