"""Order, limits and totals of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copysift import config as C
from copysift.functions.measure import confidence_rank
from copysift.functions.text import top_folder
from copysift.operators.clusters import KEY


def order(by: str) -> list[Column]:
    """By severity, then removable lines, or by frequency, then severity; then larger ones, exact ones and by place, as clusters were kept."""
    first = [F.desc("frequency"), F.desc("severity")] if by == "frequency" else [F.desc("severity"), F.desc("removable_lines")]
    return [*first, F.desc("median_lines"), F.asc("place")]


def at_least(clusters: DataFrame, confidence: str) -> DataFrame:
    """Clusters at least so sure."""
    return clusters if confidence == "low" else clusters.where(confidence_rank(F.col("confidence")) >= C.CONFIDENCE.index(confidence))


def top(clusters: DataFrame, by: str, n: int) -> DataFrame:
    return clusters.orderBy(*order(by)).limit(n)


def summary(clusters: DataFrame, places: DataFrame) -> DataFrame:
    """One row: clusters_found, total_removable_lines, files_involved."""
    files = places.join(clusters.select(*KEY), KEY, "left_semi").agg(F.countDistinct("file").alias("files_involved"))
    totals = clusters.agg(F.count("*").alias("clusters_found"), F.coalesce(F.sum("removable_lines"), F.lit(0)).alias("total_removable_lines"))
    return totals.join(files)  # one row each


def by_confidence(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("confidence").agg(F.count("*").alias("clusters"))


def largest_folders(files: DataFrame, n: int = C.MAX_LISTED) -> DataFrame:
    """(folder, files): the top folders with most files; ties by name."""
    return files.groupBy(top_folder(F.col("file")).alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(n)
