"""Sinks: manifest, paths by language, reports, glossary additions, sanitised so that a value never breaks a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated with a header."""
    df.select(*[T.sanitise(F.col(c).cast("string")).alias(c) for c in df.columns]).write.mode(mode).csv(path, sep="\t", header=True, quote="\u0000")


def manifest(df: DataFrame, path: str) -> None:
    table(df.withColumn("confidence", F.format_string("%.2f", "confidence")).orderBy("path"), path)


def by_language(df: DataFrame, path: str) -> None:
    """Paths in order, in a folder for each language; a language of many paths has several files, also in order."""
    df.select("lang", "path").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").write.mode("overwrite").partitionBy("lang").text(path)


def bilingual(pairs: DataFrame) -> DataFrame:
    """doc_id, ord, side, text: source and target lines in turn."""
    side = F.posexplode(F.array("src", "tgt")).alias("side", "text")
    return pairs.select("doc_id", "ord", side)


def additions(df: DataFrame, path: str) -> None:
    """Append proposed terms, marked as unreviewed."""
    table(df.select("source", F.col("rendering").alias("target"), F.lit("unreviewed").alias("note")), path, "append")


def counts_only(df: DataFrame, path: str) -> None:
    """Lines of name and number, without any path or text of a file. df: name, n."""
    df.select(F.format_string("  %-20s %,9d", "name", "n").alias("line")).coalesce(1).write.mode("overwrite").text(path)


def read_pages(df: DataFrame, path: str) -> None:
    """The text of each document, its pages with a blank line between, in a folder for each. df: doc_id, text."""
    df.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(path, lineSep="\n")
