"""What is missing, stale, done or orphaned, and what a run would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """id, status. source: id, s_mtime; target: id, t_mtime."""
    both = source.join(target, "id", "full_outer")
    status = F.when(F.col("s_mtime").isNull(), "orphaned").when(F.col("t_mtime").isNull(), "missing").when(F.col("t_mtime") < F.col("s_mtime"), "stale").otherwise("done")
    return both.select("id", status.alias("status"))


def decide(source: DataFrame, written: DataFrame, model: str, version: str, supported: list[str]) -> DataFrame:
    """id, decision: unsupported, skip (newer than the source and of this model and version), redo, or do. source: id, ext, s_mtime; written: id, t_mtime, model, prompt_version."""
    same = (F.col("model") == model) & (F.col("prompt_version") == version)
    rule = F.when(~F.lower("ext").isin(*supported), "unsupported").when(F.col("t_mtime").isNull(), "do").when((F.col("t_mtime") > F.col("s_mtime")) & F.coalesce(same, F.lit(False)), "skip").otherwise("redo")
    return source.join(written, "id", "left").select("id", rule.alias("decision"))


#: Ranges that a run's ids are numbered in.
CUTS = 256
WORKERS = {".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".txt": "txt", ".pdf": "pdf"}


def dispatch(files: DataFrame) -> DataFrame:
    """id, worker: by the lower-case extension, or unsupported. files: id, ext."""
    worker = F.element_at(F.create_map(*[F.lit(x) for pair in WORKERS.items() for x in pair]), F.lower("ext"))
    return files.select("id", F.coalesce(worker, F.lit("unsupported")).alias("worker"))


def route(pdfs: DataFrame, words: int = 50) -> DataFrame:
    """id, origin, action: a cached text first, then enough native words without the font that OCR leaves. pdfs: id, cached, native_words, glyphless."""
    born = (F.col("native_words") >= words) & ~F.col("glyphless")
    origin = F.when(F.col("cached"), "cached").when(born, "born-digital").otherwise("needs-ocr")
    return pdfs.select("id", origin.alias("origin"), F.when(origin == "needs-ocr", "ocr").otherwise("read").alias("action"))


def scope(disk: DataFrame, manifest: DataFrame, lang: str | None, everything: bool = False) -> DataFrame:
    """id, position, total: the files of a run in order of id. The manifest's files of the language, or all on disk where it isn't asked. disk: id; manifest: id, lang.

    Ids fall into ranges between the cuts of a bounded sample; each range is numbered alone, from the counts of the ranges before it.
    """
    chosen = disk if everything or lang is None else disk.join(manifest.filter(F.col("lang") == lang).select("id"), "id", "left_semi")
    sample = sorted(r.id for r in chosen.filter("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").select("id").limit(CUTS * 16).collect())
    cuts = F.array(*map(F.lit, sorted(set(sample[::16])))) if sample else F.array(F.lit(None))
    ranged = chosen.select("id", F.size(F.filter(cuts, lambda c: c <= F.col("id"))).alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("id"))
    return ranged.withColumn("place", place).join(counts, "range").select("id", (F.col("start") + F.col("place")).alias("position"), "total")
