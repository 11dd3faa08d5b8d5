"""The manifest: incremental merge with manual choices, volumes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SECONDS_PER_SEGMENT = 48.3


def merge(fresh: DataFrame, prior: DataFrame, accept: bool = False) -> DataFrame:
    """path, bytes, lang, method, proposal. Rows of equal size and time are reused; a manual language stays for ever; a recorded one stays and the change is proposed.

    fresh: path, bytes, mtime, lang, method; prior: the same.
    """
    old = prior.select("path", *[F.col(c).alias(f"o_{c}") for c in ("bytes", "mtime", "lang", "method")])
    both = fresh.join(old, "path", "left")
    reused = (F.col("bytes") == F.col("o_bytes")) & (F.col("mtime") == F.col("o_mtime")) & (F.col("o_method") != "not-yet-examined")
    differs = F.col("o_lang").isNotNull() & (F.col("o_lang") != F.col("lang"))
    lang = F.when((F.col("o_method") == "manual") | reused, F.col("o_lang")).when(differs & ~F.lit(accept), F.col("o_lang")).otherwise(F.col("lang"))
    method = F.when((F.col("o_method") == "manual") | reused, F.col("o_method")).otherwise(F.col("method"))
    proposal = F.when(differs & ~reused & (F.col("o_method") != "manual") & ~F.lit(accept), F.col("lang"))
    return both.select("path", "bytes", lang.alias("lang"), method.alias("method"), proposal.alias("proposal"))


def deferred(files: DataFrame, prior: DataFrame, limit: int) -> DataFrame:
    """Files after the first so many by path: as recorded, or not yet examined. Nothing is left out of the manifest."""
    cut = files.select("path").orderBy("path").limit(limit)
    later = files.join(cut, "path", "left_anti").join(prior.select("path", F.col("lang").alias("o_lang"), F.col("method").alias("o_method")), "path", "left")
    return later.select("path", F.coalesce("o_lang", F.lit("unknown")).alias("lang"), F.coalesce("o_method", F.lit("not-yet-examined")).alias("method"))


def volume(docs: DataFrame) -> DataFrame:
    """lang, files, words, segments, translatable. One scan; segments are never exploded."""
    s = T.segment("text")
    each = docs.select("lang", F.size(T.words("text")).alias("w"), s.alias("s"))
    each = each.select("lang", "w", F.size("s").alias("n"), F.size(F.filter("s", T.is_translatable)).alias("t"))
    return each.groupBy("lang").agg(F.count("*").alias("files"), F.sum("w").alias("words"), F.sum("n").alias("segments"), F.sum("t").alias("translatable"))


def estimate_seconds(segments: Column) -> Column:
    """Whole tenths of seconds, so that sums are exact."""
    return segments.cast("long") * int(SECONDS_PER_SEGMENT * 10)


def redundancy(cells: DataFrame, value: str) -> DataFrame:
    """total, distinct, translatable cells."""
    return cells.filter(T.is_translatable(value)).agg(F.count("*").alias("total"), F.count_distinct(value).alias("distinct_cells"))


def most_repeated(cells: DataFrame, value: str, top: int = 20) -> DataFrame:
    return cells.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(top)


def apply_to_cells(cells: DataFrame, mapping: DataFrame, value: str) -> DataFrame:
    """cells with tgt: the translation of each cell's value, or the value itself. mapping: src, tgt, one row for each src."""
    return cells.join(mapping.select(F.col("src").alias(value), "tgt"), value, "left").withColumn("tgt", F.coalesce("tgt", value))


def paths_by_language(files: DataFrame) -> DataFrame:
    """lang, path, in order: one row for each path, so that no language is gathered in one place. files: lang, path."""
    return files.select("lang", "path").orderBy("lang", "path")


def minutes_ratio(tally: DataFrame) -> DataFrame:
    """page_class, ratio, worth_it: mean minutes of corrected over those of fresh pages; from 1 on it isn't worth it. tally: page_class, kind (mt or scratch), minutes."""
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("minutes")))
    found = tally.groupBy("page_class").agg((mean("mt") / mean("scratch")).alias("ratio"))
    return found.select("page_class", "ratio", (F.col("ratio") < 1).alias("worth_it"))


def whole_manifest(fresh: DataFrame, prior: DataFrame, limit: int) -> DataFrame:
    """path, bytes, lang, method of every file after a run that looked at the first so many paths: what was looked at is merged, the rest stands as recorded."""
    cut = fresh.select("path").orderBy("path").limit(limit)
    looked = merge(fresh.join(cut, "path", "left_semi"), prior).select("path", "bytes", "lang", "method")
    return looked.unionByName(deferred(fresh, prior, limit).join(fresh.select("path", "bytes"), "path").select("path", "bytes", "lang", "method"))


def reusable(fresh: DataFrame, prior: DataFrame, counting: bool, rescan: bool = False) -> DataFrame:
    """path, reuse: whether the prior row can stand: equal size and time, examined, counted if this run counts, and no scan anew. prior has words, too."""
    old = prior.select("path", *[F.col(c).alias(f"o_{c}") for c in ("bytes", "mtime", "method", "words")])
    same = (F.col("bytes") == F.col("o_bytes")) & (F.col("mtime") == F.col("o_mtime")) & (F.col("o_method") != "not-yet-examined")
    counted = F.col("o_words").isNotNull() | F.lit(not counting)
    return fresh.join(old, "path", "left").select("path", (F.coalesce(same & counted, F.lit(False)) & F.lit(not rescan)).alias("reuse"))


def needing_ocr(manifest: DataFrame, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """The number of files without a text layer (n), and the first so many of them by path."""
    found = manifest.filter(F.col("method").contains("needs-ocr"))
    return found.agg(F.count("*").alias("n")), found.select("path", "method").orderBy("path").limit(shown)


def summary(manifest: DataFrame) -> DataFrame:
    """name, n: files, by language and by method. Counts alone, so that it can leave the place where the files are."""
    total = manifest.agg(F.lit("files").alias("name"), F.count("*").alias("n"))
    by = lambda c: manifest.groupBy(F.concat(F.lit(f"{c} "), F.col(c)).alias("name")).agg(F.count("*").alias("n"))
    return total.unionByName(by("lang")).unionByName(by("method"))


def project_counts(files: DataFrame, targets: DataFrame) -> DataFrame:
    """project, sources, translated: files and those with a target, of each project. files: project, id; targets: id."""
    done = files.join(targets.select("id").distinct().withColumn("done", F.lit(True)), "id", "left")
    return done.groupBy("project").agg(F.count("*").alias("sources"), F.count_if(F.coalesce("done", F.lit(False))).alias("translated"))


def untallied(classes: DataFrame, tally: DataFrame) -> DataFrame:
    """page_class of the template that no row of the tally has."""
    return classes.select("page_class").distinct().join(tally.select("page_class"), "page_class", "left_anti")
