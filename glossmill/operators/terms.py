"""Terms with inconsistent renderings, mined from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """term, rendering, n: pairs that hold both. pairs: src, tgt; pairs whose sides are equal carry no terminology."""
    told = pairs.filter(T.strip("src") != T.strip("tgt"))
    terms = told.select(F.explode(T.phrases("src", T.SOURCE_STOP)).alias("term"), T.phrases("tgt", T.TARGET_STOP).alias("r"))
    return terms.select("term", F.explode("r").alias("rendering")).groupBy("term", "rendering").agg(F.count("*").alias("n"))


def candidates(pairs: DataFrame, known: list[str] = (), least: int = 3, pin_all: bool = False) -> DataFrame:
    """source, rendering, segments, conflict, also_seen, also_count: the leader of each term and its first rival that is not part of it."""
    told = pairs.filter(T.strip("src") != T.strip("tgt"))
    total = told.count()
    sizes = told.select(F.explode(T.phrases("src", T.SOURCE_STOP)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    sizes = sizes.filter((F.col("n") >= least) & ~F.col("term").isin(*[k.lower() for k in known]) if known else F.col("n") >= least)
    spread = told.select(F.explode(T.phrases("tgt", T.TARGET_STOP)).alias("rendering")).groupBy("rendering").agg(F.count("*").alias("df"))
    counted = cooccurrence(pairs).withColumnRenamed("n", "c").join(sizes, "term").join(spread, "rendering")
    # The leader, then the best that is no part of it, as two smallest values: no list of renderings is ever built.
    ranked = counted.withColumn("x", F.struct((-F.col("c")).alias("k"), "rendering", "df"))
    ranked = ranked.withColumn("first", F.min("x").over(Window.partitionBy("term")))
    apart = ~F.col("first.rendering").contains(F.col("rendering")) & ~F.col("rendering").contains(F.col("first.rendering"))
    out = ranked.groupBy("term", "n", "first").agg(F.min(F.when(apart, F.col("x"))).alias("o"))
    out = out.select("term", "n", F.col("first.rendering").alias("r1"), (-F.col("first.k")).alias("c1"), F.col("first.df").alias("df1"), "o")
    out = out.withColumn("c2", -F.col("o.k")).withColumn("r2", F.col("o.rendering"))
    n, c1, c2 = F.col("n"), F.col("c1"), F.col("c2")
    lift2, lift1 = (c2 / n) / F.greatest(F.col("o.df") / total, F.lit(1e-9)), (c1 / n) / F.greatest(F.col("df1") / total, F.lit(1e-9))
    conflict = F.coalesce((c1 < n) & (c2 >= F.greatest(F.lit(2.0), n * 0.25)) & (c1 + c2 >= n * 0.6) & (lift2 >= 2.0), F.lit(False))
    pinned = ~conflict & F.lit(pin_all) & (c1 >= n * 0.6) & (lift1 >= 2.0)
    same = F.arrays_overlap(F.split("term", " "), F.split("r1", " "))
    kept = out.withColumn("conflict", conflict).filter((F.col("conflict") | pinned) & ~same)
    return kept.select(F.col("term").alias("source"), F.col("r1").alias("rendering"), n.alias("segments"), "conflict", F.col("r2").alias("also_seen"), c2.alias("also_count"))


def shortest(found: DataFrame, top: int) -> DataFrame:
    """Of terms with one rendering, those that hold no term before them (by segments, then name); then the first so many.

    A term that holds one that was itself left out also holds the one that that holds, so that looking at all terms before it is enough. A
    term is a few words: all its parts are listed and looked up, and the terms of a rendering are never gathered.
    """
    parts = F.expr("array_distinct(flatten(transform(sequence(1, length(source)), i -> transform(sequence(1, length(source) - i + 1), n -> substring(source, i, n)))))")
    inside = found.select("rendering", F.col("source").alias("part"), F.col("segments").alias("part_segments"))
    held = found.select("source", "rendering", "segments", F.explode(parts).alias("part")).join(inside, ["rendering", "part"])
    before = (F.col("part_segments") > F.col("segments")) | ((F.col("part_segments") == F.col("segments")) & (F.col("part") < F.col("source")))
    return found.join(held.filter(before).select("source", "rendering").distinct(), ["source", "rendering"], "left_anti").orderBy(F.desc("segments"), "source", "rendering").limit(top)


def without_echoes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose sides differ, and the number of the others (n_echoes)."""
    echo = T.strip("src") == T.strip("tgt")
    return pairs.filter(~echo), pairs.agg(F.count_if(echo).alias("n_echoes"))
