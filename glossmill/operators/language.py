"""Language by vocabulary evidence, with abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_TOKENS, LEAST_CONFIDENCE = 60, 0.30
#: The language that Cyrillic texts can be, and the least share of their distinct words in its Cyrillic vocabulary.
CYRILLIC_LANG, LEAST_CYRILLIC = "hbs", 0.20


def vocabulary(docs: DataFrame, least: int = 3, by: list[str] = ()) -> DataFrame:
    """lang, word (and the columns by) of words in at least so many texts of the language. docs: lang, text, by."""
    words = docs.select(*by, "lang", F.explode(F.array_distinct(T.tokens("text"))).alias("word"))
    return words.groupBy(*by, "lang", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*by, "lang", "word")


def joined(one: DataFrame, two: DataFrame, lang: str) -> DataFrame:
    """Two vocabularies as one of the language lang: the words of either, once each."""
    return one.select("word").union(two.select("word")).distinct().select(F.lit(lang).alias("lang"), "word")


def discriminative(vocab: DataFrame, by: list[str] = ()) -> DataFrame:
    """Words of one language alone (within the columns by)."""
    return vocab.groupBy(*by, "word").agg(F.min("lang").alias("lang"), F.count("*").alias("n")).filter("n = 1").select(*by, "word", "lang")


def cyrillic_words(vocab: DataFrame, by: list[str] = ()) -> DataFrame:
    """word of the Serbo-Croatian words in Cyrillic letters."""
    return vocab.filter(F.col("lang") == CYRILLIC_LANG).filter(F.col("word").rlike(r"[\u0400-\u04FF]")).select(*by, "word")


def detect(docs: DataFrame, disc: DataFrame, cyrillic: DataFrame | None = None, keep: list[str] = (), by: list[str] = ()) -> DataFrame:
    """doc_id, the columns keep, predicted, confidence. docs: doc_id, text, keep, by; disc: word, lang, by, for Latin texts; cyrillic: word, by, for
    Cyrillic texts, which are unknown without it. A text is scored with the words whose columns by equal its own. Scores are counts over the
    same distinct words, so ratios are exact. Every row of docs has its row, also if doc_ids repeat or are null."""
    toks = F.transform(F.array(T.tokens("text")), lambda t: F.struct(F.size(t).alias("n"), F.array_distinct(t).alias("u")))[0]
    base = docs.select(F.monotonically_increasing_id().alias("gm_n"), "doc_id", *keep, *by, toks.alias("t"), T.script("text").alias("script"), (T.count_of("text", "[ćĆđĐ]") >= 2).alias("halved"))
    known = disc.select(*by, "word", F.col("lang").alias("v_lang"), F.lit("latin").alias("script"))
    if cyrillic is not None:
        known = known.unionByName(cyrillic.select(*by, "word", F.lit(CYRILLIC_LANG).alias("v_lang"), F.lit("cyrillic").alias("script")).distinct())
    # One scan: a text that abstains or has no known word comes along as a row without a word.
    told = (F.col("t.n") >= LEAST_TOKENS) & F.col("script").isin("latin", "cyrillic")
    row = F.struct("gm_n", "doc_id", *keep, F.col("t.n").alias("n"), F.size("t.u").alias("m"), "script", "halved").alias("row")
    words = base.select(row, *by, "script", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(told, F.col("t.u")).otherwise(F.array().cast("array<string>")))).alias("word"))
    hits = words.join(known, [*by, "word", "script"], "left").filter("word IS NULL OR v_lang IS NOT NULL")
    scores = hits.groupBy("row", "v_lang").agg(F.count("*").alias("hits"))
    scores = scores.withColumn("s", F.col("hits") * F.when(F.col("row.halved") & (F.col("v_lang") == "sl"), 0.5).otherwise(1.0))
    found = F.when(F.col("v_lang").isNotNull(), F.struct((-F.col("s")).alias("k"), F.col("v_lang").alias("lang")))
    ranked = scores.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(found)), 1, 2).alias("r")).select("row.*", "r")  # one entry for each language
    best, second = -F.get(F.col("r"), F.lit(0))["k"], F.coalesce(-F.get(F.col("r"), F.lit(1))["k"], F.lit(0.0))
    rate = best / F.col("m")
    latin = F.least(F.lit(1.0), (best - second) / best * 2.5) * F.when(F.col("n") < 100, 0.75).otherwise(1.0)
    conf = F.when(F.col("script") != "cyrillic", latin).when(rate >= LEAST_CYRILLIC, F.least(F.lit(1.0), rate * 3))
    out = ranked.withColumn("conf", conf)
    lang = F.when(F.col("n") < LEAST_TOKENS, "unknown").when(F.col("script") == "armenian", "hy").when(F.col("conf") >= LEAST_CONFIDENCE, F.get(F.col("r"), F.lit(0))["lang"]).otherwise("unknown")
    sure = F.when(F.col("n") < LEAST_TOKENS, 0.0).when(F.col("script") == "armenian", 1.0).otherwise(F.coalesce("conf", F.lit(0.0)))
    return out.select("doc_id", *keep, lang.alias("predicted"), sure.alias("confidence"))


def confusion(told: DataFrame) -> DataFrame:
    """lang, predicted, n."""
    return told.groupBy("lang", "predicted").agg(F.count("*").alias("n"))


def accuracy(told: DataFrame, target: str) -> DataFrame:
    """answered, right, abstained, target recall and false targets, of rows with lang and predicted."""
    hit: Column = F.col("predicted") == F.col("lang")
    return told.agg(
        F.count_if(F.col("predicted") != "unknown").alias("answered"), F.count_if(hit).alias("right"), F.count_if(F.col("predicted") == "unknown").alias("abstained"),
        F.count_if(hit & (F.col("lang") == target)).alias("target_right"), F.count_if((F.col("predicted") == target) & (F.col("lang") != target)).alias("false_target"),
    )


def windows(docs: DataFrame, size: int, step: int) -> DataFrame:
    """doc_id, win, sample: runs of so many words."""
    w = T.words("text")

    def samples(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))

    cut = docs.select("doc_id", F.posexplode(T.let(w, samples)).alias("win", "sample"))
    return cut.select("doc_id", "win", "sample")


def first_only(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("n = 1").drop("n")


def marked(docs: DataFrame, key: str, markers: dict[str, list[str]]) -> DataFrame:
    """key, marked: the language with most non-overlapping hits of its markers, none if there is a tie or no hit."""
    text = F.lower("text")
    hits = [F.struct(sum((F.regexp_count(text, F.lit(r"\Q" + m + r"\E")) for m in found), F.lit(0)).alias("n"), F.lit(lang).alias("lang")) for lang, found in markers.items()]
    ranked = docs.select(key, F.sort_array(F.array(*hits), asc=False).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select(key, F.when((first["n"] > 0) & (second.isNull() | (first["n"] > second["n"])), first["lang"]).otherwise("none").alias("marked"))
