"""Legibility of read pages and the agreement of two readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

MARK, FLOOR = "OCR_ILLEGIBLE", 40


def readable(conf: Column, word: Column) -> Column:
    """The word, or null below the floor."""
    return F.when(conf >= FLOOR, word)


def line_text(words: Column) -> Column:
    """The text of a line of readable words in order: one mark for each run of null, or for the line, where at least half of it is null."""

    def of(ws: Column) -> Column:
        bad, text = F.size(ws) - F.size(F.array_compact(ws)), F.array_join(ws, " ", MARK)
        text = T.let(text, lambda t: F.when(t.contains(f"{MARK} {MARK}"), F.regexp_replace(t, f"(?<![^ ]){MARK}(?: {MARK}(?![^ ]))+", MARK)).otherwise(t))
        return F.when((bad > 0) & (bad >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2))), MARK).otherwise(text)

    return T.let(words, of)


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_text of a table of words, which are gathered by line. words: keys, word_ord, conf, word."""
    good = readable(F.col("conf"), F.col("word"))
    whole = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_ord", good.alias("w")))).alias("ws"))
    return whole.select(*keys, line_text(F.transform("ws", lambda x: x["w"])).alias("line_text"))


def page_lines(pages: DataFrame, page: str) -> DataFrame:
    """page, line, line_text as lines gives them, of whole pages, which needs no shuffle. pages: page, lines (of each line its readable words in order)."""
    return pages.select(page, F.posexplode(F.transform("lines", line_text)).alias("line", "line_text"))


def page_texts(pages: DataFrame, page: str, between: str = "\n", after: str = "") -> DataFrame:
    """page, text: the lines of each page in order. pages: page, lines, as above."""
    return pages.select(page, F.concat(F.array_join(F.transform("lines", line_text), between), F.lit(after)).alias("text"))


def rates(texts: DataFrame, key: str) -> DataFrame:
    """key, marks, words, pct, verdict: marks are counted as substrings, words between spaces; an empty text is 100 %."""
    marks, n = F.regexp_count("text", F.lit(MARK)), F.size(T.words("text"))
    pct = F.when(n == 0, 100.0).otherwise(100.0 * marks / n)
    verdict = F.when(pct >= 20, "STOP").when(pct >= 5, "look").otherwise("")
    return texts.select(key, marks.cast("long").alias("marks"), n.cast("long").alias("words"), pct.alias("pct"), verdict.alias("verdict"))


def profile(words: DataFrame, page: str) -> DataFrame:
    """Words, those under 40 and 40 to 60, low ones with a digit, and the share under 40 in per cent, of each page."""
    low = F.col("conf") < FLOOR
    found = words.groupBy(page).agg(F.count("*").alias("words"), F.count_if(low).alias("low"), F.count_if((F.col("conf") >= FLOOR) & (F.col("conf") < 60)).alias("middling"), F.count_if(low & F.col("word").rlike(r"\d")).alias("low_digits"))
    return found.withColumn("pct", 100.0 * F.col("low") / F.col("words"))


#: Fixed value: the letters that a reading of a page in these languages should hold.
DIACRITICS = "čšžćđČŠŽĆĐ"


def read_profile(pages: DataFrame, page: str) -> DataFrame:
    """Words, distinct numbers and letters with diacritics of each page's reading. pages: page, text."""
    numbers = F.array_distinct(T.number_sequence("text"))
    return pages.select(page, F.size(T.words("text")).cast("long").alias("words"), F.size(numbers).cast("long").alias("numbers"), T.count_of("text", f"[{DIACRITICS}]").alias("diacritics"))


def floored(rates_: DataFrame, key: str) -> DataFrame:
    """key, pct, verdict by whole per cent, rounded down, of pages with words. rates_: key, marks, words."""
    pct = F.floor(F.col("marks") * 100 / F.col("words")).cast("long")
    verdict = F.when(pct >= 20, "STOP").when(pct >= 5, "look").otherwise("proceed")
    return rates_.filter("words > 0").select(key, pct.alias("pct"), verdict.alias("verdict"))


def worst_first(rates_: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """The pages by falling rate, ties by falling key; the first so many, if a number is given."""
    ordered = rates_.orderBy(F.desc("pct"), F.desc(key))
    return ordered if top is None else ordered.limit(top)


def joined_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, text: the pages in order, with a blank line between, and a newline at the end. pages: doc, page, text."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "text"))).alias("ps"))
    return rows.select(doc, F.concat(F.array_join(F.transform("ps", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def agreement(pages: DataFrame, key: str) -> DataFrame:
    """Numbers that both readings have, and either alone. pages: key, one, two."""
    a, b = F.array_distinct(T.number_sequence("one")), F.array_distinct(T.number_sequence("two"))
    n = lambda x: F.size(x).cast("long")
    return pages.select(key, n(F.array_intersect(a, b)).alias("agreed"), n(F.array_except(a, b)).alias("only_one"), n(F.array_except(b, a)).alias("only_two"))


def settle(one: list[str], two: list[str]) -> tuple[int, list[str], list[str]]:
    """Numbers only written differently (split in two or three, or padded with zeros) leave both sides; the rest disagrees.

    A number alone on one side is a merge if two or three neighbours of the other reading, all alone on their side
    too, spell it; longer numbers go first, each part is used once.
    """
    alone = [set(one) - set(two), set(two) - set(one)]
    readings, pairs = (one, two), 0
    for side in (0, 1):
        mine, theirs, seq = alone[side], alone[1 - side], readings[1 - side]
        places: dict[str, list[list[str]]] = {}
        for k in (2, 3):
            for i in range(len(seq) - k + 1):
                places.setdefault("".join(seq[i : i + k]), []).append([i, *seq[i : i + k]])
        for whole in sorted(mine, key=lambda x: (-len(x), x)):
            fit = next((p[1:] for p in sorted(places.get(whole, ())) if whole in mine and theirs.issuperset(p[1:])), None)
            if fit:
                mine.discard(whole)
                theirs.difference_update(fit)
                pairs += 1
    by_value = {}
    for x in sorted(alone[1], reverse=True):
        by_value[x.lstrip("0")] = x
    for x in sorted(alone[0]):
        value = x.lstrip("0")
        if value and value in by_value:
            alone[0].discard(x)
            alone[1].discard(by_value.pop(value))
            pairs += 1
    return pairs, sorted(alone[0]), sorted(alone[1])


def reconcile(pages: DataFrame, key: str) -> DataFrame:
    """key, formatting, only_one, only_two. pages: key, one, two."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [settle(list(a), list(b)) for a, b in zip(pdf.one, pdf.two, strict=True)]
            yield pd.DataFrame({key: pdf[key], "formatting": [d[0] for d in done], "only_one": [",".join(d[1]) for d in done], "only_two": [",".join(d[2]) for d in done]})

    return pages.select(key, T.number_sequence("one").alias("one"), T.number_sequence("two").alias("two")).mapInPandas(run, f"{key} long, formatting long, only_one string, only_two string")


def similarity(pages: DataFrame, key: str) -> DataFrame:
    """key, ratio of matching blocks of the lower-case texts with single spaces. pages: key, one, two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        plain = lambda s: " ".join((s or "").lower().split())
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ratio": [SequenceMatcher(None, plain(a), plain(b)).ratio() for a, b in zip(pdf.one, pdf.two, strict=True)]})

    return pages.select(key, "one", "two").mapInPandas(run, f"{key} long, ratio double")
