"""Steps that grow with the input: the same rows as plain forms of them, without the work that isn't needed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossmill import catalog
from glossmill.functions import locale as L
from glossmill.functions import text as T
from glossmill.operators import lint, ocr
from glossmill.plans import tables as P

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(parts, n=400, most=9, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_strip_takes_all_white_space(spark):
    parts = list(T.WHITE) + ["a", "b​", "ž", "\x1c", "᠎", "﻿", ""]
    rows = spark.createDataFrame([(t,) for t in texts(parts)], "c string").select(T.strip("c").alias("x"), F.regexp_replace("c", r"(?U)^\s+|\s+$", "").alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows]


def test_months_that_only_other_foldings_make_stay(spark):
    cases = {"5 MÄRZ, mar_x maj": "5 3, mar_x 5", "ſept": "ſept", "aMay okt": "a5 10", "x sep": "x 9", "jan": "1"}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", T.canon_locale("c").alias("x")).collect()
    assert {r.c: r.x for r in rows} == cases


def test_altered_fragments_are_those_of_all_patterns(spark):
    """Against the patterns taken one by one, without guards."""
    parts = ["KZ-1", "KZ", "OZ", "EKČP", "12.450,00 EUR", "EUR", "USD", "5. 3. 2024", "12-3/4", "XIV Kp 12/2020", "A1/B2", "a@b.si", "http://x.y/z", "OCR_ILLEGIBLE", " ", ", ", "Ž", "x", "-7A", "March 5, 2024", "12,450.00 EUR"]
    pairs = list(zip(texts(parts, seed=1), texts(parts, seed=2), strict=True))
    src, tgt = F.col("s"), F.col("t")
    every = F.concat(*[F.regexp_extract_all(src, F.lit(f"(?U){p}"), F.lit(0)) for p in T.VERBATIM])
    way = F.lit("sl-en")
    told = F.transform(every, lambda x: F.struct(x.alias("x"), L.localize(x, way).alias("w")))
    rows = spark.createDataFrame(pairs, "s string, t string").select("t", told.alias("told"), lint.altered(src, tgt, way).alias("x")).collect()

    def slow(told, t):
        kept = []
        for x, w in told:
            if x and not any(x in k for k, _ in kept):
                kept.append((x, w))
        return [x for x, w in kept if x not in t and (w == x or w not in t)]

    assert [r.x for r in rows] == [slow(r.told, r.t) for r in rows] and any(r.x for r in rows)


@pytest.mark.parametrize("check", [c for c in lint.ORDER if c != "INCON"])
def test_one_check_is_that_part_of_all(spark, check):
    pairs = P.pairs(spark, SF)
    alone = lint.row_findings(pairs, P.GLOSSARY, check)
    rest = lint.row_findings(pairs, P.GLOSSARY).filter(F.col("check") == check)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, rest.collect()))
    if check in ("EMPTY", "FAIL", "GLOSS"):
        assert not re.search("regexp|RLIKE", plan(catalog.queries()[f"lint_{check.lower()}"](spark, SF)))
    assert (check == "NUM") == ("gm_sn" in plan(alone))


def test_a_report_is_dealt_out_before_it_is_sorted(spark):
    found = lint.report(lint.row_findings(P.pairs(spark, SF), P.GLOSSARY))
    assert re.search(r"Sort .*\n(.*\n)*.*Rebalance", plan(found))
    rows = [(lint.ORDER.index(r.check), r.source) for r in found.collect()]
    assert rows == sorted(rows) and rows


def test_pages_in_rows_are_those_of_the_words(spark):
    """Also where doc_ids repeat or are null; without repeats nothing is shuffled."""
    rows = [(1, "OCR_ILLEGIBLE a bb ccc " * 9), (2, "x yy zzz " * 7), (2, "q " * 33), (None, "n o p"), (3, None), (4, " ")]
    for n in (len(rows), 2):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        found = ocr.page_lines(P.ocr_pages(docs, ocr.readable), "page")
        assert sorted(map(repr, found.collect())) == sorted(map(repr, ocr.lines(P.ocr_words(docs), ["page", "line"]).collect()))
        assert n > 2 or "Aggregate" not in plan(found)
