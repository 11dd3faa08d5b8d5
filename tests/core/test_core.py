"""Known values of single functions, properties, and every query against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from glossmill import catalog
from glossmill.functions import locale as L
from glossmill.functions import text as T
from glossmill.operators import language, memo, mentions, ocr, status
from glossmill.sources import readers, sinks
from glossmill.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first().x


def test_segments(spark):
    cases = {
        "Družba PRIMER d. o. o. je vložila pritožbo": 1,
        "Prvi stavek. Drugi stavek! Tretji?": 3,
        "Glej čl. 5 in odst. 3. Nato 12. 3. 2024 konec.": 1,
        "A. Novak je prišel. XII. poglavje": 2,
        "Vrstica ena\nvrstica dve. Konec leta 2024. Novo": 4,
        " \r\n ": 0,
    }
    for text, n in cases.items():
        assert len(one(spark, text, T.segment("c"))) == n, text
    assert one(spark, None, T.segment("c")) == []


def test_segments_keep_every_sign(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B.", "čl.", " ", "\n", "12.", ".", "!", "?", " ", "d. o. o.", "Ž"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", T.segment("c").alias("s")).collect()
    plain = lambda t: "".join(t.split())
    assert all(plain("".join(r.s)) == plain(r.c) for r in rows)


@pytest.mark.parametrize(
    "value,way,want",
    [
        ("5. 3. 2024", "sl-en", "March 5, 2024"), ("12.450,00 EUR", "sl-en", "12,450.00 EUR"), ("14:30", "sl-en", "2:30 p.m."), ("00:05", "sl-en", "12:05 a.m."),
        ("14.30", "sl-en", "14.30"), ("03/05/2024", "sl-en", "03/05/2024"), ("31. 2. 2024", "sl-en", "February 31, 2024"), ("32. 2. 2024", "sl-en", "32. 2. 2024"),
        ("March 5th, 2024", "en-sl", "5. marec 2024"), ("5 March 2024", "en-sl", "5. marec 2024"), ("2:30 p.m.", "en-sl", "14:30"), ("12:15 am", "en-sl", "00:15"),
        ("12,450.00 EUR", "en-sl", "12.450,00 EUR"), ("12,45,0", "en-sl", "12,45,0"), ("words", "sl-en", "words"), ("5. 3. 2024", "de-en", "5. 3. 2024"),
    ],
)
def test_localize(spark, value, way, want):
    assert one(spark, value, L.localize(F.col("c"), F.lit(way))) == want


def test_fix_numbers(spark):
    fix = lambda s, t, way: spark.createDataFrame([(s, t)], "s string, t string").select(L.fix_numbers(F.col("s"), F.col("t"), F.lit(way)).alias("x")).first().x
    assert fix("plača 12.450,00 in 5,10", "pays 12.450,00 and 5,10", "sl-en") == "pays 12,450.00 and 5.10"
    assert fix("Section 5.10", "Section 5.10", "en-sl") == "Section 5,10"
    assert fix("x 1,5", "y 2,5", "sl-en") == "y 2,5"


def test_numbers_and_differences(spark):
    assert one(spark, "5. marec 2024 ob 2:30 p.m. 0012", T.numbers("c")) == ["5", "3", "2024", "1430", "12"]
    assert one(spark, "0 00", T.numbers("c")) == ["0", "0"]
    assert one(spark, "", T.more_in(F.array(*map(F.lit, "aabc")), F.array(*map(F.lit, "abb")))) == ["a", "c"]


def test_settled_readings():
    assert ocr.settle(["1245000"], ["12450", "00"]) == (1, [], [])
    assert ocr.settle(["007", "5"], ["7", "6"]) == (1, ["5"], ["6"])
    assert ocr.settle(["1", "2"], ["1", "2"]) == (0, [], [])


def test_ocr_line_with_half_bad_words_is_marked(spark):
    words = [(1, 0, 90, "a"), (1, 1, 10, "b"), (1, 2, 90, "c"), (2, 0, 90, "a"), (2, 1, 90, "b"), (2, 2, 90, "c"), (2, 3, 1, "d"), (2, 4, 90, "e"), (2, 5, 90, "f")]
    rows = ocr.lines(spark.createDataFrame(words, "line int, word_ord int, conf int, word string"), ["line"]).collect()
    assert {r.line: r.line_text for r in rows} == {1: ocr.MARK, 2: f"a b c {ocr.MARK} e f"}


def test_cyrillic_texts_are_told_by_their_vocabulary(spark):
    letters = "абвгдежзик"
    word = [f"{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}" for i in range(400)]

    def text(known, n):  # so many of n distinct words are in the vocabulary, each stands twice
        return " ".join((word[:known] + word[200 : 200 + n - known]) * 2)

    texts = {1: text(25, 100), 2: text(50, 100), 3: text(20, 100), 4: text(19, 100), 5: text(0, 100), 6: text(20, 20), 7: text(25, 100) + " plain" * 30, 8: "ab cd " * 40, 9: "է" * 3 + " բգ" * 70}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    vocab = spark.createDataFrame([("hbs", w) for w in word[:100] + word[:5]] + [("hbs", "ab"), ("hbs", "cd"), ("bg", word[200])], "lang string, word string")
    disc = language.discriminative(vocab)
    found = {r.doc_id: (r.predicted, round(r.confidence, 9)) for r in language.detect(docs, disc, language.cyrillic_words(vocab)).collect()}
    known = round(3 * 25 / 101, 9)
    assert found == {1: ("hbs", 0.75), 2: ("hbs", 1.0), 3: ("hbs", 0.6), 4: ("unknown", 0.0), 5: ("unknown", 0.0), 6: ("unknown", 0.0), 7: ("hbs", known), 8: ("hbs", 0.75), 9: ("hy", 1.0)}
    without = {r.doc_id: r.predicted for r in language.detect(docs, disc).collect()}
    assert without == {**dict.fromkeys(range(1, 8), "unknown"), 8: "hbs", 9: "hy"}


def test_translation_falls_back_and_keeps_failures_apart(spark):
    assert memo.parse_batch("1. a\n2) b", 2) == ["a", "b"] and memo.parse_batch("1. a\n1. b", 2) is None and memo.parse_batch("1. a", 2) is None

    def client(text):
        if text.startswith("1. "):
            return "nonsense"
        if text == "bad":
            raise OSError
        return text.upper()

    rows = memo.translate(spark.createDataFrame([("1", "one"), ("2", "bad"), ("3", "x" * 300)], "key string, text string").coalesce(1), client, wait=0.0).collect()
    assert [(r.translation, r.stored) for r in rows] == [("ONE", True), (memo.FAILED + "bad", False), ("X" * 300, True)]

    def breaking(text):
        if "\n" in text:
            raise OSError("a batch")
        if text == "worse":
            raise ValueError("no client error")
        return text.upper()

    texts = ["one", None, "two", "worse", "3. numbered", "", "line\nbreak"]
    rows = memo.translate(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string").coalesce(1), breaking, wait=0.0).collect()
    assert [(r.translation, r.stored) for r in rows] == [("ONE", True), (None, False), ("TWO", True), (memo.FAILED + "worse", False), ("3. NUMBERED", True), (memo.FAILED, False), (memo.FAILED + "line\nbreak", False)]
    asked = spark.createDataFrame([("1", "a", "S"), ("2", "b", "S"), ("3", "c", "T")], "key string, text string, system string").coalesce(1)
    rows = memo.translate(asked, lambda system, text: "\n".join(f"{line}{system}" for line in text.split("\n")), wait=0.0).collect()
    assert [r.translation for r in rows] == ["aS", "bS", "cT"]


def test_citations_match_the_pattern_on_random_texts(spark):
    """Against Python's own engine, on texts of whole and broken citations."""
    rng = random.Random(7)
    parts = ["čl.", "člen", "členov", "odst.", "Ustave", "KZ-1", "KZ", "kz-12a", "ZPP", "ZPPX", "xZPP", "Uradni  list", "Ur. l.", "Ur.l.", "EKČP", "točka", " ", ", ", "-", "a", "\n", "5."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", T.citations("c").alias("x")).collect()
    fold = lambda x: (x.lower().replace("č", "c"), x)
    assert [r.x for r in rows] == [sorted({m[0] for m in re.finditer(T.CITATION, t, re.I)}, key=fold) for t in texts]


def test_first_mentions_match_brute_force_on_random_documents(spark):
    rng = random.Random(9)
    forms = [("AA b", "Court of One"), ("CC d", "Court of One in Two"), ("EE", "Ministry")]
    pick = ["Court of One", "Court of One in Two", "Ministry", "AA b (Court of One)", "Ministry (", "x", "then"]
    docs = {d: [" ".join(rng.choice(pick) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6))] for d in range(200)}

    def slow(segments):
        seen, out = set(), []
        for text in segments:
            here = {t for _, t in forms if t in text} - seen
            seen |= here
            for s, t in sorted(forms, key=lambda f: -len(f[1])):
                at = text.find(t)
                if t in here and at >= 0 and s not in text[max(0, at - len(s) - 5) : at] and not text[at : at + len(t) + 2].endswith("("):
                    text = f"{text[:at]}{s} ({t}){text[at + len(t):]}"
            out.append(text)
        return out

    rows = spark.createDataFrame([(d, i, t) for d, segments in docs.items() for i, t in enumerate(segments)], "doc_id long, seg_ord int, text string")
    found = {(r.doc_id, r.seg_ord): r.text for r in mentions.first_mentions(rows, forms).collect()}
    assert found == {(d, i): t for d, segments in docs.items() for i, t in enumerate(slow(segments))}


def test_months_and_times_match_brute_force(spark):
    rng = random.Random(13)
    parts = ["12:30 p.m.", "2:30 pm", "02:05 AM", "13:15 a. m.", "99:59 p.m", "12:00am", "March", "marec", "mar", "Märchen", "märz", "May5", "maja", " ", " ", ", ", "1", "x", "x_mar", "-jan-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(600)]
    number = {x: str(n) for n, names in T.MONTHS.items() for x in names.split()}

    def to24(m):
        h, late = int(m[1]), m[3].lower() == "p"
        return f"{(12 if late else 0) if h == 12 else h + 12 * late:02d}:{m[2]}"

    def slow(t):
        t = re.sub(r"\b(\d{1,2}):(\d{2})\s*([ap])\.?\s*m\.?", to24, t, flags=re.I)
        return re.sub(r"\b(" + "|".join(sorted(number, key=len, reverse=True)) + r")\b", lambda m: number[m[1].lower()], t, flags=re.I)

    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", T.canon_locale("c").alias("x")).collect()
    assert [(t, r.x) for t, r in zip(texts, rows, strict=True)] == [(t, slow(t)) for t in texts]


def test_similarity_has_the_known_values(spark):
    pages = spark.createDataFrame([(1, "abcd", "bcde"), (2, None, ""), (3, "A  b", "a b"), (4, "x", "y")], "page long, one string, two string")
    assert {r.page: r.ratio for r in ocr.similarity(pages, "page").collect()} == {1: 0.75, 2: 1.0, 3: 1.0, 4: 0.0}


def test_all_readers_give_one_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("text", encoding="utf-8")
    (tmp_path / "in" / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "in" / "c.exe").write_bytes(b"x")
    found = {r.path.rpartition("/")[2]: (r.text, r.method) for r in readers.extracted(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.txt": ("text", "text"), "b.docx": (None, "error: BadZipFile"), "c.exe": (None, "no-extractor")}
    (tmp_path / "i.tsv").write_text("Okrožno\tDistrict\tsl-en\t# note\n# all\nA\tB # cut\nOkrajno \t Local\tsl-en # x\n", encoding="utf-8")
    rows = readers.tab_table(spark, str(tmp_path / "i.tsv"), "source string, target string, pair string").collect()
    assert sorted(map(tuple, rows)) == [("Okrajno", "Local", "sl-en"), ("Okrožno", "District", "sl-en")]
    (tmp_path / "w.dic").write_bytes("3\n1984/A\nžaba\n".encode("iso-8859-2"))
    assert {r.word for r in readers.word_list(spark, str(tmp_path / "w.dic")).collect()} == {"1984", "žaba"}
    (tmp_path / "tsv").mkdir()
    row = "5\t1\t2\t3\t4\t6\t0\t0\t9\t9\t{}\t{}"
    (tmp_path / "tsv" / "p.tsv").write_text("\n".join(["\t".join(["level"] * 10 + ["conf", "text"]), row.format(91, "word"), row.format(-1, "no"), row.format(50, " "), "5\tshort"]))
    assert [(r.block, r.par, r.line, r.word_ord, r.conf, r.word) for r in readers.word_confidences(spark, str(tmp_path / "tsv")).collect()] == [(2, 3, 4, 6, 91.0, "word")]
    pages = spark.createDataFrame([(1, "<think>a\nb</think>x"), (2, None)], "page long, reply string")
    assert [tuple(r) for r in readers.second_readings(pages).collect()] == [(1, "x")]
    assert not readers.unmarked(pages.withColumnRenamed("reply", "text")).filter("has_confidence").count()


def test_readers_and_sinks(spark, tmp_path):
    root = tmp_path / "in"
    (root / "en").mkdir(parents=True)
    (root / "en" / "a.txt").write_text("One block\nof text.\n\nSecond block.", encoding="utf-8")
    (root / "en" / ".hidden.txt").write_text("x")
    (root / "en" / "b.bin").write_bytes(b"\xff")
    assert sorted(r.ext for r in readers.files(spark, str(root)).collect()) == [".bin", ".txt"]
    found = {r.path.rpartition("/")[2]: r for r in readers.labelled(spark, str(root)).collect()}
    assert found["a.txt"].lang == "en" and found["b.bin"].method == "no-extractor"
    blocks = readers.blocks(spark.createDataFrame([(1, found["a.txt"].text)], "doc_id long, text string")).collect()
    assert [b.block for b in blocks] == ["One block of text.", "Second block."]
    (tmp_path / "d.dic").write_text("2\nBeseda/A\nhiša\tx\n", encoding="utf-8")
    assert {r.word for r in readers.word_list(spark, str(tmp_path / "d.dic")).collect()} == {"beseda", "hiša"}
    assert readers.settings(['A="x y" # c', "B=1", "2C=3", "A=later"], {"B": "2"}) == {"A": "x y", "B": "2"}
    sinks.table(spark.createDataFrame([("a\tb", 1)], "s string, n int"), str(tmp_path / "out"))
    assert {x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().splitlines()} == {"s\tn", "a b\t1"}
    sinks.by_language(spark.createDataFrame([("en", "p1"), ("sl", "p2")], "lang string, path string"), str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").glob("lang=*")} == {"lang=en", "lang=sl"}
    sinks.counts_only(spark.createDataFrame([("files", 1200)], "name string, n long"), str(tmp_path / "sums"))
    assert [x for p in (tmp_path / "sums").glob("*.txt") for x in p.read_text().splitlines()] == [f"  {'files':<20} {'1,200':>9}"]
    sinks.manifest(spark.createDataFrame([("b", 0.5), ("a", 0.123)], "path string, confidence double"), str(tmp_path / "m"))
    assert [x for p in sorted((tmp_path / "m").glob("*.csv")) for x in p.read_text().splitlines() if x != "path\tconfidence"] == ["a\t0.12", "b\t0.50"]
    for _ in range(2):
        sinks.additions(spark.createDataFrame([("s", "t")], "source string, rendering string"), str(tmp_path / "more"))
    assert [x for p in (tmp_path / "more").glob("*.csv") for x in p.read_text().splitlines() if x != "source\ttarget\tnote"] == ["s\tt\tunreviewed"] * 2


def test_stream_upserts_keep_the_newest(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(40)], "key long, ts long, value string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "mem"), str(tmp_path / "cp"), ["key"], ["ts"]).awaitTermination(120)
    assert {r.value for r in ingest.current(spark, str(tmp_path / "mem"), ["key"], ["ts"]).collect()} == {f"v{i}" for i in range(35, 40)}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in map(lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in catalog.oracle_sql():
        columns = ", ".join(f'"{c}"' for c in got.columns)
        assert tidy(rows) == tidy(con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_run_scope_numbers_all_ranges(spark):
    disk = spark.createDataFrame([(f"f{i * 7919 % 9973:05d}",) for i in range(9000)], "id string")
    found = {r.id: (r.position, r.total) for r in status.scope(disk, disk.withColumn("lang", F.lit("de")), None).collect()}
    assert found == {x: (i + 1, 9000) for i, x in enumerate(sorted(found))} and len(found) == 9000
    assert status.scope(disk.limit(0), disk.withColumn("lang", F.lit("de")), "de").collect() == []
    assert status.scope(disk, disk.withColumn("lang", F.lit("de")), "sl").count() == 0
    assert status.scope(disk, disk.withColumn("lang", F.lit("de")), "sl", everything=True).count() == 9000
