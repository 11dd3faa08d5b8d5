"""Sources: file trees, texts, word lists, tables of terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import office

READABLE = [".txt", ".md", ".csv", ".tsv", ".log"]


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, ext, bytes, mtime of all files below root, hidden and lock files left out; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.filter(~name.rlike(r"^(~\$|\.)")).select("path", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path, text, method: UTF-8 with replacement; files of other kinds have no extractor."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = ext.isin(*READABLE)
    return found.select("path", F.when(known, F.decode("content", "UTF-8")).alias("text"), F.when(known, "text").otherwise("no-extractor").alias("method"))


def extracted(spark: SparkSession, root: str) -> DataFrame:
    """path, text, method of every file below root, each by the reader of its extension; a file that can't be read has no text and the method error: <Type>.

    text for text files, docx and xlsx for office files, no-extractor for all others."""
    found = files(spark, root).select("path", "ext")
    read = texts(spark, root).filter("method = 'text'").select("path", "text", "method")
    read = read.unionByName(office.texts(office.office_files(spark, root, ".docx", ".xlsx", ".xlsm")).select("path", "text", "method"))
    return found.join(read, "path", "left").select("path", "text", F.coalesce("method", F.lit("no-extractor")).alias("method"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_ord, block: parts between blank lines, on one line each."""
    cut = F.transform(F.split("text", r"\n\s*\n"), lambda b: T.strip(F.translate(b, "\n", " ")))
    return docs.select("doc_id", F.posexplode(F.filter(cut, lambda b: b != "")).alias("block_ord", "block"))


def block_units(docs: DataFrame) -> DataFrame:
    """doc_id, block_ord, unit_ord, unit: the segments of each block; a block without any is a unit itself."""
    units = T.let(T.segment("block"), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array("block")))
    return blocks(docs).select("doc_id", "block_ord", F.posexplode(units).alias("unit_ord", "unit"))


def word_list(spark: SparkSession, path: str, encoding: str | None = None, fallback: str = "ISO-8859-2") -> DataFrame:
    """Words of a dictionary file: line 1, which counts them, and the flags after a slash or tab are left out. Without an encoding the file is
    UTF-8 or, if it isn't valid as that, in the fallback."""

    def decoded(contents: pd.Series) -> pd.Series:
        """Spark itself knows few encodings."""

        def one(content: bytes) -> str:
            try:
                return content.decode(encoding or "utf-8")
            except UnicodeDecodeError:
                return content.decode(fallback, "replace")

        return contents.map(one)

    lines = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.pandas_udf(decoded, "string")("content"), "\r?\n")).alias("n", "line"))
    word = F.lower(T.strip(F.regexp_extract("line", "^([^/\t]*)", 1)))
    return lines.filter("n > 0").select(word.alias("word")).filter("word <> ''").distinct()


def tab_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of a tab-separated file, stripped; each line is cut at its first hash sign, and lines without all columns are left out."""
    names = [x.split()[0] for x in schema.split(",")]
    cells = F.split(F.regexp_extract("value", "^([^#]*)", 1), "\t")
    rows = spark.read.text(path).select(cells.alias("c")).filter(F.size("c") >= len(names))
    kinds = [x.split()[1] for x in schema.split(",")]
    return rows.select(*[T.strip(F.get("c", F.lit(i))).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]).filter(F.col(names[0]).isNotNull() & (F.col(names[0]).cast("string") != ""))


def confidence_words(lines: DataFrame, page: str = "page") -> DataFrame:
    """page, block, par, line, word_ord, conf, word of the rows of a word-confidence table. lines: page, value (tab-separated); rows with fewer than 12
    columns, a blank word, no confidence or the header are left out."""
    def row(c: Column) -> Column:
        at = lambda i: F.get(c, F.lit(i))
        told = (F.size(c) >= 12) & (T.strip(at(11)) != "") & ~at(10).isin("-1", "conf") & at(10).try_cast("double").isNotNull()
        cells = F.struct(*[at(i).try_cast("int").alias(n) for i, n in ((2, "block"), (3, "par"), (4, "line"), (5, "word_ord"))], at(10).try_cast("double").alias("conf"), at(11).alias("word"))
        return F.when(told, F.array(cells))

    # One generator: as a filter below a projection the test would split each line anew wherever it looks at a cell.
    return lines.select(page, F.inline(T.let(F.split("value", "\t", -1), row)))


def word_confidences(spark: SparkSession, root: str) -> DataFrame:
    """confidence_words of the .tsv files below root; the page is the file's path."""
    return confidence_words(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv").text(root).select(F.input_file_name().alias("page"), "value"))


def second_readings(pages: DataFrame) -> DataFrame:
    """page, text of a second engine, without its thoughts; a page without a reply (null) is skipped. pages: page, reply."""
    return pages.filter("reply IS NOT NULL").select("page", T.without_thoughts("reply").alias("text"))


def unmarked(pages: DataFrame) -> DataFrame:
    """page, text, has_confidence: plain text layers, for pages that no word confidences are known of. pages: page, text."""
    return pages.select("page", "text", F.lit(False).alias("has_confidence"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a pattern file; comments begin at a hash sign."""
    return spark.read.text(path).select(T.strip(F.regexp_extract("value", "^([^#]*)", 1)).alias("pattern")).filter("pattern <> ''")


def settings(lines: list[str], environment: dict[str, str]) -> dict[str, str]:
    """KEY=value lines; comments cut, one pair of quotes stripped, the environment first."""
    out: dict[str, str] = {}
    for line in lines:
        key, eq, value = line.split("#", 1)[0].partition("=")
        key, value = key.strip(), value.strip()
        if not eq or not key.isidentifier():
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault(key, environment.get(key, value))
    return out


def labelled(spark: SparkSession, root: str) -> DataFrame:
    """path, lang (the folder's name), text."""
    return texts(spark, root).withColumn("lang", F.regexp_extract("path", "([^/]+)/[^/]*$", 1))
