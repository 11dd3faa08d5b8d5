"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows are kept or left by themselves, never by their doc_id alone, so that null and repeated doc_ids
go through all stages: a null text is scored like an empty one, empty texts form one near-duplicate group, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import ans, common, decontam, mixing, quality, simhash, similar


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more over five-word shingles."""
    marked = common.with_row_id(docs)
    kept = simhash.one_per_group(marked, similar.similar_groups(marked))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights; a document stands once for each epoch that takes it, and one on an edge gives its first tokens."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    return ans.token_output(docs)


STAGES = [("quality", classify), ("simhash", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("token_output", tokenize)]

#: The classifier, the fingerprints and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.sweep(spark, since)  # the stage's own tables, and the documents that it read
    return STAGES[-1][1](spark, docs, sf_dir)
