"""The pipeline against brute force, stage by stage, and its defined cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import ans, mixing, quality

from .test_operators import brute_contamination
from .test_similar import brute_similar

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    assert 0 < len(rows) <= docs.count()
    groups = brute_similar(rows)
    rows = [r for r in rows if groups[r[0]] == r[0]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in brute_contamination(rows, bench) if x[5]}
    rows = [r for r in rows if r[0] not in hit]
    assert hit and rows
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    docs.join(ids, "doc_id", "left_semi").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    taken = con.execute(f"SELECT doc_id, take_tokens, n_tokens FROM ({mixing.OP7_SQL}) ORDER BY doc_id").fetchall()
    encoder, texts = ans.encoder_at(public_tokenizers.path("word_bpe_49k.json")), dict(rows)
    start, want = 0, Counter()
    for doc_id, take, n in taken:
        text = texts[doc_id] if take == n else re.match(r"(?:[ \t-\r]*[^ \t-\r]+){%d}" % take, texts[doc_id])[0]
        tokens = np.frombuffer(encoder.whole(text) + b"\x01\x00", "<u2").astype("<u4")
        want[doc_id, len(tokens), zlib.crc32(tokens.tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert any(take < n for _, take, n in taken)
    for r in sorted(got, key=lambda r: r.start):  # in order, without gaps
        assert r.start == start
        start += r.n_tokens


def test_pipeline_keeps_rows_with_null_and_repeated_ids(spark, tmp_path):
    """Near-dedup and mixing with null and repeated doc_ids, by brute force over rows."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 60)))
    rows = [(rng.choice([None, i, i, i // 2]), text(), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(None, rows[0][1], "en", "src1", 0), (99, rows[1][1], "en", "src1", 0), rows[2], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert Counter(r.text for r in kept) == Counter({t for _, t, *_ in rows})  # no text is lost, none stands twice
    for r in kept:
        ids = [i for i, t, *_ in rows if t == r.text]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    spark.createDataFrame(kept, docs.schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, take_tokens FROM ({mixing.OP7_SQL})").fetchall())
    out = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert Counter((r.doc_id, len((r.text or "").split())) for r in out) == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, "en", "src1", None), (2, "", None, None, 0), (3, "some words " * 40, "en", "src2", 1), (3, "some words " * 40, "en", "src2", 1), (None, "text", "de", "src3", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, part, SF)
            assert out.columns == docs.columns and out.count() <= 2 * part.count()
        assert corpus_pipeline.STAGES[-1][1](spark, part, SF).agg(F.count("*")).first()[0] == part.count()
