"""Quality by compression: Zstandard dictionaries of good and of bad text, and the difference of the sizes that they give.

A whole text is cut into blocks, since a dictionary helps most at the start of what is compressed; each block is compressed with
either dictionary, and the difference of the summed sizes over the bytes of the text is the raw score. Bytes, not compressed bytes, so that
endless repeats, which both dictionaries compress alike, stand near 0 and far from good text. A rising curve fitted on labelled rows that
neither dictionary saw, the share of good rows by raw score, turns this one number into a probability.

The fit takes a bounded sample: PER_CLASS labelled rows for each label, of smallest hash, and of each text, whatever its length, up to
SAMPLE_BLOCKS evenly spaced blocks; of these only rows whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts get the score of no evidence; rows with a null doc_id are scored with held_out null; without
four labelled texts of either kind, all scores are the share of good labels (0.5 without any); repeated rows are each scored; a doc_id labelled
twice counts with the smaller label, and one of its texts, of smallest hash, is in the sample; an empty table gives no rows; other columns are
ignored or, in keep_good, kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import prepare, table

PER_CLASS, SAMPLE_BLOCKS = 1200, 12
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1024, 3
THRESHOLD = 0.3
#: Least labelled rows of a step of the curve.
LEAST_BIN = 25


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained from blocks; raw content where they are too few."""
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b"-"


class Compressor:
    """The raw score; the dictionaries are digested once in each process."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self.parts = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def raw(self, blocks: list[bytes]) -> float | None:
        """The normalised difference, above 0 where the dictionary of good text compresses better; None without text."""
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self.parts)
        return (bad - good) / sum(map(len, blocks)) if blocks else None


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int = LEAST_BIN) -> tuple[list[float], list[float]]:
    """Knots and values of a rising curve from the raw score to the weighted share of good rows: bins of at least so many rows (fewer where they would be under eight), pooled until they rise."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    bins = []  # weight, weighted x, weighted good
    for at in np.array_split(np.arange(len(x)), max(1, len(x) // least, min(8, len(x) // 2))):
        bins.append([w[at].sum(), (w[at] * x[at]).sum(), (w[at] * y[at]).sum()])
        while len(bins) > 1 and bins[-1][2] / bins[-1][0] <= bins[-2][2] / bins[-2][0]:
            top = bins.pop()
            bins[-1] = [a + b for a, b in zip(bins[-1], top, strict=True)]
    return [float(b[1] / b[0]) for b in bins], [float(b[2] / b[0]) for b in bins]


class Model:
    def __init__(self, good: bytes, bad: bytes, curve: tuple[list[float], list[float]], prior: float):
        self.good, self.bad, self.curve, self.prior = good, bad, curve, prior

    def score(self, texts: list[bytes | None]) -> list[float]:
        c = _compressor(self.good, self.bad)
        return [self.prior if (x := c.raw(blocks_of(t or b""))) is None else float(np.interp(x, *self.curve)) for t in texts]


_compressors: dict[tuple[bytes, bytes], Compressor] = {}


def _compressor(good: bytes, bad: bytes) -> Compressor:
    if (good, bad) not in _compressors:
        _compressors.clear()
        _compressors[good, bad] = Compressor(good, bad)
    return _compressors[good, bad]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, list[bytes]]]:
    """Label and blocks of each labelled text of the sample, in an order fixed by the rows."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(~held_out(F.col("doc_id").cast("long")))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    ids = [told.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = {r.doc_id: r.quality for part in ids for r in part.collect()}
    small = docs.sparkSession.createDataFrame(list(picked.items()), "doc_id long, quality int")  # 2 * per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")).join(F.broadcast(small), "doc_id").filter(F.octet_length("data") > 0)
    n = F.ceil(F.octet_length("data") / BLOCK_BYTES).cast("int")
    taken = F.least(n, F.lit(SAMPLE_BLOCKS))
    blocks = F.transform(F.sequence(F.lit(0), taken - 1), lambda i: F.substring("data", (F.floor(i * n / taken) * BLOCK_BYTES + 1).cast("int"), F.lit(BLOCK_BYTES)))
    each = texts.select("doc_id", "quality", F.xxhash64("data").alias("h"), blocks.alias("blocks")).groupBy("doc_id").agg(F.min(F.struct("h", "quality", "blocks")).alias("t"))
    rows = sorted(((r.t.h, r.doc_id, r.t.quality, [bytes(b) for b in r.t.blocks]) for r in each.collect()), key=lambda r: r[:2])  # one for each id of the sample
    return [(q, blocks) for _, _, q, blocks in rows]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Half of the sample makes the dictionaries, the other half the curve."""
    rows = sample(docs, labels, per_class)
    of = [[t for q, t in rows if q == k] for k in (0, 1)]
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).filter(~held_out(F.col("doc_id").cast("long")))
    n = {r.quality: r["count"] for r in known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).groupBy("quality").count().collect()}
    prior = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    if min(map(len, of)) < 4:
        return Model(b"-", b"-", ([0.0], [prior]), prior)
    bad, good = (dictionary([b for t in part[::2] for b in t]) for part in of)
    c = Compressor(good, bad)
    rest = [(c.raw(t), q) for q in (0, 1) for t in of[q][1::2]]
    # The classes were sampled evenly; each row weighs what its class has in the labels.
    share = [(1 - prior) / sum(q == 0 for _, q in rest), prior / sum(q == 1 for _, q in rest)]
    x, y = np.array([x for x, _ in rest]), np.array([float(q) for _, q in rest])
    return Model(good, bad, calibrate(x, y, np.where(y > 0, share[1], share[0])), prior)


def score_column(model: Model, text="text") -> F.Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return pandas_udf(run, "double")(F.col(text).cast("binary"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    prepare(docs.sparkSession)
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold."""
    prepare(docs.sparkSession)
    return docs.filter(score_column(fit(docs, labels)) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
