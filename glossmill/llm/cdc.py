"""Repeated passages found by content-defined chunking with a gear rolling hash.

Every byte adds its number from a fixed table to the doubled hash, so that the hash of a place depends on the WIDTH bytes before
it. A place whose hash is the smallest of some GAP places in a row is a cut. Cuts follow the content alone, so an insertion moves
them but changes only the chunks that it touches, and of any GAP places in a row one is a cut: a passage that stands in two texts has
its inner cuts at the same places in both. A chunk begins at every cut and runs to the first cut CHUNK bytes or more behind it, so that chunks
overlap or touch and none is so short that it stands elsewhere by chance; equal chunks are found by digest. In each text, runs of consecutive chunks that occur elsewhere too are joined, and runs of
LEAST bytes or more are repeats; of each chunk in them the first occurrence (by row in the order in which the scan deals out the files, then place) stays and the others
can go. A repeated passage of SURE bytes or more is always found, whatever its words are; none of fewer than LEAST bytes is reported.

Only digests, row numbers and offsets are shuffled, never texts. Chunks are counted by digest with partial aggregation; only those that
occur twice are looked at again, and a digest that holds a large share of all chunks is never gathered in one task: its chunks are joined to
stretches where they are read, and a stretch is one row from there on.

Defined cases: null and empty texts have no chunks; a text too short for another chunk is one chunk; each row is a text of its own, also if its
doc_id is null or repeated or the whole row is, so that of equal rows the first stays; repeats within a text count like those between
texts; in a stretch that repeats itself every EVEN bytes or less only the first of equal places is a cut, so that it can be
one long chunk; an empty table gives no rows; other columns are ignored or, in remove_repeats, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import hot_keys, materialize, prepare, table, with_row_id

#: Bytes that the hash depends on, the most places from cut to cut, the period up to which equal places are one, the least bytes of a chunk and of a repeat.
WIDTH, GAP, EVEN, CHUNK, LEAST = 16, 48, 8, 24, 64
#: From this length on every repeat is found: the first cut in it lies within WIDTH - 1 + GAP bytes, its last cut within GAP of its end, and the end of the last chunk within GAP of that.
SURE = LEAST + WIDTH - 1 + 3 * GAP
#: Bytes of a text that are hashed at once, and rows of a batch.
SECTION, ROWS = 1 << 20, 1 << 16
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def _slide(values: np.ndarray, size: int, take) -> np.ndarray:
    """take (minimum or maximum) over every run of size values."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = take(values[:-step], values[step:])
        width += step
    return values


def _places(raw: np.ndarray, gap: int) -> np.ndarray:
    """Which bytes are the smallest place of a window of gap places, of those that have all their bytes before them here."""
    h, width = GEAR[raw], 1
    while width < WIDTH:  # the hash over 2w bytes is the hash over w, and that of the w before it, shifted
        h = np.concatenate([h[:width], h[width:] + (h[:-width] << np.uint32(width))])
        width *= 2
    h[: WIDTH - 1] = _NONE
    h[:-1][(raw[1:] & 0xC0) == 0x80] = _NONE  # not within a character
    found = np.zeros(len(raw), bool)
    if len(raw) < gap:
        return found
    low = _slide(h, gap, np.minimum)
    edge = np.zeros(gap - 1, np.uint32)
    found = (h == _slide(np.concatenate([edge, low, edge]), gap, np.maximum)) & (h != _NONE)
    for k in range(1, EVEN + 1):
        found[k:] &= h[k:] != h[:-k]
    return found


def cuts(data: bytes, gap: int = GAP) -> np.ndarray:
    """Places of the cuts, from 0 to the end; none stands within a character. Long texts are hashed in sections, with the same result."""
    if not data:
        return np.zeros(1, np.int64)
    raw, around = np.frombuffer(data, np.uint8), WIDTH + 2 * gap + EVEN
    out = [np.zeros(1, np.int64)]
    for at in range(0, len(raw), SECTION):
        low, top = max(0, at - around), min(len(raw), at + SECTION + around)
        inside = np.flatnonzero(_places(raw[low:top], gap)) + low + 1
        out.append(inside[(inside > at) & (inside <= at + SECTION) & (inside < len(raw))])
    out.append(np.array([len(raw)], np.int64))
    return np.concatenate(out)


def chunks(data: bytes, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests (signed 64-bit) of the chunks."""
    at = cuts(data, gap)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = np.searchsorted(at, at[:-1] + CHUNK)
    to = to[to < len(at)] if to[0] < len(at) else np.array([len(at) - 1])
    starts, ends = at[: len(to)], at[to]
    digest = xxhash.xxh3_64_digest
    found = b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return starts, ends, np.frombuffer(found, ">i8").astype(np.int64)


_CHUNKS = "n long, digest long, start int, end int, doc_id long, row struct<f:long,i:long>"


def chunk_table(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """n (a number of the row), digest, start, end of each chunk, and for each row with chunks a line with n, doc_id and row alone; docs carry gm_row."""
    prepare(docs.sparkSession)
    names = ["n", "digest", "start", "end", "doc_id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, row_type = [], 0, batch.column(2).type

            def flush(batch=batch, row_type=row_type) -> Iterator[pa.RecordBatch]:
                rows = pa.array([i for i, _ in held], pa.int64())
                at = pa.array(np.repeat([i for i, _ in held], [len(p[0]) for _, p in held]).astype(np.int64))
                start, end, digest = (np.concatenate([p[i] for _, p in held]) for i in range(3))
                none = lambda n, t: pa.nulls(n, t)
                yield pa.record_batch([batch.column(0).take(rows), none(len(rows), pa.int64()), none(len(rows), pa.int32()), none(len(rows), pa.int32()), batch.column(1).take(rows), batch.column(2).take(rows)], names)
                for a in range(0, len(start), ROWS):
                    part = slice(a, a + ROWS)
                    here = batch.column(0).take(at[a : a + ROWS])
                    yield pa.record_batch([here, pa.array(digest[part]), pa.array(start[part].astype(np.int32)), pa.array(end[part].astype(np.int32)), none(len(here), pa.int64()), none(len(here), row_type)], names)

            for i, value in enumerate(batch.column(3)):
                held.append((i, chunks(value.as_py() or b"", gap)))
                size += len(held[-1][1][0])
                if size >= ROWS:
                    yield from flush()
                    held, size = [], 0
            if size:
                yield from flush()

    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col("doc_id").cast("long"), F.col("gm_row").alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _CHUNKS)


def stretches(pieces: DataFrame, origins: dict[int, tuple[int, int]]) -> DataFrame:
    """n, digest, first, start, end, later of each stretch of pieces (digest, n, span) that follow each other in a text and overlap or touch, joined as they are read.

    origins: n and span of the first place of each digest of pieces."""
    keys = np.array(sorted(origins), np.int64)
    first_n, first_span = (np.array([origins[k][i] for k in keys.tolist()], np.int64) for i in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digest, n, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            start, end, of = (span >> 32).astype(np.int32), (span & 0xFFFFFFFF).astype(np.int32), np.searchsorted(keys, digest)
            later = (first_n[of] != n) | (first_span[of] != span)
            goes_on = (n[1:] == n[:-1]) & (start[1:] >= start[:-1]) & (start[1:] <= end[:-1])
            at = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            counts = np.add.reduceat(later.astype(np.int32), at)
            gone = pa.StructArray.from_arrays([pa.array(start[later]), pa.array(end[later])], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), gone)
            columns = [pa.array(x) for x in (n[at], digest[at], counts == 0, start[at], np.maximum.reduceat(end, at))]
            yield pa.record_batch([*columns, lists], ["n", "digest", "first", "start", "end", "later"])

    return pieces.select("digest", "n", "span").mapInArrow(run, "n long, digest long, first boolean, start int, end int, later array<struct<start:int,end:int>>")


def repeated_spans(docs: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """doc_id, row, start, end (bytes of the text in UTF-8), digest (of the first chunk), first (all its chunks occur here first), later (the others) of each repeat.

    docs with a column gm_row keep it as row; others get row numbers here."""
    docs = docs if "gm_row" in docs.columns else with_row_id(docs)
    written = materialize(chunk_table(docs, gap), "cdc-chunks")
    # Three numbers a chunk are all that is shuffled: digest, row, and both offsets in one.
    both = (F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("span")
    pieces = written.filter("digest IS NOT NULL").select("digest", "n", both)
    several = materialize(pieces.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1"), "cdc-digests")
    hot = materialize(hot_keys(several, "digest", "times").select("digest"), "cdc-hot")
    # Where a chunk stands first: a hot digest's place by partial aggregation, the others' within the partitions of the join.
    hot_pieces = pieces.join(F.broadcast(hot), "digest", "left_semi")
    origins = hot_pieces.groupBy("digest").agg(F.min(F.struct("n", "span")).alias("origin")).select("digest", "origin.*").collect()  # fewer than HOT
    often = stretches(hot_pieces, {r.digest: (r.n, r.span) for r in origins})
    rest = pieces.join(F.broadcast(hot), "digest", "left_anti").join(several.select("digest").hint("merge"), "digest", "left_semi")
    rest = rest.withColumn("first", F.row_number().over(Window.partitionBy("digest").orderBy("n", "span")) == 1)
    rest = rest.select("n", "digest", "first", F.shiftright("span", 32).cast("int").alias("start"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"))
    twice = often.unionByName(rest.withColumn("later", F.when(~F.col("first"), F.array(F.struct("start", "end")))))
    # Chunks of a run overlap or touch: each begins no later than those before it end.
    order = Window.partitionBy("n").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = twice.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    joined = runs.groupBy("n", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("digest", "start").alias("digest"), F.bool_and("first").alias("first"), F.flatten(F.collect_list("later")).alias("later"))
    named = written.filter("digest IS NULL").select("n", "doc_id", "row")
    return joined.filter(F.col("end") - F.col("start") >= least).join(named, "n").select("doc_id", "row", "start", "end", "digest", "first", "later")


def remove_repeats(docs: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """docs with all columns, where the chunks of repeats that occur earlier are cut out of the text; each piece stays at its first place."""
    marked = with_row_id(docs)
    spans = repeated_spans(marked, gap, least).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("later"))).alias("gm_spans"))
    spans = materialize(spans.withColumnRenamed("row", "gm_of"), "cdc-spans")

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            if gone is not None and len(gone):
                at, kept = 0, []
                for s in gone:
                    kept.append(text[at : s["start"]])
                    at = max(at, s["end"])
                text = b"".join([*kept, text[at:]])
            out.append(None if text is None else text.decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    found = marked.join(spans, F.col("gm_row") == F.col("gm_of"), "left").withColumn("gm_text", F.col("text").cast("binary"))
    return found.withColumn("text", pandas_udf(cut, "string")("gm_text", "gm_spans")).select(*docs.columns)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, end (bytes), digest, first of each repeated passage of documents; rows without one give none."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row", "later")
