"""Exact top-k inner products by aggregation without random access.

The candidates come in blocks. A block holds one list for each component: its (value, candidate) entries in order of the value. The
lists are read in sequence from both ends, some entries of all lists at a time; what has been read is kept as the seen values. A value
that hasn't been read lies between the two places that the reader has reached in its list, so that each candidate has a lower and an upper bound
for each query. A candidate whose upper bound is below the k-th lower bound can't qualify and is left out; bounds are taken as long as a query has
more than a few candidates left, and reading stops once the values of all that are left are read. Their final scores are sums over what was read, in whole
numbers; vectors are never looked up by candidate. Bounds are held in floating point and widened by more than its error.

A task holds one block of candidates and reads the stated queries, which were written once in blocks to the shared folder, one
after another; the best of each block are ranked by query in the end.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without a vec_id, which no result can
name; an empty vector scores 0 against others; a query is compared with the vectors of its own length; every row is a candidate of its own
and, if it's asked, a query of its own, so that repeated rows are repeated results; scaled components beyond a long stand at its ends, and
so do scores; ties go to the smaller vec_id; fewer candidates than k give all; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, open_store, prepare, table

SCALE, K, EVERY = 64, 20, 20
CANDIDATES, QUERIES = 8192, 256
#: Shares of a list, counted from either end, that are read from one look at the bounds to the next; the last reads the middle.
STEPS = (0.25, 0.375, 0.4375, 0.5)
#: A query with at most so many times k candidates left needs no more bounds: reading on gives their scores.
FEW = 16
_LEAST, _MOST = -(2**63), 2**63 - 1


class Lists:
    """The sorted lists of a block, and what has been read of them."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.entries = [(vectors[order[:, d], d], order[:, d].astype(np.int32)) for d in range(self.width)]
        self.first, self.last = (np.array([v[i] for v, _ in self.entries]) for i in (0, -1))
        self.reach = np.maximum(np.abs(self.first.astype(np.float64)), np.abs(self.last.astype(np.float64)))
        self.begin()

    def begin(self) -> None:
        """Nothing has been read."""
        self.read, self.count = 0, 0
        self.values = np.zeros((self.n, self.width), np.int64)
        self.seen = np.zeros((self.n, self.width), bool)
        self.low, self.high = self.first.copy(), self.last.copy()

    def read_to(self, share: float) -> None:
        """Read all lists on to this share from either end."""
        to = (self.n + 1) // 2 if share >= 0.5 else int(share * self.n)
        if to <= self.read:
            return
        for d, (value, who) in enumerate(self.entries):
            for part in (slice(self.read, to), slice(max(to, self.n - to), self.n - self.read)):
                self.values[who[part], d] = value[part]
                self.seen[who[part], d] = True
                self.count += len(value[part])
            self.low[d], self.high[d] = value[to - 1], value[self.n - to]
        self.read = to

    @property
    def ended(self) -> bool:
        return 2 * self.read >= self.n

    def bounds(self, queries: np.ndarray, seen: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all candidates; seen and values are what has been read, as floating point."""
        q = queries.astype(np.float64)
        a, b = q * self.low, q * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        known = q @ values.T
        slack = 1e-9 * (np.abs(q) @ self.reach + 1)[:, None]
        lower, upper = known + (least.sum(1)[:, None] - least @ seen.T) - slack, known + (most.sum(1)[:, None] - most @ seen.T) + slack
        return np.clip(lower, float(_LEAST), float(_MOST)), np.clip(upper, float(_LEAST), float(_MOST))


def final_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; those beyond a long stand at its ends."""
    most = int(np.abs(values.astype(np.float64)).max(initial=0)) * int(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query))
    if most < 2**62:
        return values @ query
    return np.array([max(_LEAST, min(_MOST, sum(int(a) * int(b) for a, b in zip(v, query, strict=True)))) for v in values], np.int64)


def block_top(lists: Lists, ids: np.ndarray, rows: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) of the best k of a block, ties to smaller ids; ids ascend."""
    left: list[np.ndarray] = [np.flatnonzero(rows != r) for r in query_rows]
    open_queries = np.array([i for i, at in enumerate(left) if len(at) > k], np.int64)
    for share in STEPS if lists.width else ():
        lists.read_to(share)
        if lists.ended or not len(open_queries):
            break
        seen, values = lists.seen.astype(np.float64), lists.values.astype(np.float64)
        lower, upper = lists.bounds(queries[open_queries], seen, values)
        still = []
        for i, low, high in zip(open_queries.tolist(), lower, upper, strict=True):
            at = left[i]
            kth = np.partition(low[at], len(at) - k)[len(at) - k]
            left[i] = at[high[at] >= kth]
            if len(left[i]) > FEW * k:
                still.append(i)
        open_queries = np.array(still, np.int64)
    if not lists.ended:
        # All are settled: reading goes on until the values of those that are left are read.
        wanted = np.unique(np.concatenate(left)) if left else np.zeros(0, np.int64)
        for share in STEPS:
            if lists.seen[wanted].all():
                break
            lists.read_to(share)
    for i, at in enumerate(left):
        yield i, *_best(ids[at], final_scores(lists.values[at], queries[i]), k)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids ascend, so that a place settles ties."""
    if len(ids) > k:
        kth = np.partition(scores, len(ids) - k)[len(ids) - k]
        above, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
        at = np.concatenate([above, equal[: k - len(above)]])
        ids, scores = ids[at], scores[at]
    order = np.lexsort((ids, -scores.astype(np.longdouble)))
    return ids[order], scores[order]


_NAMES = ["width", "ids", "rows", "vectors"]
_BLOCK = "width int, ids binary, rows binary, vectors binary"


def _packed(size: int):
    """Rows (vec_id, row, v) in blocks of vectors of one length, of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int, rows: list) -> pa.RecordBatch:
            ids, numbers = (np.array([r[i] for r in rows], np.int64).tobytes() for i in (0, 1))
            vectors = np.concatenate([r[2] for r in rows]).tobytes() if width else b""
            return pa.record_batch([pa.array([width], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, numbers, vectors))], _NAMES)

        n = 0
        for batch in batches:
            flat, at = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            for i, (vec_id, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                vector = flat[at[i] : at[i + 1]]
                group = held.setdefault(len(vector), [])
                group.append((vec_id, row, vector))
                n += 1
                if len(group) >= size:
                    yield out(len(vector), held.pop(len(vector)))
                    n -= size
                elif n >= 2 * size:  # many lengths: nothing is held for long
                    for width, rows in held.items():
                        yield out(width, rows)
                    held, n = {}, 0
        for width, rows in held.items():
            yield out(width, rows)

    return run


def _read_queries(folder: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Width, ids, rows and vectors of each block of queries in the shared folder."""
    store, root = open_store(folder)
    for info in sorted(store.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
        if info.base_name.startswith("part-"):
            with store.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                for batch in file.iter_batches(batch_size=1, columns=_NAMES):
                    width, *parts = (batch.column(i)[0].as_py() for i in range(4))
                    ids, rows, vectors = (np.frombuffer(x, np.int64) for x in parts)
                    yield width, ids, rows, vectors.reshape(len(ids), width)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: of each row with is_query the k rows of highest inner product. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    prepare(spark)
    sound = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sound = sound.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    sound = sound.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Half of a long's range at most, so that a difference of two components fits.
    floor = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**62))), F.lit(2.0**62)))
    rows = sound.select("vec_id", F.monotonically_increasing_id().alias("row"), F.transform("e", floor).alias("v"))
    rows = materialize(rows, "topk-vectors")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    folder = fresh_path(spark, "topk-queries")
    rows.filter(is_query).mapInArrow(_packed(QUERIES), _BLOCK).write.parquet(folder)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, *parts = (batch.column(c)[i].as_py() for c in range(4))
                ids, numbers, x = (np.frombuffer(v, np.int64) for v in parts)
                order = np.argsort(ids, kind="stable")
                ids, numbers, x = ids[order], numbers[order], x.reshape(len(ids), width)[order]
                lists = Lists(x) if width else None
                for other, query_ids, query_rows, queries in _read_queries(folder):
                    if other != width:
                        continue
                    if lists is None:
                        found = [(j, *_best(ids[numbers != r], np.zeros((numbers != r).sum(), np.int64), k)) for j, r in enumerate(query_rows)]
                    else:
                        lists.begin()
                        found = list(block_top(lists, ids, numbers, query_rows, queries, k))
                    sizes = [len(f[1]) for f in found]
                    at = np.repeat([f[0] for f in found], sizes)
                    yield pa.record_batch([pa.array(query_ids[at]), pa.array(query_rows[at]), *(pa.array(np.concatenate([f[c] for f in found])) for c in (1, 2))], ["query_id", "query_row", "vec_id", "score"])

    blocks = rows.repartition(tasks).mapInArrow(_packed(CANDIDATES), _BLOCK)
    local = blocks.mapInArrow(search, "query_id long, query_row long, vec_id long, score long")
    best = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
