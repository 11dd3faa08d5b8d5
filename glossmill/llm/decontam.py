"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents gets a sparse suffix array over word numbers: the suffixes that begin with a word of the
benchmark, which are the only ones that a test suffix can match. Every suffix of every benchmark item is binary-searched
in it; the neighbours of its place give the longest verbatim match and its location. Windows whose match is long
enough give a range of the array, and these ranges mark the words that are hit.

The benchmark is written once to the shared folder in blocks of a bounded size; every shard is searched with one block after another, so that
neither the driver nor a task ever holds more than one block and the few that it keeps.

Defined cases: null and empty texts have no words; an item without words has no window; a null item_id counts as the
empty string; repeated items count once by id, repeated documents are each returned; an empty benchmark or document
table gives zero hits or no rows; other columns are ignored or, in remove_contaminated, kept.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import commit_name, fresh_path, open_store, prepare, table

WINDOW = 10
#: Words in a shard, bytes of benchmark text in a block, and blocks that a process keeps from shard to shard.
SHARD_WORDS, BLOCK_BYTES, KEPT = 1_000_000, 4_000_000, 4
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_KEEP).split()


class Benchmark:
    """Word numbers of the items, laid end to end with zeros between, and their distinct windows."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        flat: list[int] = []
        places: dict[tuple[int, ...], tuple[int, set[str]]] = {}
        self.item_of: list[tuple[str, int, int]] = []  # item, first place, words
        for item, data in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(data)]
            self.item_of.append((item, len(flat), len(ids)))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                places.setdefault(tuple(ids[i : i + window]), (len(flat) + i, set()))[1].add(item)
            flat += [*ids, 0]
        self.longest = max((n for _, _, n in self.item_of), default=0)
        self.text = np.array(flat + [0] * (self.longest + 8), np.int64)
        self.suffixes = np.flatnonzero(self.text)
        self.starts = np.array([p for p, _ in places.values()], np.int64)
        self.lengths = np.array([len(k) for k in places], np.int64)
        self.names = sorted({x for _, s in places.values() for x in s})
        number = {x: i for i, x in enumerate(self.names)}
        owned = [sorted(number[x] for x in s) for _, s in places.values()]
        self.owner_at = np.cumsum([0, *map(len, owned)])
        self.owners = np.array([x for o in owned for x in o], np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the non-zero words of text, ordered by their next words, exactly to that depth at least."""
    at = np.flatnonzero(text)
    padded = np.concatenate([text, np.zeros(depth * 2 + 8, np.int64)])
    wide = 4 if not len(text) or text.max() < 65536 else 2
    bits = 64 // wide
    key = np.zeros(len(at), np.uint64)
    for j in range(wide):
        key = (key << np.uint64(bits)) | padded[at + j].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(len(padded), np.int64)
    ranks = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    rank[at] = ranks
    k = wide
    while k < depth:
        same = np.zeros(len(at), bool)
        same[1:] = ranks[1:] == ranks[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        places = at[tied]
        key2 = rank[places + k]
        order = np.lexsort((key2, ranks[tied]))
        at[tied] = places[order]
        first, second = ranks[tied][order], key2[order]
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        ranks[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        rank[at] = ranks
        k *= 2
    return at


def common_prefix(text: np.ndarray, a: np.ndarray, test: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that text from a and test from b share, at most most; zeros in test end it."""
    size = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        s = size[live]
        w = test[b[live] + s]
        live = live[(s < most[live]) & (w > 0) & (text[np.minimum(a[live] + s, len(text) - 1)] == w)]
        size[live] += 1
    return size


def search(text: np.ndarray, sa: np.ndarray, test: np.ndarray, at: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
    """Binary search: how many suffixes stand before test[at:at+most], or with after before or at it."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        a, b, m = sa[mid], at[live], most[live]
        n = common_prefix(text, a, test, b, m)
        whole = (n >= m) | (test[b + n] == 0)
        less = np.where(whole, after, text[np.minimum(a + n, len(text) - 1)] < test[b + n])
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    return lo


class Shard:
    """The suffix array of a few documents, with what the benchmark finds in it."""

    def __init__(self, docs: list[list[bytes]], bench: Benchmark):
        get = bench.vocab.get
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        text = np.zeros(self.begin[-1] + 1, np.int64)
        for d, s in zip(docs, self.begin, strict=False):
            text[s : s + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int64, len(d))
        self.text, self.bench = text, bench
        self.sa = suffix_array(text, max(1, bench.longest))

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each test suffix: the words of its longest verbatim match here, and the place of one such match."""
        b, t = self.bench, self.bench.suffixes
        if not len(self.sa) or not len(t):
            return np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        most = np.full(len(t), max(1, b.longest))
        place = search(self.text, self.sa, b.text, t, most)
        low, high = self.sa[np.maximum(place - 1, 0)], self.sa[np.minimum(place, len(self.sa) - 1)]
        x, y = common_prefix(self.text, low, b.text, t, most), common_prefix(self.text, high, b.text, t, most)
        return np.maximum(x, y), np.where(x > y, low, high)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and the pairs (document, number of an item with an occurring window)."""
        b = self.bench
        hit = np.zeros(len(self.text), bool)
        if not len(self.sa) or not len(b.starts):
            return hit, np.zeros((0, 2), np.int64)
        size, _ = self.longest()
        by_place = np.zeros(len(b.text), np.int64)
        by_place[b.suffixes] = size
        found = np.flatnonzero(by_place[b.starts] >= b.lengths)
        lo = search(self.text, self.sa, b.text, b.starts[found], b.lengths[found])
        hi = search(self.text, self.sa, b.text, b.starts[found], b.lengths[found], after=True)
        n = hi - lo
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at, which = self.sa[flat], np.repeat(found, n)
        edge = np.bincount(at, minlength=len(self.text) + 1) - np.bincount(at + b.lengths[which], minlength=len(self.text) + 1)
        hit = np.cumsum(edge)[: len(self.text)] > 0
        doc = np.searchsorted(self.begin, at, "right") - 1
        pairs = np.unique(np.stack([doc, which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        m = b.owner_at[pairs[:, 1] + 1] - b.owner_at[pairs[:, 1]]
        flat = np.repeat(b.owner_at[pairs[:, 1]] - np.concatenate([[0], np.cumsum(m)[:-1]]) if len(m) else m, m) + np.arange(m.sum())
        return hit, np.unique(np.stack([np.repeat(pairs[:, 0], m), b.owners[flat]], 1), axis=0)


def _shard_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of the documents of each shard."""
    keys, docs, size = [], [], 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(words_of(value.as_py()))
            keys.append(key)
            size += len(docs[-1])
            if size >= SHARD_WORDS:
                yield keys, docs
                keys, docs, size = [], [], 0
    if docs:
        yield keys, docs


class Blocks:
    """The benchmark in the shared folder: read by the tasks, block by block."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def __iter__(self) -> Iterator[Benchmark]:
        for name in self.names:
            if name not in _kept:
                store, root = open_store(self.folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    block = pickle.loads(f.read())  # written by write_benchmark, below
                while len(_kept) >= KEPT:
                    _kept.pop(next(iter(_kept)))
                _kept[name] = block
            yield _kept[name]


_kept: dict[str, Benchmark] = {}


def write_benchmark(bench: DataFrame, window: int) -> Blocks:
    """Write the benchmark in blocks; all rows of an item go to one of them. The driver gets the files' names alone."""
    spark = bench.sparkSession
    prepare(spark)
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("data")).filter(F.octet_length("data") > 0)
    total = items.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0  # one number
    n, folder = int(total // BLOCK_BYTES) + 1, fresh_path(spark, "benchmark")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        number, held = None, []

        def put() -> Iterator[pa.RecordBatch]:
            if held:
                name = f"{number:08d}-{commit_name()}.block"
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(pickle.dumps(Benchmark(sorted(held), window), protocol=5))
                yield pa.record_batch([pa.array([name])], ["name"])

        for batch in batches:
            for block, item, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != number:
                    yield from put()
                    number, held = block, []
                held.append((item, data))
        yield from put()

    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(n)).alias("block"), "item", "data")
    files = dealt.repartition(min(n, 256), "block").sortWithinPartitions("block").mapInArrow(write, "name string")
    return Blocks(folder, sorted(r.name for r in files.collect()))  # one name for each BLOCK_BYTES of the benchmark


def longest_matches(docs: DataFrame, bench: DataFrame, least: int = WINDOW) -> DataFrame:
    """item_id, item_word, doc_id, doc_word, words: of each test suffix and shard, the longest verbatim match of least words or more."""
    prepare(docs.sparkSession)
    blocks = write_benchmark(bench, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _shard_texts(batches):
            for b in blocks:
                begin = np.array([p for _, p, _ in b.item_of], np.int64)
                shard = Shard(texts, b)
                size, place = shard.longest()
                at = np.flatnonzero(size >= least)
                item = np.searchsorted(begin, b.suffixes[at], "right") - 1
                doc = np.searchsorted(shard.begin, place[at], "right") - 1
                yield pa.record_batch(
                    [pa.array([b.item_of[i][0] for i in item], pa.string()), pa.array(b.suffixes[at] - begin[item]), pa.array([keys[d] for d in doc], pa.int64()), pa.array(place[at] - shard.begin[doc]), pa.array(size[at])],
                    ["item_id", "item_word", "doc_id", "doc_word", "words"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id string, item_word long, doc_id long, doc_word long, words long")


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    prepare(docs.sparkSession)
    blocks = write_benchmark(bench, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _shard_texts(batches):
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            hit, names = np.zeros(begin[-1] + 1, bool), [[] for _ in keys]
            for block in blocks:
                found, pairs = Shard(texts, block).windows()
                hit |= found
                for d, j in pairs.tolist():
                    names[d].append(block.names[j])
            before = np.concatenate([[0], np.cumsum(hit)])
            n_hit = before[begin[1:] - 1] - before[begin[:-1]]
            names = [sorted(x) for x in names]
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), sizes, pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(shas), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _REPORT)


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    from pyspark.sql.functions import pandas_udf

    prepare(docs.sparkSession)
    blocks = write_benchmark(bench, window)

    def clean(texts):
        import pandas as pd

        out: list[bool] = []
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["k", "t"])
        for _, words in _shard_texts(iter([batch])):
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in words])])
            hit = np.zeros(begin[-1] + 1, bool)
            for block in blocks:
                hit |= Shard(words, block).windows()[0]
            before = np.concatenate([[0], np.cumsum(hit)])
            out += (before[begin[1:] - 1] == before[begin[:-1]]).tolist()
        return pd.Series(out, dtype=bool)

    return docs.filter(pandas_udf(clean, "boolean")(F.col("text").cast("binary")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
          FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT rid, p, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT rid, p, n FROM occ)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
