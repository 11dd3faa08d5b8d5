"""SimHash near-duplicate groups found with vantage-point trees over Hamming distance.

Fingerprints are computed per document, and equal ones collapse to one row. Their 64 bits are cut into segments, one more than the
radius, so that two within the radius agree in a whole segment. A vantage-point tree over the values of each segment deals the distinct
fingerprints to shards: equal values fall into the same shard, so that a fingerprint lives in one shard of each segment and visits no other,
and each close pair meets in at least one. Shards too large for a block, which hold one value of a segment alone, are dealt in pairs of
blocks. Each shard builds its own tree over all 64 bits, prunes it by the triangle bounds, and emits a spanning forest instead of all
pairs. Components come from min-label propagation with pointer jumping; of all documents the driver gets only how many fingerprints
hold each value of a segment (at most 2 ** 13 values a segment).

Defined cases: a null text counts as empty; a text without words has fingerprint zero, linked like any other; rows with a
null doc_id get a fingerprint and the component of their group (null if the whole group has no id); each row is a row of its own, so that repeated
rows and different texts under one doc_id are each returned, and of a group one row stays; an empty table gives an empty result; other columns are ignored or, in one_per_group, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_by, materialize, prepare, with_row_id

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Segments at least, so that a segment has 13 bits at most.
SEGMENTS = 5
#: Most fingerprints in a shard of more than one value of its segment, and about the most in a block of a shard.
SHARD, BLOCK = 4096, 8192
LEAF = 512


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits over the XXH64 of all word shingles, as an unsigned integer."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        hashes = b"".join([digest(text[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """row, doc_id, fp (the 64 bits as a signed long) of each row; docs carry gm_row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], ["row", "doc_id", "fp"])

    rows = docs.select(F.col("gm_row").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row struct<f:long,i:long>, doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, of which two fingerprints within the radius share one."""
    n = min(65, max(SEGMENTS, radius + 1))
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class ShardTree:
    """A vantage-point tree over the values of a segment, whose leaves are shards. Inner node: (vantage, radius, inside, outside)."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.sizes: list[int] = []
        self.root = self._build(values, counts)

    def _build(self, values: np.ndarray, counts: np.ndarray):
        if len(values) > 1 and counts.sum() > SHARD:
            d = distances(values, values[0])
            by = np.cumsum(np.bincount(d, counts))
            radius = min(int(np.searchsorted(by, by[-1] / 2)), int(d.max()) - 1)  # the median, with something outside
            inside = d <= radius
            return (values[0], radius, self._build(values[inside], counts[inside]), self._build(values[~inside], counts[~inside]))
        self.sizes.append(int(counts.sum()))
        return len(self.sizes) - 1

    def shard(self, values: np.ndarray) -> np.ndarray:
        """The shard of each value."""
        found, stack = np.zeros(len(values), np.int64), [(self.root, np.arange(len(values)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                found[at] = node
            elif len(at):
                vantage, radius, inside, outside = node
                near = distances(values[at], vantage) <= radius
                stack += [(inside, at[near]), (outside, at[~near])]
        return found


class Forest:
    """Union-find that keeps the edges that joined two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def link(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        """Join what the matrix near says, hooking each row and column to one partner until no link crosses groups."""
        rows, cols = near.any(1), near.any(0)
        left, right, near = left[rows].tolist(), right[cols].tolist(), near[rows][:, cols]
        while near.any():
            for i, j in enumerate(near.argmax(1).tolist()):
                if near[i, j]:
                    self.union(left[i], right[j])
            for j, i in enumerate(near.argmax(0).tolist()):
                if near[i, j]:
                    self.union(left[i], right[j])
            a = np.array([self.find(x) for x in left], np.uint64)
            b = np.array([self.find(x) for x in right], np.uint64)
            near = near & (a[:, None] != b[None, :])


def join_near(members: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Descend a vantage-point tree over the members with all queries at once; link pairs within the radius."""
    stack = [(members, queries)]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF:
            d = distances(m, m[len(m) // 2]).astype(np.int16)
            cut = int(np.median(d))
            inside = d <= cut
            if 0 < inside.sum() < len(m):
                e = distances(q, m[len(m) // 2]).astype(np.int16)
                stack += [(m[inside], q[e - radius <= cut]), (m[~inside], q[e + radius > cut])]
                continue
        for i in range(0, len(m), LEAF):
            block = m[i : i + LEAF]
            for j in range(0, len(q), 256):
                near = np.bitwise_count(q[j : j + 256, None] ^ block[None, :]) <= radius
                if near.any():
                    own = q[j : j + 256, None] == block[None, :]
                    if (near := near & ~own).any():
                        forest.link(q[j : j + 256], block, near)


def _values(points: np.ndarray, start: int, bits: int) -> np.ndarray:
    return points >> np.uint64(start) & np.uint64(2**bits - 1) if bits else np.zeros(len(points), np.uint64)


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links within the radius between the values of the column fp (distinct longs), a spanning forest of those of each shard."""
    spark = distinct.sparkSession
    prepare(spark)
    parts = segments(radius)
    cells = [F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fp", start).bitwiseAND(2**bits - 1).alias("value")) for i, (start, bits) in enumerate(parts) if bits]
    held = distinct.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell.segment", "cell.value").agg(F.count("*").alias("n")).orderBy("segment", "value").toPandas()
    n = int(held["n"][held["segment"] == held["segment"].min()].sum())
    if n <= SHARD:
        parts = [(0, 0)]
    trees = []
    for i, (_, bits) in enumerate(parts):
        own = held[held["segment"] == i]
        trees.append(ShardTree(own["value"].to_numpy(np.uint64), own["n"].to_numpy(np.int64)) if bits else ShardTree(np.zeros(1, np.uint64), np.array([n])))
    blocks = np.maximum(1, -(-np.concatenate([t.sizes for t in trees]).astype(np.int64) // BLOCK))
    # A shard of b blocks has b * b numbers, of which those of pairs of blocks in order are groups that one task compares.
    first_shard, first_group = np.cumsum([0, *(len(t.sizes) for t in trees)]), np.cumsum(blocks * blocks) - blocks * blocks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mixed = (points ^ points >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for (start, bits), tree, base in zip(parts, trees, first_shard, strict=False):
                shard = base + tree.shard(_values(points, start, bits))
                many = blocks[shard]
                block = mixed.astype(np.int64) % many
                for k in range(int(many.max(initial=0))):
                    at = np.flatnonzero(many > k)
                    low, high = np.minimum(block[at], k), np.maximum(block[at], k)
                    group = first_group[shard[at]] + low * many[at] + high
                    yield pa.record_batch([pa.array(group), pa.array(block[at] > low), pa.array(points[at].view(np.int64))], ["group", "second", "fp"])

    def linked(second: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        forest, points = Forest(), points.view(np.uint64)
        join_near(points[~second], points[second] if second.any() else points, radius, forest)
        edges = np.array(forest.edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for batch in batches:
            group, second, points = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(rest, batch.columns, strict=True))
            ends = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                yield linked(second[a:b], points[a:b])
            last = ends[-1] if len(ends) else 0  # the last group may go on in the next batch
            rest = [group[last:], second[last:], points[last:]]
        if len(rest[0]):
            yield linked(*rest[1:])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = distinct.select("fp").mapInArrow(deal, "group long, second boolean, fp long").repartition(tasks, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of each node that a link touches."""
    edges = materialize(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc-labels")
    while True:
        seen = materialize(edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")), "cc-seen")
        low = materialize(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "cc-low")
        # Where the labels themselves point: one row for each label, so that a large component's is looked up once and then by broadcast.
        counts = low.groupBy("label").agg(F.count("*").alias("n"))
        grand = materialize(counts.join(low.select(F.col("node").alias("label"), F.col("label").alias("grand")), "label"), "cc-grand")
        jumped = join_by(low, grand.select("label", "grand"), hot_keys(grand, "label"), "label")
        labels = materialize(jumped.select("node", "old", F.least("label", "grand").alias("label")), "cc-labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def owned_by_label(linked: DataFrame, key: str) -> DataFrame:
    """key, component_id: the smallest first of the rows of its label. linked: key, first, label."""
    lowest = materialize(linked.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "cc-lowest")
    return join_by(linked, lowest.select("label", "component_id"), hot_keys(lowest, "label"), "label").select(key, "component_id")


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """row, doc_id, fp, label (one of the group's fingerprints), component_id of each row of docs; docs with a column gm_row keep it as row."""
    docs = docs if "gm_row" in docs.columns else with_row_id(docs)
    marked = materialize(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    labels = components(near_links(distinct.select("fp"), radius))
    linked = materialize(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-linked")
    owned = owned_by_label(linked, "fp").withColumnRenamed("fp", "of")
    owned = linked.select("fp", "label").join(owned, F.col("fp") == F.col("of")).select("fp", "label", "component_id")
    return join_by(marked, materialize(owned, "simhash-owned"), hot_keys(distinct, "fp"), "fp").select("row", "doc_id", "fp", "label", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Of each group the row of the smallest doc_id (rows without one last, then the first in the files), with all its columns.

    docs carry gm_row, if groups (row, doc_id, label) are given.
    """
    marked = docs if "gm_row" in docs.columns else with_row_id(docs)
    groups = near_duplicate_groups(marked) if groups is None else groups
    best = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    kept = materialize(best.select(F.col("best.row").alias("gm_row")), "simhash-kept")
    return marked.join(kept.hint("merge"), "gm_row", "left_semi").select(*[c for c in docs.columns if c != "gm_row"])
