"""Near-duplicate groups by an exact similarity: the candidates of the SimHash trees, and of MinHash bands for what they miss.

Texts with a Jaccard similarity of 0.8 over five-word shingles differ in up to 14 of 64 SimHash bits and more, a radius at which
triangle bounds prune nothing. So the trees give the close candidates, bands of minima give the others (a pair of similarity 0.8
shares none of BANDS bands of ROWS minima in 3 cases of a million), and every candidate is checked on the whole shingle sets.

Equal sets collapse first. In each band's block all members are compared with one hub, the member that shares most blocks; after that,
members of blocks that hold several groups meet through the rarest shingles of their whole sets (a filter that loses no pair), so that
neither copies of one text nor texts with a common passage are compared all with all. Sets are fetched for candidates only, and a hub
of many comparisons is salted.

Defined cases: a null text counts as empty; texts without words form one group; fewer words than a shingle are one shingle; each row is a
row of its own, also if its doc_id is null or repeated, and repeated rows share a group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_by, materialize, prepare, with_row_id
from .simhash import RADIUS, SEED, components, near_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Comparisons of one hub that a task gets.
SALT = 256
_RANDOM = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingle_hashes(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, in order and with repeats; empty without words."""
    words = (data or b"").lower().split()
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    last = max(0, min(shingle, len(words)) - 1)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(text[s:e], SEED) for s, e in zip(starts.tolist(), ends[last:].tolist(), strict=False)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def band_keys(distinct: np.ndarray) -> list[int]:
    if not len(distinct):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(distinct), 2048):
        np.minimum(low, (distinct[at : at + 2048, None] * _TIMES + _PLUS).min(0), out=low)
    return [int.from_bytes(xxhash.xxh64_digest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i), "big", signed=True) for i in range(BANDS)]


def set_id(distinct: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(distinct.tobytes(), SEED), "big", signed=True)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row, doc_id, sid (of the shingle set), fp (SimHash), keys (of the bands) of each row; docs carry gm_row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, fps, keys = [], [], []
            for value in batch.column(2):
                hashes = shingle_hashes(value.as_py(), shingle)
                distinct = np.unique(hashes)
                sids.append(set_id(distinct))
                fps.append(majority(hashes) if len(hashes) else 0)
                keys.append(band_keys(distinct))
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "sid", "fp", "keys"])

    rows = docs.select(F.col("gm_row").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row struct<f:long,i:long>, doc_id long, sid long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """sid, items (the sorted set) of the sets in wanted (sid, first), whose texts are found by the row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(0)]
            yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "items"])

    rows = docs.select(F.col("gm_row").alias("first"), F.col("text").cast("binary").alias("text"))
    return rows.join(wanted.select("first").hint("merge"), "first", "left_semi").select("text").mapInArrow(run, "sid long, items binary")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b: sids) whose sets have the similarity. firsts: sid, first."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = materialize(sets_of(docs, materialize(firsts.join(wanted, "sid"), "similar-wanted"), shingle), "similar-sets")
    counts = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")), "similar-salts")
    salts, hot = counts.select("a", F.ceil(F.col("n") / SALT).cast("int").alias("salts")), hot_keys(counts, "a")
    left = sets.select(F.col("sid").alias("a"), F.col("items").alias("a_items")).join(salts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = materialize(join_by(pairs, salts, hot, "a").select("a", "b", F.expr("CAST(pmod(xxhash64(b), salts) AS int)").alias("salt")), "similar-dealt")
    both = dealt.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("b_items")).hint("merge"), "b").join(left.hint("merge"), ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                m, n = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                near = min(len(m), len(n)) + 1e-9 >= similarity * max(len(m), len(n))
                if near:
                    shared = len(np.intersect1d(m, n, assume_unique=True))
                    near = shared + 1e-9 >= similarity * (len(m) + len(n) - shared)
                keep.append(near)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def prefix_pairs(members: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b (sids, a < b): pairs of unlike label that the similarity may link, between members (sid, label).

    Each set is ordered by how many members hold a shingle, rarest first. Sets of the similarity share one in the prefixes of that
    order, and the first that they share leaves room for the overlap behind it in both; other pairs are never formed. A shingle that
    one member alone holds takes its place in the prefix but has no posting, so that a set with many of them meets nobody.
    """
    sets = materialize(sets_of(docs, materialize(firsts.join(members.select("sid"), "sid"), "similar-open-firsts"), shingle), "similar-open-sets")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, value in zip(batch.column(0), batch.column(1), strict=True):
                items = np.frombuffer(value.as_py(), np.int64)
                for at in range(0, len(items), 65536):
                    part = items[at : at + 65536]
                    columns = (np.full(len(part), sid.as_py(), np.int64), np.full(len(part), len(items), np.int32), part)
                    yield pa.record_batch([pa.array(c) for c in columns], ["sid", "size", "item"])

    pieces = sets.select("sid", "items").mapInArrow(spread, "sid long, size int, item long")
    held = materialize(pieces.groupBy("item").agg(F.count("*").alias("held")).filter("held > 1"), "similar-held")
    common = join_by(pieces, held, hot_keys(held, "item", "held"), "item")
    each = common.groupBy("sid").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("held", "item"))).alias("items"))
    # The prefix has the places that leave similarity * size shingles from there on; lone shingles stand first.
    each = each.withColumn("lone", F.col("size") - F.size("items"))
    each = each.withColumn("length", F.floor((1 - similarity) * F.col("size") + 1e-6).cast("int") + 1 - F.col("lone")).filter("length > 0")
    postings = each.select("sid", "size", "lone", F.posexplode(F.slice("items", F.lit(1), F.col("length"))).alias("at", "entry"))
    postings = postings.select("sid", F.col("entry.item").alias("item"), "size", (F.col("size") - F.col("lone") - F.col("at")).alias("room"))
    postings = materialize(postings.join(members, "sid"), "similar-postings")
    # A posting whose members are linked is settled; in others, members outside the largest group meet those of other groups.
    counts = postings.groupBy("item", "label").agg(F.count("*").alias("n"))
    groups = counts.groupBy("item").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    unsettled = materialize(postings.join(groups.select("item", "main"), "item"), "similar-unsettled")
    rest = unsettled.filter("label <> main").select("item", F.col("sid").alias("y"), F.col("label").alias("y_label"), F.col("size").alias("y_size"), F.col("room").alias("y_room"))
    enough = F.least("room", "y_room") * (1 + similarity) + 1e-6 >= similarity * (F.col("size") + F.col("y_size"))
    facing = F.expr("label <> y_label AND (label = main OR sid < y)")
    met = unsettled.join(rest.hint("merge"), "item").filter(facing & enough)
    return met.select(F.least("sid", "y").alias("a"), F.greatest("sid", "y").alias("b")).distinct()


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, label (one of the group's sets) of each row of docs; docs with a column gm_row keep it as row."""
    docs = docs if "gm_row" in docs.columns else with_row_id(docs)
    marked = materialize(signatures(docs, shingle), "similar-marked")
    sized = marked.groupBy("sid").agg(F.min("row").alias("first"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    distinct = materialize(sized, "similar-distinct")
    firsts = distinct.select("sid", "first")
    # Close fingerprints, from the trees.
    heads = materialize(distinct.groupBy("fp").agg(F.min("sid").alias("head")), "similar-heads")
    close = near_links(heads.select("fp"), RADIUS).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    equal = distinct.join(heads, "fp").filter("sid <> head").select(F.col("head").alias("x"), F.col("sid").alias("y"))
    # Members of bands, each with the hub of its block.
    bands = materialize(distinct.select("sid", F.explode("keys").alias("key")), "similar-bands")
    blocks = materialize(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "similar-blocks")
    hot = materialize(hot_keys(blocks, "key").select("key"), "similar-hot")
    shared = materialize(join_by(bands, blocks, hot, "key"), "similar-shared")
    ranked = materialize(shared.join(shared.groupBy("sid").agg(F.sum("n").alias("degree")), "sid").select("key", "sid", "degree"), "similar-ranked")
    hubs = materialize(ranked.groupBy("key").agg(F.max(F.struct("degree", "sid"))["sid"].alias("hub")), "similar-hubs")
    hubbed = join_by(ranked, hubs, hot, "key").filter("sid <> hub").select(F.col("hub").alias("x"), F.col("sid").alias("y"))
    ordered = [F.col("x").alias("a"), F.col("y").alias("b")]
    tried = materialize(close.select("x", "y").unionByName(equal).unionByName(hubbed).select(*ordered).distinct(), "similar-tried")
    links = materialize(verified(tried, docs, firsts, shingle, similarity), "similar-links")
    # What no hub settled: members outside the largest group of a block, with the members of its other groups.
    labels = components(links)
    placed = ranked.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    placed = materialize(placed, "similar-placed")
    groups = placed.groupBy("key", "label").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("groups"))
    unsettled = materialize(groups.filter("groups > 1"), "similar-unsettled-blocks")
    open_members = materialize(join_by(placed, unsettled, hot, "key").select("sid", "label").distinct(), "similar-open")
    across = prefix_pairs(open_members, docs, firsts, shingle, similarity)
    done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    later = across.join(done, ["a", "b"], "left_anti")
    later = materialize(later, "similar-later")
    if not later.isEmpty():
        labels = components(links.unionByName(materialize(verified(later, docs, firsts, shingle, similarity), "similar-later-links")))
    owned = firsts.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"))
    owned = materialize(owned, "similar-owned")
    return join_by(marked.select("row", "doc_id", "sid"), owned, hot_keys(distinct, "sid", "copies"), "sid").select("row", "doc_id", "label")
