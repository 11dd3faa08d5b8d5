"""Groups by similarity against brute force, and their defined cases."""

import random

import numpy as np

from glossmill.llm import common, similar, simhash


def brute_similar(rows):
    """Smallest id reachable over links of similarity 0.8, for (id, text) rows with unlike ids."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        lowest[find(i)] = min(key, lowest.get(find(i), key))
    return {key: lowest[find(i)] for i, (key, _) in enumerate(rows)}


def lowest(groups):
    """doc_id, smallest doc_id of its group, of each row."""
    rows, least = groups.collect(), {}
    for r in rows:
        least[r.label] = min((x for x in (least.get(r.label), r.doc_id) if x is not None), default=None)
    return [(r.doc_id, least[r.label]) for r in rows]


def copies(n_texts, n_copies, edits, seed):
    rng, rows = random.Random(seed), []
    for t in range(n_texts):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(n_copies):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(edits + 1)):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_groups_match_brute_force(spark):
    rows = copies(6, 25, 6, 1) + [(500 + i, t) for i, (_, t) in enumerate(copies(40, 2, 3, 2))]
    got = dict(lowest(similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == brute_similar(rows)
    assert 46 < len(set(got.values())) < len(rows) - 40


def test_odd_rows(spark):
    text = "one two three four five six seven " * 3000
    rows = [(9, None), (3, ""), (4, " \n"), (5, "two words"), (6, "Two  WORDS"), (7, text), (2, text), (2, text), (None, text), (11, "two wordz")]
    docs = spark.createDataFrame([(i, t, i, 1) for i, t in rows], "doc_id long, text string, sid long, key int")
    got = sorted(lowest(similar.similar_groups(docs)), key=str)
    assert got == sorted([(2, 2), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 2), (9, 3), (11, 11), (None, 2)], key=str)
    marked = common.with_row_id(docs)
    kept = simhash.one_per_group(marked, similar.similar_groups(marked)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 5, 11] and set(kept[0].__fields__) == set(docs.columns)
    # Different texts under one doc_id each stay, and so does a text without an id that nothing resembles.
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r"), (None, "s t u v w x"), (None, "s t u v w x")], "doc_id long, text string")
    marked = common.with_row_id(docs)
    kept = simhash.one_per_group(marked, similar.similar_groups(marked)).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "s"), (1, "a"), (1, "g"), (2, "m")]
    assert simhash.one_per_group(docs).count() == 4
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert similar.similar_groups(docs.limit(0)).collect() == []


def test_bands_find_pairs_of_the_least_similarity():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, 450).astype(np.uint64))
        a, b = np.sort(x[:400]), np.sort(np.concatenate([x[:356], x[400:444]]))
        missed += not set(similar.band_keys(a)) & set(similar.band_keys(b))
    assert missed == 0


def test_prefixes_keep_every_similar_pair_and_few_others(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = copies(3, 30, 8, 7) + [(900 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for key, text in rows:
        items = np.unique(similar.shingle_hashes(text.encode()))
        sets.setdefault(similar.set_id(items), (key, items))
    docs = common.with_row_id(docs)
    place = {r.doc_id: r.gm_row for r in docs.select("doc_id", "gm_row").collect()}
    firsts = spark.createDataFrame([(s, place[key]) for s, (key, _) in sets.items()], "sid long, first struct<f:long,i:long>")
    members = firsts.selectExpr("sid", "sid AS label")
    got = {tuple(r) for r in similar.prefix_pairs(members, docs, firsts, 5, 0.8).collect()}
    need = set()
    for a, (_, x) in sets.items():
        for b, (_, y) in sets.items():
            shared = len(np.intersect1d(x, y, assume_unique=True)) if a < b else 0
            if shared and shared + 1e-9 >= 0.8 * (len(x) + len(y) - shared):
                need.add((a, b))
    assert len(need) > 50 and need <= got
    assert not {s for s, (key, _) in sets.items() if key >= 900} & {s for pair in got for s in pair}
