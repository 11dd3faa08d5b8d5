"""The ten operators against brute force on small fixtures, and their defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossmill.llm import ans, cdc, chat, common, decontam, mixing, pii, quality, simhash, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}q" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(30)]
    texts = [*base, base[0], base[0], base[1] + " tail", None, "", " ", "x", words(rng, 20000), "é@ü+49 (30) 123-456-789 " + "a" * 3000]
    out = [(i, t, random.Random(i).choice(["en", "de", None]), f"src{i % 4}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[2], "en", "src1", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], DOCS + ", component_id string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# op1


def brute_base(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, s):
        d = [int(c) for c in s if "0" <= c <= "9"]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if good(k, m[0])]
    return sorted(found)


def test_pii_base_matches_brute_force():
    rng = random.Random(1)
    pieces = ["a.b@c.d", "@", "@@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "12", "+1 (555) 123-4567", "+", "++12 34567890", " ", " ", "-", ".", "é", "\n", "+4 ((((", "...", "a@b.c@d.e", "007.0.0.1", "0000.1.1.1", "%@-.-.", "0000 0000 0000"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert [(s, k, e) for s, k, e in pii.base_spans(text) if k != 2 or set(text[s:e]) - set("0 -")] == [x for x in brute_base(text) if x[1] != 2 or set(text[x[0] : x[2]]) - set("0 -")], text


def test_pii_discovers_by_context(spark, empty):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        value = f"user{i}@mail.example.com" if i < 30 else f"user{i}(at)host99887{i}"
        rows.append((i, f"{words(rng, 20)} contact address: {value} {words(rng, 9)}"))
    rows += [(100 + i, words(rng, 50) + f" version 3.{i}") for i in range(20)] + [(300, None), (301, "")]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i].n_email == 1 and out[i].n_context == 0 for i in range(30))
    assert all(out[i].n_email == 0 and "email_ctx:" in out[i].spans for i in range(30, 40))
    assert all(out[i].spans == "" for i in [*range(100, 120), 300, 301])
    text = rows[3][1]
    s, _, e = pii.base_spans(text)[0]
    assert out[3].base_sha256 == hashlib.sha256(f"email:{s}:{e}".encode()).hexdigest()
    assert pii.personal_data(empty).count() == 0


def test_pii_discovers_identifiers_with_blanks_and_short_ones(spark):
    rng = random.Random(8)
    said = {0: "mobile line", 1: "paid with", 2: "from host"}
    seeds = {0: "+1 (555) 200-{0:04}", 1: "4111 1111 1111 1111", 2: "10.0.{0}.1"}
    hidden = {0: ["(555) 123-4567", "555 123 4567", "555.123.4568"], 1: ["4111 1111 1111 1112"], 2: ["fe80::1", "fe::ab", "n417"]}
    # one number for all cards would be one seed: three that pass the check
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"]
    rows = [(i, f"{words(rng, 5)} {said[i % 3]} {cards[i // 3 % 4] if i % 3 == 1 else seeds[i % 3].format(i)} {words(rng, 5)}") for i in range(120)]
    wanted = {}
    for kind, values in hidden.items():
        for value in values:
            text = f"{words(rng, 5)} {said[kind]} {value} {words(rng, 5)}"
            at = text.index(value)
            wanted[1000 + len(wanted)] = f"{['phone', 'card', 'ip'][kind]}_ctx:{at}:{at + len(value)}"
            rows.append((1000 + len(wanted) - 1, text))
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: out[i].spans for i in wanted} == wanted
    assert all(out[i].n_context == 0 for i in range(120))


def test_secrets_are_seeds_and_their_contexts_find_others(spark):
    rng = random.Random(21)
    letters = "abcdefghijkmnpqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f"{words(rng, 5)} password={word(5)}7{word(6)} {words(rng, 5)}") for i in range(30)]
    rows += [(100 + i, f"{words(rng, 5)} AKIA{''.join(rng.choice('ABCDEFGH23456') for _ in range(16))} {words(rng, 5)}") for i in range(9)]
    rows += [(200 + i, f"{words(rng, 5)} password={word(9)} {words(rng, 5)}") for i in range(9)]  # no digit, so no seed
    rows += [(300 + i, f"{words(rng, 30)} page=chapter{i} colour={word(8)}") for i in range(40)]  # assigned, and no secret
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        at = text.find("password=") + 9 if "password=" in text else text.find("AKIA")
        kind = "secret" if i < 200 else "secret_ctx"
        assert out[i].spans == ("" if i >= 300 else f"{kind}:{at}:{text.index(' ', at)}")
    assert all(out[i].n_spans == (i < 300) for i, _ in rows)


def slow_scores(found):
    """What pii.believed gives, by dictionaries. found: k, value, contexts."""
    n, total = Counter(), Counter()
    for k, value, contexts in found:
        for c in contexts:
            n[c, max(k, -1), value] += 1
            total[c] += 1
    values = {c: [(k, v) for d, k, v in n if d == c] for c in total}
    values = {c: x for c, x in values.items() if len(x) > pii.SUPPORT and any(k < 0 for k, _ in x)}
    known = {}
    while True:
        good = {}
        for c, held in values.items():
            for kind in range(5):
                told = [n[c, k, v] * (1.0 if k >= 0 else known[v][1]) for k, v in held if k == kind or (k < 0 and known.get(v, (None,))[0] == kind)]
                if len(told) >= pii.SUPPORT and (p := sum(told) / (total[c] + pii.DOUBT)) >= pii.GOOD_CONTEXT:
                    good[c, kind] = p
        scores = {}
        for (c, kind), p in good.items():
            for k, v in values[c]:
                if k < 0:
                    scores[v, kind] = 1 - (1 - scores.get((v, kind), 0.0)) * (1 - p)
        new = dict(known)
        for (v, kind), score in scores.items():
            if score >= pii.BELIEVED and (v not in new or (score, -kind) > (new[v][1], -new[v][0])):
                new[v] = (kind, score)
        if len(new) == len(known):
            return new
        known = new


def test_graph_scores_match_brute_force(spark):
    rng = random.Random(31)
    found = []
    for _ in range(900):
        kind = rng.choice([0, 0, 1, 4, -1, -1, -1])
        contexts = [f"c{rng.randrange(6) + 6 * (kind if kind >= 0 else rng.choice([0, 1, 4]))}" for _ in range(rng.randrange(3))]
        found.append((kind, f"v{rng.randrange(60)}{'' if kind < 0 else f'k{kind}'}", contexts + [f"rare{rng.randrange(5000)}"]))
    table = spark.createDataFrame(found, "k int, value string, contexts array<string>")
    names = {r.v: r.value for r in table.select("value", F.xxhash64("value").alias("v")).distinct().collect()}
    got = {names[r.v]: (r.kind, round(r.score, 9)) for r in pii.believed(table).collect()}
    want = {v: (k, round(p, 9)) for v, (k, p) in slow_scores(found).items()}
    assert want and {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
    assert got == want


def test_contexts_take_whole_words():
    text = "x " + "y" * 5000 + " is kept at 417 now\nnext 5"
    at = text.index("417")
    assert pii.contexts(text, at, at + 3) == ("1 at ", "2 kept at ", "3 at _now")
    assert pii.contexts(text, len(text) - 1, len(text)) == ("1 next ", None, None)
    start = text.index("is")
    one, two, _ = pii.contexts(text, start, start + 2)
    assert one == f"1 {xxhash.xxh64_hexdigest('y' * 5000)} " and two == f"2 x {one[2:]}"
    assert pii.contexts("a" + " " * 40 + "5", 41, 42) == (None, None, None) == pii.contexts("5", 0, 1)


def test_pii_on_odd_rows(docs, rows):
    assert pii.personal_data(docs).count() == len(rows)


# op2


def slow_cuts(data):
    """The cuts, one place after the other."""
    top = 2**32 - 1
    hashes = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - cdc.WIDTH + 1) : i + 1]:
            h = ((h << 1) + int(cdc.GEAR[b])) % 2**32
        hashes.append(top if i < cdc.WIDTH - 1 or (i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80) else h)
    found = {i for w in range(len(data) - cdc.GAP + 1) for i in range(w, w + cdc.GAP) if hashes[i] == min(hashes[w : w + cdc.GAP]) != top}
    found -= {i for i in found if hashes[i] in hashes[max(0, i - cdc.EVEN) : i]}
    return sorted({0, len(data)} | {i + 1 for i in found})


def slow_spans(rows):
    """(doc_id, start, end, first) of each repeat, by dictionaries."""
    pieces = []
    for n, (doc_id, text) in enumerate(rows):
        data, at = (text or "").encode(), slow_cuts((text or "").encode())
        spans = [(s, next((e for e in at if e >= s + cdc.CHUNK), None)) for s in at[:-1]]
        spans = [x for x in spans if x[1]] or [(0, len(data))] * bool(data)
        for s, e in spans:
            pieces.append((data[s:e], (n, s), e))
    by = {}
    for piece, place, _ in pieces:
        by.setdefault(piece, []).append(place)
    runs = {}
    for piece, place, e in sorted((x for x in pieces if len(by[x[0]]) > 1), key=lambda x: x[1]):
        of = runs.setdefault(place[0], [])
        first = place == min(by[piece])
        if of and place[1] <= of[-1][1]:
            of[-1] = (of[-1][0], e, of[-1][2] and first)
        else:
            of.append((place[1], e, first))
    return Counter((rows[n][0], s, e, f) for n, of in runs.items() for s, e, f in of if e - s >= cdc.LEAST)


def test_cuts_resist_shifts_and_never_lie_far_apart(monkeypatch):
    rng = random.Random(2)
    data = words(rng, 1000).encode()
    a, b = (set(cdc.chunks(x)[2].tolist()) for x in (data, b"some words in front " + data))
    assert len(a - b) <= 6 and cdc.cuts(b"").tolist() == [0]
    for x in (data, "é€😀x".encode() * 60, b"ab" * 500, b"a" * 300, words(rng, 20).encode() * 3, b"short", bytes(range(97, 110)) * 9):
        assert cdc.cuts(x).tolist() == slow_cuts(x)
    whole = cdc.cuts(data)
    assert np.diff(whole[1:-1]).max() <= cdc.GAP
    monkeypatch.setattr(cdc, "SECTION", 100)
    assert cdc.cuts(data).tolist() == whole.tolist()


def test_every_repeat_from_the_sure_length_on_is_found():
    """The recall by length; letters of a small alphabet make short words."""
    rng = random.Random(6)
    for least, length in ((0.9, 160), (0.99, 196), (1.0, cdc.SURE)):
        found = 0
        for _ in range(200):
            text = lambda n: "".join(rng.choice("abcdefgh    ") for _ in range(n)).encode()
            passage = text(length)
            one, two = (cdc.chunks(text(150) + passage + text(150)) for _ in range(2))
            shared, run, best = set(one[2].tolist()), None, 0
            for s, e, d in zip(*(x.tolist() for x in two)):
                if d in shared:
                    run = (run[0], e) if run and s <= run[1] else (s, e)
                    best = max(best, run[1] - run[0])
            found += best >= cdc.LEAST
        assert found >= least * 200


def test_spans_and_cleaned_texts_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    passages = [words(rng, 30, 10**6) for _ in range(8)]
    rows = [(i, " ".join([words(rng, 15, 10**6), rng.choice(passages), words(rng, 9, 10**6), *rng.sample(passages, rng.randrange(3))])) for i in range(40)]
    rows += [rows[4], rows[4], (None, rows[7][1]), (None, rows[7][1]), (None, None), (50, ""), (51, "x"), (52, "x"), (53, passages[0] + passages[0])]
    table = spark.createDataFrame([(a, b, "d") for a, b in rows], "doc_id long, text string, digest string").coalesce(1)
    for hot in (cdc.hot_keys, lambda counts, key, n: counts.filter("times > 3")):  # and with the hot way
        monkeypatch.setattr(cdc, "hot_keys", hot)
        got = Counter((r.doc_id, r.start, r.end, r.first) for r in cdc.repeated_spans(table).collect())
        assert got == slow_spans(rows)
    kept = cdc.remove_repeats(table).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "digest"] and len(kept) == len(rows)
    same = sorted(len(r.text) for r in kept if r.doc_id == 4)
    assert sum(n < 60 for n in same) == 2  # of equal rows the first stays
    assert sum(not r.text for r in kept if r.doc_id is None) >= 2


def test_repeats_are_found_and_clean_texts_left(spark, empty, docs):
    rng = random.Random(4)
    passages = [words(rng, 55, 10**6) for _ in range(60)]
    rows = [(i, f"{words(rng, 60, 10**6)} {passages[i % 60]} {words(rng, 60, 10**6)}") for i in range(180)] + [(1000 + i, words(rng, 200, 10**6)) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = cdc.repeated_spans(table).collect()
    assert {r.doc_id for r in found} == set(range(180))
    assert sum(r.first for r in found) == 60
    cleaned = {r.doc_id: r.text for r in cdc.remove_repeats(table).collect()}
    texts = dict(rows)
    assert all(sum(cleaned[i + k] == texts[i + k] for k in (0, 60, 120)) == 1 for i in range(60))  # one of three keeps it
    assert all(len(cleaned[i]) < len(t) - 100 or cleaned[i] == t for i, t in rows) and all(cleaned[i] == texts[i] for i in range(1000, 1100))
    assert cdc.repeated_spans(empty).count() == 0
    kept = cdc.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_chunks_of_common_passages_are_joined_as_they_are_read(spark, monkeypatch):
    """A common passage is one row in each text when it comes to the runs, and no lookup can multiply it."""
    monkeypatch.setattr(cdc, "hot_keys", lambda counts, key, n: counts.filter("times > 3"))
    rng = random.Random(8)
    passage, rows = words(rng, 60, 10**6), []
    for i in range(80):
        rows.append((i, f"{words(rng, 20, 10**6)} {passage} {words(rng, 20, 10**6)}"))
    spans = cdc.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    kinds = Counter(re.findall(r"\bJoin (\w+)", spans._jdf.queryExecution().optimizedPlan().toString()))
    assert set(kinds) == {"LeftSemi", "LeftAnti", "Inner"} and kinds["Inner"] == 1  # the last one names the rows
    found = spans.collect()
    assert len(found) == 80 and [r.doc_id for r in found if r.first] == [0]
    assert all(len(r.later) > 5 for r in found if r.doc_id) and not found[[r.doc_id for r in found].index(0)].later
    pieces = [(i % 2, n, 40 * i << 32 | 40 * i + 50) for n in range(70) for i in range(30)]
    joined = cdc.stretches(spark.createDataFrame(pieces, "digest long, n long, span long").coalesce(1), {0: (0, 50), 1: (0, 40 << 32 | 90)}).collect()
    assert [(r.n, r.first, r.start, r.end, len(r.later)) for r in joined] == [(n, False, 0, 1210, 30 - 2 * (n == 0)) for n in range(70)]


# op3


def slow_top(vectors, k=20, scale=64):
    """query_id, rank, vec_id, score by whole numbers of any size."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    good = [(i, [max(-(2**62), min(2**62, x)) for x in v]) for i, v in good]
    for n, (q, v) in enumerate(good):
        if q % 20 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v)]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]))


@pytest.mark.parametrize("size", [1.0, 1.0e6, 1.0e9, 1.0e300])
def test_top_k_is_exact(spark, monkeypatch, size):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) * size for x in np.round(rng.normal(size=8), 1)]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)] + [vectors[3], vectors[20], vectors[20], (2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2005, []), (2020, []), (2040, [3.0, 1.0, 2.0]), (2041, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(a, b, 1) for a, b in vectors], "vec_id long, embedding array<double>, rank int")
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert Counter(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0).collect())) == Counter(slow_top(vectors))
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_with_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(table, F.col("vec_id") % 20 == 0).count() == 2


def test_lists_are_read_in_order_and_only_as_far_as_needed():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-64, 64, (501, 16)), rng.integers(-64, 64, (9, 16))
    lists = topk.Lists(x)
    for share in (0.01, 0.3, 0.45, 0.5):
        lists.read_to(share)
        assert lists.count == lists.seen.sum() and (lists.values == np.where(lists.seen, x, 0)).all()
        assert all((x[~lists.seen[:, d], d] >= lists.low[d]).all() and (x[~lists.seen[:, d], d] <= lists.high[d]).all() for d in range(16))
        low, high = lists.bounds(q, lists.seen.astype(float), lists.values.astype(float))
        score = q @ x.T
        assert (low <= score).all() and (score <= high).all()
    assert lists.ended and lists.count == x.size
    # Two far groups: the bounds settle early, and reading stops before the middle, where the small values lie.
    x = np.concatenate([rng.integers(900, 1000, (30, 4)), rng.integers(-9, 9, (2000, 4)), rng.integers(-1000, -900, (30, 4))])
    ids = np.arange(len(x))
    lists = topk.Lists(x)
    found = list(topk.block_top(lists, ids, ids, np.arange(5), x[:5], 20))
    assert lists.count < x.size
    for i, at, scores in found:
        want = sorted((-int(x[i] @ v), j) for j, v in enumerate(x) if j != i)[:20]
        assert [(-s, j) for s, j in zip(scores.tolist(), at.tolist(), strict=True)] == want


# op4


def brute_contamination(docs, bench, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in bench:
        w = split(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[k]
        yield doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"W{i}" for i in range(6)] + ["é", "Ü9"]
    text = lambda n: rng.choice([" ", "-", "\x00"]).join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 9, 10, 14, 30]))) for i in range(1, 25)] + [(7, "W1 W1 W1"), (None, "W2 W3 W2"), (99, None), (98, "")]
    docs = [(i, text(rng.randrange(80))) for i in range(150)] + [(1, None), (2, ""), (3, bench[2][1] * 1)] + [(200, text(30000)), (5, docs_long := text(12)), (5, docs_long), (None, bench[5][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = Counter(brute_contamination(docs, bench))
    monkeypatch.setattr(decontam, "SHARD_WORDS", 5000)
    assert Counter(map(tuple, decontam.contamination(d, b).collect())) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert Counter(map(tuple, decontam.contamination(d, b).collect())) == want
    kept = decontam.remove_contaminated(d, b)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in want.elements() if not x[5])
    assert decontam.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(d.limit(0), b).count() == 0


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k l y"), (2, "q c d e f g h i j k l m")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(5, "zz a b c d e f g h i j k l m")], "item_id long, text string")
    found = {r.item_word: (r.doc_id, r.doc_word, r.words) for r in decontam.longest_matches(d, b).collect()}
    assert found == {1: (1, 1, 12), 2: (1, 2, 11), 3: (2, 1, 11), 4: (2, 2, 10)}


# op5


def test_ans_round_trip_and_damage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 5000, 300_000):
        ids = np.minimum(rng.zipf(1.3, n), 40000).astype(np.int64)
        table = ans.FrequencyTable.from_counts(np.bincount(ids, minlength=40001))
        assert table.freq.sum() == 1 << table.bits
        table = ans.FrequencyTable.from_bytes(table.to_bytes())
        data = ans.encode_block(ids, [(3, n)], table)
        assert (ans.decode_block(data, table) == ids).all()
        head, _ = ans.read_header(data)
        if head["marks"] > 1:  # the parts decode apart from each other
            last = ans.decode_part(data, table, head["marks"] - 1)
            assert (last == ids[-len(last) :]).all()
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        ans.decode_block(bytes(broken), table)
    one = ans.FrequencyTable.from_counts(np.array([0, 9]))
    assert (ans.decode_block(ans.encode_block(np.ones(100, np.int64), [], one), one) == 1).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name, monkeypatch):
    import public_tokenizers

    encoder = ans.TextEncoder(public_tokenizers.path(name))
    assert encoder.by_words == name.startswith("word")
    monkeypatch.setattr(encoder, "CHARS", 200)
    encoder.words.most = 500
    rng = random.Random(8)
    signs = ["don't", "WE'LL", "''s", "!'s", "a", "É", "ß", "ﬁ", "İ", "Σς", "ΑΣ", "\x1c", "\x85", "\xa0", "²", "½", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "é", " ", "\n", "\t", "--", "\x00", "ŉ", "ſ", "ª", "µ", "😀", "\x7f", "'", "x'x", "end.", "(a)", "ÿ%%%", "\u0301", "\u200d", "w" * 60]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(9)))
        assert encoder.encode(text) == encoder.whole(text), repr(text)
    texts = [" ".join(rng.choice(["it's", "we're", "x'll", "'dy", "'", "''t", "a1b22", "Über", "naïve!?", "\n", ""]) for _ in range(rng.randrange(90))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0x3000), 32])) for _ in range(40)) for _ in range(1500)]
    assert encoder.encode_many(texts) == [encoder.whole(x) for x in texts]
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    assert encoder.encode(f"{word} {other} {word}") == encoder.whole(f"{word} {other} {word}")


def test_token_output_matches_the_library(spark, docs, rows, empty):
    import public_tokenizers

    encoder = ans.encoder_at(public_tokenizers.path("word_bpe_49k.json"))
    got = ans.token_output(docs).collect()
    ids = sorted(((r[0] is not None, r[0] or 0, encoder.whole(r[1] or "") + b"\x01\x00") for r in rows), key=lambda x: x[:2])
    start, want = 0, Counter()
    for r, (has, key, _) in zip(sorted(got, key=lambda r: r.start), ids, strict=True):  # in ascending order, each where the one before ends
        assert (r.doc_id, r.start) == (key if has else None, start)
        start += r.n_tokens
    for has, key, data in ids:
        n = np.frombuffer(data, "<u2").astype("<u4")
        want[key if has else None, len(n), zlib.crc32(n.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert ans.token_output(empty).count() == 0


# op6


def test_quality_separates_and_scores_everything(spark, docs, rows, empty):
    rng = random.Random(9)
    good = [(i, "The " + words(rng, 60, 300)) for i in range(200)]
    bad = [(1000 + i, " ".join(f"BUY{rng.randrange(50)}!! $$$" for _ in range(60))) for i in range(200)]
    table = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7777, 1), (None, 0), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality(table, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    tested = [(r, i < 1000) for i, r in out.items() if r.held_out and i < 5000]
    assert tested and all(r.predicted == int(g) for r, g in tested)
    assert out[5000].score == out[5001].score and 0 <= out[5000].score <= 1
    assert quality.keep_good(table, labels).count() == sum(r.predicted for r in out.values())
    assert quality.quality(docs, labels).count() == len(rows) and quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).filter("score = 0.5").count() == len(rows)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_scores_match_brute_force(spark):
    """The raw score by single calls of the library, the curve by its own equations, and long texts as good as short ones in the fit."""
    import zstandard

    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(["tree", "river", "stone", "light"]) + str(rng.randrange(9)) for _ in range(rng.choice([30, 300, 30000])))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(["buy", "now", "cheap", "click"]) + str(rng.randrange(9)) for _ in range(rng.choice([30, 300])))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    picked = quality.sample(table, labels)
    assert len(picked) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows) == len(quality.sample(table.repartition(7), labels))
    assert picked == quality.sample(table.repartition(7), labels)  # the same rows in the same order
    blocks = {b for _, t in rows for b in quality.blocks_of(t.encode())}
    assert all(0 < len(t) <= quality.SAMPLE_BLOCKS and set(t) <= blocks for _, t in picked)
    model = quality.fit(table, labels)
    dicts = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]

    def raw(text):
        size = [sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(text[i : i + 1024])) for i in range(0, len(text), 1024)) for d in dicts]
        return (size[1] - size[0]) / len(text)

    knots, shares = model.curve
    assert knots == sorted(knots) and shares == sorted(shares) and 0 <= shares[0] < shares[-1] <= 1
    scored = {r.doc_id: r.score for r in quality.quality(table, labels).collect()}
    for i, text in rows[::7]:
        x = raw(text.encode())
        k = sum(knot <= x for knot in knots)
        want = shares[0] if k == 0 else shares[-1] if k == len(knots) else shares[k - 1] + (shares[k] - shares[k - 1]) * (x - knots[k - 1]) / (knots[k] - knots[k - 1])
        assert math.isclose(scored[i], want, rel_tol=1e-9)
    # By hand: bins of two, of which the second and third are pooled, as they fall.
    x, y, w = np.arange(8.0), np.array([0.0, 0, 1, 1, 0, 1, 1, 1]), np.array([1.0, 1, 1, 1, 1, 3, 1, 1])
    knots, shares = quality.calibrate(x[::-1], y[::-1], w[::-1], 2)
    assert np.allclose(knots, [0.5, (2 + 3 + 4 + 15) / 6, 6.5]) and np.allclose(shares, [0, 5 / 6, 1])


# op7


def test_shares_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "d", 50)], "domain string, lang string, source string, n long")
    got = {r.source: r.target for r in mixing.leaf_budgets(leaves, 400, 1, ({"d0": 1, "d1": 1}, {"en": 1, "de": 1}, {})).collect()}
    assert got == {"a": 10, "b": 165, "c": 175, "d": 50}


def test_mixing_takes_whole_epochs_and_a_prefix(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "en", f"src{i % 3}", 0) for i in range(600)]
    table = spark.createDataFrame(rows, DOCS)
    picked = mixing.select_mix(mixing.counted(table), 90, 3).collect()
    total = sum(1 + i % 5 for i in range(600))
    assert abs(sum(r.take_tokens for r in picked) - total * 90 // 100) <= 3
    d0 = [r for r in picked if r.domain == "d0"]
    assert max(r.epoch for r in d0) == 1 and sum(r.epoch == 0 for r in d0) == 200
    edge = [r for r in picked if r.take_tokens < r.n_tokens]
    assert len(edge) <= 3
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_matches_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.drop("component_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op7_mixing(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.OP7_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


# op8


def test_archives_round_trip(spark):
    big = "<p>" + "é" * 200
    pages = [(5, "http://a/b c\n", big), (2, None, big), (9, "u", big), (3, "v", "small"), (4, "w", "small"), (6, "x", None), (7, "y", ""), (2, "z", big), (None, "n", big), (11, "l", "q" * 300_000), (12, "l", "<a>\r\n\r\nWARC/1.1\r\n" * 20)]
    table = spark.createDataFrame([(a, b, c, "k") for a, b, c in pages], "page_id long, url string, html string, digest string")
    folder = common.fresh_path(spark, "test-warc")
    got = Counter(map(tuple, warc.read_archives(warc.write_archives(table, folder), folder).collect()))
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= 100 and html == big and i != 2
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    folder = common.fresh_path(spark, "test-warc")
    assert warc.read_archives(warc.write_archives(table.limit(0), folder), folder).count() == 0


def test_dictionary_leads_the_archive(spark):
    import struct

    folder = common.fresh_path(spark, "test-warc")
    table = spark.createDataFrame([(i, "u", f"<html><body>page {i} " + "same text " * 20) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    name = warc.write_archives(table, folder).first().path
    store, root = common.open_store(folder)
    data = store.open_input_file(f"{root}/{name}").read()
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D and len(list(warc.records_in(io.BytesIO(data)))) == 50 == len(list(warc.records_in(io.BytesIO(data), 7)))


# op9


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs, rows, empty):
    fps = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components(fps)
    low = {}
    for r, c in zip(rows, comps, strict=True):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    want = Counter((r[0], f, low.get(c)) for r, f, c in zip(rows, fps, comps, strict=True))
    got = simhash.near_duplicate_groups(docs)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()) == want
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({*low.values()})  # the row without an id shares its text with another
    assert simhash.near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("shard,leaf", [(32768, 512), (40, 16)])
def test_trees_lose_no_link(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(12)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):  # chains and dense clusters
        fps.append(rng.choice(fps[-40:]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))) % 2**64)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r.node: r.label for r in simhash.components(links).collect()}
    comps = brute_components(fps)
    groups = {}
    for x, c in zip(signed, comps, strict=True):
        groups.setdefault(c, []).append(x)
    for members in groups.values():
        assert {label.get(x, x) for x in members} == {min(members)}


def shuffled(spark):
    """Bytes written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_shuffled_fingerprints_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 128)
    sent = []
    for n in (4000, 16000):
        before = shuffled(spark)
        assert simhash.near_links(spark.range(n).selectExpr("xxhash64(id) AS fp")).count() < 10
        sent.append(shuffled(spark) - before)
    assert sent[1] < 6 * sent[0]


def test_large_shards_lose_no_link(spark, monkeypatch):
    """All fingerprints share the value of two segments, whose one shard is compared in pairs of blocks."""
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "BLOCK", 30, raising=False)
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(12) << 20 | rng.getrandbits(3) for _ in range(300)})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 1)
    found = simhash.components(links).collect()
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 1]
    assert {r.node for r in found} == {x for pair in near for x in pair}
    label = {r.node: r.label for r in found}
    assert all(label[a] == label[b] for a, b in near) and all((r.a ^ r.b).bit_count() == 1 for r in links.collect())


# op10


def test_escape_is_reversible():
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", "<|", "<|im_end|>", "<|im_start|>", "\n", "é", "n"]) for _ in range(rng.randrange(10)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        turns = [(text[::-1], text), ("assistant", text)]
        out, spans, loss, rewrites = chat.render(chat.marked_turns, turns)
        assert not rewrites and chat.parse_turns(out) == turns
        assert spans[-1][1] == len(out) and chat.unescape(out[loss[-1][0] : loss[-1][1]]) == text


def test_rewriting_templates_are_detected():
    def last_only(turns):
        return "".join(f"[{r}] {t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))

    assert chat.render(last_only, [("user", "a"), ("assistant", "b")])[3]
    assert not chat.render(lambda ts: "".join(t for _, t in ts), [("user", "a"), ("assistant", "b")])[3]


def test_conversations_of_any_kind(spark, tmp_path):
    import duckdb

    rows = [(1, 1, "assistant", "b<|x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (3, 5, "assistant", ""), (None, 0, "user\nx\\n", "é"), (4, None, "assistant", "<\\|"), (4, 1, "system", "s" * 50_000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    table.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op10_chat(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.OP10_SQL})").fetchall())
