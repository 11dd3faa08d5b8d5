"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction for identifiers that they miss.

One pass over the texts finds the seeds (email, ip, card, phone, and secrets: keys of known makes and what is assigned to a password or token) and
everything else that looks like an identifier: each token with a digit, an at sign or a double colon, each whole run of digits with blanks,
brackets, points and hyphens, and each token that is assigned with "=" or ":". Each has its lexical contexts on its line: the word
before it, the two words before it, and the word before with the word after, with the signs between. Of discoveries that lie in one another the
outermost is returned. Contexts and identifiers are a graph. Spark scores it in rounds until no identifier more is believed: a context is as good
as the share of its occurrences that hold seeds or identifiers already believed, smoothed and with a least number of different ones; an unseen
identifier is believed as far as its good contexts make it. What is believed at the end is added as <kind>_ctx. Seeds are never changed.

Defined cases: null and empty texts have no span; each row is a row of its own, also if rows are equal or their doc_ids null; context words are taken
whole, those over LONG characters by their digest; more than GAP signs between word and identifier are no context; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

#: The kinds of the base, in order, and the method's own.
KINDS, SECRET = ("email", "ip", "card", "phone"), 4
ALL_KINDS = (*KINDS, "secret")
#: Least different identifiers of a context, the weight of doubt against a context, least scores of contexts and identifiers.
SUPPORT, DOUBT, GOOD_CONTEXT, BELIEVED = 3, 2.0, 0.5, 0.6
LONG, GAP = 64, 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search
_ANCHOR = re.compile(r"[@0-9]|::").finditer
_ASSIGNED = re.compile(r"[=:] ?[\"']?(?=[^\s\"'<>\[\]{};,|=*$&%#!?:/]{6})").finditer
# Makes of keys, and names of what is kept secret.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])").finditer
_NAMED = re.compile(r"(?i:password|passwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_.~-]{8,}+)").finditer
_RUN = re.compile(r"(?:(?<![\w@])|(?=[+(]))[+(]{0,2}[0-9]++(?![\w@])(?:[ ().-]*+[0-9]++(?![\w@]))*+").finditer


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the at signs, so that long runs of letters cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the seeds, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT(text):
        out += [(m.start(), 1, m.end()) for m in _IP(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of keys and of assigned secrets with a digit, clear of one another."""
    found = [m.span() for m in _KEY(text)] + [m.span(1) for m in _NAMED(text) if _DIGIT(m[1])]
    out, last = [], 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= last:
            out.append((start, SECRET, end))
            last = end
    return out


def _name(word: str) -> str:
    return word.lower() if len(word) <= LONG else xxhash.xxh64_hexdigest(word.lower())


def _word_before(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The whole word that ends before at, at most GAP signs away."""
    end = at
    while end > low and text[end - 1] in _BREAK:
        end -= 1
        if at - end > GAP:
            return None
    start = end
    while start > low and text[start - 1] not in _BREAK:
        start -= 1
    return (start, end) if start < end else None


def contexts(text: str, start: int, end: int) -> tuple[str | None, str | None, str | None]:
    """The word before the span, the two words before it, and the word before with the word after; null where the line has none."""
    low = text.rfind("\n", 0, start) + 1
    one = _word_before(text, start, low)
    if one is None:
        return None, None, None
    head = _name(text[slice(*one)]) + re.sub(r"\s+", " ", text[one[1] : start])
    two = _word_before(text, one[0], low)
    at, top = end, min(len(text), end + GAP)
    while at < top and text[at] in _BREAK and text[at] != "\n":
        at += 1
    stop = at
    while stop < len(text) and text[stop] not in _BREAK:
        stop += 1
    return f"1 {head}", None if two is None else f"2 {_name(text[slice(*two)])} {head}", f"3 {head}_{_name(text[at:stop])}" if stop > at else None


def tokens(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the tokens without blanks that hold a digit, an at sign or a double colon, or are assigned, clear of the seeds."""
    out, k, seen = [], 0, 0
    anchors = sorted([m.span() for m in _ANCHOR(text)] + [(m.end(), m.end() + 1) for m in _ASSIGNED(text)])
    for at, to in anchors:
        if at < seen:
            continue
        while k < len(seeds) and seeds[k][2] <= at:
            k += 1
        if k < len(seeds) and seeds[k][0] <= at:
            continue
        start, end = at, to
        low = max(seeds[k - 1][2] if k else 0, seen)
        while start > low and text[start - 1] not in _BREAK:
            start -= 1
        top = seeds[k][0] if k < len(seeds) else len(text)
        while end < top and text[end] not in _BREAK:
            end += 1
        seen = end
        while end > to and text[end - 1] in ".:)(-":
            end -= 1
        out.append((start, end))
    return out


def runs(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of whole runs of digits with blanks, brackets, points and hyphens, the shapes of phone and card without their check, clear of the seeds."""
    edges = [0, *(x for s, _, e in seeds for x in (s, e)), len(text)]
    return [m.span() for low, top in zip(edges[::2], edges[1::2], strict=True) for m in _RUN(text, low, top)]


def candidates(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, k) of other identifier-like spans, clear of the seeds: whole runs and single tokens, which can lie in a run.
    k is -1, or -2 where a longer candidate starts at the same place: it is no occurrence of its own of the words before it."""
    if not ("@" in text or ":" in text or "=" in text or _DIGIT(text)):
        return []
    out, last = [], -1
    for start, end in sorted({*tokens(text, seeds), *runs(text, seeds)}, key=lambda x: (x[0], -x[1])):
        out.append((start, end, -2 if start == last else -1))
        last = start
    return out


#: Signs that end an identifier-like token.
_BREAK = frozenset(" \t\n\r\v\f\"'<>[]{};,|=*$&%#!?")
_SPAN = "struct<start:long,k:int,end:long>"
_SCHEMA = f"row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{_SPAN}>, secrets array<{_SPAN}>, found array<struct<k:int,start:long,end:long,value:string,contexts:array<string>>>"


def first_pass(docs: DataFrame) -> DataFrame:
    """Of each row: its number, the counts and digest of the base, its spans, the secrets, and all identifiers with their contexts (k: kind of a seed, below 0 of others)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64())])
        found_type = pa.struct([("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])
        target = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((f"n_{x}", pa.int64()) for x in KINDS), ("base_sha256", pa.string()), ("base", pa.list_(span)), ("secrets", pa.list_(span)), ("found", pa.list_(found_type))])
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                base, secrets = base_spans(text), secret_spans(text)
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                sha = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
                seeds = sorted(base + secrets)
                covered = []
                for s, _, e in seeds:
                    if covered and s < covered[-1][2]:
                        covered[-1] = (covered[-1][0], 0, max(e, covered[-1][2]))
                    else:
                        covered.append((s, 0, e))
                spots = [(k, s, e) for s, k, e in seeds] + [(k, s, e) for s, e, k in candidates(text, covered)]
                found = [{"k": k, "start": s, "end": e, "value": text[s:e], "contexts": [c for i, c in enumerate(contexts(text, s, e)) if c and (k != -2 or i == 2)]} for k, s, e in spots]
                named = lambda spans: [{"start": s, "k": k, "end": e} for s, k, e in spans]
                rows.append({"row": row, "doc_id": doc_id, **{f"n_{x}": c for x, c in zip(KINDS, n, strict=True)}, "base_sha256": sha, "base": named(base), "secrets": named(secrets), "found": found})
            yield pa.RecordBatch.from_pylist(rows, target)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def believed(found: DataFrame) -> DataFrame:
    """v (hash of the value), kind, score of unseen identifiers: the pattern-instance graph scored in rounds. found: k, value, contexts."""
    pairs = found.select(F.greatest("k", F.lit(-1)).alias("k"), F.xxhash64("value").alias("v"), F.explode("contexts").alias("context"))
    edges = materialize(pairs.groupBy("context", "v", "k").agg(F.count("*").alias("n")), "pii-edges")
    # Only a context with that many different values, an unseen one among them, can ever say something.
    sizes = edges.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("values"), F.count_if(F.col("k") < 0).alias("unseen"))
    useful = materialize(sizes.filter((F.col("values") > SUPPORT) & (F.col("unseen") > 0)).select("context", "total"), "pii-contexts")
    edges = materialize(edges.join(useful, "context"), "pii-open")
    seeds = edges.filter("k >= 0").select("context", F.col("k").alias("kind"), "v", "n", F.lit(1.0).alias("weight"), "total")
    unseen = edges.filter("k < 0").select("context", "v", "n", "total")
    known, size = None, 0
    while True:
        told = seeds
        if known is not None:
            told = seeds.unionByName(unseen.join(known, "v").select("context", "kind", "v", "n", F.col("score").alias("weight"), "total"))
        scored = told.groupBy("context", "kind").agg((F.sum(F.col("n") * F.col("weight")) / (F.max("total") + DOUBT)).alias("p"), F.count("*").alias("values"))
        good = materialize(scored.filter((F.col("p") >= GOOD_CONTEXT) & (F.col("values") >= SUPPORT)).select("context", "kind", "p"), "pii-good")
        reached = unseen.join(good, "context").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
        reached = reached.filter(F.col("score") >= BELIEVED)
        if known is not None:  # what was believed stays so, with its best score
            reached = reached.unionByName(known)
        best = reached.groupBy("v").agg(F.max(F.struct("score", (-F.col("kind")).alias("low"))).alias("b"))
        known = materialize(best.select("v", (-F.col("b.low")).alias("kind"), F.col("b.score").alias("score")), "pii-believed")
        before, size = size, known.count()
        if size == before:
            return known


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (base, secrets and discoveries), n_secret, n_context, n_spans."""
    marked = materialize(first_pass(docs), "pii-rows")
    found = marked.select("row", F.explode("found").alias("f")).select("row", "f.*")
    chosen = believed(found)
    new = found.filter("k < 0").withColumn("v", F.xxhash64("value")).join(chosen, "v").select("row", "start", "end", F.struct("start", (F.col("kind") + len(ALL_KINDS)).cast("int").alias("k"), "end").alias("s"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("end").over(before)).filter("reach IS NULL OR end > reach")
    new = materialize(new.groupBy("row").agg(F.collect_list("s").alias("more")), "pii-new")
    names = F.array(*[F.lit(x) for x in ALL_KINDS], *[F.lit(f"{x}_ctx") for x in ALL_KINDS])
    out = marked.join(new, "row", "left").withColumn("more", F.coalesce("more", F.expr(f"CAST(array() AS array<{_SPAN}>)")))
    spans = F.array_sort(F.concat("base", "secrets", "more"))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")
    size = lambda c: F.size(c).cast("long")
    return out.select("doc_id", *[f"n_{x}" for x in KINDS], "base_sha256", joined.alias("spans"), size("secrets").alias("n_secret"), size("more").alias("n_context"), size(spans).alias("n_spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
