"""Mixing sources to target weights by hierarchical budgeting.

The leaves are domain / language / source. A token budget is handed down the tree by the weights of the children. A child that
cannot use its share (it has its tokens times the allowed epochs) leaves the rest to its siblings; only what a
whole family cannot use goes to the family's own siblings. A leaf's share is its tokens once per whole epoch and, of a last
epoch in seeded order, a prefix: the document on its edge counts with the tokens that still fit.

Everything is DataFrame work. Leaves are aggregated before any window; a leaf's prefix is found over 256 ranges of the order's hash, in the range
on the edge over 256 smaller ones, and so on for LEVELS times, so that what is sorted in the end is a 16-millionth of the leaf.

Defined cases: null texts have no tokens; null or unknown domain, lang or source are nodes of their own, with the default weight; a
weight of 0 or less gives nothing; documents without tokens come along with the epochs that reach their place; repeated rows are
each counted; rows of one doc_id, or without one, have one place in the order and follow each other by their number of tokens, in one task
where they stand on the edge; an empty table gives no rows; other columns are ignored or, in mix, kept, where each row is taken or left by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, with_row_id

#: Weights by level; names that are not listed weigh 1. The budget is this share of all tokens.
DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS = {"d0": 2, "d1": 1, "d2": 1}, {"en": 3, "de": 2, "fr": 2, "es": 2}, {}
SHARE_PERCENT, EPOCHS, SEED = 70, 3, 17
#: How often the range on the edge is divided, and leaves whose targets are broadcast; more are joined by shuffle.
LEVELS, FEW_LEAVES = 3, 100_000


def default_domain() -> Column:
    """d0 to d2, by the number that ends the source; other without one."""
    n = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(n, F.lit("")) == "", "other").otherwise(F.concat(F.lit("d"), (n.cast("long") % 3).cast("string")))


def tokens(text: str = "text") -> Column:
    """Words between ASCII spaces."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(F.col(name) == key, w).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, w, cap, budget (of the parent). Adds got: budget by weight, no more than cap, rests to siblings.

    Children are filled in the order of cap / w: a child is full if its share of what is left reaches its cap. The others
    divide the rest by weight, whole tokens by cumulative rounding.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf"))
    rising = family.orderBy(ratio, F.col(name).asc_nulls_first())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    use = nodes.withColumn("w", F.greatest("w", F.lit(0))).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    use = use.withColumn("c_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    use = use.withColumn("w_from", F.sum("w").over(family) - F.col("w_before"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    use = use.withColumn("full", (F.col("w") > 0) & ((wide("budget") - wide("c_before")) * wide("w") >= wide("cap") * wide("w_from")))
    open_w = F.when(~F.col("full"), F.col("w")).otherwise(0)
    use = use.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)).withColumn("open_w", open_w)
    use = use.withColumn("all_w", F.sum("open_w").over(family)).withColumn("cum_w", F.sum("open_w").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda c: F.expr(f"CAST((CAST(rest AS DECIMAL(38,0)) * ({c})) DIV all_w AS BIGINT)")
    got = F.when(F.col("full"), F.col("cap")).when(F.col("open_w") > 0, F.least(F.col("cap"), part("cum_w") - part("cum_w - open_w"))).otherwise(0)
    return use.withColumn("got", got.cast("long")).select(*nodes.columns, "got")


def leaf_budgets(leaves: DataFrame, budget: int, epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """leaves: domain, lang, source, n. Adds target, the tokens that the leaf shall give."""
    caps = leaves.withColumn("cap", F.col("n") * epochs)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("n").alias("n"))
    domains = domains.withColumn("budget", F.lit(budget).cast("long")).withColumn("w", weight("domain", weights[0]))
    domains = share_out(domains.select("domain", "w", "cap", "budget"), [], "domain").select(F.col("domain").alias("p_domain"), F.col("got").alias("budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, F.col("domain").eqNullSafe(F.col("p_domain"))).drop("p_domain")
    langs = share_out(langs.withColumn("w", weight("lang", weights[1])), ["domain"], "lang").select(F.col("domain").alias("p_domain"), F.col("lang").alias("p_lang"), F.col("got").alias("budget"))
    both = caps.join(langs, F.col("domain").eqNullSafe(F.col("p_domain")) & F.col("lang").eqNullSafe(F.col("p_lang"))).drop("p_domain", "p_lang")
    return share_out(both.withColumn("w", weight("source", weights[2])), ["domain", "lang"], "source").select("domain", "lang", "source", "n", F.col("got").alias("target"))


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def select_mix(rows: DataFrame, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """rows: doc_id, domain, lang, source, n_tokens and, if so, row, small and materialised. Gives these, epoch and take_tokens for each copy that is taken."""
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("n"))
    total = leaves.groupBy().agg(F.sum("n")).first()[0] or 0  # one number
    targets = leaf_budgets(leaves, total * share_percent // 100, epochs, weights)
    targets = targets.withColumn("whole", F.expr("CASE WHEN n > 0 THEN target DIV n ELSE 0 END")).withColumn("rest", F.expr("CASE WHEN n > 0 THEN target % n ELSE 0 END"))
    targets = materialize(targets.select(*[F.col(c).alias(f"t_{c}") for c in leaf], "whole", "rest"), "mix-targets")
    on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in leaf]
    placed = rows.join(F.broadcast(targets) if targets.count() <= FEW_LEAVES else targets, on).drop(*[f"t_{c}" for c in leaf])
    whole = placed.filter("whole > 0").select(*rows.columns, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    edge = placed.filter("rest > 0").withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id"))).withColumn("at", F.lit(0).cast("long"))
    out = whole
    for level in range(LEVELS):
        edge = materialize(edge.withColumn("part", F.conv(F.substring("h", 1 + 2 * level, 2), 16, 10).cast("int")), "mix-edge")
        parts = edge.groupBy(*leaf, "rest", "at", "part").agg(F.sum("n_tokens").alias("b_tokens"))
        along = Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("b_at", F.col("at") + F.coalesce(F.sum("b_tokens").over(along), F.lit(0))).filter("b_at < rest")
        parts = materialize(parts.select(*[F.col(c).alias(f"t_{c}") for c in leaf], F.col("part").alias("t_part"), "b_at", "b_tokens"), "mix-parts")
        small = parts.count() <= 256 * FEW_LEAVES // 100
        near = edge.join(F.broadcast(parts) if small else parts, [*on, F.col("part") == F.col("t_part")])
        out = out.unionByName(near.filter("b_at + b_tokens <= rest").select(*rows.columns, F.col("whole").cast("int").alias("epoch"), F.col("n_tokens").alias("take_tokens")))
        edge = near.filter("b_at + b_tokens > rest").select(*rows.columns, "whole", "rest", "h", F.col("b_at").alias("at"))
    within = Window.partitionBy(*leaf).orderBy("h", "doc_id", "n_tokens", *[c for c in rows.columns if c == "row"]).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("at", F.col("at") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).filter("at < rest")
    return out.unionByName(edge.select(*rows.columns, F.col("whole").cast("int").alias("epoch"), F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("take_tokens")))


def counted(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """The columns that the choice is made on, and the row, if docs carry gm_row; texts stay behind."""
    row = [F.col("gm_row").alias("row")] if "gm_row" in docs.columns else []
    rows = docs.select(*row, F.col("doc_id").cast("long"), (default_domain() if domain is None else domain).alias("domain"), "lang", "source", tokens().alias("n_tokens"))
    return materialize(rows, "mix-rows")


def first_tokens(text: str, n: str) -> Column:
    """The text up to the end of its n-th token."""
    pieces = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with all columns: each row once for each epoch that takes it; a document on an edge, of which fewer tokens are taken, is cut behind them (and so its n_chars)."""
    marked = with_row_id(docs)
    taken = select_mix(counted(marked), **options).groupBy("row").agg(F.collect_list(F.when(F.col("take_tokens") < F.col("n_tokens"), F.col("take_tokens")).otherwise(-1)).alias("gm_takes"))
    taken = materialize(taken.withColumnRenamed("row", "gm_row"), "mix-taken")
    out = marked.join(taken.hint("merge"), "gm_row").withColumn("gm_take", F.explode("gm_takes"))
    cut = F.col("gm_take") >= 0
    out = out.withColumn("text", F.when(cut, first_tokens("text", "gm_take")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(counted(table(spark, sf_dir, "documents")))


def _case(name: str, weights: dict[str, int]) -> str:
    return "1" if not weights else f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _share_sql(source: str, parent: str, name: str, keep: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT {keep}, CAST(CASE WHEN fl THEN cap WHEN ow > 0 THEN least(cap, rest * cw // aw - rest * (cw - ow) // aw) ELSE 0 END AS BIGINT) AS got FROM (
      SELECT *, budget - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER ({part}) AS rest, CASE WHEN fl THEN 0 ELSE w END AS ow, sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({part}) AS aw,
             sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({part} ORDER BY cap / w, {name} NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cw FROM (
        SELECT *, (budget - cb) * w >= cap * (sum(w) OVER ({part}) - wb) AS fl FROM (
          SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cb,
                 coalesce(sum(w) OVER ({part} ORDER BY cap / w, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS wb FROM {source}))))"""


OP7_SQL = f"""
WITH r AS (SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other' ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 3) END AS domain,
             lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS n, CAST(sum(n_tokens) * {EPOCHS} AS HUGEINT) AS cap FROM r GROUP BY ALL),
d0 AS (SELECT domain, {_case("domain", DOMAIN_WEIGHTS)} AS w, sum(cap)::HUGEINT AS cap, (SELECT sum(n)::HUGEINT * {SHARE_PERCENT} // 100 FROM leaves) AS budget FROM leaves GROUP BY domain),
d1 AS {_share_sql("d0", "", "domain", "domain")},
l0 AS (SELECT l.domain, lang, sum(cap)::HUGEINT AS cap, any_value(got)::HUGEINT AS budget, any_value({_case("lang", LANG_WEIGHTS)}) AS w FROM leaves l JOIN d1 ON l.domain = d1.domain GROUP BY l.domain, lang),
l1 AS {_share_sql("l0", "domain", "lang", "domain, lang")},
s0 AS (SELECT l.domain, l.lang, source, n, cap, got::HUGEINT AS budget, {_case("source", SOURCE_WEIGHTS)} AS w FROM leaves l JOIN l1 ON l.domain = l1.domain AND l.lang IS NOT DISTINCT FROM l1.lang),
s1 AS {_share_sql("s0", "domain, lang", "source", "domain, lang, source, n")},
t AS (SELECT domain, lang, source, CASE WHEN n > 0 THEN got // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN got % n ELSE 0 END AS rest FROM s1),
p AS (SELECT r.*, whole, rest FROM r JOIN t ON r.domain = t.domain AND r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY sha256('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, n_tokens AS take_tokens FROM (SELECT *, unnest(generate_series(0, CAST(whole AS BIGINT) - 1)) AS epoch FROM p WHERE whole > 0)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INTEGER), CAST(least(n_tokens, rest - pos) AS BIGINT) FROM e WHERE rest > 0 AND pos < rest
"""
