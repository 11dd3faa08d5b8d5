"""Institutions: the first mention in each document is given in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source and target forms.
INSTITUTIONS = [
    ("Vrhovno sodišče Republike Slovenije", "Supreme Court of the Republic of Slovenia"),
    ("Ustavno sodišče Republike Slovenije", "Constitutional Court of the Republic of Slovenia"),
    ("Vrhovno državno tožilstvo Republike Slovenije", "Supreme State Prosecutor's Office of the Republic of Slovenia"),
    ("Ministrstvo za notranje zadeve", "Ministry of the Interior"),
    ("Ministrstvo za pravosodje", "Ministry of Justice"),
    ("Generalna policijska uprava", "General Police Directorate"),
    ("Okrožno sodišče v Ljubljani", "District Court in Ljubljana"),
    ("Okrajno sodišče v Ljubljani", "Local Court in Ljubljana"),
    ("Višje sodišče v Ljubljani", "Higher Court in Ljubljana"),
    ("Okrožno državno tožilstvo v Ljubljani", "District State Prosecutor's Office in Ljubljana"),
    ("Policijska uprava Ljubljana", "Ljubljana Police Directorate"),
    ("Okrožno sodišče v Mariboru", "District Court in Maribor"),
    ("Okrožno sodišče v Kranju", "District Court in Kranj"),
    ("Okrožno sodišče v Celju", "District Court in Celje"),
]


def first_mentions(segments: DataFrame, forms: list[tuple[str, str]] = INSTITUTIONS) -> DataFrame:
    """doc_id, seg_ord, text, with the source form put before the first mention of each institution, unless it stands there or a bracket follows.

    segments: doc_id, seg_ord, text. The forms are a short list; the first place of each in a document comes from one aggregation, and only
    these few places are joined back.
    """
    forms = sorted(forms, key=lambda f: -len(f[1]))
    hits = F.array_compact(F.array(*[F.when(F.col("text").contains(t), F.lit(i)) for i, (_, t) in enumerate(forms)]))
    firsts = segments.select("doc_id", "seg_ord", F.explode(hits).alias("form")).groupBy("doc_id", "form").agg(F.min("seg_ord").alias("seg_ord"))
    mine = firsts.groupBy("doc_id", "seg_ord").agg(F.collect_set("form").alias("gm_mine"))  # as many as there are forms, at most
    marked = segments.alias("s").join(mine.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.seg_ord") == F.col("m.seg_ord")), "left")
    marked = marked.select("s.doc_id", "s.seg_ord", "s.text", "gm_mine")
    for i, (s, t) in enumerate(forms):
        out: Column = F.col("text")
        at = F.locate(t, out)
        window = F.substring(out, F.greatest(F.lit(1), at - len(s) - 4), F.least(at - 1, F.lit(len(s) + 4)))
        bracket = F.substring(out, at, F.lit(len(t) + 2)).endswith("(")
        new = F.concat(F.substring(out, F.lit(1), at - 1), F.lit(f"{s} ({t})"), F.substring(out, at + len(t), F.length(out)))
        here = F.array_contains("gm_mine", i) & (at > 0) & ~window.contains(s) & ~bracket
        marked = marked.withColumn("text", F.when(here, new).otherwise(out))
    return marked.select("doc_id", "seg_ord", "text")
