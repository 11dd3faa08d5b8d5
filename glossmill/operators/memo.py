"""Keyed memoisation: only what no stored key answers is sent on; the newest row of a key wins."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship


def keyed(segments: DataFrame, direction: str, model: str, version: str, block=None) -> DataFrame:
    return segments.withColumn("key", T.memo_key(F.lit(direction), F.lit(model), F.lit(version), *([block] if block is not None else []), "text"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, by partial aggregation instead of a window, so that hot keys don't gather."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("m"))
    return top.select(*keys, "m.row.*")


def split_hits(wanted: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): missing has each key once, since repeats cost as much as the first."""
    return wanted.join(memory, "key"), wanted.join(memory, "key", "left_anti").dropDuplicates(["key"])


FAILED = "[TRANSLATION FAILED] "


def parse_batch(reply: str, n: int) -> list[str] | None:
    """The lines of a numbered reply; None unless it has each number once and no blank."""
    found: dict[int, str] = {}
    for line in reply.strip().splitlines():
        m = re.match(r"\s*(\d+)\s*[.)]\s?(.*)", line)
        if not m:
            continue
        if int(m[1]) in found or not m[2].strip():
            return None
        found[int(m[1])] = m[2].strip()
    return [found[i + 1] for i in range(n)] if set(found) == set(range(1, n + 1)) else None


#: What a segment that goes in a numbered batch looks like: one short line that isn't numbered itself.
_NUMBERED = re.compile(r"\s*\d+\s*[.)]")


def batchable(text: str) -> bool:
    return "\n" not in text and len(text) <= 200 and not _NUMBERED.match(text)


def translate(segments: DataFrame, client: Callable[..., str], most: int = 20, most_chars: int = 1500, tries: int = 3, wait: float = 3.0) -> DataFrame:
    """key, text -> key, text, translation, stored: short segments in numbered batches; a batch that fails or can't be read goes one by one.

    A call that fails is tried again after wait seconds, then twice as many, and so on; what fails in the end is marked and not stored. A null
    text stays null and isn't stored. Where segments have a column system, the client is called with it and the text, and a batch has one of it.
    """
    ship(segments.sparkSession)
    columns = ["key", "text", *[c for c in segments.columns if c == "system"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, systems = pdf.text.tolist(), pdf.system.tolist() if "system" in columns else None
            done: dict[int, tuple[str | None, bool]] = {}
            group: list[int] = []

            def ask(i: int, text: str) -> str:
                return (client(text) if systems is None else client(systems[i], text)).strip()

            def single(i: int) -> tuple[str, bool]:
                for n in range(tries):
                    try:
                        if out := ask(i, texts[i]):
                            return out, True
                    except Exception:  # whatever a client raises, the segment is marked and the job goes on
                        if n + 1 < tries:
                            time.sleep(wait * (n + 1))
                return FAILED + texts[i], False

            def flush() -> None:
                got = None
                if len(group) > 1:
                    try:
                        got = parse_batch(ask(group[0], "\n".join(f"{k + 1}. {texts[i]}" for k, i in enumerate(group))), len(group))
                    except Exception:  # one by one, with the tries of each
                        got = None
                for i, t in zip(group, got or (), strict=False):
                    done[i] = (t, True)
                for i in group:
                    if i not in done:
                        done[i] = single(i)
                group.clear()

            size = 0
            for i, t in enumerate(texts):
                if t is None:
                    done[i] = (None, False)
                    continue
                if not batchable(t):
                    flush()
                    size, done[i] = 0, single(i)
                    continue
                if group and (len(group) >= most or size + len(t) > most_chars or (systems is not None and systems[group[0]] != systems[i])):
                    flush()
                    size = 0
                group.append(i)
                size += len(t)
            flush()
            yield pd.DataFrame({"key": pdf.key, "text": pdf.text, "translation": [done[i][0] for i in range(len(pdf))], "stored": [done[i][1] for i in range(len(pdf))]})

    return segments.select(*columns).mapInPandas(run, "key string, text string, translation string, stored boolean")


def current_rows(rows: DataFrame, direction: str, model: str, version: str, block=None) -> DataFrame:
    """The rows (key, src) of the memory that a run would use now: their key is that of their source under these settings."""
    parts = [F.lit(direction), F.lit(model), F.lit(version), *([block] if block is not None else []), F.col("src")]
    return rows.filter(F.col("key") == T.memo_key(*parts))


def overridden(layers: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the highest layer, then line."""
    return latest(layers, [key], ["layer", "line"])


def numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
