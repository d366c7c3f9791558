"""Order-dependent steps on the items of one checklist. A checklist is small; each is one group of ``applyInPandas``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.operators.ranking import top_k

_OPENERS = [re.compile(p) for p in (L.NEGATIVE_OPENER, L.POSITIVE_OPENER)]


def plain_words(text: str | None) -> frozenset[str]:
    return frozenset(re.findall(r"[a-z0-9]+", (text or "").lower()))


def mirror_words(text: str | None) -> frozenset[str]:
    """Words without the opener that tells a positive from a negative form."""
    for p in _OPENERS:
        text = p.sub("", text or "", count=1)
    return plain_words(text)


def numbers_and_options(text: str | None) -> frozenset[str]:
    low = (text or "").lower()
    return frozenset(re.findall(r"\d+(?:[.,]\d+)?", low)) | frozenset(re.findall(r"\(([a-e])\)", low))


def overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _per_group(df: DataFrame, keys: list[str], f, order: list[str]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return f(frame.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def without_mirrors(df: DataFrame, keys: list[str], text: str, weight: str, order: list[str], threshold: float = 0.6) -> DataFrame:
    """Items that check the same fact as an earlier kept one are absorbed, if their numbers and options agree; of the two the larger
    magnitude stays, the earlier one at a tie."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        words, signs = [mirror_words(t) for t in f[text]], [numbers_and_options(t) for t in f[text]]
        for i in range(len(f)):
            twin = next((k for k, j in enumerate(kept) if signs[i] == signs[j] and overlap(words[i], words[j]) >= threshold), None)
            if twin is None:
                kept.append(i)
            elif abs(f[weight].iat[i]) > abs(f[weight].iat[kept[twin]]):
                kept[twin] = i
        return f.iloc[sorted(kept)]

    return _per_group(df, keys, one, order)


def with_best_missing(df: DataFrame, keys: list[str], text: str, weight: str, own: str, order: list[str], k: int, threshold: float = 0.5) -> DataFrame:
    """The rows where ``own`` is true and up to k others of positive weight, heaviest first, unlike all taken so far."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        taken = [i for i in range(len(f)) if f[own].iat[i]]
        seen, size = [plain_words(f[text].iat[i]) for i in taken], len(taken)
        for i in sorted((i for i in range(len(f)) if not f[own].iat[i] and f[weight].iat[i] > 0), key=lambda i: -f[weight].iat[i]):
            w = plain_words(f[text].iat[i])
            if len(taken) - size < k and all(overlap(w, s) < threshold for s in seen):
                taken.append(i)
                seen.append(w)
        return f.iloc[taken]

    return _per_group(df, keys, one, order)


def within_bounds(df: DataFrame, keys: list[str], weight: str, order: list[str], target: int) -> DataFrame:
    """At most ``target`` items: the lightest go first, later ones before earlier ones at a tie."""
    return top_k(df, keys, [F.desc(F.abs(weight)), *order], target)


def balanced_pitfalls(df: DataFrame, keys: list[str], category: str, weight: str, spare: str, order: list[str], share: float = 0.25) -> DataFrame:
    """Rows with ``spare`` false are the checklist, the others candidates: pitfalls above the share (one is always allowed) are swapped for
    the heaviest candidates that are none; without candidates they stay, so the size never changes. Counts first, then ranks."""
    pit, extra_row = F.col(category) == "Pitfall", F.col(spare)
    sizes = df.groupBy(*keys).agg(F.count_if(~extra_row).alias("_own"), F.count_if(~extra_row & pit).alias("_pit"), F.count_if(extra_row & ~pit).alias("_pool"))
    n = F.greatest(F.lit(0), F.least(F.col("_pit") - F.greatest(F.lit(1), F.floor(F.col("_own") * share)), F.col("_pool")))
    magnitude = F.when(extra_row, -F.col(weight)).otherwise(F.abs(weight))
    r = F.row_number().over(Window.partitionBy(*keys, spare, pit).orderBy(magnitude, *order))
    joined = df.withColumn("_r", r).join(sizes.withColumn("_n", n), keys)
    kept = F.when(extra_row, ~pit & (F.col("_r") <= F.col("_n"))).otherwise(~pit | (F.col("_r") > F.col("_n")))
    return joined.where(kept).select(*df.columns)
