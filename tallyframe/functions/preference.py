"""Rules on single preference cases, answers and rubric texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains by group.
GROUPS = {"if": ["IF", "instruction_following"], "stem": ["STEM", "math", "science"], "code": ["CODE", "coding"], "safety": ["SAFETY"], "chat": ["CHAT"]}


def group_of(domain: Column, groups: dict[str, list[str]] | None = None) -> Column:
    out = F.lit("other")
    for name, members in (groups or GROUPS).items():
        out = F.when(F.lower(domain).isin([m.lower() for m in members]), name).otherwise(out)
    return out


def side_of(slot: Column, swapped: Column) -> Column:
    """The side A or B a slot stands for; in a swapped presentation it is the other one. Anything else is NULL."""
    s = F.upper(F.trim(slot))
    return F.when(s.isin("A", "B"), F.when(swapped, F.when(s == "A", "B").otherwise("A")).otherwise(s))


def consistent(forward: Column, swapped: Column) -> Column:
    return F.when(forward.isNotNull() & swapped.isNotNull(), forward == swapped)


def prediction(forward: Column, swapped: Column, mode: str = "forward") -> Column:
    """``forward`` takes the first order; ``swap_consistent`` is NULL on a flip."""
    return forward if mode == "forward" else F.when(forward == swapped, forward)


def hit(forward: Column, swapped: Column, label: Column, mode: str = "forward") -> Column:
    """1 or 0, NULL without a verdict. In mode ``swap`` a flip is wrong and a missing order NULL."""
    right = (forward == label).cast("int")
    if mode == "forward":
        return right
    return F.when(forward.isNull() | swapped.isNull(), None).when(forward != swapped, 0).otherwise(right)


def rubric_lines(text: Column) -> Column:
    """The non-empty lines of a rubric text without bullets or numbers."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(lines, lambda x: x != "")


def importances(text: Column, default: int = 3, least: int = 8) -> Column:
    """The k of "(importance k/5)" of each line that has at least ``least`` characters; the default where there is none."""
    long = F.filter(rubric_lines(text), lambda x: F.length(x) >= least)
    return F.transform(long, lambda x: F.coalesce(F.regexp_extract(x, r"\(importance (\d)/5\)", 1).try_cast("int"), F.lit(default)))


def rubric_items(text: Column, default: int = 3) -> Column:
    """ARRAY<STRUCT<title, description, weight>> of the lines of a rubric text: "title: description (importance k/5)", or a bare description."""
    pattern = r"^(?:([^:()]*):)?\s*(.*?)\s*(?:\(importance (\d)/5\))?\s*$"
    part = lambda x, k: F.trim(F.regexp_extract(x, pattern, k))
    return F.transform(rubric_lines(text), lambda x: F.struct(part(x, 1).alias("title"), part(x, 2).alias("description"), F.coalesce(part(x, 3).try_cast("int"), F.lit(default)).alias("weight")))


def transformed(text: Column, kind: str) -> Column:
    """``strip_weights`` drops the importances, ``bare`` everything in brackets, ``top5`` keeps the first five lines."""
    lines = rubric_lines(text)
    if kind == "strip_weights":
        lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s*\(importance \d/5\)", "")))
    elif kind == "bare":
        lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s*[(\[][^)\]]*[)\]]", "")))
    else:
        lines = F.slice(lines, 1, 5)
    return F.array_join(lines, "\n")


def numbered(items: Column) -> Column:
    """Items as a numbered list, one per line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def satisfied_when(polarity: Column, literally_true: Column) -> Column:
    return F.when(polarity == "negative", ~literally_true).otherwise(literally_true)


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within a relative tolerance, or a millionth of it absolutely (of the larger value, at least of one); NaN never is, NULL is unknown."""
    larger = F.greatest(F.abs(a), F.abs(b))
    near = F.abs(a - b) <= F.greatest(tolerance * larger, tolerance * 1e-6 * F.greatest(larger, F.lit(1.0)))
    return F.when(F.isnan(a) | F.isnan(b), False).otherwise(near)


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0).try_cast("double")


def item_target(parts: Column, words: Column, least: int = 7, most: int = 20) -> Column:
    """An item budget from capped signals: two per part, one per sixty words of the reference."""
    return F.least(F.lit(most), F.greatest(F.lit(least), least + 2 * F.least(parts, F.lit(5)) + F.least(F.floor(words / 60), F.lit(5)))).cast("int")


def mcnemar_power(n: int, p01: float, p10: float, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> float:
    """Share of simulated studies of n cases in which McNemar's exact test finds the difference."""
    import numpy as np

    from tallyframe.functions.exact import mcnemar_p

    rng = np.random.default_rng(seed)
    cells = rng.multinomial(n, [p01, p10, 1 - p01 - p10], draws)
    seen: dict[tuple[int, int], bool] = {}
    hits = 0
    for a, b, _ in cells.tolist():
        key = (min(a, b), max(a, b))
        if key not in seen:
            seen[key] = mcnemar_p(*key) < alpha
        hits += seen[key]
    return hits / draws
