"""Paired comparisons: complete tables, differences, and resampling by groups.

A group may hold all rows. Resampling therefore works on units: up to UNITS rows of a group each are one, more are added up by a hash of
their key into UNITS parts, so that a group's task sees no more than UNITS sums. Units are drawn with a fixed generator that
any engine can repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exact import normal_two_sided
from tallyframe.operators.ranking import finite, first_per_key, value_ranks
from tallyframe.session import cut, small_or_plain

CELLS = 2_000_000


def paired_table(rows: DataFrame, key: str, group: str, value: str, groups: list[str], order: list[str]) -> DataFrame:
    """One row per key with a column per group: keys with a finite value in every group; the first row of a cell counts."""
    cells = first_per_key(rows.select(key, group, finite(F.col(value).cast("double")).alias(value), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]), [key, group], [F.col(f"_o{i}") for i in range(len(order))])
    return cells.groupBy(key).pivot(group, groups).agg(F.first(value)).dropna(subset=groups)


def dropped_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(table.select(key), key, "left_anti")


def complete_keys(rows: DataFrame, key: str, groups: str, n: int) -> DataFrame:
    """Keys that have a row in each of n groups (relational division)."""
    return rows.groupBy(key).agg(F.count_distinct(groups).alias("n")).where(F.col("n") == n).select(key)


def differences(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(contrast, key columns, d): long differences of column pairs."""
    keys = [c for c in table.columns if c not in {x for p in pairs for x in p}]
    parts = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])
    return table.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.contrast", "x.d")


def bootstrap_means(x: np.ndarray, iters: int, seed: int) -> np.ndarray:
    """Means of resamples, drawn in chunks of bounded memory."""
    rng, out = np.random.default_rng(seed), []
    step = max(1, CELLS // len(x))
    for at in range(0, iters, step):
        out.append(x[rng.integers(0, len(x), (min(step, iters - at), len(x)))].mean(1))
    return np.concatenate(out)


def mean_interval(x: np.ndarray, iters: int = 10_000, alpha: float = 0.05, seed: int = 0) -> tuple:
    """(n, mean, se, low, high) of a percentile bootstrap; NULLs where n is too small."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return len(x), float(x[0]) if len(x) else None, None, None, None
    means = bootstrap_means(x, iters, seed)
    low, high = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
    return len(x), float(x.mean()), float(means.std(ddof=1)), float(low), float(high)


def sign_flip(d: np.ndarray, iters: int = 10_000, seed: int = 0, exact_up_to: int = 20) -> tuple[float | None, bool]:
    """Two-sided p of the mean difference under random signs: all sign vectors up to 20 differences, else draws with one added."""
    d = np.asarray(d, float)
    d = d[np.isfinite(d)]
    n = len(d)
    if n == 0:
        return None, False
    seen = abs(d.mean())
    least = seen - 1e-12 * max(1.0, seen)
    if n <= exact_up_to:
        sums = np.zeros(1)
        for v in d:
            sums = np.concatenate([sums + v, sums - v])
        return float((np.abs(sums) / n >= least).mean()), True
    rng, hits, draws = np.random.default_rng(seed), 0, max(iters, 10_000)
    step = max(1, CELLS // n)
    for at in range(0, draws, step):
        signs = rng.integers(0, 2, (min(step, draws - at), n)) * 2.0 - 1
        hits += int((np.abs(signs @ d) / n >= least).sum())
    return (hits + 1) / (draws + 1), False


UNITS = 512
#: The generator of draws: two quadratic and one linear step modulo a prime.
PRIME, STEPS = 2147483647, (1000003, 7919, 104729, 12345, 374761393, 48271, 668265263)


def draws(iters: int, units: int, seed: int) -> np.ndarray:
    """(iters, units) numbers below PRIME."""
    r, j = np.arange(iters, dtype=np.int64)[:, None], np.arange(units, dtype=np.int64)[None, :]
    x = (r * STEPS[0] + j * STEPS[1] + seed * STEPS[2] + STEPS[3]) % PRIME
    x = (x * x + STEPS[4]) % PRIME
    x = x * STEPS[5] % PRIME
    return (x * x + STEPS[6]) % PRIME


def units(df: DataFrame, group: list[str], key: list[str], sums: list[Column]) -> DataFrame:
    """(group, _unit, sums): the units of each group, named by a text that sorts alike in every engine."""
    sizes = small_or_plain(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")), 10_000)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    sized = df.alias("l").join(sizes.alias("r"), same).select("l.*", "_size") if group else df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_size"))))
    name = F.md5(F.concat_ws(":", *key).cast("binary"))
    part = F.lpad((F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % UNITS).cast("string"), 4, "0")
    return sized.withColumn("_unit", F.when(F.col("_size") <= UNITS, name).otherwise(part)).groupBy(*group, "_unit").agg(*sums)


def grouped(df: DataFrame, group: list[str], f: Callable[[pd.DataFrame], tuple], schema: str) -> DataFrame:
    """A row of f for each group of units, in the order of their names."""
    kinds = dict(df.dtypes)
    full = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", " + schema
    names = [*group, *[x.split()[0] for x in schema.split(", ")]]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f(frame.sort_values("_unit")))], columns=names)

    return df.groupBy(*group).applyInPandas(run, full)


def drawn_means(n: np.ndarray, s: np.ndarray, iters: int, seed: int) -> np.ndarray:
    """Means of resampled units of n rows and sum s."""
    out, step = [], max(1, CELLS // len(n))
    all_ = draws(iters, len(n), seed) % len(n)
    for at in range(0, iters, step):
        pick = all_[at : at + step]
        out.append(s[pick].sum(1) / n[pick].sum(1))
    return np.concatenate(out)


def unit_interval(f: pd.DataFrame, iters: int, seed: int, alpha: float = 0.05) -> tuple:
    n, s = f["_n"].to_numpy(float), f["_s"].to_numpy(float)
    total = int(n.sum())
    if total < 2 or len(n) < 2:
        return total, float(s.sum() / total) if total else None, None, None, None
    means = drawn_means(n, s, iters, seed)
    low, high = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
    return total, float(s.sum() / total), float(means.std(ddof=1)), float(low), float(high)


def unit_flips(f: pd.DataFrame, iters: int, seed: int, exact_up_to: int = 20) -> tuple[float | None, bool]:
    """``sign_flip`` on units: rows up to ``exact_up_to``, else random signs of units."""
    n, s = f["_n"].to_numpy(float), f["_s"].to_numpy(float)
    if n.sum() <= exact_up_to:
        return sign_flip(s, iters, seed, exact_up_to)
    seen = abs(s.sum() / n.sum())
    signs = draws(iters, len(n), seed) % 2 * 2.0 - 1
    hits = int((np.abs(signs @ s) / n.sum() >= seen - 1e-9 * max(1.0, seen)).sum())
    return (hits + 1) / (iters + 1), False


def _value_units(df: DataFrame, group: list[str], value: str, key: list[str]) -> DataFrame:
    clean = df.withColumn("_v", finite(F.col(value).cast("double"))).where("_v is not null")
    return units(clean, group, key, [F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s")])


def mean_intervals(df: DataFrame, group: list[str], value: str, key: list[str], iters: int = 2000, seed: int = 0) -> DataFrame:
    """(group, n, mean, se, ci_low, ci_high) of finite values; ``key`` names a row."""
    return grouped(_value_units(df, group, value, key), group, lambda f: unit_interval(f, iters, seed), "n long, mean double, se double, ci_low double, ci_high double")


def paired_tests(diffs: DataFrame, group: list[str], key: list[str], iters: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, n, mean, se, ci_low, ci_high, p, exact) of differences d."""
    one = lambda f: (*unit_interval(f, iters, seed + 1), *unit_flips(f, iters, seed))
    return grouped(_value_units(diffs, group, "d", key), group, one, "n long, mean double, se double, ci_low double, ci_high double, p double, exact boolean")


def clustered_correlation(df: DataFrame, group: list[str], cluster: str, x: str, y: str, iters: int = 1000, seed: int = 0) -> DataFrame:
    """(group, n, r, ci_low, ci_high): pooled correlation with an interval from resampling whole clusters; sums per cluster suffice."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    clean = df.select(*group, cluster, a.alias("_x"), b.alias("_y")).dropna()
    parts = {"_n": F.lit(1.0), "_a": F.col("_x"), "_b": F.col("_y"), "_aa": F.col("_x") * F.col("_x"), "_bb": F.col("_y") * F.col("_y"), "_ab": F.col("_x") * F.col("_y")}
    clusters = clean.groupBy(*group, cluster).agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    names = list(parts)

    def r(s: np.ndarray) -> np.ndarray:
        n, sa, sb, saa, sbb, sab = s.T
        va, vb = saa / n - (sa / n) ** 2, sbb / n - (sb / n) ** 2
        return np.where((va > 1e-12) & (vb > 1e-12), (sab / n - sa * sb / n**2) / np.sqrt(np.maximum(va * vb, 1e-300)), np.nan)

    def one(f: pd.DataFrame) -> tuple:
        sums = f[names].to_numpy(float)
        pick = draws(iters, len(sums), seed) % len(sums)
        found = np.concatenate([r(sums[p].sum(1)) for p in np.array_split(pick, max(1, pick.size * 6 // CELLS))])
        whole = r(sums.sum(0, keepdims=True))[0]
        low, high = np.nanpercentile(found, [2.5, 97.5]) if np.isfinite(found).any() else (None, None)
        return int(sums[:, 0].sum()), None if np.isnan(whole) else float(whole), low, high

    return grouped(units(clusters, group, [cluster], [F.sum(k).alias(k) for k in parts]), group, one, "n long, r double, ci_low double, ci_high double")


def two_sample_gap(df: DataFrame, group: list[str], side: str, value: str, key: list[str] | None = None, iters: int = 2000, seed: int = 0) -> DataFrame:
    """(group, n_true, n_false, gap, ci_low, ci_high): difference of means of two independent samples, by bootstrap. ``key`` names a row."""
    rows = df if key else df.withColumn("_key", F.monotonically_increasing_id())
    picked = rows.select(*group, side, value, *(key or ["_key"])).dropna(subset=[side, value])

    def one(f: pd.DataFrame) -> tuple:
        (na, sa), (nb, sb) = ((f.loc[f[side] == s, "_n"].to_numpy(float), f.loc[f[side] == s, "_s"].to_numpy(float)) for s in (True, False))
        if na.sum() < 2 or nb.sum() < 2:
            return int(na.sum()), int(nb.sum()), None, None, None
        gaps = drawn_means(na, sa, iters, seed) - drawn_means(nb, sb, iters, seed + 1)
        low, high = np.percentile(gaps, [2.5, 97.5])
        return int(na.sum()), int(nb.sum()), float(sa.sum() / na.sum() - sb.sum() / nb.sum()), float(low), float(high)

    return grouped(_value_units(picked, [*group, side], value, key or ["_key"]), group, one, "n_true long, n_false long, gap double, ci_low double, ci_high double")


def logistic_slopes(df: DataFrame, group: list[str], x: str, y: str, rounds: int = 30) -> DataFrame:
    """(group, n, intercept, slope, se): one-variable logistic regression by Newton steps; NULLs if it has no finite optimum. Each step is one
    grouped aggregate over the counts of distinct (x, y), and only five sums a group come to the driver."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    counts = cut(df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna().groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("_c")))
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group)
    weights = {tuple(r): (0.0, 0.0) for r in counts.select(*group).distinct().collect()}
    done: dict[tuple, tuple] = {}
    for _ in range(rounds):
        now = spark.createDataFrame([(*k, *w) for k, w in weights.items() if k not in done], f"{schema}, _a double, _b double")
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("_a") + F.col("_b") * F.col("_x"), F.lit(-30.0)), F.lit(30.0))))
        j = counts.join(F.broadcast(now), group).withColumn("_p", p).withColumn("_w", F.col("_c") * F.col("_p") * (1 - F.col("_p"))).withColumn("_e", F.col("_c") * (F.col("_y") - F.col("_p")))
        sums = j.groupBy(*group).agg(F.sum("_c").alias("n"), F.sum("_w").alias("h0"), F.sum(F.col("_w") * F.col("_x")).alias("h1"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("h2"), F.sum("_e").alias("g0"), F.sum(F.col("_e") * F.col("_x")).alias("g1")).collect()
        for s in sums:
            k = tuple(s[g] for g in group)
            hess = np.array([[s.h0, s.h1], [s.h1, s.h2]])
            if not np.isfinite(hess).all() or np.linalg.cond(hess) > 1e12:
                done[k] = (s.n, None, None, None)
                continue
            step = np.linalg.solve(hess, np.array([s.g0, s.g1]))
            a, b = np.array(weights[k]) + step
            weights[k] = (float(a), float(b))
            if np.abs(step).max() < 1e-10:
                done[k] = (s.n, float(a), float(b), float(np.sqrt(np.linalg.inv(hess)[1, 1])))
        if len(done) == len(weights):
            break
    rows = [(*k, *done.get(k, (None, None, None, None))) for k in weights]
    return spark.createDataFrame(rows, f"{schema}, n long, intercept double, slope double, se double")


def signed_ranks(diffs: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, n_zero, w_plus, w_minus, z): Wilcoxon signed ranks of d with tie and continuity correction. Ranks come from the counts of
    distinct magnitudes."""
    counts = diffs.where(F.col("d").isNotNull()).groupBy(*group, F.abs("d").alias("_a")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("d") > 0).alias("_k"))
    ranked = value_ranks(counts.where("_a != 0"), group, "_a", "_c")
    zero = counts.groupBy(*group).agg(F.sum(F.when(F.col("_a") == 0, F.col("_c")).otherwise(0)).alias("n_zero"))
    c, k, r = F.col("_c"), F.col("_k"), F.col("_r")
    sums = ranked.groupBy(*group).agg(F.sum("_c").alias("n"), F.sum(k * r).alias("w_plus"), F.sum((c - k) * r).alias("w_minus"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("n")
    middle, spread = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.when(spread > 0, (F.col("w_plus") - middle - 0.5 * F.signum(F.col("w_plus") - middle)) / F.sqrt(spread))
    return sums.join(zero, group).select(*group, "n", "n_zero", "w_plus", "w_minus", z.alias("z"))


def wilcoxon_p(z: float | None) -> float | None:
    return normal_two_sided(z)
