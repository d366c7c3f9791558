"""Ranks, top-k, multiple testing and order statistics as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut


def finite(c: Column) -> Column:
    """NaN and infinities as NULL, so that aggregates skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def average_rank(group: list[str], value: str) -> Column:
    """1-based ranks as a window, for groups that fit a task; ties share the mean of theirs. ``value_ranks`` has no such bound."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (ties - 1) / 2.0


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. The aggregate is combined before the shuffle, unlike a
    window, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")) if rest else df.distinct()
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(df.columns) if rest else picked


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def running_totals(df: DataFrame, group: list[str], order: list[Column], amount: Column) -> DataFrame:
    """Adds _before, the sum of ``amount`` over the rows of the group that come earlier in ``order``, and _total, the sum over the group.

    A group may hold all rows: they are sorted across all tasks by range, added up within each, and shifted by the sums of the ranges
    before, of which there is one for each task and group. The order must tell rows of a group apart."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_g", F.xxhash64(F.lit(0), *group)).withColumn("_o", F.struct(*order)).withColumn("_a", amount)
    ranged = cut(keyed.repartitionByRange(parts, "_g", "_o").withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_g", "_p").agg(F.sum("_a").alias("_s"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_g", "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_shift"), F.sum("_s").over(Window.partitionBy("_g")).alias("_total"))
    inside = Window.partitionBy("_g", "_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_in", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    return local.join(shifts, ["_g", "_p"]).withColumn("_before", F.col("_shift") + F.col("_in")).select(*df.columns, "_before", "_total")


def value_ranks(counts: DataFrame, group: list[str], value: str, n: str) -> DataFrame:
    """Adds _r, the rank that ties of a value share, and _total to (group, value, n): distinct values and how often each occurs."""
    ranked = running_totals(counts, group, [F.col(value)], F.col(n))
    return ranked.withColumn("_r", F.col("_before") + (F.col(n) + 1) / 2.0)


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): quantiles with linear interpolation, from the counts of distinct values, so that no task holds all of a group's."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    r = running_totals(counts, group, [F.col("_v")], F.col("_c"))
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), F.col("_v")))
    parts = []
    for name, p in shares.items():
        h = (F.col("_total") - 1) * p
        low, high = at(F.floor(h)), at(F.ceil(h))
        parts.append((low + (F.max(h) - F.floor(F.max(h))) * (high - low)).alias(name))
    return r.groupBy(*group).agg(*parts)


def rank_auc(df: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """(group, n_pos, n_neg, auc): Mann-Whitney with ties at one half; NULL if a class is empty. NULL scores are left out. Ranks come from the
    counts of distinct scores."""
    counts = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("_c"), F.count_if(positive).alias("_k"))
    out = value_ranks(counts, group, score, "_c").groupBy(*group).agg(F.sum("_k").alias("n_pos"), F.sum(F.col("_c") - F.col("_k")).alias("n_neg"), F.sum(F.col("_k") * F.col("_r")).alias("_s"))
    auc = F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return out.select(*group, "n_pos", "n_neg", auc.alias("auc"))


def correlations(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, pearson, spearman) of rows with both values; from the counts of distinct pairs, whose ranks come from those of distinct values."""
    counts = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c")))
    rank = lambda v, r: value_ranks(counts.groupBy(*group, v).agg(F.sum("_c").alias("_k")), group, v, "_k").select(*group, v, (F.col("_r") - (F.col("_total") + 1) / 2.0).alias(r))
    same = lambda v: [F.col(f"c.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col(f"c.{v}") == F.col(f"r.{v}")]
    both = counts
    for v, r in (("_x", "_rx"), ("_y", "_ry")):
        both = both.alias("c").join(rank(v, r).alias("r"), same(v)).select("c.*", r)
    c, total = F.col("_c"), F.sum("_c")
    product = lambda a, b: F.sum(c * F.col(a) * F.col(b))
    cov = lambda a, b: product(a, b) / total - F.sum(c * F.col(a)) * F.sum(c * F.col(b)) / (total * total)
    pearson = F.try_divide(cov("_x", "_y"), F.sqrt(cov("_x", "_x") * cov("_y", "_y")))
    spearman = F.try_divide(product("_rx", "_ry"), F.sqrt(product("_rx", "_rx") * product("_ry", "_ry")))
    return both.groupBy(*group).agg(total.alias("n"), F.when(total >= 3, pearson).alias("pearson"), F.when(total >= 3, spearman).alias("spearman"))


def bh_adjusted(df: DataFrame, family: list[str], p: str) -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p within each family: a running minimum from the largest p down. NULL stays NULL
    and doesn't count. A family is a declared set of tests, so its window is small."""
    m = F.count(p).over(Window.partitionBy(*family))
    down = Window.partitionBy(*family).orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    ranked = df.withColumn("_k", F.row_number().over(up)).withColumn("_v", F.when(F.col(p).isNotNull(), clipped * m / F.col("_k")))
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.min("_v").over(down), F.lit(1.0)))).drop("_k", "_v")


def ordered_pairs(df: DataFrame, group: list[str], level: str, score: str) -> DataFrame:
    """(group, n_pairs, n_ties, credit, accuracy) over pairs of different level: agreement of scores with levels, a tie half."""
    x, y = df.alias("x"), df.alias("y")
    same = [F.col(f"x.{g}") == F.col(f"y.{g}") for g in group]
    pairs = x.join(y, same + [F.col(f"x.{level}") > F.col(f"y.{level}")])
    a, b = F.col(f"x.{score}"), F.col(f"y.{score}")
    out = pairs.groupBy(*[F.col(f"x.{g}").alias(g) for g in group]).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(a == b).alias("n_ties"), F.sum(F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)).alias("credit")
    )
    return out.withColumn("accuracy", F.col("credit") / F.col("n_pairs"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL with fewer than three pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa from counts; NULL if agreement by chance is complete."""
    n = n11 + n10 + n01 + n00
    observed = F.try_divide(n11 + n00, n)
    chance = F.try_divide((n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01), n * n)
    return F.when(1 - chance > 1e-12, (observed - chance) / (1 - chance))


def largest_remainder(sizes: DataFrame, group: str, size: str, target: int) -> DataFrame:
    """(group, size, quota): the target shared out in proportion to size; what rounding leaves goes to the largest fractions,
    ties by group. The groups are strata, a small table."""
    total = F.sum(size).over(Window.partitionBy())
    exact = F.lit(target) * F.col(size) / total
    base = sizes.select(group, size, F.floor(exact).alias("_b"), (exact - F.floor(exact)).alias("_f"))
    short = F.lit(target) - F.sum("_b").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_f"), group))
    return base.select(group, size, (F.col("_b") + F.when(rank <= short, 1).otherwise(0)).cast("long").alias("quota"))
