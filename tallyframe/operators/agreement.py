"""Two readings of the same answers: rank agreement, per-question vectors, label fractions, folded slot orders, weighted votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ranking import correlation, kappa

VECTOR = ["abs_diff", "signed_diff", "rank_agreement", "pass_disagreement"]


def rank_agreement(cells: DataFrame, group: list[str], level: str, x: str, y: str) -> DataFrame:
    """(group, rank_agreement): over pairs of different level, whether two scores order them alike; a tie of one is half."""
    left = cells.select(*group, F.col(level).alias("_l"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    right = cells.select(*group, F.col(level).alias("_l2"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    p = left.join(right, group).where("_l < _l2").select(*group, F.signum(F.col("_x") - F.col("_x2")).alias("s"), F.signum(F.col("_y") - F.col("_y2")).alias("t"))
    credit = F.when(F.col("s") == F.col("t"), 1.0).when((F.col("s") == 0) | (F.col("t") == 0), 0.5).otherwise(0.0)
    return p.groupBy(*group).agg(F.avg(credit).alias("rank_agreement"))


def question_vectors(cells: DataFrame, group: list[str], level: str, x: str, y: str, pass_x: str, pass_y: str) -> DataFrame:
    """(group, n, VECTOR..., pearson): how far two readings of a group's cells differ, for groups of at least two cells."""
    d = F.col(y) - F.col(x)
    steady = (F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9)
    out = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("abs_diff"), F.avg(d).alias("signed_diff"), F.avg(F.abs(F.col(pass_x) - F.col(pass_y))).alias("pass_disagreement"), F.when(steady, correlation(F.col(x), F.col(y))).alias("pearson"))
    return out.where("n >= 2").join(rank_agreement(cells, group, level, x, y), group, "left")


def pooled_agreement(cells: DataFrame, group: list[str], x: str, y: str, pass_x: str, pass_y: str) -> DataFrame:
    d = F.col(y) - F.col(x)
    return cells.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_cells"), correlation(F.col(x), F.col(y)).alias("pearson"), F.avg(F.abs(d)).alias("mean_abs_diff"), F.avg(d).alias("mean_signed_diff"), F.avg(x).alias("mean_first"), F.avg(y).alias("mean_second"),
        F.avg(pass_x).alias("pass_first"), F.avg(pass_y).alias("pass_second"), F.avg(F.abs(F.col(pass_x) - F.col(pass_y))).alias("pass_disagreement"),
    )


def verdict_agreement(rows: DataFrame, group: list[str], a: Column, b: Column) -> DataFrame:
    """(group, n, agreement, kappa) of two yes-or-no readings of each row."""
    counts = rows.groupBy(*group).agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("n11", a & b), ("n10", a & ~b), ("n01", ~a & b), ("n00", ~a & ~b))])
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    total = n11 + n10 + n01 + n00
    return counts.select(*group, total.cast("long").alias("n"), F.try_divide(n11 + n00, total).alias("agreement"), kappa(n11, n10, n01, n00).alias("kappa"))


def label_fractions(rows: DataFrame, group: list[str], item: str, label: Column, labels: list[str], order: list[Column]) -> DataFrame:
    """(group, n_labelled, a fraction for each label): the first usable label of an item counts; groups without one don't come out."""
    usable = rows.withColumn("_label", F.lower(F.trim(label))).where(F.col("_label").isin(labels) & F.col(item).isNotNull())
    first = usable.groupBy(*group, item).agg(F.min_by("_label", F.struct(*order)).alias("_label"))
    return first.groupBy(*group).agg(F.count(F.lit(1)).alias("n_labelled"), *[F.avg((F.col("_label") == x).cast("int")).alias(f"{x}_fraction") for x in labels])


def check_counts(rows: DataFrame, group: list[str], item: str, n_checks: Column, order: list[Column], most: int = 20) -> DataFrame:
    """(group, n_labelled, mean_checks, atomic_fraction, max_checks): the first count of at least one for each item, capped."""
    usable = rows.withColumn("_n", n_checks).where((F.col("_n") >= 1) & F.col(item).isNotNull())
    first = usable.groupBy(*group, item).agg(F.least(F.min_by("_n", F.struct(*order)), F.lit(most)).alias("_n"))
    return first.groupBy(*group).agg(F.count(F.lit(1)).alias("n_labelled"), F.avg("_n").alias("mean_checks"), F.avg((F.col("_n") == 1).cast("int")).alias("atomic_fraction"), F.max("_n").alias("max_checks"))


def folded(slot1: Column, slot2: Column) -> Column:
    """Both presentations of a pair as one struct: the first shows source a in slot A, the second source b. Slots are A, B or TIE; anything
    else is a failed verdict. The corrected winner won both orders."""
    s1, s2 = (F.when(F.upper(F.trim(s)).isin("A", "B", "TIE"), F.upper(F.trim(s))) for s in (slot1, slot2))
    v1 = F.when(s1 == "A", "a").when(s1 == "B", "b").when(s1 == "TIE", "tie")
    v2 = F.when(s2 == "A", "b").when(s2 == "B", "a").when(s2 == "TIE", "tie")
    count = lambda *cs: sum((F.coalesce(c.cast("int"), F.lit(0)) for c in cs), F.lit(0))
    return F.struct(
        v1.alias("verdict_order1"), v2.alias("verdict_order2"), count(s1.isNotNull(), s2.isNotNull()).alias("n_verdicts"), count(s1.isNull(), s2.isNull()).alias("n_failed"), count(s1.isin("A", "B"), s2.isin("A", "B")).alias("n_decisive"),
        count(s1 == "A", s2 == "A").alias("n_first_slot_wins"), count(v1 == "a", v2 == "a").alias("raw_wins_a"), count(v1 == "b", v2 == "b").alias("raw_wins_b"), F.when((v1 == v2) & (v1 != "tie"), v1).otherwise("tie").alias("corrected_winner"),
    )


def head_to_head(rows: DataFrame, pair: str) -> DataFrame:
    """Win rates of folded rows by pair, and over all (pair NULL): raw over votes, corrected over questions with both orders."""
    both = F.col("n_verdicts") == 2
    over = lambda x, n: F.try_divide(F.sum(F.when(both, x).otherwise(0)), n)
    n = F.count_if(both)
    won = lambda w: (F.col("corrected_winner") == w).cast("int")
    flips = (~F.col("verdict_order1").eqNullSafe(F.col("verdict_order2"))).cast("int")
    return rows.groupingSets([[pair], []], pair).agg(
        F.count(F.lit(1)).alias("n_questions"), n.alias("n_complete"), over(F.col("raw_wins_a"), 2 * n).alias("raw_win_rate_a"), over(F.col("raw_wins_b"), 2 * n).alias("raw_win_rate_b"), over(won("a"), n).alias("corrected_win_rate_a"),
        over(won("b"), n).alias("corrected_win_rate_b"), over(won("tie"), n).alias("corrected_tie_rate"), over(flips, n).alias("flip_rate"), (F.sum("n_verdicts") - F.sum("n_decisive")).alias("n_tie_verdicts"), F.sum("n_failed").alias("n_failed"),
        F.try_divide(F.sum("n_first_slot_wins"), F.sum("n_decisive")).alias("position_bias_rate"),
    )


def weighted_votes(items: DataFrame, case: str, weight: str, a: str, b: str) -> DataFrame:
    """(case, n_items, n_split, mechanical, decisive, coherence): what a case's per-criterion verdicts say when they are added up by weight: over all
    items, over those that tell the two answers apart, and how one-sided these are."""
    w, x, y = F.col(weight), F.col(a), F.col(b)
    total = lambda c: F.sum(F.when(c, w).otherwise(0))
    sums = items.groupBy(case).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(x != y).alias("n_split"), total(x).alias("sa"), total(y).alias("sb"), total(x & ~y).alias("fa"), total(y & ~x).alias("fb"))
    ahead = lambda p, q: F.when(F.col(p) > F.col(q), "A").when(F.col(p) < F.col(q), "B")
    return sums.select(case, "n_items", "n_split", ahead("sa", "sb").alias("mechanical"), ahead("fa", "fb").alias("decisive"), F.try_divide(F.abs(F.col("fa") - F.col("fb")), F.col("fa") + F.col("fb")).alias("coherence"))


def vote_profile(votes: DataFrame, group: list[str], label: str, holistic: str) -> DataFrame:
    """(group, n, accuracy, split_rate, coherence, decisive_accuracy, decisive_coverage, criteria_per_case) of weighted votes with label and holistic winner."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    right = F.col("decisive") == F.col(label)
    return votes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), share(F.col(holistic) == F.col(label)).alias("accuracy"), F.try_divide(F.sum("n_split"), F.sum("n_items")).alias("split_rate"), F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("coherence"),
        F.coalesce(F.avg(right.cast("int")), F.lit(0.0)).alias("decisive_accuracy"), F.avg(F.col("decisive").isNotNull().cast("int")).alias("decisive_coverage"), F.avg("n_items").alias("criteria_per_case"),
    )
