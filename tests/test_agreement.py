"""Two judges, slot orders, labels and weighted votes on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import exact, preference
from tallyframe.functions import text as T
from tallyframe.operators import agreement, similarity


def test_rank_agreement_gives_half_for_one_tie(spark):
    rows = [("u", 1, 0.9, 0.8), ("u", 2, 0.5, 0.8), ("u", 3, 0.4, 0.1), ("v", 1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "u string, level int, x double, y double")
    assert {r.u: r.rank_agreement for r in agreement.rank_agreement(df, ["u"], "level", "x", "y").collect()} == {"u": 2.5 / 3}
    v = agreement.question_vectors(df.withColumn("p", F.col("x")).withColumn("q", F.col("y")), ["u"], "level", "x", "y", "p", "q").collect()
    assert [(r.u, r.n) for r in v] == [("u", 3)] and v[0].abs_diff == pytest.approx((0.1 + 0.3 + 0.3) / 3)


def test_folded_orders(spark):
    cases = {("A", "B"): ("a", 2, 2, 1), ("A", "A"): ("tie", 2, 2, 2), ("tie", "B"): ("tie", 2, 1, 0), (None, "A"): ("tie", 1, 1, 1), ("B", "A"): ("b", 2, 2, 1), ("x", None): ("tie", 0, 0, 0)}
    df = spark.createDataFrame([(*k, "p") for k in cases], "s string, t string, pair string").withColumn("f", agreement.folded(F.col("s"), F.col("t"))).select("s", "t", "pair", "f.*")
    assert {(r.s, r.t): (r.corrected_winner, r.n_verdicts, r.n_decisive, r.n_first_slot_wins) for r in df.collect()} == cases
    total = agreement.head_to_head(df, "pair").where("pair is null").first()
    assert (total.n_questions, total.n_complete, total.corrected_win_rate_a, total.flip_rate, total.n_failed, total.position_bias_rate) == (6, 4, 0.25, 0.5, 3, 5 / 8)


def test_votes(spark):
    rows = [("c", 5, True, False), ("c", 2, False, True), ("c", 1, True, True), ("d", 3, True, True), ("e", 2, True, False), ("e", 2, False, True)]
    got = {r["case"]: r for r in agreement.weighted_votes(spark.createDataFrame(rows, "case string, w int, a boolean, b boolean"), "case", "w", "a", "b").collect()}
    assert (got["c"].mechanical, got["c"].decisive, got["c"].n_split) == ("A", "A", 2) and got["c"].coherence == pytest.approx(3 / 7)
    assert (got["d"].mechanical, got["d"].coherence) == (None, None) and (got["e"].decisive, got["e"].coherence) == (None, 0.0)


def test_labels_and_counts(spark):
    df = spark.createDataFrame([("r", 1, " Good ", 1, 30), ("r", 1, "bad", 2, 1), ("r", 2, "odd", 1, 0), ("r", 2, "bad", 2, 1), (None, 1, "bad", 1, 2), ("s", None, "bad", 1, 2)], "g string, i int, label string, o int, n int")
    got = {r.g: (r.n_labelled, r.good_fraction, r.bad_fraction) for r in agreement.label_fractions(df, ["g"], "i", F.col("label"), ["good", "bad"], [F.col("o")]).collect()}
    assert got == {"r": (2, 0.5, 0.5), None: (1, 0.0, 1.0)}
    counts = {r.g: (r.n_labelled, r.mean_checks, r.atomic_fraction, r.max_checks) for r in agreement.check_counts(df, ["g"], "i", F.col("n"), [F.col("o")]).collect()}
    assert counts == {"r": (2, 10.5, 0.5, 20), None: (1, 2.0, 0.0, 2)}


def test_exact_functions_at_size():
    """Halving, tails and windows agree with plain sums, and large cases end."""
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 90)
        k, p = rng.randrange(n + 1), rng.random() * 0.9 + 0.05
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert exact.binomial_tail(k, n, p) == pytest.approx(sum(pmf[: k + 1]), abs=1e-12)
        assert exact.binomial_two_sided(k, n, p) == pytest.approx(min(1.0, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-9))), abs=1e-9)
        gaps = [(n - 2 * j) / 500 for j in range(n // 2 + 1) if exact.mcnemar_p(j, n - j) < 0.05]
        assert exact.least_significant_gap(n, 500) == (min(gaps) if gaps else None)
    assert exact.clopper_pearson(500_000, 1_000_000) == pytest.approx((0.49902, 0.50098), abs=1e-5)
    assert exact.fisher_p(500_000, 1_000_000, 501_000, 1_000_000) == pytest.approx(0.1577, abs=2e-3) and exact.mcnemar_p(400_000, 600_000) == 0
    assert exact.paired_delta(0, 0, 10) == (0.0, 0.0) and exact.paired_delta(5, 15, 100) == pytest.approx(((2 * 0.08657146910143 - 1) * 0.2, (2 * 0.49104587170796 - 1) * 0.2))


def test_rubric_items_tokenisers_and_vocabulary(spark):
    df = spark.createDataFrame([("- Rate: names it (importance 5/5)\n2) plain line\n\n: odd", None), (None, None)], "t string, x string")
    items = [[tuple(i) for i in r.i] for r in df.select(preference.rubric_items(F.col("t")).alias("i")).collect()]
    assert items == [[("Rate", "names it", 5), ("", "plain line", 3), ("", "odd", 3)], []]
    got = spark.createDataFrame([("The Rates of 2.5 flows",)], "t string").select(T.tokens_by(F.col("t"), r"[a-z]+", 3, True, True).alias("a"), T.tokens_by(F.col("t"), r"\d+(?:\.\d+)?").alias("b")).first()
    assert got.a == ["rat", "flow"] and got.b == ["2.5"]
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "b"]), (3, [])], "id int, w array<string>")
    v = {r.term: (r.tf, r.df) for r in similarity.vocabulary(docs, "id", similarity.with_pairs(F.col("w")), 2).collect()}
    assert v == {"a": (3, 2), "b": (2, 2), "a b": (2, 2)}
