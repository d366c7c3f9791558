"""Text, normalisation and exact-test functions against known answers."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import exact
from tallyframe.functions import text as T


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in cols.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,polarity,method",
    [
        ("Avoids X", "positive", "avoidance"),
        ("Pitfall Criteria: Fails to state X", "negative", "failure"),
        ("Does not incorrectly assume X", "positive", "avoidance"),
        ("The response does not mention X", "negative", "failure"),
        ("Odd text", "positive", "unclassified"),
    ],
)
def test_polarity(spark, text, polarity, method):
    d, c = F.col("d"), F.lit("Pitfall")
    assert value(spark, T.polarity(d, c), d=text) == polarity
    assert value(spark, T.polarity_method(d, c), d=text) == method
    assert value(spark, T.polarity_method(d, F.lit("Optional")), d=text) == "category_default"


def test_forensic_precedence_is_the_other_way_round(spark):
    assert value(spark, T.forensic_phrasing(F.col("d")), d="Does not mention X and avoids Y") == "failure"
    assert value(spark, T.forensic_phrasing(F.col("d")), d="Never says X") == "avoidance"


@pytest.mark.parametrize("weight,category,want", [("7", "Essential", 5), ("0", "Optional", 1), ("x", "Pitfall", -1), ("5", "Pitfall", -2), ("2.5", "Important", 2), (None, "Important", 3), ("-4", "Optional", 4)])
def test_weights(spark, weight, category, want):
    assert value(spark, T.coerced_weight(F.col("w"), F.lit(category)), w=weight) == want


def test_categories(spark):
    assert value(spark, T.coerced_category(F.col("c")), c=" pitfall criteria: ") == "Pitfall"
    assert value(spark, T.coerced_category(F.col("c")), c=None) == "Important"
    assert value(spark, T.canonical_category(T.raw_category(F.col("d"))), d="Oddly Criteria: x") == "MALFORMED"
    assert value(spark, T.canonical_category(T.raw_category(F.col("d"))), d="no prefix") == "MISSING"
    assert value(spark, T.declared_or_prefix(F.col("d"), F.lit("Essential")), d="optional criterion: x") == "Optional"


def test_tokens_and_ngrams(spark):
    assert value(spark, T.content_tokens(F.col("s")), s="The mean of A-b's 3.14 is Zero-point") == ["mean", "a-b's", "3.14", "zero-point"]
    assert value(spark, T.ngrams(F.col("a"), 3), a=["a", "b", "c", "d"]) == ["a b c", "b c d"]
    assert value(spark, T.ngrams(F.col("a"), 3), a=["a"]) == []
    assert value(spark, T.ngrams(F.col("a"), 2), a=["a", "b", "a", "b"]) == ["a b", "b a"]
    assert value(spark, T.words(F.col("s")), s=None) == []


def test_text_details(spark):
    assert value(spark, T.sentence_count(F.col("s")), s="One. Two! (Three) 3.5 four") == 3
    assert value(spark, T.sentence_count(F.col("s")), s="  \t ") == 0
    assert value(spark, T.strip(F.col("s")), s=" \t a b \n") == "a b"
    assert value(spark, T.normalised_title(F.col("s")), s="  Main--Plan (2) ") == "main plan 2"
    assert value(spark, T.final_answer(F.col("s")), s="Final answer: 1\nFINAL ANSWER - 2  kJ ") == "2 kJ"
    assert value(spark, T.final_answer(F.col("s")), s="none") is None
    assert value(spark, T.without_fences(F.col("s")), s="```json\n{}\n```") == "{}"
    assert value(spark, T.polarity_stripped(F.col("s")), s="Does not mention the rate") == value(spark, T.polarity_stripped(F.col("s")), s="States the rate")
    assert [value(spark, T.stem(F.col("s")), s=w) for w in ("studies", "classes", "running", "glass", "is", "darkness")] == ["study", "class", "runn", "glass", "is", "dark"]


def test_set_measures(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, T.jaccard(a, b), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert value(spark, T.jaccard(a, b), a=[], b=["y"]) == 0
    assert value(spark, T.binary_cosine(a, b), a=["x", "y"], b=["y"]) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, T.containment(a, b), a=["x", "y"], b=["y"]) == 0.5


def test_content_uid(spark):
    got = value(spark, T.content_uid(F.col("d"), F.col("q"), F.col("r")), d="rar_science", q="q", r="r")
    assert got == "sci-53f620a82357" == "sci-" + hashlib.sha1(b"rar_science\0q\0r").hexdigest()[:12]


def test_lenient_values(spark):
    assert [value(spark, T.lenient_bool(F.col("s")), s=x) for x in (" Yes", "unmet", "maybe", None)] == [True, False, None, None]
    assert [value(spark, T.coerced_polarity(F.col("s")), s=x) for x in ("FAIL", "avoid", None)] == ["negative", "positive", "positive"]


def test_exact_tests():
    assert exact.mcnemar_p(129, 84) == pytest.approx(0.0024902882810814, rel=1e-9)
    assert exact.mcnemar_p(0, 0) == 1
    assert exact.clopper_pearson(5, 20) == pytest.approx((0.08657146910143, 0.49104587170796), abs=1e-10)
    assert exact.clopper_pearson(0, 7)[0] == 0 and exact.clopper_pearson(7, 7)[1] == 1
    assert exact.fisher_p(3, 10, 7, 10) == pytest.approx(0.17889540799758, rel=1e-9)
    assert exact.fisher_p(1, 10, 9, 10) == pytest.approx(0.00109333391067, rel=1e-8)
    assert exact.binomial_two_sided(2, 20) == pytest.approx(2 * sum(math.comb(20, i) for i in range(3)) / 2**20)
    assert exact.least_significant_gap(0, 10) is None
    g = exact.least_significant_gap(100, 1000)
    k = round((100 - g * 1000) / 2)
    assert exact.mcnemar_p(k, 100 - k) < 0.05 <= exact.mcnemar_p(k + 1, 99 - k)
    assert exact.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_wilson(spark):
    df = spark.createDataFrame([(5, 20), (44, 80), (0, 0)], "k int, n int")
    low, high = exact.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("l"), high.alias("h"), exact.mcnemar_p_column(F.col("k"), F.col("n")).alias("p")).collect()
    assert (got[0].l, got[0].h) == pytest.approx((0.11186170140767, 0.46870087761874), abs=1e-12)
    assert (got[1].l, got[1].h) == pytest.approx((0.44119507889356, 0.65422310815289), abs=1e-12)
    assert got[2].l is None and got[0].p == pytest.approx(exact.mcnemar_p(5, 20))
