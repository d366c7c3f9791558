"""Rewriting rules on known sentences."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rewriting as W


def value(spark, column, d, c="Essential"):
    return spark.createDataFrame([(d, c)], "d string, c string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,category,want",
    [
        ("Does not mention that the rate is 5", "Pitfall", "States the rate is 5"),
        ("The response fails to name the pump", "Essential", "Does name the pump"),
        ("Recommends the unsafe drug", "Pitfall", "Avoids recommending the unsafe drug"),
        ("Recommends the unsafe drug", "Essential", "Avoids recommends the unsafe drug"),
        ("Pitfall Criteria: Ignores  friction", "Pitfall", "Accounts for friction"),
        ("", "Pitfall", ""),
        (None, "Pitfall", ""),
    ],
)
def test_positive_form(spark, text, category, want):
    assert value(spark, W.positive_form(F.col("d"), F.col("c")), text, category) == want


def test_offence(spark):
    f = W.polarity_offence(F.col("d"), F.col("c"))
    assert value(spark, f, "Fails to say X", "Pitfall") == "failure" and value(spark, f, "Omits X") == "failure"
    assert value(spark, f, "States X") is None and value(spark, f, "Avoids X", "Pitfall") is None


def test_plain_form(spark):
    f = W.plain_form(F.col("d"))
    assert value(spark, f, "The answer clearly states the final rate of flow") == "The answer states the final rate of flow"
    assert value(spark, f, "States the rate of the flow, ensuring a logical flow") == "States the rate of the flow"
    assert value(spark, f, "States the rate of flow, thereby fixing the sign") == "States the rate of flow, thereby fixing the sign"
    assert value(spark, f, "Thorough and concise") == "Thorough and concise"


def test_titles_weights_and_hits(spark):
    assert value(spark, W.derived_title(F.col("d")), "Names the pump, and more words") == "Names the pump, and"
    assert value(spark, W.derived_title(F.col("d")), None) == "Criterion"
    assert value(spark, W.subjective_hits(F.col("d")), "A concise, robust tone") == ["concise", "robust", "tone"]
    w = lambda x, c, up: spark.range(1).select(W.stepped_weight(F.lit(x), F.lit(c), up).alias("x")).first().x
    assert [w(5, "Essential", True), w(3, "Optional", False), w(-2, "Pitfall", True), w(-2, "Pitfall", False)] == [5, 2, -2, -1]
