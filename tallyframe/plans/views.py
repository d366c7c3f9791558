"""Canonical views of the tables that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.session import table

#: What names one rubric: a run's checklist of one source for one question.
RUBRIC = ["run_name", "rubric_source", "uid"]


def criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criteria with category, body, weight and polarity normalised as on construction: an inline prefix beats the
    declared category, weights are rounded half to even and clamped, polarity is read from the phrasing."""
    raw = table(spark, d, "criteria").select("criterion_id", "uid", "domain", "split", "run_name", "rubric_source", "pos", "title", "description", "weight", "category")
    out = raw.withColumn("cat", T.declared_or_prefix(F.col("description"), F.col("category")))
    return out.select(
        "criterion_id", "uid", "domain", "split", "run_name", "rubric_source", "pos", "title", "description", "cat", T.without_strict_prefix(F.col("description")).alias("body"),
        T.coerced_weight(F.col("weight"), F.col("cat")).alias("w"), T.polarity_method(F.col("description"), F.col("cat")).alias("method"),
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One row per uid: the row of the smallest ex_id."""
    ex = table(spark, d, "examples").select("ex_id", "uid", "domain", "split", "question", "reference_answer")
    return ex.where("uid is not null").groupBy("uid").agg(*[F.min_by(c, "ex_id").alias(c) for c in ("ex_id", "domain", "split", "question", "reference_answer")])
