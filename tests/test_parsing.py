"""Broken JSON, question parts, units, preference rules, greedy steps, shards and progress."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import parsing as P
from tallyframe.functions import preference as R
from tallyframe.operators import greedy
from tallyframe.sources import files
from tallyframe.streaming.incremental import Progress


@pytest.mark.parametrize(
    "text,expect,want",
    [
        ('[{"w": 5},]', None, [{"w": 5}]),
        ("```json\n[1, 2]\n```", "array", [1, 2]),
        ('{"items":[1]}', "array", [1]),
        ('Sure: {"a": "}", "b": [1]} done', "object", {"a": "}", "b": [1]}),
        (r'{"t": "\alpha \\ \n"}', None, {"t": "\\alpha \\ \n"}),
        ("no json", None, None),
        ("", None, None),
        (None, None, None),
        ("[1]", "object", None),
    ],
)
def test_tolerant_json(text, expect, want):
    assert P.tolerant_json(text, expect) == want


def test_question_parts(spark):
    assert P.question_parts("Do it. a) Find x. b) Why is y so? c) fine")[0] == "subquestions"
    kind, parts = P.question_parts("Which? (a) red (b) blue (c) green")
    assert kind == "mcq" and [p[0] for p in parts] == ["a", "b", "c"]
    assert P.question_parts("1. Find x\n2. Show y\n4. no")[0] == "subquestions" and P.question_parts("b) a)") == ("none", [])
    df = spark.createDataFrame([("a) Find b) Show",), (None,)], "q string")
    assert [r.k for r in df.select(P.question_parts_column(F.col("q"))["kind"].alias("k")).collect()] == ["subquestions", "none"]


def test_units():
    assert P.parsed_unit("5 kg*m/s^2") == P.parsed_unit("newtons")
    assert P.parsed_unit("J")[0] == [2, 1, -2, 0, 0, 0] and P.parsed_unit("3.2 kJ")[1] == pytest.approx(1e3)
    assert P.parsed_unit("km/h")[1] == pytest.approx(1000 / 3600) and P.parsed_unit("minutes")[1] == 60
    assert P.parsed_unit("m foo")[2] == ["foo"] and P.parsed_unit("foo") is None and P.parsed_unit(None) is None
    assert P.close(1.0, 1.0 + 1e-9) and not P.close(1.0, 1.1) and not P.close(None, 1.0)


def test_preference_rules(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("A", None), (None, "A")]
    df = spark.createDataFrame([(*r, "A") for r in rows], "f string, s string, label string")
    hits = df.select(R.hit(F.col("f"), F.col("s"), F.col("label"), "swap").alias("h"), R.hit(F.col("f"), F.col("s"), F.col("label")).alias("g"), R.prediction(F.col("f"), F.col("s"), "swap_consistent").alias("p"), R.side_of(F.col("f"), F.lit(True)).alias("o")).collect()
    assert [r.h for r in hits] == [1, 0, 0, None, None] and [r.g for r in hits] == [1, 1, 0, 1, None]
    assert [r.p for r in hits] == ["A", None, "B", None, None] and [r.o for r in hits] == ["B", "B", "A", "B", None]
    text = "1. Names the rate (importance 5/5)\n- States the unit\n\nshort\n"
    t = spark.createDataFrame([(text,)], "t string").select(R.importances(F.col("t")).alias("i"), R.transformed(F.col("t"), "strip_weights").alias("s"), R.transformed(F.col("t"), "bare").alias("b"), R.numbered(R.rubric_lines(F.col("t"))).alias("n"), R.first_number(F.lit("about 1,200.5 kJ")).alias("x"), R.group_of(F.lit("stem")).alias("g")).first()
    assert t.i == [5, 3] and t.s == t.b == "Names the rate\nStates the unit\nshort" and t.n.startswith("1. Names") and (t.x, t.g) == (1200.5, "stem")
    assert R.mcnemar_power(200, 0.3, 0.1) > 0.9 > R.mcnemar_power(20, 0.2, 0.15)


def test_greedy_steps(spark):
    rows = [(1, 0, "States the rate is 5", 3, "Essential", True), (2, 1, "Does not mention the rate is 5", -2, "Pitfall", True), (3, 2, "States the rate is 6", 5, "Essential", True), (4, 3, "Names the pump", 4, "Important", False), (5, 4, "names pump", 5, "Important", False), (6, 5, "odd", -1, "Pitfall", True), (7, 6, "odder", -2, "Pitfall", True)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id int, pos int, t string, w int, cat string, own boolean")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(greedy.without_mirrors(df, ["g"], "t", "w", ["pos"])) == [1, 3, 5, 6, 7]
    assert ids(greedy.with_best_missing(df, ["g"], "t", "w", "own", ["pos"], 2)) == [1, 2, 3, 5, 6, 7]
    assert ids(greedy.within_bounds(df, ["g"], "w", ["pos"], 3)) == [3, 4, 5]
    kept = greedy.balanced_pitfalls(df.withColumn("spare", ~F.col("own")), ["g"], "cat", "w", "spare", ["pos"]).collect()
    assert len(kept) == 5 and sum(r.cat == "Pitfall" for r in kept) == 1


def test_shards_and_ids(spark, tmp_path):
    a = spark.createDataFrame([("u", "", 1), ("v", "x", 1)], "uid string, rubric string, ord int")
    b = spark.createDataFrame([("u", "y", 0), ("v", "", 5)], "uid string, rubric string, ord int")
    assert {r.uid: r.rubric for r in files.merged_shards([a, b], "uid", "rubric", "ord").collect()} == {"u": "y", "v": "x"}
    files.write_shards(a, str(tmp_path / "s"), "uid", 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert files.carried_over(a.limit(0), b, a, "uid").count() == 2
    assert files.as_json(a, ["uid"]).columns == ["uid", "json"]
    (tmp_path / "x.json").write_text('{"dev": ["a", "b", "a"]}')
    assert files.case_ids(spark, f"{tmp_path}/x.json:dev").count() == 2 and files.case_ids(spark, "q, r").count() == 2


def test_progress(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    p = Progress(spark)
    try:
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if p.rows >= 5:
                break
            __import__("time").sleep(0.1)
        assert p.rows == 5
    finally:
        p.stop()
