"""Replies, tool calls, cache folders, judged pairs and the registry."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import messages
from tallyframe.operators import ranking
from tallyframe.plans import registry
from tallyframe.sources import files, verdicts


def test_response_text(spark):
    cases = {'{"content": "  ", "text": "yes", "answer": "no"}': "yes", '{"response": "r", "content": "c"}': "r", '{"other": "x"}': "", "plain words": "plain words", '"quoted"': "quoted", '{"content": ""}': ""}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.x for r in df.select("t", messages.response_text(F.col("t")).alias("x")).collect()}
    assert got == {**cases, None: ""}


def test_tool_calls(spark):
    raw = [json.dumps([{"id": "a", "function": {"name": "f", "arguments": '{"x": 1}'}}, {"name": "g"}]), "[]", "no json", None]
    got = [[tuple(c) for c in r.c] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string").select("i", messages.tool_calls(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [[("a", "f", '{"x": 1}'), ("call_1", "g", "{}")], [], [], []]


def test_cache_stats(spark, tmp_path):
    assert files.cache_stats(spark, f"{tmp_path}/none").first() == (0, 0, None, None)
    (tmp_path / "sub").mkdir()
    for name, text in (("a.json", '{"fetched_at": 5.5}'), ("sub/b.json", '{"fetched_at": 2}'), ("c.json", "broken"), ("d.txt", "x")):
        (tmp_path / name).write_text(text)
    assert files.cache_stats(spark, str(tmp_path)).first() == (3, 19 + 17 + 6, 2.0, 5.5)


def test_judged_pairs(spark):
    cases = spark.createDataFrame([("one", "x", "y"), ("two", "p", "q")], "case string, a string, b string")
    cached = spark.createDataFrame([("x", "y", False, "A")], "first string, second string, swapped boolean, winner string").select(verdicts.cache_key(F.col("first"), F.col("second"), F.col("swapped")).alias("key"), "winner")
    assert {tuple(r) for r in verdicts.judged_pairs(cases, cached).collect()} == {("one", "A", None), ("two", None, None)}

    def first_slot(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "winner": "A"})

    assert {tuple(r) for r in verdicts.judged_pairs(cases, cached, first_slot).collect()} == {("one", "A", "B"), ("two", "A", "B")}


def test_registry():
    assert registry.build("verdict_scores") is registry.QUERIES["verdict_scores"]
    with pytest.raises(KeyError, match="unknown query 'nothing'"):
        registry.build("nothing")


def test_quantiles(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 2, 9)] + [("b", 4), ("b", None)], "g string, v int")
    got = {r.g: (r.lo, r.mid, r.hi) for r in ranking.quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    assert got["a"] == pytest.approx((1.4, 2, 6.2)) and got["b"] == (4, 4, 4)


def test_cases_of_an_array_file(spark, tmp_path):
    rows = [{"id": i, "domain": "ab"[i % 4 == 0]} for i in range(40)] + [{"id": 99, "domain": "c"}]
    (tmp_path / "cases.json").write_text(json.dumps(rows))
    read = lambda **k: files.read_cases(spark, f"{tmp_path}/cases.json", "id long, domain string", "domain", "id", **k)
    assert read().count() == 41 and {r.domain for r in read(groups=["a", "b"]).collect()} == {"a", "b"}
    few = read(groups=["a", "b"], limit=12).collect()
    assert sum(r.domain == "a" for r in few) == 9 and len(few) == 12 and {r.id for r in few} == {r.id for r in read(groups=["a", "b"], limit=12).collect()}


def test_unit_conversion():
    from tallyframe.functions.parsing import conversion

    same, factor = conversion("km/h", "m/s")
    assert same and factor == pytest.approx(1 / 3.6) and conversion("J", "N") == (False, None) and conversion("J foo", "J") == (False, None)
    assert conversion("KG", "g")[0] and conversion("percent", "%") == (True, 1.0) and conversion(None, "g") == (False, None)
