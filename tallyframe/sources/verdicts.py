"""Verdicts of a judge: a cache keyed by content, and a pluggable judge for what it lacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.preference import side_of

Judge = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the request as JSON with its fields in a fixed order."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def judged(requests: DataFrame, cache: DataFrame, judge: Judge | None = None, schema: str = "key string, literally_true boolean") -> DataFrame:
    """(key, literally_true, cached): cached verdicts for requests (key, ...), and the judge's for the rest. Without a judge this is a
    replay: what isn't cached stays out."""
    hits = requests.join(cache.select("key", "literally_true").dropDuplicates(["key"]), "key").select("key", "literally_true", F.lit(True).alias("cached"))
    if judge is None:
        return hits
    rest = requests.join(cache.select("key"), "key", "left_anti").mapInPandas(judge, schema)
    return hits.unionByName(rest.select("key", "literally_true", F.lit(False).alias("cached")))


def judged_pairs(cases: DataFrame, cache: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(case, forward, swapped): the side A or B that wins each case (case, a, b) when shown as it is and swapped. Both orders are requests of their own
    (key, first, second), answered from the cache (key, winner) or by the judge with slot A or B; an order without an answer is NULL."""
    orders = F.explode(F.array(F.struct(F.lit(False).alias("swapped"), F.col("a").alias("first"), F.col("b").alias("second")), F.struct(F.lit(True).alias("swapped"), F.col("b").alias("first"), F.col("a").alias("second"))))
    requests = cases.select("case", orders.alias("o")).select("case", "o.*").withColumn("key", cache_key(F.col("first"), F.col("second"), F.col("swapped")))
    found = cache.select("key", "winner").dropDuplicates(["key"])
    if judge is not None:
        rest = requests.select("key", "first", "second").dropDuplicates(["key"]).join(found.select("key"), "key", "left_anti")
        found = found.unionByName(rest.mapInPandas(judge, "key string, winner string"))
    sides = requests.join(found, "key", "left").select("case", "swapped", side_of(F.col("winner"), F.col("swapped")).alias("side"))
    return sides.groupBy("case").agg(F.max(F.when(~F.col("swapped"), F.col("side"))).alias("forward"), F.max(F.when(F.col("swapped"), F.col("side"))).alias("swapped"))


def parsed_verdicts(replies: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, item, literally_true, missing): replies (uid, reply) are JSON arrays of {id, true}; the first entry of an id counts, items
    without one are false and missing."""
    entries = replies.select("uid", F.posexplode(F.from_json("reply", "array<struct<id:int,true:boolean>>")).alias("ord", "e")).select("uid", "ord", F.col("e.id").alias("item"), F.col("e")["true"].alias("t"))
    first = entries.groupBy("uid", "item").agg(F.min_by("t", "ord").alias("t"))
    return items.join(first, ["uid", "item"], "left").select("uid", "item", F.coalesce("t", F.lit(False)).alias("literally_true"), F.col("t").isNull().alias("missing"))
