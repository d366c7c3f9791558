"""Upserts, last and first wins, unions with priority, conflicts, samples, splits and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ranking import first_per_key, largest_remainder, running_totals
from tallyframe.session import small_or_plain


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. ``order`` must be ascending numbers, the latest largest."""
    return first_per_key(df, keys, [(-o).alias(f"_o{i}") for i, o in enumerate(order)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't brought, and all new ones; keys of NULL are equal."""
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def first_source_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables; for a key in more than one, those of the earliest table."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    best = out.groupBy(*keys).agg(F.min("_priority").alias("_priority"))
    return out.join(best, [*keys, "_priority"]).drop("_priority")


def conflicts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, n): keys with more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1")


def hash_order(seed: int, *columns: str) -> Column:
    """A repeatable random order: MD5 of seed and key, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary"))


def hash_number(text: Column, modulus: int) -> Column:
    """The first eight hexadecimal digits of a SHA-256 as a number, modulo."""
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def sample_per_group(df: DataFrame, group: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group in hash order; the limit is applied within tasks before the shuffle."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(hash_order(seed, key), key))
    return df.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def positions(df: DataFrame, group: list[str], key: str, seed: int = 0) -> DataFrame:
    """Adds _i, the place of each row in its group's hash order from 0, and _n, the size of the group; a group may hold all rows."""
    out = running_totals(df, group, [hash_order(seed, key), F.col(key)], F.lit(1))
    return out.withColumnRenamed("_before", "_i").withColumnRenamed("_total", "_n")


def stratified_sample(df: DataFrame, group: str, key: str, target: int, seed: int = 0) -> DataFrame:
    """About ``target`` rows in the proportions of the groups, each with its largest-remainder quota."""
    quota = largest_remainder(df.groupBy(group).agg(F.count(F.lit(1)).alias("size")), group, "size", target)
    # No group takes more than the target, so that each task passes on no more of a group than that.
    first = sample_per_group(df, [group], key, target, seed)
    r = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key))
    return first.withColumn("_r", r).join(small_or_plain(quota.select(group, "quota"), 10_000), group).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def shift_partner(df: DataFrame, group: str, key: str, seed: int = 0, offset: int = 1) -> DataFrame:
    """(key, partner): each row's neighbour ``offset`` places on in its group's hash order, around the end; never itself."""
    r = positions(df.select(group, key), [group], key, seed)
    other = r.select(group, F.col("_i").alias("_j"), F.col(key).alias("partner"))
    return r.where(F.col("_n") > 1).withColumn("_j", (F.col("_i") + offset) % F.col("_n")).join(other, [group, "_j"]).where(F.col(key) != F.col("partner")).select(key, "partner")
