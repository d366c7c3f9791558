"""Problem 3: frequency of every value and term, by suffix-sorted n-gram counting.

Every text gives the suffixes of its words (with marks for begin and end), truncated to ``longest`` words. Suffixes
are routed by their first word, sorted in reverse lexicographic order, and read once with a stack: the words
of the current suffix are on it, and whatever leaves it is an n-gram whose count and record set are complete;
they are added to the n-gram one word shorter. A suffix stands for all its prefixes, so one row per suffix is
shuffled instead of one per n-gram.

A record set is a set of keys (here: uids). Since one word may start a third of all suffixes, the route is the
first word *and* a hash shard of the record key: counts and sets of different shards are disjoint, so partial
results just add up, no set outgrows its shard, and no word is a hot spot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import strip

#: Marks of a text's begin and end. Both sort below letters and digits and occur in no word.
BEGIN, END, GAP = "\x02", "\x03", "\x01"


def title_words(column: Column) -> Column:
    """Words of a title's value: lower case, everything but a-z and 0-9 a blank, blanks reduced."""
    return F.filter(F.split(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def suffixes(rows: DataFrame, words: Column, record: Column, longest: int | None) -> DataFrame:
    """(suffix, record, times): distinct truncated suffixes per record, counted before the shuffle."""
    base = rows.select(words.alias("w"), record.cast("string").alias("record")).where((F.size("w") > 0) & F.col("record").isNotNull())
    marked = base.select("record", F.concat(F.array(F.lit(BEGIN)), F.col("w"), F.array(F.lit(END))).alias("w"))
    counted = marked.groupBy("record", F.array_join("w", GAP).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    w = F.split("text", GAP)
    length = F.size(w) if longest is None else F.least(F.size(w), F.lit(longest))
    parts = counted.select("record", "times", w.alias("w"), length.alias("l")).select("record", "times", "l", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    return parts.select(F.array_join(F.slice("w", F.col("i"), F.col("l")), GAP).alias("suffix"), "record", "times")


def read_sorted(frames):
    """The stack over one task's suffixes in reverse order: emits (ngram, times, records) partial counts."""
    stack: list[list] = []  # [word, times, records]
    out: list[tuple] = []
    shard_now = None

    def shrink(to: int) -> None:
        while len(stack) > to:
            _, times, records = stack.pop()
            out.append((GAP.join([x[0] for x in stack] + [_]), times, len(records)))
            if stack:
                stack[-1][1] += times
                stack[-1][2] |= records

    for f in frames:
        for shard, suffix, record, times in zip(f["shard"], f["suffix"], f["record"], f["times"]):
            words = suffix.split(GAP)
            if shard != shard_now:
                shrink(0)
                shard_now = shard
            same = 0
            for (a, _, _), b in zip(stack, words):
                if a != b:
                    break
                same += 1
            shrink(same)
            stack.extend([w, 0, set()] for w in words[same:])
            stack[-1][1] += times
            stack[-1][2].add(record)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["ngram", "times", "records"])
            out.clear()
    shrink(0)
    if out:
        yield pd.DataFrame(out, columns=["ngram", "times", "records"])


def ngram_counts(rows: DataFrame, words: Column, record: Column, longest: int | None = None, shards: int | None = None) -> DataFrame:
    """(kind, ngram, words, times, records): how often each n-gram of up to ``longest`` words occurs and in
    how many distinct records. kind is ``value`` for whole texts, ``ngram`` else (a one-word text is both). Without ``shards`` they are
    as many as shuffle partitions; ``shards_for`` gives so many that a shard's record set stays small.

    Defined cases: NULL and empty texts, and rows with a NULL record key, give nothing; repeated rows count each
    time in ``times`` and once in ``records``; an empty table gives no rows; texts of any length are used whole
    unless ``longest`` truncates the n-grams."""
    spark = rows.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = None if longest is None else longest + 1
    rest = suffixes(rows, words, record, longest).withColumn("shard", F.pmod(F.xxhash64("record"), F.lit(shards)).cast("int"))
    first = F.substring_index("suffix", GAP, 1)
    route = F.when(first == BEGIN, F.substring_index("suffix", GAP, 2)).otherwise(first)
    routed = rest.repartition(F.col("shard"), route).sortWithinPartitions(F.col("shard"), F.col("suffix").desc())
    partial = routed.select("shard", "suffix", "record", "times").mapInPandas(read_sorted, "ngram string, times long, records long")
    begins, ends = F.col("ngram").startswith(BEGIN), F.col("ngram").endswith(END)
    wanted = partial.where((begins & ends) | (~begins & ~ends))
    summed = wanted.groupBy("ngram").agg(F.sum("times").alias("times"), F.sum("records").alias("records"))
    kind = F.when(F.col("ngram").startswith(BEGIN), "value").otherwise("ngram")
    clean = F.translate(F.translate(F.col("ngram"), BEGIN + END, ""), GAP, " ")
    out = summed.select(kind.alias("kind"), F.trim(clean).alias("ngram"), "times", "records").withColumn("words", F.size(F.split("ngram", " ")))
    return out if longest is None else out.where(F.col("words") < longest)


SHARD_RECORDS = 50_000


def shards_for(spark, records: int) -> int:
    """Shards of at most about SHARD_RECORDS record keys each, so that no record set on a stack outgrows that."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), records // SHARD_RECORDS + 1)


def marked_values(rows: DataFrame, text_col: str, record_col: str, rare: int = 1, common: float = 0.05) -> DataFrame:
    """(level, value, times, records, mark): whole values (level ``title``) and single words (``term``) with mark
    ``rare`` if found in at most ``rare`` records, ``common`` if in more than the share ``common`` of all distinct
    record keys, else NULL."""
    total = rows.agg(F.count_distinct(F.col(record_col)).alias("n")).first().n
    counts = ngram_counts(rows, title_words(F.col(text_col)), F.col(record_col), shards=shards_for(rows.sparkSession, total)).where("kind = 'value' or words = 1")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
    return counts.select(F.when(F.col("kind") == "value", "title").otherwise("term").alias("level"), F.col("ngram").alias("value"), "times", "records", mark.alias("mark"))


def list_check(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The titles of each run's and domain's own list (run_name, domain, title, count, rank) with the count found:
    listed count, count of exactly this spelling, and count of all spellings of its value, in that run and domain.
    ``state`` tells whether the listed count agrees, is ``missing`` (NULL) or ``differs``."""
    value = F.array_join(title_words(F.col("title")), " ")
    keyed = rows.where(F.col("title").isNotNull()).select("run_name", "domain", strip(F.col("title")).alias("title"), value.alias("value"))
    spelt = keyed.groupBy("run_name", "domain", "title").agg(F.count(F.lit(1)).alias("spelling_count"))
    valued = keyed.groupBy("run_name", "domain", "value").agg(F.count(F.lit(1)).alias("value_count"))
    listed = lists.select("run_name", "domain", "rank", "title", F.col("count").alias("listed_count")).withColumn("value", value)
    out = listed.join(spelt, ["run_name", "domain", "title"], "left").join(valued, ["run_name", "domain", "value"], "left")
    out = out.withColumn("spelling_count", F.coalesce("spelling_count", F.lit(0))).withColumn("value_count", F.coalesce("value_count", F.lit(0)))
    state = F.when(F.col("listed_count").isNull(), "missing").when(F.col("listed_count") == F.col("spelling_count"), "agrees").otherwise("differs")
    return out.select("run_name", "domain", "rank", "title", "listed_count", "spelling_count", "value_count", state.alias("state"))
