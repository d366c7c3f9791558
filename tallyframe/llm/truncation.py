"""Problem 4: texts cut off by field limits, by length histograms and endings.

Per source (here the setting) the lengths of all values are counted, in characters and in bytes. A field limit shows as a
spike at the maximum: far more values than neighbouring lengths let expect, and none beyond. The rule that lets a row in is its evidence:

* ``limit``: at a spike length and without terminal punctuation. A result, option or list item that would do without a full stop
  elsewhere doesn't count here, since the limit may have cut ``12.3 mm`` to ``12.3 m``.
* ``transfer``: shorter than recorded, and no complete ending: neither terminal punctuation nor such a result, option or item.
* ``ending``: no evidence from lengths, and no complete ending. Values cut mid-transfer without a record can't be found by lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut, small_or_plain

#: Up to so many sources their limits are broadcast (counted first); more join by shuffle.
BROADCAST_SOURCES = 100_000
#: Characters without meaning at the end: blanks, zero-width marks, closing quotes, brackets and markup.
TAIL = r"[\s\u200b\u200c\u200d\ufeff\u00a0]+$"
TERMINAL = r"""[.!?\u2026\u3002\uff01\uff1f]["'\u201d\u2019\u00bb)\]}*_`>\s]*$"""
#: Endings that are complete without a full stop.
COMPLETE = [
    r"\\boxed\{[^{}]*\}[$\s]*$",  # a boxed result
    r"(?i)\bfinal answer\s*:\s*[-+]?\d[\d.,]*(?:e[-+]?\d+)?\s+\S+$",  # a named result with its unit
    r"(?:^|\n)\s*(?:[-*\u2022]|\d+[.)])\s+[^\n]*:\s*[-+]?\d[\d.,]*\s+\S+$",  # a list item with value and unit
    r"\([A-Za-z0-9]\)$",  # an option
    r"(?i)\boptions?\s*:[^\n]*\([A-Z]\)\s+\S+(?:\s+\S+){0,3}$",  # a list of options
    r"^\s*[-+]?\d[\d.,]*(?:e[-+]?\d+)?(?:\s+\S+)?$",  # a bare result
    r"^\s*\[[^\[\]]*\]$",  # a note in brackets
    r"""["'\u201d\u2019](?i:\s*(?:final )?answer:)$""",  # a quotation with nothing but a label after it
]
#: Content is any letter or digit once tags, fences and placeholders are gone.
PLACEHOLDER = r"(?i)^[\s\p{P}\p{S}\u200b]*(?:(?:final\s+)?answer|response|n/?a|none|null|nil|nan|tbd|todo|empty|no answer|no response|think)?[\s\p{P}\p{S}\u200b]*$"
MARKUP = r"(?s)<[^<>]{0,40}>|```\w*"


def bare(text: Column) -> Column:
    """The text without blanks and zero-width marks at its end; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), TAIL, "")


def has_content(text: Column) -> Column:
    return ~F.regexp_replace(F.coalesce(text, F.lit("")), MARKUP, " ").rlike(PLACEHOLDER)


def complete_ending(text: Column) -> Column:
    """Whether the last result, option or list item is complete without a full stop."""
    out = F.lit(False)
    for pattern in COMPLETE:
        out = out | bare(text).rlike(pattern)
    return out


def spikes(rows: DataFrame, source: str, text_col: str, factor: float = 8.0, least: int = 5, near: float = 0.1, beyond: float = 0.02) -> DataFrame:
    """(source, unit, length, n, expected): lengths at which a source's values pile up at the maximum.

    unit is ``chars`` or ``bytes``. expected is the mean count of the lengths within ``near`` below. A spike has at least
    ``least`` values and ``factor`` times the expected ones, and no more than the share ``beyond`` of the source's values is
    longer (a few may have been changed after the cut). Histograms are bounded by the longest text, not by the rows."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.length(text_col).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text_col).alias("length")))
    counted = rows.select(F.col(source).alias("source"), F.explode(units).alias("x")).select("source", "x.unit", "x.length").where("length > 0")
    counted = counted.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("source", "unit").orderBy("length")
    longer = F.coalesce(F.sum("n").over(by_length.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("source", "unit"))
    ranked = counted.withColumn("beyond", longer / total).where((F.col("beyond") <= beyond) & (F.col("n") >= least)).withColumnRenamed("n", "n_top").withColumnRenamed("length", "top")
    width = F.greatest(F.floor(F.col("top") * near), F.lit(1))
    same = F.col("t.source").eqNullSafe(F.col("c.source")) & (F.col("t.unit") == F.col("c.unit"))
    below = ranked.alias("t").join(counted.alias("c"), same & (F.col("length") < F.col("top")) & (F.col("length") >= F.col("top") - width), "left")
    out = below.groupBy("t.source", "t.unit", "top", "n_top").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.first(width)).alias("expected"))
    return out.where(F.col("n_top") >= factor * F.col("expected")).select("source", "unit", F.col("top").alias("length"), F.col("n_top").alias("n"), "expected")


def truncated(rows: DataFrame, id_col: str, source: str, text_col: str, chars_col: str | None = None, slack: int = 5) -> DataFrame:
    """(id, source, evidence): rows whose text stops before its last sentence or word is complete. evidence is ``limit`` (at
    its source's spike length), ``transfer`` (more than ``slack`` characters shorter than recorded) or ``ending``.

    Defined cases: NULL, empty and placeholder texts aren't truncated; a NULL, zero or inexact recorded length is no evidence; a
    NULL source is a source; NULL ids are left out; an empty table gives no rows; texts are judged whole."""
    found = spikes(rows, source, text_col)
    limits = found.groupBy("source").agg(F.max(F.when(F.col("unit") == "chars", F.col("length"))).alias("at_chars"), F.max(F.when(F.col("unit") == "bytes", F.col("length"))).alias("at_bytes"))
    limits = small_or_plain(cut(limits), BROADCAST_SOURCES)
    recorded = F.col(chars_col) if chars_col else F.lit(None)
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(source).alias("source"), F.col(text_col).alias("text"), recorded.cast("long").alias("recorded"))
    open_ = base.where(has_content(F.col("text")) & ~bare(F.col("text")).rlike(TERMINAL))
    open_ = open_.select("id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "recorded", complete_ending(F.col("text")).alias("complete")).alias("o")
    joined = open_.join(limits.alias("l"), F.col("o.source").eqNullSafe(F.col("l.source")), "left")
    at_limit = F.coalesce((F.col("chars") == F.col("at_chars")) | (F.col("bytes") == F.col("at_bytes")), F.lit(False))
    evidence = F.when(at_limit, "limit").when(F.col("recorded") > F.col("chars") + slack, "transfer").otherwise("ending")
    return joined.where(at_limit | ~F.col("complete")).select("id", F.col("o.source").alias("source"), evidence.alias("evidence"))


def truncation_rates(rows: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, n_truncated, n_limit, n_transfer, share) for every source."""
    total = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    cut = found.groupBy("source").agg(F.count(F.lit(1)).alias("n_truncated"), F.count_if(F.col("evidence") == "limit").alias("n_limit"), F.count_if(F.col("evidence") == "transfer").alias("n_transfer"))
    joined = total.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("t.source", "n_rows", n("n_truncated"), n("n_limit"), n("n_transfer"), (F.coalesce("n_truncated", F.lit(0)) / F.col("n_rows")).alias("share"))
