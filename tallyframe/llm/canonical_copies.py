"""Problem 7: duplicates hidden by formatting, by canonical text and 128-bit hashes.

Title and description are reduced to their words in order (maximal runs of Unicode letters or digits, lower
case), always in the order title, description, whatever the order or case of the keys they were shipped in.
Two independent 64-bit hashes name the canonical text; a third hash and its length are part of the grouping
key, so that texts that collide in 128 bits are still told apart, and ``collisions`` counts them. Counting is combined before the shuffle.

With ``fold`` characters are canonicalised too (NFKC): full-width letters, ligatures, superscripts and decomposed accents become the letters
they stand for. Words are then those of the folded text, so it is off where words are defined by the characters as they are.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut

KEYS = ["k1", "k2", "check", "length"]


def folded(column: Column) -> Column:
    """The text with its characters in compatibility form; texts of plain ASCII don't leave the JVM's own path."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return F.when(column.rlike(r"[^\x00-\x7F]"), run(column)).otherwise(column)


def canonical(column: Column, fold: bool = False) -> Column:
    """The words of a text, lower-cased, with single blanks between; NULL counts as empty."""
    column = folded(column) if fold else column
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def fingerprints(rows: DataFrame, id_col: str, title_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """(id, k1, k2, check, length) of each row's canonical title and description."""
    text = F.concat_ws("\n", canonical(F.col(title_col), fold), canonical(F.col(text_col), fold))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull())
    return rows.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), F.hash("text").alias("check"), F.length("text").alias("length"))


def copy_groups(prints: DataFrame) -> DataFrame:
    """(keys, first_id, copies): one record for each canonical text, and how many rows have it."""
    return prints.groupBy(*KEYS).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collisions(prints: DataFrame) -> DataFrame:
    """(n_records, n_collisions): canonical texts, and 128-bit hashes that more than one of them has."""
    by_hash = copy_groups(prints).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    return by_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count_if(F.col("n") > 1).alias("n_collisions"))


def records(rows: DataFrame, id_col: str, title_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """(first_id, title, description, copies): one record for each canonical text, in canonical form, with the smallest id and the number of its rows."""
    groups = copy_groups(fingerprints(rows, id_col, title_col, text_col, fold)).select("first_id", "copies")
    texts = rows.select(F.col(id_col).cast("long").alias("first_id"), canonical(F.col(title_col), fold).alias("title"), canonical(F.col(text_col), fold).alias("description"))
    return groups.join(texts, "first_id").select("first_id", "title", "description", "copies")


def copies(rows: DataFrame, id_col: str, title_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """(first_id, copy_id): each row whose title and description have the same words in the same order as an
    earlier row's, with the smallest id of its set. Rows grow in proportion to the input however large a set is.

    Defined cases: NULL counts as empty text; rows with neither title nor description are one set; NULL ids are
    left out; an empty table gives no rows; other columns are ignored; texts of any length are used whole."""
    prints = cut(fingerprints(rows, id_col, title_col, text_col, fold))
    many = copy_groups(prints).where("copies > 1")
    joined = prints.join(many, KEYS).where("id != first_id")
    return joined.select("first_id", F.col("id").alias("copy_id"))


def parsed_entries(raw: DataFrame, id_col: str = "entry_id", payload_col: str = "payload") -> DataFrame:
    """(id, title, description) of JSON payloads. Keys count whatever their case and order; a bare JSON string
    is a description without title; NULL, lacking or non-text fields count as empty (numbers as their JSON
    text); payloads that aren't valid JSON, or are neither object nor string, are left out."""

    def field(value) -> str:
        return value if isinstance(value, str) else "" if value is None else json.dumps(value, sort_keys=True)

    def one(payload: str | None) -> tuple[str, str] | None:
        try:
            value = json.loads(payload) if payload is not None else None
        except (ValueError, RecursionError):
            return None
        if isinstance(value, str):
            return "", value
        if not isinstance(value, dict):
            return None
        low = {k.strip().lower(): v for k, v in value.items()}
        return field(low.get("title")), field(low.get("description"))

    def run(frames):
        for f in frames:
            got = [one(p) for p in f["payload"]]
            keep = [i for i, g in enumerate(got) if g is not None]
            if keep:
                yield pd.DataFrame({"id": f["id"].iloc[keep].to_numpy(), "title": [got[i][0] for i in keep], "description": [got[i][1] for i in keep]})

    picked = raw.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("string").alias("payload"))
    return picked.where(F.col("id").isNotNull()).mapInPandas(run, "id long, title string, description string")
