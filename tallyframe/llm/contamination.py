"""Problem 9: evaluation texts inside corpus documents, by size-partitioned MinHash containment search.

A test passage is short and a document long, so a MinHash of the whole document says nothing about the
passage. Both are therefore partitioned to the size of the smallest passage that counts, ``run`` successive words:
the MinHash of such a partition is the least hash of its word shingles. A passage contained in a document is one of
the document's partitions, and the two MinHashes are equal: containment 1 is found with certainty, not only with some
probability. Long documents get MinHashes in proportion to their size (neighbouring partitions mostly share
theirs, about one in five words gives a new one), short ones few. Documents and items with a MinHash in common are
candidates, and an exact comparison of all runs of words decides.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import as_long, chunks, rolling_hash, sliding_min, word_hashes
from tallyframe.session import cut, small_or_plain

RUN = 12
SHINGLE = 5
#: Up to so many rows of item MinHashes, or of candidates, are broadcast (counted first); more join by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 10_000_000
WORD = re.compile(r"[^\W_]+")


def min_hashes(texts: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """(id, mh) of texts (id, text): the distinct MinHashes of all partitions of ``run`` successive words."""

    def go(batches):
        for b in chunks(batches, "text"):
            hashed, offsets = word_hashes(b["text"].to_pylist())
            least = sliding_min(rolling_hash(hashed, shingle), run - shingle + 1)
            counts = np.maximum(np.diff(offsets) - run + 1, 0)
            rows = np.repeat(np.arange(b.num_rows), counts)
            at = offsets[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            mh = least[at] if len(at) else least[:0]
            new = np.ones(len(rows), bool)
            new[1:] = (mh[1:] != mh[:-1]) | (rows[1:] != rows[:-1])
            ids = b["id"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[new]]), as_long(mh[new])], ["id", "mh"])

    return texts.mapInArrow(go, "id long, mh long")


def word_runs(text: str | None, run: int) -> set[tuple[str, ...]]:
    words = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}


def contained_passages(documents: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_cols: list[str], run: int = RUN) -> DataFrame:
    """(doc_id, item_id, shared_runs, contained): documents with ``run`` successive words that follow each other in
    one text column of an item too; shared_runs counts the item's distinct runs found in the document, contained is their
    share of all its runs.

    Defined cases: NULL texts count as empty; items and documents of fewer than ``run`` words are in no pair; a run
    must lie within one column; NULL ids are left out; repeated rows with one id count as one; empty tables give no
    rows; clashing column names don't matter; documents are searched whole."""
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    fields = F.explode(F.array(*[F.col(c) for c in item_cols]))
    parts = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), fields.alias("text")).where(F.col("text").isNotNull())
    item_hashes = cut(min_hashes(parts, run).distinct().select("mh", F.col("id").alias("item")))
    hits = min_hashes(docs, run).join(small_or_plain(item_hashes, BROADCAST_ROWS), "mh")
    candidates = cut(hits.select("id", "item").distinct())
    by_item = parts.groupBy("id").agg(F.collect_list("text").alias("parts")).withColumnRenamed("id", "item")
    # Candidates are ids only. Items are small texts, but their number and size are checked before they are broadcast.
    size = by_item.select(F.aggregate("parts", F.lit(0), lambda n, t: n + F.length(t)).alias("n")).agg(F.sum("n").alias("n")).first().n or 0
    by_item = F.broadcast(by_item) if size <= BROADCAST_CHARS else by_item
    texts = docs.join(small_or_plain(candidates, BROADCAST_ROWS), "id").join(by_item, "item")

    def verify(frames):
        known: dict[tuple, set] = {}
        for f in frames:
            out, last, runs = [], None, set()
            for i, item, text, pieces in zip(f["id"], f["item"], f["text"], f["parts"]):
                key = (item, *pieces)
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = set().union(*(word_runs(p, run) for p in pieces))
                if text is not last:
                    last, runs = text, word_runs(text, run)
                if shared := len(known[key] & runs):
                    out.append((i, item, shared, shared / len(known[key])))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "shared_runs", "contained"])

    found = texts.select("id", "item", "text", "parts").mapInPandas(verify, "doc_id long, item_id long, shared_runs long, contained double")
    return found.groupBy("doc_id", "item_id").agg(F.max("shared_runs").alias("shared_runs"), F.max("contained").alias("contained"))
