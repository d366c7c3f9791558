"""Problem 6: long exact spans shared between records, by Rabin-Karp hashes of every window.

Pass 1 finds where shared windows can be at all. In each window of ``width`` characters the smallest hash of
its half-width pieces (its anchor) is the same wherever the window stands, so a window found in two records has
an anchor found in two records. Anchors are about one per 26 characters and counted over all records.
Pass 2 hashes every window whose anchor is in two or more records to 128 bits, counts windows over all records, and merges
those found in another record into maximal intervals. No window that can be shared is left out, while text
that is unique costs only its anchors. Nothing is compared pairwise: the work follows the number of windows, and
counts are combined before each shuffle, so a passage in a third of all rows is no hot spot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import as_long, chunks, code_points, flat, mix, rolling_hash, sliding_min


def _windows(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each whole window: its text's number, position there, and anchor; and all code points and starts."""
    points, starts = code_points(texts)
    piece = width // 2
    anchors = sliding_min(rolling_hash(mix(points.astype(np.uint64)), piece), width - piece + 1)
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    rows = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[rows] + inner
    return rows, inner, at, anchors[at] if len(at) else np.zeros(0, np.uint64), points


def anchors(records: DataFrame, width: int) -> DataFrame:
    """(anchor, rid), once for each record that has a window with this anchor."""

    def run(batches):
        for b in chunks(batches, "text"):
            rows, _, _, anchor, _ = _windows(b["text"].to_pylist(), width)
            change = np.ones(len(rows), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
            rows, anchor = rows[change], anchor[change]
            order = np.lexsort((anchor, rows))
            rows, anchor = rows[order], anchor[order]
            once = np.ones(len(rows), bool)
            once[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
            rid = b["rid"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([as_long(anchor[once]), pa.array(rid[rows[once]])], ["anchor", "rid"])

    return records.mapInArrow(run, "anchor long, rid long")


def in_several(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that two or more records have."""
    return rows.groupBy(*key).agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo != hi").select(*key)


def windows(records: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """(w1, w2, rid, pos) of every window whose anchor is among the record's anchors in several records."""
    with_hot = records.join(hot.groupBy("rid").agg(F.collect_set("anchor").alias("anchors")), "rid")

    def run(batches):
        for b in chunks(batches, "text"):
            rows, inner, at, anchor, points = _windows(b["text"].to_pylist(), width)
            values, offsets = flat(b["anchors"])
            # An anchor of another record of the chunk may let a window through here; counting decides anyway.
            keep = np.isin(anchor, values.view(np.uint64))
            # Two hashes of each character give two independent hashes of a window.
            w1, w2 = (rolling_hash(mix(points.astype(np.uint64), salt), width)[at[keep]] for salt in (0, 1))
            rid = b["rid"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([as_long(w1), as_long(w2), pa.array(rid[rows[keep]]), pa.array(inner[keep].astype(np.int32))], ["w1", "w2", "rid", "pos"])

    return with_hot.mapInArrow(run, "w1 long, w2 long, rid long, pos int")


def merged(positions: DataFrame, width: int) -> DataFrame:
    """(rid, span_start, span_end): the windows at the listed positions, merged where they overlap or touch."""

    def run(batches):
        for b in batches:
            values, offsets = flat(b["positions"])
            rows = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] - values[:-1] > width) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(values)) - 1 if len(first) else first
            rid = b["rid"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows[first]]), pa.array(values[first].astype(np.int32)), pa.array((values[last] + width).astype(np.int32))], ["rid", "span_start", "span_end"])

    lists_ = positions.groupBy("rid").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return lists_.mapInArrow(run, "rid long, span_start int, span_end int")


def shared_spans(records: DataFrame, width: int = 100) -> DataFrame:
    """(rid, span_start, span_end) for records (rid LONG unique, text): each maximal run of characters that lie
    in a stretch of ``width`` characters found verbatim in another record; span_end is the position after the last.

    Defined cases: NULL and texts shorter than ``width`` have no spans; a stretch repeated only within its own record isn't
    shared; equal texts share all of themselves; an empty table gives no rows; long texts are hashed whole.
    Windows count as equal if their 128-bit hashes are."""
    records = records.select("rid", "text").where(F.length("text") >= width)
    pairs = anchors(records, width)
    hot = pairs.join(in_several(pairs, "anchor"), "anchor", "left_semi")
    found = windows(records, hot, width)
    shared = found.join(in_several(found, "w1", "w2"), ["w1", "w2"], "left_semi")
    return merged(shared, width)


def shared_part(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(rid, n_spans, shared_chars, share): how much of each record that has a span is found elsewhere."""
    sums = spans.groupBy("rid").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    return sums.join(records.select("rid", F.length("text").alias("n")), "rid").select("rid", "n_spans", "shared_chars", (F.col("shared_chars") / F.col("n")).alias("share"))
