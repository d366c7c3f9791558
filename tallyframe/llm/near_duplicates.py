"""Problem 1: near-duplicate records, by min-max hashing.

Each of K hash functions is evaluated once per word and gives two signature values, its minimum and its
maximum over the record, so that 2K values cost K evaluations. Six values make a band, and 28 bands a signature, whatever the number of
rows; records that share a band are candidates. At similarity 0.75 a pair shares none of its bands with a chance of about
0.6 %, at 0.8 of 0.05 %, at 0.9 of none in a billion. Each band row carries the record's size and a parity bitmap, which rule out most
false candidates (and no true one) inside the join; exact Jaccard similarity decides about the others.

Hot buckets: the first pass over the rows counts, besides the keys of equal sets, the band keys that repeat. Each window of WINDOW rows
passes on only keys that repeat in it, so what is shuffled follows the repeats, and a bucket's count falls short by one per window at most.
Buckets of more than ``bucket`` rows (the SPLIT_KEYS largest, a bounded list) are split by the record's *prefix*: with words in one global
order, rare first, two records of Jaccard similarity t share one of their first n - ceil(t n) + 1 words. The split loses no pair, so
neither the counts nor the bounds of the lists have a part in the result. The order uses the counts of words in more than ``frequent`` of
a window's rows, at most average length / ``frequent`` of them.
Equal sets are collapsed first. Pairs are joined in the JVM, where AQE can split a skewed key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import as_long, chunks, distinct_per_row, flat, mix, rows_of, set_keys, word_hashes
from tallyframe.llm.graph import connected_components
from tallyframe.llm.sets import class_words, compatible, digest, expanded, members, picked_texts, set_classes, verified, word_sets
from tallyframe.session import cut, pieces

BANDS, PER_BAND = 28, 6
#: Bytes of a band row in a shuffle: key, id, digest.
ROW_BYTES = 24
SEED = 7
WINDOW = 100_000
BUCKET = 2000
SPLIT_KEYS = 200_000
FREQUENT = 0.0005
EXPAND_LIMIT = 1000
#: Kinds of rows the first pass gives.
ROW, KEY, WORD = 0, 1, 2


def odd_numbers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, BANDS * PER_BAND // 2, dtype=np.uint64) | np.uint64(1)


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(BANDS, rows) keys of sets of at least one word: minimum and maximum of each hash function go into a band."""
    keys = np.zeros((BANDS, len(offsets) - 1), np.uint64)
    for k, odd in enumerate(odd_numbers()):
        h, b = mix(values * odd, k), 2 * k // PER_BAND
        for extreme in (np.minimum, np.maximum):
            keys[b] = mix(keys[b] ^ extreme.reduceat(h, offsets[:-1]), b + 1)
    return keys


def first_pass(rows: DataFrame, id_col: str, text_cols: list[str], frequent: float, window: int) -> DataFrame:
    """(kind, a, b, c, d): ROW id, k1, k2, exact of every row with words; KEY band key, count; WORD word, count."""

    def counted(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        return values[counts >= least], counts[counts >= least]

    def batch(kind: int, a: pa.Array, b, c=None, d=None) -> pa.RecordBatch:
        none = lambda x: pa.nulls(len(a), pa.int64()) if x is None else x
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, pa.array(b) if isinstance(b, np.ndarray) else b, none(c), none(d)], ["kind", "a", "b", "c", "d"])

    def flushed(keys: list[np.ndarray], words: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        if keys:
            values, counts = counted(keys, 2)
            yield batch(KEY, as_long(values), counts)
            values, counts = counted(words, max(3, int(frequent * n)))
            yield batch(WORD, as_long(values), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, seen, n = [], [], np.zeros(0, np.uint64), 0
        for b in chunks(batches, "text"):
            values, offsets = distinct_per_row(*word_hashes(b["text"].to_pylist()))
            filled = np.flatnonzero(np.diff(offsets))
            if not len(filled):
                continue
            k1, k2 = (k[filled] for k in set_keys(values, offsets))
            part = b.take(pa.array(filled))
            yield batch(ROW, part["id"], as_long(k1), as_long(k2), part["exact"])
            # Each set counts once in a window.
            at = np.unique(k1, return_index=True)[1]
            at = at[~np.isin(k1[at], seen)]
            if len(at):
                own, ends = rows_of(values, offsets, filled[at])
                keys.append(band_keys(own, ends).ravel())
                words.append(own)
                seen, n = np.concatenate([seen, k1[at]]), n + len(at)
            if n >= window:
                yield from flushed(keys, words, n)
                keys, words, seen, n = [], [], np.zeros(0, np.uint64), 0
        yield from flushed(keys, words, n)

    return picked_texts(rows, id_col, text_cols).mapInArrow(run, "kind int, a long, b long, c long, d long")


def counts_above(passed: DataFrame, kind: int, least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys or words (sorted) of a count above ``least``, the ``most`` largest, and their counts."""
    sums = passed.where(F.col("kind") == kind).groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") > least)
    found = sums.orderBy(F.desc("n"), "a").limit(most).collect()
    values = np.array([r.a for r in found], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r.n for r in found], np.int64)[order]


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted array ``known``, and where."""
    if not len(known):
        return np.zeros(values.shape, bool), np.zeros(values.shape, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def band_rows(values: np.ndarray, offsets: np.ndarray, hot: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band; those of hot buckets split by prefix words. Every row has at least one value."""
    n, keys = np.diff(offsets), band_keys(values, offsets)
    is_hot = among(keys, hot)[0]
    band, row = np.nonzero(~is_hot)
    plain = (row, keys[band, row])
    band, row = np.nonzero(is_hot)
    if not len(row):
        return plain
    # The global order of words: those that aren't frequent by hash, then the frequent ones by count.
    known, at = among(values, common)
    ordered = values[np.lexsort((values, np.where(known, counts[at], 0) if len(common) else at, np.repeat(np.arange(len(n)), n)))]
    take = (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]
    which = np.repeat(np.arange(len(row)), take)
    token = ordered[offsets[row][which] + np.arange(len(which)) - np.repeat(np.cumsum(take) - take, take)]
    split = mix(keys[band, row][which] ^ mix(token, 7), 99)
    return np.concatenate([plain[0], row[which]]), np.concatenate([plain[1], split])


def candidate_pairs(vectors: DataFrame, hot: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float, n: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives (of n rows) that share a band and whose sizes and bitmaps allow ``threshold``. The band rows get
    as many partitions as their bytes need, if that is more than the session's setting."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((hot, common, counts))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                values, offsets = flat(part["words"])
                values = values.view(np.uint64)
                row, key = band_rows(values, offsets, *shared.value, threshold)
                rep, sig = part["rep"].to_numpy(zero_copy_only=False), digest(values, offsets)
                yield pa.RecordBatch.from_arrays([as_long(key), pa.array(rep[row]), as_long(sig[row])], ["key", "id", "sig"])

    keyed = vectors.select("rep", "words").mapInArrow(run, "key long, id long, sig long")
    parts = pieces(spark, n * BANDS * ROW_BYTES)
    # Buckets are bounded by then, so no key is hot; where the setting suffices, adaptive execution is left to it.
    keyed = keyed.repartition(parts, "key") if parts > pieces(spark, 0) else keyed
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & compatible("x.sig", "y.sig", threshold))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicate_classes(rows: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.75, bucket: int = BUCKET, frequent: float = FREQUENT, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of representatives of different word sets, and the (rep, n, id, exact) of rows of equal ones. The rows are
    read twice: for keys and counts, and for the words of the representatives."""
    passed = cut(first_pass(rows, id_col, text_cols, frequent, window))
    keys = passed.where(F.col("kind") == ROW).select(F.col("a").alias("id"), F.col("b").alias("k1"), F.col("c").alias("k2"), F.col("d").alias("exact"))
    hot = counts_above(passed, KEY, bucket, SPLIT_KEYS)[0]
    n = keys.count()
    common, counts = counts_above(passed, WORD, frequent * n, SPLIT_KEYS) if len(hot) else (hot, hot.view(np.int64))
    classes = set_classes(keys)
    vectors = class_words(word_sets(rows, id_col, text_cols), classes)
    pairs = verified(candidate_pairs(vectors, hot, common, counts, threshold, n), vectors, threshold)
    return pairs, members(keys, classes)


def near_duplicate_pairs(rows: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.75, bucket: int = BUCKET, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose distinct words in all text columns together have Jaccard
    similarity of at least ``threshold``.

    Defined cases: NULL text counts as empty; a row without words, or with a NULL id, is in no pair; equal
    rows are pairs like any others (as a star beyond ``expand_limit`` equal ones); ids are taken to be unique;
    an empty table gives an empty result; other columns, whatever their names, are ignored; texts of any
    length are used whole."""
    pairs, copies = near_duplicate_classes(rows, id_col, text_cols, threshold, bucket)
    return expanded(pairs, cut(copies), expand_limit)


def near_duplicate_groups(rows: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.75, bucket: int = BUCKET) -> DataFrame:
    """(id, group_id, group_size, n_links): rows that are alike, directly or through others, as groups named by
    their smallest id; n_links counts the different texts a row's text is alike to. A row like no other is not
    returned. Equal rows join their group through their representative, so no pair of copies is made."""
    pairs, copies = near_duplicate_classes(rows, id_col, text_cols, threshold, bucket)
    pairs = cut(pairs)
    copies = cut(copies)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "rep")
    nodes = connected_components(pairs.select("a", "b")).withColumnRenamed("id", "rep")
    all_rows = copies.select("rep", "id").unionByName(pairs.select(F.col("a").alias("rep"), F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("rep"), F.col("b").alias("id"))).distinct()
    out = all_rows.join(nodes, "rep", "left").join(links, "rep", "left")
    out = out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return out.join(sizes, "group_id").select("id", "group_id", "group_size", "n_links")
