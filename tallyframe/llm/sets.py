"""What the set-similarity operators share: rows as sets of word hashes, and exact overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import as_long, chunks, distinct_per_row, flat, lists, mix, set_keys, word_hashes

#: Parts of a large set's join with itself.
SALTS = 256


def picked_texts(rows: DataFrame, id_col: str, text_cols: list[str], side: Column | None = None) -> DataFrame:
    """(id, text, exact, side) of rows with an id: the text columns together, a hash of them as they are, and a yes-or-no mark."""
    exact = F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    mark = F.coalesce(side, F.lit(False)) if side is not None else F.lit(False)
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.concat_ws(" ", *[F.col(c) for c in text_cols]).alias("text"), exact.alias("exact"), mark.alias("side"))
    return picked.where(F.col("id").isNotNull())


def word_sets(rows: DataFrame, id_col: str, text_cols: list[str], side: Column | None = None) -> DataFrame:
    """(id, k1, k2, exact, side, words): the distinct words of the text columns together, as sorted 64-bit hashes,
    a 128-bit key of that set, and a hash of the texts as they are. Rows without a word have no set and don't come out."""

    def run(batches):
        for b in chunks(batches, "text"):
            values, offsets = distinct_per_row(*word_hashes(b["text"].to_pylist()))
            k1, k2 = set_keys(values, offsets)
            out = pa.RecordBatch.from_arrays([b["id"], as_long(k1), as_long(k2), b["exact"], b["side"], lists(as_long(values), offsets)], ["id", "k1", "k2", "exact", "side", "words"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return picked_texts(rows, id_col, text_cols, side).mapInArrow(run, "id long, k1 long, k2 long, exact long, side boolean, words array<long>")


def frequent_words(sets: DataFrame, share: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words that more than ``share`` times n sets have. No more than (average number of
    words) / share of them can exist, whatever the number of rows."""

    def run(batches):
        for b in batches:
            words, counts = np.unique(flat(b["words"])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["w", "c"])

    least = max(1, int(share * n))
    found = sets.select("words").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") > least).collect()
    words = np.array([r.w for r in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r.c for r in found], np.int64)[order]


def parity_bitmaps(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per row: each word flips one. Two sets differ in at least as many words as their bitmaps in bits."""
    place = mix(values, 21) % np.uint64(128)

    def half(inside: np.ndarray) -> np.ndarray:
        flips = np.zeros(len(values) + 1, np.uint64)
        np.bitwise_xor.accumulate(np.where(inside, np.uint64(1) << (place % np.uint64(64)), np.uint64(0)), out=flips[1:])
        return flips[offsets[1:]] ^ flips[offsets[:-1]]

    return half(place < 64), half(place >= 64)


#: Bits of a digest that hold the size; larger sets count as the largest.
SIZE_BITS = 12
LARGEST = (1 << SIZE_BITS) - 1


def digest(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits per row: a parity bitmap of its words above its size."""
    flips = np.zeros(len(values) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (mix(values, 21) % np.uint64(64 - SIZE_BITS) + np.uint64(SIZE_BITS)), out=flips[1:])
    return (flips[offsets[1:]] ^ flips[offsets[:-1]]) | np.minimum(np.diff(offsets), LARGEST).astype(np.uint64)


def compatible(x: str, y: str, threshold: float) -> Column:
    """A condition on the digests of two rows that every pair of Jaccard similarity ``threshold`` fulfils."""
    x, y = F.col(x), F.col(y)
    m, n = x.bitwiseAND(LARGEST), y.bitwiseAND(LARGEST)
    apart = F.bit_count(F.shiftrightunsigned(x.bitwiseXOR(y), SIZE_BITS))
    fits = F.least(m, n) >= F.ceil(threshold * F.greatest(m, n) - 1e-9)
    return (F.greatest(m, n) == LARGEST) | (fits & (apart <= (1 - threshold) / (1 + threshold) * (m + n) + 1e-9))


def bitmaps(vectors: DataFrame) -> DataFrame:
    """(rep, size, b1, b2) of (rep, words); it reads the exchange that other uses of the words read."""

    def run(batches):
        for b in batches:
            values, offsets = flat(b["words"])
            b1, b2 = parity_bitmaps(values.view(np.uint64), offsets)
            yield pa.RecordBatch.from_arrays([b["rep"], pa.array(np.diff(offsets).astype(np.int32)), as_long(b1), as_long(b2)], ["rep", "size", "b1", "b2"])

    return vectors.select("rep", "words").mapInArrow(run, "rep long, size int, b1 long, b2 long")


def can_be_similar(x: str, y: str, threshold: float) -> Column:
    """A condition on (size, b1, b2) of two rows that every pair of Jaccard similarity ``threshold`` fulfils: sizes allow it, and
    bitmaps differ in no more bits than the sets may differ in words."""
    of = lambda side, name: F.col(f"{side}.{name}")
    fits = F.least(of(x, "size"), of(y, "size")) >= F.ceil(threshold * F.greatest(of(x, "size"), of(y, "size")) - 1e-9)
    apart = sum((F.bit_count(of(x, b).bitwiseXOR(of(y, b))) for b in ("b1", "b2")), F.lit(0))
    return fits & (apart <= (1 - threshold) / (1 + threshold) * (of(x, "size") + of(y, "size")) + 1e-9)


def set_classes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: rep (its smallest id), n (rows that have it). The aggregate is combined before the
    shuffle, so a set that fills a third of all rows is still a few rows per task; the words themselves aren't shuffled."""
    return sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def class_words(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, words) of every distinct set: the rows of the representatives, partitioned by rep. Every later join on rep
    reads this one exchange."""
    return sets.select(F.col("id").alias("rep"), "words").join(classes.select("rep"), "rep", "left_semi")


def members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, n, id, exact) for the rows of every set that more than one row has."""
    many = classes.where("n > 1").select("k1", "k2", "rep", "n")
    return sets.select("id", "k1", "k2", "exact").join(many, ["k1", "k2"]).select("rep", "n", "id", "exact")


def shortened(member_rows: DataFrame, expand_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rep, id) of the sets of at most ``expand_limit`` rows; of larger ones, (rep, n, id) of the rows that pair with all others, and
    (rep, first, id) of those left to a star: rows whose texts are equal to more than ``expand_limit`` rows, but for the first of them.
    Texts of the same words in another order or writing are different texts."""
    big = member_rows.where(F.col("n") > expand_limit)
    texts = big.groupBy("rep", "exact").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("equal"))
    both = big.join(texts, ["rep", "exact"])
    is_copy = (F.col("equal") > expand_limit) & (F.col("id") != F.col("first"))
    return member_rows.where(F.col("n") <= expand_limit).select("rep", "id"), both.where(~is_copy).select("rep", "n", "id"), both.where(is_copy).select("rep", "first", "id")


def jaccard(a: str = "words_a", b: str = "words_b"):
    """Exact Jaccard similarity of two array columns of distinct values."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs of class representatives that reach the threshold."""
    sets = vectors.select(F.col("rep").alias("a"), F.col("words").alias("words_a"))
    other = vectors.select(F.col("rep").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(sets, "a").join(other, "b").select("a", "b", jaccard().alias("similarity")).where(F.col("similarity") >= threshold)


def expanded(pairs: DataFrame, member_rows: DataFrame, expand_limit: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows behind the pairs of representatives and within a set.
    More than ``expand_limit`` rows of exactly the same texts are given as a star instead: each copy with the first of them,
    and the first alone in pairs with other texts; no link between different texts is lost."""
    small, big, copies = shortened(member_rows, expand_limit)
    kept = small.unionByName(big.select("rep", "id"))
    between = pairs.select("a", "b").join(kept.select(F.col("rep").alias("a"), F.col("id").alias("id_a")), "a", "left").join(kept.select(F.col("rep").alias("b"), F.col("id").alias("id_b")), "b", "left")
    between = between.select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    left = small.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    right = small.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    within = left.join(right, F.col("a") == F.col("b")).where("id_a < id_b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    # A large set is one hot key: its rows meet in up to SALTS parts.
    salts = F.least(F.lit(SALTS), F.ceil(F.col("n") / expand_limit))
    left = big.select(F.col("rep").alias("a"), F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), salts).alias("salt_a"))
    right = big.select(F.col("rep").alias("b"), F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt_b"))
    large = left.join(right, (F.col("a") == F.col("b")) & (F.col("salt_a") == F.col("salt_b"))).where("id_a < id_b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    star = copies.select(F.col("first").alias("x"), F.col("id").alias("y"))
    both = between.unionByName(within).unionByName(large).unionByName(star)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
