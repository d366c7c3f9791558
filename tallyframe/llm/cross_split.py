"""Problem 5: same or near-same records across splits, by a weighted cosine join over inverted lists.

A record is the vector of its distinct words. Rare words weigh most, but squared weights stay within
[1, SPREAD], so that Jaccard similarity t implies a cosine of at least T = 1 / (1 + SPREAD (1 - t) / (2 t)): the
cosine join loses no pair, and an exact Jaccard test may follow.

Words have one global order, frequent ones first. A vector's leading words are left out of the inverted lists as
long as they can't reach T by themselves, by the smaller of two bounds: their norm (residual norm), or the
sum of their weights times the largest weight each has in any vector. Two vectors of cosine T have their rarest
common word in both index parts. For a match at some word, the dot product is at most the product of both norms up to
that word if it is the rarest common one; matches below T are dropped inside the join, as are those whose sizes or
parity bitmaps rule out the Jaccard similarity asked for. Survivors get exact dot products. Weights need only the frequent words' counts, a list bounded by average length / FREQUENT.
Splits are joined with each other, never with themselves; equal sets are collapsed on each side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import as_long, flat, mix
from tallyframe.llm.sets import can_be_similar, class_words, frequent_words, members, parity_bitmaps, set_classes, shortened, word_sets
from tallyframe.session import cut

FREQUENT = 0.001
EXPAND_LIMIT = 1000
SPREAD = 1.5


def cosine_bound(jaccard: float, spread: float = SPREAD) -> float:
    """The least cosine that two sets of this Jaccard similarity can have under squared weights in [1, spread]."""
    return 1 / (1 + spread * (1 - jaccard) / (2 * jaccard))


class Weights:
    """Squared weights and the global order of words, from the counts of frequent ones."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, rows: int, spread: float = SPREAD):
        self.common, self.counts = common, counts
        least = max(FREQUENT * rows, 1.0)
        scale = np.log(max(rows / least, 2.0))
        self.squared = np.clip(spread - (spread - 1) * np.log(np.maximum(counts, 1) / least) / scale, 1.0, spread)
        self.spread = spread

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared weight and count (0 if rare) of each word hash."""
        if not len(self.common):
            return np.full(len(values), self.spread), np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.common, values), len(self.common) - 1)
        known = self.common[at] == values
        return np.where(known, self.squared[at], self.spread), np.where(known, self.counts[at], 0)


def inverted_lists(vectors: DataFrame, weights, threshold: float, least_norm: float) -> DataFrame:
    """(term, id, size, b1, b2, upto): for each indexed word of each vector, the norm of the vector up to that word."""

    def run(batches):
        w = weights.value
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                values, offsets = flat(part["words"])
                values, n = values.view(np.uint64), np.diff(offsets)
                squared, counts = w.of(values)
                rows = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, -counts, rows))
                values, squared = values[order], squared[order]
                total = np.zeros(len(squared) + 1)
                np.cumsum(squared, out=total[1:])
                upto = total[1:] - np.repeat(total[offsets[:-1]], n)
                norm2 = np.repeat(total[offsets[1:]] - total[offsets[:-1]], n)
                residual = np.sqrt(upto / norm2)
                largest = upto / (np.sqrt(norm2) * least_norm)
                index = np.minimum(residual, largest) >= threshold - 1e-9
                ids = part["rep"].to_numpy(zero_copy_only=False)
                bits = [as_long(b[rows[index]]) for b in parity_bitmaps(values, offsets)]
                yield pa.RecordBatch.from_arrays([as_long(values[index]), pa.array(ids[rows[index]]), pa.array(n[rows[index]].astype(np.int32)), *bits, pa.array(residual[index])], ["term", "id", "size", "b1", "b2", "upto"])

    return vectors.select("rep", "words").mapInArrow(run, "term long, id long, size int, b1 long, b2 long, upto double")


def exact_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, weights) -> DataFrame:
    """(a, b, cosine, jaccard) of candidate pairs, from whole vectors."""
    both = pairs.join(left.select(F.col("rep").alias("a"), F.col("words").alias("words_a")), "a")
    both = both.join(right.select(F.col("rep").alias("b"), F.col("words").alias("words_b")), "b").select("a", "b", "words_a", "words_b")

    def run(batches):
        w = weights.value
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                (va, oa), (vb, ob) = flat(part["words_a"]), flat(part["words_b"])
                va, vb, k = va.view(np.uint64), vb.view(np.uint64), part.num_rows
                ra, rb = np.repeat(np.arange(k), np.diff(oa)), np.repeat(np.arange(k), np.diff(ob))
                salt = mix(np.arange(k, dtype=np.uint64), 5)
                shared = np.isin(va ^ salt[ra], vb ^ salt[rb])
                sa, sb = w.of(va)[0], w.of(vb)[0]
                dot = np.bincount(ra[shared], sa[shared], k)
                cosine = dot / np.sqrt(np.bincount(ra, sa, k) * np.bincount(rb, sb, k))
                common = np.bincount(ra[shared], minlength=k)
                jaccard = common / (np.diff(oa) + np.diff(ob) - common)
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(cosine), pa.array(jaccard)], ["a", "b", "cosine", "jaccard"])

    return both.mapInArrow(run, "a long, b long, cosine double, jaccard double")


def cross_split_classes(rows: DataFrame, id_col: str, text_col: str, first_side: Column, threshold: float = 0.75) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(a, b, cosine, jaccard) of the representatives of alike sets, a of the first side and b of the other, and of both sides the
    word sets of the rows and the classes of equal sets."""
    # Every later step reads the words from here, so that the rows are read and cut into words once.
    sets = cut(word_sets(rows, id_col, [text_col], first_side))
    total = sets.count()
    common, counts = frequent_words(sets, FREQUENT, total)
    weights = rows.sparkSession.sparkContext.broadcast(Weights(common, counts, total))
    bound = cosine_bound(threshold)
    sides = [sets.where(F.col("side") == flag) for flag in (True, False)]
    classes = [set_classes(s) for s in sides]
    # Every squared weight is 1 at least, so a norm is at least the root of the smallest number of words.
    vectors = [class_words(s, c) for s, c in zip(sides, classes)]
    least = [s.agg(F.min(F.size("words")).alias("n")).first().n or 1 for s in sides]
    lists = [inverted_lists(c, weights, bound, float(np.sqrt(n))) for c, n in zip(vectors, reversed(least))]
    x, y = lists[0].alias("x"), lists[1].alias("y")
    near = F.col("x.upto") * F.col("y.upto") >= bound - 1e-9
    pairs = x.join(y, (F.col("x.term") == F.col("y.term")) & near & can_be_similar("x", "y", threshold)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    good = exact_similarity(pairs, *vectors, weights).where((F.col("cosine") >= bound - 1e-9) & (F.col("jaccard") >= threshold))
    return good, sides, classes


def cross_split_pairs(rows: DataFrame, id_col: str, text_col: str, first_side: Column, threshold: float = 0.75, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """(id_1, id_2, cosine, jaccard): rows of which id_1 fulfils ``first_side`` and id_2 doesn't and whose distinct words
    have Jaccard similarity of at least ``threshold``.

    Defined cases: a NULL text or a text without words is in no pair; a NULL side counts as not fulfilled; NULL
    ids are left out; equal texts pair like any others, but of more than ``expand_limit`` exactly equal texts of a side all but the
    first pair with one representative of each set of words of the other side only (no link between different texts is lost); an empty table, or only one side, gives no rows; other
    columns are ignored; texts are used whole."""
    good, sides, classes = cross_split_classes(rows, id_col, text_col, first_side, threshold)
    split = [shortened(members(s, c), expand_limit) for s, c in zip(sides, classes)]
    out = good
    for side, (small, big, _) in zip("ab", split):
        kept = small.unionByName(big.select("rep", "id")).select(F.col("rep").alias(side), F.col("id").alias(f"id_{side}"))
        out = out.join(kept, side, "left").withColumn(f"id_{side}", F.coalesce(f"id_{side}", side))
    out = out.select(F.col("id_a").alias("id_1"), F.col("id_b").alias("id_2"), "cosine", "jaccard")
    for side, (_, _, copies) in zip("ab", split):
        many = copies.select(F.col("rep").alias(side), "id")
        ids = ["id", "b"] if side == "a" else ["a", "id"]
        out = out.unionByName(good.join(many, side).select(F.col(ids[0]).alias("id_1"), F.col(ids[1]).alias("id_2"), "cosine", "jaccard"))
    return out


def overlap_counts(rows: DataFrame, id_col: str, text_col: str, first_side: Column, split_col: str, source_col: str, threshold: float = 0.75) -> DataFrame:
    """(split, source, n_pairs, n_records): overlaps of records outside the first side, by split and source. Every pair of rows counts,
    from the sizes of their classes, so none is expanded however many equal texts there are."""
    good, (_, held), (first, second) = cross_split_classes(rows, id_col, text_col, first_side, threshold)
    matched = good.join(first.select(F.col("rep").alias("a"), "n"), "a").groupBy("b").agg(F.sum("n").alias("n"))
    info = rows.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    shares = held.select("id", "k1", "k2").join(info, "id").groupBy("k1", "k2", "split", "source").agg(F.count(F.lit(1)).alias("m"))
    found = shares.join(second.select("k1", "k2", F.col("rep").alias("b")), ["k1", "k2"]).join(matched, "b")
    return found.groupBy("split", "source").agg(F.sum(F.col("m") * F.col("n")).alias("n_pairs"), F.sum("m").alias("n_records"))
