"""Near duplicates, cross-split pairs and components against brute force, with nulls, copies and odd tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import cross_split, near_duplicates
from tallyframe.llm.graph import connected_components
from tallyframe.llm.sets import bitmaps, can_be_similar, compatible, digest, word_sets

WORD = re.compile(r"[^\W_]+")


def words(*texts):
    return {w.lower() for t in texts for w in WORD.findall(t or "")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def varied(n, seed, size=24, vocabulary=400):
    """Texts in families: copies with words changed, dropped, reordered or restyled."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    out = []
    while len(out) < n:
        base = rng.sample(pool, size)
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            other = list(base)
            for _ in range(rng.randrange(6)):
                other[rng.randrange(len(other))] = rng.choice(pool)
            rng.shuffle(other)
            out.append((", " if rng.random() < 0.5 else "  ").join(w.upper() if rng.random() < 0.3 else w for w in other))
    return out[:n]


def brute(rows, threshold=0.75):
    sets = {i: words(*t) for i, *t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= threshold}


def test_pairs_equal_brute_force(spark):
    texts = varied(220, 3)
    rows = [(i, t[: len(t) // 3], t[len(t) // 3 :]) for i, t in enumerate(texts, 1)]
    rows += [(1001, None, None), (1002, "", "..."), (1003, rows[0][1], rows[0][2]), (1004, rows[0][1].upper(), rows[0][2]), (1005, "long " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, title string, description string, words string, k1 int")
    got = near_duplicates.near_duplicate_pairs(df, "id", ["title", "description"]).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    assert len(got) == len(pairs)
    want = brute(rows)
    assert pairs <= want and len(want - pairs) <= 0.01 * len(want)


def test_boilerplate_in_every_row_loses_nothing(spark):
    lead = " ".join(f"common{i}" for i in range(12)) + " "
    rows = [(i, lead + t) for i, t in enumerate(varied(150, 5, size=14), 1)]
    df = spark.createDataFrame(rows, "id long, t string")
    pairs = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", ["t"]).collect()}
    want = brute(rows)
    assert pairs <= want and len(want - pairs) <= max(1, 0.01 * len(want))


def test_many_equal_rows_become_a_star(spark):
    df = spark.createDataFrame([(i, "one two three four") for i in range(1, 31)] + [(99, "one two three four five")], "id long, t string")
    pairs = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", ["t"], expand_limit=10).collect()}
    assert pairs == {(1, i) for i in range(2, 31)} | {(1, 99)}
    groups = near_duplicates.near_duplicate_groups(df, "id", ["t"]).collect()
    assert len(groups) == 31 and {(r.group_id, r.group_size) for r in groups} == {(1, 31)}


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert near_duplicates.near_duplicate_pairs(df, "id", ["t"]).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "id long, t string")
    assert near_duplicates.near_duplicate_pairs(df, "id", ["t"]).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_split_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["train", "train", "val", "test"])) for i, t in enumerate(varied(200, seed + 10), 1)]
    rows += [(900, None, "val"), (901, "", "train"), (902, rows[0][1], "val"), (903, rows[0][1], "train"), (904, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, q string, split string, words int")
    got = {(min(r.id_1, r.id_2), max(r.id_1, r.id_2)) for r in cross_split.cross_split_pairs(df, "id", "q", F.col("split") == "train").collect()}
    side = {i: s == "train" for i, _, s in rows}
    assert got == {(a, b) for a, b in brute([r[:2] for r in rows]) if side[a] != side[b]}


def test_cross_split_one_side_only(spark):
    df = spark.createDataFrame([(1, "a b c", "train"), (2, "a b c", "train")], "id long, q string, split string")
    assert cross_split.cross_split_pairs(df, "id", "q", F.col("split") == "train").count() == 0
    assert cross_split.cross_split_pairs(df.limit(0), "id", "q", F.col("split") == "train").count() == 0


def test_cosine_bound_holds():
    rng = np.random.default_rng(0)
    bound = cross_split.cosine_bound(0.75)
    for _ in range(500):
        shared, x, y = 30, int(rng.integers(0, 11)), 0
        y = int(rng.integers(0, 11 - x))
        w = rng.uniform(1, cross_split.SPREAD, shared + x + y)
        s, a, b = w[:shared].sum(), w[shared : shared + x].sum(), w[shared + x :].sum()
        assert s / np.sqrt((s + a) * (s + b)) >= bound - 1e-12


def test_cross_split_of_many_equal_texts_is_a_star(spark):
    rows = [(i, "one two three four", "train") for i in range(1, 31)] + [(i, "one two three four", "val") for i in range(101, 104)] + [(200, "one two three four five", "val")]
    df = spark.createDataFrame(rows, "id long, q string, split string")
    got = {(r.id_1, r.id_2) for r in cross_split.cross_split_pairs(df, "id", "q", F.col("split") == "train", expand_limit=10).collect()}
    assert got == {(1, 101), (1, 102), (1, 103), (1, 200)} | {(i, 101) for i in range(2, 31)} | {(i, 200) for i in range(2, 31)}


def test_overlap_counts_of_many_equal_texts(spark):
    text = ["one two three four", "Four, three two one!"]
    rows = [(i, text[i % 2], "train", "x") for i in range(1200)] + [(2000 + i, text[i % 2], ["val", "test"][i % 3 == 0], ["s", None][i % 5 == 0]) for i in range(1100)]
    rows += [(5000, "one two three four five", "val", "s"), (5001, "one two three four five", "train", "s"), (5002, "other words", "val", "s")]
    df = spark.createDataFrame(rows, "id long, q string, split string, source string")
    got = {(r.split, r.source): (r.n_pairs, r.n_records) for r in cross_split.overlap_counts(df, "id", "q", F.col("split") == "train", "split", "source").collect()}
    held = [(s, o) for i, _, s, o in rows if 2000 <= i <= 5000]
    assert got == {k: (1201 * held.count(k), held.count(k)) for k in set(held)}


def reordered():
    """30 orders of one set of words, 15 exact copies of the first, and a neighbour."""
    orders = [" ".join(p) for p in itertools.islice(itertools.permutations("one two three four".split()), 24)] + ["one, two; three four" + "!" * k for k in range(6)]
    return [(i, t) for i, t in enumerate(orders + orders[:1] * 15, 1)] + [(99, "one two three four five")]


def test_only_exact_copies_become_a_star(spark):
    df = spark.createDataFrame(reordered(), "id long, t string")
    got = [(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", ["t"], expand_limit=10).collect()]
    kept = [*range(1, 31), 99]
    assert sorted(got) == sorted([*itertools.combinations(kept, 2)] + [(1, i) for i in range(31, 46)])


def test_cross_split_keeps_links_between_orders_of_words(spark):
    rows = [(i, t, "train") for i, t in reordered()] + [(1000 + i, t, "val") for i, t in reordered()]
    df = spark.createDataFrame(rows, "id long, q string, split string")
    got = [(r.id_1, r.id_2) for r in cross_split.cross_split_pairs(df, "id", "q", F.col("split") == "train", expand_limit=10).collect()]
    kept, copies = [*range(1, 31), 99], range(31, 46)
    want = [(a, 1000 + b) for a in kept for b in kept] + [p for i in copies for b in (1, 99) for p in ((i, 1000 + b), (b, 1000 + i))]
    assert sorted(got) == sorted(want)


def test_bitmaps_never_rule_out_a_similar_pair(spark):
    texts = varied(150, 21)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    rows = bitmaps(word_sets(df, "id", ["t"]).withColumnRenamed("id", "rep")).withColumnRenamed("rep", "id")
    kept = rows.alias("x").join(rows.alias("y"), F.col("x.id") < F.col("y.id")).where(can_be_similar("x", "y", 0.75)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()
    want = brute([(i, t) for i, t in enumerate(texts)])
    assert want <= {(r.a, r.b) for r in kept} and len(kept) < 0.1 * 150 * 149 / 2


def boilerplate(n, share, seed=9):
    """(id, text) of n unrelated texts, a share of them with 25 words in common out of 37; some pairs of true near copies."""
    rng = random.Random(seed)
    lead = [f"common{i}" for i in range(25)]
    rows = []
    for i in range(n):
        own = [f"u{rng.randrange(10**9)}" for _ in range(12)]
        rows.append((i, " ".join(lead + own if rng.random() < share else own + [f"v{rng.randrange(10**9)}" for _ in range(25)])))
        if i % 50 == 49:
            rows[-1] = (i, rows[-2][1] + " more")
    return rows


def test_hot_buckets_are_split_without_loss(spark):
    rows = boilerplate(1500, 0.3)
    df = spark.createDataFrame(rows, "id long, t string")
    want = brute(rows)
    for bucket in (5, 10_000):
        pairs, _ = near_duplicates.near_duplicate_classes(df, "id", ["t"], bucket=bucket, window=300)
        assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) >= 30


def test_many_partitions_of_band_rows_change_nothing(spark, monkeypatch):
    rows = boilerplate(400, 0.3, seed=3)
    monkeypatch.setattr(near_duplicates, "ROW_BYTES", 64_000)
    df = spark.createDataFrame(rows, "id long, t string")
    pairs, _ = near_duplicates.near_duplicate_classes(df, "id", ["t"], bucket=20, window=100)
    assert {(r.a, r.b) for r in pairs.collect()} == brute(rows)


def test_candidates_of_boilerplate_grow_with_the_rows(spark):
    """A bucket of 3 % of the rows that share 25 of 37 words (and "more" in the near copies): twice the rows, about twice the rows that meet in the join."""
    met = []
    for n in (6000, 12000):
        df = spark.createDataFrame(boilerplate(n, 0.03), "id long, t string")
        passed = near_duplicates.first_pass(df, "id", ["t"], near_duplicates.FREQUENT, 3000).cache()
        hot = near_duplicates.counts_above(passed, near_duplicates.KEY, 50, 10_000)[0]
        common, counts = near_duplicates.counts_above(passed, near_duplicates.WORD, 0.001 * n, 10_000)
        assert len(hot) and len(common) == 26
        keys = []
        for r in word_sets(df, "id", ["t"]).select("words").toLocalIterator():
            values = np.array(r.words, np.int64).view(np.uint64)
            keys.append(near_duplicates.band_rows(values, np.array([0, len(values)]), hot, common, counts, 0.75)[1])
        sizes = np.unique(np.concatenate(keys), return_counts=True)[1]
        met.append(int((sizes * (sizes - 1) // 2).sum()))
    assert met[1] < 3 * met[0]


def test_digests_never_rule_out_a_similar_pair(spark):
    texts = varied(150, 22) + [" ".join(f"x{i}" for i in range(k)) for k in (4090, 4100, 5000)]
    sets = word_sets(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"]).select("id", "words").collect()
    values = np.concatenate([np.array(r.words, np.int64).view(np.uint64) for r in sets])
    sig = digest(values, np.cumsum([0] + [len(r.words) for r in sets])).view(np.int64)
    df = spark.createDataFrame([(r.id, int(x)) for r, x in zip(sets, sig)], "id long, sig long")
    kept = df.alias("x").join(df.alias("y"), F.col("x.id") < F.col("y.id")).where(compatible("x.sig", "y.sig", 0.75)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()
    assert brute(list(enumerate(texts))) <= {(r.a, r.b) for r in kept} and len(kept) < 0.15 * 150 * 149 / 2
