"""Ranking, pairing, merging, sampling, sources and streams on small fixtures."""

import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import merging, paired, ranking, similarity
from tallyframe.plans import datasets, extended
from tallyframe.sources import files, verdicts
from tallyframe.streaming import incremental


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 20.0), ("a", 30.0)], "g string, v double")
    assert sorted(r.r for r in df.select(ranking.average_rank(["g"], "v").alias("r")).collect()) == [1, 2.5, 2.5, 4]


@pytest.mark.parametrize("rows,want", [([(1, 0), (2, 1)], 1), ([(2, 0), (1, 1)], 0), ([(1, 0), (1, 1)], 0.5), ([(1, 1), (2, 1)], None)])
def test_auc(spark, rows, want):
    df = spark.createDataFrame([("g", float(s), bool(p)) for s, p in rows], "g string, s double, p boolean")
    assert ranking.rank_auc(df, ["g"], "s", F.col("p")).first().auc == want


LADDER = [("gold", 0.9, 7), ("terse", 0.7, 6), ("missing", 0.7, 3), ("wrong", 0.5, 2), ("numeric", 0.6, 2), ("verbose", 0.85, 1), ("off", 0.1, 0)]


def test_ladder(spark):
    df = spark.createDataFrame([("u", n, s, lv) for n, s, lv in LADDER], "u string, n string, s double, lv int")
    r = ranking.ordered_pairs(df, ["u"], "lv", "s").first()
    assert (r.credit, r.n_pairs, r.n_ties, r.accuracy) == (15.5, 20, 1, 0.775)
    assert ranking.rank_auc(df, ["u"], "s", F.col("lv") >= 3).first().auc == pytest.approx(0.8333333)


def test_kappa(spark):
    cases = {(2, 2, 2, 2): 0.0, (3, 1, 1, 3): 0.5, (4, 0, 0, 4): 1.0, (0, 4, 4, 0): -1.0, (8, 0, 0, 0): None, (4, 4, 0, 0): 0.0}
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "a double, b double, c double, d double")
    got = {(r.a, r.b, r.c, r.d): r.k for r in df.withColumn("k", ranking.kappa(*map(F.col, "abcd"))).collect()}
    assert got == {tuple(map(float, k)): v for k, v in cases.items()}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", None), ("f", 0.04), ("f", 0.03)] + [("g", i / 100) for i in range(1, 6)], "f string, p double")
    got = sorted((r.f, r.p or -1, r.q) for r in ranking.bh_adjusted(df, ["f"], "p").collect())
    assert got[:4] == [("f", -1, None), ("f", 0.01, 0.03), ("f", 0.03, 0.04), ("f", 0.04, 0.04)]
    assert all(q == pytest.approx(0.05) for _, _, q in got[4:])


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 10), ("b", 7), ("c", 4)], "g string, size int")
    assert {r.g: r.quota for r in ranking.largest_remainder(df, "g", "size", 8).collect()} == {"a": 4, "b": 3, "c": 1}


def test_paired_table_keeps_complete_finite_keys_and_first_rows(spark):
    rows = [("q1", "b", 0.1, 1), ("q1", "a", 0.4, 1), ("q2", "b", 0.2, 1), ("q2", "a", 0.5, 1), ("q2", "a", 0.9, 2), ("q3", "b", 0.3, 1), ("q4", "b", float("nan"), 1), ("q4", "a", 0.9, 1)]
    df = spark.createDataFrame(rows, "k string, g string, v double, o int")
    t = paired.paired_table(df, "k", "g", "v", ["a", "b"], ["o"])
    assert {r.k: (r.a, r.b) for r in t.collect()} == {"q1": (0.4, 0.1), "q2": (0.5, 0.2)}
    assert paired.dropped_keys(df, t, "k").count() == 2
    assert sorted(round(r.d, 9) for r in paired.differences(t, [("a", "b")]).collect()) == [0.3, 0.3]


def test_sign_flip_and_intervals():
    assert paired.sign_flip(np.array([0.3, 0.1, -0.05, 0.2])) == (0.25, True)
    assert paired.sign_flip(np.arange(1, 6)) == (2 / 32, True)
    assert paired.sign_flip(np.array([])) == (None, False)
    d = np.array([0.3, -0.1, 0.25, 0.4, -0.2, 0.05])
    want = np.mean([abs(np.dot(s, d)) >= abs(d.sum()) - 1e-12 for s in itertools.product([1, -1], repeat=6)])
    assert paired.sign_flip(d)[0] == want
    p, exact = paired.sign_flip(np.full(40, 0.2))
    assert not exact and p < 0.001
    assert paired.mean_interval([]) == (0, None, None, None, None)
    assert paired.mean_interval([2.0]) == (1, 2.0, None, None, None)
    n, mean, se, low, high = paired.mean_interval(np.arange(100.0))
    assert (n, mean) == (100, 49.5) and low < 49.5 < high and se == pytest.approx(2.89, abs=0.2)


def test_wilcoxon(spark):
    df = spark.createDataFrame([("c", float(i)) for i in range(1, 11)] + [("c", 0.0)], "c string, d double")
    r = paired.signed_ranks(df, ["c"]).first()
    assert (r.n, r.n_zero, r.w_plus, r.w_minus) == (10, 1, 55, 0) and paired.wilcoxon_p(r.z) < 0.01


def test_group_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    df = spark.createDataFrame([("g", f"c{i % 40}", float(a), float(b), bool(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, c string, x double, y double, s boolean")
    slope = paired.logistic_slopes(df, ["g"], "x", "y").first()
    assert slope.slope == pytest.approx(1.5, abs=0.4) and slope.se > 0
    r = paired.clustered_correlation(df, ["g"], "c", "x", "y", iters=200).first()
    assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.ci_low < r.r < r.ci_high
    gap = paired.two_sample_gap(df, ["g"], "s", "x", iters=200).first()
    assert gap.gap == pytest.approx(x[y == 1].mean() - x[y == 0].mean()) and gap.ci_low < gap.gap < gap.ci_high


def test_cosine_with_idf_of_the_group(spark):
    df = spark.createDataFrame([("r", 1, "energy conserved before"), ("r", 2, "energy conserved after"), ("r", 3, "units joule")], "g string, id int, t string")
    pairs = similarity.cosine_pairs(similarity.tfidf_vectors(df, "id", "t", ["g"]), "id", ["g"], 0.0).collect()
    assert [(p.a, p.b) for p in pairs] == [(1, 2)] and pairs[0].s == pytest.approx(0.5363499141)


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.query, r["rank"]): r.id for r in similarity.nearest_vectors(df, df.where("id % 10 = 0"), "id", "v", 3, block=4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = u @ u[q]
        s[q] = -9
        assert [got[(q, k + 1)] for k in range(3)] == np.argsort(-s)[:3].tolist()


def test_nearest_sets_equal_brute_force(spark):
    """Most pairs share only words that nearly every row has; block and batch borders fall inside the rows."""
    rng = random.Random(4)
    frequent, rare = [f"f{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    rows = [(f"u{i:04d}", "ab"[i % 2], rng.sample(frequent, 5) + rng.sample(rare, 3)) for i in range(1500)] + [("none", "a", []), ("null", None, ["f1"])]
    df = spark.createDataFrame(rows, "uid string, domain string, ts array<string>").repartition(1)
    got = similarity.nearest_sets(df, F.expr("uid in ('none', 'null') or uid like '%50'"), "uid", "domain", "ts", 3, block=7)
    want = []
    for a, da, ta in rows:
        if a in ("none", "null") or a.endswith("50"):
            s = {b: len(set(ta) & set(tb)) / len(set(ta) | set(tb)) for b, db, tb in rows if db == da and da and b != a and set(ta) & set(tb)}
            want += [(a, b, r, round(s[b], 9)) for r, b in enumerate(sorted(s, key=lambda b: (-round(s[b], 9), b))[:3], 1)]
    assert sorted((x.query, x.id, x.rank, round(x.s, 9)) for x in got.collect()) == sorted(want) and len(want) == 45


def test_similar_questions_without_a_rare_word_in_common(spark, tmp_path):
    rows = [(i, f"u{i:03d}", "d", "train", f"energy mass charge only{i}" if i in (50, 51) else f"energy mass word{i} other{i}", "a") for i in range(1, 200)]
    spark.createDataFrame(rows, "ex_id long, uid string, domain string, split string, question string, reference_answer string").write.parquet(f"{tmp_path}/examples.parquet")
    got = {(r.uid, r["rank"]): (r.neighbour, r.similarity) for r in datasets.similar_questions(spark, str(tmp_path)).collect()}
    assert got["u100", 1] == ("u001", 0.333333) and got["u050", 2] == ("u001", 0.333333) and len(got) == 9


def shuffled_mb(spark):
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() / 1e6


def asked_tables(spark, path, questions, criteria):
    """examples of (uid, question) and criteria of (criterion_id, uid, body) as parquet files."""
    ex = [(i, u, "d", "train", q, "a") for i, (u, q) in enumerate(questions)]
    spark.createDataFrame(ex, "ex_id long, uid string, domain string, split string, question string, reference_answer string").write.parquet(f"{path}/examples.parquet")
    spark.createDataFrame(criteria, "criterion_id long, uid string, body string").write.parquet(f"{path}/criteria.parquet")
    return str(path)


def test_rank_of_own_question(spark, tmp_path):
    """Question b has no word of content: its criterion still ranks it below all that share a word. Questions of equal score don't count as better."""
    asked = [("a", "energy mass"), ("b", "of 7"), ("c", "energy charge field"), ("c2", "mass energy"), ("d", "lens"), (None, "energy")]
    d = asked_tables(spark, tmp_path, asked, [(50, "a", "energy"), (100, "b", "energy mass mass"), (150, "c", "energy field lens"), (200, "d", "unknown"), (250, "z", "energy"), (51, "a", "mass"), (300, "a", None)])
    got = {r.criterion_id: r.rank_of_own for r in extended.attribution_rank(spark, d).collect()}
    assert got == {50: 1, 100: 4, 150: 1}


def test_rank_of_own_question_in_blocks_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(rng.sample(words, rng.randint(0, 6)),) for _ in range(300)]
    asked = [(i, rng.choices(words, k=rng.randint(0, 5)), rng.choice([0.0, 0.5, 1.0, 2 / 3**0.5])) for i in range(60)]
    got = similarity.scored_above(spark.createDataFrame(rows, "ts array<string>").repartition(3), "ts", spark.createDataFrame(asked, "id long, ts array<string>, own double"), "id", "ts", "own", size=40, block=7)
    score = lambda bag, ts: sum(w in ts for w in bag) / len(ts) ** 0.5 if ts else 0
    want = {i: sum(round(score(bag, ts), 9) > round(own, 9) for (ts,) in rows) for i, bag, own in asked if any(score(bag, ts) for (ts,) in rows)}
    assert {r.id: r.above for r in got.collect()} == want and len(want) > 40


def test_rank_of_own_question_shuffles_no_pairs(spark, tmp_path):
    """Every criterion shares a word with every question: 800,000 pairs of 2,000 questions and 400 criteria."""
    d = asked_tables(spark, tmp_path, [(f"u{i}", f"energy mass field word{i}") for i in range(2000)], [(i, f"u{i % 2000}", f"energy mass only{i}") for i in range(20_000)])
    before = shuffled_mb(spark)
    assert {r.rank_of_own for r in extended.attribution_rank(spark, d).collect()} == {1} and shuffled_mb(spark) - before < 2


def test_nearest_documents_equal_brute_force(spark):
    """Words of every frequency, equal texts, rows without a word, NULL groups and ids out of order, in blocks smaller than a task's rows."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 7)) for _ in range(150)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(texts)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g string, ts array<string>").repartition(3)
    got = similarity.nearest_documents(df, F.expr("id % 5 = 0"), "id", "g", F.col("ts"), size=50, block=7)
    n = {w: sum(w in ts for _, _, ts in rows) for w in words}
    vectors = []
    for i, g, ts in rows:
        x = {w: (1 + np.log(ts.count(w))) * (np.log((1 + len(rows)) / (1 + n[w])) + 1) for w in set(ts)}
        vectors.append((i, g, {w: v / np.sqrt(sum(y * y for y in x.values())) for w, v in x.items()}))
    want = []
    for i, g, x in vectors:
        s = {j: sum(v * y[w] for w, v in x.items() if w in y) for j, h, y in vectors if g and h and g != h}
        if i % 5 == 0 and max(s.values(), default=0) > 0:
            best = min(s, key=lambda j: (-round(s[j], 9), j))
            want.append((i, best, round(s[best], 9)))
    assert sorted((r.query, r.id, round(r.s, 9)) for r in got.collect()) == sorted(want) and 40 < len(want) < 80


def test_nearest_of_other_questions_shuffles_no_pairs(spark, tmp_path):
    """Every criterion shares a word with every other: 840,000 pairs of 120 asked and 7,000 criteria."""
    d = asked_tables(spark, tmp_path, [("u", "energy")], [(i, f"u{i % 7}", f"energy mass only{i // 2}") for i in range(7000)])
    before = shuffled_mb(spark)
    got = {r.criterion_id: r.other for r in extended.nearest_other_question(spark, d).collect()}
    assert got == {i: i + 1 for i in range(0, 7000, 50)}
    assert shuffled_mb(spark) - before < 0.2


def test_merging(spark):
    old = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "y", 3)], "uid string, source string, n int")
    new = spark.createDataFrame([("a", "y", 9), (None, "y", 8)], "uid string, source string, n int")
    assert {tuple(r) for r in merging.upsert(old, new, ["uid", "source"]).collect()} == {("a", "x", 1), ("a", "y", 9), (None, "y", 8)}
    assert [tuple(r) for r in merging.last_wins(old, ["source"], [F.col("n")]).where("source = 'y'").collect()] == [(None, "y", 3)]
    first = merging.first_source_wins([new, old], ["source"])
    assert {(r.source, r.n) for r in first.collect()} == {("y", 9), ("y", 8), ("x", 1)}
    assert merging.conflicts(old, ["source"], F.col("n")).first().source == "y"


def test_samples_are_repeatable_and_complete(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = {r.id for r in merging.stratified_sample(df, "g", "id", 60, seed=1).collect()}
    assert len(a) == 60 and a == {r.id for r in merging.stratified_sample(df.repartition(7), "g", "id", 60, seed=1).collect()}
    assert merging.sample_per_group(df, ["g"], "id", 5).count() == 15
    partners = {r.id: r.partner for r in merging.shift_partner(df, "g", "id").collect()}
    assert len(partners) == 500 and all(k != v and k % 3 == v % 3 for k, v in partners.items()) and len(set(partners.values())) == 500


def test_files(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "uid string, rubric_source string, n int")
    files.replace_sources(df, p)
    files.replace_sources(spark.createDataFrame([("b", "y", 7)], df.schema), p)
    assert {(r.uid, r.rubric_source) for r in spark.read.parquet(p).collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(ValueError):
        files.write_checked(df.limit(1), str(tmp_path / "u"), 2)
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"uid": "a", "error": null}\nbroken\n{"uid": "b", "error": "x"}\n')
    log = files.read_json_lines(spark, str(lines), "uid string, error string")
    assert {r.uid for r in log.collect() if r.uid} == {"a", "b"}
    assert files.read_json_lines(spark, str(tmp_path / "missing"), "uid string").count() == 0
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    assert {r.uid for r in files.to_do(work, log).collect()} == {"b", "c"}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "id int").count() == 2
    files.write_csv(work, str(tmp_path / "csv"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "csv"))
    both = files.union_families({"m": df, "k": work})
    assert both.count() == 5 and set(both.columns) == {"uid", "rubric_source", "n", "family"}


def test_verdict_replay_and_judge(spark):
    requests = spark.createDataFrame([("k1", "t"), ("k2", "u")], "key string, text string")
    cache = spark.createDataFrame([("k1", True), ("k1", True)], "key string, literally_true boolean")

    def judge(frames):
        for f in frames:
            yield f[["key"]].assign(literally_true=False)

    assert [tuple(r) for r in verdicts.judged(requests, cache).collect()] == [("k1", True, True)]
    assert {tuple(r) for r in verdicts.judged(requests, cache, judge).collect()} == {("k1", True, True), ("k2", False, False)}
    replies = spark.createDataFrame([("u", '[{"id":1,"true":true},{"id":1,"true":false}]')], "uid string, reply string")
    items = spark.createDataFrame([("u", 1), ("u", 2)], "uid string, item int")
    assert {tuple(r) for r in verdicts.parsed_verdicts(replies, items).collect()} == {("u", 1, True, False), ("u", 2, False, True)}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([("a", 1, "2024-01-01 00:00:00"), ("b", 2, "2024-01-01 00:10:00")], [("a", 3, "2024-01-01 00:20:00")], [("c", 4, "2024-01-01 03:00:00"), ("c", 5, "2024-01-01 09:00:00")])):
        spark.createDataFrame(rows, "k string, n int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    stream = incremental.stream_of(spark, src, schema, 10)
    assert sorted(r.k for r in run(incremental.first_by_key(stream, ["k"], "ts", "12 hours"), "once", "append").collect()) == ["a", "b", "c"]
    counts = run(incremental.windowed_counts(stream, "ts", "k", "n"), "windows", "complete")
    assert counts.agg(F.sum("n"), F.sum("total")).first() == (5, 15)
    incremental.upsert_batches(incremental.stream_of(spark, src, schema), str(tmp_path / "table"), ["k"], str(tmp_path / "cp")).start().awaitTermination(60)
    latest = sorted(os.listdir(tmp_path / "table"))[-1]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "table" / latest)).collect()) == ["a", "b", "c"]
    broken = incremental.breaker(stream.withColumn("bad", F.col("n") > 2), "k", "bad", limit=2)
    assert {r.k: r.open for r in run(broken, "breaker", "update").collect()} == {"a": False, "b": False, "c": True}


def test_running_totals_and_positions_equal_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.randrange(40)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = {r.id: (r._before, r._total) for r in ranking.running_totals(df, ["g"], [F.col("v"), F.col("id")], F.col("v")).collect()}
    for g in ("hot", "a", None):
        own, total = sorted((v, i) for h, i, v in rows if h == g), 0
        for v, i in own:
            assert got[i] == (total, sum(x for x, _ in own))
            total += v
    p = merging.positions(df.where("g is not null"), ["g"], "id", 3).collect()
    assert sorted(r._i for r in p if r.g == "hot") == list(range(sum(r[0] == "hot" for r in rows)))
    assert ranking.running_totals(df.limit(0), ["g"], [F.col("id")], F.lit(1)).count() == 0


def test_correlations_with_ties(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    y = (x + y) // 2
    df = spark.createDataFrame([("g", int(a), int(b)) for a, b in zip(x, y)] + [("g", None, 1), ("h", 1, 1), ("c", 1, 2), ("c", 1, 3), ("c", 1, 4)], "g string, x int, y int")
    got = {r.g: r for r in ranking.correlations(df, ["g"], "x", "y").collect()}
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["g"].n == 300 and got["g"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["g"].spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert got["h"].pearson is None and got["c"].spearman is None


def test_draws_and_units(spark):
    d = paired.draws(200, 300, 1) % 300
    assert abs(np.bincount(d.ravel(), minlength=300) / d.size * 300 - 1).max() < 0.4 and len(np.unique(d[:50], axis=0)) == 50
    df = spark.createDataFrame([("big", i, float(i)) for i in range(5000)] + [("small", i, float(i)) for i in range(30)], "g string, id int, v double")
    sizes = {r.g: r["count"] for r in paired.units(df, ["g"], ["id"], [F.sum("v").alias("s")]).groupBy("g").count().collect()}
    assert sizes["small"] == 30 and sizes["big"] <= paired.UNITS
    got = {r.g: r for r in paired.mean_intervals(df, ["g"], "v", ["id"]).collect()}
    assert got["big"].mean == 2499.5 and got["big"].se == pytest.approx(np.arange(5000).std() / 5000**0.5, rel=0.15) and got["big"].ci_low < 2499.5 < got["big"].ci_high
    t = paired.paired_tests(df.select("g", "id", (F.col("v") - 14.5).alias("d")), ["g"], ["id"], 2000).where("g = 'small'").first()
    assert t.mean == 0 and t.p > 0.9


def test_complete_cells_beyond_a_hundred_groups(spark, tmp_path):
    from tallyframe.plans import evaluation

    rows = [(1000 * u + t, u, f"type{t:03d}", float(t), None) for u in range(3) for t in range(130) if (u, t) != (1, 129)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.n_groups for r in evaluation.complete_cases(spark, str(tmp_path)).collect()}
    assert got == {0: 130, 2: 130}


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    from tallyframe import session

    path = f"{tmp_path}/criteria.parquet"
    spark.range(1000).withColumn("t", F.repeat(F.col("id").cast("string"), 50)).coalesce(1).write.parquet(path)
    assert session.table(spark, str(tmp_path), "criteria").rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "DEALT_BYTES", 1)
    dealt = session.table(spark, str(tmp_path), "criteria")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt.count() == 1000
    monkeypatch.setattr(session, "SPLIT_BYTES", 1)
    assert session.table(spark, str(tmp_path), "criteria").rdd.getNumPartitions() == 1
    assert session.pieces(spark, 0) == 4 and session.pieces(spark, 64e7) == 11
