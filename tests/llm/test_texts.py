"""Spans, copies, n-grams, contamination, truncation, defects, reading level and packing on small fixtures."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import textarrays as X
from tallyframe.llm import canonical_copies, contamination, defects, ngram_counts, packing, queries, reading_level, shared_spans, truncation

WORD = re.compile(r"[^\W_]+")


def spans_by_brute_force(rows, width):
    seen = collections.defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - width + 1):
            seen[t[p : p + width]].add(i)
    out = set()
    for i, t in rows:
        covered = [False] * len(t or "")
        for p in range(len(t or "") - width + 1):
            if len(seen[t[p : p + width]]) > 1:
                covered[p : p + width] = [True] * width
        p = 0
        while p < len(covered):
            if covered[p]:
                e = p
                while e < len(covered) and covered[e]:
                    e += 1
                out.add((i, p, e))
                p = e
            else:
                p += 1
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdé \n\U0001f600"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = [make(40) for _ in range(4)]
    rows = [(i, make(rng.randrange(60)) + rng.choice(common)[: rng.randrange(10, 41)] + make(rng.randrange(60))) for i in range(1, 80)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "ab" * 40), (104, "x" * 50), (105, make(30_000) + common[0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "rid long, text string, pos int")
    got = {tuple(r) for r in shared_spans.shared_spans(df, 20).collect()}
    assert got == spans_by_brute_force(rows, 20)
    part = {r.rid: r.share for r in shared_spans.shared_part(df, shared_spans.shared_spans(df, 20)).collect()}
    assert part[102] == 1.0 and 104 not in part
    assert shared_spans.shared_spans(df.limit(0), 20).count() == 0


def test_sliding_minimum_and_rolling_hash():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 97).astype(np.uint64)
    for w in (1, 5, 97, 98):
        assert X.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
    a = np.array([5, 6, 7, 5, 6, 7, 5, 6, 8], np.uint64)
    h = X.rolling_hash(a, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4


def test_word_hashes_follow_words():
    texts = ["Äpfel, ÄPFEL_äpfel 12½ x​y", None, "", "naïvé \U0001d538b 漢字"]
    values, offsets = X.word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(values[:3].tolist())) == 1


def test_copies(spark):
    rows = [(5, "The Title", "Some text, here."), (2, " the  TITLE", "some-text here"), (9, "the title", "here some text"), (7, None, None), (8, "", "!"), (11, "Tïtle", "x"), (12, "TÏTLE", "X"), (None, "The Title", "Some text, here.")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "id long, title string, description string, k1 int, text string")
    assert {tuple(r) for r in canonical_copies.copies(df, "id", "title", "description").collect()} == {(2, 5), (7, 8), (11, 12)}
    assert canonical_copies.copies(df.limit(0), "id", "title", "description").count() == 0
    hot = spark.createDataFrame([(i, "a", "b") for i in range(500)], "id long, title string, description string")
    assert canonical_copies.copies(hot, "id", "title", "description").count() == 499


def test_copy_counts_of_both_tables(spark, tmp_path):
    spark.createDataFrame([(1, "A b", "c."), (2, "a B!", "C"), (3, "x", None)], "criterion_id long, title string, description string").write.parquet(f"{tmp_path}/criteria.parquet")
    payloads = ['{"title": "A b", "description": "c"}', '{"Description":"C!","TITLE":"a  b"}', '"alone"', "{broken", '{"description": "Alone", "weight": 2}', '{"title": "x"}']
    spark.createDataFrame(list(enumerate(payloads, 1)), "entry_id long, payload string").write.parquet(f"{tmp_path}/raw_entries.parquet")
    got = {(r.src, r.first_id): r.copies for r in queries.p7_copy_counts(spark, str(tmp_path)).collect()}
    assert got == {("criteria", 1): 2, ("criteria", 3): 1, ("raw_entries", 1): 2, ("raw_entries", 3): 2, ("raw_entries", 6): 1}


def test_parsed_entries(spark):
    good = [json.dumps({"Description": "d", "TITLE": "t"}), json.dumps("only"), '{"title": null, "description": 5}', "  {}  "]
    bad = ['{"title" = "t"}', "```json\n{}\n```", '{"title": "t",}', "", None, "[1]", "7", '{"a": 1};']
    df = spark.createDataFrame(list(enumerate(good + bad)), "entry_id long, payload string")
    got = {r.id: (r.title, r.description) for r in canonical_copies.parsed_entries(df).collect()}
    assert got == {0: ("t", "d"), 1: ("", "only"), 2: ("", "5"), 3: ("", "")}


@pytest.mark.parametrize("longest,shards", [(None, 1), (2, 5)])
def test_ngrams_equal_brute_force(spark, longest, shards):
    rng = random.Random(6)
    rows = [(f"u{rng.randrange(12)}", " ".join(rng.choice(["a", "b", "c", "ab", "9"]) for _ in range(rng.randrange(6)))) for _ in range(300)] + [(None, "a b"), ("u1", None), ("u1", "  !! ")]
    times, records = collections.Counter(), collections.defaultdict(set)
    for u, t in rows:
        w = (t or "").replace("!", " ").split()
        if u is None or not w:
            continue
        keys = [("ngram", tuple(w[i:j])) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if longest is None or j - i <= longest]
        if longest is None or len(w) + 1 <= longest:
            keys.append(("value", tuple(w)))
        for k in keys:
            times[k] += 1
            records[k].add(u)
    df = spark.createDataFrame([(*r, 3) for r in rows], "u string, t string, record int")
    got = {(r.kind, tuple(r.ngram.split())): (r.times, r.records) for r in ngram_counts.ngram_counts(df, ngram_counts.title_words(F.col("t")), F.col("u"), longest, shards).collect()}
    assert got == {k: (times[k], len(records[k])) for k in times}


def test_marks(spark):
    rows = [(f"u{i}", "Main Plan") for i in range(40)] + [("u1", "main-plan!"), ("u2", "Odd"), (None, "Odd")]
    df = spark.createDataFrame(rows, "uid string, title string")
    got = {(r.level, r.value): (r.times, r.records, r.mark) for r in ngram_counts.marked_values(df, "title", "uid").collect()}
    assert got[("title", "main plan")] == (41, 40, "common") and got[("term", "odd")] == (1, 1, "rare")
    assert ngram_counts.marked_values(df.limit(0), "title", "uid").count() == 0


def test_contained_passages_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(5, 40))), " ".join(rng.choices(pool, k=30))) for i in range(1, 30)] + [(40, None, ""), (41, "too short", None)]
    docs = []
    for i in range(1, 90):
        w = rng.choices(pool, k=rng.randrange(0, 400))
        if rng.random() < 0.6:
            source = rng.choice(items)[rng.choice([1, 2])] or ""
            s, n, at = source.split(), rng.randrange(8, 20), rng.randrange(len(w) + 1)
            p = rng.randrange(max(1, len(s) - n + 1))
            w[at:at] = [x.upper() for x in s[p : p + n]]
        docs.append((i, ", ".join(w)))
    docs += [(200, None), (201, ""), (202, docs[0][1])]

    def runs(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs for i, q, a in items if runs(t) & (runs(q) | runs(a))}
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item int")
    e = spark.createDataFrame([(*r, "x") for r in items], "item_id int, question string, reference_answer string, text string")
    found = lambda a, b: {(r.doc_id, r.item_id) for r in contamination.contained_passages(a, "doc_id", "text", b, "item_id", ["question", "reference_answer"]).collect()}
    assert len(want) > 15 and found(d, e) == want
    assert found(d.limit(0), e) == set() and found(d, e.limit(0)) == set()


def test_truncated_rows(spark):
    full = ["Done here.", "So it is 5 kJ.\n- a: 5 kJ\n- beam: 4.2 km", "Thus \\boxed{4}", "Final answer: 4.2 kJ", "Therefore (B)", "3.5 g", '"Quoted end."', "Fin.​ ", None, "", "n/a", "```\n```", "[withheld: X]"]
    cut = ["The ratio of a to", "It halves the sec", "Because of this (", "and the vap�", "Half of it is 3."[:-1]]
    rows = [(i, "s", t, None) for i, t in enumerate(full + cut)] + [(100, "s", "The end is ne", 50), (101, None, "The end is ne", 0), (None, "s", "The e", 1)]
    df = spark.createDataFrame(rows, "id long, src string, t string, n int")
    got = {r.id: r.evidence for r in truncation.truncated(df, "id", "src", "t", "n").collect()}
    assert set(got) == {*range(len(full), len(full) + len(cut)), 100, 101}
    assert got[100] == "transfer" and got[101] == "ending"
    assert truncation.truncated(df.limit(0), "id", "src", "t", "n").count() == 0


def test_only_the_spike_tells_a_cut_item_from_a_whole_one(spark):
    """Items at a field limit are cut although they look whole; without the histogram they wouldn't come out."""
    item = "Values so far:\n- speed: 12.3 m"
    rng = random.Random(2)
    rest = [("a", "x" * rng.randrange(20, 80) + ".") for _ in range(400)]
    filler = lambda n: "y" * (n - len(item) - 1) + "\n" + item
    rows = [(i, *r) for i, r in enumerate(rest + [("a", filler(100))] * 30 + [("a", filler(90)), ("b", filler(100))] + [("a", "z" * 99 + ".")] * 5)]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    got = {r.id: r.evidence for r in truncation.truncated(df, "id", "s", "t").collect()}
    assert got == {i: "limit" for i in range(400, 430)}


def test_spikes(spark):
    rng = random.Random(1)
    rows = [("a", "x" * min(rng.randrange(20, 140), 100)) for _ in range(600)] + [("b", "é" * rng.randrange(20, 120)) for _ in range(600)] + [("a", "y" * 130), (None, None)]
    df = spark.createDataFrame(rows, "s string, t string")
    assert {(r.source, r.length) for r in truncation.spikes(df, "s", "t").collect()} == {("a", 100)}


QUESTION = "Raising the pump by 3 kJ halves the outer vapor while most lens data look dense. Which rotor should be chosen now?"


@pytest.mark.parametrize(
    "answer,defect",
    [
        ("The lens of Kuro reaches its vapor because the pump is dense. Final answer: 3 kJ", None),
        ("n/a", "empty"),
        (None, "empty"),
        ("<think></think>", "empty"),
        ("I am sorry, but I can't help with Kuro here. Please ask a qualified expert.", "refusal"),
        ("I cannot rule out Kuro here, but the answer stands. The pump halves the vapor.", None),
        (QUESTION.upper(), "copies_question"),
        ("Question: " + QUESTION, "copies_question"),
        (QUESTION + "\n\nThe outer pump of Zaro is chosen since it reaches the dense lens first and the vapor is narrow there.", None),
        ("La mesure de Kuro montre une dose lente. Il ne faut pas confondre Zaro avec la charge.", "other_language"),
        ("The lens of Kuro reaches its vapor because the pump and the sec", "truncated"),
        ("3.5 kJ", None),
    ],
)
def test_votes_and_model(spark, defect_table, answer, defect):
    assert defect_table[answer] == defect


@pytest.fixture(scope="module")
def defect_table(spark):
    answers = [p.args[1][i][0] for p in test_votes_and_model.pytestmark for i in range(len(p.args[1]))]
    rows = [("s", 1000 * k + i, QUESTION, a, None, None) for i, a in enumerate(answers) for k in range(20 if i in (0, 8, 11, 5) else 2)]
    rows += [("s", None, QUESTION, "n/a", None, None), ("t", 1, None, "Fine answer text that ends.", None, None)]
    df = spark.createDataFrame(rows, "src string, rec_id long, question string, answer string, error string, recorded int")
    found = {(r.src, r.rec_id): r.defect for r in defects.defect_labels(df).where("rank = 1").collect()}
    assert ("t", 1) not in found and defects.defect_labels(df.limit(0)).count() == 0
    return {a: found.get(("s", i)) for i, a in enumerate(answers)}


def test_cutoffs_are_validated_on_all_rows(spark, monkeypatch):
    """Each row is planted and judged once, in its own fold, by a model of the other fold."""
    rows = [("s", i, QUESTION, f"The pump {i} reaches the dense lens first and the vapor is narrow there.", None, None) for i in range(8000)]
    df = spark.createDataFrame(rows, "src string, rec_id long, question string, answer string, error string, recorded int")
    seen, table = [], defects.posterior_table
    monkeypatch.setattr(defects, "posterior_table", lambda codes, labelled: seen.append((codes.count(), labelled.count(), codes.where("fold = 1").count(), labelled.where("fold = 1").count() if "fold" in labelled.columns else 0)) or table(codes, labelled))
    defects.defect_labels(df).count()
    (n, planted, half, planted_half), = seen
    assert n == planted == 8000 and 3000 < half == planted_half < 5000
    assert defects.defect_labels(df.limit(1)).count() == 0  # one of the halves is empty


def test_label_model_recovers_planted_behaviour():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.1
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.8])
    v = np.where(rng.random((len(y), 5)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    codes, inverse, counts = np.unique([defects.encode(x) for x in v.tolist()], return_inverse=True, return_counts=True)
    model = defects.LabelModel().fit(codes, counts.astype(float))
    p = model.posterior(codes)[inverse]
    assert abs(model.rate - 0.1) < 0.01 and ((p > 0.5) == y).mean() > 0.98
    assert 0.5 <= defects.cutoff(model.posterior(codes), counts.astype(float)) <= 1


def test_reading_level_features_and_order(spark):
    rng = random.Random(5)
    easy = ["We see the cat. It is big. The sun is red."] * 3
    hard = ["Considerations regarding microcirculation demonstrate heterogeneity; consequently spectroscopy exacerbates simultaneous approximation whereas determination, unless parameterization substantiates it, constitutes characterization."] * 3
    docs = [(i, " ".join(rng.sample(easy if i % 2 else hard, 2))) for i in range(60)] + [(100, None), (101, ""), (102, "1 2 3."), (103, "One two.Three four! Five\nsix? Seven")]
    labels = [(i, "r", 1 if i % 2 else 5, None) for i in range(40)] + [(1, "r", None, None), (None, "r", 3, None)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, words int")
    r = spark.createDataFrame(labels, "doc_id long, rater string, grade int, rated_at timestamp")
    got = {x.doc_id: x for x in reading_level.reading_levels(d, "doc_id", "text", r).collect()}
    assert all(got[i].level == (1 if i % 2 else 5) for i in range(40, 60))
    assert [got[i].level for i in (100, 101, 102)] == [None] * 3 and got[102].words == 0
    assert (got[103].words, got[103].sentences) == (7, 4) and abs(got[103].letters_per_word - 27 / 7) < 1e-12
    none = reading_level.reading_levels(d, "doc_id", "text", r.limit(0)).collect()
    assert len(none) == len(docs) and all(x.level is None for x in none)
    assert reading_level.reading_levels(d.limit(0), "doc_id", "text", r).count() == 0


def test_ordinal_model_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4))
    y = np.digitize(x @ [1.5, -1, 0, 0.5] + rng.normal(0, 0.3, 900), [-1.5, -0.5, 0.5, 1.5]) + 1
    score, level = reading_level.fitted(x[:600], y[:600]).predict(x[600:])
    assert (level == y[600:]).mean() > 0.7 and np.corrcoef(score, y[600:])[0, 1] > 0.9


def test_packing_is_complete_and_within_capacity(spark):
    rng = random.Random(7)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(60, 200), rng.randrange(1, 20)]) for _ in range(700)] + [0, 0, 100, 101, 200, 250, 1000]
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "doc_id long, tokens long, bin int")
    rows = packing.packed_sequences(df, capacity=100, block_items=150).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.sequence is not None:
            by_sequence[r.sequence].append(r)
    assert {d: sum(r.n_tokens for r in x) for d, x in by_doc.items()} == dict(enumerate(sizes))
    assert all(len(x) == max(1, -(-sizes[d] // 100)) for d, x in by_doc.items())
    assert all(r.sequence is None for d, x in by_doc.items() for r in x if sizes[d] == 0)
    for x in by_sequence.values():
        at = 0
        for r in sorted(x, key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens
        assert at <= 100
    assert len(by_sequence) <= 1.02 * sum(sizes) / 100 + 2
    assert packing.packed_sequences(df.limit(0), capacity=100).count() == 0


def triplets(k, capacity, seed=1):
    """Sizes that fit exactly three to a bin: each between a quarter and a half of it."""
    rng, out = random.Random(seed), []
    for _ in range(k):
        a = rng.randrange(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randrange(capacity * 25 // 100 + 1, (capacity - a) // 2 + 1)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_genetic_packing_where_best_fit_misses_the_bound(spark):
    sizes = triplets(100, 1000)
    alone = len(packing.best_fit([], list(range(300)), sizes, 1000))
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    packed = packing.packed_sequences(df, 1000)
    assert alone >= 112 and packed.select("sequence").distinct().count() <= 104
    assert packing.packing_faults(df, packed, 1000).first()[1:] == (0, 0, 0, 0)
    got = {r.method: (r.bins, r.least) for r in packing.packing_report(df, 1000).collect()}
    assert got["best-fit decreasing"] == (alone, 100) and got["grouping genetic"][0] <= 104
    none = df.limit(0)
    assert packing.packing_faults(none, packing.packed_sequences(none)).first() == (0, 0, 0, 0, 0)
    assert {(r.method, r.bins, r.free_share) for r in packing.packing_report(none).collect()} == {("best-fit decreasing", 0, None), ("grouping genetic", 0, None)}
    wrong = packed.withColumn("position", F.col("position") + 1).withColumn("sequence", F.lit("one"))
    assert packing.packing_faults(df, wrong, 1000).first()[2] == 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "a " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 5000 and set(got) == {1, 2, 3, 4}


#: Refusals that no pattern or planted list was written after, and answers that only look like some.
HELD_OUT_REFUSALS = [
    "That is something I am not in a position to answer.", "I have chosen not to respond to this.", "Sorry, no answer from me on this one.", "I'm sorry, but I cannot continue with this request.", "Unfortunately I am unable to assist with that.",
    "I apologize, I can't provide this information.", "I will not be answering that.", "As a language model, I am not able to comment on this.", "I'd prefer not to discuss the matter.", "My apologies, I must decline to answer.",
    "Désolé, je ne suis pas en mesure de vous aider.", "Leider darf ich diese Frage nicht beantworten.", "Lamento no poder contestar; no puedo dar esa información.", "Infelizmente não consigo responder a essa pergunta.", "К сожалению, я не могу помочь с этим вопросом.",
]
NO_REFUSALS = [
    "We cannot neglect the mass of the rotor here, so the ratio is not constant.", "It is unable to reach the lens because the pump is dense.", "The pump can't help the vapor, and sorry data would follow.", "Unfortunately, the value drops to a half of the first one.", "The rotor will not provide the heat that the lens needs.",
]


def test_refusals_worded_otherwise():
    """A share of unseen refusals is found by at least one of the first two functions, and no answer by both."""
    found = [defects.votes(QUESTION, t, None, None)[1] for t in HELD_OUT_REFUSALS]
    assert sum(1 in v[:2] for v in found) >= 12
    assert all(v[0] != 1 for v in (defects.votes(QUESTION, t, None, None)[1] for t in NO_REFUSALS))


def test_copied_runs_equal_brute_force():
    rng = random.Random(3)

    def slow(answer, question, least=5):
        text, total, longest, at = " " + " ".join(question) + " ", 0, 0, 0
        while at + least <= len(answer):
            end = at + least
            if f" {' '.join(answer[at:end])} " not in text:
                at += 1
                continue
            while end < len(answer) and f" {' '.join(answer[at : end + 1])} " in text:
                end += 1
            total, longest, at = total + end - at, max(longest, end - at), end
        return total, longest

    for _ in range(300):
        q, a = rng.choices("abc", k=rng.randrange(40)), rng.choices("abc", k=rng.randrange(60))
        assert defects.copied(a, q) == slow(a, q)
    assert defects.copied(["a"] * 20_000, ["a"] * 20_000) == (20_000, 20_000)


def test_records_with_folded_characters(spark):
    rows = [(3, "Ｆｕｌｌ width", "ﬁne", 1), (1, "full width", "fine", 2), (2, "FULL  Width!", "fine.", 3), (5, "cafe\u0301", None, 4), (6, "caf\u00e9", "", 5), (None, "x", "y", 6), (7, None, None, 7)]
    df = spark.createDataFrame(rows, "id long, title string, description string, first_id int")
    plain = {r.first_id: (r.title, r.description, r.copies) for r in canonical_copies.records(df, "id", "title", "description").collect()}
    assert plain[1] == ("full width", "fine", 2) and plain[3][2] == 1 and plain[7] == ("", "", 1) and len(plain) == 5
    folded = {r.first_id: r.copies for r in canonical_copies.records(df, "id", "title", "description", fold=True).collect()}
    assert folded == {1: 3, 5: 2, 7: 1}
    assert canonical_copies.collisions(canonical_copies.fingerprints(df, "id", "title", "description")).first() == (5, 0)
    same = canonical_copies.fingerprints(df, "id", "title", "description").withColumn("k1", F.lit(1)).withColumn("k2", F.lit(1))
    assert canonical_copies.collisions(same).first() == (5, 1) and canonical_copies.collisions(same.limit(0)).first() == (0, 0)


def test_rarity_does_not_drift_with_the_corpus(spark):
    """Ten times the same corpus: a word's rarity stays, and words below the least share count as of that share."""
    texts = [f"common common word{i % 7} only{i}" for i in range(200)]
    one = reading_level.word_shares(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    ten = reading_level.word_shares(spark.createDataFrame([(t,) for t in texts * 10], "text string"), "text")
    hashed = X.word_hashes(["common absent"])[0]
    # Words here are runs of letters: "common", "word", "only".
    assert one.total == 800 and ten.total == 8000 and one.of(hashed)[0] == ten.of(hashed)[0] == pytest.approx(np.log(2))
    assert one.of(hashed)[1] == pytest.approx(np.log(800)) and len(ten.words) == 3
    assert len(reading_level.word_shares(spark.createDataFrame([], "text string"), "text").words) == 0


def test_folds_keep_a_document_together():
    ids = np.repeat(np.arange(200), 3)
    f = reading_level.folds(ids)
    assert all(len(set(f[ids == i])) == 1 for i in range(200)) and set(f) == set(range(5))


def test_held_out_agreement(spark):
    rng = random.Random(5)
    easy, hard = "We see the cat. It is big. The sun is red.", "Considerations regarding microcirculation demonstrate heterogeneity; consequently spectroscopy exacerbates approximation whereas characterization substantiates it."
    d = spark.createDataFrame([(i, " ".join([easy if i % 2 else hard] * rng.randrange(1, 4))) for i in range(60)], "doc_id long, text string")
    r = spark.createDataFrame([(i, x, 1 if i % 2 else 5, None) for i in range(60) for x in "ab"], "doc_id long, rater string, grade int, rated_at timestamp")
    got = reading_level.held_out_agreement(d, "doc_id", "text", r).first()
    assert (got.n_ratings, got.exact) == (120, 1.0)
    assert reading_level.held_out_agreement(d, "doc_id", "text", r.limit(0)).count() == 0
