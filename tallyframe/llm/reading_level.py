"""Problem 10: reading level of each document, by regularised ordinal regression.

Features are computed for every document in one vectorised pass: lexical diversity, word rarity, connectives, a
clause-depth proxy and lengths of words, sentences and text. Rarity is the logarithm of how many words of the corpus there are to one
of this word. Words are counted exactly; those of a share of SHARE or more, at most 1 / SHARE of them whatever the corpus, are kept
with their counts, and rarer ones all count as of that share, so a word's rarity doesn't drift as the corpus grows. The model shares one weight vector between the thresholds of neighbouring grades
(all-threshold logistic loss, convex, L2); its strength is chosen by cross-validation. It is fitted on at most
``fit_rows`` ratings, taken in hash order; every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.textarrays import chunks, classify, code_points, mix, powers, prefix_hash, runs, word_hashes
from tallyframe.session import cut

SHARE = 2e-6
FIT_ROWS = 5000
STRENGTHS = (0.01, 0.1, 1.0, 10.0, 100.0)
FEATURES = ["letters_per_word", "words_per_sentence", "diversity", "rarity", "rare_share", "connectives", "clause_depth", "long_share", "log_words"]
#: Connectives and subordinators of the languages at hand.
CONNECTIVES = (
    "although because consequently despite furthermore hence however if moreover nevertheless once provided since so "
    "therefore though thus unless until when whenever whereas whereby whereupon which while who "
    "aber damit dass deshalb obwohl wenn weil während cependant donc lorsque parce puisque que quand "
    "aunque cuando porque pues sino assim embora enquanto pois quando если когда который поэтому потому хотя что"
).split()
LINE_BREAKS = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029], np.uint32)
SCHEMA = "doc_id long, words long, sentences long, " + ", ".join(f"{f} double" for f in FEATURES) + ", score double, level int"


def _words(texts: list[str | None]):
    """Letter runs of the texts: code points, text starts, begins, ends, offsets and hashes."""
    points, starts = code_points(texts)
    if not len(points):
        none = np.zeros(0, np.int64)
        return points, starts, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    begins, ends, offsets = runs(classify(points, "alpha"), starts)
    p = prefix_hash(mix(classify(points, "lower").astype(np.uint64)))
    return points, starts, begins, ends, offsets, mix((p[ends] - p[begins]) * powers(len(points), inverse=True)[begins])


class WordShares:
    """Rarity of word hashes from the counts (sorted by hash) of the frequent ones and the number of all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        self.words, self.total = words, max(total, 1)
        self.rarity = np.log(self.total / np.maximum(counts, 1))
        self.most = -np.log(max(SHARE, 1 / self.total))

    def of(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashed), self.most)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        return np.where(self.words[at] == hashed, np.minimum(self.rarity[at], self.most), self.most)


def word_shares(documents: DataFrame, text_col: str) -> WordShares:
    """Counts of all words, combined within tasks before they are shuffled."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["w", "n"])

    def run(batches):
        parts, size = [], 0
        for b in chunks(batches, "text"):
            parts.append(_words(b["text"].to_pylist())[5])
            size += len(parts[-1])
            if size > 1 << 20:
                yield counted(parts)
                parts, size = [], 0
        if size:
            yield counted(parts)

    counts = cut(documents.select(F.col(text_col).alias("text")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    kept = counts.where(F.col("n") >= SHARE * total).toPandas().sort_values("w")
    words = kept["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return WordShares(words[order], kept["n"].to_numpy(np.int64)[order], total)


def features(texts: list[str | None], shares: WordShares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sentences, feature matrix) of texts. A word is a maximal run of letters; a sentence ends at a line break or
    at . ! ? followed by white space and has a word. A text without words has zeros throughout."""
    points, starts, begins, ends, offsets, hashed = _words(texts)
    n = len(texts)
    words = np.diff(offsets)
    rows = np.repeat(np.arange(n), words)
    if not len(rows):
        return words, np.zeros(n, np.int64), np.zeros((n, len(FEATURES)))
    space = classify(points, "space")
    stop = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
    followed = np.zeros(len(points), bool)
    followed[:-1] = space[1:]
    followed[starts[1:][np.diff(starts) > 0] - 1] = False
    piece = np.searchsorted(np.flatnonzero((stop & followed) | np.isin(points, LINE_BREAKS)), begins)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])
    total = lambda x: np.bincount(rows, x, n)
    sentences = total(fresh).astype(np.int64)
    length = ends - begins
    per = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    order = np.lexsort((hashed, rows))
    first = np.ones(len(rows), bool)
    first[1:] = (hashed[order][1:] != hashed[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][first], minlength=n)
    rarity = shares.of(hashed)
    joins = np.isin(hashed, word_hashes(CONNECTIVES)[0])
    commas = np.bincount(np.searchsorted(starts, np.flatnonzero(np.isin(points, [ord(c) for c in ",;:("])), side="right") - 1, minlength=n)
    matrix = np.column_stack([
        per(total(length), words), per(words, sentences), per(distinct, np.sqrt(2 * words)), per(total(rarity), words), per(total(rarity > 9), words),
        per(total(joins), words), per(commas + total(joins), sentences), per(total(length >= 8), words), np.log1p(words),
    ])
    return words, sentences, matrix


class OrdinalModel:
    """P(grade > k) = logistic(x w - t_k) for each threshold k, with w shared by all."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strength: float):
        self.grades = np.unique(y)
        self.mean, self.sd = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, k = (x - self.mean) / self.sd, len(self.grades) - 1
        over = (y[:, None] > self.grades[None, :-1]).astype(float)
        w, t = np.zeros(z.shape[1]), -np.log((over.mean(0) + 1e-6) / (1 - over.mean(0) + 1e-6))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w[:, None] - t, -30, 30)))
            r, v = p - over, np.maximum(p * (1 - p), 1e-9)
            grad = np.concatenate([z.T @ r.sum(1) + strength * w, -r.sum(0)])
            cross = -z.T @ v
            hess = np.block([[(z * v.sum(1)[:, None]).T @ z + strength * np.eye(len(w)), cross], [cross.T, np.diag(v.sum(0)) + 1e-6 * np.eye(k)]])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            w, t = w - step[: len(w)], t - step[len(w) :]
            if np.abs(step).max() < 1e-8:
                break
        self.w, self.t = w, np.sort(t)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and most fitting grade."""
        p = 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.sd) @ self.w[:, None] - self.t, -30, 30)))
        gaps = np.diff(self.grades).astype(float)
        return self.grades[0] + p @ gaps, self.grades[(p >= 0.5).sum(1)]


def folds(ids: np.ndarray) -> np.ndarray:
    """One of five folds for each document, so that several ratings of one stay together."""
    return (mix(np.asarray(ids, np.int64).view(np.uint64), 31) % np.uint64(5)).astype(int)


def fitted(x: np.ndarray, y: np.ndarray, ids: np.ndarray | None = None) -> OrdinalModel | None:
    """The model with the strength of least absolute error in five-fold cross-validation, in folds of documents (of rows without their ids);
    None if fewer than two grades."""
    if len(np.unique(y)) < 2:
        return None
    fold = np.arange(len(y)) % 5 if ids is None else folds(ids)

    def error(strength: float) -> float:
        total = 0.0
        for f in range(5):
            train, held = fold != f, fold == f
            if held.any() and len(np.unique(y[train])) > 1:
                total += np.abs(OrdinalModel(x[train], y[train], strength).predict(x[held])[0] - y[held]).sum()
        return total

    return OrdinalModel(x, y, min(STRENGTHS, key=error))


def labelled_features(documents: DataFrame, doc_id: str, text_col: str, labels: DataFrame, table, fit_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, grades and documents of at most ``fit_rows`` ratings, in the order of a hash of the rating; NULL grades are left out."""
    rated = labels.where("doc_id is not null and grade is not null").select(F.col("doc_id").alias("id"), "grade", F.xxhash64("doc_id", "rater", "rated_at").alias("h"))
    sample = F.broadcast(rated.orderBy("h", "id", "grade").limit(fit_rows))
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("h", "grade", "id", "text")

    def run(batches):
        for b in chunks(batches, "text"):
            matrix = features(b["text"].to_pylist(), table.value)[2]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * len(FEATURES)), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([b["h"], b["grade"].cast(pa.int32()), b["id"].cast(pa.int64()), values], ["h", "grade", "id", "x"])

    rows = sorted(texts.mapInArrow(run, "h long, grade int, id long, x array<double>").collect())
    return np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.grade for r in rows], np.int64), np.array([r.id for r in rows], np.int64)


def held_out_agreement(documents: DataFrame, doc_id: str, text_col: str, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(n_ratings, exact, within_one): how the levels of documents agree with their grades when each fifth of the documents is scored by a model of the
    others. No rows without grades of two kinds."""
    spark = documents.sparkSession
    x, y, ids = labelled_features(documents, doc_id, text_col, labels, spark.sparkContext.broadcast(word_shares(documents, text_col)), fit_rows)
    gaps = []
    for f in range(5):
        train, held = folds(ids) != f, folds(ids) == f
        model = fitted(x[train], y[train], ids[train]) if held.any() else None
        if model:
            gaps.append(np.abs(model.predict(x[held])[1] - y[held]))
    gaps = np.concatenate(gaps) if gaps else np.zeros(0)
    rows = [(len(gaps), float((gaps == 0).mean()), float((gaps <= 1).mean()))] if len(gaps) else []
    return spark.createDataFrame(rows, "n_ratings long, exact double, within_one double")


def reading_levels(documents: DataFrame, doc_id: str, text_col: str, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, words, sentences, features ..., score, level) of every document: score is the expected grade, level the
    most fitting one.

    Defined cases: NULL text counts as empty, and a text without words has zero features and NULL score and level; without
    labels of two different grades every score and level is NULL; NULL grades are ignored, several ratings of a document all
    count; rows with a NULL id are left out; repeated rows are scored each; an empty table gives no rows; texts are read whole."""
    context = documents.sparkSession.sparkContext
    table = context.broadcast(word_shares(documents, text_col))
    model = context.broadcast(fitted(*labelled_features(documents, doc_id, text_col, labels, table, fit_rows)))

    def run(batches):
        for b in chunks(batches, "text"):
            words, sentences, matrix = features(b["text"].to_pylist(), table.value)
            none = words == 0
            score, level = model.value.predict(matrix) if model.value else (np.zeros(len(words)), np.zeros(len(words)))
            hide = none | (model.value is None)
            arrays = [b["id"], pa.array(words), pa.array(sentences), *[pa.array(matrix[:, i]) for i in range(len(FEATURES))]]
            arrays += [pa.array(score, mask=hide), pa.array(level.astype(np.int32), mask=hide)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "words", "sentences", *FEATURES, "score", "level"])

    picked = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, SCHEMA)
