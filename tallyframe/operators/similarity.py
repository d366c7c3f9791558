"""Vector-space operators on long (id, term, weight) tables: nothing is compared pairwise unless it shares a term."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.session import cut


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, group: list[str], min_df: int = 1, tokens: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """(id, group..., carry..., t, x): sublinear term frequency times smoothed inverse document frequency within the group, of unit length.
    Documents without a term of ``min_df`` documents have no rows; the columns to carry belong to the document. The length comes from a window over
    one document's terms."""
    tokens = tokens if tokens is not None else F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(L.VECTOR_TOKEN), F.lit(0))
    own = [id_col, *group, *(carry or [])]
    tf = docs.select(*own, F.explode(tokens).alias("t")).groupBy(*own, "t").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = docs.select(*group, F.explode(F.array_distinct(tokens)).alias("t")).groupBy(*group, "t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    nd = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("nd"))
    idf = df.join(nd, group).select(*group, "t", (F.log((1 + F.col("nd")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, [*group, "t"]).withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return raw.select(*own, "t", (F.col("x") / norm).alias("x"))


def with_pairs(words: Column) -> Column:
    """The words of an array and its pairs of neighbours."""
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs(words))


def vocabulary(docs: DataFrame, id_col: str, terms: Column, min_df: int = 1, most: int | None = None) -> DataFrame:
    """(term, tf, df, idf) of the terms in at least ``min_df`` documents, the ``most`` frequent of them, ties by term. Joined to ``tfidf_vectors`` it bounds
    their features."""
    n = docs.count()
    by_doc = docs.select(id_col, F.explode(terms).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("c"))
    f = by_doc.groupBy("term").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    return f if most is None else f.orderBy(F.desc("tf"), "term").limit(most)


def cosine_pairs(vectors: DataFrame, id_col: str, within: list[str], threshold: float) -> DataFrame:
    """(within..., a, b, s): pairs a < b of one group with cosine above the threshold."""
    a = vectors.select(*within, "t", F.col(id_col).alias("a"), F.col("x").alias("xa"))
    b = vectors.select(*within, "t", F.col(id_col).alias("b"), F.col("x").alias("xb"))
    pairs = a.join(b, [*within, "t"]).where("a < b").groupBy(*within, "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    return pairs.where(F.col("s") > threshold)


def packed_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(ids, matrix): up to ``size`` vectors of a task as one row, of unit length, in bytes."""

    def run(frames):
        ids, parts, n = [], [], 0
        for f in frames:
            for at in range(0, len(f), size):
                g = f.iloc[at : at + size]
                v = np.stack(g["v"].to_numpy()).astype(float)
                ids.append(g["id"].to_numpy(np.int64))
                parts.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
                n += len(g)
                if n >= size:
                    yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "matrix": [np.concatenate(parts).tobytes()]})
                    ids, parts, n = [], [], 0
        if n:
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "matrix": [np.concatenate(parts).tobytes()]})

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return picked.mapInPandas(run, "ids binary, matrix binary")


def nearest_vectors(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 1024) -> DataFrame:
    """(query, id, rank, s): the k nearest rows of each query by cosine, itself excluded, ties by id.

    Exact search of a stated query set: queries and rows are packed into blocks of fixed size, which are rows themselves; every block of queries meets
    every block of rows as one matrix product in one job, nothing comes to the driver, and only the k best of two blocks go on to the final ranking.
    NULL ids and vectors are left out; all vectors have one length."""
    many = cut(packed_vectors(rows, id_col, vector_col, 4096)).select(F.col("ids").alias("ids_r"), F.col("matrix").alias("m_r"))
    asked = cut(packed_vectors(queries, id_col, vector_col, block)).select(F.col("ids").alias("ids_q"), F.col("matrix").alias("m_q"))

    def run(frames):
        for f in frames:
            for ids_r, m_r, ids_q, m_q in zip(f["ids_r"], f["m_r"], f["ids_q"], f["m_q"]):
                ids, names = np.frombuffer(ids_r, np.int64), np.frombuffer(ids_q, np.int64)
                s = np.frombuffer(m_r).reshape(len(ids), -1) @ np.frombuffer(m_q).reshape(len(names), -1).T
                s[ids[:, None] == names[None, :]] = -np.inf
                # Ties by id even at the border: the key orders by rounded similarity, then id.
                place = np.argsort(np.argsort(ids))
                key = place[:, None] - np.rint(np.where(np.isfinite(s), s, -2) * 1e9).astype(np.int64) * len(ids)
                best = np.argpartition(key, k - 1, axis=0)[:k] if k < len(ids) else np.tile(np.arange(len(ids))[:, None], len(names))
                q = np.tile(np.arange(len(names)), (len(best), 1))
                out = pd.DataFrame({"query": names[q.ravel()], "id": ids[best.ravel()], "s": s[best.ravel(), q.ravel()]})
                yield out[np.isfinite(out["s"])]

    # Blocks, not rows: a stated query set against all rows.
    found = many.crossJoin(asked).mapInPandas(run, "query long, id long, s double")
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "id"))
    return found.withColumn("rank", r).where(F.col("rank") <= k).select("query", "id", "rank", "s")


def streamed(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def packed_rows(df: DataFrame, size: int) -> DataFrame:
    """(data): up to ``size`` rows of a task as one, in Arrow's stream format."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([streamed(b.slice(at, size))], pa.binary())], ["data"])

    return df.mapInArrow(run, "data binary")


def unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


class SetBlock:
    """A block of query sets (id, g, ts) as inverted lists: every distinct element has the queries that hold it."""

    def __init__(self, queries: pa.RecordBatch):
        self.ids, self.groups = queries["id"], queries["g"]
        self.names = np.array(self.ids.to_pylist(), object)
        self.sizes = pc.list_value_length(queries["ts"]).to_numpy(zero_copy_only=False)
        coded = queries["ts"].flatten().cast(pa.string()).dictionary_encode()
        owner, term = np.repeat(np.arange(queries.num_rows), self.sizes), coded.indices.to_numpy()
        self.terms, self.owners = coded.dictionary, owner[np.argsort(term, kind="stable")]
        self.offsets = np.append(0, np.cumsum(np.bincount(term, minlength=len(self.terms))))

    def nearest(self, ids: np.ndarray, groups: pa.Array, sets: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the k best rows of each query, by rounded similarity and position in ``ids``; all have an element in common with it."""
        n, m = len(ids), len(self.names)
        sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
        term = pc.index_in(sets.flatten(), value_set=self.terms)
        row = np.repeat(np.arange(n), sizes)[term.is_valid().to_numpy(zero_copy_only=False)]
        term = term.drop_null().to_numpy()
        many = np.diff(self.offsets)[term]
        at = np.repeat(self.offsets[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(np.repeat(row, many) * m + self.owners[at], minlength=n * m).reshape(n, m)
        known = pc.index_in(groups, value_set=self.groups.unique()).fill_null(-1).to_numpy()
        common[known[:, None] != pc.index_in(self.groups, value_set=self.groups.unique()).to_numpy()[None, :]] = 0
        common[ids[:, None] == self.names[None, :]] = 0
        s = common / np.maximum(sizes[:, None] + self.sizes[None, :] - common, 1)
        key = np.arange(n)[:, None] - np.rint(s * 1e9).astype(np.int64) * n
        best = np.argpartition(key, k - 1, axis=0)[:k] if k < n else np.tile(np.arange(n)[:, None], m)
        row, query = best.ravel(), np.tile(np.arange(m), len(best))
        some = common[row, query] > 0
        return query[some], row[some], s[row, query][some]


def nearest_sets(rows: DataFrame, is_query: Column, id_col: str, group_col: str, set_col: str, k: int, block: int = 2048) -> DataFrame:
    """(query, id, rank, s): for each row that fulfils ``is_query``, the k rows of its group with the highest Jaccard similarity above 0,
    itself excluded, ties by id.

    Exact search of a stated query set against all rows, as in ``nearest_vectors``: queries and rows are packed into blocks, each block of queries meets
    every block of rows through its inverted lists in one job, however frequent an element is, nothing comes to the driver, and only the k best of two
    blocks go on to the final ranking. Elements are strings and distinct within a row; a NULL group matches nothing."""
    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"), F.col(set_col).alias("ts"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    kept = cut(picked.where((F.size("ts") > 0) & F.col("g").isNotNull()))
    many = cut(packed_rows(kept.select("id", "g", "ts"), 1000)).withColumnRenamed("data", "r")
    asked = cut(packed_rows(kept.where("asked").select("id", "g", "ts"), block)).withColumnRenamed("data", "q")

    def run(batches):
        blocks: dict[bytes, SetBlock] = {}
        for b in batches:
            for r, q in zip(b["r"].to_pylist(), b["q"].to_pylist()):
                if q not in blocks:
                    if len(blocks) >= 8:
                        blocks.clear()
                    blocks[q] = SetBlock(unpacked(q))
                part = unpacked(r)
                part = part.take(pc.sort_indices(part["id"]))
                query, row, s = blocks[q].nearest(np.array(part["id"].to_pylist(), object), part["g"], part["ts"], k)
                yield pa.RecordBatch.from_arrays([blocks[q].ids.take(pa.array(query)), part["id"].take(pa.array(row)), pa.array(s)], ["query", "id", "s"])

    # Blocks, not rows: a stated query set against all rows.
    found = many.crossJoin(asked).mapInArrow(run, f"query {kind}, id {kind}, s double")
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "id"))
    return found.withColumn("rank", r).where(F.col("rank") <= k).select("query", "id", "rank", "s")


#: Rows of a block of inverted lists: one number for each row is added up at a time, which stays within a core's cache. Queries of a block.
LIST_ROWS, LIST_QUERIES = 1 << 16, 1 << 12


def gathered(batches, size: int):
    """Batches of ``size`` rows, the last one of what is left, from a task's batches."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            if held and n + part.num_rows > size:
                fits = size - n
                yield pa.concat_batches([*held, part.slice(0, fits)])
                held, n, part = [], 0, part.slice(fits)
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.concat_batches(held)


def inverted(ts: pa.Array) -> pa.RecordBatch:
    """(t, rows, ns) of an array of lists of terms: for each term the rows that hold it, in order, and how often."""
    flat, n = ts.flatten().cast(pa.string()).dictionary_encode(), max(len(ts), 1)
    owner = np.repeat(np.arange(len(ts)), pc.list_value_length(ts).to_numpy(zero_copy_only=False))
    found, many = np.unique(flat.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(found // n, minlength=len(flat.dictionary)))), pa.int32())
    return pa.RecordBatch.from_arrays([flat.dictionary, pa.ListArray.from_arrays(offsets, pa.array(found % n, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(many, pa.int32()))], ["t", "rows", "ns"])


def places(asked: pa.Array, terms: pa.Array):
    """For each list of terms its own places in ``terms``, and which of the list's entries these are; other terms are passed over."""
    coded = asked.flatten().cast(pa.string()).dictionary_encode()
    at = pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
    ends = np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))
    for begin, end in zip([0, *ends.tolist()], ends.tolist()):
        known = begin + np.flatnonzero(at[begin:end] >= 0)
        yield at[known], known


def scored_above(rows: DataFrame, set_col: str, queries: DataFrame, id_col: str, bag_col: str, score_col: str, size: int = LIST_ROWS, block: int = LIST_QUERIES) -> DataFrame:
    """(id, above): for each query that shares an element with any row, the number of rows whose score is higher than the query's ``score_col``, both to
    nine digits. A row's score is the number of the query's elements that the row has, over the root of the row's own number.

    Exact: blocks of rows as inverted lists meet blocks of queries as in ``nearest_sets``. Scores of pairs are added up within a task and never leave it; what goes on is one number for each
    query and block of rows, so disk is in proportion to the tables, not to the pairs. Elements are distinct within a row and may be repeated in a query."""
    kind = queries.schema[id_col].dataType.simpleString()

    def lists(batches):
        for b in gathered(batches, size):
            sizes = pc.list_value_length(b["ts"]).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([streamed(inverted(b["ts"]))], pa.binary()), pa.array([sizes.to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["lists", "sizes"])

    many = cut(rows.select(F.col(set_col).alias("ts")).where(F.size("ts") > 0).mapInArrow(lists, "lists binary, sizes binary"))
    picked = queries.select(F.col(id_col).alias("id"), F.col(bag_col).alias("ts"), F.col(score_col).cast("double").alias("own")).where(F.size("ts") > 0)
    asked = cut(packed_rows(picked, block))

    def run(batches):
        for b in batches:
            for data, sizes, q in zip(b["lists"], b["sizes"], b["data"]):
                part, asks = unpacked(data.as_py()), unpacked(q.as_py())
                roots = np.sqrt(np.frombuffer(sizes.as_py(), np.int32).astype(float))
                offsets, held = part["rows"].offsets.to_numpy(), part["rows"].values.to_numpy().astype(np.int64)
                own, shared, above = asks["own"].to_numpy(), [], []
                for k, (at, _) in enumerate(places(asks["ts"], part["t"])):
                    if not len(at):
                        continue
                    common = np.bincount(np.concatenate([held[a:b] for a, b in zip(offsets[at].tolist(), offsets[at + 1].tolist())]), minlength=len(roots))
                    near = np.flatnonzero(common > roots * max(own[k] - 1e-8, 0))
                    shared.append(k)
                    above.append(int((np.rint(common[near] / roots[near] * 1e9) > np.rint(own[k] * 1e9)).sum()))
                yield pa.RecordBatch.from_arrays([asks["id"].take(pa.array(shared, pa.int64())), pa.array(above, pa.int64())], ["id", "above"])

    # Blocks, not rows: a stated query set against all rows.
    return many.crossJoin(asked).mapInArrow(run, f"id {kind}, above long").groupBy("id").agg(F.sum("above").alias("above"))


def nearest_documents(docs: DataFrame, is_query: Column, id_col: str, group_col: str, terms: Column, size: int = LIST_ROWS, block: int = LIST_QUERIES) -> DataFrame:
    """(query, id, s): for each row that fulfils ``is_query``, the row of another group with the highest TF-IDF cosine above 0 (as ``tfidf_vectors`` over all rows), ties to nine digits by id.

    Exact: blocks of rows as inverted lists meet blocks of queries as in ``scored_above``, and only the best row of each query and block goes on. Words are counted by block first, so what is
    shuffled for document frequencies is one row for each block and word of it. Ids are unique; a NULL group is in no pair."""
    kinds = {"id": docs.schema[id_col].dataType.simpleString(), "g": docs.schema[group_col].dataType.simpleString()}
    picked = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.coalesce(is_query, F.lit(False)).alias("asked"), terms.alias("ts"))

    def lists(batches):
        for b in gathered(batches, size):
            b = b.take(pc.sort_indices(b["id"]))
            yield pa.RecordBatch.from_arrays([pa.array([streamed(inverted(b["ts"]))], pa.binary()), pa.array([streamed(b.select(["id", "g", "asked"]))], pa.binary()), pa.array([b.num_rows], pa.int64())], ["lists", "rows", "n"])

    blocks = cut(picked.mapInArrow(lists, "lists binary, rows binary, n long")).withColumn("block", F.monotonically_increasing_id())
    nd = blocks.agg(F.sum("n")).first()[0] or 0

    def words(batches):
        for b in batches:
            for data, k in zip(b["lists"], b["block"].to_pylist()):
                t = unpacked(data.as_py())
                for at in range(0, t.num_rows, 10_000):
                    part = t.slice(at, 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k)), pa.array(np.arange(at, at + part.num_rows), pa.int32()), part["t"], pc.list_value_length(part["rows"]).cast(pa.int32())], ["block", "place", "t", "n"])

    local = blocks.select("block", "lists").mapInArrow(words, "block long, place int, t string, n int")
    df = local.groupBy("t").agg(F.sum("n").alias("df"))
    known = local.join(df, "t").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "df"))).alias("k")).select("block", F.col("k.df").alias("df"))

    def weighted(batches):
        for b in batches:
            for data, rows, df in zip(b["lists"], b["rows"], b["df"]):
                t, n = unpacked(data.as_py()), unpacked(rows.as_py()).num_rows
                row = t["rows"].values.to_numpy()
                x = (1 + np.log(t["ns"].values.to_numpy())) * np.repeat(np.log((1 + nd) / (1 + df.values.to_numpy())) + 1, pc.list_value_length(t["rows"]).to_numpy())
                x /= np.sqrt(np.bincount(row, x * x, minlength=n))[row]
                out = pa.RecordBatch.from_arrays([t["t"], t["rows"], pa.ListArray.from_arrays(t["rows"].offsets, pa.array(x))], ["t", "rows", "xs"])
                yield pa.RecordBatch.from_arrays([pa.array([streamed(out)], pa.binary()), pa.array([rows.as_py()], pa.binary())], ["lists", "rows"])

    many = cut(blocks.join(known, "block").select("lists", "rows", "df").mapInArrow(weighted, "lists binary, rows binary"))

    def queries(batches):
        for b in batches:
            for data, rows in zip(b["lists"], b["rows"]):
                t, r = unpacked(data.as_py()), unpacked(rows.as_py())
                row, term = t["rows"].values.to_numpy(), np.repeat(np.arange(t.num_rows), pc.list_value_length(t["rows"]).to_numpy())
                at = np.flatnonzero(r["asked"].to_numpy(zero_copy_only=False)[row])
                at = at[np.argsort(row[at], kind="stable")]
                own, starts = np.unique(row[at], return_index=True)
                offsets = pa.array(np.append(starts, len(at)), pa.int32())
                out = [r["id"].take(pa.array(own)), r["g"].take(pa.array(own)), pa.ListArray.from_arrays(offsets, t["t"].take(pa.array(term[at]))), pa.ListArray.from_arrays(offsets, t["xs"].values.take(pa.array(at)))]
                yield pa.RecordBatch.from_arrays(out, ["id", "g", "ts", "xs"])

    some = many.mapInArrow(queries, f"id {kinds['id']}, g {kinds['g']}, ts array<string>, xs array<double>").where("g is not null")
    asked = cut(packed_rows(some.repartition(max(1, -(-some.count() // block))), block))

    def run(batches):
        for b in batches:
            for data, rows, q in zip(b["lists"], b["rows"], b["data"]):
                part, r, asks = unpacked(data.as_py()), unpacked(rows.as_py()), unpacked(q.as_py())
                offsets, held, xs = part["rows"].offsets.to_numpy(), part["rows"].values.to_numpy().astype(np.int64), part["xs"].values.to_numpy()
                groups = r["g"].dictionary_encode()
                group = groups.indices.fill_null(-1).to_numpy()
                by_group = np.argsort(group, kind="stable")
                ends = np.searchsorted(group[by_group], np.arange(len(groups.dictionary) + 1))
                none, own = by_group[: ends[0]], pc.index_in(asks["g"], value_set=groups.dictionary).fill_null(-1).to_numpy()
                weights, first, found = asks["xs"].values.to_numpy(), asks["xs"].offsets.to_numpy(), []
                for k, (at, entry) in enumerate(places(asks["ts"], part["t"])):
                    if not len(at):
                        continue
                    spans = list(zip(offsets[at].tolist(), offsets[at + 1].tolist()))
                    s = np.bincount(np.concatenate([held[a:b] for a, b in spans]), np.concatenate([xs[a:b] * w for (a, b), w in zip(spans, weights[first[0] + entry].tolist())]), len(group))
                    s[none] = 0
                    if own[k] >= 0:
                        s[by_group[ends[own[k]] : ends[own[k] + 1]]] = 0
                    top = s.max()
                    if top > 0:
                        # Rows are in the order of their ids, so the first of equals has the least.
                        near = np.flatnonzero(s > max(top - 1e-8, 0))
                        best = near[np.argmax(np.rint(s[near] * 1e9))]
                        found.append((k, best, s[best]))
                k, best, s = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                yield pa.RecordBatch.from_arrays([asks["id"].take(pa.array(k)), r["id"].take(pa.array(best)), pa.array(s)], ["query", "id", "s"])

    # Blocks, not rows: a stated query set against all rows.
    best = many.crossJoin(asked).mapInArrow(run, f"query {kinds['id']}, id {kinds['id']}, s double")
    return best.groupBy("query").agg(F.min_by(F.struct("id", "s"), F.struct((-F.round("s", 9)).alias("o"), "id")).alias("m")).select("query", "m.id", "m.s")
