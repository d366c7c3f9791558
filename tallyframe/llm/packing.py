"""Problem 8: filling sequences of fixed capacity, by a grouping genetic algorithm on islands.

Sizes are token counts. A text longer than the capacity is divided into whole sequences and a rest. The other items
are spread over blocks of bounded size by hash. In each block several islands evolve packings whose genes are whole
bins: crossover injects well-filled bins of one parent into the other, bins that share an item with them are
dissolved, and displaced items first replace one or two items of a bin that they fill better, then go where they fit best; mutation
dissolves poorly filled bins. The first packing of a population is best-fit decreasing alone. After each epoch an
island's elite migrates to the next island of its block; then the islands of a block meet, and items of bins
still poorly filled migrate into new blocks with those of other blocks. A block stops as soon as it needs
no more bins than its total size does. Nothing but item sizes is shuffled, and no group exceeds a block.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut

CAPACITY = 2048
BLOCK_ITEMS = 1500
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
WELL_FILLED = 0.995
#: Up to so many displaced items are tried as replacements.
SWAPPED = 60
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document; NULL text has none. The driver's vocabulary file goes to every executor."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(frames):
        encode = encoder(SparkFiles.get(name))
        for f in frames:
            yield pd.DataFrame({"doc_id": f["id"], "tokens": [len(encode.encode_ordinary(t)) if t else 0 for t in f["text"]]})

    return documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, tokens long")


class Packing:
    """Bins of item numbers, their loads, and Falkenauer's fitness: the mean squared filling."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.loads = [sum(sizes[i] for i in b) for b in bins]
        self.fitness = sum((x / capacity) ** 2 for x in self.loads) / max(len(bins), 1)


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Each item, largest first, into the fullest bin that still has room."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(room, (left - sizes[i], k))
    return bins


def swapped_in(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Puts one or two loose items in place of one or two items of a bin wherever that fills it better; gives back what is loose then."""
    loose = sorted(loose, key=lambda i: sizes[i])
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        if room == 0 or not loose:
            continue
        best, change = 0, None
        for out in [(i,) for i in b] + list(combinations(b, 2)):
            gone = sum(sizes[i] for i in out)
            most = gone + room
            own = [sizes[i] for i in loose]
            for k, x in enumerate(own[: bisect_left(own, most + 1)]):
                j = bisect_left(own, most - x + 1) - 1
                j -= j == k
                found, taken = (x + own[j], (k, j)) if j >= 0 else (x, (k,))
                if x > found or found > most:
                    found, taken = x, (k,)
                if found - gone > best:
                    best, change = found - gone, (out, taken)
            if best == room:
                break
        if change:
            out, taken = change
            b[:] = [i for i in b if i not in out] + [loose[k] for k in taken]
            loose = sorted([i for k, i in enumerate(loose) if k not in taken] + list(out), key=lambda i: sizes[i])
    return loose


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled bins of b go whole into a; a's bins that share an item with them are dissolved."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.loads[k])[: max(1, len(b.bins) // 2)]
    chosen = [b.bins[k] for k in ranked if rng.random() < 0.5] or [b.bins[ranked[0]]]
    injected = {i for x in chosen for i in x}
    kept, loose = [list(x) for x in chosen], []
    for x in a.bins:
        if injected.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in injected]
    loose = swapped_in(kept[len(chosen) :], loose, sizes, capacity) if len(loose) <= SWAPPED else loose
    return Packing(best_fit(kept, loose, sizes, capacity), sizes, capacity)


def mutated(a: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bins and a few random ones are dissolved, as far as their items can be tried as replacements, and their items placed anew."""
    order = sorted(range(len(a.bins)), key=lambda k: a.loads[k])
    some = rng.choice(len(order), min(3, len(order)), replace=False).tolist()
    gone, n = set(), 0
    for k in dict.fromkeys(order[:2] + some + order[: max(2, len(order) // 20)]):
        if len(gone) >= 2 and n + len(a.bins[k]) > SWAPPED:
            break
        gone.add(k)
        n += len(a.bins[k])
    kept, loose = [list(x) for k, x in enumerate(a.bins) if k not in gone], [i for k in sorted(gone) for i in a.bins[k]]
    loose = swapped_in(kept, loose, sizes, capacity) if len(loose) <= SWAPPED else loose
    return Packing(best_fit(kept, loose, sizes, capacity), sizes, capacity)


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], generations: int, population: int, seed: int) -> Packing:
    """The fittest packing found; ends at once when no fewer bins are possible."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    pool = [Packing([list(b) for b in s], sizes, capacity) for s in seeds]
    if not pool:
        pool.append(Packing(best_fit([], list(range(len(sizes))), sizes, capacity), sizes, capacity))
    best = max(pool, key=lambda p: p.fitness)
    if len(best.bins) <= max(least, 1):
        return best
    while len(pool) < population:
        half = rng.random(len(sizes)) < 0.5
        start = best_fit([], np.flatnonzero(half).tolist(), sizes, capacity)
        pool.append(Packing(best_fit(start, np.flatnonzero(~half).tolist(), sizes, capacity), sizes, capacity))
    for _ in range(generations):
        pool.sort(key=lambda p: -p.fitness)
        pool = pool[:population]
        children = [crossover(pool[i], pool[int(rng.integers(len(pool)))], sizes, capacity, rng) for i in range(len(pool))]
        pool += [mutated(c, sizes, capacity, rng) for c in children]
        best = max(pool, key=lambda p: p.fitness)
        if len(best.bins) <= max(least, 1):
            break
    return best


def seeds_of(frame: pd.DataFrame, position: dict[tuple, int]) -> list[list[list[int]]]:
    """Packings that migrated here: rows (migrant, bin) of known items."""
    out = []
    for _, own in frame[frame["bin"] >= 0].groupby("migrant", sort=True):
        bins: dict[int, list[int]] = {}
        for d, p, b in zip(own["doc_id"], own["piece"], own["bin"]):
            bins.setdefault(b, []).append(position[(d, p)])
        out.append(list(bins.values()))
    return out


def island_step(capacity: int, generations: int, population: int, salt: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        items = frame.drop_duplicates(["doc_id", "piece"]).sort_values(["doc_id", "piece"])
        position = {x: i for i, x in enumerate(zip(items["doc_id"], items["piece"]))}
        sizes = items["size"].tolist()
        best = evolve(sizes, capacity, seeds_of(frame, position), generations, population, hash((salt, *map(int, key))) & 0xFFFFFFFF)
        numbers, load = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, (b, x) in enumerate(zip(best.bins, best.loads)):
            numbers[b], load[b] = k, x
        return pd.DataFrame({"block": items["block"], "island": int(key[-1]) if len(key) > 1 else 0, "doc_id": items["doc_id"], "piece": items["piece"], "size": items["size"], "bin": numbers, "load": load})

    return run


STEP = "block long, island int, doc_id long, piece int, size long, bin long, load long"


def packed_blocks(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, generations: int, population: int, salt: int) -> DataFrame:
    """(block, doc_id, piece, size, bin, load): one packing of each block."""
    start = items.select(F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece"), F.lit(blocks)).alias("block"), "doc_id", "piece", "size")
    state = start.withColumn("bin", F.lit(-1).cast("long")).withColumn("migrant", F.lit(0)).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    for epoch in range(epochs):
        grown = state.groupBy("block", "island").applyInPandas(island_step(capacity, generations, population, salt + epoch), STEP)
        # Each elite stays and also goes to the next island; with the last epoch all meet on one.
        last = epoch == epochs - 1
        targets = F.array(F.lit(0)) if last else F.array_distinct(F.array(F.col("home"), (F.col("home") + 1) % islands))
        state = grown.withColumnRenamed("island", "home").withColumn("island", F.explode(targets)).withColumn("migrant", F.col("home"))
    return state.groupBy("block").applyInPandas(island_step(capacity, generations, population, salt + epochs), STEP).drop("island")


def packing_report(tokens: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(method, bins, least, free_share) of the packing as it is, and of best-fit decreasing alone in the same blocks: sequences, the fewest
    that all tokens need, and the share of space left free."""
    pieces = divided(tokens, capacity).where(F.col("size") > 0)
    n, total = pieces.agg(F.count(F.lit(1)), F.sum("size")).first()

    def plain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bins": [len(best_fit([], list(range(len(frame))), frame["size"].tolist(), capacity))]})

    block = F.pmod(F.xxhash64(F.lit(1), "doc_id", "piece"), F.lit(-(-n // block_items) or 1))
    alone = pieces.withColumn("block", block).groupBy("block").applyInPandas(plain, "bins long").agg(F.lit("best-fit decreasing").alias("method"), F.coalesce(F.sum("bins"), F.lit(0)).alias("bins"))
    genetic = packed_sequences(tokens, capacity, block_items).agg(F.lit("grouping genetic").alias("method"), F.count_distinct("sequence").alias("bins"))
    least = F.lit(-(-(total or 0) // capacity)).cast("long").alias("least")
    return alone.unionByName(genetic).select("method", "bins", least, F.try_divide(F.col("bins") * capacity - (total or 0), F.col("bins") * capacity).alias("free_share"))


def packing_faults(tokens: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_documents, n_lost, n_overfull, n_divided, n_overlaps): documents, those whose tokens don't all come out once, sequences beyond the
    capacity, documents divided without need, and pieces that don't begin where the one before ends. All but the first must be 0."""
    own = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    need = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    by_doc = tokens.join(own, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.coalesce(F.col("got"), F.lit(-1)) != F.col("tokens")).alias("n_lost"), F.count_if(F.col("pieces") > need).alias("n_divided"))
    w = Window.partitionBy("sequence").orderBy("position")
    begins = packed.where("sequence is not null").select("sequence", "n_tokens", (F.col("position") != F.coalesce(F.lag(F.col("position") + F.col("n_tokens")).over(w), F.lit(0))).alias("off"))
    by_bin = begins.groupBy("sequence").agg(F.sum("n_tokens").alias("load"), F.count_if("off").alias("off")).agg(F.count_if(F.col("load") > capacity).alias("n_overfull"), F.coalesce(F.sum("off"), F.lit(0)).alias("n_overlaps"))
    return by_doc.join(by_bin).select("n_documents", "n_lost", "n_overfull", "n_divided", "n_overlaps")


def divided(tokens: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): whole sequences and a rest of texts longer than one, all others as they are."""
    whole = F.greatest(F.floor((F.col("tokens") - 1) / capacity), F.lit(0)).cast("int")
    pieces = tokens.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    return pieces.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("size"))


def packed_sequences(tokens: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, sequence, position) of (doc_id, tokens), doc_id unique: which sequence each text, or
    each piece of a longer one, belongs to, and at which token of it.

    Defined cases: only texts of more than ``capacity`` tokens are divided, into full pieces and a rest; a text without tokens
    comes out with NULL sequence, since it takes no space; an empty table gives no rows; sequence names are unique and stable
    for the same input."""
    pieces = cut(divided(tokens, capacity))
    full, empty, open_ = pieces.where(F.col("size") == capacity), pieces.where("size = 0"), pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    n = open_.count()
    first = cut(packed_blocks(open_, -(-n // block_items) or 1, capacity, islands, epochs, generations, population, 1))
    poor = F.col("load") < WELL_FILLED * capacity
    again = first.where(poor).select("doc_id", "piece", "size")
    second = packed_blocks(again, -(-again.count() // block_items) or 1, capacity, islands, epochs, generations, population, 101)
    name = lambda kind: F.concat_ws("-", F.lit(kind), "block", "bin")
    placed = first.where(~poor).select("doc_id", "piece", "size", name("a").alias("sequence")).unionByName(second.select("doc_id", "piece", "size", name("b").alias("sequence")))
    # A bin holds at most ``capacity`` items, so this window is bounded.
    before = Window.partitionBy("sequence").orderBy(F.desc("size"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("position", F.coalesce(F.sum("size").over(before), F.lit(0)))
    alone = full.withColumn("sequence", F.concat_ws("-", F.lit("f"), "doc_id", "piece")).withColumn("position", F.lit(0).cast("long"))
    nowhere = empty.withColumn("sequence", F.lit(None).cast("string")).withColumn("position", F.lit(None).cast("long"))
    out = placed.unionByName(alone.select(placed.columns)).unionByName(nowhere.select(placed.columns))
    return out.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.col("size").alias("n_tokens"), "sequence", "position")
