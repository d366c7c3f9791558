"""The pN_ queries: each takes (spark, sf_dir) and runs over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import canonical_copies, contamination, cross_split, defects, near_duplicates, ngram_counts, packing, reading_level, shared_spans, truncation
from tallyframe.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "criteria"), "criterion_id", ["title", "description"], 0.75)
    return pairs.select(F.col("id_a").alias("criterion_id_a"), F.col("id_b").alias("criterion_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(table(spark, d, "criteria"), "criterion_id", ["title", "description"], 0.75)
    return groups.withColumnRenamed("id", "criterion_id")


def p1_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Alike word sets, each named by its first row: with p1_members all pairs of p1_found, however many rows are equal."""
    pairs, _ = near_duplicates.near_duplicate_classes(table(spark, d, "criteria"), "criterion_id", ["title", "description"], 0.75)
    return pairs.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each row whose word set another row has too."""
    _, copies = near_duplicates.near_duplicate_classes(table(spark, d, "criteria"), "criterion_id", ["title", "description"], 0.75)
    return copies.select(F.col("rep").alias("class_id"), F.col("id").alias("criterion_id"))


def _p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Answers of examples and rollouts with their question; a uid names one question."""
    examples, rollouts = table(spark, d, "examples"), table(spark, d, "rollouts")
    none = F.lit(None)
    own = examples.select(F.lit("examples").alias("src"), F.col("ex_id").alias("rec_id"), "question", F.col("reference_answer").alias("answer"), none.cast("string").alias("error"), none.cast("int").alias("recorded"))
    asked = examples.where("uid is not null").groupBy("uid").agg(F.min("question").alias("question"))
    sampled = rollouts.join(asked, "uid", "left").select(F.lit("rollouts").alias("src"), F.col("rollout_key").alias("rec_id"), "question", F.col("text").alias("answer"), "error", F.col("n_chars").alias("recorded"))
    return own.unionByName(sampled)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_labels(_p2_pairs(spark, d)).where("rank = 1").select("src", "rec_id", "defect")


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must not happen: rows with two main defects, defects of rows that don't exist, answers of blanks only that aren't empty."""
    pairs = _p2_pairs(spark, d)
    labels = cut(defects.defect_labels(pairs))
    main = labels.where("rank = 1").groupBy("src", "rec_id").agg(F.count(F.lit(1)).alias("n"), F.min("defect").alias("defect"))
    both = pairs.select("src", "rec_id", (F.trim(F.coalesce("answer", F.lit(""))) == "").alias("blank")).join(main, ["src", "rec_id"], "full")
    return both.agg(F.count("blank").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_two_main"), F.count_if(F.col("blank").isNull()).alias("n_unknown"), F.count_if(F.col("blank") & (F.coalesce("defect", F.lit("")) != "empty")).alias("n_blank_missed"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """All labels of each defective pair, with posteriors."""
    return defects.defect_labels(_p2_pairs(spark, d)).select("src", "rec_id", "defect", F.round("posterior", 6).alias("posterior"), "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marked = ngram_counts.marked_values(table(spark, d, "criteria"), "title", "uid")
    return marked.where("mark is not null").select("level", "value", "mark")


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return ngram_counts.marked_values(table(spark, d, "criteria"), "title", "uid").select("level", "value", "times", "records")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    counts = ngram_counts.ngram_counts(table(spark, d, "criteria"), ngram_counts.title_words(F.col("title")), F.col("uid"), longest=3)
    return counts.where("kind = 'ngram'").select("ngram", "words", "times", "records")


def p3_list_check(spark: SparkSession, d: str) -> DataFrame:
    return ngram_counts.list_check(table(spark, d, "criteria"), table(spark, d, "top_titles"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.truncated(table(spark, d, "rollouts"), "rollout_key", "setting", "text", "n_chars")
    return found.select(F.col("id").alias("rollout_key"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    rollouts = table(spark, d, "rollouts")
    found = truncation.truncated(rollouts, "rollout_key", "setting", "text", "n_chars")
    return truncation.truncation_rates(rollouts, found, "setting").withColumnRenamed("source", "setting")


def p4_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which a setting's texts pile up at the maximum."""
    return truncation.spikes(table(spark, d, "rollouts"), "setting", "text").withColumnRenamed("source", "setting")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(table(spark, d, "examples"), "ex_id", "question", F.col("split") == "train", 0.75)
    return pairs.select(F.least("id_1", "id_2").alias("ex_id_a"), F.greatest("id_1", "id_2").alias("ex_id_b"))


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "examples")
    pairs = cross_split.cross_split_pairs(examples, "ex_id", "question", F.col("split") == "train", 0.75)
    train = examples.select(F.col("ex_id").alias("id_1"), F.col("uid").alias("train_uid"))
    held = examples.select(F.col("ex_id").alias("id_2"), F.col("uid").alias("held_uid"), "split")
    out = pairs.join(train, "id_1").join(held, "id_2")
    return out.select(F.col("id_1").alias("train_ex_id"), "train_uid", F.col("id_2").alias("held_ex_id"), "held_uid", "split", F.round("jaccard", 6).alias("jaccard"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_counts(table(spark, d, "examples"), "ex_id", "question", F.col("split") == "train", "split", "question_source", 0.75)


def p5_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Alike word sets of train and other rows, each named by its first row there."""
    good, _, _ = cross_split.cross_split_classes(table(spark, d, "examples"), "ex_id", "question", F.col("split") == "train", 0.75)
    return good.select(F.col("a").alias("train_class"), F.col("b").alias("held_class"), F.round("jaccard", 6).alias("jaccard"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each row whose word set another row of its side has too."""
    _, sides, classes = cross_split.cross_split_classes(table(spark, d, "examples"), "ex_id", "question", F.col("split") == "train", 0.75)
    parts = [cross_split.members(s, c).select(F.lit(name).alias("side"), F.col("rep").alias("class_id"), F.col("id").alias("ex_id")) for name, s, c in zip(("train", "held"), sides, classes)]
    return parts[0].unionByName(parts[1])


def _p6_records(spark: SparkSession, d: str) -> DataFrame:
    """Both tables as records; the id's lowest bit tells the table."""
    examples = table(spark, d, "examples").select((F.col("ex_id") * 2).alias("rid"), F.col("reference_answer").alias("text"))
    criteria = table(spark, d, "criteria").select((F.col("criterion_id") * 2 + 1).alias("rid"), F.col("description").alias("text"))
    return examples.unionByName(criteria)


def _p6_names() -> list:
    return [F.when(F.pmod("rid", F.lit(2)) == 0, "examples").otherwise("criteria").alias("src"), F.shiftright("rid", 1).alias("rec_id")]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_p6_records(spark, d)).select(*_p6_names(), "span_start", "span_end")


def p6_shared_part(spark: SparkSession, d: str) -> DataFrame:
    records = _p6_records(spark, d)
    part = shared_spans.shared_part(records, shared_spans.shared_spans(records))
    return part.select(*_p6_names(), "n_spans", "shared_chars", "share")


def _p7_pairs(spark: SparkSession, d: str) -> list[DataFrame]:
    criteria = canonical_copies.copies(table(spark, d, "criteria"), "criterion_id", "title", "description")
    entries = canonical_copies.copies(canonical_copies.parsed_entries(table(spark, d, "raw_entries")), "id", "title", "description")
    return [criteria.select(F.lit("criteria").alias("src"), "first_id", "copy_id"), entries.select(F.lit("raw_entries").alias("src"), "first_id", "copy_id")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    first, second = _p7_pairs(spark, d)
    return first.unionByName(second)


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each canonical text of criteria and of raw_entries, in canonical form, with its number of copies."""
    criteria = canonical_copies.records(table(spark, d, "criteria"), "criterion_id", "title", "description")
    entries = canonical_copies.records(canonical_copies.parsed_entries(table(spark, d, "raw_entries")), "id", "title", "description")
    return criteria.select(F.lit("criteria").alias("src"), "*").unionByName(entries.select(F.lit("raw_entries").alias("src"), "*"))


def p7_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Canonical texts of both tables together, and 128-bit hashes that two of them share."""
    criteria = canonical_copies.fingerprints(table(spark, d, "criteria"), "criterion_id", "title", "description")
    entries = canonical_copies.fingerprints(canonical_copies.parsed_entries(table(spark, d, "raw_entries")), "id", "title", "description")
    return canonical_copies.collisions(criteria.unionByName(entries))


def p7_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record for each canonical text of criteria and of raw_entries, with its number of copies in that table."""
    rows = [
        ("criteria", canonical_copies.fingerprints(table(spark, d, "criteria"), "criterion_id", "title", "description")),
        ("raw_entries", canonical_copies.fingerprints(canonical_copies.parsed_entries(table(spark, d, "raw_entries")), "id", "title", "description")),
    ]
    first, second = [canonical_copies.copy_groups(prints).select(F.lit(src).alias("src"), "first_id", "copies") for src, prints in rows]
    return first.unionByName(second)


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_sequences(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens come out once, no sequence is beyond its capacity, and none but longer documents are divided."""
    tokens = cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.packing_faults(tokens, packing.packed_sequences(tokens))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Sequences needed, beside those of best-fit decreasing alone and the fewest possible."""
    tokens = cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.packing_report(tokens).select("method", "bins", "least", F.round("free_share", 6).alias("free_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.contained_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "reference_answer"])
    return found.select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is found in, and the largest part of it found in one."""
    found = contamination.contained_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "reference_answer"])
    return found.groupBy(F.col("item_id").cast("int").alias("item_id")).agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.max("contained"), 6).alias("most_contained"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"))
    return levels.where("words_per_sentence >= 22.0 and letters_per_word >= 5.8").select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"))
    return levels.select("doc_id", "words", "sentences", F.round("score", 4).alias("score"), "level")


def p10_features(spark: SparkSession, d: str) -> DataFrame:
    """The counts and lengths that the levels rest on."""
    levels = reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"))
    return levels.where("words > 0").select("doc_id", "words", "sentences", F.round("letters_per_word", 6).alias("letters_per_word"), F.round("words_per_sentence", 6).alias("words_per_sentence"))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Whether levels of documents that the model didn't see equal the grade in 60 % of ratings and are within one in 95 %."""
    got = reading_level.held_out_agreement(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"))
    return got.select((F.col("exact") >= 0.6).alias("mostly_equal"), (F.col("within_one") >= 0.95).alias("nearly_always_near"))


def p10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Levels against human grades: ratings by grade and level."""
    labels = table(spark, d, "reading_labels").where("grade is not null")
    levels = reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", labels)
    return labels.join(levels.select("doc_id", "level"), "doc_id").groupBy("grade", "level").agg(F.count(F.lit(1)).alias("n"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    p1_found, p1_groups, p1_class_pairs, p1_members, p2_found, p2_labels, p2_faults, p3_found, p3_frequencies, p3_ngrams, p3_list_check, p4_found, p4_rates, p4_spikes,
    p5_found, p5_overlaps, p5_counts, p5_class_pairs, p5_members, p6_found, p6_shared_part, p7_found, p7_records, p7_copy_counts, p7_collisions, p8_sequences, p8_faults, p8_report,
    p9_found, p9_leaks, p10_found, p10_levels, p10_features, p10_held_out, p10_agreement,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
