"""Lint checks of criteria and rubrics, weight order, mirrors, redundancy, counts and truncation to a common size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T
from tallyframe.operators.similarity import tfidf_vectors
from tallyframe.plans import sqltext as S
from tallyframe.plans.forensics import _Q, R6
from tallyframe.plans.registry import query
from tallyframe.plans.views import RUBRIC, criteria, questions

CHECKS = ["title_words", "single_sentence", "category_legal", "weight_in_range", "weight_in_band", "pitfall_opener", "fields_present", "no_verbatim_copy", "self_contained"]

_RANGE = "case when cat = 'Pitfall' then w in (-1, -2) else w between 1 and 5 end"
_BAND = "case cat when 'Essential' then w = 5 when 'Important' then w in (3, 4) when 'Optional' then w in (1, 2) else w in (-1, -2) end"
#: Sentences, counted by marking each gap (RE2 has no look-behind).
_SENTENCES = "(case when trim(body) = '' then 0 else len(string_split(regexp_replace(trim(body), '([.!?])\\s+([A-Z(])', '\\1' || chr(2) || '\\2', 'g'), chr(2))) end)"
_CHECKED = f"""{S.NORMALISED}, q as (select * from {_Q}), j as (select n.*, {S.ngrams(S.content_tokens('n.body'), 3)} as g, coalesce({S.ngrams(S.content_tokens('q.reference_answer'), 3)}, []) as gr, coalesce({S.ngrams(S.content_tokens('q.question'), 3)}, []) as gq from n left join q using (uid)),
k as (select *, len({S.words('title')}) between 2 and 4 as title_words, {_SENTENCES} <= 1 as single_sentence, cat in {tuple(L.CATEGORIES)} as category_legal, {_RANGE} as weight_in_range,
 case when domain = 'rar_medicine' then {_BAND} end as weight_in_band, case when domain = 'rar_medicine' and cat = 'Pitfall' then regexp_matches(body, {S.lit(L.PITFALL_OPENER)}) end as pitfall_opener,
 trim(coalesce(title,'')) <> '' and trim(body) <> '' as fields_present, case when len(g) > 0 then greatest(len(list_intersect(g, gr)), len(list_intersect(g, gq))) / len(g) < 0.5 end as no_verbatim_copy, not {S.contains_any('body', L.NOT_SELF_CONTAINED)} as self_contained from j)"""
_ALL = " and ".join(f"coalesce({c}, true)" for c in CHECKS)


def in_category(values: dict[str, list[int]]) -> Column:
    out = F.lit(False)
    for name, allowed in values.items():
        out = F.when(F.col("cat") == name, F.col("w").isin(allowed)).otherwise(out)
    return out


def checked_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Each criterion with a column per check: true, false, or NULL where a check doesn't apply."""
    q = questions(spark, d).select("uid", T.ngrams(T.content_tokens(F.col("reference_answer")), 3).alias("gr"), T.ngrams(T.content_tokens(F.col("question")), 3).alias("gq"))
    none = F.array().cast("array<string>")
    j = criteria(spark, d).join(q, "uid", "left").withColumn("g", T.ngrams(T.content_tokens(F.col("body")), 3))
    medicine, pitfall, body = F.col("domain") == "rar_medicine", F.col("cat") == "Pitfall", F.col("body")
    shared = F.greatest(F.size(F.array_intersect("g", F.coalesce("gr", none))), F.size(F.array_intersect("g", F.coalesce("gq", none))))
    return j.select(
        "criterion_id", *RUBRIC, "domain", "pos", "cat", "w", "method",
        F.size(T.words(F.col("title"))).between(2, 4).alias("title_words"), (T.sentence_count(body) <= 1).alias("single_sentence"), F.col("cat").isin(L.CATEGORIES).alias("category_legal"),
        F.when(pitfall, F.col("w").isin(-1, -2)).otherwise(F.col("w").between(1, 5)).alias("weight_in_range"), F.when(medicine, in_category(L.WEIGHT_BAND)).alias("weight_in_band"),
        F.when(medicine & pitfall, body.rlike(L.PITFALL_OPENER)).alias("pitfall_opener"), ((T.strip(T.or_empty(F.col("title"))) != "") & (T.strip(body) != "")).alias("fields_present"),
        F.when(F.size("g") > 0, shared / F.size("g") < 0.5).alias("no_verbatim_copy"), (~T.contains_any(body, L.NOT_SELF_CONTAINED)).alias("self_contained"),
        F.size(T.words(F.col("title"))).alias("n_title_words"), T.sentence_count(body).alias("n_sentences"),
    )


def _compliant() -> Column:
    out = F.lit(True)
    for c in CHECKS:
        out = out & F.coalesce(F.col(c), F.lit(True))
    return out


@query(f"with {_CHECKED} select criterion_id, {', '.join(CHECKS)}, {_ALL} as compliant from k")
def criterion_checks(spark: SparkSession, d: str) -> DataFrame:
    return checked_criteria(spark, d).select("criterion_id", *CHECKS, _compliant().alias("compliant"))


@query(f"with {_CHECKED} " + " union all ".join(f"select '{c}' as check_name, count({c}) as n_applicable, sum(case when {c} then 1 else 0 end) as n_passed, round(avg(case when {c} then 1.0 when not {c} then 0.0 end), 6) as pass_rate from k" for c in CHECKS))
def check_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Pass rate of each check: the checks are unpivoted, then grouped once."""
    long = checked_criteria(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("passed")) for c in CHECKS])).alias("x")).select("x.*")
    return long.groupBy("check_name").agg(F.count("passed").alias("n_applicable"), F.count_if("passed").alias("n_passed"), R6(F.avg(F.when(F.col("passed"), 1.0).when(~F.col("passed"), 0.0))).alias("pass_rate"))


_REASON = f"case check_name when 'title_words' then 'title has ' || len({S.words('title')}) || ' words' when 'single_sentence' then {_SENTENCES} || ' sentences' when 'weight_in_range' then 'weight ' || w || ' for ' || cat when 'weight_in_band' then 'weight ' || w || ' for ' || cat else cat end"


@query(f"""with {_CHECKED}, ff as (""" + " union all ".join(f"select '{c}' as check_name, title, body, w, cat from k where not {c}" for c in CHECKS) + f"""), rs as (select check_name, {_REASON} as reason, count(*) as n from ff group by 1, 2),
rr as (select *, row_number() over (partition by check_name order by n desc, reason) as rank from rs) select check_name, reason, n, cast(rank as bigint) as rank from rr where rank <= 5""")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest reasons for which each check fails."""
    k = checked_criteria(spark, d)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    weight = text("weight ", F.col("w").cast("string"), " for ", F.col("cat"))
    reason = {"title_words": text("title has ", F.col("n_title_words").cast("string"), " words"), "single_sentence": text(F.col("n_sentences").cast("string"), " sentences"), "weight_in_range": weight, "weight_in_band": weight}
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.struct(F.lit(c).alias("check_name"), reason.get(c, F.col("cat")).alias("reason"))) for c in CHECKS]))
    n = k.select(F.explode(failed).alias("x")).groupBy("x.check_name", "x.reason").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("check_name").orderBy(F.desc("n"), "reason"))
    return n.withColumn("rank", rank.cast("long")).where("rank <= 5")


@query(f"""with {_CHECKED} select run_name, rubric_source, uid, count(*) as n_items, count(*) between 7 and 20 as item_count_ok, round(avg(case when {_ALL} then 1.0 else 0.0 end), 6) as compliance_rate,
 count(*) between 7 and 20 and bool_and({_ALL}) as fully_compliant, round(avg(case when w < 0 then 1.0 else 0.0 end), 6) as negative_weight_rate, round(avg(case when cat = 'Pitfall' then 1.0 else 0.0 end), 6) as pitfall_fraction,
 round(avg(case when method = 'unclassified' then 1.0 else 0.0 end), 6) as unclassified_rate, count(distinct method = 'failure') = 1 as single_polarity, round(avg(case when {_BAND} then 1.0 else 0.0 end), 6) as weight_band_rate
 from k where uid is not null group by 1, 2, 3""")
def rubric_lint(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: R6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    k = checked_criteria(spark, d).where("uid is not null").withColumn("ok", _compliant())
    count = F.count(F.lit(1))
    return k.groupBy(*RUBRIC).agg(
        count.alias("n_items"), count.between(7, 20).alias("item_count_ok"), rate(F.col("ok")).alias("compliance_rate"), (count.between(7, 20) & F.bool_and("ok")).alias("fully_compliant"),
        rate(F.col("w") < 0).alias("negative_weight_rate"), rate(F.col("cat") == "Pitfall").alias("pitfall_fraction"), rate(F.col("method") == "unclassified").alias("unclassified_rate"),
        (F.count_distinct(F.col("method") == "failure") == 1).alias("single_polarity"), rate(in_category(L.WEIGHT_BAND)).alias("weight_band_rate"),
    )


_ORDER = f"{S.NORMALISED}, r as (select run_name, rubric_source, uid, w, case cat when 'Essential' then 3 when 'Important' then 2 when 'Optional' then 1 end as rank, count(*) as c from n where cat <> 'Pitfall' and uid is not null group by 1, 2, 3, 4, 5)"


@query(f"""with {_ORDER} select run_name, rubric_source, uid, sum(a.c * b.c) as n_pairs, sum(case when a.w <= b.w then a.c * b.c else 0 end) as n_violations from r a join r b using (run_name, rubric_source, uid) where a.rank > b.rank group by 1, 2, 3""")
def weight_order(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a rubric's items whose weights contradict their categories; a tie does. Items are counted by category and weight
    first, so that a hot rubric joins a few counts, not all its pairs."""
    rank = F.lit(None).cast("int")
    for name, r in L.CATEGORY_RANK.items():
        rank = F.when(F.col("cat") == name, r).otherwise(rank)
    counts = criteria(spark, d).where("uid is not null").withColumn("rank", rank).where("rank is not null").groupBy(*RUBRIC, "w", "rank").agg(F.count(F.lit(1)).alias("c"))
    lower = counts.select(*RUBRIC, F.col("w").alias("w2"), F.col("rank").alias("rank2"), F.col("c").alias("c2"))
    pairs = counts.join(lower, RUBRIC).where("rank > rank2").withColumn("m", F.col("c") * F.col("c2"))
    return pairs.groupBy(*RUBRIC).agg(F.sum("m").alias("n_pairs"), F.sum(F.when(F.col("w") <= F.col("w2"), F.col("m")).otherwise(0)).alias("n_violations"))


@query(f"""with {S.NORMALISED}, p as (select *, row_number() over (partition by run_name, rubric_source, uid order by abs(w) desc, pos, criterion_id) as r, count(*) over (partition by run_name, rubric_source, uid) as k from n where uid is not null),
m as (select run_name, uid, min(k) as common from p group by 1, 2) select p.criterion_id, common from p join m using (run_name, uid) where r <= common""")
def common_size_by_weight(spark: SparkSession, d: str) -> DataFrame:
    """Rubrics of one run and question cut to the size of the smallest: the largest weights stay, ties by position."""
    return _common_size(spark, d, [F.desc(F.abs("w"))])


@query(f"""with {S.NORMALISED}, p as (select *, row_number() over (partition by run_name, rubric_source, uid order by case cat when 'Essential' then 0 when 'Important' then 1 when 'Optional' then 2 else 3 end, abs(w) desc, pos, criterion_id) as r, count(*) over (partition by run_name, rubric_source, uid) as k from n where uid is not null),
m as (select run_name, uid, min(k) as common from p group by 1, 2) select p.criterion_id, common from p join m using (run_name, uid) where r <= common""")
def common_size_by_category(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("cat") == "Essential", 0).when(F.col("cat") == "Important", 1).when(F.col("cat") == "Optional", 2).otherwise(3)
    return _common_size(spark, d, [rank, F.desc(F.abs("w"))])


@query(f"""with {S.NORMALISED}, p as (select *, row_number() over (partition by run_name, rubric_source, uid order by pos, criterion_id) as r, count(*) over (partition by run_name, rubric_source, uid) as k from n where uid is not null),
m as (select run_name, uid, min(k) as common from p group by 1, 2) select p.criterion_id, common from p join m using (run_name, uid) where r <= common""")
def common_size_by_position(spark: SparkSession, d: str) -> DataFrame:
    return _common_size(spark, d, [])


def _common_size(spark: SparkSession, d: str, order: list[Column]) -> DataFrame:
    c = criteria(spark, d).where("uid is not null").select("criterion_id", *RUBRIC, "pos", "cat", "w")
    sizes = c.groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("k")).groupBy("run_name", "uid").agg(F.min("k").alias("common"))
    r = F.row_number().over(Window.partitionBy(*RUBRIC).orderBy(*order, "pos", "criterion_id"))
    return c.withColumn("r", r).join(sizes, ["run_name", "uid"]).where("r <= common").select("criterion_id", "common")


@query("""with k as (select run_name, rubric_source, uid, count(*) as k from criteria where uid is not null group by 1, 2, 3), h as (select rubric_source, k, count(*) as c from k group by 1, 2),
t as (select rubric_source, c, k, row_number() over (partition by rubric_source order by c desc, k) as r from h)
select a.*, m.mode_items, m.mode_share, m.top2_share from (select rubric_source, count(*) as n, round(avg(k), 6) as mean_items, round(stddev_samp(k), 6) as sd_items, round(stddev_samp(k) / avg(k), 6) as cv_items, max(k) - min(k) as range_items from k group by 1) a
join (select rubric_source, max(case when r = 1 then k end) as mode_items, round(max(case when r = 1 then c end) / sum(c), 6) as mode_share, round(sum(case when r <= 2 then c else 0 end) / sum(c), 6) as top2_share from t group by 1) m using (rubric_source)""")
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the number of items by source; ties of the mode go to the smaller number."""
    from tallyframe.session import table

    k = table(spark, d, "criteria").where("uid is not null").groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("k"))
    a = k.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("k")).alias("mean_items"), R6(F.stddev_samp("k")).alias("sd_items"), R6(F.stddev_samp("k") / F.avg("k")).alias("cv_items"), (F.max("k") - F.min("k")).alias("range_items"))
    h = k.groupBy("rubric_source", "k").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("rubric_source").orderBy(F.desc("c"), "k")))
    m = h.groupBy("rubric_source").agg(F.max(F.when(F.col("r") == 1, F.col("k"))).alias("mode_items"), R6(F.max(F.when(F.col("r") == 1, F.col("c"))) / F.sum("c")).alias("mode_share"), R6(F.sum(F.when(F.col("r") <= 2, F.col("c")).otherwise(0)) / F.sum("c")).alias("top2_share"))
    return a.join(m, "rubric_source")


@query(f"""with {S.NORMALISED}, p as (select run_name, rubric_source, uid, abs(w) / sum(abs(w)) over (partition by run_name, rubric_source, uid) as p from n where uid is not null)
select run_name, rubric_source, uid, round(-sum(p * ln(p)), 6) as entropy, round(case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) end, 6) as normalised, round(max(p), 6) as max_share from p group by 1, 2, 3""")
def weight_profile(spark: SparkSession, d: str) -> DataFrame:
    """Entropy (nats) of each rubric's weights, from sums of w and w ln w, so no window over a rubric is needed."""
    w = F.abs("w").cast("double")
    g = criteria(spark, d).where("uid is not null").groupBy(*RUBRIC).agg(F.sum(w).alias("s"), F.sum(w * F.log(w)).alias("l"), F.max(w).alias("m"), F.count(F.lit(1)).alias("k"))
    entropy = F.log("s") - F.col("l") / F.col("s")
    clean = lambda c: F.round(c, 6) + 0.0
    return g.select(*RUBRIC, clean(entropy).alias("entropy"), clean(F.when(F.col("k") > 1, entropy / F.log("k"))).alias("normalised"), clean(F.col("m") / F.col("s")).alias("max_share"))


_MIRROR = f"{S.NORMALISED}, doc as (select criterion_id as id, rubric_source, domain, uid, run_name, cat = 'Pitfall' as pit, trim(regexp_replace(regexp_replace(body, {S.lit(L.NEGATIVE_OPENER)}, ''), {S.lit(L.POSITIVE_OPENER)}, '')) as text from n where uid is not null)"
_SQL_VECTORS = """tf as (select id, rubric_source, domain, t, 1 + ln(count(*)) as tf from (select id, rubric_source, domain, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) as t from doc) group by 1, 2, 3, 4),
df as (select rubric_source, domain, t, count(*) as df from tf group by 1, 2, 3 having count(*) >= 2), nd as (select rubric_source, domain, count(*) as nd from doc group by 1, 2),
raw as (select id, t, tf * (ln((1 + nd) / (1 + df)) + 1) as x from tf join df using (rubric_source, domain, t) join nd using (rubric_source, domain)),
vec as (select id, t, x / sqrt(sum(x * x) over (partition by id)) as x from raw)"""


@query(f"""with {_MIRROR}, {_SQL_VECTORS}, sims as (select a.run_name, a.rubric_source, a.uid, a.id as pitfall, b.id as positive, sum(v.x * u.x) as s from doc a join doc b using (run_name, rubric_source, uid) join vec v on v.id = a.id join vec u on u.id = b.id and u.t = v.t where a.pit and not b.pit group by 1, 2, 3, 4, 5)
select run_name, rubric_source, uid, sum(case when s >= 0.6 then 1 else 0 end) as n_mirrors, round(max(s), 5) as max_similarity from sims group by 1, 2, 3""")
def pitfall_mirrors(spark: SparkSession, d: str) -> DataFrame:
    """Pitfalls that repeat a positive item of their rubric: TF-IDF cosine of texts without polarity openers, with document frequencies
    of the source and domain. Vectors meet on (rubric, word), so only items that share a word are paired."""
    doc = criteria(spark, d).where("uid is not null").select(F.col("criterion_id").alias("id"), *RUBRIC, "domain", (F.col("cat") == "Pitfall").alias("pit"), T.polarity_stripped(F.col("body")).alias("text"))
    vec = tfidf_vectors(doc, "id", "text", ["rubric_source", "domain"], min_df=2, carry=["run_name", "uid", "pit"])
    a = vec.where("pit").select(*RUBRIC, "t", F.col("id").alias("pitfall"), F.col("x").alias("xa"))
    b = vec.where("not pit").select(*RUBRIC, "t", F.col("id").alias("positive"), F.col("x").alias("xb"))
    sims = a.join(b, [*RUBRIC, "t"]).groupBy(*RUBRIC, "pitfall", "positive").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    return sims.groupBy(*RUBRIC).agg(F.count_if(F.col("s") >= 0.6).alias("n_mirrors"), F.round(F.max("s"), 5).alias("max_similarity"))
