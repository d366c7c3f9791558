"""Further queries: scoring views, neighbours, agreement, balance, splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T
from tallyframe.operators import merging, ranking, similarity
from tallyframe.plans import sqltext as S
from tallyframe.plans.evaluation import _CASE, _LADDER, _SHARES, _V, ladder, preference_cases, verdicts, weighted_scores
from tallyframe.plans.forensics import _GROUND, _Q, R6, grounded_criteria
from tallyframe.plans.registry import query
from tallyframe.plans.views import RUBRIC, criteria, questions
from tallyframe.session import table


@query(f"with {S.NORMALISED} select run_name, rubric_source, uid, sum(case when w > 0 then w else 0 end) as positive_weight, " + ", ".join(f"sum(case when cat = '{c}' then abs(w) else 0 end) as mass_{c.lower()}" for c in L.CATEGORIES) + " from n where uid is not null group by 1, 2, 3")
def category_mass(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    masses = [F.sum(F.when(F.col("cat") == c, F.abs(w)).otherwise(0)).alias(f"mass_{c.lower()}") for c in L.CATEGORIES]
    return criteria(spark, d).where("uid is not null").groupBy(*RUBRIC).agg(F.sum(F.when(w > 0, w).otherwise(0)).alias("positive_weight"), *masses)


@query("select uid, sha1(string_agg(setting || ':' || sha1(coalesce(text, '')), ',' order by setting, rollout_key)) as fingerprint, count(*) as n from rollouts where uid is not null group by 1")
def answer_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """One hash over a question's answers in a fixed order."""
    part = F.concat("setting", F.lit(":"), F.sha1(T.or_empty(F.col("text")).cast("binary")))
    r = table(spark, d, "rollouts").where("uid is not null").select("uid", F.struct("setting", "rollout_key", part.alias("p")).alias("s"))
    return r.groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("l"), F.count(F.lit(1)).alias("n")).select("uid", F.sha1(F.array_join(F.transform("l", lambda x: x["p"]), ",").cast("binary")).alias("fingerprint"), "n")


_MARKS = "list_sort(list_distinct(list_concat(regexp_extract_all(lower(coalesce(body,'')), '\\d+(?:[.,]\\d+)?'), regexp_extract_all(lower(coalesce(body,'')), '[^\\w\\s]'), regexp_extract_all(lower(coalesce(body,'')), '\\(([a-e])\\)', 1))))"


@query(f"select array_to_string({_MARKS}, ' ') as marks, count(*) as n from criteria group by 1 having count(*) > 1")
def shared_marks(spark: SparkSession, d: str) -> DataFrame:
    """Criteria that numbers, punctuation and options don't tell apart."""
    c = table(spark, d, "criteria")
    return c.groupBy(F.array_join(T.marks(F.col("body")), " ").alias("marks")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""select domain, ex_id from (select *, row_number() over (partition by domain order by md5(concat('11:', ex_id)), ex_id) as k from (select *, row_number() over (partition by trim(question) order by ex_id) as r from examples
 where length(question) between 100 and 400 and length(reference_answer) >= 50 and question_source in ('open_forum', 'clinic_cases') and split = 'train') where r = 1) where k <= 25""")
def eligible_sample(spark: SparkSession, d: str) -> DataFrame:
    """Length and source filters, first of equal questions, then 25 of each domain in hash order. All filters reach the scan."""
    ex = table(spark, d, "examples").where((F.length("question").between(100, 400)) & (F.length("reference_answer") >= 50) & F.col("question_source").isin("open_forum", "clinic_cases") & (F.col("split") == "train"))
    first = ranking.first_per_key(ex.select(F.trim("question").alias("q"), "ex_id", "domain"), ["q"], [F.col("ex_id").alias("o")])
    return merging.sample_per_group(first, ["domain"], "ex_id", 25, seed=11).select("domain", "ex_id")


@query("""with v as (select rubric_source, uid, title, run_name, min(category) = 'Essential' as e from criteria where uid is not null and title is not null and category is not null group by 1, 2, 3, 4),
i as (select rubric_source, uid, title, sum(case when e then 1 else 0 end) as k, sum(case when e then 0 else 1 end) as m from v group by 1, 2, 3) select rubric_source, sum(k * (k - 1) / 2) as n_both, sum(m * (m - 1) / 2) as n_neither, sum(k * m) as n_differ from i group by 1""")
def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Runs as judges: over all pairs of runs that have an item (question, source, title), whether both call it essential. From counts
    of runs, so no pair is made."""
    base = table(spark, d, "criteria").where("uid is not null and title is not null and category is not null")
    v = base.groupBy("rubric_source", "uid", "title", "run_name").agg((F.min("category") == "Essential").alias("e"))
    i = v.groupBy("rubric_source", "uid", "title").agg(F.count_if("e").alias("k"), F.count_if(~F.col("e")).alias("m"))
    k, m = F.col("k"), F.col("m")
    return i.groupBy("rubric_source").agg(F.sum(k * (k - 1) / 2).alias("n_both"), F.sum(m * (m - 1) / 2).alias("n_neither"), F.sum(k * m).alias("n_differ"))


_NN = f"""doc as (select criterion_id as id, uid, {S.content_tokens('body')} as ts from criteria where uid is not null), tf as (select id, uid, t, 1 + ln(count(*)) as tf from (select id, uid, unnest(ts) as t from doc) group by 1, 2, 3), df as (select t, count(*) as df from tf group by 1), nd as (select count(*) as nd from doc),
raw as (select id, uid, t, df, tf * (ln((1 + nd) / (1 + df)) + 1) as x from tf join df using (t), nd), vec as (select id, uid, t, df, x / sqrt(sum(x * x) over (partition by id)) as x from raw)"""


@query(f"""with {_NN}, s as (select a.id as id, b.id as other, sum(a.x * b.x) as s from vec a join vec b using (t) where a.id % 50 = 0 and a.uid <> b.uid group by 1, 2), k as (select *, row_number() over (partition by id order by round(s, 9) desc, other) as r from s)
select id as criterion_id, other, round(s, 5) as similarity from k where r = 1""")
def nearest_other_question(spark: SparkSession, d: str) -> DataFrame:
    """For every criterion whose id is divisible by 50: the most similar criterion of another question, by TF-IDF cosine over all rows.
    Vectors meet in blocks of inverted lists; the exact sum of products is the cosine."""
    doc = table(spark, d, "criteria").where("uid is not null").select("criterion_id", "uid", "body")
    best = similarity.nearest_documents(doc, F.col("criterion_id") % 50 == 0, "criterion_id", "uid", T.content_tokens(F.col("body")))
    return best.select(F.col("query").alias("criterion_id"), F.col("id").alias("other"), F.round("s", 5).alias("similarity"))


@query(f"""with q as (select * from {_Q}), qt as (select uid, unnest(list_distinct({S.content_tokens('question')})) as t from q), qn as (select uid, count(*) as n from qt group by 1),
c as (select criterion_id, uid, unnest(list_distinct({S.content_tokens('body')})) as t from criteria where criterion_id % 50 = 0 and uid in (select uid from q)), o as (select c.criterion_id, c.uid as own, qt.uid as cand, count(*) / sqrt(any_value(n)) as s from c join qt using (t) join qn on qn.uid = qt.uid group by 1, 2, 3),
m as (select criterion_id, max(case when cand = own then s end) as own_s from o group by 1) select o.criterion_id, cast(1 + sum(case when round(s, 9) > round(coalesce(own_s, 0), 9) and cand <> own then 1 else 0 end) as bigint) as rank_of_own from o join m using (criterion_id) group by 1""")
def attribution_rank(spark: SparkSession, d: str) -> DataFrame:
    """For every criterion whose id is divisible by 50: the rank of its own question among all, by shared content words over the root of
    the question's number of words. Its own question scores what it scores and so is never among those above."""
    q = questions(spark, d).select("uid", F.array_distinct(T.content_tokens(F.col("question"))).alias("qs"))
    c = table(spark, d, "criteria").where("criterion_id % 50 = 0").select("criterion_id", "uid", F.array_distinct(T.content_tokens(F.col("body"))).alias("ts"))
    bags = c.groupBy("criterion_id", "uid").agg(F.flatten(F.collect_list("ts")).alias("ts")).join(q, "uid")
    common = F.size(F.filter("ts", lambda t: F.array_contains("qs", t)))
    own = F.max(F.when(common > 0, common / F.sqrt(F.size("qs")))).over(Window.partitionBy("criterion_id"))
    asked = bags.select("criterion_id", "ts", F.coalesce(own, F.lit(0.0)).alias("own"))
    found = similarity.scored_above(q, "qs", asked, "criterion_id", "ts", "own")
    return found.select(F.col("id").alias("criterion_id"), (1 + F.col("above")).alias("rank_of_own"))


@query(f"""with {_CASE}, x as (select uid, domain, ln(greatest(chars_a, 1) / greatest(chars_b, 1)) as x from cases), n as (select a.uid, b.uid as other, row_number() over (partition by a.uid order by round(abs(a.x - b.x), 12), b.uid) as r from x a join x b on a.domain = b.domain and a.uid <> b.uid) select uid, other, cast(r as bigint) as rank from n where r <= 3""")
def nearest_by_length_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Three questions of the domain with the nearest log length ratio. The nearest three lie within three places in sorted order,
    so neighbours come from places in that order, not from a join of the domain with itself; ties at the border are kept in reach by id order."""
    x = preference_cases(spark, d).select("uid", "domain", F.log(F.greatest("chars_a", F.lit(1)) / F.greatest("chars_b", F.lit(1))).alias("x"))
    key = F.round("x", 12)
    # Of equal values only the three smallest ids can be among anyone's nearest three, besides the row itself.
    slim = x.withColumn("k", F.row_number().over(Window.partitionBy("domain", key).orderBy("uid"))).where("k <= 4")
    groups = slim.groupBy("domain", key.alias("v")).agg(F.array_sort(F.collect_list("uid")).alias("ids"))
    placed = ranking.running_totals(groups, ["domain"], [F.col("v")], F.lit(1)).drop("_total")
    around = placed.select("domain", F.col("v").alias("own"), F.explode(F.sequence(F.col("_before") - 3, F.col("_before") + 3)).alias("_before"))
    near = around.join(placed.select("domain", "_before", F.struct("v", "ids").alias("n")), ["domain", "_before"]).groupBy("domain", "own").agg(F.collect_list("n").alias("near"))
    c = x.withColumn("own", key).join(near, ["domain", "own"]).select("uid", "x", F.explode("near").alias("n")).select("uid", "x", F.col("n.v").alias("v"), F.explode("n.ids").alias("other")).where("uid != other")
    r = F.row_number().over(Window.partitionBy("uid").orderBy(F.round(F.abs(F.col("x") - F.col("v")), 11), "other"))
    return c.withColumn("rank", r.cast("long")).where("rank <= 3").select("uid", "other", "rank")


@query("""with d as (select distinct left(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 16) as h from documents where text is not null) select r.rollout_key from (select rollout_key, left(sha1(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 16) as h from rollouts) r join d using (h)""")
def answers_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Answers that stand verbatim, but for white space, as a document."""
    docs = table(spark, d, "documents").where("text is not null").select(T.digest(F.col("text")).alias("h"))
    return table(spark, d, "rollouts").select("rollout_key", T.digest(F.col("text")).alias("h")).join(docs, "h", "left_semi").select("rollout_key")


@query(f"with {_V}, s as (select answer, {_SHARES}, count(*) as n_items, sum(case when met then 1 else 0 end) as n_met from (select *, literally_true as met from v) group by 1) select count(*) as n, round(corr(score, score_unweighted), 6) as correlation, round(avg(abs(score - score_unweighted)), 6) as mean_difference, round(avg(score), 6) as macro, round(sum(n_met) / sum(n_items), 6) as micro from s")
def weighting_matters(spark: SparkSession, d: str) -> DataFrame:
    """How far weighted scores differ from uniform ones; macro mean and ratio of sums."""
    s = weighted_scores(verdicts(spark, d).withColumn("met", F.col("literally_true")), ["answer"])
    return s.agg(F.count(F.lit(1)).alias("n"), R6(ranking.correlation(F.col("score"), F.col("score_unweighted"))).alias("correlation"), R6(F.avg(F.abs(F.col("score") - F.col("score_unweighted")))).alias("mean_difference"), R6(F.avg("score")).alias("macro"), R6(F.sum("n_met") / F.sum("n_items")).alias("micro"))


@query(f"with {_LADDER} select uid, " + ", ".join(f"round(max(case when level = {k} then score end), 4) as score_{k}" for k in range(1, 6)) + " from o group by 1")
def ladder_wide(spark: SparkSession, d: str) -> DataFrame:
    p = ladder(spark, d).groupBy("uid").pivot("level", [1, 2, 3, 4, 5]).agg(F.round(F.first("score"), 4))
    return p.select("uid", *[F.col(str(k)).alias(f"score_{k}") for k in range(1, 6)])


@query(f"""with {_LADDER}, m as (select uid, avg(case when level <= 2 then score end) - avg(case when level > 2 then score end) as gap, sqrt((var_samp(case when level <= 2 then score end) + var_samp(case when level > 2 then score end)) / 2) as sd, avg(case when level = 2 then score end) - avg(case when level > 2 then score end) as gap_without_gold from o group by 1)
select count(gap) as n, round(avg(gap), 3) as mean_gap, round(avg(case when sd > 1e-9 then gap / sd end), 5) as mean_d, round(avg(gap_without_gold), 3) as mean_gap_without_gold from m""")
def good_bad_separation(spark: SparkSession, d: str) -> DataFrame:
    """Separation of good from bad levels, in units of the pooled deviation too, with and without the gold answer."""
    good, bad = F.when(F.col("level") <= 2, F.col("score")), F.when(F.col("level") > 2, F.col("score"))
    m = ladder(spark, d).groupBy("uid").agg((F.avg(good) - F.avg(bad)).alias("gap"), F.sqrt((F.var_samp(good) + F.var_samp(bad)) / 2).alias("sd"), (F.avg(F.when(F.col("level") == 2, F.col("score"))) - F.avg(bad)).alias("g2"))
    return m.agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 3).alias("mean_gap"), F.round(F.avg(F.when(F.col("sd") > 1e-9, F.col("gap") / F.col("sd"))), 5).alias("mean_d"), F.round(F.avg("g2"), 3).alias("mean_gap_without_gold"))


@query("select o_orderpriority as tier, o_orderstatus as source, count(*) as n, round(avg(o_totalprice), 3) as mean_score from orders group by 1, 2")
def tier_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean_score"))


@query("select domain, bucket, count(*) as n from (select domain, cast(least(greatest(floor((length(question) - 100) / 20.0) + 1, 0), 21) as bigint) as bucket from examples where question is not null) group by 1, 2")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Twenty equal bins between 100 and 500 characters, with one below and one above."""
    return table(spark, d, "examples").where("question is not null").groupBy("domain", F.width_bucket(F.length("question"), F.lit(100), F.lit(500), F.lit(20)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_GROUND} select cat, count(*) as n, round(avg(n_anchors), 6) as mean_anchors, round(avg(case when generic then 1.0 else 0.0 end), 6) as generic_rate from g group by 1")
def grounding_by_category(spark: SparkSession, d: str) -> DataFrame:
    return grounded_criteria(spark, d).groupBy("cat").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("n_anchors")).alias("mean_anchors"), R6(F.avg(F.col("generic").cast("int"))).alias("generic_rate"))


@query(f"""with {_GROUND}, b as (select uid, case when length(coalesce(reference_answer,'')) < 50 then 'short' when length(reference_answer) < 300 then 'middle' else 'long' end as bucket from q)
select bucket, count(*) as n, round(avg(case when generic then 1.0 else 0.0 end), 6) as generic_rate from g join b using (uid) group by 1""")
def grounding_by_reference_length(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(T.or_empty(F.col("reference_answer")))
    b = questions(spark, d).select("uid", F.when(n < 50, "short").when(n < 300, "middle").otherwise("long").alias("bucket"))
    return grounded_criteria(spark, d).join(b, "uid").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("generic").cast("int"))).alias("generic_rate"))


@query(f"""with {S.NORMALISED}, q as (select * from {_Q}), j as (select n.rubric_source, n.uid, list_filter({S.numbers('n.body')}, lambda x: length(x) >= 2) as a, {S.numbers('q.reference_answer')} as r, {S.numbers('q.question')} as s from n join q using (uid))
select rubric_source, count(*) as n, sum(case when len(list_filter(a, lambda x: list_contains(r, x) and not list_contains(s, x))) > 0 then 1 else 0 end) as n_leaking, count(distinct case when len(list_filter(a, lambda x: list_contains(r, x) and not list_contains(s, x))) > 0 then uid end) as n_questions from j group by 1""")
def leaked_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Criteria that give away a number of the reference answer that the question doesn't have."""
    q = questions(spark, d).select("uid", F.array_except(T.numbers(F.col("reference_answer")), T.numbers(F.col("question"))).alias("r"))
    j = criteria(spark, d).select("rubric_source", "uid", F.filter(T.numbers(F.col("body")), lambda x: F.length(x) >= 2).alias("a")).join(q, "uid").withColumn("leaks", F.arrays_overlap("a", "r"))
    return j.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaks").alias("n_leaking"), F.count_distinct(F.when(F.col("leaks"), F.col("uid"))).alias("n_questions"))


@query(f"""with k as (select rubric_source, uid, count(*) as k from criteria where uid is not null group by 1, 2), q as (select * from {_Q}), j as (select rubric_source, k, len({S.words('question')}) as w from k join q using (uid)),
r as (select *, rank() over (partition by rubric_source order by k) + (count(*) over (partition by rubric_source, k) - 1) / 2.0 as rk, rank() over (partition by rubric_source order by w) + (count(*) over (partition by rubric_source, w) - 1) / 2.0 as rw from j)
select rubric_source, count(*) as n, round(corr(k, w), 6) as pearson, round(corr(rk, rw), 6) as spearman from r group by 1""")
def items_by_question_length(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "criteria").where("uid is not null").groupBy("rubric_source", "uid").agg(F.count(F.lit(1)).alias("k"))
    j = k.join(questions(spark, d).select("uid", F.size(T.words(F.col("question"))).alias("w")), "uid")
    return ranking.correlations(j, ["rubric_source"], "k", "w").select("rubric_source", "n", R6("pearson").alias("pearson"), R6("spearman").alias("spearman"))


_SPLIT = f"""{_CASE}, s as (select domain, count(*) as size, row_number() over (order by domain) as i from cases group by 1), e as (select domain, size, floor(size * 0.25) as b, size * 0.25 - floor(size * 0.25) as f from s),
quota as (select domain, size, b + case when row_number() over (order by f desc, domain) <= floor((select sum(size) from s) * 0.25) - sum(b) over () then 1 else 0 end as quota from e),
half as (select uid, c.domain, case when row_number() over (partition by c.domain order by md5(concat('20:', uid)), uid) <= quota then 'dev' else 'holdout' end as half from cases c join quota using (domain))"""


@query(f"with {_SPLIT} select uid, half from half")
def dev_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """A frozen split: a quarter of each domain, quotas by largest remainder, members by hash."""
    c = preference_cases(spark, d).select("uid", "domain")
    sizes = c.groupBy("domain").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("n")).first().n or 0
    exact = F.col("size") * 0.25
    short = int(total * 0.25) - F.sum(F.floor(exact)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(exact - F.floor(exact)), "domain"))
    quota = sizes.select("domain", (F.floor(exact) + F.when(place <= short, 1).otherwise(0)).alias("quota"))
    return merging.positions(c, ["domain"], "uid", 20).join(F.broadcast(quota), "domain").select("uid", F.when(F.col("_i") < F.col("quota"), "dev").otherwise("holdout").alias("half"))


@query(f"with {_SPLIT} select domain, half, count(*) as n, round(count(*) / sum(count(*)) over (partition by half), 6) as share from half group by 1, 2")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    g = dev_holdout_split(spark, d).join(preference_cases(spark, d).select("uid", "domain"), "uid").groupBy("domain", "half").agg(F.count(F.lit(1)).alias("n"))
    return g.select("domain", "half", "n", R6(F.col("n") / F.sum("n").over(Window.partitionBy("half"))).alias("share"))


@query(f"with {_CASE}, r as (select domain, uid, row_number() over (partition by domain order by chars_a, uid) as k, count(*) over (partition by domain) as n from cases) select domain, uid from r where k = floor(n / 2) + 1")
def median_cases(spark: SparkSession, d: str) -> DataFrame:
    """The case of median length in each domain."""
    r = ranking.running_totals(preference_cases(spark, d).select("domain", "uid", "chars_a"), ["domain"], [F.col("chars_a"), F.col("uid")], F.lit(1))
    return r.where(F.col("_before") == F.floor(F.col("_total") / 2)).select("domain", "uid")


@query("""with v as (select uid, correct, count(*) as c from rollouts where uid is not null and correct is not null group by 1, 2), m as (select uid, arg_max(correct, c * 2 + case when correct then 0 else 1 end) as vote, max(case when correct then 1 else 0 end) as any_right from v group by 1)
select round(avg(case when vote then 1.0 else 0.0 end), 6) as majority, round(avg(any_right), 6) as any_right, count(*) as n from m""")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    """Majority of a question's answers (a tie counts as wrong) and whether any is right."""
    g = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid").agg(F.count_if("correct").alias("c"), F.count_if(~F.col("correct")).alias("w"))
    return g.agg(R6(F.avg((F.col("c") > F.col("w")).cast("int"))).alias("majority"), R6(F.avg((F.col("c") > 0).cast("int"))).alias("any_right"), F.count(F.lit(1)).alias("n"))


@query("""with r as (select uid, domain, max(case when correct then 1 else 0 end) as c, max(case when correct then 0 else 1 end) as w, count(*) as n from rollouts where uid is not null and correct is not null group by 1, 2), s as (select *, case when n < 2 then 'too few' when c = 1 and w = 1 then 'informative' when c = 1 then 'all right' else 'all wrong' end as status from r)
select domain, status, count(*) as n, min(uid) as first_uid from s group by 1, 2""")
def screening_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question's answers tell checklists apart."""
    r = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid", "domain").agg(F.count_if("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") < 2, "too few").when(F.col("c").between(1, F.col("n") - 1), "informative").when(F.col("c") > 0, "all right").otherwise("all wrong")
    return r.groupBy("domain", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid"))


_BEST = " union all ".join(f"select '{m}' as mode, l_suppkey as source, avg(case when {c} then 1.0 else 0.0 end) as margin from lineitem group by 2" for m, c in (("detected", "l_linestatus = 'F'"), ("inverted", "l_linestatus <> 'F'"), ("mixed", "(l_linestatus = 'F') = (l_linenumber > 2)")))


@query(f"select source, arg_max(mode, round(margin, 9) * 1000 - case mode when 'detected' then 0 when 'inverted' then 1e-7 else 2e-7 end) as best_mode, round(max(margin), 6) as margin from ({_BEST}) group by 1")
def best_convention(spark: SparkSession, d: str) -> DataFrame:
    """The convention with the largest margin for each source."""
    met = F.col("l_linestatus") == "F"
    modes = {"detected": met, "inverted": ~met, "mixed": met == (F.col("l_linenumber") > 2)}
    agg = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(*[F.avg(c.cast("int")).alias(m) for m, c in modes.items()])
    ranked = F.array(*[F.struct((-F.round(m, 9)).alias("o"), F.lit(i).alias("i"), F.lit(m).alias("mode"), F.col(m).alias("margin")) for i, m in enumerate(modes)])
    best = F.array_min(ranked)
    return agg.select("source", best["mode"].alias("best_mode"), R6(F.greatest(*modes)).alias("margin"))


_SIM = "('0x' || left(md5(concat_ws(':', '0', l_orderkey, l_linenumber, k)), 8))::ubigint % 2 = 0"


@query(f"""with {_V}, x as (select l_orderkey as answer, k, {S.scoring_weight("case l_returnflag when 'A' then 'Essential' when 'R' then 'Important' else 'Pitfall' end", 0.7)} as w, {_SIM} as met from lineitem, (select unnest(range(8)) as k) t),
s as (select answer, k, sum(case when met then w else 0 end) / sum(w) as a, avg(case when met then 1.0 else 0.0 end) as b from x group by 1, 2) select k as draw, count(*) as n, round(corr(a, b), 6) as correlation from s group by 1""")
def weight_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Eight draws of random outcomes (hash bits): correlation of weighted and plain means."""
    li = table(spark, d, "lineitem")
    cat = F.when(F.col("l_returnflag") == "A", "Essential").when(F.col("l_returnflag") == "R", "Important").otherwise("Pitfall")
    x = li.select("l_orderkey", "l_linenumber", T.scoring_weight(cat).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    bit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("0"), "l_orderkey", "l_linenumber", "k").cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 0
    s = x.withColumn("met", bit).groupBy("l_orderkey", "k").agg((F.sum(F.when(F.col("met"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("a"), F.avg(F.col("met").cast("int")).alias("b"))
    return s.groupBy(F.col("k").cast("long").alias("draw")).agg(F.count(F.lit(1)).alias("n"), R6(ranking.correlation(F.col("a"), F.col("b"))).alias("correlation"))


_GRAMS = " union all ".join(f"select {n} as n, rubric_source, len(list_intersect({S.ngrams('a', n)}, {S.ngrams('b', n)})) / greatest(len({S.ngrams('a', n)}), 1) as o from j where len(a) >= {n}" for n in (1, 2, 3))


@query(f"""with q as (select * from {_Q}), j as (select rubric_source, {S.content_tokens('body')} as a, {S.content_tokens('q.question')} as b from criteria join q using (uid) where criterion_id % 50 = 0 or true) select rubric_source, n, count(*) as n_criteria, round(avg(o), 6) as mean_overlap from ({_GRAMS}) group by 1, 2""".replace(" where criterion_id % 50 = 0 or true", ""))
def overlap_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim overlap of criteria with their question for runs of one to three content words."""
    q = questions(spark, d).select("uid", T.content_tokens(F.col("question")).alias("b"))
    j = table(spark, d, "criteria").select("uid", "rubric_source", T.content_tokens(F.col("body")).alias("a")).join(q, "uid")
    parts = F.array(*[F.when(F.size("a") >= n, F.struct(F.lit(n).alias("n"), T.containment(T.ngrams(F.col("a"), n), T.ngrams(F.col("b"), n)).alias("o"))) for n in (1, 2, 3)])
    x = j.select("rubric_source", F.explode(F.array_compact(parts)).alias("x")).select("rubric_source", "x.*")
    return x.groupBy("rubric_source", "n").agg(F.count(F.lit(1)).alias("n_criteria"), R6(F.avg("o")).alias("mean_overlap"))


_FIELD = "coalesce(json_extract_string(p, '$.{0}'), json_extract_string(p, '$.{1}'))"


@query(f"""select entry_id, case when p is null then '' else coalesce({_FIELD.format('title', 'Title')}, '') end as title, case when p is null then payload else {_FIELD.format('description', 'Description')} end as description
 from (select entry_id, payload, case when json_valid(payload) and not regexp_matches(payload, ',\\s*[}}\\]]') and json_type(payload) = 'OBJECT' then payload end as p from raw_entries)""")
def entry_items(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a nested array may be JSON texts; what isn't an object is a description without title."""
    v = F.try_parse_json("payload")
    # Spark's parser stops after the first value, so nothing may follow it.
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & F.endswith(T.strip(F.col("payload")), F.lit("}"))
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.try_variant_get(v, f"$.{k.title()}", "string"))
    is_object = F.coalesce(is_object, F.lit(False))
    return table(spark, d, "raw_entries").select("entry_id", F.when(is_object, F.coalesce(text("title"), F.lit(""))).otherwise("").alias("title"), F.when(is_object, text("description")).otherwise(F.col("payload")).alias("description"))


@query("select 'examples' as name, count(*) as n_rows, count(distinct uid) as n_uids from examples union all select 'criteria', count(*), count(distinct uid) from criteria union all select 'rollouts', count(*), count(distinct uid) from rollouts union all select 'documents', count(*), count(distinct uid) from documents")
def run_facts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("examples", "criteria", "rollouts", "documents"):
        part = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("uid").alias("n_uids"))
        out = part if out is None else out.unionByName(part)
    return out
