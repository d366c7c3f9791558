"""Reports: rewritten criteria, claims and transfer, pairwise tests, refusals, contrasts of checklist metrics, word controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import exact, rewriting
from tallyframe.functions import text as T
from tallyframe.operators import merging, paired, ranking
from tallyframe.plans import extended  # noqa: F401  (its queries are among FAMILIES)
from tallyframe.plans import sqltext as S
from tallyframe.plans.checklists import _TILT, _tilt
from tallyframe.plans.evaluation import BOOT, _means_sql, _tests_sql, _units_sql, paired_summary, rounded_tests
from tallyframe.plans.forensics import _Q, R6
from tallyframe.plans.lint import rubric_lint
from tallyframe.plans.registry import QUERIES, SQL, query
from tallyframe.plans.views import criteria, questions
from tallyframe.session import table


@query()
def rewritten_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criteria in positive and plain form, with what was wrong."""
    c, cat, text = criteria(spark, d), F.col("cat"), F.col("description")
    return c.select("criterion_id", rewriting.polarity_offence(text, cat).alias("offence"), rewriting.positive_form(text, cat).alias("positive"), rewriting.plain_form(text).alias("plain"), rewriting.subjective_hits(F.col("body")).alias("hits"), rewriting.derived_title(F.col("body")).alias("derived_title"))


@query(f"with {S.NORMALISED} select cat, case when method = 'failure' then 'failure' when cat <> 'Pitfall' and regexp_matches(body, {S.lit(rewriting.OMISSION)}) then 'failure' end as offence, count(*) as n from n group by 1, 2")
def polarity_offences(spark: SparkSession, d: str) -> DataFrame:
    return criteria(spark, d).groupBy("cat", rewriting.polarity_offence(F.col("description"), F.col("cat")).alias("offence")).agg(F.count(F.lit(1)).alias("n"))


_CLAIMS = f"""q as (select * from {_Q}), s as (select uid, unnest(string_split(regexp_replace(coalesce(reference_answer, ''), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))) as claim from q),
claims as (select uid, row_number() over (partition by uid order by claim) as i, list_distinct({S.content_tokens('claim')}) as ct from (select distinct uid, claim from s) where len({S.content_tokens('claim')}) > 0)"""


@query(f"""with {_CLAIMS}, c as (select run_name, rubric_source, uid, list_distinct({S.content_tokens('body')}) as bt from criteria where uid is not null), m as (select run_name, rubric_source, uid, i, max(len(list_intersect(ct, bt)) / len(ct)) as best from claims join c using (uid) group by 1, 2, 3, 4)
select run_name, rubric_source, uid, count(*) as n_claims, sum(case when best >= 0.3 then 1 else 0 end) as n_recalled, round(avg(best), 6) as mean_best from m group by 1, 2, 3""")
def claim_recall(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the reference answer as claims: how many a rubric's criteria recall (30 % of a claim's content words)."""
    s = questions(spark, d).select("uid", F.explode(F.array_distinct(F.split(T.or_empty(F.col("reference_answer")), r"(?<=[.!?])\s+"))).alias("claim"))
    claims = s.select("uid", F.hash("claim").alias("i"), "claim", F.array_distinct(T.content_tokens(F.col("claim"))).alias("ct")).where(F.size("ct") > 0)
    c = table(spark, d, "criteria").where("uid is not null").select("run_name", "rubric_source", "uid", F.array_distinct(T.content_tokens(F.col("body"))).alias("bt"))
    m = claims.join(c, "uid").groupBy("run_name", "rubric_source", "uid", "claim").agg(F.max(F.size(F.array_intersect("ct", "bt")) / F.size("ct")).alias("best"))
    return m.groupBy("run_name", "rubric_source", "uid").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("best") >= 0.3).alias("n_recalled"), R6(F.avg("best")).alias("mean_best"))


_PARTNER = "u as (select domain, uid, row_number() over (partition by domain order by md5(concat('9:', uid)), uid) - 1 as i, count(*) over (partition by domain) as n from q), o as (select a.uid, b.uid as other from u a join u b on a.domain = b.domain and b.i = (a.i + 1) % a.n where a.uid <> b.uid)"


@query(f"""with q as (select * from {_Q}), {_PARTNER}, w as (select uid, {S.content_tokens('question')} as ts from q), j as (select c.rubric_source, list_distinct({S.content_tokens('c.body')}) as bt, a.ts as own, b.ts as foreign_ts from criteria c join o using (uid) join w a on a.uid = c.uid join w b on b.uid = o.other),
p as (select rubric_source, len(list_intersect(bt, own)) / len(bt) >= 0.1 as passes_own, len(list_intersect(bt, foreign_ts)) / len(bt) >= 0.1 as passes_other from j where len(bt) > 0)
select rubric_source, count(*) as n, round(avg(case when passes_own then 1.0 else 0.0 end), 6) as same_question_rate, round(avg(case when passes_other then 1.0 else 0.0 end), 6) as cross_rate, round(avg(case when passes_own then 1.0 else 0.0 end) - avg(case when passes_other then 1.0 else 0.0 end), 6) as specificity_gap,
 round(avg(case when passes_own and passes_other then 1.0 else 0.0 end), 6) as boilerplate_fraction, round(avg(case when passes_own and not passes_other then 1.0 else 0.0 end), 6) as specific_fraction from p group by 1""")
def transfer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Whether criteria fit their own question and another one of the domain (a tenth of their content words)."""
    q = questions(spark, d).select("uid", "domain", T.content_tokens(F.col("question")).alias("ts"))
    o = merging.shift_partner(q.select("domain", "uid"), "domain", "uid", seed=9)
    own, other = q.select("uid", F.col("ts").alias("own")), q.select(F.col("uid").alias("partner"), F.col("ts").alias("foreign"))
    j = table(spark, d, "criteria").select("uid", "rubric_source", F.array_distinct(T.content_tokens(F.col("body"))).alias("bt")).where(F.size("bt") > 0).join(o, "uid").join(own, "uid").join(other, "partner")
    p = j.select("rubric_source", (T.containment(F.col("bt"), F.col("own")) >= 0.1).alias("a"), (T.containment(F.col("bt"), F.col("foreign")) >= 0.1).alias("b"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a, b = F.col("a"), F.col("b")
    return p.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(share(a)).alias("same_question_rate"), R6(share(b)).alias("cross_rate"), R6(share(a) - share(b)).alias("specificity_gap"), R6(share(a & b)).alias("boilerplate_fraction"), R6(share(a & ~b)).alias("specific_fraction"))


_PAIRS = """k as (select uid, setting, arg_min(correct, rollout_key) as c from rollouts where uid is not null and correct is not null group by 1, 2), p as (select a.setting as setting_a, b.setting as setting_b, count(*) as n, sum(case when a.c and not b.c then 1 else 0 end) as n10, sum(case when b.c and not a.c then 1 else 0 end) as n01 from k a join k b using (uid) where a.setting < b.setting group by 1, 2),
t as (select *, case when n10 + n01 = 0 then 1 else least(1.0, 2 * list_sum(list_transform(range(0, cast(least(n10, n01) + 1 as bigint)), lambda i: exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))))) end as p from p), r as (select *, row_number() over (order by p, setting_a, setting_b) as k, count(*) over () as m from t)"""


@query(f"with {_PAIRS} select setting_a, setting_b, n, n10, n01, round(p, 6) as p, round(least(1.0, min(p * m / k) over (order by p desc range between unbounded preceding and current row)), 6) as q from r")
def pairwise_settings(spark: SparkSession, d: str) -> DataFrame:
    """McNemar's exact test for every pair of settings on common questions, adjusted as one family."""
    k = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid", "setting").agg(F.min_by("correct", "rollout_key").alias("c"))
    a, b = k.select("uid", F.col("setting").alias("setting_a"), F.col("c").alias("x")), k.select("uid", F.col("setting").alias("setting_b"), F.col("c").alias("y"))
    x, y = F.col("x"), F.col("y")
    p = a.join(b, "uid").where("setting_a < setting_b").groupBy("setting_a", "setting_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(x & ~y).alias("n10"), F.count_if(y & ~x).alias("n01"))
    t = p.withColumn("p", exact.mcnemar_p_column(F.col("n01"), F.col("n10"))).withColumn("f", F.lit(1))
    return ranking.bh_adjusted(t, ["f"], "p").select("setting_a", "setting_b", "n", "n10", "n01", R6("p").alias("p"), R6("q").alias("q"))


# How a refusal begins, and words of restraint.
REFUSAL = (
    r"""(?i)^\s*["']?\s*(i'?m sorry|i am sorry|sorry,|i cannot|i can'?t|i won'?t|i will not|i must (clarify|decline|point out)|i'?m not able|i am not able|i'?m unable|i am unable"""
    r"""|i do not|i don'?t (feel )?(comfortable|think)|as an ai|i'?m an ai|unfortunately, i|i apolog|i'?m not (going to|supposed to)|i am not supposed to|i'?d rather not|this request|i'?m afraid)"""
)
RESTRAINT = (
    r"(?i)\b(avoid|avoids|avoiding|without|refrain|refrains|refuse|refuses|refusing|refusal|decline|declines|declining|withhold|withholds|withholding|does not|do not|doesn't"
    r"|don't|never|abstain|abstains|omit|omits|omitting|exclude|excludes|excluding|free of|free from|no |not )"
)


@query(f"select setting, count(*) as n, sum(case when regexp_matches(left(trim(coalesce(text,'')), 200), {S.lit(REFUSAL)}) then 1 else 0 end) as n_refusals, sum(case when correct and regexp_matches(left(trim(coalesce(text,'')), 200), {S.lit(REFUSAL)}) then 1 else 0 end) as n_right_refusals from rollouts group by 1")
def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answers that begin as a refusal."""
    refuses = F.substring(F.trim(T.or_empty(F.col("text"))), 1, 200).rlike(REFUSAL)
    return table(spark, d, "rollouts").groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.count_if(refuses).alias("n_refusals"), F.count_if(F.coalesce("correct", F.lit(False)) & refuses).alias("n_right_refusals"))


@query(f"select rubric_source, domain, count(*) as n, sum(case when regexp_matches(coalesce(body,''), {S.lit(RESTRAINT)}) then 1 else 0 end) as n_restraint from criteria group by 1, 2")
def restraint_rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "criteria").groupBy("rubric_source", "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.or_empty(F.col("body")).rlike(RESTRAINT)).alias("n_restraint"))


METRICS = ["compliance_rate", "negative_weight_rate", "pitfall_fraction", "unclassified_rate", "weight_band_rate", "n_items"]


_LONG = "lg as (select run_name || '|' || uid as key, rubric_source, x.m as metric, x.v as v from (select run_name, uid, rubric_source, unnest([" + ", ".join(f"{{'m': '{m}', 'v': cast({m} as double)}}" for m in METRICS) + "]) as x from rl))"


@query(f"""with rl as ({SQL['rubric_lint']}), {_LONG}, df as (select a.metric || '#' || a.rubric_source || ' - ' || b.rubric_source as gg, a.key, round(a.v - b.v, 9) as d from lg a join lg b on a.key = b.key and a.metric = b.metric where a.rubric_source < b.rubric_source and a.v is not null and b.v is not null),
{_units_sql("select gg, key, d from df", "gg", "key", "count(*) as n, sum(d) as s")}, {_tests_sql('gg')}, sp as (select *, split_part(g, '#', 1) as metric, split_part(g, '#', 2) as contrast from res), rk as (select *, row_number() over (partition by contrast order by p, metric) as rn, count(*) over (partition by contrast) as m from sp)
select contrast, metric, cast(n as bigint) as n, round(mean, 5) as mean, round(se, 5) as se, round(lo, 5) as ci_low, round(hi, 5) as ci_high, round(p, 6) as p, round(least(1.0, min(p * m / rn) over (partition by contrast order by p desc range between unbounded preceding and current row)), 6) as q from rk""")
def metric_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Checklist metrics of each pair of sources on common questions of a run: unpivoted to one table, then one grouped job with interval,
    permutation p and q over each pair's family."""
    wide = rubric_lint(spark, d)
    long = wide.select(F.concat_ws("|", "run_name", "uid").alias("key"), "rubric_source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("m")).select("key", "rubric_source", "m.*")
    b = long.select("key", "metric", F.col("rubric_source").alias("source_b"), F.col("value").alias("v"))
    diffs = long.join(b, ["key", "metric"]).where("rubric_source < source_b").select("metric", F.concat("rubric_source", F.lit(" - "), "source_b").alias("contrast"), "key", F.round(F.col("value") - F.col("v"), 9).alias("d"))
    return rounded_tests(ranking.bh_adjusted(paired_summary(diffs, ["contrast", "metric"], ["key"]), ["contrast"], "p"))


#: Metrics by family: the query whose rows hold them, one for each rubric (run, source, question).
FAMILIES = {
    "lint": ("rubric_lint", ["compliance_rate", "negative_weight_rate", "pitfall_fraction", "unclassified_rate", "weight_band_rate", "n_items"]),
    "grounding": ("question_grounding", ["generic_rate", "weak_rate", "recyclable_rate", "subjective_or_style_rate", "generic_mass", "generic_mass_remapped", "mean_anchors", "max_title_reuse"]),
    "weights": ("weight_profile", ["entropy", "normalised", "max_share"]),
    "mass": ("category_mass", ["positive_weight", "mass_essential", "mass_important", "mass_optional", "mass_pitfall"]),
    "mirrors": ("pitfall_mirrors", ["n_mirrors", "max_similarity"]),
    "order": ("weight_order", ["n_pairs", "n_violations"]),
    "claims": ("claim_recall", ["n_claims", "n_recalled", "mean_best"]),
    "parts": ("part_coverage", ["n_parts", "n_orphans", "mean_best"]),
}


def _family_sql() -> str:
    parts = [f"select '{f}' as family, run_name || '|' || uid as key, rubric_source, x.m as metric, x.v as v from (select run_name, uid, rubric_source, unnest([" + ", ".join(f"{{'m': '{m}', 'v': cast({m} as double)}}" for m in metrics) + f"]) as x from ({SQL[name]})) t{i}" for i, (f, (name, metrics)) in enumerate(FAMILIES.items())]
    return f"fm as materialized (select * from ({' union all '.join(parts)}) where v is not null and isfinite(v))"


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """(family, metric, key, rubric_source, value) of every metric of every family."""
    out = None
    for family, (name, metrics) in FAMILIES.items():
        values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
        part = QUERIES[name](spark, d).select(F.lit(family).alias("family"), F.concat_ws("|", "run_name", "uid").alias("key"), "rubric_source", values).select("family", "key", "rubric_source", "x.*")
        out = part if out is None else out.unionByName(part)
    return out.where("value is not null")


@query(f"""with recursive {_family_sql()}, {_units_sql("select family || '#' || metric || '#' || rubric_source as gg, key, round(v, 9) as v from fm", "gg", "key", "count(*) as n, sum(v) as s")}, {_means_sql('bm', BOOT, 0)}, bi as (select g, stddev_samp(m) as se, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by 1), tt as (select g, sum(n) as n, sum(s) / sum(n) as mean, count(*) as k from u group by 1)
select split_part(g, '#', 1) as family, split_part(g, '#', 2) as metric, split_part(g, '#', 3) as rubric_source, cast(n as bigint) as n, round(mean, 4) as mean, round(case when k > 1 then se end, 4) as se, round(case when k > 1 then lo end, 4) as ci_low, round(case when k > 1 then hi end, 4) as ci_high from tt join bi using (g)""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and bootstrap interval of every metric by source."""
    rows = metric_rows(spark, d).withColumn("value", F.round("value", 9))
    out = paired.mean_intervals(rows, ["family", "metric", "rubric_source"], "value", ["key"], BOOT)
    return out.select("family", "metric", "rubric_source", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "se", "ci_low", "ci_high")])


REFERENCE = "shipped"


@query(f"""with recursive {_family_sql()}, df as (select a.family || '#' || a.metric || '#' || a.rubric_source as gg, a.key, round(a.v - b.v, 9) as d from fm a join fm b on a.family = b.family and a.metric = b.metric and a.key = b.key where a.rubric_source <> '{REFERENCE}' and b.rubric_source = '{REFERENCE}'),
{_units_sql("select gg, key, d from df", "gg", "key", "count(*) as n, sum(d) as s")}, {_tests_sql('gg')}, sp as (select *, split_part(g, '#', 1) as family, split_part(g, '#', 2) as metric, split_part(g, '#', 3) as source from res), rk as (select *, row_number() over (partition by source order by p, family, metric) as rn, count(*) over (partition by source) as m from sp)
select family, metric, source, cast(n as bigint) as n, round(mean, 4) as mean, round(p, 4) as p, round(least(1.0, min(p * m / rn) over (partition by source order by p desc range between unbounded preceding and current row)), 4) as q from rk""")
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every family: each source against the reference source on common questions of a run, with permutation p and q over a
    source's whole family."""
    rows = metric_rows(spark, d)
    base = rows.where(F.col("rubric_source") == REFERENCE).select("family", "metric", "key", F.col("value").alias("b"))
    diffs = rows.where(F.col("rubric_source") != REFERENCE).join(base, ["family", "metric", "key"]).select("family", "metric", F.col("rubric_source").alias("source"), "key", F.round(F.col("value") - F.col("b"), 9).alias("d"))
    t = ranking.bh_adjusted(paired_summary(diffs, ["family", "metric", "source"], ["key"]), ["source"], "p")
    return t.select("family", "metric", "source", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "p", "q")])


_DID = "c as (select user_id, event_type, arg_min(value, event_id) as value from events where isfinite(value) group by 1, 2), w as (select user_id, max(case when event_type = 'click' then value end) - max(case when event_type = 'view' then value end) as a, max(case when event_type = 'purchase' then value end) - max(case when event_type = 'error' then value end) as b from c group by 1)"


@query(f"with {_DID} select count(*) as n, round(avg(a - b), 5) as did, round(stddev_samp(a - b) / sqrt(count(*)), 5) as se from w where a is not null and b is not null")
def difference_in_differences(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two paired contrasts on the keys that have all four values."""
    t = paired.paired_table(table(spark, d, "events"), "user_id", "event_type", "value", ["click", "view", "purchase", "error"], ["event_id"])
    x = (F.col("click") - F.col("view")) - (F.col("purchase") - F.col("error"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 5).alias("did"), F.round(F.stddev_samp(x) / F.sqrt(F.count(F.lit(1))), 5).alias("se"))


_NULL = f"""{_TILT.replace('tf, case', 't, tf, case')}, df as (select t, count(*) as df from (select rollout_key, unnest(list_distinct({S.content_tokens('text')})) as t from rollouts where text is not null) group by 1), m as (select count(*) as m from rollouts where text is not null),
band as (select t, cast(floor(log2(df / m)) as integer) as band, row_number() over (partition by cast(floor(log2(df / m)) as integer) order by md5(t), t) - 1 as i, count(*) over (partition by cast(floor(log2(df / m)) as integer)) as k from df, m),
draw as (select n.rubric_source, n.uid, b.band, ('0x' || left(md5(concat_ws(':', '1', r, n.rubric_source, n.uid, n.t)), 8))::ubigint % b.k as i from n join band b using (t), (select unnest(range(5)) as r) x),
hit as (select d.rubric_source, d.uid, case when list_contains(win, b.t) then 1 else 0 end - case when list_contains(lose, b.t) then 1 else 0 end as h from draw d join band b on b.band = d.band and b.i = d.i join w using (uid))"""


@query(f"with {_NULL} select rubric_source, count(*) as n, round(avg(h), 6) as null_tilt from hit group by 1")
def random_word_tilt(spark: SparkSession, d: str) -> DataFrame:
    """Control of the word tilt: five random words of the same band of document frequency for each word, drawn by hash."""
    texts = table(spark, d, "rollouts").where("text is not null")
    df = texts.select(F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    band = F.floor(F.log2(F.col("df") / texts.count())).cast("int")
    w = Window.partitionBy("band")
    bands = df.select("t", band.alias("band")).withColumn("i", F.row_number().over(w.orderBy(F.md5(F.col("t").cast("binary")), "t")) - 1).withColumn("k", F.count(F.lit(1)).over(w))
    n = _tilt(spark, d).select("rubric_source", "uid", "t", F.explode(F.array(*[F.lit(r) for r in range(5)])).alias("r")).join(bands.select("t", "band", "k"), "t")
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("1"), "r", "rubric_source", "uid", "t").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("k")
    drawn = n.select("rubric_source", "uid", "band", number.alias("i")).join(bands.select("band", "i", "t"), ["band", "i"])
    answers = texts.where("uid is not null").groupBy("uid").agg(F.min_by("text", F.when(F.col("correct"), F.col("rollout_key"))).alias("win"), F.min_by("text", F.when(~F.col("correct"), F.col("rollout_key"))).alias("lose"))
    answers = answers.select("uid", F.array_distinct(T.content_tokens(F.col("win"))).alias("win"), F.array_distinct(T.content_tokens(F.col("lose"))).alias("lose"))
    h = drawn.join(answers, "uid").select("rubric_source", (F.array_contains("win", F.col("t")).cast("int") - F.array_contains("lose", F.col("t")).cast("int")).alias("h"))
    return h.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("h")).alias("null_tilt"))
