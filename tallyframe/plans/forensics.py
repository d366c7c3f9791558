"""Queries over criteria and questions: normalisation, forensic counts, boilerplate, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T
from tallyframe.operators import merging, ranking
from tallyframe.plans import sqltext as S
from tallyframe.plans.registry import query
from tallyframe.plans.views import criteria, questions
from tallyframe.session import cut, table

R6 = lambda c: F.round(c, 6)


@query(f"with {S.NORMALISED} select criterion_id, cat, body, w, method from n")
def criteria_normalised(spark: SparkSession, d: str) -> DataFrame:
    return criteria(spark, d).select("criterion_id", "cat", "body", "w", "method")


@query(f"""select criterion_id, raw, case when raw is null then 'MISSING' else coalesce({S.known('raw')}, 'MALFORMED') end as canonical, body, raw is not null as has_prefix from (
  select criterion_id, case when regexp_matches(coalesce(description,''), {S.lit(L.FORENSIC_PREFIX)}) then regexp_extract(description, {S.lit(L.FORENSIC_PREFIX)}, 1) end as raw,
  regexp_replace(coalesce(description,''), {S.lit(L.FORENSIC_PREFIX)}, '') as body from criteria)""")
def criteria_prefixes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "criteria").select("criterion_id", T.raw_category(F.col("description")).alias("raw"), T.prefix_body(F.col("description")).alias("body"))
    return c.select("criterion_id", "raw", T.canonical_category(F.col("raw")).alias("canonical"), "body", F.col("raw").isNotNull().alias("has_prefix"))


@query("""select uid, u.pos as pos, u.item.title as title, u.item.description as description, u.item.weight as weight from (
  select uid, unnest(list_transform(shipped_rubric.items, lambda x, i: {'pos': i - 1, 'item': x})) as u from examples where shipped_rubric is not null)""")
def shipped_criteria(spark: SparkSession, d: str) -> DataFrame:
    """The nested checklist of each question as rows."""
    ex = table(spark, d, "examples").where("shipped_rubric is not null").select("uid", F.posexplode("shipped_rubric.items").alias("pos", "item"))
    return ex.select("uid", "pos", "item.title", "item.description", "item.weight")


@query(f"""select domain, count(*) as n_criteria, count(distinct uid) as n_questions,
  sum(case when has_prefix then 1 else 0 end) as n_prefixed, round(avg(weight), 6) as mean_weight, sum(case when weight < 0 then 1 else 0 end) as n_negative,
  {', '.join(f"sum(case when regexp_matches(coalesce(body,''), {S.lit(p)}) then 1 else 0 end) as n_{k}" for k, p in L.MODALS.items())},
  sum(case when {S.contains_any('body', L.SUBJECTIVE_TERMS)} then 1 else 0 end) as n_subjective, sum(case when {S.contains_any('body', L.STYLE_TERMS)} then 1 else 0 end) as n_style,
  sum(case when {S.contains_any('body', L.NOT_SELF_CONTAINED)} then 1 else 0 end) as n_not_self_contained from criteria group by domain""")
def domain_profile(spark: SparkSession, d: str) -> DataFrame:
    """Compliance and verifiability counts of each domain in one wide aggregate."""
    body = F.col("body")
    return table(spark, d, "criteria").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_criteria"), F.count_distinct("uid").alias("n_questions"), F.count_if("has_prefix").alias("n_prefixed"), R6(F.avg("weight")).alias("mean_weight"),
        F.count_if(F.col("weight") < 0).alias("n_negative"), *[F.count_if(T.or_empty(body).rlike(p)).alias(f"n_{k}") for k, p in L.MODALS.items()],
        F.count_if(T.contains_any(body, L.SUBJECTIVE_TERMS)).alias("n_subjective"), F.count_if(T.contains_any(body, L.STYLE_TERMS)).alias("n_style"),
        F.count_if(T.contains_any(body, L.NOT_SELF_CONTAINED)).alias("n_not_self_contained"),
    )


@query("""select domain, split, n, mean, std, p25, median, p75, p95, lo, hi from (select domain, split, count(*) as n, round(avg(k), 6) as mean, round(stddev_samp(k), 6) as std, round(quantile_cont(k, 0.25), 6) as p25,
  round(quantile_cont(k, 0.5), 6) as median, round(quantile_cont(k, 0.75), 6) as p75, round(quantile_cont(k, 0.95), 6) as p95, min(k) as lo, max(k) as hi
  from (select domain, split, length(question) as k from examples where question is not null) group by 1, 2)""")
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "examples").where("question is not null").select("domain", "split", F.length("question").alias("k"))
    q = ranking.quantiles(k, ["domain", "split"], "k", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    sums = k.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("k")).alias("mean"), R6(F.stddev_samp("k")).alias("std"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return sums.join(q, ["domain", "split"]).select("domain", "split", "n", "mean", "std", *[R6(c).alias(c) for c in ("p25", "median", "p75", "p95")], "lo", "hi")


@query("""with c as (select rubric_source, weight, count(*) as n from criteria where weight is not null group by 1, 2), t as (select rubric_source, sum(n) as total, max(n) as top from c group by 1)
select rubric_source, round(-sum(n / total * log2(n / total)), 6) as entropy, round(max(top) / max(total), 6) as modal_share, count(*) as n_values from c join t using (rubric_source) group by 1""")
def weight_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy in bits and modal share of each source's weights: two levels of aggregation, no window over rows."""
    c = table(spark, d, "criteria").where("weight is not null").groupBy("rubric_source", "weight").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("rubric_source").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    p = F.col("n") / F.col("total")
    return c.join(t, "rubric_source").groupBy("rubric_source").agg(R6(-F.sum(p * F.log2(p))).alias("entropy"), R6(F.max("top") / F.max("total")).alias("modal_share"), F.count(F.lit(1)).alias("n_values"))


@query(f"""with {S.NORMALISED}, c as (select domain, cat, w, count(*) as n from n group by 1, 2, 3), m as (select domain, cat, sum(n) as nc from c group by 1, 2),
a as (select domain, w, sum(n) as nw from c group by 1, 2), t as (select domain, sum(n) as total from c group by 1)
select domain, round(sum(c.n / total * log2((c.n / total) / ((nc / total) * (nw / total)))), 6) as mutual_information, round(-sum(c.n / total * log2(c.n / nc)), 6) as weight_given_category
from c join m using (domain, cat) join a using (domain, w) join t using (domain) group by domain""")
def weight_information(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of category and weight, and what weights tell beyond the category."""
    c = criteria(spark, d).groupBy("domain", "cat", "w").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("domain", "cat").agg(F.sum("n").alias("nc"))
    a = c.groupBy("domain", "w").agg(F.sum("n").alias("nw"))
    t = c.groupBy("domain").agg(F.sum("n").alias("total"))
    x = c.join(m, ["domain", "cat"]).join(a, ["domain", "w"]).join(t, "domain")
    p, total = F.col("n") / F.col("total"), F.col("total")
    return x.groupBy("domain").agg(R6(F.sum(p * F.log2(p / ((F.col("nc") / total) * (F.col("nw") / total))))).alias("mutual_information"), R6(-F.sum(p * F.log2(F.col("n") / F.col("nc")))).alias("weight_given_category"))


@query(f"""with {S.NORMALISED} select domain, uid, rubric_source, run_name, round(sum(case when cat = 'Pitfall' then abs(w) else 0 end) / sum(abs(w)), 6) as pitfall_share,
  round(sum(case when {S.contains_any('body', L.SUBJECTIVE_TERMS)} then abs(w) else 0 end) / sum(abs(w)), 6) as subjective_share from n where uid is not null group by 1, 2, 3, 4""")
def reward_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each rubric's absolute weight."""
    mass = F.sum(F.abs("w"))
    part = lambda cond: R6(F.sum(F.when(cond, F.abs("w")).otherwise(0)) / mass)
    return criteria(spark, d).where("uid is not null").groupBy("domain", "uid", "rubric_source", "run_name").agg(part(F.col("cat") == "Pitfall").alias("pitfall_share"), part(T.contains_any(F.col("body"), L.SUBJECTIVE_TERMS)).alias("subjective_share"))


@query(f"""with {S.NORMALISED}, p as (select domain, uid, case when regexp_matches(body, {S.lit(L.FAILURE_PHRASING)}) then 'failure' when regexp_matches(body, {S.lit(L.AVOIDANCE_PHRASING)}) then 'avoidance' else 'other' end as phrasing from n where cat = 'Pitfall'),
q as (select domain, uid, bool_or(phrasing = 'failure') and bool_or(phrasing = 'avoidance') as mixed from p group by 1, 2)
select a.*, b.n_mixed from (select domain, sum(case when phrasing = 'failure' then 1 else 0 end) as n_failure, sum(case when phrasing = 'avoidance' then 1 else 0 end) as n_avoidance, sum(case when phrasing = 'other' then 1 else 0 end) as n_other from p group by 1) a
join (select domain, sum(case when mixed then 1 else 0 end) as n_mixed from q group by 1) b using (domain)""")
def pitfall_phrasing(spark: SparkSession, d: str) -> DataFrame:
    """How pitfalls are phrased (failure first), and questions that mix both ways."""
    p = criteria(spark, d).where("cat = 'Pitfall'").select("domain", "uid", T.forensic_phrasing(F.col("body")).alias("phrasing"))
    counts = p.groupBy("domain").agg(*[F.count_if(F.col("phrasing") == x).alias(f"n_{x}") for x in ("failure", "avoidance", "other")])
    q = p.groupBy("domain", "uid").agg((F.bool_or(F.col("phrasing") == "failure") & F.bool_or(F.col("phrasing") == "avoidance")).alias("mixed"))
    return counts.join(q.groupBy("domain").agg(F.count_if("mixed").alias("n_mixed")), "domain")


@query(f"""with t as (select {S.title('title')} as t, count(*) as c from criteria where {S.title('title')} <> '' group by 1)
select count(*) as n_distinct, sum(c) as n, {', '.join(f"sum(case when c >= {k} then c else 0 end) as n_reused_{k}" for k in (2, 5, 10, 50, 100, 500))} from t""")
def title_reuse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "criteria").select(T.normalised_title(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return t.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n"), *[F.sum(F.when(F.col("c") >= k, F.col("c")).otherwise(0)).alias(f"n_reused_{k}") for k in (2, 5, 10, 50, 100, 500)])


@query(f"select {S.title('title')} as t, count(*) as n, count(distinct uid) as n_questions from criteria where {S.title('title')} <> '' group by 1 order by n desc, t limit 50")
def top_title_values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "criteria").select(T.normalised_title(F.col("title")).alias("t"), "uid").where("t <> ''")
    return t.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_questions")).orderBy(F.desc("n"), "t").limit(50)


@query("""select opener, count(*) as n, count(distinct uid) as n_questions from (select uid, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(coalesce(body,'')), '\\s+'), lambda w: w <> ''), 1, 6), ' ') as opener from criteria)
 group by 1 order by n desc, opener limit 20""")
def top_openers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "criteria").select("uid", T.opener(F.col("body")).alias("opener"))
    return o.groupBy("opener").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_questions")).orderBy(F.desc("n"), "opener").limit(20)


_SQL_TEMPLATE = """list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(body,'')), '\\d+(?:[.,]\\d+)?', ' ' || chr(1) || ' ', 'g'), '[^a-z0-9\\s\\x01]', ' ', 'g'), '\\s+'), lambda t: t <> ''), lambda t: case when t = chr(1) then '<NUM>' else t end)"""


@query(f"""with b as (select criterion_id, uid, {_SQL_TEMPLATE} as ts from criteria), e as (select criterion_id, unnest(ts) as t, generate_subscripts(ts, 1) as i from b),
df as (select t, count(distinct criterion_id) as n from e group by 1), k as (select greatest(2, cast(floor(0.001 * count(*)) as bigint)) as cutoff from criteria),
m as (select criterion_id, string_agg(case when df.n < (select cutoff from k) and t <> '<NUM>' then '<X>' else t end, ' ' order by i) as template from e join df using (t) group by 1)
select template, count(*) as n, count(distinct uid) as n_questions from m join b using (criterion_id) group by 1 having count(*) >= 2""")
def templates(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with numbers and rare words masked, those used twice or more. The words that aren't rare are at most a thousand times the mean length
    of a body, whatever the rows, and are looked up in the row."""
    b = table(spark, d, "criteria").select("uid", T.template_tokens(F.col("body")).alias("ts"))
    cutoff = max(2, int(0.001 * b.count()))
    common = _frequent_tokens(b, cutoff)
    m = b.select("uid", F.array_join(F.transform("ts", lambda t: F.when(t.isin(*common, "<NUM>"), t).otherwise("<X>")), " ").alias("template")).where(F.size("ts") > 0)
    return m.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_questions")).where("n >= 2")


def _frequent_tokens(b: DataFrame, cutoff: int) -> list[str]:
    """The tokens that at least ``cutoff`` rows have, a share of all rows: no more than mean length over that share, so a list of them fits the plan."""
    df = b.select(F.explode(F.array_distinct("ts")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return [r.t for r in df.where(F.col("n") >= cutoff).select("t").collect()]


@query(f"""with b as (select criterion_id, {_SQL_TEMPLATE} as ts from criteria), e as (select criterion_id, unnest(ts) as t, generate_subscripts(ts, 1) as i from b),
df as (select t, count(distinct criterion_id) as n from e group by 1), k as (select cast(floor(0.02 * count(*)) as bigint) as cutoff from criteria),
m as (select criterion_id, string_agg(t, ' ' order by i) as skeleton from e join df using (t) where df.n >= (select cutoff from k) group by 1)
select skeleton, count(*) as n from m group by 1 order by n desc, skeleton limit 15""")
def top_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """What is left of bodies when only words of 2 % of all criteria or more are kept."""
    b = table(spark, d, "criteria").select(T.template_tokens(F.col("body")).alias("ts"))
    common = _frequent_tokens(b, int(0.02 * b.count()))
    kept = b.select(F.filter("ts", lambda t: t.isin(*common)).alias("k")).where(F.size("k") > 0).select(F.array_join("k", " ").alias("skeleton"))
    return kept.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skeleton").limit(15)


_Q = "(select uid, min(ex_id) as ex_id, arg_min(domain, ex_id) as domain, arg_min(split, ex_id) as split, arg_min(question, ex_id) as question, arg_min(reference_answer, ex_id) as reference_answer from examples where uid is not null group by 1)"
_ANCHORS = f"""q as (select * from {_Q}), tok as (select uid, domain, unnest(list_distinct({S.content_tokens("concat(coalesce(question,''), ' ', coalesce(reference_answer,''))")})) as t from q),
cut as (select domain, greatest(2, cast(floor(0.01 * count(*)) as bigint)) as cutoff from q group by 1),
rare as (select domain, t from tok group by 1, 2 having count(*) <= (select cutoff from cut where cut.domain = tok.domain)),
anch as (select uid, t from tok join rare using (domain, t) union select uid, x as t from (select uid, unnest({S.numbers("concat(coalesce(question,''), ' ', coalesce(reference_answer,''))")}) as x from q) where length(x) >= 2 or cast(x as double) > 2)"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """(uid, t): words and numbers that tie a criterion to its question: words that at most 1 % of the domain's questions
    (2 at least) have, and numbers of two digits or above two."""
    q = questions(spark, d)
    text = F.concat_ws(" ", T.or_empty(F.col("question")), T.or_empty(F.col("reference_answer")))
    tok = q.select("uid", "domain", F.explode(F.array_distinct(T.content_tokens(text))).alias("t"))
    cutoff = q.groupBy("domain").agg(F.greatest(F.lit(2), F.floor(0.01 * F.count(F.lit(1)))).alias("cutoff"))
    rare = tok.groupBy("domain", "t").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cutoff), "domain").where("n <= cutoff").select("domain", "t")
    number = q.select("uid", F.explode(T.numbers(text)).alias("t")).where((F.length("t") >= 2) | (F.col("t").cast("double") > 2))
    return tok.join(rare, ["domain", "t"], "left_semi").select("uid", "t").unionByName(number).distinct()


def anchor_lists(spark: SparkSession, d: str) -> DataFrame:
    """(uid, anchors) of every question: no more than its words, so a criterion is compared in its row."""
    lists = anchors(spark, d).groupBy("uid").agg(F.collect_list("t").alias("anchors"))
    return questions(spark, d).select("uid").join(lists, "uid", "left").select("uid", F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"))


@query(f"with {_ANCHORS} select uid, count(*) as n_anchors from anch group by 1")
def question_anchors(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n_anchors"))


@query(f"with {_ANCHORS} select domain, count(*) as n_rare from rare group by 1")
def rare_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    text = F.concat_ws(" ", T.or_empty(F.col("question")), T.or_empty(F.col("reference_answer")))
    tok = q.select("domain", F.explode(F.array_distinct(T.content_tokens(text))).alias("t")).groupBy("domain", "t").agg(F.count(F.lit(1)).alias("n"))
    cutoff = q.groupBy("domain").agg(F.greatest(F.lit(2), F.floor(0.01 * F.count(F.lit(1)))).alias("cutoff"))
    return tok.join(F.broadcast(cutoff), "domain").where("n <= cutoff").groupBy("domain").agg(F.count(F.lit(1)).alias("n_rare"))


_GROUND = f"""{S.NORMALISED}, {_ANCHORS}, ct as (select criterion_id, uid, unnest({S.criterion_tokens('body')}) as t from n),
hits as (select criterion_id, count(*) as n_anchors from ct join anch using (uid, t) group by 1),
reuse as (select rubric_source, domain, {S.title('title')} as nt, count(*) as reuse from n group by 1, 2, 3),
g as (select n.*, coalesce(n_anchors, 0) as n_anchors, coalesce(n_anchors, 0) = 0 as generic, {S.contains_any('body', L.SUBJECTIVE_TERMS)} as subjective, {S.contains_any('body', L.STYLE_TERMS)} as style, reuse
  from n left join hits using (criterion_id) join reuse on reuse.rubric_source = n.rubric_source and reuse.domain = n.domain and reuse.nt = {S.title('n.title')} where n.uid in (select uid from q))"""


def grounded_criteria(spark: SparkSession, d: str, lists: DataFrame | None = None) -> DataFrame:
    """Each criterion of a known question with its anchors found, whether it is generic, subjective or about style, and how often
    its title is used by its source and domain."""
    c = criteria(spark, d).withColumn("nt", T.normalised_title(F.col("title"))).join(anchor_lists(spark, d) if lists is None else lists, "uid")
    out = c.withColumn("n_anchors", F.size(F.array_intersect(T.criterion_tokens(F.col("body")), F.col("anchors")))).drop("anchors")
    all_titles = criteria(spark, d).select("rubric_source", "domain", T.normalised_title(F.col("title")).alias("nt"))
    reuse = all_titles.groupBy("rubric_source", "domain", "nt").agg(F.count(F.lit(1)).alias("reuse"))
    out = out.join(reuse, ["rubric_source", "domain", "nt"]).withColumn("generic", F.col("n_anchors") == 0)
    return out.withColumn("subjective", T.contains_any(F.col("body"), L.SUBJECTIVE_TERMS)).withColumn("style", T.contains_any(F.col("body"), L.STYLE_TERMS))


@query(f"with {_GROUND} select criterion_id, n_anchors, generic, n_anchors < 2 as weak, subjective, style, reuse, generic and reuse >= 10 as recyclable from g")
def criterion_grounding(spark: SparkSession, d: str) -> DataFrame:
    g = grounded_criteria(spark, d)
    return g.select("criterion_id", "n_anchors", "generic", (F.col("n_anchors") < 2).alias("weak"), "subjective", "style", "reuse", (F.col("generic") & (F.col("reuse") >= 10)).alias("recyclable"))


_POOLED = f"""count(*) as n_criteria, round(avg(case when generic then 1.0 else 0.0 end), 6) as generic_rate, round(avg(case when n_anchors < 2 then 1.0 else 0.0 end), 6) as weak_rate,
round(avg(case when generic and reuse >= 10 then 1.0 else 0.0 end), 6) as recyclable_rate, round(avg(case when subjective or style then 1.0 else 0.0 end), 6) as subjective_or_style_rate,
round(sum(case when generic then abs(w) else 0 end) / sum(abs(w)), 6) as generic_mass, round(sum(case when generic then {S.scoring_weight('cat', 0.5)} else 0 end) / sum({S.scoring_weight('cat', 0.5)}), 6) as generic_mass_remapped,
round(avg(n_anchors), 6) as mean_anchors, max(reuse) as max_title_reuse"""


def _pooled(g) -> DataFrame:
    rate = lambda c: R6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    paper = T.scoring_weight(F.col("cat"), L.DEFAULT_FORENSIC_WEIGHT)
    generic = F.col("generic")
    return g.agg(
        F.count(F.lit(1)).alias("n_criteria"), rate(generic).alias("generic_rate"), rate(F.col("n_anchors") < 2).alias("weak_rate"), rate(generic & (F.col("reuse") >= 10)).alias("recyclable_rate"),
        rate(F.col("subjective") | F.col("style")).alias("subjective_or_style_rate"), R6(F.sum(F.when(generic, F.abs("w")).otherwise(0)) / F.sum(F.abs("w"))).alias("generic_mass"),
        R6(F.sum(F.when(generic, paper).otherwise(0.0)) / F.sum(paper)).alias("generic_mass_remapped"), R6(F.avg("n_anchors")).alias("mean_anchors"), F.max("reuse").alias("max_title_reuse"),
    )


@query(f"with {_GROUND} select rubric_source, domain, {_POOLED} from g group by grouping sets ((rubric_source), (rubric_source, domain))")
def grounding_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pooled by source, and by source and domain, in one pass over grouping sets."""
    return _pooled(grounded_criteria(spark, d).groupingSets([["rubric_source"], ["rubric_source", "domain"]], "rubric_source", "domain")).select("rubric_source", "domain", "n_criteria", "generic_rate", "weak_rate", "recyclable_rate", "subjective_or_style_rate", "generic_mass", "generic_mass_remapped", "mean_anchors", "max_title_reuse")


@query(f"with {_GROUND} select uid, rubric_source, run_name, {_POOLED} from g group by 1, 2, 3")
def question_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(grounded_criteria(spark, d).groupBy("uid", "rubric_source", "run_name"))


@query(f"""with {_GROUND}, u as (select domain, uid, row_number() over (partition by domain order by md5(concat('0:', uid))) - 1 as i, count(*) over (partition by domain) as n from q where uid in (select uid from anch)),
o as (select a.uid, b.uid as other from u a join u b on a.domain = b.domain and b.i = (a.i + 1) % a.n where a.n > 1),
h2 as (select ct.criterion_id, count(*) as n_other from ct join o using (uid) join anch on anch.uid = o.other and anch.t = ct.t group by 1)
select rubric_source, round(avg(case when n_other is null then 1.0 else 0.0 end), 6) as generic_rate_permuted, round(avg(case when n_other is null then 1.0 else 0.0 end) - avg(case when generic then 1.0 else 0.0 end), 6) as specificity_lift
from g join o using (uid) left join h2 using (criterion_id) group by 1""")
def permuted_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Control: criteria against the anchors of another question of the domain, the next one in a seeded hash order."""
    lists = cut(anchor_lists(spark, d))
    q = questions(spark, d).select("domain", "uid").join(lists.where(F.size("anchors") > 0), "uid", "left_semi")
    o = merging.shift_partner(q, "domain", "uid", seed=0).withColumnRenamed("partner", "other")
    others = o.join(lists.select(F.col("uid").alias("other"), F.col("anchors").alias("foreign")), "other").select("uid", "foreign")
    g = grounded_criteria(spark, d, lists).join(others, "uid")
    apart = F.size(F.array_intersect(T.criterion_tokens(F.col("body")), F.col("foreign"))) == 0
    rate = F.avg(F.when(apart, 1.0).otherwise(0.0))
    return g.groupBy("rubric_source").agg(R6(rate).alias("generic_rate_permuted"), R6(rate - F.avg(F.when(F.col("generic"), 1.0).otherwise(0.0))).alias("specificity_lift"))


_TRI = f"""{S.NORMALISED}, q as (select * from {_Q}), j as (select n.criterion_id, n.rubric_source, n.domain, {S.ngrams(S.content_tokens('n.body'), 3)} as g, {S.ngrams(S.content_tokens('q.reference_answer'), 3)} as r,
 {S.ngrams(S.content_tokens('q.question'), 3)} as qq from n join q using (uid))"""


@query(f"""with {_TRI} select rubric_source, domain, count(*) as n, round(avg(o), 6) as mean_overlap, sum(case when o >= 0.5 then 1 else 0 end) as n_ge50, sum(case when o >= 0.3 then 1 else 0 end) as n_ge30
from (select rubric_source, domain, case when len(g) > 0 then len(list_intersect(g, r)) / len(g) else 0 end as o from j) group by 1, 2""")
def reference_coupling(spark: SparkSession, d: str) -> DataFrame:
    """How much of a criterion's trigrams of content words is copied from the reference answer."""
    q = questions(spark, d).select("uid", T.ngrams(T.content_tokens(F.col("reference_answer")), 3).alias("r"))
    j = criteria(spark, d).select("uid", "rubric_source", "domain", T.ngrams(T.content_tokens(F.col("body")), 3).alias("g")).join(q, "uid")
    j = j.withColumn("o", T.containment(F.col("g"), F.col("r")))
    return j.groupBy("rubric_source", "domain").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("o")).alias("mean_overlap"), F.count_if(F.col("o") >= 0.5).alias("n_ge50"), F.count_if(F.col("o") >= 0.3).alias("n_ge30"))


@query("""select domain, count(*) as n_rows, count(distinct question) as n_distinct, count(*) - count(distinct question) as n_repeated,
 (select count(*) from (select distinct question from examples e where e.split = 'test' and e.domain = x.domain) t where question in (select question from examples e2 where e2.split = 'train')) as n_test_in_train from examples x group by domain""")
def question_duplicates(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "examples").select("domain", "split", "question")
    base = ex.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("question").alias("n_distinct"))
    leaked = ex.where("split = 'test' and question is not null").select("domain", "question").distinct().join(ex.where("split = 'train'").select("question"), "question", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("n_test_in_train"))
    out = base.join(leaked, "domain", "left").withColumn("n_repeated", F.col("n_rows") - F.col("n_distinct"))
    return out.withColumn("n_test_in_train", F.coalesce("n_test_in_train", F.lit(0)))


@query("select uid, concat(left(replace(domain, 'rar_', ''), 3), '-', left(sha1(concat(domain, chr(0), coalesce(question,''), chr(0), coalesce(reference_answer,''))), 12)) as computed, ex_id from examples")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "examples")
    return ex.select("uid", T.content_uid(F.col("domain"), F.col("question"), F.col("reference_answer")).alias("computed"), "ex_id")


@query(f"select criterion_id, {S.title('title')} as norm_title, len({S.words('title')}) as title_words, len({S.content_tokens('body')}) as n_content, len({S.ngrams(S.content_tokens('body'), 3)}) as n_trigrams, len({S.numbers('body')}) as n_numbers from criteria")
def criterion_tokens(spark: SparkSession, d: str) -> DataFrame:
    c, body = table(spark, d, "criteria"), F.col("body")
    return c.select("criterion_id", T.normalised_title(F.col("title")).alias("norm_title"), F.size(T.words(F.col("title"))).alias("title_words"), F.size(T.content_tokens(body)).alias("n_content"), F.size(T.ngrams(T.content_tokens(body), 3)).alias("n_trigrams"), F.size(T.numbers(body)).alias("n_numbers"))
