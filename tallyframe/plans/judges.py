"""Two judges, labels, slot orders and weighted votes.

No table holds verdicts of two judges, so these run on tables of the same shape: an order is an answer to the question of its
customer, its status the source, its priority the level, its lines the criteria; line status, return flag and line number give three
readings of each criterion (first judge, second judge, the first one again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import exact
from tallyframe.operators import agreement, ranking
from tallyframe.plans.evaluation import _CASE, R6, preference_cases
from tallyframe.plans.registry import query
from tallyframe.session import cut, table

_READ = "rd as (select o_orderkey as answer, o_custkey as uid, o_orderstatus as source, cast(left(o_orderpriority, 1) as integer) as level, l_linenumber as item, l_quantity as w, l_linestatus = 'F' as a, l_returnflag <> 'N' as b, l_linenumber % 2 = 0 as c from lineitem join orders on l_orderkey = o_orderkey)"
_CELLS = _READ + ", cells as (select uid, source, level, " + ", ".join(f"sum(case when {r} then w else 0 end) / sum(w) as s_{r}, avg(case when {r} then 1.0 else 0.0 end) as p_{r}" for r in "abc") + ", count(*) as n from rd group by 1, 2, 3)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer"), F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("w"), (F.col("l_linestatus") == "F").alias("a"), (F.col("l_returnflag") != "N").alias("b"), (F.col("l_linenumber") % 2 == 0).alias("c"))
    return li.join(o, "answer")


def score_cells(spark: SparkSession, d: str) -> DataFrame:
    """(uid, source, level, s_a, p_a ..., n): weighted score and pass rate of each reading."""
    parts = [x for r in "abc" for x in ((F.sum(F.when(F.col(r), F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"s_{r}"), F.avg(F.col(r).cast("int")).alias(f"p_{r}"))]
    return readings(spark, d).groupBy("uid", "source", "level").agg(*parts, F.count(F.lit(1)).alias("n"))


@query(f"with {_CELLS} select uid, source, level, round(s_a, 6) as score, round(p_a, 6) as pass_rate from cells where n >= 2")
def usable_cells(spark: SparkSession, d: str) -> DataFrame:
    return score_cells(spark, d).where("n >= 2").select("uid", "source", "level", R6("s_a").alias("score"), R6("p_a").alias("pass_rate"))


def _vector_sql(second: str, family: str) -> str:
    y = second
    return f"""select '{family}' as family, v.*, r.rank_agreement from (select uid, source, count(*) as n, avg(abs(s_{y} - s_a)) as abs_diff, avg(s_{y} - s_a) as signed_diff, avg(abs(p_a - p_{y})) as pass_disagreement from cells group by 1, 2 having count(*) >= 2) v
 left join (select p.uid, p.source, avg(case when sign(p.s_a - q.s_a) = sign(p.s_{y} - q.s_{y}) then 1.0 when sign(p.s_a - q.s_a) = 0 or sign(p.s_{y} - q.s_{y}) = 0 then 0.5 else 0.0 end) as rank_agreement from cells p join cells q on p.uid = q.uid and p.source = q.source and p.level < q.level group by 1, 2) r
 on r.uid = v.uid and r.source = v.source"""


_VECTORS = f"{_CELLS}, two as ({_vector_sql('b', 'cross')} union all {_vector_sql('c', 'retest')}), vectors as (select * from two union all select 'gap', x.uid, x.source, x.n, " + ", ".join(f"x.{m} - y.{m}" for m in ("abs_diff", "signed_diff", "pass_disagreement", "rank_agreement")) + " from two x join two y on x.uid = y.uid and x.source = y.source where x.family = 'cross' and y.family = 'retest')"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(family, uid, source, n, VECTOR...): the second judge and the first one's repeat against the first, and the gap between the two."""
    cells = score_cells(spark, d)
    keys = ["uid", "source"]
    cross, retest = [agreement.question_vectors(cells, keys, "level", "s_a", f"s_{r}", "p_a", f"p_{r}").drop("pearson") for r in "bc"]
    other = retest.select(*keys, *[F.col(m).alias(f"_{m}") for m in agreement.VECTOR])
    gap = cross.join(other, keys).select(F.lit("gap").alias("family"), *keys, "n", *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in agreement.VECTOR])
    named = lambda df, f: df.select(F.lit(f).alias("family"), *keys, "n", *agreement.VECTOR)
    return named(cross, "cross").unionByName(named(retest, "retest")).unionByName(gap)


@query(f"with {_VECTORS} select family, uid, source, n, round(abs_diff, 6) + 0.0 as abs_diff, round(signed_diff, 6) + 0.0 as signed_diff, round(rank_agreement, 6) + 0.0 as rank_agreement, round(pass_disagreement, 6) + 0.0 as pass_disagreement from vectors")
def judge_question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("family", "uid", "source", "n", *[(R6(m) + 0.0).alias(m) for m in agreement.VECTOR])


@query(f"with {_CELLS} " + " union all ".join(f"select '{f}' as family, source, count(*) as n_cells, round(corr(s_a, s_{r}), 6) as pearson, round(avg(abs(s_{r} - s_a)), 6) as mean_abs_diff, round(avg(s_{r} - s_a), 6) as mean_signed_diff, round(avg(s_a), 6) as mean_first, round(avg(s_{r}), 6) as mean_second, round(avg(p_a), 6) as pass_first, round(avg(p_{r}), 6) as pass_second, round(avg(abs(p_a - p_{r})), 6) as pass_disagreement from cells group by 2" for f, r in (("cross", "b"), ("retest", "c"))))
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    cells = score_cells(spark, d)
    parts = [agreement.pooled_agreement(cells, ["source"], "s_a", f"s_{r}", "p_a", f"p_{r}").withColumn("family", F.lit(f)) for f, r in (("cross", "b"), ("retest", "c"))]
    out = parts[0].unionByName(parts[1])
    return out.select("family", "source", "n_cells", *[R6(c).alias(c) for c in out.columns if c not in ("family", "source", "n_cells")])


_SIGN_P = "case when n_wins + n_losses = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, cast(least(n_wins, n_losses) + 1 as bigint)), lambda i: exp(lgamma(n_wins + n_losses + 1) - lgamma(i + 1) - lgamma(n_wins + n_losses - i + 1) - (n_wins + n_losses) * ln(2))))) end"


@query(f"""with {_VECTORS}, l as (select family, uid, source, unnest([{{'m': 'abs_diff', 'v': abs_diff}}, {{'m': 'signed_diff', 'v': signed_diff}}, {{'m': 'pass_disagreement', 'v': pass_disagreement}}, {{'m': 'rank_agreement', 'v': rank_agreement}}]) as x from vectors), k as (select family, uid, source, x.m as metric, x.v as v from l),
dd as (select a.family, a.metric, a.source, round(a.v - b.v, 9) as d from k a join k b on a.family = b.family and a.metric = b.metric and a.uid = b.uid where b.source = 'O' and a.source <> 'O' and a.v is not null and b.v is not null),
g as (select family, metric, source, count(*) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(*)) as se, sum(case when d > 0 then 1 else 0 end) as n_wins, sum(case when d < 0 then 1 else 0 end) as n_losses from dd group by 1, 2, 3), t as (select *, {_SIGN_P} as p from g),
r as (select *, row_number() over (partition by family, metric order by p, source) as k, count(*) over (partition by family, metric) as m from t)
select family, metric, source, n, round(mean, 6) as mean, round(mean - 1.96 * se, 6) as low, round(mean + 1.96 * se, 6) as high, n_wins, n_losses, round(p, 6) as p, round(least(1.0, min(p * m / k) over (partition by family, metric order by p desc range between unbounded preceding and current row)), 6) as q from r""")
def judge_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of the vectors, each source against source O on common questions: mean difference with normal interval, exact sign test, q over the
    sources of a family's metric."""
    v = vectors(spark, d)
    long = v.select("family", "uid", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in agreement.VECTOR])).alias("x")).select("family", "uid", "source", "x.metric", "x.v").where("v is not null")
    base = long.where("source = 'O'").select("family", "uid", "metric", F.col("v").alias("b"))
    dd = long.where("source != 'O'").join(base, ["family", "uid", "metric"]).select("family", "metric", "source", F.round(F.col("v") - F.col("b"), 9).alias("d"))
    g = dd.groupBy("family", "metric", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count_if(F.col("d") > 0).alias("n_wins"), F.count_if(F.col("d") < 0).alias("n_losses"))
    t = ranking.bh_adjusted(g.withColumn("p", exact.mcnemar_p_column(F.col("n_wins"), F.col("n_losses"))), ["family", "metric"], "p")
    return t.select("family", "metric", "source", "n", (R6("mean") + 0.0).alias("mean"), R6(F.col("mean") - 1.96 * F.col("se")).alias("low"), R6(F.col("mean") + 1.96 * F.col("se")).alias("high"), "n_wins", "n_losses", R6("p").alias("p"), R6("q").alias("q"))


def _kappa_sql(group: str, second: str) -> str:
    g = f"{group}, " if group else ""
    by = f" group by {group}" if group else ""
    return f"""select {g}n11 + n10 + n01 + n00 as n, (n11 + n00) / (n11 + n10 + n01 + n00) as agreement, ((n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01)) / ((n11 + n10 + n01 + n00) * (n11 + n10 + n01 + n00)) as chance from (select {g}
 sum(case when a and {second} then 1.0 else 0.0 end) as n11, sum(case when a and not {second} then 1.0 else 0.0 end) as n10, sum(case when not a and {second} then 1.0 else 0.0 end) as n01, sum(case when not a and not {second} then 1.0 else 0.0 end) as n00 from rd{by})"""


@query(f"with {_READ} " + " union all ".join(f"select '{f}' as family, source, cast(n as bigint) as n, round(agreement, 6) as agreement, round(case when 1 - chance > 1e-12 then (agreement - chance) / (1 - chance) end, 6) as kappa from ({_kappa_sql('source', r)})" for f, r in (("cross", "b"), ("retest", "c"))))
def criterion_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on single criteria by two judges, and by one judge twice."""
    rd = readings(spark, d)
    parts = [agreement.verdict_agreement(rd, ["source"], F.col("a"), F.col(r)).withColumn("family", F.lit(f)) for f, r in (("cross", "b"), ("retest", "c"))]
    return parts[0].unionByName(parts[1]).select("family", "source", "n", R6("agreement").alias("agreement"), R6("kappa").alias("kappa"))


@query(f"with {_READ} select uid, source, count(*) as n, round(avg(case when a = b then 1.0 else 0.0 end), 6) as cross_agreement, round(avg(case when a = c then 1.0 else 0.0 end), 6) as retest_agreement, round(avg(case when a = b then 1.0 else 0.0 end) - avg(case when a = c then 1.0 else 0.0 end), 6) as gap from rd group by 1, 2")
def question_criterion_agreement(spark: SparkSession, d: str) -> DataFrame:
    same = lambda r: F.avg((F.col("a") == F.col(r)).cast("int"))
    return readings(spark, d).groupBy("uid", "source").agg(F.count(F.lit(1)).alias("n"), R6(same("b")).alias("cross_agreement"), R6(same("c")).alias("retest_agreement"), (R6(same("b") - same("c")) + 0.0).alias("gap"))


_ACC = "acc as (select x.uid, x.source, avg(case when x.s_a < y.s_a then 1.0 when x.s_a = y.s_a then 0.5 else 0.0 end) as accuracy from cells x join cells y on x.uid = y.uid and x.source = y.source and x.level > y.level group by 1, 2)"


@query(f"with {_CELLS}, {_ACC} select uid, " + ", ".join(f"round(max(case when source = '{s}' then accuracy end), 6) as accuracy_{s.lower()}" for s in "FOP") + " from acc group by 1")
def question_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Ladder accuracy of each question by source, one column per source (level 1 is best)."""
    cells = score_cells(spark, d).withColumn("worse", -F.col("level"))
    acc = ranking.ordered_pairs(cells.select("uid", "source", F.col("worse").alias("level"), "s_a"), ["uid", "source"], "level", "s_a")
    wide = acc.groupBy("uid").pivot("source", list("FOP")).agg(R6(F.first("accuracy")))
    return wide.select("uid", *[F.col(s).alias(f"accuracy_{s.lower()}") for s in "FOP"])


@query(f"with {_CELLS}, {_ACC}, w as (select uid, max(case when source = 'F' then accuracy end) as f, max(case when source = 'O' then accuracy end) as o, max(case when source = 'P' then accuracy end) as p from acc group by 1) select uid, round(f - greatest(coalesce(o, 0), coalesce(p, 0)), 6) as delta from w where f is not null and (o is not null or p is not null) order by delta desc, uid limit 25")
def largest_advantages(spark: SparkSession, d: str) -> DataFrame:
    """Questions for a case study: where one source leads the better of two others most."""
    w = question_matrix(spark, d).where("accuracy_f is not null and (accuracy_o is not null or accuracy_p is not null)")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return w.select("uid", R6(F.col("accuracy_f") - F.greatest(zero("accuracy_o"), zero("accuracy_p"))).alias("delta")).orderBy(F.desc("delta"), "uid").limit(25)


_LABELLED = "lb as (select run_name, rubric_source, uid, pos, lower(trim(raw_category)) as label, weight, loaded_at, criterion_id from criteria where uid is not null)"
LABELS = ["essential", "important", "optional", "pitfall"]


@query(f"with {_LABELLED}, u as (select *, row_number() over (partition by run_name, rubric_source, uid, pos order by loaded_at, criterion_id) as r from lb where label in {tuple(LABELS)} and pos is not null) select run_name, rubric_source, uid, count(*) as n_labelled, " + ", ".join(f"round(avg(case when label = '{x}' then 1.0 else 0.0 end), 6) as {x}_fraction" for x in LABELS) + " from u where r = 1 group by 1, 2, 3")
def label_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of labels in each rubric; a position labelled more than once keeps its first usable label."""
    c = table(spark, d, "criteria").where("uid is not null")
    out = agreement.label_fractions(c, ["run_name", "rubric_source", "uid"], "pos", F.col("raw_category"), LABELS, [F.col("loaded_at"), F.col("criterion_id")])
    return out.select("run_name", "rubric_source", "uid", "n_labelled", *[R6(f"{x}_fraction").alias(f"{x}_fraction") for x in LABELS])


@query(f"with {_LABELLED}, u as (select *, row_number() over (partition by run_name, rubric_source, uid, pos order by loaded_at, criterion_id) as r from lb where abs(weight) >= 1 and pos is not null) select run_name, rubric_source, uid, count(*) as n_labelled, round(avg(least(abs(weight), 20)), 6) as mean_checks, round(avg(case when abs(weight) = 1 then 1.0 else 0.0 end), 6) as atomic_fraction, max(least(abs(weight), 20)) as max_checks from u where r = 1 group by 1, 2, 3")
def atomicity(spark: SparkSession, d: str) -> DataFrame:
    """Checks per criterion (here the weight's magnitude stands for the count): the first count of a position, capped at twenty."""
    c = table(spark, d, "criteria").where("uid is not null")
    out = agreement.check_counts(c, ["run_name", "rubric_source", "uid"], "pos", F.abs("weight"), [F.col("loaded_at"), F.col("criterion_id")])
    return out.select("run_name", "rubric_source", "uid", "n_labelled", R6("mean_checks").alias("mean_checks"), R6("atomic_fraction").alias("atomic_fraction"), "max_checks")


_SLOTS = """sl as (select l_orderkey as question, max(case when l_linenumber = 1 and l_quantity <= 48 then case l_returnflag when 'A' then 'A' when 'R' then 'B' else 'TIE' end end) as s1, max(case when l_linenumber = 2 then case when l_quantity < 5 then 'TIE' when l_linestatus = 'F' then 'A' else 'B' end end) as s2 from lineitem group by 1),
fo as (select question, o_orderpriority as pair, case s1 when 'A' then 'a' when 'B' then 'b' when 'TIE' then 'tie' end as v1, case s2 when 'A' then 'b' when 'B' then 'a' when 'TIE' then 'tie' end as v2, s1, s2 from sl join orders on o_orderkey = question),
fr as (select *, case when v1 is null then 0 else 1 end + case when v2 is null then 0 else 1 end as n_verdicts, case when v1 = v2 and v1 <> 'tie' then v1 else 'tie' end as won, coalesce(cast(s1 in ('A', 'B') as int), 0) + coalesce(cast(s2 in ('A', 'B') as int), 0) as n_decisive, coalesce(cast(s1 = 'A' as int), 0) + coalesce(cast(s2 = 'A' as int), 0) as n_first, coalesce(cast(v1 = 'a' as int), 0) + coalesce(cast(v2 = 'a' as int), 0) as wa, coalesce(cast(v1 = 'b' as int), 0) + coalesce(cast(v2 = 'b' as int), 0) as wb from fo)"""


def slot_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(question, pair, folded fields): two orders of presentation of each pair; a missing line is a failed verdict."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    s1 = F.when((n == 1) & (F.col("l_quantity") <= 48), F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("TIE"))
    s2 = F.when(n == 2, F.when(F.col("l_quantity") < 5, "TIE").when(F.col("l_linestatus") == "F", "A").otherwise("B"))
    slots = li.groupBy(F.col("l_orderkey").alias("question")).agg(F.max(s1).alias("s1"), F.max(s2).alias("s2"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("judge"))
    return slots.join(o, "question").select("question", "pair", "judge", agreement.folded(F.col("s1"), F.col("s2")).alias("f")).select("question", "pair", "judge", "f.*")


@query(f"with {_SLOTS} select question, v1 as verdict_order1, v2 as verdict_order2, n_verdicts, 2 - n_verdicts as n_failed, n_decisive, n_first as n_first_slot_wins, wa as raw_wins_a, wb as raw_wins_b, won as corrected_winner from fr")
def folded_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return slot_verdicts(spark, d).drop("pair", "judge")


@query(f"""with {_SLOTS} select pair, count(*) as n_questions, sum(cast(n_verdicts = 2 as int)) as n_complete, round(sum(case when n_verdicts = 2 then wa else 0 end) / sum(2 * cast(n_verdicts = 2 as int)), 6) as raw_win_rate_a, round(sum(case when n_verdicts = 2 then wb else 0 end) / sum(2 * cast(n_verdicts = 2 as int)), 6) as raw_win_rate_b,
 round(avg(case when n_verdicts = 2 then case when won = 'a' then 1.0 else 0.0 end end), 6) as corrected_win_rate_a, round(avg(case when n_verdicts = 2 then case when won = 'b' then 1.0 else 0.0 end end), 6) as corrected_win_rate_b, round(avg(case when n_verdicts = 2 then case when won = 'tie' then 1.0 else 0.0 end end), 6) as corrected_tie_rate,
 round(avg(case when n_verdicts = 2 then case when v1 <> v2 then 1.0 else 0.0 end end), 6) as flip_rate, sum(n_verdicts) - sum(n_decisive) as n_tie_verdicts, sum(2 - n_verdicts) as n_failed, round(sum(n_first) / sum(n_decisive), 6) as position_bias_rate from fr group by grouping sets ((pair), ())""")
def corrected_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Win rates over both slot orders, with flips and position bias, by pair and over all."""
    out = agreement.head_to_head(slot_verdicts(spark, d), "pair")
    return out.select(*[R6(c).alias(c) if c.endswith(("rate", "rate_a", "rate_b")) else F.col(c) for c in out.columns])


@query(f"""with {_SLOTS}, c as (select o_custkey as uid, o_orderstatus as judge, avg(case won when 'a' then 1.0 when 'b' then -1.0 else 0.0 end) as x from fr join orders on o_orderkey = question group by 1, 2), d as (select a.x - b.x as d from c a join c b using (uid) where a.judge = 'F' and b.judge = 'O')
select count(*) as n, round(avg(d), 6) as mean_difference, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) as low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) as high from d""")
def head_to_head_two_judges(spark: SparkSession, d: str) -> DataFrame:
    """Winners coded 1, 0 and -1, by question under two judges: mean paired difference."""
    coded = F.when(F.col("corrected_winner") == "a", 1.0).when(F.col("corrected_winner") == "b", -1.0).otherwise(0.0)
    uid = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_custkey").alias("uid"))
    c = slot_verdicts(spark, d).join(uid, "question").groupBy("uid", "judge").agg(F.avg(coded).alias("x"))
    dd = c.where("judge = 'F'").join(c.where("judge = 'O'").select("uid", F.col("x").alias("y")), "uid").select((F.col("x") - F.col("y")).alias("d"))
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    return dd.agg(F.count(F.lit(1)).alias("n"), R6(F.avg("d")).alias("mean_difference"), R6(F.avg("d") - half).alias("low"), R6(F.avg("d") + half).alias("high"))


_VOTES = f"""{_READ}, it as (select answer, source, level, 1 + cast(w as bigint) % 5 as k, a, b from rd), su as (select answer, any_value(source) as source, any_value(level) as level, count(*) as n_items, sum(case when a <> b then 1 else 0 end) as n_split, sum(case when a then k else 0 end) as sa, sum(case when b then k else 0 end) as sb, sum(case when a and not b then k else 0 end) as fa, sum(case when b and not a then k else 0 end) as fb from it group by 1),
vt as (select *, case when sa > sb then 'A' when sa < sb then 'B' end as mechanical, case when fa > fb then 'A' when fa < fb then 'B' end as decisive, case when fa + fb > 0 then abs(fa - fb) / (fa + fb) end as coherence, case when level <= 2 then 'A' when level >= 4 then 'B' end as holistic, case when source = 'F' then 'A' else 'B' end as label from su)"""


def voted(spark: SparkSession, d: str) -> DataFrame:
    rd = readings(spark, d).withColumn("k", 1 + F.col("w").cast("long") % 5)
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer"), F.col("o_orderstatus").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    v = agreement.weighted_votes(rd, "answer", "k", "a", "b").join(cases, "answer")
    return v.withColumn("holistic", F.when(F.col("level") <= 2, "A").when(F.col("level") >= 4, "B")).withColumn("label", F.when(F.col("source") == "F", "A").otherwise("B"))


@query(f"with {_VOTES} select answer, n_items, n_split, mechanical, decisive, round(coherence, 6) as coherence from vt")
def weighted_votes(spark: SparkSession, d: str) -> DataFrame:
    """Per-criterion verdicts on two answers added up by weight."""
    return voted(spark, d).select("answer", "n_items", "n_split", "mechanical", "decisive", R6("coherence").alias("coherence"))


@query(f"with {_VOTES} select level, count(*) as n, round(avg(case when holistic = label then 1.0 else 0.0 end), 6) as accuracy, round(sum(n_split) / sum(n_items), 6) as split_rate, round(coalesce(avg(coherence), 0), 6) as coherence, round(coalesce(avg(case when decisive = label then 1.0 when decisive <> label then 0.0 end), 0), 6) as decisive_accuracy, round(avg(case when decisive is not null then 1.0 else 0.0 end), 6) as decisive_coverage, round(avg(n_items), 6) as criteria_per_case from vt group by 1")
def vote_profiles(spark: SparkSession, d: str) -> DataFrame:
    out = agreement.vote_profile(voted(spark, d), ["level"], "label", "holistic")
    return out.select("level", "n", *[R6(c).alias(c) for c in out.columns[2:]])


@query(f"""with {_VOTES} select source, count(*) as n, sum(case when holistic = label and (decisive is null or decisive = label) then 1 else 0 end) as n_right, sum(case when holistic <> label and decisive = label then 1 else 0 end) as n_judge_fault, sum(case when holistic <> label and (decisive is null or decisive <> label) then 1 else 0 end) as n_rubric_fault, sum(case when holistic is null then 1 else 0 end) as n_undecided,
 round(corr(n_split / n_items, case when holistic = label then 1.0 else 0.0 end), 6) as split_correlation from vt group by 1""")
def error_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Wrong verdicts by fault: the judge's, if the criteria that tell the answers apart were right, else the rubric's."""
    v = voted(spark, d)
    right, fits = F.col("holistic") == F.col("label"), F.col("decisive") == F.col("label")
    ok = F.coalesce(right, F.lit(False)).cast("double")
    return v.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(right & F.coalesce(fits, F.lit(True))).alias("n_right"), F.count_if(~right & F.coalesce(fits, F.lit(False))).alias("n_judge_fault"), F.count_if(~right & ~F.coalesce(fits, F.lit(False))).alias("n_rubric_fault"), F.count_if(F.col("holistic").isNull()).alias("n_undecided"), R6(ranking.correlation(F.col("n_split") / F.col("n_items"), ok)).alias("split_correlation"))


_READING = f"{_CELLS}, mr as (select uid, source, unnest([{{'r': 'first', 'v': s_a}}, {{'r': 'second', 'v': s_b}}, {{'r': 'again', 'v': s_c}}]) as x from cells), mm as (select uid, source, x.r as reading, avg(x.v) as v from mr group by 1, 2, 3), dm as (select a.uid, a.source, a.reading, a.v, a.v - b.v as d from mm a left join mm b on a.uid = b.uid and a.reading = b.reading and b.source = 'O')"


@query(f"with {_READING} select x.reading, x.source, count(*) as n, round(avg(x.v), 6) as mean, count(x.d) as n_paired, round(avg(x.d), 6) as paired_difference, round(avg(x.d - y.d), 6) as change from dm x join dm y on x.uid = y.uid and x.source = y.source and y.reading = 'first' group by 1, 2")
def judge_profile(spark: SparkSession, d: str) -> DataFrame:
    """By reading and source: marginal mean, mean difference to source O on common questions, and how far that difference moves from the first reading's."""
    long = score_cells(spark, d).select("uid", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("reading"), F.col(c).alias("v")) for n, c in (("first", "s_a"), ("second", "s_b"), ("again", "s_c"))])).alias("x")).select("uid", "source", "x.*")
    m = long.groupBy("uid", "source", "reading").agg(F.avg("v").alias("v"))
    dm = m.join(m.where("source = 'O'").select("uid", "reading", F.col("v").alias("o")), ["uid", "reading"], "left").withColumn("d", F.col("v") - F.col("o"))
    first = dm.where("reading = 'first'").select("uid", "source", F.col("d").alias("e"))
    clean = lambda c: R6(c) + 0.0
    return dm.join(first, ["uid", "source"]).groupBy("reading", "source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("v")).alias("mean"), F.count("d").alias("n_paired"), clean(F.avg("d")).alias("paired_difference"), clean(F.avg(F.col("d") - F.col("e"))).alias("change"))


_COHORT = "ct as (select user_id, event_type from events where isfinite(value) group by 1, 2 having count(*) >= 12), cn as (select a.event_type as metric, count(*) as n_paired from ct a join ct b using (user_id) where b.event_type = 'view' group by 1)"


@query(f"with {_COHORT}, e as (select max(n_paired) as expected from cn) select metric, n_paired, expected from cn, e where n_paired <> expected and metric not in ('error')")
def cohort_drift(spark: SparkSession, d: str) -> DataFrame:
    """Metrics whose paired cohort differs from the expected size, but for those that are sparse by construction."""
    c = table(spark, d, "events").where(~F.isnan("value") & (F.abs("value") < float("inf"))).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("m")).where("m >= 12").select("user_id", "event_type")
    n = c.join(c.where("event_type = 'view'").select("user_id"), "user_id", "left_semi").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n_paired"))
    return cohort_problems(n, n.agg(F.max("n_paired").alias("expected")), ["error"])


def cohort_problems(sizes: DataFrame, expected: DataFrame, exempt: list[str]) -> DataFrame:
    """(metric, n_paired, expected) of the metrics that miss the size in the one row of ``expected``."""
    return sizes.join(F.broadcast(expected)).where((F.col("n_paired") != F.col("expected")) & ~F.col("metric").isin(exempt))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) as high from events where isfinite(value) group by 1")
def mean_t_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(~F.isnan("value") & (F.abs("value") < float("inf")))
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("value")).alias("mean"), R6(F.avg("value") - half).alias("low"), R6(F.avg("value") + half).alias("high"))


_RATIO = """m as (select domain, case when run_name = (select min(run_name) from criteria) then 1 else 0 end as s, length(body) as len, weight, case when category = 'Pitfall' then 1.0 else 0.0 end as pit from criteria), a as (select domain, 'mean_length' as metric, avg(case when s = 1 then len end) as sample, avg(len) as full_corpus from m group by 1
 union all select domain, 'mean_weight', avg(case when s = 1 then weight end), avg(weight) from m group by 1 union all select domain, 'pitfall_share', avg(case when s = 1 then pit end), avg(pit) from m group by 1)"""


@query(f"with {_RATIO} select domain, metric, round(sample, 6) as sample, round(full_corpus, 6) as full_corpus, round(sample / full_corpus, 6) as ratio from a where sample is not null and full_corpus <> 0")
def sample_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the first run's criteria against those of all, by domain."""
    c = table(spark, d, "criteria")
    first = c.agg(F.min("run_name").alias("first"))
    m = c.join(F.broadcast(first)).select("domain", (F.col("run_name") == F.col("first")).alias("s"), F.length("body").alias("mean_length"), F.col("weight").alias("mean_weight"), F.when(F.col("category") == "Pitfall", 1.0).otherwise(0.0).alias("pitfall_share"))
    names = ["mean_length", "mean_weight", "pitfall_share"]
    long = m.select("domain", "s", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("domain", "s", "x.*")
    g = long.groupBy("domain", "metric").agg(F.avg(F.when(F.col("s"), F.col("v"))).alias("sample"), F.avg("v").alias("full_corpus")).where("sample is not null and full_corpus != 0")
    return g.select("domain", "metric", R6("sample").alias("sample"), R6("full_corpus").alias("full_corpus"), R6(F.col("sample") / F.col("full_corpus")).alias("ratio"))


@query(f"with {_CASE} select uid, domain, chars_a, chars_b from cases where not hit_a and hit_b")
def failures(spark: SparkSession, d: str) -> DataFrame:
    """Cases that the first setting gets wrong and the second right."""
    return preference_cases(spark, d).where("not hit_a and hit_b").select("uid", "domain", "chars_a", "chars_b")


@query(f"with {_CASE}, r as (select *, case when hit_a and hit_b then 'both' when hit_a then 'first' when hit_b then 'second' else 'neither' end as kind from cases), pk as (select domain, kind, uid, row_number() over (partition by domain, kind order by md5(concat('31:', uid)), uid) as r from r) select domain, kind, uid from pk where r <= 3")
def example_cases(spark: SparkSession, d: str) -> DataFrame:
    """Three cases of each outcome and domain, in hash order."""
    from tallyframe.operators.merging import sample_per_group

    kind = F.when(F.col("hit_a") & F.col("hit_b"), "both").when(F.col("hit_a"), "first").when(F.col("hit_b"), "second").otherwise("neither")
    return sample_per_group(preference_cases(spark, d).select("domain", kind.alias("kind"), "uid"), ["domain", "kind"], "uid", 3, seed=31)


@query(f"""with {_CASE}, t as (select domain, count(*) as n, sum(case when hit_a <> hit_b then 1 else 0 end) as m from cases group by 1) select domain, round(n / sum(n) over (), 6) as share_all, round(m / nullif(sum(m) over (), 0), 6) as share_discordant, n, m as n_discordant from t""")
def subset_composition(spark: SparkSession, d: str) -> DataFrame:
    """Domains among all cases and among those on which the settings differ."""
    t = preference_cases(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit_a") != F.col("hit_b")).alias("m"))
    sums = t.agg(F.sum("n").alias("sn"), F.sum("m").alias("sm"))
    return t.join(F.broadcast(sums)).select("domain", R6(F.col("n") / F.col("sn")).alias("share_all"), R6(F.try_divide("m", "sm")).alias("share_discordant"), "n", F.col("m").alias("n_discordant"))


@query("""with c as (select distinct domain, uid, rubric_source from criteria where uid is not null), f as (select domain, uid from c group by 1, 2 having count(*) >= 2), k as (select min(n) as k from (select domain, count(*) as n from f group by 1)),
r as (select domain, uid, row_number() over (partition by domain order by md5(concat('41:', uid)), uid) as r from f) select domain, uid from r, k where r <= k""")
def balanced_subset(spark: SparkSession, d: str) -> DataFrame:
    """Questions that at least two sources have a rubric for, equally many of each domain, in hash order."""
    from tallyframe.operators.merging import positions

    c = table(spark, d, "criteria").where("uid is not null").select("domain", "uid", "rubric_source")
    f = cut(c.groupBy("domain", "uid").agg(F.count_distinct("rubric_source").alias("n")).where("n >= 2").select("domain", "uid"))
    k = f.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("k")).first().k or 0
    return positions(f, ["domain"], "uid", 41).where(F.col("_i") < k).select("domain", "uid")


@query("""with r as (select uid, any_value(domain) as domain, count(*) as n, sum(case when correct then 1 else 0 end) as c from rollouts where uid is not null and correct is not null group by 1), i as (select * from r where n >= 2 and c between 1 and n - 1), k as (select domain, uid, n, c, row_number() over (partition by domain order by abs(c / n - 0.5), uid) as r from i) select domain, uid, n, c as n_right, cast(r as bigint) as rank from k where r <= 20""")
def screened_questions(spark: SparkSession, d: str) -> DataFrame:
    """The twenty questions of each domain whose answers are most evenly right and wrong."""
    r = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid").agg(F.min("domain").alias("domain"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c")).where("n >= 2 and c between 1 and n - 1")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.abs(F.col("c") / F.col("n") - 0.5), "uid"))
    return r.withColumn("rank", rank.cast("long")).where("rank <= 20").select("domain", "uid", "n", F.col("c").alias("n_right"), "rank")


@query("select uid || '::' || rubric_source as key, uid, rubric_source as source, try_cast(min(title) as double) as rate, round(avg(weight), 6) as mean_weight from criteria where uid is not null group by uid, rubric_source")
def supplied_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates given under keys ``uid::source``: keys are parsed back, values that are no numbers are NULL."""
    made = table(spark, d, "criteria").where("uid is not null").groupBy(F.concat("uid", F.lit("::"), "rubric_source").alias("key")).agg(F.min("title").alias("value"), R6(F.avg("weight")).alias("mean_weight"))
    return parsed_rates(made).select("key", "uid", "source", "rate", "mean_weight")


def parsed_rates(rows: DataFrame) -> DataFrame:
    """Adds uid, source and rate from (key, value); keys without ``::`` are dropped."""
    at = F.instr("key", "::")
    return rows.where(at > 0).withColumn("uid", F.expr("substring(key, 1, instr(key, '::') - 1)")).withColumn("source", F.expr("substring(key, instr(key, '::') + 2)")).withColumn("rate", F.col("value").try_cast("double"))
