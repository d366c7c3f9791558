"""Verdict scoring, quality ladders, sampled answers, paired statistics and preferences.

No table holds model verdicts, so the verdict operators run on tables of the same shape: ``lineitem`` gives verdicts (order = answer,
line = criterion, met = line status F, weight = quantity, category = return flag), ``orders`` ladders (customer = question, priority =
level, price = score), ``events`` paired metric values (user = question, event type = source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import exact
from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T
from tallyframe.operators import paired, ranking
from tallyframe.plans import sqltext as S
from tallyframe.plans.registry import query
from tallyframe.session import table

R6 = lambda c: F.round(c, 6)
_CAT = "case l_returnflag when 'A' then 'Essential' when 'R' then 'Important' else 'Pitfall' end"
_V = f"v as (select l_orderkey as answer, l_linenumber as item, {_CAT} as cat, l_quantity as weight, l_linestatus = 'F' as literally_true, l_linenumber <= 2 as inverted from lineitem)"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    cat = F.when(F.col("l_returnflag") == "A", "Essential").when(F.col("l_returnflag") == "R", "Important").otherwise("Pitfall")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("item"), cat.alias("cat"), F.col("l_quantity").cast("double").alias("weight"), (F.col("l_linestatus") == "F").alias("literally_true"), (F.col("l_linenumber") <= 2).alias("inverted"))


def weighted_scores(v: DataFrame, group: list[str]) -> DataFrame:
    """Share of weight met under three weightings in one pass: category weights, magnitudes of the weights (0 counts as 1), all equal.
    The denominator holds magnitudes; whether an item counts as met is in ``met``. Without items the score is 0."""
    w = T.scoring_weight(F.col("cat"), L.DEFAULT_SCORING_WEIGHT)
    raw = F.when(F.col("weight") == 0, 1.0).otherwise(F.abs("weight"))
    share = lambda x: R6(F.coalesce(F.try_divide(F.sum(F.when(F.col("met"), x).otherwise(0.0)), F.sum(x)), F.lit(0.0)))
    return v.groupBy(*group).agg(share(w).alias("score"), share(raw).alias("score_numeric"), share(F.lit(1.0)).alias("score_unweighted"), F.count(F.lit(1)).alias("n_items"), F.count_if("met").alias("n_met"))


_W, _RAW = S.scoring_weight("cat", 0.7), "case when weight = 0 then 1 else abs(weight) end"
_SHARES = ", ".join(f"round(sum(case when met then {x} else 0 end) / sum({x}), 6) as {n}" for x, n in ((_W, "score"), (_RAW, "score_numeric"), ("1.0", "score_unweighted")))


@query(f"with {_V} select answer, {_SHARES}, count(*) as n_items, sum(case when met then 1 else 0 end) as n_met from (select *, literally_true as met from v) group by 1")
def verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    return weighted_scores(verdicts(spark, d).withColumn("met", F.col("literally_true")), ["answer"])


_MODES = {"detected": "cat = 'Pitfall' and inverted", "all_avoidance": "false", "all_failure": "cat = 'Pitfall'"}


@query(f"with {_V} " + " union all ".join(f"select '{m}' as polarity_mode, answer, {_SHARES}, count(*) as n_items, sum(case when met then 1 else 0 end) as n_met from (select *, case when {c} then not literally_true else literally_true end as met from v) group by answer" for m, c in _MODES.items()))
def verdict_scores_by_polarity(spark: SparkSession, d: str) -> DataFrame:
    """The same verdicts scored under each convention: rows are multiplied by the three modes and aggregated once."""
    pitfall = F.col("cat") == "Pitfall"
    negative = {"detected": pitfall & F.col("inverted"), "all_avoidance": F.lit(False), "all_failure": pitfall}
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("polarity_mode"), (F.col("literally_true") != n).alias("met")) for m, n in negative.items()]))
    v = verdicts(spark, d).select("answer", "cat", "weight", modes.alias("m")).select("answer", "cat", "weight", "m.*")
    return weighted_scores(v, ["polarity_mode", "answer"])


_LADDER = "o as (select o_custkey as uid, cast(left(o_orderpriority, 1) as integer) as level, avg(o_totalprice) as score from orders group by 1, 2)"


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """(uid, level, score): mean price of each customer's orders of a priority; level 1 is the gold answer."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("uid"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level")).agg(F.avg("o_totalprice").alias("score"))


@query(f"""with {_LADDER} select a.uid, count(*) as n_pairs, sum(case when round(a.score, 6) = round(b.score, 6) then 1 else 0 end) as n_ties, sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end) as credit,
 round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end), 6) as accuracy from o a join o b on a.uid = b.uid and a.level > b.level group by 1""")
def ladder_rank_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.ordered_pairs(ladder(spark, d), ["uid"], "level", "score")
    return out.withColumn("accuracy", R6(F.col("accuracy")))


@query(f"""with {_LADDER}, g as (select uid, max(case when level = 1 then score end) as gold from o group by 1)
select uid, round(avg(case when level > 1 then gold - score end), 4) as mean_margin, round(min(case when level > 1 then gold - score end), 4) as min_margin, round(max(score) - min(score), 4) as score_range, round(stddev_pop(score), 4) as score_std,
 round(avg(case when level > 1 then case when score >= 0.8 * gold then 1.0 else 0.0 end end), 6) as saturation_rate from o join g using (uid) where gold is not null group by 1""")
def ladder_margins(spark: SparkSession, d: str) -> DataFrame:
    """Margins of the gold answer over the others, spread with the population deviation, and the share of others near gold."""
    o = ladder(spark, d)
    g = o.where("level = 1").select("uid", F.col("score").alias("gold"))
    other = F.col("level") > 1
    margin = F.when(other, F.col("gold") - F.col("score"))
    near = F.when(other, F.when(F.col("score") >= 0.8 * F.col("gold"), 1.0).otherwise(0.0))
    return o.join(g, "uid").groupBy("uid").agg(F.round(F.avg(margin), 4).alias("mean_margin"), F.round(F.min(margin), 4).alias("min_margin"), F.round(F.max("score") - F.min("score"), 4).alias("score_range"), F.round(F.stddev_pop("score"), 4).alias("score_std"), R6(F.avg(near)).alias("saturation_rate"))


@query("""with r as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as r, o_orderstatus = 'F' as p, o_orderpriority as g, o_totalprice from orders),
x as (select g, rank() over (partition by g order by o_totalprice) + (count(*) over (partition by g, o_totalprice) - 1) / 2.0 as r, p from r)
select g, sum(case when p then 1 else 0 end) as n_pos, sum(case when not p then 1 else 0 end) as n_neg, round((sum(case when p then r end) - sum(case when p then 1 else 0 end) * (sum(case when p then 1 else 0 end) + 1) / 2) / (sum(case when p then 1 else 0 end) * sum(case when not p then 1 else 0 end)), 6) as auc from x group by 1""")
def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("p"))
    out = ranking.rank_auc(o, ["g"], "o_totalprice", F.col("p"))
    return out.withColumn("auc", R6(F.col("auc")))


@query("""with r as (select setting, uid, correct, n_chars, row_number() over (partition by uid, setting order by loaded_at desc, rollout_key desc) as k from rollouts where uid is not null),
u as (select * from r where k = 1 and correct is not null) select setting, count(*) as n, round(avg(case when correct then 1.0 else 0.0 end), 6) as accuracy, round(avg(n_chars), 6) as mean_chars from u group by 1""")
def latest_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """The latest load of each question's answer in a setting counts; then accuracy by setting."""
    r = table(spark, d, "rollouts").where("uid is not null").select("uid", "setting", "correct", "n_chars", "loaded_at", "rollout_key")
    u = ranking.first_per_key(r, ["uid", "setting"], [(-F.unix_micros("loaded_at")).alias("a"), (-F.col("rollout_key")).alias("b")]).where("correct is not null")
    return u.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), R6(F.avg("n_chars")).alias("mean_chars"))


_ROLL = "s as (select uid, coalesce(length(text), 0) as score, correct from rollouts where correct is not null and uid is not null)"


@query(f"""with {_ROLL}, m as (select uid, max(score) as top from s group by 1), i as (select uid from s group by 1 having count(*) >= 2 and count(distinct correct) = 2)
select uid, round(avg(case when score >= top - 1e-12 then case when correct then 1.0 else 0.0 end end), 6) as best_of_n, round(avg(case when correct then 1.0 else 0.0 end), 6) as base, round(avg(case when correct then score end) - avg(case when not correct then score end), 6) as separation, count(*) as n
from s join m using (uid) where uid in (select uid from i) group by 1""")
def rollout_selection(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of taking the best-scored answer (tied ones share), against any answer, for questions with both kinds. The score is the
    length here."""
    s = table(spark, d, "rollouts").where("correct is not null and uid is not null").select("uid", F.coalesce(F.length("text"), F.lit(0)).alias("score"), "correct")
    top = s.groupBy("uid").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c")).where("n >= 2 and c between 1 and n - 1")
    hit, c = F.col("correct").cast("int"), F.col("correct")
    return s.join(top.select("uid", "top"), "uid").groupBy("uid").agg(R6(F.avg(F.when(F.col("score") >= F.col("top") - 1e-12, hit))).alias("best_of_n"), R6(F.avg(hit)).alias("base"), R6(F.avg(F.when(c, F.col("score"))) - F.avg(F.when(~c, F.col("score")))).alias("separation"), F.count(F.lit(1)).alias("n"))


@query("""with s as (select setting, n_chars as x, length(text) as y from rollouts where n_chars is not null and text is not null and not coalesce(correct, true)), r as (select setting, x, y, rank() over (partition by setting order by x) + (count(*) over (partition by setting, x) - 1) / 2.0 as rx, rank() over (partition by setting order by y) + (count(*) over (partition by setting, y) - 1) / 2.0 as ry from s)
select setting, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r group by 1""")
def length_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlations of two lengths among wrong answers."""
    s = table(spark, d, "rollouts").where("n_chars is not null and text is not null and not coalesce(correct, true)").select("setting", F.col("n_chars").alias("x"), F.length("text").alias("y"))
    return ranking.correlations(s, ["setting"], "x", "y").select("setting", "n", R6("pearson").alias("pearson"), R6("spearman").alias("spearman"))


@query("""select setting, oracle_confidence, count(*) as n, sum(case when correct then 1 else 0 end) as n_correct, sum(case when correct is null then 1 else 0 end) as n_unlabelled, sum(case when oracle_agreement is not null then 1 else 0 end) as n_checked, sum(case when oracle_agreement then 1 else 0 end) as n_agreed, sum(case when error is not null then 1 else 0 end) as n_errors from rollouts group by grouping sets ((setting), (oracle_confidence))""")
def oracle_report(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rollouts").groupingSets([["setting"], ["oracle_confidence"]], "setting", "oracle_confidence")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("correct").isNull()).alias("n_unlabelled"), F.count("oracle_agreement").alias("n_checked"), F.count_if("oracle_agreement").alias("n_agreed"), F.count("error").alias("n_errors"))


_CELL = "c as (select user_id, event_type, arg_min(value, event_id) as value from events where isfinite(value) group by 1, 2)"


def complete_cells(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_type, value) of the keys that have a finite value in every group, however many groups there are."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", ranking.finite(F.col("value")).alias("value"))
    n = e.agg(F.count_distinct("event_type").alias("n")).first().n
    cells = e.where("value is not null").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))
    return cells.join(paired.complete_keys(cells, "user_id", "event_type", n), "user_id", "left_semi")


@query(f"with {_CELL} select user_id, count(*) as n_groups, round(sum(value), 4) as total from c group by 1 having count(*) = (select count(distinct event_type) from events)")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a value in every group."""
    return complete_cells(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.sum("value"), 4).alias("total"))


@query("select distinct l_orderkey as dropped from lineitem where l_orderkey not in (select l_orderkey from lineitem group by 1 having count(distinct l_returnflag) = 3)")
def dropped_cases(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are missing from a group."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return paired.dropped_keys(li, paired.complete_keys(li, "l_orderkey", "l_returnflag", 3), "l_orderkey").withColumnRenamed("l_orderkey", "dropped")


_DIFF = f"{_CELL}, full_ as (select user_id from c group by 1 having count(*) = (select count(distinct event_type) from events)), dd as (select a.event_type || ' - ' || b.event_type as contrast, a.user_id, a.value - b.value as d from c a join c b using (user_id) where a.event_type < b.event_type and user_id in (select user_id from full_))"


def contrasts(spark: SparkSession, d: str) -> DataFrame:
    """(contrast, user_id, d): differences of each pair of groups on complete keys."""
    c = complete_cells(spark, d)
    other = c.select("user_id", F.col("event_type").alias("b"), F.col("value").alias("vb"))
    return c.join(other, "user_id").where("event_type < b").select(F.concat("event_type", F.lit(" - "), "b").alias("contrast"), "user_id", (F.col("value") - F.col("vb")).alias("d"))


@query(f"with {_DIFF} select contrast, count(*) as n, round(avg(d), 5) as mean, round(stddev_samp(d), 5) as sd, sum(case when d > 0 then 1 else 0 end) as n_wins, sum(case when d < 0 then 1 else 0 end) as n_losses from dd group by 1")
def contrast_grid(spark: SparkSession, d: str) -> DataFrame:
    c = contrasts(spark, d)
    return c.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 5).alias("mean"), F.round(F.stddev_samp("d"), 5).alias("sd"), F.count_if(F.col("d") > 0).alias("n_wins"), F.count_if(F.col("d") < 0).alias("n_losses"))


@query(f"""with {_DIFF}, r as (select contrast, d, rank() over (partition by contrast order by abs(d)) + (count(*) over (partition by contrast, abs(d)) - 1) / 2.0 as r from dd where d <> 0), t as (select contrast, sum(k * k * k - k) as ties from (select contrast, abs(d) as a, count(*) as k from dd where d <> 0 group by 1, 2) group by 1),
s as (select contrast, count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus from r group by 1)
select contrast, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4.0 - 0.5 * sign(w_plus - n * (n + 1) / 4.0)) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) as z from s join t using (contrast)""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return paired.signed_ranks(contrasts(spark, d), ["contrast"]).select("contrast", "n", "w_plus", "w_minus", R6(F.col("z")).alias("z"))


BOOT, FLIPS = 2000, 4000


def _draw_sql(seed: int) -> str:
    """The generator of ``paired.draws`` for draw r and unit j."""
    p, (a, b, c, e, f, g, h) = paired.PRIME, paired.STEPS
    x0 = f"((r * {a} + j * {b} + {seed * c + e}) % {p})"
    x1 = f"(({x0} * {x0} + {f}) % {p})"
    x2 = f"({x1} * {g} % {p})"
    return f"(({x2} * {x2} + {h}) % {p})"


def _units_sql(rows: str, group: str, key: str, sums: str) -> str:
    """CTEs from a relation ``rows`` to u (group g, place j, number of units k, sums)."""
    return f"""rw as ({rows}), sz as (select {group} as g, count(*) as size from rw group by 1), un as (select {group} as g, case when size <= {paired.UNITS} then md5({key}) else lpad(cast(('0x' || left(md5({key}), 8))::bigint % {paired.UNITS} as varchar), 4, '0') end as unit, {sums} from rw join sz on {group} is not distinct from g group by 1, 2),
u as (select *, row_number() over (partition by g order by unit) - 1 as j, count(*) over (partition by g) as k from un)"""


def _means_sql(name: str, iters: int, seed: int) -> str:
    return f"{name} as (select d.g, r, sum(w.s) / sum(w.n) as m from (select g, r, {_draw_sql(seed)} % k as i from u, (select unnest(range({iters})) as r) q) d join u w on w.g is not distinct from d.g and w.j = d.i group by 1, 2)"


def _tests_sql(group: str, seed: int = 0) -> str:
    return f"""{_means_sql('bm', BOOT, seed + 1)}, bi as (select g, stddev_samp(m) as se, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by 1), tt as (select g, sum(n) as n, sum(s) / sum(n) as mean from u group by 1),
fl as (select u.g, r, abs(sum(s * ({_draw_sql(seed)} % 2 * 2 - 1))) / any_value(t.n) as m, any_value(abs(t.mean)) as seen from u join tt t on t.g is not distinct from u.g, (select unnest(range({FLIPS})) as r) q group by 1, 2),
ex as (select u.g, mask, abs(sum(s * (1 - 2 * ((mask >> j) & 1)))) / any_value(q.n) as m, any_value(abs(q.mean)) as seen from u join (select g, n, mean, unnest(range(cast(pow(2, n) as bigint))) as mask from tt where n <= 20) q on q.g is not distinct from u.g group by 1, 2),
pp as (select g, (sum(case when m >= seen - 1e-9 * greatest(1.0, seen) then 1 else 0 end) + 1) / {FLIPS + 1} as p from fl where g not in (select g from tt where n <= 20) group by 1 union all select g, avg(case when m >= seen - 1e-12 * greatest(1.0, seen) then 1.0 else 0.0 end) from ex group by 1), res as (select tt.g, n, mean, se, lo, hi, p from tt join bi on bi.g is not distinct from tt.g join pp on pp.g is not distinct from tt.g)"""


@query(f"""with {_DIFF}, {_units_sql("select contrast, user_id, d from dd", "contrast", "cast(user_id as varchar)", "count(*) as n, sum(d) as s")}, {_tests_sql('contrast')}, rk as (select *, row_number() over (order by p, g) as rn, count(*) over () as m from res)
select g as contrast, cast(n as bigint) as n, round(mean, 5) as mean, round(se, 5) as se, round(lo, 5) as ci_low, round(hi, 5) as ci_high, round(p, 6) as p, round(least(1.0, min(p * m / rn) over (order by p desc range between unbounded preceding and current row)), 6) as q from rk""")
def paired_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Every contrast with bootstrap interval, sign-flip p and q over the family."""
    tests = paired_summary(contrasts(spark, d), ["contrast"], ["user_id"]).withColumn("family", F.lit("events"))
    return rounded_tests(ranking.bh_adjusted(tests, ["family"], "p").drop("family"))


def paired_summary(diffs: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Interval of BOOT draws and p of FLIPS sign vectors."""
    n = paired.grouped(paired._value_units(diffs, group, "d", key), group, lambda f: (*paired.unit_interval(f, BOOT, 1), *paired.unit_flips(f, FLIPS, 0)), "n long, mean double, se double, ci_low double, ci_high double, p double, exact boolean")
    return n.drop("exact")


def rounded_tests(t: DataFrame) -> DataFrame:
    keep = [c for c in t.columns if c not in ("n", "mean", "se", "ci_low", "ci_high", "p", "q")]
    return t.select(*keep, "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("mean", "se", "ci_low", "ci_high")], R6("p").alias("p"), R6("q").alias("q"))


@query(f"""with {_units_sql("select event_type, event_id, value from events where isfinite(value)", "event_type", "cast(event_id as varchar)", "count(*) as n, sum(value) as s")}, {_means_sql('bm', BOOT, 0)}, bi as (select g, stddev_samp(m) as se, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by 1), tt as (select g, sum(n) as n, sum(s) / sum(n) as mean from u group by 1)
select tt.g as event_type, cast(n as bigint) as n, round(mean, 5) as mean, round(se, 5) as se, round(lo, 5) as ci_low, round(hi, 5) as ci_high from tt join bi using (g)""")
def metric_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = paired.mean_intervals(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", ["event_id"], BOOT)
    return out.select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mean", "se", "ci_low", "ci_high")])


_CLUSTER_R = "case when saa / n - (sa / n) * (sa / n) > 1e-12 and sbb / n - (sb / n) * (sb / n) > 1e-12 then (sab / n - sa * sb / (n * n)) / sqrt((saa / n - (sa / n) * (sa / n)) * (sbb / n - (sb / n) * (sb / n))) end"


@query(f"""with cl as (select setting, uid, count(*) as n, sum(x) as a, sum(y) as b, sum(x * x) as aa, sum(y * y) as bb, sum(x * y) as ab from (select setting, uid, cast(length(text) as double) as x, case when correct then 1.0 else 0.0 end as y from rollouts where setting is not null and uid is not null and text is not null and correct is not null) group by 1, 2),
{_units_sql("select * from cl", "setting", "uid", "sum(n) as n, sum(a) as a, sum(b) as b, sum(aa) as aa, sum(bb) as bb, sum(ab) as ab").replace("select *, row_number()", "select un.*, row_number()")},
su as (select d.g, r, sum(w.n) as n, sum(w.a) as sa, sum(w.b) as sb, sum(w.aa) as saa, sum(w.bb) as sbb, sum(w.ab) as sab from (select g, r, {_draw_sql(0)} % k as i from u, (select unnest(range(500)) as r) q) d join u w on w.g is not distinct from d.g and w.j = d.i group by 1, 2),
wh as (select g, sum(n) as n, sum(a) as sa, sum(b) as sb, sum(aa) as saa, sum(bb) as sbb, sum(ab) as sab from u group by 1), ci as (select g, quantile_cont(c, 0.025) as lo, quantile_cont(c, 0.975) as hi from (select g, {_CLUSTER_R} as c from su) where c is not null group by 1)
select wh.g as setting, cast(n as bigint) as n, round({_CLUSTER_R}, 5) as r, round(lo, 5) as ci_low, round(hi, 5) as ci_high from wh left join ci using (g)""")
def clustered_correlations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rollouts").select("setting", "uid", F.length("text").cast("double").alias("x"), F.col("correct").cast("double").alias("y"))
    out = paired.clustered_correlation(r, ["setting"], "uid", "x", "y", iters=500)
    return out.select("setting", "n", *[F.round(c, 5).alias(c) for c in ("r", "ci_low", "ci_high")])


def _side_sql(side: str, seed: int) -> str:
    rows = f"select setting, rollout_key, cast(length(text) as double) as value from rollouts where setting is not null and text is not null and {side}"
    return f"select tt.g, tt.n, tt.mean, bm.r, bm.m from (with {_units_sql(rows, 'setting', 'cast(rollout_key as varchar)', 'count(*) as n, sum(value) as s')}, {_means_sql('bm', BOOT, seed)} select * from bm) bm join (select setting as g, count(*) as n, avg(length(text)) as mean from rollouts where setting is not null and text is not null and {side} group by 1) tt on tt.g = bm.g"


@query(f"""with yes as ({_side_sql('correct', 0)}), no_ as ({_side_sql('not correct', 1)}) select y.g as setting, any_value(y.n) as n_true, any_value(n.n) as n_false, round(any_value(y.mean) - any_value(n.mean), 4) as gap, round(quantile_cont(y.m - n.m, 0.025), 4) as ci_low, round(quantile_cont(y.m - n.m, 0.975), 4) as ci_high from yes y join no_ n on y.g = n.g and y.r = n.r group by 1""")
def correctness_gap(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rollouts").select("setting", "rollout_key", F.col("correct").alias("side"), F.length("text").cast("double").alias("value"))
    out = paired.two_sample_gap(r, ["setting"], "side", "value", ["rollout_key"], BOOT)
    return out.select("setting", "n_true", "n_false", *[F.round(c, 4).alias(c) for c in ("gap", "ci_low", "ci_high")])


def _newton_sql(steps: int) -> str:
    out = ["b0 as (select setting as g, length(text) / 100.0 as x, case when correct then 1.0 else 0.0 end as y, count(*) as c from rollouts where setting is not null and text is not null and correct is not null group by 1, 2, 3)", "w0 as (select distinct g, 0.0 as a, 0.0 as b, 0.0 as v, 0 as n from b0)"]
    for k in range(1, steps + 1):
        sums = f"select b0.g, any_value(a) as a, any_value(b) as b, sum(c) as n, sum(c * p * (1 - p)) as h0, sum(c * p * (1 - p) * x) as h1, sum(c * p * (1 - p) * x * x) as h2, sum(c * (y - p)) as g0, sum(c * (y - p) * x) as g1 from (select b0.*, w.a, w.b, 1 / (1 + exp(-least(greatest(w.a + w.b * x, -30.0), 30.0))) as p from b0 join w{k - 1} w on w.g = b0.g) b0 group by 1"
        out.append(f"w{k} as materialized (select g, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b, h0 / (h0 * h2 - h1 * h1) as v, n from ({sums}))")
    return ", ".join(out)


@query(f"with {_newton_sql(9)} select g as setting, cast(n as bigint) as n, round(a, 5) as intercept, round(b, 5) as slope, round(sqrt(v), 5) as se from w9")
def correctness_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression of being right on the length, by setting."""
    r = table(spark, d, "rollouts").select("setting", (F.length("text") / 100).alias("x"), F.col("correct").cast("double").alias("y"))
    return paired.logistic_slopes(r.where("setting is not null"), ["setting"], "x", "y").select("setting", "n", *[F.round(c, 5).alias(c) for c in ("intercept", "slope", "se")])


@query("""with p as (select l_returnflag as g, l_linenumber as i, least(1.0, (count(*) % 97) / 97.0) as p from lineitem group by 1, 2), r as (select *, row_number() over (partition by g order by p, i) as k, count(*) over (partition by g) as m from p)
select g, i, round(p, 6) as p, round(least(1.0, min(p * m / k) over (partition by g order by p desc range between unbounded preceding and current row)), 6) as q from r""")
def adjusted_families(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg within each family."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("i")).agg(F.least(F.lit(1.0), (F.count(F.lit(1)) % 97) / 97.0).alias("p"))
    return ranking.bh_adjusted(p, ["g"], "p").select("g", "i", R6("p").alias("p"), R6("q").alias("q"))


@query("""with t as (select l_linenumber as g, sum(case when a and b then 1 else 0 end) as n11, sum(case when a and not b then 1 else 0 end) as n10, sum(case when not a and b then 1 else 0 end) as n01, sum(case when not a and not b then 1 else 0 end) as n00
 from (select l_linenumber, l_linestatus = 'F' as a, l_returnflag <> 'N' as b from lineitem) group by 1), x as (select *, n11 + n10 + n01 + n00 as n from t)
select g, n, round((n11 + n00) / n, 6) as agreement, round(2 * (n11 + n00) / n - 1, 6) as pabak, round(((n11 + n00) / n - e) / (1 - e), 6) as kappa from (select *, ((n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01)) / (n * n) as e from x)""")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's kappa and its prevalence-adjusted form from counts of two yes/no readings."""
    a, b = F.col("l_linestatus") == "F", F.col("l_returnflag") != "N"
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    same = (n11 + n00) / (n11 + n10 + n01 + n00)
    return t.select("g", (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).alias("n"), R6(same).alias("agreement"), R6(2 * same - 1).alias("pabak"), R6(ranking.kappa(n11, n10, n01, n00)).alias("kappa"))


_CASE = """k as (select uid, setting, arg_min(correct, rollout_key) as correct, arg_min(coalesce(length(text), 0), rollout_key) as chars from rollouts where uid is not null and correct is not null group by 1, 2),
cases as (select a.uid, e.domain, a.correct as hit_a, b.correct as hit_b, a.chars as chars_a, b.chars as chars_b from k a join k b using (uid) join (select uid, min(domain) as domain from examples group by 1) e using (uid) where a.setting = 'deep' and b.setting = 'brief')"""


def preference_cases(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered in two settings: whether each was right, and how long it was."""
    k = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid", "setting").agg(F.min_by("correct", "rollout_key").alias("correct"), F.min_by(F.coalesce(F.length("text"), F.lit(0)), "rollout_key").alias("chars"))
    side = lambda s, n: k.where(F.col("setting") == s).select("uid", F.col("correct").alias(f"hit_{n}"), F.col("chars").alias(f"chars_{n}"))
    e = table(spark, d, "examples").where("uid is not null").groupBy("uid").agg(F.min("domain").alias("domain"))
    return side("deep", "a").join(side("brief", "b"), "uid").join(e, "uid")


@query(f"with {_CASE} select domain, count(*) as n, round(avg(case when hit_a then 1.0 else 0.0 end), 6) as accuracy_a, round(avg(case when hit_b then 1.0 else 0.0 end), 6) as accuracy_b, sum(case when hit_a and not hit_b then 1 else 0 end) as n10, sum(case when hit_b and not hit_a then 1 else 0 end) as n01, round(avg(case when chars_a > chars_b then 1.0 else 0.0 end), 6) as longer_a from cases group by grouping sets ((domain), ())")
def preference_accuracy(spark: SparkSession, d: str) -> DataFrame:
    c = preference_cases(spark, d).groupingSets([["domain"], []], "domain")
    share = lambda x: R6(F.avg(x.cast("int")))
    a, b = F.col("hit_a"), F.col("hit_b")
    return c.agg(F.count(F.lit(1)).alias("n"), share(a).alias("accuracy_a"), share(b).alias("accuracy_b"), F.count_if(a & ~b).alias("n10"), F.count_if(b & ~a).alias("n01"), share(F.col("chars_a") > F.col("chars_b")).alias("longer_a"))


_LOG_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_TAIL = "list_sum(list_transform(range(cast({lo} as bigint), cast({hi} as bigint) + 1), lambda i: exp(" + _LOG_CHOOSE.format("n", "i") + " + i * ln({p}) + (n - i) * ln(1 - {p}))))"
_HALF = "exp(" + _LOG_CHOOSE.format("m", "i") + " - m * ln(2))"
_COUNTS = f"{_CASE}, ct as (select coalesce(domain, '(all)') as domain, count(*) as n, sum(cast(hit_a as int)) as ka, sum(cast(hit_b as int)) as kb, sum(cast(hit_a and not hit_b as int)) as n10, sum(cast(hit_b and not hit_a as int)) as n01 from cases group by grouping sets ((domain), ()))"
#: Exact intervals of k of n by halving: where each tail holds a fortieth.
_EXACT = f"""bs as (select id, n, k, 0.0::double as l0, 1.0::double as l1, 0.0::double as h0, 1.0::double as h1, 0 as i from ask union all select id, n, k, case when tl < 0.025 then (l0 + l1) / 2 else l0 end, case when tl < 0.025 then l1 else (l0 + l1) / 2 end, case when th > 0.025 then (h0 + h1) / 2 else h0 end, case when th > 0.025 then h1 else (h0 + h1) / 2 end, i + 1
 from (select *, {_TAIL.format(lo='k', hi='n', p='((l0 + l1) / 2)')} as tl, {_TAIL.format(lo='0', hi='k', p='((h0 + h1) / 2)')} as th from bs where i < 50)),
ci as (select id, case when k = 0 or n = 0 then 0.0 else (l0 + l1) / 2 end as lo, case when k = n or n = 0 then 1.0 else (h0 + h1) / 2 end as hi from bs where i = 50)"""


@query(f"""with recursive {_COUNTS}, ask as (select 'a' || domain as id, n, ka as k from ct union all select 'd' || domain, n01 + n10, n01 from ct), {_EXACT},
ts as (select *, n01 + n10 as m, least(n01, n10) as low_, ka + kb as kk from ct)
select t.domain, t.n, round(case when m = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, cast(low_ as bigint) + 1), lambda i: {_HALF}))) end, 6) as p, round(c.lo, 6) as exact_low, round(c.hi, 6) as exact_high,
 round((ka / n + 1.959963984540054 ^ 2 / (2 * n) - 1.959963984540054 * sqrt(ka / n * (1 - ka / n) / n + 1.959963984540054 ^ 2 / (4 * n * n))) / (1 + 1.959963984540054 ^ 2 / n), 6) as wilson_low, round((ka / n + 1.959963984540054 ^ 2 / (2 * n) + 1.959963984540054 * sqrt(ka / n * (1 - ka / n) / n + 1.959963984540054 ^ 2 / (4 * n * n))) / (1 + 1.959963984540054 ^ 2 / n), 6) as wilson_high,
 round(list_sum(list_transform(list_filter(list_transform(range(cast(greatest(0, kk - n) as bigint), cast(least(kk, n) as bigint) + 1), lambda x: {_LOG_CHOOSE.format('n', 'x')} + {_LOG_CHOOSE.format('n', '(kk - x)')} - ({_LOG_CHOOSE.format('(2 * n)', 'kk')})), lambda v: v <= {_LOG_CHOOSE.format('n', 'ka')} + {_LOG_CHOOSE.format('n', 'kb')} - ({_LOG_CHOOSE.format('(2 * n)', 'kk')}) + 1e-9), lambda v: exp(v))), 6) as fisher_p,
 round(coalesce((m - 2 * list_max(list_filter(range(0, cast(floor(m / 2) as bigint) + 1), lambda q: least(1.0, 2 * list_sum(list_transform(range(0, q + 1), lambda i: {_HALF}))) < 0.05))) / n, 'NaN'::double), 6) as least_gap,
 round(case when m = 0 then 0.0 else (2 * e.lo - 1) * m / n end, 6) as delta_low, round(case when m = 0 then 0.0 else (2 * e.hi - 1) * m / n end, 6) as delta_high from ts t join ci c on c.id = 'a' || t.domain join ci e on e.id = 'd' || t.domain""")
def preference_tests(spark: SparkSession, d: str) -> DataFrame:
    """Exact tests of the accuracies by domain and over all, with intervals of the first, of the difference, and the least detectable one."""
    g = preference_cases(spark, d).groupingSets([["domain"], []], "domain")
    a, b = F.col("hit_a"), F.col("hit_b")
    c = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("ka"), F.count_if(b).alias("kb"), F.count_if(a & ~b).alias("n10"), F.count_if(b & ~a).alias("n01")).where("n > 0")
    n, n01, n10 = F.col("n"), F.col("n01"), F.col("n10")
    low, high = exact.clopper_pearson_columns(F.col("ka"), n)
    w_low, w_high = exact.wilson(F.col("ka"), n)
    d_low, d_high = exact.paired_delta_columns(n01, n10, n)
    parts = {"p": exact.mcnemar_p_column(n01, n10), "exact_low": low, "exact_high": high, "wilson_low": w_low, "wilson_high": w_high, "fisher_p": exact.fisher_p_column(F.col("ka"), n, F.col("kb"), n), "least_gap": exact.least_gap_column(n01 + n10, n), "delta_low": d_low, "delta_high": d_high}
    return c.select(F.coalesce("domain", F.lit("(all)")).alias("domain"), "n", *[R6(v).alias(k) for k, v in parts.items()])


@query(f"""with {_CASE}, t as (select domain, count(*) as n, sum(case when hit_a then 1 else 0 end) as k from cases group by 1), z as (select 1.959963984540054 as z)
select domain, n, k, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from t, z""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    t = preference_cases(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit_a").alias("k"))
    low, high = exact.wilson(F.col("k"), F.col("n"))
    return t.select("domain", "n", "k", R6(low).alias("low"), R6(high).alias("high"))


_FOLD = "('0x' || right(sha1(uid), 1))::integer % 2"


@query(f"""with {_CASE}, f as (select *, {_FOLD} as fold from cases), w as (select fold, domain, avg(case when hit_a then 1.0 else 0.0 end) >= avg(case when hit_b then 1.0 else 0.0 end) as pick_a from f group by 1, 2)
select f.domain, count(*) as n, round(avg(case when coalesce(pick_a, true) then case when hit_a then 1.0 else 0.0 end else case when hit_b then 1.0 else 0.0 end end), 6) as routed, round(avg(case when hit_a or hit_b then 1.0 else 0.0 end), 6) as either_right
from f left join w on w.domain = f.domain and w.fold = 1 - f.fold group by 1""")
def cross_fit_routing(spark: SparkSession, d: str) -> DataFrame:
    """Which setting to use in a domain is learned on one hash fold and judged on the other; either_right is the bound."""
    f = preference_cases(spark, d).withColumn("fold", F.conv(F.right(F.sha1(F.col("uid").cast("binary")), F.lit(1)), 16, 10).cast("int") % 2)
    a, b = F.col("hit_a").cast("int"), F.col("hit_b").cast("int")
    w = f.groupBy("fold", "domain").agg((F.avg(a) >= F.avg(b)).alias("pick_a")).select((1 - F.col("fold")).alias("fold"), "domain", "pick_a")
    routed = F.when(F.coalesce("pick_a", F.lit(True)), a).otherwise(b)
    return f.join(F.broadcast(w), ["fold", "domain"], "left").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(routed)).alias("routed"), R6(F.avg(F.greatest(a, b))).alias("either_right"))


@query(f"""with {_CASE}, q as (select quantile_cont(ln(greatest(chars_a, 1) / greatest(chars_b, 1)), [0.25, 0.5, 0.75]) as cuts from cases)
select band, count(*) as n, round(avg(case when hit_a then 1.0 else 0.0 end) - avg(case when hit_b then 1.0 else 0.0 end), 6) as gap from (select case when x <= cuts[1] then 1 when x <= cuts[2] then 2 when x <= cuts[3] then 3 else 4 end as band, hit_a, hit_b from (select *, ln(greatest(chars_a, 1) / greatest(chars_b, 1)) as x from cases), q) group by 1""")
def gap_by_length_band(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy gap by quartile of the log length ratio; cut points keep ties together."""
    c = preference_cases(spark, d).withColumn("x", F.log(F.greatest("chars_a", F.lit(1)) / F.greatest("chars_b", F.lit(1))))
    cuts = F.broadcast(ranking.quantiles(c, [], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    x = F.col("x")
    band = F.when(x <= F.col("q1"), 1).when(x <= F.col("q2"), 2).when(x <= F.col("q3"), 3).otherwise(4)
    return c.join(cuts).select(band.alias("band"), F.col("hit_a").cast("int").alias("a"), F.col("hit_b").cast("int").alias("b")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("a") - F.avg("b")).alias("gap"))


@query("""select setting, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 4) as intercept from (select r.setting, length(r.text) as y, length(q.question) as x from rollouts r join (select uid, min(question) as question from examples group by 1) q using (uid) where text is not null) group by 1""")
def answer_length_slope(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "examples").where("uid is not null").groupBy("uid").agg(F.min("question").alias("question"))
    j = table(spark, d, "rollouts").where("text is not null").select("uid", "setting", F.length("text").alias("y")).join(q, "uid").withColumn("x", F.length("question"))
    return j.groupBy("setting").agg(R6(F.regr_slope("y", "x")).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"))
