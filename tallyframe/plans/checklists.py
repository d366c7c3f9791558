"""Queries on whole checklists: parts of questions, exports, sources against each other, repeats, greedy steps, word tilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.functions import parsing
from tallyframe.functions import text as T
from tallyframe.operators import greedy
from tallyframe.plans import sqltext as S
from tallyframe.plans.forensics import _Q, R6
from tallyframe.plans.registry import query
from tallyframe.plans.views import RUBRIC, criteria, questions
from tallyframe.session import table


def _labelled(name: str, find: str, label: str, labels: str) -> str:
    """CTEs of the spans that begin at labels in order: name_s (uid, k, i) and name_p (uid, k, text, asking). White space is doubled before, so that
    a match may take the blank after a label that the pattern only looks at."""
    steps = [f"{name}_1 as (select uid, min(i) as i from {name} where label = '{labels[0]}' group by 1)"]
    steps += [f"{name}_{k} as (select s.uid, min(p.i) as i from {name}_{k - 1} s join {name} p on p.uid = s.uid and p.label = '{c}' and p.i > s.i group by 1)" for k, c in enumerate(labels[1:], 2)]
    union = " union all ".join(f"select uid, {k} as k, i from {name}_{k}" for k in range(1, len(labels) + 1))
    return f"""{name}_x as (select uid, string_split(regexp_replace(tx, '{find}', chr(1) || '\\0', 'g'), chr(1)) as ps from tx), {name} as (select uid, i, piece, regexp_extract(piece, '{label}', 1) as label from (select uid, unnest(ps) as piece, generate_subscripts(ps, 1) as i from {name}_x) where i > 1),
{', '.join(steps)}, {name}_s as (select *, lead(i) over (partition by uid order by k) as until from ({union})),
{name}_p as (select s.uid, s.k, string_agg(p.piece, '' order by p.i) as text from {name}_s s join {name} p on p.uid = s.uid and p.i >= s.i and (s.until is null or p.i < s.until) where s.uid in (select uid from {name}_2) group by 1, 2)"""


_PARTS = f"""q as (select * from {_Q}), tx as (select uid, regexp_replace(coalesce(question, ''), '(\\s)', '\\1\\1', 'g') as tx from q),
{_labelled('lt', '(?m)(?:^|[\\s(])\\(?([a-h])[\\)\\.]\\s', '^(?:[\\s(])?\\(?([a-h])[\\)\\.]\\s', 'abcdefgh')}, {_labelled('nm', '(?:^|\\n)\\s*\\(?([1-9])[\\)\\.]\\s', '^\\s*\\(?([1-9])[\\)\\.]\\s', '123456789')},
pa as (select *, contains(text, '?') or regexp_matches(text, {S.lit(L.TASK_CUE)}) as asking from (select * from lt_p union all select * from nm_p where uid not in (select uid from lt_p))),
kd as (select uid, case when sum(cast(asking as int)) >= 2 then 'subquestions' else 'mcq' end as kind from pa group by 1), pt as (select pa.uid, kind, k, text from pa join kd using (uid) where kind = 'mcq' or asking),
kn as (select q.uid, q.domain, q.question, q.reference_answer, coalesce(kind, 'none') as kind, coalesce(n, 0) as n_parts from q left join kd using (uid) left join (select uid, count(*) as n from pt group by 1) c using (uid))"""


@query(f"with {_PARTS} select domain, kind, count(*) as n, round(avg(n_parts), 6) as mean_parts from kn group by 1, 2")
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Enumerated questions by kind, with the number of parts."""
    q = questions(spark, d).select("domain", parsing.question_parts_column(F.col("question")).alias("p"))
    return q.groupBy("domain", F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.size("p.parts"))).alias("mean_parts"))


@query(f"with {_PARTS} select uid, domain, case when kind = 'subquestions' then n_parts else 0 end as n_subparts, kind = 'mcq' as is_mcq, len({S.words('question')}) as question_words, len({S.words('reference_answer')}) as reference_words from kn")
def question_complexity(spark: SparkSession, d: str) -> DataFrame:
    p = parsing.question_parts_column(F.col("question"))
    q = questions(spark, d).select("uid", "domain", p.alias("p"), F.size(T.words(F.col("question"))).alias("question_words"), F.size(T.words(F.col("reference_answer"))).alias("reference_words"))
    return q.select("uid", "domain", F.when(F.col("p.kind") == "subquestions", F.size("p.parts")).otherwise(0).alias("n_subparts"), (F.col("p.kind") == "mcq").alias("is_mcq"), "question_words", "reference_words")


@query(f"""with {_PARTS}, {S.NORMALISED}, pw as (select uid, k, list_distinct({S.content_tokens('text')}) as pw from pt), cw as (select run_name, rubric_source, uid, list_distinct(list_concat({S.content_tokens('body')}, {S.content_tokens('title')})) as cw from n),
be as (select run_name, rubric_source, uid, k, max(case when len(pw) > 0 and len(cw) > 0 then len(list_intersect(pw, cw)) / sqrt(len(pw) * len(cw)) else 0 end) as best from pw join cw using (uid) group by 1, 2, 3, 4)
select run_name, rubric_source, uid, count(*) as n_parts, sum(case when best < 0.1 then 1 else 0 end) as n_orphans, round(avg(best), 6) as mean_best from be group by 1, 2, 3""")
def part_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's labelled parts that no criterion of a rubric covers (binary cosine of content words below 0.1). Parts and
    criteria meet on the question, a small product for each rubric."""
    q = questions(spark, d).select("uid", parsing.question_parts_column(F.col("question")).alias("p")).where("p.kind != 'none'")
    parts = q.select("uid", F.posexplode("p.parts").alias("part", "x")).select("uid", "part", F.array_distinct(T.content_tokens(F.col("x.text"))).alias("pw"))
    c = criteria(spark, d).select(*RUBRIC, F.array_distinct(F.concat(T.content_tokens(F.col("body")), T.content_tokens(F.col("title")))).alias("cw"))
    best = parts.join(c, "uid").groupBy(*RUBRIC, "part").agg(F.max(T.binary_cosine(F.col("pw"), F.col("cw"))).alias("best"))
    return best.groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("best") < 0.1).alias("n_orphans"), R6(F.avg("best")).alias("mean_best"))


@query(f"""with {S.NORMALISED} select run_name, rubric_source, uid, count(*) as n_criteria, string_agg(cat || ' Criteria: ' || body, chr(10) order by pos, criterion_id) as checklist from n where uid is not null group by 1, 2, 3""")
def rubric_exports(spark: SparkSession, d: str) -> DataFrame:
    """Each rubric as one record with its items in order."""
    c = criteria(spark, d).where("uid is not null").select(*RUBRIC, "pos", "criterion_id", F.concat("cat", F.lit(" Criteria: "), "body").alias("line"))
    g = c.groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("n_criteria"), F.array_sort(F.collect_list(F.struct("pos", "criterion_id", "line"))).alias("l"))
    return g.select(*RUBRIC, "n_criteria", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("checklist"))


@query("""with s as (select uid, max(len(shipped_rubric.items)) as shipped from examples where shipped_rubric is not null group by 1), c as (select uid, max(n) as listed from (select uid, run_name, count(*) as n from criteria where rubric_source = 'shipped' and uid is not null group by 1, 2) group by 1)
select uid, shipped, listed, case when shipped is null then 'not shipped' when listed is null then 'not listed' when shipped = listed then 'equal' else 'differs' end as state from s full join c using (uid)""")
def shipped_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nested checklists against the rows of source ``shipped``."""
    s = table(spark, d, "examples").where("shipped_rubric is not null").groupBy("uid").agg(F.max(F.size("shipped_rubric.items")).alias("shipped"))
    c = table(spark, d, "criteria").where("rubric_source = 'shipped' and uid is not null").groupBy("uid", "run_name").agg(F.count(F.lit(1)).alias("n")).groupBy("uid").agg(F.max("n").alias("listed"))
    state = F.when(F.col("shipped").isNull(), "not shipped").when(F.col("listed").isNull(), "not listed").when(F.col("shipped") == F.col("listed"), "equal").otherwise("differs")
    return s.join(c, "uid", "full").select("uid", "shipped", "listed", state.alias("state"))


@query("""with m as (select uid, rubric_source as s, round(avg(length(body)), 6) as v from criteria where uid is not null and body is not null group by 1, 2), p as (select a.s || ' / ' || b.s as pair, sign(a.v - b.v) as w from m a join m b using (uid) where a.s < b.s)
select pair, count(*) as n, sum(case when w > 0 then 1 else 0 end) as wins_a, sum(case when w < 0 then 1 else 0 end) as wins_b, sum(case when w = 0 then 1 else 0 end) as ties, round(avg(case when w > 0 then 1.0 when w = 0 then 0.5 else 0.0 end), 6) as share_a from p group by grouping sets ((pair), ())""")
def sources_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of sources on common questions, by the mean length of their items, with the grand total."""
    m = table(spark, d, "criteria").where("uid is not null and body is not null").groupBy("uid", F.col("rubric_source").alias("s")).agg(R6(F.avg(F.length("body"))).alias("v"))
    a, b = m.alias("a"), m.alias("b")
    p = a.join(b, (F.col("a.uid") == F.col("b.uid")) & (F.col("a.s") < F.col("b.s"))).select(F.concat("a.s", F.lit(" / "), "b.s").alias("pair"), F.signum(F.col("a.v") - F.col("b.v")).alias("w"))
    w = F.col("w")
    return p.groupingSets([["pair"], []], "pair").agg(F.count(F.lit(1)).alias("n"), F.count_if(w > 0).alias("wins_a"), F.count_if(w < 0).alias("wins_b"), F.count_if(w == 0).alias("ties"), R6(F.avg(F.when(w > 0, 1.0).when(w == 0, 0.5).otherwise(0.0))).alias("share_a"))


@query("""with v as (select rubric_source, uid, title, weight, count(distinct run_name) as k from criteria where uid is not null and title is not null and weight is not null group by 1, 2, 3, 4), i as (select rubric_source, uid, title, sum(k) as n, sum(k * (k - 1) / 2) as agree from v group by 1, 2, 3)
select rubric_source, sum(n * (n - 1) / 2) as n_pairs, round(sum(agree) / sum(n * (n - 1) / 2), 6) as self_agreement from i where n > 1 group by 1""")
def self_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether runs give an item the same weight: agreeing pairs of repeats out of all pairs, from counts, so no pair is made."""
    base = table(spark, d, "criteria").where("uid is not null and title is not null and weight is not null")
    v = base.groupBy("rubric_source", "uid", "title", "weight").agg(F.count_distinct("run_name").alias("k"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    i = v.groupBy("rubric_source", "uid", "title").agg(F.sum("k").alias("n"), F.sum(pairs("k")).alias("agree")).where("n > 1")
    return i.groupBy("rubric_source").agg(F.sum(pairs("n")).alias("n_pairs"), R6(F.sum("agree") / F.sum(pairs("n"))).alias("self_agreement"))


_MIRRORED = f"regexp_replace(regexp_replace(coalesce(body, ''), {S.lit(L.NEGATIVE_OPENER)}, ''), {S.lit(L.POSITIVE_OPENER)}, '')"
_OVERLAP = "case when len({0}) = 0 or len({1}) = 0 then 0 else len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end"


@query(f"""with recursive {S.NORMALISED}, it as (select criterion_id as id, concat_ws('|', run_name, rubric_source, uid) as g, row_number() over (partition by run_name, rubric_source, uid order by pos, criterion_id) as i, abs(w) as w, list_distinct(regexp_extract_all(lower({_MIRRORED}), '[a-z0-9]+')) as ws,
 list_sort(list_distinct(list_concat(regexp_extract_all(lower(body), '\\d+(?:[.,]\\d+)?'), regexp_extract_all(lower(body), '\\(([a-e])\\)', 1)))) as sg from n where uid is not null),
kp as (select g, i, [struct_pack(id := id, w := w, ws := ws, sg := sg)] as kept from it where i = 1 union all
 select g, i, case when twin is null then list_append(kept, cur) when cur.w > kept[twin].w then list_transform(kept, lambda x, j: case when j = twin then cur else x end) else kept end from
 (select g, i, kept, cur, list_position(list_transform(kept, lambda x: x.sg = cur.sg and {_OVERLAP.format('x.ws', 'cur.ws')} >= 0.6), true) as twin from (select kp.g, it.i, kept, struct_pack(id := it.id, w := it.w, ws := it.ws, sg := it.sg) as cur from kp join it on it.g = kp.g and it.i = kp.i + 1)))
select unnest(list_transform(kept, lambda x: x.id)) as criterion_id from kp join (select g, max(i) as i from it group by 1) m using (g, i)""".replace("twin is null", "coalesce(twin, 0) = 0"))
def without_mirrors(spark: SparkSession, d: str) -> DataFrame:
    """Rubrics without items that repeat an earlier one."""
    c = criteria(spark, d).where("uid is not null").select("criterion_id", *RUBRIC, "pos", "body", "w")
    return greedy.without_mirrors(c, RUBRIC, "body", "w", ["pos", "criterion_id"]).select("criterion_id")


@query(f"""with {S.NORMALISED}, it as (select criterion_id as id, concat_ws('|', run_name, uid) as g, rubric_source = 'framed' as own, w, pos, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) as ws from n where uid is not null and rubric_source in ('framed', 'shipped')),
el as (select *, row_number() over (partition by g order by w desc, pos, id) as r from it c where not own and w > 0 and not exists (select 1 from it o where o.own and o.g = c.g and {_OVERLAP.format('o.ws', 'c.ws')} >= 0.5)),
f1 as (select * from el where r = 1), f2 as (select c.g, min(c.r) as r from el c join f1 on f1.g = c.g where c.r > 1 and {_OVERLAP.format('f1.ws', 'c.ws')} < 0.5 group by 1)
select id as criterion_id, own from it where own union all select id, own from f1 union all select id, own from el join f2 using (g, r)""")
def with_upstream_items(spark: SparkSession, d: str) -> DataFrame:
    """Framed rubrics with up to two heavy shipped items they lack."""
    c = criteria(spark, d).where("uid is not null and rubric_source in ('framed', 'shipped')").select("criterion_id", "run_name", "uid", "pos", "body", "w", (F.col("rubric_source") == "framed").alias("own"))
    return greedy.with_best_missing(c, ["run_name", "uid"], "body", "w", "own", ["pos", "criterion_id"], 2).select("criterion_id", "own")


@query(f"with {S.NORMALISED} select criterion_id from (select criterion_id, row_number() over (partition by run_name, rubric_source, uid order by abs(w) desc, pos, criterion_id) as r from n where uid is not null) where r <= 7")
def bounded_rubrics(spark: SparkSession, d: str) -> DataFrame:
    c = criteria(spark, d).where("uid is not null").select("criterion_id", *RUBRIC, "pos", "w")
    return greedy.within_bounds(c, RUBRIC, "w", ["pos", "criterion_id"], 7).select("criterion_id")


@query(f"""with {S.NORMALISED}, it as (select criterion_id as id, concat_ws('|', run_name, uid) as g, rubric_source = 'shipped' as spare, cat = 'Pitfall' as pit, w, pos from n where uid is not null and rubric_source in ('framed', 'shipped')),
ow as (select *, row_number() over (partition by g, pit order by abs(w), pos, id) as r, count(*) over (partition by g) as k, sum(cast(pit as int)) over (partition by g) as p from it where not spare), pl as (select *, row_number() over (partition by g order by w desc, pos, id) as r, count(*) over (partition by g) as k from it where spare and not pit),
sw as (select o.g, greatest(0, least(any_value(o.p) - greatest(1, floor(any_value(o.k) * 0.25)), coalesce(any_value(l.k), 0))) as n from ow o left join (select distinct g, k from pl) l using (g) group by 1)
select id as criterion_id from ow join sw using (g) where not pit or r > n union all select id from pl join sw using (g) where r <= n""")
def balanced_pitfalls(spark: SparkSession, d: str) -> DataFrame:
    """Framed rubrics whose pitfalls are at most a quarter, filled up from the shipped ones."""
    c = criteria(spark, d).where("uid is not null and rubric_source in ('framed', 'shipped')").select("criterion_id", "run_name", "uid", "pos", "cat", "w", (F.col("rubric_source") == "shipped").alias("spare"))
    return greedy.balanced_pitfalls(c, ["run_name", "uid"], "cat", "w", "spare", ["pos", "criterion_id"]).select("criterion_id")


@query()
def tolerant_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads read strictly and with repairs."""
    r = table(spark, d, "raw_entries").select("rubric_source", F.try_parse_json("payload").isNotNull().alias("strict"), parsing.tolerant_json_column(F.col("payload"), "object").isNotNull().alias("repaired"))
    return r.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("n_strict"), F.count_if("repaired").alias("n_object_after_repair"))


#: Units of the answers at hand: what a prefix may stand before, with dimensions; words of time have none.
_SQL_UNITS = {"m": "1,0,0,0,0,0", "g": "0,1,0,0,0,0", "s": "0,0,1,0,0,0", "A": "0,0,0,1,0,0", "K": "0,0,0,0,1,0", "mol": "0,0,0,0,0,1", "N": "1,1,-2,0,0,0", "J": "2,1,-2,0,0,0", "W": "2,1,-3,0,0,0", "Pa": "-1,1,-2,0,0,0", "C": "0,0,1,1,0,0", "V": "2,1,-3,-1,0,0", "Hz": "0,0,-1,0,0,0", "L": "3,0,0,0,0,0", "eV": "2,1,-2,0,0,0", "mmHg": "-1,1,-2,0,0,0"}
_SQL_SCALE = {"g": 1e-3, "L": 1e-3, "eV": 1.602176634e-19, "mmHg": 133.322387415}
_SQL_PREFIX = {"": 1, "k": 1e3, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "M": 1e6, "G": 1e9}
_SIMPLE = "ut as (select * from (values " + ", ".join(f"('{p}{u}', '{dims}', {f * _SQL_SCALE.get(u, 1.0)!r})" for u, dims in _SQL_UNITS.items() for p, f in _SQL_PREFIX.items()) + ") t(name, dims, f))"


@query(f"""with {_SIMPLE}, an as (select left(trim(regexp_replace(x[len(x)], '\\s+', ' ', 'g')), 400) as answer from (select regexp_extract_all(text, '(?i)final\\s*answer\\s*[:\\-]\\s*([^\\n]+)', 1) as x from rollouts) where len(x) > 0),
un as (select regexp_extract(answer, '^[-+]?\\d[\\d.,]*(?:[eE][-+]?\\d+)?\\s+([A-Za-z]+)\\.?$', 1) as name from an) select dims as dimensions, count(*) as n, count(distinct round(log10(f), 6)) as n_scales from un join ut using (name) group by 1""")
def answer_units(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions of final answers that are a number and one unit by its symbol."""
    a = table(spark, d, "rollouts").select(T.final_answer(F.col("text")).alias("answer")).where(F.col("answer").rlike(r"^[-+]?\d[\d.,]*(?:[eE][-+]?\d+)?\s+[A-Za-z]+\.?$"))
    name = F.regexp_extract("answer", r"([A-Za-z]+)\.?$", 1)
    u = a.select(name.alias("name"), parsing.unit_column(F.regexp_replace("answer", r"\.$", "")).alias("u")).where("u.dims is not null")
    known = u.where(F.col("name").isin([p + x for x in _SQL_UNITS for p in _SQL_PREFIX]))
    return known.groupBy(F.array_join("u.dims", ",").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round(F.log10("u.scale"), 6)).alias("n_scales"))


def _tilt_words(c: str) -> str:
    return f"list_distinct({S.content_tokens(c)})"


_TILT = f"""q as (select * from {_Q}), r as (select uid, arg_min(text, rollout_key) filter (where correct) as win, arg_min(text, rollout_key) filter (where not correct) as lose from rollouts where uid is not null and text is not null group by 1 having win is not null and lose is not null),
t as (select rubric_source, uid, unnest({S.content_tokens('body')}) as t from criteria where uid is not null), c as (select rubric_source, uid, t, count(*) as tf from t group by 1, 2, 3),
w as (select r.uid, {_tilt_words('win')} as win, {_tilt_words('lose')} as lose, {_tilt_words('q.question')} as ask from r join q using (uid)),
n as (select rubric_source, uid, tf, case when list_contains(win, t) then 1 else 0 end as hw, case when list_contains(lose, t) then 1 else 0 end as hl from c join w using (uid) where not list_contains(ask, t))"""


@query(f"""with {_TILT}, k as (select rubric_source, uid, sum(hw - hl) / count(*) as tilt, sum(tf * (hw - hl)) / sum(tf) as tilt_tf, sum(hw - hl) as num, count(*) as den from n group by 1, 2)
select rubric_source, count(*) as n, round(avg(tilt), 6) as tilt, round(avg(tilt_tf), 6) as tilt_by_frequency, round(sum(num) / sum(den), 6) as micro_tilt, round(avg(tilt) - 1.96 * stddev_samp(tilt) / sqrt(count(*)), 6) as low, round(avg(tilt) + 1.96 * stddev_samp(tilt) / sqrt(count(*)), 6) as high from k group by 1""")
def word_tilt(spark: SparkSession, d: str) -> DataFrame:
    """Whether a rubric's words that aren't in the question occur more in a right than in a wrong answer."""
    k = _tilt(spark, d).groupBy("rubric_source", "uid").agg((F.sum(F.col("hw") - F.col("hl")) / F.count(F.lit(1))).alias("tilt"), (F.sum(F.col("tf") * (F.col("hw") - F.col("hl"))) / F.sum("tf")).alias("tilt_tf"), F.sum(F.col("hw") - F.col("hl")).alias("num"), F.count(F.lit(1)).alias("den"))
    half = 1.96 * F.stddev_samp("tilt") / F.sqrt(F.count(F.lit(1)))
    return k.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("tilt")).alias("tilt"), R6(F.avg("tilt_tf")).alias("tilt_by_frequency"), R6(F.sum("num") / F.sum("den")).alias("micro_tilt"), R6(F.avg("tilt") - half).alias("low"), R6(F.avg("tilt") + half).alias("high"))


def _tilt(spark: SparkSession, d: str) -> DataFrame:
    """(rubric_source, uid, t, tf, hw, hl): new words of each source's rubric for a question, and whether the right and wrong answer have them."""
    r = table(spark, d, "rollouts").where("uid is not null and text is not null").groupBy("uid").agg(F.min_by("text", F.when(F.col("correct"), F.col("rollout_key"))).alias("win"), F.min_by("text", F.when(~F.col("correct"), F.col("rollout_key"))).alias("lose"))
    both = r.where("win is not null and lose is not null")
    words = lambda c, n: F.array_distinct(T.content_tokens(F.col(c))).alias(n)
    w = both.join(questions(spark, d).select("uid", "question"), "uid").select("uid", words("win", "win"), words("lose", "lose"), words("question", "ask"))
    t = table(spark, d, "criteria").where("uid is not null").select("rubric_source", "uid", F.explode(T.content_tokens(F.col("body"))).alias("t")).groupBy("rubric_source", "uid", "t").agg(F.count(F.lit(1)).alias("tf"))
    n = t.join(w, "uid").where(~F.array_contains("ask", F.col("t")))
    return n.select("rubric_source", "uid", "t", "tf", F.array_contains("win", F.col("t")).cast("int").alias("hw"), F.array_contains("lose", F.col("t")).cast("int").alias("hl"))


@query(f"""with {_TILT.replace('tf, case', 't, tf, case')}, df as (select t, count(*) as df from (select rollout_key, unnest({_tilt_words('text')}) as t from rollouts where text is not null) group by 1), m as (select count(*) as m from rollouts where text is not null)
select rubric_source, cast(floor(log2(coalesce(df, 0.5) / m)) as integer) as band, count(*) as n, round(avg(hw - hl), 6) as tilt from n left join df using (t), m group by 1, 2""")
def word_tilt_by_rarity(spark: SparkSession, d: str) -> DataFrame:
    """The same by powers of two of the share of answers that have a word."""
    texts = table(spark, d, "rollouts").where("text is not null")
    df = texts.select(F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    m = texts.count()
    band = F.floor(F.log2(F.coalesce(F.col("df").cast("double"), F.lit(0.5)) / m)).cast("int")
    return _tilt(spark, d).join(df, "t", "left").groupBy("rubric_source", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("hw") - F.col("hl"))).alias("tilt"))


@query(f"""with {S.NORMALISED} select rubric_source, count(*) as n, round(avg(len({S.words('body')})), 6) as mean_words, round(avg(case when contains(body, '?') then 1.0 else 0.0 end), 6) as question_share,
 round(avg(case when regexp_matches(body, '(?i)\\b(not|no|never|without|avoid\\w*)\\b') then 1.0 else 0.0 end), 6) as negation_share, round(avg(case when regexp_matches(coalesce(description,''), '(?i)\\(\\s*[a-eA-E]\\s*\\)|\\boption\\b|\\banswer\\b|\\bchoice\\b') then 1.0 else 0.0 end), 6) as option_share from n group by 1""")
def rubric_form(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: R6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    body = F.col("body")
    return criteria(spark, d).groupBy("rubric_source").agg(
        F.count(F.lit(1)).alias("n"), R6(F.avg(F.size(T.words(body)))).alias("mean_words"), share(body.contains("?")).alias("question_share"),
        share(body.rlike(r"(?i)\b(not|no|never|without|avoid\w*)\b")).alias("negation_share"), share(T.or_empty(F.col("description")).rlike(L.OPTION)).alias("option_share"),
    )


@query(f"""with {S.NORMALISED}, doc as (select criterion_id as id, rubric_source || '|' || run_name || '|' || uid as g, body as text from n where uid is not null),
tf as (select id, g, t, 1 + ln(count(*)) as tf from (select id, g, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) as t from doc) group by 1, 2, 3), df as (select g, t, count(*) as df from tf group by 1, 2), nd as (select g, count(*) as nd from doc group by 1),
raw as (select id, g, t, tf * (ln((1 + nd) / (1 + df)) + 1) as x from tf join df using (g, t) join nd using (g)), vec as (select id, g, t, x / sqrt(sum(x * x) over (partition by id)) as x from raw),
s as (select a.g, a.id as a, b.id as b, sum(a.x * b.x) as s from vec a join vec b using (g, t) where a.id < b.id group by 1, 2, 3) select a, b, round(s, 5) as similarity from s where s > 0.5""")
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Items of one rubric with TF-IDF cosine above one half, document frequencies within the rubric."""
    from tallyframe.operators.similarity import cosine_pairs, tfidf_vectors

    doc = criteria(spark, d).where("uid is not null").select(F.col("criterion_id").alias("id"), *RUBRIC, F.col("body").alias("text"))
    pairs = cosine_pairs(tfidf_vectors(doc, "id", "text", RUBRIC), "id", RUBRIC, 0.5)
    return pairs.select("a", "b", F.round("s", 5).alias("similarity"))
