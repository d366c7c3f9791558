"""Vocabularies, tokenisers, portability, duplicates inside a rubric, null tilts, targets and other details of single steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import exact, parsing, preference, rewriting
from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T
from tallyframe.operators import merging, ranking, similarity
from tallyframe.plans import sqltext as S
from tallyframe.plans.checklists import _PARTS, _TILT, _tilt
from tallyframe.plans.evaluation import _CASE, _HALF, _LADDER, _LOG_CHOOSE, ladder, preference_cases
from tallyframe.plans.forensics import _ANCHORS, _Q, R6, anchors
from tallyframe.plans.judges import _READ, _SLOTS, readings, slot_verdicts
from tallyframe.plans.registry import SQL, query
from tallyframe.plans.reports import _PAIRS, REFUSAL, RESTRAINT
from tallyframe.plans.views import RUBRIC, criteria, questions
from tallyframe.session import table


@query(f"""with w as (select criterion_id, {S.content_tokens('body')} as w from criteria), g as (select criterion_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), nd as (select count(*) as nd from criteria),
f as (select term, count(*) as tf, count(distinct criterion_id) as df from g group by 1 having count(distinct criterion_id) >= 3) select term, tf, df, round(ln((1 + nd) / (1 + df)) + 1, 6) as idf from f, nd order by tf desc, term limit 500""")
def top_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent words and pairs of words without stop words, in three criteria or more, with their inverse document frequency."""
    docs = table(spark, d, "criteria").select("criterion_id", T.content_tokens(F.col("body")).alias("w"))
    return similarity.vocabulary(docs, "criterion_id", similarity.with_pairs(F.col("w")), min_df=3, most=500).select("term", "tf", "df", R6("idf").alias("idf"))


#: Tokenisers by name: pattern, least length, whether stop words go.
TOKENISERS = {
    "letters": (r"[a-z]+", 3, True), "no stop list": (r"[a-z]+", 3, False), "four letters": (r"[a-z]+", 4, True), "five letters": (r"[a-z]+", 5, True), "inner marks": (r"[a-z][a-z'-]{2,}", 3, True),
    "letters and digits": (r"[a-z0-9]+", 1, True), "words and symbols": (r"\w+|[^\w\s]", 1, False), "word characters": (r"\w\w+", 2, False), "numbers": (r"\d+(?:\.\d+)?", 1, False),
}


def _token_sql(pattern: str, least: int, stop: bool) -> str:
    words = f"regexp_extract_all(lower(coalesce(body, '')), {S.lit(pattern)})"
    return f"list_filter({words}, lambda t: length(t) >= {least}" + (f" and not list_contains({S.values(L.STOPWORDS)}, t))" if stop else ")")


@query(" union all ".join(f"select '{name}' as tokeniser, count(*) as n_tokens, count(distinct t) as n_distinct from (select unnest({_token_sql(*spec)}) as t from criteria)" for name, spec in TOKENISERS.items()))
def tokeniser_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all criteria under tokenisers that differ in pattern, least length and stop words, in one pass."""
    specs = F.array(*[F.struct(F.lit(name).alias("tokeniser"), T.tokens_by(F.col("body"), *spec).alias("ts")) for name, spec in TOKENISERS.items()])
    long = table(spark, d, "criteria").select(F.explode(specs).alias("x")).select("x.tokeniser", F.explode("x.ts").alias("t"))
    return long.groupBy("tokeniser", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("tokeniser").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"))


PROBES = 5


@query(f"""with {_ANCHORS}, u as (select domain, uid, row_number() over (partition by domain order by md5(concat('51:', uid)), uid) - 1 as i, count(*) over (partition by domain) as n from q), pr as (select a.uid, b.uid as probe from u a join u b on a.domain = b.domain and a.uid <> b.uid and (b.i - a.i + a.n) % a.n between 1 and {PROBES}),
sp as (select criterion_id, uid, list(t) as sp from (select criterion_id, uid, unnest({S.criterion_tokens('body')}) as t from criteria where uid in (select uid from q)) join anch using (uid, t) group by 1, 2), tk as (select uid, {S.criterion_tokens('question')} as tk from q)
select criterion_id, len(sp) as n_specific, sum(cast(len(list_intersect(sp, tk)) = len(sp) as int)) as portable_count, count(*) as n_probes from sp join pr using (uid) join tk on tk.uid = probe group by 1, 2""")
def question_portability(spark: SparkSession, d: str) -> DataFrame:
    """Criteria with specific terms: in how many of five other questions of the domain, the next ones in hash order, all of them occur too."""
    q = questions(spark, d)
    places = merging.positions(q.select("domain", "uid"), ["domain"], "uid", 51)
    ahead = places.select("domain", "uid", F.explode(F.sequence(F.lit(1), F.lit(PROBES))).alias("k"), "_i", "_n").select("domain", "uid", F.pmod(F.col("_i") + F.col("k"), F.col("_n")).alias("_i"))
    probes = ahead.join(places.select("domain", "_i", F.col("uid").alias("probe")), ["domain", "_i"]).where("uid != probe").select("uid", "probe").distinct()
    found = table(spark, d, "criteria").select("criterion_id", "uid", F.explode(T.criterion_tokens(F.col("body"))).alias("t")).join(anchors(spark, d), ["uid", "t"])
    specific = found.groupBy("criterion_id", "uid").agg(F.collect_list("t").alias("sp"))  # no more than a criterion's words
    tokens = q.select(F.col("uid").alias("probe"), T.criterion_tokens(F.col("question")).alias("tk"))
    j = specific.join(probes, "uid").join(tokens, "probe")
    return j.groupBy("criterion_id").agg(F.first(F.size("sp")).alias("n_specific"), F.count_if(F.size(F.array_except("sp", "tk")) == 0).alias("portable_count"), F.count(F.lit(1)).alias("n_probes"))


@query(f"""with {S.NORMALISED}, w as (select criterion_id as id, concat_ws('|', run_name, rubric_source, uid) as g, list_distinct({S.content_tokens('body')}) as ws from n where uid is not null), e as (select id, g, len(ws) as n, unnest(ws) as t from w)
select a, b, round(o / (na + nb - o), 6) as similarity from (select x.id as a, y.id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as o from e x join e y on x.g = y.g and x.t = y.t and x.id < y.id group by 1, 2) where o / (na + nb - o) >= 0.6""")
def duplicates_within_rubrics(spark: SparkSession, d: str) -> DataFrame:
    """Items of one rubric that share 60 % of their content words. Only items that share a word meet."""
    w = criteria(spark, d).where("uid is not null").select(F.col("criterion_id").alias("id"), *RUBRIC, F.array_distinct(T.content_tokens(F.col("body"))).alias("ws"))
    e = w.select("id", *RUBRIC, F.size("ws").alias("n"), F.explode("ws").alias("t"))
    x, y = e.select(*RUBRIC, "t", F.col("id").alias("a"), F.col("n").alias("na")), e.select(*RUBRIC, "t", F.col("id").alias("b"), F.col("n").alias("nb"))
    o = x.join(y, [*RUBRIC, "t"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("o"))
    s = F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    return o.where(s >= 0.6).select("a", "b", R6(s).alias("similarity"))


DONORS = 120
_NULL = f"""{_TILT.replace('tf, case', 't, tf, case')}, dm as (select uid, domain from q), nv as (select uid, list(distinct t) as nv from n group by 1), cs as (select w.uid, domain, win, lose, nv, round(ln((len(win) + 1) / (len(lose) + 1)), 9) as ratio from w join dm using (uid) join nv using (uid)),
dr as (select a.uid, b.uid as donor, row_number() over (partition by a.uid order by abs(a.ratio - b.ratio), b.uid) as r from cs a join cs b on a.domain = b.domain and a.uid <> b.uid),
tl as (select dr.uid, avg((len(list_intersect(b.nv, a.win)) - len(list_intersect(b.nv, a.lose))) / len(b.nv)) as null_tilt from dr join cs a on a.uid = dr.uid join cs b on b.uid = dr.donor where r <= {DONORS} group by 1),
ow as (select uid, domain, (len(list_intersect(nv, win)) - len(list_intersect(nv, lose))) / len(nv) as own_tilt from cs)"""


@query(f"with {_NULL} select domain, count(*) as n, round(avg(own_tilt), 6) as tilt, round(avg(null_tilt), 6) as null_tilt, round(avg(own_tilt - null_tilt), 6) as excess, round(avg(own_tilt - null_tilt) - 1.96 * stddev_samp(own_tilt - null_tilt) / sqrt(count(*)), 6) as low, round(avg(own_tilt - null_tilt) + 1.96 * stddev_samp(own_tilt - null_tilt) / sqrt(count(*)), 6) as high from ow join tl using (uid) group by grouping sets ((domain), ())")
def cross_pair_null(spark: SparkSession, d: str) -> DataFrame:
    """Word tilt of a question's own rubrics over that of the 120 rubrics of its domain whose answers have the nearest length ratio. Candidates lie
    within 120 places in sorted order on either side (ties in the ratio by id), so no domain is joined with itself."""
    t = _tilt(spark, d).select("uid", "t").distinct().groupBy("uid").agg(F.collect_list("t").alias("nv"))  # no more than a question's rubrics have words
    r = table(spark, d, "rollouts").where("uid is not null and text is not null").groupBy("uid").agg(F.min_by("text", F.when(F.col("correct"), F.col("rollout_key"))).alias("win"), F.min_by("text", F.when(~F.col("correct"), F.col("rollout_key"))).alias("lose"))
    words = lambda c: F.array_distinct(T.content_tokens(F.col(c))).alias(c)
    cs = t.join(r.where("win is not null and lose is not null").select("uid", words("win"), words("lose")), "uid").join(questions(spark, d).select("uid", "domain"), "uid")
    cs = cs.withColumn("ratio", F.round(F.log((F.size("win") + 1) / (F.size("lose") + 1)), 9))
    placed = ranking.running_totals(cs, ["domain"], [F.col("ratio"), F.col("uid")], F.lit(1)).drop("_total")
    around = placed.select("domain", "uid", "ratio", F.explode(F.sequence(F.col("_before") - DONORS, F.col("_before") + DONORS)).alias("_before"))
    donors = around.join(placed.select("domain", "_before", F.col("uid").alias("donor"), F.col("ratio").alias("other")), ["domain", "_before"]).where("uid != donor")
    r = F.row_number().over(Window.partitionBy("uid").orderBy(F.abs(F.col("ratio") - F.col("other")), "donor"))
    near = donors.withColumn("r", r).where(F.col("r") <= DONORS).select("uid", "donor")
    tilt = lambda nv: (F.size(F.array_intersect(nv, F.col("win"))) - F.size(F.array_intersect(nv, F.col("lose")))) / F.size(nv)
    null = near.join(cs.select(F.col("uid").alias("donor"), F.col("nv").alias("dn")), "donor").join(cs.select("uid", "win", "lose"), "uid").groupBy("uid").agg(F.avg(tilt(F.col("dn"))).alias("null_tilt"))
    both = cs.select("uid", "domain", tilt(F.col("nv")).alias("own")).join(null, "uid").withColumn("e", F.col("own") - F.col("null_tilt"))
    half = 1.96 * F.stddev_samp("e") / F.sqrt(F.count(F.lit(1)))
    return both.groupingSets([["domain"], []], "domain").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("own")).alias("tilt"), R6(F.avg("null_tilt")).alias("null_tilt"), R6(F.avg("e")).alias("excess"), R6(F.avg("e") - half).alias("low"), R6(F.avg("e") + half).alias("high"))


_BANDS = f"""{_TILT.replace('tf, case', 't, tf, case')}, df as (select t, count(*) as df from (select rollout_key, unnest(list_distinct({S.content_tokens('text')})) as t from rollouts where text is not null) group by 1), m as (select count(*) as m from rollouts where text is not null), bd as (select t, cast(floor(log2(df / m)) as integer) as band from df, m), sz as (select band, count(*) as k from bd group by 1),
hw as (select uid, band, sum(x) as s, sum(abs(x)) as a from (select uid, t, sum(x) as x from (select uid, unnest(win) as t, 1 as x from w union all select uid, unnest(lose), -1 from w) group by 1, 2) join bd using (t) group by 1, 2),
ex as (select n.rubric_source, coalesce(s, 0) / k as mean, coalesce(a, 0) / k as square from n join bd using (t) join sz using (band) left join hw on hw.uid = n.uid and hw.band = bd.band)"""


@query(f"with {_BANDS} select rubric_source, count(*) as n, round(avg(mean), 6) as null_tilt, round(sqrt(sum(square - mean * mean)) / count(*), 6) as null_sd from ex group by 1")
def word_tilt_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the tilt of random words of the same document frequency, over all draws: what any number of them tends to. A word in one
    of the two answers counts 1 or -1, so sums by answer and band suffice."""
    texts = table(spark, d, "rollouts").where("text is not null")
    df = texts.select(F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    bands = df.select("t", F.floor(F.log2(F.col("df") / texts.count())).cast("int").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k"))  # as many rows as powers of two
    r = texts.where("uid is not null").groupBy("uid").agg(F.min_by("text", F.when(F.col("correct"), F.col("rollout_key"))).alias("win"), F.min_by("text", F.when(~F.col("correct"), F.col("rollout_key"))).alias("lose")).where("win is not null and lose is not null")
    words = lambda c: F.array_distinct(T.content_tokens(F.col(c)))
    only = lambda a, b, x: F.transform(F.array_except(words(a), words(b)), lambda t: F.struct(t.alias("t"), F.lit(x).alias("x")))
    marks = r.select("uid", F.explode(F.concat(only("win", "lose", 1), only("lose", "win", -1))).alias("m")).select("uid", "m.t", "m.x")
    sums = marks.join(bands, "t").groupBy("uid", "band").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("a"))
    e = _tilt(spark, d).select("rubric_source", "uid", "t").join(bands, "t").join(F.broadcast(sizes), "band").join(sums, ["uid", "band"], "left")
    mean, square = F.coalesce("s", F.lit(0)) / F.col("k"), F.coalesce("a", F.lit(0)) / F.col("k")
    return e.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(mean)).alias("null_tilt"), R6(F.sqrt(F.sum(square - mean * mean)) / F.count(F.lit(1))).alias("null_sd"))


@query(f"with {_PARTS}, {_ANCHORS.replace('q as (select * from ' + _Q + '), ', '')}, an as (select uid, count(*) as n_anchors from anch group by 1) select kn.uid, n_parts, cast(least(20, greatest(7, 7 + 2 * least(n_parts, 5) + least(floor(len({S.words('reference_answer')}) / 60), 5))) as integer) as target, coalesce(n_anchors, 0) as n_anchors from kn left join an using (uid)")
def scope_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many items a checklist should have, from the question's parts and the reference's length, and how many anchors it may use."""
    p = questions(spark, d).select("uid", F.size(parsing.question_parts_column(F.col("question"))["parts"]).alias("n_parts"), F.size(T.words(F.col("reference_answer"))).alias("words"))
    n = anchors(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n_anchors"))
    return p.join(n, "uid", "left").select("uid", "n_parts", preference.item_target(F.col("n_parts"), F.col("words")).alias("target"), F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"))


@query(f"""with {_READ}, x as (select uid, source, item, bool_and(case when level = 1 then a end) as reference, bool_and(case when level > 1 then a end) as others, count(case when level > 1 then 1 end) as n_others from rd group by 1, 2, 3),
y as (select *, coalesce(not reference, false) as fails, n_others > 0 and others and coalesce(reference, true) as blunt from x) select uid, source, item, fails as reference_fails, blunt as does_not_discriminate, case when fails or blunt then 'revise' else 'keep' end as verdict from y""")
def criterion_execution(spark: SparkSession, d: str) -> DataFrame:
    """Each criterion tried on the reference answer and the others: one that the reference fails, or that all others pass too, needs revision."""
    a, first = F.col("a"), F.col("level") == 1
    x = readings(spark, d).groupBy("uid", "source", "item").agg(F.bool_and(F.when(first, a)).alias("reference"), F.bool_and(F.when(~first, a)).alias("others"), F.count_if(~first).alias("n_others"))
    fails = F.coalesce(~F.col("reference"), F.lit(False))
    blunt = F.coalesce((F.col("n_others") > 0) & F.col("others") & F.coalesce("reference", F.lit(True)), F.lit(False))
    return x.select("uid", "source", "item", fails.alias("reference_fails"), blunt.alias("does_not_discriminate"), F.when(fails | blunt, "revise").otherwise("keep").alias("verdict"))


@query(f"""with {_PAIRS.split(', r as (')[0]}, ac as (select setting_a, setting_b, k.ca / k.n as accuracy_a, k.cb / k.n as accuracy_b from (select a.setting as setting_a, b.setting as setting_b, count(*) as n, sum(cast(a.c as int)) as ca, sum(cast(b.c as int)) as cb from k a join k b using (uid) where a.setting < b.setting group by 1, 2) k)
select setting_a, setting_b, n, round(accuracy_a, 6) as accuracy_a, round(accuracy_b, 6) as accuracy_b, round(p, 6) as p, round(coalesce((m - 2 * list_max(list_filter(range(0, cast(floor(m / 2) as bigint) + 1), lambda q: least(1.0, 2 * list_sum(list_transform(range(0, q + 1), lambda i: {_HALF}))) < 0.05))) / n, 'NaN'::double), 6) as least_gap from (select *, n10 + n01 as m from t) t join ac using (setting_a, setting_b)""")
def leaderboard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of settings on common questions: accuracies, exact p, and the smallest gap that could have been significant."""
    k = table(spark, d, "rollouts").where("uid is not null and correct is not null").groupBy("uid", "setting").agg(F.min_by("correct", "rollout_key").alias("c"))
    a, b = k.select("uid", F.col("setting").alias("setting_a"), F.col("c").alias("x")), k.select("uid", F.col("setting").alias("setting_b"), F.col("c").alias("y"))
    x, y = F.col("x"), F.col("y")
    g = a.join(b, "uid").where("setting_a < setting_b").groupBy("setting_a", "setting_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(x).alias("ka"), F.count_if(y).alias("kb"), F.count_if(x & ~y).alias("n10"), F.count_if(y & ~x).alias("n01"))
    n, n10, n01 = F.col("n"), F.col("n10"), F.col("n01")
    return g.select("setting_a", "setting_b", "n", R6(F.col("ka") / n).alias("accuracy_a"), R6(F.col("kb") / n).alias("accuracy_b"), R6(exact.mcnemar_p_column(n01, n10)).alias("p"), R6(exact.least_gap_column(n01 + n10, n)).alias("least_gap"))


@query(f"with {S.NORMALISED}, t as (select criterion_id, left(regexp_replace(array_to_string(list_slice(list_filter(string_split(replace(body, chr(10), ' '), ' '), lambda w: w <> ''), 1, 4), ' '), '^[.,;:]+|[.,;:]+$', '', 'g'), 60) as t from n) select criterion_id, case when t = '' then 'Criterion' else t end as derived_title from t")
def derived_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles made of the first four words."""
    return criteria(spark, d).select("criterion_id", rewriting.derived_title(F.col("body")).alias("derived_title"))


@query(f"""with {S.NORMALISED}, t as (select run_name, rubric_source, uid, row_number() over (partition by run_name, rubric_source, uid order by pos, criterion_id) as i, trim(regexp_replace(coalesce(title, ''), '[\\s\\x{{a0}}:()]+', ' ', 'g')) as title, trim(regexp_replace(body, '[\\s\\x{{a0}}:()]+', ' ', 'g')) as description, least(5, abs(w)) as weight from n where uid is not null)
select run_name, rubric_source, uid, count(*) as n_items, sum(weight) as weights, count(distinct title) as n_titles, sum(length(description)) as n_chars from t where title <> '' and description <> '' group by 1, 2, 3""")
def parsed_checklists(spark: SparkSession, d: str) -> DataFrame:
    """Rubrics written as lines of "title: description (importance k/5)" and read again."""
    clean = lambda c: F.trim(F.regexp_replace(T.or_empty(F.col(c)), r"[\s\u00a0:()]+", " "))
    c = criteria(spark, d).where("uid is not null").select(*RUBRIC, "pos", "criterion_id", clean("title").alias("title"), clean("body").alias("body"), F.least(F.lit(5), F.abs("w")).alias("k")).where("title != '' and body != ''")
    line = F.concat(F.lit("- "), "title", F.lit(": "), "body", F.lit(" (importance "), F.col("k").cast("string"), F.lit("/5)"))
    text = c.groupBy(*RUBRIC).agg(F.array_sort(F.collect_list(F.struct("pos", "criterion_id", line.alias("line")))).alias("l")).select(*RUBRIC, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    x = text.select(*RUBRIC, F.explode(preference.rubric_items(F.col("text"))).alias("x")).select(*RUBRIC, "x.*")
    return x.groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("n_items"), F.sum("weight").alias("weights"), F.count_distinct("title").alias("n_titles"), F.sum(F.length("description")).alias("n_chars"))


@query(f"select * from ({SQL['redundant_pairs']}) order by similarity desc, a, b limit 25")
def most_redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    from tallyframe.plans.checklists import redundant_pairs

    return redundant_pairs(spark, d).orderBy(F.desc("similarity"), "a", "b").limit(25)


@query(f"select * from ({SQL['pitfall_mirrors']}) order by max_similarity desc, run_name, rubric_source, uid limit 10")
def closest_mirrors(spark: SparkSession, d: str) -> DataFrame:
    from tallyframe.plans.lint import pitfall_mirrors

    return pitfall_mirrors(spark, d).orderBy(F.desc("max_similarity"), *RUBRIC).limit(10)


@query(f"""with w as (select run_name, rubric_source, uid, unnest({S.content_tokens('body')}) as t from criteria where uid is not null), s as (select distinct run_name, rubric_source, uid, t from w), n as (select run_name, rubric_source, uid, count(*) as n from s group by 1, 2, 3),
o as (select a.run_name, a.rubric_source, a.uid, count(*) as o from s a join s b on a.run_name = b.run_name and a.uid = b.uid and a.t = b.t and b.rubric_source = 'shipped' where a.rubric_source <> 'shipped' group by 1, 2, 3),
j as (select a.rubric_source, coalesce(o, 0) as o, a.n as na, b.n as nb from n a join n b on a.run_name = b.run_name and a.uid = b.uid and b.rubric_source = 'shipped' left join o on o.run_name = a.run_name and o.rubric_source = a.rubric_source and o.uid = a.uid where a.rubric_source <> 'shipped')
select rubric_source, count(*) as n, round(avg(o / nb), 6) as recall, round(avg(o / na), 6) as precision, round(avg(2 * o / (na + nb)), 6) as f1 from j group by 1""")
def rubric_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the content words of the shipped rubric each other source's rubric of the same run and question has, and the other way round."""
    w = table(spark, d, "criteria").where("uid is not null").select(*RUBRIC, F.explode(T.content_tokens(F.col("body"))).alias("t")).distinct()
    n = w.groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("n"))
    shipped = F.col("rubric_source") == "shipped"
    o = w.where(~shipped).join(w.where(shipped).select("run_name", "uid", "t"), ["run_name", "uid", "t"]).groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("o"))
    j = n.where(~shipped).join(n.where(shipped).select("run_name", "uid", F.col("n").alias("nb")), ["run_name", "uid"]).join(o, RUBRIC, "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return j.groupBy("rubric_source").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("o") / F.col("nb"))).alias("recall"), R6(F.avg(F.col("o") / F.col("n"))).alias("precision"), R6(F.avg(2 * F.col("o") / (F.col("n") + F.col("nb")))).alias("f1"))


@query(f"""with {_SLOTS}, x as (select pair, v1, v2, case when o_orderstatus = 'F' then 'a' else 'b' end as label from fr join orders on o_orderkey = question) select pair, count(*) as n, round(avg(case when v1 in ('a', 'b') then 1.0 else 0.0 end), 6) as coverage, round(avg(case when v1 in ('a', 'b') and v2 in ('a', 'b') then case when v1 = v2 then 1.0 else 0.0 end end), 6) as consistency,
 round(avg(case when v1 in ('a', 'b') then case when v1 = label then 1.0 else 0.0 end end), 6) as forward_accuracy, round(avg(case when v1 in ('a', 'b') and v2 in ('a', 'b') then case when v1 = v2 and v1 = label then 1.0 else 0.0 end end), 6) as swap_accuracy from x group by grouping sets ((pair), ())""")
def order_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, consistency and accuracy of preferences shown in one order, and in both (a flip is wrong)."""
    side = lambda c: F.when(F.col(c).isin("a", "b"), F.col(c))
    x = slot_verdicts(spark, d).select("pair", side("verdict_order1").alias("f"), side("verdict_order2").alias("s"), F.when(F.col("judge") == "F", "a").otherwise("b").alias("label"))
    f, s, label = F.col("f"), F.col("s"), F.col("label")
    return x.groupingSets([["pair"], []], "pair").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(f.isNotNull().cast("int"))).alias("coverage"), R6(F.avg(preference.consistent(f, s).cast("int"))).alias("consistency"), R6(F.avg(preference.hit(f, s, label))).alias("forward_accuracy"), R6(F.avg(preference.hit(f, s, label, "swap"))).alias("swap_accuracy"))


@query(f"with {_CASE}, t as (select domain, count(*) as n, avg(cast(hit_a as int)) as a, avg(cast(hit_b as int)) as b, avg(case when hit_a or hit_b then 1.0 else 0.0 end) as e from cases group by grouping sets ((domain), ())) select domain, n, round(a - b, 6) as delta, round(case when b < 1 then (a - b) / (1 - b) end, 6) as headroom_share, round(case when e > b then (a - b) / (e - b) end, 6) as share_of_union from t")
def headroom_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of what the second setting gets wrong the first one gains, of all and of what either gets right."""
    a, b = F.col("hit_a").cast("int"), F.col("hit_b").cast("int")
    t = preference_cases(spark, d).groupingSets([["domain"], []], "domain").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("a"), F.avg(b).alias("b"), F.avg(F.greatest(a, b)).alias("e"))
    delta = F.col("a") - F.col("b")
    return t.select("domain", "n", (R6(delta) + 0.0).alias("delta"), (R6(F.when(F.col("b") < 1, delta / (1 - F.col("b")))) + 0.0).alias("headroom_share"), (R6(F.when(F.col("e") > F.col("b"), delta / (F.col("e") - F.col("b")))) + 0.0).alias("share_of_union"))


@query(f"""with {_LADDER}, m as (select max(score) as top from o), g as (select uid, max(case when level <= 2 then score end) - min(case when level <= 2 then score end) as spread, max(case when level = 1 then score end) as gold, avg(case when level > 2 then score end) as bad from o group by 1)
select count(spread) as n_spread, round(avg(spread), 2) as good_spread, round(avg(1 - gold / top), 6) as headroom, round(avg(case when gold >= 0.95 * top then 1.0 when gold is not null then 0.0 end), 6) as saturation, round(avg(bad / top), 6) as bad_level from g, m""")
def reward_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Spread among good answers, what the gold answer leaves above it, and how often it leaves nothing."""
    o = ladder(spark, d)
    top = o.agg(F.max("score").alias("top"))
    good, gold = F.when(F.col("level") <= 2, F.col("score")), F.when(F.col("level") == 1, F.col("score"))
    g = o.groupBy("uid").agg((F.max(good) - F.min(good)).alias("spread"), F.max(gold).alias("gold"), F.avg(F.when(F.col("level") > 2, F.col("score"))).alias("bad")).join(F.broadcast(top))
    return g.agg(F.count("spread").alias("n_spread"), F.round(F.avg("spread"), 2).alias("good_spread"), R6(F.avg(1 - F.col("gold") / F.col("top"))).alias("headroom"), R6(F.avg(F.when(F.col("gold") >= 0.95 * F.col("top"), 1.0).when(F.col("gold").isNotNull(), 0.0))).alias("saturation"), R6(F.avg(F.col("bad") / F.col("top"))).alias("bad_level"))


_FISHER = f"list_sum(list_transform(list_filter(list_transform(range(cast(greatest(0, k1 + k2 - n2) as bigint), cast(least(k1 + k2, n1) as bigint) + 1), lambda x: {_LOG_CHOOSE.format('n1', 'x')} + {_LOG_CHOOSE.format('n2', '(k1 + k2 - x)')} - ({_LOG_CHOOSE.format('(n1 + n2)', '(k1 + k2)')})), lambda v: v <= {_LOG_CHOOSE.format('n1', 'k1')} + {_LOG_CHOOSE.format('n2', 'k2')} - ({_LOG_CHOOSE.format('(n1 + n2)', '(k1 + k2)')}) + 1e-9), lambda v: exp(v)))"


@query(f"""with r as (select domain, rubric_source, count(*) as n, sum(case when regexp_matches(coalesce(body, ''), {S.lit(RESTRAINT)}) then 1 else 0 end) as k from criteria group by 1, 2), j as (select a.domain, a.rubric_source, a.n as n1, a.k as k1, b.n as n2, b.k as k2 from r a join r b on a.domain = b.domain and b.rubric_source = 'shipped' where a.rubric_source <> 'shipped')
select domain, rubric_source, n1 as n, round(k1 / n1, 6) as share, round(k2 / n2, 6) as shipped_share, round(least(1.0, {_FISHER}), 6) as p from j""")
def restraint_tests(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of restraint: each source against the shipped one within a domain, by Fisher's exact test."""
    r = table(spark, d, "criteria").groupBy("domain", "rubric_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.or_empty(F.col("body")).rlike(RESTRAINT)).alias("k"))
    j = r.where("rubric_source != 'shipped'").join(r.where("rubric_source = 'shipped'").select("domain", F.col("n").alias("n2"), F.col("k").alias("k2")), "domain")
    return j.select("domain", "rubric_source", "n", R6(F.col("k") / F.col("n")).alias("share"), R6(F.col("k2") / F.col("n2")).alias("shipped_share"), R6(exact.fisher_p_column(F.col("k"), F.col("n"), F.col("k2"), F.col("n2"))).alias("p"))


_REFUSES = f"regexp_matches(left(trim(coalesce({{0}}, '')), 200), {S.lit(REFUSAL)})"


@query(f"""with r as (select uid, any_value(domain) as domain, arg_min(text, rollout_key) filter (where correct) as win, arg_min(text, rollout_key) filter (where not correct) as lose from rollouts where uid is not null and text is not null group by 1 having win is not null and lose is not null)
select domain, count(*) as n, sum(cast({_REFUSES.format('win')} as int)) as n_preferred, sum(cast({_REFUSES.format('lose')} as int)) as n_rejected, sum(cast({_REFUSES.format('win')} <> {_REFUSES.format('lose')} as int)) as n_exactly_one from (select uid, (select min(domain) from rollouts x where x.uid = r.uid and x.text is not null) as domain, win, lose from r) group by 1""")
def refusals_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Refusals among right and wrong answers to one question, and questions on which exactly one refuses."""
    r = table(spark, d, "rollouts").where("uid is not null and text is not null").groupBy("uid").agg(F.min("domain").alias("domain"), F.min_by("text", F.when(F.col("correct"), F.col("rollout_key"))).alias("win"), F.min_by("text", F.when(~F.col("correct"), F.col("rollout_key"))).alias("lose")).where("win is not null and lose is not null")
    refuses = lambda c: F.substring(F.trim(c), 1, 200).rlike(REFUSAL)
    x = r.select("domain", refuses("win").alias("w"), refuses("lose").alias("l"))
    return x.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("w").alias("n_preferred"), F.count_if("l").alias("n_rejected"), F.count_if(F.col("w") != F.col("l")).alias("n_exactly_one"))


@query(f"with {_CASE}, lk as (select uid, max(k) as k from (select uid, run_name, rubric_source, count(*) as k from criteria where uid is not null group by 1, 2, 3) group by 1) select case when k <= 7 then '1-7' when k <= 10 then '8-10' when k <= 14 then '11-14' else '15+' end as items, count(*) as n, round(avg(cast(hit_a as int)), 6) as accuracy_a, round(avg(cast(hit_b as int)), 6) as accuracy_b from cases join lk using (uid) group by 1")
def accuracy_by_items(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by the number of items of a question's longest rubric."""
    k = table(spark, d, "criteria").where("uid is not null").groupBy(*RUBRIC).agg(F.count(F.lit(1)).alias("k")).groupBy("uid").agg(F.max("k").alias("k"))
    items = F.when(F.col("k") <= 7, "1-7").when(F.col("k") <= 10, "8-10").when(F.col("k") <= 14, "11-14").otherwise("15+")
    return preference_cases(spark, d).join(k, "uid").groupBy(items.alias("items")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.col("hit_a").cast("int"))).alias("accuracy_a"), R6(F.avg(F.col("hit_b").cast("int"))).alias("accuracy_b"))
