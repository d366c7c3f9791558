"""Queries on merging, sampling, splitting, joining and searching tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import merging, ranking, similarity
from tallyframe.plans import sqltext as S
from tallyframe.plans.forensics import _Q, R6
from tallyframe.plans.registry import query
from tallyframe.plans.views import questions
from tallyframe.session import table


@query("select uid, setting, rollout_key, loaded_at from (select *, row_number() over (partition by uid, setting order by loaded_at desc, rollout_key desc) as r from rollouts where uid is not null) where r = 1")
def last_load_wins(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rollouts").where("uid is not null").select("uid", "setting", "rollout_key", "loaded_at")
    return merging.last_wins(r, ["uid", "setting"], [F.unix_micros("loaded_at"), F.col("rollout_key")])


@query("select question, ex_id, uid from (select *, row_number() over (partition by question order by ex_id) as r from examples where question is not null) where r = 1")
def first_question_wins(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "examples").where("question is not null").select("question", "ex_id", "uid")
    return ranking.first_per_key(ex, ["question"], [F.col("ex_id").alias("o")])


@query("""with late as (select * from rollouts where loaded_at > sampled_at + interval 30 minute), early as (select * from rollouts where loaded_at <= sampled_at + interval 30 minute)
select rollout_key from early e where not exists (select 1 from late l where l.uid is not distinct from e.uid and l.setting = e.setting) union all select rollout_key from late""")
def late_loads_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Late loads replace the early ones of their question and setting."""
    r = table(spark, d, "rollouts")
    late = F.col("loaded_at") > F.col("sampled_at") + F.expr("interval 30 minutes")
    return merging.upsert(r.where(~late), r.where(late), ["uid", "setting"]).select("rollout_key")


@query("select run_name, rubric_source, uid, pos, count(distinct description) as n from criteria where uid is not null group by 1, 2, 3, 4 having count(distinct description) > 1")
def conflicting_loads(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "criteria").where("uid is not null")
    return merging.conflicts(c, ["run_name", "rubric_source", "uid", "pos"], F.col("description"))


@query("select criterion_id from criteria c join (select uid, min(run_name) as run_name from criteria where uid is not null group by 1) m using (uid, run_name)")
def first_run_wins(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of each question's first run."""
    c = table(spark, d, "criteria").where("uid is not null").select("criterion_id", "uid", "run_name")
    return c.join(c.groupBy("uid").agg(F.min("run_name").alias("run_name")), ["uid", "run_name"]).select("criterion_id")


@query("select uid from criteria where uid is not null group by uid having count(distinct rubric_source) = (select count(distinct rubric_source) from criteria)")
def questions_with_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: questions that every source has a rubric for."""
    c = table(spark, d, "criteria").select("uid", "rubric_source").where("uid is not null")
    n = c.agg(F.count_distinct("rubric_source").alias("n")).first().n
    return c.groupBy("uid").agg(F.count_distinct("rubric_source").alias("n")).where(F.col("n") == n).select("uid")


@query("select distinct uid from examples where uid is not null and uid not in (select uid from criteria where uid is not null)")
def questions_without_rubric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "examples").where("uid is not null").select("uid").distinct().join(table(spark, d, "criteria").select("uid"), "uid", "left_anti")


@query("select domain, split, ex_id from (select *, row_number() over (partition by domain, split order by md5(concat('7:', ex_id)), ex_id) as r from examples) where r <= 20")
def sample_by_split(spark: SparkSession, d: str) -> DataFrame:
    return merging.sample_per_group(table(spark, d, "examples").select("domain", "split", "ex_id"), ["domain", "split"], "ex_id", 20, seed=7)


_QUOTA = """s as (select doc_kind as g, count(*) as size from documents group by 1), x as (select g, size, 200 * size / sum(size) over () as e from s), b as (select g, size, floor(e) as base, e - floor(e) as frac from x),
quota as (select g, size, cast(base + case when row_number() over (order by frac desc, g) <= 200 - sum(base) over () then 1 else 0 end as bigint) as quota from b)"""


@query(f"with {_QUOTA} select g as doc_kind, size, quota from quota")
def proportional_quotas(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("size"))
    return ranking.largest_remainder(sizes, "doc_kind", "size", 200)


@query(f"with {_QUOTA} select doc_id, doc_kind from (select doc_id, doc_kind, row_number() over (partition by doc_kind order by md5(concat('3:', doc_id)), doc_id) as r from documents) t join quota on g = doc_kind where r <= quota")
def stratified_documents(spark: SparkSession, d: str) -> DataFrame:
    return merging.stratified_sample(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_kind", "doc_id", 200, seed=3).select("doc_id", "doc_kind")


@query("select uid, cast(('0x' || left(sha256(uid), 8))::bigint % 16 as integer) as shard from (select distinct uid from examples where uid is not null)")
def shards(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "examples").where("uid is not null").select("uid").distinct()
    return u.select("uid", merging.hash_number(F.col("uid"), 16).alias("shard"))


@query("""with u as (select domain, uid, row_number() over (partition by domain order by md5(concat('5:', uid)), uid) - 1 as i, count(*) over (partition by domain) as n from (select distinct domain, uid from eval_items))
select a.uid as uid, b.uid as partner from u a join u b on a.domain = b.domain and b.i = (a.i + 1) % a.n where a.uid <> b.uid""")
def distractor_partners(spark: SparkSession, d: str) -> DataFrame:
    return merging.shift_partner(table(spark, d, "eval_items").select("domain", "uid").distinct(), "domain", "uid", seed=5)


@query(f"""with q as (select * from {_Q}), t as (select uid, ex_id, domain, unnest(list_distinct({S.content_tokens('question')})) as t from q), n as (select uid, count(*) as n from t group by 1),
x as (select ta.uid as a, tb.uid as b, count(*) as o from t ta join t tb on ta.domain = tb.domain and ta.t = tb.t and ta.uid <> tb.uid where ta.ex_id % 50 = 0 group by 1, 2)
select a as uid, b as neighbour, cast(r as bigint) as rank, round(s, 6) as similarity from (select a, b, s, row_number() over (partition by a order by round(s, 9) desc, b) as r from (select a, b, o / (na.n + nb.n - o) as s from x join n na on na.uid = a join n nb on nb.uid = b)) where r <= 3""")
def similar_questions(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar questions of the domain (Jaccard of content words above 0), for every question whose id is divisible by 50,
    exact, against all."""
    q = questions(spark, d)
    tok = q.select("uid", "ex_id", "domain", F.array_distinct(T.content_tokens(F.col("question"))).alias("ts"))
    found = similarity.nearest_sets(tok, F.col("ex_id") % 50 == 0, "uid", "domain", "ts", 3)
    return found.select(F.col("query").alias("uid"), F.col("id").alias("neighbour"), F.col("rank").cast("long").alias("rank"), R6("s").alias("similarity"))


@query("""with v as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings)
select query, id, cast(rank as bigint) as rank, round(s, 5) as similarity from (select a.vec_id as query, b.vec_id as id, s, row_number() over (partition by a.vec_id order by round(s, 9) desc, b.vec_id) as rank from (select a.vec_id, b.vec_id as other, list_dot_product(a.e, b.e) / (a.n * b.n) as s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) a join v b on b.vec_id = a.other) where rank <= 10""")
def nearest_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 50, exact, against all rows."""
    e = table(spark, d, "embeddings")
    out = similarity.nearest_vectors(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return out.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("s", 5).alias("similarity"))


@query(f"""with q as (select * from {_Q}), t as (select uid, unnest(list_distinct({S.content_tokens('question')})) as t from q where uid is not null),
c as (select criterion_id, uid, unnest(list_distinct({S.content_tokens('body')})) as t from criteria where uid in (select uid from q)), cn as (select criterion_id, uid, count(*) as n from c group by 1, 2),
h as (select criterion_id, count(*) as hits from c join t using (uid, t) group by 1) select cn.criterion_id, round(coalesce(hits, 0) / n, 6) as covered from cn left join h using (criterion_id)""")
def question_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a criterion's content words that its question has."""
    q = questions(spark, d).select("uid", F.array_distinct(T.content_tokens(F.col("question"))).alias("q"))
    c = table(spark, d, "criteria").select("criterion_id", "uid", F.array_distinct(T.content_tokens(F.col("body"))).alias("c")).where(F.size("c") > 0)
    return c.join(q, "uid").select("criterion_id", R6(T.containment(F.col("c"), F.col("q"))).alias("covered"))


@query("select sha, count(*) as n from (select left(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 16) as sha from documents) group by 1 having count(*) > 1")
def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(T.digest(F.col("text")).alias("sha")).groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select rollout_key, left(trim(regexp_replace(x[len(x)], '\\s+', ' ', 'g')), 400) as answer from (select rollout_key, regexp_extract_all(text, '(?i)final\\s*answer\\s*[:\\-]\\s*([^\\n]+)', 1) as x from rollouts) where len(x) > 0")
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rollouts").select("rollout_key", T.final_answer(F.col("text")).alias("answer"))
    return r.where("answer is not null")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def parsed_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select r_name, n_name, l_returnflag, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 group by grouping sets ((r_name, n_name), (r_name, l_returnflag), ())""")
def revenue_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupingSets([["r_name", "n_name"], ["r_name", "l_returnflag"], []], "r_name", "n_name", "l_returnflag")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by 1, 2")
def line_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), R6(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""select 'run' as kind, run_name as name, count(*) as n from criteria group by 2 union all select 'source', rubric_source, count(*) from criteria group by 2 union all select 'both', name, count(*) from (select distinct uid, 'criteria and examples' as name from criteria where uid in (select uid from examples)) group by 2""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """UNION ALL of counts, and INTERSECT of keys."""
    c = table(spark, d, "criteria")
    both = c.select("uid").intersect(table(spark, d, "examples").select("uid")).where("uid is not null")
    count = F.count(F.lit(1)).alias("n")
    parts = [c.groupBy(F.col("run_name").alias("name")).agg(count).select(F.lit("run").alias("kind"), "name", "n"), c.groupBy(F.col("rubric_source").alias("name")).agg(count).select(F.lit("source").alias("kind"), "name", "n"), both.agg(count).select(F.lit("both").alias("kind"), F.lit("criteria and examples").alias("name"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
