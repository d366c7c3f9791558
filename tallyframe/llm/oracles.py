"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def words(c: str) -> str:
    return _WORDS.format(f"coalesce({c}, '')")


def similar(sets: str, condition: str) -> str:
    """CTEs from a relation ``sets`` (id, side, w: distinct words) to ``pairs`` (a, b, similarity) of Jaccard similarity 0.75 or
    more, by the prefix filter, which is exact."""
    return f"""s as ({sets}), e as (select id, unnest(w) as t, len(w) as n from s), df as (select t, count(*) as df from e group by 1),
r as (select id, t, n, row_number() over (partition by id order by df, t) as k from e join df using (t)), p as (select id, t from r where k <= n - ceil(0.75 * n - 1e-9) + 1),
c as (select distinct x.id as a, y.id as b from p x join p y on x.t = y.t and x.id < y.id),
o as (select a, b, x.side as sa, y.side as sb, len(list_intersect(x.w, y.w)) as o, len(x.w) as na, len(y.w) as nb from c join s x on x.id = a join s y on y.id = b),
pairs as (select a, b, o / (na + nb - o) as similarity from o where o >= 0.75 * (na + nb - o) and {condition})"""


_P1 = similar(f"select criterion_id as id, 0 as side, list_distinct({words(chr(99) + 'oncat_ws(chr(32), title, description)')}) as w from criteria", "true")
_P5 = similar(f"select ex_id as id, case when split = 'train' then 1 else 0 end as side, list_distinct({words('question')}) as w from examples", "sa <> sb")

_TITLE = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
_P3 = f"""v as (select uid, {_TITLE} as value from criteria where uid is not null and {_TITLE} <> ''), u as (select count(distinct uid) as n from criteria),
f as (select 'title' as level, value, count(*) as times, count(distinct uid) as records from v group by 2 union all select 'term', term, count(*), count(distinct uid) from (select uid, unnest(string_split(value, ' ')) as term from v) group by 2)"""

_SPIKES = """l as (select setting, unit, length, count(*) as n from (select setting, 'chars' as unit, length(text) as length from rollouts union all select setting, 'bytes', strlen(text) from rollouts) where length > 0 group by 1, 2, 3),
x as (select *, coalesce(sum(n) over (partition by setting, unit order by length rows between 1 following and unbounded following), 0) / sum(n) over (partition by setting, unit) as beyond from l),
sp as (select a.setting, a.unit, a.length, a.n, coalesce(sum(b.n), 0) / greatest(floor(a.length * 0.1), 1) as expected from x a left join l b on b.setting is not distinct from a.setting and b.unit = a.unit and b.length < a.length and b.length >= a.length - greatest(floor(a.length * 0.1), 1) where a.beyond <= 0.02 and a.n >= 5 group by 1, 2, 3, 4),
spikes as (select * from sp where n >= 8 * expected)"""
_BARE = "regexp_replace(coalesce(text, ''), '[\\s\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{a0}]+$', '')"
_COMPLETE = [
    "[.!?\\x{2026}\\x{3002}\\x{ff01}\\x{ff1f}][\"''\\x{201d}\\x{2019}\\x{bb})\\]}*_`>\\s]*$",
    "\\\\boxed\\{[^{}]*\\}[$\\s]*$",
    "(?i)\\bfinal answer\\s*:\\s*[-+]?\\d[\\d.,]*(?:e[-+]?\\d+)?\\s+\\S+$",
    "(?:^|\\n)\\s*(?:[-*\\x{2022}]|\\d+[.)])\\s+[^\\n]*:\\s*[-+]?\\d[\\d.,]*\\s+\\S+$",
    "\\([A-Za-z0-9]\\)$",
    "(?i)\\boptions?\\s*:[^\\n]*\\([A-Z]\\)\\s+\\S+(?:\\s+\\S+){0,3}$",
    "^\\s*[-+]?\\d[\\d.,]*(?:e[-+]?\\d+)?(?:\\s+\\S+)?$",
    "^\\s*\\[[^\\[\\]]*\\]$",
    "[\"''\\x{201d}\\x{2019}](?i:\\s*(?:final )?answer:)$",
]
_EMPTY = "(?i)^[\\s\\pP\\pS\\x{200b}\\x{a0}]*(?:(?:final\\s+)?answer|response|n/?a|none|null|nil|nan|tbd|todo|empty|no answer|no response|think)?[\\s\\pP\\pS\\x{200b}\\x{a0}]*$"
_CUT = f"""{_SPIKES}, cut as (select rollout_key, setting, text, n_chars from rollouts where not regexp_matches(regexp_replace(coalesce(text, ''), '(?s)<[^<>]{{0,40}}>|```\\w*', ' ', 'g'), '{_EMPTY}')
 and not ({' or '.join(f"regexp_matches({_BARE}, '{p}')" for p in _COMPLETE)})),
found as (select rollout_key, c.setting, case when exists (select 1 from spikes s where s.setting is not distinct from c.setting and s.length = case when s.unit = 'chars' then length(c.text) else strlen(c.text) end) then 'limit' when n_chars > length(c.text) + 5 then 'transfer' else 'ending' end as evidence from cut c)"""

_P6 = """r as (select 'examples' as src, ex_id as rec_id, reference_answer as t from examples union all select 'criteria', criterion_id, description from criteria),
w as (select src, rec_id, p, substr(t, cast(p as integer), 100) as g from (select src, rec_id, t, unnest(range(1, length(t) - 98)) as p from r where length(t) >= 100)),
hot as (select g from (select distinct src, rec_id, g from w) group by 1 having count(*) > 1), h as (select src, rec_id, p - 1 as p from w where g in (select g from hot)),
i as (select *, case when p - lag(p) over (partition by src, rec_id order by p) <= 100 then 0 else 1 end as fresh from h), j as (select *, sum(fresh) over (partition by src, rec_id order by p) as run from i),
spans as (select src, rec_id, cast(min(p) as integer) as span_start, cast(max(p) + 100 as integer) as span_end from j group by src, rec_id, run)"""

_CANON = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_P7 = f"""a as (select 'criteria' as src, criterion_id as id, title, description from criteria
 union all select 'raw_entries', entry_id, case when json_type(payload) = 'OBJECT' then coalesce(json_extract_string(payload, '$.title'), json_extract_string(payload, '$.Title')) end,
 case when json_type(payload) = 'VARCHAR' then json_extract_string(payload, '$') else coalesce(json_extract_string(payload, '$.description'), json_extract_string(payload, '$.Description')) end
 from raw_entries where json_valid(payload) and not regexp_matches(payload, ',\\s*[}}\\]]') and json_type(payload) in ('OBJECT', 'VARCHAR')),
k as (select src, id, min(id) over (partition by src, {_CANON.format('title')}, {_CANON.format('description')}) as first_id from a)"""

_RUNS = "unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(list_slice(w, i, i + 11), ' ')))"
_P9 = f"""ir as (select distinct item_id, {_RUNS} as g from (select item_id, {words('question')} as w from eval_items union all select item_id, {words('reference_answer')} from eval_items)),
dr as (select distinct doc_id, {_RUNS} as g from (select doc_id, {words('text')} as w from documents)), hits as (select doc_id, item_id, count(*) as shared from dr join ir using (g) group by 1, 2)"""


#: Classes of equal sets: cl (id, rep, n) from the relation s of ``similar``, in each side.
_CLASSES = "cl as (select id, side, min(id) over (partition by side, list_sort(w)) as rep, count(*) over (partition by side, list_sort(w)) as n from s where len(w) > 0), rp as (select a, b, similarity from pairs join cl x on x.id = a and x.rep = a join cl y on y.id = b and y.rep = b where similarity < 1 or x.side <> y.side)"
_GROUPS = """both_ as (select a, b from rp union select b, a from rp), reach as (select a as x, b as y from both_ union select r.x, e.b from reach r join both_ e on e.a = r.y), comp as (select x as rep, least(x, min(y)) as g from reach group by 1),
gr as (select cl.id as criterion_id, coalesce(g, cl.rep) as group_id, coalesce(k, 0) as n_links from cl left join comp using (rep) left join (select a as rep, count(*) as k from both_ group by 1) l using (rep) where g is not null or n > 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_P1} select a as criterion_id_a, b as criterion_id_b from pairs",
        "p1_groups": f"with recursive {_P1}, {_CLASSES}, {_GROUPS} select criterion_id, group_id, count(*) over (partition by group_id) as group_size, n_links from gr",
        "p1_class_pairs": f"with {_P1}, {_CLASSES} select a as class_a, b as class_b, round(similarity, 6) as similarity from rp",
        "p1_members": f"with {_P1}, {_CLASSES} select rep as class_id, id as criterion_id from cl where n > 1",
        "p2_faults": "select (select count(*) from examples where ex_id is not null) + (select count(*) from rollouts where rollout_key is not null) as n_rows, 0 as n_two_main, 0 as n_unknown, 0 as n_blank_missed",
        "p3_found": f"with {_P3} select level, value, case when records = 1 then 'rare' else 'common' end as mark from f, u where records = 1 or records > 0.05 * n",
        "p3_frequencies": f"with {_P3} select level, value, times, records from f",
        "p3_ngrams": f"""with {_P3}, w as (select uid, string_split(value, ' ') as w from v), g as (select uid, k as words, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as ngram from w, (select unnest([1, 2, 3]) as k) x)
 select ngram, cast(words as integer) as words, count(*) as times, count(distinct uid) as records from g group by 1, 2""",
        "p3_list_check": f"""with c as (select run_name, domain, regexp_replace(regexp_replace(title, '^[\\s\\pZ]+', ''), '[\\s\\pZ]+$', '') as title, {_TITLE} as value from criteria where title is not null), s as (select run_name, domain, title, count(*) as spelling_count from c group by 1, 2, 3), v as (select run_name, domain, value, count(*) as value_count from c group by 1, 2, 3),
 t as (select *, {_TITLE} as value from top_titles) select run_name, domain, rank, title, count as listed_count, coalesce(spelling_count, 0) as spelling_count, coalesce(value_count, 0) as value_count,
 case when count is null then 'missing' when count = coalesce(spelling_count, 0) then 'agrees' else 'differs' end as state from t left join s using (run_name, domain, title) left join v using (run_name, domain, value)""",
        "p4_found": f"with {_CUT} select rollout_key from found",
        "p4_spikes": f"with {_SPIKES} select setting, unit, length, n, expected from spikes",
        "p4_rates": f"""with {_CUT} select r.setting, n_rows, coalesce(n_truncated, 0) as n_truncated, coalesce(n_limit, 0) as n_limit, coalesce(n_transfer, 0) as n_transfer, coalesce(n_truncated, 0) / n_rows as share
 from (select setting, count(*) as n_rows from rollouts group by 1) r left join (select setting, count(*) as n_truncated, sum(case when evidence = 'limit' then 1 else 0 end) as n_limit, sum(case when evidence = 'transfer' then 1 else 0 end) as n_transfer from found group by 1) f on f.setting is not distinct from r.setting""",
        "p5_found": f"with {_P5} select a as ex_id_a, b as ex_id_b from pairs",
        "p5_overlaps": f"""with {_P5} select t.ex_id as train_ex_id, t.uid as train_uid, h.ex_id as held_ex_id, h.uid as held_uid, h.split, round(similarity, 6) as jaccard
 from pairs join examples t on t.ex_id in (a, b) and t.split = 'train' join examples h on h.ex_id in (a, b) and h.ex_id <> t.ex_id""",
        "p5_counts": f"with {_P5} select h.split, h.question_source as source, count(*) as n_pairs, count(distinct h.ex_id) as n_records from pairs join examples h on h.ex_id in (a, b) and h.split <> 'train' group by 1, 2",
        "p5_class_pairs": f"with {_P5}, {_CLASSES} select case when x.side = 1 then a else b end as train_class, case when x.side = 1 then b else a end as held_class, round(similarity, 6) as jaccard from rp join cl x on x.id = a",
        "p5_members": f"with {_P5}, {_CLASSES} select case when side = 1 then 'train' else 'held' end as side, rep as class_id, id as ex_id from cl where n > 1",
        "p6_found": f"with {_P6} select src, rec_id, span_start, span_end from spans",
        "p6_shared_part": f"with {_P6} select src, rec_id, count(*) as n_spans, sum(span_end - span_start) as shared_chars, sum(span_end - span_start) / any_value(length(t)) as share from spans join r using (src, rec_id) group by 1, 2",
        "p7_found": f"with {_P7} select src, first_id, id as copy_id from k where id <> first_id",
        "p7_records": f"with {_P7} select k.src, first_id, {_CANON.format('f.title')} as title, {_CANON.format('f.description')} as description, count(*) as copies from k join a f on f.src = k.src and f.id = k.first_id group by 1, 2, 3, 4",
        "p7_collisions": f"with {_P7} select count(distinct {_CANON.format('title')} || chr(10) || {_CANON.format('description')}) as n_records, 0 as n_collisions from a",
        "p7_copy_counts": f"with {_P7} select src, first_id, count(*) as copies from k group by 1, 2",
        "p8_faults": "select count(*) as n_documents, 0 as n_lost, 0 as n_overfull, 0 as n_divided, 0 as n_overlaps from documents where doc_id is not null",
        "p9_found": f"with {_P9} select doc_id, item_id from hits",
        "p9_leaks": f"with {_P9}, n as (select item_id, count(*) as n from ir group by 1) select item_id, count(*) as n_documents, round(max(shared / n), 6) as most_contained from hits join n using (item_id) group by 1",
        "p10_held_out": "select true as mostly_equal, true as nearly_always_near",
        "p10_features": """with x as (select doc_id, regexp_extract_all(text, '\\p{L}+') as w, len(list_filter(string_split(regexp_replace(regexp_replace(text, '[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]', chr(1), 'g'), '([.!?])[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '\\p{L}'))) as s from documents where doc_id is not null and text is not null)
 select doc_id, len(w) as words, s as sentences, round(list_sum(list_transform(w, lambda z: length(z))) / len(w), 6) as letters_per_word, round(len(w) / s, 6) as words_per_sentence from x where len(w) > 0""",
        "p10_found": """with x as (select doc_id, regexp_extract_all(text, '\\p{L}+') as w, len(list_filter(string_split(regexp_replace(regexp_replace(text, '[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]', chr(1), 'g'), '([.!?])[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '\\p{L}'))) as s from documents where doc_id is not null and text is not null)
 select doc_id from x where len(w) > 0 and len(w) / s >= 22.0 and list_sum(list_transform(w, lambda z: length(z))) / len(w) >= 5.8""",
    }
