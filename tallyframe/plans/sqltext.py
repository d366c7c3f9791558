"""DuckDB expressions of the text functions, for the oracles only."""

from __future__ import annotations

from tallyframe.functions import lexicon as L


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(xs: list[str]) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c},'')), {lit(L.WORD)})"


def numbers(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c},'')), {lit(L.NUMBER)})"


def content_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c},'')), {lit(L.TOKEN)}), lambda t: length(t) > 2 and not list_contains({values(L.STOPWORDS)}, t))"


def criterion_tokens(c: str) -> str:
    return f"list_distinct(list_concat({content_tokens(c)}, {numbers(c)}))"


def ngrams(a: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({a}) - {n} + 2, 1)), lambda i: array_to_string(list_slice({a}, i, i + {n} - 1), ' ')))"


def contains_any(c: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({c},'')), {lit(t)})" for t in terms) + ")"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[\\s\\xA0]+', ''), '[\\s\\xA0]+$', '')"


def title(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c},'')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def known(c: str) -> str:
    return "case " + " ".join(f"when lower({c}) = '{x.lower()}' then '{x}'" for x in L.CATEGORIES) + " end"


def coerced_category(c: str) -> str:
    inner = f"regexp_replace(trim(regexp_replace(trim(coalesce({c},'')), ':+$', '')), '(?i)\\s*criteria$', '')"
    return f"coalesce({known(f'trim({inner})')}, 'Important')"


def strict_category(d: str) -> str:
    return f"coalesce({known(f'regexp_extract(coalesce({d},{lit(chr(39)*0)}), {lit(L.STRICT_PREFIX)}, 1)')}, NULL)"


def strict_body(d: str) -> str:
    return f"regexp_replace(coalesce({d},''), {lit(L.STRICT_PREFIX)}, '')"


def polarity_method(d: str, cat: str) -> str:
    b = strict_body(d)
    return f"case when {cat} <> 'Pitfall' then 'category_default' when regexp_matches({b}, {lit(L.AVOIDANCE_PHRASING)}) then 'avoidance' when regexp_matches({b}, {lit(L.FAILURE_PHRASING)}) then 'failure' else 'unclassified' end"


def scoring_weight(cat: str, default: float) -> str:
    return "case " + " ".join(f"when {cat} = '{k}' then {v}" for k, v in L.CATEGORY_WEIGHTS.items()) + f" else {default} end"


def coerced_weight(w: str, cat: str) -> str:
    v = f"coalesce(round_even(try_cast({w} as double), 0), case when {cat} = 'Pitfall' then -1 else 3 end)"
    return f"cast(case when {cat} = 'Pitfall' then greatest(-2, least(-1, -abs({v}))) else greatest(1, least(5, abs({v}))) end as integer)"


#: The normalised criteria as a CTE named n.
NORMALISED = f"""n as (
  select criterion_id, uid, domain, split, run_name, rubric_source, pos, title, cat, {strict_body('description')} as body, description,
         {coerced_weight('weight', 'cat')} as w, {polarity_method('description', 'cat')} as method
  from (select *, coalesce({strict_category('description')}, {coerced_category('category')}) as cat from criteria))"""
