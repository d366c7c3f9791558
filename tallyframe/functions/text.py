"""Text and normalisation functions from Column to Column; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once per row, however often f uses it; inside a lambda it would be computed per element."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` would take blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(L.WORD), F.lit(0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(L.TOKEN), F.lit(0))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(L.NUMBER), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Tokens of three or more characters that aren't stop words, in order."""
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(L.STOPWORDS))


def criterion_tokens(c: Column) -> Column:
    """Content tokens and numbers, each once."""
    return F.array_union(content_tokens(c), numbers(c))


def ngrams(a: Column, n: int) -> Column:
    """Distinct runs of n elements, joined by blanks; none if there are fewer than n."""
    def grams(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))
        return F.when(F.size(x) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(a, grams)


def contains_any(c: Column, terms: list[str]) -> Column:
    return let(F.lower(or_empty(c)), lambda low: reduce(lambda x, y: x | y, [low.contains(t) for t in terms]))


def sentence_count(c: Column) -> Column:
    body = strip(or_empty(c))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, L.SENTENCE_GAP)))


def percent(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * n, d), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct values; 0 if either is empty."""
    both = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return let(a, lambda x: let(b, lambda y: F.when((F.size(x) > 0) & (F.size(y) > 0), both(x, y)).otherwise(0.0)))


def tokens_by(c: Column, pattern: str, least: int = 1, without_stop: bool = False, stemmed: bool = False) -> Column:
    """Tokens of a text under a tokeniser: a pattern over the lower case, a least length, stems, and stop words left out."""
    out = F.filter(F.regexp_extract_all(F.lower(or_empty(c)), F.lit(pattern), F.lit(0)), lambda t: F.length(t) >= least)
    out = F.transform(out, stem) if stemmed else out
    return F.filter(out, lambda t: ~t.isin(L.STOPWORDS)) if without_stop else out


def binary_cosine(a: Column, b: Column) -> Column:
    both = lambda x, y: F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))
    return let(a, lambda x: let(b, lambda y: F.when((F.size(x) > 0) & (F.size(y) > 0), both(x, y)).otherwise(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has too; 0 if a is empty."""
    return let(a, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)).otherwise(0.0))


# Criteria


def raw_category(description: Column) -> Column:
    """The word before ``Criteria:`` at the start, or NULL."""
    return F.when(or_empty(description).rlike(L.FORENSIC_PREFIX), F.regexp_extract(description, L.FORENSIC_PREFIX, 1))


def prefix_body(description: Column) -> Column:
    return F.regexp_replace(or_empty(description), L.FORENSIC_PREFIX, "")


def canonical_category(raw: Column) -> Column:
    """Canonical name, MALFORMED for any other word, MISSING for none."""
    known = F.initcap(F.lower(raw))
    return F.when(raw.isNull(), "MISSING").when(known.isin(L.CATEGORIES), known).otherwise("MALFORMED")


def coerced_category(c: Column, default: str = "Important") -> Column:
    """Lenient reading: outer blanks, a colon and the word ``criteria`` don't matter, nor does case."""
    text = strip(F.regexp_replace(strip(or_empty(c)), r":+$", ""))
    name = F.initcap(F.lower(strip(F.regexp_replace(text, r"(?i)\s*criteria$", ""))))
    return F.when(name.isin(L.CATEGORIES), name).otherwise(default)


def strict_prefix_category(description: Column) -> Column:
    return F.when(or_empty(description).rlike(L.STRICT_PREFIX), F.initcap(F.lower(F.regexp_extract(description, L.STRICT_PREFIX, 1))))


def without_strict_prefix(description: Column) -> Column:
    return F.regexp_replace(or_empty(description), L.STRICT_PREFIX, "")


def declared_or_prefix(description: Column, declared: Column) -> Column:
    """An inline prefix beats the declared category."""
    return F.coalesce(strict_prefix_category(description), coerced_category(declared))


def polarity_method(description: Column, category: Column) -> Column:
    """How the polarity is known. Avoidance is tried first: "does not incorrectly ..." fits both patterns."""
    text = without_strict_prefix(description)
    return (
        F.when(category != "Pitfall", "category_default")
        .when(text.rlike(L.AVOIDANCE_PHRASING), "avoidance")
        .when(text.rlike(L.FAILURE_PHRASING), "failure")
        .otherwise("unclassified")
    )


def polarity(description: Column, category: Column) -> Column:
    return F.when(polarity_method(description, category) == "failure", "negative").otherwise("positive")


def forensic_phrasing(body: Column) -> Column:
    """The other precedence: failure is tried first."""
    return F.when(or_empty(body).rlike(L.FAILURE_PHRASING), "failure").when(or_empty(body).rlike(L.AVOIDANCE_PHRASING), "avoidance").otherwise("other")


def coerced_polarity(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("negative", "neg", "-", "failure", "fail", "bad", "0", "false"), "negative").otherwise("positive")


def lenient_bool(c: Column) -> Column:
    """True or false for the usual spellings, else NULL."""
    low = F.lower(strip(c.cast("string")))
    return F.when(low.isin("true", "yes", "y", "1", "met", "pass", "satisfied"), True).when(low.isin("false", "no", "n", "0", "unmet", "fail", "none", "null", ""), False)


def coerced_weight(weight: Column, category: Column) -> Column:
    """Rounded half to even and clamped: [1, 5], or [-2, -1] for a Pitfall; unreadable counts as 3, or -1."""
    pitfall = category == "Pitfall"
    value = F.coalesce(F.bround(weight.try_cast("double"), 0), F.when(pitfall, -1.0).otherwise(3.0))
    return F.when(pitfall, F.greatest(F.lit(-2.0), F.least(F.lit(-1.0), -F.abs(value)))).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.abs(value)))).cast("int")


def scoring_weight(category: Column, default: float = L.DEFAULT_SCORING_WEIGHT) -> Column:
    out = F.lit(default)
    for name, w in L.CATEGORY_WEIGHTS.items():
        out = F.when(category == name, w).otherwise(out)
    return out


def normalised_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(or_empty(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def opener(c: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.lower(or_empty(c)), r"\s+"), lambda w: w != ""), 1, n), " ")


def polarity_stripped(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(or_empty(c), L.NEGATIVE_OPENER, ""), L.POSITIVE_OPENER, ""))


def template_tokens(c: Column) -> Column:
    """Lower-case words with numbers masked as <NUM>, in order."""
    masked = F.regexp_replace(F.lower(or_empty(c)), r"\d+(?:[.,]\d+)?", " \u0001 ")
    clean = F.regexp_replace(masked, "[^a-z0-9\\s\u0001]", " ")
    return F.transform(F.filter(F.split(clean, r"\s+"), lambda t: t != ""), lambda t: F.when(t == "\u0001", "<NUM>").otherwise(t))


def marks(c: Column) -> Column:
    """What tells parallel criteria apart: numbers, punctuation and option letters, sorted."""
    low = F.lower(or_empty(c))
    parts = [F.regexp_extract_all(low, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), F.regexp_extract_all(low, F.lit(r"[^\w\s]"), F.lit(0)), F.regexp_extract_all(low, F.lit(r"\(([a-e])\)"), F.lit(1))]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def final_answer(c: Column, pattern: str = r"(?i)final\s*answer\s*[:\-]\s*([^\n]+)") -> Column:
    """The last match with white space reduced, at most 400 characters, or NULL."""
    found = F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.substring(F.trim(F.regexp_replace(F.element_at(found, -1), r"\s+", " ")), 1, 400))


def digest(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))), 1, n)


def content_uid(domain: Column, question: Column, reference: Column) -> Column:
    """Identity of a question: three letters of its domain and twelve digits of a hash of domain, question and reference."""
    short = F.substring(F.replace(domain, F.lit("rar_"), F.lit("")), 1, 3)
    return F.concat(short, F.lit("-"), F.substring(F.sha1(F.concat_ws("\0", domain, or_empty(question), or_empty(reference))), 1, 12))


def clipped(c: Column, limit: int) -> Column:
    """Head and tail in the proportion two to one with a gap between, if longer than the limit."""
    head = limit * 2 // 3
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.lit("\n...\n"), F.right(c, F.lit(limit - head)))).otherwise(c)


def without_fences(c: Column) -> Column:
    """Without a code fence around the whole text."""
    return strip(F.regexp_replace(or_empty(c), r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$", "$1"))


def stem(c: Column) -> Column:
    """A plain suffix stripper for words: the first rule that fits and leaves at least three letters applies."""
    # Suffixes and what replaces them, in order.
    rules = [("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ness", ""), ("ingly", ""), ("edly", "")]
    plain = ["ing", "ed", "ly", "es", "s"]
    fits = lambda suffix: c.endswith(suffix) & (F.length(c) > len(suffix) + 2)
    cut = lambda suffix, to: F.concat(F.left(c, F.length(c) - len(suffix)), F.lit(to))
    out = c
    for suffix in reversed(plain):
        out = F.when(fits(suffix) & ~c.endswith("ss"), cut(suffix, "")).otherwise(out)
    for suffix, to in reversed(rules):
        out = F.when(fits(suffix), cut(suffix, to)).otherwise(out)
    return out
