"""Rules that put criteria into positive, checkable form; each is a chain of regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import lexicon as L
from tallyframe.functions import text as T

# Openers that name an omission.
OMISSION = (
    r"(?i)^\s*" + L.SUBJECT + r"(?:does\s+not\s+(?:mention|state|note|say|specify|include|list|provide|discuss|explain|address|identify|describe|recommend|suggest)"
    r"|fails?\s+to|omits?|neglects?\s+to|overlooks?|ignores?|misses)\b"
)
# Openers and what replaces them, in order; the second list is for pitfalls only.
POSITIVE_FORMS = [
    (r"does\s+not\s+(?:mention|state|note|say|specify)\s+(?:that\s+)?", "States "),
    (r"does\s+not\s+(?:include|list|provide)\s+", "Includes "),
    (r"does\s+not\s+(?:identify|recognise|recognize)\s+", "Identifies "),
    (r"does\s+not\s+(?:discuss|explain|describe|address)\s+", "Explains "),
    (r"does\s+not\s+(?:recommend|suggest)\s+", "Recommends "),
    (r"fails?\s+to\s+", "Does "),
    (r"neglects?\s+to\s+", "Does "),
    (r"(?:omits?|overlooks?|misses)\s+", "States "),
    (r"ignores?\s+", "Accounts for "),
]
PITFALL_FORMS = [
    (r"(?:incorrectly|wrongly|falsely|erroneously|mistakenly)\s+", "Avoids incorrectly "),
    (r"(?:recommends?|suggests?)\s+", "Avoids recommending "),
    (r"(?:claims?|states?|asserts?|reports?)\s+", "Avoids claiming "),
    (r"(?:misidentifies|confuses|mistakes)\s+", "Avoids misidentifying "),
]
# Subjective words with a technical sense too, which are kept.
AMBIGUOUS = ["clear", "smooth", "robust", "accessible", "effective", "elegant", "engaging"]
# Repairs of grammar after words were taken out, in order.
TIDY = [
    (r"([,;])\s*(?=[,;])", ""),
    (r"(?i)\b(a|an|the)\s+(?:and|or)\s+", "$1 "),
    (r"(?i)\b(?:is|are|was|were|remains?|stays?|reads?|appears?)\s+and\s+", ""),
    (r"(?i)\s+(?:and|or)\s+(?:and|or)\s+", " and "),
    (r"(?i)^\s*(?:and|or)\s+", ""),
    (r"(?i)\s+(?:and|or)\s*(?=[,.;:]|$)", ""),
    (r"(?i)\b(a|an|the)\s+(?=[,.;:]|$)", ""),
    (r"\s+([,.;:])", "$1"),
    (r"\s{2,}", " "),
]
# Fixed value: clauses that may only praise.
PRAISE_CLAUSE = r"\s*(?:,|;)?\s*\b(?:while|whilst|ensuring|ensure|making|so\s+that|thereby|thus|without|avoiding|which\s+(?:makes|ensures|helps))\b[^.;]*"


def tidy(c: Column) -> Column:
    for pattern, to in TIDY:
        c = F.regexp_replace(c, pattern, to)
    return T.let(F.regexp_replace(T.strip(c), r"^[,;\s]+|[,;\s]+$", ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))


def polarity_offence(description: Column, category: Column) -> Column:
    """Why a criterion doesn't read "true means good": its detection method, or NULL."""
    text = T.without_strict_prefix(description)
    return F.when(T.polarity(description, category) == "negative", T.polarity_method(description, category)).when((category != "Pitfall") & text.rlike(OMISSION), "failure")


def positive_form(description: Column, category: Column) -> Column:
    """The first fitting rewrite; without one, "Avoids" before the sentence. Empty stays empty."""

    def one(text: Column) -> Column:
        out = F.concat(F.lit("Avoids "), F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
        rules = [(p, to, F.lit(True)) for p, to in POSITIVE_FORMS] + [(p, to, category == "Pitfall") for p, to in PITFALL_FORMS]
        for p, to, applies in reversed(rules):
            pattern = r"(?i)^\s*" + L.SUBJECT + p
            out = F.when(applies & text.rlike(pattern), F.concat(F.lit(to), F.regexp_replace(F.regexp_replace(text, pattern, ""), r"^\s+", ""))).otherwise(out)
        return F.when(text == "", "").otherwise(tidy(out))

    return T.let(T.strip(T.without_strict_prefix(description)), one)


def subjective_hits(c: Column) -> Column:
    """The subjective and style terms in a text, sorted."""
    terms = F.array(*[F.lit(t) for t in L.SUBJECTIVE_TERMS + L.STYLE_TERMS])
    return T.let(F.lower(T.or_empty(c)), lambda low: F.array_sort(F.array_distinct(F.transform(F.filter(terms, lambda t: F.contains(low, t)), F.trim))))


def plain_form(description: Column) -> Column:
    """Without quality words and clauses of praise; as it was if fewer than four words would be left."""
    single = sorted({t.strip() for t in L.SUBJECTIVE_TERMS if " " not in t.strip() and t.strip() not in AMBIGUOUS})
    praise = "|".join(t.strip().replace("-", r"\-") for t in sorted(L.SUBJECTIVE_TERMS + L.STYLE_TERMS))

    def one(text: Column) -> Column:
        # A clause goes only if it has a subjective or style term.
        cut = F.regexp_replace(text, r"(?i)(?=" + PRAISE_CLAUSE.replace("[^.;]*", r"[^.;]*?(?:" + praise + ")") + ")" + PRAISE_CLAUSE, "")
        done = tidy(F.regexp_replace(cut, r"(?i)\b(?:" + "|".join(w.replace("-", r"\-") for w in single) + r")\b", ""))
        return T.let(done, lambda x: F.when(F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= 4, x).otherwise(text))

    return T.let(T.without_strict_prefix(description), one)


def derived_title(description: Column) -> Column:
    """The first four words without outer punctuation, at most sixty characters."""
    words = F.slice(F.filter(F.split(F.regexp_replace(T.or_empty(description), "\n", " "), " "), lambda w: w != ""), 1, 4)
    title = F.substring(F.regexp_replace(F.array_join(words, " "), r"^[.,;:]+|[.,;:]+$", ""), 1, 60)
    return T.let(title, lambda x: F.when(x == "", "Criterion").otherwise(x))


def stepped_weight(weight: Column, category: Column, up: bool) -> Column:
    """One step along the importance scale within the category's range."""
    pitfall = category == "Pitfall"
    moved = F.when(pitfall, weight + (-1 if up else 1)).otherwise(weight + (1 if up else -1))
    return F.when(pitfall, F.greatest(F.lit(-2), F.least(F.lit(-1), moved))).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), moved)))
