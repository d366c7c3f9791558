"""Word lists, patterns, weights and thresholds that results depend on."""

from __future__ import annotations

# Stop words of the content tokeniser.
STOPWORDS = """a an the and or but if then than that this these those of to in on at by for with
    from as is are was were be been being it its it's they them their there here which who
    whom whose what when where why how all any both each few more most other some such no
    nor not only own same so too very can will just should now must may might could would
    does do did doing done have has had having i you he she we us our your his her also
    into about over under between within without across during before after above below
    response answer criteria criterion mention mentions mentioned state states stated
    explain explains explained include includes included provide provides provided must
    should may correctly correct clearly clear""".split()

# Substrings that make a criterion subjective.
SUBJECTIVE_TERMS = [
    "clearly", "clear ", "concise", "concisely", "thorough", "thoroughly", "appropriate", "appropriately", "well-organized",
    "well organized", "well-structured", "well structured", "readability", "readable", "coherent", "coherently", "logical flow",
    "easy to follow", "comprehensive", "comprehensively", "adequate", "adequately", "sufficient", "sufficiently", "properly",
    "effectively", "effective ", "robust", "insightful", "elegant", "nuanced", "professional", "engaging", "accessible",
    "succinct", "succinctly", "rigorous", "high-quality", "articulate", "in-depth", "well-reasoned", "seamlessly", "meaningful",
    "helpful", "user-friendly", "enhancing", "enhances", "enhance", "smooth", "polished", "elegantly", "aptly",
]

# Substrings about presentation.
STYLE_TERMS = [
    "tone", "format", "formatting", "structure", "structured", "organiz", "readab", "concise", "brevity", "verbos", "jargon",
    "empath", "presentation", "layout", "bullet", "heading", "wording", "phrasing", "style", "narrative", "flow",
    "language accessible", "plain language", "prose",
]

# Phrases that assert correctness without saying what is correct.
NOT_SELF_CONTAINED = [
    "the correct answer", "correct answer", "the right answer", "correct value", "correct result", "correct solution",
    "correct final", "accurate answer", "the reference", "reference answer", "expected answer", "expected value",
    "appropriate value", "as expected", "the proper answer", "final answer is correct", "correct numerical",
    "correct conclusion", "arrives at the correct",
]

# Categories, the weights each may have, their rank and their replacement weights.
CATEGORIES = ["Essential", "Important", "Optional", "Pitfall"]
CATEGORY_RANK = {"Essential": 3, "Important": 2, "Optional": 1}
CATEGORY_WEIGHTS = {"Essential": 1.0, "Important": 0.7, "Optional": 0.3, "Pitfall": 0.9}
WEIGHT_BAND = {"Essential": [5], "Important": [3, 4], "Optional": [1, 2], "Pitfall": [-1, -2]}
DEFAULT_SCORING_WEIGHT, DEFAULT_FORENSIC_WEIGHT = 0.7, 0.5

# Tokenisers (the input is lower-cased first).
WORD = r"[A-Za-z][A-Za-z\-']+"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-'\.]*"
NUMBER = r"\d+(?:\.\d+)?"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z(])"
SYMBOL = r"[^\x00-\x7F]|\\[a-zA-Z]+|[=<>+^_/]"
VECTOR_TOKEN = r"(?U)\b\w\w+\b"

# Prefixes and phrasings of criteria.
FORENSIC_PREFIX = r"(?i)^\s*([A-Za-z]+)\s+Criteria\s*:\s*"
STRICT_PREFIX = r"(?i)^\s*(essential|important|optional|pitfall)\s*criteri(?:a|on)\s*:\s*"
SUBJECT = r"(?:the\s+(?:response|answer|explanation)\s+)?"
FAILURE_PHRASING = (
    r"(?i)^\s*" + SUBJECT + r"(does\s+not\s+(?:mention|state|recommend|include|identify|address|note|specify|suggest|list|provide|discuss|explain)"
    r"|fails?\s+to|omits?|neglects?\s+to|overlooks?|ignores?|misses|recommends?|suggests?|claims?|misidentifies|confuses|mistakes)"
)
AVOIDANCE_PHRASING = (
    r"(?i)^\s*" + SUBJECT + r"(avoid(?:s|ing|ed)?|does\s+not\s+(?:incorrectly|wrongly|falsely|erroneously|mistakenly)"
    r"|(?:must|should)\s+(?:not|avoid|never|refrain|steer)|do\s+not|refrains?|never|warns?\s+against|cautions?\s+against|ensures?|prevents?)"
)
PITFALL_OPENER = r"(?i)^\s*(does not mention|recommends)"
NEGATIVE_OPENER = (
    r"(?i)^\s*(?:the\s+(?:response|answer)\s+)?(?:must\s+not|should\s+not|does\s+not|do\s+not|fails?\s+to|neglects?\s+to|omits?|avoids?|avoiding|recommends?)\s*"
    r"(?:mention(?:ing)?|state|recommend|include|identify|note)?\s*"
)
POSITIVE_OPENER = (
    r"(?i)^\s*(?:the\s+)?(?:response|answer)?\s*(?:must|should|may|will)?\s*(?:clearly|explicitly|correctly|accurately)?\s*"
    r"(?:state[sd]?|identif(?:y|ies)|mention[sd]?|explain[sd]?|includ(?:e|es)|note[sd]?|provide[sd]?)\s*(?:that\s+)?"
)
MODALS = {"must": r"(?i)\bmust\b", "should": r"(?i)\bshould\b", "may": r"(?i)\bmay\b|\bmight\b|\bcould\b"}
OPTION = r"(?i)\(\s*[a-eA-E]\s*\)|\boption\b|\banswer\b|\bchoice\b"
TASK_CUE = (
    r"(?i)\b(find|calculate|determine|compute|show|derive|prove|explain|estimate|evaluate|obtain|sketch|describe|discuss|what|how|why|write|give|list|solve|verify)\b"
)
LETTER_PART = r"(?:^|[\s(])\(?([a-h])[\)\.](?=\s)"
NUMERIC_PART = r"(?:^|\n)\s*\(?([1-9])[\)\.](?=\s)"
