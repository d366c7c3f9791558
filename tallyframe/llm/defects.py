"""Problem 2: broken prompt and response pairs, by labelling functions and an expectation-maximization label model.

For every defect a handful of noisy labelling functions vote yes (1), no (-1) or abstain (0). Votes of a row are one small
code per defect, so the model is fitted on the counts of codes over all rows: at most 3^m codes for m functions,
whatever the number of rows. Expectation-maximization learns each function's behaviour and the defect's rate, and gives every code a
posterior. Cutoffs are validated on labelled rows: every row gets a defect planted (emptied, cut at a random place, replaced by the question, by an answer in another
language or by a refusal), but for a sixth that stays as it is, and is judged by a model fitted on the half of the rows (by hash) that it isn't in; the cutoff of a
defect is the one of best F1 on all of them. A row keeps all labels above their
cutoffs. A later defect in the order of DEFECTS may be a mere effect of an
earlier one (a refusal in English is also in another language), so the first of them is a row's main defect.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut

DEFECTS = ["empty", "refusal", "copies_question", "other_language", "truncated"]
VOTES = 5
WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[^<>]{0,40}>|```\w*|\*\*|__|[`#>~]")
PLACEHOLDERS = {"", "n a", "na", "none", "null", "nil", "nan", "tbd", "todo", "answer", "final answer", "response", "no answer", "empty", "think"}
TERMINAL = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f]["'\u201d\u2019\u00bb)\]}*_`>\s]*$""")
COMPLETE = re.compile(
    r"\\boxed\{[^{}]*\}[$\s]*$"
    r"|(?i:\bfinal answer\s*:\s*)[-+]?\d[\d.,]*(?:e[-+]?\d+)?\s+\S+$"
    r"|(?:^|\n)\s*(?:[-*\u2022]|\d+[.)])\s+[^\n]*:\s*[-+]?\d[\d.,]*\s+\S+$"
    r"|\([A-Za-z0-9]\)$"
    r"|(?i:\boptions?\s*:)[^\n]*\([A-Z]\)\s+\S+(?:\s+\S+){0,3}$"
    r"|^\s*[-+]?\d[\d.,]*(?:e[-+]?\d+)?(?:\s+\S+)?$"
    r"|^\s*\[[^\[\]]*\]$"
    r"|[\"'\u201d\u2019](?i:\s*(?:final )?answer:)$"
)
OPEN_WORDS = set(
    "a an the of to for with by at in on and or but that which when while whereas whenever until unless although because before after since once provided if than each its no some any most more less from is are means la le de der die das und et y e que para con и в на что".split()
)
#: Ways to decline, to open and to close a refusal. Decoys such as "cannot rule out" don't fit them.
DECLINES = re.compile(
    r"\b(?:i(?: am|'m| was)? (?:can't|cannot|can not|won't|will not|not able to|unable to)(?: \w+){0,2} (?:help|assist|answer|discuss|comment|provide|advise|share)"
    r"|i(?:'m| am) (?:not able|unable) to|i must (?:pass|decline)|i (?:have to|must|will) decline|(?:is|are) (?:outside|not something) (?:what )?i (?:do|can)"
    r"|one i leave unanswered|nothing can be said by me|not be right for me to|can't do that one|off limits for me|no comment on|^declined\b|^\W*withheld\b|i(?:'d| would) rather not)"
)
OPENERS = re.compile(
    r"^(?:i am sorry|i'm sorry|sorry, |my apologies|apologies|regrettably|unfortunately|for safety reasons|as a careful assistant|i have to decline|thank(?:s| you) for asking|after some thought|hmm\b|declined\b|\W*withheld\b|no comment\b|can't do\b|alas)"
)
CLOSERS = re.compile(r"(?:ask me something else\?|another source for [\w ]+\.|would be a better choice\.|ask a qualified expert\.|i hope you understand\.|off limits for me\.|withheld[^\]]*\])$")
DECOYS = re.compile(r"\b(?:can't help noting|cannot rule out|sorry cases|but the answer stands)\b")
#: Refusals in general, by language: a first person who can't, won't or mustn't do what an answer does.
CANNOT = re.compile(
    r"\b(?:i(?:'m| am)? (?:really |simply |just )?(?:can't|cannot|can not|couldn't|won't|will not|must not|mustn't|may not|not able to|not allowed to|not permitted to|unable to|not comfortable|do not feel|don't feel|refuse|decline)"
    r"(?: \w+){0,4}? (?:help|helping|assist|answer|answering|discuss|discussing|comment|provide|providing|advise|advice|share|sharing|give|giving|offer|tell|recommend|respond|responding|comply|fulfil|fulfill|continue|support|address|that|this)\b"
    r"|as an? (?:ai|language model|assistant)\b[^.]{0,60}\b(?:cannot|can't|not|unable)\b|(?:have|choose|prefer|going|like) (?:to|not to) (?:decline|refuse|abstain|answer)\b|against my (?:rules|guidelines|policy|principles)"
    r"|je (?:ne peux|ne puis|ne suis pas en mesure|dois refuser|refuse de|préfère ne pas|ne souhaite pas)|ich (?:kann|darf|möchte|werde|will) (?:\w+ ){0,5}?(?:nicht|keine)\b[^.]{0,40}\b(?:beantworten|helfen|antworten|geben|sagen)|(?:es )?tut mir leid"
    r"|(?:lo siento|no puedo (?:\w+ ){0,3}?(?:ayudar|responder|contestar|dar|ofrecer|comentar)\w*|no me es posible|prefiero no)|(?:não (?:posso|consigo) (?:\w+ ){0,3}?(?:ajudar|responder|dar|oferecer|comentar)\w*|sinto muito|prefiro não)"
    r"|я не (?:могу|буду|стану|вправе) (?:\w+ ){0,3}?(?:помочь|ответить|отвечать|помогать|дать|давать|обсуждать)\w*|вынужден\w* отказать)"
)
APOLOGY = re.compile(
    r"^\W*(?:(?:i'm|i am|we are|we're) (?:so |very |really )?(?:sorry|afraid|unable|not able)|sorry\b|(?:my |sincere )?apologies|i apologi[sz]e|unfortunately|regrettably|i must (?:decline|refuse)|as an? (?:ai|language model|assistant)|i(?:'d| would) (?:rather|prefer) not"
    r"|(?:je suis )?désolée?|pardon|malheureusement|(?:es )?tut mir leid|leider|entschuldigung|lo siento|lamento|lamentablemente|desculpe|sinto muito|infelizmente|извините|простите|к сожалению|i (?:really |simply |just )?(?:cannot|can't|won't|will not) |я не могу)"
)
FIRST_PERSON = set("i i'm i'd i've i'll my me myself mine je j' me moi mon ma ich mir mich mein meine yo mi mí me eu meu minha mim я мне меня мой".split())
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to and is its at that by for in with this from when which what how would one each some most no if it on are as any after before than while because unless until both all",
    "fr": "le la les de des du et est une un il elle que qui ne pas avec pour au après lorsque donc devient pourquoi ce",
    "de": "der die das und ist ein eine nicht mit von nach wenn wird zu im bei sollte man deshalb warum was den dem nur",
    "es": "el la los las de y es una un no que con por se hay cuando tras del esta sigue qué eso vuelve",
    "pt": "o a os as de e é uma um não que com por se quando depois do da assim fica torna ela no quase",
    "ru": "и в не на что у то если через поэтому нельзя путать по он она это показывает мало",
}
LANGUAGES = list(FUNCTION_WORDS)
_BY_WORD: dict[str, list[int]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _BY_WORD.setdefault(_w, []).append(_k)


def language(words: list[str]) -> tuple[str | None, float]:
    """The most likely language of some words and its lead over the next, as a share of all words; NULL without evidence."""
    scores = [0.0] * len(LANGUAGES)
    for w in words:
        hit = _BY_WORD.get(w)
        if hit:
            for k in hit:
                scores[k] += 1 / len(hit)
    if not words:
        return None, 0.0
    cyrillic = sum("\u0400" <= w[0] <= "\u04ff" for w in words)
    scores[LANGUAGES.index("ru")] += cyrillic
    best = max(range(len(scores)), key=scores.__getitem__)
    rest = max(s for k, s in enumerate(scores) if k != best)
    lead = (scores[best] - rest) / len(words)
    return (LANGUAGES[best], lead) if scores[best] > rest else (None, 0.0)


def copied(answer: list[str], question: list[str], least: int = 5) -> tuple[int, int]:
    """Of an answer's words: how many stand in runs of at least ``least`` words that the question has too, and the length of
    the longest such run. Runs are taken from left to right, each as long as possible, with a suffix automaton of the question,
    so the time is in proportion to the words."""
    starts = {tuple(question[i : i + least]) for i in range(len(question) - least + 1)}
    if not any(tuple(answer[i : i + least]) in starts for i in range(len(answer) - least + 1)):
        return 0, 0
    follow = automaton(question)
    total, longest, at = 0, 0, 0
    while at + least <= len(answer):
        state, end = 0, at
        while end < len(answer) and (to := follow[state].get(answer[end])) is not None:
            state, end = to, end + 1
        if end - at >= least:
            total, longest, at = total + end - at, max(longest, end - at), end
        else:
            at += 1
    return total, longest


def automaton(words: list[str]) -> list[dict[str, int]]:
    """Transitions of the suffix automaton: a path from state 0 exists for each run of the words, and for nothing else."""
    follow, link, size, last = [{}], [-1], [0], 0
    for w in words:
        new = len(follow)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        p, last = last, new
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p < 0:
            continue
        q = follow[p][w]
        if size[q] != size[p] + 1:
            twin = len(follow)
            follow.append(dict(follow[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            while p >= 0 and follow[p].get(w) == q:
                follow[p][w] = twin
                p = link[p]
            link[q] = twin
            q = twin
        link[new] = q
    return follow


def votes(question: str | None, answer: str | None, error: str | None, recorded: float | None) -> list[list[int]]:
    """Votes of the labelling functions, VOTES for each of DEFECTS."""
    question, answer, error = question or "", answer or "", (error or "").lower()
    plain = MARKUP.sub(" ", answer).replace("\u200b", " ").replace("\u2019", "'")
    words = [w.lower() for w in WORD.findall(plain)]
    asked = [w.lower() for w in WORD.findall(question)]
    n = len(words)
    tail = answer.rstrip("\u200b\u200c\ufeff \t\r\n\u00a0\u200a")
    low = " ".join(plain.lower().split())
    digits = any(w.isdigit() for w in words)

    key = " ".join(words)
    empty = [
        1 if key in PLACEHOLDERS else -1,
        1 if n == 0 else (-1 if n > 3 else 0),
        1 if n <= 1 and not digits else -1,
        1 if "empty" in error or "no reply" in error else 0,
        1 if len(answer.strip()) <= 4 and not digits else (-1 if len(answer) > 40 else 0),
    ]

    decoy = bool(DECOYS.search(low))
    declines = not decoy and n <= 80 and bool(DECLINES.search(low) or CANNOT.search(low))
    personal = sum(w in FIRST_PERSON for w in low.split()) / n >= 0.08 if n else False
    refusal = [
        1 if declines else -1,
        1 if not decoy and (OPENERS.search(low) or APOLOGY.search(low)) else -1,
        1 if CLOSERS.search(low) or (personal and n <= 45 and not decoy) else 0,
        -1 if n > 45 else (0 if n else -1),
        -1 if digits else 0,
    ]

    body = words
    for lead in (["the", "question", "is"], ["question"], ["q"]):
        if body[: len(lead)] == lead:
            body = body[len(lead) :]
            break
    taken, run = copied(body, asked)
    known = set(asked)
    inside = sum(w in known for w in body) / len(body) if body else 0.0
    part = taken / len(body) if body else 0.0
    copies = [
        1 if part >= 0.9 and run >= 5 else -1,
        1 if inside >= 0.95 and len(body) >= 5 else -1,
        1 if part >= 0.6 and run >= 5 else -1,
        (1 if run >= 10 else 0) if inside >= 0.9 else -1,
        -1 if part < 0.6 or len(body) < 4 else 0,
    ]

    mine, lead = language(words)
    theirs, asked_lead = language(asked)
    differ = mine is not None and theirs is not None and mine != theirs
    sure = lead >= 0.15 and asked_lead >= 0.08
    script = lambda ws: sum("\u0400" <= w[0] <= "\u04ff" for w in ws) > len(ws) / 3 if ws else None
    other = [
        (1 if differ else -1) if mine and theirs else 0,
        (1 if differ else -1) if sure else (0 if mine and theirs and n > 4 else -1),
        1 if n and asked and script(words) != script(asked) else 0,
        (1 if differ and n >= 5 else -1) if n else -1,
        -1 if inside >= 0.8 or declines else 0,
    ]

    complete = bool(TERMINAL.search(tail) or COMPLETE.search(tail))
    short = bool(recorded and recorded > len(answer) + 5)
    last = words[-1] if words else ""
    truncated = [
        -1 if complete or not n or key in PLACEHOLDERS else 1,
        1 if not complete and (last in OPEN_WORDS or tail.endswith(("(", ",", "\ufffd", "-"))) else (-1 if complete else 0),
        1 if short and not complete and n else 0,
        1 if n > 3 and not complete and ("timeout" in error or "closed early" in error) else 0,
        -1 if complete or n < 3 else (1 if tail[-1:].isalnum() else 0),
    ]
    return [empty, refusal, copies, other, truncated]


def encode(v: list[int]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def decode(code: int, m: int = VOTES) -> list[int]:
    out = []
    for _ in range(m):
        code, x = divmod(code, 3)
        out.append(x - 1)
    return out[::-1]


def coded(pairs: DataFrame, key: str) -> DataFrame:
    """(key columns, c0 ...) of pairs: a code of votes per defect."""
    names = key.replace(",", " ").split()[::2]

    def run(frames):
        for f in frames:
            recorded = [None if r is None or r != r else r for r in f["recorded"]]
            codes = [[encode(v) for v in votes(q, a, e, r)] for q, a, e, r in zip(f["question"], f["answer"], f["error"], recorded)]
            if codes:
                table = pd.DataFrame(codes, columns=[f"c{k}" for k in range(len(DEFECTS))])
                yield pd.concat([f[names].reset_index(drop=True), table], axis=1)

    kinds = ", ".join(f"c{k} int" for k in range(len(DEFECTS)))
    return pairs.select(*names, "question", "answer", "error", "recorded").mapInPandas(run, f"{key}, {kinds}")


def prepared(pairs: DataFrame) -> DataFrame:
    picked = pairs.where(F.col("rec_id").isNotNull()).select("src", F.col("rec_id").cast("long").alias("rec_id"), "question", "answer", "error", F.col("recorded").cast("double").alias("recorded"))
    return picked.withColumn("fold", F.pmod(F.xxhash64("src", "rec_id"), F.lit(2)))


#: Refusals to plant for the choice of cutoffs.
PLANTED_REFUSALS = [
    "I'm afraid I cannot give guidance on this topic.", "As an AI, I cannot give medical advice.", "I won't be able to offer a recommendation here.", "Sorry, but this is a question I will not answer.", "I am not permitted to discuss this subject.",
    "Je ne peux pas répondre à cette question.", "Es tut mir leid, darauf kann ich keine Antwort geben.", "Lo siento, no puedo ayudar con eso.", "Sinto muito, não posso responder a isso.", "Извините, я не могу ответить на этот вопрос.",
]
PLANTED_FOREIGN = [
    ("Le débit de la pompe est doublé lorsque la pression monte, et la valeur ne change pas avec la température.", "fr"), ("Der Druck ist nicht mit der Temperatur verbunden, und die Pumpe wird nach dem Start im Kreis geführt.", "de"),
    ("La presión de la bomba se duplica cuando el caudal sube, y eso no cambia con la temperatura del aire.", "es"), ("The flow of the pump is doubled when the pressure rises, and the value is not changed by the heat of the air.", "en"),
]


def planted(question: str | None, answer: str | None, key: int) -> tuple[int, str | None]:
    """(defect number, or -1, and the answer with that defect planted), by a hash of the row."""
    kind, draw = key % 6, key // 6
    answer, question = answer or "", question or ""
    words = WORD.findall(answer)
    if kind == 0:
        return 0, sorted(PLACEHOLDERS)[draw % len(PLACEHOLDERS)]
    if kind == 1:
        return 1, PLANTED_REFUSALS[draw % len(PLANTED_REFUSALS)]
    if kind == 2 and len(WORD.findall(question)) >= 8:
        return 2, question if draw % 2 else "Question: " + question
    asked = language([w.lower() for w in WORD.findall(question)])[0]
    if kind == 3 and asked:
        text, of = PLANTED_FOREIGN[draw % len(PLANTED_FOREIGN)]
        part = text.split()[: 6 + draw // 4 % 14]
        return (3, " ".join(part).rstrip(",.") + ".") if of != asked else (-1, answer)
    if kind == 4 and len(words) >= 12 and TERMINAL.search(answer.rstrip()):
        at = len(answer) // 3 + draw % max(len(answer) // 3, 1)
        cut_ = answer[:at].rstrip()
        return (4, cut_) if not TERMINAL.search(cut_) else (-1, answer)
    return -1, answer


def validation_codes(pairs: DataFrame) -> DataFrame:
    """(label, fold, c0 ...) of all pairs, with planted defects."""

    def plant(frames):
        for f in frames:
            keys = [zlib.crc32(f"{s}:{i}".encode()) for s, i in zip(f["src"], f["rec_id"])]
            got = [planted(q, a, k) for q, a, k in zip(f["question"], f["answer"], keys)]
            changed = [label >= 0 for label, _ in got]
            f = f.assign(label=[label for label, _ in got], answer=[a for _, a in got])
            f.loc[changed, ["error", "recorded"]] = None
            yield f[["label", "fold", "question", "answer", "error", "recorded"]]

    made = pairs.select("src", "rec_id", "fold", "question", "answer", "error", "recorded").mapInPandas(plant, "label int, fold long, question string, answer string, error string, recorded double")
    return coded(made, "label int, fold long")


class LabelModel:
    """Two latent classes, functions independent within a class; fitted on counts of vote codes by EM."""

    def __init__(self, m: int = VOTES, rounds: int = 100, prior: float = 0.03):
        self.m, self.rounds, self.rate = m, rounds, prior
        # From class and vote (-1, 0, 1): a function starts out as right more often than wrong.
        self.table = np.array([np.full((m, 3), (0.7, 0.25, 0.05)), np.full((m, 3), (0.1, 0.3, 0.6))])
        self.pseudo = np.array([np.full((m, 3), (7.0, 2.5, 0.5)), np.full((m, 3), (1.0, 3.0, 6.0))])

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        v = np.array([decode(int(c), self.m) for c in codes]).reshape(-1, self.m) + 1
        log = np.log(self.table[:, np.arange(self.m), v]).sum(-1) + np.log([[1 - self.rate], [self.rate]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def fit(self, codes: np.ndarray, counts: np.ndarray) -> LabelModel:
        v = np.array([decode(int(c), self.m) for c in codes]).reshape(-1, self.m) + 1
        hit = (v[:, :, None] == np.arange(3)).astype(float)
        for _ in range(self.rounds):
            p = self.posterior(codes)
            for k, w in enumerate((counts * (1 - p), counts * p)):
                t = (hit * w[:, None, None]).sum(0) + self.pseudo[k]
                self.table[k] = t / t.sum(1, keepdims=True)
            self.rate = float(np.clip(((counts * p).sum() + 1) / (counts.sum() + 2), 1e-6, 0.5))
        return self


def cutoff(posteriors: np.ndarray, counts: np.ndarray, right: np.ndarray | None = None) -> float:
    """The cutoff with the best F1, at least 0.5: ``right`` of the ``counts`` rows of each code have the defect (as many as the posterior
    lets expect if not given)."""
    best, at = -1.0, 0.5
    right = posteriors * counts if right is None else right
    for c in sorted({0.5, *posteriors[posteriors >= 0.5].tolist()}):
        keep = posteriors >= c
        f1 = 2 * right[keep].sum() / max(counts[keep].sum() + right.sum(), 1e-12)
        if f1 > best + 1e-12:
            best, at = f1, c
    return at


def posterior_table(codes: DataFrame, labelled: DataFrame) -> list[tuple[int, int, float, float]]:
    """(defect number, code, posterior, cutoff) for every code that occurs: at most 3^VOTES codes for each defect. ``labelled`` rows of a fold are judged by the
    model of the other."""

    def counts(frame: DataFrame, *marks: str) -> list:
        exploded = frame.select(*marks, F.posexplode(F.array(*[F.col(f"c{k}") for k in range(len(DEFECTS))])).alias("d", "code"))
        return exploded.groupBy("d", "code", *marks).agg(F.count(F.lit(1)).alias("n")).collect()

    counted, checked = counts(codes, "fold"), counts(labelled, "label", "fold")
    out = []
    for d in range(len(DEFECTS)):
        own = [r for r in counted if r.d == d]
        if not own:
            continue
        seen = np.array(sorted({r.code for r in own}))
        fold = {f: np.array([sum(r.n for r in own if r.code == c and r.fold == f) for c in seen], float) for f in (0, 1)}
        held = {f: LabelModel().fit(seen, fold[1 - f]) for f in (0, 1)}
        judged = []
        for f in (0, 1):
            truth = [r for r in checked if r.d == d and r.fold == f]
            test = np.array(sorted({r.code for r in truth}), np.int64)
            total = np.array([sum(r.n for r in truth if r.code == c) for c in test], float)
            right = np.array([sum(r.n for r in truth if r.code == c and r.label == d) for c in test], float)
            # Rows as they are, cut ones and refusals (of any language) may have the defect besides: as many as the posterior lets expect.
            open_ = np.array([sum(r.n for r in truth if r.code == c and r.label in (-1, 1, len(DEFECTS) - 1) and r.label != d) for c in test], float)
            p = held[f].posterior(test) if len(test) else np.zeros(0)
            judged.append((p, total, right + open_ * p))
        p, total, right = (np.concatenate(x) for x in zip(*judged))
        at = cutoff(p, total, right) if right.sum() else cutoff(*(np.concatenate(x) for x in zip(*[(held[f].posterior(seen), fold[f]) for f in (0, 1)])))
        final = LabelModel().fit(seen, fold[0] + fold[1]).posterior(seen)
        out += [(d, int(c), float(p), float(at)) for c, p in zip(seen, final)]
    return out


def defect_labels(pairs: DataFrame) -> DataFrame:
    """(src, rec_id, defect, posterior, rank): every label of a pair (src, rec_id, question, answer, error, recorded) whose posterior
    exceeds its cutoff; rank follows the order of DEFECTS, 1 being the main one.

    Defined cases: NULL answers count as empty; a NULL question gives no evidence of copying or language; NULL ids are left
    out; repeated rows are labelled each; an empty table gives no rows; other columns are ignored; texts are read whole."""
    spark = pairs.sparkSession
    pairs = prepared(pairs)
    codes = cut(coded(pairs, "src string, rec_id long, fold long"))
    table = posterior_table(codes, validation_codes(pairs))
    schema = "d int, code int, posterior double, cutoff double"
    known = F.broadcast(spark.createDataFrame(table, schema))  # at most len(DEFECTS) * 3^VOTES rows
    long = codes.select("src", "rec_id", F.posexplode(F.array(*[F.col(f"c{k}") for k in range(len(DEFECTS))])).alias("d", "code"))
    kept = long.join(known, ["d", "code"]).where("posterior >= cutoff")
    names = F.array(*[F.lit(x) for x in DEFECTS])
    listed = kept.groupBy("src", "rec_id").agg(F.array_sort(F.collect_list(F.struct("d", "posterior"))).alias("all"))
    return listed.select("src", "rec_id", F.posexplode("all").alias("r", "x")).select("src", "rec_id", names[F.col("x.d")].alias("defect"), F.col("x.posterior").alias("posterior"), (F.col("r") + 1).alias("rank"))
