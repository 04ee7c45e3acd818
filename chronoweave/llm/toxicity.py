"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as a string of symbols, one for each word: insult, threat, target, negation, report, other. Five
transducers (``fst.Transducer``) are composed into one:

* insult: rewrites one insult as a hit, or none;
* threat: rewrites as a hit the target that follows a threat verb within ``NEAR`` words, if there is no other hit;
* negation: a hit within ``REACH`` words after a negation takes the negation's factor;
* report: a hit after a reporting verb takes the report's factor;
* target: a clause that also names a target takes the target's factor.

Every accepted path has one hit; a clause's weight is the sum over its paths of their factors times the weight of
the word hit. A document's score is a logistic function of its heaviest clause and of the sum over its clauses.

Learned from labelled rows: the insult lexicon, whole words and word stems (prefixes) that toxic rows have and clean
rows lack, by smoothed log-odds of document frequency; the weights of threat verbs, by the same odds; the three
factors, by likelihood against a prior that holds where labels say nothing; the logistic weights, each class
weighted by its count in all labelled rows. Threat verbs, targets, negations and report words are fixed, closed lists.

Scale: all is fitted in one task on a bounded sample of labelled rows (about ``SAMPLE`` of each class, by a bound on the
hash of the id; no ranking). Scoring is a narrow map over whole texts: one pass of a compiled alternation finds lexical
matches, and only the clauses round them are read word by word.

Defined cases: null and empty texts score as texts without a match; a null label teaches nothing; repeated
label rows of a document count as toxic if any does; of several texts of one labelled doc_id the least teaches;
without labels only the fixed lists act; empty tables give no rows; columns other than doc_id and text are
never read for scores.
"""

import itertools
import math
import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.fst import Transducer, compose
from chronoweave.llm.langid import held_out, sample_bound
from chronoweave.session import small_batches

#: The bound of the labelled sample, by class.
SAMPLE = {1: 1500, 0: 4500}
STEM = range(4, 9)
#: A word or stem is learned if it is this much likelier in toxic rows, and chance would do as much with this probability.
MIN_ODDS, MAX_CHANCE = 2.5, 1e-7
# Closed-class words of the grammar in its four languages.
THREATS = {"kill", "hurt", "destroy", "beat", "burn", "punch", "bring", "bringe", "mach", "mache", "töte", "schlage", "mataré", "matar", "pegaré", "tuer", "tuerai", "frapper"}
TARGETS = {"you", "your", "u", "they", "he", "she", "him", "them", "du", "dich", "dir", "ihr", "euch", "tu", "te", "toi", "vous", "usted", "ustedes", "ti"}
NEGATIONS = {"not", "never", "isn't", "aren't", "won't", "nicht", "kein", "keine", "nie", "jamais", "pas", "nunca"}
REPORTS = {"said", "says", "called", "quoted", "claimed", "wrote", "sagte", "nannte", "dit", "disait", "dijo", "llamó"}
OBJECT_FIRST = {"te", "dich"}  # in "je te tuerai" and "te mataré" the target stands before the verb
#: Words after a negation in which it acts, and between a threat verb and its target.
REACH, NEAR = 3, 2
THREAT_WEIGHT = 4.0
#: Factors without evidence, those that are tried, and how strongly the former hold (in units of log-likelihood).
FACTORS = {"target": 1.25, "negation": 0.5, "report": 0.6}
TRIED, HOLD = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0), 2.0
SYMBOLS = ("insult", "threat", "target", "object", "negation", "report", "other")
HITS = frozenset({"hit", "aimed"})  # a hit; a hit that is a target as well
_WORD = re.compile(r"[\w']+")
_STOP = re.compile(r"[.;:!?\n]")


def _same(state: int, to: int | None = None, but=(), weight: float = 1.0) -> list:
    """Arcs that leave every symbol as it is, but for those named."""
    return [(x, x, weight, state if to is None else to) for x in (*SYMBOLS, *sorted(HITS)) if x not in but]


def insults() -> Transducer:
    """State 1: an insult was rewritten as the hit."""
    return Transducer({0: [*_same(0), ("insult", "hit", 1.0, 1)], 1: _same(1)}, {0: 1.0, 1: 1.0})


def threats() -> Transducer:
    """State 1: there is a hit. State 2 + k: a threat verb was chosen and its target may stand k more words on. Last: an object waits for its verb."""
    wait = 2 + NEAR
    arcs = {0: [*_same(0, but=HITS), ("hit", "hit", 1.0, 1), ("object", "object", 1.0, wait)], 1: _same(1, but=HITS)}
    arcs[0] += [("threat", "threat", 1.0, 2 + NEAR - 1)]
    for k in range(NEAR):
        arcs[2 + k] = [(x, "aimed", 1.0, 1) for x in ("target", "object")] + [(x, x, 1.0, 2 + k - 1) for x in SYMBOLS if x not in ("target", "object") and k > 0]
    arcs[wait] = [("threat", "aimed", 1.0, 1)]
    return Transducer(arcs, {1: 1.0})


def negations(factor: float) -> Transducer:
    """State k: a negation acts on k more words."""
    arcs = {}
    for k in range(REACH + 1):
        arcs[k] = [*_same(max(0, k - 1), but={"negation", *HITS}), ("negation", "negation", 1.0, REACH)]
        arcs[k] += [(x, x, factor if k else 1.0, max(0, k - 1)) for x in sorted(HITS)]
    return Transducer(arcs, {k: 1.0 for k in arcs})


def reports(factor: float) -> Transducer:
    """State 1: a reporting verb was read."""
    arcs = {0: [*_same(0, but={"report"}), ("report", "report", 1.0, 1)], 1: [*_same(1, but=HITS), *((x, x, factor, 1) for x in sorted(HITS))]}
    return Transducer(arcs, {0: 1.0, 1: 1.0})


def targets(factor: float) -> Transducer:
    """State 1: a target was read."""
    named = {"target", "object", "aimed"}
    return Transducer({0: [*_same(0, but=named), *((x, x, 1.0, 1) for x in sorted(named))], 1: _same(1)}, {0: 1.0, 1: factor})


def composed(factors: dict[str, float]) -> Transducer:
    """The whole grammar as one transducer."""
    out = insults()
    for part in (threats(), negations(factors["negation"]), reports(factors["report"]), targets(factors["target"])):
        out = compose(out, part)
    return out


class Grammar:
    """Words and stems of insults with their weights, weights of threat verbs, factors; bias and slopes of the logistic score."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], verbs: dict[str, float] | None = None, factors: dict[str, float] | None = None, logistic=(-3.0, 0.5, 0.25)):
        self.words, self.stems, self.logistic = words, stems, tuple(logistic)
        self.verbs = dict.fromkeys(THREATS, THREAT_WEIGHT) if verbs is None else verbs
        self.factors = dict(FACTORS) if factors is None else factors
        self.bias, self.top, self.all = self.logistic
        self.machine = composed(self.factors)
        self.find = re.compile(r"(?<![\w'])" + alternation({*(w + "\0" for w in words), *(t + "\0" for t in self.verbs), *stems}))

    def __reduce__(self):
        return Grammar, (self.words, self.stems, self.verbs, self.factors, self.logistic)

    def symbol(self, word: str, match: str | None) -> tuple[str, float]:
        """The symbol of a word, and its weight; ``match`` is the lexical match that begins there."""
        if match is not None:
            w = max(self.words.get(match, 0.0), self.stems.get(match, 0.0))
            return ("insult", w) if w else ("threat", self.verbs[match])
        for name, words in (("negation", NEGATIONS), ("report", REPORTS), ("object", OBJECT_FIRST), ("target", TARGETS)):
            if word in words:
                return name, 0.0
        return "other", 0.0

    def clauses(self, text: str) -> list[tuple[list[str], list[float]]]:
        """(symbols, weight of the hit at each place) of every clause with a lexical match."""
        low = text.lower()
        hits: dict[tuple[int, int], dict[int, str]] = {}
        first, end = 0, -1
        for m in self.find.finditer(low):
            if m.start() >= end:
                first = max(low.rfind(c, max(end, 0), m.start()) for c in ".;:!?\n") + 1
                first = first if first > 0 or end < 0 else end
                stop = _STOP.search(low, m.end())
                end = stop.start() if stop else len(low)
            hits.setdefault((first, end), {})[m.start()] = m.group()
        out = []
        for (a, b), found in hits.items():
            read = [self.symbol(m.group(), found.get(m.start() + a)) for m in _WORD.finditer(low[a:b])]
            names, weights = [x for x, _ in read], [w for _, w in read]
            verb = 0.0  # a target that is hit weighs as the threat verb before it
            for i, x in enumerate(names):
                if x == "threat":
                    verb = weights[i]
                elif x in ("target", "object"):
                    weights[i] = verb
            out.append((names, weights))
        return out

    def weigh(self, clauses) -> tuple[float, float]:
        found = [self.machine.total(names, weights, HITS) for names, weights in clauses]
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)

    def features(self, text) -> tuple[float, float]:
        return self.weigh(self.clauses(text)) if isinstance(text, str) and text else (0.0, 0.0)

    def score(self, text) -> float:
        top, total = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.top * top + self.all * total))))

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int], share: dict[int, float] | None = None) -> "Grammar":
        """``share``: how many labelled rows each row of a class stands for."""
        n = {k: max(1, sum(1 for y in toxic if y == k)) for k in (0, 1)}
        rate = n[1] / (n[0] + n[1])
        odds = lambda c, x: math.log((c[1][x] + 0.1) / (n[1] + 0.2)) - math.log((c[0][x] + 0.1) / (n[0] + 0.2))
        pick = lambda c: {x: odds(c, x) for x, k in c[1].items() if odds(c, x) >= MIN_ODDS and chance(k, k + c[0][x], rate) <= MAX_CHANCE}
        whole, stem = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        for t, y in zip(texts, toxic):
            words = set(_WORD.findall((t or "").lower()))
            whole[y].update(words)
            stem[y].update({w[:k] for w in words for k in STEM if len(w) > k})
        # a threat verb weighs between the odds of its word, where it is seen, and its weight without evidence
        verbs = {}
        for x in THREATS:
            seen_in = whole[0][x] + whole[1][x]
            verbs[x] = max(0.0, (THREAT_WEIGHT * 5 + odds(whole, x) * seen_in) / (5 + seen_in)) if seen_in else THREAT_WEIGHT
        # what stands between the same two words again and again is one text copied, and counts once
        some, begun = pick(whole), pick(stem)
        seen = {0: defaultdict(set), 1: defaultdict(set)}
        for t, y in zip(texts, toxic):
            words = _WORD.findall((t or "").lower())
            for i, w in enumerate(words):
                for x in (w, *(w[:k] + "*" for k in STEM if len(w) > k)):
                    if x in some or x[:-1] in begun and x[-1] == "*":
                        seen[y][x].add((words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else ""))
        for c, names in ((whole, {x: x for x in some}), (stem, {x: x + "*" for x in begun})):
            for y in (0, 1):
                c[y] = Counter({x: min(c[y][x], len(seen[y][s])) for x, s in names.items()})
        some, begun = pick(whole), pick(stem)
        stems = {}
        for x, w in sorted(begun.items(), key=lambda p: len(p[0])):  # a stem stands for those that it begins
            if not any(x[:k] in stems for k in STEM if k < len(x)):
                stems[x] = w
        for s in list(stems):  # a stem that is only ever one word is that word
            forms = {c[1] for c in seen[1][s + "*"]} | ({s} if s in some else set())
            if len(forms) == 1:
                word = forms.pop()
                some[word] = max(some.get(word, 0.0), stems.pop(s))
        words = {x: w for x, w in some.items() if not any(x.startswith(s) for s in stems)}
        verbs = {x: w for x, w in verbs.items() if x not in words and not any(x.startswith(s) for s in stems)}
        grammar = cls(words, stems, verbs)
        weight = [1.0 if share is None else share[y] for y in toxic]
        if not 0 < sum(toxic) < len(toxic):
            return grammar
        read = [grammar.clauses(t) if t else [] for t in texts]
        best = None
        for name in FACTORS:  # one after the other, from the factor without evidence
            for f in dict.fromkeys((FACTORS[name], *TRIED)):
                factors = grammar.factors | {name: f}
                grammar.machine = composed(factors)
                w, fit = logistic([grammar.weigh(c) for c in read], toxic, weight)
                fit -= HOLD * sum(math.log(x / FACTORS[k]) ** 2 for k, x in factors.items())
                if best is None or fit > best[0] + 1e-9:
                    best = fit, factors, w
            grammar.factors = best[1]
        return cls(words, stems, verbs, best[1], best[2])


def alternation(names: set[str]) -> str:
    """A pattern for any of the names, by common beginnings; a name that ends in \\0 must end its word."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""  # a stem: longer names that it begins add nothing
        parts = [r"(?![\w'])" if c == "\0" else re.escape(c) + pattern(node[c]) for c in sorted(node, reverse=True)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return pattern(tree)


def chance(k: int, n: int, rate: float) -> float:
    """Probability that at least k of n rows fall into a class of that rate."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)) if 0 < rate < 1 else 1.0
    total = 0.0
    while k <= n and term > 1e-18:
        total += term
        term *= (n - k) / (k + 1) * rate / (1 - rate) if rate < 1 else 0
        k += 1
    return total


def logistic(x: list, y: list, weight: list, ridge: float = 1e-2) -> tuple[tuple[float, float, float], float]:
    """(bias and slopes, log-likelihood) by Newton steps, each row counted ``weight`` times."""
    x, y, v = np.column_stack((np.ones(len(y)), np.asarray(x, dtype=float))), np.asarray(y, dtype=float), np.asarray(weight, dtype=float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (v * (p - y)) + ridge * w
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    z = np.clip(x @ w, -30, 30)
    return tuple(float(c) for c in w), float((v * (y * z - np.log1p(np.exp(z)))).sum())


def fit(docs: DataFrame, labels: DataFrame) -> "Grammar":
    """Learns from labelled rows that are not held out."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r["count"] for r in rows.where(F.col("toxic").isin(*SAMPLE)).groupBy("toxic").count().collect()}
    chosen = rows.where(sample_bound("toxic", {y: n / max(1, count.get(y, 0)) for y, n in SAMPLE.items()}))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def learn(batches):
        """The sample, bounded by ``SAMPLE``, in one task: its texts and counts stay out of the driver."""
        sample = sorted((r for b in batches for r in zip(b["doc_id"].tolist(), b["text"], b["toxic"].tolist())), key=lambda r: r[0])
        drawn = Counter(y for _, _, y in sample)
        grammar = Grammar.fit([t for _, t, _ in sample], [y for _, _, y in sample], {y: count[y] / drawn[y] for y in drawn})
        yield pd.DataFrame({"grammar": [pickle.dumps(grammar.__reduce__()[1])]})

    learned = found.repartition(1).mapInPandas(learn, "grammar binary").first()
    return Grammar(*pickle.loads(learned.grammar)) if learned else Grammar.fit([], [])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text."""

    def run(batches):
        for batch in batches:
            s = [grammar.score(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]})

    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return source.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs``, same columns, without the rows that score ``threshold`` or more."""

    def scores(s: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in s], dtype="float64")

    return small_batches(docs).where(F.pandas_udf(scores, "double")(F.col(text)) < threshold)
