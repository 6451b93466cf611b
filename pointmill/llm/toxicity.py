"""Toxicity by a weighted finite-state grammar of clauses.

A text is cut into clauses. Every token of a clause has a class: insult, threat, target, predicate, negation, reported speech or other.
Three transducers read the classes one after the other and are composed into one machine when the grammar is built:

* negation turns insults and threats in the few tokens after a negation into negated ones,
* reported speech turns what follows a verb of saying into reported ones,
* aim holds an insult or threat pending for a few tokens and emits an outcome once a second role is met, before or after it: a
  *target* (somebody addressed or spoken of), a *predicate* (a copula or modal verb that says it of somebody), an *article* that makes it
  somebody's name, or a second lexeme.

A clause matches only by such an outcome, that is by at least two roles; a word by itself is worth nothing. An outcome is worth its
lexeme's strength. A text's score is a logistic function of the damped sums of each outcome's worth, of its best clause and of its matched
clauses; the weights, one for each kind of outcome, are fitted to labels.

The lexicon has a fixed part and a learned one. In a bounded sample of labelled texts the stems (first four to eight letters of a
word, and whole words) are counted by class; a stem that occurs in at least ``min_texts`` toxic texts and a
share ``min_share`` of them, and whose log odds exceed ``min_odds`` becomes
an insult of that strength. At most ``max_stems`` are kept, the strongest first.

Defined cases: a null text is empty; a text without matched clauses gets the score of no matches; with no labels of one class only
the fixed lexicon counts, with fixed weights; repeated rows get equal scores; an empty table gives an empty result; other columns,
ids included, do not enter a score. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, held_out, id_type, map_batches, materialize
from .learning import labelled_sample, logistic_fit, sigmoid

#: Words of each class.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown clowns imbecile vermin parasite filth dumb fool fools".split()
THREATS = "kill hurt destroy beat attack punish burn crush stab shoot".split()
TARGETS = "you your yours they them he she him her these those people everyone".split()
NEGATIONS = "not never no without nobody isn't aren't wasn't don't doesn't didn't won't nicht kein keine ne pas jamais nunca".split()
PREDICATES = "is are was were am be been being will shall must should gonna going ist sind war waren bist wird werden soll est sont était suis es son eres soy era fue será sera".split()
ARTICLES = "the a an this that such der die das den dem ein eine einen le la les un une des du el los las una unos".split()
REPORTS = "said says wrote writes claimed claims called quoted reported told asked according sagte dijo dit".split()
OTHER, INSULT, THREAT, TARGET, PREDICATE, ARTICLE, NEGATION, REPORT = "oitycaer"
CLAUSE = re.compile(r"[.!?;:\n|]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STEMS = (4, 5, 6, 7, 8)
#: Marks the stem that is a whole word.
WHOLE = "$"

Transducer = dict[tuple[int, str], tuple[int, str]]


def negation(scope: int = 3) -> Transducer:
    """State: tokens of scope left. Insult i and threat t become j and u inside it."""
    arcs: Transducer = {}
    for s in range(scope + 1):
        left = max(0, s - 1)
        for x in (OTHER, TARGET, PREDICATE, ARTICLE, REPORT):
            arcs[s, x] = left, x
        arcs[s, NEGATION] = scope, OTHER
        arcs[s, INSULT] = left, "j" if s else INSULT
        arcs[s, THREAT] = left, "u" if s else THREAT
    return arcs


def reported() -> Transducer:
    """State 1 once a verb of saying has been read: i, t become k, v."""
    arcs: Transducer = {}
    for s in (0, 1):
        for x in (OTHER, TARGET, PREDICATE, ARTICLE, "j", "u"):
            arcs[s, x] = s, x
        arcs[s, REPORT] = 1, OTHER
        arcs[s, INSULT] = s, "k" if s else INSULT
        arcs[s, THREAT] = s, "v" if s else THREAT
    return arcs


#: What becomes of a lexeme that meets a target, a predicate, an article or another lexeme.
MET = {
    TARGET: {"i": "I", "t": "T", "j": "J", "u": "U", "k": "K", "v": "V"},
    PREDICATE: {"i": "A", "t": "B", "j": "D", "u": "F", "k": "E", "v": "G"},
    ARTICLE: {"i": "N", "t": "M", "j": "D", "u": "F", "k": "E", "v": "G"},
}
PAIRED = "P"
#: Weights of the outcomes where there are no labels to fit them to.
OUTCOMES = {"I": 1.5, "T": 1.5, "A": 1.0, "B": 0.8, "N": 0.7, "M": 0.0, "P": 1.2, "J": 0.3, "D": 0.2, "K": 0.5, "E": 0.3, "U": 0.0, "F": 0.0, "V": 0.3, "G": 0.2}


def aim(reach: int = 6) -> Transducer:
    """State: the strongest role that is near (target, predicate, article or none), the tokens for which it is near, the lexeme that is pending (or none) and
    the tokens for which it is. Emits an outcome where a lexeme and a second role meet."""
    start = ("", 0, "", 0)
    names, arcs, todo = {start: 0}, {}, [start]
    while todo:
        state = role, near, held, left = todo.pop()
        for x in (OTHER, *MET, *MET[TARGET]):
            now_near, now_left = max(0, near - 1), max(0, left - 1)
            now = (role if now_near else "", now_near, held if now_left else "", now_left)
            out = OTHER
            if x in MET:
                out = MET[x][held] if held else OTHER
                # A weaker role does not hide a stronger one that is still near.
                strongest = x if not now[0] else min(x, now[0], key=list(MET).index)
                now = (x, reach, "", 0) if strongest == x else (*now[:2], "", 0)
            elif x in MET[TARGET]:
                if role:
                    out, now = MET[role][x], (*now[:2], "", 0)
                elif held:
                    out, now = PAIRED, (*now[:2], x, reach)
                else:
                    now = (*now[:2], x, reach)
            if now not in names:
                names[now] = len(names)
                todo.append(now)
            arcs[names[state], x] = names[now], out
    return arcs


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the first one's outputs to the second."""
    states, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    inputs = sorted({x for _, x in first})
    while todo:
        a, b = pair = todo.pop()
        for x in inputs:
            if (a, x) in first:
                na, mid = first[a, x]
                if (b, mid) in second:
                    nb, out = second[b, mid]
                    if (na, nb) not in states:
                        states[na, nb] = len(states)
                        todo.append((na, nb))
                    arcs[states[pair], x] = states[na, nb], out
    return arcs


@dataclass(frozen=True)
class Grammar:
    """The composed machine and its lexicon: classes of words, strengths of stems."""

    stems: dict[str, float] = field(default_factory=dict)
    machine: Transducer = field(default_factory=lambda: compose(compose(negation(), reported()), aim()))

    def lexeme(self, word: str) -> tuple[str, float]:
        """Class and strength of a lower-case word."""
        fixed = FIXED.get(word)
        if fixed and fixed != INSULT:
            return fixed, 1.0
        strength = max(self.stems.get(word + WHOLE, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS))
        if fixed or strength:
            return INSULT, max(strength, 1.0 if fixed else 0.0)
        return OTHER, 0.0

    def clause(self, tokens: list[tuple[str, float]]) -> Counter:
        """The worth of a clause's outcomes. An outcome takes the strength of the last lexeme, which is the one that it is about."""
        state, strength, outcomes = 0, 0.0, Counter()
        for kind, own in tokens:
            if kind in (INSULT, THREAT):
                strength = own
            state, out = self.machine[state, kind]
            if out in OUTCOMES:
                outcomes[out] += strength
        return outcomes


FIXED = {w: k for k, words in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (PREDICATE, PREDICATES), (ARTICLE, ARTICLES), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
KINDS = sorted(OUTCOMES)


class Reader:
    """Reads texts with a grammar; the class of each distinct word is looked up once, in a table of bounded size."""

    def __init__(self, grammar: Grammar, limit: int = 300_000):
        self.grammar, self.limit, self.table = grammar, limit, {}

    def _known(self, word: str) -> tuple[str, float]:
        got = self.table.get(word)
        if got is None:
            if len(self.table) >= self.limit:
                self.table.clear()
            got = self.table[word] = self.grammar.lexeme(word)
        return got

    def features(self, text: bytes) -> list[float]:
        """For each kind of outcome its worth in the text; then the worth of the best clause, the matched clauses and their share; damped."""
        low = text.decode("utf-8", "replace").lower()
        total, best, matched, clauses = Counter(), 0.0, 0, 0
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            if not words:
                continue
            clauses += 1
            kinds = [self._known(w) for w in words]
            if any(k in (INSULT, THREAT) for k, _ in kinds):
                found = self.grammar.clause(kinds)
                total.update(found)
                best = max(best, sum(n * OUTCOMES[k] for k, n in found.items()))
                matched += bool(found)
        return [*(math.log1p(total[k]) for k in KINDS), math.log1p(best), math.log1p(matched), matched / max(1, clauses)]


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def learn_stems(sample: DataFrame, *, min_texts: int = 6, min_share: float = 0.006, min_odds: float = 3.0, max_stems: int = 5_000) -> dict[str, float]:
    """Stems that mark toxic texts, with their strengths. Counted in the tasks and summed by a hash aggregate."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        sizes = [0, 0]
        for text, y in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(text.decode("utf-8", "replace").lower()))
            for stem in {w[:n] for w in words if len(w) >= STEMS[0] for n in STEMS} | {w + WHOLE for w in words}:
                counts.setdefault(stem, [0, 0])[y] += 1
            sizes[y] += 1
        counts[""] = sizes
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["stem", "clean", "toxic"])

    counted = map_batches(sample.select("t", "y"), run, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted.where(f"toxic >= {min_texts} or stem = ''"), "stems")
    sizes = counted.where("stem = ''").first()
    if sizes is None or not sizes["clean"] or not sizes["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (sizes["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes["clean"] + 1.0))
    strong = counted.where("stem <> ''").where(F.col("toxic") >= min_share * sizes["toxic"]).withColumn("odds", odds).where(F.col("odds") >= min_odds).orderBy(F.desc("odds"), "stem").limit(max_stems)
    return {r["stem"]: r["odds"] / min_odds for r in strong.collect()}


def fit_from(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the lexicon and the weights from a bounded sample of labelled texts."""
    sample = materialize(labelled_sample(docs, labels, label, per_class=per_class, id_col=id_col, text_col=text_col).select("t", "y"), "sample")
    grammar = Grammar(learn_stems(sample))
    rows = map_batches(sample, _featurer(grammar, lambda b: [b.column(1)], ["y"]), "x array<double>, y int").collect()
    share = labels.where(~held_out("doc_id")).agg(F.avg((F.col(label) == 1).cast("double")).alias("toxic")).first()["toxic"]
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(grammar, np.array([*(OUTCOMES[k] for k in KINDS), 1.0, 0.5, 0.0, -2.0]))
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((*x.T, y))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(grammar, logistic_fit(x[order], y[order], weight[order], ridge=1.0))


def _featurer(grammar: Grammar, others: Callable[[pa.RecordBatch], list], names: list[str]):
    held: list[Reader] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Reader(grammar))
        return pa.RecordBatch.from_arrays([pa.array([held[0].features(t) for t in bytes_of(batch.column(0))], pa.list_(pa.float64())), *others(batch)], names=["x", *names])

    return run


def toxicity_scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, matched`` for every row; ``matched``: whether any clause was."""
    held: list[Reader] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Reader(model.grammar))
        x = np.array([held[0].features(t) for t in bytes_of(batch.column(2))])
        s = model.score(x)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, -2] > 0)], names=["doc_id", "held_out", "score", "predicted", "matched"])

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {id_type(docs, id_col)}, held_out boolean, score double, predicted int, matched boolean")
