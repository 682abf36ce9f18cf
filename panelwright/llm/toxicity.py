"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses. A lexicon gives each word an input symbol: insult or threat (both with a learned
weight), target, negation, reported speech, or other. Five transducers follow each other: reported speech marks what is
quoted, negation marks what stands within its reach, targets mark what is aimed at somebody (in front or behind),
insults and threats turn the marks into outputs with weights. Their composition, minimised, is the one machine that
reads clauses; a clause counts by what the machine puts out, not by its words alone.

The lexicon is learned from labelled rows: words, word beginnings and word pairs by their log odds, and as
threats the words whose odds are high only in clauses with a target. A logistic model over the clause outputs turns
them into a score.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal, give_back
from panelwright.llm.transducer import Transducer, rewriting

#: The closed word classes of the grammar, in the corpus's four languages.
NEGATIONS = frozenset("not never no nor without isn't aren't wasn't don't doesn't ne pas jamais sans nicht kein keine nie ohne nunca jamás sin".split())
REPORTS = frozenset("said says say told reported quoted quote called wrote dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split())
TARGETS = frozenset("you your yours yourself they them he she him her tu toi vous ton ta du dich dir ihr euch sie usted ustedes ellos ellas".split())
NEGATION_REACH = 4
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
BEGINNINGS = (4, 5, 6)
OUTPUTS = ("plain", "targeted", "negated", "reported", "threats")
FEATURES = (*OUTPUTS, "best_clause", "clauses")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = ".", "insult", "threat", "target", "negation", "report"
INPUT = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
_HARMS = (INSULT, THREAT)
_NOTHING = (OTHER, 0.0)
_QUOTED, _NEGATED, _AIMED, _LATE = "quoted", "negated", "aimed", "aimed late"


def reported_speech() -> Transducer:
    """Behind a word of reporting, insults and threats are quoted to the clause's end."""
    rules = {(0, REPORT): (OTHER, 0.0, 1), (1, REPORT): (OTHER, 0.0, 1)} | {(1, x): (f"{_QUOTED} {x}", 0.0, 1) for x in _HARMS}
    return rewriting(INPUT, (0, 1), rules)


def negation() -> Transducer:
    """Insults and threats among the next ``NEGATION_REACH`` words are negated; quoted ones stay quoted."""
    symbols = (OTHER, INSULT, THREAT, TARGET, NEGATION, *(f"{_QUOTED} {x}" for x in _HARMS))
    states = range(NEGATION_REACH + 1)
    rules = {(s, NEGATION): (OTHER, 0.0, NEGATION_REACH) for s in states} | {(s, x): (f"{_NEGATED} {x}", 0.0, s - 1) for s in states if s for x in _HARMS}
    return rewriting(symbols, states, rules, {s: max(0, s - 1) for s in states})


def targets() -> Transducer:
    """Insults and threats behind a target are aimed; a target behind them aims them late. States: nothing, target seen, harm seen."""
    marked = [f"{m} {x}" for m in (_QUOTED, _NEGATED) for x in _HARMS]
    rules = {(0, TARGET): (OTHER, 0.0, 1), (1, TARGET): (OTHER, 0.0, 1), (2, TARGET): (_LATE, 0.0, 1)}
    rules |= {(0, x): (x, 0.0, 2) for x in _HARMS} | {(1, x): (f"{_AIMED} {x}", 0.0, 1) for x in _HARMS}
    return rewriting((OTHER, INSULT, THREAT, TARGET, *marked), (0, 1, 2), rules)


def insults() -> Transducer:
    """What insults put out, by their marks; the weight is the share of the word's own weight that counts."""
    rules = {(0, INSULT): ("plain", 1.0, 0), (0, f"{_AIMED} {INSULT}"): ("targeted", 1.0, 0), (0, f"{_NEGATED} {INSULT}"): ("negated", 1.0, 0), (0, f"{_QUOTED} {INSULT}"): ("reported", 1.0, 0), (0, _LATE): ("targeted", 1.0, 0)}
    kept = [OTHER, _LATE, *(f"{m}{x}".strip() for x in _HARMS for m in ("", f"{_QUOTED} ", f"{_NEGATED} ", f"{_AIMED} "))]
    return rewriting(kept, (0,), rules)


def threats() -> Transducer:
    """A threat counts in full where it is aimed, not at all where it is negated or quoted, and else a quarter."""
    rules = {(0, THREAT): ("threats", 0.25, 0), (0, f"{_AIMED} {THREAT}"): ("threats", 1.0, 0), (0, f"{_NEGATED} {THREAT}"): (OTHER, 0.0, 0), (0, f"{_QUOTED} {THREAT}"): (OTHER, 0.0, 0)}
    return rewriting((OTHER, "plain", "targeted", "negated", "reported", *(f"{m}{THREAT}" for m in ("", f"{_QUOTED} ", f"{_NEGATED} ", f"{_AIMED} "))), (0,), rules)


@cache
def grammar_machine() -> Transducer:
    """The five transducers as one."""
    machine = reported_speech()
    for after in (negation(), targets(), insults(), threats()):
        machine = machine.compose(after).minimal()
    return machine


@dataclass
class Grammar:
    """The learned lexicon (words, ``ab..*`` beginnings, pairs of words, threats) and the logistic model over clause outputs."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * (len(FEATURES) + 1))

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's input symbol and weight."""
        weight = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) > n:
                weight = max(weight, self.beginnings.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        if word in self.threats:
            return THREAT, self.threats[word]
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return symbol, 0.0
        return _NOTHING

    def probability(self, x: np.ndarray) -> np.ndarray:
        c = np.array(self.coefficients)
        return 1.0 / (1.0 + np.exp(-np.clip(c[0] + x @ c[1:], -60, 60)))


class Reader:
    """Clause features of texts, with a bounded memory of word symbols."""

    limit = 250_000

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.known: dict[str, tuple[str, float]] = {}
        self.harms: set[str] = set()  # the known insults and threats
        self.seconds: dict[str, set[str]] = {}
        for first, second in (p.split(" ") for p in grammar.pairs):
            self.seconds.setdefault(first, set()).add(second)
        self.machine: dict[int, dict[str, tuple[str, float, int]]] = {}
        for (state, x), arc in grammar_machine().arcs.items():
            self.machine.setdefault(state, {})[x] = arc

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            got = self.known[word] = self.grammar.symbol(word)
            if got[0] in _HARMS:
                self.harms.add(word)
        return got

    def read_clause(self, words: list[str]) -> dict[str, float]:
        """The weights that the machine puts out on a clause, by output symbol. A late target passes on the last harm's weight."""
        sums = dict.fromkeys(OUTPUTS, 0.0)
        state, last, before, machine, pairs = 0, 0.0, "", self.machine, self.grammar.pairs
        for word in words:
            x, weight = self.symbol(word)
            if pairs and x == OTHER and (pair := pairs.get(f"{before} {word}")):
                x, weight = INSULT, pair
            out, share, state = machine[state][x]
            if x in _HARMS:
                last = weight
            if share:
                sums[out] += share * (weight if x in _HARMS else last)
            before = word
        return sums

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        sums, best, matched = [0.0] * len(OUTPUTS), 0.0, 0
        symbol = self.symbol
        if len(self.known) > self.limit:
            self.known.clear()
            self.harms.clear()
        distinct = set(WORD.findall(text))
        for w in distinct.difference(self.known):
            symbol(w)
        hits = distinct & self.harms
        hits.update(b for w in distinct & self.seconds.keys() for b in self.seconds[w] & distinct)
        if hits:
            for clause in CLAUSE.split(text):
                words = WORD.findall(clause)
                if hits.isdisjoint(words):
                    continue
                out = self.read_clause(words)
                total = sum(out.values())
                if total or any(symbol(w)[0] in _HARMS for w in words):
                    matched += 1
                    best = max(best, total)
                    sums = [a + out[o] for a, o in zip(sums, OUTPUTS, strict=True)]
        return [*(math.log1p(x) for x in sums), math.log1p(best), math.log1p(matched)]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}]+(?:['’][\p{L}]+)?)"), F.lit(1))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps of a ridge logistic regression; the sample is bounded, so it fits the driver."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    c = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -60, 60)))
        grad = a.T @ (p - y) + penalty * c
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return c.tolist()


def fit_grammar(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, log_odds: float = 2.0) -> Grammar:
    """Learns a grammar from at most ``max_rows`` labelled documents, the first by a hash of the key.

    Of rows that repeat a key one is read, and of its labels the greatest. Patterns (words, beginnings, pairs of neighbouring
    words of which neither is a pattern, and threats) enter with the lower bound of their smoothed log odds where that is ``log_odds``
    or more and a minimum of toxic documents holds them; a beginning also needs three different words, a threat is a word that
    doesn't enter by itself but does when only clauses with a target are counted. Their number is bounded by the sample.
    Null keys and labels are left out. Without toxic or without clean rows, and with empty tables, everything scores 0.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    sample = one.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "key")
    rows = rows.groupBy("key").agg(F.max("y").alias("y"), F.min("text").alias("text")).persist()
    try:
        total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = total.get(1, 0), total.get(0, 0)
        if not n1 or not n0:
            return Grammar(coefficients=[-10.0] + [0.0] * len(FEATURES))
        least = max(3, n1 // 200)
        low = rows.select("key", "y", F.lower("text").alias("text"))
        tokens = low.select("key", "y", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
        c1, c0 = F.sum("y"), F.sum(1 - F.col("y"))
        odds = F.ln((c1 + 0.5) / (n1 + 1)) - F.ln((c0 + 0.5) / (n0 + 1))
        error = F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        bound, surer = odds - error, odds - 2 * error  # pairs and aimed words are so many more that some stand out by chance

        def heavy(df: DataFrame, by: str) -> dict[str, float]:
            return {r[by]: r["weight"] for r in df.where((F.col("c1") >= least) & (F.col("weight") >= log_odds)).select(by, "weight").collect()}

        words = heavy(tokens.groupBy("word").agg(c1.alias("c1"), bound.alias("weight")), "word")
        starts = tokens.select("key", "y", "word", F.explode(F.array(*[F.lit(n) for n in BEGINNINGS])).alias("n")).where("length(word) > n").select("key", "y", F.expr("substring(word, 1, n)").alias("start"), "word")
        forms = starts.groupBy("start", "word").agg(F.max("y").alias("y")).groupBy("start").agg(F.sum("y").alias("forms"))
        by_start = starts.select("key", "y", "start").distinct().groupBy("start").agg(c1.alias("c1"), bound.alias("weight"))
        beginnings = heavy(by_start.join(forms, "start").where("forms >= 3"), "start")
        grammar = Grammar(words, beginnings)
        clauses = F.transform(F.split("text", CLAUSE.pattern), _words)
        some = F.array(*[F.lit(t) for t in sorted(TARGETS)])
        aimed = low.select("y", F.explode(F.array_distinct(F.flatten(F.filter(clauses, lambda w: F.arrays_overlap(w, some))))).alias("word"))
        found = heavy(aimed.groupBy("word").agg(c1.alias("c1"), surer.alias("weight")), "word")
        grammar.threats = {w: v for w, v in found.items() if grammar.symbol(w)[0] == OTHER}
        rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
        neighbours = lambda w: F.zip_with(F.slice(w, F.lit(1), rest(w)), F.slice(w, F.lit(2), rest(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        pairs = low.select("y", F.explode(F.array_distinct(F.flatten(F.transform(clauses, neighbours)))).alias("pair"))
        found = heavy(pairs.groupBy("pair").agg(c1.alias("c1"), surer.alias("weight")), "pair")
        grammar.pairs = {p: v for p, v in found.items() if all(grammar.symbol(w)[0] == OTHER for w in p.split(" "))}
        got = rows.select("y", "text").mapInArrow(frugal(_feature_rows(grammar)), "y int, x array<double>").toPandas()
        grammar.coefficients = _fit_logistic(np.array(got["x"].tolist()), got["y"].to_numpy(float))
        return grammar
    finally:
        rows.unpersist()


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grammar)
        for batch in batches:
            x = [reader.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    return run


def toxicity_column(grammar: Grammar, text: Column) -> Column:
    """struct(score, matched) of each whole text: its probability and the number of clauses with a match."""

    @F.pandas_udf("struct<score:double,matched:long>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(grammar)
        for texts in parts:
            x = np.array([reader.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"score": grammar.probability(x), "matched": np.rint(np.expm1(x[:, -1])).astype(np.int64)})
        give_back()

    return score(text.cast("string"))


def toxicity_scores(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted, matched): the score of every whole text and whether it reaches ``threshold``.

    One row per row of ``docs``, repeated rows and rows without a key included; null and empty texts have no clause and get the
    score of a text without matches, an empty table gives an empty one. Texts are read clause by clause, however long.
    ``matched`` counts the clauses with a match. Other columns, whatever their names, are not read.
    """
    got = docs.select(F.col(key).alias("key"), toxicity_column(grammar, F.col(text)).alias("t"))
    return got.select(F.col("key").alias(key), "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.matched")


def held_out(key: Column) -> Column:
    """Rows never learned from: the crc32 of the key as text leaves 1 when divided by 3. A null key isn't held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
