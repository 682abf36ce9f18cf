"""The grammar's transducers against their cascade and against clauses read by hand, and the held-out accuracy."""

import itertools

import pytest
from pyspark.sql import functions as F

from panelwright.llm import toxicity as T
from panelwright.llm.transducer import Transducer

CASCADE = (T.reported_speech(), T.negation(), T.targets(), T.insults(), T.threats())


def one_after_the_other(symbols):
    """Every transducer over the whole output of the one before it; weights of a place add up."""
    total = [0.0] * len(symbols)
    for machine in CASCADE:
        out = list(machine.run(symbols))
        symbols, total = [x for x, _ in out], [a + w for a, (_, w) in zip(total, out, strict=True)]
    return list(zip(symbols, total, strict=True))


def test_composition_is_the_cascade():
    """All clauses of up to five symbols."""
    machine = T.grammar_machine()
    for n in range(6):
        for clause in itertools.product(T.INPUT, repeat=n):
            assert list(machine.run(clause)) == one_after_the_other(list(clause))


def test_minimal_is_smaller_and_the_same():
    large = CASCADE[0].compose(CASCADE[1]).compose(CASCADE[2])
    small = large.minimal()
    assert len(small.states) < len(large.states) and len(small.minimal().states) == len(small.states)
    for clause in itertools.product(T.INPUT, repeat=5):
        assert list(small.run(clause)) == list(large.run(clause))
    twins = Transducer({(0, "a"): ("x", 1.0, 1), (1, "a"): ("x", 1.0, 2), (2, "a"): ("x", 1.0, 0)})
    assert len(twins.minimal().states) == 1


GRAMMAR = T.Grammar(words={"idiot": 3.0}, beginnings={"mora": 2.0}, pairs={"big nothing": 4.0}, threats={"smash": 2.0})


@pytest.mark.parametrize(
    "clause, out",
    [
        ("such an idiot", {"plain": 3}),
        ("you are such an idiot", {"targeted": 3}),
        ("what an idiot you are", {"plain": 3, "targeted": 3}),
        ("you are not an idiot", {"negated": 3}),
        ("you are not only by far the greatest idiot", {"targeted": 3}),
        ("he called you an idiot", {"reported": 3}),
        ("moralising", {"plain": 2}),
        ("you big nothing", {"targeted": 4}),
        ("nothing", {}),
        ("they will smash him", {"threats": 2}),
        ("smash it", {"threats": 0.5}),
        ("never smash it", {}),
        ("", {}),
    ],
)
def test_clauses(clause, out):
    got = T.Reader(GRAMMAR).read_clause(clause.split())
    assert {k: v for k, v in got.items() if v} == out


def test_long_text_and_clause_bounds():
    reader = T.Reader(GRAMMAR)
    assert reader.features("x " * 200_000) == [0.0] * len(T.FEATURES)
    a, b = reader.features("you. idiot"), reader.features("you idiot")
    assert a[0] > 0 == b[0] and b[1] > 0 == a[1]


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, "fine words here" if i % 2 else "you idiot there", i % 2 == 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows for _ in range(3)], "doc_id long, text string").withColumn("key", F.lit("x"))
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    once = T.fit_grammar(docs.dropDuplicates(["doc_id"]), labels)
    again = T.fit_grammar(docs, labels.union(labels))
    assert again.words == once.words and "idiot" in once.words and again.coefficients == pytest.approx(once.coefficients)
    got = {r.doc_id: r.predicted for r in T.toxicity_scores(docs, again).collect()}
    assert got == {i: int(y) for i, _, y in rows}


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_held_out_accuracy(spark, sf, recall):
    """Over all held-out rows, found toxic ones and flagged clean ones; some labels are noise (3 of 18 on sf0.01: no insult in the text)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    grammar = T.fit_grammar(docs, labels.where(~T.held_out(F.col("doc_id"))))
    rows = T.toxicity_scores(docs, grammar).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).select("toxic", "predicted").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == v] for v in (1, 0))
    assert toxic and sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.02 * len(clean)
