"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from panelwright.llm.chat_format import rotate_perspectives
from panelwright.llm.embedding_dedup import embedding_dedup
from panelwright.llm.line_dedup import line_dedup
from panelwright.llm.media import document_media
from panelwright.llm.minhash_dedup import minhash_dedup
from panelwright.llm.mixing import mix_sources
from panelwright.llm.pieces import encode_pieces
from panelwright.llm.substring_dedup import substring_dedup
from panelwright.llm.token_file import token_file
from panelwright.llm.toxicity import FEATURES, Grammar, fit_grammar, toxicity_scores

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(50))
#: (doc_id, text, source): a null id, null and empty texts, a blank one, a long one, a repeated row, copies.
ROWS = [(1, PASSAGE, "a"), (1, PASSAGE, "a"), (2, PASSAGE, None), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (6, LONG, "a"), (None, PASSAGE, "b"), (None, None, None), (None, "some other words here", None)]
CLASHING = ("key", "k", "h", "pos", "line", "gone", "digest", "rep", "class", "bands", "bin", "size", "rate", "copies", "spans", "score", "html", "id", "a", "b")
SHA_EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


OPERATORS = {
    "media": document_media,
    "substring": substring_dedup,
    "pieces": lambda d: encode_pieces(d, P.path("piece_bpe_32k.model")),
    "tokens": lambda d: token_file(d, P.path("word_bpe_49k.json")),
    "minhash": minhash_dedup,
    "lines": line_dedup,
    "mixing": mix_sources,
    "toxicity": lambda d: toxicity_scores(d, Grammar(coefficients=[-1.0] + [0.0] * len(FEATURES))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, name):
    got = Counter(r.doc_id for r in OPERATORS[name](docs).collect())
    assert got == Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_minhash_decisions(docs):
    got = {(r.doc_id, r.class_id, r.kept) for r in minhash_dedup(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True)}


def test_minhash_of_a_key_with_several_texts(spark):
    """(1, A), (1, B), (2, near B), (3, near A): each row goes with its own text, whatever the order; nulls and reruns too."""
    words = lambda p: [f"{p}{i}" for i in range(120)]
    a, b = " ".join(words("a")), " ".join(words("b"))
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (None, a), (None, near(b)), (4, None), (5, ""), (1, a)]
    want = sorted([(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (-1, -1, True), (-1, -1, True), (4, 4, True), (5, 5, True)])
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        for _ in range(2):
            assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.kept) for r in minhash_dedup(df).collect()) == want


def test_minhash_of_one_key_for_most_rows(spark):
    """Most rows have the same key and different texts; copies of one of them lie under other keys."""
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(60))
    rows = [(7, text(i)) for i in range(200)] + [(100 + i, text(i) + " end") for i in range(20)]
    got = {(r.doc_id, r.class_id, r.kept) for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 7, True)} | {(100 + i, 7, False) for i in range(20)}


def test_substring_decisions(docs):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {(1, 50, 50), (2, 50, 50), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 60_000, 0), (None, 50, 50), (None, 0, 0), (None, 4, 0)}


def test_rows_of_one_key_with_different_texts(spark):
    """Each row is judged by its own text: spans and line positions of one text never touch the other."""
    long, short = PASSAGE + " " + " ".join(f"t{i}" for i in range(40)), "only these few words"
    rows = [(1, long), (1, short), (2, "q " + PASSAGE), (None, "r " + PASSAGE), (None, short)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 90, 50), (1, 4, 0), (2, 51, 50), (None, 51, 50), (None, 4, 0)}
    shared = "a line that is shared"
    rows = [(2, f"x\ny\n{shared}"), (2, "one line here"), (1, shared), (None, shared)]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 3, 1, "x\ny"), (2, 1, 0, "one line here"), (1, 1, 0, shared), (None, 1, 0, shared)}


def test_line_decisions(docs):
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 1, 0), (5, 2, 0), (6, 1, 0), (None, 1, 0)}


def test_mixing_reruns_and_carries(docs):
    rows = lambda: sorted(map(str, mix_sources(docs, carry=("text", "size")).select("doc_id", "carried_text", "copies", "carried_size", "taken").collect()))
    assert rows() == rows() and len(rows()) == len(ROWS)
    assert {r.copies for r in mix_sources(docs).where("size = 0").collect()} == {0}


def test_rows_without_keys_are_dealt_out(spark):
    """With nine rows of ten keyless, mixing draws for each text by itself, and the token file has several files of them."""
    rows = [(None if i % 10 else i, f"words number {i} of a text", "s") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(df, weights=(1.0,), share=0.5).collect()
    keyless = [r.copies for r in mixed if r.doc_id is None]
    assert 0 < sum(keyless) < len(keyless) and abs(sum(r.taken for r in mixed) - mixed[0].target) <= 6
    got = token_file(df, P.path("word_bpe_49k.json")).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == 600 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[:540] == [None] * 540 and ids[540:] == sorted(ids[540:])


def test_media_of_nothing(docs):
    got = [r for r in document_media(docs).collect() if r.doc_id in (3, 4)]
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(0, 576)] * 2 and len({r.payload_sha256 for r in got}) == 1


def test_pieces_of_nothing(docs):
    got = {(r.n_tokens, r.decoded_sha256, r.round_trip) for r in encode_pieces(docs, P.path("piece_bpe_32k.model")).where("doc_id in (3, 4)").collect()}
    assert got == {(0, SHA_EMPTY, True)}


def test_labels_without_a_class(spark, docs):
    for labels in ([], [(1, 1)], [(None, None), (2, 0)]):
        g = fit_grammar(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.score < 0.7 and r.predicted == 0 for r in toxicity_scores(docs, g).collect())


def test_chat_nulls(spark):
    rows = [(None, 1, "ann", "x"), (1, None, None, None), (1, None, None, None), (2, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "block", "times", "me", "name")})
    got = rotate_perspectives(df).collect()
    assert [(r.conv_id, r.perspective) for r in got] == [(1, "unknown")] * 2 and sorted(r.position for r in got) == [0, 1]
    assert rotate_perspectives(df.limit(0)).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, None]), (4, []), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "digest", "rep", "node", "key")})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup(df).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert embedding_dedup(df.limit(0)).collect() == []
