"""Each stage of the pipeline against a brute-force version on its own input, and the whole on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from panelwright.llm.toxicity import fit_grammar, held_out, toxicity_scores

DATA = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_columns(chain):
    assert all(df.columns == list(C.COLUMNS) for name, (_, df) in chain.items() if name != "sentencepiece")


def test_toxicity_stage(spark, chain):
    before, after = chain["toxicity"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity_scores(before, fit_grammar(before, labels.where(~held_out(F.col("doc_id"))))).collect()}
    rows = {r.doc_id: r for r in before.collect()}
    assert {r.doc_id: r for r in after.collect()} == {i: r for i, r in rows.items() if scores[i] < 0.7}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} & set(rows)
    assert sum(scores[i] < 0.7 for i in clean) >= 0.98 * len(clean)


def test_line_stage(chain):
    before, after = chain["line_dedup"]
    docs = {r.doc_id: (r.text or "").split("\n") for r in before.collect()}
    holders = defaultdict(set)
    for i, lines in docs.items():
        for x in lines:
            holders[x.strip(BLANK).translate(LOWER)].add(i)
    gone = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    want = {i: "\n".join(x for x in lines if gone.get(x.strip(BLANK).translate(LOWER), i) == i) for i, lines in docs.items()}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert {(r.doc_id, r.lang, r.source) for r in got} == {(r.doc_id, r.lang, r.source) for r in before.collect()}


def test_near_duplicate_stage(chain):
    before, after = chain["minhash_dedup"]
    rows = {r.doc_id: r for r in before.collect()}
    bags = {}
    for i, r in rows.items():
        w = words(r.text)
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    ids, at = sorted(rows), {i: i for i in rows}
    for x, a in enumerate(ids):
        for b in ids[:x]:
            low = sum((bags[a] & bags[b]).values())
            if low and low >= 0.8 * sum((bags[a] | bags[b]).values()):
                p, q = sorted((at[a], at[b]))
                at = {i: p if c == q else c for i, c in at.items()}
    assert {r.doc_id: r for r in after.collect()} == {i: r for i, r in rows.items() if at[i] == i}


def test_mixing_stage(chain):
    before, after = chain["mixing"]
    rows = {r.doc_id: r for r in before.collect()}
    size = {i: len(words(r.text)) for i, r in rows.items()}
    per = defaultdict(int)
    for i, r in rows.items():
        per[r.source] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(per.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * per[s]}
        for s in over or open_:
            target[s] = 2.0 * per[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    got = after.collect()
    times, taken = Counter(r.doc_id for r in got), defaultdict(int)
    assert all(rows[r.doc_id] == r for r in got) and max(times.values()) <= 2
    for i, n in times.items():
        taken[rows[i].source] += n * size[i]
    for s in order:
        assert math.isclose(taken[s], target[s], abs_tol=max(size[i] for i in rows if rows[i].source == s))


def test_encoding_stage(chain):
    before, after = chain["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in before.collect())
    got = after.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_run_is_the_chain(spark, chain):
    key = lambda df: Counter((r.doc_id, r.ids_crc32) for r in df.collect())
    assert key(C.run(spark, DATA)) == key(chain["sentencepiece"][1])


ODD = [(1, "a b c d e f g", "en", "web", 13), (1, "a b c d e f g", "en", "web", 13), (2, "a b c d e f g", None, None, None), (3, None, None, None, None), (4, "", "en", "web", 0), (None, "a b c d e f g", "en", "web", 13), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name, ids", [("toxicity", [1, 1, 2, 3, 4, None, None]), ("line_dedup", [1, 1, 2, 3, 4, None, None]), ("minhash_dedup", [1, 3, 4, None, None])])
def test_odd_rows(spark, name, ids):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "copies", "toxicity", "kept", "class_id", "copy", "kept_text")})
    got = dict(C.STAGES)[name](spark, docs, DATA)
    assert Counter(r.doc_id for r in got.collect()) == Counter(ids) and got.columns == list(C.COLUMNS)


def test_odd_rows_of_the_mix(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "copies", "copy", "size", "rate", "taken")})
    got = C.mixing(spark, docs, DATA)
    rows = got.collect()
    assert got.columns == list(C.COLUMNS) and all(len(words(r.text)) for r in rows)
    times = Counter(rows)
    assert max(times.values()) <= 4 and all(n <= 2 for r, n in times.items() if r.doc_id != 1)
    assert any(r.doc_id is None for r in rows)


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_empty(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), DATA).collect() == []
