import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelwright.llm.chat_format import rotate_perspectives
from panelwright.llm.embedding_dedup import embedding_dedup, similar_pairs
from panelwright.llm.line_dedup import line_dedup
from panelwright.llm.media import document_media, parse_parts
from panelwright.llm.minhash_dedup import bag_signatures, minhash_dedup, shingle_counts
from panelwright.llm.mixing import mix_sources
from panelwright.llm.pieces import MarkedWords, decode_pieces, encode_pieces
from panelwright.llm.substring_dedup import substring_dedup
from panelwright.llm.token_file import decode_words, encode_words, token_file

SCHEMA = "doc_id long, text string, source string"
P1 = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, P1 + " one", "a"), (2, "x " + P1, "a"), (3, None, None), (4, "", "b"), (5, "Same line here\n  same LINE here \nother", "b"), (6, "same line here", "b"), (7, P1 + " one", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_substring(docs):
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert [got[i].n_removed for i in range(1, 8)] == [61, 60, 0, 0, 0, 0, 61]
    assert got[2].kept_text == "x" and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_lines(docs):
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert (got[5].n_dropped, got[6].n_dropped, got[6].kept_text, got[3].n_lines) == (0, 1, "", 1)


def test_minhash(docs):
    got = {r.doc_id: r.class_id for r in minhash_dedup(docs).collect()}
    assert got[1] == got[2] == got[7] == 1 and got[3] == 3 and got[4] == 4


def test_bag_similarity():
    a, b = {i: 1 + i % 3 for i in range(200)}, {i: 1 + i % 4 for i in range(20, 220)}
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    x, y = (bag_signatures(np.zeros(len(d), int), np.array(list(d), np.uint64), np.array(list(d.values())), 1, 4096)[0] for d in (a, b))
    assert abs((x == y).mean() - true) < 0.03


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_mixing(spark, docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mix_sources(docs.limit(0)).count() == 0


def test_words_round_trip():
    for x in ([], [0] * 500, [2**64 - 1, 5, 2**60 - 1], list(range(5000))):
        assert decode_words(encode_words(np.array(x, np.uint64)))[: len(x)].tolist() == x


def test_token_file(docs):
    got = token_file(docs, P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(1, 8)) and got[3].n_tokens == 1


def test_pieces_equal_library():
    sp, memo = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), MarkedWords(P.path("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = ["", " a", "a  b\n\n c", "漢字 é́"] + ["".join(r.choice("ab aabcéz=-\n the") for _ in range(r.randrange(50))) for _ in range(300)]
    ids, n = memo.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(texts)


def test_media(docs):
    got = {r.doc_id: r for r in document_media(docs).collect()}
    assert got[3].payload_bytes == 576 and got[1].payload_sha256 == got[7].payload_sha256
    parts = parse_parts('<p>a<figure><img src="sha256:FF" alt="x"><figcaption>cap</figcaption></figure>b')
    assert [(p["kind"], p["caption"]) for p in parts] == [("text", None), ("media", "cap"), ("text", None)]


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None)]
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 8 and {r.perspective for r in got} == {"ann", "bob"}
    assert all(r.mask_end > r.mask_start for r in got if r.role == "assistant")


def test_minhash_outside_of_leaders(spark):
    """A large group of near copies with texts around the threshold: classes as from all pairs."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(260):
        words, edits = list(base), r.choice((0, 1, 2, 2, 3, 4, 5))
        for at in r.sample(range(120), edits):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    bags = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    at = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                p, q = sorted((at[a], at[b]))
                at = [p if x == q else x for x in at]
    got = {x.doc_id: x.class_id for x in minhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == at


def test_minhash_block_links():
    """The exact step alone: every pair of different classes within a block, and across two blocks."""
    import pyarrow as pa

    from panelwright.llm.minhash_dedup import _bucket_links

    texts = {1: P1, 2: P1 + " tail", 3: "q " + P1, 4: " ".join(f"z{i}" for i in range(60)), 5: P1 + " tail more"}

    def links(own, j):
        n = len(texts)
        names = ["band", "at", "i", "j", "key", "c", "own", "text"]
        batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array([0] * n), pa.array([0] * n), pa.array([j] * n), pa.array(list(texts)), pa.array([1, 2, 2, 4, 5]), pa.array(own), pa.array(list(texts.values()))], names=names)
        return [(a, b) for out in _bucket_links(0.8)(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]

    assert len(links([True] * 5, 0)) == 2
    assert {x for p in links([True, False, False, False, True], 1) for x in p} >= {1, 5}


def test_embedding_copies(spark):
    """Copies of a vector, scaled copies, and a neighbour: each counts all the others, by brute force."""
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 8))
    rows = [x for x in base for _ in range(int(r.integers(1, 5)))] + [base[0] * 2.0, base[1] + 0.05, base[1] + 0.1]
    r.shuffle(rows)
    v = np.array(rows)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9 - 1e-12
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    reach = near.copy()
    for _ in range(6):
        reach = reach @ reach
    assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(len(v))}


def test_signature_bits_do_not_depend_on_company():
    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n)).encode()
    own = [text(24), text(44), text(400), (text(12) + b" ") * 30]
    alone = [bag_signatures(*shingle_counts([t]), 1)[0] for t in own]
    for fill in (600, 5_000, 19_000, 90_000):  # words beside them: a batch tail up to a full piece
        texts = [*own, *[text(200) for _ in range(fill // 200)]]
        together = bag_signatures(*shingle_counts(texts), len(texts))
        assert all((a.view(np.uint64) == b.view(np.uint64)).all() for a, b in zip(alone, together, strict=False))


def test_minhash_first_shared_band_is_of_full_keys():
    """Sketches that agree by chance in an earlier band, whose keys differ, don't take a pair out of its real bucket."""
    import pyarrow as pa

    from panelwright.llm.minhash_dedup import BANDS, REGISTERS, _bucket_members

    def members(at):
        sketches = [bytes(REGISTERS)] * 2
        bands = [list(range(BANDS)), [99, *range(1, BANDS)]]
        marks = pa.StructArray.from_arrays([pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["bands", "sketch"])
        columns = {"band": pa.array([7, 7]), "at": pa.array([at, at]), "i": pa.array([0, 0]), "j": pa.array([0, 0]), "key": pa.array([1, 2]), "c": pa.array([1, 2]), "own": pa.array([True, True]), "sketch": pa.array(sketches, pa.binary()), "marks": marks}
        return [k for out in _bucket_members(0.8)(iter([pa.RecordBatch.from_pydict(columns)])) for k in out.column("key").to_pylist()]

    assert members(1) == [1, 2] and members(2) == []


def test_embedding_cluster_of_a_third(spark):
    """One cluster with a third of the rows, of cosines around 0.86, in many blocks: counted links against all pairs."""
    r = np.random.default_rng(11)
    n, dim = 9_000, 64
    x = r.standard_normal((n, dim))
    centre = r.standard_normal(dim)
    x[: n // 3] = centre / np.linalg.norm(centre) + x[: n // 3] * (0.16 / dim) ** 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x[: n // 3] @ x[: n // 3].T
    assert 0.85 < cos.mean() < 0.87
    want = np.zeros(n, int)
    want[: n // 3] = (cos >= 0.9).sum(axis=1) - 1
    ids = r.permutation(n)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    back = np.argsort(ids)
    got = np.zeros(n, int)
    for row in embedding_dedup(rows).select("vec_id", "n_links").collect():
        got[back[row.vec_id]] = row.n_links
    missed = 1 - got.sum() / want.sum()
    print(f"{want.sum() // 2} links, recall {1 - missed:.4f}")
    assert missed <= 0.01 and (got <= want).all()


def test_similar_pairs(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.standard_normal((700, 24)), 4, axis=0) + 0.12 * r.standard_normal((2_800, 24))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()}
    got = [tuple(p) for p in similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)


def test_media_columns_against_brute_force(spark):
    """Every column that the contract names, from the texts alone."""
    import zlib

    rows = {r.doc_id: (r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows |= {10**9: (None, None), 10**9 + 1: ("", "a & <b>"), 10**9 + 2: ("<p>x</p>\n\n<img src='sha256:00'>&amp;", None), 10**9 + 3: ("é" * 288, "s")}
    got = document_media(spark.createDataFrame([(k, *v) for k, v in rows.items()], "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        text, source = rows[r.doc_id]
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = f"P5\n24 {len(payload) // 24}\n255\n".encode() + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r.n_texts, r.position, r.caption) == (len(lines), len(lines), (source or "unknown").strip()) and r.feature.startswith("mean=")


def test_pages_with_several_figures(spark):
    """Positions and captions stay with their media; digests that aren't stored and plain links resolve to nulls."""
    from panelwright.llm.media import interleaved, interleaved_media, store_media

    docs = spark.createDataFrame([("one",), ("two",), ("two",)], "text string")
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-") + "/store"
    store_media(docs, "text", path)
    store = spark.read.parquet(path)
    import hashlib as h

    pic = lambda t: h.sha256(b"P5\n24 24\n255\n" + t + b"\xff" * (576 - len(t))).hexdigest()
    page = f'a<figure><img src="sha256:{pic(b"one")}"><img src="sha256:{pic(b"two")}" alt="no"><figcaption>both</figcaption></figure>b<img alt="x" src="/p.png">c<img src="sha256:00">'
    pages = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "<p>t")], "page_id long, html string").withColumn("key", F.lit(0))
    got = sorted(((r.page_id, r.position, r.kind, r.text, r.caption, r.payload_bytes) for r in interleaved_media(pages, store, "page_id", "html").collect()), key=str)
    once = [(1, 0, "text", "a", None, None), (1, 1, "media", None, "both", 576), (1, 2, "media", None, "both", 576), (1, 3, "text", "b", None, None), (1, 4, "media", None, "x", None), (1, 5, "text", "c", None, None), (1, 6, "media", None, None, None)]
    assert got == sorted([*once, *once, (3, 0, "text", "t", None, None)], key=str)
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    parts = interleaved(real, "page_id", "html").collect()
    want = {(r.page_id, p["position"], p["kind"], p["text"]) for r in real.collect() for p in parse_parts(r.html)}
    assert {(r.page_id, r.position, r.kind, r.text) for r in parts} == want and len(parts) == len(want) > 250


@pytest.mark.parametrize("number", (None, 7))
def test_long_conversation_of_one_number(spark, number):
    """All turns with one number or none: positions and offsets run on over the partitions."""
    rows = [(1, number, ("ann", "bob", "system")[i % 3], f"turn {i:05}") for i in range(3_000)] + [(2, 1, "ann", "x")]
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1").collect()
    order = sorted((r[2], r[3]) for r in rows if r[0] == 1)
    for person in ("ann", "bob"):
        mine = sorted((r for r in got if r.perspective == person), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(3_000))
        at = 0
        for r, (speaker, text) in zip(mine, order, strict=True):
            assert r.seg_start == at and text in r.segment and (r.role == "assistant") == (speaker == person)
            at += len(r.segment)
            assert r.seg_end == at


def test_mixing_rates_against_a_solver(spark):
    """Rates by bisection of each source's dual, targets by sharing again; ties at the cut and reruns."""
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * (7 if i % 5 == 0 else r.randrange(0, 40))), r.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(i, "w " * 3000, "e") for i in range(900, 903)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mix_sources(docs.repartition(5)).collect()}
    assert got == {x.doc_id: x for x in mix_sources(docs.repartition(2)).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    for s in {r[2] for r in rows}:
        mine = [i for i, _, source in rows if source == s]
        words, target = sum(size[i] for i in mine), got[mine[0]].target
        scale = words and sum(size[i] for i in mine) / sum(1 for i in mine if size[i])
        lo, hi = -1000.0, 1000.0
        for _ in range(200):
            x = (lo + hi) / 2
            total = sum(size[i] * min(2.0, np.exp(min(50.0, x * size[i] / scale))) for i in mine)
            lo, hi = (x, hi) if total < target else (lo, x)
        for i in mine:
            rate = 2.0 if target >= 2.0 * words else min(2.0, np.exp(min(50.0, x * size[i] / scale)))
            assert got[i].rate == pytest.approx(rate if size[i] else 0.0, rel=1e-6)
            assert got[i].taken == got[i].copies * size[i] <= 2 * size[i] and got[i].copies in (int(rate - 1e-9), int(rate - 1e-9) + 1, int(rate)) or not size[i]
        assert abs(sum(got[i].taken for i in mine) - target) <= max(size[i] for i in mine)


def model_file(path, pieces, kind):
    """A SentencePiece model written by hand: no tokenizer is trained. ``kind``: 1 unigram, 2 merges."""

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + body

    def sized(n, body):
        return field(n, 2, size(len(body)) + body)

    def size(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)

    out = sized(1, sized(1, b"<unk>") + field(2, 5, np.float32(0).tobytes()) + field(3, 0, b"\x02"))
    for piece, score in pieces:
        out += sized(1, sized(1, piece.encode()) + field(2, 5, np.float32(score).tobytes()))
    out += sized(2, field(3, 0, bytes([kind])) + field(4, 0, size(len(pieces) + 1)))
    out += sized(3, sized(1, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("kind", (1, 2))
def test_pieces_without_byte_pieces_equal_library(tmp_path, kind):
    """Scores (unigram) and merges, unknown characters and runs of them, against the library."""
    r = random.Random(kind)
    letters = "▁abcde"
    known = list(letters)
    while len(known) < 106:  # as merges make them: each piece of two earlier ones
        piece = r.choice(known) + r.choice([x for x in known if x[0] != "▁"])
        if piece not in known:
            known.append(piece)
    longer = known[len(letters) :]
    # distinct scores, so that no two paths tie; of a merge model the scores are the order of the merges
    scores = [(-1.0 - 7.3 * r.random()) * 1.0 if kind == 1 else -float(i) for i in range(len(longer) + len(letters))]
    path = model_file(tmp_path / "m.model", list(zip([*letters, *longer], scores, strict=True)), kind)
    sp, memo = sentencepiece.SentencePieceProcessor(model_file=path), MarkedWords(path, {1: "unigram", 2: "bpe"}[kind])
    texts = ["", "xx", "axxa x", "\nxx\nx a"] + ["".join(r.choice("aabbccdde  xz\n") for _ in range(r.randrange(40))) for _ in range(400)]
    ids, n = memo.encode([t.encode() for t in texts])
    got, want = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])], sp.encode(texts)
    if kind == 1:  # "aa" + "a" and "a" + "aa" tie
        assert sum(x != y for x, y in zip(got, want, strict=True)) < 20
        total = lambda x: (sum(sp.get_score(i) for i in x), x.count(0))
        assert all(total(x) == pytest.approx(total(y), abs=1e-4) for x, y in zip(got, want, strict=True))
    else:
        assert got == want
    assert [memo.vocab.decode(x).decode() for x in want] == [sp.decode(x) for x in want]


def test_decoding(spark):
    path = P.path("piece_bpe_32k.model")
    texts = ["", " a  b", "漢字\n\nx", "plain words", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1))
    encoded = encode_pieces(rows, path)
    assert {r.doc_id: r.text for r in decode_pieces(encoded, path).collect()} == dict(enumerate(t or "" for t in texts))
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_pieces(none, path).collect()[0].text is None


def test_memo_starts_anew():
    memo = MarkedWords(P.path("piece_bpe_32k.model"))
    memo.limit = 2_000
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(40))
        assert memo.encode([text.encode()])[0].tolist() == sp.encode(text)


def test_token_file_against_library(spark):
    """Every column of the index, and the ids read back, against the tokenizers library."""
    import zlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()} | {10**9: None, 10**9 + 1: "A<|endoftext|>b İx ẞ. word. 12,"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    tokenizer, want, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}, 0
    for key in sorted(rows):
        ids = np.array([*tokenizer.encode(rows[key] or "", add_special_tokens=False).ids, 2], "<u4")
        want[key] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file(docs, P.path("word_bpe_49k.json")).collect()}
    assert got == want


def test_library_words_on_odd_texts():
    """Special tokens, combining marks, odd white space and end marks: the ids of the library on the whole text."""
    from panelwright.llm.word_memo import library_words

    memo = library_words(P.path("word_bpe_49k.json"))
    r = random.Random(3)
    some = [*"aBT.,'sT5é̈ \n\t\x0b\x1c\x85\xa0  Σς%<|İK١字", "<|endoftext|>", "<|", "|>", "'re", "'S ", "5. ", "x, ", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(40))) for _ in range(5000)]
    ids, n = memo.encode([t.encode() for t in texts], 2)
    stop = np.cumsum(n)
    for t, e, a, b in zip(texts, memo.tokenizer.encode_batch(texts, add_special_tokens=False), stop - n, stop, strict=True):
        assert ids[a:b].tolist() == [*e.ids, 2], t
