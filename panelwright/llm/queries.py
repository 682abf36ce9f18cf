"""The queries of this subpackage over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.alignment import align_tokenizers
from panelwright.llm.chat_format import rotate_perspectives
from panelwright.llm.embedding_dedup import embedding_dedup
from panelwright.llm.line_dedup import line_dedup
from panelwright.llm.media import document_media
from panelwright.llm.minhash_dedup import minhash_dedup
from panelwright.llm.mixing import mix_sources
from panelwright.llm.pieces import encode_pieces
from panelwright.llm.secret_scan import secret_scan
from panelwright.llm.substring_dedup import substring_dedup
from panelwright.llm.token_file import token_file
from panelwright.llm.toxicity import fit_grammar, held_out, toxicity_scores
from panelwright.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), k=35).drop("kept_text")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end=2)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents")).drop("n_links", "text_md5")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = fit_grammar(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity_scores(docs, grammar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "matched")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_substring_dedup, op3_sentencepiece, op4_chat_perspectives, op5_token_file, op6_minhash_dedup, op7_line_dedup, op8_embedding_dedup, op9_mixing, op10_toxicity, op11_alignment, op12_secret_scan, op13_whitening)}

SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER s AS win, count(*) OVER s AS n FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
dup AS (SELECT win FROM win WHERE n = 35 GROUP BY win HAVING count(*) > 1),
cov AS (SELECT doc_id, pos, word, max(CASE WHEN n = 35 AND win IN (SELECT win FROM dup) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM win),
per AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)
""",
    "op4_chat_perspectives": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS me,
  CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name FROM t JOIN p ON t.conv_id = p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment, row_number() OVER o - 1 AS position FROM h WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)),
e AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS UNBOUNDED PRECEDING) AS seg_end FROM s)
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position, role, name, segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
  CAST(CASE WHEN me THEN seg_end - length(segment) + length(head) ELSE seg_end - length(segment) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN me THEN seg_end - 1 ELSE seg_end - length(segment) END AS BIGINT) AS mask_end FROM e
""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS gram FROM w) GROUP BY ALL),
tot AS (SELECT doc_id, sum(c) AS n FROM g GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN tot x ON a = x.doc_id JOIN tot y ON b = y.doc_id WHERE i >= 0.8 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.seen = l.a)
SELECT node AS doc_id, min(seen) AS class_id, node = min(seen) AS kept FROM reach GROUP BY node
""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.doc_id, pos, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.seen = l.a)
SELECT node AS vec_id, CAST((SELECT count(*) FROM link WHERE a = node) AS BIGINT) AS n_links, min(seen) AS component_id, node = min(seen) AS kept FROM reach GROUP BY node
""",
}
