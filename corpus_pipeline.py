"""A corpus pipeline: toxicity, line dedup, near dedup, mixing and SentencePiece encoding of ``documents``.

Each stage gets what the one before it wrote, works on all of it, and returns the columns of ``documents`` (the
last one returns the token ids). No stage is plain SQL, so there is no ORACLE_SQL; tests/llm/test_pipeline.py holds each
stage against a brute-force version.

Null and empty texts pass every stage but mixing, which takes no document without words. Rows without a doc_id
are judged by their own text alone and never dropped as duplicates; of a row that repeats id and text near dedup keeps one, and
rows of one id with different texts are judged by their own. Columns
other than those of ``documents`` are left out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.line_dedup import line_dedup
from panelwright.llm.minhash_dedup import minhash_dedup
from panelwright.llm.mixing import mix_sources
from panelwright.llm.pieces import encode_pieces
from panelwright.llm.queries import vocabulary_path
from panelwright.llm.scratch import stored
from panelwright.llm.toxicity import fit_grammar, held_out, toxicity_column

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
THRESHOLD = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learned from the labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = fit_grammar(docs, labels.where(~held_out(F.col("doc_id"))))
    return docs.withColumn("toxicity", toxicity_column(grammar, F.col("text"))).where(F.col("toxicity.score") < THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; all documents stay, if only with empty text."""
    kept = line_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the least id of each class of texts; rows without an id stay, of rows that repeat an id and its text one stays."""
    found = stored(minhash_dedup(docs), "found").where("doc_id is not null")
    dropped = found.where("not kept").select("doc_id", "text_md5").distinct()
    repeated = found.where("kept").groupBy("doc_id", "text_md5").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    docs = docs.select(*COLUMNS).withColumn("text_md5", F.md5("text"))
    alone, again = (x.withColumnsRenamed({"doc_id": "_id", "text_md5": "_md5"}) for x in (dropped.unionByName(repeated), repeated))
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_md5").eqNullSafe(F.col("_md5"))
    once = docs.join(alone, hit, "left_anti")
    return once.unionByName(docs.join(again, hit, "left_semi").dropDuplicates(["doc_id", "text_md5"])).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: it is repeated, or left out."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "source")]
    mix = mix_sources(docs, carry=tuple(rest)).where("copies > 0")
    again = mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.withColumnsRenamed({f"carried_{c}": c for c in rest}).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, and that they decode to its text."""
    return encode_pieces(docs, vocabulary_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("minhash_dedup", near_duplicates), ("mixing", mixing), ("sentencepiece", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
