"""Lines that several documents share: explode normalised lines, count documents per hash, drop, reassemble."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal, join_spread, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters unchanged; texts of ASCII alone take the quicker way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, digest, kept = [], [], [], []
        for t, gone in zip(batch.column("text").cast(pa.binary()), batch.column("gone"), strict=True):
            lines = (t.as_py() or b"").split(b"\n")
            n_lines.append(len(lines))
            if gone.is_valid:
                drop = set(gone.values.to_pylist())
                lines = [x for i, x in enumerate(lines) if i not in drop]
                n_dropped.append(len(drop))
            else:
                n_dropped.append(0)
            kept.append(b"\n".join(lines))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        carried = [c for c in batch.schema.names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], names=[*carried, "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that ``min_docs`` or more of them share, kept only in the least key's document.

    Returns (key, the columns ``carry``, n_lines, n_dropped, kept_sha256, kept_text), one row per row of ``docs``. A null or
    empty text is one empty line, an empty table gives an empty one. Lines whose normalised form is under ``min_chars`` code
    points always stay; all lines of the least document stay, repeats included. A line's hash is 128 bits wide (md5).

    Rows of one key are one document: none of them takes a line from another, whatever their texts. A row without
    a key is no document: it holds no line for others and loses none. Texts of any length are split where they
    lie. Columns of ``docs`` other than key, text and ``carry`` aren't read, so their names may clash with any here.

    Each text is split and hashed once; hashes and positions are stored and grouped with partial sums, so a line that most
    documents hold reaches its task as one row per map task. Hashes with many lines are joined back where the
    lines lie (:func:`join_spread`), so none of them fills a task.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    lines = docs.where("text is not null and key is not null").select("key", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.length("line") >= min_chars).withColumn("k", F.btrim(F.col("line"), F.lit(BLANKS))).where(F.length("k") >= min_chars)
    lines = stored(lines.select("key", "row", "pos", F.unhex(F.md5(lower_ascii(F.col("k")))).alias("h")), "lines")
    if min_docs == 2:  # two different documents: least and greatest differ
        shared = lines.groupBy("h").agg(F.min("key").alias("keeper"), F.max("key").alias("last"), F.count("*").alias("n")).where("keeper <> last").select("h", "keeper", "n")
    else:
        per = lines.groupBy("h", "key").agg(F.count("*").alias("n"))
        shared = per.groupBy("h").agg(F.min("key").alias("keeper"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).select("h", "keeper", "n")
    gone = join_spread(lines, stored(shared, "shared"), "h", "n").where("key <> keeper").groupBy("key", "row").agg(F.collect_list("pos").alias("gone"))
    rows = docs.join(gone, ["key", "row"], "left").drop("row")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "gone"))
    kept = rows.mapInArrow(frugal(_rebuild), own + ", n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    return kept.withColumnsRenamed({"key": key} | {f"carry_{c}": c for c in carry})
