"""Typed dimension and fact rows from staged text, crosswalks of ids, and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import columns as C


@dataclass(frozen=True)
class Field:
    """Where a typed column comes from and how its text is read: text, long, decimal, date or flag ('1', '0')."""

    source: str
    kind: str = "text"
    formats: tuple[str, ...] = ("yyyy-MM-dd",)
    sentinels: tuple[str, ...] = ()

    def read(self) -> Column:
        c = F.col(self.source)
        return {"text": lambda: C.blank_to_null(c), "long": lambda: C.safe_long(c), "decimal": lambda: C.safe_decimal(c), "date": lambda: C.safe_date(c, self.formats, self.sentinels), "flag": lambda: C.tri_bool(c)}[self.kind]()


def conform(stage: DataFrame, fields: Mapping[str, Field], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each staged row, every field typed, and ``unread``: the fields, in order, whose text is there but can't be read.

    One projection: no row is dropped and nothing is shuffled. Blank texts and sentinels (open ends) are null, not unread.
    Columns in ``keep`` go along as they are.
    """
    typed = {n: f.read() for n, f in fields.items()}
    lost = []
    for n, f in fields.items():
        given = C.blank_to_null(F.col(f.source))
        there = given.isNotNull() & ~given.isin(*f.sentinels) if f.sentinels else given.isNotNull()
        lost.append(F.when(there & typed[n].isNull(), F.lit(n)))
    return stage.select(*[c.alias(n) for n, c in typed.items()], *keep, F.array_join(F.array_compact(F.array(*lost)), ",").alias("unread"))


def read_status(typed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_rows, n_null, n_unread) of conformed rows, in one aggregate."""
    lost = F.split("unread", ",")
    counts = [F.struct(F.lit(n).alias("field"), F.count("*").alias("n_rows"), F.count_if(F.col(n).isNull()).alias("n_null"), F.count_if(F.array_contains(lost, n)).alias("n_unread")) for n in fields]
    return typed.agg(F.array(*counts).alias("f")).select(F.inline("f"))


def attach_where(df: DataFrame, condition: Column, source: DataFrame, key: str, source_key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` of the source row that ``key`` names, only where ``condition`` holds; null elsewhere.

    The condition is part of the key, not a filter after the join: rows that fail it keep no key, so they match nothing whatever
    their key says. They are spread by a random number instead of meeting in the task of one null. A source key must be unique.
    """
    kind = source.schema[source_key].dataType
    found = source.where(F.col(source_key).isNotNull()).select(F.struct(F.col(source_key).alias("k"), F.lit(-1.0).alias("r")).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    own = F.when(condition & F.col(key).isNotNull(), F.struct(F.col(key).cast(kind).alias("k"), F.lit(-1.0).alias("r")))
    x = df.withColumn("_o", F.coalesce(own, F.struct(F.lit(None).cast(kind).alias("k"), F.rand(7).alias("r"))))
    return x.join(found, x["_o"] == found["_k"], "left").select(*[x[c] for c in df.columns], *[F.col(f"_{c}").alias(c) for c in columns])


def crosswalk(sources: Mapping[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(id, source, name, n_sources): the distinct ids of every source (table, id column, name column), and how many sources have the id."""
    parts = [df.select(F.col(key).cast("long").alias("id"), F.lit(n).alias("source"), (F.col(name) if name else F.lit(None)).cast("string").alias("name")).where("id is not null") for n, (df, key, name) in sources.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    one = both.groupBy("id", "source").agg(F.min("name").alias("name"))
    per = one.groupBy("id").agg(F.collect_list(F.struct("source", "name")).alias("s"))  # a row for each source at most
    return per.select("id", F.inline("s"), F.size("s").cast("long").alias("n_sources"))


def filter_isin(df: DataFrame, selections: Mapping[str, Sequence[object]]) -> DataFrame:
    """The rows whose columns are all among the values selected; an empty selection selects everything."""
    for column, values in selections.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df
