"""Helpers shared by the operators: Arrow maps, row keys, checked broadcasts, ASCII lower case."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pickwright.session import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def per_process(key: str, make: Callable[[], object]):
    """A value made once in each Python worker and kept between its tasks, until it runs a task that doesn't keep it."""
    kept = sys.__dict__.setdefault("_pickwright_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget(but: str | None) -> None:
    """Drop what earlier tasks of other stages left in this worker."""
    kept = sys.__dict__.get("_pickwright_kept", {})
    for key in [k for k in kept if k != but]:
        del kept[key]


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, fn: Callable[[list], dict[str, list]], keeps: str | None = None) -> DataFrame:
    """Columns ``keep`` of every row beside what ``fn`` makes of the list of texts of an Arrow batch.

    ``fn`` gets str or None per row and returns one list per column of ``schema``.
    ``keeps`` names what ``fn`` takes from :func:`per_process`. No shuffle: rows stay where the scan put them.
    """
    plain = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    fields = plain.select(*keep).schema
    made_fields = T._parse_datatype_string(schema)
    names, kinds = made_fields.names, [to_arrow_type(f.dataType) for f in made_fields]
    out = T.StructType([*fields, *made_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for batch in batches:
            made = fn(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(made[n], k) for n, k in zip(names, kinds, strict=True)]], names=[*keep, *names])

    return plain.mapInArrow(run, out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later steps survive lost executors and don't recompute."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a counted table of at most ``rows`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Hint a join by shuffle: Spark takes an exploded table for about as large as the one it is made from, and so would broadcast it."""
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. All-ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Columns that tell documents apart: rows with equal id and text are one document and get one result."""
    return [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__h")]



def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row, however often and inside whichever lambda they are used."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(made)))
