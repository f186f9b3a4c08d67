"""Sinks: wide tables, one-year replacement, weekly snapshots, as-of re-runs."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.skew import first_by


def write_wide(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_stacked(df: DataFrame, path: str, index: str, columns: Mapping[str, Sequence[str]], levels: Sequence[str]) -> None:
    """Delimited text that begins with one line per level and one with the index name, as :func:`scans.read_stacked` reads it.

    ``columns`` gives each column's labels, one per level, in order; a label that repeats the one before it is left
    blank. The header is a file of its own, the first by name; rows follow in any number of files.
    """
    labels = list(columns.values())
    top = []
    for i, level in enumerate(levels):
        line = [x[i] if k == 0 or labels[k - 1][: i + 1] != x[: i + 1] else "" for k, x in enumerate(labels)]
        top.append([level, *line])
    top.append([index, *[""] * len(labels)])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(top)
    head = df.sparkSession.createDataFrame([(line,) for line in out.getvalue().splitlines()], "value string").coalesce(1)
    rows = df.select(F.to_csv(F.struct(index, *columns)).alias("value"))
    # a union keeps the order of its sides' partitions
    head.unionAll(rows).write.text(path)


def overwrite_partition(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partition: str = "year") -> None:
    """Replace only the years present in ``df``; of rows with equal keys the first by ``order`` stays, which must tell them apart."""
    clean = first_by(df, keys, [F.col(c) for c in order])
    clean.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_snapshot(df: DataFrame, path: str, year: int | None = None, week: int | None = None) -> None:
    """One folder per (year, week); writing a week again replaces that week only."""
    if year is not None:
        df = df.withColumn("year", F.lit(year))
    if week is not None:
        df = df.withColumn("week", F.lit(week))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "week").parquet(path)


def run_as_of(pipeline: Callable[[DataFrame, list[str]], DataFrame], events: DataFrame, day: str, dates: Sequence[str]) -> DataFrame:
    """One job for all as-of dates: ``pipeline(events, ["as_of"])`` must group by the given key.

    A row is used for every date that is not before its own day. Pipelines that only need
    decayed sums should use ``as_of_weighted_mean``, which does not copy rows.
    """
    stops = F.array(*[F.lit(d).cast("date") for d in sorted(dates)])
    copies = events.withColumn("as_of", F.explode(F.filter(stops, lambda s: s >= F.col(day))))
    return pipeline(copies, ["as_of"])
