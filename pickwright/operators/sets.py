"""Unions, except by key and key-wise fill; sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.skew import first_by


def union_sides(home: DataFrame, away: DataFrame) -> DataFrame:
    return home.unionByName(away)


def union_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """History and current rows together, without duplicates; absent columns are null."""
    return history.unionByName(current, allowMissingColumns=True).distinct()


def except_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def union_seasons(df: DataFrame, season: str, per_season) -> DataFrame:
    """Per-season results in one job: the season is a key, not a loop variable."""
    return per_season(df, season)


def fill_from(first: DataFrame, second: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """All keys of both tables; the first table's value where it has one."""
    other = second.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    joined = first.select(*keys, *cols).join(other, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def ordered(df: DataFrame, by: Sequence[Column], digits: int | None = None) -> DataFrame:
    """Global order (a range-partitioned sort); doubles rounded half-even when asked."""
    if digits is not None:
        df = df.withColumns({c: F.bround(c, digits) for c, t in df.dtypes if t == "double"})
    return df.orderBy(*by)


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The row with the largest order values of each group."""
    return first_by(df, keys, by, last=True)


def chronological(df: DataFrame, day: str, *ties: str) -> DataFrame:
    return df.orderBy(day, *ties)
