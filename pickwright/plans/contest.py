"""Contest history: public picks and entries to features, flow and expected value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.operators import aggregates as A
from pickwright.operators import joins, rows, scenarios, sets, windows
from pickwright.session import cut_lineage

WEEK = ["year", "week"]


def clean_public_picks(raw: DataFrame) -> DataFrame:
    """Typed rows from the scraped text table: win %, pick %, codes, week; no byes, no duplicates."""
    df = rows.clean_label(rows.clean_label(raw, "team", drop=()), "opponent")
    df = rows.parse_percent(df, "win_pct")
    df = rows.parse_percent(df, "pick_pct", null_as_zero=True)
    week = F.regexp_extract(F.col("week").cast("string"), r"(\d+)", 1).cast("int")
    return rows.dedupe(df.withColumn("week", week))


def replace_year(history: DataFrame, current: DataFrame, year: int) -> DataFrame:
    """History without the year, plus the year's new rows, without duplicates."""
    return sets.union_history(history.where(F.col("year") != year), current)


def pick_features(picks: DataFrame, horizon: int | None = 18) -> DataFrame:
    """Week-relative features of win %, future value and look-ahead counts.

    ``picks``: year, week, team, opponent, win_pct, pick_pct, future_value, availability,
    is_away, day.
    """
    df = rows.calendar_flags(picks, "day", "is_away", "win_pct")
    df = _week_relative(df, ["win_pct", "future_value"])
    df = windows.future_scarcity(df, ["year", "team"], "week", "win_pct", "win_pct_is_top", horizon)
    return _week_relative(df, ["future_top", "future_over_80", "future_70_80", "future_60_70", "availability"])


def _week_relative(df: DataFrame, cols: list[str]) -> DataFrame:
    """All columns share one aggregation; ranks are cut one by one, as each reads its input again."""
    df = cut_lineage(windows.relative_stats(windows.group_stats(df, WEEK, cols), WEEK, cols))
    for c in cols:
        df = cut_lineage(windows.rank_density(df, WEEK, c))
    return df


def entry_flow(entries_wide: DataFrame, week_cols: list[str], grid: DataFrame, pools: DataFrame) -> DataFrame:
    """Alive entries, picks, availability and shares per (year, week, team).

    ``entries_wide``: year, entry_name, total_wins, week columns; ``pools``: year, entries.
    """
    long = rows.unpivot_picks(entries_wide, ["year", "entry_name", "total_wins"], week_cols)
    made = long.where(F.col("pick") != "ELIMINATED").withColumnRenamed("pick", "team")
    alive = A.alive_by_week(entries_wide, ["year"], "total_wins", len(week_cols), pools)
    return A.pick_flow(grid, made, alive, pools, ["year"])


def week_value(sides: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Expected value per team and week: one row per game by mirrored join, then all outcomes."""
    k = keys or WEEK
    both = joins.opponent_value(sides, k, "team", "opponent", "pick_pct", one_per_game=True)
    both = both.withColumn("_game", F.concat_ws("-", "team", "opponent"))
    ev = scenarios.scenario_ev(both, k, "_game", "team", "opponent", "win_pct", None, "pick_pct", "opponent_pick_pct")
    return sets.fill_from(ev.select(*k, "team", "ev"), sides.select(*k, "team", F.lit(None).cast("double").alias("ev")), [*k, "team"], ["ev"])
