"""Season projection and pick paths: pick shares week by week, value, best paths."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.operators import paths, rows, scenarios, windows
from pickwright.operators.aggregates import rollup_path
from pickwright.operators.iterative import redistribute
from pickwright.session import cut_lineage


def implied_use(pools: DataFrame, availability: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries that have used a team when the projection starts, from the share that still may: S x (1 - availability)."""
    k = list(keys)
    size = pools.select(*k, F.col("entries").cast("double").alias("_s"))
    used = F.greatest(F.lit(0.0), F.least(F.col("_s") * (1 - F.coalesce("availability", F.lit(1.0))), F.col("_s")))
    return availability.join(size, k).select(*k, "team", F.coalesce(used, F.lit(0.0)).alias("used"))


def project_picks(
    sides: DataFrame, pools: DataFrame, weeks: Sequence[int], predict: Callable[[DataFrame], DataFrame],
    keys: Sequence[str], picks_per_week: Mapping[int, int] | None = None, used: DataFrame | None = None,
    overrides: DataFrame | None = None, passes: int = 15, availability: DataFrame | None = None,
) -> DataFrame:
    """Expected crowd picks of every week, each from the pool the earlier weeks leave.

    ``sides``: keys, week, team, win and the features ``predict`` needs; it gets the week's rows with ``entries`` and
    ``availability`` and must add ``pick_pct``. ``pools``: keys, entries at the first of ``weeks``, which may be any
    week of the season; ``used`` (keys, team, used) or ``availability`` (keys, team, availability) tells what has been
    used before it, a team in neither nothing. A pool that is empty, or that had no games in the week before, stops:
    it has no rows from then on, and the loop ends when all have stopped. The loop runs over the weeks of a season;
    all pools advance together, and what is carried from week to week, in reliable checkpoints, is one row per pool
    and one per (pool, team).
    """
    k = list(keys)
    size = cut_lineage(pools.select(*k, F.col("entries").cast("double").alias("entries")).where("entries > 0"))
    if used is None and availability is not None:
        used = implied_use(pools, availability, k)
    everyone = sides.select(*k, "team").distinct()
    if used is None:
        used = everyone.withColumn("used", F.lit(0.0))
    else:
        used = everyone.join(used.select(*k, "team", "used"), [*k, "team"], "left").withColumn("used", F.coalesce("used", F.lit(0.0)))
    used, done = cut_lineage(used), None
    for w in weeks:
        target = F.lit(float((picks_per_week or {}).get(w, 1)))
        df = sides.where(F.col("week") == w).join(size, k).join(used, [*k, "team"], "left")
        free = (F.col("entries") - F.coalesce("used", F.lit(0.0))) / F.col("entries")
        df = df.withColumn("availability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), free)))
        df = windows.normalize(cut_lineage(predict(df)), k, "pick_pct", target)
        df = redistribute(df, k, "pick_pct", "availability", passes)
        if overrides is not None:
            df = rows.apply_overrides(df, overrides, [*k, "week", "team"], "pick_pct")
        df = cut_lineage(rows.expected_flow(df, "pick_pct", "win", "entries", F.lit((picks_per_week or {}).get(w, 1))))
        done = df if done is None else done.unionByName(df)
        kept = df.groupBy(*k, "team").agg(F.sum("expected_survivors").alias("_kept"))
        after = kept.groupBy(*k).agg(F.sum("_kept").alias("_after"))
        rate = size.join(after, k)  # without games in a week the next pool is unknown
        carried = used.join(rate, k).join(kept, [*k, "team"], "left")
        still = F.col("used") * F.col("_after") / F.col("entries")
        now = F.greatest(F.lit(0.0), F.least(F.coalesce("_kept", F.lit(0.0)) + still, F.col("_after")))
        used = cut_lineage(carried.select(*k, "team", now.alias("used")))
        size = cut_lineage(rate.where("_after > 0").select(*k, F.col("_after").alias("entries")))
        if size.isEmpty():
            break
    return done


def add_value(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected value of every side; ``sides``: keys, week, game_id, team, opp_team, is_away, win, pick_pct."""
    group = [*keys, "week"]
    other = sides.where(F.col("is_away")).select(*group, "game_id", F.col("win").alias("_qw"), F.col("pick_pct").alias("_qp"))
    games = sides.where(~F.col("is_away")).join(other, [*group, "game_id"])
    ev = scenarios.scenario_ev(games, group, "game_id", "team", "opp_team", "win", "_qw", "pick_pct", "_qp")
    return sides.join(ev, [*group, "game_id", "team"], "left")


def choose_paths(
    sides: DataFrame, keys: Sequence[str], weeks: Sequence[int], score: str, rules: Mapping[str, Column], k: int = 1,
    picks_per_week: Mapping[int, int] | None = None, required: DataFrame | None = None, already_used: DataFrame | None = None,
) -> DataFrame:
    """The k best paths over the sides that no rule rejects."""
    open_sides = rows.eligible(sides, rules).where("eligible")
    if already_used is not None:
        open_sides = open_sides.join(already_used, [*keys, "team"], "left_anti")
    return paths.best_paths(open_sides, keys, "week", "team", score, weeks, k, picks_per_week, required)


def path_weeks(best: DataFrame, sides: DataFrame, keys: Sequence[str], weeks: Sequence[int], picks_per_week: Mapping[int, int] | None = None) -> DataFrame:
    """Per path and week: the picks with the products of their win chance, share and value."""
    slots = F.array(*[F.lit(w) for w, _ in paths._slots(weeks, picks_per_week)])
    pairs = best.select(*keys, "rank", F.explode(F.arrays_zip(slots.alias("week"), F.col("picks").alias("team"))).alias("_p"))
    flat = pairs.select(*keys, "rank", F.col("_p.week").alias("week"), F.col("_p.team").alias("team"))
    known = flat.join(sides.select(*keys, "week", F.col("team").cast("string").alias("team"), "win", "pick_pct", "ev"), [*keys, "week", "team"])
    return rollup_path(known, [*keys, "rank", "week"], "team", "team", {"survival": "win", "share": "pick_pct", "value": "ev"})
