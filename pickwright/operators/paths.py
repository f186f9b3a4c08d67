"""Best season-long pick paths: one pick per week slot, every team at most once."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwright.session import cut_lineage

EPS = 1e-9
#: Starts the name of the pick that stands for a week without candidates; dropped from the result.
NO_WEEK = "(no pick) "

# the price function travels with its job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _slots(weeks: Sequence[int], picks: Mapping[int, int] | None) -> list[tuple[int, int]]:
    """(week, slot in week) for every pick of the season, in order."""
    return [(w, i) for w in sorted(weeks) for i in range(1, (picks or {}).get(w, 1) + 1)]


def _slot_candidates(
    cands: DataFrame, keys: list[str], week: str, team: str, score: str, slots: list[tuple[int, int]], k: int, required: DataFrame | None
) -> DataFrame:
    """Candidates per slot, cut to the ones an answer can contain.

    A team listed more than once in a week counts with its best score. A required team
    without a candidate in its week is not required. Among the best (slots + k - 1) teams of a week at least k are unused by the rest of any
    path, so a path with a worse team has k better paths and cannot be among the k best.
    """
    base = cands.where(F.col(score).isNotNull()).select(
        *keys, F.col(week).alias("_w"), F.col(team).cast("string").alias("_t"), F.col(score).cast("double").alias("_s")
    )
    base = base.where(F.col("_w").isin([w for w, _ in slots])).groupBy(*keys, "_w", "_t").agg(F.max("_s").alias("_s"))
    present = base.select(*keys, "_w").distinct()
    forced = None
    if required is not None:
        known = required.select(*keys, F.col(week).alias("_w"), F.col(team).cast("string").alias("_t")).distinct().join(base, [*keys, "_w", "_t"], "left_semi")
        forced = known.select(*keys, F.col("_w").alias("_rw"), "_t", F.row_number().over(Window.partitionBy(*keys, "_w").orderBy("_t")).alias("_place"))
        base = base.join(forced, [*keys, "_t"], "left").where(F.col("_rw").isNull() | (F.col("_rw") == F.col("_w")))
    else:
        base = base.withColumn("_place", F.lit(None).cast("int"))
    best = Window.partitionBy(*keys, "_w").orderBy(F.col("_place").isNull(), F.desc("_s"), "_t")
    base = base.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= len(slots) + k - 1)
    taken = F.lit(0)
    if forced is not None:
        counts = forced.groupBy(*keys, F.col("_rw").alias("_w")).agg(F.count("*").alias("_taken"))
        base = base.join(counts, [*keys, "_w"], "left")
        taken = F.coalesce("_taken", F.lit(0))
    spec = F.array(*[F.struct(F.lit(n).alias("slot"), F.lit(w).alias("w"), F.lit(i).alias("i")) for n, (w, i) in enumerate(slots)])
    mine = F.filter(
        spec,
        lambda s: (s["w"] == F.col("_w"))
        & F.when(F.col("_place").isNotNull(), s["i"] == F.col("_place")).otherwise(s["i"] > taken),
    )
    open_slots = base.select(*keys, "_t", "_s", F.col("_place").isNull().alias("_free"), F.explode(mine).alias("_sl")).select(
        *keys, F.col("_sl.slot").alias("_slot"), "_t", "_s", "_free"
    )
    # a contest takes the listed weeks that it has: each slot of another week gets one pick without a team
    wanted = present.select(*keys).distinct().select(*keys, F.explode(spec).alias("_sl")).select(*keys, F.col("_sl.w").alias("_w"), F.col("_sl.slot").alias("_slot"))
    absent = wanted.join(present, [*keys, "_w"], "left_anti")
    return open_slots.unionByName(absent.select(*keys, "_slot", F.format_string(f"{NO_WEEK}%09d", "_slot").alias("_t"), F.lit(0.0).alias("_s"), F.lit(False).alias("_free")))


def auction(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots bid for teams: a price >= 0 per team, and the slot that holds it (-1: none).

    Any prices give a valid bound and any full holding is a path; the search below is exact
    whatever comes out here, only slower when the prices are bad.
    """
    slots, teams = pdf["_slot"].to_numpy(), pdf["_t"].astype("category").cat.codes.to_numpy()
    reward = np.full((slots.max() + 1, teams.max() + 1), -np.inf)
    reward[slots, teams] = pdf["_s"].to_numpy()
    span = max(float(pdf["_s"].max() - pdf["_s"].min()), 1e-6)
    eps = span / (2000.0 * len(reward))
    price, owner, waiting = np.zeros(reward.shape[1]), np.full(reward.shape[1], -1), list(range(len(reward)))
    # prices stay under this bound if every slot can hold a team of its own; beyond it the contest has no path
    highest = 4 * len(reward) * (span + eps)
    while waiting and price.max() <= highest:
        s = waiting.pop()
        value = reward[s] - price
        t = int(value.argmax())
        best, value[t] = value[t], -np.inf
        second = value.max()
        if not np.isfinite(best):
            break
        price[t] += best - (second if np.isfinite(second) else best - span) + eps
        if owner[t] >= 0:
            waiting.append(int(owner[t]))
        owner[t] = s
    return price, owner


def _with_prices(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a team's price and the slot that holds it. A contest's cut candidates are at
    most slots x (slots + k - 1) rows, so its group stays small whatever the input."""

    def price(pdf: pd.DataFrame) -> pd.DataFrame:
        prices, owner = auction(pdf)
        if (owner >= 0).sum() <= pdf["_slot"].max():
            pdf = pdf[:0]  # some slot can't be filled: no path, nothing to search
            prices, owner = prices[:0], owner[:0]
        by_team = pd.DataFrame({"_t": pdf["_t"].astype("category").cat.categories, "_price": prices, "_owner": owner})
        return pdf[[*keys, "_slot", "_t", "_s", "_free"]].merge(by_team, on="_t")

    fields = [f"{c} {dict(cands.dtypes)[c]}" for c in keys]
    schema = ", ".join([*fields, "_slot int, _t string, _s double, _free boolean, _price double, _owner int"])
    return cands.groupBy(*keys).applyInPandas(price, schema)


def _floor(ready: DataFrame, keys: list[str], slots: int, k: int) -> DataFrame:
    """A total that k known paths reach: the held teams, and each swap of one of them for
    a team nobody holds. Null when the holding is not complete."""
    held = ready.where(F.col("_owner") == F.col("_slot"))
    whole = held.groupBy(*keys).agg(F.sum("_s").alias("_total"), F.count("*").alias("_n")).where(F.col("_n") == slots)
    swaps = ready.where(F.col("_owner") < 0).join(held.select(*keys, "_slot", F.col("_s").alias("_held")), [*keys, "_slot"])
    swaps = swaps.join(whole, keys).select(*keys, (F.col("_total") - F.col("_held") + F.col("_s")).alias("_total"))
    known = _limit(whole.select(*keys, "_total").unionByName(swaps), keys, [F.desc("_total")], k)
    return known.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("_total")).alias("_floor"))


def _extend(paths: DataFrame, cands: DataFrame, keys: list[str], slot: int, same_week: bool) -> DataFrame:
    """One-pick continuations within the budget; free picks of one week go in team order."""
    nxt = cands.where(F.col("_slot") == slot).select(*keys, "_t", "_s", "_free", "_slack", "_budget")
    ok = ~F.array_contains("picks", F.col("_t")) & (F.col("slack") + F.col("_slack") <= F.col("_budget"))
    if same_week:
        ok = ok & (F.col("_last").isNull() | (F.col("_t") > F.col("_last")))
    return paths.join(nxt, keys).where(ok).select(
        *keys,
        F.concat("picks", F.array("_t")).alias("picks"),
        (F.col("total") + F.col("_s")).alias("total"),
        (F.col("slack") + F.col("_slack")).alias("slack"),
        F.when(F.col("_free"), F.col("_t")).alias("_last"),
    )


def _start(cands: DataFrame, keys: list[str]) -> DataFrame:
    return cands.where(F.col("_slot") == 0).select(
        *keys, F.array("_t").alias("picks"), F.col("_s").alias("total"), F.col("_slack").alias("slack"),
        F.when(F.col("_free"), F.col("_t")).alias("_last"),
    )


def _limit(paths: DataFrame, by: Sequence[str | Column], order: Sequence[Column | str], n: int) -> DataFrame:
    """Best n per group; the optimizer limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return paths.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def best_paths(
    cands: DataFrame,
    keys: Sequence[str],
    week: str,
    team: str,
    score: str,
    weeks: Sequence[int],
    k: int = 1,
    picks: Mapping[int, int] | None = None,
    required: DataFrame | None = None,
    cut_every: int = 6,
) -> DataFrame:
    """The k best paths of every contest: (keys, rank, picks, total).

    ``picks`` gives the weeks with two or three picks, ``required`` (keys, week, team) the
    forced ones. ``keys`` name the contest. A contest plays the listed weeks in which it has
    candidates; one with fewer teams than picks in some week has no path and no row.

    Paths are joined with the next slot's candidates level by level, and
    a path stays while its bound reaches a total that k known paths have. The bound is
    additive: with a price per team, no path is worth more than (sum of the slots' best
    reduced scores + all prices) minus its own slack.
    """
    ks = list(keys)
    slots = _slots(weeks, picks)
    raw = _slot_candidates(cands, ks, week, team, score, slots, k, required)
    priced = _with_prices(raw, ks).withColumn("_r", F.col("_s") - F.col("_price"))
    tops = cut_lineage(priced)
    best = tops.groupBy(*ks, "_slot").agg(F.max("_r").alias("_top"))
    ready = tops.join(best, [*ks, "_slot"]).withColumn("_slack", F.col("_top") - F.col("_r"))
    prices = tops.groupBy(*ks, "_t").agg(F.first("_price").alias("_price")).groupBy(*ks).agg(F.sum("_price").alias("_prices"))
    ceiling = best.groupBy(*ks).agg(F.sum("_top").alias("_tops")).join(prices, ks)
    budget = ceiling.join(_floor(tops, ks, len(slots), k), ks, "left").select(
        *ks, F.coalesce(F.col("_tops") + F.col("_prices") - F.col("_floor"), F.lit(float("inf"))).alias("_budget")
    )
    budget = budget.withColumn("_budget", F.col("_budget") + EPS * (1 + F.abs("_budget")))
    source = cut_lineage(ready.join(budget, ks).where(F.col("_slack") <= F.col("_budget")))
    paths = _start(source, ks)
    for n in range(1, len(slots)):
        paths = _extend(paths, source, ks, n, slots[n][0] == slots[n - 1][0])
        # equal sets of teams continue equally: only the k best of a set matter
        same = [*ks, F.array_sort("picks"), F.coalesce("_last", F.lit(""))]
        paths = _limit(paths, same, [F.desc("total"), "picks"], k)
        if n % cut_every == 0:
            paths = cut_lineage(paths)
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy(*ks).orderBy(F.desc("total"), "picks")))
    teams = F.filter("picks", lambda t: ~t.startswith(NO_WEEK))
    return ranked.where(F.col("rank") <= k).select(*ks, "rank", teams.alias("picks"), "total")
