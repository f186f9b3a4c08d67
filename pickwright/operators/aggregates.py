"""Aggregations. All but the exact percentiles are algebraic, so partial
aggregation runs before the shuffle and a hot key costs no more than any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.functions import rating
from pickwright.skew import cell_order, nan_to_null, not_null, running_totals

#: A counted table of at most so many rows may be hinted for broadcast.
HINTED_ROWS = 200_000


def over_weight(total: Column, weight: Column) -> Column:
    """``total / weight`` as IEEE has it: values of no weight in all have no mean, NaN, and fail no job."""
    return F.when(weight == 0, total * F.lit(float("inf"))).otherwise(total / F.nullif(weight, F.lit(0)))


def wmean(x: Column, w: Column, where: Column | None = None) -> Column:
    """Weighted mean over rows with a value; null when there is none, NaN when all weigh nothing. NaN is no value."""
    x = F.nullif(x.cast("double"), F.lit(float("nan")))
    use = x.isNotNull() if where is None else x.isNotNull() & where
    return over_weight(F.sum(F.when(use, x * w)), F.sum(F.when(use, w)))


def wrate(hit: Column, base: Column, w: Column) -> Column:
    """Weight of the rows of ``base`` that are hits, over the weight of ``base``."""
    hit_in_base = base & F.coalesce(hit, F.lit(False))
    return over_weight(F.sum(F.when(hit_in_base, w).otherwise(F.when(base, F.lit(0.0)))), F.sum(F.when(base, w)))


def wstd(x: Column, w: Column, where: Column | None = None) -> Column:
    """Weighted population standard deviation."""
    use = x.isNotNull() if where is None else x.isNotNull() & where
    sw, sx, sxx = F.sum(F.when(use, w)), F.sum(F.when(use, x * w)), F.sum(F.when(use, x * x * w))
    return F.sqrt(F.greatest(over_weight(sxx, sw) - F.pow(over_weight(sx, sw), 2), F.lit(0.0)))


def weighted_mean(df: DataFrame, keys: Sequence[str], x: Mapping[str, str], w: str) -> DataFrame:
    """Weighted means per key ({out: column}); no value at all gives 0."""
    means = [F.coalesce(wmean(F.col(c), F.col(w)), F.lit(0.0)).alias(n) for n, c in x.items()]
    return df.where(not_null(keys)).groupBy(*keys).agg(*means)


def weighted_stats(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    c, wt = F.col(x), F.col(w)
    zero = F.lit(0.0)
    return df.where(not_null(keys)).groupBy(*keys).agg(
        F.coalesce(wmean(c, wt), zero).alias("mean"), F.coalesce(wstd(c, wt), zero).alias("std")
    )


def game_stats(df: DataFrame, keys: Sequence[str], x: str, success: str, w: str) -> DataFrame:
    """Per game side: summed value, summed success, plays, mean weight, success rate."""
    return (
        df.where(not_null(keys))
        .groupBy(*keys)
        .agg(F.sum(x).alias("total"), F.sum(success).alias("successes"), F.count("*").alias("plays"), F.avg(w).alias("weight"))
        .withColumn("rate", F.col("successes") / F.col("plays"))
    )


def mode_by(df: DataFrame, keys: Sequence[str], col: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group; the smallest value wins a tie."""
    counts = df.where(not_null([*keys, col])).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(out), F.max("_n").alias(f"{out}_count")
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str = "latest") -> DataFrame:
    return df.where(not_null(keys)).groupBy(*keys).agg(F.max_by(F.col(col), F.struct(*order)).alias(out))


def mean_of_sums(df: DataFrame, keys: Sequence[str], inner: Sequence[str], x: str, out: str, default: float = K.DEFAULT_VOLUME) -> DataFrame:
    """Sum per (keys, inner), then the mean of those sums per keys."""
    sums = df.where(not_null([*keys, *inner])).groupBy(*keys, *inner).agg(F.sum(x).alias("_s"))
    return sums.groupBy(*keys).agg(F.coalesce(F.avg("_s"), F.lit(default)).alias(out))


def per_game_rate(df: DataFrame, team: str, opponent: str, game: str, x: str, w: str, scrimmage: Column, kicking: Column) -> DataFrame:
    """Weighted mean over games of per-game sums: offence, defence, special teams.

    A kicking play counts for the kicking side and, negated, for the other side.
    """
    roles = F.array_compact(
        F.array(
            F.when(scrimmage, F.struct(F.col(team).alias("team"), F.lit("offense").alias("unit"), F.col(x).alias("v"))),
            F.when(scrimmage, F.struct(F.col(opponent).alias("team"), F.lit("defense").alias("unit"), F.col(x).alias("v"))),
            F.when(kicking, F.struct(F.col(team).alias("team"), F.lit("special").alias("unit"), F.col(x).alias("v"))),
            F.when(kicking, F.struct(F.col(opponent).alias("team"), F.lit("special").alias("unit"), (-F.col(x)).alias("v"))),
        )
    )
    games = (
        df.select(game, F.col(w).alias("_w"), F.explode(roles).alias("_r"))
        .where(F.col("_r.team").isNotNull())
        .groupBy(F.col("_r.team").alias("team"), F.col("_r.unit").alias("unit"), game)
        .agg(F.sum("_r.v").alias("_v"), F.avg("_w").alias("_w"))
    )
    return games.groupBy("team").agg(
        *[
            F.coalesce(wmean(F.col("_v"), F.col("_w"), F.col("unit") == u), F.lit(0.0)).alias(f"{u}_per_game")
            for u in ("offense", "defense", "special")
        ]
    )


def conditional_rates(
    df: DataFrame, keys: Sequence[str], rates: Mapping[str, tuple[Column, Column]], w: str, defaults: Mapping[str, float] | None = None
) -> DataFrame:
    """Several weighted rates {name: (hit, base)} in one aggregation."""
    wt = F.col(w)
    out = []
    for name, (hit, base) in rates.items():
        r = wrate(hit, F.coalesce(base, F.lit(False)), wt)
        if defaults and name in defaults:
            r = F.coalesce(r, F.lit(defaults[name]))
        out.append(r.alias(name))
    return df.where(not_null(keys)).groupBy(*keys).agg(*out)


def play_calling(plays: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """Pass rate by team and situation, and the league's rate of the situation."""
    situation = [k for k in keys if k != "posteam"]
    hit = F.when(F.col("play_type") == "pass", F.col(w)).otherwise(0.0)
    cells = plays.where(not_null(keys)).groupBy(*keys).agg(F.sum(hit).alias("_h"), F.sum(w).alias("_w"))
    league = cells.groupBy(*situation).agg((F.sum("_h") / F.sum("_w")).alias("league_pass_rate"))
    return cells.withColumn("pass_rate", F.col("_h") / F.col("_w")).join(league, situation).select(*keys, "pass_rate", "league_pass_rate")


def offense_profile(plays: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """Run and pass efficiency per key, with fixed fallbacks for empty cells."""
    c, wt, d = F.col, F.col(w), K.PROFILE_DEFAULTS
    run, passed = c("play_type") == "run", c("play_type") == "pass"
    thrown = passed & (c("sack") == 0)
    caught = thrown & (c("complete_pass") == 1)
    ran = F.coalesce(c("yards_gained"), F.lit(0.0))
    n_thrown = F.sum(F.when(thrown, 1).otherwise(0))

    def or_default(value: Column, thrown_default: float, none_default: float) -> Column:
        return F.coalesce(value, F.when(n_thrown > 0, thrown_default).otherwise(none_default))

    return plays.where(not_null(keys) & (run | passed)).groupBy(*keys).agg(
        F.coalesce(wmean(ran, wt, run), F.lit(d["run_mu"])).alias("run_mu"),
        F.coalesce(wstd(ran, wt, run), F.lit(d["run_sigma"])).alias("run_sigma"),
        F.coalesce(wrate(c("fumble_lost") == 1, run, wt), F.lit(d["run_fumble"])).alias("run_fumble"),
        F.coalesce(wrate(c("sack") == 1, passed, wt), F.lit(d["sack"])).alias("sack"),
        F.coalesce(wrate(c("complete_pass") == 1, thrown, wt), F.lit(d["complete"])).alias("complete"),
        F.coalesce(wrate(c("interception") == 1, thrown, wt), F.lit(d["intercept"])).alias("intercept"),
        F.coalesce(wrate(c("fumble_lost") == 1, caught, wt), F.lit(d["pass_fumble"])).alias("pass_fumble"),
        or_default(wmean(c("yards_gained"), wt, caught), d["completion_mu"], d["pass_mu"]).alias("pass_mu"),
        or_default(wstd(c("yards_gained"), wt, caught), d["completion_sigma"], d["pass_sigma"]).alias("pass_sigma"),
        F.coalesce(wrate(c("out_of_bounds") == 1, run | passed, wt), F.lit(0.0)).alias("out_of_bounds"),
    )


def penalty_profile(plays: DataFrame, side: str, w: str) -> DataFrame:
    """Penalty share of a side's plays, and what the defence's penalties are made of."""
    c, wt, d = F.col, F.col(w), K.PROFILE_DEFAULTS
    own = F.coalesce((c("penalty") == 1) & (c("penalty_team") == c(side)), F.lit(False))
    interference = own & F.coalesce(F.lower("penalty_type").contains("pass interference"), F.lit(False))
    major = own & ~interference & F.coalesce(c("penalty_yards") == 15, F.lit(False))
    return plays.where(not_null([side])).groupBy(side).agg(
        wrate(own, F.lit(True), wt).alias("penalty_rate"),
        F.coalesce(wrate(interference, own, wt), F.lit(d["interference_share"])).alias("interference_share"),
        F.coalesce(wrate(major, own, wt), F.lit(d["major_share"])).alias("major_share"),
        F.coalesce(wmean(c("penalty_yards"), wt, interference), F.lit(d["interference_mu"])).alias("interference_mu"),
        F.coalesce(wstd(c("penalty_yards"), wt, interference), F.lit(d["interference_std"])).alias("interference_std"),
    )


def kicking_profile(plays: DataFrame, team: str, w: str) -> DataFrame:
    """Field-goal accuracy by distance, longest made, net punt mean and deviation."""
    c, wt, d = F.col, F.col(w), K.PROFILE_DEFAULTS
    goal, punt, made = c("play_type") == "field_goal", c("play_type") == "punt", c("field_goal_result") == "made"
    dist = c("kick_distance")
    net = F.coalesce(dist - F.coalesce(c("return_yards"), F.lit(0.0)), F.lit(d["net_punt"]))
    return plays.where(not_null([team]) & (goal | punt)).groupBy(team).agg(
        F.coalesce(F.max(F.when(goal & made, dist)), F.lit(d["longest_made"])).alias("longest_made"),
        F.coalesce(wrate(made, goal & (dist < 40), wt), F.lit(d["short_acc"])).alias("short_acc"),
        F.coalesce(wrate(made, goal & (dist >= 40) & (dist < 50), wt), F.lit(d["mid_acc"])).alias("mid_acc"),
        F.coalesce(wrate(made, goal & (dist >= 50), wt), F.lit(d["long_acc"])).alias("long_acc"),
        wmean(net, wt, punt).alias("punt_mu"),
        wstd(net, wt, punt).alias("punt_sigma"),
    )


def _scalar(df: DataFrame, value: Column) -> Column:
    """One number of the whole table, as a scalar subquery."""
    return df.select(value.alias("v")).scalar()


def ratio_to_total(df: DataFrame, key: str, x: Mapping[str, tuple[str, Column]], w: str) -> DataFrame:
    """Weighted mean per key over the weighted mean of all rows; 1 where a key has no rows."""
    wt = F.col(w)
    sums = []
    for n, (col, use) in x.items():
        ok = F.coalesce(use, F.lit(False)) & F.col(col).isNotNull()
        sums += [F.sum(F.when(ok, F.col(col) * wt)).alias(f"_{n}_s"), F.sum(F.when(ok, wt)).alias(f"_{n}_w")]
    cells = df.groupBy(key).agg(*sums)
    out = cells.where(not_null([key]))
    for n in x:
        league = _scalar(cells, F.sum(f"_{n}_s") / F.sum(f"_{n}_w"))
        out = out.withColumn(n, F.coalesce(F.col(f"_{n}_s") / F.col(f"_{n}_w") / league, F.lit(1.0)))
    return out.select(key, *x)


def shrunk_rate(df: DataFrame, key: str, hit: Column, prior_n: int = K.SHRINK_PRIOR, default: float = K.PROFILE_DEFAULTS["breakaway"]) -> DataFrame:
    """Hit rate pulled to the rate of all rows by ``prior_n`` average rows."""
    cells = df.groupBy(key).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count("*").alias("n"))
    league = F.coalesce(_scalar(cells, F.sum("hits") / F.sum("n")), F.lit(default))
    return cells.where(not_null([key])).withColumn("rate", (F.col("hits") + prior_n * league) / (F.col("n") + prior_n))


def pivot_mean(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long to wide with means; column names are ``<value>_<metric>`` and static."""
    sums = []
    for v in values:
        for m in metrics:
            sums.append(F.avg(F.when(F.col(col) == v, F.col(m))).alias(f"{v}_{m}"))
    return df.where(not_null(rows)).groupBy(*rows).agg(*sums)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, Spearman (average ranks), MAE, RMSE, both deviations and their ratio: one row.

    Spearman sums the ranks of ``a`` per value of ``b`` and multiplies them by that value's rank, so rows never
    meet the ranks of ``b``. Ranks are taken from their mean, which keeps the sums small.
    """
    both = nan_to_null(df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))).where(not_null(["_a", "_b"]))
    rank = F.col("n_upto") - F.col("n") / 2 - F.col("n_total") / 2
    ranks = running_totals(both, [], "_a", {"n": F.lit(1)}).select("_a", "n", rank.alias("_rank"))
    few = ranks.limit(HINTED_ROWS + 1).count() <= HINTED_ROWS
    met = both.join(F.broadcast(ranks.drop("n")) if few else ranks.drop("n"), "_a")
    sums = running_totals(met, [], "_b", {"n": F.lit(1), "_ranks": F.col("_rank")})
    square = _scalar(ranks, F.sum(F.col("n") * F.col("_rank") * F.col("_rank")))
    common = sums.agg(F.max("n_total").alias("_n"), F.sum(rank * F.col("_ranks")).alias("_ab"), F.sum(F.col("n") * rank * rank).alias("_bb"))
    spearman = common.select(F.when(F.col("_n") > 1, F.col("_ab") / F.sqrt(F.col("_bb") * square)).alias("v")).scalar()
    d = F.col("_a") - F.col("_b")
    return both.agg(
        F.corr("_a", "_b").alias("pearson"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.stddev_samp("_a").alias("std_a"),
        F.stddev_samp("_b").alias("std_b"),
        (F.stddev_samp("_a") / F.stddev_samp("_b")).alias("std_ratio"),
    ).select("pearson", spearman.alias("spearman"), "mae", "rmse", "std_a", "std_b", "std_ratio")


def percentiles(df: DataFrame, keys: Sequence[str], x: str, qs: Mapping[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, without a per-group value list."""
    cells = running_totals(df, keys, x, {"n": F.lit(1)})
    before = F.col("n_upto") - F.col("n")
    picks = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("n_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks.append(F.max(F.when((before <= low) & (low < F.col("n_upto")), F.col(x))).alias(f"_{name}_lo"))
        picks.append(F.max(F.when((before <= high) & (high < F.col("n_upto")), F.col(x))).alias(f"_{name}_hi"))
        picks.append(F.max(at - low).alias(f"_{name}_f"))
    got = cells.groupBy(*keys).agg(*picks) if keys else cells.agg(*picks)
    return got.select(
        *keys, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in qs]
    )


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    qs: Mapping[str, float] | None = None,
    lands: Sequence[int] = (3, 7),
) -> DataFrame:
    """Distribution summary of ``x`` per key."""
    qs = qs or {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}
    c = F.col(x)
    df = nan_to_null(df, [x])
    moments = df.where(not_null([*keys, x])).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.var_samp(c).alias("variance"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(F.when(c < 0, 1.0).otherwise(0.0)).alias("share_negative"),
        F.avg(F.when(c > 0, 1.0).otherwise(0.0)).alias("share_positive"),
        *[F.avg(F.when(F.abs(c) == v, 1.0).otherwise(0.0)).alias(f"share_{v}") for v in lands],
    )
    return moments.join(percentiles(df, keys, x, qs), list(keys))


def rollup_path(df: DataFrame, keys: Sequence[str], pick: str, order: str, products: Mapping[str, str]) -> DataFrame:
    """Picks of a path's week as a list, with the products of its measures.

    Groups are the one to three picks of one week of one path, so the list is short.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(pick).alias("p")))), lambda s: s["p"])
    return df.groupBy(*keys).agg(listed.alias("picks"), *[F.product(c).alias(n) for n, c in products.items()])


def alive_by_week(entries: DataFrame, keys: Sequence[str], wins: str, weeks: int, pools: DataFrame | None = None) -> DataFrame:
    """Entries alive at the start of each week: those with at least week-1 wins.

    Entries are first counted by wins, so only that small histogram is spread over weeks.
    ``pools`` (keys, entries) gives week 1.
    """
    by_wins = entries.where(not_null(keys)).groupBy(*keys, F.coalesce(F.col(wins), F.lit(0)).alias("_w")).agg(F.count("*").alias("_n"))
    spread = by_wins.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"), "_w", "_n")
    alive = spread.groupBy(*keys, "week").agg(F.sum(F.when(F.col("_w") >= F.col("week") - 1, F.col("_n")).otherwise(0)).alias("alive"))
    if pools is None:
        return alive
    size = pools.select(*keys, F.col("entries").alias("_pool"))
    joined = alive.join(size, list(keys), "left")
    return joined.select(*keys, "week", F.when((F.col("week") == 1) & F.col("_pool").isNotNull(), F.col("_pool")).otherwise(F.col("alive")).alias("alive"))


def pick_flow(grid: DataFrame, picks: DataFrame, alive: DataFrame, pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current and prior picks of alive entries, availability, pick % and remaining %.

    ``grid``: (keys, week, team); ``picks``: (keys, week, team, total_wins), one row per pick;
    ``alive``: (keys, week, alive); ``pools``: (keys, entries). Picks are counted by wins
    before they are spread over the later weeks in which their entry is still alive.
    """
    counts = picks.where(not_null([*keys, "week", "team"])).groupBy(
        *keys, "team", "week", F.coalesce("total_wins", F.lit(0)).alias("_w")
    ).agg(F.count("*").alias("_n"))
    last = grid.groupBy(*keys).agg(F.max("week").alias("_last"))
    lasting = F.least(F.col("_w") + 1, F.col("_last"))
    spread = counts.join(last, list(keys)).where(lasting >= F.col("week")).select(
        *keys, "team", "_n", F.col("week").alias("_at"), F.explode(F.sequence("week", lasting)).alias("week")
    )
    used = spread.groupBy(*keys, "team", "week").agg(
        F.sum(F.when(F.col("_at") == F.col("week"), F.col("_n")).otherwise(0)).alias("_now"),
        F.sum(F.when(F.col("_at") < F.col("week"), F.col("_n")).otherwise(0)).alias("_before"),
    )
    size = pools.select(*keys, F.col("entries").alias("_pool"))
    df = grid.join(used, [*keys, "team", "week"], "left").join(alive, [*keys, "week"], "left").join(size, list(keys), "left")
    now, before, n = F.coalesce("_now", F.lit(0)), F.coalesce("_before", F.lit(0)), F.coalesce("alive", F.lit(0))
    share = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    return df.select(
        *keys, "week", "team",
        n.alias("alive"), now.alias("current_picks"), before.alias("prior_picks"),
        share(n - before, n).alias("availability"),
        share(now, n).alias("pick_pct"),
        F.coalesce(share(n, F.col("_pool")), F.lit(0.0)).alias("remaining_pct"),
    )


def availability(picks: DataFrame, teams: DataFrame, week: int, keys: Sequence[str] = (), entry: str = "entry") -> DataFrame:
    """Share of the entries alive at ``week`` that never used the team in an earlier week."""
    alive = picks.where((F.col("total_wins") >= week - 1) & F.col(entry).isNotNull())
    pool = alive.select(*keys, entry).distinct()
    used = alive.where(F.col("week") < week).select(*keys, "team", entry).distinct()
    used = used.groupBy(*keys, "team").agg(F.count("*").alias("entries_used"))
    out = teams.join(used, [*keys, "team"], "left").withColumn("entries_used", F.coalesce("entries_used", F.lit(0)))
    if keys:
        out = out.join(pool.groupBy(*keys).agg(F.count("*").alias("alive")), list(keys))
    else:
        out = out.withColumn("alive", _scalar(pool, F.count("*")))
    left = F.col("alive") - F.col("entries_used")
    return out.where(F.col("alive") > 0).withColumn("availability", left / F.col("alive"))


def availability_by_week(picks: DataFrame, teams: DataFrame, weeks: int, keys: Sequence[str] = (), entry: str = "entry") -> DataFrame:
    """:func:`availability` at the start of every week at once: (keys, week, team), entries_used, alive, availability.

    An entry with W wins that first used a team in week f counts against it in the weeks f + 1 to W + 1. So entries are
    counted per (team, f, W), each count is added where its weeks begin and taken off where they end, and a
    running sum over the weeks gives all of them; no row is made per entry and week.
    """
    k = list(keys)
    own = picks.where(not_null([*k, entry]))
    wins = F.coalesce("total_wins", F.lit(0))
    first = own.where(not_null(["team", "week"])).groupBy(*k, entry, "team").agg(F.min("week").alias("_f"), F.max(wins).alias("_w"))
    cells = first.where("_f <= _w").groupBy(*k, "team", "_f", "_w").agg(F.count("*").alias("_n"))
    marks = F.array(F.struct(F.greatest(F.col("_f") + 1, F.lit(1)).alias("week"), F.col("_n").alias("_d")), F.struct((F.col("_w") + 2).alias("week"), (-F.col("_n")).alias("_d")))
    steps = cells.select(*k, "team", F.inline(marks)).groupBy(*k, "team", "week").agg(F.sum("_d").alias("_d"))
    grid = teams.select(*k, "team").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    sofar = cell_order([*k, "team"], "week")  # one row per week
    used = grid.join(steps, [*k, "team", "week"], "left").withColumn("entries_used", F.sum(F.coalesce("_d", F.lit(0))).over(sofar)).drop("_d")
    entries = own.groupBy(*k, entry).agg(F.max(wins).alias("total_wins"))
    alive = alive_by_week(entries, k, "total_wins", weeks)
    out = used.join(alive, [*k, "week"]).where("alive > 0")
    return out.withColumn("availability", (F.col("alive") - F.col("entries_used")) / F.col("alive"))


def region_summary(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.where(not_null([key])).groupBy(key).agg(F.count("*").alias("teams"), *[F.avg(c).alias(f"at_{c}") for c in cols])


def split_diff(df: DataFrame, key: str, zone: str, zones: Sequence[str], x: str, w: str, min_n: int = 2) -> DataFrame:
    """Weighted mean in each zone minus the overall one; null below ``min_n`` rows."""
    c, wt = F.col(x), F.col(w)
    base = wmean(c, wt)
    out = [base.alias("baseline")]
    for z in zones:
        here = F.col(zone) == z
        n = F.sum(F.when(here & c.isNotNull(), 1).otherwise(0))
        out.append(F.when(n >= min_n, wmean(c, wt, here) - base).alias(f"{z}_diff"))
    return df.where(not_null([key])).groupBy(key).agg(*out)


def weight_share(df: DataFrame, key: str, match: Column, w: str, x: str | None = None) -> DataFrame:
    """Share of the weight on matching rows; with ``x`` also its weighted mean (null counts 0)."""
    wt = F.col(w)
    out = [F.coalesce(wrate(match, F.lit(True), wt), F.lit(0.0)).alias("share")]
    if x:
        out.append(wmean(F.coalesce(F.col(x), F.lit(0.0)), wt).alias("historical"))
    return df.where(not_null([key])).groupBy(key).agg(*out)


def efficiency(df: DataFrame, key: str, num: Column, den: Column, min_den: float = K.MIN_VOLUME) -> DataFrame:
    totals = df.where(not_null([key])).groupBy(key).agg(F.sum(num).alias("value"), F.sum(den).alias("volume"))
    return totals.where(F.col("volume") > min_den).withColumn("efficiency", F.col("value") / F.col("volume"))


def home_split(edges: DataFrame, ratings: DataFrame) -> DataFrame:
    """Adjusted home and away level and half their difference, per team.

    ``edges``: team, opponent, net_epa, net_sr, weight, is_home; ``ratings``: team, epa, sr.
    A side a team never played falls back to its overall rating.
    """
    opp = ratings.select(F.col("team").alias("opponent"), F.col("epa").alias("_oe"), F.col("sr").alias("_os"))
    wt = F.col("weight")
    sides = []
    for name, here in (("home", F.col("is_home")), ("away", ~F.col("is_home"))):
        for m, net, o in (("epa", "net_epa", "_oe"), ("sr", "net_sr", "_os")):
            sides.append(wmean(F.col(net) + F.coalesce(o, F.lit(0.0)), wt, here).alias(f"_{name}_{m}"))
    got = edges.join(opp, "opponent", "left").groupBy("team").agg(*sides).join(ratings, "team", "left")
    he, hs = F.coalesce("_home_epa", "epa"), F.coalesce("_home_sr", "sr")
    ae, as_ = F.coalesce("_away_epa", "epa"), F.coalesce("_away_sr", "sr")
    return got.select(
        "team",
        rating.blend((he - ae) / 2, (hs - as_) / 2).alias("hfa_points"),
        rating.blend(he, hs).alias("home_rating"),
        rating.blend(ae, as_).alias("away_rating"),
        rating.blend(F.col("epa"), F.col("sr")).alias("global_rating"),
        ((he - ae) / 2).alias("hfa_epa"),
        ((hs - as_) / 2).alias("hfa_sr"),
    )


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def current_week(schedule: DataFrame, as_ofs: DataFrame, keys: Sequence[str], day: str, week: str, holidays: Sequence[str] = (), cap: int = 19) -> DataFrame:
    """Upcoming contest week at each ``as_of``: last week played + 1, one more per holiday
    passed, at most ``cap``; 1 before the first game. ``as_ofs``: keys, as_of, holiday dates."""
    days = schedule.where(not_null([*keys, day])).groupBy(*keys, day).agg(F.max(week).alias("_w"))
    asked = as_ofs.select(*keys, "as_of", *holidays)
    played = asked.join(days, list(keys)).where(F.col(day) <= F.col("as_of")).groupBy(*keys, "as_of").agg(F.max("_w").alias("_w"))
    passed = F.lit(0)
    for h in holidays:
        passed = passed + F.when(F.col("as_of") >= F.col(h), 1).otherwise(0)
    start = F.when(F.col("_w").isNull(), 1).otherwise(F.least(F.col("_w") + 1 + passed, F.lit(cap)))
    return asked.join(played, [*keys, "as_of"], "left").select(*keys, "as_of", start.alias("current_week"))


def as_of_weighted_mean(df: DataFrame, key: str, day: str, x: str, dates: Sequence[str], rate: float = K.DECAY_RATE) -> DataFrame:
    """Decayed weighted mean of every key as of every date, in one pass over the facts.

    A row counts for all dates from its own day on. Instead of copying rows per date, each
    row is summed once into the interval that ends at its first date; the few interval
    sums are then decayed from interval to interval.
    """
    marks = sorted(dates)
    stops = F.array(*[F.lit(d).cast("date") for d in marks])
    at = F.array_min(F.filter(stops, lambda s: s >= F.col(day)))
    first = F.lit(marks[0]).cast("date")
    weight = F.exp(-F.lit(rate) * F.datediff(at, F.col(day)))
    cells = (
        df.where(F.col(x).isNotNull() & (F.col(day) <= F.lit(marks[-1]).cast("date")))
        .groupBy(key, at.alias("as_of"))
        .agg(F.sum(F.col(x) * weight).alias("_wx"), F.sum(weight).alias("_w"))
    )
    # one row per key and date, whether or not the interval has rows
    grid = cells.select(key).distinct().select(key, F.explode(stops).alias("as_of"))
    full = grid.join(cells, [key, "as_of"], "left")
    growth = F.exp(F.lit(rate) * F.datediff("as_of", first))
    w = cell_order([key], "as_of")
    wx, ww = F.sum(F.coalesce("_wx", F.lit(0.0)) * growth).over(w), F.sum(F.coalesce("_w", F.lit(0.0)) * growth).over(w)
    return full.select(key, "as_of", F.when(ww > 0, wx / ww).alias("mean"), (ww / growth).alias("weight")).where(F.col("mean").isNotNull())
