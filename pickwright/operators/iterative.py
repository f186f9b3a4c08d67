"""Fixed-point ratings, opponent adjustment, pool recursion and capped shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.operators.rows import fan_out
from pickwright.operators.windows import weak_percentile
from pickwright.session import cut_lineage
from pickwright.skew import not_null


#: Passes of leagues whose squared pair tables take at most so many multiply-adds are composed by doubling,
#: and a pair table of at most so many rows goes to every task whole.
SQUARED, SENT = 8_000_000, 200_000


def iterative_rating(
    edges: DataFrame,
    node: str,
    opponent: str,
    values: Mapping[str, str],
    weight: str,
    multiplier: float,
    iterations: int,
    keys: Sequence[str] = (),
    cut_every: int = 8,
    squared: int = SQUARED,
) -> DataFrame:
    """Schedule-adjusted ratings: own weighted mean plus multiplier x opponents' ratings.

    All nodes move together, from 0, for exactly ``iterations`` passes: with a multiplier
    of 1 the result depends on the pass count. ``values`` is {out: net column}; the last
    opponent term is ``<out>_schedule``. Games are first summed per (node, opponent), so a
    pass joins and adds at most one row per pair, however many games there are.

    A pass is linear, so runs of passes are composed by doubling where the squares of the pair
    tables (nodes cubed, summed over the keys) stay under ``squared``; larger leagues go pass by pass.
    """
    k = list(keys)
    w = F.col(weight)
    pairs = (
        edges.where(not_null([*k, node, opponent]))
        .groupBy(*k, node, opponent)
        .agg(F.sum(w).alias("_w"), *[F.sum(F.col(c) * w).alias(f"_{n}") for n, c in values.items()])
    )
    own = pairs.groupBy(*k, node).agg(
        F.sum("_w").alias("_total"), *[(F.sum(f"_{n}") / F.sum("_w")).alias(f"_{n}_own") for n in values]
    )
    shares = cut_lineage(
        pairs.join(own, [*k, node]).select(
            *k, node, opponent, (F.col("_w") / F.col("_total")).alias("_share"), *[f"_{n}_own" for n in values]
        )
    )
    if iterations > 2 and multiplier != 0:
        sizes = shares.groupBy(*k, node).agg(F.count("*").alias("_p")).groupBy(*k).agg(F.count("*").cast("double").alias("_n"), F.sum("_p").alias("_p"))
        work, rows = sizes.agg(F.sum(F.pow("_n", F.lit(3.0))), F.sum(F.pow("_n", F.lit(2.0)))).first()
        if work is not None and work <= squared:
            return _by_doubling(shares, node, opponent, list(values), multiplier, iterations, k, rows <= SENT, 2 if work <= squared / 16 else 1)
    rated = shares.groupBy(*k, node).agg(
        *[F.first(f"_{n}_own").alias(n) for n in values], *[F.first(F.lit(0.0)).alias(f"{n}_schedule") for n in values]
    )
    for i in range(1, iterations):
        opp = rated.select(*k, F.col(node).alias(opponent), *[F.col(n).alias(f"_{n}_opp") for n in values])
        terms = {n: F.sum(F.col("_share") * F.coalesce(f"_{n}_opp", F.lit(0.0))) for n in values}
        rated = (
            shares.join(opp, [*k, opponent], "left")
            .groupBy(*k, node)
            .agg(
                *[(F.first(f"_{n}_own") + F.lit(multiplier) * t).alias(n) for n, t in terms.items()],
                *[t.alias(f"{n}_schedule") for n, t in terms.items()],
            )
        )
        if i % cut_every == 0 and i + 1 < iterations:
            rated = cut_lineage(rated)
    return rated


def _by_doubling(shares: DataFrame, node: str, opponent: str, names: Sequence[str], multiplier: float, iterations: int, k: list[str], small: bool, cut_every: int) -> DataFrame:
    """``iterations`` passes in as many joins as the number has binary digits and further ones.

    A run of passes is one table of (keys, node, part, other, x): part 0 is the matrix, which takes other nodes'
    ratings before the run, and part i is what the run adds to the i-th value. One join composes two runs.
    """
    wide = F.array(
        F.struct(F.lit(0).alias("_part"), F.col(opponent).alias("_other"), (F.lit(multiplier) * F.col("_share")).alias("_x")),
    )
    matrix = shares.select(*k, F.col(node).alias("_node"), F.inline(wide))
    nothing = F.lit(None).cast(shares.schema[opponent].dataType)
    parts = F.array(*[F.struct(F.lit(i).alias("_part"), nothing.alias("_other"), F.col(f"_{n}_own").alias("_x")) for i, n in enumerate(names, 1)])
    owns = shares.select(*k, F.col(node).alias("_node"), *[f"_{n}_own" for n in names]).distinct().select(*k, "_node", F.inline(parts))
    one = cut_lineage(matrix.unionByName(owns))

    def after(last: DataFrame, first: DataFrame, whole: bool) -> DataFrame:
        """The run ``first`` and then the run ``last``; without its matrix where no further run follows."""
        left = last.where("_part = 0").select(*k, "_node", F.col("_other").alias("_via"), F.col("_x").alias("_q"))
        right = (first if whole else first.where("_part > 0")).withColumnRenamed("_node", "_via")
        met = left.join(F.broadcast(right) if small else right, [*k, "_via"])
        moved = met.select(*k, "_node", "_part", "_other", (F.col("_q") * F.col("_x")).alias("_x"))
        return moved.unionByName(last.where("_part > 0")).groupBy(*k, "_node", "_part", "_other").agg(F.sum("_x").alias("_x"))

    # a digit doubles the run so far, and a one adds a pass to it
    steps = [double for digit in bin(iterations)[3:] for double in ([True, False] if digit == "1" else [True])]
    run = one
    for i, double in enumerate(steps, 1):
        run = after(run if double else one, run, i < len(steps))
        if i % cut_every == 0 or i == len(steps):
            run = cut_lineage(run)
    both = run.where("_part > 0").unionByName(one.where("_part > 0").withColumn("_part", -F.col("_part")))
    at = lambda i: F.sum(F.when(F.col("_part") == i, F.col("_x")))
    out = both.groupBy(*k, F.col("_node").alias(node))
    return out.agg(*[at(i).alias(n) for i, n in enumerate(names, 1)], *[((at(i) - at(-i)) / multiplier).alias(f"{n}_schedule") for i, n in enumerate(names, 1)])


def as_of_ratings(
    edges: DataFrame,
    node: str,
    opponent: str,
    values: Mapping[str, str],
    day: str,
    dates: Sequence[str],
    multiplier: float = K.SCHEDULE_MULTIPLIER,
    iterations: int = K.RATING_PASSES,
    history_days: int = K.HISTORY_DAYS,
    rate: float = K.DECAY_RATE,
) -> DataFrame:
    """Iterated ratings as of every date: one row per (as_of, node), from one pass over the games.

    A game's weight as of a date is exp(-rate x days), a factor of the game times a factor of the date, and the
    latter falls out of the shares. So games are summed once per (node, opponent, interval between any two window
    edges); a date adds up the intervals of its window, and all dates are solved together with ``as_of`` as key.
    """
    stops = sorted({str(d) for d in dates})
    ends = [(date.fromisoformat(d) - date(1970, 1, 1)).days for d in stops]
    bounds = sorted({e - history_days for e in ends} | {e + 1 for e in ends})  # an interval begins at each
    place = {b: i for i, b in enumerate(bounds, 1)}
    at = F.unix_date(F.col(day))
    cells = (
        edges.where(not_null([node, opponent, day]))
        .withColumns({"_cell": F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= at)), "_g": F.exp(F.lit(rate) * (at - ends[-1]))})
        .groupBy(node, opponent, "_cell")
        .agg(F.sum("_g").alias("_w"), *[F.sum(F.col(c) * F.col("_g")).alias(f"_{n}") for n, c in values.items()])
    )
    windows = F.array(*[
        F.struct(F.lit(d).cast("date").alias("as_of"), F.lit(place[e - history_days]).alias("lo"), F.lit(place[e + 1]).alias("hi")) for d, e in zip(stops, ends, strict=True)
    ])
    mine = F.filter(windows, lambda v: (v["lo"] <= F.col("_cell")) & (F.col("_cell") < v["hi"]))
    dated = cells.withColumn("_v", F.explode(mine)).withColumn("as_of", F.col("_v.as_of"))
    means = dated.select("as_of", node, opponent, "_w", *[(F.col(f"_{n}") / F.col("_w")).alias(n) for n in values])
    return iterative_rating(means, node, opponent, {n: n for n in values}, "_w", multiplier, iterations, ["as_of"])


def category_cells(
    df: DataFrame, categories: Mapping[str, Column], team: str, opponent: str, values: Mapping[str, str], weight: str, is_home: Column, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Sums of plays per (keys, category, team, opponent, ``_home``), and per keys over the plays themselves.

    The adjustment of a play depends on nothing finer than its cell, so every later step works on cells.
    """
    k = list(keys)
    w = F.col(weight)
    base = df.where(not_null([*k, team, opponent])).withColumn("_home", is_home)
    sums = [F.sum(w).alias("_w"), *[F.sum(F.col(c) * w).alias(f"_{n}") for n, c in values.items()]]
    cells = fan_out(base, categories).groupBy(*k, "category", team, opponent, "_home").agg(F.count("*").alias("_n"), *sums)
    # league means are over the plays, not over their categories
    return cells, base.groupBy(*k).agg(*sums)


def adjust_cells(
    cells: DataFrame, league: DataFrame, team: str, opponent: str, names: Sequence[str], keys: Sequence[str] = (),
    home_effect: Mapping[str, float] | None = None, min_weight: float = K.MIN_WEIGHTED_PLAYS,
) -> DataFrame:
    """Category means of both sides with the other side's deviation taken out, from :func:`category_cells`.

    Offence, defence, their counter-adjustments and percentiles all work on the cells.
    ``home_effect`` is subtracted at home and added away.
    """
    k = list(keys)
    effect = dict(home_effect or {})
    # read four times below, and far smaller than the plays
    cells = cut_lineage(cells)
    means = league.select(*k, *[(F.col(f"_{n}") / F.col("_w")).alias(f"_{n}_lg") for n in names])

    sides = []
    for side, me, them in (("Offense", team, opponent), ("Defense", opponent, team)):
        scout = cells.groupBy(*k, "category", them).agg(
            F.sum("_w").alias("_sw"), *[(F.sum(f"_{n}") / F.sum("_w")).alias(f"_{n}_opp") for n in names]
        )
        joined = cells.join(scout, [*k, "category", them])
        joined = joined.join(means, k) if k else joined.withColumns({f"_{n}_lg": means.select(f"_{n}_lg").scalar() for n in names})
        sums = []
        for n in names:
            shift = F.when(F.col("_sw") >= min_weight, F.col(f"_{n}_opp") - F.col(f"_{n}_lg")).otherwise(0.0)
            home = F.when(F.col("_home"), -effect.get(n, 0.0)).otherwise(effect.get(n, 0.0))
            sums.append((F.sum(F.col(f"_{n}") + F.col("_w") * (home - shift)) / F.sum("_w")).alias(n))
        sides.append(
            joined.groupBy(*k, "category", F.col(me).alias("team"))
            .agg(F.sum("_n").alias("plays"), F.sum("_w").alias("weight_score"), *sums)
            .where(F.col("weight_score") >= min_weight)
            .withColumn("side", F.lit(side))
        )
    out = cut_lineage(sides[0].unionByName(sides[1]))
    for n in names:
        out = weak_percentile(out, [*k, "category", "side"], n, f"{n}_pct", invert=F.col("side") == "Defense")
    return out


def opponent_adjusted(
    df: DataFrame,
    categories: Mapping[str, Column],
    team: str,
    opponent: str,
    values: Mapping[str, str],
    weight: str,
    is_home: Column,
    keys: Sequence[str] = (),
    home_effect: Mapping[str, float] | None = None,
    min_weight: float = K.MIN_WEIGHTED_PLAYS,
) -> DataFrame:
    """Category means of both sides with the other side's deviation taken out; ``values`` is {out: column}."""
    cells, league = category_cells(df, categories, team, opponent, values, weight, is_home, keys)
    return adjust_cells(cells, league, team, opponent, list(values), keys, home_effect, min_weight)


def anchored_sums(sums: DataFrame, anchors: Mapping[int, str], seasons_back: int, group: Sequence[str], names: Sequence[str], rate: float, season: str = "season") -> DataFrame:
    """Sums per (season, ``_at``, group) brought together per (rating_season, group), for windows that overlap.

    ``_at`` is the number of anchor dates before a play's day, and weights are as of the first anchor date
    (:func:`anchor_place`). An anchor's window holds its own and the ``seasons_back`` seasons before it, up to its
    date; its decay is one factor of all its cells, so no play is read or weighted twice.
    """
    stops = sorted(set(anchors.values()))
    windows = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(stops.index(d)).alias("last"), F.exp(F.lit(-rate) * F.datediff(F.lit(d).cast("date"), F.lit(stops[0]).cast("date"))).alias("f"))
        for s, d in sorted(anchors.items())
    ])
    mine = F.filter(windows, lambda a: (a["s"] >= F.col(season)) & (a["s"] <= F.col(season) + seasons_back) & (F.col("_at") <= a["last"]))
    dated = sums.withColumn("_v", F.explode(mine)).withColumn("rating_season", F.col("_v.s"))
    weighed = [F.sum(F.col(c) * F.col("_v.f")).alias(c) for c in ("_w", *[f"_{n}" for n in names])]
    counts = [F.sum("_n").alias("_n")] if "_n" in sums.columns else []
    return dated.groupBy("rating_season", *group).agg(*weighed, *counts)


def anchor_place(df: DataFrame, anchors: Mapping[int, str], day: str, rate: float) -> DataFrame:
    """Add ``_at`` and ``w`` for :func:`anchored_sums`."""
    stops = sorted(set(anchors.values()))
    before = F.size(F.filter(F.array(*[F.lit(d).cast("date") for d in stops]), lambda d: d < F.col(day)))
    return df.withColumns({"_at": before, "w": F.exp(F.lit(-rate) * F.datediff(F.lit(stops[0]).cast("date"), F.col(day)))})


#: A group of at most so many rows may be folded in one row.
FOLDED = 4096


def redistribute(df: DataFrame, keys: Sequence[str], x: str, cap: str, iterations: int = 15, out: str | None = None, folded: int = FOLDED) -> DataFrame:
    """Clamp shares over their cap and hand the excess to the rest in proportion.

    A pass multiplies every share that is under its cap by one factor per group, so the
    whole state of a group is its list of factors. Where no group has more than ``folded`` rows, a fold
    over the group's shares gives them all at once. Otherwise each pass replays them on the rows,
    sums the excess, and appends the next factor: no group is gathered, and the plan grows by one join per pass.
    """
    k = list(keys)
    # read twice, or once per pass
    rows = cut_lineage(df.where(not_null(k)).select(*k, F.col(x).alias("_x"), F.coalesce(cap, F.lit(0.0)).alias("_cap")))

    def replay(start: Column, limit: Column, factors: Column) -> Column:
        return F.aggregate(factors, start, lambda v, f: F.when(v > limit, limit).otherwise(v * f))

    largest = rows.groupBy(*k).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= folded:
        shares = F.collect_list(F.struct(F.coalesce("_x", F.lit(0.0)).cast("double").alias("v"), F.col("_cap").cast("double").alias("c")))
        factors = rows.groupBy(*k).agg(shares.alias("_r")).select(*k, _factors(F.col("_r"), iterations).alias("_f"))
    else:
        factors = rows.groupBy(*k).agg(F.first(F.expr("cast(array() as array<double>)")).alias("_f"))
        for _ in range(iterations):
            now = rows.join(factors, k).withColumn("_v", replay(F.col("_x"), F.col("_cap"), F.col("_f")))
            over = F.col("_v") > F.col("_cap")
            excess = F.sum(F.when(over, F.col("_v") - F.col("_cap")).otherwise(0.0))
            room = F.sum(F.when(over, 0.0).otherwise(F.col("_v")))
            step = F.when((excess > 0) & (room > 0), 1 + excess / room).otherwise(1.0)
            factors = now.groupBy(*k).agg(F.first("_f").alias("_f"), step.alias("_s"))
            factors = factors.select(*k, F.concat("_f", F.array("_s")).alias("_f"))
    limit = F.coalesce(F.col(cap), F.lit(0.0))
    done = F.least(replay(F.col(x), limit, F.col("_f")), limit)
    return df.join(factors, k, "left").withColumn(out or x, done).drop("_f")


def _factors(shares: Column, iterations: int) -> Column:
    """The factors of all passes over one group's list of (v, c)."""
    total = lambda vs, part: F.aggregate(vs, F.lit(0.0), lambda a, s: a + part(s))

    def advance(acc: Column, _: Column) -> Column:
        vs = acc["vs"]
        excess = total(vs, lambda s: F.when(s["v"] > s["c"], s["v"] - s["c"]).otherwise(0.0))
        room = total(vs, lambda s: F.when(s["v"] > s["c"], 0.0).otherwise(s["v"]))
        sums = F.array(F.struct(excess.alias("e"), room.alias("r")))
        step = F.transform(sums, lambda t: F.when((t["e"] > 0) & (t["r"] > 0), 1 + t["e"] / t["r"]).otherwise(1.0))
        # bound once, then used for every share
        moved = F.transform(step, lambda f: F.transform(vs, lambda s: F.struct(F.when(s["v"] > s["c"], s["c"]).otherwise(s["v"] * f).alias("v"), s["c"].alias("c"))))
        return F.struct(F.element_at(moved, 1).alias("vs"), F.concat(acc["f"], step).alias("f"))

    start = F.struct(shares.alias("vs"), F.expr("cast(array() as array<double>)").alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, advance, lambda acc: acc["f"])


def pool_projection(sides: DataFrame, pools: DataFrame, keys: Sequence[str], week: str = "week", team: str = "team") -> DataFrame:
    """Expected pool size, use and availability per (keys, week, team).

    ``sides``: keys, week, team, pick_pct, win (one row per team and week; more are summed);
    ``pools``: keys, entries. The pool size is a running product over the weeks. A team's use
    is folded over its weeks with both clamps; a season has few weeks, so the folded
    arrays stay short.
    """
    k = list(keys)
    cells = (
        sides.where(not_null([*k, week, team]))
        .groupBy(*k, week, team)
        .agg(F.sum(F.col("pick_pct") * F.col("win")).alias("_kept"))
    )
    weekly = cells.groupBy(*k, week).agg(F.sum("_kept").alias("_rate"))
    earlier = Window.partitionBy(*k).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    size = pools.select(*k, F.col("entries").cast("double").alias("_pool"))
    # a product of earlier rates; logs are not used because a rate may be 0
    sizes = weekly.join(size, k).withColumn("_s", F.col("_pool") * F.coalesce(F.product("_rate").over(earlier), F.lit(1.0)))
    teams = cells.select(*k, team).distinct()
    grid = teams.join(sizes, k).join(cells, [*k, week, team], "left")
    step = F.struct(
        F.col(week).alias("w"), F.col("_s").alias("s"), F.col("_rate").alias("r"), F.coalesce("_kept", F.lit(0.0)).alias("kept")
    )
    line = grid.groupBy(*k, team).agg(F.array_sort(F.collect_list(step)).alias("_line"))
    entry = "struct<w:int,s:double,used:double>"
    start = F.expr(f"named_struct('u', 0.0D, 'out', cast(array() as array<{entry}>))")

    def advance(acc: Column, st: Column) -> Column:
        survivors = st["s"] * st["r"]
        after = F.greatest(F.lit(0.0), F.least(st["kept"] * st["s"] + acc["u"] * st["r"], survivors))
        row = F.struct(st["w"].cast("int").alias("w"), st["s"].alias("s"), acc["u"].alias("used"))
        return F.struct(after.alias("u"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = line.select(*k, team, F.explode(F.aggregate("_line", start, advance, lambda a: a["out"])).alias("_o"))
    avail = (F.col("_o.s") - F.col("_o.used")) / F.col("_o.s")
    return folded.select(
        *k, F.col("_o.w").alias(week), team, F.col("_o.s").alias("entries"), F.col("_o.used").alias("used"),
        F.when(F.col("_o.s") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), avail))).alias("availability"),
    )


def impute_spread(games: DataFrame, spread: str, home_total: Column, away_total: Column) -> DataFrame:
    """Fill a missing line by the difference of the game-day ratings."""
    return games.withColumn("projected_spread", home_total - away_total).withColumn(spread, F.coalesce(spread, "projected_spread"))
