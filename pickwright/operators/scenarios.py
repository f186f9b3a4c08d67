"""Expected value over all outcomes of a week, and hash-seeded outcome trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwright.operators.aggregates import percentiles
from pickwright.operators.draws import summed_draws
from pickwright.operators.nodes import NODE_HIGH, STEP, log_sums, values
from pickwright.operators.rows import to_team_long
from pickwright.session import cut_lineage
from pickwright.skew import add_group_stats, not_null, spread, tasks

# nodes of a usual group
NODES = 100
# games of one list, and pairs of a game and a node in one task
LIST, PAIRS = 1000, 2_000_000


def expand_outcomes(games: DataFrame, group: Sequence[str], game: str, limit: int = 16) -> DataFrame:
    """Every game of a group times every outcome index of the group: 2^n scenarios.

    For listing scenarios of small groups. A group above ``limit`` games fails the job
    rather than being cut; :func:`scenario_ev` handles any size without this listing.
    """
    sized = add_group_stats(games, group, {"_n": F.count("*")})
    checked = sized.withColumn(
        "_n", F.when(F.col("_n") <= limit, F.col("_n")).otherwise(F.raise_error(F.lit(f"more than {limit} games in a group")))
    )
    # within a group of at most ``limit`` rows
    place = F.row_number().over(Window.partitionBy(*group).orderBy(game)) - 1
    last = F.pow(F.lit(2.0), F.col("_n")).cast("long") - 1
    out = checked.withColumn("_i", place).withColumn("scenario", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first_wins = F.expr("(shiftright(scenario, _i) & 1) = 0")
    return out.withColumn("first_wins", first_wins).drop("_n", "_i")


def scenario_ev(
    games: DataFrame, group: Sequence[str], game: str, team_a: str, team_b: str, p_a: str, p_b: str | None, pick_a: str, pick_b: str
) -> DataFrame:
    """Expected value of every team: mean over all outcomes of 1 / (shares still alive) if it wins.

    The mean over 2^n outcomes is computed to about 12 digits in time linear in n, so no group
    is too large: 1/S is an integral of exp(-S*t), and for fixed t the outcomes of different
    games factorise. Per node t the group needs the sum of log(p e^-at + q e^-bt) over its
    games; a team's value is then a sum over the nodes. An outcome
    that leaves nobody alive counts 0, and so does every team of a group in which no side has a share.

    Games are listed by (group, hash), about ``LIST`` a list, and the lists are checkpointed: the input is not read
    again, a group of any size is many lists, and only one row of sums per list is shuffled between the two steps.
    """
    g = list(group)
    pa = F.col(p_a)
    pb = F.col(p_b) if p_b else 1 - pa
    rows = games.where(not_null([*g, game])).select(
        *g, game, F.col(team_a).alias("_ta"), F.col(team_b).alias("_tb"),
        F.when(pa + pb > 0, pa / (pa + pb)).otherwise(0.0).alias("_p"),
        F.when(pa + pb > 0, pb / (pa + pb)).otherwise(0.0).alias("_q"),
        F.coalesce(pick_a, F.lit(0.0)).cast("double").alias("_a"), F.coalesce(pick_b, F.lit(0.0)).cast("double").alias("_b"),
    )
    tiny = F.least(F.when(F.col("_a") > 0, F.col("_a")), F.when(F.col("_b") > 0, F.col("_b")))
    # the chance that the game's winner has no share at all
    dead = F.when(F.col("_a") == 0, F.col("_p")).otherwise(0.0) + F.when(F.col("_b") == 0, F.col("_q")).otherwise(0.0)
    span = rows.groupBy(*g).agg(
        F.min(tiny).alias("_small"), F.sum(F.greatest("_a", "_b")).alias("_scale"),
        F.sum(F.when(dead > 0, F.log(dead)).otherwise(0.0)).alias("_dead_log"), F.sum(F.when(dead > 0, 0).otherwise(1)).alias("_safe"),
        F.ceil(F.count("*") / LIST).alias("_lists"),
    ).withColumn("_to", F.ceil((F.lit(NODE_HIGH) + F.log(F.col("_scale") / F.col("_small"))) / STEP).cast("int"))
    others_dead = F.when(
        F.col("_safe") - F.when(dead > 0, 0).otherwise(1) == 0,
        F.exp(F.col("_dead_log") - F.when(dead > 0, F.log(dead)).otherwise(0.0)),
    ).otherwise(0.0)
    # a group without any share is left unscaled
    scale = F.when(F.col("_to").isNotNull(), F.col("_scale")).otherwise(1.0)
    placed = rows.join(span, g).withColumn("_gone", others_dead).withColumns({
        "_scale": scale, "_a": F.col("_a") / scale, "_b": F.col("_b") / scale, "_list": F.pmod(F.xxhash64(game), F.col("_lists")),
    })
    at = [*g, "_list"]
    dealt = placed.repartition(tasks(rows, NODES, PAIRS), *at)
    listed = F.collect_list(F.struct(F.col(game).alias("_game"), "_ta", "_tb", "_a", "_b", "_p", "_q", "_gone"))
    lists = cut_lineage(dealt.groupBy(*at, "_lists", "_to", "_scale").agg(listed.alias("_games")))
    schema = lambda cols, made: T.StructType([*cols, *T._parse_datatype_string(made)])
    shared = lists.where(F.col("_to").isNotNull()).select(*g, "_lists", "_to", "_games")
    sums = shared.mapInArrow(log_sums, schema(shared.drop("_games").schema, "_sums array<double>"))
    logs = (
        sums.select(*g, "_lists", F.posexplode("_sums").alias("_x", "_l"))
        .groupBy(*g, "_lists", "_x").agg(F.sum("_l").alias("_l"))
        .groupBy(*g, "_lists").agg(F.transform(F.array_sort(F.collect_list(F.struct("_x", "_l"))), lambda n: n["_l"]).alias("_logs"))
    )
    # one row for every list of the group, so that no group is joined in one task
    logs = logs.select(*g, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lists") - 1)).alias("_list"), "_logs")
    again = lists.join(logs, at, "left").select(*g, "_to", "_scale", "_logs", "_games")
    game_type = lists.schema["_games"].dataType.elementType
    plain = ["_game", "_ta", "_tb"]
    made = schema([*again.select(*g).schema, *[game_type[c] for c in plain]], "_ea double, _eb double")
    valued = again.mapInArrow(values(g, plain), made).withColumnRenamed("_game", game)
    return to_team_long(valued, [*g, game], {"team": ("_ta", "_tb"), "ev": ("_ea", "_eb")}).select(*g, game, "team", "ev")


def scenario_ev_pairs(
    games: DataFrame, group: Sequence[str], game: str, team_a: str, team_b: str, p_a: str, p_b: str | None, pick_a: str, pick_b: str
) -> DataFrame:
    """Two-pick value: sum over partners in other games of P(both win) / (pick x pick).

    Different games are independent, so the sum over partners is the group's total of
    p/pick less the own game's: two aggregations, and no pair is ever formed.
    """
    g = list(group)
    pa = F.col(p_a)
    pb = F.col(p_b) if p_b else 1 - pa
    ratio = lambda p, k: F.coalesce(F.when((k > 0) & (pa + pb > 0), p / (pa + pb) / k), F.lit(0.0))
    rows = games.withColumns({"_ra": ratio(pa, F.col(pick_a)), "_rb": ratio(pb, F.col(pick_b))})
    own = rows.withColumn("_g", F.col("_ra") + F.col("_rb"))
    total = add_group_stats(own, g, {"_t": F.sum("_g")})
    rest = F.col("_t") - F.col("_g")
    valued = total.withColumns({"_ea": F.col("_ra") * rest, "_eb": F.col("_rb") * rest})
    return to_team_long(valued, [*g, game], {"team": (team_a, team_b), "ev": ("_ea", "_eb")}).select(*g, game, "team", "ev")


# bits of the md5 that make one uniform number
BITS = 52
# draws of one task, about a second of work
DRAWS = 4_000_000


def outcome_trials(
    games: DataFrame, pools: Sequence[str], week: str, game: str, p: str, pick_a: str, pick_b: str, trials: int, seed: int
) -> DataFrame:
    """Share of the pool alive after each week, per trial.

    Every (trial, game) gets one winner from md5("trial-game-seed"), which any engine can
    reproduce; a week keeps the pick shares on winners (picks are
    shares of the week's total). Games are dealt in order of their weeks, so a task holds few weeks
    and only (trial, pool, week) sums leave it. The sums are checkpointed: the draws are made once.
    """
    k = [*pools, week]
    chance = F.coalesce(p, F.lit(0.5))
    # a whole number is below the bound where its uniform number is below the chance
    bound = F.when(chance >= 1, F.lit(2**BITS)).otherwise(F.ceil(chance * F.lit(float(2**BITS))).cast("long"))
    asked = spread(games.where(not_null([*k, game])), *k, game, work=trials, made=DRAWS, in_order=True).select(
        *k, F.concat(F.lit("-"), F.col(game).cast("string"), F.lit(f"-{seed}")).alias("_tail"), bound.alias("_bound"),
        F.coalesce(F.col(pick_a).cast("double"), F.lit(0.0)).alias("_a"), F.coalesce(F.col(pick_b).cast("double"), F.lit(0.0)).alias("_b"),
    )
    made = T.StructType([*asked.select(*k).schema, T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_all", T.DoubleType())])
    drawn = asked.mapInPandas(summed_draws(k, trials), made).select(*k, "_all", F.posexplode("_sums").alias("trial", "_sum"))
    kept = cut_lineage(
        drawn.groupBy("trial", *k).agg(F.sum("_sum").alias("_kept"), F.sum("_all").alias("_all")).where(F.col("_all") > 0)
    )
    # one row per week of a season in each partition
    sofar = Window.partitionBy("trial", *pools).orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    rate = kept.withColumn("rate", F.col("_kept") / F.col("_all"))
    return rate.select("trial", *k, "rate", F.product("rate").over(sofar).alias("alive_share"))


def trial_summary(trials: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    moments = trials.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    return moments.join(percentiles(trials, keys, x, {"median": 0.5}), list(keys))
