"""Plays to ratings: power ratings, home-field splits, zone splits, category strengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.functions import rating
from pickwright.operators import aggregates as A
from pickwright.operators.iterative import adjust_cells, anchor_place, anchored_sums, category_cells, iterative_rating
from pickwright.operators.joins import enrich, join_compare, pair_sides
from pickwright.operators.rows import filter_events, play_categories
from pickwright.session import cut_lineage

SCRIMMAGE = ["run", "pass"]
SPECIAL = ["punt", "field_goal", "kickoff", "extra_point"]


@dataclass(frozen=True)
class RatingParams:
    """What the three rating jobs do differently."""

    history_days: int = K.HISTORY_DAYS
    decay: float = K.DECAY_RATE
    passes: int = K.RATING_PASSES
    multiplier: float = K.SCHEDULE_MULTIPLIER
    game_cap: float = K.GAME_CAP
    cap_plays: bool = True
    competitive_only: bool = True
    not_null: Sequence[str] = field(default=("wp", "epa", "posteam", "defteam", "success"))


POWER = RatingParams()
HOME_FIELD = RatingParams(passes=K.SPLIT_PASSES, multiplier=K.SPLIT_MULTIPLIER)
ZONES = RatingParams(
    history_days=K.ZONE_HISTORY_DAYS, decay=K.ZONE_DECAY_RATE, passes=K.SPLIT_PASSES, multiplier=K.SPLIT_MULTIPLIER,
    game_cap=K.ZONE_GAME_CAP, cap_plays=False, competitive_only=False, not_null=("epa", "posteam", "defteam"),
)


def weighted_plays(plays: DataFrame, as_of: str, params: RatingParams = POWER) -> DataFrame:
    """Plays of the history window with their capped value ``x`` and weight ``w``."""
    end = F.lit(as_of).cast("date")
    kept = filter_events(
        plays, "wp" if params.competitive_only else None, kind="play_type", kinds=[*SCRIMMAGE, *SPECIAL],
        not_null=params.not_null, day="game_date", start=F.date_sub(end, params.history_days), as_of=end,
    )
    x = rating.winsorize(F.col("epa")) if params.cap_plays else F.col("epa")
    return kept.withColumns({"x": x, "w": rating.time_decay(F.col("game_date"), end, params.decay)})


def game_edges(weighted: DataFrame, params: RatingParams = POWER) -> DataFrame:
    """Both directions of every game with two sides: net value, net success rate, weight."""
    own = weighted.withColumn("is_home", F.coalesce(F.col("posteam") == F.col("home_team"), F.lit(False)))
    stats = A.game_stats(own, ["game_id", "posteam", "defteam", "is_home"], "x", "success", "w")
    nets = {"net_epa": ("total", lambda d: rating.damped_cap(d, params.game_cap)), "net_sr": ("rate", None)}
    return pair_sides(stats, "game_id", "posteam", ["weight", "is_home"], nets).withColumnRenamed("posteam", "team")


def solve(edges: DataFrame, params: RatingParams) -> DataFrame:
    return iterative_rating(
        edges, "team", "opponent", {"epa": "net_epa", "sr": "net_sr"}, "weight", params.multiplier, params.passes
    )


def passer_ratings(player_weeks: DataFrame, season: int, week: int) -> tuple[DataFrame, DataFrame]:
    """Efficiency per passer and volume per team, from weeks before the given one."""
    c = F.col
    past = player_weeks.where((c("position") == "QB") & ((c("season") < season) | ((c("season") == season) & (c("week") < week))))
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    past = past.withColumns({"_value": zero("passing_epa") + zero("rushing_epa"), "_volume": zero("attempts") + zero("sacks") + zero("carries")})
    per_player = A.efficiency(past, "player_name", c("_value"), c("_volume")).select(F.col("player_name").alias("qb"), F.col("efficiency").alias("qb_rating"))
    return per_player, A.mean_of_sums(past, ["team"], ["season", "week"], "_volume", "volume")


def power_ratings(plays: DataFrame, player_weeks: DataFrame, as_of: str, season: int, week: int, params: RatingParams = POWER) -> DataFrame:
    """One row per team: blended rating and its parts."""
    weighted = weighted_plays(plays, as_of, params)
    edges = cut_lineage(game_edges(weighted, params))
    ratings = solve(edges, params)
    passes = weighted.where(F.col("play_type") == "pass")
    game_qb = cut_lineage(A.mode_by(passes, ["game_id", "posteam"], "passer_player_name", out="qb").select("game_id", F.col("posteam").alias("team"), "qb"))
    last_game = A.latest_by(passes, ["posteam"], ["game_date", "game_id"], "game_id", out="game_id").withColumnRenamed("posteam", "team")
    starter = last_game.join(game_qb, ["game_id", "team"], "left").select("team", F.col("qb").alias("starter"))
    qb, volume = passer_ratings(player_weeks, season, week)

    history = edges.join(game_qb, ["game_id", "team"], "left").join(qb, "qb", "left").join(starter, "team", "left")
    share = A.weight_share(history, "team", F.col("qb") == F.col("starter"), "weight", "qb_rating")
    units = A.per_game_rate(
        weighted, "posteam", "defteam", "game_id", "x", "w", F.col("play_type").isin(SCRIMMAGE), F.col("play_type").isin(SPECIAL)
    )
    current = qb.select(F.col("qb").alias("starter"), F.col("qb_rating").alias("current_rating"))
    df = (
        ratings.join(starter, "team", "left").join(current, "starter", "left").join(share, "team", "left")
        .join(volume, "team", "left").join(units, "team", "left")
    )
    df = df.withColumn("qb_adj", rating.starter_adjustment(F.coalesce("current_rating", F.lit(0.0)), F.coalesce("historical", F.lit(0.0)), F.col("volume")))
    df = df.withColumn("epa_rating", F.col("epa") + F.col("qb_adj"))
    return df.select(
        "team", rating.power_rating(F.col("epa_rating"), F.col("sr")).alias("power_rating"), F.col("starter").alias("projected_qb"),
        F.col("share").alias("starter_weight"), "qb_adj", "epa_rating", rating.success_points(F.col("sr")).alias("sr_rating_pts"),
        F.col("epa_schedule").alias("strength_of_schedule"), (F.col("offense_per_game") + F.col("qb_adj")).alias("offense_per_game"),
        "defense_per_game", F.col("special_per_game"),
    )


def home_field(plays: DataFrame, as_of: str, params: RatingParams = HOME_FIELD) -> DataFrame:
    edges = cut_lineage(game_edges(weighted_plays(plays, as_of, params), params))
    return A.home_split(edges, solve(edges, params))


def zone_splits(plays: DataFrame, team_zones: DataFrame, as_of: str, zones: Sequence[str], params: RatingParams = ZONES) -> DataFrame:
    """Away form per host zone against the team's away form; ``team_zones``: team, zone."""
    edges = cut_lineage(game_edges(weighted_plays(plays, as_of, params), params))
    ratings = solve(edges, params).select(F.col("team").alias("opponent"), rating.blend(F.col("epa"), F.col("sr")).alias("_opp"))
    host = team_zones.select(F.col("team").alias("opponent"), F.col("zone").alias("host_zone"))
    away = edges.where(~F.col("is_home")).join(ratings, "opponent").join(host, "opponent", "left")
    away = away.withColumn("performance", rating.blend(F.col("net_epa"), F.col("net_sr")) + F.col("_opp"))
    split = A.split_diff(away, "team", "host_zone", zones, "performance", "weight")
    return split.join(team_zones.withColumnRenamed("zone", "origin_zone"), "team", "left")


def zone_report(splits: DataFrame, zones: Sequence[str]) -> DataFrame:
    return A.region_summary(splits, "origin_zone", [f"{z}_diff" for z in zones])


def compare_ratings(own: DataFrame, external: DataFrame, own_col: str = "power_rating", other_col: str = "rating") -> tuple[DataFrame, DataFrame]:
    """Agreement report (one row) and the joined list with absolute differences."""
    both = join_compare(own.select("team", own_col), external.select("team", other_col), ["team"])
    both = both.withColumn("difference", F.col(own_col) - F.col(other_col)).withColumn("abs_difference", F.abs("difference"))
    return A.agreement(both, own_col, other_col), both


def team_strengths(
    plays: DataFrame, anchors: Mapping[int, str], rosters: DataFrame | None = None, charting: DataFrame | None = None,
    seasons_back: int = 2, decay: float = K.DECAY_RATE,
) -> DataFrame:
    """Adjusted category strengths of every anchor season in one job.

    A season's window holds its own and the ``seasons_back`` seasons before it, up to its anchor date. Windows
    overlap, but plays are fanned out to their categories and summed once, per season and interval between anchor
    dates; the windows' sums are put together from those.
    """
    c = F.col
    kept = filter_events(plays, "wp", kind="play_type", kinds=SCRIMMAGE, not_null=["epa", "posteam", "defteam"])
    if charting is not None:
        kept = enrich(kept, charting, ["game_id", "play_id"])
    if rosters is not None:
        positions = rosters.select(c("gsis_id").alias("receiver_player_id"), c("position").alias("receiver_pos"))
        kept = enrich(kept, positions, ["receiver_player_id"])
    elif "receiver_pos" not in kept.columns:
        kept = kept.withColumn("receiver_pos", F.lit(None).cast("string"))
    values = {"epa": "epa", "sr": "success"}
    at_home = F.coalesce(c("posteam") == c("home_team"), F.lit(False))
    cells, league = category_cells(
        anchor_place(kept, anchors, "game_date", decay), play_categories(kept.columns), "posteam", "defteam", values, "w", at_home, ["season", "_at"]
    )
    group = ["category", "posteam", "defteam", "_home"]
    return adjust_cells(
        anchored_sums(cells, anchors, seasons_back, group, list(values), decay), anchored_sums(league, anchors, seasons_back, [], list(values), decay),
        "posteam", "defteam", list(values), ["rating_season"], {"epa": K.HOME_EPA},
    )


def strengths_wide(strengths: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per (season, team): ``Off_<category>_EPA_Pct`` and so on."""
    side = F.when(F.col("side") == "Offense", "Off").otherwise("Def")
    named = strengths.withColumn("_c", F.concat_ws("_", side, "category")).withColumnsRenamed(
        {"epa_pct": "EPA_Pct", "sr_pct": "SR_Pct", "epa": "EPA_Adj", "sr": "SR_Adj", "rating_season": "season"}
    )
    values = [f"{s}_{c}" for s in ("Off", "Def") for c in categories]
    return A.pivot_mean(named, ["season", "team"], "_c", values, ["EPA_Pct", "SR_Pct", "EPA_Adj", "SR_Adj"])
