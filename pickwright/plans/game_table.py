"""Schedule, ratings and prices to one feature row per game side.

Most operators read their input twice (a summary, and the join of it back to the rows), so
a chain of them doubles its plan per step. Every stage below therefore ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.functions import calendar, geo, odds, rating
from pickwright.operators import joins, rows, windows
from pickwright.operators.iterative import impute_spread
from pickwright.session import cut_lineage

TEAM = ["season", "team"]


def schedule_sides(schedule: DataFrame, teams: DataFrame, venues: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Two rows per game with rest, sequence, travel and zone features.

    ``schedule``: game_id, season, week, day, kickoff (UTC timestamp), home_team, away_team, venue.
    ``teams``: team, stadium, lat, lon, tz, division. ``venues``: venue, venue_lat, venue_lon, venue_tz.
    """
    if cutoffs is not None:
        schedule = joins.shift_weeks(schedule, cutoffs, "season", "day", "week", "_w").drop("week").withColumnRenamed("_w", "week")
    placed = schedule.join(venues, "venue", "left")
    last = schedule.groupBy("season").agg(F.max("week").alias("last_week"))
    shared = ["game_id", "season", "week", "day", "kickoff", "venue", "venue_lat", "venue_lon", "venue_tz"]
    long = rows.to_team_long(placed, shared, {"team": ("home_team", "away_team")}).join(last, "season")
    long = cut_lineage(windows.neighbors(cut_lineage(long), TEAM, "day", "game_id", "week", "opp_team", "venue", "last_week"))
    long = windows.rest_days(long, TEAM, "day", "game_id", default=0)
    long = cut_lineage(windows.prev_value(long, TEAM, "day", "game_id", "venue_tz", "previous_tz"))
    long = windows.opponent_rest(long, "game_id", "team", "opp_team")
    long = cut_lineage(windows.running_advantage(long, TEAM, "day", "rest_adv"))
    long = windows.count_in_days(long, TEAM, "day", {"three_in_10": (10, 3), "four_in_17": (17, 4)})
    long = cut_lineage(windows.back_to_back(long, TEAM, "day", "game_id", "week", "is_away"))
    long = joins.lookup_sides(long, teams, "team", ["stadium", "lat", "lon", "tz", "division"], "team", "opp_team")
    # lookup_sides names the two roles home_ and away_; here they are own and opponent
    own = {c: c.replace("home_", "own_", 1) for c in long.columns if c.startswith("home_")}
    opp = {c: c.replace("away_", "opp_", 1) for c in long.columns if c.startswith("away_")}
    long = long.withColumnsRenamed(own | opp)
    c = F.col
    miles = {s: geo.great_circle_miles(c(f"{s}_lat"), c(f"{s}_lon"), c("venue_lat"), c("venue_lon")) for s in ("own", "opp")}
    long = long.withColumns({"travel": miles["own"], "opp_travel": miles["opp"]})
    change = geo.adjusted_zone_change(
        geo.zone_hours(c("kickoff"), c("own_tz"), c("venue_tz")), c("previous_tz"), c("venue_tz"), c("venue"), c("own_stadium")
    )
    long = long.withColumns(
        {
            "travel_adv": c("opp_travel") - c("travel"), "zone_change": change,
            "divisional": F.coalesce(c("own_division") == c("opp_division"), F.lit(False)),
            "at_home_venue": F.when(c("is_away"), c("opp_stadium") == c("venue")).otherwise(c("own_stadium") == c("venue")),
            "venues_differ": c("own_stadium") != c("opp_stadium"),
        }
    )
    other = long.select("game_id", c("team").alias("opp_team"), c("zone_change").alias("opp_zone_change"), c("travel_adv").alias("opp_travel_adv"))
    long = long.join(other, ["game_id", "opp_team"], "left")
    return cut_lineage(long.withColumn("zone_adv", geo.zone_advantage(c("zone_change"), c("opp_zone_change"))))


def rated_sides(sides: DataFrame, ratings: DataFrame, name: str, params: rating.AdjustmentParams = rating.CURRENT) -> DataFrame:
    """Raw and game-day ratings of one source. ``ratings``: team, rating, home_points, away_points."""
    got = ratings.select("team", F.col("rating").alias(f"{name}_rating"), "home_points", "away_points")
    df = sides.join(got, "team", "left")
    c = F.col

    def adjust(is_home: bool) -> Column:
        away_travel = c("opp_travel_adv") if is_home else c("travel_adv")
        points = c("home_points") if is_home else c("away_points")
        return rating.adjusted_rating(
            c(f"{name}_rating"), away_travel, c("at_home_venue"), c("zone_adv"), c("rest_adv"), c("season_rest_adv"), points,
            c("venues_differ"), is_home, params,
        )

    df = df.withColumn(f"{name}_adjusted", F.when(c("is_away"), adjust(False)).otherwise(adjust(True))).drop("home_points", "away_points")
    df = joins.opponent_value(df, ["game_id"], "team", "opp_team", f"{name}_adjusted")
    df = joins.opponent_value(df, ["game_id"], "team", "opp_team", f"{name}_rating")
    return cut_lineage(df).withColumns(
        {
            f"{name}_edge": c(f"{name}_rating") - c(f"opponent_{name}_rating"),
            f"{name}_adjusted_edge": c(f"{name}_adjusted") - c(f"opponent_{name}_adjusted"),
        }
    )


def model_fair_odds(sides: DataFrame, name: str) -> DataFrame:
    """Fair win chance implied by a rating source's game-day edge."""
    df = sides.withColumns({"_line": F.col(f"{name}_adjusted_edge"), "_own": F.lit(None).cast("int"), "_opp": F.lit(None).cast("int")})
    df = joins.nearest_lookup(df, "_line", "_own", "_opp")
    own, opp = odds.implied_probability(F.col("_own")), odds.implied_probability(F.col("_opp"))
    return df.withColumn(f"{name}_fair", odds.fair_probability(own, opp)).withColumnRenamed("_own", f"{name}_price").drop("_line", "_opp")


def priced_sides(sides: DataFrame, book: DataFrame, sources: list[str]) -> DataFrame:
    """Book prices first, then the rating sources in order; advantage, outlook and stars.

    ``book``: game_id, home_price, away_price, home_spread (prices already overlaid with live ones).
    """
    c = F.col
    b = book.select("game_id", c("home_price").alias("_hp"), c("away_price").alias("_ap"), c("home_spread").alias("_hs"))
    df = sides.join(b, "game_id", "left").withColumns(
        {
            "book_price": F.when(c("is_away"), c("_ap")).otherwise(c("_hp")), "_other": F.when(c("is_away"), c("_hp")).otherwise(c("_ap")),
            "book_spread": F.when(c("is_away"), -c("_hs")).otherwise(c("_hs")),
            "book_favorite": odds.favorite(c("_hp"), F.when(c("is_away"), c("opp_team")).otherwise(c("team")), F.when(c("is_away"), c("team")).otherwise(c("opp_team"))),
        }
    )
    fair = odds.fair_probability(odds.implied_probability(c("book_price")), odds.implied_probability(c("_other")))
    df = df.withColumn("book_fair", fair).drop("_hp", "_ap", "_hs", "_other")
    for s in sources:
        df = model_fair_odds(df, s)
    df = rows.coalesce_sources(df, {"book": "book_fair"} | {s: f"{s}_fair" for s in sources}, "win", "win_source")
    favorites = {"book": c("book_favorite")} | {
        s: F.when(c(f"{s}_adjusted_edge") > 0, c("team")).when(c(f"{s}_adjusted_edge") < 0, c("opp_team")) for s in sources
    }
    df = rows.coalesce_sources(df, favorites, "favorite", "favorite_source")
    df = df.withColumn("win_adv", odds.win_advantage(c("win")))
    df = windows.future_mean(cut_lineage(df), TEAM, "week", "win_adv", out="outlook")
    return cut_lineage(windows.minmax_stars(df, ["season", "week"], "outlook"))


def holiday_sides(sides: DataFrame, holidays: dict[str, int]) -> DataFrame:
    """Flags for teams of a holiday week and for their earlier weeks; Thursday flags."""
    c = F.col
    df = sides
    for name, week in holidays.items():
        held = sides.where((c("week") == week) & c("favorite").isNotNull())
        for role, is_role in (("favorite", c("favorite") == c("team")), ("underdog", c("favorite") != c("team"))):
            members = held.where(is_role).select("season", "team")
            df = joins.mark_members(df, members, TEAM, f"{name}_{role}", c("week") <= week)
        either = (c(f"{name}_favorite") == 1) | (c(f"{name}_underdog") == 1)
        df = df.withColumn(f"pre_{name}", (either & (c("week") < week)).cast("int"))
    season = c("season")
    off = [calendar.thanksgiving(season), F.make_date(season, F.lit(12), F.lit(25)), F.make_date(season, F.lit(12), F.lit(26))]
    return rows.calendar_flags(df, "day", "is_away", "win", off)


def build_game_table(
    schedule: DataFrame, teams: DataFrame, venues: DataFrame, sources: dict[str, DataFrame], book: DataFrame, live: DataFrame | None = None,
    cutoffs: DataFrame | None = None, holidays: dict[str, int] | None = None, picks: DataFrame | None = None,
) -> DataFrame:
    """The whole feature table, two rows per game.

    ``sources`` are rating tables in order of trust; ``live`` overwrites ``book`` prices by
    game_id; ``picks`` (season, week, team, pick_pct) adds the public's share.
    """
    sides = schedule_sides(schedule, teams, venues, cutoffs)
    for name, table in sources.items():
        sides = rated_sides(sides, table, name)
    names = list(sources)
    sides = rows.all_positive(sides, [F.col(f"{n}{k}") for n in names for k in ("_edge", "_adjusted_edge")], "consensus")
    if live is not None:
        book = joins.overlay(book, live, ["game_id"], ["home_price", "away_price", "home_spread"])
    sides = holiday_sides(priced_sides(sides, book, names), holidays or {})
    if picks is not None:
        sides = sides.join(picks.select("season", "week", "team", "pick_pct"), ["season", "week", "team"], "left")
    return sides


def imputed_schedule(schedule: DataFrame, sides: DataFrame, name: str) -> DataFrame:
    """Missing lines from the game-day ratings, then missing prices from the lines."""
    pick = lambda away, p: sides.where(F.col("is_away") == F.lit(away)).select("game_id", F.col(f"{name}_adjusted").alias(p))
    df = schedule.join(pick(False, "_h"), "game_id", "left").join(pick(True, "_a"), "game_id", "left")
    df = impute_spread(df, "spread_line", F.col("_h"), F.col("_a")).drop("_h", "_a")
    return joins.nearest_lookup(df, "spread_line", "home_moneyline", "away_moneyline")
