"""Sorts, top-k and set operations."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import GAMES, PICKS, PLAYS, TEAM_GAMES, games, picks, plays, table, team_games
from pickwright.operators import sets
from pickwright.operators.aggregates import weighted_mean


@case(
    "t1_global_order", "user_id:l mean:d3",
    "SELECT user_id, round_even(avg(value), 3) AS mean FROM events GROUP BY ALL ORDER BY mean DESC, user_id",
)
def t1(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    return sets.ordered(e, [F.desc("mean"), F.asc("user_id")], digits=3)


@case(
    "t2_top_k", "team:l gap:d",
    q(GAMES, TEAM_GAMES, "SELECT team, avg(line) FILTER (is_away) - avg(line) FILTER (NOT is_away) AS gap FROM tg GROUP BY ALL ORDER BY abs(gap) DESC, team LIMIT 5"),
)
def t2(spark, d):
    tg = team_games(spark, d).groupBy("team").agg(
        (F.avg(F.when(F.col("is_away"), F.col("line"))) - F.avg(F.when(~F.col("is_away"), F.col("line")))).alias("gap")
    )
    return sets.top_k(tg, [F.desc(F.abs("gap")), F.asc("team")], 5)


@case(
    "t3_top_per_group", "season:l home:l game_id:l total:d",
    q(GAMES, "SELECT season, home, game_id, total FROM games QUALIFY row_number() OVER (PARTITION BY season, home ORDER BY total DESC, game_id DESC) = 1"),
)
def t3(spark, d):
    g = games(spark, d).select("season", "home", "game_id", "total")
    return sets.top_per_group(g, ["season", "home"], [F.col("total"), F.col("game_id")])


@case("t4_chronological", "game_id:l day:t home:l", q(GAMES, "SELECT game_id, day, home FROM games ORDER BY day, game_id"))
def t4(spark, d):
    return sets.chronological(games(spark, d), "day", "game_id")


@case(
    "u1_union_sides", "game_id:l team:l is_away:b",
    q(GAMES, "SELECT game_id, home AS team, false AS is_away FROM games UNION ALL SELECT game_id, away, true FROM games"),
)
def u1(spark, d):
    g = games(spark, d)
    return sets.union_sides(
        g.select("game_id", F.col("home").alias("team"), F.lit(False).alias("is_away")),
        g.select(F.lit(True).alias("is_away"), F.col("away").alias("team"), "game_id"),
    )


@case(
    "u2_union_history", "home:l week:l tier:s",
    q(GAMES, "SELECT DISTINCT home, week, tier FROM games WHERE season < 1999 UNION SELECT DISTINCT home, week, NULL FROM games WHERE season >= 1998"),
)
def u2(spark, d):
    g = games(spark, d)
    return sets.union_history(g.where("season < 1999").select("home", "week", "tier"), g.where("season >= 1998").select("home", "week"))


@case(
    "u3_except_keys", "game_id:l",
    q(GAMES, "SELECT game_id FROM games WHERE game_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
)
def u3(spark, d):
    other = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("game_id"))
    return sets.except_keys(games(spark, d), other, ["game_id"])


@case(
    "u4_union_seasons", "season:l team:l x:d",
    q(GAMES, PLAYS, "SELECT season, team, sum(x * w) / sum(w) AS x FROM plays GROUP BY ALL"),
)
def u4(spark, d):
    return sets.union_seasons(plays(spark, d), "season", lambda df, season: weighted_mean(df, [season, "team"], {"x": "x"}, "w"))


@case(
    "u5_fill_from", "week:l team:l pct:d",
    q(PICKS, """SELECT coalesce(a.week, b.week) AS week, coalesce(a.team, b.team) AS team, coalesce(a.pct, b.pct) AS pct
      FROM (SELECT week, team, sum(CASE WHEN pool = 'click' THEN pct END) AS pct FROM picks GROUP BY ALL) a FULL JOIN (SELECT week + 1 AS week, team, sum(pct) AS pct FROM picks GROUP BY ALL) b
      ON a.week = b.week AND a.team = b.team"""),
)
def u5(spark, d):
    p = picks(spark, d)
    own = p.groupBy("week", "team").agg(F.sum(F.when(F.col("pool") == "click", F.col("pct"))).alias("pct"))
    before = p.groupBy((F.col("week") + 1).alias("week"), "team").agg(F.sum("pct").alias("pct"))
    return sets.fill_from(own, before, ["week", "team"], ["pct"])
