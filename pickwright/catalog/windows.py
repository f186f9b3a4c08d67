"""Ordered and group-relative operators."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import GAMES, PICKS, TEAM_GAMES, picks, table, team_games
from pickwright.operators import windows

KEYS = ["season", "team"]
REST = "r AS (SELECT tg.*, coalesce(date_diff('day', lag(day) OVER (PARTITION BY season, team ORDER BY day, game_id), day), 7) AS rest FROM tg)"
ADV = "o AS (SELECT r.*, r2.rest AS opp_rest, r.rest - r2.rest AS rest_adv FROM r JOIN r r2 ON r.game_id = r2.game_id AND r.opp = r2.team)"


@case(
    "w1_rest_days", "game_id:l team:l rest:l daily_rest:l",
    q(GAMES, TEAM_GAMES, REST, """SELECT game_id, team, rest, coalesce(date_diff('day', lag(day) OVER (PARTITION BY team ORDER BY day, game_id), day), 0) AS daily_rest FROM r"""),
)
def w1(spark, d):
    tg = windows.rest_days(team_games(spark, d), KEYS, "day", "game_id", 7)
    return windows.rest_days(tg, ["team"], "day", "game_id", 0, out="daily_rest")


@case(
    "w2_running_rest", "game_id:l team:l rest_adv:l season_rest_adv:l",
    q(GAMES, TEAM_GAMES, REST, ADV, "SELECT *, sum(rest_adv) OVER (PARTITION BY season, team ORDER BY day) AS season_rest_adv FROM o"),
)
def w2(spark, d):
    tg = windows.rest_days(team_games(spark, d), KEYS, "day", "game_id", 7)
    tg = windows.opponent_rest(tg, "game_id", "team", "opp")
    return windows.running_advantage(tg, KEYS, "day", "rest_adv")


def _label(fn: str, col: str, end: str, label: str, alias: str) -> str:
    return f"CASE WHEN {end} THEN '{label}' ELSE coalesce(CAST({fn}({col}) OVER w AS VARCHAR), 'BYE') END AS {alias}"


@case(
    "w3_neighbors", "game_id:l team:l previous_opponent:s previous_venue:s next_opponent:s next_venue:s",
    q(GAMES, TEAM_GAMES, f"""SELECT game_id, team, {_label('lag', 'opp', 'week = 1', 'Preseason', 'previous_opponent')}, {_label('lag', 'venue', 'week = 1', 'Preseason', 'previous_venue')},
      {_label('lead', 'opp', 'week = last_week', 'Playoffs?', 'next_opponent')}, {_label('lead', 'venue', 'week = last_week', 'Playoffs?', 'next_venue')}
      FROM (SELECT *, max(week) OVER (PARTITION BY season) AS last_week FROM tg) WINDOW w AS (PARTITION BY season, team ORDER BY day, game_id)"""),
)
def w3(spark, d):
    tg = team_games(spark, d)
    tg = tg.join(tg.groupBy("season").agg(F.max("week").alias("last_week")), "season")
    return windows.neighbors(tg, KEYS, "day", "game_id", "week", "opp", "venue", "last_week")


@case(
    "w4_previous_venue", "game_id:l team:l previous:l shift:l",
    q(GAMES, TEAM_GAMES, "SELECT game_id, team, lag(venue) OVER w AS previous, lag(venue) OVER w % 4 - venue % 4 AS shift FROM tg WINDOW w AS (PARTITION BY season, team ORDER BY day, game_id)"),
)
def w4(spark, d):
    tg = windows.prev_value(team_games(spark, d), KEYS, "day", "game_id", "venue", "previous")
    return tg.withColumn("shift", F.col("previous") % 4 - F.col("venue") % 4)


@case(
    "w5_games_in_days", "game_id:l team:l three_in_10:b three_in_10_count:l four_in_17:b four_in_17_count:l",
    q(GAMES, TEAM_GAMES, """SELECT game_id, team, count(*) OVER a AS three_in_10_count, count(*) OVER a >= 3 AS three_in_10, count(*) OVER b AS four_in_17_count, count(*) OVER b >= 4 AS four_in_17
      FROM tg WINDOW a AS (PARTITION BY season, team ORDER BY day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY season, team ORDER BY day RANGE BETWEEN INTERVAL 17 DAY PRECEDING AND CURRENT ROW)"""),
)
def w5(spark, d):
    return windows.count_in_days(team_games(spark, d), KEYS, "day", {"three_in_10": (10, 3), "four_in_17": (17, 4)})


@case(
    "w6_back_to_back_away", "game_id:l team:l back_to_back:b",
    q(GAMES, TEAM_GAMES, """SELECT game_id, team, coalesce(lag(week) OVER (PARTITION BY season, team ORDER BY day, game_id) = week - 1, false) AS back_to_back FROM tg WHERE is_away
      UNION ALL SELECT game_id, team, false FROM tg WHERE NOT is_away"""),
)
def w6(spark, d):
    return windows.back_to_back(team_games(spark, d), KEYS, "day", "game_id", "week", "is_away")


def _stat_sql(c: str) -> str:
    return ", ".join([f"avg({c}) OVER w AS {c}_mean", f"max({c}) OVER w AS {c}_max", f"min({c}) OVER w AS {c}_min", f"coalesce(stddev_samp({c}) OVER w, 0) AS {c}_std"])


@case(
    "w7_group_stats", "event_id:l pct_mean:d8 pct_max:d8 pct_min:d8 pct_std:d8 value_mean:d value_max:d value_min:d value_std:d",
    q(PICKS, f"SELECT event_id, {_stat_sql('pct')}, {_stat_sql('value')} FROM picks WINDOW w AS (PARTITION BY pool, week)"),
)
def w7(spark, d):
    return windows.group_stats(picks(spark, d), ["pool", "week"], ["pct", "value"])


@case(
    "w8_relative_stats", "event_id:l pct_vs_mean:d8 pct_vs_top:d8 pct_from_top:d8 pct_is_top:l",
    q(PICKS, """SELECT event_id, pct - avg(pct) OVER w AS pct_vs_mean, CASE WHEN max(pct) OVER w <> 0 THEN pct / max(pct) OVER w ELSE 0 END AS pct_vs_top,
      pct - max(pct) OVER w AS pct_from_top, CASE WHEN pct = max(pct) OVER w THEN 1 ELSE 0 END AS pct_is_top FROM picks WINDOW w AS (PARTITION BY pool, week)"""),
)
def w8(spark, d):
    return windows.relative_stats(picks(spark, d), ["pool", "week"], ["pct"])


@case(
    "w9_rank_density", "event_id:l pct_rank:l pct_rank_density:d8",
    q(PICKS, """SELECT event_id, rank() OVER (PARTITION BY pool, week ORDER BY pct DESC) AS pct_rank,
      rank() OVER (PARTITION BY pool, week ORDER BY pct DESC) / CAST(count(*) OVER (PARTITION BY pool, week) AS DOUBLE) AS pct_rank_density FROM picks"""),
)
def w9(spark, d):
    return windows.rank_density(picks(spark, d), ["pool", "week"], "pct")


@case(
    "w10_weak_percentile", "event_id:l up:d down:d",
    q(PICKS, """SELECT event_id, 100 * cume_dist() OVER (PARTITION BY pool ORDER BY value) AS up,
      100 * cume_dist() OVER (PARTITION BY pool ORDER BY CASE WHEN pool = 'error' THEN -value ELSE value END) AS down FROM picks"""),
)
def w10(spark, d):
    p = windows.weak_percentile(picks(spark, d), ["pool"], "value", "up")
    return windows.weak_percentile(p, ["pool"], "value", "down", invert=F.col("pool") == "error")


_SCARCE = {"top": "is_top = 1", "over_80": "win > 0.8", "70_80": "win >= 0.7 AND win <= 0.8", "60_70": "win >= 0.6 AND win < 0.7"}


def _scarce(n: str, hit: str) -> str:
    later = "OVER (PARTITION BY season, team ORDER BY week RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"coalesce(CASE WHEN 53 - week > 0 THEN sum(CASE WHEN {hit} THEN 1 ELSE 0 END) {later} / CAST(53 - week AS DOUBLE) END, 0) AS future_{n}"


def _scarce_app(n: str, hit: str) -> str:
    return f"""coalesce((SELECT sum(CASE WHEN {hit} THEN 1 ELSE 0 END) / CAST(count(DISTINCT week) AS DOUBLE) FROM top t
      WHERE t.season = k.season AND t.team = k.team AND t.week > k.week), 0) AS future_{n}"""


TOP = "top AS (SELECT *, CASE WHEN win = max(win) OVER (PARTITION BY season, week) THEN 1 ELSE 0 END AS is_top FROM tg)"


def top_games(spark, d):
    tg = team_games(spark, d)
    return windows.relative_stats(tg, ["season", "week"], ["win"]).withColumnRenamed("win_is_top", "is_top")


@case(
    "w11_future_scarcity", "game_id:l team:l future_top:d future_over_80:d future_70_80:d future_60_70:d",
    q(GAMES, TEAM_GAMES, TOP, "SELECT game_id, team, " + ", ".join(_scarce(n, h) for n, h in _SCARCE.items()) + " FROM top"),
)
def w11(spark, d):
    return windows.future_scarcity(top_games(spark, d), KEYS, "week", "win", "is_top", horizon=53)


@case(
    "w11_future_scarcity_played", "season:l team:l week:l future_top:d future_over_80:d future_70_80:d future_60_70:d",
    q(GAMES, TEAM_GAMES, TOP, "SELECT season, team, week, " + ", ".join(_scarce_app(n, h) for n, h in _SCARCE.items()) + " FROM (SELECT DISTINCT season, team, week FROM tg) k"),
)
def w11_played(spark, d):
    out = windows.future_scarcity(top_games(spark, d), KEYS, "week", "win", "is_top", horizon=None)
    return out.select("season", "team", "week", *[f"future_{n}" for n in _SCARCE]).distinct()


@case(
    "w12_future_mean", "game_id:l team:l future_mean:d11",
    q(GAMES, TEAM_GAMES, """SELECT game_id, team, coalesce(avg(win - 0.5) OVER (PARTITION BY season, team ORDER BY week RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS future_mean FROM tg"""),
)
def w12(spark, d):
    tg = team_games(spark, d).withColumn("adv", F.col("win") - 0.5)
    return windows.future_mean(tg, KEYS, "week", "adv")


@case(
    "w13_stars", "event_id:l stars:d",
    q(PICKS, """SELECT event_id, round_even(10 * ((pct - min(pct) OVER w) / CASE WHEN max(pct) OVER w = min(pct) OVER w THEN 1 ELSE max(pct) OVER w - min(pct) OVER w END), 0) / 2 AS stars
      FROM picks WINDOW w AS (PARTITION BY pool, week)"""),
)
def w13(spark, d):
    return windows.minmax_stars(picks(spark, d), ["pool", "week"], "pct")


CLOCK = """clock AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, date_diff('minute', lead(ts) OVER w, ts) AS z,
   (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / CAST(60000000 AS DOUBLE) AS consumed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def clock(spark, d):
    e = table(spark, d, "events").withColumn("remaining", -F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    return windows.gap_to_next(e, ["user_id"], ["ts", "event_id"], "remaining", F.to_date("ts"))


@case("w14_gap_to_next", "event_id:l consumed:d4", q(CLOCK, "SELECT * FROM clock"))
def w14(spark, d):
    return clock(spark, d)


@case(
    "w14_pace", "event_type:s user_id:l pace:d4 n:l",
    q(CLOCK, "SELECT event_type, user_id, sum(consumed * value) / sum(value) AS pace, count(*) AS n FROM clock WHERE consumed >= 0 AND consumed < 600 GROUP BY ALL"),
)
def w14_pace(spark, d):
    return windows.pace(clock(spark, d), ["event_type", "user_id"], "consumed", "value", limit=600)


@case(
    "w15_normalize", "event_id:l share:d8",
    q(PICKS, "SELECT event_id, pct * (CASE week % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END / sum(pct) OVER (PARTITION BY pool, week)) AS share FROM picks"),
)
def w15(spark, d):
    target = (F.col("week") % 3 + 1).cast("double")
    return windows.normalize(picks(spark, d), ["pool", "week"], "pct", target, out="share")
