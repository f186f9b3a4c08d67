"""Results for many dates, anchors and weeks at once: ratings, strengths, availability, pool projections."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.catalog.aggs import adjusted_sql, ratings_sql
from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import GAMES, PICKS, PLAYS, games, picks, plays
from pickwright.catalog.contest import POOLS, WEEKS, _pools
from pickwright.catalog.joins import EDGES
from pickwright.catalog.pipelines import CATEGORY_SQL, CHARTED, POSITION, TYPE_SQL, feed
from pickwright.functions import rating
from pickwright.operators import aggregates as A
from pickwright.operators.aggregates import game_stats
from pickwright.operators.iterative import as_of_ratings
from pickwright.operators.joins import pair_sides
from pickwright.plans import pick_plan, ratings

# twenty dates, 90 days apart, and their windows of 840 days
DATES = [str(date(1997, 1, 31) + timedelta(days=90 * i)) for i in range(20)]
ASOF = "stops(as_of) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in DATES) + ")"
DATED = f"""dated AS (SELECT as_of, team, opponent, net_epa, net_sr, exp(-CAST({K.DECAY_RATE} AS DOUBLE) * date_diff('day', g.day, as_of)) AS weight
  FROM edges JOIN games g USING (game_id) JOIN stops ON g.day <= as_of AND g.day >= as_of - INTERVAL {K.HISTORY_DAYS} DAY)"""


@case(
    "s8_as_of_ratings", "as_of:t team:l epa:d sr:d epa_schedule:d",
    q(GAMES, PLAYS, EDGES, ASOF, DATED, *ratings_sql(K.RATING_PASSES, K.SCHEDULE_MULTIPLIER, "dated", "as_of"), "SELECT * FROM rated"),
)
def s8_as_of_ratings(spark, d):
    p = plays(spark, d).withColumn("capped", rating.winsorize(F.col("x")))
    stats = game_stats(p, ["game_id", "team"], "capped", "success", "w")
    edges = pair_sides(stats, "game_id", "team", ["weight"], {"net_epa": ("total", rating.damped_cap), "net_sr": ("rate", None)})
    dated = edges.join(games(spark, d).select("game_id", "day"), "game_id")
    return as_of_ratings(dated, "team", "opponent", {"epa": "net_epa", "sr": "net_sr"}, "day", DATES)


# three seasons up to a date within the last of them
ANCHORS = {y: f"{y}-10-31" for y in range(1995, 2002)}
SLOW = 0.0005
ANCHOR_SQL = "anchors(s, d) AS (VALUES " + ", ".join(f"({y}, DATE '{x}')" for y, x in ANCHORS.items()) + ")"


@case(
    "i2_anchored_seasons", "rating_season:l category:s side:s team:l plays:l weight_score:d epa:d sr:d epa_pct:d sr_pct:d",
    q(GAMES, PLAYS, ANCHOR_SQL,
      f"feed AS (SELECT *, {TYPE_SQL} AS play_type, {POSITION} AS receiver_pos, {', '.join(f'{e} AS {c}' for c, e in CHARTED.items())} FROM plays WHERE wp BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.95 AS DOUBLE))",
      f"""win AS (SELECT feed.* EXCLUDE (w), s AS rating_season, exp(-CAST({SLOW} AS DOUBLE) * date_diff('day', day, d)) AS w
        FROM feed JOIN anchors ON season BETWEEN s - 2 AND s AND day <= d WHERE play_type IN ('run', 'pass'))""",
      "fan AS (" + " UNION ALL ".join(f"SELECT *, '{c}' AS category FROM win WHERE {p}" for c, p in CATEGORY_SQL.items()) + ")",
      "lg AS (SELECT rating_season, sum(x * w) / sum(w) AS le, sum(success * w) / sum(w) AS ls FROM win GROUP BY ALL)",
      adjusted_sql("Offense", "team", "opp", "rating_season") + " UNION ALL " + adjusted_sql("Defense", "opp", "team", "rating_season")),
)
def i2_anchored_seasons(spark, d):
    charted = feed(spark, d).withColumns({c: F.expr(e) for c, e in CHARTED.items()} | {"receiver_pos": F.expr(POSITION)})
    return ratings.team_strengths(charted, ANCHORS, decay=SLOW)


@case(
    "a17_availability_weeks", "pool:s week:l team:l entries_used:l alive:l availability:d",
    q(PICKS, f"weeks AS (SELECT unnest(range(1, {WEEKS + 1})) AS week)",
      "al AS (SELECT pool, weeks.week, count(DISTINCT entry) AS alive FROM picks JOIN weeks ON total_wins >= weeks.week - 1 GROUP BY ALL)",
      "u AS (SELECT pool, weeks.week, team, count(DISTINCT entry) AS used FROM picks JOIN weeks ON total_wins >= weeks.week - 1 AND picks.week < weeks.week GROUP BY ALL)",
      """SELECT pool, al.week, team, coalesce(used, 0) AS entries_used, alive, (alive - coalesce(used, 0)) / CAST(alive AS DOUBLE) AS availability
         FROM (SELECT DISTINCT pool, team FROM picks) t JOIN al USING (pool) LEFT JOIN u USING (pool, week, team)"""),
)
def a17_weeks(spark, d):
    p = picks(spark, d)
    return A.availability_by_week(p, p.select("pool", "team"), WEEKS, ["pool"])


# --- pool projection with a share predicted inside every week -----------------
START, PASSES = 4, 5
#: Nobody's pick wins in this pool and week, so the pool is empty from then on.
EMPTIED = ("purchase", 9)
SIDES = f"""sides AS (SELECT pool, week, team, CASE WHEN pool = '{EMPTIED[0]}' AND week = {EMPTIED[1]} THEN 0 ELSE CAST(0.45 AS DOUBLE) + team * CAST(0.015 AS DOUBLE) END AS win,
  sum(pct) / CAST(100 AS DOUBLE) AS fame FROM picks GROUP BY ALL)"""
RAW = "win * (CAST(0.2 AS DOUBLE) + availability) + fame / (1 + fame)"


def _week_sql(w: int) -> list[str]:
    """One week: availability from the state, predicted shares, capped shares, flow, next state."""
    over = "v > availability"
    out = [
        f"""d{w} AS MATERIALIZED (SELECT s.pool, s.week, s.team, s.win, z.entries, greatest(0, least(1, (entries - coalesce(used, 0)) / entries)) AS availability, s.fame
          FROM sides s JOIN z{w} z ON z.pool = s.pool LEFT JOIN u{w} u ON u.pool = s.pool AND u.team = s.team WHERE s.week = {w})""",
        f"r{w}_0 AS MATERIALIZED (SELECT *, ({RAW}) / sum({RAW}) OVER (PARTITION BY pool) AS v FROM d{w})",
    ]
    for i in range(1, PASSES + 1):
        out.append(f"""r{w}_{i} AS MATERIALIZED (SELECT * EXCLUDE (v, ex, room), CASE WHEN {over} THEN availability WHEN room > 0 AND ex > 0 THEN v * (1 + ex / room) ELSE v END AS v FROM
          (SELECT *, sum(CASE WHEN {over} THEN v - availability ELSE 0 END) OVER g AS ex, sum(CASE WHEN {over} THEN 0 ELSE v END) OVER g AS room FROM r{w}_{i - 1} WINDOW g AS (PARTITION BY pool)))""")
    return [
        *out,
        f"f{w} AS MATERIALIZED (SELECT pool, week, team, entries, availability, least(v, availability) AS pick_pct, least(v, availability) * win * entries AS expected_survivors FROM r{w}_{PASSES})",
        f"a{w} AS MATERIALIZED (SELECT pool, any_value(entries) AS entries, sum(expected_survivors) AS after FROM f{w} GROUP BY ALL)",
        f"z{w + 1} AS MATERIALIZED (SELECT pool, after AS entries FROM a{w} WHERE after > 0)",
        f"""u{w + 1} AS MATERIALIZED (SELECT u.pool, u.team, greatest(0, least(coalesce(expected_survivors, 0) + used * after / a.entries, after)) AS used
          FROM u{w} u JOIN a{w} a ON a.pool = u.pool LEFT JOIN f{w} f ON f.pool = u.pool AND f.team = u.team)""",
    ]


PROJECTION = q(
    PICKS, POOLS, SIDES, f"z{START} AS MATERIALIZED (SELECT pool, CAST(entries AS DOUBLE) AS entries FROM sizes)",
    f"u{START} AS MATERIALIZED (SELECT DISTINCT s.pool, team, z.entries * (team % 4) * CAST(0.1 AS DOUBLE) AS used FROM sides s JOIN z{START} z ON z.pool = s.pool)",
    *[step for w in range(START, WEEKS + 1) for step in _week_sql(w)],
    " UNION ALL ".join(f"SELECT * FROM f{w}" for w in range(START, WEEKS + 1)),
)


@case("i3_predicted_projection", "pool:s week:l team:l entries:d availability:d pick_pct:d expected_survivors:d", PROJECTION)
def i3_predicted(spark, d):
    fame = picks(spark, d).groupBy("pool", "week", "team").agg((F.sum("pct") / 100).alias("fame"))
    nobody = (F.col("pool") == EMPTIED[0]) & (F.col("week") == EMPTIED[1])
    sides = fame.withColumn("win", F.when(nobody, 0.0).otherwise(0.45 + F.col("team") * 0.015))
    free = sides.select("pool", "team").distinct().withColumn("availability", 1 - (F.col("team") % 4) * 0.1)

    def predict(df):
        return df.withColumn("pick_pct", F.col("win") * (0.2 + F.col("availability")) + F.col("fame") / (1 + F.col("fame")))

    return pick_plan.project_picks(sides, _pools(spark, d), range(START, WEEKS + 1), predict, ["pool"], passes=PASSES, availability=free)
