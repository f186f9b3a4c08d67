"""Whole pipelines over the test tables: home-field ratings, zone splits, entry flow, pick paths, play categories."""

from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.catalog.aggs import _side, ratings_sql
from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import AS_OF, GAMES, PICKS, PLAYS, picks, plays, table
from pickwright.catalog.contest import PATH_CANDS, path_candidates
from pickwright.catalog.joins import EDGES
from pickwright.operators import rows
from pickwright.plans import contest, pick_plan, ratings

TYPES = {1: "run", 2: "pass", 3: "run", 4: "pass", 5: "punt", 6: "field_goal"}
TYPE_SQL = "CASE down " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in TYPES.items()) + " ELSE 'kneel' END"


def feed(spark, d):
    """The plays under the column names of the play-by-play feed."""
    kind = F.lit("kneel")
    for n, t in TYPES.items():
        kind = F.when(F.col("down") == n, t).otherwise(kind)
    named = {"team": "posteam", "opp": "defteam", "home": "home_team", "day": "game_date", "x": "epa"}
    return plays(spark, d).drop("w").withColumn("play_type", kind).withColumnsRenamed(named)


KEPT = f"""kept AS (SELECT * FROM plays WHERE wp BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.95 AS DOUBLE) AND down <= 6
  AND day BETWEEN DATE '{AS_OF}' - INTERVAL 840 DAY AND DATE '{AS_OF}')"""


@case(
    "plan_home_field", "team:l hfa_points:d home_rating:d away_rating:d global_rating:d hfa_epa:d hfa_sr:d",
    q(GAMES, PLAYS, KEPT, EDGES.replace("FROM plays", "FROM kept"), *ratings_sql(50, 1.0),
      f"""hs AS (SELECT t.team, coalesce({_side('net_epa', 'epa', 'is_home')}, any_value(t.epa)) AS he, coalesce({_side('net_sr', 'sr', 'is_home')}, any_value(t.sr)) AS hs,
        coalesce({_side('net_epa', 'epa', 'NOT is_home')}, any_value(t.epa)) AS ae, coalesce({_side('net_sr', 'sr', 'NOT is_home')}, any_value(t.sr)) AS sa
        FROM rated t JOIN edges ON edges.team = t.team JOIN rated o ON o.team = edges.opponent GROUP BY t.team)""",
      """SELECT hs.team, (he - ae) / 2 * 0.42 + (hs - sa) / 2 * 100 * 0.765 * 0.58 AS hfa_points, he * 0.42 + hs * 100 * 0.765 * 0.58 AS home_rating, ae * 0.42 + sa * 100 * 0.765 * 0.58 AS away_rating,
         epa * 0.42 + sr * 100 * 0.765 * 0.58 AS global_rating, (he - ae) / 2 AS hfa_epa, (hs - sa) / 2 AS hfa_sr FROM hs JOIN rated USING (team)"""),
)
def plan_home_field(spark, d):
    return ratings.home_field(feed(spark, d), AS_OF)


ZONES = ["EST", "CST", "PST"]
ZONE_SQL = "zones AS (SELECT CAST(n_nationkey AS BIGINT) AS team, ['EST', 'CST', 'PST'][CAST(n_nationkey % 3 + 1 AS INT)] AS zone FROM nation)"
_DAYS = f"day BETWEEN DATE '{AS_OF}' - INTERVAL {K.ZONE_HISTORY_DAYS} DAY AND DATE '{AS_OF}'"
ZONE_EDGES = EDGES.replace("FROM plays", f"FROM plays WHERE down <= 6 AND {_DAYS}").replace("greatest(least(x, CAST(4.875 AS DOUBLE)), CAST(-4.875 AS DOUBLE))", "x").replace(str(K.GAME_CAP), str(K.ZONE_GAME_CAP))


def _zone_diff(zone: str) -> str:
    here = f"FILTER (host = '{zone}')"
    return f'CASE WHEN count(*) {here} >= 2 THEN sum(x * weight) {here} / sum(weight) {here} - sum(x * weight) / sum(weight) END AS "{zone}_diff"'


@case(
    "plan_zone_splits", "team:l origin_zone:s baseline:d EST_diff:d CST_diff:d PST_diff:d",
    q(GAMES, PLAYS.replace("CAST(0.00475 AS DOUBLE)", f"CAST({K.ZONE_DECAY_RATE} AS DOUBLE)"), ZONE_EDGES, *ratings_sql(50, 1.0), ZONE_SQL,
      """away AS (SELECT e.team, e.weight, z.zone AS host, (net_epa + o.epa) * 0.42 + (net_sr + o.sr) * 100 * 0.765 * 0.58 AS x
        FROM edges e JOIN rated o ON o.team = e.opponent LEFT JOIN zones z ON z.team = e.opponent WHERE NOT is_home)""",
      f"SELECT a.team, any_value(z.zone) AS origin_zone, sum(x * weight) / sum(weight) AS baseline, {', '.join(map(_zone_diff, ZONES))} FROM away a LEFT JOIN zones z ON z.team = a.team GROUP BY a.team"),
)
def plan_zone_splits(spark, d):
    zones = F.array(*[F.lit(z) for z in ZONES])
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("team"), F.element_at(zones, (F.col("n_nationkey") % 3 + 1).cast("int")).alias("zone"))
    return ratings.zone_splits(feed(spark, d), known, AS_OF, ZONES)


FLOW_WEEKS = 16


@case(
    "plan_entry_flow", "year:l week:l team:s alive:l current_picks:l prior_picks:l availability:d pick_pct:d remaining_pct:d",
    q(PICKS, "people AS (SELECT DISTINCT 2020 + entry % 3 AS year, entry, total_wins FROM picks)", "sizes AS (SELECT year, count(*) * 2 AS entries FROM people GROUP BY ALL)",
      "best AS (SELECT 2020 + entry % 3 AS year, entry, total_wins, week, CAST(max(team) AS VARCHAR) AS team FROM picks GROUP BY ALL)",
      f"""al AS (SELECT s.year, r.week, CASE WHEN r.week = 1 THEN entries ELSE (SELECT count(*) FROM people p WHERE p.year = s.year AND total_wins >= r.week - 1) END AS alive
        FROM sizes s, range(1, {FLOW_WEEKS + 1}) r(week))""",
      "grid AS (SELECT year, week, alive, CAST(team AS VARCHAR) AS team FROM al, range(32) r(team))",
      """f AS (SELECT g.year, g.week, g.team, count(b.entry) FILTER (b.week = g.week) AS now, count(b.entry) FILTER (b.week < g.week) AS before
        FROM grid g LEFT JOIN best b ON b.year = g.year AND b.team = g.team AND b.total_wins >= g.week - 1 GROUP BY ALL)""",
      """SELECT year, week, team, alive, now AS current_picks, before AS prior_picks, CASE WHEN alive > 0 THEN (alive - before) / CAST(alive AS DOUBLE) ELSE 0 END AS availability,
         CASE WHEN alive > 0 THEN now / CAST(alive AS DOUBLE) ELSE 0 END AS pick_pct, alive / CAST(entries AS DOUBLE) AS remaining_pct FROM f JOIN grid USING (year, week, team) JOIN sizes USING (year)"""),
)
def plan_entry_flow(spark, d):
    """From the wide table of entries, one column per week."""
    weeks = list(range(1, FLOW_WEEKS + 1))
    p = picks(spark, d).withColumns({"year": F.col("entry") % 3 + 2020, "entry_name": F.col("entry").cast("string")})
    wide = p.groupBy("year", "entry_name", "total_wins").pivot("week", weeks).agg(F.max("team").cast("string"))
    wide = wide.withColumnsRenamed({str(w): f"week_{w}" for w in weeks})
    pools = wide.groupBy("year").agg((F.count("*") * 2).alias("entries"))
    grid = pools.select("year", F.explode(F.sequence(F.lit(1), F.lit(FLOW_WEEKS))).alias("week"))
    grid = grid.select("year", "week", F.explode(F.sequence(F.lit(0), F.lit(31)).cast("array<string>")).alias("team"))
    return contest.entry_flow(wide, [f"week_{w}" for w in weeks], grid, pools)


@case(
    "plan_choose_paths", "contest:s rank:l picks:a total:d4",
    q(PATH_CANDS.replace("cand AS", "every AS"), """cand AS (SELECT * FROM every WHERE NOT (length(team) < 5) AND NOT (coalesce(score < 135000, false)) AND NOT (contest LIKE '1%' AND team = 'GERMANY'))""",
      """p AS (SELECT a.contest, [a.team, b.team, c.team, e.team] AS picks, a.score + b.score + c.score + e.score AS total FROM cand a JOIN cand b ON b.contest = a.contest AND b.week = 2 AND b.team <> a.team
        JOIN cand c ON c.contest = a.contest AND c.week = 3 AND c.team NOT IN (a.team, b.team) JOIN cand e ON e.contest = a.contest AND e.week = 4 AND e.team NOT IN (a.team, b.team, c.team) WHERE a.week = 1)""",
      "SELECT contest, row_number() OVER (PARTITION BY contest ORDER BY total DESC) AS rank, picks, total FROM p QUALIFY rank <= 2"),
)
def plan_choose_paths(spark, d):
    """Paths over the sides that no rule rejects, without the teams an entry has used."""
    sides = path_candidates(spark, d)
    used = sides.where(F.col("contest").startswith("1") & (F.col("team") == "GERMANY")).select("contest", "team").distinct()
    rules = {"short_name": F.length("team") < 5, "low_score": F.col("score") < 135000}
    return pick_plan.choose_paths(sides, ["contest"], [1, 2, 3, 4], "score", rules, k=2, already_used=used)


# what the feed's and the charting columns are on the test tables
CHARTED = {
    "air_yards": "passer - 10", "yardline_100": "field", "qb_scramble": "dist % 2", "sack": "passer % 2", "is_blitz": "game_id % 2",
    "is_pressure": "field % 2", "is_play_action": "game_id % 3", "is_rpo": "field % 5", "is_slot": "dist % 3",
}
POSITION = "CASE dist % 4 WHEN 0 THEN 'WR' WHEN 1 THEN 'TE' WHEN 2 THEN 'RB' END"
RUN, PASS = "play_type = 'run'", "play_type = 'pass'"
CATEGORY_SQL = {
    "Overall": f"{RUN} OR {PASS}", "Run": RUN, "Pass": PASS, "Scramble": f"{RUN} AND qb_scramble = 1",
    "Pass_Deep": f"{PASS} AND air_yards >= 20", "Pass_Intermediate": f"{PASS} AND air_yards >= 10 AND air_yards <= 19",
    "Pass_Short": f"{PASS} AND air_yards >= 0 AND air_yards <= 9", "Pass_BehindLoS": f"{PASS} AND air_yards < 0",
    "Redzone": "yardline_100 <= 20", "1st_Down": "down = 1", "3rd_Down": "down = 3",
    "Target_WR": f"{PASS} AND receiver_pos = 'WR'", "Target_TE": f"{PASS} AND receiver_pos = 'TE'", "Target_RB": f"{PASS} AND receiver_pos = 'RB'",
    "Quick_Game_Proxy": f"{PASS} AND air_yards < 5 AND qb_scramble = 0 AND sack = 0",
    "Versus_Blitz": f"{PASS} AND is_blitz = 1", "No_Blitz": f"{PASS} AND is_blitz = 0",
    "Under_Pressure": f"{PASS} AND is_pressure = 1", "Clean_Pocket": f"{PASS} AND is_pressure = 0",
    "Play_Action": f"{PASS} AND is_play_action = 1", "RPO": "is_rpo = 1", "Target_Slot": f"{PASS} AND is_slot = 1",
}


@case(
    "p17_play_categories", "category:s n:l x:d",
    q(GAMES, PLAYS, f"feed AS (SELECT *, {TYPE_SQL} AS play_type, {POSITION} AS receiver_pos, {', '.join(f'{e} AS {c}' for c, e in CHARTED.items())} FROM plays)",
      " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n, sum(x) AS x FROM feed WHERE {p}" for c, p in CATEGORY_SQL.items())),
)
def p17_play_categories(spark, d):
    charted = feed(spark, d).withColumns({c: F.expr(e) for c, e in CHARTED.items()} | {"receiver_pos": F.expr(POSITION)})
    out = rows.fan_out(charted, rows.play_categories(charted.columns))
    return out.groupBy("category").agg(F.count("*").alias("n"), F.sum("epa").alias("x"))
