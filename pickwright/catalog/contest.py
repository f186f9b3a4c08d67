"""Pool flow, expected value, trials and paths."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import DIM, GAMES, PICKS, TEAM_GAMES, dim, games, picks, table, team_games
from pickwright.catalog.joins import NATIONS, OUTCOMES, nations
from pickwright.catalog.windows import ADV, REST
from pickwright.operators import aggregates as A
from pickwright.operators import iterative, paths, scenarios
from pickwright.operators.joins import lookup_sides
from pickwright.operators.windows import opponent_rest, rest_days, running_advantage
from pickwright.session import cut_lineage

WEEKS = 16
POOLS = "sizes AS (SELECT pool, count(DISTINCT entry) * 2 AS entries FROM picks GROUP BY ALL)"
ALIVE = f"""alive AS (SELECT s.pool, r.week, CASE WHEN r.week = 1 THEN entries ELSE (SELECT count(DISTINCT entry) FROM picks p WHERE p.pool = s.pool AND total_wins >= r.week - 1) END AS alive
  FROM sizes s, range(1, {WEEKS + 1}) r(week))"""


def _entries(spark, d):
    return picks(spark, d).select("pool", "entry", "total_wins").distinct()


def _pools(spark, d):
    return _entries(spark, d).groupBy("pool").agg((F.count("*") * 2).alias("entries"))


@case("a15_alive_by_week", "pool:s week:l alive:l", q(PICKS, POOLS, ALIVE, "SELECT * FROM alive"))
def a15(spark, d):
    return A.alive_by_week(_entries(spark, d), ["pool"], "total_wins", WEEKS, _pools(spark, d))


@case(
    "a16_pick_flow", "pool:s week:l team:l alive:l current_picks:l prior_picks:l availability:d pick_pct:d remaining_pct:d",
    q(PICKS, POOLS, ALIVE, "grid AS (SELECT pool, week, alive, team FROM alive, range(32) r(team))",
      """f AS (SELECT g.pool, g.week, g.team, count(p.entry) FILTER (p.week = g.week) AS now, count(p.entry) FILTER (p.week < g.week) AS before
         FROM grid g LEFT JOIN picks p ON p.pool = g.pool AND p.team = g.team AND p.total_wins >= g.week - 1 GROUP BY ALL)""",
      """SELECT pool, week, team, alive, now AS current_picks, before AS prior_picks, CASE WHEN alive > 0 THEN (alive - before) / CAST(alive AS DOUBLE) ELSE 0 END AS availability,
         CASE WHEN alive > 0 THEN now / CAST(alive AS DOUBLE) ELSE 0 END AS pick_pct, alive / CAST(entries AS DOUBLE) AS remaining_pct FROM f JOIN grid USING (pool, week, team) JOIN sizes USING (pool)"""),
)
def a16(spark, d):
    pools = _pools(spark, d)
    grid = pools.select("pool", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))).alias("week"))
    grid = grid.select("pool", "week", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("team"))
    alive = A.alive_by_week(_entries(spark, d), ["pool"], "total_wins", WEEKS, pools)
    return A.pick_flow(grid, picks(spark, d), alive, pools, ["pool"])


@case(
    "a17_availability", "pool:s team:l entries_used:l alive:l availability:d",
    q(PICKS, "al AS (SELECT pool, count(DISTINCT entry) AS alive FROM picks WHERE total_wins >= 5 GROUP BY ALL)",
      "u AS (SELECT pool, team, count(DISTINCT entry) AS used FROM picks WHERE total_wins >= 5 AND week < 6 GROUP BY ALL)",
      """SELECT pool, t.team, coalesce(used, 0) AS entries_used, alive, (alive - coalesce(used, 0)) / CAST(alive AS DOUBLE) AS availability FROM (SELECT DISTINCT pool, team FROM picks) t
         LEFT JOIN u USING (pool, team) JOIN al USING (pool)"""),
)
def a17(spark, d):
    p = picks(spark, d)
    return A.availability(p, p.select("pool", "team").distinct(), 6, ["pool"])


@case(
    "a17_availability_all", "team:l entries_used:l alive:l availability:d",
    q(PICKS, "al AS (SELECT count(DISTINCT entry) AS alive FROM picks WHERE total_wins >= 9)",
      "u AS (SELECT team, count(DISTINCT entry) AS used FROM picks WHERE total_wins >= 9 AND week < 10 GROUP BY ALL)",
      """SELECT t.team, coalesce(used, 0) AS entries_used, alive, (alive - coalesce(used, 0)) / CAST(alive AS DOUBLE) AS availability FROM (SELECT DISTINCT team FROM picks) t LEFT JOIN u USING (team), al"""),
)
def a17_all(spark, d):
    p = picks(spark, d)
    return A.availability(p, p.select("team").distinct(), 10)


SHARES = """sides AS (SELECT pool, week, team, sum(pct) / sum(sum(pct)) OVER (PARTITION BY pool, week) AS pick_pct, 0.3 + team * 0.02 AS win FROM picks GROUP BY pool, week, team)"""


def _shares(spark, d):
    cells = picks(spark, d).groupBy("pool", "week", "team").agg(F.sum("pct").alias("s"))
    total = cells.groupBy("pool", "week").agg(F.sum("s").alias("t"))
    return cells.join(total, ["pool", "week"]).select(
        "pool", "week", "team", (F.col("s") / F.col("t")).alias("pick_pct"), (0.3 + F.col("team") * 0.02).alias("win")
    )


@case(
    "i3_pool_projection", "pool:s week:l team:l entries:d used:d availability:d",
    "WITH RECURSIVE " + q(PICKS, POOLS, SHARES, "rates AS (SELECT pool, week, sum(pick_pct * win) AS rate FROM sides GROUP BY ALL)",
      "grid AS (SELECT DISTINCT pool, team FROM sides)",
      """u(pool, team, week, s, used) AS (SELECT pool, team, 1, CAST(entries AS DOUBLE), CAST(0 AS DOUBLE) FROM grid JOIN sizes USING (pool)
         UNION ALL SELECT u.pool, u.team, u.week + 1, s * rate, greatest(0, least(coalesce(x.pick_pct * x.win, 0) * s + used * rate, s * rate))
         FROM u JOIN rates r ON r.pool = u.pool AND r.week = u.week LEFT JOIN sides x ON x.pool = u.pool AND x.team = u.team AND x.week = u.week)""",
      "SELECT u.pool, u.week, u.team, s AS entries, used, greatest(0, least(1, (s - used) / s)) AS availability FROM u JOIN rates r ON r.pool = u.pool AND r.week = u.week").removeprefix("WITH "),
)
def i3(spark, d):
    return iterative.pool_projection(_shares(spark, d), _pools(spark, d), ["pool"])


# --- expected value ---------------------------------------------------------
WEEK_GAMES = """wg0 AS (SELECT season, week, game_id, home, away, 0.5 + spread / 20 AS p, CASE WHEN game_id % 11 = 0 THEN 0 ELSE CAST(floor(total) AS BIGINT) % 97 + 1 END AS ra, cust % 89 + 1 AS rb FROM games),
  wg AS (SELECT season, week, game_id, 'h' || home AS a, 'a' || away AS b, p, ra / CAST(sum(ra + rb) OVER (PARTITION BY season, week) AS DOUBLE) AS ka,
    rb / CAST(sum(ra + rb) OVER (PARTITION BY season, week) AS DOUBLE) AS kb FROM wg0)"""


def week_games(spark, d):
    g = games(spark, d).select(
        "season", "week", "game_id", F.concat(F.lit("h"), "home").alias("a"), F.concat(F.lit("a"), "away").alias("b"), (0.5 + F.col("spread") / 20).alias("p"),
        F.when(F.col("game_id") % 11 == 0, 0).otherwise(F.floor("total") % 97 + 1).alias("ra"), (F.col("cust") % 89 + 1).alias("rb"),
    )
    total = g.groupBy("season", "week").agg(F.sum(F.col("ra") + F.col("rb")).alias("t"))
    return g.join(total, ["season", "week"]).withColumns({"ka": F.col("ra") / F.col("t"), "kb": F.col("rb") / F.col("t")})


# the same integral on exponential nodes, one wide and fixed grid for all weeks; the outcomes
# that leave nobody alive (all winners without a share) are taken out, as they count 0
_LF = "ln(greatest(p * exp((least(ka, kb) - ka) * t) + (1 - p) * exp((least(ka, kb) - kb) * t), 1e-300)) - least(ka, kb) * t"
_DEAD = "CASE WHEN ka = 0 THEN p ELSE 0 END + CASE WHEN kb = 0 THEN 1 - p ELSE 0 END"
_GONE = "CASE WHEN safe - CASE WHEN dead = 0 THEN 1 ELSE 0 END = 0 THEN exp(dl - CASE WHEN dead > 0 THEN ln(dead) ELSE 0 END) ELSE 0 END"


@case(
    "i4_scenario_ev_weeks", "season:l week:l game_id:l team:s ev:d8",
    q(GAMES, WEEK_GAMES, "nodes AS (SELECT exp(x * CAST(0.25 AS DOUBLE)) AS t FROM range(-180, 60) r(x))",
      f"wd AS (SELECT *, {_DEAD} AS dead FROM wg)",
      "gd AS (SELECT season, week, count(*) FILTER (dead = 0) AS safe, sum(CASE WHEN dead > 0 THEN ln(dead) ELSE 0 END) AS dl FROM wd GROUP BY ALL)",
      f"lf AS (SELECT wd.*, {_GONE} AS gone, t, {_LF} AS l FROM wd JOIN gd USING (season, week), nodes)",
      "tot AS (SELECT season, week, t, sum(l) AS l FROM lf GROUP BY ALL)",
      """ev AS (SELECT season, week, game_id, a, b, sum(t * 0.25 * p * (exp(tot.l - lf.l - ka * t) - CASE WHEN ka = 0 THEN gone ELSE 0 END)) AS ea,
         sum(t * 0.25 * (1 - p) * (exp(tot.l - lf.l - kb * t) - CASE WHEN kb = 0 THEN gone ELSE 0 END)) AS eb
         FROM lf JOIN tot USING (season, week, t) GROUP BY ALL)""",
      "SELECT season, week, game_id, a AS team, ea AS ev FROM ev UNION ALL SELECT season, week, game_id, b, eb FROM ev"),
)
def i4(spark, d):
    return scenarios.scenario_ev(week_games(spark, d), ["season", "week"], "game_id", "a", "b", "p", None, "ka", "kb")


@case(
    "i4_scenario_ev_enumerated", "region:l game:l team:s ev:d",
    q(NATIONS, OUTCOMES, "w AS (SELECT region, scenario, product(CASE WHEN first_wins THEN p ELSE 1 - p END) AS w, sum(CASE WHEN first_wins THEN ka ELSE kb END) AS s FROM sc GROUP BY ALL)",
      """SELECT region, game, CASE WHEN first_wins THEN a ELSE b END AS team, sum(CASE WHEN s > 0 THEN w / s ELSE 0 END) AS ev FROM sc JOIN w USING (region, scenario) GROUP BY ALL"""),
)
def i4_nations(spark, d):
    return scenarios.scenario_ev(nations(spark, d), ["region"], "game", "a", "b", "p", None, "ka", "kb")


SHARELESS = NATIONS.replace("nat AS", "nat0 AS") + ", nat AS (SELECT * REPLACE (CASE WHEN region = 2 THEN 0 ELSE ka END AS ka, CASE WHEN region = 2 THEN 0 ELSE kb END AS kb) FROM nat0)"


@case(
    "i4_scenario_ev_no_shares", "region:l game:l team:s ev:d",
    q(SHARELESS, OUTCOMES, "w AS (SELECT region, scenario, product(CASE WHEN first_wins THEN p ELSE 1 - p END) AS w, sum(CASE WHEN first_wins THEN ka ELSE kb END) AS s FROM sc GROUP BY ALL)",
      """SELECT region, game, CASE WHEN first_wins THEN a ELSE b END AS team, sum(CASE WHEN s > 0 THEN w / s ELSE 0 END) AS ev FROM sc JOIN w USING (region, scenario) GROUP BY ALL"""),
)
def i4_no_shares(spark, d):
    none = F.col("region") == 2
    n = nations(spark, d).withColumns({c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("ka", "kb")})
    return scenarios.scenario_ev(n, ["region"], "game", "a", "b", "p", None, "ka", "kb")


@case(
    "i5_pair_ev", "season:l week:l game_id:l team:s ev:d2",
    q(GAMES, WEEK_GAMES, """s AS (SELECT season, week, game_id, a AS team, CASE WHEN ka > 0 THEN p / ka ELSE 0 END AS r FROM wg UNION ALL
         SELECT season, week, game_id, b, CASE WHEN kb > 0 THEN (1 - p) / kb ELSE 0 END FROM wg)""",
      """SELECT x.season, x.week, x.game_id, x.team, coalesce(sum(x.r * y.r), 0) AS ev FROM s x LEFT JOIN s y ON x.season = y.season AND x.week = y.week AND x.game_id <> y.game_id GROUP BY ALL"""),
)
def i5(spark, d):
    return scenarios.scenario_ev_pairs(week_games(spark, d), ["season", "week"], "game_id", "a", "b", "p", None, "ka", "kb")


def _pass(i: int) -> str:
    over = "v > cap"
    return f"""r{i} AS (SELECT pool, week, team, x, cap, CASE WHEN {over} THEN cap WHEN room > 0 AND ex > 0 THEN v * (1 + ex / room) ELSE v END AS v FROM
      (SELECT *, sum(CASE WHEN {over} THEN v - cap ELSE 0 END) OVER w AS ex, sum(CASE WHEN {over} THEN 0 ELSE v END) OVER w AS room FROM r{i - 1} WINDOW w AS (PARTITION BY pool, week)))"""


@case(
    "i6_redistribute", "pool:s week:l team:l share:d",
    q(PICKS, SHARES, "r0 AS (SELECT pool, week, team, pick_pct AS x, 0.02 + (team % 7) * 0.01 AS cap, CAST(pick_pct AS DOUBLE) AS v FROM sides)", *[_pass(i) for i in range(1, 16)],
      "SELECT pool, week, team, least(v, cap) AS share FROM r15"),
)
def i6(spark, d):
    s = _shares(spark, d).withColumn("cap", 0.02 + (F.col("team") % 7) * 0.01)
    return iterative.redistribute(s, ["pool", "week"], "pick_pct", "cap", out="share")


@case(
    "i7_outcome_trials", "season:l week:l mean:d9 std:d9 median:d9",
    q(GAMES, WEEK_GAMES, "tr AS (SELECT season, week, game_id, p, ka, kb, t FROM wg, range(200) r(t))",
      """o AS (SELECT season, week, t, sum(CASE WHEN CAST('0x' || substr(md5(t || '-' || game_id || '-7'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < p THEN ka ELSE kb END) / sum(ka + kb) AS rate FROM tr GROUP BY ALL)""",
      "s AS (SELECT season, week, product(rate) OVER (PARTITION BY season, t ORDER BY week) AS alive FROM o)",
      "SELECT season, week, avg(alive) AS mean, stddev_samp(alive) AS std, quantile_cont(alive, 0.5) AS median FROM s GROUP BY ALL"),
)
def i7(spark, d):
    t = scenarios.outcome_trials(week_games(spark, d), ["season"], "week", "game_id", "p", "ka", "kb", 200, 7)
    return scenarios.trial_summary(t, ["season", "week"], "alive_share")


PATH_CANDS = """cand AS (SELECT o_orderpriority AS contest, quarter(o_orderdate) AS week, n_name AS team, avg(o_totalprice) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def path_candidates(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy(
        F.col("o_orderpriority").alias("contest"), F.quarter("o_orderdate").alias("week"), F.col("n_name").alias("team")
    ).agg(F.avg("o_totalprice").alias("score"))


@case(
    "i8_best_paths", "contest:s rank:l picks:a total:d4",
    q(PATH_CANDS, """p AS (SELECT a.contest, [a.team, b.team, c.team, e.team] AS picks, a.score + b.score + c.score + e.score AS total FROM cand a JOIN cand b ON b.contest = a.contest AND b.week = 2 AND b.team <> a.team
        JOIN cand c ON c.contest = a.contest AND c.week = 3 AND c.team NOT IN (a.team, b.team) JOIN cand e ON e.contest = a.contest AND e.week = 4 AND e.team NOT IN (a.team, b.team, c.team) WHERE a.week = 1)""",
      "SELECT contest, row_number() OVER (PARTITION BY contest ORDER BY total DESC) AS rank, picks, total FROM p QUALIFY rank <= 3"),
)
def i8(spark, d):
    return paths.best_paths(path_candidates(spark, d), ["contest"], "week", "team", "score", [1, 2, 3, 4], k=3)


@case(
    "i8_best_paths_two_picks", "contest:s rank:l picks:a total:d4",
    q(PATH_CANDS, """p AS (SELECT a.contest, [a.team, e.team, b.team, c.team, f.team] AS picks, a.score + e.score + b.score + c.score + f.score AS total
        FROM cand a JOIN cand e ON e.contest = a.contest AND e.week = 2 AND e.team <> a.team JOIN cand b ON b.contest = a.contest AND b.week = 3 AND b.team NOT IN (a.team, e.team)
        JOIN cand c ON c.contest = a.contest AND c.week = 3 AND c.team > b.team AND c.team NOT IN (a.team, e.team)
        JOIN cand f ON f.contest = a.contest AND f.week = 4 AND f.team NOT IN (a.team, e.team, b.team, c.team) WHERE a.week = 1)""",
      "SELECT contest, row_number() OVER (PARTITION BY contest ORDER BY total DESC) AS rank, picks, total FROM p QUALIFY rank <= 2"),
)
def i8_two(spark, d):
    return paths.best_paths(path_candidates(spark, d), ["contest"], "week", "team", "score", [1, 2, 3, 4], k=2, picks={3: 2})


@case(
    "i12_impute_spread", "game_id:l line:d projected_spread:d",
    q(GAMES, TEAM_GAMES, DIM, REST, ADV, "s AS (SELECT o.*, sum(rest_adv) OVER (PARTITION BY season, team ORDER BY day) AS adv FROM o)",
      """j AS (SELECT g.game_id, CASE WHEN g.game_id % 4 = 0 THEN NULL ELSE g.spread END AS line, hd.rank + 1.5 + h.rest_adv * 0.125 + h.adv * 0.0625 - (ad.rank + a.rest_adv * 0.125 + a.adv * 0.0625) AS pr
         FROM games g JOIN s h ON h.game_id = g.game_id AND h.team = g.home JOIN s a ON a.game_id = g.game_id AND a.team = g.away LEFT JOIN dim hd ON hd.team = g.home LEFT JOIN dim ad ON ad.team = g.away)""",
      "SELECT game_id, coalesce(line, pr) AS line, pr AS projected_spread FROM j"),
)
def i12(spark, d):
    tg = rest_days(team_games(spark, d), ["season", "team"], "day", "game_id", 7)
    tg = cut_lineage(opponent_rest(tg, "game_id", "team", "opp"))
    tg = running_advantage(tg, ["season", "team"], "day", "rest_adv")
    own = tg.select("game_id", "team", "rest_adv", "season_rest_adv")
    g = games(spark, d)
    for side in ("home", "away"):
        names = {"team": side, "rest_adv": f"{side}_adv", "season_rest_adv": f"{side}_season"}
        g = g.join(own.withColumnsRenamed(names), ["game_id", side])
    g = lookup_sides(g, dim(spark, d), "team", ["rank"], "home", "away")
    g = g.withColumn("line", F.when(F.col("game_id") % 4 != 0, F.col("spread")))
    total = lambda s: F.col(f"{s}_rank") + F.col(f"{s}_adv") * 0.125 + F.col(f"{s}_season") * 0.0625
    return iterative.impute_spread(g, "line", total("home") + 1.5, total("away"))
