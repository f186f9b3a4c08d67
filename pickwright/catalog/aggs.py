"""Aggregations."""

from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import DIM, GAMES, PLAYS, TEAM_GAMES, dim, games, plays, table, team_games
from pickwright.catalog.joins import EDGES, edges
from pickwright.catalog.rows import FAN_SQL, fan_predicates
from pickwright.functions import rating
from pickwright.operators import aggregates as A
from pickwright.operators.iterative import iterative_rating, opponent_adjusted

LIMIT = "greatest(least(x, CAST(4.875 AS DOUBLE)), CAST(-4.875 AS DOUBLE))"


@case(
    "a1_weighted_mean", "season:l team:l x:d success:d",
    q(GAMES, PLAYS, "SELECT season, team, sum(x * w) / sum(w) AS x, sum(success * w) / sum(w) AS success FROM plays GROUP BY ALL"),
)
def a1(spark, d):
    return A.weighted_mean(plays(spark, d), ["season", "team"], {"x": "x", "success": "success"}, "w")


@case(
    "a2_weighted_stats", "team:l kind:s mean:d std:d",
    q(GAMES, PLAYS, "m AS (SELECT team, kind, sum(yards * w) / sum(w) AS mean FROM plays GROUP BY ALL)",
      "SELECT team, kind, any_value(mean) AS mean, sqrt(sum(w * (yards - mean) ** 2) / sum(w)) AS std FROM plays JOIN m USING (team, kind) GROUP BY ALL"),
)
def a2(spark, d):
    return A.weighted_stats(plays(spark, d), ["team", "kind"], "yards", "w")


@case(
    "a3_game_stats", "game_id:l team:l opp:l day:t total:d successes:d plays:l weight:d8",
    q(GAMES, PLAYS, f"SELECT game_id, team, opp, day, sum({LIMIT}) AS total, sum(success) AS successes, count(*) AS plays, avg(w) AS weight FROM plays GROUP BY ALL"),
)
def a3(spark, d):
    p = plays(spark, d).withColumn("capped", rating.winsorize(F.col("x")))
    return A.game_stats(p, ["game_id", "team", "opp", "day"], "capped", "success", "w")


@case(
    "a4_mode", "season:l team:l passer:l passer_count:l",
    q(GAMES, PLAYS, "c AS (SELECT season, team, passer, count(*) AS n FROM plays GROUP BY ALL)",
      "SELECT season, team, passer, n AS passer_count FROM c QUALIFY row_number() OVER (PARTITION BY season, team ORDER BY n DESC, passer) = 1"),
)
def a4(spark, d):
    return A.mode_by(plays(spark, d), ["season", "team"], "passer", out="passer")


@case(
    "a5_latest", "team:l latest:l",
    q(GAMES, TEAM_GAMES, "SELECT team, opp AS latest FROM tg QUALIFY row_number() OVER (PARTITION BY team ORDER BY day DESC, game_id DESC) = 1"),
)
def a5(spark, d):
    return A.latest_by(team_games(spark, d), ["team"], ["day", "game_id"], "opp")


@case(
    "a6_mean_of_sums", "team:l volume:d",
    q(GAMES, PLAYS, "SELECT team, avg(s) AS volume FROM (SELECT team, season, floor(dayofyear(day) / 7) AS week, sum(qty) AS s FROM plays GROUP BY ALL) GROUP BY ALL"),
)
def a6(spark, d):
    p = plays(spark, d).withColumn("week", F.floor(F.dayofyear("day") / 7))
    return A.mean_of_sums(p, ["team"], ["season", "week"], "qty", "volume")


@case(
    "a7_per_game_rate", "team:l offense_per_game:d defense_per_game:d special_per_game:d",
    q(GAMES, PLAYS, """r AS (SELECT team, 'o' AS u, game_id, x AS v, w FROM plays WHERE kind LIKE 'O%' UNION ALL SELECT opp, 'd', game_id, x, w FROM plays WHERE kind LIKE 'O%'
        UNION ALL SELECT team, 's', game_id, x, w FROM plays WHERE kind LIKE 'F%' UNION ALL SELECT opp, 's', game_id, -x, w FROM plays WHERE kind LIKE 'F%')""",
      "g AS (SELECT team, u, game_id, sum(v) AS v, avg(w) AS w FROM r GROUP BY ALL)",
      """SELECT team, coalesce(sum(v * w) FILTER (u = 'o') / sum(w) FILTER (u = 'o'), 0) AS offense_per_game, coalesce(sum(v * w) FILTER (u = 'd') / sum(w) FILTER (u = 'd'), 0) AS defense_per_game,
         coalesce(sum(v * w) FILTER (u = 's') / sum(w) FILTER (u = 's'), 0) AS special_per_game FROM g GROUP BY ALL"""),
)
def a7(spark, d):
    o = F.col("kind").startswith("O")
    return A.per_game_rate(plays(spark, d), "team", "opp", "game_id", "x", "w", o, ~o)


@case(
    "a8_conditional_rates", "team:l down:l run:d late:d fallback:d",
    q(GAMES, PLAYS, """SELECT team, down, coalesce(sum(w) FILTER (kind = 'OR'), 0) / sum(w) AS run,
      coalesce(sum(w) FILTER (qty > 40 AND kind LIKE 'F%'), 0) / sum(w) FILTER (kind LIKE 'F%') AS late,
      coalesce(sum(w) FILTER (qty > 49 AND dist = 6), 0) AS z, coalesce(coalesce(sum(w) FILTER (qty > 45 AND qty > 49), 0) / sum(w) FILTER (qty > 49), 0.98) AS fallback FROM plays GROUP BY ALL"""),
)
def a8(spark, d):
    c = F.col
    rates = {
        "run": (c("kind") == "OR", F.lit(True)),
        "late": (c("qty") > 40, c("kind").startswith("F")),
        "fallback": (c("qty") > 45, c("qty") > 49),
    }
    return A.conditional_rates(plays(spark, d), ["team", "down"], rates, "w", {"fallback": 0.98})


PROFILE = """prof AS (SELECT team, CASE WHEN field <= 20 THEN 'redzone' ELSE 'open' END AS field_zone, down,
   CASE WHEN kind LIKE 'O%' THEN 'run' WHEN kind = 'FA' THEN 'punt' WHEN kind = 'FR' THEN 'field_goal' ELSE 'pass' END AS play_type, w,
   CASE WHEN dist = 10 THEN NULL ELSE yards END AS yards_gained, CASE WHEN dist = 0 THEN 1 ELSE 0 END AS fumble_lost, CASE WHEN dist = 1 THEN 1 ELSE 0 END AS sack,
   CASE WHEN dist BETWEEN 2 AND 7 THEN 1 ELSE 0 END AS complete_pass, CASE WHEN dist = 8 THEN 1 ELSE 0 END AS interception, CASE WHEN field % 4 = 0 THEN 1 ELSE 0 END AS out_of_bounds,
   qty + 10 AS kick_distance, CASE WHEN dist < 5 THEN yards END AS return_yards, CASE WHEN dist % 3 <> 0 THEN 'made' ELSE 'missed' END AS field_goal_result,
   CASE WHEN field % 3 = 0 THEN 1 ELSE 0 END AS penalty, CASE WHEN field % 2 = 0 THEN team ELSE opp END AS penalty_team,
   CASE WHEN dist < 3 THEN 'Defensive Pass Interference' WHEN dist < 8 THEN 'Holding' END AS penalty_type, CASE WHEN dist % 2 = 0 THEN 15 ELSE 5 + dist END AS penalty_yards, opp FROM plays)"""


def profile(spark, d):
    c = F.col
    p = plays(spark, d)
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    return p.select(
        "team", "opp", "down", "w",
        F.when(c("field") <= 20, "redzone").otherwise("open").alias("field_zone"),
        F.when(c("kind").startswith("O"), "run").when(c("kind") == "FA", "punt").when(c("kind") == "FR", "field_goal").otherwise("pass").alias("play_type"),
        F.when(c("dist") != 10, c("yards")).alias("yards_gained"), flag(c("dist") == 0).alias("fumble_lost"), flag(c("dist") == 1).alias("sack"),
        flag(c("dist").between(2, 7)).alias("complete_pass"), flag(c("dist") == 8).alias("interception"), flag(c("field") % 4 == 0).alias("out_of_bounds"),
        (c("qty") + 10).alias("kick_distance"), F.when(c("dist") < 5, c("yards")).alias("return_yards"),
        F.when(c("dist") % 3 != 0, "made").otherwise("missed").alias("field_goal_result"),
        flag(c("field") % 3 == 0).alias("penalty"), F.when(c("field") % 2 == 0, c("team")).otherwise(c("opp")).alias("penalty_team"),
        F.when(c("dist") < 3, "Defensive Pass Interference").when(c("dist") < 8, "Holding").alias("penalty_type"),
        F.when(c("dist") % 2 == 0, 15).otherwise(5 + c("dist")).alias("penalty_yards"),
    )


def _mean(x: str, cond: str) -> str:
    return f"(sum({x} * w) FILTER ({cond} AND {x} IS NOT NULL) / sum(w) FILTER ({cond} AND {x} IS NOT NULL))"


def _std(x: str, cond: str) -> str:
    ok = f"{cond} AND {x} IS NOT NULL"
    return f"sqrt(greatest(sum({x} * {x} * w) FILTER ({ok}) / sum(w) FILTER ({ok}) - {_mean(x, cond)} ** 2, 0))"


def _share(hit: str, base: str) -> str:
    return f"(coalesce(sum(w) FILTER ({base} AND {hit}), 0) / sum(w) FILTER ({base}))"


_RUN, _PASS, _THROWN = "play_type = 'run'", "play_type = 'pass'", "play_type = 'pass' AND sack = 0"
_CAUGHT = _THROWN + " AND complete_pass = 1"
_Y0 = "coalesce(yards_gained, 0)"


@case(
    "a8_offense_profile", "team:l field_zone:s run_mu:d run_sigma:d4 run_fumble:d sack:d complete:d intercept:d pass_fumble:d pass_mu:d pass_sigma:d4 out_of_bounds:d",
    q(GAMES, PLAYS, PROFILE, f"""SELECT team, field_zone, coalesce({_mean(_Y0, _RUN)}, 3.5) AS run_mu, coalesce({_std(_Y0, _RUN)}, 3) AS run_sigma, coalesce({_share('fumble_lost = 1', _RUN)}, 0.01) AS run_fumble,
      coalesce({_share('sack = 1', _PASS)}, 0.07) AS sack, coalesce({_share('complete_pass = 1', _THROWN)}, 0.6) AS complete, coalesce({_share('interception = 1', _THROWN)}, 0.03) AS intercept,
      coalesce({_share('fumble_lost = 1', _CAUGHT)}, 0.01) AS pass_fumble, coalesce({_mean('yards_gained', _CAUGHT)}, CASE WHEN count(*) FILTER ({_THROWN}) > 0 THEN 10 ELSE 7 END) AS pass_mu,
      coalesce({_std('yards_gained', _CAUGHT)}, 5) AS pass_sigma, {_share('out_of_bounds = 1', f"({_RUN} OR {_PASS})")} AS out_of_bounds
      FROM prof WHERE {_RUN} OR {_PASS} GROUP BY ALL"""),
)
def a8_offense(spark, d):
    return A.offense_profile(profile(spark, d), ["team", "field_zone"], "w")


_OWN = "(penalty = 1 AND penalty_team = opp)"
_DPI = _OWN + " AND coalesce(penalty_type ILIKE '%pass interference%', false)"
_MAJOR = _OWN + " AND NOT coalesce(penalty_type ILIKE '%pass interference%', false) AND penalty_yards = 15"


@case(
    "a8_penalty_profile", "opp:l penalty_rate:d interference_share:d major_share:d interference_mu:d interference_std:d4",
    q(GAMES, PLAYS, PROFILE, f"""SELECT opp, {_share(_OWN, 'true')} AS penalty_rate, coalesce({_share(_DPI, _OWN)}, 0.1) AS interference_share, coalesce({_share(_MAJOR, _OWN)}, 0.15) AS major_share,
      coalesce({_mean('penalty_yards', _DPI)}, 15) AS interference_mu, coalesce({_std('penalty_yards', _DPI)}, 10) AS interference_std FROM prof GROUP BY ALL"""),
)
def a8_penalties(spark, d):
    return A.penalty_profile(profile(spark, d), "opp", "w")


_FG, _PUNT = "play_type = 'field_goal'", "play_type = 'punt'"
_NET = "(kick_distance - coalesce(return_yards, 0))"


@case(
    "a8_kicking_profile", "team:l longest_made:d short_acc:d mid_acc:d long_acc:d punt_mu:d punt_sigma:d4",
    q(GAMES, PLAYS, PROFILE, f"""SELECT team, coalesce(max(kick_distance) FILTER ({_FG} AND field_goal_result = 'made'), 50) AS longest_made,
      coalesce({_share("field_goal_result = 'made'", _FG + ' AND kick_distance < 40')}, 0.98) AS short_acc,
      coalesce({_share("field_goal_result = 'made'", _FG + ' AND kick_distance >= 40 AND kick_distance < 50')}, 0.85) AS mid_acc,
      coalesce({_share("field_goal_result = 'made'", _FG + ' AND kick_distance >= 50')}, 0.65) AS long_acc,
      {_mean(_NET, _PUNT)} AS punt_mu, {_std(_NET, _PUNT)} AS punt_sigma FROM prof WHERE {_FG} OR {_PUNT} GROUP BY ALL"""),
)
def a8_kicking(spark, d):
    return A.kicking_profile(profile(spark, d), "team", "w")


@case(
    "a8_play_calling", "posteam:l down:l zone:s pass_rate:d league_pass_rate:d",
    q(GAMES, PLAYS, PROFILE, """c AS (SELECT team AS posteam, down, field_zone AS zone, coalesce(sum(w) FILTER (play_type = 'pass'), 0) AS h, sum(w) AS w FROM prof GROUP BY ALL)""",
      "SELECT posteam, down, zone, h / w AS pass_rate, sum(h) OVER (PARTITION BY down, zone) / sum(w) OVER (PARTITION BY down, zone) AS league_pass_rate FROM c"),
)
def a8_play_calling(spark, d):
    p = profile(spark, d).withColumnsRenamed({"team": "posteam", "field_zone": "zone"})
    return A.play_calling(p, ["posteam", "down", "zone"], "w")


@case(
    "a9_ratio_to_total", "opp:l run:d pass:d",
    q(GAMES, PLAYS, """SELECT opp, coalesce(sum(yards * w) FILTER (kind = 'OR') / sum(w) FILTER (kind = 'OR') / (SELECT sum(yards * w) / sum(w) FROM plays WHERE kind = 'OR'), 1) AS run,
      coalesce(sum(yards * w) FILTER (kind = 'FN' AND dist < 5) / sum(w) FILTER (kind = 'FN' AND dist < 5) / (SELECT sum(yards * w) / sum(w) FROM plays WHERE kind = 'FN' AND dist < 5), 1) AS pass
      FROM plays GROUP BY ALL"""),
)
def a9(spark, d):
    x = {"run": ("yards", F.col("kind") == "OR"), "pass": ("yards", (F.col("kind") == "FN") & (F.col("dist") < 5))}
    return A.ratio_to_total(plays(spark, d), "opp", x, "w")


@case(
    "a10_shrunk_rate", "team:l hits:l n:l rate:d",
    q(GAMES, PLAYS, """SELECT team, count(*) FILTER (qty >= 45) AS hits, count(*) AS n,
      (count(*) FILTER (qty >= 45) + 50 * (SELECT count(*) FILTER (qty >= 45) / CAST(count(*) AS DOUBLE) FROM plays)) / (count(*) + 50) AS rate FROM plays GROUP BY ALL"""),
)
def a10(spark, d):
    return A.shrunk_rate(plays(spark, d), "team", F.col("qty") >= 45)


@case(
    "a11_pivot_mean", "season:l team:l OR_x:d OR_yards:d FN_x:d FN_yards:d OA_x:d OA_yards:d",
    q(GAMES, PLAYS, "SELECT season, team, " + ", ".join(f"avg({m}) FILTER (kind = '{v}') AS {v}_{m}" for v in ("OR", "FN", "OA") for m in ("x", "yards")) + " FROM plays GROUP BY ALL"),
)
def a11(spark, d):
    return A.pivot_mean(plays(spark, d), ["season", "team"], "kind", ["OR", "FN", "OA"], ["x", "yards"])


@case(
    "a12_agreement", "pearson:d spearman:d mae:d rmse:d std_a:d std_b:d std_ratio:d",
    """WITH r AS (SELECT l_quantity AS a, l_extendedprice / 2000 AS b,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / CAST(2 AS DOUBLE) AS ra,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / CAST(2 AS DOUBLE) AS rb FROM lineitem)
       SELECT corr(a, b) AS pearson, corr(ra, rb) AS spearman, avg(abs(a - b)) AS mae, sqrt(avg((a - b) * (a - b))) AS rmse,
         stddev_samp(a) AS std_a, stddev_samp(b) AS std_b, stddev_samp(a) / stddev_samp(b) AS std_ratio FROM r""",
)
def a12(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 2000).alias("b"))
    return A.agreement(li, "a", "b")


@case(
    "a13_summary", "pool:s n:l mean:d std:d variance:d4 min:d max:d share_negative:d share_positive:d share_3:d share_7:d p10:d p25:d median:d p75:d p90:d",
    """WITH m AS (SELECT event_type AS pool, floor(value) - 40 AS v FROM events)
       SELECT pool, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, var_samp(v) AS variance, min(v) AS min, max(v) AS max,
         avg(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS share_negative, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS share_positive,
         avg(CASE WHEN abs(v) = 3 THEN 1 ELSE 0 END) AS share_3, avg(CASE WHEN abs(v) = 7 THEN 1 ELSE 0 END) AS share_7,
         quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90
       FROM m GROUP BY ALL""",
)
def a13(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("pool"), (F.floor("value") - 40).cast("double").alias("v"))
    return A.summarize(e, ["pool"], "v")


@case(
    "a14_rollup_path", "order_id:l picks:a survival:d14 pct:d14",
    """WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS line, min(l_partkey) AS part, min(1 - l_discount) AS keep, min(l_tax + 0.5) AS pct FROM lineitem GROUP BY ALL)
       SELECT order_id, list(part ORDER BY line) AS picks, product(keep) AS survival, product(pct) AS pct FROM l GROUP BY ALL""",
)
def a14(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")).agg(
        F.min("l_partkey").alias("part"), F.min(1 - F.col("l_discount")).alias("keep"), F.min(F.col("l_tax") + 0.5).alias("pct")
    )
    return A.rollup_path(li, ["order_id"], "part", "line", {"survival": "keep", "pct": "pct"})


@case(
    "a18_region_summary", "division:s teams:l at_line:d at_win:d",
    q(GAMES, TEAM_GAMES, DIM, "t AS (SELECT team, avg(line) FILTER (week > 10) AS line, avg(win) FILTER (is_away AND team % 3 <> 0) AS win FROM tg GROUP BY ALL)",
      "SELECT division, count(*) AS teams, avg(line) AS at_line, avg(win) AS at_win FROM t JOIN dim USING (team) GROUP BY ALL"),
)
def a18(spark, d):
    t = team_games(spark, d).groupBy("team").agg(
        F.avg(F.when(F.col("week") > 10, F.col("line"))).alias("line"),
        F.avg(F.when(F.col("is_away") & (F.col("team") % 3 != 0), F.col("win"))).alias("win"),
    )
    return A.region_summary(t.join(dim(spark, d), "team"), "division", ["line", "win"])


@case(
    "a19_split_diff", "team:l baseline:d OR_diff:d FA_diff:d XX_diff:d",
    q(GAMES, PLAYS, """SELECT team, sum(x * w) / sum(w) AS baseline, CASE WHEN count(*) FILTER (kind = 'OR') >= 300 THEN sum(x * w) FILTER (kind = 'OR') / sum(w) FILTER (kind = 'OR') - sum(x * w) / sum(w) END AS "OR_diff",
      CASE WHEN count(*) FILTER (kind = 'FA') >= 300 THEN sum(x * w) FILTER (kind = 'FA') / sum(w) FILTER (kind = 'FA') - sum(x * w) / sum(w) END AS "FA_diff", NULL AS "XX_diff" FROM plays GROUP BY ALL"""),
)
def a19(spark, d):
    return A.split_diff(plays(spark, d), "team", "kind", ["OR", "FA", "XX"], "x", "w", min_n=300)


@case(
    "a20_weight_share", "team:l share:d historical:d",
    q(GAMES, PLAYS, "SELECT team, coalesce(sum(w) FILTER (passer = 7), 0) / sum(w) AS share, sum(CASE WHEN passer > 20 THEN 0 ELSE yards END * w) / sum(w) AS historical FROM plays GROUP BY ALL"),
)
def a20(spark, d):
    p = plays(spark, d).withColumn("r", F.when(F.col("passer") <= 20, F.col("yards")))
    return A.weight_share(p, "team", F.col("passer") == 7, "w", "r")


@case(
    "a21_efficiency", "game_id:l value:d volume:d efficiency:d",
    q(GAMES, PLAYS, "SELECT game_id, sum(x + yards) AS value, sum(qty) AS volume, sum(x + yards) / sum(qty) AS efficiency FROM plays GROUP BY ALL HAVING sum(qty) > 50"),
)
def a21(spark, d):
    return A.efficiency(plays(spark, d), "game_id", F.col("x") + F.col("yards"), F.col("qty"))


@case("a23_distinct", "season:l week:l", q(GAMES, "SELECT DISTINCT season, week FROM games"))
def a23(spark, d):
    return A.distinct_values(games(spark, d), ["season", "week"])


def ratings_sql(passes: int, m: float, edges: str = "edges", key: str = "") -> list[str]:
    """The passes as a recursion: r = own + m * opponents' r of the pass before; ``rated`` is the last one. ``key`` is one more key column."""
    k, own, same = (f"{key}, ", f"sh.{key}, ", f" AND p.{key} = sh.{key}") if key else ("", "", "")
    return [
        f"tot AS MATERIALIZED (SELECT {k}team, sum(weight) AS tw, sum(net_epa * weight) / sum(weight) AS be, sum(net_sr * weight) / sum(weight) AS bs FROM {edges} GROUP BY ALL)",
        f"sh AS MATERIALIZED (SELECT {k}team, opponent, sum(weight) / any_value(tw) AS s, any_value(be) AS be, any_value(bs) AS bs FROM {edges} JOIN tot USING ({k}team) GROUP BY ALL)",
        f"""rated AS MATERIALIZED (WITH RECURSIVE p AS (
          SELECT 1 AS i, {k}team, be AS epa, bs AS sr, CAST(0 AS DOUBLE) AS epa_schedule FROM tot
          UNION ALL
          SELECT any_value(p.i) + 1, {own}sh.team, any_value(be) + {m} * sum(s * p.epa), any_value(bs) + {m} * sum(s * p.sr), sum(s * p.epa)
          FROM sh JOIN p ON p.team = sh.opponent{same} WHERE p.i < {passes} GROUP BY {own}sh.team)
          SELECT {k}team, epa, sr, epa_schedule FROM p WHERE i = {passes})""",
    ]


@case(
    "i1_iterative_rating", "team:l epa:d sr:d epa_schedule:d",
    q(GAMES, PLAYS, EDGES, *ratings_sql(100, 0.86), "SELECT * FROM rated"),
)
def i1(spark, d):
    return iterative_rating(edges(spark, d), "team", "opponent", {"epa": "net_epa", "sr": "net_sr"}, "weight", K.SCHEDULE_MULTIPLIER, K.RATING_PASSES)


def _side(net: str, r: str, home: str) -> str:
    return f"sum(({net} + o.{r}) * weight) FILTER ({home}) / sum(weight) FILTER ({home})"


@case(
    "a22_home_split", "team:l hfa_points:d home_rating:d away_rating:d global_rating:d hfa_epa:d hfa_sr:d",
    q(GAMES, PLAYS, EDGES, *ratings_sql(50, 1.0), f"""hs AS (SELECT edges.team, {_side('net_epa', 'epa', 'is_home')} AS he, {_side('net_sr', 'sr', 'is_home')} AS hs,
        {_side('net_epa', 'epa', 'NOT is_home')} AS ae, {_side('net_sr', 'sr', 'NOT is_home')} AS sa FROM edges JOIN rated o ON o.team = edges.opponent GROUP BY edges.team)""",
      """SELECT hs.team, (he - ae) / 2 * 0.42 + (hs - sa) / 2 * 100 * 0.765 * 0.58 AS hfa_points, he * 0.42 + hs * 100 * 0.765 * 0.58 AS home_rating, ae * 0.42 + sa * 100 * 0.765 * 0.58 AS away_rating,
         epa * 0.42 + sr * 100 * 0.765 * 0.58 AS global_rating, (he - ae) / 2 AS hfa_epa, (hs - sa) / 2 AS hfa_sr FROM hs JOIN rated USING (team)"""),
)
def a22(spark, d):
    e = edges(spark, d)
    ratings = iterative_rating(e, "team", "opponent", {"epa": "net_epa", "sr": "net_sr"}, "weight", K.SPLIT_MULTIPLIER, K.SPLIT_PASSES)
    return A.home_split(e, ratings)


def adjusted_sql(side: str, me: str, them: str, key: str = "") -> str:
    sign = "-" if side == "Defense" else ""
    k, league = (f"{key}, ", f"JOIN lg USING ({key})") if key else ("", ", lg")
    return f"""SELECT *, '{side}' AS side, 100 * cume_dist() OVER (PARTITION BY {k}category ORDER BY {sign}epa) AS epa_pct, 100 * cume_dist() OVER (PARTITION BY {k}category ORDER BY {sign}sr) AS sr_pct FROM (
      SELECT {k}category, fan.{me} AS team, count(*) AS plays, sum(w) AS weight_score,
        sum(w * (x - CASE WHEN sw >= 30 THEN oe - le ELSE 0 END + CASE WHEN fan.team = home THEN -0.04 ELSE 0.04 END)) / sum(w) AS epa,
        sum(w * (success - CASE WHEN sw >= 30 THEN os - ls ELSE 0 END)) / sum(w) AS sr
      FROM fan JOIN (SELECT {k}category, {them}, sum(w) AS sw, sum(x * w) / sum(w) AS oe, sum(success * w) / sum(w) AS os FROM fan GROUP BY ALL) s USING ({k}category, {them}) {league}
      GROUP BY {k}category, fan.{me} HAVING sum(w) >= 30)"""


@case(
    "i2_opponent_adjusted", "category:s side:s team:l plays:l weight_score:d epa:d sr:d epa_pct:d sr_pct:d",
    q(GAMES, PLAYS.replace("CAST(0.00475 AS DOUBLE)", "CAST(0.0005 AS DOUBLE)"), FAN_SQL, "lg AS (SELECT sum(x * w) / sum(w) AS le, sum(success * w) / sum(w) AS ls FROM plays)",
      adjusted_sql("Offense", "team", "opp") + " UNION ALL " + adjusted_sql("Defense", "opp", "team")),
)
def i2(spark, d):
    p = plays(spark, d).withColumn("w", rating.time_decay(F.col("day"), F.lit("2001-12-31").cast("date"), 0.0005))
    return opponent_adjusted(
        p, fan_predicates(), "team", "opp", {"epa": "x", "sr": "success"}, "w", F.col("team") == F.col("home"), home_effect={"epa": K.HOME_EPA}
    )
