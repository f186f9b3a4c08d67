"""Row-level operators."""

from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import DIM, GAMES, PICKS, PLAYS, TEAM_GAMES, dim, games, picks, plays, table, team_games
from pickwright.functions import labels, rating
from pickwright.operators import rows
from pickwright.operators.joins import lookup_sides
from pickwright.operators.windows import back_to_back, count_in_days, opponent_rest, rest_days, running_advantage
from pickwright.session import cut_lineage


@case("p1_project", "customer:l segment:s balance:d", "SELECT c_custkey AS customer, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def p1(spark, d):
    names = {"c_custkey": "customer", "c_mktsegment": "segment", "c_acctbal": "balance"}
    return rows.project(table(spark, d, "customer"), names, ["customer", "segment", "balance", "absent"], drop=["c_name", "no_such"])


@case(
    "p2_normalize_codes", "c_custkey:l c_mktsegment:s fixed:s",
    """SELECT c_custkey, CASE WHEN length(c_mktsegment) > 8 THEN substr(c_mktsegment, 1, 3) ELSE c_mktsegment END AS c_mktsegment,
       CASE c_custkey % 9 WHEN 0 THEN 'LA' WHEN 1 THEN 'ARI' ELSE 'K' || (c_custkey % 9) END AS fixed FROM customer""",
)
def p2(spark, d):
    c = table(spark, d, "customer")
    alias = c.where(F.length("c_mktsegment") > 8).select(
        F.col("c_mktsegment").alias("alias"), F.substring("c_mktsegment", 1, 3).alias("code")
    ).distinct()
    raw = F.when(F.col("c_custkey") % 9 == 0, "STL").when(F.col("c_custkey") % 9 == 1, "ARZ").otherwise(F.concat(F.lit("K"), F.col("c_custkey") % 9))
    return rows.normalize_codes(rows.normalize_codes(c.withColumn("fixed", raw), "c_mktsegment", alias), "fixed", K.CODE_ALIASES)


_LABEL_SQL = """CASE p_size % 5 WHEN 0 THEN p_name || ' (W)' WHEN 1 THEN '@' || p_name || chr(160) || '(tie)' WHEN 2 THEN chr(10) || '  +' || p_brand
  WHEN 3 THEN 'NE' || (p_size % 10) ELSE 'BYE' END"""


@case(
    "p3_clean_label", "p_partkey:l label:s",
    f"""WITH a AS (SELECT p_partkey, {_LABEL_SQL} AS raw FROM part),
      b AS (SELECT p_partkey, regexp_replace(substr(trim(regexp_replace(regexp_replace(raw, '[\\s\\x{{00A0}}]\\((W|L|tie|PPD)\\)', '', 'g'),
        '[@\\t\\n+\\-\\x{{00A0}}]', '', 'g')), 1, 3), '^(.{{2}})\\d$', '\\1') AS label FROM a)
      SELECT * FROM b WHERE label <> 'BYE'""",
)
def p3(spark, d):
    p = table(spark, d, "part")
    m = F.col("p_size") % 5
    raw = (
        F.when(m == 0, F.concat("p_name", F.lit(" (W)")))
        .when(m == 1, F.concat(F.lit("@"), "p_name", F.lit("\u00a0(tie)")))
        .when(m == 2, F.concat(F.lit("\n  +"), "p_brand"))
        .when(m == 3, F.concat(F.lit("NE"), F.col("p_size") % 10))
        .otherwise("BYE")
    )
    return rows.clean_label(p.select("p_partkey", raw.alias("label")), "label")


@case(
    "p4_parse_percent", "event_id:l pct:d8 filled:d8",
    """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN CAST(0 AS DOUBLE) WHEN user_id % 10 = 1 THEN NULL ELSE value / 100 END AS pct,
       CASE WHEN user_id % 10 < 2 THEN CAST(0 AS DOUBLE) ELSE value / 100 END AS filled FROM events""",
)
def p4(spark, d):
    u = F.col("user_id") % 10
    text = F.when(u == 0, "--").when(u == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("%")))
    e = table(spark, d, "events").select("event_id", text.alias("pct"), text.alias("filled"))
    return rows.parse_percent(rows.parse_percent(e, "pct"), "filled", null_as_zero=True)


@case(
    "p5_filter_events", "game_id:l team:l day:t kind:s wp:d",
    q(GAMES, PLAYS, """SELECT * FROM plays WHERE wp >= CAST(0.05 AS DOUBLE) AND wp <= CAST(0.95 AS DOUBLE) AND kind IN ('OR', 'FN')
      AND x IS NOT NULL AND day BETWEEN DATE '1997-01-01' AND DATE '2000-06-30'"""),
)
def p5(spark, d):
    return rows.filter_events(
        plays(spark, d), "wp", kind="kind", kinds=["OR", "FN"], not_null=["x", "success"],
        day="day", start=F.lit("1997-01-01").cast("date"), as_of=F.lit("2000-06-30").cast("date"),
    )


@case(
    "p6_winsorize", "event_id:l capped:d",
    "SELECT event_id, greatest(least(value / 10 - 5, CAST(4.875 AS DOUBLE)), CAST(-4.875 AS DOUBLE)) AS capped FROM events",
)
def p6(spark, d):
    return table(spark, d, "events").select("event_id", rating.winsorize(F.col("value") / 10 - 5).alias("capped"))


@case(
    "p7_damped_cap", "event_id:l capped:d",
    """SELECT event_id, CASE WHEN abs(z) > CAST(21.25 AS DOUBLE) THEN sign(z) * (CAST(21.25 AS DOUBLE) + 2 * ln(abs(z) - CAST(21.25 AS DOUBLE) + 1))
       ELSE z END AS capped FROM (SELECT event_id, value - 60 AS z FROM events)""",
)
def p7(spark, d):
    return table(spark, d, "events").select("event_id", rating.damped_cap(F.col("value") - 60).alias("capped"))


@case(
    "p8_results", "game_id:l winner:s loser:s winner_points:l loser_points:l margin:l spread_winner:s upset:b",
    q(GAMES, "m AS (SELECT *, home_score - away_score AS mg FROM games)", """SELECT game_id,
      CASE WHEN mg > 0 THEN CAST(home AS VARCHAR) WHEN mg < 0 THEN CAST(away AS VARCHAR) WHEN mg = 0 THEN 'Tie' END AS winner,
      CASE WHEN mg > 0 THEN CAST(away AS VARCHAR) WHEN mg < 0 THEN CAST(home AS VARCHAR) WHEN mg = 0 THEN 'Tie' END AS loser,
      CASE WHEN mg IS NOT NULL THEN greatest(home_score, away_score) END AS winner_points,
      CASE WHEN mg IS NOT NULL THEN least(home_score, away_score) END AS loser_points, mg AS margin,
      CASE WHEN mg - spread > 0 THEN CAST(home AS VARCHAR) WHEN mg - spread < 0 THEN CAST(away AS VARCHAR) WHEN mg - spread = 0 THEN 'PUSH' END AS spread_winner,
      CASE WHEN mg IS NOT NULL THEN (spread > 0 AND mg < 0) OR (spread < 0 AND mg > 0) END AS upset FROM m"""),
)
def p8(spark, d):
    g = games(spark, d).withColumns({"home": F.col("home").cast("string"), "away": F.col("away").cast("string")})
    return rows.derive_result(g, "home", "away", "home_score", "away_score", "spread")


@case(
    "p9_first_per_key", "home:l season:l game_id:l total:d",
    q(GAMES, "SELECT home, season, game_id, total FROM games QUALIFY row_number() OVER (PARTITION BY home, season ORDER BY day, game_id) = 1"),
)
def p9(spark, d):
    g = games(spark, d).select("home", "season", "day", "game_id", "total")
    return rows.dedupe(g, ["home", "season"], [F.col("day"), F.col("game_id")])


@case("p9_whole_row", "team:l week:l", q(PICKS, "SELECT DISTINCT team, week FROM picks"))
def p9_rows(spark, d):
    return rows.dedupe(picks(spark, d).select("team", "week"))


@case(
    "p10_safe_numbers", "entry:l ratio:d filled:d",
    """SELECT user_id AS entry, CASE WHEN user_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE value / (user_id % 4) END AS ratio,
       CASE WHEN user_id % 4 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END AS filled FROM events""",
)
def p10(spark, d):
    e = table(spark, d, "events")
    den = F.col("user_id") % 4
    bad = F.when(den == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = e.select(F.col("user_id").alias("entry"), labels.safe_ratio(F.col("value"), den).alias("ratio"), bad.alias("filled"))
    return rows.fill(out, {"filled": -1.0})


@case(
    "p11_buckets", "distance:s level:s single:s context:s n:l total:d4",
    q(GAMES, PLAYS, """SELECT CASE WHEN dist <= 3 THEN 'short' WHEN dist <= 7 THEN 'med' ELSE 'long' END AS distance,
      CASE WHEN qty * 5 < 160 THEN 'Low' WHEN qty * 5 < 170 THEN 'Med-Low' WHEN qty * 5 < 180 THEN 'Medium' WHEN qty * 5 < 195 THEN 'Med-High' ELSE 'High' END AS level,
      CASE WHEN qty * 3 < 70 THEN 'Low' WHEN qty * 3 < 85 THEN 'Med-Low' WHEN qty * 3 < 100 THEN 'Medium' WHEN qty * 3 < 115 THEN 'Med-High' ELSE 'High' END AS single,
      CASE WHEN field - 50 > 8 THEN 'leading' WHEN field - 50 < -8 THEN 'trailing' ELSE 'neutral' END AS context, count(*) AS n, sum(yards) AS total FROM plays GROUP BY ALL"""),
)
def p11(spark, d):
    p = rows.bucketize(plays(spark, d), "dist", [3, 7], ["short", "med", "long"], "distance")
    p = p.withColumns({"five": F.col("qty") * 5, "three": F.col("qty") * 3, "context": labels.game_context(F.col("field") - 50)})
    p = rows.bucketize(p, "five", K.VARIANCE_BOUNDS_COMBINED, K.VARIANCE_LABELS, "level", inclusive=False)
    p = rows.bucketize(p, "three", K.VARIANCE_BOUNDS_SINGLE, K.VARIANCE_LABELS, "single", inclusive=False)
    return p.groupBy("distance", "level", "single", "context").agg(F.count("*").alias("n"), F.sum("yards").alias("total"))


@case(
    "p12_source_cascade", "game_id:l fair:d source:s",
    q(GAMES, """SELECT game_id, coalesce(CAST(raw_price AS DOUBLE), CASE WHEN home_score > 20 THEN spread END, total) AS fair,
      CASE WHEN raw_price IS NOT NULL THEN 'live' WHEN home_score > 20 THEN 'model_a' ELSE 'model_b' END AS source FROM games"""),
)
def p12(spark, d):
    live = F.col("raw_price").cast("double")
    a = F.when(F.col("home_score") > 20, F.col("spread"))
    return rows.coalesce_sources(games(spark, d), {"live": live, "model_a": a, "model_b": F.col("total")}, "fair", "source")


@case(
    "p12_weather_cascade", "game_id:l temp:d wind:d precip:d weather_source:s",
    q(GAMES, """hourly AS (SELECT user_id % 32 AS home, CAST(ts AS DATE) + INTERVAL 1 YEAR - INTERVAL 29 YEAR AS day, value AS temp, value / 10 AS wind, value / 100 AS precip
        FROM events WHERE hour(ts) BETWEEN 13 AND 16)""",
      "played AS (SELECT home, CAST(day AS DATE) AS day, avg(temp) AS t, avg(wind) AS w, sum(precip) AS p FROM hourly GROUP BY ALL)",
      "monthly AS (SELECT home, month(day) AS month, avg(CASE WHEN cust % 4 > 0 AND home % 5 <> 1 THEN total END) / 10000 AS mt, avg(spread) + 10 AS mw FROM games GROUP BY ALL)",
      """SELECT game_id, CASE WHEN home % 7 = 0 THEN CAST(70 AS DOUBLE) WHEN t IS NOT NULL THEN t WHEN away_score IS NOT NULL THEN away_score ELSE coalesce(mt, 60) END AS temp,
        CASE WHEN home % 7 = 0 THEN CAST(0 AS DOUBLE) WHEN t IS NOT NULL THEN w WHEN away_score IS NOT NULL AND away_score > 30 THEN home_score ELSE coalesce(mw, 10) END AS wind,
        CASE WHEN home % 7 <> 0 AND t IS NOT NULL THEN p ELSE 0 END AS precip,
        CASE WHEN home % 7 = 0 THEN 'dome' WHEN t IS NOT NULL THEN 'hourly' WHEN away_score IS NOT NULL THEN 'row' ELSE 'monthly' END AS weather_source
        FROM games LEFT JOIN played USING (home, day) LEFT JOIN monthly ON monthly.home = games.home AND month = month(games.day)"""),
)
def p12_weather(spark, d):
    g = games(spark, d)
    ready = g.select(
        "game_id", "home", "day", (F.col("home") % 7 == 0).alias("dome"), F.col("away_score").cast("double").alias("row_temp"),
        F.when(F.col("away_score") > 30, F.col("home_score").cast("double")).alias("row_wind"),
    )
    e = table(spark, d, "events")
    hourly = e.select(
        (F.col("user_id") % 32).alias("home"), F.expr("ts + INTERVAL 1 YEAR - INTERVAL 29 YEAR").alias("ts"),
        F.col("value").alias("temp"), (F.col("value") / 10).alias("wind"), (F.col("value") / 100).alias("precip"),
    )
    measured = F.when((F.col("cust") % 4 > 0) & (F.col("home") % 5 != 1), F.col("total"))  # some places have no reading at all
    monthly = g.groupBy("home", F.month("day").alias("month")).agg(
        (F.avg(measured) / 10000).alias("month_temp"), (F.avg("spread") + 10).alias("month_wind")
    )
    return rows.weather_cascade(ready, hourly, monthly, ["home"])


@case(
    "p13_overrides", "week:l team:l pct:d avail:d",
    q(PICKS, "base AS (SELECT week, team, avg(pct) AS pct FROM picks GROUP BY ALL)",
      "ov AS (SELECT week, team, CASE WHEN sum(event_id) % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE (sum(event_id) % 100) / 100 END AS o FROM picks WHERE team % 2 = 0 GROUP BY ALL)",
      "SELECT week, team, CASE WHEN o >= 0 THEN o ELSE pct END AS pct, CASE WHEN o > CAST(-0.01 AS DOUBLE) THEN o ELSE 1 END AS avail FROM base LEFT JOIN ov USING (week, team)"),
)
def p13(spark, d):
    p = picks(spark, d)
    base = p.groupBy("week", "team").agg(F.avg("pct").alias("pct"))
    s = F.sum("event_id")
    ov = p.where(F.col("team") % 2 == 0).groupBy("week", "team").agg(F.when(s % 3 == 0, -1.0).otherwise((s % 100) / 100).alias("override"))
    out = rows.apply_overrides(base, ov, ["week", "team"], "pct")
    return out.join(ov, ["week", "team"], "left").withColumn("avail", rows.clean_availability(F.col("override")))


@case(
    "p14_consensus", "game_id:l same:b home_all:b",
    q(GAMES, """SELECT game_id, (spread > 0) = (home_score > away_score) AND (spread > 0) = (total > 200000) AND (spread > 0) = (home > away) AS same,
      spread > 0 AND home_score - away_score > 0 AND total - 200000 > 0 AND home - away > 0 AS home_all FROM games"""),
)
def p14(spark, d):
    g = games(spark, d).withColumns(
        {"w1": F.col("spread") > 0, "w2": F.col("home_score") > F.col("away_score"), "w3": F.col("total") > 200000, "w4": F.col("home") > F.col("away")}
    )
    diffs = [F.col("spread"), F.col("home_score") - F.col("away_score"), F.col("total") - 200000, F.col("home") - F.col("away")]
    return rows.all_positive(rows.consensus(g, ["w1", "w2", "w3", "w4"], "same"), diffs, "home_all")


@case(
    "p15_team_long", "game_id:l team:l opp_team:l is_away:b score:l opp_score:l margin:l",
    q(GAMES, """SELECT game_id, home AS team, away AS opp_team, false AS is_away, home_score AS score, away_score AS opp_score, home_score - away_score AS margin FROM games
      UNION ALL SELECT game_id, away, home, true, away_score, home_score, away_score - home_score FROM games"""),
)
def p15(spark, d):
    sides = {"team": ("home", "away"), "score": ("home_score", "away_score")}
    return rows.to_team_long(games(spark, d), ["game_id"], sides, {"margin": ("score", "opp_score")})


@case(
    "p16_unpivot_picks", "entry:l total_wins:l week:l pick:s",
    q(PICKS, "best AS (SELECT entry, total_wins, week, max(team) AS t FROM picks GROUP BY ALL)",
      "people AS (SELECT DISTINCT entry, total_wins FROM picks)", "weeks AS (SELECT unnest(range(1, 17)) AS week)",
      """SELECT p.entry, p.total_wins, w.week, coalesce(CAST(t AS VARCHAR), 'ELIMINATED') AS pick FROM people p CROSS JOIN weeks w
         LEFT JOIN best b ON b.entry = p.entry AND b.week = w.week"""),
)
def p16(spark, d):
    weeks = list(range(1, 17))
    wide = picks(spark, d).groupBy("entry", "total_wins").pivot("week", weeks).agg(F.max("team"))
    wide = wide.withColumnsRenamed({str(w): f"week_{w}" for w in weeks})
    return rows.unpivot_picks(wide, ["entry", "total_wins"], [f"week_{w}" for w in weeks])


def fan_predicates():
    c = F.col
    return {
        "Overall": c("kind").isNotNull(), "Run": c("kind").startswith("O"), "Pass": c("kind").startswith("F"),
        "Short": c("dist").between(0, 3), "Redzone": c("field") <= 20, "3rd_Down": c("down") == 3, "1st_Down": c("down") == 1,
    }


FAN_SQL = """fan AS (SELECT plays.*, category FROM plays, (VALUES ('Overall'), ('Run'), ('Pass'), ('Short'), ('Redzone'), ('3rd_Down'), ('1st_Down')) v(category)
  WHERE CASE category WHEN 'Overall' THEN true WHEN 'Run' THEN kind LIKE 'O%' WHEN 'Pass' THEN kind LIKE 'F%' WHEN 'Short' THEN dist BETWEEN 0 AND 3
  WHEN 'Redzone' THEN field <= 20 WHEN '3rd_Down' THEN down = 3 ELSE down = 1 END)"""


@case("p17_fan_out", "category:s n:l x:d", q(GAMES, PLAYS, FAN_SQL, "SELECT category, count(*) AS n, sum(x) AS x FROM fan GROUP BY ALL"))
def p17(spark, d):
    out = rows.fan_out(plays(spark, d), fan_predicates())
    return out.groupBy("category").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@case(
    "p18_calendar_flags", "game_id:l team:l thursday:l thursday_home:l thursday_away:l thursday_favorite:l thursday_underdog:l",
    q(GAMES, TEAM_GAMES, """t AS (SELECT *, CASE WHEN isodow(day) = 4 AND NOT (month(day) = 12 AND day(day) IN (25, 26)) THEN 1 ELSE 0 END AS th FROM tg)""",
      """SELECT game_id, team, th AS thursday, CASE WHEN th = 1 AND NOT is_away THEN 1 ELSE 0 END AS thursday_home, CASE WHEN th = 1 AND is_away THEN 1 ELSE 0 END AS thursday_away,
        CASE WHEN th = 1 AND win > 0.5 THEN 1 ELSE 0 END AS thursday_favorite, CASE WHEN th = 1 AND win <= 0.5 THEN 1 ELSE 0 END AS thursday_underdog FROM t"""),
)
def p18(spark, d):
    tg = team_games(spark, d)
    y = F.year("day")
    return rows.calendar_flags(tg, "day", "is_away", "win", [F.make_date(y, F.lit(12), F.lit(25)), F.make_date(y, F.lit(12), F.lit(26))])


_ELIGIBLE_SQL = q(
    GAMES, TEAM_GAMES, DIM,
    """r AS (SELECT tg.*, coalesce(date_diff('day', lag(day) OVER (PARTITION BY season, team ORDER BY day, game_id), day), 7) AS rest,
      is_away AND coalesce(lag(week) OVER (PARTITION BY season, team, is_away ORDER BY day, game_id) = week - 1, false) AS b2b FROM tg)""",
    "o AS (SELECT r.*, r2.rest AS opp_rest, r.rest - r2.rest AS rest_adv FROM r JOIN r r2 ON r.game_id = r2.game_id AND r.opp = r2.team)",
    "s AS (SELECT o.*, sum(rest_adv) OVER (PARTITION BY season, team ORDER BY day) AS season_adv FROM o)",
    """c AS (SELECT s.*, count(*) OVER (PARTITION BY season, team ORDER BY day RANGE BETWEEN INTERVAL 17 DAY PRECEDING AND CURRENT ROW) >= 60 AS f17,
      count(*) OVER (PARTITION BY season, team ORDER BY day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW) >= 35 AS t10 FROM s)""",
    "v AS (SELECT c.*, a.division AS da, b.division AS db FROM c LEFT JOIN dim a ON a.team = c.team LEFT JOIN dim b ON b.team = c.opp)",
    """z AS (SELECT game_id, team, list_filter([CASE WHEN line <= 0 THEN 'not_favored' END, CASE WHEN is_away AND line <= 3 THEN 'away_close' END, CASE WHEN b2b THEN 'back_to_back_away' END,
       CASE WHEN coalesce(da = db, false) AND line <= 3 THEN 'close_divisional' END, CASE WHEN coalesce(da = db, false) AND is_away THEN 'away_divisional' END,
       CASE WHEN is_away AND rest < 7 AND rest < opp_rest THEN 'short_rest' END, CASE WHEN f17 THEN 'four_in_17' END,
       CASE WHEN t10 THEN 'three_in_10' END, CASE WHEN venue % 7 = 0 THEN 'foreign_venue' END,
       CASE WHEN isodow(day) = 4 THEN 'thursday' END, CASE WHEN is_away AND isodow(day) = 4 THEN 'away_thursday' END, CASE WHEN rest_adv < 0 THEN 'weekly_rest' END,
       CASE WHEN season_adv < CASE WHEN is_away THEN -10 ELSE -5 END THEN 'season_rest' END,
       CASE WHEN is_away AND (team - opp) * 100 < -850 THEN 'travel' END, CASE WHEN team % 11 = 3 THEN 'prohibited' END,
       CASE WHEN (team + week) % 13 = 0 THEN 'already_used' END, CASE WHEN (line > 0) <> (game_id % 10 < 6) THEN 'no_consensus' END], lambda e: e IS NOT NULL) AS reject_reasons FROM v)""",
    "SELECT game_id, team, len(reject_reasons) = 0 AS eligible, reject_reasons FROM z",
)


@case("p19_eligibility", "game_id:l team:l eligible:b reject_reasons:a", _ELIGIBLE_SQL)
def p19(spark, d):
    c, season = F.col, ["season", "team"]
    tg = rest_days(team_games(spark, d), season, "day", "game_id", 7)
    tg = back_to_back(tg, season, "day", "game_id", "week", "is_away")
    tg = cut_lineage(opponent_rest(tg, "game_id", "team", "opp"))
    tg = running_advantage(tg, season, "day", "rest_adv")
    tg = count_in_days(tg, season, "day", {"four_in_17": (17, 60), "three_in_10": (10, 35)})
    tg = lookup_sides(tg, dim(spark, d), "team", ["division"], "team", "opp")
    same = F.coalesce(c("home_division") == c("away_division"), F.lit(False))
    tg = tg.withColumns(
        {
            "divisional": same, "margin": c("line"), "thursday": (F.weekday("day") == 3).cast("int"), "foreign_venue": c("venue") % 7 == 0,
            "travel_adv": (c("team") - c("opp")) * 100, "prohibited": c("team") % 11 == 3, "already_used": (c("team") + c("week")) % 13 == 0,
            "consensus": (c("line") > 0) == (c("game_id") % 10 < 6),
        }
    )
    return rows.eligible(tg, rows.pick_rules())


_ADJ = """coalesce({r}, 0) + CASE WHEN {travel} < {lim} AND home % 3 <> 0 THEN {tv} ELSE 0 END + (spread / 2) * {z} + (home - away) * {sg} * {rest} + (week - 20) * {season} + CASE WHEN home % 5 <> 0 THEN {vp} * {vm} ELSE 0 END"""


def _adj_sql(is_home: bool, p: rating.AdjustmentParams) -> str:
    return _ADJ.format(
        r="hd.rank" if is_home else "ad.rank", travel="(home - away) * 100", lim=p.travel_limit, tv=p.travel_home if is_home else p.travel_away,
        z=p.zone_home if is_home else p.zone_away, sg=1 if is_home else -1, rest=p.rest, season=p.season_rest,
        vp="CAST(1.5 AS DOUBLE)" if is_home else "CAST(-0.5 AS DOUBLE)", vm=1.0 if is_home else p.away_points,
    )


@case(
    "p20_adjusted_rating", "game_id:l home_now:d away_now:d home_pre:d away_pre:d",
    q(GAMES, DIM, f"""SELECT game_id, {_adj_sql(True, rating.CURRENT)} AS home_now, {_adj_sql(False, rating.CURRENT)} AS away_now,
      {_adj_sql(True, rating.PRESEASON)} AS home_pre, {_adj_sql(False, rating.PRESEASON)} AS away_pre
      FROM games LEFT JOIN dim hd ON hd.team = home LEFT JOIN dim ad ON ad.team = away"""),
)
def p20(spark, d):
    g = lookup_sides(games(spark, d), dim(spark, d), "team", ["rank"], "home", "away", {"rank": 0.0})
    c = F.col

    def adj(is_home, params):
        sign = 1 if is_home else -1
        return rating.adjusted_rating(
            c("home_rank") if is_home else c("away_rank"), (c("home") - c("away")) * 100, c("home") % 3 != 0, c("spread") / 2,
            (c("home") - c("away")) * sign, c("week") - 20, F.lit(1.5 if is_home else -0.5), c("home") % 5 != 0, is_home, params,
        )

    return g.withColumns(
        {
            "home_now": adj(True, rating.CURRENT), "away_now": adj(False, rating.CURRENT),
            "home_pre": adj(True, rating.PRESEASON), "away_pre": adj(False, rating.PRESEASON),
        }
    )


@case(
    "p21_compare_sides", "game_id:l winner:s difference:d both:d",
    q(GAMES, DIM, """j AS (SELECT game_id, home, away, hd.rank AS hr, ad.rank AS ar, spread FROM games LEFT JOIN dim hd ON hd.team = home LEFT JOIN dim ad ON ad.team = away)""",
      """SELECT game_id, CASE WHEN ar > hr THEN CAST(away AS VARCHAR) WHEN ar < hr THEN CAST(home AS VARCHAR) WHEN ar = hr THEN 'Tie' END AS winner,
         abs(ar - hr) AS difference, (hr + spread) / 2 AS both FROM j"""),
)
def p21(spark, d):
    g = games(spark, d).withColumns({"home_s": F.col("home").cast("string"), "away_s": F.col("away").cast("string")})
    g = lookup_sides(g, dim(spark, d), "team", ["rank"], "home", "away")
    g = rows.compare_sides(g, "home_s", "away_s", "home_rank", "away_rank")
    return rows.average_sources(g, ["home_rank", "spread"], "both")


def _matchups() -> tuple[str, str]:
    """Column kinds and SQL of every matchup category; the stand-in values differ per category."""
    kinds, made = ["game_id:l"], ["game_id"]
    for i, cat in enumerate(K.MATCHUP_CATEGORIES, 1):
        kinds += [f"Matchup_HomeOff_{cat}:d", f"Matchup_AwayOff_{cat}:d"]
        made += [f'total / {1001 * i} - (away_score + {i}) AS "Matchup_HomeOff_{cat}"', f'spread * {i} - (home_score - {i}) AS "Matchup_AwayOff_{cat}"']
    return " ".join(kinds), f"SELECT {', '.join(made)} FROM games"


@case("p22_mismatch", _matchups()[0], q(GAMES, _matchups()[1]))
def p22(spark, d):
    made, c = {}, F.col
    for i, cat in enumerate(K.MATCHUP_CATEGORIES, 1):
        made |= {
            f"home_Off_{cat}_EPA_Pct": c("total") / (1001 * i), f"away_Def_{cat}_EPA_Pct": (c("away_score") + i).cast("double"),
            f"away_Off_{cat}_EPA_Pct": c("spread") * i, f"home_Def_{cat}_EPA_Pct": (c("home_score") - i).cast("double"),
        }
    return rows.mismatch_features(games(spark, d).withColumns(made))


@case(
    "p23_expected_flow", "event_id:l expected_picks:d expected_survivors:d expected_eliminations:d survival_rate:d11 elimination_percent:d11",
    q(PICKS, """SELECT event_id, pct * 1000 AS expected_picks, pct * w * 1000 AS expected_survivors, pct * (1 - w) * 1000 AS expected_eliminations,
      w * pct * f AS survival_rate, pct - w * pct * f AS elimination_percent
      FROM (SELECT *, (team + 1) / CAST(40 AS DOUBLE) AS w, CASE week % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS f FROM picks)"""),
)
def p23(spark, d):
    p = picks(spark, d).withColumns({"w": (F.col("team") + 1) / 40, "entries": F.lit(1000)})
    return rows.expected_flow(p, "pct", "w", "entries", F.col("week") % 3 + 1)
