"""Column functions."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import DIM, GAMES, PLAYS, dim, games, table
from pickwright.catalog.joins import PRICED, PRICES_SQL, edges, EDGES, priced
from pickwright.functions import calendar, geo, labels, odds, rating, text
from pickwright.operators.aggregates import current_week
from pickwright.operators.joins import lookup_sides


def _miles(a: str, b: str) -> str:
    h = f"(sin((radians({b}.lat) - radians({a}.lat)) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin((radians({b}.lon) - radians({a}.lon)) / 2) ** 2)"
    return f"round_even(2 * atan2(sqrt({h}), sqrt(1 - {h})) * 3956, 0)"


@case(
    "f1_great_circle", "game_id:l miles:d advantage:d",
    q(GAMES, DIM, f"SELECT game_id, {_miles('h', 'a')} AS miles, {_miles('h', 'a')} - {_miles('h', 'h')} AS advantage FROM games LEFT JOIN dim h ON h.team = home LEFT JOIN dim a ON a.team = away"),
)
def f1(spark, d):
    g = lookup_sides(games(spark, d), dim(spark, d), "team", ["lat", "lon"], "home", "away")
    c = F.col
    away = geo.great_circle_miles(c("home_lat"), c("home_lon"), c("away_lat"), c("away_lon"))
    own = geo.great_circle_miles(c("home_lat"), c("home_lon"), c("home_lat"), c("home_lon"))
    return g.select("game_id", away.alias("miles"), (away - own).alias("advantage"))


ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Europe/London", "Asia/Tokyo"]


def _zone_sql(c: str) -> str:
    return f"CASE {c} % 6 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"


@case(
    "f2_zone_hours", "game_id:l hours:d adjusted:d advantage:d",
    q(GAMES, f"z AS (SELECT game_id, home, away, (day + INTERVAL 18 HOUR) AT TIME ZONE 'UTC' AS ts, {_zone_sql('home')} AS hz, {_zone_sql('away')} AS az, week FROM games)",
      "o AS (SELECT *, (epoch(ts AT TIME ZONE az) - epoch(ts AT TIME ZONE hz)) / 3600 AS hours FROM z)",
      "a AS (SELECT *, CASE WHEN week % 6 = home % 6 AND home <> away THEN 0 ELSE hours END AS adjusted FROM o)",
      "SELECT game_id, hours, adjusted, CASE WHEN adjusted = 0 THEN 0 ELSE adjusted - week % 3 END AS advantage FROM a"),
)
def f2(spark, d):
    zone = lambda c: F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col(c) % 6 + 1).cast("int"))
    g = games(spark, d).withColumns({"hz": zone("home"), "az": zone("away"), "pz": zone("week")})
    ts = F.col("day").cast("timestamp") + F.expr("INTERVAL 18 HOURS")
    g = g.withColumn("hours", geo.zone_hours(ts, F.col("az"), F.col("hz")))
    g = g.withColumn("adjusted", geo.adjusted_zone_change(F.col("hours"), F.col("pz"), F.col("hz"), F.col("home"), F.col("away")))
    return g.withColumn("advantage", geo.zone_advantage(F.col("adjusted"), F.col("week") % 3))


@case(
    "f3_time_decay", "event_id:l w:d8 zone_w:d8",
    """SELECT event_id, exp(-CAST(0.00475 AS DOUBLE) * date_diff('day', CAST(ts AS DATE), DATE '2024-12-31')) AS w,
       exp(-CAST(0.0025 AS DOUBLE) * date_diff('day', CAST(ts AS DATE), DATE '2024-12-31')) AS zone_w FROM events""",
)
def f3(spark, d):
    day, end = F.to_date("ts"), F.lit("2024-12-31").cast("date")
    return table(spark, d, "events").select("event_id", rating.time_decay(day, end).alias("w"), rating.time_decay(day, end, 0.0025).alias("zone_w"))


def _implied(c: str) -> str:
    return f"round_even(CASE WHEN {c} > 0 THEN 100 / CAST({c} + 100 AS DOUBLE) ELSE abs({c}) / CAST(abs({c}) + 100 AS DOUBLE) END, 4)"


IMPLIED = f"imp AS (SELECT *, {_implied('home_price')} AS hi, {_implied('away_price')} AS ai FROM priced)"
FAIR = "fair AS (SELECT *, round_even(hi / (hi + ai), 4) AS hf, round_even(ai / (hi + ai), 4) AS af FROM imp)"
_PRICED = (GAMES, PRICES_SQL, PRICED)


@case("f4_implied_probability", "game_id:l home_p:d away_p:d", q(*_PRICED, IMPLIED, "SELECT game_id, hi AS home_p, ai AS away_p FROM imp"))
def f4(spark, d):
    p = priced(spark, d)
    return p.select("game_id", odds.implied_probability(F.col("home_price")).alias("home_p"), odds.implied_probability(F.col("away_price")).alias("away_p"))


@case(
    "f5_american_to_decimal", "game_id:l dec:d",
    q(*_PRICED, "SELECT game_id, round_even(CASE WHEN home_price > 0 THEN home_price / CAST(100 AS DOUBLE) + 1 ELSE 100 / CAST(abs(home_price) AS DOUBLE) + 1 END, 2) AS dec FROM priced"),
)
def f5(spark, d):
    return priced(spark, d).select("game_id", odds.american_to_decimal(F.col("home_price")).alias("dec"))


@case(
    "f6_decimal_to_american", "event_id:l price:l",
    "SELECT event_id, round_even(CASE WHEN x >= 2 THEN (x - 1) * 100 ELSE -100 / (x - 1) END, 0) AS price FROM (SELECT event_id, 1 + (value + CAST(0.013 AS DOUBLE)) / 40 AS x FROM events)",
)
def f6(spark, d):
    return table(spark, d, "events").select("event_id", odds.decimal_to_american(1 + (F.col("value") + 0.013) / 40).alias("price"))


@case("f7_fair_odds", "game_id:l home_fair:d away_fair:d", q(*_PRICED, IMPLIED, FAIR, "SELECT game_id, hf AS home_fair, af AS away_fair FROM fair"))
def f7(spark, d):
    return _fair(priced(spark, d))


def _fair(p):
    p = p.withColumns({"hi": odds.implied_probability(F.col("home_price")), "ai": odds.implied_probability(F.col("away_price"))})
    return p.withColumns({"home_fair": odds.fair_probability(F.col("hi"), F.col("ai")), "away_fair": odds.fair_probability(F.col("ai"), F.col("hi"))})


@case("f8_win_advantage", "game_id:l home_adv:d away_adv:d", q(*_PRICED, IMPLIED, FAIR, "SELECT game_id, round_even(hf - 0.5, 4) AS home_adv, round_even(af - 0.5, 4) AS away_adv FROM fair"))
def f8(spark, d):
    p = _fair(priced(spark, d))
    return p.select("game_id", odds.win_advantage(F.col("home_fair")).alias("home_adv"), odds.win_advantage(F.col("away_fair")).alias("away_adv"))


@case("f9_favorite", "game_id:l favorite:l", q(*_PRICED, "SELECT game_id, CASE WHEN home_price IS NOT NULL THEN CASE WHEN home_price <= -110 THEN home ELSE away END END AS favorite FROM priced"))
def f9(spark, d):
    return priced(spark, d).select("game_id", odds.favorite(F.col("home_price"), F.col("home"), F.col("away")).alias("favorite"))


TG_SQL = "make_date(season, 11, 1) + CAST((11 - isodow(make_date(season, 11, 1))) % 7 + 21 AS INT)"


@case("f10_thanksgiving", "game_id:l holiday:t until:l", q(GAMES, f"SELECT game_id, {TG_SQL} AS holiday, date_diff('day', day, {TG_SQL}) AS until FROM games"))
def f10(spark, d):
    h = calendar.thanksgiving(F.col("season"))
    return games(spark, d).select("game_id", h.alias("holiday"), F.datediff(h, "day").alias("until"))


@case(
    "f11_week_number", "game_id:l number:l holiday_week:l",
    q(GAMES, f"""SELECT game_id, CAST(floor(date_diff('day', f, day) / 7) AS INT) + 1 AS number, CAST(floor(date_diff('day', f, {TG_SQL}) / 7) AS INT) + 2 AS holiday_week
      FROM games JOIN (SELECT season, min(day) AS f FROM games GROUP BY ALL) USING (season)"""),
)
def f11(spark, d):
    g = games(spark, d)
    g = g.join(g.groupBy("season").agg(F.min("day").alias("first")), "season")
    return g.select(
        "game_id", calendar.week_number(F.col("day"), F.col("first")).alias("number"),
        calendar.week_number(calendar.thanksgiving(F.col("season")), F.col("first"), 2).alias("holiday_week"),
    )


@case(
    "f12_current_week", "season:l as_of:t current_week:l",
    q(GAMES, "a AS (SELECT DISTINCT season, make_date(season, m, 20) AS as_of FROM games, (VALUES (1), (3), (4), (12)) v(m))",
      "w AS (SELECT season, as_of, (SELECT max(week) FROM games g WHERE g.season = a.season AND g.day <= as_of) AS w FROM a)",
      """SELECT season, as_of, CASE WHEN w IS NULL THEN 1 ELSE least(w + 1 + CASE WHEN as_of >= make_date(season, 3, 1) THEN 1 ELSE 0 END + CASE WHEN as_of >= make_date(season, 12, 26) THEN 1 ELSE 0 END, 19) END AS current_week FROM w"""),
)
def f12(spark, d):
    g = games(spark, d)
    months = F.explode(F.array(*[F.lit(m) for m in (1, 3, 4, 12)]))
    a = g.select("season").distinct().select("season", months.alias("m"))
    s = F.col("season")
    a = a.select("season", F.make_date(s, F.col("m"), F.lit(20)).alias("as_of"), F.make_date(s, F.lit(3), F.lit(1)).alias("h1"), F.make_date(s, F.lit(12), F.lit(26)).alias("h2"))
    return current_week(g, a, ["season"], "day", "week", ["h1", "h2"])


@case("f13_season_of", "game_id:l five:l six:l", q(GAMES, "SELECT game_id, CASE WHEN month(day) < 5 THEN year(day) - 1 ELSE year(day) END AS five, CASE WHEN month(day) < 6 THEN year(day) - 1 ELSE year(day) END AS six FROM games"))
def f13(spark, d):
    return games(spark, d).select("game_id", calendar.season_of(F.col("day")).alias("five"), calendar.season_of(F.col("day"), 6).alias("six"))


@case("f14_clock_label", "event_id:l label:s", "SELECT event_id, lower(strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%I:%M %p')) AS label FROM events")
def f14(spark, d):
    return table(spark, d, "events").select("event_id", calendar.clock_label(F.col("ts").cast("timestamp")).alias("label"))


@case(
    "f15_blended_rating", "game_id:l team:l power:d adjustment:d",
    q(GAMES, PLAYS, EDGES, """SELECT game_id, team, (net_epa * 0.42 + net_sr * 100 * 0.765 * 0.58) * 0.99 * 1.04 AS power,
      (net_sr - weight) * coalesce(CASE WHEN team % 2 = 0 THEN 30 + opponent END, 40) / 2.1 AS adjustment FROM edges"""),
)
def f15(spark, d):
    volume = F.when(F.col("team") % 2 == 0, 30.0 + F.col("opponent"))
    return edges(spark, d).select(
        "game_id", "team", rating.power_rating(F.col("net_epa"), F.col("net_sr")).alias("power"),
        rating.starter_adjustment(F.col("net_sr"), F.col("weight"), volume).alias("adjustment"),
    )


@case(
    "f16_edge_label", "game_id:l label:s",
    q(GAMES, "e AS (SELECT game_id, CASE WHEN game_id % 17 = 0 THEN NULL ELSE spread END AS s, total / 5000 AS run, home_score * 1.5 AS pass, 40.0 - week AS deep FROM games)",
      "b AS (SELECT *, greatest(run, pass, deep) AS away_best, greatest(run - 10, deep) AS home_best FROM e)",
      """SELECT game_id, CASE WHEN s IS NULL THEN 'Unknown' WHEN s > 0 THEN CASE WHEN away_best > 30 THEN printf('Underdog Edge: %s (+%.1f)', CASE away_best WHEN run THEN 'Run' WHEN pass THEN 'Pass' ELSE 'Deep' END, away_best) ELSE 'No Glaring Mismatch' END
        WHEN s < 0 THEN CASE WHEN home_best > 30 THEN printf('Underdog Edge: %s (+%.1f)', CASE home_best WHEN run - 10 THEN 'Run' ELSE 'Deep' END, home_best) ELSE 'No Glaring Mismatch' END ELSE 'Pick''em' END AS label FROM b"""),
)
def f16(spark, d):
    run, deep = F.col("total") / 5000, 40.0 - F.col("week")
    spread = F.when(F.col("game_id") % 17 != 0, F.col("spread"))
    away = {"Run": run, "Pass": F.col("home_score") * 1.5, "Deep": deep}
    return games(spark, d).select("game_id", labels.edge_label(spread, {"Run": run - 10, "Deep": deep}, away).alias("label"))


@case(
    "f17_strings", "p_partkey:l bare:s code:s number:d has_ring:b padded:s",
    """SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_size % 2 = 0 THEN ' (W)' ELSE ' (L)' END, '\\s\\((W|L|tie|PPD)\\)', '', 'g') AS bare, substr(upper(p_brand), 1, 3) AS code,
       CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS DOUBLE) AS number, p_name LIKE '%ring%' AS has_ring, rtrim(p_type || '%%', '%') AS padded FROM part""",
)
def f17(spark, d):
    p = table(spark, d, "part")
    marked = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (W)").otherwise(" (L)"))
    return p.select(
        "p_partkey", text.strip_marks(marked).alias("bare"), F.substring(F.upper("p_brand"), 1, 3).alias("code"),
        text.number_in(F.col("p_brand"), r"#(\d+)").alias("number"), F.col("p_name").contains("ring").alias("has_ring"),
        F.rtrim(F.concat("p_type", F.lit("%%")), F.lit("%")).alias("padded"),
    )


@case(
    "f18_dates", "event_id:l parsed:t weekday:l month:s days:l",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS parsed, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m') AS month,
       date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS days FROM events""",
)
def f18(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    raw = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(day)
    start = calendar.start_of_day(F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", calendar.safe_date(raw).alias("parsed"), F.weekday(start).alias("weekday"), F.date_format("ts", "yyyy-MM").alias("month"),
        F.datediff(start.cast("date"), F.lit("2023-12-25").cast("date")).alias("days"),
    )


@case(
    "f19_collections", "event_id:l k:l known:b label:s",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type IN ('view', 'click') AS known,
       CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'used' END AS label FROM events""",
)
def f19(spark, d):
    names = F.create_map(F.lit("view"), F.lit("seen"), F.lit("click"), F.lit("used"))
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"),
        F.array_contains(F.array(F.lit("view"), F.lit("click")), F.col("event_type")).alias("known"), names[F.col("event_type")].alias("label"),
    )
