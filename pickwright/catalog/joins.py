"""Joins."""

from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import DIM, GAMES, PICKS, PLAYS, TEAM_GAMES, dim, games, picks, plays, table, team_games
from pickwright.functions import rating
from pickwright.operators import joins
from pickwright.operators.aggregates import game_stats
from pickwright.operators.scenarios import expand_outcomes

CUTS = [(y, f"{y}-{md}") for y in range(1995, 2002) for md in ("03-15", "11-26", "12-26") if not (y == 1997 and md == "03-15") and y != 1999]
CUTS_SQL = "cuts(year, cutoff) AS (VALUES " + ", ".join(f"({y}, DATE '{c}')" for y, c in CUTS) + ")"
PRICES_SQL = "prices(k, f, u) AS (VALUES " + ", ".join(f"(CAST({k} AS DOUBLE), {f}, {u})" for k, (f, u) in K.SPREAD_PRICES.items()) + ")"


@case(
    "j1_lookup_sides", "game_id:l home_name:s home_division:s home_lat:d away_name:s away_division:s away_lat:d",
    q(GAMES, DIM, """SELECT game_id, h.name AS home_name, coalesce(h.division, 'NONE') AS home_division, h.lat AS home_lat, a.name AS away_name,
      coalesce(a.division, 'NONE') AS away_division, a.lat AS away_lat FROM games LEFT JOIN dim h ON h.team = home LEFT JOIN dim a ON a.team = away"""),
)
def j1(spark, d):
    return joins.lookup_sides(games(spark, d), dim(spark, d), "team", ["name", "division", "lat"], "home", "away", {"division": "NONE"})


@case(
    "j2_two_roles", "game_id:l season:l home_strength:d home_n:l away_strength:d away_n:l",
    q(GAMES, PLAYS, "st AS (SELECT season + 1 AS season, team, avg(x) AS strength, count(*) AS n FROM plays GROUP BY ALL)",
      """SELECT game_id, games.season, h.strength AS home_strength, h.n AS home_n, a.strength AS away_strength, a.n AS away_n FROM games
         LEFT JOIN st h ON h.season = games.season AND h.team = home LEFT JOIN st a ON a.season = games.season AND a.team = away"""),
)
def j2(spark, d):
    # last season's strength: the first season has none
    stats = plays(spark, d).groupBy((F.col("season") + 1).alias("season"), "team").agg(F.avg("x").alias("strength"), F.count("*").alias("n"))
    return joins.join_two_roles(games(spark, d), stats, home="home", away="away")


@case(
    "j3_enrich", "doc_id:l lang:s n_chars:l quality:l toxic:l",
    "SELECT doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def j3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return joins.enrich(docs, table(spark, d, "labels"), ["doc_id"])


EDGES = f"""gs AS (SELECT game_id, team, sum(greatest(least(x, CAST(4.875 AS DOUBLE)), CAST(-4.875 AS DOUBLE))) AS total, sum(success) / count(*) AS rate,
    avg(w) AS weight, any_value(home) AS home FROM plays GROUP BY game_id, team),
  edges AS (SELECT game_id, a.team, b.team AS opponent, a.weight, a.home = a.team AS is_home,
    CASE WHEN abs(a.total - b.total) > CAST({K.GAME_CAP} AS DOUBLE)
      THEN sign(a.total - b.total) * (CAST({K.GAME_CAP} AS DOUBLE) + 2 * ln(abs(a.total - b.total) - CAST({K.GAME_CAP} AS DOUBLE) + 1)) ELSE a.total - b.total END AS net_epa,
    a.rate - b.rate AS net_sr FROM gs a JOIN gs b USING (game_id) WHERE a.team <> b.team)"""


def edges(spark, d):
    p = plays(spark, d).withColumn("capped", rating.winsorize(F.col("x"))).withColumn("at_home", F.col("home") == F.col("team"))
    stats = game_stats(p, ["game_id", "team", "at_home"], "capped", "success", "w")
    nets = {"net_epa": ("total", rating.damped_cap), "net_sr": ("rate", None)}
    return joins.pair_sides(stats, "game_id", "team", ["weight", "at_home"], nets).withColumnRenamed("at_home", "is_home")


@case("j4_pair_sides", "game_id:l team:l opponent:l weight:d8 is_home:b net_epa:d net_sr:d", q(GAMES, PLAYS, EDGES, "SELECT * FROM edges"))
def j4(spark, d):
    return edges(spark, d)


@case(
    "j5_opponent_value", "game_id:l team:l opp:l line:d opponent_line:d",
    q(GAMES, TEAM_GAMES, """SELECT a.game_id, a.team, a.opp, a.line, b.line AS opponent_line FROM tg a
      LEFT JOIN tg b ON a.game_id = b.game_id AND a.team = b.opp AND a.opp = b.team WHERE a.team < a.opp"""),
)
def j5(spark, d):
    tg = team_games(spark, d).select("game_id", "team", "opp", "line")
    return joins.opponent_value(tg, ["game_id"], "team", "opp", "line", one_per_game=True)


@case(
    "j6_overlay", "game_id:l spread:d total:d safe_spread:d",
    q(GAMES, """live AS (SELECT l_orderkey AS game_id, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE sum(l_quantity) END AS spread, max(l_extendedprice) AS total
        FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey)""",
      """SELECT g.game_id, CASE WHEN l.game_id IS NOT NULL THEN l.spread ELSE g.spread END AS spread, CASE WHEN l.game_id IS NOT NULL THEN l.total ELSE g.total END AS total,
         coalesce(l.spread, g.spread) AS safe_spread FROM games g LEFT JOIN live l USING (game_id)"""),
)
def j6(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_orderkey") % 2 == 0).groupBy(F.col("l_orderkey").alias("game_id"))
    live = li.agg(
        F.when(F.col("game_id") % 4 != 0, F.sum("l_quantity")).alias("spread"), F.max("l_extendedprice").alias("total"),
    ).withColumn("safe_spread", F.col("spread"))
    base = games(spark, d).select("game_id", "spread", "total", F.col("spread").alias("safe_spread"))
    out = joins.overlay(base, live, ["game_id"], ["spread", "total"])
    return joins.overlay(out, live, ["game_id"], ["safe_spread"], keep_on_null=True)


@case(
    "j7_shift_weeks", "game_id:l week:l contest_week:l",
    q(GAMES, CUTS_SQL, "SELECT game_id, week, week + (SELECT count(*) FROM cuts WHERE year = season AND cutoff <= day) AS contest_week FROM games"),
)
def j7(spark, d):
    cuts = spark.createDataFrame(CUTS, "year int, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    return joins.shift_weeks(games(spark, d), cuts, "season", "day", "week", "contest_week")


# three quarters of the line, so that rounding to half points matters
PRICED = """priced AS (SELECT g.*, CASE WHEN g.hp IS NOT NULL AND g.ap IS NOT NULL OR s IS NULL THEN hp WHEN s > 0 THEN f WHEN s < 0 THEN u ELSE -110 END AS home_price,
    CASE WHEN g.hp IS NOT NULL AND g.ap IS NOT NULL OR s IS NULL THEN ap WHEN s > 0 THEN u WHEN s < 0 THEN f ELSE -110 END AS away_price
  FROM (SELECT *, spread * 4.75 AS s, CASE WHEN game_id % 3 <> 0 THEN NULL WHEN raw_price >= 100 THEN raw_price ELSE -100 - abs(raw_price) END AS hp,
          CASE WHEN home_score > 22 THEN -120 END AS ap FROM games) g
  LEFT JOIN prices ON k = least(round_even(abs(s) * 2, 0) / 2, 30))"""


def priced(spark, d):
    g = games(spark, d)
    p = F.col("raw_price")
    g = g.withColumns(
        {
            "s": F.col("spread") * 4.75,
            "home_price": F.when(F.col("game_id") % 3 == 0, F.when(p >= 100, p).otherwise(-100 - F.abs(p))),
            "away_price": F.when(F.col("home_score") > 22, -120),
        }
    )
    return joins.nearest_lookup(g, "s", "home_price", "away_price")


@case("j8_nearest_price", "game_id:l s:d home_price:l away_price:l", q(GAMES, PRICES_SQL, PRICED, "SELECT * FROM priced"))
def j8(spark, d):
    return priced(spark, d)


# tens of thousands of unevenly spaced keys, some of them in one segment only
NEAREST = """keys AS (SELECT l_returnflag AS mode, l_extendedprice AS price, count(*) AS n, min(l_orderkey) AS least FROM lineitem GROUP BY ALL),
  asked AS (SELECT o_orderkey, o_totalprice / 3 AS x, ['A', 'N', 'R', 'X'][CAST(o_custkey % 4 + 1 AS INT)] AS mode FROM orders),
  b AS (SELECT a.*, k.price AS lo, k.n AS ln, k.least AS ll FROM asked a ASOF LEFT JOIN keys k ON a.mode = k.mode AND a.x >= k.price),
  c AS (SELECT b.*, k.price AS hi, k.n AS hn, k.least AS hl FROM b ASOF LEFT JOIN keys k ON b.mode = k.mode AND b.x <= k.price),
  d AS (SELECT *, hi IS NULL OR (lo IS NOT NULL AND x - lo <= hi - x) AS low FROM c)"""


@case(
    "j8_nearest_keys", "o_orderkey:l mode:s x:d4 price:d4 n:l least:l",
    q(NEAREST, "SELECT o_orderkey, mode, x, CASE WHEN low THEN lo ELSE hi END AS price, CASE WHEN low THEN ln ELSE hn END AS n, CASE WHEN low THEN ll ELSE hl END AS least FROM d"),
)
def j8_keys(spark, d):
    li = table(spark, d, "lineitem")
    known = li.groupBy(F.col("l_returnflag").alias("mode"), F.col("l_extendedprice").alias("price")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"))
    modes = F.array(*[F.lit(m) for m in ("A", "N", "R", "X")])
    asked = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 3).alias("x"), F.element_at(modes, (F.col("o_custkey") % 4 + 1).cast("int")).alias("mode"))
    return joins.nearest_join(asked, known, "x", "price", ["n", "least"], ["mode"])


@case(
    "j9_join_compare", "team:l line_own:d line_other:d",
    q(GAMES, TEAM_GAMES, DIM, "SELECT a.team, a.line AS line_own, rank AS line_other FROM (SELECT team, avg(line) AS line FROM tg GROUP BY ALL) a JOIN dim USING (team)"),
)
def j9(spark, d):
    """Teams outside the dimension drop out."""
    own = team_games(spark, d).groupBy("team").agg(F.avg("line").alias("line"))
    return joins.join_compare(own, dim(spark, d).select("team", F.col("rank").alias("line")), ["team"])


@case(
    "j10_exclude", "c_custkey:l c_mktsegment:s",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def j10(spark, d):
    used = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.exclude(table(spark, d, "customer"), used, ["c_custkey"])


MEMBERS = """fav AS (SELECT DISTINCT season, CASE WHEN spread > 0 THEN home ELSE away END AS team FROM games WHERE week = 48 AND spread > 6)"""


@case(
    "j11_mark_members", "game_id:l team:l holiday:l pre_holiday:l",
    q(GAMES, TEAM_GAMES, MEMBERS, """SELECT game_id, tg.team, CASE WHEN f.team IS NOT NULL AND week <= 48 THEN 1 ELSE 0 END AS holiday,
      CASE WHEN f.team IS NOT NULL AND week < 48 THEN 1 ELSE 0 END AS pre_holiday FROM tg LEFT JOIN fav f ON f.season = tg.season AND f.team = tg.team"""),
)
def j11(spark, d):
    g = games(spark, d).where((F.col("week") == 48) & (F.col("spread") > 6))
    members = g.select("season", F.when(F.col("spread") > 0, F.col("home")).otherwise(F.col("away")).alias("team"))
    tg = joins.mark_members(team_games(spark, d), members, ["season", "team"], "holiday", F.col("week") <= 48)
    return joins.mark_members(tg, members, ["season", "team"], "pre_holiday", F.col("week") < 48)


@case("j11_semi_join", "game_id:l team:l", q(GAMES, TEAM_GAMES, MEMBERS, "SELECT game_id, team FROM tg WHERE (season, team) IN (SELECT season, team FROM fav)"))
def j11_semi(spark, d):
    g = games(spark, d).where((F.col("week") == 48) & (F.col("spread") > 6))
    members = g.select("season", F.when(F.col("spread") > 0, F.col("home")).otherwise(F.col("away")).alias("team"))
    return joins.keep_members(team_games(spark, d), members, ["season", "team"])


@case(
    "j12_back_map", "game_id:l team:l late_win:d holiday_strength:d",
    q(GAMES, TEAM_GAMES, """h AS (SELECT season, team, max(win) FILTER (week = 48) AS a, max(win) FILTER (week = 52) AS b FROM tg GROUP BY ALL)""",
      """SELECT game_id, team, coalesce(a, 0) AS late_win, CASE WHEN week < 48 THEN coalesce(a, 0) ELSE 0 END + CASE WHEN week < 52 THEN coalesce(b, 0) ELSE 0 END AS holiday_strength
         FROM tg JOIN h USING (season, team)"""),
)
def j12(spark, d):
    tg = team_games(spark, d)
    tg = tg.withColumns({"pre_a": (F.col("week") < 48).cast("int"), "pre_b": (F.col("week") < 52).cast("int")})
    tg = joins.back_map(tg, F.col("week") == 48, ["season", "team"], "win", "late_win")
    return joins.holiday_strength(tg, ["season", "team"], "win", {"a": (F.col("week") == 48, "pre_a"), "b": (F.col("week") == 52, "pre_b")})


@case(
    "j13_attach_schedule", "year:l team:l slot:l is_away:b won:b game_day:t n:l",
    q(GAMES, PICKS, """g AS (SELECT season AS year, week % 16 + 1 AS slot, home, away, home_score - away_score AS mg, day FROM games)""",
      """s AS (SELECT year, slot, home AS team, false AS is_away, mg > 0 AS won, day FROM g UNION ALL SELECT year, slot, away, true, mg < 0, day FROM g)""",
      "p AS (SELECT CAST(1994 + event_id % 9 AS INT) AS year, week AS slot, team, count(*) AS n FROM picks GROUP BY ALL)",
      "SELECT p.year, p.team, p.slot, is_away, won, day AS game_day, n FROM p LEFT JOIN s ON s.year = p.year AND s.slot = p.slot AND s.team = p.team"),
)
def j13(spark, d):
    """Picks of nine years, the first and the last of them without a schedule."""
    g = games(spark, d)
    m = F.col("home_score") - F.col("away_score")
    g = g.select(
        F.col("season").alias("year"), (F.col("week") % 16 + 1).alias("slot"), "home", "away", "day",
        F.when(m > 0, F.col("home")).when(m < 0, F.col("away")).when(m == 0, F.lit(-1)).alias("winner"),
    )
    p = picks(spark, d).groupBy((F.col("event_id") % 9 + 1994).cast("int").alias("year"), F.col("week").alias("slot"), "team").agg(F.count("*").alias("n"))
    return joins.attach_schedule(p, g, ["year", "slot"], "home", "away", "winner", "day")


@case(
    "j14_attach_pick_pct", "game_id:l home_pct:d away_pct:d",
    q(GAMES, PICKS, "g AS (SELECT game_id, week % 16 + 1 AS slot, home, away FROM games)",
      "p AS (SELECT week AS slot, team, entry % 2 = 1 AS is_away, sum(pct) AS pct FROM picks GROUP BY ALL)",
      """SELECT game_id, h.pct AS home_pct, a.pct AS away_pct FROM g LEFT JOIN p h ON h.slot = g.slot AND h.team = home AND NOT h.is_away
         LEFT JOIN p a ON a.slot = g.slot AND a.team = away AND a.is_away"""),
)
def j14(spark, d):
    g = games(spark, d).select("game_id", (F.col("week") % 16 + 1).alias("slot"), "home", "away")
    p = picks(spark, d).groupBy(F.col("week").alias("slot"), "team", (F.col("entry") % 2 == 1).alias("is_away")).agg(F.sum("pct").alias("pct"))
    return joins.attach_pick_pct(g, p, ["slot"], "home", "away", "pct")


# five nations per region, whatever the scale: groups small enough to list every outcome
NATIONS = """nat AS (SELECT n_regionkey AS region, n_nationkey AS game, 'A' || n_nationkey AS a, 'B' || n_nationkey AS b,
    count(*) FILTER (c_acctbal > 4500) / CAST(count(*) AS DOUBLE) AS p, count(*) FILTER (c_mktsegment = 'BUILDING') / CAST(1000 AS DOUBLE) AS ka,
    count(*) FILTER (c_mktsegment <> 'BUILDING') / CAST(1000 AS DOUBLE) AS kb
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def nations(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    cells = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        (F.sum(F.when(F.col("c_acctbal") > 4500, 1).otherwise(0)) / F.count("*")).alias("p"),
        (F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)) / 1000).alias("ka"),
        (F.sum(F.when(F.col("c_mktsegment") != "BUILDING", 1).otherwise(0)) / 1000).alias("kb"),
    )
    return cells.join(n, "n_nationkey").select(
        F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("game"), F.concat(F.lit("A"), "n_nationkey").alias("a"),
        F.concat(F.lit("B"), "n_nationkey").alias("b"), "p", "ka", "kb",
    )


OUTCOMES = """sc AS (SELECT nat.*, s AS scenario, (s >> CAST(row_number() OVER (PARTITION BY region, s ORDER BY game) - 1 AS INT)) & 1 = 0 AS first_wins
  FROM nat JOIN (SELECT region, count(*) AS n FROM nat GROUP BY ALL) USING (region), range(64) r(s) WHERE s < 2 ** n)"""


@case("j15_expand_outcomes", "region:l game:l scenario:l first_wins:b", q(NATIONS, OUTCOMES, "SELECT * FROM sc"))
def j15(spark, d):
    return expand_outcomes(nations(spark, d), ["region"], "game")
