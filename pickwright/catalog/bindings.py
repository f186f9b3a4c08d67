"""The test tables seen as plays, games, team games and picks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.functions import rating
from pickwright.operators.rows import to_team_long
from pickwright.skew import spread

AS_OF = "2001-12-31"
TEAMS = 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- schedule ---------------------------------------------------------------
GAMES = """games AS (
  SELECT o_orderkey AS game_id, o_custkey % 32 AS home, (o_custkey * 7 + o_orderkey) % 32 AS away,
         CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS season,
         CAST(floor(dayofyear(o_orderdate) / 7) AS INT) + 1 AS week,
         round_even((o_totalprice % 31) - 15, 0) / 2 AS spread,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 45 END AS home_score,
         CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 3 + o_custkey) % 45 END AS away_score,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 400 - 250 END AS raw_price,
         o_totalprice AS total, o_custkey AS cust, o_orderpriority AS tier
  FROM orders WHERE o_custkey % 32 <> (o_custkey * 7 + o_orderkey) % 32)"""


def games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    home, away = F.col("o_custkey") % TEAMS, (F.col("o_custkey") * 7 + F.col("o_orderkey")) % TEAMS
    done = F.col("o_orderstatus") != "P"
    return o.where(home != away).select(
        F.col("o_orderkey").alias("game_id"), home.alias("home"), away.alias("away"),
        F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"),
        (F.floor(F.dayofyear("o_orderdate") / 7) + 1).cast("int").alias("week"),
        (F.bround((F.col("o_totalprice") % 31) - 15) / 2).alias("spread"),
        F.when(done, F.col("o_orderkey") % 45).alias("home_score"),
        F.when(done, (F.col("o_orderkey") * 3 + F.col("o_custkey")) % 45).alias("away_score"),
        F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice") % 400 - 250).alias("raw_price"),
        F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("tier"),
    )


# win: chance of the team from its line; line: points the team is favoured by
TEAM_GAMES = """tg AS (
  SELECT game_id, season, week, day, home AS team, away AS opp, false AS is_away, home AS venue, spread AS line,
         0.5 + spread / 20 AS win FROM games
  UNION ALL
  SELECT game_id, season, week, day, away, home, true, home, -spread, 0.5 + (-spread) / 20 FROM games)"""


def team_games(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d).withColumn("away_line", -F.col("spread"))
    long = to_team_long(
        g, ["game_id", "season", "week", "day", F.col("home").alias("venue")],
        {"team": ("home", "away"), "line": ("spread", "away_line")},
    )
    return long.withColumnRenamed("opp_team", "opp").drop("opp_line").withColumn("win", 0.5 + F.col("line") / 20)


# --- plays ------------------------------------------------------------------
PLAYS = f"""plays AS (
  SELECT l_orderkey AS game_id, season, home, away,
         CASE WHEN l_suppkey % 2 = 0 THEN home ELSE away END AS team,
         CASE WHEN l_suppkey % 2 = 0 THEN away ELSE home END AS opp,
         CAST(l_shipdate AS DATE) AS day, (l_discount - CAST(0.05 AS DOUBLE)) * 100 AS x,
         CASE WHEN l_returnflag = 'N' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS success,
         l_quantity / 50 AS wp, l_linestatus || l_returnflag AS kind, l_linenumber AS down,
         CAST(l_quantity AS BIGINT) % 11 AS dist, l_partkey % 40 AS passer, l_tax * 100 AS yards,
         CAST(floor(l_extendedprice) AS BIGINT) % 100 AS field, l_quantity AS qty,
         exp(-CAST(0.00475 AS DOUBLE) * date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}')) AS w
  FROM lineitem JOIN games ON game_id = l_orderkey)"""


def plays(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d).select("game_id", "season", "home", "away")
    # the join and what follows per game hold a bounded number of rows a task, however few bytes the rows shuffle
    li = spread(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "game_id"), "game_id", work=1)
    first = F.col("l_suppkey") % 2 == 0
    return li.join(g, "game_id").select(
        "game_id", "season", "home", "away",
        F.when(first, F.col("home")).otherwise(F.col("away")).alias("team"),
        F.when(first, F.col("away")).otherwise(F.col("home")).alias("opp"),
        F.to_date("l_shipdate").alias("day"), ((F.col("l_discount") - 0.05) * 100).alias("x"),
        F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0).alias("success"),
        (F.col("l_quantity") / 50).alias("wp"), F.concat("l_linestatus", "l_returnflag").alias("kind"),
        F.col("l_linenumber").alias("down"), (F.col("l_quantity").cast("long") % 11).alias("dist"),
        (F.col("l_partkey") % 40).alias("passer"), (F.col("l_tax") * 100).alias("yards"),
        (F.floor("l_extendedprice") % 100).alias("field"), F.col("l_quantity").alias("qty"),
        rating.time_decay(F.to_date("l_shipdate"), F.lit(AS_OF).cast("date"), K.DECAY_RATE).alias("w"),
    )


# --- contest ----------------------------------------------------------------
PICKS = """picks AS (
  SELECT user_id AS entry, CAST(floor((day(ts) - 1) / 2) AS INT) + 1 AS week, event_id % 32 AS team,
         value / 500 AS pct, user_id % 15 AS total_wins, event_type AS pool, event_id, value
  FROM events)"""


def picks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("entry"), (F.floor((F.dayofmonth("ts") - 1) / 2) + 1).cast("int").alias("week"),
        (F.col("event_id") % TEAMS).alias("team"), (F.col("value") / 500).alias("pct"),
        (F.col("user_id") % 15).alias("total_wins"), F.col("event_type").alias("pool"), "event_id", "value",
    )


# --- venue dimension --------------------------------------------------------
DIM = """dim AS (
  SELECT CAST(n_nationkey AS BIGINT) AS team, n_name AS name, r_name AS division,
         CAST(n_nationkey * 3 - 36 AS DOUBLE) AS lat, CAST(n_nationkey * 7 - 84 AS DOUBLE) AS lon,
         n_nationkey * CAST(0.5 AS DOUBLE) - 6 AS rank
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def dim(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("team"), F.col("n_name").alias("name"), F.col("r_name").alias("division"),
        (F.col("n_nationkey") * 3 - 36).cast("double").alias("lat"), (F.col("n_nationkey") * 7 - 84).cast("double").alias("lon"),
        (F.col("n_nationkey") * 0.5 - 6).alias("rank"),
    )
