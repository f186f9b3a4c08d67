"""Scans and sinks."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import GAMES, TEAM_GAMES, games, table, team_games
from pickwright.operators.aggregates import as_of_weighted_mean, pivot_mean, weighted_mean
from pickwright.functions.rating import time_decay
from pickwright.session import fresh_path
from pickwright.sources import scans, sinks

DATES = ["2024-01-05", "2024-01-10", "2024-01-15", "2024-01-20", "2024-01-31"]
_DATE_SQL = "dates AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in DATES) + "]) AS as_of)"


@case("s1_delimited_scan", "c_custkey:l c_name:s c_nationkey:l c_acctbal:d c_mktsegment:s", "SELECT * FROM customer")
def s1(spark, d):
    path = fresh_path(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return scans.read_table(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@case(
    "s2_season_scan", "season:l home:l n:l total:d4",
    q(GAMES, "SELECT season, home, count(*) AS n, sum(total) AS total FROM games WHERE season IN (1996, 1997, 1998) GROUP BY ALL"),
)
def s2(spark, d):
    path = fresh_path(spark, "seasons")
    games(spark, d).write.partitionBy("season").parquet(path)
    some = scans.read_seasons(spark, path, [1996, 1997, 1998], ["season", "home", "total"])
    return some.groupBy("season", "home").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@case(
    "s3_wide_sink", "season:l team:l home_line:d home_win:d away_line:d away_win:d",
    q(GAMES, TEAM_GAMES, """SELECT season, team, avg(line) FILTER (NOT is_away) AS home_line, avg(win) FILTER (NOT is_away) AS home_win,
      avg(line) FILTER (is_away) AS away_line, avg(win) FILTER (is_away) AS away_win FROM tg GROUP BY ALL"""),
)
def s3(spark, d):
    path = fresh_path(spark, "wide")
    tg = team_games(spark, d).withColumn("side", F.when(F.col("is_away"), "away").otherwise("home"))
    sinks.write_wide(pivot_mean(tg, ["season", "team"], "side", ["home", "away"], ["line", "win"]), path)
    return spark.read.parquet(path)


STACKED = {f"{s}_{c}_{m}": (s, c, m) for s in ("Offense", "Defense") for c in ("Early", "Late") for m in ("Line", "Win")}
_CELL = lambda s, c, m: f"avg({m.lower()}) FILTER ({'' if s == 'Defense' else 'NOT '}is_away AND week {'<=' if c == 'Early' else '>'} 26)"


@case(
    "s1_stacked_header", "Team:s " + " ".join(f"{n}:d" for n in STACKED),
    q(GAMES, TEAM_GAMES, "SELECT 'T' || team AS \"Team\", " + ", ".join(f'{_CELL(*labels)} AS "{n}"' for n, labels in STACKED.items()) + " FROM tg GROUP BY ALL"),
)
def s1_stacked(spark, d):
    """Written with a header of three levels and an index line, read back by it."""
    path = fresh_path(spark, "stacked")
    tg = team_games(spark, d).withColumns({"side": F.when(F.col("is_away"), "Defense").otherwise("Offense"), "part": F.when(F.col("week") <= 26, "Early").otherwise("Late")})
    cell = lambda s, c, m: F.avg(F.when((F.col("side") == s) & (F.col("part") == c), F.col(m.lower())))
    wide = tg.groupBy(F.concat(F.lit("T"), "team").alias("Team")).agg(*[cell(*labels).alias(n) for n, labels in STACKED.items()])
    sinks.write_stacked(wide, path, "Team", STACKED, ["Side", "Category", "Metric"])
    return scans.read_stacked(spark, path, header=4)


@case(
    "s4_html_rows", "page_id:l cell_0:s stars:d n:l",
    """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>.*?</li>')) AS row FROM pages),
       c AS (SELECT page_id, regexp_extract_all(row, '(?is)<a\\b[^>]*>.*?</a>') AS cells FROM r)
       SELECT page_id, regexp_replace(cells[1], '<[^>]*>', '', 'g') AS cell_0, CAST(0 AS DOUBLE) AS stars, count(*) AS n
       FROM c WHERE len(cells) >= 1 GROUP BY ALL""",
)
def s4(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    rows = scans.extract_html_rows(pages, row_tag="li", cell_tag="a", min_cells=1, n_cells=1)
    return rows.groupBy("page_id", "cell_0", "stars").agg(F.count("*").alias("n"))


# every link of a page as a table row, some of them with a table inside, unclosed cells, or a comment around a row
_ROW_PARTS = (
    "'<!-- <tr><td>a<td>b<td>c<td>d<td>e</tr> --><TR class=x><td> ' || (page_id % 7) || '</td><td>' || i || '%<td><b>' || t || '</b></td>'",
    "CASE WHEN i % 3 = 0 THEN '<td>outer <table><tr><th>p</th><th>q<th>' || t || '</th><th>r</th><th>s</th></tr></table> end</td>' ELSE '<td>plain' END",
    "'<td>last</td>'", "CASE WHEN i % 2 = 0 THEN '<td><div style=\"width: ' || (i * 16) || 'px\"></div></td>' ELSE '' END", "CASE WHEN i % 4 = 1 THEN '' ELSE '</tr>' END",
)


@case(
    "s4_table_rows", "page_id:l cell_0:s cell_1:s cell_2:s cell_3:s cell_4:s stars:d n:l",
    r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS links FROM pages),
      t AS (SELECT page_id, generate_subscripts(links, 1) AS i, unnest(links) AS link FROM l),
      u AS (SELECT page_id, i, regexp_replace(link, '<[^>]*>', '', 'g') AS t FROM t),
      r AS (SELECT page_id, ' ' || (page_id % 7) AS cell_0, i || '%' AS cell_1, t AS cell_2, CASE WHEN i % 3 = 0 THEN 'outer  end' ELSE 'plain' END AS cell_3, 'last' AS cell_4,
          CASE WHEN i % 2 = 0 THEN CAST(i AS DOUBLE) ELSE 0 END AS stars FROM u
        UNION ALL SELECT page_id, 'p', 'q', t, 'r', 's', 0 FROM u WHERE i % 3 = 0)
      SELECT page_id, cell_0, cell_1, cell_2, cell_3, cell_4, stars, count(*) AS n FROM r GROUP BY ALL""",
)
def s4_tables(spark, d):
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("i", "link"))
    named = links.select("page_id", (F.col("i") + 1).alias("i"), F.regexp_replace("link", "<[^>]*>", "").alias("t"))
    lines = named.select("page_id", "i", F.concat(*[F.expr(p) for p in _ROW_PARTS]).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "")  # the links of one page
    pages = lines.groupBy("page_id").agg(F.concat(F.lit("<html><table>"), text, F.lit("</table></html>")).alias("html"))
    cells = [f"cell_{i}" for i in range(5)]
    return scans.extract_table_rows(pages).groupBy("page_id", *cells, "stars").agg(F.count("*").alias("n"))


@case(
    "s5_odds_json", "home_team:s away_team:s commence_time:s home_price:d away_price:d home_spread:d away_spread:d",
    """WITH e AS (SELECT 'H' || (user_id % 8) AS home_team, 'A' || (user_id % 5) AS away_team,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS commence_time, event_type IN ('view', 'click', 'purchase') AS h2h, value AS v FROM events)
       SELECT home_team, away_team, commence_time, avg(v) FILTER (h2h) AS home_price, avg(v + 1) FILTER (h2h) AS away_price,
         avg(v / 100) FILTER (NOT h2h) AS home_spread, avg(-v / 100) FILTER (NOT h2h) AS away_spread FROM e GROUP BY ALL""",
)
def s5(spark, d):
    e = table(spark, d, "events")
    home, away = F.concat(F.lit("H"), F.col("user_id") % 8), F.concat(F.lit("A"), F.col("user_id") % 5)
    v = F.col("value")
    outs = F.array(
        F.struct(home.alias("name"), v.alias("price"), (v / 100).alias("point")),
        F.struct(away.alias("name"), (v + 1).alias("price"), (-v / 100).alias("point")),
    )
    key = F.when(F.col("event_type").isin("view", "click", "purchase"), "h2h").otherwise("spreads")
    payload = F.to_json(
        F.struct(
            home.alias("home_team"), away.alias("away_team"), F.to_date("ts").cast("string").alias("commence_time"),
            F.array(F.struct(F.array(F.struct(key.alias("key"), outs.alias("outcomes"))).alias("markets"))).alias("bookmakers"),
        )
    )
    return scans.flatten_odds(e.select(payload.alias("payload")), "payload")


@case(
    "s6_replace_year", "year:l game_id:l total:d",
    q(GAMES, """SELECT season AS year, game_id, total FROM games WHERE season <> 2001
      UNION ALL SELECT season, game_id, total * 2 FROM games WHERE season = 2001 AND home_score IS NOT NULL"""),
)
def s6(spark, d):
    path = fresh_path(spark, "history")
    g = games(spark, d).withColumnRenamed("season", "year")
    sinks.overwrite_partition(g.select("year", "game_id", "total"), path, ["game_id"], ["total"])
    new = g.where((F.col("year") == 2001) & F.col("home_score").isNotNull()).withColumn("total", F.col("total") * 2)
    new = new.select("year", "game_id", "total")
    sinks.overwrite_partition(new.unionAll(new), path, ["year", "game_id"], ["total"])
    return spark.read.parquet(path)


@case(
    "s7_weekly_snapshot", "year:l week:l team:l line:d n:l",
    q(GAMES, TEAM_GAMES, "SELECT season AS year, week, team, avg(line) AS line, count(*) AS n FROM tg GROUP BY ALL"),
)
def s7(spark, d):
    path = fresh_path(spark, "snapshot")
    tg = team_games(spark, d).groupBy(F.col("season").alias("year"), "week", "team").agg(F.avg("line").alias("line"), F.count("*").alias("n"))
    sinks.write_snapshot(tg.repartition("year", "week"), path)
    return spark.read.parquet(path)


_AS_OF = """WITH %s SELECT user_id, as_of, sum(value * exp(-CAST(0.00475 AS DOUBLE) * date_diff('day', CAST(ts AS DATE), as_of)))
  / sum(exp(-CAST(0.00475 AS DOUBLE) * date_diff('day', CAST(ts AS DATE), as_of))) AS mean,
  sum(exp(-CAST(0.00475 AS DOUBLE) * date_diff('day', CAST(ts AS DATE), as_of))) AS weight
  FROM events JOIN dates ON CAST(ts AS DATE) <= as_of GROUP BY ALL""" % _DATE_SQL


@case("s8_as_of_means", "user_id:l as_of:t mean:d weight:d", _AS_OF)
def s8(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return as_of_weighted_mean(e, "user_id", "day", "value", DATES)


@case("s8_as_of_pipeline", "user_id:l as_of:t mean:d", _AS_OF.replace("AS mean,", "AS mean, 0 AS z,"))
def s8_pipeline(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.to_date("ts").alias("day"))

    def pipeline(df, keys):
        weighted = df.withColumn("w", time_decay(F.col("day"), F.col("as_of")))
        return weighted_mean(weighted, [*keys, "user_id"], {"mean": "value"}, "w")

    return sinks.run_as_of(pipeline, e, "day", DATES)
