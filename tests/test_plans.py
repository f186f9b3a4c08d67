"""The pipelines end to end on small fixtures."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pickwright.functions import rating
from pickwright.operators.rows import pick_rules
from pickwright.plans import contest, game_table, pick_plan, ratings

TEAMS = ["AAA", "BBB", "CCC", "DDD"]
ZONES = {"AAA": "EST", "BBB": "CST", "CCC": "EST", "DDD": "PST"}
PLAY_COLS = (
    "game_id string, play_id long, season int, week int, game_date date, posteam string, defteam string, home_team string, play_type string, "
    "epa double, success double, wp double, down int, yardline_100 int, air_yards double, qb_scramble int, sack int, passer_player_name string, receiver_player_id string"
)


@pytest.fixture(scope="module")
def plays(spark):
    rnd = random.Random(3)
    data, pid = [], 0
    for season, rounds in ((2023, 3), (2024, 3)):
        for n in range(rounds):
            for gi, (h, a) in enumerate(itertools.permutations(TEAMS, 2)):
                week = n * 12 + gi + 1
                day = dt.date(season, 9, 1) + dt.timedelta(days=week)
                for side, other in ((h, a), (a, h)):
                    for i in range(12):
                        pid += 1
                        kind = ["run", "pass", "pass", "punt", "field_goal", "kickoff"][i % 6]
                        skill = TEAMS.index(side) * 0.4 - TEAMS.index(other) * 0.2
                        epa = None if pid % 97 == 0 else skill + rnd.gauss(0, 1.5) * (6 if pid % 41 == 0 else 1)
                        data.append(
                            (f"{season}_{week}_{h}_{a}", pid, season, week, day, side, other, h, kind, epa, float(rnd.random() < 0.5), rnd.random(), i % 4 + 1,
                             rnd.randint(1, 99), float(rnd.randint(-3, 30)), i % 2, 0, f"{side}_qb{(week + i) % 2}" if kind == "pass" else None, "r1")
                        )
    return spark.createDataFrame(data, PLAY_COLS).cache()


def by_team(df):
    return {r["team"]: r for r in df.collect()}


def test_power_ratings_against_a_plain_loop(spark, plays):
    as_of, season, week = "2024-12-01", 2024, 20
    stats = [(f"{t}_qb{q}", "QB", t, s, w, 4.0 + q + i, 1.0, 30, 2, 1) for i, t in enumerate(TEAMS) for q in (0, 1) for s in (2023, 2024) for w in (1, 2, 25)]
    weeks = spark.createDataFrame(
        stats, "player_name string, position string, team string, season int, week int, passing_epa double, rushing_epa double, attempts int, carries int, sacks int"
    )
    params = ratings.RatingParams(passes=12)
    got = by_team(ratings.power_ratings(plays, weeks, as_of, season, week, params))

    end = dt.date.fromisoformat(as_of)
    kept = [p for p in plays.collect() if p["epa"] is not None and 0.05 <= p["wp"] <= 0.95 and (end - p["game_date"]).days <= 840]
    cap = lambda x: max(-4.875, min(4.875, x))
    w_of = lambda p: math.exp(-0.00475 * (end - p["game_date"]).days)
    games = {}
    for p in kept:
        g = games.setdefault(p["game_id"], {}).setdefault(p["posteam"], {"x": 0.0, "s": 0.0, "n": 0, "w": w_of(p), "d": p["game_date"]})
        g["x"] += cap(p["epa"]); g["s"] += p["success"]; g["n"] += 1  # noqa: E702
    qb_counts = {}
    for p in kept:
        if p["play_type"] == "pass":
            key = (p["game_id"], p["posteam"])
            qb_counts.setdefault(key, {}).setdefault(p["passer_player_name"], 0)
            qb_counts[key][p["passer_player_name"]] += 1
    qb_of = {k: min(v, key=lambda q: (-v[q], q)) for k, v in qb_counts.items()}
    edges = []
    for gid, sides in games.items():
        if len(sides) == 2:
            for me, them in itertools.permutations(sides, 2):
                d = sides[me]["x"] - sides[them]["x"]
                d = d if abs(d) <= 21.25 else math.copysign(21.25 + 2 * math.log(abs(d) - 21.25 + 1), d)
                edges.append((me, them, d, sides[me]["s"] / sides[me]["n"] - sides[them]["s"] / sides[them]["n"], sides[me]["w"], qb_of.get((gid, me))))
    epa, sr = dict.fromkeys(TEAMS, 0.0), dict.fromkeys(TEAMS, 0.0)
    avg = lambda vals, ws: sum(v * w for v, w in zip(vals, ws)) / sum(ws)
    for _ in range(12):
        ne, ns, sos = {}, {}, {}
        for t in TEAMS:
            mine = [e for e in edges if e[0] == t]
            ws = [e[4] for e in mine]
            sos[t] = avg([epa[e[1]] for e in mine], ws)
            ne[t] = avg([e[2] for e in mine], ws) + 0.86 * sos[t]
            ns[t] = avg([e[3] for e in mine], ws) + 0.86 * avg([sr[e[1]] for e in mine], ws)
        epa, sr = ne, ns
    past = [s for s in stats if s[3] < season or s[4] < week]
    rate, volume = {}, {}
    for t in TEAMS:
        per_week = {}
        for s in [s for s in past if s[2] == t]:
            per_week[s[3], s[4]] = per_week.get((s[3], s[4]), 0) + s[7] + s[8] + s[9]
        volume[t] = sum(per_week.values()) / len(per_week)
    for name in {s[0] for s in past}:
        mine = [s for s in past if s[0] == name]
        if sum(s[7] + s[8] + s[9] for s in mine) > 50:
            rate[name] = sum(s[5] + s[6] for s in mine) / sum(s[7] + s[8] + s[9] for s in mine)
    for t in TEAMS:
        last = max((p["game_date"], p["game_id"]) for p in kept if p["posteam"] == t and p["play_type"] == "pass")[1]
        starter = qb_of[last, t]
        mine = [e for e in edges if e[0] == t]
        ws = [e[4] for e in mine]
        hist = avg([rate.get(e[5], 0.0) for e in mine], ws)
        adj = (rate.get(starter, 0.0) - hist) * volume[t] / 2.1
        power = ((epa[t] + adj) * 0.42 + sr[t] * 100 * 0.765 * 0.58) * 0.99 * 1.04
        r = got[t]
        assert r["projected_qb"] == starter
        assert r["starter_weight"] == pytest.approx(sum(w for e, w in zip(mine, ws) if e[5] == starter) / sum(ws))
        assert (r["qb_adj"], r["power_rating"], r["strength_of_schedule"]) == pytest.approx((adj, power, sos[t]))
    assert got["DDD"]["power_rating"] > got["AAA"]["power_rating"]


def test_home_field_and_zones(spark, plays):
    hfa = by_team(ratings.home_field(plays, "2024-12-01", ratings.RatingParams(passes=4, multiplier=1.0)))
    assert set(hfa) == set(TEAMS)
    for r in hfa.values():
        assert r["hfa_points"] == pytest.approx((r["home_rating"] - r["away_rating"]) / 2)
    zones = spark.createDataFrame(list(ZONES.items()), "team string, zone string")
    split = ratings.zone_splits(plays, zones, "2024-12-01", ["EST", "CST", "PST"], ratings.RatingParams(passes=4, multiplier=1.0))
    got = by_team(split)
    assert got["DDD"]["PST_diff"] is None and got["AAA"]["PST_diff"] is not None
    report = {r["origin_zone"]: r["teams"] for r in ratings.zone_report(split, ["EST", "CST", "PST"]).collect()}
    assert report == {"EST": 2, "CST": 1, "PST": 1}


def test_compare_ratings(spark):
    own = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "team string, power_rating double")
    ext = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 5.0), ("z", 0.0)], "team string, rating double")
    report, joined = ratings.compare_ratings(own, ext)
    r = report.first()
    assert (r["pearson"], r["spearman"], r["mae"], r["rmse"]) == pytest.approx((1, 1, 1, 1))
    assert joined.count() == 3


def test_team_strengths_wide(spark, plays):
    rosters = spark.createDataFrame([("r1", "WR")], "gsis_id string, position string")
    charting = plays.select("game_id", "play_id", (F.col("play_id") % 2).cast("int").alias("is_blitz"))
    long = ratings.team_strengths(plays, {2023: "2024-02-20", 2024: "2025-02-20"}, rosters, charting)
    cats = {r["category"] for r in long.select("category").distinct().collect()}
    assert {"Overall", "Pass", "Target_WR"} <= cats and "Play_Action" not in cats
    top = long.groupBy("rating_season", "category", "side").agg(F.max("epa_pct").alias("m")).collect()
    assert all(r["m"] == 100 for r in top)
    wide = ratings.strengths_wide(long, ["Overall", "Pass"])
    assert "Off_Pass_EPA_Pct" in wide.columns and wide.count() == 8


@pytest.fixture(scope="module")
def season(spark):
    """Four teams, four weeks, each pairing order known."""
    pairs = [("AAA", "BBB"), ("CCC", "DDD"), ("BBB", "CCC"), ("DDD", "AAA"), ("AAA", "CCC"), ("BBB", "DDD"), ("BBB", "AAA"), ("DDD", "CCC")]
    data = []
    for i, (h, a) in enumerate(pairs):
        week = i // 2 + 1
        day = dt.date(2025, 9, 4) + dt.timedelta(days=7 * (week - 1) + (3 if i % 2 else 0))
        data.append((f"g{i}", 2025, week, day, dt.datetime(day.year, day.month, day.day, 18), h, a, f"{h} Field"))
    schedule = spark.createDataFrame(data, "game_id string, season int, week int, day date, kickoff timestamp, home_team string, away_team string, venue string")
    place = {"AAA": (40.0, -74.0, "America/New_York"), "BBB": (41.0, -87.0, "America/Chicago"), "CCC": (42.0, -71.0, "America/New_York"), "DDD": (34.0, -118.0, "America/Los_Angeles")}
    teams = spark.createDataFrame([(t, f"{t} Field", *place[t], "E" if t in ("AAA", "CCC") else "W") for t in TEAMS], "team string, stadium string, lat double, lon double, tz string, division string")
    venues = spark.createDataFrame([(f"{t} Field", *place[t]) for t in TEAMS], "venue string, venue_lat double, venue_lon double, venue_tz string")
    source = spark.createDataFrame([(t, 2.0 * i - 3, 1.5, -0.5) for i, t in enumerate(TEAMS)], "team string, rating double, home_points double, away_points double")
    book = spark.createDataFrame([("g0", -150, 130, 3.0), ("g1", None, None, None)], "game_id string, home_price int, away_price int, home_spread double")
    return schedule, teams, venues, source, book


def test_game_table(spark, season):
    schedule, teams, venues, source, book = season
    live = spark.createDataFrame([("g2", -200, 170, 4.5)], "game_id string, home_price int, away_price int, home_spread double")
    full_book = book.unionByName(spark.createDataFrame([("g2", 100, 100, 0.0)], book.schema))
    table = game_table.build_game_table(schedule, teams, venues, {"own": source}, full_book, live, holidays={"turkey": 3})
    got = {(r["game_id"], r["team"]): r for r in table.collect()}
    assert len(got) == 16
    g0 = got["g0", "AAA"]
    assert (g0["rest"], g0["previous_opponent"], g0["next_opponent"], g0["win_source"]) == (0, "Preseason", "DDD", "book")
    assert (g0["win"], got["g0", "BBB"]["win"], g0["book_favorite"], got["g0", "BBB"]["favorite"]) == (0.5798, 0.4202, "AAA", "AAA")
    assert got["g2", "BBB"]["book_price"] == -200 and got["g2", "CCC"]["book_spread"] == -4.5
    # week 2: A and D meet in g3; A rested 10 days, D 7
    g3 = got["g3", "AAA"]
    assert (g3["rest"], g3["opp_rest"], g3["rest_adv"], g3["season_rest_adv"]) == (10, 7, 3, 3)
    assert g3["is_away"] and g3["travel"] > 2400 and g3["travel_adv"] < -2400 and g3["zone_change"] == 3 and g3["zone_adv"] == 3
    assert g3["win_source"] == "own" and g3["win"] < 0.5 and g3["favorite"] == "DDD"
    home = got["g3", "DDD"]
    # rating 3, travel .125, weekly rest -3 * .125, season rest -3 * .0625, home points 1.5; no zone change of its own
    assert home["own_adjusted"] == pytest.approx(3 + 0.125 - 0.375 - 0.1875 + 1.5)
    assert g3["own_adjusted"] == pytest.approx(-3 - 0.125 - 0.3 + 0.375 + 0.1875 - 0.5)
    assert got["g6", "AAA"]["next_opponent"] == "Playoffs?" and got["g6", "AAA"]["outlook"] == 0
    weeks = {(r["team"], r["week"]): r for r in table.collect()}
    assert all(weeks[t, w]["turkey_favorite"] + weeks[t, w]["turkey_underdog"] == (1 if w <= 3 else 0) for t in TEAMS for w in (1, 2, 3, 4))
    assert all(weeks[t, w]["pre_turkey"] == (1 if w < 3 else 0) for t in TEAMS for w in (1, 2, 3, 4))
    stars = [r["stars"] for r in table.collect() if r["week"] == 1]
    assert min(stars) == 0 and max(stars) == 5


def test_imputed_schedule(spark, season):
    schedule, teams, venues, source, _ = season
    sides = game_table.rated_sides(game_table.schedule_sides(schedule, teams, venues), source, "own")
    lines = schedule.withColumns({"spread_line": F.when(F.col("game_id") == "g0", 2.5), "home_moneyline": F.lit(None).cast("int"), "away_moneyline": F.lit(None).cast("int")})
    got = {r["game_id"]: r for r in game_table.imputed_schedule(lines, sides, "own").collect()}
    assert (got["g0"]["spread_line"], got["g0"]["home_moneyline"]) == (2.5, -142)
    assert got["g1"]["spread_line"] == pytest.approx(got["g1"]["projected_spread"])
    assert all(r["home_moneyline"] is not None for r in got.values())


def test_contest_history(spark, rows):
    raw = spark.createDataFrame(
        [("1.1", "78.0%", "15.3%", "AAA (W)", "@BBB", 2.0, 2025, "Week 1"), ("1.1", "78.0%", "15.3%", "AAA (W)", "@BBB", 2.0, 2025, "Week 1"),
         ("0.8", "22.0%", "--", "BBB (L)", "AAA-3", 1.0, 2025, "Week 1"), ("", "--", None, "CCC", "BYE", 0.0, 2025, "Week 1")],
        "ev string, win_pct string, pick_pct string, team string, opponent string, future_value double, year int, week string",
    )
    clean = contest.clean_public_picks(raw)
    assert rows(clean, "team", "opponent", "win_pct", "pick_pct", "week") == [("AAA", "BBB", 0.78, 0.153, 1), ("BBB", "AAA", 0.22, 0.0, 1)]
    old = clean.withColumn("year", F.lit(2024)).unionByName(clean)
    assert contest.replace_year(old, clean.limit(1), 2025).count() == 3

    picks = spark.createDataFrame(
        [(2025, w, t, o, p, k, 1.0 + p, 0.9, a) for w, games in ((1, (("AAA", "BBB", 0.7), ("CCC", "DDD", 0.6))), (2, (("AAA", "CCC", 0.85), ("BBB", "DDD", 0.5))))
         for x, y, q in games for t, o, p, k, a in ((x, y, q, 0.3, False), (y, x, 1 - q, 0.2, True))],
        "year int, week int, team string, opponent string, win_pct double, pick_pct double, future_value double, availability double, is_away boolean",
    ).withColumn("day", F.date_add(F.lit("2025-09-04").cast("date"), F.col("week") * 7))
    f = {(r["week"], r["team"]): r for r in contest.pick_features(picks).collect()}
    assert f[1, "AAA"]["future_over_80"] == pytest.approx(1 / 17) and f[1, "AAA"]["win_pct_rank"] == 1
    assert f[1, "BBB"]["win_pct_rank_density"] == 1 and f[2, "AAA"]["future_top"] == 0
    assert f[1, "AAA"]["thursday_favorite"] == 1 and f[1, "BBB"]["thursday_away"] == 1
    ev = {(r["week"], r["team"]): r["ev"] for r in contest.week_value(picks).collect()}
    # AAA wins: survivors are its .3 plus CCC's .3 or DDD's .2
    assert ev[1, "AAA"] == pytest.approx(0.7 * (0.6 / 0.6 + 0.4 / 0.5))
    assert len(ev) == 8


def test_entry_flow(spark):
    wide = spark.createDataFrame(
        [(2025, "e1", 2, "AAA", "BBB", "CCC"), (2025, "e2", 1, "AAA", "DDD", None), (2025, "e3", 0, "BBB", None, None)],
        "year int, entry_name string, total_wins int, week_1 string, week_2 string, week_3 string",
    )
    grid = spark.createDataFrame([(2025, w, t) for w in (1, 2, 3) for t in TEAMS], "year int, week int, team string")
    pools = spark.createDataFrame([(2025, 10)], "year int, entries int")
    got = {(r["week"], r["team"]): r for r in contest.entry_flow(wide, ["week_1", "week_2", "week_3"], grid, pools).collect()}
    assert (got[1, "AAA"]["alive"], got[1, "AAA"]["current_picks"], got[1, "AAA"]["pick_pct"]) == (10, 2, 0.2)
    assert (got[2, "AAA"]["alive"], got[2, "AAA"]["prior_picks"], got[2, "AAA"]["availability"]) == (2, 2, 0.0)
    assert (got[3, "BBB"]["alive"], got[3, "BBB"]["prior_picks"], got[3, "BBB"]["remaining_pct"]) == (1, 1, 0.1)


def test_pick_plan(spark):
    data = [(1, w, f"w{w}g{g}", t, o, a, p) for w, games in ((1, (("AAA", "BBB", 0.7), ("CCC", "DDD", 0.6))), (2, (("AAA", "CCC", 0.8), ("DDD", "BBB", 0.55))))
            for g, (x, y, q) in enumerate(games) for t, o, a, p in ((x, y, False, q), (y, x, True, 1 - q))]
    sides = spark.createDataFrame(data, "pool int, week int, game_id string, team string, opp_team string, is_away boolean, win double")
    pools = spark.createDataFrame([(1, 100)], "pool int, entries int")
    out = pick_plan.project_picks(sides, pools, [1, 2], lambda df: df.withColumn("pick_pct", F.col("win")), ["pool"])
    got = {(r["week"], r["team"]): r for r in out.collect()}
    assert sum(got[1, t]["pick_pct"] for t in TEAMS) == pytest.approx(1)
    kept = 100 * sum(got[1, t]["pick_pct"] * got[1, t]["win"] for t in TEAMS)
    assert got[2, "AAA"]["entries"] == pytest.approx(kept)
    assert got[2, "AAA"]["availability"] == pytest.approx(1 - 35 * 0.7 / kept)
    assert sum(got[2, t]["pick_pct"] for t in TEAMS) == pytest.approx(1, abs=1e-4)
    valued = pick_plan.add_value(out, ["pool"])
    assert all(r["ev"] is not None for r in valued.collect())
    rules = {"not_favored": F.col("win") <= 0.5}
    best = pick_plan.choose_paths(valued, ["pool"], [1, 2], "win", rules, k=2)
    picks = [(r["rank"], r["picks"]) for r in best.orderBy("rank").collect()]
    assert picks == [(1, ["CCC", "AAA"]), (2, ["AAA", "DDD"])]
    weeks = pick_plan.path_weeks(best, valued, ["pool"], [1, 2]).orderBy("rank", "week").collect()
    assert [r["survival"] for r in weeks] == pytest.approx([0.6, 0.8, 0.7, 0.55])
    assert set(pick_rules()) >= {"not_favored"}
    assert rating.CURRENT.rest == 0.125
