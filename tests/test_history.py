"""Pass doubling, ratings of many dates, anchored windows, weeks at once, projections, nearest keys, stacked headers, tag streams."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pickwright.operators import aggregates as A
from pickwright.operators import iterative, joins, models, scenarios
from pickwright.plans import pick_plan, ratings
from pickwright.sources import scans, sinks


def league(spark, teams=9, games=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(games):
        a, b = rnd.sample(range(teams), 2)
        net, w, day = rnd.gauss(0, 7), rnd.uniform(0.2, 1), date(2023, 1, 1) + timedelta(days=rnd.randrange(900))
        rows += [(g % 2, g, a, b, net, net / 50, w, day), (g % 2, g, b, a, -net, -net / 50, w, day)]
    rows += [(0, 99, 100, 3, 5.0, 0.1, 1.0, date(2024, 1, 1))]  # its opponent has no row against it
    return spark.createDataFrame(rows, "pool int, game int, team int, opponent int, net double, rate double, w double, day date")


@pytest.mark.parametrize("passes", [1, 2, 7, 12])
def test_doubled_passes_equal_single_passes(spark, rows, passes):
    values = {"epa": "net", "sr": "rate"}
    one = lambda squared: iterative.iterative_rating(league(spark), "team", "opponent", values, "w", 0.86, passes, ["pool"], squared=squared)
    assert rows(one(iterative.SQUARED), "pool", "team", "epa", "sr", "epa_schedule", "sr_schedule", digits=8) == rows(one(0), "pool", "team", "epa", "sr", "epa_schedule", "sr_schedule", digits=8)


def test_ratings_as_of_every_date_equal_one_run_per_date(spark, rows):
    edges = league(spark, games=200).drop("pool", "w")
    dates = ["2023-03-01", "2024-02-29", "2024-03-01", "2025-05-20", "2030-01-01"]
    got = iterative.as_of_ratings(edges, "team", "opponent", {"epa": "net"}, "day", dates, 0.86, 9, history_days=300, rate=0.01)
    want = []
    for d in dates:
        kept = edges.where(f"day <= DATE '{d}' AND day >= date_sub(DATE '{d}', 300)").withColumn("w", F.exp(-0.01 * F.datediff(F.lit(d).cast("date"), "day")))
        one = iterative.iterative_rating(kept, "team", "opponent", {"epa": "net"}, "w", 0.86, 9)
        want += [(date.fromisoformat(d), *r) for r in rows(one, "team", "epa", "epa_schedule")]
    assert rows(got, "as_of", "team", "epa", "epa_schedule") == sorted(want, key=str) and len({r[0] for r in want}) == 4


def test_anchored_windows_equal_copied_plays(spark, rows):
    rnd = random.Random(2)
    plays = []
    for i in range(4000):
        a, b = rnd.sample(["A", "B", "C", "D"], 2)
        season = rnd.randint(2019, 2024)
        plays.append((i % 50, i, season, date(season, rnd.randint(9, 12), 3), a, b, rnd.choice([a, b, None]), rnd.choice(["run", "pass", "punt"]), rnd.gauss(0, 1), float(rnd.random() < 0.5), rnd.random(), rnd.randint(1, 4), rnd.randint(1, 99), rnd.randint(-5, 40)))
    df = spark.createDataFrame(plays, "game_id int, play_id int, season int, game_date date, posteam string, defteam string, home_team string, play_type string, epa double, success double, wp double, down int, yardline_100 int, air_yards int").withColumns({"qb_scramble": F.lit(0), "sack": F.lit(0)})
    anchors = {2021: "2021-10-15", 2022: "2023-02-01", 2023: "2023-11-10", 2030: "2030-01-01"}
    names = ["rating_season", "category", "side", "team", "plays", "weight_score", "epa", "sr", "epa_pct", "sr_pct"]
    got = ratings.team_strengths(df, anchors, decay=0.001)
    want = []
    for s, d in anchors.items():
        own = df.where(f"season BETWEEN {s - 2} AND {s} AND game_date <= DATE '{d}'").withColumn("rating_season", F.lit(s))
        want += rows(ratings.team_strengths(own.withColumn("season", F.lit(s)), {s: d}, decay=0.001, seasons_back=0), *names)
    assert rows(got, *names) == sorted(want, key=str) and len(want) > 100


def test_availability_of_all_weeks_equals_week_by_week(spark, rows):
    rnd = random.Random(3)
    data = []
    for e in range(60):
        wins = rnd.choice([None, 0, 2, 5, 9])
        data += [(e % 2, e, w, rnd.choice("ABCD"), wins) for w in range(1, rnd.randint(2, 7))]
    data += [(0, 1, 3, None, 4), (None, 2, 1, "A", 3), (1, None, 1, "A", 3)]
    picks = spark.createDataFrame(data, "pool int, entry int, week int, team string, total_wins int").withColumn("total_wins", F.coalesce("total_wins", F.lit(0)))
    teams = picks.where("pool is not null and team is not null").select("pool", "team").distinct()
    got = rows(A.availability_by_week(picks, teams, 8, ["pool"]), "week", "pool", "team", "entries_used", "alive", "availability")
    want = [(w, *r) for w in range(1, 9) for r in rows(A.availability(picks.where("pool is not null"), teams, w, ["pool"]), "pool", "team", "entries_used", "alive", "availability")]
    assert got == sorted(want, key=str)


def projected(sides, pools, used, weeks):
    """The state loop in plain Python, without caps."""
    out = []
    for pool, size in pools.items():
        u = dict(used[pool])
        for w in weeks:
            now = [(t, win) for p, k, t, win in sides if p == pool and k == w]
            if size <= 0 or not now:
                break
            free = {t: max(0.0, min(1.0, (size - u.get(t, 0.0)) / size)) for t, _ in now}
            raw = {t: win * (0.1 + free[t]) for t, win in now}
            total = sum(raw.values())
            v = {t: x / total if total > 0 else 0.0 for t, x in raw.items()}
            for _ in range(15):
                over = sum(max(0.0, v[t] - free[t]) for t in v)
                room = sum(v[t] for t in v if v[t] <= free[t])
                v = {t: free[t] if v[t] > free[t] else v[t] * (1 + over / room if over > 0 and room > 0 else 1) for t in v}
            share = {t: min(v[t], free[t]) for t in v}
            out += [(pool, w, t, round(size, 6), round(free[t], 6), round(share[t], 6)) for t, _ in now]
            kept = {t: share[t] * win * size for t, win in now}
            after = sum(kept.values())
            teams = {t for p, _, t, _ in sides if p == pool}
            u = {t: max(0.0, min(kept.get(t, 0.0) + u.get(t, 0.0) * after / size, after)) for t in teams}
            size = after
    return sorted(out, key=str)


def test_projection_starts_anywhere_and_stops_at_an_empty_pool(spark, rows):
    rnd = random.Random(4)
    sides = [(p, w, t, 0.0 if (p, w) == ("x", 6) else rnd.uniform(0.2, 0.9)) for p in "xyz" for w in range(1, 9) for t in "ABCDEF" if (p, w) != ("z", 5)]
    pools, free = {"x": 100.0, "y": 40.0, "z": 7.0, "none": 0.0}, {("x", "A"): 0.3, ("y", "B"): 0.0, ("y", "C"): 1.4}
    used = {p: {t: max(0.0, min(s * (1 - free.get((p, t), 1.0)), s)) for t in "ABCDEF"} for p, s in pools.items()}
    got = pick_plan.project_picks(
        spark.createDataFrame(sides, "pool string, week int, team string, win double"), spark.createDataFrame(list(pools.items()), "pool string, entries double"), range(3, 9),
        lambda df: df.withColumn("pick_pct", F.col("win") * (0.1 + F.col("availability"))), ["pool"],
        availability=spark.createDataFrame([(p, t, a) for (p, t), a in free.items()], "pool string, team string, availability double"),
    )
    want = projected(sides, pools, used, range(3, 9))
    assert rows(got, "pool", "week", "team", "entries", "availability", "pick_pct") == want
    assert {(r[0], r[1]) for r in want if r[0] != "y"} == {("x", 3), ("x", 4), ("x", 5), ("x", 6), ("z", 3), ("z", 4)}


def test_folded_groups_equal_passes_over_rows(spark, rows):
    rnd = random.Random(5)
    df = spark.createDataFrame([(g, i, rnd.random() if i else None, rnd.random() / 3 if i % 5 else None) for g in range(6) for i in range(9)], "g int, i int, x double, cap double")
    both = [iterative.redistribute(df, ["g"], "x", "cap", 7, "y", folded=n) for n in (4096, 0)]
    assert rows(both[0], "g", "i", "y", digits=9) == rows(both[1], "g", "i", "y", digits=9)


def test_group_without_a_share_has_value_zero(spark, rows):
    games = spark.createDataFrame([(1, 1, "a", "b", 0.6, 0.0, 0.0), (1, 2, "c", "d", 0.3, 0.0, None), (2, 3, "e", "f", 1.0, 0.5, 0.5)], "week int, game int, a string, b string, p double, ka double, kb double")
    got = rows(scenarios.scenario_ev(games, ["week"], "game", "a", "b", "p", None, "ka", "kb"), "week", "team", "ev")
    assert got == [(1, "a", 0.0), (1, "b", 0.0), (1, "c", 0.0), (1, "d", 0.0), (2, "e", 2.0), (2, "f", 0.0)]


@pytest.mark.parametrize("piece", [1_000_000, 7])
def test_nearest_key_equals_a_search(spark, piece):
    rnd = random.Random(6)
    keys = [(g, round(rnd.uniform(0, 50) ** 2 / 40, 1), rnd.randint(0, 9)) for g in "ab" for _ in range(40)] + [("a", None, 1), ("a", float("nan"), 1), (None, 3.0, 1)]
    asked = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, float("nan"), -5.0, 1e9, 7.5, 7.5, round(rnd.uniform(0, 60), 2)])) for i in range(200)]
    df, table = spark.createDataFrame(asked, "id int, g string, x double"), spark.createDataFrame(keys, "g string, k double, v int")
    got = {r["id"]: (r["k"], r["v"]) for r in joins.nearest_join(df, table, "x", "k", ["v"], ["g"], piece).collect()}
    for i, g, x in asked:
        own = [(abs(x - k), k, v) for h, k, v in keys if h == g and k is not None and k == k] if g and x is not None and x == x else []
        assert got[i] == (min(own)[1:] if own else (None, None)), (g, x)


def test_stacked_header_is_read_as_written(spark, tmp_path, rows):
    assert scans.stacked_names(["Side,Off,,Def", "Category,Run,Pass,Run", "Team,,,"]) == ["Team", "Off_Run", "Off_Pass", "Def_Run"]
    assert scans.stacked_names(["x,a,b", "y,c,"], 1) == ["y", "a_c", "b_c"]
    assert scans.stacked_names([",A,\"B, C\""]) == ["index_0", "A", "B, C"]
    columns = {"Off_Run_x": ("Off", "Run", "x"), "Off_Run_y": ("Off", "Run", "y"), "Off_Pass_x": ("Off", "Pass", "x"), "Def_Pass_x": ("Def", "Pass", "x")}
    df = spark.createDataFrame([("A, B", 1.5, None, -2.0, 1e-9), ("Side", 0.1, 2.0, 3.0, float("nan"))], "Team string, Off_Run_x double, Off_Run_y double, Off_Pass_x double, Def_Pass_x double")
    sinks.write_stacked(df.repartition(3), str(tmp_path / "t"), "Team", columns, ["Side", "Category", "Metric"])
    got = scans.read_stacked(spark, str(tmp_path / "t"), 4)
    assert got.columns == df.columns
    assert rows(got, digits=12) == rows(scans.clean_numbers(df), digits=12)


HTML = """<p>x</p><!-- <table><tr><td>no</td></tr> --><TABLE><tr><th>a</th><td class='q'> b <i>c</i></td>junk</tr>
<tr><td>d<td>e<tr><td>f <table><tr><td>in<td>ner</table> g</td><td>h</td></table><tr><td>loose<td>end<!-- open <td>"""


def test_tables_nested_unclosed_and_commented(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<table></table>")], "id int, html string")
    got = sorted((r["id"], r["cell_0"].strip(), r["cell_1"].strip()) for r in scans.extract_table_rows(pages, min_cells=2, n_cells=2).collect())
    assert got == [(1, "a", "b c"), (1, "d", "e"), (1, "f  g", "h"), (1, "in", "ner"), (1, "loose", "end")]


def test_stars_come_from_the_last_cell(spark):
    row = "<tr><td>1<td>2<td>3<td>4<td>5{}</tr>"
    pages = spark.createDataFrame([(1, row.format("<td><div style='width:  48px'></div>")), (2, row.format("")), (3, row.format("<td>width: 32px<td>none"))], "id int, html string")
    assert sorted((r["id"], r["stars"]) for r in scans.extract_table_rows(pages).collect()) == [(1, 3.0), (2, 0.0), (3, 0.0)]


def test_stacked_model_never_sees_its_own_target(spark):
    """Targets are pure noise: a leak would show as a base prediction that follows them."""
    rnd = random.Random(7)
    data = [(i, rnd.random(), rnd.random(), rnd.random() if i % 3 else None) for i in range(120)]
    df = spark.createDataFrame(data, "id int, x double, y double, public double")
    made = models.train_stacked_model(df, ["x"], "public", "y", ["id"], folds=3, trees=10)
    held = made.rows.select(F.corr("base_pick", "y")).first()[0]
    seen = models.predict_picks(made.base, df, "p").select(F.corr("p", "y")).first()[0]
    assert held < 0.2 < 0.4 < seen
    assert made.rows.count() == 120 and made.rows.where(models.fold_of(["id"], 3) != F.col("fold")).count() == 0
    out = {r["id"]: r for r in made.predict(df).collect()}
    assert all((out[i]["pick_pct"] == out[i]["base_pick"]) == (p is None) or p is not None for i, _, _, p in data)
    assert all(out[i]["public"] == p for i, _, _, p in data)


def test_scratch_folder_is_demanded_on_a_cluster():
    from types import SimpleNamespace

    from pickwright.session import shared_dir

    def session(master, warehouse, configured=None):
        known = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": configured}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: known[k] or d), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("local[8]", "file:/w/")) == "file:/w/pickwright-scratch"
    assert shared_dir(session("spark://m:7077", "hdfs://n/w")) == "hdfs://n/w/pickwright-scratch"
    assert shared_dir(session("spark://m:7077", "file:/w", "hdfs://n/c")) == "hdfs://n/c"
    for master in ("spark://m:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, "file:/w"))
