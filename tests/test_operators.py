"""Operators on small frames: hand-computed values, brute force, and properties."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwright import skew
from pickwright.operators import aggregates as A
from pickwright.operators import iterative, joins, paths, scenarios, windows
from pickwright.operators import rows as R


# --- expected value ---------------------------------------------------------
def brute_ev(games):
    """games: (p, q, ka, kb); mean of 1/survivors over all outcomes."""
    ev, total = {}, 0.0
    for outcome in itertools.product((0, 1), repeat=len(games)):
        w = math.prod((g[0], g[1])[o] for g, o in zip(games, outcome))
        s = sum((g[2], g[3])[o] for g, o in zip(games, outcome))
        total += w
        for i, o in enumerate(outcome):
            ev[i, o] = ev.get((i, o), 0.0) + (w / s if s > 0 else 0.0)
    return {k: v / total for k, v in ev.items()}


def run_ev(spark, games, fn=scenarios.scenario_ev):
    data = [(1, i, f"A{i}", f"B{i}", *map(float, g)) for i, g in enumerate(games)]
    df = spark.createDataFrame(data, "week int, game int, a string, b string, p double, q double, ka double, kb double")
    out = fn(df, ["week"], "game", "a", "b", "p", "q", "ka", "kb").collect()
    return {(r["game"], 0 if r["team"].startswith("A") else 1): r["ev"] for r in out}


def test_scenario_ev_golden(spark):
    got = run_ev(spark, [(0.7, 0.3, 0.4, 0.1), (0.6, 0.4, 0.3, 0.2)])
    want = {(0, 0): 1.0666667, (0, 1): 0.85, (1, 0): 1.05, (1, 1): 0.8666667}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_scenario_ev_matches_enumeration(spark, seed):
    rnd = random.Random(seed)
    games = []
    for _ in range(rnd.randint(1, 10)):
        p = rnd.choice([0.0, 1.0, rnd.random(), rnd.random()])
        zero = lambda: rnd.choice([0.0, rnd.random(), rnd.random() * 1e-5])
        games.append((p, 1 - p, zero(), zero()))
    if not any(g[2] or g[3] for g in games):
        games[0] = (0.5, 0.5, 0.1, 0.2)
    want = brute_ev(games)
    got = run_ev(spark, games)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9), (k, games)


def test_scenario_ev_normalises_and_handles_certain_wins(spark):
    games = [(0.9, 0.4, 0.2, 0.1), (0.5, 0.8, 0.05, 0.3)]
    assert run_ev(spark, games) == pytest.approx(brute_ev(games), rel=1e-9)
    sure = [(1.0, 0.0, 0.2, 0.1), (1.0, 0.0, 0.3, 0.1), (1.0, 0.0, 0.1, 0.1)]
    got = run_ev(spark, sure)
    assert all(got[i, 0] == pytest.approx(1 / 0.6) and got[i, 1] == pytest.approx(0) for i in range(3))


def test_scenario_ev_has_no_size_limit(spark):
    games = [(0.5, 0.5, 0.01, 0.01)] * 60
    assert all(v == pytest.approx(0.5 / 0.6, rel=1e-9) for v in run_ev(spark, games).values())


def test_pair_ev_matches_pairs(spark):
    games = [(0.7, 0.3, 0.4, 0.1), (0.6, 0.4, 0.3, 0.0), (0.2, 0.8, 0.1, 0.1)]
    got = run_ev(spark, games, scenarios.scenario_ev_pairs)
    for i, o in got:
        want = 0.0
        for j, side in itertools.product(range(3), (0, 1)):
            k = games[i][2 + o] * games[j][2 + side]
            if j != i and k > 0:
                want += games[i][o] * games[j][side] / k
        assert got[i, o] == pytest.approx(want)


def test_expand_outcomes_refuses_large_groups(spark):
    df = spark.range(5).select(F.lit(1).alias("g"), F.col("id").alias("game"))
    assert scenarios.expand_outcomes(df, ["g"], "game").count() == 5 * 32
    with pytest.raises(Exception, match="more than 4 games"):
        scenarios.expand_outcomes(df, ["g"], "game", limit=4).count()


def test_trials_do_not_depend_on_partitioning(spark):
    data = [(w, g, 0.3 + 0.1 * (g % 5), 0.1, 0.15) for w in (1, 2) for g in range(w * 10, w * 10 + 4)]
    df = spark.createDataFrame(data, "week int, game int, p double, ka double, kb double").withColumn("pool", F.lit(1))
    run = lambda d: sorted(map(tuple, scenarios.outcome_trials(d, ["pool"], "week", "game", "p", "ka", "kb", 50, 3).collect()))
    first = run(df)
    assert first == run(df.repartition(7))
    assert len(first) == 100 and all(0 <= r[3] <= 1 for r in first)


def test_trial_chance_is_the_game_chance(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 0.0), (2, 2, 0.25, 1.0, 0.0)], "week int, game int, p double, ka double, kb double").withColumn("pool", F.lit(1))
    got = {r["week"]: r["m"] for r in scenarios.outcome_trials(df, ["pool"], "week", "game", "p", "ka", "kb", 4000, 1).groupBy("week").agg(F.avg("rate").alias("m")).collect()}
    assert got[1] == 1.0
    assert got[2] == pytest.approx(0.25, abs=0.03)


def test_trials_draw_the_md5_of_any_name(spark):
    """One or two blocks of text, and a chance below 0, which nobody has."""
    import hashlib

    names = ["7", "é-1", "x" * 49, "x" * 50, "y" * 60, "z" * 130]
    data = [(i, n, 0.5 if i else -0.1, 1.0, 0.0) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "week int, game string, p double, ka double, kb double").withColumn("pool", F.lit(1))
    got = {(r["trial"], r["week"]): r["rate"] for r in scenarios.outcome_trials(df, ["pool"], "week", "game", "p", "ka", "kb", 120, 5).collect()}
    drawn = lambda t, n: int(hashlib.md5(f"{t}-{n}-5".encode()).hexdigest()[:13], 16) / 16**13
    assert got == {(t, w): float(drawn(t, n) < p) for t in range(120) for w, n, p, _, _ in data}


def test_trials_are_drawn_once_and_summed_per_task(spark):
    """Games of 60 weeks come mixed; the draws' task hands on few rows, and the summary reads sums."""
    df = spark.range(6000, numPartitions=3).select(F.lit(1).alias("pool"), (F.col("id") % 60).alias("week"), F.col("id").alias("game"), F.lit(0.5).alias("p"), F.lit(0.5).alias("ka"), F.lit(0.5).alias("kb"))
    made = scenarios.outcome_trials(df, ["pool"], "week", "game", "p", "ka", "kb", 20, 1)
    plan = scenarios.trial_summary(made, ["pool", "week"], "alive_share")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0" not in plan and "MapIn" not in plan
    assert made.count() == 1200


def test_scenario_ev_lists_games_once(spark):
    """A group of several lists beside one of a single game and one without a share; the steps read the lists, not the input."""
    df = spark.range(2502, numPartitions=3).select(
        F.when(F.col("id") < 2500, 1).otherwise(F.col("id") - 2498).alias("g"), F.col("id").alias("game"), F.lit("a").alias("ta"), F.lit("b").alias("tb"),
        F.lit(1.0).alias("p"), F.when(F.col("id") < 2501, 2.0).otherwise(0.0).alias("ka"), F.lit(0.0).alias("kb"),
    )
    made = scenarios.scenario_ev(df, ["g"], "game", "ta", "tb", "p", None, "ka", "kb")
    assert "Range (0" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.groupBy("g", "team").agg(F.count("*").alias("n"), F.min("ev").alias("low"), F.max("ev").alias("high")).collect()
    want = {(1, "a"): (2500, 1 / 5000), (2, "a"): (1, 0.5), (3, "a"): (1, 0.0)}
    assert len(got) == 6
    for r in got:
        n, v = want.get((r["g"], r["team"]), (2500 if r["g"] == 1 else 1, 0.0))
        assert r["n"] == n and (r["low"], r["high"]) == pytest.approx((v, v), rel=1e-9, abs=1e-12)


def test_agreement_joins_no_rows_to_ranks(spark):
    """Ties on both sides and a null; ranks of the second column never meet the rows."""
    rng = random.Random(4)
    data = [(float(rng.randrange(9)), float(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame([*data, (None, 1.0)], "a double, b double")
    made = A.agreement(df, "a", "b")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    x = np.array(data)
    ranks = [[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T]
    got = made.first()
    assert got["spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-12)
    assert got["pearson"] == pytest.approx(np.corrcoef(*x.T)[0, 1], abs=1e-12)
    assert A.agreement(df.where("false"), "a", "b").first()["spearman"] is None


def test_pieces_are_found_by_halving(spark):
    import bisect

    rng = random.Random(8)
    assert "filter" not in str(skew.piece_of(F.col("x")))
    for n in (0, 1, 2, 31, 512, 1022, 1023):
        cuts = sorted(float(v) for v in rng.sample(range(5000), n))
        asked = [float(rng.randrange(-5, 5005)) for _ in range(60)] + cuts[:1] + cuts[-1:] + [float("nan")]
        df = spark.createDataFrame([(v,) for v in asked], "x double").withColumn("_cuts", F.array(*map(F.lit, cuts)).cast("array<double>"))
        got = [r[0] for r in df.select(skew.piece_of(F.col("x"))).collect()]
        low = [n if math.isnan(v) else bisect.bisect_left(cuts, v) for v in asked]
        assert got == [2 * i + (i < n and cuts[i] == v) for i, v in zip(low, asked)]


# --- shares, ratings --------------------------------------------------------
def test_redistribute_golden(spark, rows):
    df = spark.createDataFrame([("a", 0.5, 0.3), ("b", 0.3, 0.9), ("c", 0.2, 0.25)], "t string, x double, cap double").withColumn("g", F.lit(1))
    out = rows(iterative.redistribute(df, ["g"], "x", "cap"), "t", "x", digits=5)
    assert out == [("a", 0.3), ("b", 0.45), ("c", 0.25)]


def test_redistribute_stops_when_everything_is_capped(spark, rows):
    df = spark.createDataFrame([("a", 0.5, 0.3), ("b", 0.5, 0.2)], "t string, x double, cap double").withColumn("g", F.lit(1))
    assert rows(iterative.redistribute(df, ["g"], "x", "cap"), "t", "x") == [("a", 0.3), ("b", 0.2)]


@pytest.mark.parametrize("seed", range(3))
def test_redistribute_keeps_sum_and_caps(spark, seed):
    rnd = random.Random(seed)
    data = [(g, i, rnd.random(), 0.02 + rnd.random() * 0.3) for g in range(5) for i in range(20)]
    df = spark.createDataFrame(data, "g int, i int, x double, cap double")
    df = windows.normalize(df, ["g"], "x")
    out = iterative.redistribute(df, ["g"], "x", "cap", out="y").collect()
    for g in range(5):
        mine = [r for r in out if r["g"] == g]
        assert sum(r["y"] for r in mine) == pytest.approx(1, abs=1e-4)
        assert all(r["y"] <= r["cap"] for r in mine)


def jacobi(edges, m, n):
    teams = sorted({e[0] for e in edges})
    r, sos = dict.fromkeys(teams, 0.0), {}
    for _ in range(n):
        new = {}
        for t in teams:
            mine = [e for e in edges if e[0] == t]
            w = sum(e[3] for e in mine)
            sos[t] = sum(r.get(e[1], 0.0) * e[3] for e in mine) / w
            new[t] = sum(e[2] * e[3] for e in mine) / w + m * sos[t]
        r = new
    return r, sos


@pytest.mark.parametrize("m,n", [(0.86, 100), (1.0, 7)])
def test_iterative_rating_matches_loop(spark, m, n):
    rnd = random.Random(n)
    edges = []
    for _ in range(30):
        a, b = rnd.sample(range(6), 2)
        net, w = rnd.uniform(-9, 9), rnd.random() + 0.1
        edges += [(a, b, net, w), (b, a, -net, w * 1.01)]
    df = spark.createDataFrame(edges, "team int, opponent int, net double, w double")
    got = {r["team"]: (r["x"], r["x_schedule"]) for r in iterative.iterative_rating(df, "team", "opponent", {"x": "net"}, "w", m, n).collect()}
    want, sos = jacobi(edges, m, n)
    for t in want:
        assert got[t] == pytest.approx((want[t], sos[t]), rel=1e-9, abs=1e-9)


def test_two_teams_one_pass(spark, rows):
    df = spark.createDataFrame([("a", "b", 6.0, 1.0), ("b", "a", -6.0, 1.0)], "team string, opponent string, net double, w double")
    assert rows(iterative.iterative_rating(df, "team", "opponent", {"x": "net"}, "w", 0.0, 1), "team", "x") == [("a", 6.0), ("b", -6.0)]


def test_pool_projection_clamps(spark):
    data = [(1, 1, "a", 1.0, 1.0), (1, 2, "a", 1.0, 0.5), (1, 3, "b", 0.5, 1.0)]
    sides = spark.createDataFrame(data, "pool int, week int, team string, pick_pct double, win double")
    pools = spark.createDataFrame([(1, 100)], "pool int, entries int")
    got = {(r["week"], r["team"]): (r["entries"], r["used"], r["availability"]) for r in iterative.pool_projection(sides, pools, ["pool"]).collect()}
    assert got[1, "a"] == (100, 0, 1)
    assert got[2, "a"] == (100, 100, 0)
    # 50 + 100 * 0.5 is more than the 50 that survive
    assert got[3, "a"] == (50, 50, 0)
    assert got[3, "b"] == (50, 0, 1)


# --- paths ------------------------------------------------------------------
def brute_paths(score, weeks, per_week, k, forced=()):
    teams = sorted({t for _, t in score})
    options = []
    for w in weeks:
        options.append([c for c in itertools.combinations([t for t in teams if (w, t) in score], per_week.get(w, 1))])
    best = []
    for choice in itertools.product(*options):
        flat = [t for c in choice for t in c]
        if len(set(flat)) == len(flat) and all(t in dict(zip(weeks, choice))[w] for w, t in forced):
            best.append(sum(score[w, t] for w, c in zip(weeks, choice) for t in c))
    return sorted(best, reverse=True)[:k]


@pytest.mark.parametrize("seed,per_week", [(0, {}), (1, {3: 2}), (2, {}), (3, {2: 3})])
def test_best_paths_match_brute_force(spark, seed, per_week):
    rnd = random.Random(seed)
    weeks = [1, 2, 3, 4]
    data, want = [], {}
    for contest in (1, 2):
        # similar teams every week, so that the weekly favourites collide
        strength = [rnd.random() for _ in range(7)]
        score = {(w, f"t{t}"): strength[t] + rnd.random() * 0.2 for w in weeks for t in range(7) if rnd.random() < 0.9}
        want[contest] = brute_paths(score, weeks, per_week, 4)
        data += [(contest, w, t, s) for (w, t), s in score.items()]
    df = spark.createDataFrame(data, "contest int, week int, team string, score double")
    out = paths.best_paths(df, ["contest"], "week", "team", "score", weeks, k=4, picks=per_week).collect()
    for contest in (1, 2):
        got = [r["total"] for r in sorted((r for r in out if r["contest"] == contest), key=lambda r: r["rank"])]
        assert got == pytest.approx(want[contest])
    assert all(len(set(r["picks"])) == len(r["picks"]) for r in out)


def test_best_paths_with_required_picks(spark):
    rnd = random.Random(9)
    weeks = [1, 2, 3]
    score = {(w, f"t{t}"): rnd.random() for w in weeks for t in range(6)}
    forced = [(2, "t0"), (3, "t4")]
    df = spark.createDataFrame([(1, w, t, s) for (w, t), s in score.items()], "contest int, week int, team string, score double")
    need = spark.createDataFrame([(1, w, t) for w, t in forced], "contest int, week int, team string")
    out = paths.best_paths(df, ["contest"], "week", "team", "score", weeks, k=3, picks={3: 2}, required=need).collect()
    want = brute_paths(score, weeks, {3: 2}, 3, forced)
    assert sorted((r["total"] for r in out), reverse=True) == pytest.approx(want)
    assert all(r["picks"][1] == "t0" and "t4" in r["picks"][2:] for r in out)


PATH_SCHEMA = "contest int, week int, team string, score double"


def test_best_paths_count_a_repeated_team_once(spark):
    rows = [(1, 1, "A", 9.0)] * 4 + [(1, 1, "B", 8.0), (1, 2, "A", 9.0), (1, 2, "A", 3.0), (1, 2, "B", 1.0)]
    out = paths.best_paths(spark.createDataFrame(rows, PATH_SCHEMA), ["contest"], "week", "team", "score", [1, 2], k=2).collect()
    assert sorted((r["rank"], r["picks"], r["total"]) for r in out) == [(1, ["B", "A"], 17.0), (2, ["A", "B"], 10.0)]


def test_best_paths_take_the_weeks_that_a_contest_has(spark):
    rows = [(1, 1, "A", 5.0), (1, 1, "B", 4.0), (1, 3, "A", 5.0), (1, 3, "B", 1.0), (2, 2, "A", 1.0), (2, 2, "B", 2.0), (2, 2, "C", 3.0), (3, 1, "A", 1.0), (3, 2, "A", 1.0)]
    df = spark.createDataFrame(rows, PATH_SCHEMA)
    out = paths.best_paths(df, ["contest"], "week", "team", "score", [1, 2, 3], k=1, picks={2: 2}).collect()
    got = {r["contest"]: (r["picks"], r["total"]) for r in out}
    assert got == {1: (["B", "A"], 9.0), 2: (["B", "C"], 5.0)}  # contest 3 has one team for three picks: no path


def test_best_paths_ignore_a_required_team_that_does_not_play(spark):
    rows = [(1, 1, "A", 5.0), (1, 1, "B", 4.0), (1, 2, "A", 3.0), (1, 2, "C", 1.0)]
    need = spark.createDataFrame([(1, 1, "Z"), (1, 2, "C"), (1, 1, "C")], "contest int, week int, team string")
    out = paths.best_paths(spark.createDataFrame(rows, PATH_SCHEMA), ["contest"], "week", "team", "score", [1, 2], k=1, required=need).collect()
    assert [(r["picks"], r["total"]) for r in out] == [(["A", "C"], 6.0)]


def test_best_paths_of_a_whole_season(spark):
    """18 weeks x 32 teams, checked against the value of an optimal assignment."""
    rnd = np.random.default_rng(5)
    strength = rnd.normal(0, 0.15, 32)
    score = np.clip(1 + strength[None, :] + rnd.normal(0, 0.1, (18, 32)), 0, None)
    data = [(1, w + 1, f"t{t:02}", float(score[w, t])) for w in range(18) for t in range(32)]
    df = spark.createDataFrame(data, "contest int, week int, team string, score double")
    out = paths.best_paths(df, ["contest"], "week", "team", "score", list(range(1, 19)), k=2).collect()
    best = max(r["total"] for r in out)
    assert len(out) == 2
    # weak duality: for any prices >= 0 no assignment beats this bound
    prices, bound = np.zeros(32), np.inf
    for i in range(4000):
        top = (score - prices).argmax(axis=1)
        bound = min(bound, (score - prices).max(axis=1).sum() + prices.sum())
        used = np.bincount(top, minlength=32)
        prices = np.maximum(0, prices + 0.05 / math.sqrt(i + 1) * (used - 1))
    assert best <= bound + 1e-9
    assert best >= bound - 0.02


# --- skew-safe blocks -------------------------------------------------------
def test_running_totals_across_bins(spark):
    rnd = random.Random(1)
    data = [(g, rnd.choice([rnd.randint(-50, 50), 7]), 1) for g in ("hot", "hot", "hot", "cold") for _ in range(300)]
    df = spark.createDataFrame(data, "g string, x int, n int")
    one = skew.running_totals(df, ["g"], "x", {"n": F.col("n")})
    many = skew.running_totals(df, ["g"], "x", {"n": F.col("n")}, bin_rows=5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    for g, x, n, upto, total in map(tuple, many.collect()):
        mine = [d[1] for d in data if d[0] == g]
        assert (n, upto, total) == (mine.count(x), sum(v <= x for v in mine), len(mine))


def test_neighbor_crosses_chunks(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=d) for d in (0, 3, 3, 40, 41, 200)]
    data = [("a", d, i, i * 10) for i, d in enumerate(days)] + [("b", days[0], 9, None)]
    df = spark.createDataFrame(data, "t string, day date, id int, v int")
    for chunk in (skew.day_chunk("day", 7), skew.day_chunk("day", 1000)):
        back = {r["id"]: r["p"] for r in skew.neighbor(df, ["t"], ["day", "id"], {"p": "v"}, chunk).collect()}
        assert back == {0: None, 1: 0, 2: 10, 3: 20, 4: 30, 5: 40, 9: None}
        ahead = {r["id"]: r["p"] for r in skew.neighbor(df, ["t"], ["day", "id"], {"p": "v"}, chunk, ahead=True).collect()}
        assert ahead == {0: 10, 1: 20, 2: 30, 3: 40, 4: 50, 5: None, 9: None}


def largest_piece(df, keys):
    """Rows of the largest piece over the mean piece's rows, within the hot key."""
    sizes = [r["count"] for r in df.groupBy(*keys).count().collect()]
    return max(sizes), sum(sizes) / len(sizes)


def test_pieces_of_a_hot_key_with_an_outlier(spark):
    n = 60_000
    x = F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") * 0.5)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("g"), x.alias("x"), "id")
    cut = skew.cut_pieces(df, ["g"], ["x"], 1000).where("g = 'hot'")
    most, _ = largest_piece(cut, ["_piece"])
    assert most <= 1.5 * (n / 3) / skew.CUTS + 2
    got = {(r["g"], r["x"]): r["n_upto"] for r in skew.running_totals(df, ["g"], "x", {"n": F.lit(1)}, bin_rows=1000).where("g = 'hot'").collect()}
    assert [got["hot", v] for _, v in sorted(got)] == list(range(1, len(got) + 1)) and len(got) == n / 3


def test_a_single_heavy_value_is_cut_by_the_next_column(spark):
    n = 40_000
    day = F.when(F.col("id") % 2 == 0, F.lit("2025-01-05")).otherwise(F.lit("2025-01-06")).cast("date")
    df = spark.range(n).select(F.lit("hot").alias("t"), day.alias("day"), "id", (F.col("id") * 7).alias("v"))
    cut = skew.cut_pieces(df, ["t"], ["day", "id"], 500)
    assert largest_piece(cut, ["_piece"])[0] <= 1.5 * n / 2 / skew.CUTS + 2
    for ahead in (False, True):
        got = skew.neighbor(df, ["t"], ["day", "id"], {"p": "v"}, F.lit(0), ahead=ahead, piece_rows=500)
        pairs = {r["id"]: r["p"] for r in got.collect()}
        line = sorted(range(n), key=lambda i: (i % 2, i))
        if ahead:
            line = line[::-1]
        assert pairs == {i: (line[k - 1] * 7 if k else None) for k, i in enumerate(line)}


def test_string_order_keeps_its_order(spark):
    words = ["", "a", "ab", "abcdefg", "abcdefh", "b", "zz", "é"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    codes = [r[0] for r in df.orderBy("s").select(skew._ordinal(df, "s")).collect()]
    assert codes == sorted(codes) and None not in codes


def test_nan_has_no_rank_and_no_weight(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", float("nan")), ("a", 1.0), ("a", None)], "g string, x double")
    ranks = {str(r["x"]): (r["x_rank"], r["x_rank_density"]) for r in windows.rank_density(df, ["g"], "x").collect()}
    assert ranks == {"2.0": (1, 0.25), "1.0": (2, 0.5), "nan": (None, None), "None": (None, None)}
    weak = {str(r["x"]): r["p"] for r in windows.weak_percentile(df, ["g"], "x", "p").collect()}
    assert weak == {"2.0": 100.0, "1.0": 50.0, "nan": None, "None": None}
    assert df.agg(A.wmean(F.col("x"), F.lit(1.0)).alias("m")).first()["m"] == 1.5
    assert {r["x_mean"] for r in windows.group_stats(df, ["g"], ["x"]).collect()} == {1.5}
    assert A.summarize(df, ["g"], "x").first()["median"] == 1.5


def test_first_by_keeps_whole_rows(spark, rows):
    df = spark.createDataFrame([(1, None, 2), (1, "x", 1), (2, "y", 5)], "k int, v string, o int")
    assert rows(skew.first_by(df, ["k"], [F.col("o")])) == [(1, "x", 1), (2, "y", 5)]
    assert rows(skew.first_by(df, ["k"], [F.col("o")], last=True)) == [(1, None, 2), (2, "y", 5)]


# --- windows ----------------------------------------------------------------
def test_games_in_days_golden(spark):
    days = ["2025-09-01", "2025-09-06", "2025-09-11", "2025-09-12"]
    df = spark.createDataFrame([("a", d) for d in days], "t string, day string").withColumn("day", F.to_date("day"))
    out = {str(r["day"]): (r["x_count"], r["x"]) for r in windows.count_in_days(df, ["t"], "day", {"x": (10, 3)}).collect()}
    assert [out[d] for d in days] == [(1, False), (2, False), (3, True), (3, True)]


def test_percentile_rank_and_stars_golden(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double").withColumn("g", F.lit(1))
    assert [r[1] for r in rows(windows.weak_percentile(df, ["g"], "x", "p"), "x", "p")] == [25, 75, 75, 100]
    d = spark.createDataFrame([(5.0,), (2.0,), (2.0,), (1.0,), (None,)], "x double").withColumn("g", F.lit(1))
    got = rows(windows.rank_density(d.where("x is not null"), ["g"], "x"), "x", "x_rank", "x_rank_density")
    assert got == [(1.0, 4, 1.0), (2.0, 2, 0.5), (2.0, 2, 0.5), (5.0, 1, 0.25)]
    ranks = {r["x"]: r["x_rank"] for r in windows.rank_density(d, ["g"], "x").collect()}
    assert ranks[None] is None and ranks[5.0] == 1
    s = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "x double").withColumn("g", F.lit(1))
    assert rows(windows.minmax_stars(s, ["g"], "x"), "x", "stars") == [(0.0, 0.0), (0.25, 1.0), (1.0, 5.0)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double").withColumn("g", F.lit(1))
    assert [r[0] for r in rows(windows.minmax_stars(same, ["g"], "x"), "stars")] == [0.0, 0.0]


def test_one_row_group_has_zero_deviation(spark):
    df = spark.createDataFrame([(1, 4.0)], "g int, x double")
    r = windows.group_stats(df, ["g"], ["x"]).first()
    assert (r["x_mean"], r["x_std"]) == (4.0, 0.0)


def test_normalize_zero_sum(spark, rows):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 3.0), (2, 1.0)], "g int, x double")
    assert rows(windows.normalize(df, ["g"], "x", F.lit(2.0)), "g", "x") == [(1, 0.0), (1, 0.0), (2, 0.5), (2, 1.5)]


# --- aggregates -------------------------------------------------------------
def test_percentiles_golden(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 10)] + [(2, 5.0)], "g int, x double")
    got = {r["g"]: (r["p25"], r["median"]) for r in A.summarize(df, ["g"], "x").collect()}
    assert got == {1: (1.75, 2.5), 2: (5.0, 5.0)}


def test_availability_forms(spark):
    picks = spark.createDataFrame(
        [(e, w, t, 5) for e, w, t in [("a", 1, "X"), ("a", 2, "X"), ("b", 1, "Y"), ("c", 1, "Z"), ("d", 1, "Y")]] + [("dead", 1, "X", 0)],
        "entry string, week int, team string, total_wins int",
    )
    teams = spark.createDataFrame([("X",), ("Y",), ("Q",)], "team string")
    got = {r["team"]: r["availability"] for r in A.availability(picks, teams, 3).collect()}
    assert got == {"X": 0.75, "Y": 0.5, "Q": 1.0}
    grid = teams.select(F.lit(1).alias("pool"), F.lit(3).alias("week"), "team")
    pools = spark.createDataFrame([(1, 10)], "pool int, entries int")
    p = picks.withColumn("pool", F.lit(1))
    alive = A.alive_by_week(p.select("pool", "entry", "total_wins").distinct(), ["pool"], "total_wins", 3, pools)
    flow = {r["team"]: r["availability"] for r in A.pick_flow(grid, p, alive, pools, ["pool"]).collect()}
    # per occurrence: entry a used X twice
    assert flow["X"] == 0.5
    assert {r["week"]: r["alive"] for r in alive.collect()} == {1: 10, 2: 4, 3: 4}


def test_empty_weighted_mean_is_zero(spark, rows):
    df = spark.createDataFrame([(1, None, 1.0), (2, 3.0, 2.0), (None, 1.0, 1.0)], "g int, x double, w double")
    assert rows(A.weighted_mean(df, ["g"], {"m": "x"}, "w")) == [(1, 0.0), (2, 3.0)]


def test_mode_tie_takes_the_smallest(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (2, None)], "g int, v string")
    assert rows(A.mode_by(df, ["g"], "v")) == [(1, "a", 2)]


def test_as_of_rows_after_the_date_never_matter(spark, rows):
    base = [("a", "2025-01-01", 1.0), ("a", "2025-01-10", 5.0), ("b", "2025-01-12", 2.0)]
    make = lambda data: spark.createDataFrame(data, "k string, day string, x double").withColumn("day", F.to_date("day"))
    dates = ["2025-01-05", "2025-01-12"]
    before = rows(A.as_of_weighted_mean(make(base), "k", "day", "x", dates))
    after = rows(A.as_of_weighted_mean(make(base + [("a", "2025-01-13", 900.0), ("c", "2025-02-01", 1.0)]), "k", "day", "x", dates))
    assert before == after and len(before) == 3


def test_pair_sides_needs_exactly_two(spark, rows):
    df = spark.createDataFrame([(1, "a", 30.0), (1, "b", 2.0), (2, "a", 1.0), (3, "x", 1.0), (3, "y", 1.0), (3, "z", 1.0)], "g int, t string, v double")
    out = joins.pair_sides(df, "g", "t", [], {"net": ("v", None)})
    assert rows(out) == [(1, "a", "b", 28.0), (1, "b", "a", -28.0)]


# --- rows -------------------------------------------------------------------
def test_overlay_forms(spark, rows):
    base = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double")
    live = spark.createDataFrame([(1, None), (9, 1.0)], "k int, v double")
    assert rows(joins.overlay(base, live, ["k"], ["v"])) == [(1, None), (2, 6.0)]
    assert rows(joins.overlay(base, live, ["k"], ["v"], keep_on_null=True)) == [(1, 5.0), (2, 6.0)]


def test_nearest_price_rounds_half_even_and_clamps(spark, rows):
    df = spark.createDataFrame([(1, 3.25), (2, -3.75), (3, 45.0), (4, 0.0), (5, None)], "k int, s double").withColumns(
        {"h": F.lit(None).cast("int"), "a": F.lit(None).cast("int")}
    )
    got = rows(joins.nearest_lookup(df, "s", "h", "a"), "k", "h", "a")
    assert got == [(1, -164, 135), (2, 171, -211), (3, -10000, 2000), (4, -110, -110), (5, None, None)]


def test_week_cutoff_counts_the_day_itself(spark, rows):
    df = spark.createDataFrame([(2025, "2025-11-28", 13), (2025, "2025-11-29", 13), (2025, "2025-12-26", 17), (2019, "2019-12-30", 17)], "y int, d string, w int")
    df = df.withColumn("d", F.to_date("d"))
    got = [r["c"] for r in joins.shift_weeks(df, joins.calendar_cutoffs(spark), "y", "d", "w", "c").orderBy("d").collect()]
    assert got == [17, 13, 14, 19]


def test_results_with_missing_scores(spark):
    df = spark.createDataFrame([("H", "A", None, None, 3.0), ("H", "A", 10, 10, 0.0), ("H", "A", 7, 10, 3.0)], "h string, a string, hs int, as int, line double")
    out = R.derive_result(df, "h", "a", "hs", "as", "line").collect()
    assert [r["winner"] for r in out] == [None, "Tie", "A"]
    assert [r["spread_winner"] for r in out] == [None, "PUSH", "A"]
    assert [r["upset"] for r in out] == [None, False, True]


def test_every_pick_rule_can_reject(spark):
    good = dict(is_away=True, margin=9.0, back_to_back=False, divisional=False, rest=7, opp_rest=7, four_in_17=False, three_in_10=False,
                foreign_venue=False, thursday=0, rest_adv=0, season_rest_adv=0, travel_adv=0.0, prohibited=False, already_used=False, consensus=True)
    bad = {
        "not_favored": dict(margin=-1.0), "away_close": dict(margin=2.0), "back_to_back_away": dict(back_to_back=True),
        "close_divisional": dict(divisional=True, margin=2.5), "away_divisional": dict(divisional=True), "short_rest": dict(rest=5),
        "four_in_17": dict(four_in_17=True), "three_in_10": dict(three_in_10=True), "foreign_venue": dict(foreign_venue=True),
        "thursday": dict(thursday=1), "away_thursday": dict(thursday=1), "weekly_rest": dict(rest_adv=-1), "season_rest": dict(season_rest_adv=-11),
        "travel": dict(travel_adv=-900.0), "prohibited": dict(prohibited=True), "already_used": dict(already_used=True), "no_consensus": dict(consensus=False),
    }
    rules = R.pick_rules()
    assert set(rules) == set(bad)
    names = list(good)
    data = [tuple((good | change)[n] for n in names) + (name,) for name, change in bad.items()] + [tuple(good.values()) + ("none",)]
    df = spark.createDataFrame(data, [*names, "case"])
    got = {r["case"]: r["reject_reasons"] for r in R.eligible(df, rules).collect()}
    assert got.pop("none") == []
    assert all(name in reasons for name, reasons in got.items())


def test_overrides_sentinel(spark, rows):
    base = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.3), (1, "c", 0.4)], "week int, team string, pct double")
    ov = spark.createDataFrame([(1, "a", -1.0), (1, "b", 0.0)], "week int, team string, override double")
    assert rows(R.apply_overrides(base, ov, ["week", "team"], "pct")) == [(1, "a", 0.2), (1, "b", 0.0), (1, "c", 0.4)]


def test_values_without_weight_have_no_mean_and_fail_nothing(spark):
    """A pace whose only gap weighs 0 failed the job by a division by zero."""
    df = spark.createDataFrame([("a", 5.0, 0.0), ("b", 4.0, 0.0), ("b", 7.0, 2.0), ("c", None, 0.0)], "k string, x double, w double")
    got = {r["k"]: r["pace"] for r in windows.pace(df, ["k"], "x", "w").collect()}
    assert math.isnan(got["a"]) and got["b"] == 7.0 and "c" not in got
    shares = df.groupBy("k").agg(A.wmean(F.col("x"), F.col("w")).alias("m"), A.wstd(F.col("x"), F.col("w")).alias("s"), A.wrate(F.col("x") > 4, F.col("x") > 0, F.col("w")).alias("r"))
    got = {r["k"]: tuple(r)[1:] for r in shares.collect()}
    assert all(math.isnan(v) for v in got["a"]) and got["b"] == (7.0, 0.0, 1.0) and got["c"] == (None, 0.0, None)


def test_forest_rows_are_dealt_over_tasks(spark, monkeypatch):
    """One partition in, as many as the work asks for out, the same rows, and a chance for each."""
    from pickwright.operators import models

    df = spark.range(400).selectExpr("id", "double(id % 20) AS f", "double(id % 7) AS g", "int(id % 20 > 11) AS y").coalesce(1)
    monkeypatch.setattr(skew, "MADE_ROWS", 100)
    fitted = models.train_upset_model(df, ["f", "g"], "y", trees=20, depth=3)
    scored = models.predict_upsets(fitted, df)
    assert scored.rdd.getNumPartitions() == 4
    got = scored.collect()
    assert sorted(r["id"] for r in got) == list(range(400)) and all((r["upset_probability"] > 0.5) == (r["y"] == 1) for r in got)


def test_plays_are_dealt_by_rows(spark, monkeypatch):
    """A task of the join holds a bounded number of rows, not a bounded number of shuffled bytes."""
    from oracle import ROOT
    from pickwright.catalog.bindings import plays

    monkeypatch.setattr(skew, "MADE_ROWS", 500)
    n = spark.read.parquet(f"{ROOT}/sf0.001/lineitem.parquet").count()
    assert plays(spark, f"{ROOT}/sf0.001").rdd.getNumPartitions() >= n // 500 > 4


def test_forest_is_that_of_mllib(spark):
    """The same chances and importances as MLlib's forest up to the draws, on rows with missing features and labels; its counts are those of the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from pickwright.operators import forest, models

    draw = lambda k, n: f"double(pmod(xxhash64(id, {k}), {n}))"
    df = spark.range(1500).selectExpr("id", f"{draw(1, 1000)} AS a", f"if(id % 9 = 0, null, {draw(2, 20)}) AS b", f"{draw(3, 50)} AS c")
    df = df.selectExpr("*", f"if(id % 11 = 0, null, int(a / 1000 + coalesce(b, 5) / 20 + {draw(4, 100)} / 100 > 2.0)) AS y").cache()
    names, trees, depth = ["a", "b", "c"], 60, 5
    fitted = models.train_upset_model(df, names, "y", trees, depth)
    got = {r["id"]: r["upset_probability"] for r in models.predict_upsets(fitted, df).collect()}
    again = models.train_upset_model(df, names, "y", trees, depth)
    assert [t.counts.tolist() for t in again.forest.trees] == [t.counts.tolist() for t in fitted.forest.trees]

    known = df.where("y IS NOT NULL")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    weighed = known.withColumns({"w": F.when(F.col("y") == 1, 1 / n[1]).otherwise(1 / n[0]) * (sum(n.values()) / 2), "y": F.col("y").cast("double")})
    filled = [f"_{c}" for c in names]
    stages = [Imputer(inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=3)]
    plain = Pipeline(stages=stages).fit(weighed)
    want = {r["id"]: r["p"] for r in plain.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    gap = np.array([got[k] - want[k] for k in want])
    assert set(got) == set(want) and np.abs(gap).mean() < 0.03 and abs(gap.mean()) < 0.01
    assert np.abs(np.array(list(fitted.importances().values())) - plain.stages[-1].featureImportances.toArray()).max() < 0.06

    for t in fitted.forest.trees:
        inner = np.flatnonzero(t.child != np.arange(len(t.child)))
        assert forest.height(t.child) <= depth and abs(int(t.counts[0].sum()) - sum(n.values())) < 200  # Poisson draws of mean 1
        assert all((t.counts[k] == t.counts[t.child[k]] + t.counts[t.child[k] + 1]).all() for k in inner)


def test_forest_of_one_class_or_constant_features(spark):
    from pickwright.operators import models

    df = spark.createDataFrame([(k, 1.0, float(k % 3), 1, k % 2, 0) for k in range(60)], "id int, f double, g double, one int, y int, zero int")
    chance = lambda label, names: {round(r["upset_probability"], 9) for r in models.predict_upsets(models.train_upset_model(df, names, label, 8, 3), df).collect()}
    assert chance("one", ["f", "g"]) == {1.0} and chance("zero", ["f", "g"]) == {0.0}
    assert all(0.2 < p < 0.8 for p in chance("y", ["f"]))
    with pytest.raises(ValueError):
        models.train_upset_model(df.where("id < 0"), ["f"], "y")
    with pytest.raises(ValueError):
        models.train_upset_model(df.withColumn("y", F.col("id") - 3), ["f"], "y")


def test_best_split_is_that_of_all_splits():
    from pickwright.operators import forest

    rnd = np.random.default_rng(5)
    counts, weights = rnd.integers(0, 4, (6, 2, 3, 5)) * rnd.integers(0, 2, (6, 2, 3, 5)), np.array([0.7, 1.9])
    counts[:, :, 1:, -1] += (counts[:, :, :1].sum(axis=3) - counts[:, :, 1:].sum(axis=3)).clip(0)
    allowed = rnd.random((6, 3)) < 0.7
    feature, cut, gain, left = forest.best_splits(counts, weights, allowed)
    impurity = lambda c: 1 - sum(((c * weights) / (c * weights).sum()) ** 2) if c.sum() else 0.0
    for k in range(6):
        found = [-1.0]
        for f in np.flatnonzero(allowed[k]):
            for b in range(4):
                a, z = counts[k, :, f, : b + 1].sum(axis=1), counts[k, :, f, b + 1 :].sum(axis=1)
                if a.sum() and z.sum():
                    share = (a * weights).sum() / ((a + z) * weights).sum()
                    found.append(impurity(a + z) - share * impurity(a) - (1 - share) * impurity(z))
        assert abs(max(found) - gain[k]) < 1e-12
        assert max(found) < 0 or (left[k] == counts[k, :, feature[k], : cut[k] + 1].sum(axis=1)).all()
