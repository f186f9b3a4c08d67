"""Forests. Trees differ between libraries, so the SQL states what holds for any right forest: the rows, the range
of the predictions, a bound on the held-out error, and the columns that elimination must keep."""

from pyspark.sql import functions as F

from pickwright.catalog.base import case, q
from pickwright.catalog.bindings import GAMES, TEAM_GAMES, games, team_games
from pickwright.operators import models
from pickwright.operators.rows import derive_result, mismatch_features
from pickwright.operators.windows import future_mean, group_stats, minmax_stars, relative_stats
from pickwright.session import cut_lineage

FEATURES = [
    "win", "adv_mean", "adv_max", "adv_min", "adv_std", "win_vs_mean", "win_vs_top", "win_from_top", "win_is_top", "future_mean", "stars",
    "week", "away_share", "games", "thursdays", "line", "late",
]


def pick_features(spark, d):
    """One row per (season, week, team) with the crowd's share to learn."""
    tg = team_games(spark, d)
    cells = tg.groupBy("season", "week", "team").agg(
        F.avg("win").alias("win"), F.avg(F.col("is_away").cast("double")).alias("away_share"), F.count("*").alias("games"),
        F.sum((F.weekday("day") == 3).cast("int")).alias("thursdays"), F.max("line").alias("line"), F.avg((F.dayofmonth("day") > 15).cast("double")).alias("late"),
    )
    cells = cells.withColumn("adv", F.col("win") - 0.5)
    cells = relative_stats(group_stats(cells, ["season", "week"], ["adv"]), ["season", "week"], ["win"])
    cells = minmax_stars(future_mean(cells, ["season", "team"], "week", "adv"), ["season", "week"], "future_mean")
    return cells.withColumn("pick_share", F.greatest(F.lit(0.0), F.col("win_vs_mean")) * 0.3 + F.col("stars") * 0.01)


CELLS = "cells AS (SELECT DISTINCT season, week, team FROM tg)"


@case("i9_pick_model", "season:l week:l team:l in_range:b fits:b", q(GAMES, TEAM_GAMES, CELLS, "SELECT season, week, team, true AS in_range, true AS fits FROM cells"))
def i9(spark, d):
    """A forest averages targets, so it stays in their range; on the smallest tables the
    held-out error is 0.005, that of a constant 0.033."""
    rows = cut_lineage(pick_features(spark, d))
    fitted = models.train_pick_model(rows, FEATURES, "pick_share", ["season", "week", "team"], trees=50)
    low, high = (rows.select(f("pick_share")).scalar() for f in (F.min, F.max))
    inside = F.col("pick_pct").between(low - 1e-9, high + 1e-9)
    return models.predict_picks(fitted, rows).withColumns({"in_range": inside, "fits": F.lit(fitted.mae < 0.012)})


_FOLD_SQL = "CAST('0x' || substr(md5(season || '-' || week || '-' || team), 1, 8) AS BIGINT) % 3"


@case(
    "i9_stacked_model", "fold:l n:l n_public:l mean_win:d base_fits:b final_fits:b held_out:b",
    q(GAMES, TEAM_GAMES, "c AS (SELECT season, week, team, avg(win) AS win FROM tg GROUP BY ALL)", f"f AS (SELECT *, {_FOLD_SQL} AS fold FROM c)",
      "SELECT fold, count(*) AS n, count(*) FILTER (team % 4 <> 0) AS n_public, avg(win) AS mean_win, true AS base_fits, true AS final_fits, true AS held_out FROM f GROUP BY ALL"),
)
def i9_stacked(spark, d):
    """Folds, their sizes and means by SQL. Both forests must beat the best constant twice over on rows they have not
    seen, and out-of-fold predictions must be worse than those of a forest that has seen the rows."""
    public = F.when(F.col("team") % 4 != 0, F.col("pick_share") * 0.8 + (F.col("team") % 5) * 0.004)
    rows = cut_lineage(pick_features(spark, d).withColumn("public_pick", public))
    made = models.train_stacked_model(rows, FEATURES, "public_pick", "pick_share", ["season", "week", "team"], trees=20)
    middle = rows.select(F.median("pick_share")).scalar()
    constant = rows.select(F.avg(F.abs(F.col("pick_share") - middle))).first()[0]
    seen = made.predict(made.rows.drop("base_pick")).select(F.avg(F.abs(F.col("base_pick") - F.col("pick_share")))).first()[0]
    told = made.rows.groupBy("fold").agg(F.count("*").alias("n"), F.count("public_pick").alias("n_public"), F.avg("win").alias("mean_win"))
    return told.withColumns({"base_fits": F.lit(made.base.mae < constant / 2), "final_fits": F.lit(made.final.mae < constant / 2), "held_out": F.lit(seen < made.base.mae)})


#: Columns that carry nothing about the target: with the real ones they make up the thirty features.
NOISE = [f"noise_{i}" for i in range(30 - len(FEATURES))]


@case("i10_feature_elimination", "season:l week:l team:l kept:l signal_kept:b", q(GAMES, TEAM_GAMES, CELLS, "SELECT season, week, team, 15 AS kept, true AS signal_kept FROM cells"))
def i10(spark, d):
    """Thirty features down to fifteen; both columns that the target is made of must stay."""
    rows = pick_features(spark, d)
    draws = {n: F.pmod(F.xxhash64("season", "week", "team", F.lit(n)), F.lit(1000)) / 1000 for n in NOISE}
    rows = cut_lineage(rows.withColumns(draws))
    kept = models.rfe(rows, FEATURES + NOISE, "pick_share", keep=15, step=5, trees=30)
    return rows.select("season", "week", "team", F.lit(len(kept)).alias("kept"), F.lit({"win_vs_mean", "stars"} <= set(kept)).alias("signal_kept"))


def upset_rows(spark, d):
    named = games(spark, d).withColumns({c: F.col(c).cast("string") for c in ("home", "away")})
    g = derive_result(named, "home", "away", "home_score", "away_score", "spread")
    g = g.withColumns(
        {
            "home_Off_Run_EPA_Pct": F.col("total") / 5000, "away_Def_Run_EPA_Pct": F.when(F.col("cust") % 10 != 0, (F.col("cust") % 100).cast("double")),
            "away_Off_Run_EPA_Pct": (F.col("game_id") % 100).cast("double"), "home_Def_Run_EPA_Pct": (F.col("cust") % 50).cast("double"),
        }
    )
    return mismatch_features(g)


@case("i11_upset_model", "game_id:l is_chance:b balanced:b", q(GAMES, "SELECT game_id, true AS is_chance, true AS balanced FROM games"))
def i11(spark, d):
    """Trained on the seasons before 2000, applied to all games; balanced classes put the mean chance near a half."""
    rows = cut_lineage(upset_rows(spark, d))
    features = ["spread", "total", "Matchup_HomeOff_Run", "Matchup_AwayOff_Run", "week"]
    played = rows.where(F.col("upset").isNotNull() & (F.col("spread") != 0)).withColumn("upset", F.col("upset").cast("int"))
    fitted = models.train_upset_model(played.where("season < 2000"), features, "upset")
    scored = cut_lineage(models.predict_upsets(fitted, rows))  # read twice
    p = F.col("upset_probability")
    mean = scored.select(F.avg("upset_probability")).scalar()
    return scored.withColumns({"is_chance": p.between(0, 1), "balanced": F.abs(mean - 0.5) < 0.1})
