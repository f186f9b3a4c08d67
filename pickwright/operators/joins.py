"""Joins. No side is hinted for broadcast unless it is a fixed table of this library:
the optimizer and AQE broadcast by measured size and fall back to a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.operators.rows import to_team_long
from pickwright.session import cut_lineage
from pickwright.skew import add_group_stats, cut_pieces, nan_to_null, not_null


def _prefixed(dim: DataFrame, key: str, cols: Sequence[str], prefix: str, on: str) -> DataFrame:
    return dim.select(F.col(key).alias(on), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def lookup_sides(
    df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str], home: str, away: str, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Dimension columns for both sides; a missing entry takes the default."""
    out = df
    for side, prefix in ((home, "home_"), (away, "away_")):
        out = out.join(_prefixed(dim, key, cols, prefix, side), side, "left")
        filled = {f"{prefix}{c}": F.coalesce(f"{prefix}{c}", F.lit(v)) for c, v in (defaults or {}).items()}
        out = out.withColumns(filled) if filled else out
    return out.select(*df.columns, *[f"{p}{c}" for p in ("home_", "away_") for c in cols])


def join_two_roles(
    games: DataFrame, stats: DataFrame, season: str = "season", team: str = "team", home: str = "home_team", away: str = "away_team"
) -> DataFrame:
    """Wide team statistics of a season for the home and the away team."""
    measures = [c for c in stats.columns if c not in (season, team)]
    out = games
    for side, prefix in ((home, "home_"), (away, "away_")):
        role = stats.select(season, F.col(team).alias(side), *[F.col(c).alias(f"{prefix}{c}") for c in measures])
        out = out.join(role, [season, side], "left")
    return out.select(*games.columns, *[f"{p}{c}" for p in ("home_", "away_") for c in measures])


def enrich(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left")


def pair_sides(
    stats: DataFrame, game: str, team: str, own: Sequence[str], nets: Mapping[str, tuple[str, Column | None]]
) -> DataFrame:
    """Both directions of every game that has exactly two side rows.

    ``nets`` is {out: (column, shape)}: own minus other, optionally reshaped by a
    function of that difference; ``own`` columns are kept from the own side.
    One aggregation per game replaces the self join.
    """
    row = F.struct(team, *dict.fromkeys([*own, *[c for c, _ in nets.values()]]))
    pair = (
        stats.where(F.col(game).isNotNull())
        .groupBy(game)
        .agg(F.count("*").alias("_n"), F.min_by(row, F.col(team)).alias("_a"), F.max_by(row, F.col(team)).alias("_b"))
        .where((F.col("_n") == 2) & (F.col(f"_a.{team}") != F.col(f"_b.{team}")))
    )
    both = F.array(
        F.struct(F.col("_a").alias("me"), F.col("_b").alias("them")), F.struct(F.col("_b").alias("me"), F.col("_a").alias("them"))
    )
    sides = pair.select(game, F.explode(both).alias("_s"))
    out = []
    for name, (col, shape) in nets.items():
        diff = F.col(f"_s.me.{col}") - F.col(f"_s.them.{col}")
        out.append((shape(diff) if shape else diff).alias(name))
    return sides.select(
        game,
        F.col(f"_s.me.{team}").alias(team),
        F.col(f"_s.them.{team}").alias("opponent"),
        *[F.col(f"_s.me.{c}").alias(c) for c in own],
        *out,
    )


def opponent_value(df: DataFrame, keys: Sequence[str], team: str, opponent: str, col: str, one_per_game: bool = False) -> DataFrame:
    """The opponent's value of ``col`` on the same row; optionally one row per game."""
    mirror = df.select(*keys, F.col(team).alias(opponent), F.col(opponent).alias(team), F.col(col).alias(f"opponent_{col}"))
    out = df.join(mirror, [*keys, team, opponent], "left").select(*df.columns, f"opponent_{col}")
    return out.where(F.col(team) < F.col(opponent)) if one_per_game else out


def overlay(base: DataFrame, live: DataFrame, on: Sequence[str], cols: Sequence[str], keep_on_null: bool = False) -> DataFrame:
    """Matched base rows take the live values, nulls included unless ``keep_on_null``."""
    fresh = live.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_live_{c}") for c in cols])
    joined = base.join(fresh, list(on), "left")
    for c in cols:
        new = F.coalesce(f"_live_{c}", F.col(c)) if keep_on_null else F.when(F.col("_hit"), F.col(f"_live_{c}")).otherwise(F.col(c))
        joined = joined.withColumn(c, new)
    return joined.select(*base.columns)


def shift_weeks(df: DataFrame, cutoffs: DataFrame, year: str, day: str, week: str, out: str) -> DataFrame:
    """Contest week: schedule week plus the cutoff dates of the year that are not after the day.

    The cutoffs of a year travel as one short array, so this is an equi join on the year.
    """
    lists = cutoffs.groupBy(F.col("year").alias(year)).agg(F.collect_set("cutoff").alias("_cuts"))
    passed = F.size(F.filter(F.col("_cuts"), lambda c: c <= F.col(day)))
    return df.join(lists, year, "left").withColumn(
        out, F.col(week) + F.when(F.col("_cuts").isNull(), 0).otherwise(passed)
    ).select(*df.columns, out)


def calendar_cutoffs(spark: SparkSession) -> DataFrame:
    rows = [(y, d) for y, days in K.WEEK_CUTOFFS.items() for d in days]
    return spark.createDataFrame(rows, "year int, cutoff string").withColumn("cutoff", F.to_date("cutoff"))


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(float(s), f, u) for s, (f, u) in K.SPREAD_PRICES.items()]
    return spark.createDataFrame(rows, "spread_key double, favorite_price int, underdog_price int")


def nearest_join(
    df: DataFrame, table: DataFrame, x: str, key: str, cols: Sequence[str], keys: Sequence[str] = (), piece_rows: int = 1_000_000
) -> DataFrame:
    """Every row of ``df`` beside the ``table`` row whose ``key`` is nearest to ``x``, within equal ``keys``; the lower key on a tie.

    For key tables of any size: rows and keys are put in one order, each row takes the last key before and the first
    key after it, and the nearer one stays. The order is cut by rank into pieces of about ``piece_rows`` rows, and a
    piece takes the keys beyond its edges from a table with one row per piece, so no group is one task. Adds ``key`` and
    ``cols``, null where ``x`` is null or NaN, or there is no key. Of equal keys the least row is taken; null ones never.
    """
    k = list(keys)
    group = k or ["_all"]
    hit = F.struct(*[F.col(c) for c in (key, *cols)])
    # of rows with one key the least, so that every task sees the same one
    known = nan_to_null(table, [key]).where(not_null([*k, key])).groupBy(*k, F.col(key).cast("double").alias("_at")).agg(F.min(hit).alias("_hit"))
    # the search for cuts reads it several times
    known = cut_lineage(known)
    place = F.col(x).cast("double")
    asked = df.select(*k, F.when(~F.isnan(place), place).alias("_at"), F.struct(*df.columns).alias("_row"))
    no_row, no_hit = (F.lit(None).cast(t.schema[c].dataType) for t, c in ((asked, "_row"), (known, "_hit")))
    lines = known.withColumn("_row", no_row).unionByName(asked.where(not_null([*k, "_at"])).withColumn("_hit", no_hit))
    lines = lines.withColumns({"_all": F.lit(0), "_tie": F.xxhash64("_row")})
    placed = cut_lineage(cut_pieces(lines, group, ["_at", "_tie"], piece_rows))
    # rows of one place are peers, so a key at the row's own place counts for both sides; a frame that ends
    # at the row is extended row by row, so the next key is the last one in falling order
    own = F.when(F.col("_hit").isNotNull(), F.struct("_at", "_hit"))
    piece = Window.partitionBy(*group, "_piece")
    sofar = lambda order: F.last(own, ignorenulls=True).over(piece.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = sofar(F.asc("_at")), sofar(F.desc("_at"))
    edges = placed.groupBy(*group, "_piece").agg(F.max(own).alias("_high"), F.min(own).alias("_low"))
    others = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    beyond = edges.select(*group, "_piece", others("_high", F.asc("_piece")).alias("_under"), others("_low", F.desc("_piece")).alias("_over"))
    met = placed.withColumns({"_b": before, "_a": after}).where("_row is not null").join(beyond, [*group, "_piece"])
    met = met.withColumns({"_b": F.coalesce("_b", "_under"), "_a": F.coalesce("_a", "_over")})
    low = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("_at") - F.col("_b._at") <= F.col("_a._at") - F.col("_at")))
    found = met.select("_row", F.when(low, F.col("_b._hit")).otherwise(F.col("_a._hit")).alias("_hit"))
    rest = asked.where(~not_null([*k, "_at"])).select("_row", no_hit.alias("_hit"))
    return found.unionByName(rest).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], *[F.col(f"_hit.{c}").alias(c) for c in (key, *cols)])


def nearest_lookup(df: DataFrame, spread: str, home_price: str, away_price: str) -> DataFrame:
    """Fill two missing prices from the spread: nearest half point, favourite by the sign.

    The price table is a fixed 61-row table of this library, hence the broadcast.
    """
    key = F.least(F.bround(F.abs(F.col(spread)) * 2) / 2, F.lit(K.SPREAD_MAX))
    joined = df.withColumn("_k", key).join(
        F.broadcast(price_table(df.sparkSession)), F.col("_k") == F.col("spread_key"), "left"
    )
    known = F.col(home_price).isNotNull() & F.col(away_price).isNotNull()
    s, fav, dog = F.col(spread), F.col("favorite_price"), F.col("underdog_price")
    even = F.lit(K.PICKEM_PRICE)

    def side(col: str, ahead: Column, behind: Column) -> Column:
        made = F.when(s > 0, ahead).when(s < 0, behind).when(s == 0, even).otherwise(F.col(col))
        return F.when(known, F.col(col)).otherwise(made)

    return joined.withColumns(
        {"_h": side(home_price, fav, dog), "_a": side(away_price, dog, fav)}
    ).withColumns({home_price: F.col("_h"), away_price: F.col("_a")}).select(*df.columns)


def join_compare(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_own", "_other")) -> DataFrame:
    """Inner join; columns both sides have get a suffix."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(on), "inner")


def exclude(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def mark_members(df: DataFrame, members: DataFrame, keys: Sequence[str], out: str, condition: Column | None = None) -> DataFrame:
    """0/1 flag: the keys are in the set, and the condition (such as week <= holiday week) holds."""
    found = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    hit = F.coalesce(F.col("_in"), F.lit(False))
    if condition is not None:
        hit = hit & F.coalesce(condition, F.lit(False))
    return df.join(found, list(keys), "left").withColumn(out, hit.cast("int")).select(*df.columns, out)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def back_map(df: DataFrame, cond: Column, keys: Sequence[str], col: str, out: str, default: float = 0.0) -> DataFrame:
    """The value a group has where ``cond`` holds, on all rows of the group."""
    marked = add_group_stats(df, keys, {out: F.max(F.when(cond, F.col(col)))})
    return marked.withColumn(out, F.coalesce(out, F.lit(default))).select(*df.columns, out)


def holiday_strength(df: DataFrame, keys: Sequence[str], win: str, holidays: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Sum over holidays of (win % in the holiday week) x (flag: is a team of a later holiday week)."""
    aggs = {f"_{n}": F.max(F.when(cond, F.col(win))) for n, (cond, _) in holidays.items()}
    marked = add_group_stats(df, keys, aggs)
    total = F.lit(0.0)
    for n, (_, flag) in holidays.items():
        total = total + F.col(flag) * F.coalesce(f"_{n}", F.lit(0.0))
    return marked.withColumn("holiday_strength", total).select(*df.columns, "holiday_strength")


def attach_schedule(picks: DataFrame, games: DataFrame, keys: Sequence[str], home: str, away: str, winner: str, day: str) -> DataFrame:
    """Is the picked team away, did it win, and when: by (keys, team) against the schedule."""
    sides = to_team_long(games, [*keys, F.col(winner).alias("_winner"), F.col(day).alias("game_day")], {"team": (home, away)})
    known = sides.select(
        *keys, "team", "is_away", F.when(F.col("_winner").isNotNull(), F.col("_winner") == F.col("team")).alias("won"), "game_day"
    )
    return picks.join(known, [*keys, "team"], "left")


def attach_pick_pct(games: DataFrame, picks: DataFrame, keys: Sequence[str], home: str, away: str, pct: str) -> DataFrame:
    """Pick share of the home and the away team; ``picks`` has keys, team, is_away."""
    out = games
    for side, flag, name in ((home, False, f"home_{pct}"), (away, True, f"away_{pct}")):
        share = picks.where(F.col("is_away") == F.lit(flag)).select(*keys, F.col("team").alias(side), F.col(pct).alias(name))
        out = out.join(share, [*keys, side], "left")
    return out.select(*games.columns, f"home_{pct}", f"away_{pct}")
