"""Projections, filters and row-level logic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright import constants as K
from pickwright.functions import calendar, labels, text
from pickwright.skew import first_by


def project(df: DataFrame, mapping: Mapping[str, str], order: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename, drop what exists, and fix the column order; absent columns are left out."""
    out = df.withColumnsRenamed(dict(mapping)).drop(*drop)
    return out.select(*[c for c in order if c in out.columns])


def normalize_codes(df: DataFrame, col: str, alias_df: DataFrame | Mapping[str, str]) -> DataFrame:
    """Replace known aliases; an unknown code passes through.

    A mapping becomes a literal in the plan; a table (alias, code) is joined.
    """
    if isinstance(alias_df, Mapping):
        table = F.create_map(*[F.lit(v) for kv in alias_df.items() for v in kv])
        return df.withColumn(col, F.coalesce(table[F.col(col)], F.col(col)))
    alias = alias_df.select(F.col("alias").alias(col), F.col("code").alias("_code"))
    return df.join(alias, col, "left").withColumn(col, F.coalesce("_code", col)).drop("_code").select(*df.columns)


def clean_label(df: DataFrame, col: str, drop: Sequence[str] = ("BYE",)) -> DataFrame:
    out = df.withColumn(col, text.short_code(F.col(col)))
    return out.where(~F.col(col).isin(*drop)) if drop else out


def parse_percent(df: DataFrame, col: str, null_as_zero: bool = False) -> DataFrame:
    value = text.percent(F.col(col))
    return df.withColumn(col, F.coalesce(value, F.lit(0.0)) if null_as_zero else value)


def filter_events(
    df: DataFrame,
    prob: str | None = None,
    lo: float = K.WIN_PROB_RANGE[0],
    hi: float = K.WIN_PROB_RANGE[1],
    kind: str | None = None,
    kinds: Sequence[str] = (),
    not_null: Sequence[str] = (),
    day: str | None = None,
    start: Column | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Plain comparisons on columns only, so all of them reach the Parquet scan."""
    if prob is not None:
        df = df.where((F.col(prob) >= lo) & (F.col(prob) <= hi))
    if kind is not None:
        df = df.where(F.col(kind).isin(*kinds))
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    if start is not None:
        df = df.where(F.col(day) >= start)
    if as_of is not None:
        df = df.where(F.col(day) <= as_of)
    return df


def derive_result(
    df: DataFrame, home: str, away: str, home_score: str, away_score: str, spread: str, home_price: str | None = None
) -> DataFrame:
    """Winner, loser and their points, margin, spread winner, upset. Null scores give nulls."""
    h, a, hs, as_ = F.col(home), F.col(away), F.col(home_score), F.col(away_score)
    margin = hs - as_
    line = margin - F.col(spread)
    upset = ((F.col(spread) > 0) & (margin < 0)) | ((F.col(spread) < 0) & (margin > 0))
    return df.withColumns(
        {
            "winner": F.when(margin > 0, h).when(margin < 0, a).when(margin == 0, "Tie"),
            "loser": F.when(margin > 0, a).when(margin < 0, h).when(margin == 0, "Tie"),
            "winner_points": F.when(margin.isNotNull(), F.greatest(hs, as_)),
            "loser_points": F.when(margin.isNotNull(), F.least(hs, as_)),
            "margin": margin,
            "spread_winner": F.when(line > 0, h).when(line < 0, a).when(line == 0, "PUSH"),
            "upset": F.when(margin.isNotNull() & F.col(spread).isNotNull(), upset),
        }
    )


def dedupe(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Whole-row duplicates, or the first row per key in an explicit order."""
    return first_by(df, keys, order) if keys else df.dropDuplicates()


def fill(df: DataFrame, defaults: Mapping[str, float | str]) -> DataFrame:
    """Replace null, NaN and infinite values by a default per column."""
    kinds = dict(df.dtypes)
    fixed = {}
    for c, default in defaults.items():
        col = F.col(c)
        if kinds[c] in ("double", "float"):
            bad = F.isnan(col) | (F.abs(col) == float("inf"))
            col = F.when(~bad, col)
        fixed[c] = F.coalesce(col, F.lit(default))
    return df.withColumns(fixed)


def bucketize(df: DataFrame, col: str, bounds: Sequence[float], names: Sequence[str], out: str, inclusive: bool = True) -> DataFrame:
    return df.withColumn(out, labels.bucketize(F.col(col), bounds, names, inclusive))


def coalesce_sources(df: DataFrame, sources: Mapping[str, Column | str], out: str, tag: str) -> DataFrame:
    """First non-null source wins; ``tag`` says which one it was."""
    cols = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sources.items()}
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in cols.items()])
    return df.withColumns({out: F.coalesce(*cols.values()), tag: name})


def weather_cascade(games: DataFrame, hourly: DataFrame, monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dome, then hourly readings of 13-16 h, then the game's own values, then the month's.

    ``games`` has ``keys``, ``day``, ``dome``, ``row_temp``, ``row_wind``; ``hourly`` has
    ``keys``, ``ts``, ``temp``, ``wind``, ``precip``; ``monthly`` has ``keys``, ``month``,
    ``month_temp``, ``month_wind``. Hours 13 to 16 are averaged, rain is summed.
    """
    played = (
        hourly.where(F.hour("ts").between(13, 16))
        .groupBy(*keys, F.to_date("ts").alias("day"))
        .agg(F.avg("temp").alias("_t"), F.avg("wind").alias("_w"), F.sum("precip").alias("_p"), F.count("*").alias("_n"))
    )
    df = (
        games.withColumn("month", F.month("day"))
        .join(played, [*keys, "day"], "left")
        .join(monthly, [*keys, "month"], "left")
    )
    dome, hour, row = F.col("dome"), F.col("_n").isNotNull(), F.col("row_temp").isNotNull()
    base_t, base_w = F.coalesce("month_temp", F.lit(60.0)), F.coalesce("month_wind", F.lit(10.0))
    return df.select(
        *games.columns,
        F.when(dome, 70.0).when(hour, F.coalesce("_t", base_t)).when(row, F.col("row_temp")).otherwise(base_t).alias("temp"),
        F.when(dome, 0.0).when(hour, F.coalesce("_w", base_w)).when(row, F.coalesce("row_wind", base_w)).otherwise(base_w).alias("wind"),
        F.when(~dome & hour, F.coalesce("_p", F.lit(0.0))).otherwise(0.0).alias("precip"),
        F.when(dome, "dome").when(hour, "hourly").when(row, "row").otherwise("monthly").alias("weather_source"),
    )


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: Sequence[str], col: str, value: str = "override") -> DataFrame:
    """A user value wins when it is at least zero; missing or -1 keeps the model's."""
    ov = overrides.select(*keys, F.col(value).alias("_ov"))
    won = F.when(F.col("_ov") >= 0, F.col("_ov")).otherwise(F.col(col))
    return df.join(ov, list(keys), "left").withColumn(col, won).select(*df.columns)


def clean_availability(col: Column) -> Column:
    """Missing or the 'auto' mark means everybody can still pick the team."""
    return F.when(col > -0.01, col).otherwise(1.0)


def consensus(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """True when all columns agree."""
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (F.col(cols[0]) == F.col(c))
    return df.withColumn(out, same)


def all_positive(df: DataFrame, diffs: Sequence[Column], out: str) -> DataFrame:
    """Team-side consensus: every rating difference favours the team."""
    ok = F.lit(True)
    for d in diffs:
        ok = ok & (d > 0)
    return df.withColumn(out, ok)


def to_team_long(
    df: DataFrame, shared: Sequence[str | Column], side_map: Mapping[str, tuple[str, str]], differences: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """One game row becomes a home row and an away row, in a single scan.

    ``side_map`` is {name: (home column, away column)}: each row gets ``name`` for its own
    side and ``opp_<name>`` for the other. ``differences`` is {name: (a, b)}, computed after.
    """
    home = F.struct(
        F.lit(False).alias("is_away"),
        *[F.col(h).alias(n) for n, (h, _) in side_map.items()],
        *[F.col(a).alias(f"opp_{n}") for n, (_, a) in side_map.items()],
    )
    away = F.struct(
        F.lit(True).alias("is_away"),
        *[F.col(a).alias(n) for n, (_, a) in side_map.items()],
        *[F.col(h).alias(f"opp_{n}") for n, (h, _) in side_map.items()],
    )
    both = df.select(*shared, F.explode(F.array(home, away)).alias("_s"))
    out = both.select(*both.columns[:-1], "_s.*")
    return out.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in (differences or {}).items()})


def unpivot_picks(df: DataFrame, ids: Sequence[str], week_cols: Sequence[str], prefix: str = "week_") -> DataFrame:
    """Wide picks to (ids, week, pick); an empty pick is the elimination mark."""
    long = df.unpivot(list(ids), list(week_cols), "week", "pick")
    return long.select(
        *ids,
        F.regexp_replace("week", f"^{prefix}", "").cast("int").alias("week"),
        F.coalesce(F.nullif(F.trim(F.col("pick").cast("string")), F.lit("")), F.lit("ELIMINATED")).alias("pick"),
    )


def fan_out(df: DataFrame, predicates: Mapping[str, Column], out: str = "category") -> DataFrame:
    """One row per label that applies. All labels are tested in the same pass."""
    hits = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    return df.withColumn(out, F.explode(hits))


def play_categories(columns: Sequence[str]) -> dict[str, Column]:
    """The play categories; those on charting columns only when the columns exist."""
    c = F.col
    run, passed = c("play_type") == "run", c("play_type") == "pass"
    cats = {
        "Overall": run | passed,
        "Run": run,
        "Pass": passed,
        "Pass_Deep": passed & (c("air_yards") >= 20),
        "Pass_Intermediate": passed & c("air_yards").between(10, 19),
        "Pass_Short": passed & c("air_yards").between(0, 9),
        "Pass_BehindLoS": passed & (c("air_yards") < 0),
        "Redzone": c("yardline_100") <= 20,
        "3rd_Down": c("down") == 3,
        "1st_Down": c("down") == 1,
        "Scramble": run & (c("qb_scramble") == 1),
        "Target_WR": passed & (c("receiver_pos") == "WR"),
        "Target_TE": passed & (c("receiver_pos") == "TE"),
        "Target_RB": passed & (c("receiver_pos") == "RB"),
        "Quick_Game_Proxy": passed & (c("air_yards") < 5) & (c("qb_scramble") == 0) & (c("sack") == 0),
    }
    charted = {
        "is_blitz": {"Versus_Blitz": passed & (c("is_blitz") == 1), "No_Blitz": passed & (c("is_blitz") == 0)},
        "is_pressure": {"Under_Pressure": passed & (c("is_pressure") == 1), "Clean_Pocket": passed & (c("is_pressure") == 0)},
        "is_play_action": {"Play_Action": passed & (c("is_play_action") == 1)},
        "is_rpo": {"RPO": c("is_rpo") == 1},
        "is_slot": {"Target_Slot": passed & (c("is_slot") == 1)},
    }
    for flag, found in charted.items():
        if flag in columns:
            cats.update(found)
    return cats


def calendar_flags(df: DataFrame, day: str, away: str, win: str, holidays: Sequence[Column] = ()) -> DataFrame:
    """Thursday and its four crossings with side and favourite."""
    thu, is_away, fav = F.col("thursday") == 1, F.col(away), F.col(win) > 0.5
    return df.withColumn("thursday", calendar.is_thursday(F.col(day), list(holidays)).cast("int")).withColumns(
        {
            "thursday_home": (thu & ~is_away).cast("int"),
            "thursday_away": (thu & is_away).cast("int"),
            "thursday_favorite": (thu & fav).cast("int"),
            "thursday_underdog": (thu & ~fav).cast("int"),
        }
    )


def compare_sides(df: DataFrame, home: str, away: str, home_rating: str, away_rating: str, prefix: str = "") -> DataFrame:
    """Higher rating wins, equal is a tie; and how far apart they are."""
    h, a = F.col(home_rating), F.col(away_rating)
    return df.withColumns(
        {
            f"{prefix}winner": F.when(a > h, F.col(away)).when(a < h, F.col(home)).when(a == h, "Tie"),
            f"{prefix}difference": F.abs(a - h),
        }
    )


def average_sources(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumn(out, total / len(cols))


def mismatch_features(df: DataFrame, cats: Sequence[str] = K.MATCHUP_CATEGORIES, metric: str = "EPA_Pct") -> DataFrame:
    """Offence minus the other side's defence, per category whose columns exist."""
    made = {}
    for cat in cats:
        for side, other, name in (("home", "away", "HomeOff"), ("away", "home", "AwayOff")):
            off, dfn = f"{side}_Off_{cat}_{metric}", f"{other}_Def_{cat}_{metric}"
            if off in df.columns and dfn in df.columns:
                made[f"Matchup_{name}_{cat}"] = F.col(off) - F.col(dfn)
    return df.withColumns(made) if made else df


def expected_flow(df: DataFrame, pick: str, win: str, entries: str, picks_per_week: Column | None = None) -> DataFrame:
    """Expected picks, survivors, eliminations and survival rate of one side."""
    p, w, n = F.col(pick), F.col(win), F.col(entries)
    many = F.lit(1) if picks_per_week is None else picks_per_week
    factor = F.lit(1.0)
    for count, value in K.MULTI_PICK_SURVIVAL.items():
        factor = F.when(many == count, value).otherwise(factor)
    rate = w * p * factor
    return df.withColumns(
        {
            "expected_picks": p * n,
            "expected_survivors": p * w * n,
            "expected_eliminations": p * (1 - w) * n,
            "survival_rate": rate,
            "elimination_percent": p - rate,
        }
    )


def eligible(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reject_reasons`` (every rule that forbids the row) and ``eligible``."""
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return df.withColumn("reject_reasons", reasons).withColumn("eligible", F.size("reject_reasons") == 0)


def pick_rules(min_away_spread: float = 3.0, min_division_spread: float = 3.0) -> dict[str, Column]:
    """The reasons not to pick a row of the team-long table, one predicate each.

    ``margin`` is the points the team is favoured by. Callers drop the rules they do not want.
    """
    c = F.col
    away = c("is_away")
    return {
        "not_favored": c("margin") <= 0,
        "away_close": away & (c("margin") <= min_away_spread),
        "back_to_back_away": away & c("back_to_back"),
        "close_divisional": c("divisional") & (c("margin") <= min_division_spread),
        "away_divisional": c("divisional") & away,
        "short_rest": away & (c("rest") < 7) & (c("rest") < c("opp_rest")),
        "four_in_17": c("four_in_17"),
        "three_in_10": c("three_in_10"),
        "foreign_venue": c("foreign_venue"),
        "thursday": c("thursday") == 1,
        "away_thursday": away & (c("thursday") == 1),
        "weekly_rest": c("rest_adv") < 0,
        "season_rest": c("season_rest_adv") < F.when(away, -10).otherwise(-5),
        "travel": away & (c("travel_adv") < -850),
        "prohibited": c("prohibited"),
        "already_used": c("already_used"),
        "no_consensus": ~c("consensus"),
    }
