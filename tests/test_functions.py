"""Column functions against hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pickwright.functions import calendar, geo, labels, odds, rating, text


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("price,p,d", [(-150, 0.6, 1.67), (130, 0.4348, 2.3), (None, None, None)])
def test_price_to_probability(spark, price, p, d):
    c = F.lit(price).cast("int")
    assert one(spark, odds.implied_probability(c)) == p
    assert one(spark, odds.american_to_decimal(c)) == d


def test_fair_odds(spark):
    own, other = F.lit(0.6), F.lit(0.4348)
    assert one(spark, odds.fair_probability(own, other)) == 0.5798
    assert one(spark, odds.fair_probability(other, own)) == 0.4202
    assert one(spark, odds.fair_probability(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, odds.fair_probability(F.lit(None).cast("double"), other)) is None


@pytest.mark.parametrize("decimal,price", [(2.5, 150), (1.5, -200), (1.0, None)])
def test_decimal_to_american(spark, decimal, price):
    assert one(spark, odds.decimal_to_american(F.lit(decimal))) == price


def test_favorite_rule(spark):
    pick = lambda p: one(spark, odds.favorite(F.lit(p).cast("int"), F.lit("H"), F.lit("A")))
    assert [pick(-110), pick(-105), pick(None)] == ["H", "A", None]


def test_caps_and_decay(spark):
    assert one(spark, rating.damped_cap(F.lit(30.0))) == pytest.approx(25.8045, abs=1e-4)
    assert one(spark, rating.damped_cap(F.lit(-30.0))) == pytest.approx(-25.8045, abs=1e-4)
    assert one(spark, rating.damped_cap(F.lit(-10.0))) == -10
    assert [one(spark, rating.winsorize(F.lit(v).cast("double"))) for v in (7.2, -9.0, 1.0, None)] == [4.875, -4.875, 1.0, None]
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, rating.time_decay(day("2025-01-01"), day("2025-04-11"))) == pytest.approx(0.62189, abs=1e-5)


def test_thanksgiving_and_season(spark):
    assert one(spark, calendar.thanksgiving(F.lit(2025))) == dt.date(2025, 11, 27)
    assert one(spark, calendar.thanksgiving(F.lit(2024))) == dt.date(2024, 11, 28)
    assert one(spark, calendar.season_of(F.lit("2025-02-09").cast("date"))) == 2024
    assert one(spark, calendar.season_of(F.lit("2025-05-01").cast("date"))) == 2025
    assert one(spark, calendar.season_of(F.lit("2025-05-01").cast("date"), 6)) == 2024


def test_thursday_is_not_a_holiday(spark):
    thu = F.lit("2025-11-27").cast("date")
    assert one(spark, calendar.is_thursday(thu))
    assert not one(spark, calendar.is_thursday(thu, [calendar.thanksgiving(F.lit(2025))]))


def test_zone_hours_follow_the_game_date(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    east, phoenix = F.lit("America/New_York"), F.lit("America/Phoenix")
    assert one(spark, geo.zone_hours(at("2025-09-14 18:00:00"), east, phoenix)) == 3
    assert one(spark, geo.zone_hours(at("2025-12-14 18:00:00"), east, phoenix)) == 2


def test_clock_label(spark):
    assert one(spark, calendar.clock_label(F.lit("2025-09-14 17:00:00").cast("timestamp"))) == "01:00 pm"


@pytest.mark.parametrize(
    "raw,want", [("DAL (W)", "DAL"), ("NYG (tie)", "NYG"), ("@\n KC+3", "KC"), ("KC7", "KC"), ("BUF-7", "BUF"), ("LA (PPD)", "LA")]
)
def test_short_code(spark, raw, want):
    assert one(spark, text.short_code(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("78.0%", 0.78), ("--", 0.0), ("x", None), (None, None), (" 15.3% ", 0.153)])
def test_percent(spark, raw, want):
    assert one(spark, text.percent(F.lit(raw).cast("string"))) == (want if want is None else pytest.approx(want))


def test_edge_labels(spark):
    home, away = {"Run": F.lit(31.26)}, {"Run": F.lit(12.0), "Pass": F.lit(None).cast("double")}
    label = lambda s: one(spark, labels.edge_label(F.lit(s).cast("double"), home, away))
    assert label(-3.0) == "Underdog Edge: Run (+31.3)"
    assert label(3.0) == "No Glaring Mismatch"
    assert label(0.0) == "Pick'em"
    assert label(None) == "Unknown"


def test_buckets(spark):
    b = lambda v: one(spark, labels.bucketize(F.lit(v).cast("double"), [3, 7], ["short", "med", "long"]))
    assert [b(3.0), b(7.0), b(7.5), b(None)] == ["short", "med", "long", None]


def test_distance(spark):
    # New York to Los Angeles
    miles = one(spark, geo.great_circle_miles(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437)))
    assert 2430 <= miles <= 2450


def test_adjustment_sets_differ(spark):
    args = (F.lit(3.0), F.lit(-500.0), F.lit(True), F.lit(2.0), F.lit(4.0), F.lit(8.0), F.lit(1.5), F.lit(True))
    assert one(spark, rating.adjusted_rating(*args, True)) == pytest.approx(3 + 0.125 + 0.2 + 0.5 + 0.5 + 1.5)
    assert one(spark, rating.adjusted_rating(*args, False)) == pytest.approx(3 - 0.125 - 0.2 + 0.5 + 0.5 + 1.5)
    assert one(spark, rating.adjusted_rating(*args, True, rating.PRESEASON)) == pytest.approx(3 - 0.125 - 0.5 - 4 - 1 + 1.5)
    assert one(spark, rating.adjusted_rating(*args, False, rating.PRESEASON)) == pytest.approx(3 - 0.125 - 0.5 - 4 - 1 - 1.5)


def test_one_decimal_is_that_of_c(spark):
    values = [89.25, 89.35, 0.15, 0.25, 0.35, 30.05, 99.95, 31.0, 0.04, -0.04, -89.25, 45.45, 1e13 + 0.25, 1e15, float("inf")]
    values += [i * 7919 % 100003 / 1000 for i in range(0, 400)] + [k / 20 for k in range(1, 400, 2)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", labels.one_decimal(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == ["Infinity" if v == float("inf") else f"{v:.1f}" for v in values]
