"""Rating arithmetic: decay, caps and blends."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwright import constants as K


def time_decay(day: Column, as_of: Column, rate: float = K.DECAY_RATE) -> Column:
    return F.exp(F.lit(-rate) * F.datediff(as_of, day))


def winsorize(x: Column, lo: float = K.OUTLIER_RANGE[0], hi: float = K.OUTLIER_RANGE[1]) -> Column:
    """Clamp; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def damped_cap(x: Column, limit: float = K.GAME_CAP) -> Column:
    """Beyond the limit only twice the logarithm of the excess counts."""
    over = F.abs(x) - limit
    return F.when(over > 0, F.signum(x) * (limit + 2 * F.log(over + 1))).otherwise(x)


def success_points(rate: Column) -> Column:
    return rate * 100 * K.SUCCESS_TO_POINTS


def blend(epa: Column, success: Column) -> Column:
    """Expected points and success rate in one number of points."""
    return epa * K.EPA_WEIGHT + success_points(success) * K.SUCCESS_WEIGHT


def power_rating(epa: Column, success: Column) -> Column:
    return blend(epa, success) * (1 - K.REGRESSION_RATE) * K.RATING_SCALE


def starter_adjustment(current: Column, historical: Column, volume: Column) -> Column:
    return (current - historical) * F.coalesce(volume, F.lit(K.DEFAULT_VOLUME)) / K.VOLUME_DIVISOR


@dataclass(frozen=True)
class AdjustmentParams:
    """Signs and sizes of the terms that turn a rating into a game-day rating."""

    travel_limit: float
    travel_away: float
    travel_home: float
    zone_away: float
    zone_home: float
    rest: float
    season_rest: float
    away_points: float


CURRENT = AdjustmentParams(-400, -0.125, 0.125, -0.1, 0.1, 0.125, 0.0625, 1.0)
PRESEASON = AdjustmentParams(-100, -0.125, -0.125, -0.25, -0.25, -1.0, -0.125, -1.0)


def adjusted_rating(
    rating: Column,
    away_travel_advantage: Column,
    at_home_venue: Column,
    zone_adv: Column,
    rest_adv: Column,
    season_rest_adv: Column,
    venue_points: Column,
    venues_differ: Column,
    is_home: bool,
    params: AdjustmentParams = CURRENT,
) -> Column:
    """``venue_points``: home advantage for the home side, away effect for the away side."""
    travel = params.travel_home if is_home else params.travel_away
    zone = params.zone_home if is_home else params.zone_away
    points = 1.0 if is_home else params.away_points
    return (
        rating
        + F.when((away_travel_advantage < params.travel_limit) & at_home_venue, travel).otherwise(0.0)
        + F.coalesce(zone_adv, F.lit(0)) * zone
        + F.coalesce(rest_adv, F.lit(0)) * params.rest
        + season_rest_adv * params.season_rest
        + F.when(venues_differ, venue_points * points).otherwise(0.0)
    )
