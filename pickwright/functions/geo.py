"""Distance and time-zone expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwright.constants import EARTH_MILES


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.bround(2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_MILES)


def zone_hours(ts: Column, zone_a: Column, zone_b: Column) -> Column:
    """Hours zone_a is ahead of zone_b at the moment ``ts`` (UTC)."""
    a = F.unix_timestamp(F.from_utc_timestamp(ts, zone_a))
    b = F.unix_timestamp(F.from_utc_timestamp(ts, zone_b))
    return (a - b) / 3600


def adjusted_zone_change(change: Column, previous_zone: Column, zone: Column, venue: Column, own_venue: Column) -> Column:
    """No change for a team already in the zone, unless it plays at home."""
    stays = F.coalesce(previous_zone == zone, F.lit(False)) & (venue != own_venue)
    return F.when(stays, 0.0).otherwise(change)


def zone_advantage(own: Column, other: Column) -> Column:
    return F.when(own == 0, 0.0).otherwise(own - other)
