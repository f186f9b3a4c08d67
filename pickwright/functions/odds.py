"""Price conversions and what follows from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwright.constants import PICKEM_PRICE


def implied_probability(price: Column) -> Column:
    """American price to probability, 4 places, null for null."""
    p = F.when(price > 0, 100 / (price + 100)).otherwise(F.abs(price) / (F.abs(price) + 100))
    return F.bround(p.cast("double"), 4)


def american_to_decimal(price: Column) -> Column:
    d = F.when(price > 0, price / 100 + 1).otherwise(100 / F.abs(price) + 1)
    return F.bround(d.cast("double"), 2)


def decimal_to_american(price: Column) -> Column:
    a = F.when(price >= 2, (price - 1) * 100).when(price != 1, -100 / (price - 1))
    return F.bround(a).cast("int")


def fair_probability(own: Column, other: Column) -> Column:
    """Share of the two raw probabilities; takes the margin out."""
    return F.bround(F.when((own + other) != 0, own / (own + other)), 4)


def win_advantage(fair: Column) -> Column:
    return F.bround(fair - 0.5, 4)


def favorite(home_price: Column, home: Column, away: Column) -> Column:
    """Home when its price is at most the pick'em price, else away; null price gives null."""
    return F.when(home_price.isNotNull(), F.when(home_price <= PICKEM_PRICE, home).otherwise(away))
