"""Bucket labels, ratios and arg-max labels."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketize(x: Column, bounds: Sequence[float], labels: Sequence[str], inclusive: bool = True) -> Column:
    """First label whose upper bound holds ``x``; the last label is for the rest."""
    out = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels))):
        out = F.when(x <= bound if inclusive else x < bound, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def game_context(diff: Column, margin: int = 8) -> Column:
    return F.when(diff > margin, "leading").when(diff < -margin, "trailing").when(diff.isNotNull(), "neutral")


def safe_ratio(num: Column, den: Column) -> Column:
    """Zero where the ratio is null or not finite."""
    return F.coalesce(F.when(den != 0, num / den), F.lit(0.0))


def arg_max(values: Mapping[str, Column]) -> Column:
    """Struct(value, name) of the largest value; the first name wins a tie, nulls lose."""
    cells = [
        F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(-i).alias("place"), F.lit(n).alias("name")))
        for i, (n, c) in enumerate(values.items())
    ]
    return F.array_max(F.array_compact(F.array(*cells)))


def one_decimal(x: Column) -> Column:
    """``%.1f`` as C prints it: the double's exact value is rounded, an exact tie to the even digit.

    ``format_string`` rounds the shortest decimal text half up: 89.25 becomes 89.3, and 0.15, a little below its text, 0.2.
    """
    a = F.abs(x)
    low = F.floor(a * 10)
    # 20 a = four + rest, without error, against the odd number halfway to the next tenth
    four = a * 16 + a * 4
    rest = a * 4 - (four - a * 16)
    past = (four - (2 * low + 1)) + rest
    tenths = low + F.when(past > 0, 1).when(past == 0, low % 2).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), ((tenths - tenths % 10) / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    # beyond, tenths are not whole numbers of a double; NaN and infinity go the same way
    return F.when(a < 1e14, text).otherwise(F.format_string("%.1f", x))


def edge_label(spread: Column, home_edges: Mapping[str, Column], away_edges: Mapping[str, Column], limit: float = 30) -> Column:
    """Name the underdog's best matchup when it is large enough."""

    def text(best: Column) -> Column:
        named = F.concat(F.lit("Underdog Edge: "), best["name"], F.lit(" (+"), one_decimal(best["value"]), F.lit(")"))
        return F.when(best["value"] > limit, named).otherwise(F.lit("No Glaring Mismatch"))

    return (
        F.when(spread.isNull(), "Unknown")
        .when(spread > 0, text(arg_max(away_edges)))
        .when(spread < 0, text(arg_max(home_edges)))
        .otherwise("Pick'em")
    )
