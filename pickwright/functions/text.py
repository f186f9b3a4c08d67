"""Label and percent cleaning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result marks that follow a name, after a space or a no-break space (x00A0).
RESULT_MARKS = r"[\s\x{00A0}]\((W|L|tie|PPD)\)"
DROP_CHARS = r"[@\t\n\+\-\x{00A0}]"


def strip_marks(col: Column) -> Column:
    return F.regexp_replace(col, RESULT_MARKS, "")


def short_code(col: Column) -> Column:
    """Drop marks and signs, trim, keep three characters, drop a digit in third place."""
    three = F.substring(F.trim(F.regexp_replace(strip_marks(col), DROP_CHARS, "")), 1, 3)
    return F.regexp_replace(three, r"^(.{2})\d$", "$1")


def percent(col: Column) -> Column:
    """'12.5%' to 0.125; '--' is zero; text that is no number is null."""
    plain = F.when(F.trim(col) == "--", "0.0").otherwise(F.rtrim(F.trim(col), F.lit("%")))
    return plain.try_cast("double") / 100


def number_in(col: Column, pattern: str) -> Column:
    """First group of the pattern as a number, null when it does not match."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).try_cast("double")
