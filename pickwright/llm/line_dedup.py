"""Line dedup: three-line windows hashed, repeats found over all documents, later occurrences cut out.

DataFrame expressions only. A window is ``span`` consecutive lines (parts between
newlines) of one document, not all of them blank. Windows are told apart by two
64-bit hashes. Of equal windows the first by document id and line stays; the lines
of every later one are covered, and covered lines are removed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import row_key

SPAN = 3


def _lines(text: str):
    return F.split(F.col(text), "\n")


def windows(docs: DataFrame, doc_id: str, text: str, span: int) -> DataFrame:
    """(__id, __h, at, a, b): one row per window with its place and its two hashes."""
    lines = docs.where(F.col(text).isNotNull()).select(*row_key(doc_id, text), _lines(text).alias("lines"))
    lines = lines.where(F.size("lines") >= span)

    def hashed(i):
        part = [F.get(F.col("lines"), i + k) for k in range(span)]
        blank = F.length(F.trim(F.concat(*part))) == 0
        return F.struct(i.alias("at"), F.xxhash64(*part).alias("a"), F.xxhash64(F.lit(span), *part).alias("b"), blank.alias("blank"))

    one = lines.select("__id", "__h", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - span), hashed)))
    return one.where("not blank").drop("blank")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """All columns of ``docs`` with the text left over, and ``n_lines`` and ``n_removed``.

    Null text stays null with no lines; texts of fewer than ``span`` lines stay as
    they are. Rows with equal id and text are one document and get one result; a null
    id is a document of its own text and comes first. Existing columns called
    ``n_lines`` or ``n_removed`` are replaced. An empty table gives an empty result.
    """
    one = windows(docs, doc_id, text, span)
    order = F.struct(F.col("__id").isNotNull().alias("k"), F.col("__id").alias("i"), F.col("__h").alias("h"), F.col("at").alias("at"))
    first = one.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("a").alias("__a"), F.col("b").alias("__b"), "first")
    later = one.join(first, (one["a"] == first["__a"]) & (one["b"] == first["__b"])).where(~order.eqNullSafe(F.col("first")))
    cut = later.groupBy("__id", "__h").agg(F.collect_set("at").alias("__starts"))
    cut = cut.select(F.col("__id").alias("__cid"), F.col("__h").alias("__ch"), "__starts")
    # the lines travel in place of the text; joined with newlines they are the text
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    own = docs.select(*rest, *row_key(doc_id, text), _lines(text).alias("__lines"))
    joined = own.join(cut, own["__id"].eqNullSafe(cut["__cid"]) & (own["__h"] == cut["__ch"]), "left")
    # merge the covered positions: every start covers itself and the span - 1 lines after it
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + span - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered)
    left_over = F.transform(kept, lambda i: F.get(F.col("__lines"), i))
    made = {
        text: F.array_join(F.when(F.col("__starts").isNull(), F.col("__lines")).otherwise(left_over), "\n"),
        "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        "n_removed": F.when(F.col("__starts").isNull(), 0).otherwise(F.size(covered)).cast("long"),
    }
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in order])
