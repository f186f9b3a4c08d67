"""Group-wise building blocks that never put one whole group into one task.

A key may hold a third of all rows, so a plain ``Window.partitionBy(key)`` over
fact rows is not used in this library. The blocks below shrink the data first
(partial aggregation runs before every shuffle) and split what stays ordered
into bounded pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickwright.session import cut_lineage


def not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def add_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Put per-group aggregates on every row: aggregate, then join back.

    The statistics side has one row per group, so AQE can broadcast it or split
    the hot side of the join; rows with a null key get null statistics.
    """
    stats = df.where(not_null(keys)).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(keys), "left")


def _ordinal(df: DataFrame, col: str) -> Column:
    """A double that never decreases along the column's order; unequal values may share one."""
    kind = dict(df.dtypes)[col]
    if kind == "date":
        return F.unix_date(F.col(col)).cast("double")
    if kind.startswith("timestamp"):
        return F.col(col).cast("timestamp").cast("double")
    if kind == "string":
        # the first six bytes as a number, short strings padded with zero bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(col).cast("double")


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in the given (all) floating columns."""
    wanted = {c for c, t in df.dtypes if t in ("double", "float") and (cols is None or c in cols)}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in wanted}) if wanted else df


#: Cuts of one heavy group, a power of two.
CUTS = 1024
#: A heavy group's piece number stays below this.
CODES = 4 * CUTS


def heavy_cuts(df: DataFrame, group: Sequence[str], x: str, piece_rows: int) -> DataFrame | None:
    """Cut values of ``x`` for each group of more than ``piece_rows`` rows; None if there is no such group.

    A mergeable percentile sketch with a rank error of at most 1 / (16 CUTS) of the group finds them, so no
    group is gathered. They are checkpointed: all uses must see the same cuts, whatever the order of merging.
    There is at most one row per ``piece_rows`` rows of the input.
    """
    heavy = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > piece_rows).drop("_n")
    if heavy.isEmpty():
        return None
    shares = [i / CUTS for i in range(1, CUTS)]
    cuts = F.array_distinct(F.percentile_approx(x, shares, 16 * CUTS))
    found = df.select(*group, x).join(heavy, list(group), "left_semi").groupBy(*group).agg(cuts.alias("_cuts"))
    found = cut_lineage(found)
    # a small table, counted, is hinted: a join by shuffle would put a whole group into one task
    return F.broadcast(found) if found.limit(CUTS + 1).count() <= CUTS else found


def piece_of(x: Column) -> Column:
    """Piece of a value among ``_cuts``: even between two cuts, odd for a value that is itself a cut.

    An even piece holds at most 1 / CUTS of the group, beside the sketch's error; an odd one holds one value.
    Groups without cuts are piece 0. The number of cuts below the value is found by halving, in ten steps.
    """
    steps = F.array(*[F.lit(CUTS >> i) for i in range(1, CUTS.bit_length())])
    halve = lambda below, step: below + F.when(F.get("_cuts", below + step - 1) < x, step).otherwise(0)
    code = F.aggregate(steps, F.lit(0), halve, lambda below: below * 2 + F.coalesce(F.get("_cuts", below) == x, F.lit(False)).cast("int"))
    return F.when(F.col("_cuts").isNull(), 0).otherwise(code).cast("long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    bin_rows: int = 1_000_000,
) -> DataFrame:
    """One row per (keys, order value) with ``<m>``, ``<m>_upto`` and ``<m>_total``.

    Equal order values are merged first, so ties are free; null and NaN have no place. A group of up to
    ``bin_rows`` distinct values is one ordered piece. A larger one is cut by rank (:func:`heavy_cuts`), so
    outliers don't matter; sums run inside a piece and the pieces' own totals are carried over.
    The merged values are checkpointed, so the input is read once.
    """
    names = list(measures)
    df = nan_to_null(df, [order])
    cells = (
        df.where(not_null([*keys, order]))
        .groupBy(*keys, order)
        .agg(*[F.sum(measures[n]).alias(n) for n in names])
        .withColumn("_x", _ordinal(df, order))
    )
    if not keys:
        cells = cells.withColumn("_all", F.lit(0))
    cells = cut_lineage(cells)
    group = list(keys) or ["_all"]
    cuts = heavy_cuts(cells, group, "_x", bin_rows)
    if cuts is None:
        whole = Window.partitionBy(*group)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return cells.select(
            *keys, order, *names,
            *[F.sum(n).over(upto).alias(f"{n}_upto") for n in names],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
        )
    binned = cells.join(cuts, group, "left").withColumn("_bin", piece_of(F.col("_x"))).drop("_cuts")
    totals = binned.groupBy(*group, "_bin").agg(*[F.sum(n).alias(n) for n in names])
    line = Window.partitionBy(*group)
    earlier = line.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, "_bin",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_carry") for n in names],
        *[F.sum(n).over(line).alias(f"{n}_total") for n in names],
    )
    inside = Window.partitionBy(*group, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return binned.join(carried, [*group, "_bin"]).select(
        *keys,
        order,
        *names,
        *[(F.col(f"_{n}_carry") + F.sum(n).over(inside)).alias(f"{n}_upto") for n in names],
        *[f"{n}_total" for n in names],
    )


def cut_pieces(df: DataFrame, group: Sequence[str], order: Sequence[str], piece_rows: int) -> DataFrame:
    """Add ``_piece``, which never decreases along ``order`` inside a group.

    Groups of up to ``piece_rows`` rows are one piece. Larger ones are cut by rank of the first order column;
    a single value that still has more rows is cut by the next column, and so on.
    """
    out = df.withColumn("_piece", F.lit(0).cast("long"))
    for i, col in enumerate(order):
        x = out.withColumn("_x", _ordinal(out, col))
        # between two cuts several values of the column before are mixed, so only single ones are cut further
        single = x if i == 0 else x.where(F.col("_piece") % 2 == 1)
        cuts = heavy_cuts(single, [*group, "_piece"], "_x", piece_rows)
        if cuts is None:
            return out
        placed = x.join(cuts, [*group, "_piece"], "left").withColumn("_code", piece_of(F.col("_x")))
        out = placed.withColumn("_piece", F.col("_piece") * CODES + F.col("_code")).select(*df.columns, "_piece")
    return out


def neighbor(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str],
    chunk: Column,
    ahead: bool = False,
    piece_rows: int = 1_000_000,
) -> DataFrame:
    """Add ``{new: source}`` columns taken from the previous (or next) row.

    ``chunk`` must not decrease along ``order``; it cuts a group into chunks, and a chunk of more than
    ``piece_rows`` rows is cut further by rank (:func:`cut_pieces`). The lag runs per piece, and the first row
    of a piece takes the last row of the piece before it from a small edge table.
    """
    row = F.struct(*[F.col(s).alias(n) for n, s in cols.items()])
    rank = F.struct(*order)
    at = [*keys, "_chunk", "_piece"]

    def edges(tagged: DataFrame) -> DataFrame:
        return tagged.groupBy(*at).agg((F.min_by(row, rank) if ahead else F.max_by(row, rank)).alias("_edge"), F.count("*").alias("_n"))

    chunked = df.withColumn("_chunk", chunk)
    tagged = chunked.withColumn("_piece", F.lit(0).cast("long"))
    # the edge table is needed in any case, and its counts tell whether a chunk must be cut
    edge = cut_lineage(edges(tagged))
    if not edge.where(F.col("_n") > piece_rows).isEmpty():
        tagged = cut_pieces(chunked, [*keys, "_chunk"], order, piece_rows)
        edge = edges(tagged)
    piece = Window.partitionBy(*at).orderBy(*order)
    near = F.lead(row).over(piece) if ahead else F.lag(row).over(piece)
    line = Window.partitionBy(*keys).orderBy("_chunk", "_piece")
    beyond = F.lead("_edge").over(line) if ahead else F.lag("_edge").over(line)
    edge = edge.select(*at, beyond.alias("_beyond"))
    return (
        tagged.withColumn("_near", near)
        .join(edge, at, "left")
        .withColumn("_near", F.coalesce("_near", "_beyond"))
        .select(*df.columns, *[F.col(f"_near.{n}").alias(n) for n in cols])
    )


def day_chunk(col: str, days: int = 7) -> Column:
    return F.floor(F.unix_date(F.col(col)) / days)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """Keep one whole row per key, by order: an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def over_cells(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    outputs: Mapping[str, Column],
) -> DataFrame:
    """Window over (keys, order value) cells instead of rows, joined back to the rows.

    For orders with a small domain (days of a season, weeks): however many rows a
    group has, its window then holds one cell per day or week. ``outputs`` are window
    expressions over the measures, built on :func:`cell_order`.
    """
    cells = df.where(not_null([*keys, order])).groupBy(*keys, order).agg(*[c.alias(n) for n, c in measures.items()])
    done = cells.select(*keys, order, *[c.alias(n) for n, c in outputs.items()])
    return df.join(done, [*keys, order], "left")


def cell_order(keys: Sequence[str], order: Column | str):
    return Window.partitionBy(*keys).orderBy(order)


#: Rows that a task of a step with much work per row makes, about.
MADE_ROWS = 250_000


def tasks(df: DataFrame, work: int, made: int | None = None) -> int:
    """Tasks for a step that makes about ``work`` rows of each row of ``df``, ``made`` (else ``MADE_ROWS``) rows a task."""
    return max(1, -(-df.count() * work // (made or MADE_ROWS)))


def spread(df: DataFrame, *keys: str, work: int, made: int | None = None, in_order: bool = False) -> DataFrame:
    """Distribute rows by ``keys`` before a step that makes about ``work`` rows of each, ``made`` rows a task.

    AQE would size the partitions by the bytes before that step, so the rows are counted; the number of
    partitions follows what the step makes. ``keys`` should tell rows apart. ``in_order`` deals ranges of the
    keys: a task then holds few values of the first ones, and sums by them shrink before they are shuffled.
    """
    n = tasks(df, work, made)
    return df.repartitionByRange(n, *keys) if in_order else df.repartition(n, *keys)
