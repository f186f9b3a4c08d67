"""Scans: delimited files, season-bounded facts, stored pages, nested price feeds."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of one event of the price feed.
ODDS_SCHEMA = (
    "home_team string, away_team string, commence_time string, "
    "bookmakers array<struct<markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
)
STAR_PIXELS = 16


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Delimited scan with a declared schema; NaN and infinity come in as null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return clean_numbers(df)


def stacked_names(header: Sequence[str], index: int = 1) -> list[str]:
    """Column names of a stacked header: ``Side_Category_Metric`` from its lines, one per level.

    The first ``index`` cells of the lines name the levels, and those of the last line the index columns. A last line
    without any other cell holds index names only. Within a level a blank takes the label before it, and a blank
    at the start is left out.
    """
    lines = list(csv.reader(header))
    levels = [line[index:] for line in lines]
    names = [name or f"index_{i}" for i, name in enumerate(lines[-1][:index])]
    if len(levels) > 1 and not any(levels[-1]):
        levels.pop()
    filled = []
    for level in levels:
        label, row = "", []
        for cell in level:
            label = cell or label
            row.append(label)
        filled.append(row)
    return names + ["_".join(x for x in labels if x) for labels in zip(*filled, strict=True)]


def read_stacked(spark: SparkSession, path: str, header: int, index: int = 1, kind: str = "double") -> DataFrame:
    """Delimited scan of files that begin with ``header`` lines of column labels; NaN and infinity come in as null.

    The labels of the first file, in name order, are the declared schema: ``index`` text columns, all others of type
    ``kind``. Every file's own copy of these lines is left out. A cell holds no line break.
    """
    lines = spark.read.text(path)
    first = min(lines.inputFiles())
    top = [r[0] for r in spark.read.text(first, wholetext=False).limit(header).collect()]  # header lines only
    names = stacked_names(top, index)
    schema = T.StructType([T.StructField(n, T.StringType() if i < index else T._parse_datatype_string(kind)) for i, n in enumerate(names)])
    rows = lines.where(~F.col("value").isin(top) & (F.col("value") != ""))
    return clean_numbers(rows.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("_r")).select("_r.*"))


def clean_numbers(df: DataFrame) -> DataFrame:
    fixed = {}
    for c, t in df.dtypes:
        if t in ("double", "float"):
            fixed[c] = F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.withColumns(fixed) if fixed else df


def read_seasons(spark: SparkSession, path: str, seasons: Sequence[int], cols: Sequence[str], season: str = "season") -> DataFrame:
    """Only the asked seasons (partition pruning) and columns (a narrow read schema); NaN and infinity come in as null."""
    return clean_numbers(spark.read.parquet(path).where(F.col(season).isin(*seasons)).select(*cols))


def seasons_of_window(as_of_year: int, back: int) -> list[int]:
    return list(range(as_of_year - back, as_of_year + 1))


def extract_html_rows(
    pages: DataFrame,
    html: str = "html",
    row_tag: str = "tr",
    cell_tag: str = "td",
    min_cells: int = 5,
    n_cells: int = 5,
    star_pattern: str = r"width:\s*(\d+)px",
) -> DataFrame:
    """Rows of stored pages with the text of their first cells and a star value.

    The star is the pixel width in the last cell beyond the first ``n_cells``, over 16;
    rows with fewer than ``min_cells`` cells are skipped. All in column expressions.
    """
    rows = pages.withColumn("_row", F.explode(F.regexp_extract_all(html, F.lit(rf"(?is)<{row_tag}\b[^>]*>.*?</{row_tag}>"), F.lit(0))))
    cells = rows.withColumn("_cells", F.regexp_extract_all("_row", F.lit(rf"(?is)<{cell_tag}\b[^>]*>.*?</{cell_tag}>"), F.lit(0)))
    cells = cells.where(F.size("_cells") >= min_cells)
    last = F.when(F.size("_cells") > n_cells, F.element_at("_cells", -1))
    width = F.nullif(F.regexp_extract(last, star_pattern, 1), F.lit("")).cast("double")

    def text(i: int) -> Column:
        cell = F.when(F.size("_cells") > i, F.element_at("_cells", i + 1))
        return F.regexp_replace(cell, r"<[^>]*>", "")

    keep = [c for c in pages.columns if c != html]
    return cells.select(
        *keep, *[text(i).alias(f"cell_{i}") for i in range(n_cells)], F.coalesce(width / STAR_PIXELS, F.lit(0.0)).alias("stars")
    )


#: A page is cut before every tag that opens or closes a table, a row or a cell.
TABLE_TAG = r"(?i)(?=</?(?:table|tr|td|th)\b)"


def extract_table_rows(
    pages: DataFrame, html: str = "html", min_cells: int = 5, n_cells: int = 5, star_pattern: str = r"width:\s*(\d+)px"
) -> DataFrame:
    """Rows of all tables of stored pages with the text of their first cells and a star value.

    One pass over the page's tags with a stack of open tables, in column expressions. A nested table has rows of its own,
    and the cell around it goes on behind it; a cell or row that isn't closed ends where the next begins or its table
    ends; tags inside comments don't count. A row belongs to the table it stands in, or to the page outside of one.
    The star is the pixel width in the last cell beyond the first ``n_cells``, over 16; rows with fewer than
    ``min_cells`` cells are skipped. Null pages have no rows.
    """
    parts = F.split(F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", ""), TABLE_TAG)
    cells = "array<string>"
    table = f"struct<cells:{cells},open:boolean>"
    fresh = F.expr(f"cast(named_struct('cells', array(), 'open', false) as {table})")
    start = F.struct(F.array(fresh).alias("stack"), F.expr(f"cast(array() as array<{cells}>)").alias("rows"))

    def step(acc: Column, part: Column) -> Column:
        tag = F.lower(F.regexp_extract(part, r"^<(/?[A-Za-z]+)", 1))
        stack, rows = acc["stack"], acc["rows"]
        top = F.element_at(stack, -1)
        below = F.slice(stack, 1, F.size(stack) - 1)
        nested = F.size(stack) > 1
        # what is left of the part when its own tag is gone
        rest = F.regexp_replace(part, r"^<[^>]*>?", "")
        held = lambda cs, is_open: F.struct(cs.alias("cells"), is_open.alias("open"))
        none, no = F.expr(f"cast(array() as {cells})"), F.lit(False)
        ended = F.when(F.size(top["cells"]) > 0, F.concat(rows, F.array(top["cells"]))).otherwise(rows)

        def outer(s: Column) -> Column:
            """Behind a nested table the text goes on in the cell around it, if that is open."""
            up = F.element_at(s, -1)
            more = F.concat(F.slice(up["cells"], 1, F.size(up["cells"]) - 1), F.array(F.concat(F.element_at(up["cells"], -1), rest)))
            return F.when(up["open"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(held(more, F.lit(True))))).otherwise(s)

        new_stack = (
            F.when(tag == "table", F.concat(stack, F.array(fresh)))
            .when((tag == "/table") & nested, outer(below))
            .when(tag.isin("tr", "/tr"), F.concat(below, F.array(held(none, no))))
            .when(tag.isin("td", "th"), F.concat(below, F.array(held(F.concat(top["cells"], F.array(rest)), F.lit(True)))))
            .when(tag.isin("/td", "/th"), F.concat(below, F.array(held(top["cells"], no))))
            .otherwise(stack)
        )
        new_rows = F.when(tag.isin("tr", "/tr") | ((tag == "/table") & nested), ended).otherwise(rows)
        return F.struct(new_stack.alias("stack"), new_rows.alias("rows"))

    def finish(acc: Column) -> Column:
        """Rows of tables that are still open at the end of the page."""
        left = F.filter(F.transform(acc["stack"], lambda t: t["cells"]), lambda c: F.size(c) > 0)
        return F.concat(acc["rows"], left)

    keep = [c for c in pages.columns if c != html]
    found = pages.where(F.col(html).isNotNull()).select(*keep, F.explode(F.aggregate(parts, start, step, finish)).alias("_cells")).where(F.size("_cells") >= min_cells)
    last = F.when(F.size("_cells") > n_cells, F.element_at("_cells", -1))
    width = F.nullif(F.regexp_extract(last, star_pattern, 1), F.lit("")).cast("double")
    text = lambda i: F.regexp_replace(F.when(F.size("_cells") > i, F.element_at("_cells", i + 1)), r"<[^>]*>", "")
    return found.select(*keep, *[text(i).alias(f"cell_{i}") for i in range(n_cells)], F.coalesce(width / STAR_PIXELS, F.lit(0.0)).alias("stars"))


def flatten_odds(df: DataFrame, json_col: str, schema: T.StructType | str = ODDS_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """Mean price (h2h) and point (spreads) per event and side over all bookmakers."""
    ev = df.select(*keep, F.from_json(json_col, schema).alias("e")).where(F.col("e").isNotNull())
    books = ev.select(*keep, "e.home_team", "e.away_team", "e.commence_time", F.explode("e.bookmakers").alias("b"))
    markets = books.select(*keep, "home_team", "away_team", "commence_time", F.explode("b.markets").alias("m"))
    outs = markets.select(*keep, "home_team", "away_team", "commence_time", "m.key", F.explode("m.outcomes").alias("o"))

    def side_mean(market: str, team: str, field: str) -> Column:
        return F.avg(F.when((F.col("key") == market) & (F.col("o.name") == F.col(team)), F.col(f"o.{field}")))

    return outs.groupBy(*keep, "home_team", "away_team", "commence_time").agg(
        side_mean("h2h", "home_team", "price").alias("home_price"),
        side_mean("h2h", "away_team", "price").alias("away_price"),
        side_mean("spreads", "home_team", "point").alias("home_spread"),
        side_mean("spreads", "away_team", "point").alias("away_spread"),
    )
