"""Wide spreadsheet cells to long facts, with every cell accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import parse_money
from tallyspark.functions.text import classified, fiscal_year_of, normalised


def column_plan(headers: DataFrame) -> DataFrame:
    """workbook, col_idx, kind, detail, fiscal_year of every header."""
    return classified(headers).drop("header")


def unpivot(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per classified money cell of a line-item row: its identity, stage and outcome (row, blank, failure).

    Rows without a code are totals and are left out; estimates and unknown stages are skipped as columns.
    """
    known = cells.join(plan, ["workbook", "col_idx"])
    first = F.min(F.struct("col_idx", "text"))["text"]
    ident = known.where("kind = 'identity'").groupBy("workbook", "row_idx", "detail").agg(first.alias("text")).groupBy("workbook", "row_idx").pivot("detail", ["agency", "line_item_code", "line_item_name"]).agg(F.first("text"))
    money = known.where("kind in ('appropriation', 'actual')").join(ident.where("trim(line_item_code) <> ''"), ["workbook", "row_idx"])
    parsed = parse_money(F.col("text"))
    blank = F.trim("text").isin("", "-")
    return money.select(
        "workbook", "row_idx", "agency", F.trim("line_item_code").alias("code"), "line_item_name", "kind", F.col("detail").alias("stage"), "fiscal_year",
        F.when(blank, "blank").when(parsed["error"].isNotNull(), "failure").otherwise("row").alias("outcome"), F.when(~blank, parsed["cents"]).alias("amount_cents"),
    )


def accounting(facts: DataFrame) -> DataFrame:
    """Cells by outcome; their sum is the number of classified cells of line-item rows."""
    return facts.groupBy("workbook").agg(
        F.count_if((F.col("kind") == "appropriation") & (F.col("outcome") == "row")).alias("appropriations"), F.count_if((F.col("kind") == "actual") & (F.col("outcome") == "row")).alias("actuals"),
        F.count_if(F.col("outcome") == "blank").alias("blanks"), F.count_if(F.col("outcome") == "failure").alias("failures"), F.count("*").alias("cells"),
    )


# Headings of a single-stage table; the first column with one of them counts.
SINGLE_STAGE = {
    "agency": ["agency code", "agency", "agy"],
    "code": ["ali", "line item code", "ali code", "code"],
    "name": ["line item name", "line item", "ali name", "title", "name"],
    "fund_group": ["fund group", "group"],
    "fund": ["fund", "fund code"],
}
NEEDED = ("agency", "code", "name")


def map_columns(headers: DataFrame) -> DataFrame:
    """One row a table (headers: doc, col_idx, header): column of each identity, fiscal years as (col_idx, fiscal_year), refused (the first thing missing, or null)."""
    plain = normalised(F.col("header"))
    first = [F.min(F.when(plain.isin(*names), F.col("col_idx"))).alias(f"{k}_at") for k, names in SINGLE_STAGE.items()]
    year = fiscal_year_of(F.col("header"))
    rows = headers.groupBy("doc").agg(*first, F.array_sort(F.collect_list(F.when(year.isNotNull(), F.struct("col_idx", year.alias("fiscal_year"))))).alias("years"))
    refused = F.coalesce(*[F.when(F.col(f"{k}_at").isNull(), F.lit(f"no_{k}")) for k in NEEDED], F.when(F.size("years") == 0, F.lit("no_fiscal_year")))
    return rows.withColumn("refused", refused)


def single_stage(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every fiscal-year cell of every row (rows: doc, row_idx, cells) of the tables that are not refused, as row, blank or unparsed.

    doc, row_idx, agency, code, name, fund_group and fund ([open] without a column), fiscal_year, outcome, amount_cents, raw (what does not parse), reason.
    """
    at = lambda c: F.trim(F.get("cells", F.col(c)))
    open_ = lambda c: F.when(F.col(f"{c}_at").isNull(), "[open]").otherwise(F.get("cells", F.col(f"{c}_at")))
    cells = rows.join(columns.where("refused IS NULL"), "doc").select("*", F.explode("years").alias("y")).withColumn("raw", at("y.col_idx"))
    # A column of its own, so that a cell is parsed once.
    cells = cells.withColumn("parsed", parse_money(F.col("raw")))
    parsed = F.col("parsed")
    blank = F.coalesce("raw", F.lit("")).isin("", "-")
    outcome = F.when(blank, "blank").when(parsed["error"].isNotNull(), "unparsed").otherwise("row")
    named = lambda c: F.get("cells", F.col(f"{c}_at")).alias(c)
    return cells.select(
        "doc", "row_idx", named("agency"), named("code"), named("name"), open_("fund_group").alias("fund_group"), open_("fund").alias("fund"), F.col("y.fiscal_year").alias("fiscal_year"), outcome.alias("outcome"),
        F.when(outcome == "row", parsed["cents"]).alias("amount_cents"), F.when(outcome == "unparsed", F.col("raw")).alias("raw"), F.when(outcome == "unparsed", parsed["error"]).alias("reason"),
    )


def stage_coverage(outcomes: DataFrame) -> DataFrame:
    """Cells of each table by outcome; they add up to its rows times its fiscal years."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.groupBy("doc").agg(n("row").alias("rows"), n("blank").alias("blanks"), n("unparsed").alias("unparsed"), F.count("*").alias("cells"))


def listed_only(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """``rows`` whose agency and code are on the list (agency, code); the list is a fixed dimension."""
    return rows.join(allowed.select("agency", "code").distinct(), ["agency", "code"], "left_semi")
