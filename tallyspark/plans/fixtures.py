"""Texts and records that the driver's tables do not hold, made from their rows; the same expressions feed both engines.

``Drawn`` writes one text a row of a given table: the row's key picks a shape, its numbers go into it. ``Copied`` writes a small record
set for every row of a given table, with the row's key in its names and without those records that the row's numbers leave out, so that no two copies
need be alike. ``Rows`` are fixed dimensions of a few rows, which only stand beside the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SQL = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
#: In a text: three digits of a row's number, five of its key.
NUMBER, KEY = "#", "@"


def _cell(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


class Rows:
    """A named inline table: ``schema`` is Spark DDL of simple columns."""

    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [tuple(c.split()) for c in schema.split(",")]

    def frame(self, spark, sf_dir: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A DuckDB common table expression with the same rows."""
        values = ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {', '.join(f'CAST({c} AS {_SQL[t]}) AS {c}' for c, t in self.columns)} FROM (VALUES {values}) AS v({', '.join(c for c, _ in self.columns)}))"


class Drawn(Rows):
    """One row for each order: ``id`` is its key, the other columns have the shape that the key picks, with the order's number in place of NUMBER."""

    base, key, number = "orders", "o_orderkey", "o_custkey + CAST(floor(o_totalprice) AS BIGINT)"

    def frame(self, spark, sf_dir: str | None = None) -> DataFrame:
        digits = F.lpad(F.expr(f"CAST(({self.number}) % 1000 AS STRING)"), 3, "0")

        def shape(k: int, kind: str) -> Column:
            cases = F.element_at(F.array(*[F.lit(r[k]).cast(kind) for r in self.rows]), F.expr(f"CAST({self.key} % {len(self.rows)} AS INT) + 1"))
            return F.replace(cases, F.lit(NUMBER), digits) if kind == "string" else cases

        own = [F.col(self.key).cast(t).alias(c) if c == "id" else shape(k, t).alias(c) for k, (c, t) in enumerate(self.columns)]
        return spark.read.parquet(f"{sf_dir}/{self.base}.parquet").select(*own)

    def sql(self) -> str:
        def shape(k: int, kind: str) -> str:
            cases = f"[{', '.join(f'CAST({_cell(r[k])} AS {_SQL[kind]})' for r in self.rows)}][CAST({self.key} % {len(self.rows)} AS INTEGER) + 1]"
            return f"replace({cases}, '{NUMBER}', lpad(CAST(({self.number}) % 1000 AS VARCHAR), 3, '0'))" if kind == "string" else cases

        own = [f"CAST({self.key} AS {_SQL[t]}) AS {c}" if c == "id" else f"{shape(k, t)} AS {c}" for k, (c, t) in enumerate(self.columns)]
        return f"{self.name} AS (SELECT {', '.join(own)} FROM {self.base})"


class Copied(Rows):
    """A copy for each supplier: the supplier's key in place of KEY, ``spaced`` columns moved a thousand on from copy to copy; the n-th record is left out of every sixth copy, by its balance."""

    base, key, number = "supplier", "s_suppkey", "CAST(floor(abs(s_acctbal)) AS BIGINT)"

    def __init__(self, name: str, schema: str, rows: list[tuple], spaced: tuple[str, ...] = (), whole: bool = False) -> None:
        super().__init__(name, schema, rows)
        self.spaced, self.keep = spaced, "true" if whole else f"({self.number} + {self.key} * 7 + n * 13) % 6 <> 0"

    def frame(self, spark, sf_dir: str | None = None) -> DataFrame:
        records = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, self.columns, strict=True)]) for n, r in enumerate(self.rows)])
        rows = spark.read.parquet(f"{sf_dir}/{self.base}.parquet").withColumn("_r", F.explode(records)).withColumn("n", F.col("_r.n")).where(self.keep)
        key = F.lpad(F.expr(f"CAST({self.key} % 100000 AS STRING)"), 5, "0")
        own = lambda c, t: F.replace(F.col(f"_r.{c}"), F.lit(KEY), key) if t == "string" else (F.col(f"_r.{c}") + F.col(self.key) * 1000).cast(t) if c in self.spaced else F.col(f"_r.{c}")
        return rows.select(*[own(c, t).alias(c) for c, t in self.columns])

    def sql(self) -> str:
        values = ", ".join("(" + ", ".join([str(n), *map(_cell, r)]) + ")" for n, r in enumerate(self.rows))
        own = lambda c, t: f"replace(CAST(v.{c} AS VARCHAR), '{KEY}', lpad(CAST({self.key} % 100000 AS VARCHAR), 5, '0'))" if t == "string" else f"CAST(v.{c} + {self.key} * 1000 AS {_SQL[t]})" if c in self.spaced else f"CAST(v.{c} AS {_SQL[t]})"
        return f"{self.name} AS (SELECT {', '.join(f'{own(c, t)} AS {c}' for c, t in self.columns)} FROM {self.base}, (VALUES {values}) AS v(n, {', '.join(c for c, _ in self.columns)}) WHERE {self.keep})"


MONEY = Drawn("money", "id int, text string", list(enumerate([
    "$1,#.56", "(1,#.56)", "-1#.5", "--#", "", "  ", "$", ".", ".5", "#.", "1.#", "n/a", "(#", "12345678901234567890.00", "0", "-", "92233720368547758.07", "92233720368547758.08", "$ 1 #.10", "1_#", "(0.01)", "about eight billion", None,
])))
STRICT = Drawn("strict", "id int, text string", list(enumerate(["1,#.56", "$#.00", "#", "#.0", ".50", "-#.25", "(3.10)", "abc", "", None])))
PATHS = Drawn("paths", "id int, base string, target string", [(i, *t) for i, t in enumerate([
    ("line-item/a#.yml", "../agency/b#.yml"), ("line-item/a.yml", "./c.yml"), ("x/y/z.yml", "../../q.md"), ("a.yml", "../../up.yml"), ("d/e.yml", "fund.ont.yml"), ("d/e.yml", "../catalog/src.md"), ("d/e.yml", "f/./g/../h#.yml"),
])])
HEADERS = Copied("headers", "workbook string, col_idx int, header string", [
    ("w1/@", 0, "Agency"), ("w1/@", 1, "Fund Group"), ("w1/@", 2, "Fund"), ("w1/@", 3, "ALI"), ("w1/@", 4, "ALITitle"), ("w1/@", 5, "FY 2033"), ("w1/@", 6, "Actual\r\nFY 2031"), ("w1/@", 7, "Budget Estimate\r\nFY 2033"),
    ("w1/@", 8, "Introduced\r\nFY 2034"), ("w1/@", 9, "House Passed\r\nFY 2034"), ("w1/@", 10, "$ Change\r\nFY 2031"), ("w2/@", 0, "CAS"), ("w2/@", 1, "ALI"), ("w2/@", 2, "Title"), ("w2/@", 3, "House Substitute\r\n(draft 7 b)\r\nFY 2032"),
    ("w2/@", 4, "As Enacted after Governor's Vetoes\r\nFY 2032"), ("w2/@", 5, "Governor Recommended\r\nFY 2034"), ("w2/@", 6, "FY 2031 Adjusted Approp. as of 3/4/2030"), ("w2/@", 7, "Conference\r\nFY 2033"), ("w2/@", 8, "Appropriation FY 2030"), ("w2/@", 9, "Notes"),
])
NESTED = Drawn("nested", "id int, text string", list(enumerate(["a (b (#) d) e#", "x# ) y", "open ( tail", "none", "(all)", "(a)(b)c", None, ""])))
CELLS = Drawn("cells", "id int, text string", list(enumerate([
    "Same as the Executive.", "(#) Same as the House.", "Same as the Executive, but makes the following changes:", "No provision.", "same as  the   senate", "Same as the Conference report.", "(a) Same as the House", "", None, "(#) Same as the Executive proposal",
])))
VETOED = Drawn("vetoed", "id int, text string", list(enumerate([
    "Keeps [***VETOED: strikes # this***] and that", "none #", "two [***VETOED:a***] x [***VETOED: b ***] y", "open [***VETOED: never closed", None, "",
])))
CODES = Drawn("codes", "id int, text string", list(enumerate(["EDUCD#Title", "EDU# x", "EDUCATIONS12x", "OBMCD#45", "AGR# Farm #", "abc12", "DNRCD1", None, "TAXCD1234end"])))
WIDE_CELLS = Copied("wide_cells", "workbook string, row_idx int, col_idx int, text string", [
    ("w1/@", r, c, t) for r, row in enumerate([
        ["EDU", "GRF", "GRF", "200550", "Foundation", "@.00", "900.00", "5", "1,@.50", "1,150.00", "x"], ["EDU", "GRF", "GRF", "200550", "Foundation Funding", "2,000.00", "", "5", "-", "2,150.00", "x"],
        ["EDU", "GRF", "GRF", "200401", "Other", "n/a", "(10.50)", "5", "1,234.567", "7", "x"], ["", "", "", "", "Grand Total", "9", "9", "9", "9", "9", "x"],
    ]) for c, t in enumerate(row)
] + [("w2/@", 0, c, t) for c, t in enumerate(["EDU", "200550", "Foundation", "1@.00", "20.00", "30.00", "40.00", "50.00", "60.00", "note"])])
