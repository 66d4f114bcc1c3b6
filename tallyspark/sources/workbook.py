"""Spreadsheet source: ``spark.read.format("workbook").load(path)`` reads .xlsx cells in long form.

Files are told by content, not extension: the older binary format is refused. One task reads one file.
Rows: sheet, row_idx, col_idx, text. Numbers are rendered with two decimals, errors as #ERR, all-empty rows are
left out. The paths must be readable by the tasks (a shared file system).
"""

from __future__ import annotations

import glob
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.operators.extract import column_plan

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, value = c.get("t", "n"), c.findtext(f"{_M}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_M}t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "e":
        return "#ERR"
    if kind == "b":
        return "true" if value == "1" else "false"
    return value if kind == "str" else f"{float(value):.2f}"


def cells(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every cell of the rows that are not empty."""
    if not raw.startswith(b"PK"):
        raise ValueError("not an .xlsx workbook (by content); the older binary format is not supported")
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{_M}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_M}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for i, row in enumerate(tree.iter(f"{_M}row")):
            found = [(_column(c.get("r", "A1")), _cell(c, shared)) for c in row.iter(f"{_M}c")]
            if any(text.strip() for _, text in found):
                for k, text in found:
                    yield sheet.get("name"), int(row.get("r", i + 1)) - 1, k, text


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for row in cells(f.read()):
                yield (partition.path.rsplit("/", 1)[-1], *row)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "workbook string, sheet string, row_idx int, col_idx int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def detail_sheet(raw: DataFrame) -> DataFrame:
    """The sheet of each workbook that holds its detail: EN, else the only one, else the first named "without summary"."""
    sheets = raw.select("workbook", "sheet").distinct().withColumn("n", F.count("*").over(W.partitionBy("workbook")))
    rank = F.when(F.col("sheet") == "EN", 0).when(F.col("n") == 1, 1).when(F.lower("sheet").contains("without summary"), 2)
    return sheets.where(rank.isNotNull()).groupBy("workbook").agg(F.min(F.struct(rank, "sheet"))["sheet"].alias("sheet"))


def header_rows(raw: DataFrame, first_rows: int = 10, legacy: bool = False) -> DataFrame:
    """workbook, sheet and header row: the best score among the first rows, the earliest on a tie.

    Identities score 3, money columns 2, estimates and unknown stages 1; ``legacy`` takes the first row that is not empty.
    """
    order = W.partitionBy("workbook", "sheet").orderBy("row_idx")
    head = raw.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= (1 if legacy else first_rows))
    if legacy:
        return head.groupBy("workbook", "sheet").agg(F.min("row_idx").alias("header_row"))
    named = column_plan(head.select(F.concat_ws("\u0001", "workbook", "sheet", "row_idx").alias("workbook"), "col_idx", F.col("text").alias("header")))
    score = F.when(F.col("kind") == "identity", 3).when(F.col("kind").isin("appropriation", "actual", "adjusted"), 2).when(F.col("kind").isin("estimate", "unknown_stage"), 1).otherwise(0)
    parts = F.split("workbook", "\u0001")
    scored = named.groupBy("workbook").agg(F.sum(score).alias("score")).where("score > 0").select(parts[0].alias("workbook"), parts[1].alias("sheet"), parts[2].cast("int").alias("row_idx"), "score")
    return scored.groupBy("workbook", "sheet").agg((-F.max(F.struct("score", (-F.col("row_idx")).alias("r")))["r"]).alias("header_row"))
