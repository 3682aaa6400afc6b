"""Questionnaire sheets: reading, cleaning and the list of questions."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators.sizing import top_per_group

# The sheets of a workbook, in order, and the column of the questions.
SHEETS = (
    "Governance",
    "Architecture & Design",
    "Code Development & Review",
    "Build & Deployment",
    "Test & Verification",
    "Operations & Observability",
)
QUESTION_COLUMN = "Evaluation Questions"
FEWEST_COLUMNS = 8
ROW_NO = "row_no"


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One exported sheet, all cells as text. The first physical row is used up as a
    provisional header. Rows keep their number: a column row_no if the export has one,
    else the order inside the file."""
    sheet = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    if ROW_NO in sheet.columns:
        return sheet.withColumn(ROW_NO, F.col(ROW_NO).cast("long"))
    return sheet.withColumn(ROW_NO, F.monotonically_increasing_id())


def cells(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if c != ROW_NO]


def columns_to_drop(n: int) -> range:
    """0-based positions of the columns a sheet of n columns loses."""
    if n < FEWEST_COLUMNS:
        raise ValueError(f"a sheet needs at least {FEWEST_COLUMNS} columns, got {n}")
    return range(4, min(n, 10))


def drop_positional(sheet: DataFrame) -> DataFrame:
    """Drop columns 4-9 of ten or more, 4-8 of nine, 4-7 of eight. Only what is left is read."""
    names = cells(sheet)
    gone = set(columns_to_drop(len(names)))
    return sheet.select(ROW_NO, *[F.col(f"`{c}`") for i, c in enumerate(names) if i not in gone])


def promote_header(sheet: DataFrame) -> DataFrame:
    """The first data row becomes the column names and is removed; an empty sheet stays."""
    first = sheet.orderBy(ROW_NO).limit(1).first()
    if first is None:
        return sheet
    names, seen = [], {}
    for c in cells(sheet):
        name = "nan" if first[c] is None else str(first[c])
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    rest = sheet.filter(F.col(ROW_NO) > first[ROW_NO])
    return rest.select(ROW_NO, *[F.col(f"`{c}`") for c in cells(sheet)]).toDF(ROW_NO, *names)


def clean_sheet(sheet: DataFrame) -> DataFrame:
    return promote_header(drop_positional(sheet))


def load_questionnaire(spark: SparkSession, directory: str,
                       sheets: Sequence[str] = SHEETS) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Clean the sheets exported to ``directory/<sheet>.csv`` (a file or folder): the sheets
    by name, and the reason for each one rejected. A missing sheet is an error."""
    good, rejected = {}, {}
    for name in sheets:
        raw = read_sheet(spark, os.path.join(directory, f"{name}.csv"))
        try:
            good[name] = clean_sheet(raw)
        except ValueError as e:
            rejected[name] = str(e)
    return good, rejected


def with_questions(sheets: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """Sheets that have the question column, and the names of those skipped."""
    usable = {n: s for n, s in sheets.items() if QUESTION_COLUMN in s.columns}
    return usable, [n for n in sheets if n not in usable]


def nonnull_questions(rows: DataFrame) -> DataFrame:
    """Rows (sheet_no, sheet, row_no, question) whose question is not null, as text; no
    question is dropped as a repeat. The order is (sheet_no, row_no)."""
    return rows.filter(F.col("question").isNotNull()).withColumn("question", F.col("question").cast("string"))


def extract_questions(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """All questions of all sheets in sheet and row order; see nonnull_questions."""
    usable, _ = with_questions(sheets)
    if not usable:
        raise ValueError(f"no sheet has a column {QUESTION_COLUMN}")
    order = {n: i for i, n in enumerate(sheets)}
    parts = [
        s.select(F.lit(order[n]).alias("sheet_no"), F.lit(n).alias("sheet"), ROW_NO,
                 F.col(QUESTION_COLUMN).alias("question"))
        for n, s in usable.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return nonnull_questions(rows)


def sheet_head(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of every sheet."""
    return top_per_group(rows, ["sheet"], [F.col(ROW_NO)], n, "place")
