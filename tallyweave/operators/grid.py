"""Sheets as text in numbered segments, so that no sheet has to be one row, and what is wrong with a solution's sheets. cells: (workbook, sheet, row, col, raw, cached, v_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.formulas import column_letters
from tallyweave.operators.sheets import KEY, filled, used_range

#: Rows of a sheet that a segment covers.
ROWS = 256


def address() -> Column:
    return F.concat(column_letters("col"), F.col("row").cast("string"))


def is_formula() -> Column:
    return F.col("raw").startswith("=")


def cell_text() -> Column:
    """`A1: =f [=v]` for a formula ([formula] without a stored value), `A1: 5 [number]`, `A1: "x" [text]`."""
    kind = F.when(is_formula(), F.coalesce(F.concat(F.lit("[="), F.col("cached"), F.lit("]")), F.lit("[formula]"))).when(F.col("v_type").isin("number", "bool"), "[number]").otherwise("[text]")
    shown = F.when(is_formula() | F.col("v_type").isin("number", "bool"), F.col("raw")).otherwise(F.concat(F.lit('"'), F.col("raw"), F.lit('"')))
    return F.concat(address(), F.lit(": "), shown, F.lit(" "), kind)


def in_segments(lines: DataFrame, text: str, rows_of: int = ROWS) -> DataFrame:
    """(workbook, sheet, segment, text): texts of rows (workbook, sheet, row, text), in order, `rows_of` rows at a time. Segments without a row are left out."""
    held = lines.groupBy(*KEY, F.floor(F.col("row") / rows_of).cast("int").alias("segment"))
    return held.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", text))), lambda x: x[text]), "").alias("text"))


def segments(cells: DataFrame, rows_of: int = ROWS) -> DataFrame:
    """(workbook, sheet, segment, text): put together by segment, the sheet's text. Segment -1 names the sheet and its used range from A1 on; rows without a cell are left out."""
    rows = filled(cells).groupBy(*KEY, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", cell_text().alias("text")))), lambda x: x["text"]), " | ").alias("line"))
    lines = rows.withColumn("line", F.concat(F.lit("  "), F.col("line"), F.lit("\n")))
    head = F.concat(F.lit("\n=== WORKSHEET: "), F.col("sheet"), F.lit(" ===\nUsed Range: A1:"), column_letters("max_col"), F.col("max_row").cast("string"), F.lit("\n"))
    return used_range(cells).select(*KEY, F.lit(-1).alias("segment"), head.alias("text")).unionByName(in_segments(lines, "line", rows_of))


def _refers_to_itself() -> Column:
    own = address()
    by_name = F.col("raw").contains(F.concat(F.lit("'"), F.col("sheet"), F.lit("'!"), own)) | F.col("raw").contains(F.concat(F.col("sheet"), F.lit("!"), own))
    plain = ~F.col("raw").contains("!") & F.array_contains(F.regexp_extract_all("raw", F.lit(r"\b[A-Z]{1,3}[0-9]+\b"), F.lit(0)), own)
    return by_name | plain


def self_references(cells: DataFrame) -> DataFrame:
    """Formulas that may refer to their own cell: by the sheet's name, quoted or not, or, in formulas without any sheet, by the plain address."""
    return cells.where(is_formula() & _refers_to_itself()).withColumn("address", address())


def unanswered(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """Of sheets (workbook, sheet) those named Q and a number that hold no formula, empty ones among them."""
    answered = cells.where(is_formula()).select(*KEY).distinct()
    return sheets.where(F.col("sheet").rlike("^Q[0-9]+$")).join(answered, KEY, "left_anti")


def solution_report(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(workbook, worksheets, formulas, self_references, unanswered) of every workbook of sheets (workbook, sheet). Cells are read once, and counted by sheet."""
    refers = F.coalesce(_refers_to_itself(), F.lit(False))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    listed = sheets.select(*KEY, one.alias("listed"), none.alias("formulas"), none.alias("self_references"))
    counted = cells.where(is_formula()).groupBy(*KEY).agg(none.alias("listed"), F.count("*").alias("formulas"), F.count_if(refers).alias("self_references"))
    by_sheet = listed.unionByName(counted).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("listed", "formulas", "self_references")))
    unanswered = F.when(F.col("sheet").rlike("^Q[0-9]+$") & (F.col("formulas") == 0), F.col("listed")).otherwise(0)
    out = by_sheet.groupBy("workbook").agg(F.sum("listed").alias("worksheets"), *(F.sum(c).alias(c) for c in ("formulas", "self_references")), F.sum(unanswered).alias("unanswered"))
    return out.where("worksheets > 0")
