"""Workbooks as long tables of cells, by a Spark data source that reads .xlsx files (zip and XML) on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.grid import ROWS, in_segments

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "workbook string, sheet string, row int, col int, raw string, cached string, v_type string, number_format string"
#: Formats that files refer to by number only.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 49: "@"}


def cells_of(content: bytes, name: str) -> Iterator[tuple]:
    """Rows of SCHEMA: raw is the formula (with =) or the value, cached the stored value of a formula."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in have:
            strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        formats = ["General"]
        if "xl/styles.xml" in have:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
            used = styles.find(f"{MAIN}cellXfs")
            formats = [own.get(n := int(x.get("numFmtId", 0)), BUILT_IN.get(n, "General")) for x in (used if used is not None else [])] or formats
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[s.get(RELATION)].lstrip("/")
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}c"):
                kind, value, formula = c.get("t", "n"), c.findtext(f"{MAIN}v"), c.findtext(f"{MAIN}f")
                if kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if value is None and formula is None:
                    continue
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
                col = 0
                for letter in m[1]:
                    col = col * 26 + ord(letter) - 64
                v_type = {"s": "string", "str": "string", "inlineStr": "string", "b": "bool", "e": "error"}.get(kind, "number")
                yield (name, s.get("name"), int(m[2]), col, f"={formula}" if formula is not None else value, value, v_type, formats[min(int(c.get("s", 0)), len(formats) - 1)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files under a path; lock files (~$) and hidden files are passed over. Files that are no workbook give no cell: `broken` names them."""
    return _parsed(spark, path).where("error IS NULL").drop("error")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(workbook, error) of the .xlsx files under a path that can't be read."""
    return _parsed(spark, path).where("error IS NOT NULL").select("workbook", "error")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).where(~F.col("name").startswith("~$") & ~F.col("name").startswith("."))

    def parse(batches):
        for batch in batches:
            for name, content in batch[["name", "content"]].itertuples(index=False):
                try:
                    rows = list(cells_of(content, name))
                    out = pd.DataFrame(rows, columns=names).assign(error=None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out = pd.DataFrame([(name, *[None] * (len(names) - 1))], columns=names).assign(row=0, col=0, error=f"{type(e).__name__}: {e}")
                yield out.astype({"row": "int32", "col": "int32"})

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return files.select("name", "content").mapInPandas(parse, SCHEMA + ", error string")


def to_csv_text(cells: DataFrame, rows_of: int = ROWS) -> DataFrame:
    """(workbook, sheet, segment, csv): values row by row, rows and columns that are empty throughout left out, `rows_of` rows at a time.

    Put together by segment, with line ends between, they are the sheet's text, so no sheet is one row. A sheet's list of filled columns has 16,384 entries at most."""
    some = cells.where(F.coalesce("cached", F.lit("")) != "")
    columns = some.groupBy("workbook", "sheet").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    rows = some.groupBy("workbook", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cached"))).alias("by_col"))
    line = F.array_join(F.transform("cols", lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit(""))), ",")
    lines = rows.join(columns, ["workbook", "sheet"]).select("workbook", "sheet", "row", F.concat(line, F.lit("\n")).alias("line"))
    return in_segments(lines, "line", rows_of).select("workbook", "sheet", "segment", F.regexp_replace("text", "\n$", "").alias("csv"))
