"""Workbooks as a Spark data source: a partition for each sheet, filters on workbook, sheet and row pushed into the scan, sheets read row by row.

`register(spark)` once, then `cells`, `merged`, `panes` and `styles`. All of them leave out lock files (~$) and hidden files; a file that is no workbook is an error here,
`xlsx.broken` finds such files.
"""

from __future__ import annotations

import array
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tallyweave.sources.publish import store
from tallyweave.sources.xlsx import BUILT_IN, MAIN, RELATION

SCHEMAS = {
    "cells": "workbook string, sheet string, row int, col int, raw string, cached string, v_type string, number_format string, style int",
    "merged": "workbook string, sheet string, range_id int, r1 int, c1 int, r2 int, c2 int",
    "panes": "workbook string, sheet string, x_split double, y_split double, top_left string, active string, state string",
    "styles": "workbook string, style int, number_format string, font string, size double, bold boolean, italic boolean, underline boolean, font_rgb string, font_indexed int, fill_rgb string, fill_indexed int, halign string, valign string, top string, bottom string, left string, right string",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
BATCH = 20_000
TYPES = {"s": "string", "str": "string", "inlineStr": "string", "b": "bool", "e": "error"}


class Strings:
    """A table of shared strings: one run of bytes and the ends of each."""

    def __init__(self, z: zipfile.ZipFile):
        self.text, self.ends = bytearray(), array.array("q", [0])
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for si in _elements(f, "si"):
                    self.text += "".join(t.text or "" for t in si.iter(f"{MAIN}t")).encode()
                    self.ends.append(len(self.text))

    def __getitem__(self, i: int) -> str:
        return self.text[self.ends[i] : self.ends[i + 1]].decode()


def _elements(f, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one name, each dropped when the next is asked for."""
    events = ElementTree.iterparse(f, events=("start", "end"))
    _, root = next(events)
    for event, e in events:
        if event == "end" and e.tag == f"{MAIN}{tag}":
            yield e
            e.clear()
            root.clear()


def position(address: str) -> tuple[int, int]:
    """Row and column of an address."""
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", address).groups()
    col = 0
    for letter in letters:
        col = col * 26 + ord(letter) - 64
    return int(row), col


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook, in order."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(RELATION)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in sheets]


def _styles(z: zipfile.ZipFile) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read("xl/styles.xml")) if "xl/styles.xml" in z.namelist() else None


def number_formats(styles: ElementTree.Element | None) -> list[str]:
    """The number format of each style index."""
    if styles is None or (used := styles.find(f"{MAIN}cellXfs")) is None:
        return ["General"]
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
    return [own.get(n := int(x.get("numFmtId", 0)), BUILT_IN.get(n, "General")) for x in used] or ["General"]


def cell_rows(z: zipfile.ZipFile, part: str, least: int | None = None, most: int | None = None) -> Iterator[tuple]:
    """(row, col, raw, cached, v_type, number_format, style) of the cells of the rows from `least` to `most`; reading ends behind the last of them."""
    strings, formats = None, number_formats(_styles(z))
    with z.open(part) as f:
        events = ElementTree.iterparse(f, events=("start", "end"))
        data = None
        for event, e in events:
            if event == "start":
                data = e if e.tag == f"{MAIN}sheetData" else data
                continue
            if e.tag == f"{MAIN}sheetData":
                return
            if e.tag != f"{MAIN}row":
                continue
            for c in e.iter(f"{MAIN}c"):
                row, col = position(c.get("r"))
                if least is not None and row < least:
                    break
                if most is not None and row > most:
                    return
                kind, value, formula = c.get("t", "n"), c.findtext(f"{MAIN}v"), c.findtext(f"{MAIN}f")
                if kind == "s" and value is not None:
                    strings = strings or Strings(z)
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if value is None and formula is None:
                    continue
                style = int(c.get("s", 0))
                yield row, col, f"={formula}" if formula is not None else value, value, TYPES.get(kind, "number"), formats[min(style, len(formats) - 1)], style
            e.clear()
            data.clear()


def merged_rows(z: zipfile.ZipFile, part: str) -> Iterator[tuple]:
    with z.open(part) as f:
        for i, m in enumerate(_elements(f, "mergeCell")):
            (r1, c1), (r2, c2) = (position(x) for x in (m.get("ref").split(":") * 2)[:2])
            yield i, r1, c1, r2, c2


def pane_rows(z: zipfile.ZipFile, part: str) -> Iterator[tuple]:
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f, events=("start",)):
            if e.tag == f"{MAIN}sheetData":
                return
            if e.tag == f"{MAIN}pane":
                split = [float(e.get(k)) if e.get(k) else None for k in ("xSplit", "ySplit")]
                if any(split):
                    yield *split, e.get("topLeftCell"), e.get("activePane"), e.get("state")
                return


def style_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """A row for each style index of a workbook. Colours are ARGB or an index of the palette."""
    styles = _styles(z)
    if styles is None or (used := styles.find(f"{MAIN}cellXfs")) is None:
        return
    group = lambda name: list(styles.find(f"{MAIN}{name}")) if styles.find(f"{MAIN}{name}") is not None else []
    at = lambda some, i: some[int(i)] if i is not None and int(i) < len(some) else None
    flag = lambda e, tag: e is not None and (x := e.find(f"{MAIN}{tag}")) is not None and x.get("val", "1") not in ("0", "false", "none")
    value = lambda e, tag: x.get("val") if e is not None and (x := e.find(f"{MAIN}{tag}")) is not None else None
    colour = lambda e: (e.get("rgb"), int(e.get("indexed")) if e.get("indexed") else None) if e is not None else (None, None)
    fonts, fills, borders, formats = group("fonts"), group("fills"), group("borders"), number_formats(styles)
    for i, x in enumerate(used):
        font, fill, border, alignment = at(fonts, x.get("fontId")), at(fills, x.get("fillId")), at(borders, x.get("borderId")), x.find(f"{MAIN}alignment")
        pattern = fill.find(f"{MAIN}patternFill") if fill is not None else None
        size = value(font, "sz")
        sides = [s.get("style") if border is not None and (s := border.find(f"{MAIN}{side}")) is not None else None for side in ("top", "bottom", "left", "right")]
        aligned = [alignment.get(k) if alignment is not None else None for k in ("horizontal", "vertical")]
        front = colour(font.find(f"{MAIN}color") if font is not None else None)
        back = colour(pattern.find(f"{MAIN}fgColor") if pattern is not None else None)
        yield i, formats[i], value(font, "name"), float(size) if size else None, flag(font, "b"), flag(font, "i"), flag(font, "u"), *front, *back, *aligned, *sides


class Sheet(InputPartition):
    def __init__(self, file: str, workbook: str, sheet: str | None, part: str | None):
        self.file, self.workbook, self.sheet, self.part = file, workbook, sheet, part


class SheetReader(DataSourceReader):
    """Reads one kind of rows of the sheets under a path. What has been pushed down is kept in `only` and the bounds of rows."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.only: dict[str, set] = {}
        self.least: int | None = None
        self.most: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("workbook", "sheet") and isinstance(f, EqualTo | In) and (name != "sheet" or self.kind != "styles"):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, found) & found
            elif name == "row" and self.kind == "cells" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = f.value + isinstance(f, GreaterThan)
                    self.least = low if self.least is None else max(self.least, low)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = f.value - isinstance(f, LessThan)
                    self.most = high if self.most is None else min(self.most, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = store(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        wanted = lambda column, name: column not in self.only or name in self.only[column]
        out: list[InputPartition] = []
        for x in sorted(files, key=lambda x: x.path):
            if not x.is_file or x.extension != "xlsx" or x.base_name.startswith(("~$", ".")) or not wanted("workbook", x.base_name):
                continue
            if self.kind == "styles":
                out.append(Sheet(x.path, x.base_name, None, None))
                continue
            with fs.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                out += [Sheet(x.path, x.base_name, name, part) for name, part in sheets_of(z) if wanted("sheet", name)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, SCHEMAS[self.kind].split(", "))])
        if partition is None:  # nothing is left to read
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            rows = {
                "cells": lambda: cell_rows(z, partition.part, self.least, self.most), "merged": lambda: merged_rows(z, partition.part),
                "panes": lambda: pane_rows(z, partition.part), "styles": lambda: style_rows(z),
            }[self.kind]()
            before = (partition.workbook,) if partition.sheet is None else (partition.workbook, partition.sheet)
            held = []
            for row in rows:
                held.append(before + row)
                if len(held) == BATCH:
                    yield _batch(held, schema)
                    held = []
            if held:
                yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Workbooks(DataSource):
    """spark.read.format("workbooks").option("kind", "cells" | "merged" | "panes" | "styles").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "cells")]

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("kind", "cells"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)


def _load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    register(spark)
    return spark.read.format("workbooks").option("kind", kind).load(path)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files under a path, with both views: `raw` is the formula or the value, `cached` the stored value; `style` joins `styles`."""
    return _load(spark, path, "cells")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Merged ranges, numbered within their sheet."""
    return _load(spark, path, "merged")


def panes(spark: SparkSession, path: str) -> DataFrame:
    """The split of each sheet that has one: columns and rows that stay, and the state (frozen, split)."""
    return _load(spark, path, "panes")


def styles(spark: SparkSession, path: str) -> DataFrame:
    """The styles of each workbook, by index."""
    return _load(spark, path, "styles")
