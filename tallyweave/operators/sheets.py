"""Cells of workbooks: used ranges, headers, column profiles, references, search. cells: (workbook, sheet, row, col, raw, v_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.formulas import column_letters

KEY = ["workbook", "sheet"]


def filled(cells: DataFrame) -> DataFrame:
    """Cells that hold something: neither NULL nor the empty text."""
    return cells.where(F.col("raw").isNotNull() & (F.col("raw") != ""))


def used_range(cells: DataFrame) -> DataFrame:
    return filled(cells).groupBy(*KEY).agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count("*").alias("n_cells"))


def behind_rows(cells: DataFrame, *made: Column, where: Column | None = None) -> DataFrame:
    """cells with those of `made` (structs of some of the cells' columns; others are NULL) after each row that holds a filled cell and of which `where` is true.

    They are put behind the row's first filled cell, so that cells are read once. `where` and `made` may use workbook, sheet and row."""
    own = [c for c in cells.columns if c not in (*KEY, "row")]
    types = {f.name: f.dataType for f in cells.schema.fields}
    given = [cells.select(m.alias("x")).schema["x"].dataType.names for m in made]
    whole = lambda m, has: F.struct(*((m[c] if c in has else F.lit(None)).cast(types[c]).alias(c) for c in own))
    some = F.coalesce(F.col("raw") != "", F.lit(False))
    first = F.row_number().over(Window.partitionBy(*KEY, "row").orderBy(F.when(some, 0).otherwise(1), "col")) == 1
    put = some & F.col("__first") & (F.lit(True) if where is None else where)
    cell = F.struct(*(F.col(c).alias(c) for c in own))
    told = cells.withColumn("__first", first).withColumn("__cells", F.when(put, F.array(cell, *map(whole, made, given))).otherwise(F.array(cell)))
    return told.select(*KEY, "row", F.inline("__cells")).select(*cells.columns)


def sheet_info(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, min_row, max_row, min_col, max_col, n_cells, n_formulas, used_range) of every sheet with a filled cell."""
    box = ["min", "max"]
    found = filled(cells).groupBy(*KEY).agg(*(getattr(F, f)(c).alias(f"{f}_{c}") for c in ("row", "col") for f in box), F.count("*").alias("n_cells"), F.count_if(F.col("raw").startswith("=")).alias("n_formulas"))
    corner = lambda f: F.concat(column_letters(f"{f}_col"), F.col(f"{f}_row").cast("string"))
    return found.withColumn("used_range", F.concat(corner("min"), F.lit(":"), corner("max")))


def formulas_at(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (workbook, sheet, row, col) with the cell's formula (NULL where it is none), value and type; NULLs where no cell is."""
    there = cells.select(*KEY, "row", "col", F.when(F.col("raw").startswith("="), F.col("raw")).alias("formula"), F.col("raw").alias("value"), F.col("v_type").alias("data_type"))
    return wanted.join(there, [*KEY, "row", "col"], "left")


def header_rows(cells: DataFrame, share: float = 0.6, look: int = 3) -> DataFrame:
    """(sheet, header_row): the first of the first `look` used rows whose texts reach `share` of the used width (at least one)."""
    box = used_range(cells)
    rows = filled(cells).where("v_type = 'string'").groupBy(*KEY, "row").agg(F.count("*").alias("texts")).join(box, KEY)
    need = F.greatest(F.lit(1), F.floor(F.lit(share) * (F.col("max_col") - F.col("min_col") + 1)))
    return rows.where((F.col("row") < F.col("min_row") + look) & (F.col("texts") >= need)).groupBy(*KEY).agg(F.min("row").alias("header_row"))


def column_profile(cells: DataFrame) -> DataFrame:
    """By column: filled cells, the commonest type (the type seen first on ties), and its first three values.

    A task passes on three values of a column at most: Spark limits ranked groups before it shuffles them."""
    some = filled(cells)
    types = some.groupBy(*KEY, "col", "v_type").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    kind = types.groupBy(*KEY, "col").agg(F.max_by("v_type", F.struct("n", -F.col("first"))).alias("type"), F.sum("n").alias("non_null"))
    ranked = some.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY, "col").orderBy("row", "raw"))).where(F.col("__n") <= 3)
    near = ranked.groupBy(*KEY, "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "raw"))), lambda x: x["raw"]).alias("examples"))
    return kind.join(near, [*KEY, "col"])


def search(cells: DataFrame, query: str, how: str = "contains", case: bool = False, limit: int = 100) -> DataFrame:
    """The first `limit` cells, row by row, that contain, equal or match the query."""
    value, q = (F.col("raw"), query) if case else (F.lower("raw"), query.lower())
    hit = {"contains": value.contains(q), "equals": value == q, "regex": F.col("raw").rlike(query if case else f"(?i){query}")}[how]
    return cells.where(hit).orderBy(*KEY, "row", "col").limit(limit)


def read_range(cells: DataFrame, row1: int, col1: int, row2: int, col2: int) -> DataFrame:
    return cells.where(F.col("row").between(row1, row2) & F.col("col").between(col1, col2))


def in_ranges(cells: DataFrame, ranges: DataFrame, block: int = 256) -> DataFrame:
    """Cells within ranges (workbook, sheet, r1, r2, c1, c2, range_id), by an equi-join on blocks of rows instead of a range join."""
    spread = ranges.withColumn("blk", F.explode(F.sequence(F.floor(F.col("r1") / block), F.floor(F.col("r2") / block))))
    hit = cells.withColumn("blk", F.floor(F.col("row") / block)).join(spread, [*KEY, "blk"])
    return hit.where("row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2").drop("blk", "r1", "r2", "c1", "c2")


def with_merged(cells: DataFrame, merged: DataFrame, block: int = 256) -> DataFrame:
    """Cells with the merged range (workbook, sheet, range_id, r1, c1, r2, c2) that they lie in, as `merged` (A1:C3) and `range_id`, and whether they are its first cell, which is the one shown.

    Ranges are spread over blocks of rows and meet cells in one equi-join; a block's ranges are one array. Of ranges that overlap the least number counts. Cells outside have NULLs.
    """
    box = F.struct("range_id", "r1", "c1", "r2", "c2")
    blocks = merged.select(*KEY, F.explode(F.sequence(F.floor(F.col("r1") / block), F.floor(F.col("r2") / block))).alias("__blk"), box.alias("box")).groupBy(*KEY, "__blk").agg(F.sort_array(F.collect_list("box")).alias("__boxes"))
    met = cells.withColumn("__blk", F.floor(F.col("row") / block)).join(blocks, [*KEY, "__blk"], "left")
    hit = F.try_element_at(F.filter("__boxes", lambda x: F.col("row").between(x["r1"], x["r2"]) & F.col("col").between(x["c1"], x["c2"])), F.lit(1))
    corner = lambda r, c: F.concat(column_letters(F.col(f"__hit.{c}")), F.col(f"__hit.{r}").cast("string"))
    told = met.withColumn("__hit", hit).withColumns({"merged": F.concat(corner("r1", "c1"), F.lit(":"), corner("r2", "c2")), "range_id": F.col("__hit.range_id"), "is_shown": (F.col("row") == F.col("__hit.r1")) & (F.col("col") == F.col("__hit.c1"))})
    return told.select(*cells.columns, "range_id", "merged", "is_shown")


def formula_refs(formulas: DataFrame, formula: str = "raw") -> DataFrame:
    """(…, ref_sheet, ref) of each formula: sheet-qualified references, then plain ones.

    The plain pattern also reads the tail of a qualified reference as one of the formula's own sheet; each is listed once.
    """
    qualified = F.transform(F.regexp_extract_all(formula, F.lit(r"('[^']+'|[A-Za-z0-9_]+)!\$?[A-Z]{1,3}\$?[0-9]+"), F.lit(0)), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, "^(.*)!", 1), "'", "").alias("ref_sheet"), F.regexp_replace(F.regexp_extract(x, "!(.*)$", 1), r"\$", "").alias("ref")))
    plain = F.transform(F.regexp_extract_all(formula, F.lit(r"\$?[A-Z]{1,3}\$?[0-9]+"), F.lit(0)), lambda x: F.struct(F.col("sheet").alias("ref_sheet"), F.regexp_replace(x, r"\$", "").alias("ref")))
    return formulas.where(F.col(formula).startswith("=")).select("*", F.inline(F.array_distinct(F.concat(qualified, plain))))


def split(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, and the empty text before or behind them."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits of two or more characters, with the singular of plurals added."""
    words = F.filter(split(text), lambda w: F.length(w) >= 2)
    return F.flatten(F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w))))


def keywords(sources: list[tuple[DataFrame, str, str, int]], most: int = 60) -> DataFrame:
    """(key, word, weight) of the heaviest words of each key over sources (rows, key, text, weight)."""

    every = None
    for rows, key, text, weight in sources:
        # The words of `tokens`, row by row: functions over arrays would be interpreted for each word.
        part = rows.select(F.col(key).alias("key"), F.explode(split(text)).alias("word"), F.lit(weight).alias("weight")).where(F.length("word") >= 2)
        singular = F.expr("substring(word, 1, length(word) - 1)")
        part = part.select("key", F.explode(F.when(F.col("word").endswith("s") & (F.length("word") > 3), F.array("word", singular)).otherwise(F.array("word"))).alias("word"), "weight")
        every = part if every is None else every.unionByName(part)
    total = every.groupBy("key", "word").agg(F.sum("weight").alias("weight"))
    return total.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "word"))).where(F.col("_n") <= most).drop("_n")


def task_like(text: str | Column, patterns: list[str]) -> Column:
    """Whether a text reads like a task, by any of the patterns."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def sheet_mentions(texts: DataFrame, sheets: DataFrame, text: str) -> DataFrame:
    """Rows of texts (workbook, sheet, text) with the other sheet whose name comes first in the text (ties to the first name)."""
    names = sheets.groupBy("workbook").agg(F.collect_set("sheet").alias("names"))
    first = F.array_min(F.filter(F.transform("names", lambda n: F.struct(F.instr(F.lower(F.col(text)), F.lower(n)).alias("at"), n.alias("name"))), lambda x: (x["at"] > 0) & (x["name"] != F.col("sheet"))))
    return texts.join(names, "workbook", "left").withColumn("mentions", first["name"]).drop("names")


def rendered(cells: DataFrame, rows_of: int = 256) -> DataFrame:
    """(workbook, sheet, segment, grid): every filled cell as `A1: raw`, row by row, `rows_of` rows to a segment: a sheet's segments in order, with line ends between, are its text."""
    line = F.concat(column_letters("col"), F.col("row").cast("string"), F.lit(": "), F.col("raw"))
    segment = F.floor(F.col("row") / rows_of).cast("int").alias("segment")
    return filled(cells).groupBy(*KEY, segment).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", line.alias("line")))), lambda x: x["line"]), "\n").alias("grid"))


def enhanced(address: Column, value: Column, formula: Column, number_format: Column) -> Column:
    """`[A1]value|FORMULA:…|FORMAT:…`, parts that are NULL left out, General not shown."""
    return F.concat_ws("|", F.concat(F.lit("["), address, F.lit("]"), F.coalesce(value, F.lit(""))), F.concat(F.lit("FORMULA:"), formula), F.when(number_format != "General", F.concat(F.lit("FORMAT:"), number_format)))


def resolve_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each cell of an append-only table (workbook, sheet, row, col, raw, seq)."""
    return edits.groupBy(*KEY, "row", "col").agg(F.max_by("raw", "seq").alias("raw"))


#: Rows of a sheet among which a piece of it may begin.
BLOCK = 4_096


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (workbook, sheet, row, ...) with `piece`: pieces of a sheet in which no row is next to one of another piece.

    A piece begins in each `block` rows at the first row that follows an empty one of them, if there is any. A row before that is of the piece that began last."""
    at = F.floor(F.col("row") / block).alias("__at")
    near = Window.partitionBy(*KEY, "__at").orderBy("row")
    last = F.coalesce(F.lag("row").over(near), F.col("__at") * block - 1)
    gaps = rows.select(*KEY, at, "row").distinct().withColumn("__gap", (F.col("row") > F.col("__at") * block) & (last < F.col("row") - 1))
    begins = gaps.groupBy(*KEY, "__at").agg(F.min(F.when(F.col("__gap"), F.col("row"))).alias("__own"))
    before = F.last("__own", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("__at", at).join(begins.withColumn("__before", before), [*KEY, "__at"])
    return met.select(*rows.columns, F.when(F.col("row") >= F.col("__own"), F.col("__own")).otherwise(F.col("__before")).alias("piece"))


def blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(workbook, sheet, r1, c1, r2, c2) of contiguous blocks: right along the first row, then down while the whole width is filled.

    No block crosses a row without any cell, so the pieces of a sheet between such rows are dealt over tasks. A task reads the runs of cells row by row and
    holds only the blocks that are open in the row it is at, whatever the length of a piece. A run begins a block at its first cell that none from above covers.
    """
    import pandas as pd

    def next_row(above: list, row: int, runs: list) -> tuple[list, list]:
        """The open blocks (r1, c1, c2) after a row, by their first columns, and those that ended above it."""
        going, ended, new, k = [], [], [], 0
        for one in above:
            while k < len(runs) and runs[k][1] < one[1]:
                k += 1
            (going if k < len(runs) and runs[k][0] <= one[1] and one[2] <= runs[k][1] else ended).append(one)
        k = 0
        for c1, c2 in runs:
            while k < len(going) and going[k][1] <= c1:
                c1, k = max(c1, going[k][2] + 1), k + 1
            if c1 <= c2:
                new.append((row, c1, c2))
        return sorted(going + new, key=lambda x: x[1]) if going else new, ended

    def find(parts):
        sheet, row, runs, above, out = None, None, [], [], []

        def closed(ended: list, down: int) -> None:
            out.extend((*sheet, r1, c1, down, c2) for r1, c1, c2 in ended)

        for part in parts:
            for workbook, name, r, c1, c2 in zip(*(part[c].tolist() for c in ("workbook", "sheet", "row", "c1", "c2")), strict=True):
                if r != row or (workbook, name) != sheet:
                    if row is not None:
                        above, ended = next_row(above, row, runs)
                        closed(ended, row - 1)
                        if r != row + 1 or (workbook, name) != sheet:
                            closed(above, row)
                            above = []
                    sheet, row, runs = (workbook, name), r, []
                runs.append((c1, c2))
            yield pd.DataFrame(out, columns=["workbook", "sheet", "r1", "c1", "r2", "c2"])
            out.clear()
        if row is not None:
            above, ended = next_row(above, row, runs)
            closed(ended, row - 1)
            closed(above, row)
            yield pd.DataFrame(out, columns=["workbook", "sheet", "r1", "c1", "r2", "c2"])

    run = F.col("col") - F.dense_rank().over(Window.partitionBy(*KEY, "row").orderBy("col"))
    runs = filled(cells).select(*KEY, "row", "col").withColumn("__run", run).groupBy(*KEY, "row", "__run").agg(F.min("col").alias("c1"), F.max("col").alias("c2")).drop("__run")
    dealt = pieces(runs, block).repartition(*KEY, "piece").sortWithinPartitions(*KEY, "row", "c1")
    return dealt.select(*KEY, "row", "c1", "c2").mapInPandas(find, "workbook string, sheet string, r1 int, c1 int, r2 int, c2 int")


#: Cells that one request may read.
MOST_CELLS = 2_500


def requested_ranges(cells: DataFrame, requests: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """Requests (request_id, workbook, sheet, r1, c1, r2, c2) with the sheet's n_rows and n_cols, r2 clamped to n_rows, and the error of those that can't be read.

    Rows and columns count from 1. The checks come in this order: null bounds, rows, columns, size, a sheet that is not there, a start beyond its end."""
    size = filled(cells).groupBy(*KEY).agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    span = lambda a, b: (F.col(b) - F.col(a) + 1).cast("long")
    wanted = span("r1", "r2") * span("c1", "c2")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    # These sentences, word by word.
    error = (
        F.when(F.col("r1").isNull() | F.col("r2").isNull() | F.col("c1").isNull() | F.col("c2").isNull(), F.lit("Error: All range parameters are required: start_row, end_row, start_col, end_col."))
        .when((F.col("r1") < 1) | (F.col("r2") < F.col("r1")), F.concat(F.lit("Error: Invalid row range "), text("r1"), F.lit("-"), text("r2"), F.lit(". Rows are 1-based and end_row must be >= start_row.")))
        .when((F.col("c1") < 1) | (F.col("c2") < F.col("c1")), F.concat(F.lit("Error: Invalid column range "), column_letters("c1"), F.lit("-"), column_letters("c2"), F.lit(". end_col must be >= start_col.")))
        .when(
            wanted > most,
            F.concat(F.lit("Error: requested range is "), text(wanted), F.lit(" cells ("), text(span("r1", "r2")), F.lit(" rows x "), text(span("c1", "c2")), F.lit(f" cols), which exceeds the {most}-cell per-call limit. Split the request into multiple smaller read_file calls.")),
        )
        .when(F.col("n_rows").isNull(), F.concat(F.lit("Error: Sheet '"), F.col("sheet"), F.lit("' not found.")))
        .when(F.col("r1") > F.col("n_rows"), F.concat(F.lit("Error: start_row "), text("r1"), F.lit(" exceeds file row count ("), text("n_rows"), F.lit(").")))
    )
    return requests.join(size, KEY, "left").withColumn("error", error).withColumn("r2", F.when(F.col("error").isNull(), F.least("r2", "n_rows")).otherwise(F.col("r2")))


def shows_something(raw: str = "raw", font: str = "font_rgb", fill: str = "fill_rgb") -> Column:
    """Whether a cell holds more than blanks, or has a font or fill colour."""
    coloured = lambda c: F.coalesce(F.col(c) != "00000000", F.lit(False))
    return (F.length(F.trim(F.coalesce(raw, F.lit("")))) > 0) | coloured(font) | coloured(fill)
