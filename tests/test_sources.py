"""Workbooks as a data source, how cells look, tables published whole, runs that fall silent."""

import colorsys
import datetime as dt
import gzip
import os
import subprocess
import sys
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import formats
from tallyweave.operators import grid, sheets
from tallyweave.sources import logs, publish, workbooks, xlsx
from tallyweave.streaming import runs

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = (
    f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="&quot;$&quot;#,##0;[Red]\\(&quot;$&quot;#,##0\\)"/></numFmts>'
    '<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><i/><u/><sz val="9.5"/><color rgb="FFFF0000"/><name val="Arial"/></font><font><b val="0"/><color indexed="14"/></font></fonts>'
    '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00B0F0"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor indexed="64"/></patternFill></fill></fills>'
    '<borders><border/><border><left style="thin"/><top style="medium"/></border></borders>'
    '<cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment horizontal="center" vertical="bottom"/></xf><xf numFmtId="9" fontId="2" fillId="2" borderId="0"><alignment horizontal="general" vertical="top"/></xf></cellXfs></styleSheet>'
)


def book(path, parts):
    """A workbook of sheets by name, each the inner XML of its worksheet."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(parts, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Name</t></si><si><r><t>two </t></r><r><t>runs é</t></r></si><si/></sst>")
        z.writestr("xl/styles.xml", STYLES)
        for i, inner in enumerate(parts.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}>{inner}</worksheet>")


def rows_xml(n):
    return "<sheetData>" + "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>{r % 3}</v></c><c r="B{r}" s="1"><v>{r}</v></c><c r="AA{r}" s="2"><f>B{r}*2</f><v>{2 * r}</v></c><c r="AB{r}"/></row>' for r in range(1, n + 1)) + "</sheetData>"


@pytest.fixture
def books(tmp_path):
    pane = '<sheetViews><sheetView><pane xSplit="1" ySplit="2" topLeftCell="B3" activePane="bottomRight" state="frozen"/></sheetView></sheetViews>'
    merges = '<mergeCells count="3"><mergeCell ref="A1:C3"/><mergeCell ref="B300:AA900"/><mergeCell ref="AB1"/></mergeCells>'
    book(tmp_path / "one.xlsx", {"In put": pane + rows_xml(50) + merges, "empty": "<sheetData/>", "last": rows_xml(3)})
    os.mkdir(tmp_path / "deep")
    book(tmp_path / "deep" / "two.xlsx", {"In put": rows_xml(7)})
    (tmp_path / "~$one.xlsx").write_bytes(b"lock")
    return str(tmp_path)


def test_the_source_reads_what_the_whole_file_holds(spark, books):
    names = ["workbook", "sheet", "row", "col", "raw", "cached", "v_type", "number_format"]
    got = workbooks.cells(spark, books)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(map(tuple, xlsx.read(spark, books).select(names).collect()), key=repr)
    assert {(r.col, r.style, r.number_format) for r in got.collect()} == {(1, 0, "General"), (2, 1, '"$"#,##0;[Red]\\("$"#,##0\\)'), (27, 2, "0%")}


def test_filters_are_pushed_into_the_scan(spark, books):
    cells = workbooks.cells(spark, books)
    some = cells.where("sheet = 'In put' AND row > 3 AND row <= 5 AND workbook IN ('one.xlsx', 'x') AND col < 27")
    assert some.rdd.getNumPartitions() == 1
    reader = workbooks.SheetReader(books, "cells")
    left = list(reader.pushFilters([workbooks.EqualTo(("sheet",), "In put"), workbooks.GreaterThan(("row",), 3), workbooks.LessThan(("col",), 27), workbooks.EqualTo(("row",), 4)]))
    assert [x.attribute for x in left] == [("col",)] and (reader.least, reader.most, reader.only) == (4, 4, {"sheet": {"In put"}})
    assert {(r.row, r.col) for r in some.collect()} == {(4, 1), (4, 2), (5, 1), (5, 2)}
    assert cells.where("sheet = 'nowhere'").collect() == [] and cells.where("row = 2 AND row = 3").collect() == []
    assert cells.where("sheet IS NULL OR row IS NULL").collect() == []


def test_a_sheet_of_a_million_cells_is_read_in_little_memory(tmp_path):
    n = 250_000
    book(tmp_path / "large.xlsx", {"s": "<sheetData>" + "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><v>2</v></c><c r="C{r}"><v>3</v></c><c r="D{r}"><v>4</v></c></row>' for r in range(1, n + 1)) + "</sheetData>"})
    code = (
        "import resource, sys\nfrom tallyweave.sources.workbooks import SheetReader\nr = SheetReader(sys.argv[1], 'cells')\np = r.partitions()[0]\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nn = sum(b.num_rows for b in r.read(p))\nprint(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) == 4 * n and int(out[1]) < 300


def test_merged_ranges_panes_and_styles(spark, books):
    merged = workbooks.merged(spark, books)
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [("In put", 0, 1, 1, 3, 3), ("In put", 1, 300, 2, 900, 27), ("In put", 2, 1, 28, 1, 28)]
    assert [tuple(r) for r in workbooks.panes(spark, books).collect()] == [("one.xlsx", "In put", 1.0, 2.0, "B3", "bottomRight", "frozen")]
    looks = workbooks.styles(spark, books).where("workbook = 'one.xlsx'").orderBy("style").select(formats.format_summary().alias("s")).collect()
    assert [r.s for r in looks] == [
        "font:Calibri;size:11.0", "font:Arial;size:9.5;bold;italic;underline;textcolor:bright_red (FF0000);bgcolor:bright_cyan (00B0F0);halign:center;border:top:medium,left:thin",
        "textcolor:bright_orange (FF6600);bgcolor:black (000000);valign:top",
    ]


@pytest.mark.parametrize("block", [256, 3])
def test_cells_in_merged_ranges_equal_brute_force(spark, block):
    boxes = [("b", "s", 0, 2, 2, 5, 3), ("b", "s", 1, 5, 3, 9, 9), ("b", "t", 2, 1, 1, 1, 1), ("b", None, 3, 1, 1, 9, 9)]
    cells = [("b", s, r, c, "x", "string") for s in ("s", "t", "u") for r in range(1, 12) for c in range(1, 12)] + [("b", "s", 5, 3, "again", "string")]
    df = spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, raw string, v_type string")
    ranges = spark.createDataFrame(boxes, "workbook string, sheet string, range_id int, r1 int, c1 int, r2 int, c2 int")
    got = sheets.with_merged(df, ranges, block).collect()
    assert len(got) == len(cells)
    for g in got:
        hit = next((b for b in boxes if b[1] == g.sheet and b[3] <= g.row <= b[5] and b[4] <= g.col <= b[6]), None)
        assert g.range_id == (hit[2] if hit else None)
        assert g.is_shown == ((g.row, g.col) == (hit[3], hit[4]) if hit else None)
    assert {g.merged for g in got} == {None, "B2:C5", "C5:I9", "A1:A1"}
    assert sheets.with_merged(df, ranges.limit(0)).where("merged IS NOT NULL").collect() == [] and sheets.with_merged(df.limit(0), ranges).collect() == []


def named(rgb):
    """The rule for colour names by the standard library's conversion."""
    h, s, v = colorsys.rgb_to_hsv(*(int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4)))
    h *= 360
    if s < 0.1:
        return "black" if v < 0.2 else "white" if v > 0.9 else "gray"
    names, again = formats.DARK if v < 0.4 else formats.MUTED if s < 0.4 else formats.BRIGHT if s > 0.7 and v > 0.7 else formats.PASTEL if s < 0.7 and v > 0.7 else formats.PLAIN
    return names[0][1] if again and h >= again else next(n for bound, n in names if h < bound)


def test_colour_names_of_the_whole_cube(spark):
    steps = [0, 25, 51, 76, 102, 127, 153, 178, 204, 229, 255]
    cube = [f"{r:02X}{g:02x}{b:02X}" for r in steps for g in steps for b in steps]
    rows = spark.createDataFrame([(c, c) for c in cube] + [("FF123456", "123456"), ("00ABCDEF", "ABCDEF")], "rgb string, digits string").select("digits", formats.colour_name("rgb").alias("n")).collect()
    assert all(r.n == f"{named(r.digits)} ({r.digits})" for r in rows) and len(rows) == len(cube) + 2
    odd = spark.createDataFrame([("ABC",), ("XYZXYZ",), (None,), ("",)], "rgb string").select(formats.colour_name("rgb").alias("n")).collect()
    assert [r.n for r in odd] == ["ABC", "XYZXYZ", None, ""]
    indexed = spark.createDataFrame([(0,), (13,), (14,), (63,), (64,), (-1,), (None,)], "i int").select(formats.palette_rgb("i").alias("c")).collect()
    assert [r.c for r in indexed] == ["000000", "00FF00", "FF6600", "333333", "000000", "000000", None]


def test_values_with_their_formats(spark):
    rows = [
        (None, "number", "0"), ("text", "string", "0.00"), ("5", "number", "General"), ("0.1234567891", "number", "General"), ("5.0", "number", None), ("-3", "number", "[Red]#,##0"), ("0.123456789123", "number", "[Blue]0.00%"),
        ("-2.5", "number", '[$-409]#,##0;[Red]"$"0'), ("0", "number", '[Red]#,##0;-0;[Blue]"$"0'), ("1234.5678915", "number", '[Red]"$"#,##0.00'), ("12", "number", "yyyy-mm-dd"), ("0.5", "number", "0%"), ("1e3", "number", "@"), ("x", "number", "0"),
    ]
    want = ["", "text", "5", "0.123457", "5.0", "-3 [FORMAT:[Red]#,##0]", "0.12345679 [FORMAT:[Blue]0.00%]", '-2.5 [NEG FORMAT:[Red]"$"0]', '0 [ZERO FORMAT:[Blue]"$"0]', '1234.567892 [FORMAT:[Red]"$"#,##0.00]', "12", "50%", "1000.0", "x"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string, f string")
    assert [r.s for r in df.orderBy("i").select(formats.formatted_value("v", "t", "f").alias("s")).collect()] == want


def test_text_of_a_workbook_in_segments(spark, books):
    out = grid.segments(workbooks.cells(spark, books).where("sheet = 'last'"), 2).orderBy("segment").collect()
    assert "".join(r.text for r in out).splitlines()[3:5] == ['  A1: "two runs é" [text] | B1: 1 [number] | AA1: =B1*2 [=2]', "  B2: 2 [number] | AA2: =B2*2 [=4]"]


def test_the_first_writer_wins(spark, tmp_path):
    path, done = str(tmp_path / "table"), []
    tables = [spark.range(k * 1_000, k * 1_000 + 500, numPartitions=4).withColumn("who", F.lit(k)) for k in range(4)]
    writers = [threading.Thread(target=lambda t=t: done.append(publish.publish(t, path))) for t in tables]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(done) == 4
    kept = publish.published(spark, path, tables[0].schema).collect()
    assert len(kept) == 500 and len({r.who for r in kept}) == 1 and {r.id - 1_000 * r.who for r in kept} == set(range(500))
    assert len(os.listdir(tmp_path / "table" / "runs")) == 1  # nothing of the others is left
    with pytest.raises(Exception, match="published already"):
        publish.publish(tables[0], path, strict=True)
    assert publish.published(spark, path, tables[0].schema).count() == 500
    with pytest.raises(Exception, match="never overwritten"):
        tables[0].write.format("published").mode("overwrite").option("path", path).save()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken row"):
        publish.publish(bad, path)
    assert not os.path.exists(f"{path}/published.json")
    publish.tidy(path)
    assert os.listdir(f"{path}/runs") == []
    with pytest.raises(Exception):
        publish.published(spark, path, "id long")
    publish.publish(spark.range(0), path)
    publish.tidy(path)
    assert publish.published(spark, path, "id long").collect() == [] and publish.published(spark, path, "id long").schema.simpleString() == "struct<id:bigint>"


def test_one_retry():
    calls = []

    def work(fails, error=OSError):
        calls.append(1)
        if len(calls) <= fails:
            raise error("lost")
        return "done"

    assert publish.once_more(lambda: work(1), 0) == "done" and len(calls) == 2
    calls.clear()
    with pytest.raises(OSError):
        publish.once_more(lambda: work(2), 0)
    calls.clear()
    with pytest.raises(FileExistsError):
        publish.once_more(lambda: work(1, FileExistsError), 0)
    assert len(calls) == 1


def test_silent_runs_get_a_note_and_late_ends_cancel_it(spark, tmp_path):
    runs.use_state_store(spark)
    schema = "run string, ts timestamp, type string"
    t0 = dt.datetime(2025, 1, 1, 12)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    batches = [
        [("silent", at(0), "call"), ("silent", at(2), "call"), ("late end", at(0), "call"), ("ended", at(0), "call"), ("ended", at(1), "end"), ("unordered", at(5), "end"), (None, at(1), "call"), ("no time", None, "call")],
        [("late end", at(25), "end"), ("unordered", at(1), "call"), ("talks", at(1), None), ("clock", at(28), "call")],
        [("talks", at(29), "call"), ("clock", at(50), "call")],
        [("clock", at(51), "call"), ("too late", at(5), "call")],
        [("clock", at(120), "call")],
        [("clock", at(121), "end")],
        [("other", at(300), "end")],
    ]
    source = tmp_path / "in"
    os.mkdir(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = runs.partial_runs(stream).writeStream.format("memory").queryName("partial_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(i)))
            part = next(f for f in os.listdir(tmp_path / "made" / str(i)) if f.endswith(".parquet"))
            os.rename(tmp_path / "made" / str(i) / part, source / f"{i}.parquet")
            q.processAllAvailable()
        notes = sorted(tuple(r) for r in spark.table("partial_runs").collect())
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert notes == [("silent", 2, at(2)), ("talks", 2, at(29))]


def test_bad_lines_have_their_numbers(spark, tmp_path):
    lines = ['{"type": "call", "step": %d}' % i if i % 7 else "" if i % 2 else "{bad %d" % i for i in range(3_000)]
    (tmp_path / "plain.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.jsonl").write_text("\n".join(lines[::-1]))
    (tmp_path / "empty.jsonl").write_text("")
    with gzip.open(tmp_path / "packed.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[:500]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        records, bad = logs.trajectory(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.file, r.line_no, r.value) for r in bad.collect())
        assert records.count() == sum(bool(x) and not x.startswith("{bad") for part in (lines, lines, lines[:500]) for x in part)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(name, i, x) for name, part in (("plain.jsonl", lines), ("other.jsonl", lines[::-1]), ("packed.jsonl.gz", lines[:500])) for i, x in enumerate(part, 1) if x.startswith("{bad")]
    assert got == sorted(want)


def test_a_database_filters_and_names_are_checked(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"it's {i % 3}", float(i) if i % 5 else None) for i in range(40)], "id long, kind string, x double")
    rows.write.format("jdbc").options(url=url, dbtable='"tasks"', driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="kind VARCHAR(20)").save()
    read = lambda **k: logs.jdbc(spark, url, "tasks", ["id", "kind"], "id", driver="org.apache.derby.jdbc.EmbeddedDriver", **k)
    assert {r.id for r in read().collect()} == set(range(40)) and read(ids=[]).collect() == []
    some = read(ids=[1, 2, 4, 5, 7, 99], equal={"kind": "it's 1"}, bounds=(0, 40), parts=4)
    assert some.rdd.getNumPartitions() == 4 and {r.id for r in some.collect()} == {1, 4, 7}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "*In(id" in plan and "*EqualTo(kind" in plan
    assert {r.id for r in read(equal={"x": None}).collect()} == set(range(0, 40, 5)) and read(equal={"kind": "x' OR '1'='1"}).collect() == []
    for bad in ({"id_col": 'id" OR 1=1 --'}, {"table": "tasks; DROP TABLE tasks"}, {"columns": ["id", "(SELECT 1)"]}, {"equal": {"kind = kind OR kind": 1}}):
        with pytest.raises(ValueError, match="no plain name"):
            logs.jdbc(spark, url, **{"table": "tasks", "columns": ["id"], "id_col": "id"} | bad)


def test_trajectory_with_its_blobs(spark, tmp_path):
    rows = [(1, "short"), (2, "x" * 5_000), (3, "x" * 5_000), (4, None), (5, ""), (6, "é" * 2_048), (7, "y" * 2_047)]
    df = spark.createDataFrame(rows, "step long, content string").repartition(3)
    path = str(tmp_path / "run")
    assert publish.publish_trajectory(df, path, "content") and not publish.publish_trajectory(df, path, "content")
    assert sorted(map(tuple, publish.published_trajectory(spark, path, df.schema, "content").collect())) == rows
    (run,) = os.listdir(f"{path}/runs")
    assert spark.read.json(f"{path}/runs/{run}/blobs").count() == 2 and all(f.endswith(".gz") for f in os.listdir(f"{path}/runs/{run}/records") if f.startswith("part"))
    assert publish.publish_trajectory(df.limit(0), str(tmp_path / "none"), "content") and publish.published_trajectory(spark, str(tmp_path / "none"), df.schema, "content").collect() == []
