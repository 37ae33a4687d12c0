"""Operators that must hold for groups of any size: exact quantiles, running sums, an inverted index, texts in segments."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import budget, candidates, grid, scan, sheets, stats
from tallyweave.operators.quantiles import with_quantiles

PARTS = {"least": 0.0, "q25": 0.25, "median": 0.5, "q9": 0.9, "most": 1.0}


def values(kind, n):
    r = random.Random(hash(kind) % 1000)
    return {
        "uniform": [r.random() * 1e6 for _ in range(n)], "ties": [float(r.randrange(3)) for _ in range(n)], "one": [7.5] * n,
        "far": [r.choice([-1e300, 1e-300, 0.0, 1e300, 5.0]) for _ in range(n)], "sorted": [float(i) for i in range(n)], "infinite": [float("inf")] + [1.0] * (n - 1),
    }[kind]


@pytest.mark.parametrize("accuracy", [20_000, 50, 7])
def test_quantiles_equal_numpy(spark, accuracy):
    groups = {(k, n): values(k, n) for k in ("uniform", "ties", "one", "far", "sorted", "infinite") for n in (1, 2, 3, 10, 101, 3_000)}
    rows = [(f"{k}{n}" if k != "one" else None, n, v) for (k, n), own in groups.items() for v in own] + [("empty", 0, None)] * 3 + [("ties10", 10, None)] * 5
    df = spark.createDataFrame(rows, "k string, n int, v double").repartition(7)
    got = {(r.k, r.n): r for r in with_quantiles(df, ["k", "n"], "v", PARTS, [F.count("*").alias("rows"), F.sum("v").alias("total")], accuracy).collect()}
    assert len(got) == len(groups) + 1 and tuple(got["empty", 0])[2:] == (3, None, *[None] * 5)
    assert got["ties10", 10].rows == 15
    for (k, n), own in groups.items():
        r = got[f"{k}{n}" if k != "one" else None, n]
        for name, p in PARTS.items():
            if k != "infinite":
                assert r[name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-300)
        assert (r.least, r.most) == (min(own), max(own))


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert with_quantiles(df, [], "v", {"m": 0.5}).collect()[0].m == 5.0
    assert with_quantiles(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v", {"m": 0.5}).collect() == []
    assert stats.stat_summary(df.withColumn("k", F.lit(None).cast("int")), ["k"], "v").collect()[0].q25 == 2.5


def test_a_group_of_ten_million_rows_is_never_gathered(spark):
    df = spark.range(10_000_000, numPartitions=4).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    out = with_quantiles(df, ["k"], "v", {"q25": 0.25, "median": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and not re.search(r"\bpercentile\(|median\(", plan)
    row = out.collect()[0]
    held = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("p")).collect()[0].p
    assert [row.q25, row.median] == held


def prefix(rows, inclusive):
    out, sums = {}, {}
    for k, o, i, v in sorted(rows, key=lambda x: (str(x[0]), -x[1], x[2])):
        before = sums.get(k, 0)
        sums[k] = before + (v or 0)
        out[i] = sums[k] if inclusive else before
    return out, sums


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("parts", [1, 5, None])
def test_running_sums_of_a_hot_group(spark, inclusive, parts):
    r = random.Random(2)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", r.randrange(9), i, r.randrange(100) if i % 11 else None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, o int, i long, v long").repartition(6)
    got = scan.prefix_sums(df, ["k"], [F.desc("o"), "i"], {"upto": "v"}, {"whole": F.col("v")}, inclusive, parts).collect()
    want, sums = prefix(rows, inclusive)
    assert {x.i: (x.upto, x.whole) for x in got} == {i: (want[i], sums[k]) for k, _, i, _ in rows}
    assert scan.prefix_sums(df.limit(0), ["k"], ["o"], {"upto": "v"}).collect() == []


def test_running_sums_have_no_window_over_the_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 50).alias("n_chars"), F.lit(10).alias("short"))
    plan = budget.summarised_sheets(df, ["source"], "n_chars", "short", "doc_id", 6_000)._jdf.queryExecution().optimizedPlan().toString()
    over = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert [w for w in over if "n_chars" in w] and all("__part" in w for w in over if "n_chars" in w)  # the others are over the ranges' sums


def test_rows_without_a_value_stay_out_of_the_second_pass(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, None), ("b", None), ("b", None)], "k string, v double")
    got = with_quantiles(rows, ["k"], "v", {"median": 0.5}, [F.count("*").alias("n")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 3, 2.0), ("b", 2, None), (None, 1, None)], key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnotnull(v#" in plan or "Filter (isnotnull(v#" in plan


def words_of(text):
    out = []
    for w in re.split(r"[^A-Za-z0-9]+", (text or "").lower()):
        if len(w) >= 2:
            out += [w, w[:-1]] if len(w) > 3 and w.endswith("s") else [w]
    return out


def brute_candidates(texts, keywords, headers):
    """The rule, text by text and sheet by sheet."""
    out = []
    sheets_of = {}
    for book, sheet, *_ in [*keywords, *headers]:
        sheets_of.setdefault(book, set()).add(sheet)
    for book, sheet, task, text in texts:
        mine, found = set(words_of(text)), []
        for other in sorted(sheets_of.get(book, ())):
            own = other == sheet
            names = {}
            for b, s, block, place, name in headers:
                if (b, s) == (book, other) and block < (20 if own else 10):
                    names.setdefault(block, []).append((place, name))
            hits = {block: len(mine & {w for _, n in some for w in words_of(n)}) for block, some in names.items()}
            best = max((b for b in hits if hits[b]), key=lambda b: (hits[b], -b), default=None)
            hit = sorted(mine & {w for b, s, w in keywords if (b, s) == (book, other)})
            score = (hits[best] if best is not None else 0) if own else 0 if other.lower() in candidates.LISTS else len(hit)
            if score:
                matches = [n for _, n in sorted(names[best]) if mine & set(words_of(n))][:6] if best is not None else None
                found.append((-score, own, other, None if own else hit[:10], best, matches))
        for rank, (minus, _, other, hit, best, matches) in enumerate(sorted(found, key=lambda x: x[:3])[:5], 1):
            out.append((book, sheet, task, rank, other, -minus, hit, best, matches))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [candidates.SMALL, 0])
def test_candidates_equal_the_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(candidates, "SMALL", limit)
    r = random.Random(6)
    some = ["sales", "sale", "tax", "costs", "year", "total", "x", "units", "price", "ab", "rate"]
    books = {"b1": ["data", "Tasks", "inputs", "m1", "m2", "m3", "m4"], "b2": ["only"], None: ["lost"]}
    keywords = [(b, s, w) for b, own in books.items() for s in own for w in r.sample(some, 5)]
    headers = [(b, s, block, place, " ".join(r.sample(some, 2)).title()) for b, own in books.items() for s in own for block in (0, 1, 3, 12, 25) for place in range(r.randrange(9))]
    texts = [(b, r.choice(own), i, " ".join(r.choices(some, k=r.randrange(7)))) for b, own in books.items() for i in range(40)]
    texts += [("b1", "data", 100, None), ("b1", "data", 101, ""), ("b1", "data", 102, "SALES, taxes & sales-tax!"), ("b9", "x", 103, "sales")]
    df = spark.createDataFrame(texts, "workbook string, sheet string, task_id int, text string")
    k, h = spark.createDataFrame(keywords, "workbook string, sheet string, word string"), spark.createDataFrame(headers, "workbook string, sheet string, block int, place int, name string")
    got = sorted(map(tuple, candidates.task_candidates(df, k, h).collect()), key=repr)
    assert got == brute_candidates([t for t in texts if t[0]], [x for x in keywords if x[0]], [x for x in headers if x[0]])
    assert candidates.task_candidates(df.limit(0), k, h).collect() == [] and candidates.task_candidates(df, k.limit(0), h.limit(0)).collect() == []


def test_candidates_call_no_function_for_each_posting_or_word(spark, monkeypatch):
    text = spark.createDataFrame([("b", "s", 1, "sales taxes class as")], "workbook string, sheet string, task_id int, text string")
    k, h = spark.createDataFrame([("b", "t", w) for w in ("sale", "clas", "x", "a")], "workbook string, sheet string, word string"), spark.createDataFrame([("b", "s", 0, 0, "Taxes")] * 2, "workbook string, sheet string, block int, place int, name string")
    df = candidates.task_candidates(text, k, h)
    # The plural of a word meets it, "class" the word "clas" too; a word of one letter meets nothing, its plural is one of two letters.
    assert sorted(map(tuple, df.collect())) == [("b", "s", 1, 1, "t", 2, ["clas", "sale"], None, None), ("b", "s", 1, 2, "s", 2, None, 0, ["Taxes", "Taxes"])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(found" not in plan and "transform(found" not in plan and "filter(split" not in plan
    assert "lambdafunction" not in sheets.keywords([(text, "task_id", "text", 1)])._jdf.queryExecution().optimizedPlan().toString()
    # Texts are scored some at a time.
    bit = 1 << candidates.OWN_BLOCKS
    found, own = pa.array([[2**49 * (i % 3) + 2**candidates.WORD_BIT * j + bit for j in range(i % 5)] for i in range(40)], pa.list_(pa.int64())), pa.array([-1] * 40)
    every = candidates.best_sheets.func(found, own)
    assert [len(x) for x in every.to_pylist()] == [int(i % 5 > 0) for i in range(40)] and every[4].as_py()[0]["hit"] == [0, 1, 2, 3]
    monkeypatch.setattr(candidates, "TOGETHER", 3)
    assert candidates.best_sheets.func(found, own).equals(every)
    assert candidates.best_sheets.func(found.slice(0, 0), own.slice(0, 0)).to_pylist() == []


CELLS = [
    ("b", "F", 1, 1, "Name", None, "string"), ("b", "F", 1, 2, "5", None, "number"), ("b", "F", 600, 28, "=A1+B1", "7", "number"), ("b", "F", 3, 3, "=SUM(C3,A1)", None, "number"), ("b", "F", 4, 4, "=F!D4*2", None, "number"),
    ("b", "F", 4, 5, "='F'!E4", "0", "number"), ("b", "F", 4, 6, "=G!F4", None, "number"), ("b", "F", 5, 1, "", None, "string"), ("b", "F", 5, 2, None, None, "string"), ("b", "Q1", 1, 1, "text", None, "string"), ("b", "Q2", 1, 1, "=1", "1", "number"),
]


def test_segments_make_the_whole_text(spark):
    cells = spark.createDataFrame(CELLS, "workbook string, sheet string, row int, col int, raw string, cached string, v_type string")
    got = {}
    for r in sorted(grid.segments(cells).where("sheet = 'F'").collect(), key=lambda r: r.segment):
        got.setdefault(r.sheet, []).append(r.text)
    assert len(got["F"]) == 3
    assert "".join(got["F"]) == (
        "\n=== WORKSHEET: F ===\nUsed Range: A1:AB600\n  A1: \"Name\" [text] | B1: 5 [number]\n  C3: =SUM(C3,A1) [formula]\n"
        "  D4: =F!D4*2 [formula] | E4: ='F'!E4 [=0] | F4: =G!F4 [formula]\n  AB600: =A1+B1 [=7]\n"
    )
    assert sorted(r.address for r in grid.self_references(cells).collect()) == ["C3", "D4", "E4"]
    sheets_of = spark.createDataFrame([("b", s) for s in ("F", "Q1", "Q2", "Q3", "Quote", "Q")] + [("c", "F")], "workbook string, sheet string")
    assert sorted(r.sheet for r in grid.unanswered(sheets_of, cells).collect()) == ["Q1", "Q3"]
    assert sorted(map(tuple, grid.solution_report(sheets_of, cells).collect())) == [("b", 6, 6, 3, 2), ("c", 1, 0, 0, 0)]
    assert grid.segments(cells.limit(0)).collect() == [] and grid.solution_report(sheets_of.limit(0), cells).collect() == []


def test_a_profile_passes_on_three_values_of_a_column(spark):
    cells = spark.range(5_000).select(F.lit("b").alias("workbook"), F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row"), (F.col("id") % 2).alias("col"), F.col("id").cast("string").alias("raw"), F.lit("number").alias("v_type"))
    out = sheets.column_profile(cells)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("b", "s", 0, "number", 2_500, ["0", "2", "4"]), ("b", "s", 1, "number", 2_500, ["1", "3", "5"])]


@pytest.mark.parametrize("block", [4_096, 7, 1])
def test_blocks_of_sheets_dealt_in_pieces(spark, block):
    """Rows are read one after the other by few tasks, not a group for each band of rows; where pieces begin makes no difference."""

    def plain(have):
        seen, out = set(), []
        for r, c in sorted(have):
            if (r, c) not in seen:
                right, down = c, r
                while (r, right + 1) in have:
                    right += 1
                while all((down + 1, k) in have for k in range(c, right + 1)):
                    down += 1
                seen.update((i, k) for i in range(r, down + 1) for k in range(c, right + 1))
                out.append((r, c, down, right))
        return out

    rng = random.Random(3)
    held = {f"s{n}": {(rng.randint(0, 30), rng.randint(1, 8)) for _ in range(most)} for n, most in enumerate([5, 40, 120, 200] * 4)}
    df = spark.createDataFrame([("w", s, r, c, "x") for s, have in held.items() for r, c in [*have, *list(have)[:2]]], "workbook string, sheet string, row int, col int, raw string")
    found = sheets.blocks(df, block)
    assert sorted(map(tuple, found.collect())) == sorted(("w", s, *b) for s, have in held.items() for b in plain(have))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_formulas_that_differ_only_in_references_are_parsed_once(spark):
    from tallyweave.functions import evaluation

    one, other = evaluation.template('=SUM(A1:B1)*2&"A1"'), evaluation.template('=SUM($A$7:B9)*2&"A1"')
    assert one[0] == other[0] == 'SUM(_ref(0))*2&"A1"' and (one[1], other[1]) == ([(1, 1, 1, 2)], [(7, 1, 9, 2)])
    rows = [("w", f"s{n}", r, c, f"={'J' if c == 11 else 'A'}{r}*{2}" if c > 9 else str(n + r)) for n in range(40) for r in range(5) for c in (1, 10, 11)]
    found = evaluation.evaluate(spark.createDataFrame([*rows, ("w", "s0", 9, 1, "=_ref(0)")], "workbook string, sheet string, row int, col int, raw string"))
    want = {("w", f"s{n}", r, c): str((n + r) * (2 if c == 10 else 4)) for n in range(40) for r in range(5) for c in (10, 11)} | {("w", "s0", 9, 1): None}
    assert {tuple(r)[:4]: r.value for r in found.collect()} == want and "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_letters_are_a_short_expression(spark):
    from tallyweave.operators.scoring import check_letter

    letters = check_letter("i")
    want = {None: "", -3: "", 0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA", 12356630: "AAAAAA"}
    df = spark.createDataFrame([(i,) for i in want], "i long")
    assert {r.i: r.x for r in df.select("i", letters.alias("x")).collect()} == want
    assert len(df.select(letters.alias("x"))._jdf.queryExecution().analyzed().toString()) < 20_000


def test_formulas_behind_rows_and_report_read_cells_once(spark):
    rows = [("w", "F", 3, 2, "", "a"), ("w", "F", 3, 4, "x", "b"), ("w", "F", 3, 5, "y", "c"), ("w", "F", 4, 1, "", "d"), ("w", "F", 6, 1, None, "e"), ("w", "Q1", 3, 1, "z", "f")]
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, raw string, cached string")
    made = F.struct(F.lit(8).alias("col"), F.concat(F.lit("=H"), F.col("row").cast("string")).alias("raw"))
    got = sheets.behind_rows(cells, made, where=F.col("sheet") == "F")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*rows, ("w", "F", 3, 8, "=H3", None)], key=repr)
    report = grid.solution_report(cells.select("workbook", "sheet").distinct(), got)
    assert sorted(map(tuple, report.collect())) == [("w", 2, 1, 1, 1)]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_means_without_quantiles_sort_nothing_but_the_join(spark):
    rows = [(f"k{i % 3}" if i % 7 else None, float(i)) for i in range(200)] + [("k9", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    whole, means = stats.stat_summary(df, ["k"], "v").select("k", "n", "mean", "sem"), stats.mean_summary(df, ["k"], "v")
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, means.collect()), key=repr)
    for found in (whole, means):
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_references_of_a_formula_are_looked_for_once(spark):
    from tallyweave.functions import formulas

    df = spark.createDataFrame([("=SUM(A1:B3)", "B2"), ("=B2+1", "B2"), ("=S!B2", "B2"), ("=A1", "B2"), (None, "B2")], "f string, c string")
    found = df.select("f", formulas.validation("f", F.col("c")).alias("v"))
    assert {r.f: r.v.valid for r in found.collect() if r.f} == {"=SUM(A1:B3)": False, "=B2+1": False, "=S!B2": False, "=A1": True}
    assert found._jdf.queryExecution().analyzed().toString().count("'[^']+'![A-Z]+") <= 2
