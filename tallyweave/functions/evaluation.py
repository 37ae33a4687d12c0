"""Evaluation of cell formulas, a workbook's sheet at a time."""

from __future__ import annotations

import ast
import functools
import math
import operator
import re
import statistics

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")
SPAN = re.compile(r"\$?([A-Z]{1,3})\$?(\d+):\$?([A-Z]{1,3})\$?(\d+)")
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def number_of(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


def flat(args) -> list:
    return [x for a in args for x in (flat(a) if isinstance(a, list) else [a])]


def numbers(args) -> list:
    return [x for x in flat(args) if isinstance(x, int | float) and not isinstance(x, bool)]


def _sumproduct(*arrays):
    rows = [numbers(a if isinstance(a, list) else [a]) for a in arrays]
    return sum(math.prod(t) for t in zip(*rows, strict=False))


#: What formulas may call; text, booleans and blanks take no part in sums and means. AND and OR take a range as one argument, true if it has cells, whatever they hold.
FUNCTIONS = {
    "SUM": lambda *a: sum(numbers(a)),
    "AVERAGE": lambda *a: statistics.fmean(n) if (n := numbers(a)) else None,
    "MEAN": lambda *a: statistics.fmean(n) if (n := numbers(a)) else None,
    "MIN": lambda *a: min(numbers(a), default=None),
    "MAX": lambda *a: max(numbers(a), default=None),
    "COUNT": lambda *a: len(numbers(a)),
    "COUNTA": lambda *a: sum(x is not None and x != "" for x in flat(a)),
    "STDEV": lambda *a: statistics.stdev(n) if len(n := numbers(a)) > 1 else None,
    "STDEVP": lambda *a: statistics.pstdev(n) if (n := numbers(a)) else None,
    "MEDIAN": lambda *a: statistics.median(n) if (n := numbers(a)) else None,
    "SUMPRODUCT": _sumproduct,
    "ABS": abs, "SQRT": math.sqrt, "POWER": lambda a, b: a**b, "EXP": math.exp, "LN": math.log,
    "LOG": lambda x, base=10: math.log(x, base), "ROUND": lambda x, n=0: round(x, int(n)),
    "IF": lambda test, yes=True, no=False: yes if test else no,
    "AND": lambda *a: all(a), "OR": lambda *a: any(a),
}


#: What a formula's text is split into: texts in double quotes, ranges, cells.
PART = re.compile(rf'("[^"]*")|{SPAN.pattern}|{CELL.pattern}')
TEXT = re.compile(r'("[^"]*")')
#: Formulas that differ only in what they refer to that a worker keeps in compiled form.
KEPT = 4_096


def template(formula: str) -> tuple[str, list]:
    """A formula with numbers for what it refers to, and these: (row, column) of a cell, (row, column, row, column) of a range. Texts in double quotes stay as they are."""
    refs = []
    if "_ref" in formula and any("_ref" in x for x in TEXT.split(formula)[::2]):
        return "()", refs  # no function has that name: no value

    def number(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        refs.append((int(m[3]), number_of(m[2]), int(m[5]), number_of(m[4])) if m[2] is not None else (int(m[7]), number_of(m[6])))
        return f"_ref({len(refs) - 1})"

    return PART.sub(number, formula[1:]), refs


def tree(text: str):
    """The syntax tree of a template."""
    parts = TEXT.split(text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![<>=])=(?!=)", "==", parts[i].replace("<>", "!=")).replace("^", "**")
    return ast.parse("".join(parts).strip(), mode="eval").body


def compiled(node):
    """A syntax tree as a function of the values of its references. What formulas may not hold raises ValueError or KeyError."""
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float | str | bool):
        value = node.value
        return lambda refs: value
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        op, left, right = BINARY[type(node.op)], compiled(node.left), compiled(node.right)
        return lambda refs: op(left(refs), right(refs))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        op, x = operator.neg if isinstance(node.op, ast.USub) else operator.pos, compiled(node.operand)
        return lambda refs: op(x(refs))
    if isinstance(node, ast.Compare):
        ops, sides = [COMPARE[type(op)] for op in node.ops], [compiled(x) for x in (node.left, *node.comparators)]

        def compared(refs) -> bool:
            values = [side(refs) for side in sides]
            return all(op(a, b) for op, a, b in zip(ops, values, values[1:], strict=False))

        return compared
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        if node.func.id == "_ref":
            at = node.args[0].value
            return lambda refs: refs[at]
        f, args = FUNCTIONS[node.func.id.upper()], [compiled(a) for a in node.args]
        return lambda refs: f(*[a(refs) for a in args])
    if isinstance(node, ast.Name) and node.id.upper() in ("TRUE", "FALSE"):
        value = node.id.upper() == "TRUE"
        return lambda refs: value
    raise ValueError(f"not allowed: {ast.dump(node)[:40]}")


@functools.lru_cache(KEPT)
def prepared(text: str) -> tuple:
    """(function or None, numbers of the references that count) of a template: parsed once for all formulas that share it."""
    try:
        node = tree(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, ()
    calls = (n for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "_ref")
    try:
        used = tuple(sorted({n.args[0].value for n in calls}))
        return compiled(node), used
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return None, used


class Sheet:
    """The cells of a sheet, {(row, column): value or text of a formula}.

    Formulas are evaluated in the order of what they refer to, whatever the length of a chain. A formula that leads back to itself, or
    to one that does, has no value (None), and so has one that can't be evaluated: the result does not depend on the order of the cells.
    """

    def __init__(self, cells: dict):
        self.cells = cells
        self.formulas = {at for at, raw in cells.items() if isinstance(raw, str) and raw.startswith("=")}
        self.known: dict = dict.fromkeys(self.formulas)
        found, waits, users, ready = {}, {}, {}, []
        for at in self.formulas:
            text, refs = template(cells[at])
            f, used = prepared(text)
            found[at] = f, refs
            needs = self.needed([refs[i] for i in used])
            if not needs:
                ready.append(at)
                continue
            waits[at] = len(needs)
            for other in needs:
                users.setdefault(other, []).append(at)
        while ready:
            at = ready.pop()
            f, refs = found[at]
            if f is not None:
                try:
                    self.known[at] = f([self.value(r) if len(r) == 2 else self.span(*r) for r in refs])
                except (ArithmeticError, ValueError, TypeError, KeyError, RecursionError):
                    self.known[at] = None
            for user in users.get(at, ()):
                waits[user] -= 1
                if not waits[user]:
                    ready.append(user)

    def needed(self, refs: list) -> set:
        """The formula cells that references lead to."""
        out = set()
        for ref in refs:
            if len(ref) == 2:
                if ref in self.formulas:
                    out.add(ref)
                continue
            r1, c1, r2, c2 = ref
            rows, cols = range(min(r1, r2), max(r1, r2) + 1), range(min(c1, c2), max(c1, c2) + 1)
            if len(rows) * len(cols) > len(self.formulas):
                out.update(at for at in self.formulas if at[0] in rows and at[1] in cols)
            else:
                out.update((r, c) for r in rows for c in cols if (r, c) in self.formulas)
        return out

    def value(self, at):
        """A cell's value; None for an empty cell and for a formula without one."""
        return self.known[at] if at in self.formulas else self.cells.get(at)

    def span(self, r1: int, c1: int, r2: int, c2: int) -> list:
        return [self.value((r, c)) for r in range(min(r1, r2), max(r1, r2) + 1) for c in range(min(c1, c2), max(c1, c2) + 1)]


def parsed(raw: str | None):
    """A cell's text as a number, boolean or text."""
    if raw is None or raw == "" or raw.startswith("="):
        return raw or None
    if raw.isdecimal() and len(raw) < 4_000:
        return int(raw)
    if raw.upper() in ("TRUE", "FALSE"):
        return raw.upper() == "TRUE"
    try:
        return int(raw) if re.fullmatch(r"-?\d+", raw) else float(raw)
    except ValueError:
        return raw


def evaluate(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, col, value) of every formula of cells (…, raw): its value as text, NULL where it can't be evaluated.

    A formula may need any cell of its sheet, so a task holds a sheet at a time; it reads many, one after the other.
    """
    columns = ["workbook", "sheet", "row", "col", "value"]

    def told(key: tuple, held: list) -> list:
        sheet = Sheet({(r, c): parsed(raw) for r, c, raw in held})
        values = [(r, c, sheet.value((r, c))) for r, c, raw in held if raw is not None and raw.startswith("=")]
        return [(*key, r, c, None if v is None or isinstance(v, list) else str(v)) for r, c, v in values]

    def run(parts):
        key, held, out = None, [], []
        for part in parts:
            for workbook, sheet, *cell in zip(*(part[c].to_pylist() for c in ("workbook", "sheet", "row", "col", "raw")), strict=True):
                if (workbook, sheet) != key:
                    out += told(key, held)
                    key, held = (workbook, sheet), []
                held.append(cell)
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
        yield batch(out + told(key, held))

    def batch(rows: list) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(values, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], columns)

    dealt = cells.select("workbook", "sheet", F.col("row").cast("int"), F.col("col").cast("int"), "raw").repartition("workbook", "sheet").sortWithinPartitions("workbook", "sheet")
    return dealt.mapInArrow(run, "workbook string, sheet string, row int, col int, value string")
