"""Fill-in-the-middle: texts cut at two code points and put together again around sentinels, by a table-driven automaton over bytes.

One table holds everything that a scan has to know: how many continuation bytes of a code point are due, and how much of a sentinel has
been read (the states), and for each state and byte the next state and what the step counts (a code point begins, a sentinel ends). Texts are cut
into blocks of equal length, one lane each. The first scan runs all lanes at once from every state, since a lane does not know yet where the one
before it ends; chained, the lanes' mappings give each block's true first state, its code points and its sentinels. The second pass
finds the block that holds a cut from these counts and runs only such blocks again, to the byte.

Null texts count as empty; empty texts are plain. Texts of any length are cut whole, in memory proportional to the longest text. Repeated rows
are cut alike, for the cuts come from the id alone; a null id counts as an empty one. Bytes that are no UTF-8 count as a code point each. Extra columns are
left out, whatever they are called (only the id is carried along); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import give_back

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts without sentinels, those that are cut; of a hundred cut, those that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of a lane, and of the texts that are scanned at a time.
LANE, CHUNK = 256, 8_000_000
UNIT, SENTINEL = 0, 1


class Automaton:
    """The table over (state, byte): the next state, and the counts of a step, code points in the low and sentinels in the high half of a word.

    A state is a number of continuation bytes due and a prefix of a sentinel, so sentinels of any bytes are found (none may overlap another).
    Symbol 256 changes nothing: it fills the last lane of a text.
    """

    def __init__(self, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        for x in marks:
            for y in marks:
                if not x or (x != y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + (x != y)) if k < max(len(x), len(y))):
                    raise ValueError(f"sentinels must not be empty or overlap: {x!r}, {y!r}")
        self.marks = marks

        def after(read: bytes, b: int) -> tuple[bytes, bool]:
            read += bytes([b])
            while not any(m.startswith(read) for m in marks):
                read = read[1:]
            return (b"", True) if read in marks else (read, False)

        begin = (0, b"")
        order, rows = {begin: 0}, []
        for due, read in (todo := [begin]):  # grows while it is read
            row = []
            for b in range(256):
                goes_on = due > 0 and b & 0xC0 == 0x80
                left = due - 1 if goes_on else 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
                now, ended = after(read, b)
                if (left, now) not in order:
                    order[left, now] = len(order)
                    todo.append((left, now))
                row.append((order[left, now], (not goes_on) + (ended << 32)))
            rows.append(row)
        self.n = len(order)
        self.next = np.array([[s for s, _ in row] + [i] for i, row in enumerate(rows)], dtype=np.intp)
        self.count = np.array([[c for _, c in row] + [0] for row in rows], dtype=np.int64)


class Scan:
    """The first pass over texts that stand one after another in `data`, text i from ends[i] to ends[i + 1]."""

    def __init__(self, auto: Automaton, data: np.ndarray, ends: np.ndarray, lane: int = LANE):
        self.auto, self.data, self.ends, self.lane = auto, data, ends, lane
        blocks = -(-np.diff(ends) // lane)
        self.first = np.concatenate([[0], np.cumsum(blocks)])  # of each text's blocks
        owner = np.repeat(np.arange(len(blocks)), blocks)
        self.begins = ends[owner] + (np.arange(len(owner)) - self.first[owner]) * lane
        self.lengths = np.minimum(self.begins + lane, ends[owner + 1]) - self.begins
        state = np.repeat(np.arange(auto.n)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        for symbol in self.symbols(np.arange(len(owner))):
            at = state * 257 + symbol
            count += auto.count.ravel()[at]
            state = auto.next.ravel()[at]
        # chained: a text begins in state 0, a block where the one before it ended
        ended, self.entry, now = state.T.tolist(), np.zeros(len(owner), dtype=np.intp), 0
        begins_text = np.zeros(len(owner) + 1, dtype=bool)
        begins_text[self.first] = True
        for i, (new, to) in enumerate(zip(begins_text[:-1].tolist(), ended, strict=True)):
            now = 0 if new else now
            self.entry[i] = now
            now = to[now]
        own = count[self.entry, np.arange(len(owner))]
        self.upto = [np.concatenate([[0], np.cumsum(x)]) for x in (own & 0xFFFFFFFF, own >> 32)]  # before each block

    def symbols(self, blocks: np.ndarray) -> Iterator[np.ndarray]:
        """The lanes' bytes, position by position; 256 where a lane has ended."""
        begins, lengths = self.begins[blocks], self.lengths[blocks]
        for k in range(int(lengths.max(initial=0))):
            inside = k < lengths
            yield np.where(inside, self.data[np.where(inside, begins + k, 0)].astype(np.intp), 256)

    def totals(self, what: int) -> np.ndarray:
        """Code points or sentinels of each text."""
        return self.upto[what][self.first[1:]] - self.upto[what][self.first[:-1]]

    def locate(self, what: int, texts: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The second pass: the place in `data` where the code point `nth` (from 0) of each text begins, or behind its sentinel `nth`; the text's end where it has no more."""
        place = self.ends[texts + 1].copy()
        there = np.flatnonzero(nth < self.totals(what)[texts])
        wanted = self.upto[what][self.first[texts[there]]] + nth[there]
        blocks = np.searchsorted(self.upto[what], wanted, side="right") - 1
        state, seen = self.entry[blocks], self.upto[what][blocks].copy()
        for k, symbol in enumerate(self.symbols(blocks)):
            at = state * 257 + symbol
            counted = (self.auto.count.ravel()[at] >> (32 * what)) & 0xFFFFFFFF
            hit = (counted > 0) & (seen == wanted)
            place[there[hit]] = self.begins[blocks[hit]] + k + what
            seen += counted
            state = self.auto.next.ravel()[at]
        return place


def _texts(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, bytes, ends) of rows of a binary column whose values together stay near `limit` bytes. Null: empty."""
    column = batch.column(name).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
        yield begin, end, data[ends[begin] : ends[end]], ends[begin : end + 1] - ends[begin]
        begin = end


def draws(id_col: str, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers: the first four groups of eight hexadecimal digits of the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): n code points, form plain, psm or spm, and the text so arranged.

    The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger (`draws`). A text stays plain, with null
    lengths, if it is empty or holds a sentinel, or if h3 % 100 is `cut` or more; else the suffix comes first where h4 % 100 is under `suffix_first`.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    before_prefix, before_suffix, before_middle = (s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(sentinels)
        for batch in batches:
            drawn = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for a, b, data, ends in _texts(batch, "text", chunk):
                scan = Scan(auto, data, ends)
                n = scan.totals(UNIT)
                h1, h2, h3, h4 = (h[a:b] for h in drawn)
                plain = (n == 0) | (scan.totals(SENTINEL) > 0) | (h3 % 100 >= cut)
                low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                texts = np.flatnonzero(~plain)
                first, second = scan.locate(UNIT, texts, low[texts]), scan.locate(UNIT, texts, high[texts])
                raw, out, forms = data.tobytes(), [], np.where(plain, "plain", np.where(h4 % 100 < suffix_first, "spm", "psm")).tolist()
                cuts = iter(zip(first.tolist(), second.tolist(), strict=True))
                for form, begin, end in zip(forms, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if form == "plain":
                        out.append(raw[begin:end])
                        continue
                    x, y = next(cuts)
                    prefix, middle, suffix = raw[begin:x], raw[x:y], raw[y:end]
                    parts = (before_prefix, prefix, before_suffix, suffix) if form == "psm" else (before_suffix, suffix, before_prefix, prefix)
                    out.append(b"".join((*parts, before_middle, middle)))
                sizes = [pa.array(np.where(plain, 0, v), mask=plain) for v in (low, high - low)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), pa.array(forms), *sizes, pa.array(out, pa.binary())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *draws(id_col, seed))
    made = rows.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restore(made: DataFrame, form_col: str = "form", output_col: str = "output", to: str = "restored", sentinels: tuple[str, str, str] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """All columns of `made`, and the text that was cut, from its output and form alone. Outputs without the three sentinels in the order of their form give null, and so do nulls."""
    names = made.columns
    widths = {"psm": [len(sentinels[k].encode()) for k in (0, 1, 2)], "spm": [len(sentinels[k].encode()) for k in (1, 0, 2)]}
    orders = {"psm": [sentinels[k].encode() for k in (0, 1, 2)], "spm": [sentinels[k].encode() for k in (1, 0, 2)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(sentinels)
        for batch in batches:
            all_forms, there = batch.column("__form").to_pylist(), batch.column("__output").is_valid().to_pylist()
            for a, b, data, ends in _texts(batch, "__output", chunk):
                forms, raw = all_forms[a:b], data.tobytes()
                cut = np.flatnonzero([f in widths for f in forms])
                scan = Scan(auto, data, ends)
                found = scan.totals(SENTINEL)
                places = [scan.locate(SENTINEL, cut, np.full(len(cut), k)).tolist() for k in range(3)]
                out = [raw[x:y] if f == "plain" and ok else None for f, ok, x, y in zip(forms, there[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                for i, *behind in zip(cut.tolist(), *places, strict=True):
                    form, end = forms[i], int(ends[i + 1])
                    begins = [p - w for p, w in zip(behind, widths[form], strict=True)]
                    if found[i] != 3 or begins[0] != ends[i] or [raw[x:p] for x, p in zip(begins, behind, strict=True)] != orders[form]:
                        continue
                    one, two, middle = raw[behind[0] : begins[1]], raw[behind[1] : begins[2]], raw[behind[2] : end]
                    out[i] = one + middle + two if form == "psm" else two + middle + one
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(len(names))), pa.array(out, pa.binary())], [*(f"c{i}" for i in range(len(names))), "restored"])
        give_back()

    kinds = ", ".join(f"c{i} {made.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    rows = made.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(form_col).alias("__form"), F.col(output_col).cast("binary").alias("__output"))
    back = rows.mapInArrow(run, f"{kinds}, restored binary")
    return back.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("restored").cast("string").alias(to))


def query_digest(made: DataFrame) -> DataFrame:
    """The columns of the query: digests of the output and of the text restored from it."""
    return restore(made).withColumns({"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(F.col("restored").cast("binary"), 256)}).drop("output", "restored")
