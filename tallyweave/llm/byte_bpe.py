"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

Spark deals the documents out; a task splits its texts into pieces, and each distinct piece becomes rows
(piece, position, token). A recursive query joins neighbouring tokens with the merge table and contracts the
leftmost pair of minimum rank of each piece, until no piece holds a pair of the table. Ordered aggregation
then gives each piece's ids. Documents are decoded from their ids alone: joined with the vocabulary and
aggregated in order of position.

The rows of a recursive query grow with the square of a piece. A piece of more than BLOCK bytes is therefore cut into blocks
that are contracted one by one, and so is a window around each seam. A sequence of tokens is what contraction gives
wherever every two neighbours are what contraction gives for the two alone; neighbours in a contracted piece always are. So where the blocks and
the window share a token on both sides of a seam, what follows the one and precedes the other is taken from the window. A seam that shares
none is given up and its blocks become one: that is so in runs of few characters (dots, zeros, spaces), which have few different pairs. Such a block is contracted
rank by rank: each step contracts all places of the pair of minimum rank, from the left up to the first that makes a pair of a lower rank, which is the order of one at a time.

Null texts count as empty; empty texts have no tokens. Texts of any length are coded whole. Repeated rows are coded alike, null
ids and columns of clashing names pass by or are left out (only the id is carried along). Ties of rank are the same pair: the leftmost goes first.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyweave.llm.common import map_texts

#: Pieces that one recursive query contracts at a time, and pieces whose ids a worker remembers.
PIECES_AT_ONCE, REMEMBERED = 50_000, 800_000
#: Bytes of a block of a long piece; the sum of squares of the pieces' bytes in one recursive query (its rows are half as many at most); tokens decoded by one query, and in one group.
BLOCK, SQUARES, DECODED, SEGMENT = 128, 4_000_000, 500_000, 65_536
#: Megabytes that DuckDB may take, and bytes for each row of a run that needs more.
MEMORY, BYTES_A_ROW = 400, 1_500
#: Characters of text that a task tokenizes at a time.
CHUNK = 16_000_000

CONTRACT = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE step(it, piece, pos, tok, next_pos, next_tok) AS (
    SELECT 0, piece, pos, tok,
           lead(pos) OVER (PARTITION BY piece ORDER BY pos), lead(tok) OVER (PARTITION BY piece ORDER BY pos)
    FROM tokens
  UNION ALL
    SELECT s.it + 1, s.piece, s.pos,
           CASE WHEN s.pos = best.pos THEN best.id ELSE s.tok END,
           CASE WHEN s.pos = best.pos THEN gone.next_pos ELSE s.next_pos END,
           CASE WHEN s.pos = best.pos THEN gone.next_tok WHEN s.next_pos = best.pos THEN best.id ELSE s.next_tok END
    FROM step s
    JOIN (SELECT piece,
                 min(id * 4294967296 + pos) & 4294967295 AS pos,
                 min(id * 4294967296 + pos) >> 32 AS id,
                 arg_min(next_pos, id * 4294967296 + pos) AS gone_pos
          FROM step JOIN merges ON pair = tok * 65536 + next_tok
          GROUP BY piece) best ON s.piece = best.piece
    LEFT JOIN step gone ON gone.piece = best.piece AND gone.pos = best.gone_pos AND s.pos = best.pos
    WHERE s.pos <> best.gone_pos
)
SELECT step.piece, step.pos, step.tok
FROM step JOIN (SELECT piece, max(it) AS it FROM step GROUP BY piece) ended USING (piece, it)
"""
#: The same, all places of a rank in one step. A step replaces the rows of the one before, so what is held grows with the piece alone.
CONTRACT_RUNS = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE step(piece, pos, it, tok) USING KEY (piece, pos) AS (
    SELECT piece, pos, 0, tok FROM tokens
  UNION
    (WITH pairs AS (
        SELECT piece, pos, it, tok, id, row_number() OVER w AS n, lag(tok) OVER w AS before, lead(tok, 2) OVER w AS behind
        FROM (SELECT piece, pos, it, tok, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS next_tok FROM step) s
        LEFT JOIN merges ON pair = tok * 65536 + next_tok
        WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    least AS (SELECT *, min(id) OVER (PARTITION BY piece) AS best FROM pairs),
    hits AS (SELECT *, id IS NOT DISTINCT FROM best AS hit, n - row_number() OVER (PARTITION BY piece, id IS NOT DISTINCT FROM best ORDER BY pos) AS run FROM least WHERE best IS NOT NULL),
    chosen AS (SELECT *, hit AND row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1 AS taken FROM hits),
    around AS (SELECT *, CASE WHEN lag(taken, 2, false) OVER w THEN best ELSE before END AS left_tok FROM chosen WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    judged AS (
        SELECT a.*, min(CASE WHEN taken AND (l.id < best OR r.id < best) THEN pos END) OVER (PARTITION BY piece) AS last
        FROM around a LEFT JOIN merges l ON taken AND l.pair = left_tok * 65536 + best LEFT JOIN merges r ON taken AND r.pair = best * 65536 + behind),
    done AS (SELECT *, taken AND pos <= coalesce(last, pos) AS merged FROM judged)
    SELECT piece, pos, it + 1, CASE WHEN merged THEN best ELSE tok END
    FROM (SELECT *, lag(merged, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS gone FROM done) d WHERE NOT gone)
)
SELECT step.piece, step.pos, step.tok
FROM step JOIN (SELECT piece, max(it) AS it FROM step GROUP BY piece) ended USING (piece, it)
"""
#: Each piece's ids in order of position.
COLLECT = "SELECT piece, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids FROM coded GROUP BY piece"
#: The bytes (in hexadecimal) of each segment of each document, in order of position.
DECODE = "SELECT n, segment, string_agg(hex, '' ORDER BY pos) AS hex FROM written JOIN vocabulary USING (tok) GROUP BY n, segment ORDER BY n, segment"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """One worker's database with the merge table, and what it remembers of pieces seen before."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.pieces_of = regex.compile(pattern).findall
        self.length = {i: len(token) for token, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        merges = [
            (left * 65536 + right, i)
            for token, i in self.ranks.items()
            for k in range(1, len(token))
            if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None
        ]
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{MEMORY}MB'")
        self.db.execute("SET temp_directory = ''")  # nothing is written beside the worker: what one query holds is bounded
        self._load("merges", pair=[m[0] for m in merges], id=[m[1] for m in merges])
        self._load("vocabulary", tok=list(self.ranks.values()), hex=[t.hex() for t in self.ranks])
        self.remembered, self.pieces_at_once = REMEMBERED, PIECES_AT_ONCE
        self.ids: dict[str, str] = {}

    def _load(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, pieces: list[bytes], query: str = CONTRACT) -> list[str]:
        """Each piece's ids, joined by spaces, from recursive queries over some pieces at a time."""
        out, begin = [""] * len(pieces), 0
        costs = np.cumsum([len(raw) ** 2 if query is CONTRACT else len(raw) * 64 for raw in pieces])
        while begin < len(pieces):
            done = costs[begin - 1] if begin else 0
            end = min(begin + self.pieces_at_once, max(begin + 1, int(np.searchsorted(costs, done + SQUARES, side="right"))))
            part = pieces[begin:end]
            size = np.array([len(raw) for raw in part])
            first = np.cumsum(size) - size
            data = np.frombuffer(b"".join(part), dtype=np.uint8)
            self._load("tokens", piece=np.repeat(np.arange(len(part)), size), pos=np.arange(len(data)) - np.repeat(first, size), tok=self.byte_ids[data])
            self._run(query)
            got = self.db.sql(COLLECT).to_arrow_table()
            for i, ids in zip(got.column("piece").to_pylist(), got.column("ids").to_pylist(), strict=True):
                out[begin + i] = ids
            begin = end
        return out

    def _run(self, query: str) -> None:
        """A query; where its memory does not do (one run of millions of bytes), again with as much as that run needs. Nothing is spilled to a folder."""
        try:
            self.db.execute(query)
        except duckdb.OutOfMemoryException:
            (n,) = self.db.execute("SELECT count(*) FROM tokens").fetchone()
            self.db.execute(f"SET memory_limit = '{MEMORY + n * BYTES_A_ROW // 1_000_000}MB'")
            try:
                self.db.execute(query)
            finally:
                self.db.execute(f"SET memory_limit = '{MEMORY}MB'")

    def spans(self, ids: str, begin: int) -> list[tuple[int, int, str]]:
        """(begin, end, id) of each token, in bytes from `begin` on."""
        out = []
        for t in ids.split(" "):
            out.append((begin, begin + self.length[int(t)], t))
            begin = out[-1][1]
        return out

    def long_pieces(self, pieces: list[bytes]) -> list[str]:
        """The ids of pieces longer than a block, from their blocks and a window around each seam. Seams that can't be proved are given up, round by round."""
        seams = {i: list(range(BLOCK, len(raw), BLOCK)) for i, raw in enumerate(pieces)}
        out, known = [""] * len(pieces), {}
        while seams:
            spans = {i: list(zip([0, *own], [*own, len(pieces[i])], strict=True)) for i, own in seams.items()}
            self._contract_spans(pieces, spans, known)
            around = {i: [self._window(known[i, *left], known[i, *right], left[1]) for left, right in zip(own[:-1], own[1:], strict=True)] for i, own in spans.items()}
            self._contract_spans(pieces, around, known)
            for i in list(seams):
                ids, unproved = self._assembled(seams[i], [known[i, *x] for x in spans[i]], [known[i, *x] for x in around[i]])
                if unproved:
                    seams[i] = [s for s in seams[i] if s not in unproved]
                else:
                    out[i] = ids
                    del seams[i]
        return out

    def _contract_spans(self, pieces: list[bytes], wanted: dict[int, list[tuple[int, int]]], known: dict) -> None:
        """Contract the spans that are not known yet: short ones pair by pair, the others rank by rank."""
        new = [(i, a, b) for i, own in wanted.items() for a, b in own if (i, a, b) not in known]
        for query, some in ((CONTRACT, [x for x in new if x[2] - x[1] <= 2 * BLOCK]), (CONTRACT_RUNS, [x for x in new if x[2] - x[1] > 2 * BLOCK])):
            for (i, a, b), ids in zip(some, self.contract([pieces[i][a:b] for i, a, b in some], query), strict=True):
                known[i, a, b] = self.spans(ids, a)

    @staticmethod
    def _window(left: list, right: list, seam: int) -> tuple[int, int]:
        """From a token's begin, half a block before the seam at most, to a token's end half a block after it."""
        begin = next((a for a, _, _ in left if a >= seam - BLOCK // 2), left[-1][0])
        return begin, next((b for _, b, _ in right if b >= seam + BLOCK // 2), right[-1][1])

    @staticmethod
    def _assembled(seams: list[int], blocks: list[list], windows: list[list]) -> tuple[str, set[int]]:
        """The ids of a piece, and the seams at which blocks and window share no token on either side."""
        out, left, unproved = [], blocks[0], set()
        for seam, window, right in zip(seams, windows, blocks[1:], strict=True):
            on_left, on_right = set(left), set(right)
            before = [t for t in window if t[1] <= seam and t in on_left]
            after = [t for t in window if t[0] >= seam and t in on_right]
            if not before or not after:
                unproved.add(seam)
                left = right
                continue
            x, y = before[0], after[-1]
            out += [t for t in left if t[1] <= x[1]] + [t for t in window if t[0] >= x[1] and t[1] <= y[1]]
            left = [t for t in right if t[0] >= y[1]]
            if not left:
                left = [y]
                out.pop()
        return " ".join([t for _, _, t in [*out, *left]]), unproved

    def learn(self, pieces: set[str]) -> None:
        """Contract the pieces that are not known yet."""
        new = pieces - self.ids.keys()
        if len(self.ids) + len(new) > self.remembered:
            self.ids.clear()
            new = pieces
        raws = {p: p.encode("utf-8", "surrogatepass") for p in new}
        for p, raw in raws.items():
            if (whole := self.ranks.get(raw)) is not None:  # one token as it stands
                self.ids[p] = str(whole)
        for long, by in ((False, self.contract), (True, self.long_pieces)):
            todo = [p for p, raw in raws.items() if p not in self.ids and (len(raw) > BLOCK) == long]
            self.ids.update(zip(todo, by([raws[p] for p in todo]), strict=True))

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        out, begin = [b""] * len(rows), 0
        ends = np.cumsum([len(r) for r in rows])
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + DECODED, side="right")))
            size = np.array([len(r) for r in rows[begin:end]])
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("written", pa.table({"n": np.repeat(np.arange(begin, end), size), "segment": pos // SEGMENT, "pos": pos, "tok": np.concatenate(rows[begin:end])}))
            parts: dict[int, list[bytes]] = {}
            for n, _, h in self.db.execute(DECODE).fetchall():
                parts.setdefault(n, []).append(bytes.fromhex(h))
            self.db.unregister("written")
            for n, own in parts.items():
                out[n] = b"".join(own)
            begin = end
        return out

    def code(self, texts: list[str | None]) -> list[tuple[str, np.ndarray, bytes]]:
        """Per text: its ids joined by one space, the ids, and the bytes decoded from them."""
        split = [self.pieces_of(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        ids = self.ids
        joined = [" ".join([ids[p] for p in pieces]) for pieces in split]
        rows = [np.fromstring(j, dtype=np.int64, sep=" ") for j in joined]
        return list(zip(joined, rows, self.decode(rows), strict=True))


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder; a worker keeps it from task to task."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True, chunk: int = CHUNK, remembered: int = REMEMBERED, pieces_at_once: int = PIECES_AT_ONCE) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded binary]) of every row of `docs`.

    `path` is a .tiktoken file that every worker can read, `pattern` the regular expression that splits texts into
    pieces. `arrays` adds the ids and the decoded bytes themselves. `chunk` characters are tokenized at a time,
    `pieces_at_once` contracted by one query and `remembered` kept: all bound a worker's memory and change no result.
    """
    def work():
        own = coder(path, pattern)
        own.remembered, own.pieces_at_once = remembered, pieces_at_once

        def code(texts):
            rows = own.code(texts)
            out = {
                "n_tokens": [len(r[1]) for r in rows],
                "ids_sha256": [hashlib.sha256(r[0].encode()).hexdigest() for r in rows],
                "decoded_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows],
            }
            return out | ({"ids": [r[1].astype(np.int32) for r in rows], "decoded": [r[2] for r in rows]} if arrays else {})

        return code

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * arrays
    return map_texts(docs, work, columns, id_col, text_col, chunk)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows that hold arrays of ids; bytes that are no UTF-8 become U+FFFD, null arrays become empty texts."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            rows = [np.array(r or [], dtype=np.int64) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b.decode("utf-8", "replace") for b in own.decode(rows)], pa.string())], ["id", "text"])

    return coded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
