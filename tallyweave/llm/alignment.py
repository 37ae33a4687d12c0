"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how well linked tokens agree over the corpus.

Every byte of a text gets a label: no token ends there, one of A, one of B, or both. A regular expression scans the label string
for spans up to each label of both; the labels in a span count the tokens of its group. Within a group, A's and B's tokens overlap along one
staircase, so its links (overlapping pairs) are one for each byte at which a token ends.

Both vocabularies break a text at the cuts of `units`, so each unit's groups and links are found once in a worker and put together by text.

How many documents hold a pair of ids linked is counted in blocks of documents first: a task sends each pair of a block once. Pairs
are summed, compared with the best of their A id, and go back to the blocks that hold them; there each document's links, kept in the
shared folder as places in the block's list, are summed. No pair has more rows than there are blocks, so none is hot.

Null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens: zeros, and an empty text of groups.
Texts of any length are aligned whole, repeated rows one by one (each is a document of its own), null ids too. Ties for the best count all count as best. Extra columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.llm.common import give_back, in_chunks, map_texts, materialize
from tallyweave.llm.units import TOGETHER, ByteLevel, Pieces, byte_ends, spaced_units, units

#: Characters of the documents of one block; units that a worker remembers.
CHUNK, REMEMBERED = 3_000_000, 350_000
#: Labels by the bits "A ends here" and "B ends here".
LABELS = np.frombuffer(b"nabx", dtype=np.uint8)
SPAN = re.compile(rb"[^x]*x")
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """One worker's two vocabularies, and what it remembers of units: counts, the text of their groups, and their links as numbers in `pairs`."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        self.a, self.b, self.remembered = ByteLevel(path_a, plain=True), Pieces(path_b), remembered
        self.size_b = len(self.b.tokens)
        #: The text of each id with what follows it in a group's text.
        self.written = [f"{i}{mark}" for i in range(max(len(self.a.tokens), self.size_b)) for mark in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.spans: dict[bytes, tuple[int, int]] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.counted = [np.zeros((0, 5), dtype=np.int64)]  # of tokens of A and B, groups, links; whether the bytes are the text's

    def labels(self, ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> np.ndarray:
        """The label of each of n bytes, from the places behind tokens' last bytes."""
        bits = np.zeros(n, dtype=np.uint8)
        bits[ends_a - 1] |= 1
        bits[ends_b - 1] |= 2
        return LABELS[bits]

    def learn(self, new: list[str]) -> None:
        """Align units, each as if a space stood before it. Those without white space at an edge are encoded in one text; where that does not give back the bytes, one by one."""
        together, alone = [u for u in new if u == u.strip()], [u for u in new if u != u.strip()]
        for first in range(0, len(together), TOGETHER):
            part = together[first : first + TOGETHER]
            ends = byte_ends(part)
            got = [spaced_units(v, part, ends) for v in (self.a, self.b)]
            raw = f" {' '.join(part)}".encode("utf-8", "surrogatepass")
            if any(g is None or b"".join(map(v.tokens.__getitem__, g[0].tolist())) != raw for g, v in zip(got, (self.a, self.b), strict=True)):
                alone += part
                continue
            self._add(part, *got[0], *got[1], np.ones(len(part), dtype=np.int64), len(raw))
        for first in range(0, len(alone), TOGETHER):
            part = alone[first : first + TOGETHER]
            tokens = [v.spaced(part) for v in (self.a, self.b)]
            raw = [f" {u}".encode("utf-8", "surrogatepass") for u in part]
            exact = [all(b"".join(map(v.tokens.__getitem__, x)) == r for v, x in ((self.a, x), (self.b, y))) for r, x, y in zip(raw, *tokens, strict=True)]
            kept = [[x if ok else [] for x, ok in zip(side, exact, strict=True)] for side in tokens]
            flat = [(np.array([t for x in side for t in x], dtype=np.int64), np.array([len(x) for x in side], dtype=np.int64)) for side in kept]
            self._add(part, *flat[0], *flat[1], np.array(exact, dtype=np.int64), sum(len(r) for r, ok in zip(raw, exact, strict=True) if ok))

    def _add(self, new: list[str], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, exact: np.ndarray, n_bytes: int) -> None:
        """Remember units from their tokens, whose bytes are the units' where `exact`, and none elsewhere."""
        labels = self.labels(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]), n_bytes)
        # groups: spans of the label string, each with its labels' counts
        found = SPAN.findall(labels.tobytes())
        for span in set(found) - self.spans.keys():
            self.spans[span] = span.count(b"a") + 1, span.count(b"b") + 1
        p, q = np.array([self.spans[s] for s in found], dtype=np.int64).reshape(-1, 2).T
        order = np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        order[np.arange(len(ids_a)) + np.repeat(np.cumsum(q) - q, p)] = ids_a * 3
        order[np.arange(len(ids_b)) + np.repeat(np.cumsum(p), q)] = ids_b * 3
        last = np.cumsum(p + q)
        order[last - q - 1] += 1
        order[last - 1] += 2
        texts = [self.written[k] for k in order.tolist()]
        # links: the tokens of both sides at each byte where one ends
        at = labels[labels != LABELS[0]]
        in_a, in_b = at != LABELS[2], at != LABELS[1]
        left, right = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        names, back = np.unique(ids_a[left] * self.size_b + ids_b[right], return_inverse=True)
        links = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in names.tolist()], dtype=np.int32)[back].tobytes() if len(names) else b""
        # by unit
        unit = np.repeat(np.arange(len(new)), n_a)[left]
        n_links, n_groups = np.bincount(unit, minlength=len(new)), np.bincount(unit[at == LABELS[3]], minlength=len(new))
        cuts = [[0, *np.cumsum(n).tolist()] for n in (n_a + n_b, 4 * n_links)]
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += ["".join(texts[x:y]) for x, y in zip(cuts[0][:-1], cuts[0][1:], strict=True)]
        self.links += [links[x:y] for x, y in zip(cuts[1][:-1], cuts[1][1:], strict=True)]
        self.counted.append(np.stack([n_a, n_b, n_groups, n_links, exact], axis=1))

    def of(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's units; none for texts that have no tokens."""
        split = [(units(t) if self.b.divisible else [t]) if t else [] for t in texts]
        held = set().union(*split)
        if len(self.known.keys() | held) > self.remembered:
            self.forget()
        self.learn([u for u in held if u not in self.known])
        numbers = [[self.known[u] for u in s] for s in split]
        wrong = set(np.flatnonzero(self.counts[:, 4] == 0).tolist())
        doubtful = [i for i, own in enumerate(numbers) if wrong and not wrong.isdisjoint(own)]
        self.learn([t for t in {texts[i] for i in doubtful} if t not in self.known])
        for i in doubtful:  # the whole text decides
            whole = self.known[texts[i]]
            numbers[i] = [whole] if self.counts[whole, 4] else []
        return numbers

    @property
    def counts(self) -> np.ndarray:
        if len(self.counted) > 1:
            self.counted = [np.concatenate(self.counted)]
        return self.counted[0]

    def groups_of(self, own: list[int]) -> str:
        return "".join([self.groups[k] for k in own])[:-1]  # each ends with a semicolon


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner; a worker keeps it from task to task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, groups) of every row: `a1,a2|b1;a3|b2,b3`, the decimal ids of both sides in order; '' without tokens."""

    def work() -> Callable:
        own = aligner(path_a, path_b)
        return lambda texts: {"groups": [own.groups_of(x) for x in own.of(texts)]}

    return map_texts(docs, work, "groups string", id_col, text_col, chunk)


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """A row for each block: its documents' ids, counts, digests and distinct links, and the block's list of pairs with their documents here."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, chunk):
                numbers = own.of(texts[a:b])
                flat, n_units = np.array([k for x in numbers for k in x], dtype=np.int64), np.array([len(x) for x in numbers])
                until = np.concatenate([[0], np.cumsum(n_units)])
                sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(own.counts[flat, :4], axis=0)])
                counts = sums[until[1:]] - sums[until[:-1]]
                digests = [hashlib.sha256(own.groups_of(x).encode()).hexdigest() if x else "" for x in numbers]
                links = np.frombuffer(b"".join([own.links[k] for x in numbers for k in x]), dtype=np.int32)
                keys = np.repeat(np.arange(b - a), counts[:, 3]) * max(1, len(own.pairs)) + links
                keys, times = np.unique(keys, return_counts=True)
                doc, pair = np.divmod(keys, max(1, len(own.pairs)))
                held = np.bincount(pair, minlength=len(own.pairs))  # documents of this block, by pair
                here = np.flatnonzero(held)
                place = np.cumsum(held > 0) - 1
                names = np.fromiter(own.pairs, dtype=np.int64, count=len(own.pairs))[here]
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(block, pa.int64()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("id").slice(a, b - a)),
                        *(one(counts[:, c], pa.list_(pa.int64())) for c in range(4)), one(digests, pa.list_(pa.string())),
                        one(np.bincount(doc, minlength=b - a).astype("<u4").tobytes(), pa.binary()), one(place[pair].astype("<u4").tobytes(), pa.binary()), one(times.astype("<u4").tobytes(), pa.binary()),
                        one(names, pa.list_(pa.int64())), one(held[here], pa.list_(pa.int64())),
                    ],
                    ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "n_distinct", "links", "times", "pairs", "held"],
                )
                block += 1
        give_back()

    schema = f"block long, ids array<{id_type}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, n_distinct binary, links binary, times binary, pairs array<long>, held array<long>"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) of rows (pair, held): documents that hold the pair linked, and whether no other pair of its A id has more."""
    summed = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair DIV {size_b}"))
    return summed.withColumn("best", F.col("n") == F.max("n").over(of_a))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    A is a file of the tokenizers library that reads a space and the text, B a sentencepiece model that reads the text; workers must be able to read both.
    n_best counts links whose pair is in as many documents as any of its A id, count_sum adds the documents of all links' pairs. `groups` gives the groups themselves.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    size_b = len(Pieces(path_b).tokens)
    written = materialize(_blocks(docs, path_a, path_b, id_col, text_col, chunk), "aligned")
    pairs = written.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    told = pairs.select("block", "place", "pair").join(pair_counts(pairs.select("pair", "held"), size_b), "pair").select(F.col("block").alias("of_block"), "place", "n", "best")

    def score(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        place, n, best = (told.column(c).to_numpy() for c in ("place", "n", "best"))
        by_place, is_best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        by_place[place], is_best[place] = n, best
        for row in range(blocks.num_rows):  # one
            links, times, distinct = (np.frombuffer(blocks.column(c)[row].as_py(), dtype="<u4").astype(np.int64) for c in ("links", "times", "n_distinct"))
            until = np.concatenate([[0], np.cumsum(distinct)])
            sums = [np.concatenate([[0], np.cumsum(times * x[links])]) for x in (is_best, by_place)]
            lists = [blocks.column(c)[row].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            out.append(pa.table([*lists, *(pa.array(s[until[1:]] - s[until[:-1]]) for s in sums), blocks.column("digests")[row].values], names=names))
        return pa.concat_tables(out) if out else none

    names = ["id", *(c.split()[0] for c in RESULT.split(", "))]
    none = to_arrow_schema(StructType.fromDDL(f"id {id_type}, {RESULT}")).empty_table()
    docs_of = written.drop("pairs", "held").groupBy("block")
    return docs_of.cogroup(told.groupBy("of_block")).applyInArrow(score, f"id {id_type}, {RESULT}").withColumnRenamed("id", id_col)
