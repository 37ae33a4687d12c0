"""Token ids of a corpus as binary files, by an adaptive context-mixing range coder.

Ids are coded in blocks of equal length. A block begins with an untrained model, so any one can be read without the others, and carries the CRC-32 of its ids.
It lists its ids in ascending order and codes their numbers. An order-2 and an order-1 context each predict one number, with a confidence; the order-0 case is one of the
64 lowest. A number is coded as right for order 2, else for order 1, else as one of the lowest (it follows in 6 bits), else written out. How likely the four
cases are is mixed from three adaptive tables (by the confidence of order 2 and whether order 1 agrees, by that of order 1, and by the case before), each
weighted by how likely it lately held what came true, weighed anew at every fourth step. Arithmetic is on integers alone, so all machines agree.

Blocks do not know of each other, so many are coded side by side: a step codes one id of each in numpy, decoding as well as encoding.

Documents are dealt out by ranges of their id and sorted, so that files follow each other in order of ids. A task writes files under names of its own attempt
and lists them in a manifest that Spark commits; files of lost attempts are in no manifest. Null texts count as empty and hold the end id alone. Texts of any length are
coded whole. Rows that share an id stand in order of their text's hash, null ids come first; rows equal in both in any order. Extra columns are left out; an empty table gives an
empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import give_back, materialize, shared_dir
from tallyweave.llm.units import ArrowWords, ByteLevel

#: Ids of a block; blocks coded side by side; ids from which on a file is full; bytes of text encoded at a time; ids of the longest block.
BLOCK, LANES, FILE_IDS, CHUNK, LONGEST = 2048, 4096, 8_000_000, 8_000_000, 1 << 20
MAGIC = b"TWTOKEN2"
#: Entries of the table of order 2, by powers of two; bits of the numbers of the most frequent ids.
ORDER2, FEW = 11, 6
#: The four cases are likely by shares of 1 << ONE_BITS; shares and scores learn by a sixteenth of the difference.
ONE_BITS, FOUR, SIXTEEN, HALF = np.uint64(12), np.uint64(4), np.uint64(16), np.uint64(32)
SETTLED, PLACES = np.uint64(1 << 32), np.array([[0], [16], [32]], dtype=np.uint64)


def fields(*values: int) -> np.uint64:
    """Values of 16 bits in one word, the first lowest."""
    return np.uint64(sum(v << (16 * k) for k, v in enumerate(values)))


FIELD, FIELDS, WHOLE = fields(0xFFFF), fields(0xFFF, 0xFFF, 0xFFF), fields(0, 0, 0, 1 << 12)
#: Shares at first; what keeps a case possible; what shares strive for, times 16, by the case that came true. The sum of all is below the whole.
EVEN, LEAST = fields(1_024, 2_048, 3_072), fields(8, 16, 24)
TARGETS = np.array([fields(253, 253, 253), fields(0, 253, 253), fields(0, 0, 253), fields(0, 0, 0)])
#: Steps from one weighing of the tables to the next; scores learn by an eighth, and their highest 3 bits count.
WEIGHED, THREE, HIGH = 4, np.uint64(3), np.uint64(9)


def _weights() -> np.ndarray:
    """The weights of three tables, sixteen in all, by their scores: as the squares of these."""
    out = []
    for k in range(512):
        squares = [(2 * (k >> shift & 7) + 1) ** 2 for shift in (0, 3, 6)]
        own = [16 * x // sum(squares) for x in squares]
        own[squares.index(max(squares))] += 16 - sum(own)
        out.append(own)
    return np.ascontiguousarray(np.array(out, dtype=np.uint64).T)


WEIGHTS = _weights()
TABLE = np.dtype([("ids", "<u4"), ("bytes", "<u4"), ("raw", "u1"), ("crc", "<u4")])


class Model:
    """What the lanes have learned: predicted numbers with confidences, and the shares of the cases.

    The four cases' shares are three sums (of the first case, the first two, the first three) in fields of 16 bits of one word, so that all are mixed and taught at once.
    """

    def __init__(self, lanes: int, numbers: int, block: int):
        self.lane = np.arange(lanes)
        self.kind = kind_of(block)
        bits1 = max(1, (numbers - 1).bit_length())
        self.table = np.zeros((lanes << ORDER2) + (lanes << bits1), dtype=self.kind)  # order 2, then order 1
        self.begins = np.stack([self.lane << ORDER2, (lanes << ORDER2) + (self.lane << bits1)])
        self.shares = np.full(lanes * 28, EVEN, dtype=np.uint64)
        self.first_rows = np.stack([self.lane * 16, lanes * 16 + self.lane * 8, lanes * 24 + self.lane * 4])
        self.at, self.rows = np.zeros((2, lanes), dtype=np.int64), np.zeros((3, lanes), dtype=np.int64)
        self.scores, self.step = np.full((3, lanes), 1_024, dtype=np.uint64), 0
        self.two = self.one = np.zeros(lanes, dtype=self.kind)
        self.case = np.zeros(lanes, dtype=np.int64)
        self._weigh()

    def _weigh(self) -> None:
        high = (self.scores >> HIGH).view(np.int64)
        self.weights = WEIGHTS.take(high[0] + (high[1] << 3) + (high[2] << 6), axis=1)

    def predict(self) -> np.ndarray:
        """Sums of the cases' shares of ONE, in fields."""
        at, rows = self.at, self.rows
        at[0] = (self.two * 1_597 + self.one) & ((1 << ORDER2) - 1)  # what overflows is masked anyway
        at[1] = self.one
        at += self.begins
        self.entry = self.table.take(at)
        self.sure, self.guess = self.entry & 7, self.entry >> 3
        rows[0] = self.sure[0] * 2 + (self.guess[0] == self.guess[1])
        rows[1], rows[2] = self.sure[1], self.case
        rows += self.first_rows
        self.share = self.shares.take(rows)
        each = self.share * self.weights
        mixed = each[0]
        mixed += each[1]
        mixed += each[2]
        mixed >>= FOUR
        mixed &= FIELDS
        mixed += LEAST
        return mixed

    def learn(self, now: np.ndarray, case: np.ndarray, same: np.ndarray) -> None:
        """`now` came true, as `case`; `same`: where a context had foretold it."""
        share, entry, sure = self.share, self.entry, self.sure
        if self.step % WEIGHED == 0:
            hit = (share | WHOLE) - (share << SIXTEEN)
            hit >>= (case << 4).view(np.uint64)
            hit &= FIELD
            self.scores -= self.scores >> THREE
            self.scores += hit >> THREE
            self._weigh()
        self.step += 1
        share -= (share >> FOUR) & FIELDS
        share += TARGETS.take(case)
        self.shares[self.rows] = share
        self.table[self.at] = np.where(same, entry + (sure < 7), np.where(sure > 1, entry - ((sure + 1) >> 1), now << 3))
        self.two, self.one, self.case = self.one, now, case


def _encode(numbers: np.ndarray, bits: np.ndarray, distinct: int, block: int) -> list[bytes]:
    """The words of each row of `numbers` (a block each), whose numbers have so many bits."""
    lanes, steps = numbers.shape
    model, room = Model(lanes, distinct, block), steps + 3
    words, place = np.zeros(lanes * room, dtype=np.uint64), np.arange(lanes) * room
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    length, lane = lengths(bits), model.lane
    shown = np.ascontiguousarray(numbers.T)
    unseen = np.where(shown < 1 << FEW, np.uint8(2), np.uint8(3))
    for now, case in zip(shown, unseen, strict=True):
        sums = model.predict()
        same = model.guess == now
        np.putmask(case, same[1], 1)
        np.putmask(case, same[0], 0)
        case = case.astype(np.int64)
        field, below = (case << 4).view(np.uint64), sums << SIXTEEN
        unit = width >> ONE_BITS
        add = below >> field
        add &= FIELD
        add *= unit
        sums |= WHOLE
        sums -= below
        sums >>= field
        sums &= FIELD
        width = unit * sums
        width >>= length.take(case * lanes + lane)
        add += width * (now * (case > 1)).astype(np.uint64)
        low += add
        over = np.flatnonzero(low < add)  # carried into the word before
        words[place[over] - 1] += np.uint64(1)
        full = np.flatnonzero(width < SETTLED)
        begin = low[full]
        words[place[full]] = begin >> HALF
        place[full] += 1
        low[full] = begin << HALF
        width[full] <<= HALF
        model.learn(now, case, same)
    for part in (low >> HALF, low & (SETTLED - np.uint64(1))):
        words[place] = part
        place += 1
    words, sizes = words.reshape(lanes, room), place - lane * room
    words = words[:, : sizes.max()].copy()
    while (carry := words >> HALF).any():
        words &= SETTLED - np.uint64(1)
        words[:, :-1] += carry[:, 1:]
    return [row[:n].astype("<u4").tobytes() for row, n in zip(words, sizes.tolist(), strict=True)]


def _decode(coded: list[bytes], steps: int, bits: np.ndarray, distinct: int, block: int) -> np.ndarray:
    """The numbers of blocks of `steps` ids each."""
    lanes = len(coded)
    words = np.frombuffer(b"".join([*coded, bytes(8)]), dtype="<u4").astype(np.uint64)
    place = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])[:-1]
    model, out = Model(lanes, distinct, block), np.zeros((steps, lanes), dtype=kind_of(block))
    rest, width = (words.take(place, mode="clip") << HALF) | words.take(place + 1, mode="clip"), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    place = place + 2
    length, lane, most = lengths(bits), model.lane, np.uint64(distinct - 1)
    bounds, told = np.zeros((5, lanes), dtype=np.uint64), np.zeros((4, lanes), dtype=out.dtype)
    for now in out:
        sums = model.predict()
        unit = width >> ONE_BITS
        inner = bounds[1:4]
        np.right_shift(sums, PLACES, out=inner)
        inner &= FIELD
        inner *= unit
        np.left_shift(unit, ONE_BITS, out=bounds[4])
        over = (rest >= inner).view(np.uint8)
        case = (over[0] + over[1] + over[2]).astype(np.int64)
        at = case * lanes
        at += lane
        begin = bounds.take(at)
        rest -= begin
        width = bounds.take(at + lanes)
        width -= begin
        width >>= length.take(at)
        number = rest // width
        rest -= number * width
        told[:2], told[2:] = model.guess, np.minimum(number, most)
        told.take(at, out=now, mode="clip")
        full = np.flatnonzero(width < SETTLED)
        next_word = place[full]
        rest[full] = (rest[full] << HALF) | words.take(next_word, mode="clip")
        place[full] = next_word + 1
        width[full] <<= HALF
        model.learn(now, case, model.guess == now)
    return out.T


def kind_of(block: int) -> type:
    """What holds a number and three bits of confidence."""
    return np.uint16 if block <= 1 << 13 else np.uint32


def lengths(bits: np.ndarray) -> np.ndarray:
    """The bits that follow each case, by case and lane."""
    return np.concatenate([bits * 0, bits * 0, np.minimum(bits, FEW), bits])


def bits_of(sizes: list[int]) -> np.ndarray:
    """The bits of numbers below each of `sizes`."""
    return np.array([(n - 1).bit_length() for n in sizes], dtype=np.uint64)


class Names:
    """The ids of a block numbered in ascending order, which is by and large that of their frequency in vocabularies of merges: as bytes, their number and the steps between them."""

    def __init__(self, ids: np.ndarray, block: int = BLOCK):
        top = int(ids.max(initial=0))
        self.direct = top < 1 << 17
        if self.direct:
            self.seen, self.at = np.zeros(top + 1, dtype=bool), np.zeros(top + 1, dtype=kind_of(block))

    def number(self, ids: np.ndarray) -> tuple[np.ndarray, int, bytes]:
        """(the number of each id, how many there are, bytes)."""
        if self.direct:
            self.seen[ids] = True
            own = np.flatnonzero(self.seen)
            self.seen[own] = False
            self.at[own] = np.arange(len(own))
            numbers = self.at.take(ids)
        else:
            own, numbers = np.unique(ids, return_inverse=True)
            own = own.astype(np.int64)
        steps = own.copy()
        steps[1:] -= own[:-1]
        short = np.minimum(steps, 255).astype("u1").tobytes()
        return numbers, len(own), struct.pack("<I", len(own)) + short + steps[steps > 254].astype("<u4").tobytes()

    @staticmethod
    def read(body: bytes) -> tuple[np.ndarray, bytes]:
        """The ids by their numbers, and what follows them."""
        (n,) = struct.unpack_from("<I", body)
        steps = np.frombuffer(body, dtype="u1", count=n, offset=4).astype(np.int64)
        far = np.flatnonzero(steps == 255)
        if len(far):
            steps[far] = np.frombuffer(body, dtype="<u4", count=len(far), offset=4 + n)
        return np.cumsum(steps), body[4 + n + 4 * len(far) :]


def pack(ids: np.ndarray, index: pa.Table, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """A file: header, table of blocks, index (what the ids belong to, with a column n of their numbers), blocks.

    A block that would be longer than its ids themselves is stored as they are.
    """
    if not 0 < block <= LONGEST:
        raise ValueError(f"a block has 1 to {LONGEST} ids")
    n_blocks = -(-len(ids) // block)
    table, bodies, names = np.zeros(n_blocks, dtype=TABLE), [], Names(ids, block)
    for first in range(0, n_blocks, lanes):
        part = ids[first * block : (first + lanes) * block]
        rows = -(-len(part) // block)
        steps = min(block, len(part))
        full, sizes, heads = np.zeros(rows * steps, dtype=kind_of(block)), [], []  # the last block is filled up
        for at in range(0, len(part), block):
            own = part[at : at + block]
            full[at : at + len(own)], n, head = names.number(own)
            sizes.append(n)
            heads.append(head)
        for k, words in enumerate(_encode(full.reshape(rows, steps), bits_of(sizes), max(sizes), block)):
            body, own = heads[k] + words, np.ascontiguousarray(part[k * block : (k + 1) * block], dtype="<u4").tobytes()
            raw = len(body) >= len(own)
            bodies.append(own if raw else body)
            table[first + k] = (len(own) // 4, len(bodies[-1]), raw, zlib.crc32(own))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(index)
    about = table.tobytes() + sink.getvalue().to_pybytes()
    header = struct.pack("<IQQ", block, n_blocks, len(about))
    return b"".join([MAGIC, header, struct.pack("<I", zlib.crc32(about, zlib.crc32(header))), about, *bodies])


def _blocks(bodies: list[bytes], first: int, steps: int, block: int) -> np.ndarray:
    """The ids of coded blocks, a row each."""
    names, words = [], []
    for k, body in enumerate(bodies):
        try:
            own, rest = Names.read(body)
        except (ValueError, struct.error):  # sizes beyond the body
            own, rest = np.zeros(0), b""
        if not 0 < len(own) <= steps or len(rest) % 4:
            raise ValueError(f"block {first + k} is damaged")
        names.append(own)
        words.append(rest)
    sizes = [len(n) for n in names]
    every = np.zeros((len(names), max(sizes)), dtype="<u4")
    for row, own in zip(every, names, strict=True):
        row[: len(own)] = own
    numbers = _decode(words, steps, bits_of(sizes), max(sizes), block)
    return np.take_along_axis(every, numbers, axis=1)


def unpack(content: bytes, lanes: int = LANES) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """The index of a file and its ids, some blocks at a time. Damage is an error that names the block."""
    size = struct.calcsize("<IQQI")
    if content[:8] != MAGIC or len(content) < 8 + size:
        raise ValueError("no file of token ids")
    block, n_blocks, n_about, crc = struct.unpack("<IQQI", content[8 : 8 + size])
    about = content[8 + size : 8 + size + n_about]
    if len(about) != n_about or zlib.crc32(about, zlib.crc32(content[8 : 4 + size])) != crc:
        raise ValueError("the table of blocks is damaged")
    table = np.frombuffer(about[: n_blocks * TABLE.itemsize], dtype=TABLE)
    index = pa.ipc.open_stream(about[n_blocks * TABLE.itemsize :]).read_all()
    begins = 8 + size + n_about + np.concatenate([[0], np.cumsum(table["bytes"], dtype=np.int64)])

    def parts() -> Iterator[np.ndarray]:
        for first in range(0, n_blocks, lanes):
            own = table[first : first + lanes]
            steps = block if len(own) > 1 else int(own["ids"][0])  # a block alone is not filled up
            bodies = [content[a:b] for a, b in zip(begins[first:], begins[first + 1 : first + 1 + len(own)], strict=False)]
            coded = [k for k in range(len(own)) if not own["raw"][k]]
            rows = dict(zip(coded, _blocks([bodies[k] for k in coded], first, steps, block), strict=True)) if coded else {}
            out = []
            for k, (n, _, raw, crc) in enumerate(own.tolist()):
                ids = np.frombuffer(bodies[k], dtype="<u4") if raw else rows[k][:n].astype("<u4")
                if len(ids) != n or zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError(f"block {first + k} is damaged")
                out.append(ids)
            yield np.concatenate(out)

    return index, parts()


_words: dict[str, ArrowWords] = {}


def words_of(path: str) -> ArrowWords:
    """This worker's encoder; a worker keeps it, and what it remembers, from task to task."""
    if path not in _words:
        _words[path] = ArrowWords(ByteLevel(path, plain=False))
    return _words[path]


def runs_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows that begin in the same `limit` bytes."""
    edges = np.flatnonzero(np.diff((np.cumsum(sizes, dtype=np.int64) - sizes) // limit)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """The manifest (part, seq, file, n_docs, n_ids, n_bytes) of files under `folder`, in the order of part and seq.

    `path` is a file of the tokenizers library; `end_id` follows each document. `folder` is one that all executors share, a new one
    beside `spark.checkpoint.dir`'s other tables if none is given. `parts` ranges of ids are made, as many as Spark shuffles by if None.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = words_of(path), TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        ids, names, held, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, held, seq
            content = pack(np.concatenate(ids), pa.table({"id": pa.concat_arrays(names), "n": np.array([len(i) for i in ids], dtype=np.int64)}), block)
            name = f"part-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.tok"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(content)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((task.partitionId(), pa.int32()), (seq, pa.int32()), (f"{folder}/{name}", pa.string()), (len(ids), pa.int64()), (held, pa.int64()), (len(content), pa.int64()))], ["part", "seq", "file", "n_docs", "n_ids", "n_bytes"])
            ids, names, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            texts = batch.column("text")
            for a, b in runs_of(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), CHUNK):
                for k, own in enumerate(words.encode(texts.slice(a, b - a))):
                    ids.append(np.concatenate([own, np.array([end_id], dtype="<u4")]))
                    names.append(batch.column("id").slice(a + k, 1))
                    held += len(own) + 1
                    if held >= file_ids:
                        yield flush()
        if ids:
            yield flush()
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    keys = [F.col("id").asc_nulls_first(), "tie", "place"]
    dealt = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).select("id", "text")
    return materialize(dealt.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"), "manifest")


def _in_order(manifest: DataFrame) -> DataFrame:
    """The manifest with `before`: the ids of all files before each. Files are summed by part first, so the window without keys has a row for each part."""
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    return manifest.join(parts, "part").withColumn("before", F.col("parts_before") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).drop("parts_before")


def read(manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id", arrays: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids array<long>]) of every document, from the files of a manifest: a task a file. `start` counts the ids of all documents before."""
    names = ["id", "start", "n_tokens", "ids_crc32", *["ids"] * arrays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, path = _store(file)
                with store.open_input_file(path) as f:
                    index, parts = unpack(f.read())
                n = index.column("n").to_numpy()
                ends = np.cumsum(n)
                crcs, kept, doc, at = [], [], 0, 0
                crc, own = 0, []
                for part in parts:
                    begin = 0
                    while doc < len(n) and begin < len(part):
                        take = min(len(part) - begin, int(ends[doc]) - at)
                        piece = part[begin : begin + take]
                        crc = zlib.crc32(piece.tobytes(), crc)
                        own += [piece] * arrays
                        begin, at = begin + take, at + take
                        if at == ends[doc]:
                            crcs.append(crc)
                            kept.append(np.concatenate(own).astype(np.int64) if own else None)
                            crc, own, doc = 0, [], doc + 1
                columns = [pa.concat_arrays(index.column("id").chunks), pa.array(before + ends - n), pa.array(n), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int64()))] * arrays], names)
        give_back()

    ordered = _in_order(manifest).select("file", "before")
    files = ordered.repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays).withColumnRenamed("id", id_col)
