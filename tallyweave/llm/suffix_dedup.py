"""Suffix-array dedup: removal of every byte that lies in a LENGTH-byte string which also starts in a document with a smaller id.

Documents are dealt into shards by a hash of their id.

1. Anchors. Of every LENGTH-byte window the GRAM-byte gram with the smallest hash is its anchor, so equal windows have
   equal anchors at equal places. They are found once, text by text, and dealt out with the texts. A shard sends its anchors' hashes, sorted, cut into ranges.
2. A range's task merges the shards' sorted runs: by binary search in the merged run it finds the hashes that occur in
   more than one document, and tells each shard which of its own they are, and which are hot: those that stand in HOT places or more
   (counts are rounded up to powers of two). All other text is unique and goes no further.
3. For each distinct context (the bytes of all windows that an anchor can stand for) of a recurring anchor, a shard sends
   the context and the smallest document that holds it. The other documents of the shard that hold it need nothing from elsewhere.
4. A range's task joins equal contexts of all shards. Where one anchor has several contexts, a suffix array of these
   contexts (Larsson-Sadakane refinement in numpy) with its common prefixes (Kasai) tells which windows they share
   with contexts of smaller documents. It sends back the anchors' covered windows.
   A hot anchor's contexts never meet: each of their windows goes to a range by a hash of its LENGTH bytes instead, once from
   each shard, and equal windows meet there alone. So an anchor that all documents share, with other text around it in each, is spread over all ranges.
5. Each shard adds what recurs inside it, from a suffix array with common prefixes of its own recurring text, and cuts.

Nothing is capped: a window that a third of all documents hold is one row of each shard in one range. A shard sends a row to each range that it
has anchors for: with few ranges one for each pair, with many at most one for each anchor, so rows never outgrow the text.
Windows are judged on the input. Ids may be of any type that Spark orders; those that are no whole numbers are numbered in their order first. Null
texts count as empty, texts of any length are one document (a shard holds whole documents). Rows with a null id take no part and
stay whole. Rows that share an id, equal or not, never remove each other's text. An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tallyweave.llm.common import _BYTE_CODES, INVERSE, MULTIPLIER, give_back, in_chunks, materialize, mix64, powers, utf8

LENGTH, GRAM = 50, 26
SIDE = LENGTH - GRAM
#: Bytes of text in a shard, and the bytes whose anchors are found at a time.
SHARD, AT_ONCE = 8_000_000, 500_000
#: Ranges of hashes for each shard, and contexts of one suffix array (more only where one anchor has more).
RANGES_EACH, CONTEXTS = 5, 20_000
#: Places from which on an anchor is hot: it may have more contexts than one suffix array takes.
HOT = 20_000
#: Stands beyond the ends of documents; no UTF-8 text holds it.
EDGE = 255


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte string in order; an end sorts before any byte.

    Larsson and Sadakane's refinement: suffixes are ranked by their first seven bytes, then the groups that are not yet
    sorted, and only they, are sorted by the ranks of the suffixes h further on, with h doubled each time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    byte = np.zeros(n + 6, dtype=np.uint16)
    byte[:n] = text
    byte[:n] += 1
    key = byte[:n].astype(np.uint64)
    for k in range(1, 7):
        key *= np.uint64(257)
        key += byte[k : n + k]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.append(True, key[1:] != key[:-1])
    del byte, key
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of more than one
    while len(open_):
        own = sa[open_]
        after = own + h
        further = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((further, rank[own]))
        own, further = own[order], further[order]
        group = rank[own]
        sa[open_] = own
        new = np.append(True, (group[1:] != group[:-1]) | (further[1:] != further[:-1]))
        rank[own] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in `sa` (Kasai's theorem, in text order).

    Where a suffix and its neighbour are preceded by the same byte, its common prefix is one shorter than that of the
    suffix one place before; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    follows = (before > 0) & (place > 0)
    follows[follows] = text[place[follows] - 1] == text[before[follows] - 1]
    heads = np.flatnonzero(~follows)
    length = np.zeros(len(heads), dtype=np.int64)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.flatnonzero(before[heads] >= 0)
    while len(live):
        a, b = heads[live] + length[live], before[heads[live]] + length[live]
        room = n - np.maximum(a, b)
        same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
        step = np.minimum(np.where(same.all(1), 8, same.argmin(1)), np.maximum(room, 0))
        length[live] += step
        live = live[(step == 8) & (room > 8)]
    at = np.maximum.accumulate(np.where(follows, 0, place))
    start = np.zeros(n, dtype=np.int64)
    start[heads] = length
    by_place = start[at] - (place - at)
    return np.maximum(by_place[sa], 0)


def repeated(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """At each place whether its LENGTH-byte window, free of EDGE, also starts at a place with a smaller owner."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < LENGTH:
        return out
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    edges = np.concatenate([[0], np.cumsum(text == EDGE)])
    whole = np.zeros(n, dtype=bool)
    whole[: n - LENGTH + 1] = edges[LENGTH:] == edges[: n - LENGTH + 1]
    group = np.cumsum(lcp < LENGTH) - 1
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(np.where(whole[sa], owner[sa], np.iinfo(np.int64).max), starts)
    out[sa] = whole[sa] & (least[group] < owner[sa])
    return out


def anchor_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the anchors of all windows inside documents (which end at `ends[1:]`), in order. Two of one document are never more than LENGTH - GRAM + 1 apart."""
    places = []
    span = LENGTH - GRAM + 1
    for a in range(0, max(len(data) - LENGTH + 1, 0), AT_ONCE):
        part = data[a : a + AT_ONCE + LENGTH - 1 + 2 * SIDE]  # windows that start in this run, and those that share grams with them
        n = len(part)
        if n < LENGTH:
            break
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[part] * powers("up", MULTIPLIER, n), out=sums[1:])
        h = mix64((sums[GRAM:] - sums[:-GRAM]) * powers("down", INVERSE, n + 1)[: n - GRAM + 1]) >> np.uint64(16)
        least = sliding(h, span, np.minimum)
        # Windows that cross a document's end count for nothing.
        for end in ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(least) + LENGTH, side="left")].tolist():
            least[max(end - LENGTH + 1 - a, 0) : max(end - a, 0)] = 0
        if a + AT_ONCE < len(data) - LENGTH + 1:
            least[AT_ONCE:] = 0  # the next run's
        most = sliding(np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)]), span, np.maximum)
        places.append(np.flatnonzero((most == h) & (h > 0)) + a)
    return np.unique(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)


def anchor_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """48-bit hashes of the grams at `places`. Anchors are minima of a hash, so these are scrambled once more and spread evenly over the ranges."""
    out = np.zeros(len(places), dtype=np.uint64)
    for a in range(0, len(data), AT_ONCE):
        some = slice(*np.searchsorted(places, [a, a + AT_ONCE]))
        at = places[some] - a
        if len(at):
            part = data[a : a + AT_ONCE + GRAM]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[part] * powers("up", MULTIPLIER, len(part)), out=sums[1:])
            out[some] = mix64(mix64((sums[at + GRAM] - sums[at]) * powers("down", INVERSE, len(part) + 1)[at]) >> np.uint64(16)) >> np.uint64(16)
    return out


def steps_of(texts: list[str | None]) -> list[bytes]:
    """For each text the steps from each of its anchors to the next, a byte each, the first from the text's begin."""
    data, ends = utf8(texts)
    places = anchor_places(data, ends)
    doc = np.searchsorted(ends, places, side="right") - 1
    steps = np.diff(places, prepend=0)
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, dtype=bool)
    steps[first] = (places - ends[doc])[first]
    raw, at = steps.astype(np.uint8).tobytes(), np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def with_steps(docs: DataFrame) -> DataFrame:
    """`docs` (id, text, what they carry) with `steps`, so that anchors are looked for once, before texts are dealt out."""

    def run(found):
        for batch in found:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 4_000_000):
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(steps_of(texts[a:b]), pa.binary())], [*own.schema.names, "steps"])
        give_back()

    columns = ", ".join(f"{c} {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{columns}, steps binary")


def sliding(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `span` values, by doubling."""
    done, out = 1, x
    while done * 2 <= span:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (span - done)], out[span - done :]) if done < span else out


class Shard:
    """The documents of one shard that have an id, in order of id and text."""

    def __init__(self, table: pa.Table):
        columns = [table.column(c).to_pylist() for c in ("id", "text", "steps")]
        rows = sorted((i, t or "", s, k) for k, (i, t, s) in enumerate(zip(*columns, strict=True)) if i is not None)
        self.row = [r[3] for r in rows]  # where each stands in the table
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.data, self.ends = utf8([r[1] for r in rows])
        n = np.array([len(r[2]) for r in rows], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(rows)), n)
        step = np.cumsum(np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.uint8).astype(np.int64))
        before = np.concatenate([[0], step])[np.cumsum(n) - n]  # what all texts before have stepped
        self.place = step - before[self.doc] + self.ends[self.doc] if len(step) else np.zeros(0, dtype=np.int64)
        self.hash = anchor_hashes(self.data, self.place)
        self.known, self.which = np.unique(self.hash, return_inverse=True)

    def several(self) -> np.ndarray:
        """Which of the known hashes occur in more than one document (by id)."""
        least, most = np.full(len(self.known), np.iinfo(np.int64).max), np.full(len(self.known), np.iinfo(np.int64).min)
        np.minimum.at(least, self.which, self.ids[self.doc])
        np.maximum.at(most, self.which, self.ids[self.doc])
        return least < most


def cuts(known: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of 48-bit hashes begins in the sorted hashes, and the end."""
    return np.concatenate([np.searchsorted(known, (np.arange(ranges, dtype=np.uint64) << np.uint64(48)) // np.uint64(ranges) if ranges < 65536 else np.array([(i << 48) // ranges for i in range(ranges)], dtype=np.uint64)), [len(known)]])


def six_bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def send_hashes(table: pa.Table, number: int, ranges: int) -> pa.Table:
    """Step 1: (range, shard, hashes, several, times) of one shard; times: the logarithm, rounded up, of how often each hash occurs."""
    shard = Shard(table)
    several, at = shard.several(), cuts(shard.known, ranges)
    times = np.ceil(np.log2(np.bincount(shard.which, minlength=len(shard.known)))).astype(np.uint8) if len(shard.known) else np.zeros(0, dtype=np.uint8)
    full = np.flatnonzero(at[:-1] < at[1:]).tolist()
    return pa.table(
        {
            "range": pa.array(full, pa.int32()),
            "shard": pa.array([number] * len(full), pa.int32()),
            "hashes": pa.array([six_bytes(shard.known[at[r] : at[r + 1]]) for r in full], pa.binary()),
            "several": pa.array([np.packbits(several[at[r] : at[r + 1]]).tobytes() for r in full], pa.binary()),
            "times": pa.array([times[at[r] : at[r + 1]].tobytes() for r in full], pa.binary()),
        }
    )


def merge_hashes(table: pa.Table, hot: int) -> pa.Table:
    """Step 2: (range, shard, recurring, hot) of one range, by binary search of each shard's run in the merged run."""
    runs = [from_six_bytes(b) for b in table.column("hashes").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[: len(r)].astype(bool) for r, b in zip(runs, table.column("several").to_pylist(), strict=True)]
    times = np.concatenate([np.frombuffer(b, dtype=np.uint8) for b in table.column("times").to_pylist()])
    merged = np.concatenate(runs)
    order = np.argsort(merged, kind="stable")
    merged = merged[order]
    places = np.concatenate([[0], np.cumsum(np.int64(1) << times[order].astype(np.int64))])
    bits, hots = [], []
    for run, flag in zip(runs, flags, strict=True):
        begin, end = np.searchsorted(merged, run, side="left"), np.searchsorted(merged, run, side="right")
        bits.append(np.packbits((end - begin > 1) | flag).tobytes())
        hots.append(np.packbits(places[end] - places[begin] >= hot).tobytes())
    return pa.table({"range": table.column("range"), "shard": table.column("shard"), "recurring": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())})


SENT = ("range", "shard", "wide", "contexts", "firsts", "owners", "places", "offsets")
SENT_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def send_contexts(docs: pa.Table, told: pa.Table, ranges: int) -> pa.Table:
    """Step 3: (range, shard, wide, contexts, firsts, owners, places, offsets) of one shard.

    contexts: the distinct contexts (`wide` bytes each), compressed; firsts: the smallest id that holds each; places: every place of
    a context's anchor in that document, and owners: which context each is of. Of hot anchors the windows stand in the contexts'
    place, and offsets tells which of an anchor's windows each is.
    """
    shard = Shard(docs)
    at = cuts(shard.known, ranges)
    recurs, hot = np.zeros(len(shard.known), dtype=bool), np.zeros(len(shard.known), dtype=bool)
    for r, blob, hots in zip(*(told.column(c).to_pylist() for c in ("range", "recurring", "hot")), strict=True):
        own = slice(at[r], at[r + 1])
        recurs[own] = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))[: at[r + 1] - at[r]]
        hot[own] = np.unpackbits(np.frombuffer(hots, dtype=np.uint8))[: at[r + 1] - at[r]]
    out: dict[str, list] = {n: [] for n in SENT}
    number = told.column("shard")[0].as_py() if told.num_rows else 0
    range_of = np.repeat(np.arange(ranges), np.diff(at))[shard.which] if len(shard.known) else np.zeros(0, dtype=np.int64)
    hot &= recurs

    def distinct(rows):
        """(distinct contexts, the smallest id of each, rows of its anchors in that document, which context each is of)."""
        text = contexts(shard.data, shard.ends, shard.place[rows], shard.doc[rows])
        order, new = grouped(text)
        group = np.empty(len(rows), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        ids = shard.ids[shard.doc[rows]]
        first = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(first, group, ids)
        mine = np.flatnonzero(ids == first[group])
        return text[order[new]], first, rows[mine], group[mine]

    def send(r, wide, text, first, owners, rows, offsets):
        values = (r, number, wide, pa.compress(text.tobytes(), codec="zstd", asbytes=True), first.tobytes(), owners.astype(np.int32).tobytes(), shard.place[rows].astype(np.int32).tobytes(), offsets)
        for n, v in zip(SENT, values, strict=True):
            out[n].append(v)

    def by_range(of):
        """(range, rows of `of` in it) of the ranges that have some."""
        order = np.argsort(of, kind="stable")
        begins = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(of) else []
        return zip(of[order][begins].tolist(), np.split(order, begins[1:]), strict=True) if len(of) else []

    cold = np.flatnonzero((recurs & ~hot)[shard.which])
    for r, some in by_range(range_of[cold]):
        text, first, rows, owners = distinct(cold[some])
        send(r, WIDE, text, first, owners, rows, b"")
    rows = np.flatnonzero(hot[shard.which])
    if len(rows):
        text, first, rows, owners = distinct(rows)
        inner = text != EDGE
        whole = np.lib.stride_tricks.sliding_window_view(inner, LENGTH, axis=1).all(2)
        context, offset = np.nonzero(whole)
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH, axis=1)[context, offset]
        order, new = grouped(windows)
        kind = np.empty(len(windows), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        rep = windows[order[new]]
        del windows
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, first[context])
        # every window of every place: its kind, by way of the place's context
        begin = np.concatenate([[0], np.cumsum(whole.sum(1))])
        many = begin[owners + 1] - begin[owners]
        entry = np.repeat(begin[owners] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        entry_row, entry_kind, entry_offset = np.repeat(rows, many), kind[entry], offset[entry]
        window_range = (row_hashes(rep) % np.uint64(ranges)).astype(np.int64)
        entries = dict(by_range(window_range[entry_kind]))
        for r, some in by_range(window_range):
            own = entries[r]
            local = np.searchsorted(some, entry_kind[own])
            send(r, LENGTH, rep[some], least[some], local, entry_row[own], entry_offset[own].astype(np.uint8).tobytes())
    return pa.table({n: pa.array(out[n], t) for n, t in zip(SENT, SENT_TYPES, strict=True)})


WIDE = LENGTH + SIDE


def contexts(data: np.ndarray, ends: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor the bytes from SIDE before it to SIDE after it; EDGE beyond its document."""
    at = place[:, None] + np.arange(-SIDE, GRAM + SIDE)[None, :]
    inside = (at >= ends[doc][:, None]) & (at < ends[doc + 1][:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.uint8(EDGE))


def batches(group: np.ndarray):
    """(begin, end) of runs of about CONTEXTS rows that never part a group; `group` is sorted."""
    begin = 0
    while begin < len(group):
        end = begin + CONTEXTS
        end = len(group) if end >= len(group) else max(int(np.searchsorted(group, group[end], side="left")), begin)
        end = int(np.searchsorted(group, group[begin], side="right")) if end == begin else end
        yield begin, end
        begin = end


_WEIGHTS = mix64(np.arange(1, -(-WIDE // 8) + 1, dtype=np.uint64))


def row_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, eight bytes at a time."""
    padded = np.zeros((len(text), -(-text.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : text.shape[1]] = text
    h = np.zeros(len(text), dtype=np.uint64)
    for word, weight in zip(padded.view(np.uint64).T, _WEIGHTS, strict=False):
        h = mix64(h + (word ^ weight))
    return h


def grouped(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that puts equal rows together, where a new row begins in it). Hashes order the rows, bytes decide."""
    order = np.argsort(row_hashes(text), kind="stable")
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[order[1:]] != text[order[:-1]]).any(1)
    return order, new


def covered_windows(table: pa.Table) -> pa.Table:
    """Step 4: (shard, places, windows) of one range: bit s of `windows` tells that the window starting SIDE - s before the anchor is covered."""
    wide = table.column("wide").to_numpy()
    done = [covered_of(table.filter(pa.array(wide == w)), w) for w in (WIDE, LENGTH) if (wide == w).any()]
    return pa.concat_tables(done)


def covered_of(table: pa.Table, wide: int) -> pa.Table:
    """`covered_windows` of the rows of whole contexts, or of the rows of hot anchors' windows."""
    firsts = [np.frombuffer(b, dtype=np.int64) for b in table.column("firsts").to_pylist()]
    parts = [np.frombuffer(pa.decompress(b, decompressed_size=len(f) * wide, codec="zstd", asbytes=True), dtype=np.uint8).reshape(-1, wide) for b, f in zip(table.column("contexts").to_pylist(), firsts, strict=True)]
    first, text = np.concatenate(firsts), np.concatenate(parts)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    del parts
    mask = np.zeros(len(text), dtype=np.int64)
    if wide == WIDE:
        gram = row_hashes(text[:, SIDE : SIDE + GRAM])
        by_gram = np.argsort(gram, kind="stable")
        for a, b in batches(gram[by_gram]):
            rows = by_gram[a:b]
            mask[rows] = anchor_windows(text[rows], first[rows], gram[rows])
    else:
        order, new = grouped(text)
        kind = np.empty(len(text), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, first)
        mask = (first > least[kind]).astype(np.int64)
    places, windows = [], []
    for j, (owners, where, offsets) in enumerate(zip(*(table.column(c).to_pylist() for c in ("owners", "places", "offsets")), strict=True)):
        own = mask[at[j] : at[j + 1]][np.frombuffer(owners, dtype=np.int32)]
        if wide == LENGTH:
            own = own << np.frombuffer(offsets, dtype=np.uint8).astype(np.int64)
        some = np.flatnonzero(own)
        places.append(np.frombuffer(where, dtype=np.int32)[some].tobytes())
        windows.append(own[some].astype(np.uint32).tobytes())
    return pa.table({"shard": table.column("shard"), "places": pa.array(places, pa.binary()), "windows": pa.array(windows, pa.binary())})


def anchor_windows(text: np.ndarray, first: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The covered windows, as bits, of contexts, the smallest ids that hold them and their anchors' hashes. All contexts of an anchor come together."""
    order, new = grouped(text)
    kind = np.empty(len(text), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = text[order[new]]
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, first)
    # Windows that lie inside a document.
    edges = np.concatenate([np.zeros((len(rep), 1), dtype=np.int16), np.cumsum(rep == EDGE, axis=1, dtype=np.int16)], axis=1)
    whole = edges[:, LENGTH : LENGTH + SIDE + 1] == edges[:, : SIDE + 1]
    # Contexts whose anchor has others. Where two anchors' hashes are equal there is more to sort, and no other result.
    _, which, times = np.unique(gram[order[new]], return_inverse=True, return_counts=True)
    many = np.flatnonzero(times[which] > 1)
    part = np.zeros_like(whole)
    if len(many):
        joined = np.concatenate([rep[many], np.full((len(many), 1), EDGE, dtype=np.uint8)], axis=1)
        found = repeated(joined.ravel(), np.repeat(least[many], WIDE + 1)).reshape(len(many), WIDE + 1)
        part[many] = found[:, : SIDE + 1]
    weights = (np.int64(1) << np.arange(SIDE + 1)).astype(np.int64)
    return np.where(first > least[kind], (whole @ weights)[kind], (part @ weights)[kind])


def inside(shard: Shard) -> np.ndarray:
    """Places of the shard whose windows also start in one of its own documents with a smaller id."""
    out = np.zeros(len(shard.data) + 1, dtype=bool)
    rows = np.flatnonzero(shard.several()[shard.which])
    if not len(rows):
        return out
    doc = shard.doc[rows]
    begin, end = np.maximum(shard.place[rows] - SIDE, shard.ends[doc]), np.minimum(shard.place[rows] + GRAM + SIDE, shard.ends[doc + 1])
    step = np.zeros(len(shard.data) + 1, dtype=np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    near = np.cumsum(step[:-1]) > 0
    split = np.zeros(len(shard.data) + 1, dtype=bool)
    split[shard.ends] = True
    starts = np.flatnonzero(near & (np.append(True, ~near[:-1]) | split[:-1]))
    stops = np.flatnonzero(near & (np.append(~near[1:], True) | split[1:])) + 1
    size = stops - starts
    at = np.cumsum(size + 1) - (size + 1)
    place = np.full(int((size + 1).sum()), -1, dtype=np.int64)
    inner = np.ones(len(place), dtype=bool)
    inner[at + size] = False
    place[inner] = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text = np.where(inner, shard.data[np.maximum(place, 0)], np.uint8(EDGE))
    owner = np.where(inner, shard.ids[np.searchsorted(shard.ends, np.maximum(place, 0), side="right") - 1], np.iinfo(np.int64).max)
    found = repeated(text, owner)
    out[place[found]] = True
    return out


def cut_text(docs: pa.Table, told: pa.Table, id_type: pa.DataType, digests: bool = False) -> pa.Table:
    """Step 5: (id, n_bytes, n_removed, n_spans, kept, spans) of one shard's rows, with `digests` the texts' text_md5 too, and what they carry."""
    shard = Shard(docs)
    start = inside(shard)
    for places, windows in zip(told.column("places").to_pylist(), told.column("windows").to_pylist(), strict=True):
        place, window = np.frombuffer(places, dtype=np.int32), np.frombuffer(windows, dtype=np.uint32)
        for s in range(SIDE + 1):
            start[place[(window >> np.uint32(s)) & np.uint32(1) == 1] - SIDE + s] = True
    step = np.zeros(len(shard.data) + LENGTH + 1, dtype=np.int32)
    at = np.flatnonzero(start)
    step[at] += 1
    step[at + LENGTH] -= 1
    gone = np.cumsum(step)[: len(shard.data)] > 0
    rows = []
    for k, i in enumerate(shard.ids.tolist()):
        own, lost = shard.data[shard.ends[k] : shard.ends[k + 1]], gone[shard.ends[k] : shard.ends[k + 1]]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
        rows.append((i, len(own), int(lost.sum()), len(turn) // 2, own[~lost].tobytes(), turn.tolist()))
    for t in (t or "" for i, t in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist(), strict=True) if i is None):
        raw = t.encode("utf-8", "surrogatepass")
        rows.append((None, len(raw), 0, 0, raw, []))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
    out = pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "n_bytes", "n_removed", "n_spans", "kept", "spans"), columns, types, strict=True)})
    if "carry" in docs.column_names:
        unnamed = [k for k, i in enumerate(docs.column("id").to_pylist()) if i is None]
        out = out.append_column("carry", docs.column("carry").take(pa.array(shard.row + unnamed, pa.int64())))
    if digests:
        texts = [shard.data[a:b].tobytes() for a, b in zip(shard.ends[:-1], shard.ends[1:], strict=True)] + [r[4] for r in rows[len(shard.ids) :]]
        out = out.append_column("text_md5", pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()))
    return out


def released(step):
    """`step`, after which the worker gives back the memory that the group took."""

    def run(*tables):
        try:
            return step(*tables)
        finally:
            give_back()

    return run


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, number) of each distinct id that is not null; numbers grow with the ids."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return materialize(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()), "numbers")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD, digests: bool = False, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, spans array<int>) of every row; spans: begin and end of each removed run, in bytes.

    digests: one more column, text_md5 binary of the text before, which tells rows of one id apart. carry: columns that each row keeps, in a
    struct of that name with fields c0, c1, …, so that the result need not be joined with the rows again."""
    id_type = docs.schema[id_col].dataType
    whole = isinstance(id_type, (ByteType, ShortType, IntegerType, LongType))
    kept_by = [F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("carry")] if carry else []
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept_by)
    others = ["text", "carry"] if carry else ["text"]
    numbers = None if whole else numbered(docs, id_col)
    named = named.withColumn("id", F.col("id").cast("long")) if whole else named.join(numbers, "id", "left").select(F.col("number").alias("id"), *others)
    total = named.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    # Rows that share an id don't depend on each other: the text deals them out too.
    dealt = with_steps(named).withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    ranges = shards * RANGES_EACH
    hashes = dealt.groupBy("shard").applyInArrow(lambda key, t: released(send_hashes)(t, key[0].as_py(), ranges), "range int, shard int, hashes binary, several binary, times binary")
    recurring = hashes.groupBy("range").applyInArrow(lambda t: merge_hashes(t, hot), "range int, shard int, recurring binary, hot binary")
    sent = dealt.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(lambda a, b: released(send_contexts)(a, b, ranges), "range int, shard int, wide int, contexts binary, firsts binary, owners binary, places binary, offsets binary")
    covered = sent.groupBy("range").applyInArrow(lambda t: released(covered_windows)(t), "shard int, places binary, windows binary")
    columns = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<int>" + (f", carry {dict(named.dtypes)['carry']}" if carry else "") + ", text_md5 binary" * digests
    cut = dealt.groupBy("shard").cogroup(covered.groupBy("shard")).applyInArrow(lambda a, b: released(cut_text)(a, b, pa.int64(), digests), columns)
    rest = [c for c in cut.columns if c != "id"]
    if whole:
        return cut.select(F.col("id").cast(id_type).alias(id_col), *rest)
    return cut.withColumnRenamed("id", "number").join(numbers, "number", "left").select(F.col("id").alias(id_col), *rest)


def query_digest(cut: DataFrame) -> DataFrame:
    """`dedup` with the kept text's digest in its place."""
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept", "spans")
