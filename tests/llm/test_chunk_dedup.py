import random

import numpy as np

from tallyweave.llm import chunk_dedup


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcdefghijklmnop é") for _ in range(n))


ROWS = [(1, text(1, 3000)), (2, "moved " + text(1, 3000)), (3, text(2, 500) + text(1, 3000)[500:1500] + text(3, 500)), (4, None), (5, ""), (6, text(4, 900) * 2), (None, text(1, 3000)), (7, text(5, 200_000)), (8, text(6, 10)), (1, text(1, 3000))]


def slow_chunks(raw):
    """Chunks by one pass over the bytes: an end where the rolling hash says so, from LEAST bytes on, and after MOST at the latest; a short rest joins the chunk before."""
    ends, last, h = [], 0, 0
    for k, b in enumerate(raw, 1):
        h = (h * 2 + int(chunk_dedup.GEAR[b])) % 2**32
        if k - last > chunk_dedup.MOST:
            last += chunk_dedup.MOST
            ends.append(last)
        if h & int(chunk_dedup.MASK) == 0 and k - last >= chunk_dedup.LEAST:
            last = k
            ends.append(k)
    if last < len(raw):
        if ends and len(raw) - last < chunk_dedup.LEAST:
            ends.pop()
            if len(raw) - (ends[-1] if ends else 0) > chunk_dedup.MOST:
                ends.append(len(raw) - chunk_dedup.LEAST)
        ends.append(len(raw))
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_chunks_equal_one_pass_over_the_bytes():
    for raw in [b"", b"a", b"x" * 1000, bytes(300), *(text(k, n).encode() for k, n in enumerate((15, 16, 17, 255, 256, 257, 270, 3_000, 20_000)))]:
        assert [raw[a:b] for a, b, _ in chunk_dedup.chunks(raw)] == slow_chunks(raw)


def test_a_chunk_that_all_hold_is_found_and_dealt_out(spark):
    shared = text(50, 400)
    rows = [(i, text(100 + i, 60) + shared) for i in range(1_500)]
    got = {r.doc_id: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # chunks meet from the first common end on, which a few texts reach late
    assert got[0].n_removed == 0 and sum(got[i].n_removed >= 200 and 0 in got[i].repeats_of for i in range(1, 1_500)) >= 1_400
    assert all(r.n_removed <= len(shared.encode()) + 20 for r in got.values())


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, digest string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, bytes(r.kept)) for r in chunk_dedup.dedup(docs).collect())
    first = {}
    for i, t in ROWS:
        for d in slow_chunks((t or "").encode()) if i is not None else ():
            first[d] = min(first.get(d, i), i)
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        want.append((-1 if i is None else i, len(raw), b"".join(d for d in slow_chunks(raw) if i is None or first[d] >= i)))
    assert got == sorted(want)
    rows = {r.doc_id: r for r in chunk_dedup.dedup(docs).collect()}
    assert rows[2].n_removed > 2800 and rows[2].repeats_of == [1]  # an insertion shifts nothing but the first chunks
    assert 500 < rows[3].n_removed <= len(text(1, 3000)[500:1500].encode()) and rows[6].n_removed == 0


def test_rolling_hash_and_sizes():
    data = np.frombuffer(text(9, 5000).encode(), dtype=np.uint8)
    h = chunk_dedup.gear_hash(data)
    slow = 0
    for k, b in enumerate(data.tolist()):
        slow = (slow * 2 + int(chunk_dedup.GEAR[b])) % 2**32
        assert int(h[k]) == slow
    ends = chunk_dedup.cut(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_dedup.MOST and sizes[:-1].min() >= chunk_dedup.LEAST


def ended(seed, n):
    """Text whose last chunk is ended by its own bytes."""
    t = text(seed, n).encode()
    return t[: chunk_dedup.cut(np.frombuffer(t, dtype=np.uint8))[-3]]


def test_unrelated_documents_stay_whole(spark):
    # a phrase that is a chunk wherever it follows the end of one, and an ending too short for a chunk
    phrases = (text(seed, 40).encode()[:36] for seed in range(1000, 9000))
    phrase = next(p for p in phrases if any(chunk_dedup.cut(np.frombuffer(ended(21, 900) + p + text(22, 300).encode(), dtype=np.uint8))[k] == len(ended(21, 900)) + len(p) for k in range(len(chunk_dedup.cut(np.frombuffer(ended(21, 900), dtype=np.uint8))) + 1)) and not (chunk_dedup.gear_hash(np.frombuffer(p, dtype=np.uint8))[15:-1] & chunk_dedup.MASK == 0).any())
    rows = [(1, ended(21, 900) + phrase + ended(22, 300) + b" Yours."), (2, ended(23, 700) + phrase + ended(24, 400) + b" Yours."), (3, b"Short."), (4, b"Short."), (5, text(25, 400).encode()), (6, text(25, 400).encode())]
    own = [{d for _, _, d in chunk_dedup.chunks(t)} for _, t in rows]
    assert own[0] & own[1]  # they do share a chunk
    got = {r.doc_id: r for r in chunk_dedup.dedup(spark.createDataFrame([(i, t.decode("utf-8", "ignore")) for i, t in rows], "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 5)] == [0, 0, 0, 0] and got[2].repeats_of == [] and bytes(got[2].kept) == rows[1][1]
    assert bytes(got[4].kept) == b"" and bytes(got[6].kept) == b"" and got[6].repeats_of == [5]  # copies go whole, short ones too


def test_short_last_pieces_join_the_chunk_before():
    for seed in range(300):
        t = np.frombuffer(text(seed, 200 + seed).encode(), dtype=np.uint8)
        sizes = np.diff([0, *chunk_dedup.cut(t)])
        assert sizes.sum() == len(t) and sizes.min() >= chunk_dedup.LEAST and sizes.max() <= chunk_dedup.MOST
    tail = np.zeros(chunk_dedup.MOST + 5, dtype=np.uint8)
    assert np.diff([0, *chunk_dedup.cut(tail)]).min() >= chunk_dedup.LEAST


def test_empty_table(spark):
    assert chunk_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
