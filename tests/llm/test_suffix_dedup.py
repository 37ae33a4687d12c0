import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pyspark.sql import functions as F

from tallyweave.llm import suffix_dedup


def brute(rows):
    """Per row (bytes, removed, runs, kept), by a table of all 50-byte strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, dtype=np.uint8)[~gone])))
    return sorted(out)


def random_rows(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abé ") for _ in range(r.randrange(30, 200))) for _ in range(6)]
    rows = []
    for _ in range(40):
        text = ""
        for _ in range(r.randrange(6)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            text += r.choice([p, p[a:], p[:a], "".join(r.choice("abcdefgh") for _ in range(r.randrange(80)))])
        rows.append((r.randrange(60), None if r.random() < 0.05 else text))
    return [*rows, (100, "ab" * 300), (101, "ab" * 200 + "c" + "ab" * 60), (5, "z" * 49), (6, "z" * 50), (7, "z" * 51), (None, "z" * 60), (102, passages[0] * 400)]


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3), (3, 1)])
def test_equals_brute_force(spark, seed, hot):
    rows = random_rows(seed)
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, kept string, n_bytes int")
    cut = suffix_dedup.dedup(docs, shard_bytes=8_000, hot=hot).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut)
    assert got == brute(rows)
    assert all(len(r.spans) == 2 * r.n_spans and sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in cut)


def test_string_ids_equal_brute_force(spark):
    rows = [(None if i is None else f"id{i:05d}", t) for i, t in random_rows(4)]
    cut = suffix_dedup.dedup(spark.createDataFrame(rows, "name string, text string"), id_col="name", shard_bytes=8_000).collect()
    got = sorted((-1 if r.name is None else int(r.name[2:]), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut)
    assert got == brute(random_rows(4))


def test_a_common_phrase_is_spread_over_the_ranges():
    r = random.Random(5)
    phrase = "this phrase of fifty bytes less one is all we share"[:49]
    other = lambda: "".join(r.choice("abcdefghij klmnop") for _ in range(60))
    docs = [pa.table({"id": list(range(k, 2_000, 2)), "text": [other() + phrase + other() for _ in range(k, 2_000, 2)]}) for k in (0, 1)]
    docs = [t.append_column("steps", pa.array(suffix_dedup.steps_of(t.column("text").to_pylist()), pa.binary())) for t in docs]
    sizes = {}
    for hot in (10**9, 500):
        hashes = pa.concat_tables([suffix_dedup.send_hashes(t, k, 10) for k, t in enumerate(docs)])
        told = pa.concat_tables([suffix_dedup.merge_hashes(hashes.filter(pc.equal(hashes["range"], i)), hot) for i in range(10) if i in hashes["range"].to_pylist()])
        sent = pa.concat_tables([suffix_dedup.send_contexts(t, told.filter(pc.equal(told["shard"], k)), 10) for k, t in enumerate(docs)])
        rows = list(zip(sent["range"].to_pylist(), (len(f) // 8 * w for f, w in zip(sent["firsts"].to_pylist(), sent["wide"].to_pylist(), strict=True)), strict=True))
        sizes[hot] = sorted(sum(n for x, n in rows if x == i) for i in range(10))
    assert sizes[10**9][-1] > 10 * sizes[10**9][5]
    assert sizes[500][-1] < 1.5 * sizes[500][5]


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    for text in [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(100)] + [b"x" * 100, b"abcdefghij" * 9, b"\xff\x00" * 20]:
        data = np.frombuffer(text, dtype=np.uint8)
        sa = suffix_dedup.suffix_array(data)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefixes(data, sa)
        for k in range(1, len(text)):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.query_digest(suffix_dedup.dedup(docs)).collect() == []


def test_rows_carry_their_columns(spark):
    passage = "a passage of well over fifty bytes that stands in three of these rows "
    rows = [(3, passage + "c", "x", 1), (1, "a " + passage, None, 2), (None, passage, "n", 3), (2, None, "y", 4), (2, "unlike", "z", 5), (2, passage, "w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a b` string, kept int")
    got = suffix_dedup.dedup(docs, carry=("a b", "kept"), shard_bytes=60).collect()
    assert sorted(((r.doc_id, r.n_bytes, *r.carry) for r in got), key=repr) == sorted(((i, len(t or ""), x, k) for i, t, x, k in rows), key=repr)
    assert {r.carry.c1: r.n_removed > 0 for r in got} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert [f for f in suffix_dedup.dedup(docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id")), carry=("kept",)).columns if f == "carry"] == ["carry"]
